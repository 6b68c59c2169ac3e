"""SentencePiece encoding and decoding of merge-type models by backtracking.

A sequence of tokens is the merge encoding of its text exactly if every two neighbours stay apart when their joined text
is merged again. The encoder therefore walks the text taking the longest vocabulary match at each place (found for all
places at once by an Aho-Corasick automaton), accepts a token when it is compatible with the one before, else tries its
next shorter prefix, and steps back when none is left; a bit field keeps the places known to lead nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean_batches, table

SPACE = "▁"
#: Chunks that a worker remembers in each of two generations, and the longest that it remembers: bounds its memory.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 48
#: Rows whose ids are made at once.
SLICE = 500


class Remembered(dict):
    """What ``learn`` makes of each key, remembered for two generations of ``most`` keys: common keys stay, rare ones go."""

    def __init__(self, learn: Callable[[str], object], most: int = REMEMBERED):
        super().__init__()
        self.learn, self.most, self.old = learn, most, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.learn(key)
            if len(key) > LONGEST_REMEMBERED:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceModel:
    """Vocabulary of a merge-type model with byte fallback, identity normalisation and a leading space."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank, self.ids, self.text, self.byte_ids = {}, {}, {}, {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not lib.is_control(i) and not lib.is_unknown(i):
                self.ids[piece], self.rank[piece] = i, -lib.get_score(i)
        self.of_byte = {i: b for b, i in self.byte_ids.items()}
        self.piece_of = {i: p for p, i in self.ids.items()}
        self.alphabet = {c for p in self.ids if len(p) > 1 for c in p}
        self.known = self.alphabet | {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece in (*self.ids, *(c for c in self.alphabet if c not in self.ids)):
            if self.merge(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.whole = {p for p in self.automaton}
        self.reach, self.shorter = max(map(len, self.whole)), {}
        self.compatible = lru_cache(maxsize=100_000)(lambda a, b: self.merge(a + b) == [a, b])
        #: No piece has a space after another character: no merge crosses such a place.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def merge(self, text: str) -> list[str]:
        """Merge neighbours of a short text, best rank first and leftmost at ties, as training did."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def prefix(self, piece: str) -> str | None:
        """The longest token that is a proper prefix of ``piece``."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.whole), None)
        return self.shorter[piece]

    def longest(self, text: str, at: int) -> str:
        """The longest token at a place that the run of longest matches steps over."""
        found = text[at : at + self.automaton.longest_prefix(text[at : at + self.reach])]
        return found if found in self.whole else self.prefix(found)

    def split(self, text: str) -> list[str]:
        """Tokens of a text whose characters all stand in the vocabulary's alphabet, by backtracking."""
        ahead = {end - len(token) + 1: token for end, token in self.automaton.iter_long(text)}  # one longest match behind another
        closed, tokens, at, last = bytearray(len(text) + 1), [], 0, None
        compatible, token = self.compatible, ahead.get(0)
        while token is not None:
            end = at + len(token)
            if not closed[end] and (last is None or compatible(last, token)):
                tokens.append(token)
                at, last = end, token
                token = (ahead.get(at) or self.longest(text, at)) if at < len(text) else None
                continue
            token = self.prefix(token)
            while token is None:
                closed[at] = 1
                token = tokens.pop()  # its end is closed now, so a shorter one is tried
                at -= len(token)
                last = tokens[-1] if tokens else None
                token = self.prefix(token)
        return tokens

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk that starts and ends where no merge can cross; characters of no piece become bytes."""
        if self.known.issuperset(chunk):
            return self._ids(chunk)
        ids, start = [], 0
        for i in range(len(chunk) + 1):
            if i == len(chunk) or chunk[i] not in self.known:
                ids += self._ids(chunk[start:i])
                if i < len(chunk):
                    ids.extend(self.byte_ids[b] for b in chunk[i].encode())
                start = i + 1
        return ids

    def _ids(self, run: str) -> list[int]:
        own, tokens = self.ids, self.split(run)
        try:
            return [own[t] for t in tokens]
        except KeyError:
            return [i for t in tokens for i in ([own[t]] if t in own else [self.byte_ids[b] for b in t.encode()])]

    def chunks(self, text: str) -> list[str]:
        """Parts of the text with its leading space: words with the spaces before them, and line feeds."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if not self.splits:
            return [SPACE + text.replace(" ", SPACE)]
        found: list[str] = []
        for n, line in enumerate(text.split("\n") if "\n" not in self.known else [text]):
            found += ["\n"] * (n > 0) + self.line_chunks(line, n == 0)
        return found

    def line_chunks(self, line: str, first: bool) -> list[str]:
        """Chunks of one line; the text's first line has a space before it."""
        found, spaces = [], int(first)
        for k, w in enumerate(line.split(" ")):
            spaces += k > 0
            if w:
                found.append(SPACE * spaces + w)
                spaces = 0
        return [*found, SPACE * spaces] if spaces else found

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.encode_chunk(c)]

    def decode_part(self, ids: list[int]) -> str:
        out = bytearray()
        for i in ids:
            out += bytes([self.of_byte[i]]) if i in self.of_byte else self.piece_of[i].replace(SPACE, " ").encode()
        return out.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the leading space that encoding put there goes."""
        text = self.decode_part(ids)
        return text[1:] if text.startswith(" ") and ids and ids[0] not in self.of_byte else text


class Encoder:
    """Encodes whole texts chunk by chunk, each chunk's ids in the form that ``pack`` gives them."""

    def __init__(self, path: str, pack: Callable[[list[int]], object]):
        self.model, self.pack, self.odd = PieceModel(path), pack, {}
        self.words = Remembered(lambda word: self._learn(SPACE + word))
        self.others = Remembered(self._learn, REMEMBERED // 4)
        self.lines = "\n" not in self.model.known

    def _learn(self, chunk: str):
        ids = self.model.encode_chunk(chunk)
        if (back := self.model.decode_part(ids)) != chunk.replace(SPACE, " "):
            self.odd[chunk] = back  # characters that don't come back as they were
        return self.pack(ids)

    def parts(self, text: str) -> list:
        """The packed ids of the text's chunks in order."""
        if not text or not self.model.splits:
            return [self.others[c] for c in self.model.chunks(text)]
        text, found = text.replace(SPACE, " "), []
        for n, line in enumerate(text.split("\n") if self.lines else [text]):
            words = line.split(" ")
            if "" in words:  # runs of spaces belong to the word behind them
                found += [self.others[c] for c in (*["\n"] * (n > 0), *self.model.line_chunks(line, n == 0))]
                continue
            if n:
                found += [self.others["\n"], self.others[words.pop(0)]]
            found += map(self.words.__getitem__, words)
        return found

    def decoded(self, text: str) -> str:
        """The text that the ids of ``text`` decode to: the text itself but for its odd chunks."""
        if not self.odd:
            return text.replace(SPACE, " ")
        return "".join([self.odd.get(c, c) for c in self.model.chunks(text)]).replace(SPACE, " ")[1:]


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> Encoder:
    """A worker's encoder, kept between its tasks."""
    return Encoder(path, (lambda ids: np.array(ids, np.int32).tobytes()) if kind == "bytes" else lambda ids: ",".join(map(str, ids)))


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, ids, decoded``: exact ids of whole texts and the text they decode to.

    Row-local, no shuffle. Null and empty texts have no ids and decode to the empty text; repeated rows stay; an empty
    table gives no rows; extra columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path, "bytes")
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                texts = [t.as_py() or "" for t in part.column("text")]
                ids = [b"".join(own.parts(t)) for t in texts]
                ends = np.cumsum([0, *[len(i) // 4 for i in ids]])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array([own.decoded(t) for t in texts], pa.string())], ["doc_id", "ids", "decoded"])

    lean_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of whole texts, made beside the encoding inside the task.

    The same encoder as in ``encode_texts``, but ids never leave the worker: a chunk is remembered as its id string, and
    digests take these parts in order. Cases as there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest = encoder(model_path, "text"), lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            sizes, ids, decoded = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                joined = ",".join(own.parts(text))
                sizes.append(joined.count(",") + 1 if joined else 0)
                ids.append(digest(joined))
                decoded.append(digest(own.decoded(text)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    lean_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` with the public model ``piece_bpe_32k``; cases as in ``encode_texts``."""
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
