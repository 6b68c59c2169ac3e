"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Texts and items become lower-case words. Training words are streamed through the automaton, which tracks the longest
stretch of item words ending at each place; where it reaches a window's length, the words inside are hit. Items shorter
than the window are windows of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean_batches, table

#: Bytes to bytes: A-Z to lower case, everything that is no letter, digit or non-ASCII byte to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WINDOW = 13
#: Bytes of item text that one automaton, and so one broadcast, may hold; more items are matched block by block.
BLOCK_BYTES = 4_000_000


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, in memory proportional to the items' words.

    States at which a match first reaches the window name the items with these words; short items are named where their
    words end, and ``near`` points from any state to the next such place among its suffixes.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.numbers = {w: n for n, w in enumerate(dict.fromkeys(chain.from_iterable(w for _, w in items)), 1)}
        self.next, self.link, self.length = [{}], [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.numbers[w])
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.holder = list(range(len(self.next)))  # the state of a state's last ``window`` words
        for state in by_length:
            if self.length[self.link[state]] >= window:
                self.holder[state] = self.holder[self.link[state]]
        self.items: dict[int, set] = {}
        self.short: dict[int, list] = {}
        for item, words in items:
            state = 0
            for n, w in enumerate(words, 1):
                state = self.next[state][self.numbers[w]]
                if n >= window:
                    self.items.setdefault(self.holder[state], set()).add(item)
            if 0 < len(words) < window:
                self.short.setdefault(state, []).append((len(words), item))
        self.near = [0] * len(self.next)
        for state in by_length:
            self.near[state] = state if state in self.short else self.near[self.link[state]]
        sizes = [len(w) for _, w in items if w]
        self.shortest = min([window, *sizes])

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length

        def split(p: int, q: int) -> int:
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = clone
            while p >= 0 and nxt[p].get(word) == q:
                nxt[p][word] = clone
                p = link[p]
            return clone

        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else split(last, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word spans ``[start, end)`` that lie inside windows, and the items whose windows occur."""
        get = self.numbers.get
        numbers = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        spans: list[tuple[int, int]] = []
        found: set = set()
        edges = np.flatnonzero(np.diff(np.concatenate(([0], numbers > 0, [0])).astype(np.int8)))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= self.shortest:  # words of no item end every match, so these runs are walked alone
                self._walk(numbers[start:end].tolist(), start, spans, found)
        return spans, found

    def _walk(self, numbers: list[int], base: int, spans: list, found: set) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for at, n in enumerate(numbers, base + 1):
            while state and n not in nxt[state]:
                state = link[state]
                size = length[state]
            if n in nxt[state]:
                state = nxt[state][n]
                size += 1
            hit = 0
            if size >= window:
                found |= self.items[self.holder[state]]
                hit = window
            place = self.near[state]
            while place:
                for n_words, item in self.short[place]:
                    if n_words <= size:
                        found.add(item)
                        hit = max(hit, n_words)
                place = self.near[link[place]]
            if hit:
                if spans and at - hit <= spans[-1][1]:
                    start = min(spans[-1][0], at - hit)
                    while len(spans) > 1 and spans[-2][1] >= start:
                        spans.pop()
                        start = min(start, spans[-1][0])
                    spans[-1] = (start, at)
                else:
                    spans.append((at - hit, at))


_automata: dict[str, SuffixAutomaton] = {}


def automaton_of(shared, window: int) -> SuffixAutomaton:
    """The automaton of a broadcast block, built once by a worker process and replaced by the next block's."""
    name, items = shared.value
    if (key := f"{name}-{window}") not in _automata:
        _automata.clear()
        _automata[key] = SuffixAutomaton([(i, words_of(t)) for i, t in items], window)
    return _automata[key]


def item_blocks(spark: SparkSession, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple]:
    """``(broadcast, last)`` of the test items in blocks of bounded size, one at a time: all items at once where a check of
    their size allows, else by hashed block."""
    source = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = source.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for block in range(blocks):
        part = source if blocks == 1 else source.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.item_id, r.text) for r in part.collect()]))
        yield shared, block == blocks - 1


def union_spans(one: list, other: list) -> list[tuple[int, int]]:
    """Spans of both lists in order, overlapping and touching ones as one."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted([*map(tuple, one), *map(tuple, other)]):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


SPANS = pa.list_(pa.list_(pa.int32()))


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, text`` x ``item_id, text`` -> ``doc_id, n_words, spans, items`` of every row of ``docs``.

    ``spans`` are merged word spans ``[start, end)`` inside item windows, ``items`` the ids whose windows occur. The
    items are a stated query set: they are broadcast as one automaton where their checked size allows, else all rows pass
    one block of items after another and gather spans on the way, written to the shared folder in between, so that a task
    holds one block. Rows stay where they are, without a shuffle. Null or empty text has no words; the words of an item
    without an id are hit, but no id is listed for it; repeated rows stay apart; without items nothing is hit; extra
    columns are dropped; an empty table gives no rows.
    """
    lean_batches(docs.sparkSession)
    schema = "doc_id long, text string, n_words long, spans array<array<int>>, items array<long>"
    rest = docs.select(F.col("doc_id").cast("long"), "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<long>").alias("items"))
    for shared, last in item_blocks(docs.sparkSession, items, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            automaton = automaton_of(shared, window)
            for batch in batches:
                sizes, spans, names = [], [], []
                for text, before, known in zip(batch.column("text"), batch.column("spans"), batch.column("items")):
                    words = words_of(text.as_py() or "")
                    own, found = automaton.scan(words)
                    sizes.append(len(words))
                    spans.append(union_spans(own, before.as_py()) if len(before) else own)
                    names.append(sorted({*known.as_py(), *found} - {None}) if found or len(known) else [])
                text = pa.nulls(len(batch), pa.string()) if last else batch.column("text")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, pa.array(sizes, pa.int64()), pa.array(spans, SPANS), pa.array(names, pa.list_(pa.int64()))], ["doc_id", "text", "n_words", "spans", "items"])

        rest = rest.mapInArrow(run, schema)
        if not last:
            rest = cut(rest, "hits")
            shared.unpersist()
    return rest.drop("text")


def contamination(hits: DataFrame) -> DataFrame:
    """Digest columns of ``find_hits``: a row is contaminated when a twentieth of its words or more are hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    named = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans`` (word spans as ``SuffixAutomaton.scan`` gives them) and what lies between them."""
    raw, folded = text.encode(), text.encode().translate(FOLD)
    space = np.frombuffer(folded, np.uint8) == 32
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for first, last in spans:
        kept.append(raw[at : starts[first]])
        at = int(ends[last - 1])
    return b"".join([*kept, raw[at:]]).decode()


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.05, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without rows that items cover to ``coverage`` or more, and without item windows in the rows that stay.

    All blocks of items see the whole text and gather spans on the way, as in ``find_hits``; after the last one their union
    is judged and cut once, so the blocks' size is no part of the result. Columns stay as they are but for ``text`` and,
    if there, ``n_chars``. Rows without hits keep their text, null included; repeated rows are judged alike; without items
    all stay.
    """
    lean_batches(docs.sparkSession)
    columns, schema = docs.columns, docs.schema
    gathered = "spans" + "_" * max(map(len, columns))  # no column of docs
    rest = docs.withColumn(gathered, F.array().cast("array<array<int>>"))
    passed = rest.schema
    for shared, last in item_blocks(docs.sparkSession, items, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            automaton = automaton_of(shared, window)
            for batch in batches:
                texts, keep, rows, changed = [], [], [], False
                for text, before in zip(batch.column("text").to_pylist(), batch.column(gathered)):
                    words = words_of(text or "")
                    own, _ = automaton.scan(words)
                    spans = union_spans(own, before.as_py()) if len(before) else own
                    hit = sum(b - a for a, b in spans)
                    keep.append(not last or not hit or hit < coverage * len(words))
                    cutting = last and hit and keep[-1]
                    texts.append(cut_spans(text, spans) if cutting else text)
                    rows.append([] if last else spans)
                    changed |= bool(cutting)
                if changed:
                    batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
                batch = batch.set_column(batch.schema.get_field_index(gathered), gathered, pa.array(rows, SPANS))
                yield batch.filter(pa.array(keep, pa.bool_()))

        rest = rest.mapInArrow(run, passed)
        if not last:
            rest = cut(rest, "hits")
            shared.unpersist()
    rest = rest.drop(gathered)
    if "n_chars" in columns:
        rest = rest.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(schema["n_chars"].dataType))
    return rest


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``, 13-word windows; cases as in ``find_hits``."""
    return contamination(find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
