"""Chat, tokens, pieces, decontamination: against libraries, brute force and exact round trips."""

import hashlib
import random
import re

import public_tokenizers as P
import pytest
from conftest import DATA

from deskbook.llm import chat, decontaminate, pieces, tokens

R = random.Random(4)


def test_chat_round_trip():
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "[\\INST]", "<\\\\s>", "[SYS]", "[AS]", "[/ROLE]", "x", "<", "[", "/", " ", "\n", "é"]
    for _ in range(3000):
        role = R.choice(["user", "assistant", "system", "", "tool", "[AS]", "<\\s>"])
        text = "".join(R.choice(parts) for _ in range(R.randint(0, 8)))
        piece, start, end = chat.format_turn(role, text)
        (back,) = chat.parse(piece)
        assert back[:2] == (role, text) and chat.unescape(piece[start:end]) == text
    assert chat.parse("x") is None and chat.parse("<s>[INST]a") is None and chat.parse("<s>[INST]a[/BOT]</s>") is None
    assert chat.format_turn("user", "plain")[0] == "<s>[INST]plain[/INST]</s>"


def test_chat_table(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, 0, None, None, 0), (None, None, "user", "z", 0), (3, 0, "assistant", "same", 0), (3, 0, "assistant", "same", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and got[1].loss_chars == 1
    assert (got[2].n_turns, got[3].loss_chars, got[None].n_turns) == (1, 8, 1)
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


def test_conversations_are_parsed_as_a_whole(spark):
    parts = [("user", "a</s>"), ("tool [AS]", "b[INST]"), ("assistant", "[\\INST] c"), ("", "")] * 3
    text = "".join(chat.format_turn(r, t)[0] for r, t in parts)
    for size in (1, 2, 5, 7, len(text)):  # whatever the parts that the text comes in
        parser = chat.Parser()
        turns = [t for at in range(0, len(text), size) for t in parser.feed(text[at : at + size])]
        assert [t[:2] for t in turns] == parts and not parser.rest
    assert [t[:2] for t in chat.parse(text)] == parts and chat.parse(text[:-1]) is None and chat.parse(text + "x") is None
    reading = chat.Reading(1)
    with pytest.raises(ValueError):  # a piece whose text runs into the next one
        reading.add("<s>[INST]a", None, None, b"")
        reading.add("<s>[INST]b[/INST]</s>", None, None, b"")
        reading.row()
    big = (1 << 53) + 1
    df = spark.createDataFrame([(big, i, "assistant", f"{i} " * 50) for i in range(20_000)] + [(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    learnt = "".join(f"{i} " * 50 for i in range(20_000))
    assert set(got) == {big, None} and got[big].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest() and got[big].n_turns == 20_000


TEXTS = ["", " ", "  a", "a    b\n\n  c ", "\x00\t", "日本語", "😀 a😀b", "<s> </s> <unk>", "a" * 400, "é é", "=====", "it's we'll 'Sx <|endoftext|> x", "x\x1cy ½ ª", "the cat " * 500]
TEXTS += ["".join(R.choice("abcdeeett  \n.,thein▁é日ñ😀<>/s=_-01") for _ in range(R.randint(0, 60))) for _ in range(500)]


def test_pieces_match_the_library():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    for t in TEXTS:
        ids = lib.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids)
    packed = pieces.Encoder(path, tuple)
    packed.words.most = packed.others.most = 7  # forgets all the time
    for t in [*TEXTS, "\n", "\n\na", "a\n", " \n b", "a \n  b\n", "▁a▁"]:
        ids = lib.encode(t)
        assert [i for part in packed.parts(t) for i in part] == ids and packed.decoded(t) == lib.decode(ids)


def test_very_long_words_take_linear_time():
    import sentencepiece
    import time

    path = P.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    word = "".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000))
    own.encode(word)
    assert own.encode(word * 4) == lib.encode(word * 4)
    took = []
    for n in (10, 40):
        began = time.process_time()
        own.encode(word * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_pieces_of_documents_match_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(r.doc_id, len(ids := lib.encode(r.text or "")), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {tuple(r) for r in pieces.op9_sentencepiece(spark, DATA).collect()} == want


def test_piece_table(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(1, None, 1), (big, "a b", 1), (big, "a b", 1), (None, "", 1)], "doc_id long, text string, ids int")
    path = P.path("piece_bpe_32k.model")
    digests, texts = pieces.encoding_digests(df, path).collect(), pieces.encode_texts(df, path).collect()
    assert sorted(r.n_tokens for r in digests) == [0, 0, 2, 2] and sorted(r.decoded for r in texts) == ["", "", "a b", "a b"]
    assert sorted((r.doc_id for r in digests), key=str) == sorted([None, 1, big, big], key=str)
    for d, t in zip(sorted(digests, key=str), sorted(texts, key=lambda r: str(r.doc_id))):
        assert d.decoded_sha256 in {hashlib.sha256(x.decoded.encode()).hexdigest() for x in texts} and t.ids is not None
    assert pieces.encode_texts(df.limit(0), path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_match_the_library(name):
    count = tokens.Counter(P.path(name))
    assert [count(t) for t in TEXTS] == count.whole(TEXTS)


def test_cache_encodes_misses_alone(spark, tmp_path):
    path, file = str(tmp_path / "cache"), P.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "one two", 0), (2, "one two", 0), (3, None, 0), (3, None, 0)], "doc_id long, text string, n_tokens int")
    first = {(r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_with_cache(df, file, path).collect()}
    assert first == {(1, 7, 2), (2, 7, 2), (3, 0, 0)}
    before = spark.read.parquet(path).count()
    more = df.unionByName(spark.createDataFrame([(4, "three", 0)], df.schema))
    assert tokens.count_with_cache(more, file, path).count() == 5
    assert spark.read.parquet(path).count() == before + 1
    assert tokens.count_with_cache(df.limit(0), file, str(tmp_path / "other")).count() == 0


@pytest.mark.parametrize("broadcast", [tokens.MOST_BROADCAST, 0])
def test_repeated_and_null_ids_are_encoded_once(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(tokens, "MOST_BROADCAST", broadcast)
    path, file = str(tmp_path / "cache"), P.path("byte_bpe_50k.json")
    rows = [(1, "one two")] * 4 + [(1, "three")] * 3 + [(None, "one two"), (None, "three"), (2, None), ((1 << 53) + 1, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part, size in ((rows[:9], 2), (rows, 4), (rows, 4)):
        got = tokens.count_with_cache(spark.createDataFrame(part, df.schema), file, path).collect()
        assert spark.read.parquet(path).count() == size and len(got) == len(part)
    count = tokens.Counter(file)
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=i, n_bytes=len((t or "").encode()), n_tokens=count.whole([t or ""])[0])) for i, t in rows)


def test_counts_of_documents_match_the_library(spark):
    whole, docs = tokens.Counter(P.path("byte_bpe_50k.json")).whole, spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {(r.doc_id, len((r.text or "").encode()), n, n > 1024) for r, n in zip(docs, whole([r.text or "" for r in docs]))}
    assert {tuple(r) for r in tokens.op6_token_counts(spark, DATA).collect()} == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window):
    words = lambda t: WORD.findall(t.translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    w, hit, found = words(text), set(), set()
    for n in {len(k) for k in windows}:
        for k in range(len(w) - n + 1):
            if own := windows.get(tuple(w[k : k + n])):
                hit |= set(range(k, k + n))
                found |= own
    return len(w), len(hit), sorted(found)


def test_automaton_against_brute_force():
    for _ in range(300):
        make = lambda n, k: " ".join(R.choice("abcd"[:k]) for _ in range(R.randint(0, n)))
        k, window = R.randint(1, 4), R.randint(2, 6)
        items = [(i, make(12, k)) for i in range(R.randint(0, 5))]
        automaton = decontaminate.SuffixAutomaton([(i, decontaminate.words_of(t)) for i, t in items], window)
        for text in (make(40, 4) for _ in range(8)):
            w = decontaminate.words_of(text)
            spans, found = automaton.scan(w)
            assert (len(w), sum(b - a for a, b in spans), sorted(found)) == brute_hits(text, items, window)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 60])
def test_contamination_table(spark, block_bytes):
    item, filler = " ".join(f"w{i}" for i in range(20)), " ".join(f"f{i}" for i in range(400))
    items = spark.createDataFrame([(1, item), (2, "Lone Short item"), (3, None)], "item_id long, text string")
    rows = [(1, f"{filler} {item.upper()}! tail"), (2, None), (3, item), (4, "a lone, short-item b"), (5, "clean"), (6, f"{filler} " * 2 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hits = {r.doc_id: r for r in decontaminate.contamination(decontaminate.find_hits(docs, items, block_bytes=block_bytes)).collect()}
    assert {i: (h.n_hit, h.n_items, h.contaminated) for i, h in hits.items()} == {1: (20, 1, False), 2: (0, 0, False), 3: (20, 1, True), 4: (3, 1, True), 5: (0, 0, False), 6: (20, 1, False)}
    kept = {r.doc_id: r.text for r in decontaminate.remove_contamination(docs, items, block_bytes=block_bytes).collect()}
    assert set(kept) == {1, 2, 5, 6} and kept[1] == f"{filler} ! tail" and kept[5] == "clean" and kept[2] is None
    assert decontaminate.find_hits(docs, items.limit(0)).where("size(spans) > 0").count() == 0


def test_removal_judges_all_blocks_at_once(spark):
    words, filler = [f"w{i}" for i in range(30)], " ".join(f"f{i}" for i in range(400))
    a, b = " ".join(words[:20]), " ".join(words[14:])  # without the words of a, what is left of b is shorter than a window
    c, d = (" ".join(f"{k}{i}" for i in range(13)) for k in "cd")
    items = spark.createDataFrame([(1, a), (2, b), (3, c), (4, d)], "item_id long, text string")
    rows = [(1, f"{filler} {c} z {d}", 7), (2, f"{filler} {filler} {' '.join(words)} tail", 7), (3, None, 7), (4, f"x {a} {filler} {filler}", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    one, many = ({r.doc_id: (r.text, r.spans) for r in decontaminate.remove_contamination(docs, items, block_bytes=n).collect()} for n in (decontaminate.BLOCK_BYTES, 50))
    assert one == many == {2: (f"{filler} {filler}  tail", 7), 3: (None, 7), 4: (f"x  {filler} {filler}", 7)}  # 26 of 427 words are hit in row 1


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 40])
def test_hits_of_odd_rows(spark, block_bytes):
    big, item = (1 << 53) + 1, " ".join(f"w{i}" for i in range(13))
    items = spark.createDataFrame([(1, item, "x"), (None, "lone words", "x"), (2, item, "x"), (2, item, "x"), (3, "", "x")], "item_id long, text string, spans string")
    rows = [(big, f"{item} z", "x"), (big, f"{item} z", "x"), (None, "Lone words here", "x"), (4, None, "x"), (5, "", "x"), (6, ("filler " * 50 + item + " ") * 2000, "x"), (7, f"{item} {item}", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(decontaminate.find_hits(docs, items, block_bytes=block_bytes)).collect())
    assert got == sorted([(str(big), 14, 13, 2, True)] * 2 + [("None", 3, 2, 0, True), ("4", 0, 0, 0, False), ("5", 0, 0, 0, False), ("6", 126_000, 26_000, 2, True), ("7", 26, 26, 2, True)])
    assert decontaminate.find_hits(docs.limit(0), items).count() == 0 and decontaminate.find_hits(docs, items.limit(0)).where("size(items) > 0").count() == 0


def test_matches_longer_than_a_window_are_tracked():
    words = [f"w{i}" for i in range(40)]
    automaton = decontaminate.SuffixAutomaton([(1, [w.encode() for w in words]), (2, [w.encode() for w in words[10:30]])], 13)
    assert automaton.scan([w.encode() for w in ["x", *words, "y", *words[20:33]]]) == ([(1, 41), (42, 55)], {1, 2})
