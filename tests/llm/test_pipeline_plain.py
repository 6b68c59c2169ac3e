"""The pipeline's stages against plain readings of their contracts, none of which uses the stages' own code."""

import re

import corpus_pipeline
import public_tokenizers
import pytest
from conftest import DATA
WORD, BENCH = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
fold = lambda text: "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output rows."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, DATA).collect()
        out[name] = docs.collect(), rows
        docs = spark.createDataFrame(rows, docs.schema) if name != "sentencepiece" else docs
    return out


def test_toxic_documents_go(spark):
    data = DATA.replace("sf0.001", "sf0.01")  # the smallest tables have too few labels to learn from
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before, after = docs.collect(), corpus_pipeline.STAGES[0][1](spark, docs, data).collect()
    kept = {r.doc_id for r in after}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.toxic is not None}
    clean, toxic = ([i for i, y in labels.items() if y == want] for want in (0, 1))
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i not in kept for i in toxic) >= 0.6 * len(toxic) > 0
    assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = stages["ngram_jaccard"]
    sets = {}
    for r in before:
        words = WORD.findall(fold(r.text))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert sorted(r.doc_id for r in after) == [i for i in ids if find(i) == i]


def test_benchmark_windows_go(spark, stages):
    before, after = stages["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        words = BENCH.findall(fold(r.text))
        n = min(13, len(words))
        windows |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    sizes, want = {len(w) for w in windows}, {}
    for r in before:
        words = BENCH.findall(fold(r.text))
        hit = {p for n in sizes for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows for p in range(i, i + n)}
        if not hit or 20 * len(hit) < len(words):
            want[r.doc_id] = [w for p, w in enumerate(words) if p not in hit]
    assert {r.doc_id: BENCH.findall(fold(r.text)) for r in after} == want
    assert all((r.n_chars == len(r.text)) for r in after if r.text is not None) and len(want) < len(before)


def test_personal_data_go(stages):
    before, after = stages["pii"]
    assert [r.doc_id for r in sorted(after, key=lambda r: r.doc_id)] == sorted(r.doc_id for r in before)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    address = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    clear = lambda m: all(int(p) <= 255 for p in m[0].split("."))
    had = {r.doc_id for r in before if email.search(r.text or "")}
    assert had and not any(email.search(r.text or "") for r in after)
    assert not any(clear(m) for r in after for m in address.finditer(r.text or ""))
    texts = {r.doc_id: r.text for r in before}
    untouched = [r for r in after if not re.search(r"[0-9@]", texts[r.doc_id] or "")]
    assert untouched and all(r.text == texts[r.doc_id] for r in untouched)


def test_encoding_is_the_library_s(stages):
    import sentencepiece

    before, after = stages["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {r.doc_id: library.encode(r.text or "") for r in before}
    assert {r.doc_id: (r.n_tokens, list(r.ids), r.decoded) for r in after} == {i: (len(ids), ids, library.decode(ids)) for i, ids in want.items()}
