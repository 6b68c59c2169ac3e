"""The pipeline's stages on rows that are null, empty, repeated or oddly named, and a hot passage in the near-duplicate stage."""

import random

import corpus_pipeline
import pytest
from conftest import DATA
from pyspark.sql import types as T

from deskbook.llm import ngramjoin
from test_joins import Union, shingle_set

EXTRA = ("toxic_score", "offending", "component_id", "spans", "base", "terms", "private", "rep", "ids")


def odd_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.StringType()) for c in EXTRA)])
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(None, None, None, None, None), (None, words, "en", "s", 5), (1_000_001, None, None, None, None), (1_000_002, "", "en", "s", 0), (1_000_003, words, "en", "s", 5), (1_000_003, words, "en", "s", 5),
            (1_000_004, words + " more", None, None, None), (1_000_005, "x@y.example.com " * 3000, "en", "s", 5), (1_000_006, "a" * 100_000, "en", "s", 5), (1_000_007, " \n ", "en", "s", 3)]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], schema), rows


def test_stages_on_odd_rows(spark):
    docs, rows = odd_documents(spark)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, DATA).collect(), docs.schema)
        got = kept.collect()
        assert kept.columns == docs.columns and all(r[c] == c for r in got for c in EXTRA), name
        ids = [r.doc_id for r in got]
        if name == "toxicity":
            assert len(got) == len(rows)
        else:  # one row of the repeated id, the near copy of a larger id gone, rows without an id or words all there
            assert sorted(i for i in ids if i) == [1_000_001, 1_000_002, 1_000_003, 1_000_005, 1_000_006, 1_000_007] and ids.count(None) == 2, name
        if name == "pii":
            assert {r.text for r in got if r.doc_id == 1_000_005} == {"<EMAIL> " * 3000} and {r.text for r in got if r.doc_id == 1_000_001} == {None}
    final = corpus_pipeline.STAGES[-1][1](spark, kept, DATA).collect()
    assert {r.doc_id: r.decoded for r in final if r.doc_id} == {r.doc_id: r.text or "" for r in kept.collect() if r.doc_id} and len(final) == 8


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, stage):
    docs, _ = odd_documents(spark)
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_large_sets_with_a_hot_passage(spark, monkeypatch):
    own, rows = random.Random(3), []
    passage, common = [f"p{i}" for i in range(60)], [f"c{i}" for i in range(40)]
    for k in range(150):  # a third with the passage alone beside their own words, some made of passages, chains of near copies
        words = [f"w{own.randrange(10**6)}" for _ in range(own.choice([8, 60, 90]))]
        rows.append(" ".join(passage + words if k % 3 == 0 else words + common * (k % 5 == 0)))
        if k % 10 == 0:
            for _ in range(12):
                words[own.randrange(len(words))] = f"w{own.randrange(10**6)}"
                rows.append(" ".join(passage + words if k % 20 else words))
    rows += [" ".join(passage + common + [f"e{i}"] * (i % 7)) for i in range(40)]
    sim = ngramjoin.Similarity(5, 80, 100)
    sets = {i: shingle_set(t, 5) for i, t in enumerate(rows)}
    want = Union(sets)
    for a in sets:
        for b in range(a + 1, len(sets)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                want.link(a, b)
    monkeypatch.setattr(ngramjoin, "BLOCK", 4)
    monkeypatch.setattr(ngramjoin, "MAIN_BLOCK", 8)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = ngramjoin.jaccard_components(df, sim).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want.find(i)) for i, s in sets.items()}
