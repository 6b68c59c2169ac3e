"""Registered queries against their SQL, and the pipeline's stages against what they promise."""

import corpus_pipeline
import pytest
from conftest import DATA

from deskbook.llm import decontaminate, ngramjoin, toxicity
from deskbook.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda f: sorted(tuple("" if str(v) in ("None", "nan", "<NA>") else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert plain(got) == plain(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA).cache()
        assert kept.columns == docs.columns and kept.count() <= before.count(), name
        if name == "toxicity":
            model = toxicity.fit(toxicity.labelled_sample(docs, spark.read.parquet(f"{DATA}/labels.parquet")))
            score = model.scorer()
            assert {r.doc_id for r in docs.collect() if score(r.text or "")[0] < toxicity.THRESHOLD} == {r.doc_id for r in kept.collect()}
        if name == "ngram_jaccard":
            groups = ngramjoin.jaccard_components(before, ngramjoin.Similarity(5, 80, 100))
            assert {r.component_id for r in groups.collect()} == {r.doc_id for r in kept.collect()}
        if name == "decontamination":
            hits = decontaminate.contamination(decontaminate.find_hits(kept, spark.read.parquet(f"{DATA}/benchmark.parquet")))
            assert hits.where("contaminated").count() == 0
        if name == "pii":
            assert kept.count() == before.count() and kept.where("text rlike '[0-9]@[a-z0-9]+[.]example'").count() == 0
    final = corpus_pipeline.STAGES[-1][1](spark, kept, DATA).collect()
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id: r.decoded for r in final} == texts
