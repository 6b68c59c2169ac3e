"""Queries that once did a part of their job: what they answer is held against the whole of it."""

import hashlib

from conftest import DATA
from pyspark.sql import functions as F

from deskbook.operators import chunking, retrieval
from deskbook.plans.queries import QUERIES
from deskbook.sources.views import view


def test_citations_are_those_of_the_search(spark):
    keys = ("query_id", "rank", "chunk_id", "score")
    found = QUERIES["bm25_top_k"](spark, DATA).select(*keys).collect()
    assert sorted(map(tuple, QUERIES["citation_rows"](spark, DATA).select(*keys).collect())) == sorted(map(tuple, found))


def test_prompts_hold_what_the_search_finds(spark):
    found = QUERIES["bm25_top_k"](spark, DATA)
    made = retrieval.prompt_contexts(found, view(spark, DATA, "v_chunks1"), view(spark, DATA, "v_queries"), "Answer from these excerpts.")
    want = made.select("query_id", F.sha2("prompt", 256)).collect()
    assert sorted(map(tuple, QUERIES["prompts"](spark, DATA).select("query_id", "prompt_sha").collect())) == sorted(map(tuple, want))


def test_sections_hold_whole_bodies(spark):
    own = {a.doc_id: a for a in view(spark, DATA, "v_articles").collect()}
    want = []
    for a in own.values():
        text = f"## First\n{a.body_markdown}\n\n#### Second\n{a.body_markdown}\n### Third\n## Fourth\n\n{a.body_markdown}"
        want += [(a.doc_id, n, " > ".join(path), hashlib.sha256(t.encode()).hexdigest()) for n, (path, t) in enumerate(chunking.chunk_text(text, a.title))]
    got = QUERIES["section_chunks"](spark, DATA).select("doc_id", "n", "path", "text_sha").collect()
    assert sorted(map(tuple, got)) == sorted(want)
