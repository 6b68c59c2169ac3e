"""Divergence of sources against a plain computation in exact numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from deskbook.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(docs, ranks=200):
    own, seen, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        own[lang, source].update(terms)
        seen[lang].update(set(terms))
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = sorted((t for t, n in seen[lang].items() if n >= 3), key=str.encode)
        total = Counter()
        for s in names:
            total.update(own[lang, s])

        def shares(counts):
            of = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // of for t in kept}

        p, q = {s: shares(own[lang, s]) for s in names}, shares(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in names:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in names if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if own[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, v, r) for r, (item, v) in enumerate(items, 1) if part == "pair" or r <= ranks]
    return sorted(out)


@pytest.mark.parametrize("sources, broadcast", [(5, 100_000), (70, 100_000), (5, 0)])
def test_against_a_plain_computation(spark, monkeypatch, sources, broadcast):
    monkeypatch.setattr(divergence, "MOST_BROADCAST", broadcast)
    rng = np.random.default_rng(sources)
    words = ["der", "Die", "été", "ÉTÉ", "x", "Zz", "\U0001f600", "ﬁ", "é", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(5))]
    shares = 1 / np.arange(1, len(words) + 1)
    docs = [(str(rng.choice(["en", "de"])), f"s{rng.integers(sources)}", " ".join(rng.choice(words, int(rng.integers(0, 30)), p=shares / shares.sum())) + "7!") for _ in range(240)]
    docs += [("fr", "a", "seul"), ("fr", "b", None), (None, None, "der der der"), (None, "k", ""), ("", "k", "der"), ("", "k", "der x"), ("ru", "one", "a a a")]
    docs += [("en", "s0", "copy der die")] * 4
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "lang string, source string, text string, n int, term int").repartition(5)
    got = sorted(tuple(r) for r in divergence.audit_sources(df, ranks=7).collect())
    assert got == expected(docs, 7)


def test_odd_tables(spark):
    df = spark.createDataFrame([("en", "a", None), ("en", "b", "")], "lang string, source string, text string")
    assert divergence.audit_sources(df.limit(0)).collect() == []
    assert sorted(tuple(r) for r in divergence.audit_sources(df).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_stretches_and_held_terms_change_nothing(spark):
    text = "One two\x00three été-Four " * 50
    assert all(divergence.term_counts(text, piece) == divergence.term_counts(text) for piece in (1, 3, 17))
    df = spark.createDataFrame([("en", 0, text + w) for w in ("a", "b", "c")], "lang string, no int, text string").coalesce(1)
    sums = lambda held: sorted(tuple(r) for r in divergence.counted_terms(df, held).groupBy("lang", "no", "term").sum("n", "docs").collect())
    assert sums(2) == sums(10**6) and ("en", 0, "two", 150, 3) in sums(2)


def test_shares_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(c), int(of)) for of in rng.integers(1, 9 * 10**15, 300) for c in (0, of - 1, rng.integers(0, of))]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(rows, "c long, of long").select("c", "of", divergence.share(F.col("c"), F.col("of")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.of for r in got)
