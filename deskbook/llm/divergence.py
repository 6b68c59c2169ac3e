"""Audit of how sources of a language differ in their terms, by ranking cells of counts.

A term matters to a group (a language's source) only through two counts: the group's and that of what it is compared with.
Terms are therefore gathered into cells of equal counts, the divergence is evaluated once a cell, cells of a group are
ranked by value with their terms' number as multiplicity, and only cells that reach the ranks asked for are expanded into
terms, equal values in UTF-8 order. All arithmetic is exact, in longs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, cut, lean_batches, table

#: Bytes to bytes: A-Z to lower case, ASCII that is no letter to a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text split at a time, and terms that a task holds before it hands them on: bounds of a worker's memory.
PIECE, HELD = 1_000_000, 400_000
LEAST_DOCS, RANKS = 3, 200
#: Sources whose counts of a term stand in one row.
BLOCK = 64
#: Chosen cells that may be broadcast; more are joined by shuffles.
MOST_BROADCAST = 100_000


def term_counts(text: str, piece: int = PIECE) -> Counter:
    """Terms of a whole text with their occurrences, split stretch by stretch between terms."""
    folded, at, found = text.encode().translate(LETTERS), 0, Counter()
    while at < len(folded):
        end = folded.find(b" ", at + piece)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


def counted_terms(docs: DataFrame, held: int = HELD) -> DataFrame:
    """``lang, no, term, n, docs``: occurrences and documents, added up by each task as far as its memory goes.

    ``docs`` has ``lang, no, text``, ``no`` standing for a source.
    """
    lean_batches(docs.sparkSession)

    def rows(sums: dict) -> pa.RecordBatch:
        flat = [(lang, no, term.decode(), v >> 32, v & 0xFFFFFFFF) for (lang, no), own in sums.items() for term, v in own.items()]
        types = pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()
        columns = zip(*flat) if flat else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "no", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, dict[bytes, int]] = {}
        size = 0
        for batch in batches:
            for lang, no, text in zip(batch.column("lang").to_pylist(), batch.column("no").to_pylist(), batch.column("text")):
                own = sums.setdefault((lang, no), {})
                before = len(own)
                for term, n in term_counts(text.as_py()).items():
                    own[term] = own.get(term, 0) + (n << 32 | 1)
                size += len(own) - before
                if size > held:
                    yield rows(sums)
                    sums, size = {}, 0
        yield rows(sums)

    return docs.select("lang", F.col("no").cast("int"), "text").mapInArrow(run, "lang string, no int, term string, n long, docs long")


def div(a: Column, b: Column) -> Column:
    """Whole quotient of longs."""
    return F.call_function("div", a, b)


def share(count: Column, of: Column) -> Column:
    """``1 + floor(10^9 * (count + 1) / of)`` by long division in steps of a thousand: exact while ``of`` is below 9 * 10^15."""
    rest, out = (count + 1) % of, F.lit(1_000_000_000) * div(count + 1, of) + 1
    for scale in (1_000_000, 1_000, 1):
        out = out + div(rest * 1000, of) * scale
        rest = (rest * 1000) % of
    return out


def divergence(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def by_block(counts: DataFrame) -> DataFrame:
    """``lang, term, block, counts, n, lang_n, first`` of the kept terms, dealt by term in one shuffle.

    ``counts`` are ``no, n`` of at most BLOCK sources in order; ``lang_n`` counts the term in its whole language, and
    ``first`` marks one row a term.
    """
    own = counts.repartition("lang", "term").groupBy("lang", "term", "no").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    block = F.floor(F.col("no") / BLOCK).cast("int")
    rows = own.groupBy("lang", "term", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("no", "n"))).alias("counts"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = rows.withColumns({"lang_n": F.sum("n").over(term), "docs": F.sum("docs").over(term), "first": F.col("block") == F.min("block").over(term)})
    return whole.where(F.col("docs") >= LEAST_DOCS).drop("docs")


def numbered(docs: DataFrame) -> DataFrame:
    """``lang, source, no`` of every group; ``no`` counts a language's sources from 0 in UTF-8 order."""
    groups = docs.select("lang", "source").distinct()
    return groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def with_sums(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """``groups`` with ``of`` and ``lang_of``, the divisors of their and their languages' shares, and ``terms``; 0 without kept terms."""
    own = blocks.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.no").agg(F.sum("c.n").alias("n_own"))
    langs = blocks.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("first").alias("terms"))
    every = groups.join(own, ["lang", "no"], "left").join(langs, "lang", "left").fillna(0, ["n_own", "n_lang", "terms"])
    return every.select("lang", "no", "source", (F.col("n_own") + F.col("terms")).alias("of"), (F.col("n_lang") + F.col("terms")).alias("lang_of"), "terms")


def top_terms(blocks: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """``lang, source, item, value, rank``: terms that a group uses more than its language does, the first ``ranks``.

    Cells are (group count, language count). A cell holds a term at least, so the first ``ranks`` values of a group have
    all that can be ranked; those are cut where the number of terms before them reaches ``ranks``. Terms of the chosen
    cells are found where they are while the cells' checked number allows.
    """
    terms = blocks.select("lang", "term", "lang_n", F.explode("counts").alias("c")).select("lang", "term", "lang_n", "c.no", "c.n")
    cells = terms.groupBy("lang", "no", "n", "lang_n").agg(F.count("*").alias("m"))
    p, q = share(F.col("n"), F.col("of")), share(F.col("lang_n"), F.col("lang_of"))
    valued = cut(cells.join(groups, ["lang", "no"]).withColumns({"p": p, "q": q}).where("p > q").select("lang", "no", "source", "n", "lang_n", "m", divergence(F.col("p"), F.col("q")).alias("value")), "cells")
    down = Window.partitionBy("lang", "no").orderBy(F.col("value").desc())
    merged = valued.groupBy("lang", "no", "value").agg(F.sum("m").alias("m")).withColumn("r", F.row_number().over(down)).where(F.col("r") <= ranks)
    before = F.coalesce(F.sum("m").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = merged.withColumn("before", before).where(F.col("before") < ranks).select("lang", "no", "value")
    chosen = cut(valued.join(reached, ["lang", "no", "value"]), "chosen")
    keys = ["lang", "no", "n", "lang_n"]
    n_chosen = chosen.count()
    found = terms.join(F.broadcast(chosen.drop("m")), keys) if n_chosen <= MOST_BROADCAST else attach(cut(terms, "terms"), chosen, keys, "m", terms.count()).where("value is not null")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def pair_sums(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank``: for each two sources of a language the divergence summed over all its kept terms.

    With f(a, b) of a term's counts in both, the sum is that of f(0, 0) over all terms, plus what each term of one source
    alone changes, by cells of its counts, plus, by cells of pairs of counts, what is left for terms that both have. Terms
    with the same counts in all sources of a block are one row before pairs are made.
    """
    one = blocks.groupBy("lang").agg(F.max("block").alias("b")).where("b > 0").limit(1).count() == 0
    if one:
        sides = blocks.select("lang", F.col("counts").alias("x"), F.col("counts").alias("y"))
    else:
        low, high = blocks.select("lang", "term", "block", F.col("counts").alias("x")), blocks.select("lang", "term", F.col("block").alias("other"), F.col("counts").alias("y"))
        sides = low.join(high, ["lang", "term"]).where("block <= other").select("lang", "x", "y")
    alike = sides.groupBy("lang", "x", "y").agg(F.count("*").alias("m"))
    both = F.flatten(F.transform("x", lambda a: F.transform(F.filter("y", lambda b: b["no"] > a["no"]), lambda b: F.struct(a["no"].alias("a"), a["n"].alias("n"), b["no"].alias("b"), b["n"].alias("k")))))
    joint = cut(alike.select("lang", "m", F.explode(both).alias("c")).groupBy("lang", "c.a", "c.n", "c.b", "c.k").agg(F.sum("m").alias("m")), "joint")
    single = cut(blocks.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.no", "c.n").agg(F.count("*").alias("m")), "single")

    mine, theirs = groups.select("lang", F.col("no").alias("a"), F.col("source"), F.col("of").alias("of_a"), "terms"), groups.select("lang", F.col("no").alias("b"), F.col("source").alias("item"), F.col("of").alias("of_b"))
    pairs = cut(mine.join(theirs, "lang").where("a <> b"), "pairs")  # the rows of the result
    zero = F.lit(0).cast("long")
    f = lambda n, k: divergence(share(n, F.col("of_a")), share(k, F.col("of_b")))
    there = pairs.where("terms > 0")
    turned = joint.unionByName(joint.select("lang", F.col("b").alias("a"), F.col("k").alias("n"), F.col("a").alias("b"), F.col("n").alias("k"), "m"))
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    parts = (
        there.select("lang", "a", "b", (F.col("terms") * f(zero, zero)).alias("v")),
        there.join(single.withColumnRenamed("no", "a"), ["lang", "a"]).select("lang", "a", "b", (m * (f(n, zero) - f(zero, zero))).alias("v")),
        there.join(single.withColumnsRenamed({"no": "b", "n": "k"}), ["lang", "b"]).select("lang", "a", "b", (m * (f(zero, k) - f(zero, zero))).alias("v")),
        turned.join(there, ["lang", "a", "b"]).select("lang", "a", "b", (m * (f(n, k) - f(n, zero) - f(zero, k) + f(zero, zero))).alias("v")),
    )
    sums = reduce(DataFrame.unionByName, parts).groupBy("lang", "a", "b").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    valued = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", zero))
    return valued.withColumn("rank", F.row_number().over(order)).select("lang", "source", "item", "value", "rank")


def audit_sources(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group of ``docs`` (``lang, source, text``).

    Part ``pair`` ranks a language's other sources by how far the group's term shares are from theirs; part ``term`` ranks
    the terms it uses more than its language. A language keeps the terms of at least LEAST_DOCS of its rows. Null texts,
    languages and sources are read as empty; repeated rows count as documents of their own; a language without kept terms
    gives pairs of value 0, a single source no pairs; an empty table gives no rows; other columns are ignored. Sums of a
    pair are exact while a language has fewer than 10^9 kept terms (a larger sum is an error, never a wrong number).
    """
    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = cut(numbered(own), "groups")
    named = own.join(groups, ["lang", "source"])
    blocks = cut(by_block(counted_terms(named)), "terms")
    groups = cut(with_sums(groups, blocks), "sums")
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pair_sums(blocks, groups), "pair").unionByName(part(top_terms(blocks, groups, ranks), "term"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of ``documents``, terms to rank 200; cases as in ``audit_sources``."""
    return audit_sources(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n, count(distinct r) as docs from (select lang, source, r, unnest(ts) as term from d) group by all),
kept as (select lang, term, sum(n) as lang_n from c group by all having sum(docs) >= 3),
grid as (select g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) as n from g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
shares as (
  select *, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang, source) + count(*) over (partition by lang, source))::hugeint as p from grid),
langs as (select lang, term, 1 + (1000000000::hugeint * (lang_n + 1)) // (sum(lang_n) over (partition by lang) + count(*) over (partition by lang))::hugeint as q from kept),
pairs as (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) as value from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
every as (select a.lang, a.source, b.source as item, coalesce(p.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
terms as (select s.lang, s.source, s.term as item, ((s.p - l.q) * (s.p - l.q)) // l.q as value from shares s join langs l on l.lang = s.lang and l.term = s.term where s.n > 0 and s.p > l.q),
ranked as (
  select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, item) as rank from every
  union all select *, 'term', row_number() over (partition by lang, source order by value desc, item) from terms)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 200
"""
