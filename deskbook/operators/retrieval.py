"""Lexical index and batch retrieval: many queries at once against all chunks."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import host_of
from ..sources.scratch import cut, lean_batches

K1, B = 1.2, 0.75
TITLE_TERM, TITLE_PHRASE, TEXT_PHRASE = 0.8, 2.5, 1.2
#: Step of scores: finer than any difference that matters, and whole numbers of it add up alike in any order.
POINT = 1e-9


def normalize_source(value: Column, aliases: dict[str, str]) -> Column:
    """Source key in lower case with the configured aliases (``alias -> key``) resolved."""
    key = F.lower(T.strip(value))
    out = key
    for alias, name in aliases.items():
        out = F.when(key == alias, F.lit(name)).otherwise(out)
    return out


def resolve_source(source: Column, url: Column, aliases: dict[str, str], own_suffix: str) -> Column:
    """Explicit source, else one inferred from the address: an alias, the first label under ``own_suffix``, or the host."""
    host = host_of(url)
    known = F.lit(None).cast("string")
    for alias, name in aliases.items():
        known = F.when(host == alias, F.lit(name)).otherwise(known)
    inferred = F.when(host == "", "unknown").otherwise(F.coalesce(known, F.when(host.endswith(own_suffix), normalize_source(F.substring_index(host, ".", 1), aliases)).otherwise(normalize_source(host, aliases))))
    return F.when(T.strip(F.coalesce(source, F.lit(""))) != "", normalize_source(source, aliases)).otherwise(inferred)


class Index(NamedTuple):
    """A corpus' lexical index as written tables, for any number of query batches.

    ``lists``: a row a chunk, ``chunk_id, url, source, doc_len`` with its distinct ``terms`` and for each of them ``tfs`` and
    ``titled``; ``df``: ``term, df``; ``stats``: one row, ``n, total, avgdl``; ``texts``: the chunks that the index was made of.
    """

    lists: DataFrame
    df: DataFrame
    stats: DataFrame
    texts: DataFrame


LISTS = "chunk_id string, url string, source string, doc_len long, terms array<string>, tfs array<int>, titled array<boolean>"


def term_lists(chunks: DataFrame) -> DataFrame:
    """``Index.lists`` of chunks: tokenised in expressions, a chunk's terms counted where it is, without a shuffle."""
    lean_batches(chunks.sparkSession)
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    spread = chunks.repartition(cores, "chunk_id") if len(chunks.inputFiles()) < cores else chunks  # few files: else one task has all the work
    source = F.col("source") if "source" in chunks.columns else F.lit(None).cast("string")
    meta = spread.select("chunk_id", "url", source.alias("source"), T.tokenize(F.concat_ws("\n", "title", F.coalesce("section", F.lit("")), T.clean_chunk_text("text"))).alias("tokens"), T.tokenize("title").alias("title_terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tfs, titled, sizes = [], [], [], []
            for tokens, title in zip(batch.column("tokens").to_pylist(), batch.column("title_terms").to_pylist()):
                counts, title = Counter(tokens or ()), set(title or ())
                terms.append(list(counts))
                tfs.append(list(counts.values()))
                titled.append([t in title for t in counts])
                sizes.append(max(1, len(tokens or ())))
            own = pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32())), pa.array(titled, pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chunk_id", "url", "source")), *own], ["chunk_id", "url", "source", "doc_len", "terms", "tfs", "titled"])

    return meta.mapInArrow(run, LISTS)


def document_frequency(lists: DataFrame) -> DataFrame:
    return lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def index_sizes(lists: DataFrame) -> DataFrame:
    return lists.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total"))


def with_mean(sizes: DataFrame) -> DataFrame:
    """``n, total, avgdl``: the mean length is 1 at least."""
    return sizes.select("n", "total", F.greatest(F.lit(1.0), F.col("total") / F.greatest(F.lit(1), F.col("n"))).alias("avgdl"))


def build_index(chunks: DataFrame) -> Index:
    """Tokenise the chunks once and write their term lists and document frequencies to the shared folder."""
    lists = cut(term_lists(chunks), "lists")
    return Index(lists, cut(document_frequency(lists), "df"), cut(with_mean(index_sizes(lists)), "stats"), chunks)


def extend_index(index: Index, chunks: DataFrame, removed: DataFrame | None = None) -> Index:
    """The index with ``chunks`` added and those of ``removed`` (``chunk_id``) gone; a chunk whose id it has is replaced.

    Only the new chunks' lists are written, as a segment of their own. Lists of chunks that are gone stay where they are and
    are left out by a table of tombstones; frequencies and sizes change by what came and went. After many segments
    ``compact_index`` writes one. Results are those of an index built anew.
    """
    fresh = cut(term_lists(chunks), "segment")
    ids = fresh.select("chunk_id") if removed is None else fresh.select("chunk_id").unionByName(removed.select("chunk_id"))
    tombs = cut(ids.where("chunk_id is not null").distinct(), "tombstones")
    lost = cut(index.lists.join(tombs, "chunk_id", "left_semi").select("doc_len", "terms"), "lost")
    delta = document_frequency(fresh).unionByName(document_frequency(lost).select("term", (-F.col("df")).alias("df")))
    df = index.df.unionByName(delta).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    sizes = index.stats.select("n", "total").unionByName(index_sizes(fresh)).unionByName(index_sizes(lost).select((-F.col("n")).alias("n"), (-F.col("total")).alias("total")))
    kept = lambda old, new: old.join(tombs, "chunk_id", "left_anti").unionByName(new)
    shared = [c for c in index.texts.columns if c in chunks.columns]
    return Index(kept(index.lists, fresh), cut(df, "df"), cut(with_mean(sizes.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))), "stats"), kept(index.texts.select(shared), chunks.select(shared)))


def compact_index(index: Index) -> Index:
    """The same index with its segments written as one table."""
    return index._replace(lists=cut(index.lists, "lists"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, pos, term``: a query's distinct terms in order."""
    return queries.select("query_id", F.posexplode(F.array_distinct(T.tokenize("query")))).select("query_id", "pos", F.col("col").alias("term"))


class Asked(NamedTuple):
    """A block of queries as arrays: the corpus' terms that they have, and by term the queries that have it."""

    terms: list[str]
    idf: np.ndarray
    first: np.ndarray
    queries: np.ndarray
    needed: np.ndarray
    avgdl: float


#: Terms of queries, and queries, that one broadcast block holds; more queries are answered block by block.
BLOCK_TERMS, BLOCK_QUERIES = 1_000_000, 10_000
#: Cells of chunks x queries that a task adds up at a time, and pairs that it holds before it hands them on.
CELLS, HELD = 2_000_000, 100_000
PAIRS = "q int, chunk_id string, url string, points long, matched int, multiplier double, score double, could double"


def _blocks(queries: DataFrame, index: Index) -> Iterator[tuple[Asked, DataFrame]]:
    """Blocks of a checked size of the queries, each with ``query_id, q``."""
    spark = queries.sparkSession
    n, terms = queries.select(F.count("*"), F.coalesce(F.sum(F.size(F.split("query", " "))), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_QUERIES), -(-terms // BLOCK_TERMS))
    stats = index.stats.first()
    idf = F.log(1 + (F.lit(stats.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        ids = [r.query_id for r in part.select("query_id").distinct().collect()]
        number = {i: q for q, i in enumerate(ids)}
        needed = np.zeros(len(ids), np.int64)
        for r in phrases(part).select("query_id", "needed").collect():
            needed[number[r.query_id]] = r.needed
        rows = query_terms(part).select("query_id", "term").distinct().join(index.df, "term").select("query_id", "term", idf.alias("idf")).collect()
        by_term: dict[str, list] = {}
        weight: dict[str, float] = {}
        for r in rows:
            by_term.setdefault(r.term, []).append(number[r.query_id])
            weight[r.term] = r.idf
        names = list(by_term)
        first = np.cumsum([0, *(len(by_term[t]) for t in names)])
        asked = Asked(names, np.array([weight[t] for t in names], float), first, np.array([q for t in names for q in by_term[t]], np.int64), needed, stats.avgdl)
        yield asked, spark.createDataFrame(list(number.items()), f"query_id {queries.schema['query_id'].dataType.simpleString()}, q int")


class _Best:
    """A task's best addresses by query; ``least`` is the k-th one's score, below which no pair can matter."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.by_address, self.held = k, np.full(n, -np.inf), [{} for _ in range(n)], []

    def take(self, q: np.ndarray, could: np.ndarray, score: np.ndarray, rows: list[tuple]) -> None:
        for i, c, s, row in zip(q.tolist(), could.tolist(), score.tolist(), rows):
            if c < self.least[i]:
                continue
            self.held.append((i, c, row))
            own = self.by_address[i]
            if s > own.get(row[1], -np.inf):
                own[row[1]] = s
                if len(own) >= self.k:
                    top = heapq.nlargest(self.k, own.values())
                    self.least[i] = top[-1]
                    if len(own) > 4 * self.k:
                        self.by_address[i] = {u: v for u, v in own.items() if v >= top[-1]}

    def give(self) -> list[tuple[int, tuple]]:
        """Pairs that still matter; the task holds none of them any more."""
        out = [(i, row) for i, c, row in self.held if c >= self.least[i]]
        self.held = []
        return out


def pair_scores(lists: DataFrame, asked: Asked, k: int | None = None) -> DataFrame:
    """Pairs of chunks and queries that share a term, added up where the chunks are, without a shuffle.

    ``points`` sums the terms' weights in whole steps of POINT, so sums don't depend on their order; ``matched`` counts the
    terms; ``could`` is the score that phrase boosts could still bring. With ``k`` a task leaves out pairs that can't reach
    the score of its own k-th best address. ``lists`` may bring a ``multiplier``.
    """
    shared = lists.sparkSession.sparkContext.broadcast(asked)  # a block of checked size
    rows = lists.select("chunk_id", "url", F.col("doc_len").cast("double"), "terms", "tfs", "titled", F.col("multiplier") if "multiplier" in lists.columns else F.lit(1.0).alias("multiplier"))
    most = round((TITLE_PHRASE + TEXT_PHRASE) / POINT)

    def add_up(part: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, ...]:
        a = shared.value
        n_queries = len(a.needed)
        terms, column = part.column("terms"), lambda name: part.column(name).flatten().to_numpy(zero_copy_only=False)
        term = pc.fill_null(pc.index_in(terms.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
        fine = term >= 0
        term, row, tf, titled = term[fine], row[fine], column("tfs")[fine].astype(float), column("titled")[fine].astype(bool)
        length = part.column("doc_len").to_numpy(zero_copy_only=False)[row]
        idf = a.idf[term]
        own = idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * (length / a.avgdl)))
        points = np.floor((own + np.where(titled, TITLE_TERM * idf, 0.0)) / POINT + 0.5)
        many = a.first[term + 1] - a.first[term]
        each = np.repeat(np.arange(len(term)), many)
        query = a.queries[a.first[term][each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)]
        cell = row[each] * n_queries + query
        sums, matched = np.bincount(cell, points[each], len(part) * n_queries), np.bincount(cell, minlength=len(part) * n_queries)
        hit = np.flatnonzero(matched)
        row, query = hit // n_queries, hit % n_queries
        multiplier = part.column("multiplier").to_numpy(zero_copy_only=False)[row]
        score = sums[hit] * POINT * multiplier
        could = np.where(matched[hit] >= a.needed[query], np.maximum((sums[hit] + most) * POINT * multiplier, score), score)
        return row, query, sums[hit].astype(np.int64), matched[hit], multiplier, score, could

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in PAIRS.split(", ")]
        types = pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        vocabulary, step = pa.array(a.terms, pa.string()), max(1, min(1024, CELLS // max(1, len(a.needed))))
        best = _Best(len(a.needed), k) if k is not None else None
        for batch in batches:
            for at in range(0, len(batch) if a.terms else 0, step):
                part = batch.slice(at, step)
                row, query, points, matched, multiplier, score, could = add_up(part, vocabulary)
                if best is not None:
                    alive = could >= best.least[query]
                    row, query, points, matched, multiplier, score, could = (c[alive] for c in (row, query, points, matched, multiplier, score, could))
                ids, urls = part.column("chunk_id").to_pylist(), part.column("url").to_pylist()
                made = [(ids[r], urls[r], *rest) for r, *rest in zip(row.tolist(), points.tolist(), matched.tolist(), multiplier.tolist(), score.tolist(), could.tolist())]
                if best is None:
                    yield batch_of([(q, *m) for q, m in zip(query.tolist(), made)])
                    continue
                best.take(query, could, score, made)
                if len(best.held) > HELD:
                    yield batch_of([(q, *m) for q, m in best.give()])
        if best is not None:
            yield batch_of([(q, *m) for q, m in best.give()])

    return rows.mapInArrow(run, PAIRS)


def term_hits(queries: DataFrame, index: Index, lists: DataFrame, k: int | None = None) -> DataFrame:
    """``query_id`` and the pairs of ``pair_scores`` for all queries, written, block of queries by block."""
    parts = [cut(pair_scores(lists, asked, k).join(F.broadcast(ids), "q").drop("q"), "hits") for asked, ids in _blocks(queries, index)]
    return reduce(DataFrame.unionByName, parts)


def phrases(queries: DataFrame) -> DataFrame:
    """``query_id, phrase, needed``: the whole query in lower case, and how many of its distinct terms a text with it must have.

    Words inside the phrase stand in such a text as they are; its first and last may be parts of longer words there.
    """
    phrase, terms = F.lower(T.strip("query")), F.array_distinct(T.tokenize("query"))
    words = F.split(phrase, r"(?U)\s+")
    inside = F.when(F.size(words) > 2, F.array_distinct(T.tokenize(F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), " ")))).otherwise(F.array().cast("array<string>"))
    return queries.select("query_id", phrase.alias("phrase"), F.size(F.array_intersect(inside, terms)).alias("needed"))


def phrase_boosts(pairs: DataFrame, index: Index, asked: DataFrame) -> DataFrame:
    """``query_id, chunk_id, boost`` (in points) of those of the pairs whose title or text has the whole query; texts are read for these pairs alone."""
    texts = index.texts.select("chunk_id", F.lower("title").alias("title"), F.lower(T.clean_chunk_text("text")).alias("text"))
    rows = pairs.select("query_id", "chunk_id").join(asked.select("query_id", "phrase"), "query_id").join(texts, "chunk_id")
    steps = lambda boost: round(boost / POINT)
    boost = F.when(F.col("title").contains(F.col("phrase")), steps(TITLE_PHRASE)).otherwise(0) + F.when(F.col("text").contains(F.col("phrase")), steps(TEXT_PHRASE)).otherwise(0)
    return rows.select("query_id", "chunk_id", boost.cast("long").alias("boost")).where("boost > 0")


def _of_sources(index: Index, sources: Iterable[str] | None) -> DataFrame:
    """The index's lists of the sources: None is no filter, an empty list no rows."""
    return index.lists if sources is None else index.lists.where(F.col("source").isin(*sources)) if list(sources) else index.lists.where(F.lit(False))


def matched_terms(pairs: DataFrame, index: Index, queries: DataFrame) -> DataFrame:
    """``pairs`` with ``terms``, the query's terms that the chunk has, in query order."""
    asked = queries.select("query_id", F.array_distinct(T.tokenize("query")).alias("asked"))
    both = pairs.join(asked, "query_id").join(index.lists.select("chunk_id", F.col("terms").alias("own")), "chunk_id")
    return both.withColumn("terms", F.array_intersect("asked", "own")).drop("asked", "own")


def bm25_scores(queries: DataFrame, chunks: DataFrame | Index, sources: Iterable[str] | None = None) -> DataFrame:
    """``query_id, chunk_id, score, terms`` of every chunk that has a term of the query (``terms`` in query order).

    Texts do not take part in scoring; the phrase boosts look them up for pairs that have all the terms inside the phrase.
    A batch of queries that only needs its best chunks is ``top_chunks``' task.
    """
    index = chunks if isinstance(chunks, Index) else build_index(chunks)
    asked = phrases(queries)
    hits = term_hits(queries, index, _of_sources(index, sources))
    boosts = phrase_boosts(hits.where("could > score"), index, asked)
    scored = hits.join(boosts, ["query_id", "chunk_id"], "left").withColumn("score", (F.col("points") + F.coalesce("boost", F.lit(0))) * POINT)
    return matched_terms(scored.select("query_id", "chunk_id", "score"), index, queries).select("query_id", "chunk_id", "score", "terms")


def top_chunks(queries: DataFrame, index: Index, k: int, sources: Iterable[str] | None = None, signals: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, chunk_id, url, score, terms``: each query's ``k`` best chunks, scores times ``signals``' multipliers where given.

    Each task keeps the pairs that can reach the score of its own k-th best address, so what is written and shuffled grows
    with queries and tasks, not with pairs. Texts are read for those alone that the phrase boosts could still bring among
    the first k of all tasks: pairs with all the terms inside the phrase, whose boosted score reaches the k-th address.
    """
    asked, lists = phrases(queries), _of_sources(index, sources)
    if signals is not None:
        lists = with_multipliers(lists, signals)
    hits = term_hits(queries, index, lists, k)
    by_address = hits.groupBy("query_id", "url").agg(F.max("score").alias("best"))
    ranked = by_address.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("best").desc()))).where(F.col("r") <= k)
    least = ranked.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("best")).alias("least"))  # null: fewer addresses than k
    alive = cut(hits.join(least, "query_id").where("least is null or could >= least"), "alive")
    boosts = phrase_boosts(alive.where("could > score"), index, asked)
    final = alive.join(boosts, ["query_id", "chunk_id"], "left").withColumn("score", (F.col("points") + F.coalesce("boost", F.lit(0))) * POINT * F.col("multiplier"))
    return matched_terms(diverse_top_k(final.select("query_id", "chunk_id", "url", "score"), k), index, queries)


def with_multipliers(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """``rows`` with their chunk's ``multiplier``; a missing or non-finite one counts as 1."""
    m = F.col("multiplier")
    fine = F.when(m.isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf")), m).otherwise(1.0)
    return rows.join(signals.select("chunk_id", "multiplier"), "chunk_id", "left").withColumn("multiplier", fine)


def apply_multipliers(scores: DataFrame, signals: DataFrame) -> DataFrame:
    """Scores times their chunk's multiplier."""
    return with_multipliers(scores, signals).withColumn("score", F.col("score") * F.col("multiplier"))


def diverse_top_k(scores: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, ...``: each address's best chunk first, in score order, then the rest until ``k``.

    Ties go by chunk id. Spark keeps a group's first k rows before the shuffle.
    """
    by_score = [F.col("score").desc(), F.col("chunk_id")]
    in_url = F.row_number().over(Window.partitionBy("query_id", "url").orderBy(*by_score))
    best = scores.withColumn("in_url", in_url).where(F.col("in_url") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(F.col("in_url") == 1, 0).otherwise(1), *by_score))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).drop("in_url")


def snippet(text: Column, terms: Column) -> Column:
    """A window of 280 characters from 90 before the earliest hit, or the first 220 characters without a hit."""
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0))
    start = F.greatest(F.lit(0), at - 1 - 90)
    window = F.concat(F.when(start > 0, "...").otherwise(""), T.compact(F.substring(text, start + 1, F.lit(280))), F.when(start + 280 < F.length(text), "...").otherwise(""))
    short = T.compact(text)
    return F.when(at.isNotNull(), window).otherwise(F.when(F.length(short) > 220, F.concat(F.substring(short, 1, 220), F.lit("..."))).otherwise(short))


def citations(ranked: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Citation rows of the winners; their texts are joined back last."""
    asked = queries.select("query_id", F.array_distinct(T.tokenize("query")).alias("asked"))
    texts = chunks.select("chunk_id", "doc_id", "title", "url", "section", T.clean_chunk_text("text").alias("text"))
    rows = ranked.select("query_id", "rank", "chunk_id", "score").join(texts, "chunk_id").join(asked, "query_id")
    return rows.select("query_id", "rank", "chunk_id", "doc_id", "title", "url", "section", "score", snippet(F.col("text"), F.col("asked")).alias("snippet"))


def prompt_contexts(ranked: DataFrame, chunks: DataFrame, queries: DataFrame, instructions: str) -> DataFrame:
    """``query_id, prompt``: instructions and the numbered context blocks of each query's winners (k at most)."""
    own = chunks.select("chunk_id", "title", "url", "section", "text", F.coalesce("source", F.lit("unknown")).alias("source"), F.col("heading_path") if "heading_path" in chunks.columns else F.lit(None).cast("array<string>").alias("heading_path"))
    rows = ranked.select("query_id", "rank", "chunk_id").join(own, "chunk_id")
    block = F.concat_ws(
        "\n", F.concat(F.lit("["), "rank", F.lit("]")), F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Source: "), "source"), F.concat(F.lit("URL: "), "url"),
        F.concat(F.lit("Section: "), F.coalesce("section", F.lit("(not provided)"))), F.concat(F.lit("Heading path: "), F.coalesce(F.array_join("heading_path", " > "), "title")), F.concat(F.lit("Excerpt:\n"), "text"),
    )
    blocks = rows.select("query_id", F.struct("rank", block.alias("block")).alias("b")).groupBy("query_id").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    joined = queries.select("query_id").join(blocks, "query_id", "left")
    context = F.coalesce(F.array_join(F.transform("bs", lambda b: b["block"]), "\n\n"), F.lit("No context found."))
    return joined.select("query_id", F.concat(F.lit(instructions + "\n"), context).alias("prompt"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """``source, n_docs, n_chunks``; a document counts once, under its first chunk's source."""
    per_doc = chunks.groupBy("doc_id").agg(F.min_by("source", F.struct("ord", "chunk_id")).alias("source")).groupBy("source").agg(F.count("*").alias("n_docs"))
    per_source = chunks.groupBy("source").agg(F.count("*").alias("n_chunks"))
    return per_source.join(per_doc, "source", "full_outer").select("source", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
