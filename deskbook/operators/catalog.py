"""Document catalogue over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import host_of


def catalogue_source(source: Column, url: Column, aliases: dict[str, str]) -> Column:
    """The catalogue's rule: only aliases of known sources count as explicit; any other source is the address's host."""
    key, host = F.lower(T.strip(F.coalesce(source, F.lit("")))), host_of(url)
    out = F.when(host == "", "unknown").otherwise(host)
    for alias, name in aliases.items():
        out = F.when(host == alias, name).otherwise(out)
    for alias, name in aliases.items():
        out = F.when(key == alias, name).otherwise(out)
    return out


def chunk_ordinal(chunk_id: Column) -> Column:
    """Number after the only ``#`` of a chunk id; null if there is none."""
    return F.when(F.size(F.split(chunk_id, "#")) == 2, F.regexp_extract(chunk_id, r"#\s*([+-]?\d+)", 1).try_cast("long"))


def document_summaries(chunks: DataFrame) -> DataFrame:
    """One row a document: its first chunk's title, address, source and host, latest update, chunk and section counts."""
    first = lambda c: F.min_by(c, F.struct("ord", "chunk_id")).alias(c)
    sections = F.countDistinct(F.when(F.col("section") != "", F.col("section"))).alias("section_count")
    return chunks.groupBy("doc_id").agg(*map(first, ("title", "url", "source", "source_host")), F.max("updated_at").alias("updated_at"), F.count("*").alias("chunk_count"), sections)


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """``doc_id, position, chunk_id``: a document's chunks in the order of their ordinals, else of the ids; one row each, so a
    document of any size is sorted (and spilled) but never put into one row."""
    order = Window.partitionBy("doc_id").orderBy(chunk_ordinal(F.col("chunk_id")), "chunk_id")
    return chunks.select("doc_id", "chunk_id").withColumn("position", F.row_number().over(order))


def search_catalogue(chunks: DataFrame, query: str, source: str = "all") -> DataFrame:
    """Summaries of documents whose title, address or any section holds ``query`` (any case; empty: all), with ``filtered``, their number."""
    summaries, q = document_summaries(chunks), query.strip().lower()
    if source != "all":
        summaries = summaries.where(F.col("source") == source)
    if q:
        by_section = chunks.where(F.lower("section").contains(q)).select("doc_id").distinct().withColumn("in_section", F.lit(True))
        summaries = summaries.join(by_section, "doc_id", "left").where(F.lower("title").contains(q) | F.lower("url").contains(q) | F.col("in_section")).drop("in_section")
    return summaries.crossJoin(F.broadcast(summaries.agg(F.count("*").alias("filtered"))))


def select_document(found: DataFrame, doc_id: str | None = None) -> DataFrame:
    """The chosen document of a search, or the first by title."""
    return found.where(F.col("doc_id") == doc_id) if doc_id else found.orderBy(F.lower("title"), "title", "doc_id").limit(1)
