"""JSON-lines sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import CHUNK, CRAWL_ERROR, URL_DOCUMENT


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines folder or file; blank lines are skipped and a missing path is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_chunks(spark: SparkSession, path: str, required: tuple[str, ...] = ("chunk_id", "url", "title", "text")) -> DataFrame:
    """Chunks without malformed lines and without rows that lack a required field (empty counts as missing)."""
    try:
        rows = spark.read.schema(f"{CHUNK}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CHUNK)
    return complete_chunks(rows.where("_corrupt is null").drop("_corrupt"), required)


def read_catalogue_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The document catalogue's variant, which needs the document id as well."""
    return read_chunks(spark, path, ("chunk_id", "doc_id", "url", "title", "text"))


def complete_chunks(chunks: DataFrame, required: tuple[str, ...]) -> DataFrame:
    for name in required:
        chunks = chunks.where(F.col(name).isNotNull() & (F.col(name) != ""))
    return chunks


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8, non-ASCII kept; null fields are written so that every row has every field."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_url_document(spark: SparkSession, path: str) -> DataFrame:
    """``url`` rows of a JSON document ``{count, urls}``."""
    return spark.read.schema(URL_DOCUMENT).option("multiLine", True).json(path).select(F.explode("urls").alias("url"))


def url_document(urls: DataFrame) -> DataFrame:
    """``{count, urls}`` of a list of addresses that a person reads; long lists stay tables."""
    return urls.agg(F.count("*").alias("count"), F.sort_array(F.collect_list("url")).alias("urls"))


def write_errors(failed: DataFrame, path: str, resume: bool = False) -> None:
    """``url, error, timestamp`` of failed rows: a fresh run starts the log anew, a resumed one goes on with it."""
    names = [c.split()[0] for c in CRAWL_ERROR.split(", ")]
    write_jsonl(failed.where("error is not null").select(*names), path, "append" if resume else "overwrite")
