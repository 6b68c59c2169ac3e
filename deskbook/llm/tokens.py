"""Token counts with a digest cache.

A text's key is the digest of its normalised content beside the digest of the tokenizer's file. Known keys take their
count from the cache table; of the rest every distinct content is encoded once, appended to the cache and joined back.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, lean_batches, new_path, table

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Characters whose class every regular-expression engine agrees on; texts with others go to the library whole.
PLAIN = r"[^\t\n\r\x20-\x7e¡-¬®-ſ]"
#: The byte-level pre-tokenizer's pattern (fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers between clearings, and the longest that it remembers: bounds its memory.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 64
#: Digests of a cache that may be broadcast; those of a larger one are joined by a shuffle.
MOST_BROADCAST = 500_000


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts tokens as the tokenizers library does; repeated pre-tokens of plain texts are encoded once a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.byte_level = '"type":"ByteLevel","add_prefix_space":false' in self.tokenizer.to_str() and self.tokenizer.normalizer is None
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd, self.words, self.known = regex.compile(PLAIN), regex.compile(PATTERN), {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, text: str) -> int:
        if not self.byte_level or self.odd.search(text) or any(s in text for s in self.specials):
            return self.whole([text])[0]
        words, known = self.words.findall(text), self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            new = list({w for w in words if w not in known})
            counted = dict(zip(new, self.whole(new)))
            total = sum(known[w] if w in known else counted[w] for w in words)
            known.update(item for item in counted.items() if len(item[0]) <= LONGEST_REMEMBERED)
            return total


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """A worker's counter, kept between its tasks."""
    return Counter(path)


def normalised(text):
    """Content as the digest sees it: null is empty, nothing else may change a count."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def count_with_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id") -> DataFrame:
    """``id, n_bytes, n_tokens`` for every row of ``docs`` (``id_col``, ``text``), growing the cache at ``cache_path``.

    The cache is a Parquet table of CACHE_SCHEMA, append-only; a missing one counts as empty. Contents are dealt by digest,
    each once a map task, so one that makes up a third of the rows is pre-aggregated; those that the cache lacks are
    encoded, once each whatever their ids, and appended. Counts are joined back by digest, very common ones where their
    rows are. Null text counts as empty (0 tokens); null and repeated ids and repeated texts keep a row each as given; an
    empty table gives none; extra columns are dropped. A rerun after a failure may append a key twice; readers take one
    row a key.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    lean_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), normalised("text").alias("text")).withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    cached = cache.where(F.col("tokenizer_digest") == version).select("content_digest").distinct()
    contents = source.select("content_digest", "text")
    if (n_cached := cached.count()) and n_cached <= MOST_BROADCAST:
        contents = contents.join(F.broadcast(cached), "content_digest", "left_anti")  # texts with known counts stay where they are
    misses = contents.groupBy("content_digest").agg(F.first("text").alias("text"))
    if n_cached > MOST_BROADCAST:
        misses = misses.join(cached, "content_digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for batch in batches:
            n = [count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    misses.select("content_digest", "text").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    keyed = cut(source.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest"), "digests")
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    common = cut(keyed.groupBy("content_digest").agg(F.count("*").alias("rows_")).join(counts, "content_digest"), "counts")
    return attach(keyed, common, ["content_digest"], "rows_", keyed.count()).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents against an empty cache in the shared folder, so all distinct contents are encoded."""
    counts = count_with_cache(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
