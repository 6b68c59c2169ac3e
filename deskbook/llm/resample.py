"""Target-distribution importance resampling with bit-sliced weights.

Features (runs of one or two words) fall into hashed buckets. A bucket's gain says how much commoner it is in the target
texts than in the raw ones. A document's bucket counts are cut into bit planes of one bit a bucket; each is ANDed with the
planes of the gains' magnitudes, positive and negative ones apart, and the popcounts, scaled by powers of two, add up to
the exact sum of gains over the document's features. Documents are then drawn by Gumbel top-k.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean_batches, table
from .decontaminate import FOLD

BUCKETS = 10_000
#: Bytes of a text that are split into words at a time: bounds a worker's memory for very long ones.
PIECE = 1_000_000
SEED, LEAST_WORDS, PERCENT = 7, 20, 25


def bucket_runs(text: str, buckets: int = BUCKETS, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """``(words, buckets of their features)`` of one stretch of the text after another.

    A stretch ends between words; its pairs include that of the last word of the stretch before.
    """
    folded, at, last = text.encode().translate(FOLD), 0, b""
    while at < len(folded):
        end = folded.find(b" ", at + piece)
        end = len(folded) if end < 0 else end
        words = folded[at:end].split()
        at = end
        if words:
            joined = b" ".join([last, *words] if last else words)
            starts = np.cumsum([0, *(len(w) + 1 for w in ([last, *words] if last else words))]).tolist()
            pairs = [crc32(joined[a : b - 1]) for a, b in zip(starts, starts[2:])]
            yield len(words), np.array([*map(crc32, words), *pairs], np.int64) % buckets
            last = words[-1]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all rows of ``texts`` (``text``): each task adds up its own, at most one row a bucket and task."""
    lean_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in bucket_runs(text.as_py() or "", buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of every bucket: a thousand times the log-odds of target against raw, smoothed by one, floored."""
    counts = F.broadcast(bucket_counts(raw, buckets).withColumnRenamed("n", "s")), F.broadcast(bucket_counts(target, buckets).withColumnRenamed("n", "t"))  # one row a bucket at most
    every = raw.sparkSession.range(0, buckets, 1, 1).withColumnRenamed("id", "bucket").join(counts[0], "bucket", "left").join(counts[1], "bucket", "left").fillna(0, ["s", "t"])
    sums = F.broadcast(every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")))
    ratio = ((F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return every.crossJoin(sums).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative integers, the lowest first, each packed into 64-bit words."""
    n = max(1, int(values.max(initial=0)).bit_length())
    bits = np.packbits((values >> np.arange(n)[:, None] & 1).astype(bool), axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


class SlicedGains:
    """Gains as planes of their magnitudes, with the sign and power of two that each plane stands for."""

    def __init__(self, gain: np.ndarray):
        up, down = planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0))
        self.planes = np.concatenate([up, down])
        self.scale = [*(1 << k for k in range(len(up))), *(-(1 << k) for k in range(len(down)))]

    def total(self, counts: np.ndarray) -> int:
        """Exact sum of count times gain over all buckets."""
        own = planes(counts)
        hits = np.bitwise_count(own[:, None, :] & self.planes).sum(axis=2, dtype=np.int64)
        return sum((by << j) * n for j, row in enumerate(hits.tolist()) for by, n in zip(self.scale, row) if n)


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id") -> DataFrame:
    """``id, n_words, n_features, weight`` of every row; the weight is the floored mean gain of a row's features.

    Row-local, whole texts, piece by piece. Null and empty texts have no features and weigh 0; repeated rows weigh alike;
    null ids stay; an empty table gives no rows; other columns are dropped.
    """
    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced, buckets = SlicedGains(shared.value), len(shared.value)
        for batch in batches:
            made = []
            for text in batch.column("text"):
                counts, n_words = np.zeros(buckets, np.int64), 0
                for n, found in bucket_runs(text.as_py() or "", buckets):
                    counts += np.bincount(found, minlength=buckets)
                    n_words += n
                n_features = int(counts.sum())
                made.append((n_words, n_features, sliced.total(counts) // n_features if n_features else 0))
            columns = [pa.array(c, pa.int64()) for c in (zip(*made) if made else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("id"), "text").mapInArrow(run, "id long, n_words long, n_features long, weight long")


def gumbel_scores(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighed`` with ``score``: weight plus a thousand times Gumbel noise hashed from seed and id; a null id hashes as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))))


def ranked(rows: DataFrame, n_ranks: int) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3, ... by score downwards, then id, then features; null after ``n_ranks``.

    A range partitioned sort, whose parts are written with their places; a part's offset is the number of rows in the
    parts before it. ``rows`` must be a written table with ``row``, a number of its own for each row, which keeps repeated
    ids apart when ranges are cut.
    """
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "n_features", "row"]
    placed = cut(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).count().withColumnRenamed("count", "n").collect())  # one row a partition
    before, at = [], 0
    for p, n in sizes:
        before.append((p, at))
        at += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + inside + 1
    return placed.withColumn("part", part).join(offsets, "part").withColumn("rank", F.when(rank <= n_ranks, rank)).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null where a row is not drawn.

    ``floor(percent / 100)`` of the rows with ``least_words`` words or more are drawn, highest scores first. Both tables'
    features are counted over all rows. Empty tables count as no features: without a target, gains favour rare buckets as
    the smoothing has it; without docs no rows come. Cases otherwise as in ``weigh``; repeated ids get a rank each.
    """
    gain = [r.gain for r in sorted(gains(docs, target, buckets).collect())]
    scored = cut(gumbel_scores(weigh(docs, gain, id_col), seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= least_words
    drawn = ranked(scored.where(enough), scored.where(enough).count() * percent // 100)
    out = drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` weighed towards all of ``benchmark``, a quarter of the long enough ones drawn; cases as in ``resample``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with recursive crc as (
  select i as byte, i::ubigint as c, 0 as k from range(256) t(i)
  union all select byte, case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from crc where k < 8),
lookup as (select list(c order by byte) as tab from crc where k = 8),
texts as (
  select 1 as side, row_number() over () as r, doc_id, coalesce(text, '') as text from documents
  union all select 2, row_number() over (), null, coalesce(text, '') from benchmark),
words as (select side, r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from texts),
features as (
  select side, r, unnest(ws) as f from words
  union all select side, r, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from words where len(ws) > 1),
counted as (select side, r, f, count(*) as n from features group by all),
hashed as (
  select f, cast(xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || hex(encode(f))[2 * i - 1:2 * i])::ubigint)),
    lambda c, b: xor(c >> 8, tab[cast(xor(c, b) % 256 as integer) + 1])), 4294967295::ubigint) % 10000 as bigint) as bucket
  from (select distinct f from counted), lookup),
buckets as (select c.side, c.r, h.bucket, cast(sum(c.n) as bigint) as n from counted c join hashed h using (f) group by all),
sums as (select bucket, cast(sum(n) filter (side = 1) as bigint) as s, cast(sum(n) filter (side = 2) as bigint) as t from buckets group by bucket),
alls as (select coalesce(sum(s), 0)::double as ss, coalesce(sum(t), 0)::double as tt from sums),
gain as (select bucket, cast(floor(1000 * ln(((coalesce(t, 0) + 1)::double * (ss + 10000)) / ((coalesce(s, 0) + 1)::double * (tt + 10000)))) as bigint) as g from sums, alls),
weights as (select r, cast(sum(n) as bigint) as n_features, sum(n * g) as total from buckets join gain using (bucket) where side = 1 group by r),
scored as (
  select w.doc_id, len(w.ws) as n_words, coalesce(x.n_features, 0) as n_features, coalesce((x.total - ((x.total % x.n_features) + x.n_features) % x.n_features) // x.n_features, 0)::bigint as weight,
    (('0x' || sha256('7:' || coalesce(w.doc_id::varchar, ''))[:8])::ubigint::double + 0.5) / 4294967296 as u
  from words w left join weights x using (r) where w.side = 1),
noisy as (select *, cast(weight + floor(-1000 * ln(-ln(u))) as bigint) as score, n_words >= 20 as enough from scored),
placed as (select *, row_number() over (partition by enough order by score desc, doc_id nulls last, n_features) as place, count(*) over (partition by enough) as n from noisy)
select doc_id, n_features, weight, score, case when enough and place <= 25 * n // 100 then place end as rank from placed
"""
