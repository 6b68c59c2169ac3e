"""Ratings -> ranking signals and ingestion candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the signal formula.
LIGHT, STRONG, LOWEST, HIGHEST = 3, 10, 0.7, 1.2


def latest_feedback(log: DataFrame, key: str) -> DataFrame:
    """One row for each ``key`` and user, the last one; blank comments are null, invalid ratings and comments are dropped."""
    valid = F.col("rating").between(1, 5) & (F.col("rating") == F.floor("rating"))
    if "comment" in log.columns:
        log = log.withColumn("comment", F.nullif(T.strip("comment"), F.lit("")))
        valid &= F.coalesce(F.length("comment"), F.lit(0)) <= 4000
    last = F.row_number().over(Window.partitionBy(key, "user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return log.where(valid).withColumn("r_", last).where("r_ = 1").drop("r_")


def chunk_ratings(citations: DataFrame, message_feedback: DataFrame, thread_feedback: DataFrame) -> DataFrame:
    """``chunk_id, rating``: ratings of messages that cite the chunk and of threads with such a message, each once a chunk."""
    by_message = citations.select("message_id", "chunk_id").distinct().join(message_feedback.select("message_id", "rating"), "message_id")
    by_thread = citations.select("thread_id", "chunk_id").distinct().join(thread_feedback.select("thread_id", "rating"), "thread_id")
    return by_message.select("chunk_id", "rating").unionAll(by_thread.select("chunk_id", "rating"))


def rating_stats(ratings: DataFrame) -> DataFrame:
    """Number, mean and low and high counts of each rated chunk; unrated chunks have no row."""
    return ratings.groupBy("chunk_id").agg(F.count("*").alias("rating_count"), F.avg("rating").alias("avg_rating"), F.count_if(F.col("rating") <= 2).alias("low_count"), F.count_if(F.col("rating") >= 4).alias("high_count"))


def newer_ratings(batch: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """``key, user_id, rating, ts, event_id, old``: what a batch of ratings changes in ``latest``, and the rating it replaces.

    ``latest`` has one row for each ``key`` and user. Of a batch the last valid row counts, and only if it is later than the
    stored one (by time, then event), so rows out of order and batches read twice change nothing.
    """
    fresh = latest_feedback(batch, key).where(F.col(key).isNotNull()).select(key, "user_id", "rating", "ts", "event_id")
    held = latest.select(key, "user_id", F.col("rating").alias("old"), F.struct("ts", "event_id").alias("held"))
    rows = fresh.join(held, [key, "user_id"], "left")
    return rows.where(F.col("held").isNull() | (F.struct("ts", "event_id") > F.col("held"))).drop("held")


def with_newer(latest: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``latest`` after the changes."""
    return latest.join(changes.select(key, "user_id"), [key, "user_id"], "left_anti").unionByName(changes.select(latest.columns))


def stat_changes(citations: DataFrame, by_message: DataFrame, by_thread: DataFrame) -> DataFrame:
    """``chunk_id, n, total, low, high``: what changed ratings add to the cited chunks' sums; replaced ratings are taken back.

    Only citations of what was rated are read beyond their keys.
    """
    parts = []
    for key, changes in (("message_id", by_message), ("thread_id", by_thread)):
        signed = changes.select(key, F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("rating").alias("rating")), F.struct(F.lit(-1).alias("sign"), F.col("old").alias("rating")))).alias("r")).where("r.rating is not null")
        r, sign = F.col("r.rating"), F.col("r.sign")
        sums = signed.groupBy(key).agg(F.sum(sign).alias("n"), F.sum(sign * r).alias("total"), F.sum(F.when(r <= 2, sign).otherwise(0)).alias("low"), F.sum(F.when(r >= 4, sign).otherwise(0)).alias("high"))
        parts.append(citations.select(key, "chunk_id").distinct().join(sums, key).drop(key))
    return parts[0].unionByName(parts[1]).groupBy("chunk_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "total", "low", "high")))


def changed_stats(stats: DataFrame, changes: DataFrame) -> DataFrame:
    """``chunk_id, n, total, low, high`` after ``stat_changes`` of the chunks that it names; a chunk without ratings left has 0."""
    held = stats.join(changes.select("chunk_id"), "chunk_id", "left_semi")
    return held.unionByName(changes).groupBy("chunk_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "total", "low", "high")))


def signals_of(stats: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranking signals from sums (``changed_stats``) and ``latest_doc``; chunks without ratings have none."""
    rows = stats.where("n > 0").select("chunk_id", F.col("n").alias("rating_count"), (F.col("total") / F.col("n")).alias("avg_rating"), F.col("low").alias("low_count"), F.col("high").alias("high_count"))
    return _signals(rows, docs)


def signal_confidence(n: Column) -> Column:
    raw = F.least(F.lit(1.0), n / STRONG)
    return F.when(n <= 0, 0.0).when(n < LIGHT, raw * 0.5).otherwise(raw)


def retrieval_multiplier(avg: Column, n: Column, low: Column, high: Column) -> Column:
    """1 for no ratings, else 1 plus the mean's distance from neutral, less low and plus high shares, by confidence, clamped."""
    clamp = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(c, hi if isinstance(hi, Column) else F.lit(hi)))
    change = (clamp(avg, 1.0, 5.0) - 3) / 2 * 0.2 - clamp(low, 0, n) / n * 0.18 + clamp(high, 0, n) / n * 0.08
    return F.when(n <= 0, 1.0).otherwise(F.round(clamp(1 + change * signal_confidence(n), LOWEST, HIGHEST), 4))


def latest_doc(citations: DataFrame) -> DataFrame:
    """``chunk_id, doc_id`` of a chunk's latest citation."""
    return citations.groupBy("chunk_id").agg(F.max_by("doc_id", F.struct("created_ts", "message_id")).alias("doc_id"))


def _signals(stats: DataFrame, docs: DataFrame) -> DataFrame:
    rows = stats.join(docs, "chunk_id")
    n = F.col("rating_count")
    return rows.select("chunk_id", "doc_id", "rating_count", F.round("avg_rating", 6).alias("avg_rating"), "low_count", "high_count", F.round(signal_confidence(n), 4).alias("confidence"), retrieval_multiplier(F.col("avg_rating"), n, F.col("low_count"), F.col("high_count")).alias("multiplier"))


def ranking_signals(citations: DataFrame, message_feedback: DataFrame, thread_feedback: DataFrame) -> DataFrame:
    return _signals(rating_stats(chunk_ratings(citations, message_feedback, thread_feedback)), latest_doc(citations))


def upsert_signals(signals: DataFrame, affected: DataFrame, citations: DataFrame, message_feedback: DataFrame, thread_feedback: DataFrame) -> DataFrame:
    """``signals`` with the ``affected`` chunks (trimmed, blank ones ignored) recomputed; those that lost their ratings go."""
    ids = affected.select(T.strip("chunk_id").alias("chunk_id")).where("chunk_id <> ''").distinct()
    fresh = ranking_signals(citations.join(ids, "chunk_id", "left_semi"), message_feedback, thread_feedback)
    return signals.join(ids, "chunk_id", "left_anti").unionByName(fresh)


def queue_candidates(feedback: DataFrame, key: str, pending: DataFrame) -> DataFrame:
    """First high rating (4 or more) of each ``key`` that has no pending candidate yet."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id"))
    high = feedback.where("rating >= 4").withColumn("r_", first).where("r_ = 1").drop("r_")
    return high.join(pending.where("status = 'pending'").select(key).distinct(), key, "left_anti")


def candidate_summary(context: str, rating: Column, comment: Column, excerpt: Column) -> Column:
    comment = F.nullif(T.strip(comment), F.lit(""))
    noted = F.concat(F.lit("Feedback comment: "), F.coalesce(comment, F.lit("(none provided)")))
    return F.concat_ws("\n", F.lit(f"Source: {context}"), F.concat(F.lit("Rating: "), rating.cast("string"), F.lit("/5")), noted, F.lit("Content excerpt:"), F.substring(T.strip(excerpt), 1, 800))


def thread_excerpts(messages: DataFrame, most: int = 2000) -> DataFrame:
    """``thread_id, excerpt``: contents in order, a blank line between, cut to ``most`` characters.

    Pieces that start beyond the cut are dropped before they are gathered, so a thread of any length stays small.
    """
    order = Window.partitionBy("thread_id").orderBy("created_ts", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.substring(F.coalesce("content", F.lit("")), 1, most)
    near = messages.select("thread_id", "created_ts", "message_id", piece.alias("piece")).withColumn("before", F.coalesce(F.sum(F.length("piece") + 2).over(order), F.lit(0))).where(F.col("before") < most)
    pieces = near.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("created_ts", "message_id", "piece"))).alias("ps"))
    return pieces.select("thread_id", F.substring(F.array_join(F.transform("ps", lambda p: p["piece"]), "\n\n"), 1, most).alias("excerpt"))


def review_listing(candidates: DataFrame, users: DataFrame, threads: DataFrame, messages: DataFrame, status: str | None = None) -> DataFrame:
    """Candidates, newest first, with creator, reviewer, thread and message; an unknown status is no filter."""
    if status in ("pending", "approved", "rejected"):
        candidates = candidates.where(F.col("status") == status)
    who = lambda role: users.select(F.col("user_id").alias(f"{role}_user_id"), F.col("name").alias(f"{role}_name"))
    rows = candidates.join(who("created_by"), "created_by_user_id", "left").join(who("reviewed_by"), "reviewed_by_user_id", "left")
    rows = rows.join(threads.select("thread_id", F.col("title").alias("thread_title")), "thread_id", "left").join(messages.select("message_id", F.col("content").alias("message_content")), "message_id", "left")
    return rows.orderBy(F.col("created_ts").desc(), F.col("candidate_id").desc())


def rating_summary(targets: DataFrame, feedback: DataFrame, key: str, user_id: int) -> DataFrame:
    """``key, mean_rating, rating_count, mine`` of every target; no ratings: null, 0, null."""
    stats = feedback.groupBy(key).agg(F.round(F.avg("rating"), 2).alias("mean_rating"), F.count("*").alias("rating_count"), F.max(F.when(F.col("user_id") == user_id, F.col("rating"))).alias("mine"))
    return targets.select(key).distinct().join(stats, key, "left").withColumn("rating_count", F.coalesce("rating_count", F.lit(0)))
