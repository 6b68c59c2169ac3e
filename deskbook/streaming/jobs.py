"""Rate limits, admissions, signals and ingestion, in batch and on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import corpus, feedback
from ..operators.chunking import chunk_articles
from ..sources.scratch import cut


def rate_limit(events: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """``scope, k, event_id, window_start_ms, n, allowed``: windows start at a key's first request and end after ``window_ms``.

    Rejected requests count too. A key's requests are a fold in order of time and id, run over sorted partitions as a
    stream with one window of state, so the length of a key's history costs no memory.
    """
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    ordered = events.select("scope", "k", "event_id", ms.alias("ms")).repartition("scope", "k").sortWithinPartitions("scope", "k", "ms", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, n = None, 0, 0
        for b in batches:
            out = []
            for scope, k, event, now in zip(b.scope, b.k, b.event_id, b.ms):
                if (scope, k) != key or now - start >= window_ms:
                    key, start, n = (scope, k), now, 0
                n += 1
                out.append((scope, k, event, start, n, n <= limit))
            yield pd.DataFrame(out, columns=["scope", "k", "event_id", "window_start_ms", "n", "allowed"])

    return ordered.mapInPandas(run, "scope string, k long, event_id long, window_start_ms long, n int, allowed boolean")


class RateWindow(StatefulProcessor):
    """Start and count of a key's window; state that is idle for two windows expires.

    Requests are decided as they arrive, one chunk of rows at a time, each chunk in order of time and id: memory is that of
    a chunk, whatever a key's batch holds. A request older than the window that is open counts in it; no decision is taken
    back.
    """

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start long, n int", ttlDurationMs=2 * self.window_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        start, n = self.window.get() if self.window.exists() else (None, 0)
        for chunk in rows:
            out = []
            chunk = chunk.sort_values(["ms", "event_id"])
            for event, now in zip(chunk.event_id.tolist(), chunk.ms.tolist()):
                if start is None or now - start >= self.window_ms:
                    start, n = now, 0
                n += 1
                out.append((key[0], key[1], event, start, n, n <= self.limit))
            self.window.update((start, n))
            yield pd.DataFrame(out, columns=["scope", "k", "event_id", "window_start_ms", "n", "allowed"])

    def close(self) -> None:
        pass


def stream_rate_limit(events: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """The same on a stream; needs the RocksDB state store."""
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    keyed = events.select("scope", "k", "event_id", ms.alias("ms")).groupBy("scope", "k")
    schema = "scope string, k long, event_id long, window_start_ms long, n int, allowed boolean"
    return keyed.transformWithStateInPandas(RateWindow(limit, window_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")


class Wallet(StatefulProcessor):
    """A user's balance; grants raise it, reservations pass only if it covers them.

    Entries count as they arrive, one chunk of rows at a time, each chunk in order of time and id: a grant that arrives
    late covers what comes after it, and no decision is taken back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "cents long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        cents = self.balance.get()[0] if self.balance.exists() else 0
        for chunk in rows:
            out = []
            chunk = chunk.sort_values(["ts", "request_id"])
            for kind, request, amount, actual in zip(chunk.kind.tolist(), chunk.request_id.tolist(), chunk.amount_cents.tolist(), chunk.actual_cents.tolist()):
                if kind == "grant":
                    cents += amount
                    continue
                accepted = amount > 0 and cents >= amount
                if accepted:
                    cents -= amount if actual < 0 else min(actual, amount)
                out.append((request, key[0], accepted, cents))
            self.balance.update((cents,))
            yield pd.DataFrame(out, columns=["request_id", "user_id", "accepted", "balance_after"])

    def close(self) -> None:
        pass


def stream_admissions(entries: DataFrame) -> DataFrame:
    """Decisions on a stream of ``user_id, ts, request_id, kind, amount_cents, actual_cents`` (-1: not settled)."""
    return entries.groupBy("user_id").transformWithStateInPandas(Wallet(), outputStructType="request_id long, user_id long, accepted boolean, balance_after long", outputMode="Append", timeMode="None")


def signal_updater(load: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], citations: DataFrame, write: Callable[[DataFrame, DataFrame, DataFrame, DataFrame, int], None]):
    """``foreachBatch`` handler: a batch's ratings are added to the sums of the chunks they are about, replaced ones taken back.

    Ratings are of messages (``message_id``) or of whole threads (``thread_id``), which touch all that the thread cites.
    ``load`` gives the stored state: latest ratings of messages and of threads, and sums by chunk. ``write`` takes the
    changed rows of all three and the changed chunks' signals (none for a chunk that lost its last rating), and stores them
    under the epoch as one. The log is not read; a batch that comes again changes nothing.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        messages, threads, stats = load()
        changed = []
        for key, latest in (("message_id", messages), ("thread_id", threads)):
            rows = batch if key in batch.columns else batch.withColumn(key, F.lit(None).cast(latest.schema[key].dataType))
            changed.append(cut(feedback.newer_ratings(rows.where(F.col(key).isNotNull()), latest, key), "ratings"))
        sums = cut(feedback.changed_stats(stats, feedback.stat_changes(citations, *changed)), "sums")
        docs = feedback.latest_doc(citations.join(sums.select("chunk_id"), "chunk_id", "left_semi"))
        write(changed[0].drop("old"), changed[1].drop("old"), sums, feedback.signals_of(sums, docs), epoch)

    return handle


def page_ingester(spark: SparkSession, load: Callable[[], tuple[DataFrame, DataFrame]], write: Callable[[DataFrame, DataFrame, int], None]):
    """``foreachBatch`` handler: new pages become articles, are merged, and changed documents are chunked anew.

    ``load`` gives the stored articles and the cache, ``write`` takes the merged articles and the fresh chunks.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        pages = batch.where(~corpus.is_blocked(F.col("html")))
        scraped = corpus.extract_articles(pages).drop("page_id")
        existing, cache = load()
        merged, outcomes = corpus.merge_articles(existing, scraped, cache)
        changed = outcomes.where("written").select("doc_id").distinct()
        write(merged, chunk_articles(merged.join(changed, "doc_id", "left_semi")), epoch)

    return handle


def store_ingester(spark: SparkSession, path: str, write: Callable[[DataFrame, DataFrame, int], None], buckets: int = corpus.BUCKETS):
    """``foreachBatch`` handler as ``page_ingester``, for a corpus stored in buckets at ``path``: a batch rewrites its own buckets.

    ``write`` takes the outcomes and the fresh chunks of changed documents. What is stored serves as the cache, of which
    addresses and hashes alone are read; a batch that comes again finds its articles unchanged and gives no chunks.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        scraped = cut(corpus.extract_articles(batch.where(~corpus.is_blocked(F.col("html")))).drop("page_id"), "pages")
        stored = lambda: corpus.stored_articles(spark, path, scraped.drop("error"))
        outcomes = corpus.merge_into(path, scraped, stored().select("url", "content_hash"), buckets)
        changed = outcomes.where("written").select("bucket", "doc_id").distinct()
        write(outcomes, chunk_articles(stored().join(changed, ["bucket", "doc_id"], "left_semi").drop("bucket")), epoch)

    return handle
