"""Conversations: scopes, roll-ups, pages, context windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .billing import usage_tokens


def visible_threads(threads: DataFrame, participants: DataFrame, user_id: int, scope: str = "all") -> DataFrame:
    """Threads of a user: ``mine`` are those created or taken part in, ``all`` adds what the organisation may see."""
    own = participants.where(F.col("user_id") == user_id).select("thread_id").distinct().withColumn("takes_part", F.lit(True))
    mine = (F.col("created_by") == user_id) | F.coalesce("takes_part", F.lit(False))
    return threads.join(own, "thread_id", "left").where(mine if scope == "mine" else mine | (F.col("visibility") == "org")).drop("takes_part")


def thread_rollup(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages, cents and tokens of each thread and its last message (180 characters of it)."""
    own = usage_tokens(messages)
    last = F.max_by(F.struct("role", F.substring("content", 1, 180).alias("preview"), "created_ts"), F.struct("created_ts", "message_id")).alias("last")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = own.groupBy("thread_id").agg(F.count("*").alias("message_count"), total("cost_cents"), total("input_tokens"), total("output_tokens"), last)
    rows = threads.join(sums, "thread_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("message_count", "cost_cents", "input_tokens", "output_tokens")]
    return rows.select("thread_id", "updated_ts", *zero, F.col("last.role").alias("last_role"), F.col("last.preview").alias("last_preview"), F.col("last.created_ts").alias("last_ts"))


def page(threads: DataFrame, cursor: int | None = None, limit: int = 20) -> DataFrame:
    """One page, latest update first, after thread ``cursor``; ``next_cursor`` is its last id where more follow, else null."""
    limit = max(1, min(50, limit))
    if cursor is not None:
        at = threads.where(F.col("thread_id") == cursor).select(F.col("updated_ts").alias("cu"), F.col("thread_id").alias("ct"))
        threads = threads.crossJoin(F.broadcast(at)).where((F.col("updated_ts") < F.col("cu")) | ((F.col("updated_ts") == F.col("cu")) & (F.col("thread_id") < F.col("ct")))).drop("cu", "ct")
    order = [F.col("updated_ts").desc(), F.col("thread_id").desc()]
    more = threads.orderBy(*order).limit(limit + 1).withColumn("n_", F.row_number().over(Window.orderBy(*order)))
    ends = F.broadcast(more.agg(F.when(F.max("n_") > limit, F.max(F.when(F.col("n_") == limit, F.col("thread_id")))).alias("next_cursor")))
    return more.where(F.col("n_") <= limit).crossJoin(ends).drop("n_")


def thread_details(messages: DataFrame, citations: DataFrame, feedback: DataFrame) -> DataFrame:
    """A row for each message in its thread's order, with citations by score and its feedback nested."""
    cited = citations.groupBy("message_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("by"), "chunk_id", "score"))), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["score"].alias("score"))).alias("citations"))
    rated = feedback.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("user_id", "rating"))).alias("feedback"))
    n = F.row_number().over(Window.partitionBy("thread_id").orderBy("created_ts", "message_id"))
    return messages.join(cited, "message_id", "left").join(rated, "message_id", "left").withColumn("n", n)


def context_window(messages: DataFrame, first: int = 24, last: int = 12, recent: bool = False) -> DataFrame:
    """Messages that a model sees: of the oldest ``first`` (``recent``: the latest) the last ``last`` of user and assistant."""
    asc, desc = [F.col("created_ts"), F.col("message_id")], [F.col("created_ts").desc(), F.col("message_id").desc()]
    edge = F.row_number().over(Window.partitionBy("thread_id").orderBy(*(desc if recent else asc)))
    seen = messages.withColumn("a_", edge).where(F.col("a_") <= first).where(F.col("role").isin("user", "assistant"))
    return seen.withColumn("b_", F.row_number().over(Window.partitionBy("thread_id").orderBy(*desc))).where(F.col("b_") <= last).drop("a_", "b_")


def titled_threads(threads: DataFrame, messages: DataFrame, default: str = "New thread") -> DataFrame:
    """Threads that still have the default title get one from their first user message."""
    first = messages.where("role = 'user'").groupBy("thread_id").agg(F.min_by("content", F.struct("created_ts", "message_id")).alias("first"))
    rows = threads.join(first, "thread_id", "left")
    return rows.withColumn("title", F.when((F.col("title") == default) & F.col("first").isNotNull(), T.thread_title("first", default)).otherwise(F.col("title"))).drop("first")


def display_text(content, has_citations):
    """Assistant text as shown: without a closing source list if citations are kept apart, citation marks spaced, wrapped list lines joined."""
    shown = F.when(has_citations, T.strip_trailing_sources(content)).otherwise(T.col(content))
    return T.join_list_continuations(T.space_citations(shown))


def prompt_sizes(messages: DataFrame, instructions: str) -> DataFrame:
    """``thread_id, model_id, prompt_chars``: characters of each thread's messages in order below the instructions, a line
    each, without white space at the end. Sizes are summed, so no thread's text is put together anywhere."""
    sized = messages.select("thread_id", "model_id", F.struct("created_ts", "message_id").alias("at"), F.length("content").alias("n"), F.length(T.strip_end("content")).alias("filled"))
    last = sized.groupBy("thread_id").agg(F.max("model_id").alias("model_id"), F.max(F.when(F.col("filled") > 0, F.struct("at", "filled"))).alias("last"))
    upto = sized.select("thread_id", "at", "n").join(last.select("thread_id", "last"), "thread_id").where(F.col("at") < F.col("last.at")).groupBy("thread_id").agg(F.sum(F.col("n") + 1).alias("before"))
    chars = F.lit(len(instructions)) + F.when(F.col("last").isNotNull(), 1 + F.coalesce("before", F.lit(0)) + F.col("last.filled")).otherwise(0)
    return last.join(upto, "thread_id", "left").select("thread_id", "model_id", chars.alias("prompt_chars"))
