"""Token usage, model prices, and the wallet ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import cut

PROVIDERS = ("openai", "anthropic", "gemini")

# Families of models with their exact ids, the pattern of their dated and previewed ids, USD per million
# input and output tokens, and threshold and rates of the long-context tier where there is one. Patterns are tried in order.
MODELS = (
    ("gpt-5.2-pro", ("gpt-5.2-pro",), None, 21, 168),
    ("gpt-5.2", ("gpt-5.2",), None, 1.75, 14),
    ("gpt-5.1", ("gpt-5.1",), None, 1.25, 10),
    ("gpt-5", ("gpt-5",), None, 1.25, 10),
    ("gpt-5-mini", ("gpt-5-mini",), None, 0.25, 2),
    ("gpt-5-nano", ("gpt-5-nano",), None, 0.05, 0.4),
    ("claude-opus-4-6", ("claude-opus-4-6", "claude-opus-4-6-20260114"), r"^claude-opus-4-6(?:-\d{8})?$", 15, 75, 200_000, 30, 75),
    ("claude-opus-4-1", ("claude-opus-4-1", "claude-opus-4-1-20250805"), r"^claude-opus-4-1(?:-\d{8})?$", 15, 75),
    ("claude-opus-4", ("claude-opus-4-0", "claude-opus-4-20250514"), r"^claude-opus-4(?:-(?:0|\d{8}))?$", 15, 75),
    ("claude-sonnet-4-5", ("claude-sonnet-4-5", "claude-sonnet-4-5-20250929"), r"^claude-sonnet-4-5(?:-\d{8})?$", 3, 15, 200_000, 6, 15),
    ("claude-sonnet-4", ("claude-sonnet-4-0", "claude-sonnet-4-20250514"), r"^claude-sonnet-4(?:-(?:0|\d{8}))?$", 3, 15),
    ("claude-haiku-4-5", ("claude-haiku-4-5", "claude-haiku-4-5-20251001"), r"^claude-haiku-4-5(?:-\d{8})?$", 1, 5),
    ("claude-3-7-sonnet", ("claude-3-7-sonnet-latest", "claude-3-7-sonnet-20250219"), r"^claude-3-7-sonnet(?:-(?:latest|\d{8}))?$", 3, 15),
    ("claude-3-5-sonnet", ("claude-3-5-sonnet-latest", "claude-3-5-sonnet-20241022", "claude-3-5-sonnet-20240620"), r"^claude-3-5-sonnet(?:-(?:latest|\d{8}))?$", 3, 15),
    ("claude-3-5-haiku", ("claude-3-5-haiku-latest", "claude-3-5-haiku-20241022"), r"^claude-3-5-haiku(?:-(?:latest|\d{8}))?$", 0.8, 4),
    ("claude-3-opus", ("claude-3-opus-20240229",), r"^claude-3-opus(?:-(?:latest|\d{8}))?$", 15, 75),
    ("claude-3-haiku", ("claude-3-haiku-20240307",), r"^claude-3-haiku(?:-(?:latest|\d{8}))?$", 0.25, 1.25),
    ("gemini-2.5-pro", ("gemini-2.5-pro", "gemini-2.5-pro-preview-06-05", "gemini-2.5-pro-preview-05-06"), r"^gemini-2\.5-pro(?:-preview-(?:\d{2}-\d{2}|\d{2}-\d{4}))?$", 1.25, 10, 200_000, 2.5, 15),
    ("gemini-2.5-flash", ("gemini-2.5-flash", "gemini-2.5-flash-preview-05-20", "gemini-2.5-flash-preview-09-2025"), r"^gemini-2\.5-flash(?:-preview-(?:\d{2}-\d{2}|\d{2}-\d{4}))?$", 0.3, 2.5),
    ("gemini-2.5-flash-lite", ("gemini-2.5-flash-lite", "gemini-2.5-flash-lite-preview-06-17", "gemini-2.5-flash-lite-preview-09-2025"), r"^gemini-2\.5-flash-lite(?:-preview-(?:\d{2}-\d{2}|\d{2}-\d{4}))?$", 0.1, 0.4),
    ("gemini-2.0-flash", ("gemini-2.0-flash",), r"^gemini-2\.0-flash(?:-\d{3})?$", 0.1, 0.4),
    ("gemini-2.0-flash-lite", ("gemini-2.0-flash-lite",), r"^gemini-2\.0-flash-lite(?:-\d{3})?$", 0.075, 0.3),
    ("gemini-3-pro-preview", ("gemini-3-pro-preview",), None, 2, 12, 200_000, 4, 18),
    ("gemini-3-flash-preview", ("gemini-3-flash-preview",), None, 0.5, 3),
    ("gemini-3-pro-image-preview", ("gemini-3-pro-image-preview",), None, 2, 120),
    ("gemini-2.5-flash-image", ("gemini-2.5-flash-image",), None, 0.3, 30),
    ("gemini-2.5-flash-preview-tts", ("gemini-2.5-flash-preview-tts",), None, 0.5, 10),
    ("gemini-2.5-pro-preview-tts", ("gemini-2.5-pro-preview-tts",), None, 1, 20),
    ("gemini-2.5-computer-use-preview-10-2025", ("gemini-2.5-computer-use-preview-10-2025",), None, 1.25, 10, 200_000, 2.5, 15),
)
# Ids that are known to have no price; the search stops at them.
UNRESOLVED = (
    "gemini-2.0-flash-preview-image-generation", "gemini-2.0-flash-exp-image-generation", "gemini-flash-latest", "gemini-flash-lite-latest", "gemini-pro-latest", "gemini-exp-1206",
    "claude-opus-4-5", "claude-opus-4-5-20251001",
)
RATES = "family string, input_rate double, output_rate double, threshold long, long_input_rate double, long_output_rate double"


def provider_of(family: str) -> str:
    return {"gpt": "openai", "claude": "anthropic", "gemini": "gemini"}[family.split("-")[0]]


def price_list(spark: SparkSession) -> DataFrame:
    """``family`` with its rates; the long-context columns are null without such a tier."""
    rows = [(f, *map(float, r[:2]), int(r[2]) if len(r) > 2 else None, *(map(float, r[3:]) if len(r) > 2 else (None, None))) for f, _, _, *r in MODELS]
    return spark.createDataFrame(rows, RATES)


def exact_ids() -> dict[str, str | None]:
    """Families by ``provider:id``; none for ids known to have no price."""
    return {f"{provider_of(i)}:{i}": family for family, ids, *_ in MODELS for i in ids} | {f"{provider_of(i)}:{i}": None for i in UNRESOLVED}


def price_keys(spark: SparkSession) -> DataFrame:
    """``key, family`` of exact ids; a null family means known to have no price."""
    return spark.createDataFrame(sorted(exact_ids().items()), "key string, family string")


def split_model_id(model_id: Column) -> tuple[Column, Column]:
    """Provider and model of ``provider:model`` at the first colon; nulls for unknown providers and empty parts."""
    at = F.instr(model_id, ":")
    provider, model = F.substring(model_id, F.lit(1), at - 1), T.strip(F.substring(model_id, at + 1, F.length(model_id)))
    fine = (at > 1) & provider.isin(*PROVIDERS) & (model != "")
    return F.when(fine, provider), F.when(fine, model)


def resolve_prices(model_ids: DataFrame) -> DataFrame:
    """``model_id, provider, api_model, family`` and rates of the distinct model ids of a table.

    In this order: exact key; the id without an ISO date, without a compact date, without ``-latest``; ordered patterns.
    A known id without a price ends the search with null rates. Only distinct ids take part.
    """
    spark = model_ids.sparkSession
    provider, model = split_model_id(F.col("model_id"))
    ids = model_ids.select("model_id").where("model_id is not null").distinct().select("model_id", provider.alias("provider"), model.alias("api_model"))
    keys = F.broadcast(price_keys(spark))  # under a hundred rows
    found = ids
    tries = {"exact": "$^", "iso": r"-\d{4}-\d{2}-\d{2}$", "compact": r"-\d{8}$", "latest": "-latest$"}
    for name, pattern in tries.items():
        variant = F.regexp_replace("api_model", pattern, "") if name != "exact" else F.col("api_model")
        own = keys.select(F.col("key").alias(f"k_{name}"), F.struct("family").alias(name))
        found = found.withColumn(f"v_{name}", F.concat_ws(":", "provider", variant)).join(own, F.col(f"v_{name}") == F.col(f"k_{name}"), "left").drop(f"v_{name}", f"k_{name}")
    by_pattern = F.lit(None).cast("string")
    for family, _, pattern, *_ in reversed(MODELS):
        if pattern:
            by_pattern = F.when(F.col("api_model").rlike(pattern) & (F.col("provider") == provider_of(family)), family).otherwise(by_pattern)
    family = F.coalesce(*tries, F.struct(by_pattern.alias("family")))["family"]
    return found.select("model_id", "provider", "api_model", family.alias("family")).join(F.broadcast(price_list(spark)), "family", "left").select("model_id", "provider", "api_model", *[c.split()[0] for c in RATES.split(", ")])


def turn_costs(turns: DataFrame) -> DataFrame:
    """``turns`` (``model_id, input_tokens, output_tokens``) with ``cost_usd``, ``tier`` and ``cost_cents`` (rounded up).

    More input tokens than the threshold put both rates on the long-context tier; no price costs 0 with tier ``unknown``.
    """
    long = F.coalesce(F.col("input_tokens") > F.col("threshold"), F.lit(False))
    rate = lambda side: F.when(long, F.col(f"long_{side}_rate")).otherwise(F.col(f"{side}_rate"))
    usd = F.col("input_tokens") / 1e6 * rate("input") + F.col("output_tokens") / 1e6 * rate("output")
    priced = turns.join(resolve_prices(turns), "model_id", "left")
    tier = F.when(F.col("input_rate").isNull(), "unknown").when(long, "long-context").otherwise("standard")
    out = priced.withColumn("cost_usd", F.coalesce(usd, F.lit(0.0))).withColumn("tier", tier).withColumn("cost_cents", usd_to_cents(F.col("cost_usd")))
    return out.select(*turns.columns, "cost_usd", "tier", "cost_cents")


def usd_to_cents(usd: Column) -> Column:
    fine = usd.isNotNull() & ~F.isnan(usd) & (usd < float("inf")) & (usd > 0)
    return F.when(fine, F.ceil(usd * 100)).otherwise(0).cast("long")


def usage_tokens(messages: DataFrame) -> DataFrame:
    """``messages`` with ``input_tokens, output_tokens, total_tokens`` out of the usage JSON (three spellings), numbers only."""
    names = {"input": ("inputTokens", "prompt_tokens", "promptTokenCount", "input_tokens"), "output": ("outputTokens", "completion_tokens", "candidatesTokenCount", "output_tokens"), "total": ("totalTokens", "total_tokens", "totalTokenCount")}
    schema = ", ".join(f"{n} double" for own in names.values() for n in own)
    parsed = messages.withColumn("u_", F.from_json("usage", schema))
    pick = lambda kind: F.coalesce(*[F.col("u_")[n] for n in names[kind]])
    parsed = parsed.withColumn("input_tokens", pick("input")).withColumn("output_tokens", pick("output"))
    return parsed.withColumn("total_tokens", F.coalesce(pick("total"), F.col("input_tokens") + F.col("output_tokens"))).drop("u_")


def normalized_usage(messages: DataFrame, prompt: str, reply: str) -> DataFrame:
    """Usage with estimates of the texts where a provider sent none; the total is the sum unless given."""
    own = usage_tokens(messages)
    own = own.withColumn("input_tokens", F.coalesce("input_tokens", T.estimate_service_tokens(prompt).cast("double"))).withColumn("output_tokens", F.coalesce("output_tokens", T.estimate_service_tokens(reply).cast("double")))
    return own.withColumn("total_tokens", F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens")))


def max_turn_cost(prompts: DataFrame, max_output_tokens: int, safety: float = 1.25) -> DataFrame:
    """``prompts`` (``model_id`` and ``prompt``, or its ``prompt_chars``) with the tokens and cents to reserve; ``cents`` is null where no price is known."""
    estimate = F.ceil(F.col("prompt_chars") / 4).cast("int") if "prompt_chars" in prompts.columns else T.estimate_service_tokens("prompt")
    own = prompts.withColumn("input_tokens", F.greatest(F.lit(1), estimate)).withColumn("output_tokens", F.lit(max(1, max_output_tokens)))
    cents = F.when(F.col("tier") != "unknown", F.greatest(F.lit(1), F.ceil(F.col("cost_usd") * 100 * safety))).cast("long")
    return turn_costs(own).withColumn("cents", cents).drop("cost_cents")


def settle(requests: DataFrame) -> DataFrame:
    """Ledger rows of settled requests: the debit, the actual cents within the reservation, and the release of the rest."""
    debit = F.greatest(F.lit(0), F.least(F.col("actual_cents"), F.col("reserved_cents")))
    rows = F.array(F.struct(F.lit("debit").alias("kind"), debit.alias("amount_cents")), F.struct(F.lit("release").alias("kind"), (F.col("reserved_cents") - debit).alias("amount_cents")))
    return requests.where("actual_cents is not null").select("request_id", "user_id", "ts", F.explode(rows).alias("r")).select("request_id", "user_id", "ts", "r.kind", "r.amount_cents").where("amount_cents > 0")


def ledger(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """All ledger rows: grants, reservations, and what settling them brings."""
    start = requests.agg(F.min("ts").alias("ts"))
    granted = grants.where("amount_cents > 0").crossJoin(F.broadcast(start)).select(F.lit(None).cast("long").alias("request_id"), "user_id", "ts", F.lit("grant").alias("kind"), "amount_cents")
    reserved = requests.select("request_id", "user_id", "ts", F.lit("reservation").alias("kind"), F.col("reserved_cents").alias("amount_cents"))
    return granted.unionByName(reserved).unionByName(settle(requests))


def _sum(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount_cents"))), F.lit(0))


def wallet_balances(entries: DataFrame) -> DataFrame:
    return entries.groupBy("user_id").agg((_sum("grant") - _sum("reservation") + _sum("release")).alias("balance_cents"), _sum("grant").alias("granted_cents"), _sum("debit").alias("spent_cents"))


def reconcile(wallets: DataFrame, entries: DataFrame) -> DataFrame:
    """Users whose stored balance is not the ledger's, or who have one of the two alone."""
    both = wallets.select("user_id", F.col("balance_cents").alias("stored_cents")).join(wallet_balances(entries).select("user_id", F.col("balance_cents").alias("ledger_cents")), "user_id", "full_outer")
    return both.where(~F.col("stored_cents").eqNullSafe(F.col("ledger_cents"))).withColumn("difference_cents", F.coalesce("stored_cents", F.lit(0)) - F.coalesce("ledger_cents", F.lit(0)))


def open_reservations(entries: DataFrame) -> DataFrame:
    """Requests whose reservation is not used up by debits and releases."""
    own = entries.where("request_id is not null").groupBy("request_id").agg(F.max("user_id").alias("user_id"), (_sum("reservation") - _sum("debit") - _sum("release")).alias("open_cents"))
    return own.where("open_cents > 0")


def release_rows(entries: DataFrame, ts: Column) -> DataFrame:
    """Release rows that close the open reservations."""
    return open_reservations(entries).select("request_id", "user_id", ts.alias("ts"), F.lit("release").alias("kind"), F.col("open_cents").alias("amount_cents"))


def running_balance(entries: DataFrame) -> DataFrame:
    """Every ledger row with the user's balance after it; rows of one time come grant, reservation, debit, release.

    Sums of two levels: the ledger is sorted in ranges, which cut a long history wherever they fall, and written with the
    range of each row; a row's balance is the sum so far in its range, and what the user's earlier ranges add up to. No
    task sees more of a user than a range. Rows alike in all of the order's columns go by kind and amount.
    """
    sign = F.when(F.col("kind").isin("grant", "release"), F.col("amount_cents")).when(F.col("kind") == "reservation", -F.col("amount_cents")).otherwise(0)
    order = F.when(F.col("kind") == "grant", 0).when(F.col("kind") == "reservation", 1).when(F.col("kind") == "debit", 2).otherwise(3)
    keys = ["ts", "request_id", "order_", "kind", "amount_cents"]
    placed = cut(entries.withColumns({"sign_": sign, "order_": order}).orderBy("user_id", *keys).withColumn("range_", F.spark_partition_id()), "ledger")
    inside = Window.partitionBy("user_id", "range_").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(F.col("user_id").alias("user_"), F.col("range_").alias("of_")).agg(F.sum("sign_").alias("total_"))
    before = Window.partitionBy("user_").orderBy("of_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("user_", "of_", F.coalesce(F.sum("total_").over(before), F.lit(0)).alias("before_"))
    rows = placed.withColumn("so_far_", F.sum("sign_").over(inside)).join(offsets, F.col("user_id").eqNullSafe(F.col("user_")) & (F.col("range_") == F.col("of_")))
    return rows.select(*entries.columns, (F.col("before_") + F.col("so_far_")).alias("balance_cents"))


def replay_admissions(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """``request_id, user_id, accepted, balance_after``: a reservation passes only if the balance of that moment covers it.

    Each decision depends on those before, so a user's requests are a fold in order of time and id. It runs over sorted
    partitions as a stream: a task keeps one balance, whatever the length of a user's history.
    """
    granted = grants.groupBy("user_id").agg(F.sum("amount_cents").alias("granted"))
    rows = requests.join(granted, "user_id", "left").select("user_id", "ts", "request_id", "reserved_cents", F.coalesce("actual_cents", F.lit(-1)).alias("actual"), F.coalesce("granted", F.lit(0)).alias("granted"))
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "request_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, balance = object(), 0
        for b in batches:
            out = []
            for u, request, amount, actual, start in zip(b.user_id, b.request_id, b.reserved_cents, b.actual, b.granted):
                if u != user:
                    user, balance = u, start
                accepted = amount > 0 and balance >= amount
                if accepted:
                    balance -= amount if actual < 0 else min(actual, amount)
                out.append((request, u, accepted, balance))
            yield pd.DataFrame(out, columns=["request_id", "user_id", "accepted", "balance_after"])

    return ordered.mapInPandas(run, "request_id long, user_id long, accepted boolean, balance_after long")


def user_profiles(entries: DataFrame, messages: DataFrame, users: DataFrame) -> DataFrame:
    """Spending, billed turns and lifetime tokens of every user; only positive numbers count, rounded.

    ``entries`` are debits with ``message_id``; ``messages`` carry the usage JSON.
    """
    tokens = usage_tokens(messages).select("message_id", *[F.when(F.col(c) > 0, F.round(c)).otherwise(0).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")])
    billed = entries.where("kind = 'debit'").join(tokens, "message_id", "left")
    total = F.when(F.col("total_tokens") > 0, F.col("total_tokens")).otherwise(F.col("input_tokens") + F.col("output_tokens"))
    own = billed.groupBy("user_id").agg(F.sum("amount_cents").alias("spent_cents"), F.countDistinct("message_id").alias("billed_turns"), *[F.sum(c).alias(f"lifetime_{n}") for n, c in (("input", F.col("input_tokens")), ("output", F.col("output_tokens")), ("total", total))])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return users.select("user_id").join(own, "user_id", "left").select("user_id", *map(zero, ("spent_cents", "billed_turns", "lifetime_input", "lifetime_output", "lifetime_total")))


def org_totals(users: DataFrame, wallets: DataFrame) -> DataFrame:
    rows = users.join(wallets, "user_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.agg(F.count("*").alias("users"), F.count_if(F.col("status") == "active").alias("active_users"), *map(zero, ("balance_cents", "spent_cents", "granted_cents")))


def reprice(usage: DataFrame, rag_tokens: int = 0, caching: bool = False, daily_volume: int = 1, markup_percent: float = 0.0, anchor: str = "gpt-5-mini") -> DataFrame:
    """Cost of a usage table (``input_tokens, output_tokens``) under every priced family, cheapest first, relative to ``anchor``.

    The price list has a few dozen rows and is broadcast; usage is summed per family on the map side.
    """
    prices = F.broadcast(price_list(usage.sparkSession))
    input_tokens = (F.col("input_tokens") + rag_tokens) * (0.5 if caching else 1.0)
    long = F.coalesce(input_tokens > F.col("threshold"), F.lit(False))
    rate = lambda side: F.when(long, F.col(f"long_{side}_rate")).otherwise(F.col(f"{side}_rate"))
    cost = (input_tokens / 1e6 * rate("input") + F.col("output_tokens") / 1e6 * rate("output")) * daily_volume * (1 + markup_percent / 100)
    totals = usage.select("input_tokens", "output_tokens").crossJoin(prices).groupBy("family").agg(F.sum(cost).alias("usd"))
    base = F.broadcast(totals.where(F.col("family") == anchor).select(F.col("usd").alias("anchor_usd")))
    ranked = totals.crossJoin(base).withColumn("usd", F.round("usd", 4)).withColumn("relative", F.round(F.col("usd") / F.col("anchor_usd"), 3)).drop("anchor_usd")
    return ranked.orderBy("usd", "family")
