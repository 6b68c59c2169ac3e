"""Invitations, sign-in decisions, stored keys, audit events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def normalize_email(c) -> Column:
    return F.lower(T.strip(c))


def expire_invites(invites: DataFrame, now: Column) -> DataFrame:
    return invites.withColumn("status", F.when((F.col("status") == "pending") & (F.col("expires_at") <= now), "expired").otherwise(F.col("status")))


def active_invites(invites: DataFrame, now: Column) -> DataFrame:
    """The newest pending, unexpired invitation of each address as of ``now``."""
    live = invites.where((F.col("status") == "pending") & (F.col("expires_at") > now)).withColumn("email", normalize_email("email"))
    newest = F.row_number().over(Window.partitionBy("email").orderBy(F.col("created_at").desc(), F.col("invite_id").desc()))
    return live.withColumn("r_", newest).where("r_ = 1").drop("r_")


def login_decisions(attempts: DataFrame, users: DataFrame, invites: DataFrame, now: Column, home_domain: str, admins: Iterable[str] = ()) -> DataFrame:
    """``attempts`` with ``allowed``, ``reason`` (null if allowed) and ``role``; the first rule that applies decides."""
    own = users.select(normalize_email("email").alias("e_"), F.col("status").alias("user_status"))
    live = active_invites(invites, now).select(F.col("email").alias("i_"), F.col("invite_id").alias("live_invite"), F.col("role").alias("invite_role") if "role" in invites.columns else F.lit(None).cast("string").alias("invite_role"))
    rows = attempts.withColumn("n_", F.nullif(normalize_email("email"), F.lit("")))
    rows = rows.join(own, F.col("n_") == F.col("e_"), "left").join(live, F.col("n_") == F.col("i_"), "left")
    reason = (
        F.when(F.col("n_").isNull(), "missing_email").when(~F.coalesce("email_verified", F.lit(False)), "unverified_email").when(F.col("user_status") == "disabled", "disabled_user")
        .when(F.col("n_").endswith("@" + home_domain), F.lit(None)).when(F.col("user_status") == "active", F.lit(None)).when(F.col("live_invite").isNotNull(), F.lit(None)).otherwise("invite_required")
    )
    role = F.when(F.col("live_invite").isNotNull() & F.col("invite_role").isNotNull(), F.col("invite_role")).when(F.col("n_").isin(*[a.strip().lower() for a in admins] or [""]), "admin").otherwise("member")
    out = rows.withColumn("reason", reason)
    return out.withColumn("allowed", F.col("reason").isNull()).withColumn("role", F.when(F.col("reason").isNull(), role)).drop("n_", "e_", "i_", "user_status", "live_invite", "invite_role")


def key_versions(keys: DataFrame, current: str = "v2") -> DataFrame:
    """``version, key_id, n, legacy``: how many stored keys each encryption version and key id has."""
    part = lambda i: F.split_part("encrypted_key", F.lit(":"), F.lit(i))
    own = keys.groupBy(part(1).alias("version"), part(2).alias("key_id")).agg(F.count("*").alias("n"))
    return own.withColumn("legacy", F.col("version") != current).orderBy("version", "key_id")


def sanitize_audit(events: DataFrame) -> DataFrame:
    return events.withColumn("target_id", T.safe_token("target_id", "redacted")).withColumn("request_id", T.safe_token("request_id", None)).withColumn("reason_code", T.safe_reason("reason_code"))
