"""Shared helpers of the training-data operators: reading tables, cutting lineage, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut, lean_batches, new_path, remove, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(rows: DataFrame, lookup: DataFrame, keys: list[str], heat: str, n_rows: int) -> DataFrame:
    """``rows`` left-joined with ``lookup`` (one row a key), where one key may hold any share of ``rows``.

    ``heat`` is lookup's column with the number of a key's rows. Keys of a thousandth of ``n_rows`` or more (a thousand at
    most, whatever the data's size) are broadcast and so joined where their rows are; the others are shuffled. Both
    inputs are read twice and should be written tables. ``heat`` is dropped.
    """
    hot = F.col(heat) * 1000 >= max(n_rows, 1)
    few, many = F.broadcast(lookup.where(hot).drop(heat)), lookup.where(~hot).drop(heat)
    return rows.join(few, keys).unionByName(rows.join(few.select(keys), keys, "left_anti").join(many, keys, "left"))


def crc_held_out(id_col: str = "doc_id"):
    """True for the third of ids that no model may learn labels from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` of longs: ``(node, component)``, component = smallest node id.

    Random-order contraction: every node points at the neighbour (or itself) with the smallest hashed id, edges are
    rewritten to those targets, loops and repeats go, and the rounds' maps are composed at the end. A fixed hash order
    halves chains and swallows stars, so rounds grow with the logarithm of the nodes. All steps are pre-aggregated
    group-bys and shuffle joins; each round is cut in the shared folder, and nothing but a row count reaches the driver.
    Null ends and loops are ignored; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    rest = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    rest = cut(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        if not rest.take(1):
            break
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        both = rest.select(F.col("a").alias("node"), key("b").alias("to")).unionByName(rest.select(F.col("b").alias("node"), key("a").alias("to")))
        best = both.groupBy("node").agg(F.min("to").alias("to"))
        step = cut(best.select("node", F.least("to", key("node"))["v"].alias("root")), "roots")
        maps.append(step)
        named = rest.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        rest = cut(named.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    found = maps[-1]
    for step in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("later"))
        found = cut(step.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root")), "composed")
    smallest = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(smallest, "root").select("node", "component")
