"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A vector is turned by random signs and Hadamard transforms; its bucket is the axis (with sign) it then lies closest to.
A few rotations together make a table's bucket, several tables make misses rare, and further probes use the next-closest
axes. Vectors that share a bucket are compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import attach, connected_components, cut, table

THRESHOLD = 0.95
TABLES, PROBES = 6, 4
#: Steps of angle up to the threshold's, and the sum of two steps up to which vectors are certainly linked (a step to spare).
RINGS = 64
SURE = RINGS - 3
#: Rows of a block of a large bucket or component; blocks are compared pair by pair, in tasks of their own.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), scaled to keep lengths."""
    n, step = x.shape[1], 1
    x = x.copy()
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


def bucket_codes(x: np.ndarray, axes: int, tables: int = TABLES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """Bucket numbers (rows, tables * probes) of unit rows: ``axes`` rotations a table, the likeliest probes first."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), n))
    padded[:, : x.shape[1]] = x
    rng, out = np.random.default_rng([seed, n]), []
    for t in range(tables):
        choices = []
        for _ in range(axes):
            turned = padded
            for signs in rng.choice([-1.0, 1.0], size=(3, n)):
                turned = hadamard(turned * signs)
            size = np.abs(turned)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            value = np.take_along_axis(size, top, 1)
            top = np.take_along_axis(top, np.argsort(-value, axis=1, kind="stable"), 1)
            signed = 2 * top + (np.take_along_axis(turned, top, 1) < 0)
            choices.append((signed, -np.diff(np.sort(value, axis=1), axis=1)[:, 0]))
        # Probes flip the axes with the closest second choice first; the first probe flips none.
        loss = np.stack([c[1] for c in choices], axis=1)
        subsets = np.array([[s >> a & 1 for a in range(axes)] for s in range(1 << axes)])
        ranked = np.argsort(-(loss @ subsets.T), axis=1, kind="stable")[:, :probes]
        for p in range(ranked.shape[1]):
            flips = subsets[ranked[:, p]]
            code = np.full(len(x), t, np.int64)
            for a in range(axes):
                code = code * (2 * n) + np.take_along_axis(choices[a][0], flips[:, a : a + 1], 1)[:, 0]
            out.append(code)
    return np.stack(out, axis=1)


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column (all of one length) in double precision and unit length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.RecordBatch, np.ndarray], list], schema: str) -> DataFrame:
    """Run ``work(rows, unit vectors)`` on each group of ``keys``, whose sizes are bounded, in sorted streams.

    Groups are mostly tiny, so they are cut out of large Arrow batches here instead of being handed over one by one; only
    a batch's last group, which may go on in the next, waits.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            rows = rest if batch is None else batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if rows is None or not len(rows):
                rest = rows
                continue
            key = np.stack([rows.column(k).to_numpy(zero_copy_only=False) for k in keys])
            starts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(rows)]))
            if batch is not None:
                starts, rest = starts[:-1], rows.slice(starts[-2])
            if len(starts) < 2:
                continue
            x, out = unit_rows(rows.column("embedding").slice(0, starts[-1])), []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b - a > 1:
                    out += work(rows.slice(a, b - a), x[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(len(names))], names)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """``rep, n, embedding``: one row for each distinct usable vector, its smallest id and the number of its rows."""
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return vectors.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "embedding")


def blocks_of(df: DataFrame, key: str, size: str, member: str) -> DataFrame:
    """Deal a key's rows over blocks of about BLOCK rows and over all pairs ``(i, j)``, i <= j, of its blocks.

    Every two rows of a key meet in exactly one pair, or in their own block's ``(i, i)``; a key of up to BLOCK rows has
    one block. Large keys so become many tasks of bounded size.
    """
    n = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(member), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    return df.select("*", own.alias("own"), F.explode(pairs).alias("p")).select(*df.columns, "own", F.col("p.i").alias("i"), F.col("p.j").alias("j"))


def _sides(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of both blocks of a pair, and whether they are the same block."""
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    own = group.column("own").to_numpy()
    return np.flatnonzero(own == i), np.flatnonzero(own == j), i == j


def spanning_edges(group: pa.RecordBatch, x: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges that span the components of a block pair: every link inside is implied by them."""
    reps = group.column("rep").to_numpy()
    label, edges = np.arange(len(x)), []
    for at in range(0, len(x), 256):
        close = x[at : at + 256] @ x.T >= threshold
        for k in (np.flatnonzero(close.sum(axis=1) > 1) + at).tolist():
            mates = np.flatnonzero(close[k - at])
            others, firsts = np.unique(label[mates], return_index=True)
            if len(others) > 1:
                edges += [(int(reps[k]), int(reps[mates[f]])) for o, f in zip(others, firsts) if o != label[k]]
                label[np.isin(label, others)] = others[0]
    return edges


def link_counts(group: pa.RecordBatch, x: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Rows that each vector class of a block pair is linked with there, itself and what ``ring`` tells already left out."""
    left, right, same = _sides(group)
    (reps, n, ring), found = (group.column(c).to_numpy() for c in ("rep", "n", "ring")), []
    for one, other in [(left, right)] if same else [(left, right), (right, left)]:
        for at in range(0, len(one), 512):
            part = one[at : at + 512]
            close = x[part] @ x[other].T >= threshold
            close &= (reps[part][:, None] != reps[other][None, :]) & (ring[part][:, None] + ring[other][None, :] > SURE)
            found += zip(reps[part].tolist(), (close @ n[other]).tolist())
    return found


def rings(grouped: DataFrame, threshold: float) -> DataFrame:
    """``grouped`` with ``ring``, ``sure`` and ``open``: how far a class is from its component's pivot, and what follows.

    Angles add up: two vectors whose angles to the pivot come to less than the threshold's angle are linked without a
    comparison. Rings are steps of angle, a RINGS-th of that of the threshold each; a component's rows are counted by ring
    (pre-aggregated), and ``sure`` sums those that are certainly linked with the class. ``open`` classes may have links
    with others that the rings don't tell. A group of near copies is all within few rings, and none of it is open.
    """
    step = math.acos(threshold) / RINGS

    def angle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = (unit_rows(batch.column("embedding")) * unit_rows(batch.column("pivot"))).sum(axis=1) if len(batch) else np.empty(0)
            ring = np.minimum(np.arccos(np.clip(cosine, -1, 1)) / step, 2 * RINGS).astype(np.int32)
            yield batch.drop_columns(["pivot"]).append_column("ring", pa.array(ring))

    n_rows = grouped.count()
    pivots = cut(grouped.groupBy("component_id").agg(F.min_by("embedding", "rep").alias("pivot"), F.count("*").alias("members")), "pivots")
    near = attach(grouped, pivots, ["component_id"], "members", n_rows)
    placed = cut(near.mapInArrow(angle, StructType([*(f for f in near.schema if f.name != "pivot"), StructField("ring", IntegerType())])), "rings")
    per_ring = placed.groupBy("component_id", "ring").agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    known = per_ring.groupBy("component_id").agg(F.collect_list(F.struct("ring", "rows")).alias("by_ring"), F.max("ring").alias("outer"), F.sum("classes").alias("members"))  # 2 * RINGS + 1 entries at most
    found = attach(placed, cut(known, "ring-counts"), ["component_id"], "members", n_rows)
    sure = F.aggregate("by_ring", F.lit(0).cast("long"), lambda acc, r: acc + F.when(r["ring"] + F.col("ring") <= SURE, r["rows"]).otherwise(F.lit(0).cast("long")))
    own = F.when(2 * F.col("ring") <= SURE, F.col("n")).otherwise(F.lit(0))
    return found.select("rep", "n", "embedding", "component_id", "ring", (sure - own).alias("sure"), (F.col("ring") + F.col("outer") > SURE).alias("open"))


def bridging_edges(group: pa.RecordBatch, x: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """One link of a block pair for each two components (column ``component``) that have any there."""
    left, right, _ = _sides(group)
    reps, component, found = group.column("rep").to_numpy(), group.column("component").to_numpy(), {}
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        a, b = np.nonzero((x[part] @ x[right].T >= threshold) & (component[part][:, None] != component[right][None, :]))
        pairs, firsts = np.unique(np.sort(np.stack([component[part][a], component[right][b]], axis=1), axis=1), axis=0, return_index=True)
        for pair, k in zip(map(tuple, pairs.tolist()), firsts.tolist()):
            found.setdefault(pair, (int(reps[part[a[k]]]), int(reps[right[b[k]]])))
    return list(found.values())


def leader_edges(large: DataFrame, own: DataFrame, n_rows: int, threshold: float) -> DataFrame:
    """``a, b``: links of the entries (``code, rep, embedding, leader, members``) of large buckets with their bucket's leader."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                close = (unit_rows(batch.column("embedding")) * unit_rows(batch.column("first"))).sum(axis=1) >= threshold
                yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("rep")], ["a", "b"]).filter(pa.array(close))

    leaders = large.groupBy("code", "leader").agg(F.count("*").alias("heat")).join(own.select(F.col("rep").alias("leader"), F.col("embedding").alias("first")), "leader")
    met = attach(large.select("code", "rep", "embedding"), cut(leaders, "leaders"), ["code"], "heat", n_rows)
    return met.where("rep <> leader").select("leader", "rep", "embedding", "first").mapInArrow(linked, "a long, b long")


def rest_edges(large: DataFrame, edges: DataFrame, n_rows: int, threshold: float) -> DataFrame:
    """``a, b``: what else links components of ``edges`` inside large buckets.

    A bucket's largest component is not compared with itself: its other rows meet one another and that component's, in
    pairs of blocks. A bucket whose rows are one component by now takes no part.
    """
    component = connected_components(edges).select(F.col("node").alias("rep"), "component")
    placed = cut(large.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed-entries")
    sizes = placed.groupBy("code", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("code").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("heat")).where(F.col("heat") > F.col("main.n"))
    main = cut(main.select("code", F.col("main.component").alias("main"), F.col("main.n").alias("n_main"), (F.col("heat") - F.col("main.n")).alias("n_rest"), "heat"), "mains")
    met = attach(placed, main, ["code"], "heat", n_rows).where("main is not null")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    is_rest = F.col("component") != F.col("main")
    own = F.when(is_rest, F.pmod(F.xxhash64("rep"), blocks("n_rest"))).otherwise(blocks("n_rest") + F.pmod(F.xxhash64("rep"), blocks("n_main"))).cast("int")
    last = blocks("n_rest") - 1 + F.when(is_rest, blocks("n_main")).otherwise(0)
    pairs = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    dealt = met.select("code", "rep", "embedding", "component", own.alias("own"), F.explode(pairs).alias("p")).select("code", "rep", "embedding", "component", "own", "p.i", "p.j")
    return by_group(dealt, ["code", "i", "j"], lambda g, x: bridging_edges(g, x, threshold), "a long, b long")


def candidate_edges(usable: DataFrame, size: int, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``a, b``: verified links that span what shares a bucket, for classes of vectors of all lengths.

    Buckets of up to BLOCK rows are compared at once. Larger ones are compared within blocks of that size and with the
    bucket's leader, which makes most of a dense group one component at a cost in proportion to its size; only rows of
    different components then meet (``rest_edges``).
    """
    edges = usable.sparkSession.createDataFrame([], "a long, b long")
    for (width,) in usable.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).collect():  # a handful of lengths
        own = usable.where(F.size("embedding") == width).select("rep", "embedding")
        axes = max(1, min(8, round(math.log(max(size, 2) / 4) / math.log(2 * (1 << max(1, (width - 1).bit_length()))))))

        def code(batches: Iterator[pa.RecordBatch], axes=axes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    codes = bucket_codes(unit_rows(batch.column("embedding")), axes, tables, probes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rep").to_numpy(), codes.shape[1])), pa.array(codes.ravel())], ["rep", "code"])

        entries = cut(own.mapInArrow(code, "rep long, code long"), "codes")
        n_rows = entries.count()
        shared = entries.groupBy("code").agg(F.count("*").alias("members"), F.count("*").alias("heat"), F.min("rep").alias("leader")).where("members > 1")
        met = attach(entries, cut(shared, "shared-codes"), ["code"], "heat", n_rows).where("members is not null").join(own, "rep")
        dealt = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / BLOCK)).cast("int"))
        found = by_group(dealt.select("code", "own", "rep", "embedding"), ["code", "own"], lambda g, x: spanning_edges(g, x, threshold), "a long, b long")
        large = cut(met.where(F.col("members") > BLOCK).select("code", "rep", "embedding", "leader"), "large-buckets")
        if large.take(1):
            found = cut(found.unionByName(leader_edges(large, own, n_rows, threshold)), "near-edges")
            found = found.unionByName(rest_edges(large, found, n_rows, threshold))
        edges = edges.unionByName(found)
    return edges


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``vec_id, embedding`` -> ``vec_id, n_links, component_id, kept`` for every row.

    Equal vectors are one class first (pre-aggregated), so exact copies are never compared. Classes that share a bucket
    in any table are candidates; inside a bucket only edges that span its components are kept, so a dense group yields
    edges in proportion to its size. Buckets over BLOCK rows are linked through a leader and within blocks first; then only
    rows outside their largest component are compared, with all others, in pairs of blocks. After the components are
    known, links are counted: by angles to the component's pivot where these decide, else by comparing a component's
    undecided classes with one another in double precision, dealt out as pairs of blocks. So every link returned is
    certain, and links that no bucket found but a component implies count as well.

    Hashing misses some pairs just above the threshold whose components nothing else joins (recall in the README). Vectors
    that are null, empty, zero or hold null or non-finite components have no links and form components of their
    own; vectors of different lengths are never compared; repeated ids keep a row each; other columns are not looked at;
    an empty table gives none.
    """
    usable = cut(vector_classes(vectors.select("vec_id", "embedding")), "classes")
    edges = candidate_edges(usable, usable.count(), threshold, tables, probes)
    component = cut(connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("component_id")), "components")
    grouped = cut(usable.join(component, "rep").select("rep", "n", "embedding", "component_id"), "grouped")
    placed = cut(rings(grouped, threshold), "placed")
    undecided = placed.where("open").select("rep", "n", "embedding", "component_id", "ring")
    members = undecided.groupBy("component_id").agg(F.count("*").alias("members"))
    dealt = blocks_of(undecided.join(members, "component_id"), "component_id", "members", "rep")
    compared = by_group(dealt, ["component_id", "i", "j"], lambda g, x: link_counts(g, x, threshold), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    linked = placed.select("rep", "component_id", "sure").join(compared, "rep", "left")
    classes = usable.join(linked, "rep", "left")
    n_links = F.col("n") - 1 + F.coalesce("sure", F.lit(0)) + F.coalesce("links", F.lit(0))
    per_class = cut(classes.select("embedding", n_links.alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"), F.col("n").alias("rows")), "per-class")
    source = vectors.select("vec_id", "embedding")
    joined = attach(source, per_class, ["embedding"], "rows", source.count())
    own = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))


def op5_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings`` at a cosine of 0.95; cases as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
