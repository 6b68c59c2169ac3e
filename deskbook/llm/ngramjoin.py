"""N-gram Jaccard join: a size-aware heavy-light similarity join of word-shingle sets.

Small sets enumerate their subsets of the size that a partner must share; linked sets share one. Large sets scan inverted
lists of shingles. Of a large set only a prefix stands in lists: its rarest shingles, so many that two partners cannot miss
each other, and none if too few of its shingles occur elsewhere at all. A passage in a third of all documents is so no
list but that of documents made of it. The boundary between small and large is where enumerating costs as much as listing,
from the sizes at hand.

How the prefix is exact: a set of n shingles has a partner's share of ``ceil(t * n)`` or more. Of its ``n - ceil(t * n) + l(n)``
smallest shingles by hash, partners have ``l`` or more in common, l of the smaller set. Only these are counted over the
corpus; among them, ordered by frequency, the first ``... - l(ceil(t * n)) + 1`` hold a common one.

Shingles are 64-bit hashes, multilinear over a word's bytes and then over a window's words; equal hashes count as equal
shingles, which for two given ones goes wrong with a chance of 2^-56 or less.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, connected_components, cut, lean_batches, new_path, remove, table

U = np.uint64
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
#: Shingle numbers set one bit each in a sketch of so many bits, whose differing bits bound the sets' difference from below.
SKETCH_BITS = 1024
#: Members of a block of a leader's group: larger groups are compared block by block, in tasks of their own.
BLOCK, MAIN_BLOCK = 512, 2048
LONGEST_LIGHT = 40
#: Share of a set's size that partners are to have in common among the smallest hashes.
COMMON = 0.1
#: Texts that are hashed together: documents and bytes (a longer text is a batch of its own).
BATCH_DOCS, BATCH_BYTES = 1000, 1_200_000
#: Bytes of text whose shingles meet in one bin.
BIN_BYTES = 24_000_000
#: Ids that may be broadcast to pick texts; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _factors(n: int, seed: int = 0) -> np.ndarray:
    """Fixed pseudo-random odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_letters = [_factors(1 << 10)]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of folded bytes: sums of bytes times the factors of their places in the word."""
    space = raw == 32
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    longest = int((ends - starts).max())
    if len(_letters[0]) < longest:
        _letters[0] = _factors(1 << longest.bit_length())
    body = np.flatnonzero(~space)
    first = np.cumsum(ends - starts) - (ends - starts)  # of each word in the bytes without spaces
    place = np.arange(len(body)) - np.repeat(first, ends - starts)
    value = _letters[0][place] * (raw[body].astype(np.uint64) + U(1))
    return starts, mix(np.add.reduceat(value, first) + (ends - starts).astype(np.uint64))


def batch_shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle numbers of several texts and the texts' numbers, sorted by text and shingle."""
    lengths = np.array([len(t) + 1 for t in texts])
    bounds = np.cumsum(lengths)
    starts, w = word_hashes(np.frombuffer(b" ".join(texts).translate(FOLD), np.uint8))
    doc = np.searchsorted(bounds, starts, side="right")
    counts = np.bincount(doc, minlength=len(texts))
    factor = _factors(words, 5)
    found, owner = [], []
    if len(w) >= words:
        whole = doc[: len(w) - words + 1] == doc[words - 1 :]
        total = np.zeros(len(whole), np.uint64)
        for i in range(words):
            total += w[i : len(w) - words + 1 + i] * factor[i]
        found.append(mix(total[whole]))
        owner.append(doc[: len(whole)][whole])
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first, total = (np.cumsum(counts) - counts)[short], counts[short].astype(np.uint64) * U(0x51ED27)
        for i in range(words - 1):
            has = counts[short] > i
            total[has] += w[first[has] + i] * factor[i]
        found.append(mix(total))
        owner.append(short)
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, d = np.concatenate(found), np.concatenate(owner).astype(np.uint16 if len(texts) < 1 << 16 else np.int64)
    by_hash = np.argsort(h)
    order = by_hash[np.argsort(d[by_hash], kind="stable")]
    h, d = h[order], d[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
    return h[fresh], d[fresh].astype(np.int64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle numbers of a whole text; the whole sequence where there are fewer words."""
    return batch_shingles([(text or "").encode()], words)[0]


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``words`` words link at ``num / den`` of Jaccard similarity."""

    words: int = 4
    num: int = 85
    den: int = 100

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def least(self, n):
        """Least intersection of a set of n with any partner, and so a partner's least size."""
        return -(-self.num * n // self.den)

    def fits(self, a: int, b: int) -> bool:
        return self.den * min(a, b) >= self.num * max(a, b)

    def largest(self, a: int) -> int:
        return a * self.den // self.num

    def common(self, n):
        """Shingles that a set of n is to share among the smallest hashes with a partner that is no smaller."""
        return np.maximum(1, np.ceil(COMMON * np.asarray(n))).astype(np.int64)

    def counted(self, n):
        """Number of a set's smallest shingles that are counted over the corpus."""
        return np.minimum(n, n - self.least(n) + self.common(n))


@lru_cache(maxsize=None)
def _removals(n: int, r: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), r)), np.int64).reshape(math.comb(n, r), r)


@lru_cache(maxsize=None)
def partners(n: int, sim: Similarity) -> tuple[tuple[int, int, int], ...]:
    """``(smaller size, larger size, overlap that links them)`` of a set of size n with each size that fits."""
    sizes = [m for m in range(1, sim.largest(n) + 1) if sim.fits(n, m)]
    return tuple((min(n, m), max(n, m), o) for m in sizes if (o := sim.overlap(n, m)) <= min(n, m))


def n_subsets(n: int, sim: Similarity) -> int:
    return sum(math.comb(n, o) for _, _, o in partners(n, sim))


def subset_keys(h: np.ndarray, sim: Similarity) -> np.ndarray:
    """Keys of all subsets of a small set that a partner of each size would share: linked sets share one, and few others do."""
    mixed, keys = mix(h + U(1)), []
    total = mixed.sum(dtype=np.uint64)
    for small, large, o in partners(len(h), sim):
        gone = mixed[_removals(len(h), len(h) - o)].sum(axis=1, dtype=np.uint64)
        keys.append(mix(total - gone + U((small * 0xA24BAED4963EE407 + large * 0x9FB21C651E98DF25) % (1 << 64))))
    return np.concatenate(keys)


def in_lists(n: int, sim: Similarity, light: int) -> bool:
    """Whether sets of size n stand in inverted lists: large ones, and small ones that a large one may link with."""
    return n > light or n > 0 and sim.fits(n, light + 1)


def sketch(h: np.ndarray) -> bytes:
    bits = np.zeros(SKETCH_BITS, np.uint8)
    bits[(h & U(SKETCH_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def light_boundary(docs: DataFrame, sim: Similarity) -> int:
    """Largest size whose sets enumerate subsets, by cost: keys made, and for lists the counting that they need.

    Sizes are taken from the numbers of words of all short texts (a histogram of LONGEST_LIGHT rows at most); the
    boundary changes the work alone, not the links.
    """
    n_words = F.size(F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    short = docs.where(F.octet_length("text") <= 40 * LONGEST_LIGHT).select(F.greatest(F.lit(1), n_words - sim.words + 1).alias("n"))
    rows = {r.n: r["count"] for r in short.where(F.col("n") <= LONGEST_LIGHT).groupBy("n").count().collect()}
    lists = lambda n: 2 * int(sim.counted(n))
    cost = lambda b: sum(c * ((n <= b) * n_subsets(n, sim) + in_lists(n, sim, b) * lists(n)) for n, c in rows.items())
    return min(range(LONGEST_LIGHT + 1), key=lambda b: (cost(b), -b))


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Fewer rows to an Arrow batch while jobs over packed rows (tens of kilobytes each) are planned and run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_batches(batches: Iterator[pa.RecordBatch], docs: int = BATCH_DOCS, most: int = BATCH_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts in batches of bounded size."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc, text in zip(batch.column("doc_id"), batch.column("text")):
            own = (text.as_py() or "").encode()
            if ids and (len(ids) == docs or size + len(own) > most):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc.as_py())
            texts.append(own)
            size += len(own)
        if ids:
            yield ids, texts


MADE = "kind int, doc_id long, n int, d1 long, d2 long, batch long, bin int, at int, classes binary, owners binary, fresh binary, data binary"
MADE_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("batch", pa.int64()), ("bin", pa.int32()), ("at", pa.int32()), ("classes", pa.binary()), ("owners", pa.binary()), ("fresh", pa.binary()), ("data", pa.binary())])
CLASS = np.dtype([("doc", "<i8"), ("n", "<i4"), ("d1", "<i8"), ("d2", "<i8")])
#: A shared shingle of a batch: its place among the batch's sorted shingles, its number, its frequency's logarithm.
SHARED = np.dtype([("at", "<i4"), ("key", "<u8"), ("seen", "u1")])


def _set_numbers(h: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets and two digests of each."""
    n, sums = np.bincount(d, minlength=n_docs), []
    ends = np.cumsum(n)
    for seed in (77, 7919):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + U(seed)), dtype=np.uint64)))
        sums.append((total[ends] - total[ends - n]).view(np.int64))
    return n, *sums


def counted_shingles(docs: DataFrame, sim: Similarity, light: int, bins: int) -> DataFrame:
    """One pass over the texts: a row for each document (kind 0), each batch (1) and each batch's shingles of a bin (2).

    Equal sets of a batch are one class. The batch keeps which classes have which of its sorted shingles; only the
    shingles themselves travel, each once a batch, so one in a third of all documents is pre-aggregated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = itertools.count(), TaskContext.get().partitionId()

        def made(rows: int, /, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in MADE_SCHEMA], schema=MADE_SCHEMA)

        for ids, texts in text_batches(batches):
            h, d = batch_shingles(texts, sim.words)
            n, d1, d2 = _set_numbers(h, d, len(ids))
            yield made(len(ids), kind=[0] * len(ids), doc_id=ids, n=n.astype(np.int32), d1=d1, d2=d2)
            first: dict[tuple, int] = {}
            for i, key in enumerate(zip(n.tolist(), d1.tolist(), d2.tolist())):
                if key[0] and ids[i] is not None and (key not in first or ids[i] < ids[first[key]]):
                    first[key] = i
            if not first:
                continue
            chosen = np.array(sorted(first.values()))
            number_of = np.full(len(ids), -1)
            number_of[chosen] = np.arange(len(chosen))
            classes = np.empty(len(chosen), CLASS)
            classes["doc"], classes["n"], classes["d1"], classes["d2"] = [ids[i] for i in chosen], n[chosen], d1[chosen], d2[chosen]
            begin = np.cumsum(n) - n
            listed = np.array([in_lists(x, sim, light) for x in range(light + 2)])[np.minimum(n, light + 1)] & (number_of >= 0)
            taken = (np.arange(len(h)) - begin[d] < sim.counted(n)[d]) & listed[d]
            keys, owners = [h[taken]], [2 * number_of[d[taken]]]
            for i in chosen[n[chosen] <= light]:
                keys.append(subset_keys(h[begin[i] : begin[i] + n[i]], sim))
                owners.append(np.full(len(keys[-1]), 2 * number_of[i] + 1))
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key)
            key, owner = key[order], owner[order]
            fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
            distinct, count = key[fresh], np.diff(np.append(np.flatnonzero(fresh), len(key)))
            here = np.empty(int((count > 1).sum()), SHARED)
            here["at"], here["key"], here["seen"] = np.flatnonzero(count > 1), distinct[count > 1], 0
            batch = task << 32 | next(number)
            yield made(1, kind=[1], batch=[batch], at=[len(distinct)], classes=[classes.tobytes()], owners=[owner.astype(np.uint16).tobytes()], fresh=[np.packbits(fresh).tobytes()], data=[here.tobytes()])
            bin_of = ((distinct >> U(40)) * U(bins) >> U(24)).astype(np.int64)  # keys are sorted, so bins are too
            cuts = np.append(np.flatnonzero(np.diff(bin_of, prepend=-1)), len(distinct)).tolist()
            spans = list(itertools.pairwise(cuts))
            yield made(len(spans), kind=[2] * len(spans), batch=[batch] * len(spans), bin=bin_of[cuts[:-1]].astype(np.int32), at=np.array(cuts[:-1], np.int32), data=[distinct[a:b].tobytes() for a, b in spans])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MADE)


def shared_shingles(made: DataFrame) -> DataFrame:
    """``batch, kind, data``: for each batch those of its shingles that other batches have too (SHARED records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []

        def replies() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            sizes = np.array([len(keys) for _, _, keys in rows])
            key = np.concatenate([keys for _, _, keys in rows])
            order = np.argsort(key)
            run_of = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
            seen = np.empty(len(key), np.int64)
            seen[order] = np.bincount(run_of)[run_of]
            level = np.minimum(255, 8 * np.log2(seen) + 1).astype(np.uint8)
            out, ends = [], np.cumsum(sizes)
            for (batch, at, keys), end in zip(rows, ends.tolist()):
                own = slice(end - len(keys), end)
                hit = np.flatnonzero(seen[own] > 1)
                if len(hit):
                    reply = np.empty(len(hit), SHARED)
                    reply["at"], reply["key"], reply["seen"] = at + hit, keys[hit], level[own][hit]
                    out.append((batch, reply.tobytes()))
            for part in itertools.batched(out, 256):
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int64()), pa.array([r for _, r in part], pa.binary())], ["batch", "data"])

        for group in batches:
            for number, batch, at, data in zip(group.column("bin").to_numpy(), group.column("batch").to_numpy(), group.column("at").to_numpy(), group.column("data")):
                if number != current:
                    yield from replies()
                    current, rows = number, []
                rows.append((int(batch), int(at), np.frombuffer(data.as_buffer(), "<u8").copy()))
        yield from replies()

    return made.where("kind = 2").select("bin", "batch", "at", "data").repartition("bin").sortWithinPartitions("bin").mapInArrow(run, "batch long, data binary")


def list_entries(made: DataFrame, shared: DataFrame, sim: Similarity) -> DataFrame:
    """``doc_id, n, d1, d2, keys``: the lists that a class of equal sets stands in, for classes that can have a partner."""

    def entries(own: dict, replies: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(own["classes"], CLASS)
        owner = np.frombuffer(own["owners"], np.uint16).astype(np.int64)
        run_of = np.cumsum(np.unpackbits(np.frombuffer(own["fresh"], np.uint8), count=len(owner))) - 1
        key, seen = np.zeros(own["at"], np.uint64), np.full(own["at"], -1)
        for r in (np.frombuffer(own["data"], SHARED), *replies):
            key[r["at"]], seen[r["at"]] = r["key"], r["seen"]
        hit = seen[run_of] >= 0
        owner, k, seen = owner[hit], key[run_of[hit]], seen[run_of[hit]]
        small = owner & 1 == 1
        large = ~small
        number = owner[large] >> 1
        n = classes["n"].astype(np.int64)
        prefix = np.bincount(number, minlength=len(n)) - sim.common(sim.least(n)) + 1  # lists of each; none if not above 0
        order = np.lexsort((k[large], seen[large], number))
        number, listed = number[order], k[large][order]
        rank = np.arange(len(number)) - np.searchsorted(number, number)
        keep = rank < prefix[number]
        who, what = np.concatenate([number[keep], owner[small] >> 1]), np.concatenate([listed[keep], k[small]])
        order = np.argsort(who, kind="stable")
        who, what = who[order], what[order].view(np.int64)
        ids, starts = np.unique(who, return_index=True)
        if len(ids):
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(who)).astype(np.int32)), pa.array(what))
            yield pa.RecordBatch.from_arrays([pa.array(classes["doc"][ids]), pa.array(classes["n"][ids]), pa.array(classes["d1"][ids]), pa.array(classes["d2"][ids]), lists], ["doc_id", "n", "d1", "d2", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, replies = None, []
        for group in batches:
            for i in range(len(group)):
                data = group.column("data")[i].as_buffer()
                if group.column("kind")[i].as_py() == 1:
                    if own is not None:
                        yield from entries(own, replies)
                    own, replies = {c: group.column(c)[i].as_py() for c in ("at", "classes", "owners", "fresh", "data")}, []
                else:
                    replies.append(np.frombuffer(data, SHARED).copy())
        if own is not None:
            yield from entries(own, replies)

    columns = ["batch", "kind", "at", "classes", "owners", "fresh", "data"]
    answers = shared.select("batch", F.lit(2).alias("kind"), F.lit(0).alias("at"), *[F.lit(None).cast("binary").alias(c) for c in columns[3:6]], "data")
    dealt = made.where("kind = 1").select(columns).unionByName(answers).repartition("batch").sortWithinPartitions("batch", "kind")
    return dealt.mapInArrow(run, "doc_id long, n int, d1 long, d2 long, keys array<long>")


def groups_of(entries: DataFrame) -> DataFrame:
    """``leader, doc_id, votes``: each list's members beside its leader, the member with the smallest hashed id.

    Sets that link share a list and so a leader; near copies share many lists but few leaders. ``votes`` counts the lists
    that the two share under that leader. The leader is a member itself. Long lists meet their leader where they are.
    """
    lists = cut(entries.select("doc_id", F.explode("keys").alias("key")), "lists")
    leader = F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id"))["doc_id"].alias("leader")
    per_list = cut(lists.groupBy("key").agg(F.count("*").alias("m"), leader).where("m > 1"), "leaders")
    named = attach(lists, per_list, ["key"], "m", lists.count()).where("leader is not null")
    return named.groupBy("leader", "doc_id").agg(F.count("*").alias("votes"))


def sets_of(docs: DataFrame, ids: DataFrame, sim: Similarity) -> DataFrame:
    """``doc_id, n, sketch, items`` (packed shingle numbers) of the documents with the given ids, one row for each distinct set."""
    wanted = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    own = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            h, d = batch_shingles(texts, sim.words)
            ends = np.cumsum(np.bincount(d, minlength=len(ids)))
            rows = {(doc, part.tobytes()): sketch(part) for doc, part in zip(ids, np.split(h, ends[:-1]))}
            yield pa.RecordBatch.from_arrays([pa.array([doc for doc, _ in rows], pa.int64()), pa.array([len(items) // 8 for _, items in rows], pa.int32()), pa.array(list(rows.values()), pa.binary()), pa.array([items for _, items in rows], pa.binary())], ["doc_id", "n", "sketch", "items"])

    found = own.mapInArrow(run, "doc_id long, n int, sketch binary, items binary")
    return found.groupBy("doc_id", "n", "sketch", F.xxhash64("items").alias("digest")).agg(F.first("items").alias("items")).drop("digest")


def verified(pairs: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs ``a, b`` of linked sets, by the sets themselves; a document in very many pairs is a skewed key that adaptive execution splits."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(sim.den * both >= sim.num * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    side = lambda s: sets.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("items").alias(f"items_{s}"))
    known = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    fits = sim.den * F.least("n_a", "n_b").cast("long") >= sim.num * F.greatest("n_a", "n_b").cast("long")
    return known.where(fits).select("a", "b", "items_a", "items_b").mapInArrow(check, "a long, b long").distinct()


def cross_pairs(groups: DataFrame, component: DataFrame, sets: DataFrame, sim: Similarity, closest: bool) -> DataFrame:
    """Pairs of different components in one leader's group whose sizes and sketches allow a link.

    ``closest``: for each component in a group only its pair with the most similar sketches.

    A group of one component is done. In the others the largest component's members are not compared with one another, so
    the work is that of the rest against all; blocks of both are dealt out as tasks of bounded size.
    """
    named = groups.select("leader", "doc_id").join(component.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = cut(named, "members")
    n_rows = named.count()
    per_part = named.groupBy("leader", "component").agg(F.count("*").alias("m"))
    mixed = per_part.groupBy("leader").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    mixed = mixed.select("leader", F.col("top.component").alias("main"), F.ceil(F.col("top.m") / MAIN_BLOCK).cast("int").alias("n_main"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int").alias("n_rest"), "all")
    rows = attach(named, cut(mixed, "mixed"), ["leader"], "all", n_rows).where("main is not null")  # a large group is split over tasks
    inside = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("doc_id"), F.when(inside, F.col("n_main")).otherwise(F.col("n_rest"))).cast("int")
    rest, main = F.sequence(F.lit(0), F.col("n_rest") - 1), F.sequence(F.lit(0), F.col("n_main") - 1)
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    cells = F.when(inside, F.transform(rest, lambda i: cell(i, -1 - F.col("own")))).otherwise(
        F.concat(F.transform(main, lambda c: cell(F.col("own"), -1 - c)), F.transform(rest, lambda o: cell(F.least(F.col("own"), o), F.greatest(F.col("own"), o))))
    )
    placed = rows.withColumn("own", own).withColumn("side", F.when(inside, -1 - F.col("own")).otherwise(F.col("own"))).withColumn("p", F.explode(cells))
    dealt = placed.select("leader", "p.i", "p.j", "side", "doc_id", "component").join(sets.select("doc_id", "n", "sketch"), "doc_id")

    def compare(g: pa.RecordBatch) -> np.ndarray:
        i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
        side, doc, comp, size = (g.column(c).to_numpy() for c in ("side", "doc_id", "component", "n"))
        bits = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint64).reshape(len(g), -1)
        left, right, found, size = np.flatnonzero(side == i), np.flatnonzero(side == j), [], size.astype(np.int64)
        for one, other in [(left, right)] if i == j or j < 0 or not closest else [(left, right), (right, left)]:
            for at in range(0, len(one), 64):
                x, y = one[at : at + 64, None], other[None, :]
                total = size[x] + size[y]
                fits = (comp[x] != comp[y]) & (sim.den * np.minimum(size[x], size[y]) >= sim.num * np.maximum(size[x], size[y]))
                if not fits.any():
                    continue
                apart = np.bitwise_count(bits[x[:, 0]][:, None, :] ^ bits[other][None, :, :]).sum(axis=2, dtype=np.int64)
                fits &= apart <= total - 2 * -(-sim.num * total // (sim.num + sim.den))
                if closest:
                    apart[~fits] = 1 << 40
                    r = np.flatnonzero(fits.any(axis=1))
                    c = apart[r].argmin(axis=1)
                else:
                    r, c = np.nonzero(fits & (doc[x] < doc[y]) if i == j else fits)
                p, q = doc[one[at + r]], doc[other[c]]
                found.append(np.stack([np.minimum(p, q), np.maximum(p, q), comp[one[at + r]], apart[r, c]], axis=1))
        pairs = np.concatenate(found) if found else np.empty((0, 4), np.int64)
        if closest and len(pairs):
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0], pairs[:, 3], pairs[:, 2]))]
            pairs = pairs[np.concatenate(([True], pairs[1:, 2] != pairs[:-1, 2]))]
        return np.unique(pairs[:, :2], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            rows = rest if batch is None else batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if rows is None or not len(rows):
                continue
            key = np.stack([rows.column(k).to_numpy() for k in ("leader", "i", "j")])
            starts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(rows)]))
            if batch is not None:
                starts, rest = starts[:-1], rows.slice(starts[-2])
            found = [compare(rows.slice(a, b - a)) for a, b in itertools.pairwise(starts.tolist()) if b - a > 1]
            if found and len(pairs := np.concatenate(found)):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    return dealt.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(run, "a long, b long").distinct()


def same_id(named: DataFrame) -> DataFrame:
    """Links ``a, b`` between the classes that one id has rows in: its texts are one document."""
    several = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("doc_id", "a")
    return named.join(several, "doc_id").where("rep > a").select("a", F.col("rep").alias("b")).distinct()


def jaccard_components(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, n_shingles, component_id`` for every row; components of linked documents.

    1. One pass makes sets, digests and keys; equal sets are one class from here on. The keys (subsets of small sets,
       smallest shingles of large ones) are counted in bins, and each batch learns which of its keys occur elsewhere.
    2. Classes with enough of these stand in inverted lists, the rarest shingles first. A list's members form a group
       around its leader, and a document is compared with the leader that it shares most lists with.
    3. In groups with several components left, each component's pair with the most similar sketches is compared.
    4. Where members of a group are still of different components, all such pairs are compared, by sketch and then by
       their sets. What is left uncompared lies inside a component, so no link between components is lost.

    Pairs are never all emitted within a group. Null or blank texts have no shingles and link with nothing; a repeated
    id keeps a row for each given and is one document, which links by any of its texts; a null id links with
    nothing and gets a null component; an empty table gives none; other columns are not looked at.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    source = docs.select("doc_id", "text")
    volume = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins = max(48, volume // BIN_BYTES)
    path, answers = new_path(spark, "counted"), new_path(spark, "shared")
    with small_batches(spark, 1000):
        counted_shingles(source, sim, light_boundary(source, sim), int(bins)).write.parquet(path)
    made = spark.read.schema(MADE).parquet(path)
    with small_batches(spark, 256):
        shared_shingles(made).write.parquet(answers)
        entries = cut(list_entries(made, spark.read.schema("batch long, data binary").parquet(answers), sim), "entries")
    rows = cut(made.where("kind = 0").select("doc_id", "n", "d1", "d2"), "rows")
    remove(spark, path)
    remove(spark, answers)
    n_rows = rows.count()
    class_table = cut(rows.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    named = cut(attach(rows, class_table, ["n", "d1", "d2"], "rows", n_rows).select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "named")
    first = entries.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.min_by("keys", "doc_id").alias("keys"))
    groups = cut(groups_of(first.select("doc_id", "keys")), "groups")
    sets = cut(sets_of(source, groups.select("doc_id").distinct(), sim), "sets")
    best = groups.where("leader <> doc_id").groupBy(F.col("doc_id").alias("a")).agg(F.max_by("leader", F.struct("votes", F.xxhash64("leader"))).alias("b"))
    with small_batches(spark, 500):
        links = cut(verified(best, sets, sim).unionByName(same_id(named)), "links")
        component = connected_components(links)
        for closest in (True, False):
            apart = cut(cross_pairs(groups, component, sets, sim, closest), "apart")
            more = cut(verified(apart, sets, sim), "links")
            if more.take(1):
                links = links.unionByName(more)
                component = connected_components(links)
    lookup = class_table.join(component.select(F.col("node").alias("rep"), F.col("component").alias("component_id")), "rep").select("rep", "component_id", "rows")
    found = attach(named, cut(lookup, "components"), ["rep"], "rows", n_rows)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))


def keep_one(docs: DataFrame, sim: Similarity) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id.

    Of a repeated id one row stays (any of them, if they are of one component); rows without an id all stay, as do
    those without words unless their id is repeated. All columns stay.
    """
    component = jaccard_components(docs, sim)
    dropped = component.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti")
    repeated = component.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles at a similarity of 0.85 over all of ``documents``; cases as in ``jaccard_components``."""
    return jaccard_components(table(spark, sf_dir, "documents"))
