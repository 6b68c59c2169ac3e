"""Secret scan: patterns, and a linear-chain conditional random field that tags tokens as begin, inside or outside.

Runs of characters without blanks are cut into tokens; a token's features are its shape, the words and signs before and
after it, and figures of its whole text. Tags are decoded by Viterbi. Tags that cannot be right are ruled out in training
and decoding alike: a secret begins at a token with a digit or of sixteen letters, and goes on without a blank. Runs
without such a token are outside, so only the others are decoded, and the chain is exact across them.

The field learns from what the patterns find in a bounded sample of rows, every second time with the words around hidden,
so that it also knows secrets that no pattern names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import cut, lean_batches, table

# The patterns of the contract, in the order in which kinds are listed; the fitted kind comes last.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "field")
#: Parts of words beside secrets.
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "sign", "bearer")

RUN = re.compile(r"\S+")
ODD = re.compile("[0-9]|[A-Za-z]{16}")
TOKEN = re.compile(r"[^\W_]+|[^\s]")
WORD = re.compile(r"[^\W\d_]+")
#: Characters before and after a run that count as beside it.
BESIDE = 64
OUT, BEGIN, INSIDE = range(3)
NEVER = -1e9
#: Bounds of the sample that the field is fitted on: rows with and without what looks like a secret, whole texts, and runs.
SAMPLE_WITH, SAMPLE_WITHOUT, SAMPLE_RUNS = 1000, 1000, 20_000
#: Tokens of a run that training sees at once; longer runs are cut there.
LONGEST = 48
#: Native filter of rows that may hold a match of a pattern.
LIKELY = r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}|(?i:password|passwd|secret|token|api_?key)"


def odd_runs(text: str) -> list[tuple[int, int, int]]:
    """``(number, start, end)`` of the runs that have a digit or sixteen letters on end."""
    if not ODD.search(text):
        return []
    return [(i, m.start(), m.end()) for i, m in enumerate(RUN.finditer(text)) if ODD.search(m[0])]


def base_spans(text: str, runs: list[tuple[int, int, int]] | None = None) -> tuple[list, list]:
    """``(spans, values)``: pattern spans ``(start, kind, end)`` in order, and ``(start, end)`` of the secrets in them.

    Leftmost matches that don't overlap, per kind; those that fail the kind's test are dropped and not tried again. Runs
    of hexadecimal digits long enough lie in ``odd_runs``.
    """
    spans, values = [], []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                spans.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                spans.append((m.start(), 1, m.end()))
                values.append(m.span())
    for _, a, b in odd_runs(text) if runs is None else runs:
        if b - a >= 32:
            for m in HEX.finditer(text, a, b):
                if m.end() - m.start() >= 32:
                    spans.append((m.start(), 2, m.end()))
                    values.append(m.span())
    return sorted(spans), values


def figures(text: str) -> list[str]:
    """Features of the whole text: share of digits and of signs of assignment, lines, length."""
    size = max(1, len(text))
    digits = sum(map(text.count, "0123456789"))
    signs = text.count("=") + text.count(":")
    out = [f"text:digits>{t}" for t in (0.005, 0.02, 0.1) if digits > t * size]
    out += [f"text:signs>{t}" for t in (0.0005, 0.005) if signs > t * size]
    return out + [f"text:lines>{t}" for t in (10, 100) if text.count("\n") > t] + [f"text:size>{t}" for t in (300, 3000) if size > t]


def shape(token: str) -> list[str]:
    """Features of a token by itself: class of characters, length, distinct characters, changes between letter and digit."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return [f"sign:{token}"]
    digits = sum(c.isdigit() for c in token)
    low, up = token.lower() == token, token.upper() == token
    hexes = all(c in "0123456789abcdef" for c in token) or all(c in "0123456789ABCDEF" for c in token)
    kind = "digits" if digits == n else ("mixed" if not low and not up else "upper" if up else "lower") + ("+digits" if digits else "")
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    out = [f"kind:{kind}", "hex"] if hexes and 0 < digits < n else [f"kind:{kind}"]
    letters = digits < n
    out += [f"long:{t}:{letters}" for t in (4, 8, 12, 16, 20, 24, 32, 48) if n >= t]
    out += [f"changes:{t}" for t in (1, 2, 4, 8, 12) if changes >= t]
    return out + [f"distinct:{t}" for t in (4, 8, 10, 14, 20) if len(set(token)) >= t]


def around(text: str, start: int, end: int) -> list[str]:
    """Features of what stands before and after a run in its line: two words, signs between, hints."""
    before = text[max(0, start - BESIDE) : start].rpartition("\n")[2]
    after = text[end : end + BESIDE].partition("\n")[0]
    words = [w.lower() for w in WORD.findall(before)[-2:]]
    signs = re.sub(r"[\w\s]", "", before[-6:])
    out = [f"before:{w}" for w in words[-1:]] + [f"earlier:{w}" for w in words[:-1]] + [f"after:{w.lower()}" for w in WORD.findall(after)[:1]]
    out += [f"beside:{h}" for h in HINTS if any(h in w for w in words)][:2]
    return out + ([f"signs:{signs[-2:]}"] if signs else []) + ([] if before.strip() else ["line start"])


def sequence(text: str, start: int, end: int, whole: list[str]) -> tuple[list[tuple[int, int]], list[list[str]], list[str], list[tuple[bool, bool]]]:
    """A run's tokens ``(start, end)``, their own features, those of the run's surroundings, and which may be begin and inside."""
    places = [m.span() for m in TOKEN.finditer(text, start, end)]
    tokens = [text[a:b] for a, b in places]
    own = []
    for i, token in enumerate(tokens):
        features = shape(token)
        features.append(f"left:{tokens[i - 1] if not tokens[i - 1].isalnum() else 'word'}" if i else "first")
        features.append(f"right:{tokens[i + 1] if not tokens[i + 1].isalnum() else 'word'}" if i + 1 < len(tokens) else "last")
        if i > 1 and tokens[i - 2].isalpha():
            features.append(f"two left:{tokens[i - 2].lower()}")
        own.append(features)
    beside = around(text, start, end) + whole
    return places, own, beside, [(bool(ODD.search(t)), i > 0) for i, t in enumerate(tokens)]


@dataclass
class Field:
    """Weights ``(begin, inside)`` by feature, outside weighing nothing, and the transitions ``[from][to]``."""

    weights: dict[str, tuple[float, float]]
    moves: list[list[float]]

    def emissions(self, own: list[list[str]], beside: list[str], allowed: list[tuple[bool, bool]]) -> list[tuple[float, float, float]]:
        get, none = self.weights.get, (0.0, 0.0)
        shared = [get(f"* {f}", none) for f in beside]
        base = sum(w[0] for w in shared), sum(w[1] for w in shared)
        out = []
        for features, (begin, inside) in zip(own, allowed):
            found = [get(f, none) for f in features]
            out.append((0.0, base[0] + sum(w[0] for w in found) if begin else NEVER, base[1] + sum(w[1] for w in found) if inside else NEVER))
        return out

    def viterbi(self, emissions: list[tuple[float, float, float]]) -> list[int]:
        """Best tags of a chain that follows an outside token; of equal paths the one with the lower tags, from the end."""
        at, back = [0.0, NEVER, NEVER], []
        for e in emissions:
            best = [max((at[p] + self.moves[p][t], -p) for p in range(3)) for t in range(3)]
            back.append([-p for _, p in best])
            at = [score + own for (score, _), own in zip(best, e)]
        tags = [max(range(3), key=lambda t: (at[t], -t))]
        for came in reversed(back[1:]):
            tags.append(came[tags[-1]])
        return tags[::-1]

    def spans(self, text: str, runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """``(start, end)`` of the secrets of a text; runs that follow each other are one chain."""
        out, whole = [], figures(text) if runs else []
        places, emissions, last = [], [], None

        def close() -> None:
            for (a, b), tag in zip(places, self.viterbi(emissions) if emissions else ()):
                if tag == BEGIN:
                    out.append((a, b))
                elif tag == INSIDE:
                    out[-1] = (out[-1][0], b)

        for number, start, end in runs:
            if last is not None and number != last + 1:
                close()
                places, emissions = [], []
            last = number
            own_places, own, beside, allowed = sequence(text, start, end, whole)
            places += own_places
            emissions += self.emissions(own, beside, allowed)
        close()
        return out


def chains(text: str) -> Iterator[tuple[list[list[str]], list[str], list[int], list[tuple[bool, bool]]]]:
    """Training chains of a text, a run each: features of tokens and surroundings, tags, and what is allowed."""
    runs = odd_runs(text)
    if not runs:
        return
    values, whole = sorted(base_spans(text, runs)[1]), figures(text)
    at = 0
    for _, start, end in runs:
        while at < len(values) and values[at][1] <= start:
            at += 1
        near = []
        for v in values[at:]:
            if v[0] >= end:
                break
            near.append(v)
        places, own, beside, allowed = sequence(text, start, end, whole)
        tags = []
        for i, (a, b) in enumerate(places):
            hit = any(v[0] < b and a < v[1] for v in near)
            inside = hit and allowed[i][1] and tags[-1] != OUT
            tags.append(INSIDE if inside else BEGIN if hit and allowed[i][0] else OUT)
        for i in range(0, len(own), LONGEST):
            part = slice(i, i + LONGEST)
            if tags[i] != INSIDE:
                yield own[part], beside, tags[part], [(b, s and k > 0) for k, (b, s) in enumerate(allowed[part])]


def sample_rows(docs: DataFrame) -> DataFrame:
    """``text`` of a bounded sample: rows that may hold a pattern's match and rows that don't, in the order of hashed ids."""
    rows = docs.where("doc_id is not null and text is not null")
    likely, order = F.col("text").rlike(LIKELY), F.xxhash64(F.lit("secrets"), "doc_id")
    flagged = cut(rows.select("doc_id", likely.alias("likely")), "likely")
    ids = [flagged.where(F.col("likely") == y).select("doc_id").distinct().orderBy(order, "doc_id").limit(n) for y, n in ((True, SAMPLE_WITH), (False, SAMPLE_WITHOUT))]
    chosen = F.broadcast(ids[0].unionByName(ids[1]).distinct())  # SAMPLE_WITH + SAMPLE_WITHOUT ids at most
    return rows.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", "text")


def fit(docs: DataFrame) -> Field | None:
    """A field fitted to what the patterns find in the sample of ``docs`` (``doc_id, text``); None where they find nothing.

    Chains are made in Spark's tasks; a bounded number of them, those with secrets first, reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.string())), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.list_(pa.bool_())), pa.bool_()
        for batch in batches:
            for text in batch.column("text"):
                made = list(chains(text.as_py()))
                columns = [m[0] for m in made], [m[1] for m in made], [m[2] for m in made], [[list(a) for a in m[3]] for m in made], [any(m[2]) for m in made]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kind)], ["own", "beside", "tags", "allowed", "secret"])

    lean_batches(docs.sparkSession)
    made = cut(sample_rows(docs).mapInArrow(run, "own array<array<string>>, beside array<string>, tags array<byte>, allowed array<array<boolean>>, secret boolean"), "chains")
    order = F.xxhash64("own", "beside"), *(F.col(c).cast("string") for c in ("own", "beside", "tags", "allowed"))
    picked = [made.where(F.col("secret") == y).distinct().orderBy(*order).limit(SAMPLE_RUNS // 2).collect() for y in (True, False)]
    return train([(r.own, r.beside, list(r.tags), r.allowed) for part in picked for r in part]) if picked[0] else None


def train(data: list, steps: int = 150, rate: float = 0.2, decay: float = 2.0) -> Field:
    """Weights by full-batch Adam on the penalised conditional likelihood, forward-backward in numpy.

    Each chain counts twice, once without the features of its surroundings.
    """
    data = [(own, beside, tags, allowed) for own, real, tags, allowed in data for beside in (real, [])]
    names: dict[str, int] = {}
    number = lambda f: names.setdefault(f, len(names))
    longest, n = max(len(d[2]) for d in data), len(data)
    cells, features = [], []
    tags, size = np.zeros((n, longest), int), np.array([len(d[2]) for d in data])
    mask = np.full((n, longest, 3), NEVER)
    mask[:, :, OUT] = 0
    for c, (own, beside, tag, allowed) in enumerate(data):
        shared = [number(f"* {f}") for f in beside]
        for i, row in enumerate(own):
            ids = [number(f) for f in row] + shared
            cells += [c * longest + i] * len(ids)
            features += ids
            mask[c, i, BEGIN], mask[c, i, INSIDE] = 0 if allowed[i][0] else NEVER, 0 if allowed[i][1] else NEVER
        tags[c, : len(tag)] = tag
    cells, features = np.array(cells), np.array(features)
    there = np.arange(longest) < size[:, None]
    gold = np.zeros((n, longest, 3))
    gold[np.arange(n)[:, None], np.arange(longest), tags] = there
    came = np.concatenate([np.zeros((n, 1), int), tags[:, :-1]], axis=1)
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (came[there], tags[there]), 1)
    barred = np.zeros((3, 3))
    barred[OUT, INSIDE] = NEVER
    w, moves = np.zeros((len(names), 2)), np.zeros((3, 3))
    first, second = np.zeros(w.size + 9), np.zeros(w.size + 9)
    for step in range(1, steps + 1):
        e = np.zeros((n * longest, 3))
        for k in (0, 1):
            e[:, k + 1] = np.bincount(cells, w[features, k], n * longest)
        e = e.reshape(n, longest, 3) + mask
        t = moves + barred
        ahead = np.full((n, longest, 3), NEVER)
        at = np.full((n, 3), NEVER)
        at[:, OUT] = 0
        for i in range(longest):
            at = np.where(there[:, i, None], np.logaddexp.reduce(at[:, :, None] + t, axis=1) + e[:, i], at)
            ahead[:, i] = at
        total = np.logaddexp.reduce(at, axis=1)
        behind = np.zeros((n, 3))
        grad_e, grad_t = gold.copy(), gold_moves.copy()
        for i in range(longest - 1, -1, -1):
            now = there[:, i]
            grad_e[:, i] -= np.exp(ahead[:, i] + behind - total[:, None]) * now[:, None]
            before = ahead[:, i - 1] if i else np.where(np.arange(3) == OUT, 0.0, NEVER) * np.ones((n, 1))
            joint = before[:, :, None] + t + (e[:, i] + behind)[:, None, :]
            grad_t -= (np.exp(joint - total[:, None, None]) * now[:, None, None]).sum(axis=0)
            behind = np.where(now[:, None], np.logaddexp.reduce(t + (e[:, i] + behind)[:, None, :], axis=2), behind)
        flat = grad_e.reshape(-1, 3)
        grad_w = np.stack([np.bincount(features, flat[cells, k + 1], len(names)) for k in (0, 1)], axis=1) - decay * w
        grad = np.concatenate([grad_w.ravel(), (grad_t - decay * moves).ravel()])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w, moves = w + move[: w.size].reshape(w.shape), moves + move[w.size :].reshape(3, 3)
    kept = {f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items() if abs(w[i]).max() > 1e-3}
    return Field(kept, (moves + barred).tolist())


def scan(text: str, field: Field | None) -> tuple[list, list]:
    """``(base, spans)`` of a text, each ``(start, kind, end)`` in order; the field adds spans that touch no base span."""
    runs = odd_runs(text)
    base, _ = base_spans(text, runs)
    if field is None or not runs:
        return base, base
    taken, added = sorted((a, b) for a, _, b in base), []
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else ()
    for a, b in field.spans(text, runs):
        i = int(np.searchsorted([s for s, _ in taken], b)) if taken else 0  # base spans that start before b
        if not i or ends[i - 1] <= a:
            added.append((a, 3, b))
    return base, sorted(base + added)


SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def find_secrets(docs: DataFrame, field: Field | None) -> DataFrame:
    """All columns of ``docs`` with ``base`` and ``secrets``, arrays of ``{kind, start, end}`` (code points, end exclusive).

    ``base`` has the patterns' spans, ``secrets`` also the field's (kind ``field``), both by start, then kind as listed.
    Row-local, whole texts, only the text is read. Null and empty texts have none; repeated rows are scanned alike; null
    ids stay; an empty table gives no rows; columns of these two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # weights of a bounded sample
    lean_batches(docs.sparkSession)
    kept = docs.drop("base", "secrets")
    schema = StructType([*kept.schema.fields, StructField("base", ArrayType(SPAN)), StructField("secrets", ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py() or "", shared.value) for t in batch.column("text")]
            yield batch.append_column("base", pa.array([named(f[0]) for f in found], kind)).append_column("secrets", pa.array([named(f[1]) for f in found], kind))

    return kept.mapInArrow(run, schema)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, by a field fitted to a sample of them; cases as in ``find_secrets``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, fit(docs))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(written("base"), 256).alias("base_sha256"), written("secrets").alias("spans"), (F.size("secrets") - F.size("base")).cast("long").alias("n_added"))
