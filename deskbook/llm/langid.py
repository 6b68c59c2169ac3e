"""Language identification with a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes that fill a matrix, so one step of the recurrence serves thousands of windows. Each
position gets class probabilities from both directions' states; a document's probabilities are the mean over all its
positions. The network is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_held_out, cut, lean_batches, table

HIDDEN = 8
#: Bytes of a window; byte 256 fills windows up and leaves the state as it is.
WINDOW, PAD = 128, 256
#: Windows that run beside one another.
LANES = 2048
#: Bounds of the labelled sample, within a fifth: documents a language (whole texts), and windows of LEARNT bytes a language
#: of all that these texts consist of.
SAMPLE_PER_LANGUAGE, SAMPLE_WINDOWS, LEARNT = 400, 4000, 96
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Both directions' tables of byte inputs and recurrent weights (gates z and r, candidate n), and the read-out."""

    languages: list[str]
    table_zr: np.ndarray  # 2 x 257 x 2H
    table_n: np.ndarray  # 2 x 257 x H
    u_zr: np.ndarray  # 2 x H x 2H
    u_n: np.ndarray  # 2 x H x H
    out: np.ndarray  # 2 x H x K
    bias: np.ndarray  # K

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator) -> Network:
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        h, k = HIDDEN, len(languages)
        net = cls(languages, make(2, 257, 2 * h, scale=0.3), make(2, 257, h, scale=0.3), make(2, h, 2 * h, scale=0.3), make(2, h, h, scale=0.3), make(2, h, k, scale=0.3), np.zeros(k, np.float32))
        net.close_pad()
        return net

    def close_pad(self) -> None:
        """The filling byte keeps the state: its update gate is open for the old state alone."""
        self.table_zr[:, PAD, :HIDDEN], self.table_zr[:, PAD, HIDDEN:], self.table_n[:, PAD] = 40, 0, 0

    def weights(self) -> list[np.ndarray]:
        return [self.table_zr, self.table_n, self.u_zr, self.u_n, self.out, self.bias]

    def states(self, ids: np.ndarray, keep: bool = False):
        """States (steps, 2, lanes, H) of windows ``ids`` (lanes, steps); the second direction runs from the end."""
        lanes, steps = ids.shape
        both = np.stack([ids.T, ids.T[::-1]], axis=1)  # steps, 2, lanes
        flat = both + np.array([[[0], [257]]], both.dtype)
        tzr, tn = self.table_zr.reshape(514, -1), self.table_n.reshape(514, -1)
        h = np.zeros((2, lanes, HIDDEN), np.float32)
        all_h, kept = np.empty((steps, 2, lanes, HIDDEN), np.float32), []
        for t in range(steps):
            zr = tzr[flat[t]]
            zr += h @ self.u_zr
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            g = h @ self.u_n
            n = r * g
            n += tn[flat[t]]
            np.tanh(n, out=n)
            if keep:
                kept.append((h, z, r, g, n))
            h = n + z * (h - n)
            all_h[t] = h
        return all_h, both, kept

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Class probabilities (steps, lanes, K) of every position."""
        h, _, _ = self.states(ids)
        logits = h[:, 0] @ self.out[0]
        logits += h[::-1, 1] @ self.out[1]
        logits += self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of one batch: every position of a window is to have the window's label."""
        h, both, kept = self.states(ids, keep=True)
        real = (ids.T != PAD).astype(np.float32)
        logits = h[:, 0] @ self.out[0] + h[::-1, 1] @ self.out[1] + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        scale = real / max(1.0, real.sum())
        lanes = np.arange(len(y))
        loss = float(-(np.log(p[:, lanes, y] + 1e-9) * scale).sum())
        d = p
        d[:, lanes, y] -= 1
        d *= scale[..., None]
        g_out = np.stack([np.einsum("tbh,tbk->hk", h[:, 0], d), np.einsum("tbh,tbk->hk", h[::-1, 1], d)])
        into = np.stack([d @ self.out[0].T, (d @ self.out[1].T)[::-1]], axis=1)  # gradients of all_h
        g_tzr, g_tn, g_uzr, g_un = (np.zeros_like(w) for w in self.weights()[:4])
        back = np.zeros_like(h[0])
        for t in range(len(kept) - 1, -1, -1):
            before, z, r, g, n = kept[t]
            dh = into[t] + back
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * g * r * (1 - r)
            dzr, dg = np.concatenate([dz, dr], axis=2), dn * r
            back = dh * z + dzr @ self.u_zr.transpose(0, 2, 1) + dg @ self.u_n.transpose(0, 2, 1)
            g_uzr += before.transpose(0, 2, 1) @ dzr
            g_un += before.transpose(0, 2, 1) @ dg
            for side in (0, 1):
                np.add.at(g_tzr[side], both[t, side], dzr[side])
                np.add.at(g_tn[side], both[t, side], dn[side])
        return loss, [g_tzr, g_tn, g_uzr, g_un, g_out, d.sum(axis=(0, 1))]


def train(snippets: list[bytes], labels: list[str], steps: int = 260, batch: int = 128, length: int = 48, rate: float = 0.03, seed: int = 7) -> Network | None:
    """Fit a network by Adam on pieces at random places of the labelled windows; None without any."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng, y_all = np.random.default_rng(seed), np.array([languages.index(x) for x in labels])
    by_class = [np.flatnonzero(y_all == k) for k in range(len(languages))]
    net = Network.new(languages, rng)
    m, v = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        y = rng.integers(len(languages), size=batch)
        ids = np.full((batch, length), PAD, np.int64)
        for lane, k in enumerate(y):
            text = snippets[rng.choice(by_class[k])]
            at = rng.integers(max(1, len(text) - length + 1))
            part = text[at : at + length]
            ids[lane, : len(part)] = np.frombuffer(part, np.uint8)
        _, grads = net.gradients(ids, y)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(net.weights(), grads, m, v):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        net.close_pad()
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean class probabilities over all positions of each text (rows of zeros for empty texts)."""
    sums, windows, owner = np.zeros((len(texts), len(net.languages))), [], []

    def flush() -> None:
        if windows:
            ids = np.stack(windows)
            p = net.probabilities(ids)
            p *= (ids.T != PAD)[..., None]
            np.add.at(sums, np.asarray(owner), p.sum(axis=0))
            windows.clear()
            owner.clear()

    for i, text in enumerate(texts):
        ids = np.frombuffer(text, np.uint8).astype(np.int16)
        rest = -len(ids) % WINDOW
        for row in np.concatenate([ids, np.full(rest, PAD, np.int16)]).reshape(-1, WINDOW):
            windows.append(row)
            owner.append(i)
            if len(windows) == LANES:
                flush()
    flush()
    return sums / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def about(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """About 1.2 * k rows of each key, all where there are no more: those whose hash ``order`` lies below the share that k is
    of the key's rows. Rows are to be distinct. They stay where they are; only the keys' counts (of languages) travel."""
    counts = F.broadcast(df.groupBy(key).agg(F.count("*").alias("of_")))  # a row a language
    place = F.shiftrightunsigned(F.col(order), 1) / F.lit(float(1 << 63))
    return df.join(counts, key).where(place * F.col("of_") < 1.2 * k).drop("of_")


def labelled_windows(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, windows: int = SAMPLE_WINDOWS) -> tuple[list[bytes], list[str]]:
    """Windows of bytes with a letter, and their languages, of a bounded sample of documents of each known language.

    Documents are taken by hashed id and cut up whole; of their distinct windows a sample is taken by hash. Ids or languages that are
    null, and texts that are null or empty, are not learnt from.
    """
    own = docs.where("lang is not null and doc_id is not null and text is not null and text <> ''").where(~crc_held_out())
    picked = about(own.select("lang", "doc_id").distinct().withColumn("h", F.xxhash64("doc_id")), "lang", "h", per_language).select("lang", "doc_id")
    texts = docs.select("lang", "doc_id", "text").join(F.broadcast(picked), ["lang", "doc_id"])  # about 1.2 * per_language ids of each language

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                raw = text.as_py().encode()
                for at in range(0, len(raw), LEARNT << 10):
                    parts = [raw[i : i + LEARNT] for i in range(at, min(len(raw), at + (LEARNT << 10)), LEARNT)]
                    kept = [p for p in parts if LETTER.search(p.decode("utf-8", "ignore"))]
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(kept), pa.string()), pa.array(kept, pa.binary())], ["lang", "part"])

    parts = cut(texts.select("lang", "text").mapInArrow(cut_up, "lang string, part binary").distinct().withColumn("h", F.xxhash64("part")), "windows")
    rows = sorted(about(parts, "lang", "h", windows).collect(), key=lambda r: (r.lang, r.h, bytes(r.part)))
    return [bytes(r.part) for r in rows], [r.lang for r in rows]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, lang_pred, score, probabilities`` for whole texts.

    Row-local, no shuffle. ``und`` (score 0) where the text is null or has no letter (of any script; digits, fractions and
    numerals are none), or where nothing could be learnt; else the language with the highest mean probability over the
    text's bytes and that mean. Repeated rows are judged alike, extra columns dropped, an empty table gives no rows.
    """
    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights
    chances = pa.map_(pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = [t if t and net and LETTER.search(t) else "" for t in batch.column("text").to_pylist()]
            known = [i for i, t in enumerate(texts) if t]
            pred, score, each = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if known:
                for i, row in zip(known, pooled(net, [texts[i].encode() for i in known])):
                    best = int(row.argmax())
                    pred[i], score[i] = net.languages[best], min(1.0, float(row[best]))
                    each[i] = list(zip(net.languages, map(float, row)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(each, chances)], ["doc_id", "lang_pred", "score", "probabilities"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, probabilities map<string,double>")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all of ``documents`` by a network that learns from those not held out; cases as in ``identify``."""
    docs = table(spark, sf_dir, "documents")
    net = train(*labelled_windows(docs))
    return identify(docs, net).select("doc_id", crc_held_out().alias("held_out"), "lang_pred", "score")
