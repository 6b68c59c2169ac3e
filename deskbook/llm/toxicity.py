"""Toxicity by multiple-instance learning.

A document is a bag of sentences; the chance that it is toxic is the noisy-or of its sentences' chances, each a logistic
score of the words and word beginnings in the sentence. Only documents are labelled: the noisy-or's gradient sends a
document's label to the sentences that explain it, and afterwards the sentence scores locate the offending ones.
Sentences without informative words, and sentences that repeat others' informative words, add nothing to a document's
chance, so it does not grow with the document's length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import crc_held_out, cut, lean_batches, table

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]*[^.!?\n\s][^.!?\n]*[.!?]*")
#: Bound of the labelled sample that the model is fitted on: rows of each class, whole texts of any length.
SAMPLE_PER_CLASS = 2000
#: Words that a task remembers between clearings: bounds a worker's memory.
REMEMBERED = 150_000
THRESHOLD = 0.7
#: Similarity of two labelled texts' features from which one is a near copy of the other.
ALIKE = 0.8


def word_features(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings of four and five letters, which its inflections share."""
    return tuple({"=" + word, "^" + word[:4], "^" + word[:5]}) if len(word) >= 4 else ("=" + word,)


#: Log-odds of a sentence before its informative words count.
BIAS = -6.0


@dataclass
class BagModel:
    """Weights of the features, and the leak: the chance of a toxic label that no sentence explains."""

    weights: dict[str, float]
    leak: float
    bias: float = BIAS

    def scorer(self):
        """Function text -> (score, spans ``(start, end, chance)`` of sentences with a chance of a half or more)."""
        weights, known = self.weights, {}
        none = float(np.log1p(-self.leak))

        def of(word: str) -> tuple:
            found = known.get(word)
            if found is None:
                if len(known) > REMEMBERED:
                    known.clear()
                found = known[word] = tuple(f for f in word_features(word) if f in weights)
            return found

        def score(text: str) -> tuple[float, list[tuple[int, int, float]]]:
            if not any(map(of, set(WORD.findall(text.lower())))):
                return -np.expm1(none), []
            logits, spans = {}, []
            for m in SENTENCE.finditer(text):
                seen = frozenset(f for w in WORD.findall(m[0].lower()) for f in of(w))
                if not seen:
                    continue
                logit = logits.get(seen)
                if logit is None:
                    logit = logits[seen] = self.bias + sum(map(weights.__getitem__, sorted(seen)))
                if logit >= 0:
                    spans.append((m.start(), m.end(), float(1 / (1 + np.exp(-logit)))))
            return float(-np.expm1(none - np.logaddexp(0, np.fromiter(logits.values(), float)).sum())), spans

        return score


def document_features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``doc_id, toxic, text`` of a bounded sample of the labelled rows that may be learnt from, ``per_class`` of each class.

    Rows come in the order of their hashed ids, so any run takes the same. A document labelled twice counts as toxic if
    any label says so; of a repeated id the first text in order is taken; null texts and null ids are not.
    """
    own = labels.where("toxic in (0, 1) and doc_id is not null").where(~crc_held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = [own.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows at most
    return docs.where("text is not null").select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def bags_of(sample: DataFrame) -> DataFrame:
    """``doc_id, toxic, least, features`` of the sample; near copies mostly agree on ``least``, the smallest feature hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [sorted(document_features(t.as_py())) for t in batch.column("text")]
            least = [",".join(map(str, sorted({zlib.crc32(f.encode()) for f in own})[:3])) for own in features]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(least, pa.string()), pa.array(features, pa.list_(pa.string()))], ["doc_id", "toxic", "least", "features"])

    return sample.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(run, "doc_id long, toxic int, least string, features array<string>")


def distinct_bags(bags: DataFrame) -> DataFrame:
    """``doc_id`` of one of each set of near copies with one label, so that copies don't vouch for their words.

    Bags with the same least hashes are compared; one is left out if its features' Jaccard similarity with a kept one
    reaches ``ALIKE``. Texts that merely share common words all stay. A group is a part of the bounded sample.
    """

    def thin(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        chosen = []
        for doc, features in sorted(zip(group.doc_id, group.features), key=lambda g: g[0]):
            own = set(features)
            if not any(len(own & o) >= ALIKE * len(own | o) for o in kept):
                kept.append(own)
                chosen.append(doc)
        return pd.DataFrame({"doc_id": chosen})

    return bags.groupBy("toxic", "least").applyInPandas(thin, "doc_id long")


def informative_features(bags: DataFrame, least: float = 13.0) -> list[str]:
    """Features that are commoner in toxic documents than chance allows.

    ``least`` bounds the log-likelihood ratio of a feature's toxic share against the sample's, about a millionth by chance;
    each feature so needs several toxic documents of the bounded sample, which bounds their number.
    """
    total = bags.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    if not total.n or total.k in (None, 0, total.n):
        return []
    share = F.lit(total.k / total.n)
    counted = bags.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("k"), F.count("*").alias("n")).where("k > 0")
    q = F.col("k") / F.col("n")
    gain = F.col("n") * (q * F.log(q / share) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0))
    return [r.feature for r in counted.where((q > share) & (gain >= least)).orderBy("feature").select("feature").collect()]


def sentence_sets(sample: DataFrame, chosen: list[str]) -> DataFrame:
    """``doc_id, toxic, sets``: the distinct sets of informative features in each document's sentences, as numbers."""
    index = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(chosen)})  # the fitted features, see above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in batch.column("text"):
                found = {tuple(sorted(index.value[f] for f in document_features(s) if f in index.value)) for s in SENTENCE.findall(text.as_py())}
                sets.append(sorted(found - {()}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(sets, pa.list_(pa.list_(pa.int32())))], ["doc_id", "toxic", "sets"])

    return sample.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(run, "doc_id long, toxic int, sets array<array<int>>")


def fit_weights(sets: list[list[list[int]]], y: np.ndarray, n_features: int, epochs: int = 400, rate: float = 0.1, decay: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and leak of the noisy-or of sentence scores, by full-batch Adam on document labels."""
    doc = np.array([d for d, own in enumerate(sets) for _ in own], int)
    every = [s for own in sets for s in own]
    rows, cols = np.repeat(np.arange(len(every)), [len(s) for s in every]), np.array([c for s in every for c in s], int)
    w = np.concatenate([np.full(n_features, 4.0), [-3.0]])  # the last is the leak's log-odds
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        s = BIAS + np.bincount(rows, w[cols], len(every))
        p, leak = 1 / (1 + np.exp(-s)), 1 / (1 + np.exp(-w[-1]))
        log_none = np.log1p(-leak) + np.bincount(doc, -np.logaddexp(0, s), len(y))
        none = np.exp(np.minimum(log_none, -1e-9))
        pull = np.where(y > 0, -none / (1 - none), 1.0) / len(y)
        by_sentence = pull[doc] * p
        grad = np.concatenate([np.bincount(cols, by_sentence[rows], n_features) + decay * w[:-1] / len(y), [pull.sum() * leak]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], min(0.5, float(1 / (1 + np.exp(-w[-1]))))


def fit(sample: DataFrame) -> BagModel:
    """Fit a model to ``doc_id, toxic, text`` (see ``labelled_sample``); without both labels nothing is toxic.

    Texts are read in Spark's tasks; numbers of informative features in the sentences of the bounded sample reach the driver.
    """
    sample = cut(sample.select("doc_id", "toxic", "text"), "labelled")
    bags = cut(bags_of(sample), "bags")
    kept = cut(distinct_bags(bags), "kept")
    chosen = informative_features(bags.join(F.broadcast(kept), "doc_id"))
    if not chosen:
        return BagModel({}, 0.0)
    found = sorted(sentence_sets(sample.join(F.broadcast(kept), "doc_id"), chosen).collect(), key=lambda r: r.doc_id)
    w, leak = fit_weights([r.sets for r in found], np.array([r.toxic for r in found], float), len(chosen))
    return BagModel({f: float(x) for f, x in zip(chosen, w) if x > 1e-3}, leak, BIAS)


def score_documents(docs: DataFrame, model: BagModel) -> DataFrame:
    """All columns of ``docs`` with ``toxic_score`` and ``offending`` (array of ``{start, end, chance}``, code points).

    Row-local, whole texts, only the text is read. Null and empty texts score as any text without informative words does;
    repeated rows score alike; an empty table gives no rows; columns of these two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the fitted features' weights
    lean_batches(docs.sparkSession)
    kept = docs.drop("toxic_score", "offending")
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("chance", DoubleType())])
    schema = StructType([*kept.schema.fields, StructField("toxic_score", DoubleType()), StructField("offending", ArrayType(span))])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            made = [score(t.as_py() or "") for t in batch.column("text")]
            offending = [[{"start": a, "end": b, "chance": c} for a, b, c in m[1]] for m in made]
            yield batch.append_column("toxic_score", pa.array([m[0] for m in made], pa.float64())).append_column("offending", pa.array(offending, spans_type))

    return kept.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents`` by a model of ``labels``, held-out rows' labels left out; cases as in ``score_documents``."""
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels")))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", crc_held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))
