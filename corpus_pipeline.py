"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep docs' columns as they are, columns
beside those of the documents table among them, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskbook.llm import decontaminate, ngramjoin, pieces, pii, toxicity
from deskbook.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores below the threshold; it learns from the labels of all documents.

    Null and empty texts stay, repeated rows go or stay together, null ids are scored like any other; without labels of
    both kinds nothing is toxic.
    """
    model = toxicity.fit(toxicity.labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    own = {c: f"{c}_kept_" for c in docs.columns if c in ("toxic_score", "offending")}
    kept = toxicity.score_documents(docs.withColumnsRenamed(own), model).where(F.col("toxic_score") < toxicity.THRESHOLD)
    return kept.drop("toxic_score", "offending").withColumnsRenamed({v: k for k, v in own.items()})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of five-word shingle sets of similarity 0.8 or more.

    Texts without words are near nothing and stay, as do rows without an id; of a repeated id one row stays.
    """
    return ngramjoin.keep_one(docs, ngramjoin.Similarity(words=5, num=80, den=100))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents (a twentieth of the words or more), and without benchmark windows in the others.

    ``n_chars`` follows the text. Null and empty texts stay as they are; repeated rows are judged alike; an empty benchmark
    contaminates nothing.
    """
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def drop_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by placeholders, words that disclose it generalised or removed; all documents stay.

    ``n_chars`` follows the text. Null texts stay null; repeated rows are cleaned alike and count as rows of the corpus.
    """
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: ids of every remaining text and the text that they decode to.

    Null and empty texts have no ids and decode to the empty text; a row for each row; other columns are left behind.
    """
    encoded = pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", drop_personal_data),
    ("sentencepiece", encode),
]

#: Model scores, suffix automata and merge encodings have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the documents table, each stage's result written to the shared folder before the next reads it.

    Cases as in the stages; the result's columns are those of the last one.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
