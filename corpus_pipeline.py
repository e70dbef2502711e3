"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents; what came before is freed.
All but the last keep the columns of documents; columns beyond them are carried
along, whatever their names.  Ids are whole numbers or null.  Every stage takes null,
empty and very long texts, rows that repeat and empty tables; what it does with them
its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import bpe, decontam, langid, minhash, secrets
from podium.llm.common import Scratch
from podium.llm.queries import tokenizer_path

_PREDICTED, _SCORE = "_predicted", "_score"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those without a language: null texts and texts without a letter.

    If none is labelled, nothing can be told and all go.  Repeated rows are judged each.
    """
    found = langid.predict(docs, langid.train(docs), "text", _PREDICTED, _SCORE)
    return found.where(F.col(_PREDICTED) != langid.UNKNOWN).drop(_PREDICTED, _SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group with 5-word shingles of similarity 0.8 or more.

    A null id is the smallest.  Of rows equal in id and text one stays; texts without words
    are like nothing, so they stay.
    """
    return minhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with an item of ``benchmark``; null, empty and wordless texts stay, repeated rows go together."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; ``n_chars`` is counted again where it is a column.  No row goes, null texts stay null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each text, with the decoded text's digest; a null or empty text has none.  One row per row."""
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return both.select("doc_id", "lang", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("encode", encode),
]

#: Naive Bayes, the novelty measure and BPE aren't SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop_others(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
