"""Token totals kept up by signed deltas.

A change says that a document came (``insert``), went (``delete``) or is counted
anew (``revise``, with the counts before and after).  ``deltas`` turns changes into
signed numbers and sums them by source, language and tokenizer version, before
the shuffle and after it, so a hot source costs one row per task.  ``Rollup``
stores each batch's sums under its batch id.  A batch is written aside and then
renamed, so it counts whole or not at all; sent again, say after a lost driver, it
changes nothing.  Totals are sums over batches, and ``compact`` folds batches into a
base that remembers their ids.  One driver at a time may write to a folder.

Versions of a tokenizer are any counts: ``count_tokens`` counts by a regular
expression, ``bpe_counts`` by the encoder of ``podium.llm.bpe``, whole texts however
long they are.

Null sources and languages are groups of their own; null counts and texts are 0.  A
group whose documents are all gone keeps no row.  An empty batch is a valid batch.
Rows that repeat an id are documents of their own; ``changes_between`` pairs equal
rows of an id by number.  Columns beyond those named are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.llm import bpe
from podium.llm.common import Scratch

KEYS = ("source", "lang", "tokenizer")
MEASURES = ("docs", "tokens", "chars")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"

#: What splits a text into words, for the version counted by a regular expression.
WORDS = r"[^ \t\n\r]+"


def count_tokens(text: Column, pattern: str = WORDS) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def bpe_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Adds ``out_col`` (replaced if it is there): the number of BPE tokens of each whole text."""
    held = "_tokens"
    return bpe.encode(docs, tokenizer_path, text_col, held).withColumn(out_col, F.size(held).cast("long")).drop(held)


def counted(docs: DataFrame, tokenizer: str, op: str, tokens: str, before: str | None = None) -> DataFrame:
    """Changes of one kind for rows (source, lang, chars and the named columns of counts); ``before`` is what a revision replaces."""
    null = F.lit(None).cast("long")
    return docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), F.col(tokens).alias("tokens"), "chars", (F.col(before) if before else null).alias("tokens_before"), F.col("chars").alias("chars_before"))


def changes_between(old: DataFrame, new: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Changes from one counted table (id, keys, tokens, chars) to the next, by id and tokenizer.

    A row whose source or language moved is deleted there and inserted here.  Rows with
    equal id and keys are numbered by their counts and met by number.
    """
    key = [id_col, *KEYS]
    numbered = lambda df: df.withColumn("_no", F.row_number().over(Window.partitionBy(*key).orderBy("tokens", "chars")))
    key_no = [*key, "_no"]
    o = numbered(old).select(*key_no, F.col("tokens").alias("_o"), F.col("chars").alias("_oc"))
    n = numbered(new).select(*key_no, F.col("tokens").alias("_n"), F.col("chars").alias("_nc"))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key_no]
    both = o.withColumn("_in_o", F.lit(True)).alias("o").join(n.withColumn("_in_n", F.lit(True)).alias("n"), same, "full")
    op = F.when(F.col("_in_o").isNull(), INSERT).when(F.col("_in_n").isNull(), DELETE).when(~F.col("_o").eqNullSafe(F.col("_n")) | ~F.col("_oc").eqNullSafe(F.col("_nc")), REVISE)
    return both.select(*[F.when(F.col("_in_n").isNull(), F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in KEYS], op.alias("op"), F.coalesce("_n", "_o").alias("tokens"), F.coalesce("_nc", "_oc").alias("chars"), F.col("_o").alias("tokens_before"), F.col("_oc").alias("chars_before")).where("op IS NOT NULL")


def deltas(changes: DataFrame) -> DataFrame:
    sign = F.when(F.col("op") == INSERT, 1).when(F.col("op") == DELETE, -1).otherwise(0)
    signed_by = lambda m: F.when(F.col("op") == REVISE, F.coalesce(m, F.lit(0)) - F.coalesce(f"{m}_before", F.lit(0))).otherwise(sign * F.coalesce(m, F.lit(0))).alias(m)
    signed = changes.select(*KEYS, sign.cast("long").alias("docs"), signed_by("tokens"), signed_by("chars"))
    return signed.groupBy(*KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])


class Rollup:
    """Batches of deltas in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _publish(self, aside: str, path: str) -> None:
        fs, to = self._fs(path)
        fs.mkdirs(to.getParent())
        if not fs.rename(self._fs(aside)[1], to):
            raise OSError(f"can't rename {aside} to {path}")

    def _listed(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _folded(self) -> str | None:
        """Folder of the newest base."""
        found = self._listed("base")
        return f"{self.path}/base/{found[-1]}" if found else None

    def folded(self, *ids: str) -> set[str]:
        """Which of these batches are in the base; no more ids than asked for reach the driver."""
        base = self._folded()
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{base}/ids").where(F.col("batch").isin(*ids)).collect()} if base and ids else set()

    def batches(self) -> list[str]:
        """Ids of published batches that aren't folded into the base."""
        found = self._listed("batch")
        done = self.folded(*found)
        return [b for b in found if b not in done]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Publishes a batch; False, and nothing changed, if it was published before."""
        if batch in self._listed("batch") or self.folded(batch):
            return False
        aside = f"{self.path}/aside/{batch}-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(aside)
        self._publish(aside, f"{self.path}/batch/{batch}")
        return True

    def totals(self) -> DataFrame:
        base = self._folded()
        parts = [*([f"{base}/sums"] if base else []), *(f"{self.path}/batch/{b}" for b in self.batches())]
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES]).where("docs <> 0 OR tokens <> 0 OR chars <> 0")

    def compact(self) -> None:
        """Folds all batches into a new base, published with the list of their ids; then their folders go."""
        base, now = self._folded(), self.batches()
        aside = f"{self.path}/aside/base-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{aside}/sums")
        ids = self.spark.createDataFrame([(i,) for i in now], "batch string")
        (ids.unionByName(self.spark.read.schema("batch string").parquet(f"{base}/ids")) if base else ids).write.parquet(f"{aside}/ids")
        self._publish(aside, f"{self.path}/base/{len(self._listed('base')):06d}")
        for b in now:
            fs, at = self._fs(f"{self.path}/batch/{b}")
            fs.delete(at, True)


#: In the registered query, documents below so many characters go and come back in later batches.
SHORT = 200


def replay(docs: DataFrame, tokenizer_path: str, scratch: Scratch, rollup: Rollup) -> DataFrame:
    """Totals after a fixed history over all documents, with batches sent twice and a compaction.

    Two versions are counted once a document: ``words`` by white space and ``bpe`` by the
    encoder.  Documents with a ``|`` are revised to counts without it; short ones go and
    come back, so the totals are those of every document.
    """
    text = F.col("text")
    plain = docs.select("source", "lang", "text").withColumns({"chars": F.coalesce(F.length("text"), F.lit(0)).cast("long"), "words": count_tokens(text), "cells": count_tokens(F.replace(text, F.lit("|"), F.lit(" "))), "piped": F.coalesce(text.contains("|"), F.lit(False))})
    rows = scratch.keep(bpe_counts(plain, tokenizer_path, out_col="bpe").drop("text"), "counts")
    short = rows.where(F.col("chars") < SHORT)
    rollup.commit("0001", counted(rows, "words", INSERT, "words"))
    rollup.commit("0002", counted(rows, "bpe", INSERT, "bpe"))
    rollup.compact()
    revised = counted(rows.where("piped"), "words", REVISE, "cells", "words")
    rollup.commit("0003", revised)
    rollup.commit("0003", revised)
    rollup.commit("0004", counted(short, "words", DELETE, "cells").unionByName(counted(short, "bpe", DELETE, "bpe")))
    rollup.commit("0002", counted(rows, "bpe", INSERT, "bpe"))
    rollup.commit("0005", counted(short, "words", INSERT, "cells").unionByName(counted(short, "bpe", INSERT, "bpe")))
    return rollup.totals()
