"""Helpers shared by the corpus operators: shared storage, row identity and
rolling hashes over bytes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids are compared or ordered.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can read and write.

    It is the one named in ``spark.checkpoint.dir``.  Only where that setting is
    missing (a local session, as in tests) is a folder of our own made and set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="podium-shared-")
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` frees one early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.kept: list[DataFrame] = []

    def path(self, tag: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{tag}"

    def keep(self, df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
        at = self.path(tag)
        df.write.parquet(at, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        self.kept.append(out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.kept = [x for x in self.kept if all(x is not df for df in frames)]

    def drop_others(self, *needed: DataFrame) -> None:
        """Frees all tables but those that a result still reads."""
        self.drop(*[df for df in self.kept if all(df is not x for x in needed)])


#: Bytes of an Arrow batch, unless the session sets ``spark.sql.execution.arrow.maxBytesPerBatch``; keeps workers small.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose function may use this package on any executor."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes, so that workers stay small."""
    for batch in batches:
        at, n = 0, batch.num_rows
        step = max(1, int(n * limit / max(1, batch.column(column).get_total_buffer_size())))
        while at < n:
            yield batch.slice(at, step)
            at += step


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once a context."""
    context = spark.sparkContext
    if getattr(context, "_podium_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    bundle = os.path.join(tempfile.mkdtemp(prefix="podium-"), "podium.zip")
    with zipfile.ZipFile(bundle, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(bundle)
    context._podium_shipped = True


def with_row_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) plus ``_d``, ``_h``: a key that equal rows share and others don't."""
    return df.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_d"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"),
    )


# Rolling hashes ---------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPAN = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while filled < n:
            take = min(filled, n - filled)
            out[filled : filled + take] = out[:take] * step
            filled += take
            step = step * step
    return out


class Rolling:
    """Hash of any substring in O(1): prefix sums of b[i] * B**i modulo 2**64.

    ``table`` spreads byte values over 64 bits; the result of ``of`` is mixed, so
    its bits can be used apart.
    """

    _cache: dict = {}

    def __init__(self, limit: int = _SPAN):
        self.limit = limit
        self.pow = _powers(int(_BASE), limit + 1)
        self.inv = _powers(pow(int(_BASE), -1, 1 << 64), limit + 1)
        self.table = np.random.RandomState(20240229).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    @classmethod
    def get(cls) -> "Rolling":
        if "one" not in cls._cache:
            cls._cache["one"] = cls()
        return cls._cache["one"]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums (length n + 1) of 64-bit values."""
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.pow[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start, end) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.inv[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
