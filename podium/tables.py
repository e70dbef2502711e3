"""Loading, saving and paging of tables; a catalogue is a dict of DataFrames."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium import schema

Catalog = dict[str, DataFrame]


def load(spark: SparkSession, path: str) -> Catalog:
    """All tables from Parquet below a path; a missing table is an error."""
    return {t: spark.read.parquet(f"{path}/{t}.parquet") for t in schema._DDL}


#: Rows that one connection reads at a time, rows of a partition of a table read from a database, and connections at once.
FETCH_ROWS, PARTITION_ROWS, CONNECTIONS = 10_000, 1_000_000, 64


def load_jdbc(
    spark: SparkSession, url: str, properties: dict[str, str], tables: list[str] | None = None, where: dict[str, str] | None = None,
    partition_rows: int = PARTITION_ROWS, connections: int = CONNECTIONS, fetch_rows: int = FETCH_ROWS,
) -> Catalog:
    """Tables from a database; credentials come from the caller only.

    A table is read in ranges of its id, as many as its rows need and at most ``connections``;
    the database answers one small query for their bounds.  ``where`` holds a condition by table,
    which the database evaluates; so do later filters and selections of columns.
    """
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier("id")
    out = {}
    for t in tables or list(schema._DDL):
        about = f"(SELECT MIN({quoted}) AS low, MAX({quoted}) AS high, COUNT(*) AS n FROM {t}) bounds"
        low, high, n = spark.read.jdbc(url, about, properties=properties).first()
        parts = min(connections, -(-n // partition_rows))
        given = properties | {"fetchsize": str(fetch_rows)}
        if parts > 1:
            df = spark.read.jdbc(url, t, column="id", lowerBound=low, upperBound=high + 1, numPartitions=parts, properties=given)
        else:
            df = spark.read.jdbc(url, t, properties=given)
        out[t] = schema.conform(df.where(where[t]) if t in (where or {}) else df, t)
    return out


def save(t: Catalog, path: str, mode: str = "errorifexists") -> None:
    for name, df in t.items():
        df.write.mode(mode).parquet(f"{path}/{name}.parquet")


#: Column that names the folder of a competition's rows; the rows keep their own ``competition_id``.
PART = "_competition"


class Store:
    """An archive whose tables of competitions are partitioned by competition, so that a change of one rewrites only its files.

    Tables without a ``competition_id`` are stored whole.  One driver at a time may write to a store.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}.parquet"

    def save(self, t: Catalog, mode: str = "errorifexists") -> Store:
        for name, df in t.items():
            if "competition_id" in df.columns:
                df.withColumn(PART, F.col("competition_id")).repartition(PART).write.mode(mode).partitionBy(PART).parquet(self._at(name))
            else:
                df.write.mode(mode).parquet(self._at(name))
        return self

    def table(self, name: str, comp_id: int | None = None) -> DataFrame:
        """A table, or one competition's rows of it: only their folder is read."""
        fields = schema.ddl(name).replace(" NOT NULL", "")
        if "competition_id" not in schema.columns(name):
            return self.spark.read.schema(fields).parquet(self._at(name))
        df = self.spark.read.schema(f"{fields}, {PART} long").parquet(self._at(name))
        return (df if comp_id is None else df.where(F.col(PART) == comp_id)).drop(PART)

    def load(self) -> Catalog:
        return {name: self.table(name) for name in schema._DDL}

    def replace(self, name: str, comp_id: int, rows: DataFrame) -> None:
        """Stores ``rows`` in place of a competition's rows; no other file is touched.

        Rows are written aside first, so they may be read from the table itself.
        """
        aside = keep(schema.conform(rows, name), name)
        if not aside.where(F.col("competition_id").isNull() | (F.col("competition_id") != comp_id)).isEmpty():
            raise ValueError(f"rows of another competition than {comp_id}")
        if aside.isEmpty():
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(name)}/{PART}={comp_id}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        else:
            part = aside.withColumn(PART, F.col("competition_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            part.partitionBy(PART).parquet(self._at(name))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a local session without it gets one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="podium-shared-"))
    return shared_dir(spark)


def keep(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table written to the shared folder: cuts the lineage of chained changes."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Scratch:
    """Tables of one change, written to the shared folder to cut lineage and freed with it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: dict[str, DataFrame] = {}
        self.count = 0

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        self.count += 1
        at = f"{self.root}/{self.count:03d}-{tag}"
        df.write.parquet(at)
        self.kept[at] = self.spark.read.schema(df.schema).parquet(at)
        return self.kept[at]

    def drop_others(self, *needed: DataFrame) -> None:
        """Deletes all tables but those that a result still reads."""
        for at, df in list(self.kept.items()):
            if all(df is not x for x in needed):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                del self.kept[at]


def require_one(df: DataFrame, value, key: str = "id"):
    """The one row with that key, or KeyError."""
    found = df.where(F.col(key) == value).limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"{key} = {value!r}: {'none' if not found else 'several'}")
    return found[0]


def exists(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def page(df: DataFrame, number: int = 0, size: int = 20) -> tuple[DataFrame, dict]:
    """A slice of a sorted DataFrame, with the counts that a pager shows."""
    if size <= 0 or number < 0:
        raise ValueError("a page has a positive size and a number from 0")
    total = df.count()
    pages = math.ceil(total / size)
    return df.offset(number * size).limit(size), {"page": number, "size": size, "total_elements": total, "total_pages": pages, "last": number >= pages - 1}


def facets(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values of a column, sorted."""
    return df.where(F.trim(column) != "").select(column).distinct().orderBy(column)


def filter_equal(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every given value; a value of None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def to_json(df: DataFrame) -> DataFrame:
    """Rows as JSON objects, nulls shown."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
