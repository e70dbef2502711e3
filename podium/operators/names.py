"""Search for names that contain a text, through a stored index.

``NameIndex`` keeps the pairs of neighbouring characters (``SIZE``) of each distinct name:
a table of postings (gram, name), in buckets of grams and sorted there, and the number of
rows of each gram; a second table holds the keys of each name, so what many rows share is
cut into grams once and each row is shuffled once.  A search reads the postings of the
text's rarest grams only, by pruned buckets and row groups, and the names that hold them
are then compared with the text itself.  A text shorter than a gram can't use the index and scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a gram: names here have three as a rule.
SIZE = 2
#: Buckets of the postings, and how many of a text's grams are asked.
BUCKETS, RAREST = 64, 3
_POSTINGS, _GRAMS, _KEYS = "gram string, name string, names long, bucket int", "gram string, names long, bucket int", "name string, key long, bucket int"


def grams(text: Column, size: int = SIZE) -> Column:
    """The distinct grams of a text; an empty array if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def grams_of(text: str, size: int = SIZE) -> list[str]:
    return list(dict.fromkeys(text[i : i + size] for i in range(len(text) - size + 1)))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int").alias("bucket")


class NameIndex:
    """An index in a folder that all executors share; it isn't changed once it is built."""

    def __init__(self, spark: SparkSession, path: str, size: int = SIZE, buckets: int = BUCKETS):
        self.spark, self.path, self.size, self.buckets = spark, path.rstrip("/"), size, buckets

    def build(self, df: DataFrame, key: str, column: str) -> NameIndex:
        """Stores the keys and postings of ``column``; null names have none.  A name that most rows hold spreads over files by key."""
        found = df.where(F.col(column).isNotNull()).select(F.col(column).alias("name"), F.col(key).cast("long").alias("key"), _bucket(F.col(column), self.buckets))
        found.repartitionByRange("bucket", "name", "key").sortWithinPartitions("bucket", "name", "key").write.partitionBy("bucket").parquet(f"{self.path}/keys")
        once = self._read("keys", _KEYS).groupBy("name").agg(F.count("*").alias("names"))
        rows = once.select(F.explode(grams(F.col("name"), self.size)).alias("gram"), "name", "names").select("*", _bucket(F.col("gram"), self.buckets))
        rows.repartitionByRange("bucket", "gram", "name").sortWithinPartitions("bucket", "gram", "name").write.partitionBy("bucket").parquet(f"{self.path}/postings")
        counts = self._read("postings", _POSTINGS).groupBy("gram", "bucket").agg(F.sum("names").alias("names"))
        counts.select("gram", "names", "bucket").repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.path}/grams")
        return self

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _asked(self, name: str, schema: str, wanted: list[str]) -> DataFrame:
        """Rows of these grams: only their buckets are listed, only their row groups read."""
        one = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket(F.col("gram"), self.buckets)).distinct()
        buckets = [r["bucket"] for r in one.collect()]
        return self._read(name, schema).where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))

    def rarest(self, text: str) -> list[tuple[str, int]]:
        """(gram, names) of the grams of a text that fewest names hold."""
        wanted = grams_of(text, self.size)
        known = {r["gram"]: r["names"] for r in self._asked("grams", _GRAMS, wanted).collect()}
        return sorted(((g, known.get(g, 0)) for g in wanted), key=lambda x: (x[1], x[0]))[:RAREST]

    def keys(self, text: str) -> DataFrame | None:
        """(key) of the names that hold the text's rarest grams; None if the text is too short."""
        if len(text) < self.size:
            return None
        asked = [g for g, _ in self.rarest(text)]
        found = self._asked("postings", _POSTINGS, asked)
        names = found.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("name", _bucket(F.col("name"), self.buckets))
        return self._read("keys", _KEYS).join(names, ["bucket", "name"]).select("key")

    def narrowed(self, df: DataFrame, text: str, key: str) -> DataFrame:
        """The rows of ``df`` whose name may contain the text: all if it is too short."""
        keys = self.keys(text)
        return df if keys is None else df.join(keys.select(F.col("key").alias(key)), key, "left_semi").select(*df.columns)
