"""Deep pages of a sorted table without sorting it again.

``Pages`` stores a table in ranges of its order, each sorted, with the number of rows of
each range.  A page is then found by running sums over the ranges (as many as there are
partitions, not rows), and only the ranges that hold it are read.  ``after`` gives the
rows behind a known one, for callers that go from page to page.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of a stored table.
RANGES = 256


class Pages:
    """A table in the order of ``order`` (ascending, nulls first), in a folder that all executors share.

    The columns of ``order`` should tell rows apart; rows that they don't may change places between pages.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[str]):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    def build(self, df: DataFrame, ranges: int = RANGES) -> Pages:
        placed = df.repartitionByRange(ranges, *self.order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *self.order)
        placed.write.partitionBy("_range").parquet(f"{self.path}/rows")
        placed.limit(0).coalesce(1).write.parquet(f"{self.path}/none")  # a table without rows has columns too
        counts = self._stored().groupBy("_range").agg(F.count("*").alias("n"), *[F.min(c).alias(f"_{i}") for i, c in enumerate(self.order[:1])])
        counts.coalesce(1).write.parquet(f"{self.path}/counts")
        return self

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/none").schema).parquet(f"{self.path}/rows")

    def _counts(self) -> list[tuple[int, int]]:
        return sorted((r["_range"], r["n"]) for r in self.spark.read.parquet(f"{self.path}/counts").collect())

    def _rows(self, ranges: list[int]) -> DataFrame:
        return self._stored().where(F.col("_range").isin(ranges))

    def total(self) -> int:
        return sum(n for _, n in self._counts())

    def page(self, number: int = 0, size: int = 20) -> tuple[DataFrame, dict]:
        """(rows of a page with their ``position``, the counts that a pager shows); a page behind the last is empty."""
        if size <= 0 or number < 0:
            raise ValueError("a page has a positive size and a number from 0")
        counts = self._counts()
        ends = list(accumulate(n for _, n in counts))
        total, first, last = (ends[-1] if ends else 0), number * size, number * size + size
        hit = [i for i, end in enumerate(ends) if end > first and end - counts[i][1] < last]
        before = {counts[i][0]: ends[i] - counts[i][1] for i in hit}
        within = Window.partitionBy("_range").orderBy(*[F.asc_nulls_first(c) for c in self.order])
        shift = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("_range")] if before else F.lit(0)
        rows = self._rows(list(before)).withColumn("position", shift + F.row_number().over(within))
        pages = math.ceil(total / size)
        found = rows.where((F.col("position") > first) & (F.col("position") <= last)).drop("_range").orderBy("position")
        return found, {"page": number, "size": size, "total_elements": total, "total_pages": pages, "last": number >= pages - 1}

    def after(self, value, size: int = 20) -> DataFrame:
        """The first ``size`` rows whose leading order column is larger than ``value``, from the ranges that may hold them."""
        rows = sorted((r["_range"], r["n"], r["_0"]) for r in self.spark.read.parquet(f"{self.path}/counts").collect() if r["_0"] is not None)
        at = max(0, bisect_right([r[2] for r in rows], value) - 1)
        needed, have = [], 0
        for number, n, low in rows[at:]:
            needed.append(number)
            have += n if low > value else 0
            if have >= size:
                break
        return self._rows(needed).where(F.col(self.order[0]) > F.lit(value)).drop("_range").orderBy(*self.order).limit(size)
