"""Schedules: import of JSON rows and days with nested entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions.exprs import day_label, lenient_int
from podium.schema import conform
from podium.tables import Catalog, Store

# JSON keys and columns.
_TEXT = {"startTime": "start_time", "divisionName": "division_name", "eventName": "event_name", "roundType": "round_type", "heatInfo": "heat_info", "notes": "notes"}
_INT = {"dayNumber": "day_number", "orderNumber": "order_number", "quarterFinalRef": "quarter_final_ref", "semiFinalRef": "semi_final_ref", "finalRef": "final_ref"}


def parse_rows(json_rows: DataFrame, column: str = "value") -> DataFrame:
    """Typed rows of JSON objects.  Numbers may be text; what isn't a number is null.

    The entry type is ``race`` only where the key is missing; an explicit null stays and fails validation.
    """
    fields = [*_TEXT, *_INT, "dayDate", "entryType"]
    read = F.from_json(column, T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    keys = F.json_object_keys(column)
    rows = json_rows.select(read.alias("r"), keys.alias("keys"))
    kind = F.when(F.array_contains("keys", "entryType"), F.col("r.entryType")).otherwise("race")
    return rows.select(*[F.col(f"r.{k}").alias(c) for k, c in _TEXT.items()], *[lenient_int(F.col(f"r.{k}")).alias(c) for k, c in _INT.items()], F.col("r.dayDate").try_cast("date").alias("day_date"), kind.alias("entry_type"))


def replace_schedule(t: Catalog, comp_id: int, rows: DataFrame) -> Catalog:
    """The competition's entries are replaced by ``rows``; all others stay."""
    from podium.operators.mutate import allocate

    kept = t["schedule_entry"].where(F.col("competition_id") != comp_id)
    new = allocate(rows.withColumn("competition_id", F.lit(comp_id).cast("long")), kept, ["day_number", "order_number", "start_time", "event_name", "division_name"])
    return {**t, "schedule_entry": kept.unionByName(conform(new, "schedule_entry"))}


def replace_stored(store: Store, comp_id: int, rows: DataFrame) -> None:
    """As ``replace_schedule``, in a store: the files of other competitions aren't written.  Ids follow the largest of the others."""
    from podium.operators.mutate import allocate

    others = store.table("schedule_entry").where(F.col("competition_id") != comp_id)
    new = allocate(rows.withColumn("competition_id", F.lit(comp_id).cast("long")), others, ["day_number", "order_number", "start_time", "event_name", "division_name"])
    store.replace("schedule_entry", comp_id, new)


def schedule(t: Catalog, comp_id: int | None = None, day: int | None = None) -> DataFrame:
    """One row per day: label and nested entries in order."""
    rows = t["schedule_entry"]
    rows = rows if comp_id is None else rows.where(F.col("competition_id") == comp_id)
    rows = rows if day is None else rows.where(F.col("day_number") == day)
    entry = F.struct("id", "order_number", "start_time", "division_name", "event_name", "round_type", "heat_info", "quarter_final_ref", "semi_final_ref", "final_ref", "entry_type", "notes")
    days = rows.groupBy("competition_id", "day_number").agg(F.min_by("day_date", F.when(F.col("day_date").isNotNull(), F.col("id"))).alias("day_date"), F.array_sort(F.collect_list(entry)).alias("entries"))
    return days.withColumn("label", day_label(F.col("day_number"), F.col("day_date"))).orderBy("competition_id", "day_number")


def has_schedule(t: Catalog, comp_id: int) -> bool:
    return not t["schedule_entry"].where(F.col("competition_id") == comp_id).limit(1).isEmpty()


def with_schedule(t: Catalog) -> DataFrame:
    """(competition_id, found) of every competition: whether it has a schedule."""
    has = t["schedule_entry"].select("competition_id").distinct().withColumn("found", F.lit(True))
    return t["competition"].select(F.col("id").alias("competition_id")).join(has, "competition_id", "left").select("competition_id", F.coalesce("found", F.lit(False)).alias("found"))
