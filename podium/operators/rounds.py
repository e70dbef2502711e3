"""Rounds: status, detail pages and time-trial ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.functions.exprs import record_ms
from podium.operators import facts
from podium.schema import TRIAL
from podium.tables import Catalog

# How complete a round is.
DONE, PARTLY, ENTRIES_ONLY, NOTHING = "완료", "일부", "엔트리만", "없음"


def round_status(t: Catalog, event_id: int | None = None) -> DataFrame:
    """Entries and results of every round, and how complete it is."""
    starts = facts.heats(t).select("heat_id", "round_id").join(t["heat_entry"].select(F.col("id").alias("start_id"), "heat_id"), "heat_id")
    results = t["event_result"].select(F.col("heat_entry_id").alias("start_id"), F.lit(1).alias("has"))
    counts = starts.join(results, "start_id", "left").groupBy("round_id").agg(F.count("*").alias("entry_count"), F.count("has").alias("result_count"))
    rounds = facts.rounds(t) if event_id is None else facts.rounds(t).where(F.col("event_id") == event_id)
    e, r = (F.coalesce(c, F.lit(0)) for c in ("entry_count", "result_count"))
    status = F.when((r > 0) & (r >= e), DONE).when(r > 0, PARTLY).when(e > 0, ENTRIES_ONLY).otherwise(NOTHING)
    return rounds.join(counts, "round_id", "left").select("event_id", "round_id", "round", "event_number", status.alias("status"), e.alias("entry_count"), r.alias("result_count")).orderBy("event_id", F.asc_nulls_first("event_number"), "round_id")


def has_results(t: Catalog) -> DataFrame:
    """Rounds with a result."""
    return round_status(t).where("result_count > 0").select("round_id")


def results_by_start(t: Catalog, round_id: int | None = None) -> DataFrame:
    out = facts.result_fact(t)
    return out if round_id is None else out.where(F.col("round_id") == round_id)


def heat_rows(t: Catalog) -> DataFrame:
    """Every start with its result, if any, and its place on the page: by ranking where the heat has a result, else by bib."""
    results = t["event_result"].select(F.col("id").alias("result_id"), F.col("heat_entry_id").alias("start_id"), "ranking", "record", "new_record", "qualification", "note")
    rows = facts.entry_fact(t).join(results, "start_id", "left")
    heat = Window.partitionBy("heat_id")
    rows = rows.withColumn("heat_has", F.max(F.col("result_id").isNotNull()).over(heat))
    by = F.when(F.col("heat_has"), F.coalesce("ranking", F.lit(2**31 - 1))).otherwise(F.col("bib_number"))
    return rows.withColumn("position", F.row_number().over(heat.orderBy(by, "bib_number", "start_id")))


def round_rows(t: Catalog, round_id: int | None = None) -> DataFrame:
    """What a round's page lists: results only once any heat has one, else all starts."""
    rows = heat_rows(t)
    rows = rows if round_id is None else rows.where(F.col("round_id") == round_id)
    rows = rows.withColumn("round_has", F.max("heat_has").over(Window.partitionBy("round_id")))
    return rows.where(~F.col("round_has") | F.col("result_id").isNotNull()).select("round_id", "heat_id", "heat_number", "position", "bib_number", "athlete_name", "region", "team_name", "athlete_id", "ranking", "record", "new_record", "qualification", "note")


def round_detail(t: Catalog, round_id: int | None = None) -> DataFrame:
    """One row per heat with its nested rows; a heat that lists nothing has an empty array."""
    row = F.struct("position", "bib_number", "athlete_name", "region", "team_name", "athlete_id", "ranking", "record", "new_record", "qualification", "note")
    listed = round_rows(t, round_id).groupBy("heat_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    heats = facts.heats(t) if round_id is None else facts.heats(t).where(F.col("round_id") == round_id)
    return heats.select("event_id", "round_id", "round", "heat_id", "heat_number").join(listed, "heat_id", "left").withColumn("rows", F.coalesce("rows", F.array())).orderBy("round_id", "heat_number")


def rerank_time_trials(t: Catalog, comp_id: int | None = None, by: str = "text") -> DataFrame:
    """New rankings of all time-trial results: position by record over all heats of a round.

    ``text`` compares records as text, so 1:02.345 is before 59.123; ``time`` compares times.
    Results without a record come last and have no ranking.
    """
    trials = facts.result_fact(t, comp_id).where(F.col("event_name").contains(TRIAL))
    record = F.col("record") if by == "text" else record_ms(F.col("record"))
    order = Window.partitionBy("round_id").orderBy(record.asc_nulls_last(), F.asc("heat_id"), F.asc_nulls_last("ranking"), F.asc("result_id"))
    return trials.withColumn("new_ranking", F.when(F.col("record").isNotNull(), F.row_number().over(order))).select("result_id", "round_id", "record", F.col("ranking").alias("old_ranking"), "new_ranking")


def apply_ranking(t: Catalog, ranked: DataFrame) -> Catalog:
    """The catalogue with the rankings that ``rerank_time_trials`` gave."""
    new = ranked.select(F.col("result_id").alias("id"), "new_ranking", F.lit(True).alias("hit"))
    old = t["event_result"]
    return {**t, "event_result": old.join(new, "id", "left").withColumn("ranking", F.when(F.col("hit"), F.col("new_ranking")).otherwise(F.col("ranking"))).select(*old.columns)}


def event_detail(t: Catalog, event_id: int) -> DataFrame:
    status = round_status(t, event_id)
    return facts.rounds(t).where(F.col("event_id") == event_id).select("round_id", "division_name", "event_name", "event_gender", "team_event", "day_number").join(status, "round_id")
