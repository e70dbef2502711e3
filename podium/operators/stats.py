"""Participation, new records and competition lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.functions.exprs import distance, division_rank, gender_rank, is_blank, record_rank, report_division
from podium.operators import facts
from podium.tables import Catalog


def competitions(t: Catalog) -> DataFrame:
    """All competitions, latest first, undated last."""
    return t["competition"].withColumn("has_image", ~is_blank(F.col("image_path"))).orderBy(F.desc_nulls_last("start_date"), "id")


def series(t: Catalog, names: list[str]) -> DataFrame:
    """Competitions whose short name is one of a series, by series and edition."""
    return t["competition"].where(F.col("short_name").isin(*names)).orderBy("short_name", F.asc_nulls_first("edition"), "id")


def edition_map(t: Catalog) -> DataFrame:
    """(edition, competition_id): of equal editions the one of largest id."""
    return t["competition"].where("edition IS NOT NULL").groupBy("edition").agg(F.max("id").alias("competition_id"))


def participant_totals(t: Catalog, comp_id: int | None = None) -> DataFrame:
    """Per competition: male (M) and female (all else) entries, all events, and regions of those entries."""
    entries = facts.individual_entries(t, comp_id)
    male = F.coalesce(F.col("gender") == "M", F.lit(False))
    people = entries.groupBy("competition_id").agg(F.count_if(male).alias("male"), F.count_if(~male).alias("female"), F.count_distinct(F.when(~is_blank(F.col("region")), F.col("region"))).alias("regions"))
    events = t["event"] if comp_id is None else t["event"].where(F.col("competition_id") == comp_id)
    counts = events.groupBy("competition_id").agg(F.count("*").alias("events"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.join(people, "competition_id", "full").select("competition_id", zero("male"), zero("female"), zero("events"), zero("regions"))


def division_breakdown(t: Catalog, comp_id: int | None = None) -> DataFrame:
    """Entries by report division, from the first round with heats of each event for individuals; an entry counts once a division."""
    heats = facts.heats(t).where("NOT team_event")
    heats = heats if comp_id is None else heats.where(F.col("competition_id") == comp_id)
    rounds = heats.select("event_id", "round_id", "event_number").distinct()
    first = rounds.withColumn("k", F.row_number().over(Window.partitionBy("event_id").orderBy(F.asc_nulls_first("event_number"), "round_id"))).where("k = 1").select("round_id")
    starts = facts.entry_fact(t).join(first, "round_id", "left_semi")
    once = starts.select("competition_id", "entry_id", report_division(F.col("division_name")).alias("division"), F.coalesce(F.col("gender") == "M", F.lit(False)).alias("is_male")).distinct()
    out = once.groupBy("competition_id", "division").agg(F.count_if("is_male").alias("male"), F.count_if(~F.col("is_male")).alias("female"), F.count("*").alias("total"))
    return out.orderBy("competition_id", division_rank(F.col("division")), "division")


def new_records(t: Catalog, comp_id: int | None = None) -> DataFrame:
    """Results with a new-record mark, strongest first; ``place`` is the row's number in its competition."""
    rows = facts.result_fact(t, comp_id).where("new_record IS NOT NULL")
    order = Window.partitionBy("competition_id").orderBy(record_rank(F.col("new_record")), division_rank(report_division(F.col("division_name"))), gender_rank(F.col("division_name")), distance(F.col("event_name")), F.asc_nulls_last("record"), "event_id", "result_id")
    return rows.withColumn("place", F.row_number().over(order)).select("competition_id", "place", "new_record", "division_name", "event_name", "round", "athlete_name", "region", "team_name", "record", "result_id")


def events_with_podium(t: Catalog, comp_id: int | None = None) -> DataFrame:
    from podium.operators.medals import podium_by_event

    events = facts.events_by_first_number(t, comp_id).select(F.col("id").alias("event_id"), "division_name", "gender", "event_name", "team_event", "first_number")
    return events.join(podium_by_event(t, comp_id), "event_id").orderBy(F.asc_nulls_last("first_number"), "event_id")


def team_filter(standings: DataFrame, region: str | None = None, division: str | None = None) -> DataFrame:
    """Team standings of a region whose division list contains a text (so a prefix matches longer names)."""
    if region:
        standings = standings.where(F.col("region") == region)
    return standings.where(F.col("divisions").contains(division)) if division else standings


def division_facets(standings: DataFrame) -> DataFrame:
    return standings.select(F.explode(F.split("divisions", ", ")).alias("division")).distinct().orderBy("division")
