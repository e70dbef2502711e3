"""The joins that reports start from.

Dimension tables are joined by equality; whether one is broadcast is left to
Spark's size estimates, so nothing that grows is forced into memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.schema import FINAL
from podium.tables import Catalog


def _named(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def _event(t: Catalog) -> DataFrame:
    return _named(t["event"], event_id="id", competition_id="competition_id", division_name="division_name", event_gender="gender", event_name="event_name", team_event="team_event")


def _round(t: Catalog) -> DataFrame:
    return _named(t["event_round"], round_id="id", event_id="event_id", round="round", event_number="event_number", day_number="day_number")


def _heat(t: Catalog) -> DataFrame:
    return _named(t["event_heat"], heat_id="id", round_id="event_round_id", heat_number="heat_number")


def rounds(t: Catalog) -> DataFrame:
    """Rounds with their events."""
    return _round(t).join(_event(t), "event_id")


def heats(t: Catalog) -> DataFrame:
    return _heat(t).join(rounds(t), "round_id")


def with_heats(starts: DataFrame, t: Catalog) -> DataFrame:
    """Rows that have a ``heat_id`` with everything above it.

    One table after the other: Spark knows how small each is, but takes their join for large and would shuffle all starts by heat.
    """
    return starts.join(_heat(t), "heat_id").join(_round(t), "round_id").join(_event(t), "event_id")


def entry_fact(t: Catalog, masters: bool = False) -> DataFrame:
    """One row per start with its entry and everything above it; ``masters`` adds athlete and team names."""
    return _above(_named(t["heat_entry"], **_START), t, masters)


_ENTRY = {"entry_id": "id", "entry_competition_id": "competition_id", "athlete_name": "athlete_name", "gender": "gender", "region": "region", "team_name": "team_name", "grade": "grade", "athlete_id": "athlete_id", "team_id": "team_id"}
_START = {"start_id": "id", "heat_id": "heat_id", "entry_id": "entry_id", "bib_number": "bib_number"}


def _above(starts: DataFrame, t: Catalog, masters: bool) -> DataFrame:
    """Starts with their entries, then heats: heats are few, so what is shuffled by entry carries none of their columns."""
    out = starts.join(_named(t["competition_entry"], **_ENTRY), "entry_id")
    out = with_heats(out, t)
    if masters:
        out = out.join(_named(t["athlete"], athlete_id="id", master_name="name", birth_year="birth_year"), "athlete_id", "left").join(_named(t["team"], team_id="id", master_team="name"), "team_id", "left")
    return out


def result_fact(t: Catalog, comp_id: int | None = None, masters: bool = False) -> DataFrame:
    """One row per result with its start, entry, round, event and competition."""
    result = _named(t["event_result"], result_id="id", start_id="heat_entry_id", ranking="ranking", record="record", new_record="new_record", qualification="qualification", note="note")
    competition = _named(t["competition"], competition_id="id", competition_name="name", short_name="short_name", edition="edition", start_date="start_date")
    # results meet bare starts, so neither side of the largest join is wide
    out = _above(result.join(_named(t["heat_entry"], **_START), "start_id"), t, masters).join(competition, "competition_id")
    return out if comp_id is None else out.where(F.col("competition_id") == comp_id)


def medals(t: Catalog, comp_id: int | None = None) -> DataFrame:
    """Results ranked 1 to 3 in finals; group finals give none."""
    return result_fact(_finals(t), comp_id).where((F.col("round") == FINAL) & F.col("ranking").isin(1, 2, 3))


def _finals(t: Catalog) -> Catalog:
    """With the starts of finals only, told by their heats before anything is shuffled."""
    final = _heat(t).join(_round(t).where(F.col("round") == FINAL), "round_id", "left_semi")
    return {**t, "heat_entry": t["heat_entry"].join(final, "heat_id", "left_semi")}


def of_competition(t: Catalog, comp_id: int) -> Catalog:
    """With the starts of one competition only, told by their heats before anything is shuffled."""
    own = _heat(t).join(_round(t).join(_event(t).where(F.col("competition_id") == comp_id), "event_id", "left_semi"), "round_id", "left_semi")
    return {**t, "heat_entry": t["heat_entry"].join(own, "heat_id", "left_semi")}


def scoring(t: Catalog, comp_id: int | None = None) -> DataFrame:
    return result_fact(_finals(t), comp_id).where((F.col("round") == FINAL) & F.col("ranking").between(1, 6))


def individual_entries(t: Catalog, comp_id: int | None = None, unmapped: bool = False, with_team: bool = False) -> DataFrame:
    """Entries with a start in an event for individuals, each once; ``with_team`` adds the team's own name and region, by team name."""
    single = _heat(t).join(_round(t).join(_event(t).where("NOT team_event"), "event_id", "left_semi"), "round_id", "left_semi")
    ids = t["heat_entry"].join(single, "heat_id", "left_semi").select(F.col("entry_id").alias("id"))
    out = t["competition_entry"].join(ids, "id", "left_semi")
    if comp_id is not None:
        out = out.where(F.col("competition_id") == comp_id)
    if unmapped:
        out = out.where("athlete_id IS NULL")
    if with_team:
        out = out.join(_named(t["team"], team_id="id", master_team="name", master_region="region"), "team_id", "left").orderBy("team_name", "id")
    return out


def events_by_first_number(t: Catalog, comp_id: int | None = None) -> DataFrame:
    """Events with the least number of their rounds; those without a number come last."""
    first = t["event_round"].groupBy("event_id").agg(F.min("event_number").alias("first_number"))
    events = t["event"] if comp_id is None else t["event"].where(F.col("competition_id") == comp_id)
    return events.join(first, events["id"] == first["event_id"], "left").drop("event_id").orderBy(F.asc_nulls_last("first_number"), "id")
