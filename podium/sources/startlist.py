"""Start lists: events, rounds, heats and starts from printed text.

A line has one class, the first that fits; state (day, event, round, heat, gender)
is what the lines before it set.  A heat holds until the next event header; starts
without a heat line are in heat 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.exprs import affiliation_note, is_team_event, trimmed, with_affiliation
from podium.operators.mutate import find_or_create, with_ids
from podium.schema import FINAL
from podium.sources.text import carried, group, groups
from podium.tables import Catalog, keep

# The line formats.
DAY = r"^제(\d)일차.*$"
HEADER = r"^(\d+)\s+(여|남)(.+?)\s+(\S+)\s+(예선|준준결승|준결승|결승|조별결승)$"
HEADER_PLAIN = r"^(\d+)\s+(여|남)(\S+부.*)\s+(\S+m\S*)$"
HEAT = r"^<\s*(\d+)조\s*>$"
HEAT_FINAL = r"^<\s*결승\s*>$"
ATHLETE = r"^(\d+)\s+(\S+)\s+\((.+?)\)$"
TEAM = r"^(?:\d+\s+)?(.+?)\s+\((.+?)\)$"
ROSTER_HEADER = r"^\s*(\d+)\s+(여|남)\S+부\s+.*$"


def parse_start_list(docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per start: (doc, pos, day_number, event_number, division_name, gender, event_name, team_event, round, heat_number, bib_number, athlete_name, region, team_name, grade)."""
    line = F.col("line")
    plain = line.rlike(HEADER_PLAIN) & ~line.rlike(r"^\d+\s+\d+\s+")
    kind = F.when(line.rlike(DAY), "day").when(line.rlike(HEADER), "event").when(plain, "plain").when(line.rlike(HEAT), "heat").when(line.rlike(HEAT_FINAL), "heat0")
    pick = lambda n: F.when(F.col("kind") == "event", group(line, HEADER, n)).when(F.col("kind") == "plain", group(line, HEADER_PLAIN, n))
    is_header = F.col("kind").isin("event", "plain")
    heat = F.when(F.col("kind") == "heat", group(line, HEAT, 1).cast("int")).when(F.col("kind") == "heat0", 0)
    state = {
        "day_number": F.when(F.col("kind") == "day", group(line, DAY, 1).cast("int")),
        "event_number": pick(1).cast("int"), "gender": F.when(is_header, F.when(pick(2) == "여", "F").otherwise("M")), "division_name": F.concat(pick(2), pick(3)), "event_name": pick(4),
        "round_name": F.when(F.col("kind") == "event", group(line, HEADER, 5)).when(F.col("kind") == "plain", F.lit(FINAL)),
        # a header ends the heat before it
        "heat": F.when(is_header, F.struct(F.lit(0).alias("number"))).when(heat.isNotNull(), F.struct(heat.alias("number"))),
    }
    rows = carried(docs, lambda found: found.withColumn("kind", kind).withColumns(state), list(state), id_col, text_col)
    rows = rows.withColumns({"day_number": F.coalesce("day_number", F.lit(0)), "heat_number": F.col("heat.number"), "team_event": is_team_event(F.col("event_name"))})
    rows = rows.where(F.col("kind").isNull() & F.col("event_name").isNotNull())
    # one pattern a line, and each step of an affiliation a column
    rows = rows.withColumn("parts", F.when(F.col("team_event"), groups(line, TEAM, 2)).otherwise(groups(line, ATHLETE, 3))).where(F.size("parts") > 1)
    part = lambda n: F.get("parts", F.lit(n))
    rows = with_affiliation(rows, F.when(~F.col("team_event"), part(2)), "own_").withColumn("team_name", trimmed(part(0)))
    single = ~F.col("team_event")
    return rows.select(
        "doc", "pos", "day_number", "event_number", "division_name", "gender", "event_name", "team_event", F.col("round_name").alias("round"), "heat_number",
        F.when(single, part(0).cast("int")).otherwise(0).alias("bib_number"), F.when(single, trimmed(part(1))).otherwise(F.col("team_name")).alias("athlete_name"),
        F.when(single, F.col("own_region")).otherwise(trimmed(F.substring_index(trimmed(part(1)), " ", 1))).alias("region"), F.when(single, F.col("own_team")).otherwise(F.col("team_name")).alias("team_name"), F.col("own_grade").alias("grade"),
    )


def parse_roster(docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """Distinct (doc, name, gender, notes) of the athletes in individual events of a start list."""
    raw = F.col("raw")
    header = raw.rlike(ROSTER_HEADER)
    marks = {"gender": F.when(header, F.when(group(raw, ROSTER_HEADER, 2) == "여", "F").otherwise("M")), "in_team": F.when(header, is_team_event(raw)), "is_header": header}
    rows = carried(docs, lambda found: found.withColumns(marks), ["gender", "in_team"], id_col, text_col)
    rows = rows.where(~F.col("is_header") & F.col("gender").isNotNull() & ~F.col("in_team")).withColumn("parts", groups(F.col("line"), ATHLETE, 3)).where(F.size("parts") > 1)
    rows = rows.withColumn("info", F.get("parts", F.lit(2)))
    return rows.select("doc", F.get("parts", F.lit(1)).alias("name"), "gender", affiliation_note(F.col("info")).alias("notes")).distinct()


def apply_roster(t: Catalog, roster: DataFrame) -> tuple[Catalog, DataFrame]:
    """(catalogue with unknown athletes added, one row of created and skipped counts)."""
    from podium.operators.mutate import allocate
    from podium.schema import conform

    # stored: lists are parsed once for the counts and the table
    rows = keep(roster.select("name", "gender", "notes").distinct(), "roster")
    known = t["athlete"].select("name", "gender", "notes").distinct()
    created = rows.join(known, ["name", "gender", "notes"], "left_anti")
    counts = created.agg(F.count("*").alias("created")).crossJoin(rows.agg(F.count("*").alias("n"))).select("created", (F.col("n") - F.col("created")).alias("skipped"))
    new = conform(allocate(created, t["athlete"], ["name", "gender", "notes"]), "athlete")
    return {**t, "athlete": t["athlete"].unionByName(new)}, counts


def apply_start_list(t: Catalog, parsed: DataFrame, comp_id: int) -> Catalog:
    """Events, rounds, heats, entries and starts found or created; a second import changes nothing."""
    rows = keep(parsed.withColumn("competition_id", F.lit(comp_id).cast("long")).withColumn("line_at", F.struct("doc", "pos")), "start-list")
    events, _ = find_or_create(t["event"], rows.select("line_at", "competition_id", "division_name", "gender", "event_name", "team_event"), "event", "line_at")
    rows = with_ids(rows, events, "event", "event_id")
    rounds, _ = find_or_create(t["event_round"], rows.select("line_at", "event_id", "round", "event_number", "day_number"), "event_round", "line_at")
    rows = with_ids(rows, rounds, "event_round", "event_round_id")
    heats, _ = find_or_create(t["event_heat"], rows.select("line_at", "event_round_id", "heat_number"), "event_heat", "line_at")
    rows = with_ids(rows, heats, "event_heat", "heat_id")
    entries, _ = find_or_create(t["competition_entry"], rows.select("line_at", "competition_id", "athlete_name", "gender", "region", "team_name", "grade"), "competition_entry", "line_at")
    rows = with_ids(rows, entries, "competition_entry", "entry_id")
    starts, _ = find_or_create(t["heat_entry"], rows.select("line_at", "heat_id", "entry_id", "bib_number"), "heat_entry", "line_at")
    return {**t, "event": events, "event_round": rounds, "event_heat": heats, "competition_entry": entries, "heat_entry": starts}


def import_counts(before: Catalog, after: Catalog) -> DataFrame:
    """One row: events, rounds, heats and entries that an import made."""
    out = None
    for name, table in (("events", "event"), ("rounds", "event_round"), ("heats", "event_heat"), ("entries", "competition_entry")):
        made = after[table].join(before[table].select("id"), "id", "left_anti").agg(F.count("*").alias(name))
        out = made if out is None else out.crossJoin(made)
    return out
