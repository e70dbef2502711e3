"""Tables of the data model and their validation rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column lists in Spark DDL; ``!`` marks columns that may not be null.
_DDL = {
    "competition": "id long!, name string!, short_name string!, edition int, start_date date, end_date date, duration_days int, venue string, venue_detail string, host string, organizer string, notes string, image_path string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "event": "id long!, competition_id long!, division_name string!, gender string!, event_name string!, team_event boolean!, created_at timestamp_ntz, updated_at timestamp_ntz",
    "event_round": "id long!, event_id long!, round string!, event_number int, day_number int, created_at timestamp_ntz, updated_at timestamp_ntz",
    "event_heat": "id long!, event_round_id long!, heat_number int!, created_at timestamp_ntz",
    "heat_entry": "id long!, heat_id long!, entry_id long!, bib_number int!",
    "event_result": "id long!, heat_entry_id long!, ranking int, record string, new_record string, qualification string, note string, created_at timestamp_ntz",
    "competition_entry": "id long!, competition_id long!, athlete_name string!, gender string, region string, team_name string, grade int, athlete_id long, team_id long, created_at timestamp_ntz, updated_at timestamp_ntz",
    "athlete": "id long!, name string!, gender string!, birth_year int, notes string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "team": "id long!, name string!, region string!, created_at timestamp_ntz, updated_at timestamp_ntz",
    "schedule_entry": "id long!, competition_id long!, day_number int!, day_date date, order_number int, start_time string, division_name string, event_name string, round_type string, heat_info string, quarter_final_ref int, semi_final_ref int, final_ref int, event_round_id long, entry_type string!, notes string",
}
REQUIRED = {t: [c.split()[0] for c in ddl.split(", ") if c.endswith("!")] for t, ddl in _DDL.items()}

# Fixed values of the domain.
ROUNDS = ("예선", "준준결승", "준결승", "결승", "조별결승")
PRELIM, QUARTER, SEMI, FINAL, GROUP_FINAL = ROUNDS
RECORD_MARKS = ("세계신", "한국신", "부별신", "대회신")
B_GROUP = "일반(B조)"
TRIAL = "DTT"
TEAM_EVENTS = ("계주", "팀DTT", "팀dtt")
ENTRY_TYPES = ("race", "warmup", "lunch", "ceremony")

#: Keys that may occur once only.
UNIQUE = {
    "event_round": ("event_id", "round"),
    "event_heat": ("event_round_id", "heat_number"),
    "heat_entry": ("heat_id", "entry_id"),
    "event_result": ("heat_entry_id",),
}
#: Form rules: longest text by column; those of REQUIRED_TEXT may not be blank.
LONGEST = {
    "competition": {"name": 200, "short_name": 50, "venue": 200, "venue_detail": 200, "host": 100, "organizer": 100},
    "event": {"division_name": 50, "event_name": 30},
    "athlete": {"name": 50, "notes": 200},
    "team": {"name": 100, "region": 20},
}
REQUIRED_TEXT = {"competition": ("name", "short_name"), "event": ("division_name", "gender", "event_name"), "athlete": ("name", "gender"), "team": ("name", "region")}


def ddl(table: str) -> str:
    """Spark DDL of a table."""
    return ", ".join(c.replace("!", " NOT NULL") if c.endswith("!") else c for c in _DDL[table].split(", "))


def columns(table: str) -> list[str]:
    return [c.split()[0] for c in _DDL[table].split(", ")]


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; missing ones are null."""
    parts = [c.rstrip("!").split() for c in _DDL[table].split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in parts])


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with an array ``reasons``)."""
    blank = [F.when(F.coalesce(F.trim(F.regexp_replace(c, r"\s", " ")), F.lit("")) == "", F.lit(f"{c} is blank")) for c in REQUIRED_TEXT.get(table, ()) if c in df.columns]
    long = [F.when(F.length(c) > n, F.lit(f"{c} is longer than {n}")) for c, n in LONGEST.get(table, {}).items() if c in df.columns]
    null = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in REQUIRED[table] if c in df.columns and c not in REQUIRED_TEXT.get(table, ())]
    marked = df.withColumn("reasons", F.array_compact(F.array(*blank, *long, *null)))
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def duplicates(df: DataFrame, table: str) -> DataFrame:
    """Unique keys that occur more than once, with their number."""
    return df.groupBy(*UNIQUE[table]).agg(F.count("*").alias("n")).where("n > 1")


def any_of(conditions):
    return reduce(lambda a, b: a | b, conditions)
