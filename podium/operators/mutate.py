"""Changes as functions from catalogue to catalogue.

Ids are allocated as the largest id so far plus a position that the natural keys
decide, so a rerun gives the same ids.  Where a key occurs several times among new rows,
the first in order wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium import schema
from podium.tables import Catalog, keep

#: (child, its column, parent): what a cascade follows.
CHILDREN = (
    ("event", "competition_id", "competition"), ("competition_entry", "competition_id", "competition"), ("schedule_entry", "competition_id", "competition"),
    ("event_round", "event_id", "event"), ("event_heat", "event_round_id", "event_round"), ("schedule_entry", "event_round_id", "event_round"),
    ("heat_entry", "heat_id", "event_heat"), ("heat_entry", "entry_id", "competition_entry"), ("event_result", "heat_entry_id", "heat_entry"),
)
#: Natural keys by which rows are found or created.
KEYS = {"event": ["competition_id", "division_name", "gender", "event_name"], "event_round": ["event_id", "round"], "event_heat": ["event_round_id", "heat_number"], "heat_entry": ["heat_id", "entry_id"], "competition_entry": ["competition_id", "athlete_name", "gender", "team_name"], "team": ["name", "region"]}


def allocate(rows: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Rows with new ids after the largest existing one, without gaps.

    Numbers are dealt within slots by the hash of all key columns, in key order there,
    and shifted by the slots before: no task sorts all rows, whatever the first key.
    """
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    slot = rows.withColumn("_slot", F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]), F.lit(256)).cast("int"))
    counts = slot.groupBy("_slot").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_slot", "_before")
    numbered = slot.withColumn("_k", F.row_number().over(Window.partitionBy("_slot").orderBy(*[F.asc_nulls_first(c) for c in order])))
    out = numbered.join(F.broadcast(before), "_slot").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_before") + F.col("_k"))
    return out.drop("_slot", "_k", "_before", "_top")


def _match(a: str, b: str, keys: list[str], literal: bool) -> Column:
    """Equal keys; nulls meet nulls and empty text unless ``literal``."""
    out = None
    for k in keys:
        x, y = F.col(f"{a}.{k}"), F.col(f"{b}.{k}")
        same = x == y if literal or k != "team_name" else F.coalesce(x, F.lit("")) == F.coalesce(y, F.lit(""))
        out = same if out is None else out & same
    return out


def find_or_create(existing: DataFrame, rows: DataFrame, table: str, order: str | None = None, literal: bool = False, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(table with what was missing, the created rows, which are stored at once).  The first row of a key in ``order`` gives its values; ``keys`` replaces the table's natural key."""
    keys = keys or KEYS[table]
    norm = [F.coalesce(k, F.lit("")) if k == "team_name" and not literal else F.col(k) for k in keys]
    first = Window.partitionBy(*norm).orderBy(*([order] if order else [F.asc_nulls_first(c) for c in rows.columns]))
    once = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    missing = once.alias("n").join(existing.alias("o"), _match("n", "o", keys, literal), "left_anti")
    created = keep(schema.conform(allocate(missing.drop("id"), existing, keys), table), table)
    return existing.unionByName(created), created


def with_ids(rows: DataFrame, table: DataFrame, name: str, id_name: str, literal: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Rows with the id of the table row they mean, by natural key (the smallest id if several)."""
    keys = keys or KEYS[name]
    ids = table.groupBy(*[F.coalesce(k, F.lit("")).alias(k) if k == "team_name" and not literal else F.col(k) for k in keys]).agg(F.min("id").alias(id_name))
    met = rows.alias("r").join(ids.alias("i"), _match("r", "i", keys, literal), "left")
    return met.select("r.*", f"i.{id_name}")


def upsert_results(t: Catalog, rows: DataFrame) -> Catalog:
    """Results by start: all values are replaced where one exists, else a row is added; the last of repeated starts wins."""
    values = ["ranking", "record", "new_record", "qualification", "note"]
    last = Window.partitionBy("heat_entry_id").orderBy(*[F.desc_nulls_last(c) for c in values])
    new = rows.select("heat_entry_id", *values).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    old = t["event_result"]
    changed = old.join(new.select("heat_entry_id", F.struct(*values).alias("_new")), "heat_entry_id", "left")
    kept = changed.select(*[(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c in old.columns])
    added = schema.conform(allocate(new.join(old, "heat_entry_id", "left_anti"), old, ["heat_entry_id"]), "event_result")
    return {**t, "event_result": kept.unionByName(added)}


def delete_cascade(t: Catalog, table: str, ids: DataFrame) -> Catalog:
    """Without the rows of these ids (column ``id``) and everything below them."""
    gone = {table: ids.select("id").distinct()}
    for child, column, parent in CHILDREN:
        if parent in gone:
            below = t[child].join(gone[parent].select(F.col("id").alias(column)), column, "left_semi").select("id")
            gone[child] = gone[child].union(below).distinct() if child in gone else below
    return {name: df.join(gone[name], "id", "left_anti") if name in gone else df for name, df in t.items()}


def delete_athlete(t: Catalog, athlete_id: int, force: bool = False) -> Catalog:
    """Without an athlete; ValueError if entries name the athlete, unless ``force`` removes those too."""
    own = t["competition_entry"].where(F.col("athlete_id") == athlete_id)
    if not force and not own.limit(1).isEmpty():
        raise ValueError(f"athlete {athlete_id} has entries")
    out = delete_cascade(t, "competition_entry", own) if force else t
    return {**out, "athlete": out["athlete"].where(F.col("id") != athlete_id)}


def merge_athletes(t: Catalog, pairs: DataFrame) -> Catalog:
    """Entries of each ``loser_id`` go to its ``keeper_id``; losers are removed.  Keepers may not be losers."""
    moves = pairs.where("loser_id <> keeper_id").groupBy(F.col("loser_id").alias("athlete_id")).agg(F.min("keeper_id").alias("_to"))
    entries = t["competition_entry"]
    moved = entries.join(moves, "athlete_id", "left").withColumn("athlete_id", F.coalesce("_to", "athlete_id")).select(*entries.columns)
    return {**t, "competition_entry": moved, "athlete": t["athlete"].join(moves.select(F.col("athlete_id").alias("id")), "id", "left_anti")}


def map_entries(t: Catalog, mapping: DataFrame, column: str = "athlete_id") -> Catalog:
    """Sets ``athlete_id`` or ``team_id`` of entries from (entry_id, value); a null value unmaps."""
    entries = t["competition_entry"]
    new = mapping.select(F.col("entry_id").alias("id"), F.col("value").alias("_value"), F.lit(True).alias("_hit")).dropDuplicates(["id"])
    return {**t, "competition_entry": entries.join(new, "id", "left").withColumn(column, F.when(F.col("_hit"), F.col("_value")).otherwise(F.col(column))).select(*entries.columns)}


def create_and_map(t: Catalog, entries: DataFrame) -> Catalog:
    """A new athlete for each of these entries, (entry_id, birth_year), with its name and gender; the entry is mapped to it."""
    asked = entries.groupBy("entry_id").agg(F.max("birth_year").alias("birth_year"))
    named = t["competition_entry"].select(F.col("id").alias("entry_id"), F.col("athlete_name").alias("name"), "gender").join(asked, "entry_id")
    made = keep(allocate(named, t["athlete"], ["entry_id"]), "athlete")
    return map_entries({**t, "athlete": t["athlete"].unionByName(schema.conform(made, "athlete"))}, made.select("entry_id", F.col("id").alias("value")))


def add_heat(t: Catalog, rows: DataFrame) -> Catalog:
    """Heats by (event_round_id, heat_number); those that exist stay."""
    heats, _ = find_or_create(t["event_heat"], rows, "event_heat")
    return {**t, "event_heat": heats}


def save_entries(t: Catalog, rows: DataFrame, literal: bool = False) -> Catalog:
    """Entries and starts from (competition_id, athlete_name, gender, region, team_name, heat_id, bib_number), each once.

    ``literal`` compares a null team as unequal to all, so that saving it twice makes two entries.
    """
    entries, _ = find_or_create(t["competition_entry"], rows, "competition_entry", literal=literal)
    starts = with_ids(rows, entries, "competition_entry", "entry_id", literal).where("entry_id IS NOT NULL")
    heat_entry, _ = find_or_create(t["heat_entry"], starts.select("heat_id", "entry_id", "bib_number"), "heat_entry")
    return {**t, "competition_entry": entries, "heat_entry": heat_entry}


def create(t: Catalog, table: str, rows: DataFrame) -> tuple[Catalog, DataFrame]:
    """(catalogue with the valid rows added under new ids, rejected rows)."""
    valid, rejected = schema.validate(rows, table)
    new = schema.conform(allocate(valid.drop("id"), t[table], [c for c in valid.columns if c != "id"]), table)
    return {**t, table: t[table].unionByName(new)}, rejected


def update(t: Catalog, table: str, rows: DataFrame) -> tuple[Catalog, DataFrame]:
    """(catalogue with the columns of ``rows`` replaced by id, rejected rows)."""
    valid, rejected = schema.validate(rows, table)
    columns = [c for c in valid.columns if c != "id"]
    old = t[table]
    met = old.join(valid.select("id", F.struct(*columns).alias("_new")), "id", "left")
    return {**t, table: met.select(*[(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c) for c in old.columns])}, rejected
