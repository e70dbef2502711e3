"""Matching of competition entries to master athletes and teams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.exprs import division_category, is_blank
from podium.operators import facts
from podium.operators.mutate import map_entries
from podium.operators.names import SIZE, grams
from podium.tables import Catalog


#: All values of ``division_category``, sorted.
LEVELS = ("", "고등", "대일", "중등", "초등")


_SINGLE = 1 << len(LEVELS)


def _seen(t: Catalog) -> DataFrame:
    """(entry_id, seen): a bit for each school level of an entry's starts, and one more if it started for itself; starts are shuffled as two numbers."""
    level, bits = division_category(F.col("division_name")), F.lit(0)
    for k, name in enumerate(LEVELS):
        bits = F.when(level == name, 1 << k).otherwise(bits)
    starts = facts.with_heats(t["heat_entry"].select("heat_id", "entry_id"), t)
    return starts.select("entry_id", bits.bitwiseOR(F.when(F.col("team_event"), 0).otherwise(_SINGLE)).alias("seen")).groupBy("entry_id").agg(F.bit_or("seen").alias("seen"))


def levels_of(bits: str) -> Column:
    """The sorted school levels of a column of bits."""
    return F.array_compact(F.array(*[F.when(F.col(bits).bitwiseAND(F.lit(1 << k)) != 0, name) for k, name in enumerate(LEVELS)]))


def categories(t: Catalog) -> DataFrame:
    """(entry_id, categories): sorted distinct school levels of an entry's starts."""
    return _seen(t).join(t["competition_entry"].select(F.col("id").alias("entry_id")), "entry_id", "left_semi").select("entry_id", levels_of("seen").alias("categories"))


def looked_at(t: Catalog) -> DataFrame:
    """Entries (``id`` as ``entry_id``) with the school levels of their starts as bits (none is 0), and whether they started for themselves (``single``)."""
    seen = F.coalesce("seen", F.lit(0))
    met = t["competition_entry"].withColumnRenamed("id", "entry_id").join(_seen(t), "entry_id", "left")
    return met.withColumns({"levels": seen.bitwiseAND(F.lit(_SINGLE - 1)), "single": seen.bitwiseAND(F.lit(_SINGLE)) != 0}).drop("seen")


def compatible(a, b):
    """Whether two category sets meet, or either is empty."""
    return F.arrays_overlap(a, b) | (F.size(a) == 0) | (F.size(b) == 0)


def entry_history(t: Catalog) -> DataFrame:
    """Per entry: competition, year, divisions and events in order, joined; null if there are none."""
    starts = facts.entry_fact(t)
    names = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ", "), F.lit("")).alias(f"{c}s")
    shown = starts.groupBy("entry_id").agg(names("division_name"), names("event_name"))
    competition = t["competition"].select(F.col("id").alias("competition_id"), F.col("name").alias("competition"), F.year("start_date").alias("year"))
    return t["competition_entry"].select(F.col("id").alias("entry_id"), "athlete_id", "competition_id", "region", "team_name").join(competition, "competition_id").join(shown, "entry_id", "left")


def candidates(t: Catalog, comp_id: int | None = None, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """Unmapped individual entries with every athlete of their name and gender, and those athletes' histories (as ``shown`` gives them, once each)."""
    history = histories(t)
    history = history if shown is None else history.withColumn("history", shown(F.col("history")))
    athlete = t["athlete"].select(F.col("id").alias("athlete_id"), F.col("name").alias("athlete_name"), "gender", "birth_year", "notes")
    entries = facts.individual_entries(t, comp_id, unmapped=True).select(F.col("id").alias("entry_id"), "athlete_name", "gender", "region", "team_name")
    # histories meet their athletes before these are paired with entries, so no shuffle carries pairs; the merge join hands out all
    # entries of one athlete after those of the other, so a file holds a history once for many rows
    met = athlete.join(history, "athlete_id", "left").join(entries.hint("merge"), ["athlete_name", "gender"])
    return met.select("athlete_name", "gender", "entry_id", "region", "team_name", "athlete_id", "birth_year", "notes", "history")


def auto_match(t: Catalog, comp_id: int | None = None) -> DataFrame:
    """(entry_id, athlete_id) for unmapped individual entries whose group has exactly one candidate.

    A group is name, gender, team and categories; a candidate has that name and gender and any
    entry with the same team and compatible categories.
    """
    # one look at the starts: an entry's categories, and whether it started for itself
    starts = facts.entry_fact(t).groupBy("entry_id").agg(F.array_sort(F.collect_set(division_category(F.col("division_name")))).alias("categories"), F.bool_or(~F.col("team_event")).alias("single"))
    entries = t["competition_entry"].withColumnRenamed("id", "entry_id").join(starts, "entry_id", "left").withColumn("team", F.coalesce("team_name", F.lit(""))).withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    open_ = entries.where(F.col("athlete_id").isNull() & F.coalesce("single", F.lit(False)))
    open_ = open_ if comp_id is None else open_.where(F.col("competition_id") == comp_id)
    keys = ["athlete_name", "gender", "team", "categories"]
    past = entries.where("athlete_id IS NOT NULL").select("athlete_id", F.coalesce("team_name", F.lit("")).alias("team"), F.col("categories").alias("theirs"))
    athlete = t["athlete"].select(F.col("id").alias("athlete_id"), F.col("name").alias("athlete_name"), "gender")
    known = past.join(athlete, "athlete_id").distinct()
    groups = open_.select(*keys).distinct()
    found = groups.join(known, ["athlete_name", "gender", "team"]).where(compatible(F.col("categories"), F.col("theirs"))).groupBy(*keys).agg(F.count_distinct("athlete_id").alias("n"), F.min("athlete_id").alias("match")).where("n = 1")
    return open_.join(found, keys).select("entry_id", F.col("match").alias("athlete_id"))


def apply_match(t: Catalog, matched: DataFrame, column: str = "athlete_id") -> Catalog:
    return map_entries(t, matched.select("entry_id", F.col(column).alias("value")), column)


def _rarest(short: DataFrame, long_grams: DataFrame, column: str) -> DataFrame:
    """(column, gram): for each short name its gram that fewest of the long names hold; a name with a gram that none holds lies in none."""
    counts = long_grams.groupBy("gram").agg(F.count("*").alias("n"))
    own = short.select(column, F.explode(_name_grams(F.col(column))).alias("gram")).join(counts, "gram", "left")
    best = own.groupBy(column).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("best")).where("best.n > 0")
    return best.select(column, "best.gram")


def _name_grams(name: Column) -> Column:
    """Pairs of neighbouring characters, or the one character there is."""
    return F.when(F.length(name) < SIZE, F.array(name)).otherwise(grams(name))


def team_candidates(t: Catalog, comp_id: int | None = None) -> DataFrame:
    """Distinct team names of entries without a team, with teams whose name contains theirs or is contained.

    The shorter of two such names lies within the longer one, so all its grams occur there.
    Pairs meet on the one gram of the shorter name that fewest of the longer ones hold, by
    counts taken before; a word that begins most names is the meeting place only of names
    that have nothing else.
    """
    entries = t["competition_entry"].where("team_id IS NULL")
    entries = entries if comp_id is None else entries.where(F.col("competition_id") == comp_id)
    names = entries.where(~is_blank(F.col("team_name"))).select("team_name").distinct()
    teams = t["team"].where(~is_blank(F.col("name"))).select(F.col("id").alias("team_id"), "name", "region")
    distinct_names = teams.select("name").distinct()
    # single characters too, for names of one
    all_grams = lambda c: F.explode(F.array_union(grams(F.col(c)), F.array_distinct(F.split(F.col(c), "")))).alias("gram")
    of_teams, of_entries = distinct_names.select("name", all_grams("name")), names.select("team_name", all_grams("team_name"))
    inside_team = _rarest(names, of_teams, "team_name").join(of_teams, "gram").where(F.col("name").contains(F.col("team_name")))
    inside_entry = _rarest(distinct_names, of_entries, "name").join(of_entries, "gram").where(F.col("team_name").contains(F.col("name")))
    pairs = inside_team.select("team_name", "name").union(inside_entry.select("team_name", "name")).distinct()
    return pairs.join(teams, "name").select("team_name", "team_id", F.col("name").alias("candidate"), "region")


def histories(t: Catalog) -> DataFrame:
    """(athlete_id, history): the entries of each mapped athlete, nested in order."""
    return entry_history(t).where("athlete_id IS NOT NULL").groupBy("athlete_id").agg(F.array_sort(F.collect_list(F.struct("year", "competition", "region", "team_name", "division_names", "event_names"))).alias("history"))


def homonyms(t: Catalog) -> DataFrame:
    """Names and genders of several athletes, with the athletes and their histories nested."""
    one = F.struct(F.col("id").alias("athlete_id"), "birth_year", "notes", "history")
    people = t["athlete"].join(histories(t).withColumnRenamed("athlete_id", "id"), "id", "left")
    return people.groupBy("name", "gender").agg(F.count("*").alias("athletes"), F.array_sort(F.collect_list(one)).alias("candidates")).where("athletes >= 2").orderBy("name", "gender")


def _shown(text: str, unmapped_only: bool):
    """Whether the mapping page lists an entry: name or team contains the text, and it is unmapped if that is asked."""
    found = F.lower("athlete_name").contains(text.lower()) | F.lower(F.coalesce("team_name", F.lit(""))).contains(text.lower())
    return found & F.col("athlete_id").isNull() if unmapped_only else found


def mapping_list(t: Catalog, comp_id: int | None = None, text: str = "", unmapped_only: bool = False) -> DataFrame:
    """The entries that the mapping page lists."""
    return facts.individual_entries(t, comp_id).where(_shown(text, unmapped_only))


def mapping_counts(t: Catalog, text: str = "", unmapped_only: bool = False) -> DataFrame:
    """Per competition: individual entries, mapped, unmapped and listed under the filter."""
    mapped = F.col("athlete_id").isNotNull()
    return facts.individual_entries(t).groupBy("competition_id").agg(F.count("*").alias("total"), F.count_if(mapped).alias("mapped"), F.count_if(~mapped).alias("unmapped"), F.count_if(_shown(text, unmapped_only)).alias("visible"))
