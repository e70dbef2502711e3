"""Podiums, standings and all-time rankings.

Ties that the data leave open are broken by (event, ranking, result id).  Blank
regions and teams don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.functions.exprs import count_medals, is_blank, medal_score
from podium.operators import facts
from podium.schema import B_GROUP
from podium.tables import Catalog

_SEEN = ("event_id", "ranking", "result_id")


def _order() -> Column:
    return F.struct(*_SEEN)


def podium_by_event(t: Catalog, comp_id: int | None = None) -> DataFrame:
    """Every event with name and athlete id of ranks 1 to 3.

    Of several results of a rank the first gives the name; the id is the first that isn't null.
    """
    won = facts.medals(t, comp_id)
    one = lambda value, rank, extra: F.min_by(value, F.when((F.col("ranking") == rank) & extra, F.col("result_id")))
    always, known = F.lit(True), F.col("athlete_id").isNotNull()
    cells = [c for rank, name in ((1, "gold"), (2, "silver"), (3, "bronze")) for c in (one("athlete_name", rank, always).alias(name), one("athlete_id", rank, known).alias(f"{name}_id"))]
    events = t["event"] if comp_id is None else t["event"].where(F.col("competition_id") == comp_id)
    return events.select(F.col("id").alias("event_id"), "competition_id").join(won.groupBy("event_id").agg(*cells), "event_id", "left")


def region_standings(t: Catalog, comp_id: int | None = None) -> DataFrame:
    """Per competition and region: medals, score (B groups win medals but no points) and athletes by group."""
    b_group = F.col("division_name").contains(B_GROUP)
    ranked = facts.scoring(t, comp_id).where(~is_blank(F.col("region")))
    won = ranked.groupBy("competition_id", "region").agg(*count_medals(F.col("ranking")), F.sum(F.when(b_group, 0).otherwise(medal_score(F.col("ranking")))).cast("long").alias("score"))
    in_b = facts.entry_fact(t).groupBy("entry_id").agg(F.bool_or(b_group).alias("in_b"))
    people = facts.individual_entries(t, comp_id).where(~is_blank(F.col("region"))).join(in_b, F.col("id") == F.col("entry_id")).groupBy("competition_id", "region").agg(F.count_if(~F.col("in_b")).alias("athletes"), F.count_if("in_b").alias("athletes_b_group"))
    counts = ["gold", "silver", "bronze", "total", "score", "athletes", "athletes_b_group"]
    both = won.join(people, ["competition_id", "region"], "full").select("competition_id", "region", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    return both.orderBy("competition_id", F.desc("score"), "region")


def team_standings(t: Catalog, comp_id: int | None = None, nested: bool = True) -> DataFrame:
    """Per competition, team and region: medals, divisions in the order first won, and awards."""
    won = facts.medals(t, comp_id).where(~is_blank(F.col("team_name")))
    keys = ["competition_id", F.col("team_name"), F.coalesce("region", F.lit("")).alias("region")]
    award = F.struct("ranking", "event_id", "result_id", "athlete_name", "division_name", "event_name")
    divisions = won.groupBy(*keys, "division_name").agg(F.min(_order()).alias("at")).groupBy("competition_id", "team_name", "region").agg(F.array_sort(F.collect_list(F.struct("at", "division_name"))).alias("d"))
    out = won.groupBy(*keys).agg(*count_medals(F.col("ranking")), F.array_sort(F.collect_list(award)).alias("awards")).join(divisions, ["competition_id", "team_name", "region"])
    names = F.array_join(F.transform("d", lambda x: x["division_name"]), ", ")
    awards = F.transform("awards", lambda a: F.struct(a["athlete_name"].alias("athlete_name"), a["division_name"].alias("division_name"), a["event_name"].alias("event_name"), a["ranking"].alias("ranking")))
    if not nested:
        awards = F.array_join(F.transform("awards", lambda a: F.concat_ws("/", a["ranking"].cast("string"), a["athlete_name"], a["event_name"])), "; ")
    return out.select("competition_id", "team_name", "region", "gold", "silver", "bronze", "total", names.alias("divisions"), awards.alias("awards")).orderBy("competition_id", F.desc("total"), F.desc("gold"), F.desc("silver"), "team_name", "region")


def _all_time(t: Catalog) -> DataFrame:
    return facts.medals(t).where(~is_blank(F.col("region")))


def alltime_regions(t: Catalog, order: str = "literal") -> DataFrame:
    """Medals per region.  ``literal`` sorts fewer golds first among equal totals, as the original chain of comparators does; ``intended`` doesn't."""
    out = _all_time(t).groupBy("region").agg(*count_medals(F.col("ranking")))
    gold = F.asc("gold") if order == "literal" else F.desc("gold")
    return out.orderBy(F.desc("total"), gold, F.desc("silver"), "region")


def alltime_by_edition(t: Catalog) -> DataFrame:
    """Medals per region and edition (unnumbered: 0); series that share a number are one, labelled as first seen."""
    won = _all_time(t).withColumn("edition", F.coalesce("edition", F.lit(0)))
    seen = F.struct(F.coalesce("start_date", F.lit("0001-01-01").cast("date")), *_SEEN)
    labels = won.groupBy("edition").agg(F.min_by("short_name", seen).alias("label"))
    return won.groupBy("region", "edition").agg(*count_medals(F.col("ranking"))[:3]).join(labels, "edition").select("region", "edition", "label", "gold", "silver", "bronze")


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(*order))).where(F.col("rank") <= k)


def top_teams(t: Catalog, k: int = 5) -> DataFrame:
    won = _all_time(t).where(~is_blank(F.col("team_name"))).groupBy("region", "team_name").agg(F.count("*").alias("medals"))
    return _top(won, k, F.desc("medals"), F.asc("team_name"))


def top_athletes(t: Catalog, k: int = 5, order: str = "literal") -> DataFrame:
    """Athletes by name.  ``literal`` keeps those with the fewest medals, as the original comparator does; ``intended`` the most."""
    won = _all_time(t).groupBy("region", "athlete_name").agg(*count_medals(F.col("ranking")))
    total = F.asc("total") if order == "literal" else F.desc("total")
    return _top(won, k, total, F.desc("gold"), F.asc("athlete_name"))


def alltime_region_standings(t: Catalog, order: str = "literal", k: int = 5) -> DataFrame:
    """``alltime_regions`` with nested editions, teams and athletes."""
    nest = lambda df, name, key, *columns: df.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, *columns))), lambda x: F.struct(*[x[c].alias(c) for c in ((key, *columns) if key != "rank" else columns)])).alias(name))
    editions = nest(alltime_by_edition(t), "by_competition", "edition", "label", "gold", "silver", "bronze")
    teams = nest(top_teams(t, k), "top_teams", "rank", "team_name", "medals")
    athletes = nest(top_athletes(t, k, order), "top_athletes", "rank", "athlete_name", "gold", "silver", "bronze", "total")
    out = alltime_regions(t, order)
    for part in (editions, teams, athletes):
        out = out.join(part, "region", "left")
    gold = F.asc("gold") if order == "literal" else F.desc("gold")
    return out.orderBy(F.desc("total"), gold, F.desc("silver"), "region")


def alltime_summary(t: Catalog) -> DataFrame:
    """One row: competitions, events, medals (blank regions too) and regions."""
    return facts.medals(t).agg(F.count_distinct("entry_competition_id").alias("competitions"), F.count_distinct("event_id").alias("events"), F.count("*").alias("medals"), F.count_distinct(F.when(~is_blank(F.col("region")), F.col("region"))).alias("regions"))


def athlete_medals(t: Catalog, by_id: bool = False) -> DataFrame:
    """Medals by athlete name, as histories are kept, or by athlete id."""
    key = "athlete_id" if by_id else "athlete_name"
    return facts.medals(t).groupBy(key).agg(*count_medals(F.col("ranking")))


def medal_history(t: Catalog, name: str | None = None) -> DataFrame:
    """Medal results by athlete name, latest competition first; without a name those of each athlete lie together in that order."""
    order = [F.desc_nulls_last("start_date"), "division_name", "event_name", "result_id"]
    won = facts.medals(t)
    return won.repartition("athlete_name").sortWithinPartitions("athlete_name", *order) if name is None else won.where(F.col("athlete_name") == name).orderBy(*order)
