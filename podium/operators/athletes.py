"""Athletes: latest profiles, performances, recent medals and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.functions.exprs import blank_to_null, competition_label, record_ms
from podium.operators import facts
from podium.operators.names import NameIndex
from podium.tables import Catalog, keep


def athlete_entries(t: Catalog) -> DataFrame:
    """(master_id, entry_id): entries by athlete id; by name and gender only where the id has none."""
    athlete = t["athlete"].select(F.col("id").alias("master_id"), "name", "gender")
    entry = t["competition_entry"].select(F.col("id").alias("entry_id"), "athlete_id", "athlete_name", F.col("gender").alias("entry_gender"))
    by_id = athlete.join(entry, F.col("master_id") == F.col("athlete_id")).select("master_id", "entry_id")
    rest = athlete.join(entry.select(F.col("athlete_id").alias("master_id")), "master_id", "left_anti")
    by_name = rest.join(entry, (F.col("name") == F.col("athlete_name")) & (F.col("gender") == F.col("entry_gender"))).select("master_id", "entry_id")
    return by_id.unionByName(by_name)


def _of_group(people: DataFrame, own: DataFrame, named: DataFrame, columns: list[str]) -> DataFrame:
    """Athletes with ``columns`` of their own entries (``own``, by athlete_id) or, where the id has none, of those of their name and gender (``named``).

    What a name and gender give is worked out once, whatever the number of athletes that share it.
    """
    mine, theirs = own.select(F.col("athlete_id").alias("master_id"), F.struct(*columns).alias("_own")), named.select(F.col("athlete_name").alias("name"), F.col("entry_gender").alias("gender"), F.struct(*columns).alias("_named"))
    return people.join(mine, "master_id", "left").join(theirs, ["name", "gender"], "left").withColumn("_got", F.coalesce("_own", "_named")).select(*people.columns, *[F.col(f"_got.{c}").alias(c) for c in columns])


_NAMED = ["athlete_name", "entry_gender"]


def latest_profiles(t: Catalog) -> DataFrame:
    """Each athlete with the entry of the latest competition (undated lowest, then the first entry)."""
    entry = t["competition_entry"].select(F.col("id").alias("entry_id"), "competition_id", "athlete_id", "athlete_name", F.col("gender").alias("entry_gender"), "region", "team_name", "grade")
    dated = entry.join(t["competition"].select(F.col("id").alias("competition_id"), "start_date"), "competition_id")
    latest = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("start_date"), "entry_id"))
    own = dated.where("athlete_id IS NOT NULL").withColumn("k", latest("athlete_id")).where("k = 1")
    named = dated.withColumn("k", latest(*_NAMED)).where("k = 1")
    people = t["athlete"].select(F.col("id").alias("master_id"), "name", "gender", "birth_year")
    out = _of_group(people, own, named, ["region", "team_name", "grade", "entry_id"])
    return out.select(F.col("master_id").alias("athlete_id"), "name", "gender", "birth_year", "region", "team_name", "grade", F.col("entry_id").alias("latest_entry_id"))


def entry_divisions(t: Catalog) -> DataFrame:
    """Divisions that an athlete started in, joined in order."""
    of_entry = facts.with_heats(t["heat_entry"].select("heat_id", "entry_id"), t).groupBy("entry_id").agg(F.sort_array(F.collect_set("division_name")).alias("of_entry"))
    entry = t["competition_entry"].select(F.col("id").alias("entry_id"), "athlete_id", "athlete_name", F.col("gender").alias("entry_gender")).join(of_entry, "entry_id", "left")
    # sets of few divisions, so few of them differ
    whole = F.sort_array(F.array_distinct(F.flatten(F.collect_set("of_entry")))).alias("found")
    own, named = entry.where("athlete_id IS NOT NULL").groupBy("athlete_id").agg(whole), entry.groupBy(*_NAMED).agg(whole)
    out = _of_group(t["athlete"].select(F.col("id").alias("master_id"), "name", "gender"), own, named, ["found"]).where(F.size("found") > 0)
    return out.select(F.col("master_id").alias("athlete_id"), F.array_join("found", ", ").alias("divisions"))


def athletes_latest(t: Catalog, name_contains: str | None = None, names: NameIndex | None = None) -> DataFrame:
    """Athletes by name with profile and divisions; a search adds their recent medals.  ``names`` is an index of athletes' names by id."""
    if names is not None and name_contains:
        t = {**t, "athlete": names.narrowed(t["athlete"], name_contains, "id")}
    out = latest_profiles(t).join(entry_divisions(t), "athlete_id", "left")
    if name_contains is not None:
        recent = recent_medals(t).where(F.col("athlete_name").contains(name_contains)).groupBy(F.col("athlete_name").alias("name")).agg(F.array_sort(F.collect_list(F.struct("position", "label", "division_name", "event_name", "ranking", "record"))).alias("recent_medals"))
        out = out.where(F.col("name").contains(name_contains)).join(recent, "name", "left")
    return out.orderBy("name", "athlete_id")


def _latest_first() -> list:
    return [F.desc_nulls_last("start_date"), F.desc("event_number"), "start_id"]


def performances(t: Catalog, athlete_id: int | None = None, by_start: bool = False) -> DataFrame:
    """Every start of an athlete with its result, latest competition first.

    For all athletes the rows of one lie together in that order; the table isn't sorted as a whole.
    Starts that many athletes share by their name are put in order once and met last, so no
    shuffle carries them once for each of these athletes.  ``by_start``: in no order, but the rows of
    a start that many share lie together, so files hold what it says once.
    """
    results = t["event_result"].select(F.col("heat_entry_id").alias("start_id"), "ranking", "record", "new_record", "qualification", "note")
    if athlete_id is not None:
        mine = athlete_entries(t).where(F.col("master_id") == athlete_id)
        rows = mine.join(facts.entry_fact(t), "entry_id").join(results, "start_id", "left")
        return _shown(rows, t).select(F.col("master_id").alias("athlete_id"), *_PERFORMANCE).orderBy(*_latest_first())
    starts = _shown(facts.entry_fact(t).join(results, "start_id", "left"), t)
    own = starts.where("athlete_id IS NOT NULL").join(t["athlete"].select(F.col("id").alias("athlete_id")), "athlete_id").select("athlete_id", *_PERFORMANCE)
    keys = ["athlete_name", "gender"]
    if by_start:
        # a merge join hands out all of the right side for one row of the left after the other
        return own.unionByName(starts.select(*keys, *_PERFORMANCE).join(_without_entries(t).hint("merge"), keys).select("athlete_id", *_PERFORMANCE))
    own = own.repartition("athlete_id").sortWithinPartitions("athlete_id", *_latest_first())
    # a merge join hands out the right side's rows in their order, here the window's, for one row of the left after the other
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*_latest_first()))
    shared = starts.select(*keys, *_PERFORMANCE).withColumn("k", k).where("k > 0")
    named = _without_entries(t).hint("merge").join(shared, keys).select("athlete_id", *_PERFORMANCE)
    return own.unionByName(named)


_PERFORMANCE = ["competition_id", "label", "start_date", "division_name", "event_name", "round", "event_number", "ranking", "record", "new_record", "qualification", "note", "start_id"]


def _shown(starts: DataFrame, t: Catalog) -> DataFrame:
    """Starts with date and label of their competition; no number counts as 0."""
    competition = t["competition"].select(F.col("id").alias("competition_id"), "start_date", competition_label(F.col("edition"), F.col("short_name"), F.col("name")).alias("label"))
    return starts.join(competition, "competition_id").withColumn("event_number", F.coalesce("event_number", F.lit(0)))


def _without_entries(t: Catalog) -> DataFrame:
    """(athlete_id, athlete_name, gender) of athletes whose id no entry has."""
    have = t["competition_entry"].where("athlete_id IS NOT NULL").select("athlete_id").distinct()
    # both grow with the archive: met by shuffle, however small their files are
    return t["athlete"].select(F.col("id").alias("athlete_id"), F.col("name").alias("athlete_name"), "gender").join(have.hint("merge"), "athlete_id", "left_anti")


def detail(t: Catalog, number: int = 0, size: int = 20, athlete_id: int | None = None) -> DataFrame:
    """One row per athlete: the latest profile, and a page of performances nested, with the counts a pager shows.

    A page is chosen by the bare starts, once for all athletes that share a name, and only then shown with results.
    """
    if size <= 0 or number < 0:
        raise ValueError("a page has a positive size and a number from 0")
    if athlete_id is not None:
        t = {**t, "athlete": t["athlete"].where(F.col("id") == athlete_id)}
    entry = t["competition_entry"].select(F.col("id").alias("entry_id"), "athlete_id", "athlete_name", F.col("gender").alias("entry_gender"))
    bare = _shown(facts.with_heats(t["heat_entry"].select(F.col("id").alias("start_id"), "heat_id", "entry_id").join(entry, "entry_id"), t), t)
    bare = bare.select("start_id", "start_date", "event_number", "heat_id", "athlete_id", *_NAMED)
    on_page = (F.col("k") > number * size) & (F.col("k") <= (number + 1) * size)
    listed = []
    for keys in (["athlete_id"], _NAMED):
        rows = bare.where("athlete_id IS NOT NULL") if keys == ["athlete_id"] else bare
        k = F.row_number().over(Window.partitionBy(*keys).orderBy(*_latest_first()))
        page = rows.withColumn("k", k).where(on_page).select(*keys, "k", "start_id", "heat_id")
        results = t["event_result"].select(F.col("heat_entry_id").alias("start_id"), "ranking", "record", "new_record", "qualification", "note")
        shown = _shown(facts.with_heats(page.join(results, "start_id", "left"), t), t)
        content = shown.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", *_PERFORMANCE))).alias("content"))
        # an athlete has a row by its entries even where these have no start
        known = entry.where("athlete_id IS NOT NULL").select("athlete_id").distinct() if keys == ["athlete_id"] else None
        total = rows.groupBy(*keys).agg(F.count("*").alias("total_elements"))
        total = total if known is None else known.join(total, keys, "left")
        listed.append(total.join(content, keys, "left"))
    people = latest_profiles(t).join(entry_divisions(t), "athlete_id", "left").withColumnRenamed("athlete_id", "master_id")
    out = _of_group(people, *listed, ["total_elements", "content"]).withColumnRenamed("master_id", "athlete_id")
    # a page behind the last is empty; an athlete without starts has none
    out = out.withColumn("content", F.when(F.col("total_elements").isNotNull(), F.coalesce("content", F.array().cast(out.schema["content"].dataType)))).withColumn("total_elements", F.coalesce("total_elements", F.lit(0)))
    pages = F.ceil(F.col("total_elements") / size).cast("int")
    return out.withColumns({"total_pages": pages, "number": F.lit(number), "last": F.lit((number + 1) * size) >= F.col("total_elements")})


def recent_medals(t: Catalog, competitions: int = 5) -> DataFrame:
    """Medals by athlete name, latest first, up to where one more competition than that begins.

    The list stops there: later medals of competitions seen before are cut too.
    """
    order = [F.desc_nulls_last("start_date"), "division_name", "event_name", "result_id"]
    name, once = Window.partitionBy("athlete_name").orderBy(*order), Window.partitionBy("athlete_name", "competition_id").orderBy(*order)
    # a competition's first medal counts one, so a running sum tells how many were seen; both windows use the one shuffle by name
    flagged = facts.medals(t).repartition("athlete_name").withColumn("first", (F.row_number().over(once) == 1).cast("int"))
    seen = F.sum("first").over(name.rowsBetween(Window.unboundedPreceding, 0))
    rows = flagged.withColumn("seen", seen).withColumn("position", F.row_number().over(name)).where(F.col("seen") <= competitions)
    return rows.select("athlete_name", "position", "competition_id", competition_label(F.col("edition"), F.col("short_name"), F.col("competition_name")).alias("label"), "division_name", "event_name", "ranking", "record", "result_id")


def athlete_profile(t: Catalog, comp_id: int, name: str) -> DataFrame:
    """One row: region, team and id of the first entry of that name in the competition, with recent medals."""
    entry = t["competition_entry"].where((F.col("competition_id") == comp_id) & (F.col("athlete_name") == name)).orderBy("id").limit(1).select(F.col("athlete_name").alias("name"), "gender", "region", "team_name", "athlete_id")
    recent = recent_medals(t).where(F.col("athlete_name") == name).groupBy(F.col("athlete_name").alias("name")).agg(F.array_sort(F.collect_list(F.struct("position", "label", "division_name", "event_name", "ranking", "record"))).alias("recent_medals"))
    return entry.join(recent, "name", "left")


def search(t: Catalog, name: str | None = None, birth_year: int | None = None, notes: str | None = None, names: NameIndex | None = None) -> DataFrame:
    """Athletes that meet every given condition; blank text asks for nothing.  ``names`` is an index of their names by id."""
    out = t["athlete"]
    if names is not None and name is not None and name.strip():
        out = names.narrowed(out, name.strip(), "id")
    for column, text in (("name", name), ("notes", notes)):
        if text is not None and text.strip():
            out = out.where(F.col(column).contains(text.strip()))
    if birth_year is not None:
        out = out.where(F.col("birth_year") == birth_year)
    return out.orderBy("name", "id")


def filter_list(listed: DataFrame, text: str = "", gender: str | None = None, region: str | None = None, division: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows shown, one row of visible and total counts) for a list of athletes."""
    wanted = F.lower("name").contains(text.lower()) | F.lower(F.coalesce("team_name", F.lit(""))).contains(text.lower())
    for column, value in (("gender", gender), ("region", region)):
        if value:
            wanted = wanted & (F.col(column) == value)
    if division:
        wanted = wanted & F.coalesce(F.col("divisions").contains(division), F.lit(False))
    return listed.where(wanted), listed.agg(F.count_if(wanted).alias("visible"), F.count("*").alias("total"))


#: Ids of found entries up to this many are sent to every task; starts meet more by shuffle.
SENT_IDS = 1_000_000


def suggest_entries(t: Catalog, event_id: int | None = None, q: str = "", names: NameIndex | None = None) -> DataFrame:
    """Entries of an event's starts whose name contains q, first of each name and team.  ``names`` is an index of entries' names by id."""
    if names is not None:
        found = keep(names.narrowed(t["competition_entry"], q, "id").where(F.col("athlete_name").contains(q)), "found")
        t = {**t, "competition_entry": found}
        if found.count() <= SENT_IDS:
            # starts of others end where they are read
            t["heat_entry"] = t["heat_entry"].join(F.broadcast(found.select(F.col("id").alias("entry_id"))), "entry_id", "left_semi")
    starts = facts.entry_fact(t)
    starts = starts if event_id is None else starts.where(F.col("event_id") == event_id)
    team = F.coalesce("team_name", F.lit(""))
    first = Window.partitionBy("event_id", "athlete_name", team).orderBy("heat_id", "bib_number", "start_id")
    return starts.where(F.col("athlete_name").contains(q)).withColumn("k", F.row_number().over(first)).where("k = 1").select("event_id", "athlete_name", "team_name", "region", "gender", "bib_number")


def best_records(t: Catalog) -> DataFrame:
    """Best time per athlete name and event, as an addition: times compared as times."""
    rows = facts.result_fact(t).withColumn("ms", record_ms(F.col("record"))).where("ms IS NOT NULL")
    return rows.groupBy("athlete_name", "event_name").agg(F.min("ms").alias("best_ms"), F.count("*").alias("timed"))


def team_search(t: Catalog, region: str | None = None) -> DataFrame:
    out = t["team"] if blank_to_null(F.lit(region)) is None or not region else t["team"].where(F.col("region") == region)
    return out.orderBy("region", "name", "id")
