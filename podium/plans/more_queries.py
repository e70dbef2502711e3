"""Registered queries of parsers, listings, changes, pages and column functions.

Parsers read what ``sheets`` prints from the archive, so the SQL is that of the
archive itself: it knows nothing of lines and cells.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium import tables
from podium.functions import exprs as x
from podium.operators import athletes, facts, identity, medals, mutate, names, paging, registration, rounds, schedule, stats
from podium.plans import sheets
from podium.plans.queries import _CATEGORIES, _MEDALS, _MINE, _SEEN, _WON, _pick, _query
from podium.schema import conform
from podium.sources import listings, results, startlist
from podium.sources.ledger import Ledger

#: Competition of the queries that import one, and another one.
COMP = 19951


def _of_event(column: str) -> str:
    return f"CASE WHEN team_event THEN athlete_name ELSE {column} END"


# Parsers ------------------------------------------------------------------------


@_query("parsed_start_list", f"""{sheets.SQL}
SELECT CAST(event_id AS VARCHAR) AS doc, day_number, number AS event_number, division_name, event_gender AS gender, event_name, team_event, round, heat_number,
  CASE WHEN team_event THEN 0 ELSE bib END AS bib_number, athlete_name, shown_region AS region, shown_team AS team_name, CASE WHEN NOT team_event THEN grade END AS grade FROM pr""")
def _(t):
    return _pick(startlist.parse_start_list(sheets.start_lists(t)), "doc day_number event_number division_name gender event_name team_event round heat_number bib_number athlete_name region team_name grade")


_ROSTER = "SELECT DISTINCT CAST(event_id AS VARCHAR) AS doc, athlete_name AS name, event_gender AS gender, CASE WHEN start_id % 2 = 0 THEN shown_region || ' ' ELSE '' END || shown_region || ' ' || team_name AS notes FROM pr WHERE NOT team_event"


@_query("parsed_roster", f"{sheets.SQL} {_ROSTER}")
def _(t):
    return startlist.parse_roster(sheets.start_lists(t))


@_query("roster_import", f"""{sheets.SQL}, r AS (SELECT DISTINCT name, gender, notes FROM ({_ROSTER})),
k AS (SELECT count(*) FILTER (EXISTS (SELECT 1 FROM athlete a WHERE a.name = r.name AND a.gender = r.gender AND a.notes = r.notes)) AS skipped, count(*) AS n FROM r)
SELECT n - skipped AS created, skipped, (SELECT count(*) FROM athlete) + n - skipped AS athletes FROM k""")
def _(t):
    out, counts = startlist.apply_roster(t, startlist.parse_roster(sheets.start_lists(t)))
    return counts.crossJoin(out["athlete"].agg(F.count("*").alias("athletes")))


_SHEET = f"""CAST(heat_id AS VARCHAR) AS doc, number AS event_number, heat_number, team_event, bib AS bib_number, athlete_name, CASE WHEN team_event THEN city ELSE shown_region END AS region, shown_team AS team_name,
  ranking, record, new_record, qualification, CASE WHEN ranking IS NULL THEN '실격' END AS note"""


@_query("parsed_results", f"{sheets.SQL} SELECT {_SHEET} FROM pr WHERE result_id IS NOT NULL")
def _(t):
    return results.parse_results(sheets.result_sheets(t)).drop("pos")


def _batch(t):
    """Sheets with four more files: no text, no header, a summary of finals, a header alone."""
    spark = t["event"].sparkSession
    odd = spark.createDataFrame([("bad-1", None), ("bad-2", "결과 없음"), ("bad-3", "3 남중부 결승종합\n순위\n1 2 가  나"), ("bad-4", "3 남중부 500m 결승\n순위")], "path string, text string")
    return sheets.result_sheets(t).unionByName(odd)


@_query("result_batch_counts", f"{sheets.SQL} SELECT count(DISTINCT heat_id) AS files, count(*) AS results FROM pr WHERE result_id IS NOT NULL")
def _(t):
    return results.counts(results.parse_results(_batch(t)))


@_query("result_batch_rejects", " SELECT * FROM (VALUES ('bad-1', 'no text'), ('bad-2', 'no header'), ('bad-3', 'no header'), ('bad-4', 'no rows')) v(doc, reason)")
def _(t):
    docs = _batch(t)
    return results.rejected(docs, results.parse_results(docs))


def _bare(t, *kept: str):
    """The archive with all other tables empty."""
    return {name: df if name in kept else df.where(F.lit(False)) for name, df in t.items()}


@_query("start_list_import_counts", f"""{sheets.SQL}, p AS (SELECT * FROM pr WHERE competition_id = {COMP})
SELECT count(DISTINCT event_id) AS events, count(DISTINCT round_id) AS rounds, count(DISTINCT heat_id) AS heats, count(DISTINCT (athlete_name, event_gender, shown_team)) AS entries FROM p""")
def _(t):
    empty = _bare(t, "competition")
    done = startlist.apply_start_list(empty, startlist.parse_start_list(sheets.start_lists(t, COMP)), COMP)
    return startlist.import_counts(empty, done)


#: Time trials are ranked anew over all heats; among equal records the order is one of new ids, so the first of their places stands for all.
_PLACE = "CASE WHEN event_name NOT LIKE '%DTT%' THEN ranking WHEN record IS NOT NULL THEN CAST(rank() OVER (PARTITION BY round_id ORDER BY record NULLS LAST) AS INT) END"


@_query("imported_results", f"""{sheets.SQL}
SELECT division_name, event_name, round, heat_number, athlete_name, shown_team AS team_name, {_PLACE} AS ranking, record, new_record, qualification, CASE WHEN ranking IS NULL THEN '실격' END AS note
FROM pr WHERE competition_id = {COMP} AND result_id IS NOT NULL""")
def _(t):
    """Start lists, then result sheets, into an archive that knows the competition only."""
    done = startlist.apply_start_list(_bare(t, "competition"), startlist.parse_start_list(sheets.start_lists(t, COMP)), COMP)
    done = results.apply_results(done, results.parse_results(sheets.result_sheets(t, COMP)), COMP)
    first = F.min("ranking").over(Window.partitionBy("round_id", "record"))
    found = facts.result_fact(done).withColumn("ranking", F.when(F.col("event_name").contains("DTT"), F.when(F.col("record").isNotNull(), first)).otherwise(F.col("ranking")))
    return _pick(found, "division_name event_name round heat_number athlete_name team_name ranking record new_record qualification note")


@_query("results_sent_again", f"""{sheets.SQL}, p AS (SELECT * FROM pr WHERE result_id IS NOT NULL)
SELECT count(DISTINCT heat_id) AS files, count(*) AS results, CAST(0 AS BIGINT) AS files_again, (SELECT count(DISTINCT heat_id) FROM p WHERE competition_id = {COMP}) AS of_one FROM p""")
def _(t):
    """One competition's sheets, then all sheets twice, under other names: each is read once."""
    spark = t["event"].sparkSession
    ledger = Ledger(spark, f"{tables.shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    some, every = sheets.result_sheets(t, COMP), sheets.result_sheets(t)
    ledger.take("first", some, results.parse_results)
    of_one = ledger.files().count()
    ledger.take("second", every.withColumn("path", F.concat(F.lit("renamed "), "path")), results.parse_results)
    again = ledger.take("third", every, results.parse_results)
    assert ledger.take("second", every, results.parse_results) is None
    counted = ledger.rows().agg(F.count_distinct("doc").alias("files"), F.count("*").alias("results"))
    return counted.select("files", "results", F.lit(0 if again is None else 1).cast("long").alias("files_again"), F.lit(of_one).cast("long").alias("of_one"))


@_query("result_import_counts", f"""{sheets.SQL}, p AS (SELECT * FROM pr WHERE competition_id = {COMP} AND result_id IS NOT NULL)
SELECT count(DISTINCT heat_id) AS files, count(*) AS results, count(DISTINCT (athlete_name, event_gender, shown_team)) AS new_entries FROM p""")
def _(t):
    """Result sheets alone: rounds are known, entries aren't."""
    numbered = t["event_round"].withColumn("event_number", (F.pmod("event_id", F.lit(1000)) * 10 + F.pmod("id", F.lit(10))).cast("int"))
    before = {**_bare(t, "competition", "event"), "event_round": numbered}
    parsed = results.parse_results(sheets.result_sheets(t, COMP))
    return results.import_counts(before, results.apply_results(before, parsed, COMP), parsed)


# Listings -----------------------------------------------------------------------

_LISTED = "SELECT CAST(heat_id AS VARCHAR) AS doc, ranking, shown_region AS region, athlete_name, CAST(start_id AS VARCHAR) AS player_id, team_name, coalesce(record, '') AS record, new_record AS note, CASE WHEN new_record IN ('한국신', '대회신') THEN new_record END AS new_record FROM pr WHERE ranking IS NOT NULL"


@_query("listed_results", f"{sheets.SQL} {_LISTED}")
def _(t):
    return listings.result_rows(sheets.result_pages(t)).drop("pos")


@_query("listed_schedule", " SELECT CAST(e.id AS VARCHAR) AS doc, e.division_name AS division, e.event_name AS event, r.round, CAST(e.competition_id AS VARCHAR) AS a1, CAST(e.id AS VARCHAR) AS a2, CAST(r.id AS VARCHAR) AS a5 FROM event_round r JOIN event e ON e.id = r.event_id WHERE e.event_name NOT LIKE '%계주%'")
def _(t):
    return _pick(listings.schedule_rows(sheets.schedule_pages(t)), "doc division event round a1 a2 a5")


@_query("listed_records", f"{sheets.SQL} SELECT CAST(event_id AS VARCHAR) AS doc, row_number() OVER (PARTITION BY event_id ORDER BY result_id) - 1 AS rec, division_name AS division, event_name AS event, round, athlete_name AS athlete, record FROM pr WHERE new_record IS NOT NULL AND record IS NOT NULL")
def _(t):
    return listings.record_rows(sheets.record_pages(t))


_TARGETS = "SELECT r.id AS round_id, e.id AS event_id, e.competition_id, e.division_name, e.event_name, r.round FROM event_round r JOIN event e ON e.id = r.event_id"


@_query("scrape_targets", f" SELECT round_id * 2 AS pos, division_name AS division, event_name AS event, round, CAST(competition_id AS VARCHAR) AS gameno, CAST(event_id % 7 AS VARCHAR) AS kind, CAST(event_id AS VARCHAR) AS detail, CAST(round_id AS VARCHAR) AS rh FROM ({_TARGETS})")
def _(t):
    return listings.scrape_targets(sheets.target_rows(t)).drop("url")


@_query("sport_csv", f""" SELECT CAST(round_id * 2 + copy AS VARCHAR) AS c0, '롤러 "S", 인라인' AS c1, division_name AS c2, event_name AS c3, round AS c4 FROM ({_TARGETS}), (VALUES (0), (1)) v(copy) WHERE event_id % 2 = 0""")
def _(t):
    """Rows of the sport written as CSV and read again."""
    rows = sheets.target_rows(t).drop("pos")
    path = f"{tables.shared_dir(rows.sparkSession)}/csv-{uuid.uuid4().hex}"
    listings.write_sport(rows, path)
    return _pick(listings.read_csv(rows.sparkSession, path), "c0 c1 c2 c3 c4")


def _stored(youth: bool):
    code = "CASE WHEN heat_number = 0 THEN '9000' ELSE 'rh0' || heat_number END" if youth else "CASE WHEN heat_number = 0 THEN '309000' ELSE '100000' || heat_number END"

    def run(t):
        rows = sheets.printed(t, COMP).where("result_id IS NOT NULL AND ranking IS NOT NULL").selectExpr("start_id AS pos", "division_name AS division", "event_name AS event", "round", f"{code} AS code", "ranking", "shown_region AS region", "athlete_name", "team_name", "coalesce(record, '') AS record", "coalesce(new_record, '') AS note")
        # a row that comes twice changes nothing
        done = listings.store_results(_bare(t, "competition"), rows.unionByName(rows.withColumn("ranking", F.lit(99)).withColumn("pos", F.col("pos") + 1_000_000_000_000_000)), COMP, youth)
        return _pick(facts.result_fact(done), "division_name event_gender event_name team_event round heat_number athlete_name gender region team_name ranking record new_record note")

    return run


for _youth in (False, True):
    _query(f"stored_{'youth' if _youth else 'national'}_listing", f"""{sheets.SQL},
    p AS (SELECT *, CASE WHEN division_name LIKE '여%' OR division_name LIKE '%여자%' THEN 'F' ELSE 'M' END AS sex FROM pr WHERE competition_id = {COMP} AND ranking IS NOT NULL),
    q AS (SELECT *, arg_min(shown_region, start_id) OVER (PARTITION BY athlete_name, sex, team_name) AS first_region FROM p QUALIFY row_number() OVER (PARTITION BY heat_id, athlete_name, team_name ORDER BY start_id) = 1)
    SELECT division_name, sex AS event_gender, event_name, {'false' if _youth else "event_name LIKE '%계주%'"} AS team_event, round, heat_number, athlete_name, sex AS gender, first_region AS region, team_name, ranking, record,
      CASE WHEN new_record IN ('한국신', '대회신') THEN new_record END AS new_record, new_record AS note FROM q""")(_stored(_youth))


# Schedules ----------------------------------------------------------------------


@_query("schedule_import", f""" SELECT competition_id, day_number, day_date, CASE WHEN id % 3 = 0 THEN NULL ELSE order_number END AS order_number, division_name, event_name, round_type, 'race' AS entry_type FROM schedule_entry
WHERE competition_id = {COMP} UNION ALL SELECT competition_id, day_number, day_date, order_number, division_name, event_name, round_type, entry_type FROM schedule_entry WHERE competition_id <> {COMP}""")
def _(t):
    """A competition's schedule sent as JSON and stored in place of the old one; every third order number isn't one."""
    mine = t["schedule_entry"].where(F.col("competition_id") == COMP)
    order = F.when(F.col("id") % 3 == 0, "x").otherwise(F.concat(F.lit(" "), _string("order_number"), F.lit(" ")))
    sent = mine.select(F.to_json(F.struct(_string("day_number").alias("dayNumber"), _string("day_date").alias("dayDate"), order.alias("orderNumber"), F.col("division_name").alias("divisionName"), F.col("event_name").alias("eventName"), F.col("round_type").alias("roundType"))).alias("value"))
    done = schedule.replace_schedule(t, COMP, schedule.parse_rows(sent))
    return _pick(done["schedule_entry"], "competition_id day_number day_date order_number division_name event_name round_type entry_type")


@_query("stored_schedule_import", f""" SELECT competition_id, count(*) AS n, CAST(sum(day_number) AS BIGINT) AS days, count(order_number) AS numbered, count(*) = count(DISTINCT id) AS told_apart FROM (
  SELECT id, competition_id, day_number + CASE WHEN competition_id = {COMP} THEN 1 ELSE 0 END AS day_number, order_number FROM schedule_entry) GROUP BY competition_id""")
def _(t):
    """A competition's schedule moved by a day in a store that is partitioned by competition."""
    spark = t["event"].sparkSession
    store = tables.Store(spark, f"{tables.shared_dir(spark)}/store-{uuid.uuid4().hex}").save({"schedule_entry": t["schedule_entry"]})
    mine = store.table("schedule_entry", COMP)
    schedule.replace_stored(store, COMP, mine.drop("id", "competition_id").withColumn("day_number", F.col("day_number") + 1))
    found = store.table("schedule_entry").groupBy("competition_id")
    return found.agg(F.count("*").alias("n"), F.sum("day_number").alias("days"), F.count("order_number").alias("numbered"), (F.count("*") == F.count_distinct("id")).alias("told_apart"))


def _string(column: str):
    return F.col(column).cast("string")


@_query("competitions_with_schedule", " SELECT c.id AS competition_id, EXISTS (SELECT 1 FROM schedule_entry s WHERE s.competition_id = c.id) AS found FROM competition c")
def _(t):
    return schedule.with_schedule(t)


# Changes ------------------------------------------------------------------------


@_query("saved_entries", """, n AS (SELECT DISTINCT e.competition_id, '새선수' || (h.id % 5) AS athlete_name, h.id AS heat_id FROM event_heat h JOIN event_round r ON r.id = h.event_round_id JOIN event e ON e.id = r.event_id)
SELECT competition_id, athlete_name, heat_id, 99 AS bib_number, CAST(NULL AS VARCHAR) AS team_name FROM n UNION ALL SELECT ce.competition_id, ce.athlete_name, he.heat_id, he.bib_number, ce.team_name FROM heat_entry he JOIN competition_entry ce ON ce.id = he.entry_id""")
def _(t):
    """A start without a team in every heat, saved twice."""
    null = F.lit(None).cast("string")
    rows = facts.heats(t).select("competition_id", F.concat(F.lit("새선수"), F.pmod("heat_id", F.lit(5)).cast("string")).alias("athlete_name"), F.lit("M").alias("gender"), null.alias("region"), null.alias("team_name"), "heat_id", F.lit(99).alias("bib_number"))
    done = mutate.save_entries(mutate.save_entries(t, rows), rows)
    return done["heat_entry"].join(done["competition_entry"].select(F.col("id").alias("entry_id"), "competition_id", "athlete_name", "team_name"), "entry_id").select("competition_id", "athlete_name", "heat_id", "bib_number", "team_name")


@_query("added_heats", " SELECT DISTINCT event_round_id, heat_number FROM (SELECT event_round_id, heat_number FROM event_heat UNION ALL SELECT id, unnest([0, 9]) FROM event_round)")
def _(t):
    rows = t["event_round"].select(F.col("id").alias("event_round_id"), F.explode(F.array(F.lit(0), F.lit(9))).alias("heat_number"))
    return mutate.add_heat(t, rows)["event_heat"].select("event_round_id", "heat_number")


@_query("deleted_athlete", """, g AS (SELECT max(athlete_id) AS a FROM competition_entry), e AS (SELECT id FROM competition_entry WHERE athlete_id = (SELECT a FROM g)), s AS (SELECT id FROM heat_entry WHERE entry_id IN (SELECT id FROM e))
SELECT 'athlete' AS tab, count(*) AS n FROM athlete WHERE id <> (SELECT a FROM g) UNION ALL SELECT 'competition_entry', count(*) FROM competition_entry WHERE id NOT IN (SELECT id FROM e) UNION ALL SELECT 'heat_entry', count(*) FROM heat_entry WHERE id NOT IN (SELECT id FROM s)
UNION ALL SELECT 'event_result', count(*) FROM event_result WHERE heat_entry_id NOT IN (SELECT id FROM s)""")
def _(t):
    """The last athlete with entries, and all that hangs on it."""
    last = t["competition_entry"].agg(F.max("athlete_id")).first()[0]
    left = mutate.delete_athlete(t, last, force=True)
    out = None
    for name in ("athlete", "competition_entry", "heat_entry", "event_result"):
        one = left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
        out = one if out is None else out.union(one)
    return out


@_query("created_teams", " SELECT name || '-3' AS name, region, true AS valid FROM team WHERE id % 2 = 0 UNION ALL SELECT ' ', region, false FROM team WHERE id % 2 = 1")
def _(t):
    """New teams, of which every other one has a blank name and is refused."""
    rows = t["team"].select(F.when(F.col("id") % 2 == 0, F.concat("name", F.lit("-3"))).otherwise(" ").alias("name"), "region")
    done, refused = mutate.create(t, "team", rows)
    new = done["team"].join(t["team"].select("id"), "id", "left_anti")
    return new.select("name", "region", F.lit(True).alias("valid")).union(refused.select("name", "region", F.lit(False)))


@_query("updated_athletes", " SELECT id, name, gender, CASE WHEN birth_year % 2 = 0 THEN birth_year + 1 ELSE birth_year END AS birth_year FROM athlete")
def _(t):
    rows = t["athlete"].where("birth_year % 2 = 0").select("id", "name", "gender", (F.col("birth_year") + 1).alias("birth_year"))
    return _pick(mutate.update(t, "athlete", rows)[0]["athlete"], "id name gender birth_year")


@_query("created_and_mapped", " SELECT ce.id AS entry_id, ce.athlete_name, coalesce(a.name, ce.athlete_name) AS master_name, coalesce(a.birth_year, 1999) AS birth_year FROM competition_entry ce LEFT JOIN athlete a ON a.id = ce.athlete_id")
def _(t):
    """Every unmapped entry gets an athlete of its own."""
    done = mutate.create_and_map(t, t["competition_entry"].where("athlete_id IS NULL").select(F.col("id").alias("entry_id"), F.lit(1999).alias("birth_year")))
    people = done["athlete"].select(F.col("id").alias("athlete_id"), F.col("name").alias("master_name"), "birth_year")
    return done["competition_entry"].join(people, "athlete_id").select(F.col("id").alias("entry_id"), "athlete_name", "master_name", "birth_year")


@_query("unmapped_all", " SELECT id, CAST(NULL AS BIGINT) AS team_id FROM competition_entry")
def _(t):
    rows = t["competition_entry"].select(F.col("id").alias("entry_id"), F.lit(None).cast("long").alias("value"))
    return mutate.map_entries(t, rows, "team_id")["competition_entry"].select("id", "team_id")


#: Group by group of a name over the list of its athletes' entries, as a loop would; a chosen athlete is told by id, or as new by the smallest entry id.
_REGISTERED = f""", {_CATEGORIES},
e AS (SELECT ce.id, ce.athlete_name AS name, ce.gender, coalesce(ce.team_name, '') AS team, coalesce(c, []) AS c, ce.athlete_id, ce.competition_id = {COMP} AND ce.id IN (SELECT id FROM ind) AS mine
  FROM competition_entry ce LEFT JOIN cat ON cat.entry_id = ce.id),
g AS (SELECT *, CAST(row_number() OVER (PARTITION BY name, gender ORDER BY team, array_to_string(c, '/')) AS INT) AS i FROM (SELECT name, gender, team, c, min(id) AS first FROM e WHERE mine GROUP BY ALL)),
s0 AS (SELECT a.name, a.gender, list(struct_pack(p := CAST(a.id AS VARCHAR), t := h.team, c := h.c, k := h.k, f := h.f)) AS st FROM athlete a JOIN (
  SELECT e.athlete_id, e.team, e.c, coalesce(g.i, 0) AS k, min(e.id) AS f FROM e LEFT JOIN g ON e.mine AND g.name = e.name AND g.gender = e.gender AND g.team = e.team AND g.c = e.c WHERE e.athlete_id IS NOT NULL GROUP BY ALL) h
  ON h.athlete_id = a.id GROUP BY ALL),
r AS (
  SELECT n.name, n.gender, 0 AS i, coalesce(s0.st, []) AS st, CAST(NULL AS VARCHAR) AS pick FROM (SELECT DISTINCT name, gender FROM g) n LEFT JOIN s0 ON s0.name = n.name AND s0.gender = n.gender
  UNION ALL
  SELECT name, gender, i, list_append(list_filter(st, lambda x: x.k <> i), struct_pack(p := pick, t := team, c := c, k := i, f := first)), pick FROM (
    SELECT *, coalesce(list_extract(list_sort(list_transform(list_filter(st, lambda x: x.k = i AND list_contains(fit, x.p)), lambda x: struct_pack(f := x.f, p := x.p))), 1).p, CASE WHEN len(fit) = 1 THEN fit[1] END, 'new ' || first) AS pick FROM (
      SELECT r.name, r.gender, g.i, r.st, g.team, g.c, g.first,
        list_filter(list_distinct(list_transform(r.st, lambda x: x.p)), lambda q: len(list_filter(r.st, lambda x: x.p = q AND (x.t <> g.team OR NOT (len(x.c) = 0 OR len(g.c) = 0 OR list_has_any(x.c, g.c))))) = 0) AS fit
      FROM r JOIN g ON g.name = r.name AND g.gender = r.gender AND g.i = r.i + 1))),
chosen AS (SELECT e.id AS entry_id, e.athlete_id AS before, r.pick, e.team, g.first FROM e JOIN g ON g.name = e.name AND g.gender = e.gender AND g.team = e.team AND g.c = e.c JOIN r ON r.name = g.name AND r.gender = g.gender AND r.i = g.i WHERE e.mine)"""


@_query("bulk_register", f"""{_REGISTERED}
SELECT entry_id, CASE WHEN starts_with(pick, 'new') THEN 'new ' || min(entry_id) OVER (PARTITION BY pick) ELSE pick END AS athlete FROM chosen""")
def _(t):
    """Which athlete every entry gets."""
    done, _ = registration.bulk_register(t, COMP)
    mine = facts.individual_entries(done, COMP).select(F.col("id").alias("entry_id"), "athlete_id")
    new = mine.join(t["athlete"].select(F.col("id").alias("athlete_id")), "athlete_id", "left_anti").groupBy("athlete_id").agg(F.concat(F.lit("new "), F.min("entry_id")).alias("_new"))
    return mine.join(new, "athlete_id", "left").select("entry_id", F.coalesce("_new", F.col("athlete_id").cast("string")).alias("athlete"))


@_query("bulk_register_counts", f"""{_REGISTERED},
tm AS (SELECT team_name, region FROM ind WHERE competition_id = {COMP} AND team_id IS NULL AND {_SEEN} AND trim(coalesce(team_name, '')) <> '')
SELECT (SELECT count(*) FROM (SELECT DISTINCT team_name, region FROM tm EXCEPT SELECT name, region FROM team)) AS teams_created, (SELECT count(*) FROM tm) AS teams_mapped,
  count(DISTINCT pick) FILTER (starts_with(pick, 'new')) AS athletes_created, count(*) FILTER (pick IS DISTINCT FROM CAST(before AS VARCHAR)) AS athletes_mapped FROM chosen""")
def _(t):
    return registration.bulk_register(t, COMP)[1]


@_query("registered_notes", f"""{_REGISTERED},
k AS (SELECT r.name, r.gender, g.team, ce.region, r.i FROM r JOIN g ON g.name = r.name AND g.gender = r.gender AND g.i = r.i JOIN competition_entry ce ON ce.id = g.first WHERE r.pick = 'new ' || g.first)
SELECT name, gender, CASE WHEN trim(n) <> '' THEN n END AS notes FROM (
  SELECT name, gender, CASE WHEN EXISTS (SELECT 1 FROM athlete a WHERE a.name = k.name AND a.gender = k.gender) OR row_number() OVER (PARTITION BY name, gender ORDER BY i) > 1 THEN coalesce(region || ' ', '') || team END AS n FROM k)""")
def _(t):
    """The athletes that registration makes."""
    done, _ = registration.bulk_register(t, COMP)
    return done["athlete"].join(t["athlete"].select("id"), "id", "left_anti").select("name", "gender", "notes")


@_query("found_entries", " SELECT ce.id AS asked, (SELECT min(o.id) FROM competition_entry o WHERE o.competition_id = ce.competition_id AND o.athlete_name = ce.athlete_name AND o.gender = ce.gender AND coalesce(o.team_name, '') = coalesce(ce.team_name, '')) AS found FROM competition_entry ce")
def _(t):
    """Each entry by its natural key: the smallest id of those that share it."""
    rows = t["competition_entry"].select(F.col("id").alias("asked"), "competition_id", "athlete_name", "gender", "team_name")
    return mutate.with_ids(rows, t["competition_entry"], "competition_entry", "found").select("asked", "found")


@_query("found_rounds", " SELECT event_id, round, id FROM event_round UNION ALL SELECT id, '연습', NULL FROM event")
def _(t):
    """Every event gets one more round; those it has stay."""
    rows = t["event_round"].select("event_id", "round").union(t["event"].select("id", F.lit("연습")))
    done, made = mutate.find_or_create(t["event_round"], rows, "event_round")
    return done.join(made.select("id", F.lit(True).alias("_new")), "id", "left").select("event_id", "round", F.when(F.col("_new").isNull(), F.col("id")).alias("id"))


# Pages and filters --------------------------------------------------------------


@_query("athletes_latest", f"""{_MINE},
l AS (SELECT master_id, ce.* FROM mine JOIN competition_entry ce ON ce.id = entry_id JOIN competition c ON c.id = ce.competition_id QUALIFY row_number() OVER (PARTITION BY master_id ORDER BY start_date DESC NULLS LAST, ce.id) = 1),
d AS (SELECT master_id, string_agg(DISTINCT division_name, ', ' ORDER BY division_name) AS divisions FROM mine JOIN sf USING (entry_id) GROUP BY master_id),
m AS (SELECT *, row_number() OVER w AS position FROM rf WHERE {_WON} WINDOW w AS (PARTITION BY athlete_name ORDER BY start_date DESC NULLS LAST, division_name, event_name, result_id)),
s AS (SELECT *, count(DISTINCT competition_id) OVER (PARTITION BY athlete_name ORDER BY position) AS seen FROM m),
n AS (SELECT athlete_name, count(*) AS recent, string_agg(event_name, '/' ORDER BY position) AS recent_events FROM s WHERE seen <= 5 GROUP BY athlete_name)
SELECT a.id AS athlete_id, a.name, l.region, l.team_name, d.divisions, coalesce(n.recent, -1) AS recent, recent_events FROM athlete a LEFT JOIN l ON l.master_id = a.id LEFT JOIN d ON d.master_id = a.id LEFT JOIN n ON n.athlete_name = a.name WHERE a.name LIKE '%선수1%'""")
def _(t):
    out = athletes.athletes_latest(t, "선수1")
    return out.select("athlete_id", "name", "region", "team_name", "divisions", F.coalesce(F.size("recent_medals"), F.lit(-1)).cast("long").alias("recent"), F.array_join(F.transform("recent_medals", lambda r: r["event_name"]), "/").alias("recent_events"))


@_query("athlete_detail", f"""{_MINE},
p AS (SELECT master_id, start_id, row_number() OVER (PARTITION BY master_id ORDER BY start_date DESC NULLS LAST, coalesce(event_number, 0) DESC, start_id) AS k FROM mine JOIN sf USING (entry_id) JOIN competition c ON c.id = sf.competition_id),
g AS (SELECT master_id, count(*) AS n, coalesce(string_agg(CAST(start_id AS VARCHAR), ',' ORDER BY k) FILTER (k BETWEEN 6 AND 10), '') AS starts FROM p GROUP BY master_id)
SELECT a.id AS athlete_id, coalesce(n, 0) AS total_elements, CAST(ceil(coalesce(n, 0) / 5) AS INT) AS total_pages, 10 >= coalesce(n, 0) AS last, starts FROM athlete a LEFT JOIN g ON g.master_id = a.id""")
def _(t):
    """The second page of five performances of every athlete."""
    out = athletes.detail(t, number=1, size=5)
    return out.select("athlete_id", "total_elements", "total_pages", "last", F.array_join(F.transform("content", lambda c: c["start_id"].cast("string")), ",").alias("starts"))


@_query("athlete_profile", f"""
, m AS (SELECT *, row_number() OVER w AS position FROM rf WHERE {_WON} AND athlete_name = '선수017' WINDOW w AS (ORDER BY start_date DESC NULLS LAST, division_name, event_name, result_id)),
s AS (SELECT *, count(DISTINCT competition_id) OVER (ORDER BY position) AS seen FROM m)
SELECT athlete_name AS name, gender, region, team_name, athlete_id, (SELECT count(*) FROM s WHERE seen <= 5) AS medals FROM competition_entry WHERE competition_id = {COMP} AND athlete_name = '선수017' ORDER BY id LIMIT 1""")
def _(t):
    return athletes.athlete_profile(t, COMP, "선수017").select("name", "gender", "region", "team_name", "athlete_id", F.greatest(F.coalesce(F.size("recent_medals"), F.lit(0)), F.lit(0)).cast("long").alias("medals"))


@_query("entries_with_masters", " SELECT start_id, a.name AS master_name, a.birth_year, tm.name AS master_team FROM sf JOIN competition_entry ce ON ce.id = sf.entry_id LEFT JOIN athlete a ON a.id = ce.athlete_id LEFT JOIN team tm ON tm.id = ce.team_id")
def _(t):
    return _pick(facts.entry_fact(t, masters=True), "start_id master_name birth_year master_team")


@_query("entries_with_team", " SELECT ind.id, ind.team_name, tm.name AS master_team, tm.region AS master_region FROM ind LEFT JOIN team tm ON tm.id = ind.team_id")
def _(t):
    return _pick(facts.individual_entries(t, with_team=True), "id team_name master_team master_region")


@_query("results_by_start", " SELECT start_id, round_id, result_id, ranking, record FROM rf")
def _(t):
    return _pick(rounds.results_by_start(t), "start_id round_id result_id ranking record")


@_query("rounds_with_results", " SELECT DISTINCT round_id FROM rf")
def _(t):
    return rounds.has_results(t)


@_query("event_detail", """, g AS (SELECT min(id) AS e FROM event)
SELECT r.id AS round_id, r.round, e.division_name, e.event_name, (SELECT count(*) FROM sf WHERE sf.round_id = r.id) AS entry_count, (SELECT count(*) FROM rf WHERE rf.round_id = r.id) AS result_count FROM event_round r JOIN event e ON e.id = r.event_id WHERE e.id = (SELECT e FROM g)""")
def _(t):
    first = t["event"].agg(F.min("id")).first()[0]
    return _pick(rounds.event_detail(t, first), "round_id round division_name event_name entry_count result_count")


@_query("events_with_podium", f""", m AS (SELECT * FROM rf WHERE {_WON})
SELECT e.id AS event_id, e.division_name, e.event_name, (SELECT min(event_number) FROM event_round r WHERE r.event_id = e.id) AS first_number, (SELECT arg_min(athlete_name, result_id) FROM m WHERE m.event_id = e.id AND ranking = 1) AS gold FROM event e""")
def _(t):
    return _pick(stats.events_with_podium(t), "event_id division_name event_name first_number gold")


@_query("alltime_nested", f""",
m AS (SELECT *, coalesce(edition, 0) AS ed FROM rf WHERE {_WON} AND {_SEEN}),
l AS (SELECT ed, arg_min(short_name, (coalesce(start_date, DATE '0001-01-01'), event_id, ranking, result_id)) AS label FROM m GROUP BY ed),
e AS (SELECT region, ed, any_value(label) AS label, {_MEDALS} FROM m JOIN l USING (ed) GROUP BY region, ed),
et AS (SELECT region, string_agg(ed || ':' || label || ':' || gold || '/' || silver || '/' || bronze, ' ' ORDER BY ed) AS by_competition FROM e GROUP BY region),
tt AS (SELECT region, string_agg(team_name || ':' || n, ' ' ORDER BY k) AS top_teams FROM (SELECT region, team_name, count(*) AS n, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, team_name) AS k FROM m WHERE trim(coalesce(team_name, '')) <> '' GROUP BY region, team_name) WHERE k <= 5 GROUP BY region),
ta AS (SELECT region, string_agg(athlete_name || ':' || n, ' ' ORDER BY k) AS top_athletes FROM (SELECT region, athlete_name, count(*) AS n, row_number() OVER (PARTITION BY region ORDER BY count(*), count(*) FILTER (ranking = 1) DESC, athlete_name) AS k FROM m GROUP BY region, athlete_name) WHERE k <= 5 GROUP BY region),
r AS (SELECT region, {_MEDALS}, count(*) AS total FROM m GROUP BY region)
SELECT region, gold, silver, bronze, total, by_competition, top_teams, top_athletes FROM r JOIN et USING (region) LEFT JOIN tt USING (region) JOIN ta USING (region)""")
def _(t):
    out = medals.alltime_region_standings(t)
    joined = lambda c, f: F.array_join(F.transform(c, f), " ").alias(c)
    medal = lambda e: F.concat_ws("/", e["gold"].cast("string"), e["silver"].cast("string"), e["bronze"].cast("string"))
    return out.select("region", "gold", "silver", "bronze", "total", joined("by_competition", lambda e: F.concat_ws(":", e["edition"].cast("string"), e["label"], medal(e))), joined("top_teams", lambda e: F.concat_ws(":", e["team_name"], e["medals"].cast("string"))), joined("top_athletes", lambda e: F.concat_ws(":", e["athlete_name"], e["total"].cast("string"))))


#: An entry's line in a history, and the order of lines.
_PAST = """, past AS (SELECT ce.athlete_id, year(c.start_date) AS y, c.name AS competition, ce.region, ce.team_name, string_agg(DISTINCT division_name, ', ' ORDER BY division_name) AS d, string_agg(DISTINCT event_name, ', ' ORDER BY event_name) AS e
  FROM competition_entry ce JOIN competition c ON c.id = ce.competition_id LEFT JOIN sf ON sf.entry_id = ce.id WHERE ce.athlete_id IS NOT NULL GROUP BY ce.id, ce.athlete_id, c.start_date, c.name, ce.region, ce.team_name),
h AS (SELECT athlete_id, string_agg(concat_ws('/', coalesce(CAST(y AS VARCHAR), '-'), competition, coalesce(region, '-'), coalesce(team_name, '-'), coalesce(d, '-'), coalesce(e, '-')), '; '
  ORDER BY y NULLS FIRST, competition, region NULLS FIRST, team_name NULLS FIRST, d NULLS FIRST, e NULLS FIRST) AS history FROM past GROUP BY athlete_id)"""


def _told(history):
    shown = lambda x: F.concat_ws("/", *[F.coalesce(x[c].cast("string"), F.lit("-")) for c in ("year", "competition", "region", "team_name", "division_names", "event_names")])
    return F.array_join(F.transform(history, shown), "; ")


@_query("candidate_histories", f"{_PAST} SELECT i.id AS entry_id, i.region, i.team_name, a.id AS athlete_id, a.birth_year, a.notes, h.history FROM ind i JOIN athlete a ON a.name = i.athlete_name AND a.gender = i.gender LEFT JOIN h ON h.athlete_id = a.id WHERE i.athlete_id IS NULL")
def _(t):
    """Every candidate with its nested history written out."""
    return identity.candidates(t, shown=_told).select("entry_id", "region", "team_name", "athlete_id", "birth_year", "notes", "history")


@_query("homonym_details", f"""{_PAST}, d AS (SELECT name, gender FROM athlete GROUP BY name, gender HAVING count(*) >= 2)
SELECT a.name, a.gender, a.id AS athlete_id, a.birth_year, a.notes, h.history FROM athlete a JOIN d ON d.name = a.name AND d.gender = a.gender LEFT JOIN h ON h.athlete_id = a.id""")
def _(t):
    """Every athlete of a shared name with its nested history written out."""
    return identity.homonyms(t).select("name", "gender", F.explode("candidates").alias("c")).select("name", "gender", "c.athlete_id", "c.birth_year", "c.notes", _told(F.col("c.history")).alias("history"))


@_query("homonym_histories", """, h AS (SELECT athlete_id, count(*) AS n FROM competition_entry WHERE athlete_id IS NOT NULL GROUP BY athlete_id), d AS (SELECT name, gender FROM athlete GROUP BY name, gender HAVING count(*) >= 2)
SELECT a.name, a.gender, a.id AS athlete_id, coalesce(h.n, -1) AS entries FROM athlete a JOIN d ON d.name = a.name AND d.gender = a.gender LEFT JOIN h ON h.athlete_id = a.id""")
def _(t):
    return identity.homonyms(t).select("name", "gender", F.explode("candidates").alias("c")).select("name", "gender", "c.athlete_id", F.coalesce(F.size("c.history"), F.lit(-1)).cast("long").alias("entries"))


@_query("mapping_page", " SELECT competition_id, count(*) AS total, count(athlete_id) AS mapped, count(*) - count(athlete_id) AS unmapped, count(*) FILTER (athlete_id IS NULL AND (athlete_name LIKE '%1%' OR lower(team_name) LIKE '%1%')) AS visible FROM ind GROUP BY ALL")
def _(t):
    return identity.mapping_counts(t, "1", unmapped_only=True)


@_query("mapping_list", " SELECT id, athlete_name, team_name FROM ind WHERE athlete_id IS NULL AND (athlete_name LIKE '%build%' OR lower(team_name) LIKE '%build%')")
def _(t):
    return _pick(identity.mapping_list(t, text="Build", unmapped_only=True), "id athlete_name team_name")


@_query("filtered_entries", f" SELECT id, region, gender FROM competition_entry WHERE gender = 'M' AND competition_id = {COMP}")
def _(t):
    return _pick(tables.filter_equal(t["competition_entry"], gender="M", competition_id=COMP, region=None), "id region gender")


@_query("listed_athletes", f"""{_MINE}, d AS (SELECT master_id, string_agg(DISTINCT division_name, ', ' ORDER BY division_name) AS divisions FROM mine JOIN sf USING (entry_id) GROUP BY master_id),
l AS (SELECT master_id, ce.* FROM mine JOIN competition_entry ce ON ce.id = entry_id JOIN competition c ON c.id = ce.competition_id QUALIFY row_number() OVER (PARTITION BY master_id ORDER BY start_date DESC NULLS LAST, ce.id) = 1)
SELECT a.id AS athlete_id FROM athlete a JOIN l ON l.master_id = a.id JOIN d ON d.master_id = a.id WHERE (a.name LIKE '%build%' OR lower(l.team_name) LIKE '%build%') AND a.gender = 'M' AND d.divisions LIKE '%중부%'""")
def _(t):
    listed = athletes.latest_profiles(t).join(athletes.entry_divisions(t), "athlete_id", "left")
    return athletes.filter_list(listed, "Build", gender="M", division="중부")[0].select("athlete_id")


@_query("listed_athlete_counts", f"""{_MINE}, l AS (SELECT master_id, ce.* FROM mine JOIN competition_entry ce ON ce.id = entry_id JOIN competition c ON c.id = ce.competition_id QUALIFY row_number() OVER (PARTITION BY master_id ORDER BY start_date DESC NULLS LAST, ce.id) = 1)
SELECT count(*) FILTER (a.name LIKE '%1%' OR coalesce(lower(l.team_name), '') LIKE '%1%') AS visible, count(*) AS total FROM athlete a LEFT JOIN l ON l.master_id = a.id""")
def _(t):
    return athletes.filter_list(athletes.latest_profiles(t), "1")[1]


@_query("teams_of_region", " SELECT id, name, region FROM team WHERE region = (SELECT min(region) FROM team)")
def _(t):
    return _pick(athletes.team_search(t, t["team"].agg(F.min("region")).first()[0]), "id name region")


@_query("all_teams", " SELECT id, name, region FROM team")
def _(t):
    return _pick(athletes.team_search(t), "id name region")


@_query("filtered_standings", f""", m AS (SELECT *, coalesce(region, '') AS rg FROM rf WHERE {_WON} AND trim(coalesce(team_name, '')) <> '')
SELECT competition_id, team_name, rg AS region, count(*) AS total FROM m GROUP BY ALL HAVING count(*) FILTER (division_name LIKE '%중부%') > 0""")
def _(t):
    return _pick(stats.team_filter(medals.team_standings(t), division="중부"), "competition_id team_name region total")


@_query("series", " SELECT id, short_name, edition FROM competition WHERE short_name IN ('봄 1995', '가을 1996')")
def _(t):
    return _pick(stats.series(t, ["봄 1995", "가을 1996"]), "id short_name edition")


@_query("third_page", " SELECT id, name, (SELECT count(*) FROM athlete) AS total_elements FROM athlete ORDER BY id LIMIT 20 OFFSET 40")
def _(t):
    part, about = tables.page(t["athlete"].orderBy("id"), 2, 20)
    return part.select("id", "name", F.lit(about["total_elements"]).cast("long").alias("total_elements"))


@_query("page_of_a_stored_order", " SELECT id, name, CAST(row_number() OVER (ORDER BY name, id) AS INT) AS position, (SELECT count(*) FROM athlete) AS total_elements FROM athlete QUALIFY position BETWEEN 1001 AND 1020")
def _(t):
    """A deep page by name: one or two ranges of the stored order are read."""
    spark = t["athlete"].sparkSession
    pages = paging.Pages(spark, f"{tables.shared_dir(spark)}/pages-{uuid.uuid4().hex}", ["name", "id"]).build(t["athlete"], 16)
    part, about = pages.page(50, 20)
    return part.select("id", "name", "position", F.lit(about["total_elements"]).cast("long").alias("total_elements"))


def _indexed(t, table: str, column: str) -> names.NameIndex:
    spark = t[table].sparkSession
    return names.NameIndex(spark, f"{tables.shared_dir(spark)}/names-{uuid.uuid4().hex}").build(t[table], "id", column)


@_query("athlete_search_by_index", " SELECT id, name, gender, birth_year, notes FROM athlete WHERE name LIKE '%수17%' AND notes LIKE '%NATION%'")
def _(t):
    return _pick(athletes.search(t, "수17", notes="NATION", names=_indexed(t, "athlete", "name")), "id name gender birth_year notes")


@_query("entry_suggest_by_index", """ SELECT event_id, athlete_name, team_name, region, gender, bib_number FROM sf WHERE athlete_name LIKE '%수12%'
QUALIFY row_number() OVER (PARTITION BY event_id, athlete_name, coalesce(team_name, '') ORDER BY heat_id, bib_number, start_id) = 1""")
def _(t):
    return athletes.suggest_entries(t, q="수12", names=_indexed(t, "competition_entry", "athlete_name"))


@_query("name_grams", """, g AS (SELECT DISTINCT id, name[i:i + 1] AS gram FROM (SELECT id, name, unnest(range(1, length(name))) AS i FROM athlete)) SELECT gram, count(*) AS names FROM g GROUP BY gram""")
def _(t):
    """How many names hold each gram, as the index counts them."""
    index = _indexed(t, "athlete", "name")
    return index.spark.read.parquet(f"{index.path}/grams").select("gram", "names")


@_query("lookups", f" SELECT (SELECT name FROM competition WHERE id = {COMP}) AS name, EXISTS (SELECT 1 FROM event) AS has_events, false AS has_others")
def _(t):
    row = tables.require_one(t["competition"], COMP)
    return t["competition"].sparkSession.createDataFrame([(row["name"], tables.exists(t["event"]), tables.exists(t["event"].where("id < 0")))], "name string, has_events boolean, has_others boolean")


@_query("competition_json", """ SELECT id, '{"id":' || id || ',"edition":' || coalesce(CAST(edition AS VARCHAR), 'null') || '}' AS json FROM competition""")
def _(t):
    rows = tables.to_json(t["competition"].select("id", "edition"))
    return rows.select(F.get_json_object("json", "$.id").cast("long").alias("id"), "json")


@_query("saved_archive", " " + " UNION ALL ".join(f"SELECT '{n}' AS tab, count(*) AS n, CAST(sum(id % 1000003) AS BIGINT) AS ids FROM {n}" for n in ("competition", "event", "event_round", "event_heat", "heat_entry", "event_result", "competition_entry", "athlete", "team", "schedule_entry")))
def _(t):
    """All tables written below a folder and loaded from there."""
    spark = t["event"].sparkSession
    path = f"{tables.shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    tables.save(t, path)
    out = None
    for name, df in tables.load(spark, path).items():
        one = conform(df, name).agg(F.count("*").alias("n"), F.sum(F.col("id") % 1_000_003).alias("ids")).select(F.lit(name).alias("tab"), "n", "ids")
        out = one if out is None else out.union(one)
    return out


# Column functions ---------------------------------------------------------------


@_query("fn_gender_and_heat", """ SELECT DISTINCT h.id, CASE WHEN e.division_name LIKE '여%' OR e.division_name LIKE '%여자%' THEN 'F' ELSE 'M' END AS sex, CASE WHEN h.id % 4 IN (0, 1) THEN 0 ELSE CAST(right(CAST(h.id AS VARCHAR), 1) AS INT) END AS heat
FROM event_heat h JOIN event_round r ON r.id = h.event_round_id JOIN event e ON e.id = r.event_id""")
def _(t):
    code = F.when(F.col("heat_id") % 4 == 0, "x9000x3").when(F.col("heat_id") % 4 == 1, "").otherwise(F.concat(F.lit("rh"), F.right(_string("heat_id"), F.lit(1))))
    return facts.heats(t).select(F.col("heat_id").alias("id"), x.infer_gender(F.col("division_name")).alias("sex"), x.heat_from_youth_code(code).alias("heat"))


@_query("fn_marks", """ SELECT id, new_record AS mark, CASE WHEN new_record IN ('한국신', '대회신') THEN new_record END AS mark_two, CASE id % 6 WHEN 0 THEN '경고 제외' WHEN 1 THEN '실격' WHEN 2 THEN '미완주' WHEN 3 THEN '미출전' WHEN 4 THEN NULL ELSE 'XX' END AS note FROM event_result""")
def _(t):
    text = F.concat(F.lit("기록 "), F.coalesce("new_record", F.lit("")), F.lit(" 끝"))
    code = F.element_at(F.array(*[F.lit(c) for c in ("EL", "DSQ", "DNF", "DNS", "3", "XX")]), (F.col("id") % 6 + 1).cast("int"))
    return t["event_result"].select("id", x.record_mark(text).alias("mark"), x.record_mark_two(text).alias("mark_two"), x.with_rank_note(F.when(F.col("id") % 6 == 0, "경고"), code).alias("note"))


@_query("fn_affiliation", " SELECT DISTINCT coalesce(nullif(trim(region), ''), 'x') AS region, team_name AS team, grade, coalesce(nullif(trim(region), ''), 'x') || ' ' || team_name AS note, nullif(trim(region), '') AS shown FROM competition_entry")
def _(t):
    region = F.coalesce(F.nullif(F.trim("region"), F.lit("")), F.lit("x"))
    info = F.concat(F.lit("  "), region, F.lit(" "), F.col("team_name"), _string("grade"), F.lit(" "))
    a = x.affiliation(info)
    return t["competition_entry"].select(a["region"].alias("region"), a["team"].alias("team"), a["grade"].alias("grade"), x.affiliation_note(info).alias("note"), x.blank_to_null(F.col("region")).alias("shown")).distinct()


@_query("fn_lenient_int", " SELECT id, CASE WHEN id % 3 = 0 THEN CAST(birth_year AS INT) END AS n FROM athlete")
def _(t):
    given = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" "), _string("birth_year"), F.lit("\t"))).when(F.col("id") % 3 == 1, "12a")
    return t["athlete"].select("id", x.lenient_int(given).alias("n"))


