"""Registered queries of the core library, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import exprs as x
from podium.operators import athletes, facts, identity, medals, mutate, registration, rounds, schedule, stats
from podium.plans import star
from podium.sources import listings
from podium.tables import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_MEDALS = "count(*) FILTER (ranking = 1) AS gold, count(*) FILTER (ranking = 2) AS silver, count(*) FILTER (ranking = 3) AS bronze"
_WON = "round = '결승' AND ranking IN (1, 2, 3)"
_SEEN = "trim(coalesce(region, '')) <> ''"


def _query(name: str, sql: str):
    """Registers a function from catalogue to DataFrame, with the rest of its SQL after the common tables."""

    def register(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(star.tables(spark, sf_dir))
        ORACLE_SQL[name] = f"{star.SQL}{sql}"
        return f

    return register


def _pick(df: DataFrame, columns: str) -> DataFrame:
    return df.select(*columns.split())


@_query("region_standings", f""",
w AS (SELECT competition_id, region, {_MEDALS}, count(*) FILTER (ranking <= 3) AS total,
  CAST(sum(CASE WHEN division_name LIKE '%일반(B조)%' THEN 0 ELSE CASE ranking WHEN 1 THEN 7 WHEN 2 THEN 5 WHEN 3 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END END) AS BIGINT) AS score
  FROM rf WHERE round = '결승' AND ranking BETWEEN 1 AND 6 AND {_SEEN} GROUP BY ALL),
b AS (SELECT entry_id, bool_or(division_name LIKE '%일반(B조)%') AS in_b FROM sf GROUP BY ALL),
p AS (SELECT competition_id, region, count(*) FILTER (NOT in_b) AS athletes, count(*) FILTER (in_b) AS athletes_b_group FROM ind JOIN b ON b.entry_id = ind.id WHERE {_SEEN} GROUP BY ALL)
SELECT competition_id, region, coalesce(gold, 0) AS gold, coalesce(silver, 0) AS silver, coalesce(bronze, 0) AS bronze, coalesce(total, 0) AS total, coalesce(score, 0) AS score,
  coalesce(athletes, 0) AS athletes, coalesce(athletes_b_group, 0) AS athletes_b_group FROM w FULL JOIN p USING (competition_id, region)""")
def _(t):
    return medals.region_standings(t)


@_query("podium_by_event", f""",
m AS (SELECT * FROM rf WHERE {_WON})
SELECT e.id AS event_id, e.competition_id, {', '.join(f'''(SELECT arg_min(athlete_name, result_id) FROM m WHERE m.event_id = e.id AND ranking = {k}) AS {n},
  (SELECT arg_min(athlete_id, result_id) FROM m WHERE m.event_id = e.id AND ranking = {k} AND athlete_id IS NOT NULL) AS {n}_id''' for k, n in ((1, 'gold'), (2, 'silver'), (3, 'bronze')))} FROM event e""")
def _(t):
    return medals.podium_by_event(t)


@_query("team_standings", f""",
m AS (SELECT *, coalesce(region, '') AS rg FROM rf WHERE {_WON} AND trim(coalesce(team_name, '')) <> ''),
d AS (SELECT competition_id, team_name, rg, division_name, min((event_id, ranking, result_id)) AS place FROM m GROUP BY ALL),
dd AS (SELECT competition_id, team_name, rg, string_agg(division_name, ', ' ORDER BY place) AS divisions FROM d GROUP BY ALL)
SELECT competition_id, team_name, rg AS region, {_MEDALS}, count(*) AS total, any_value(divisions) AS divisions,
  string_agg(ranking || '/' || athlete_name || '/' || event_name, '; ' ORDER BY ranking, event_id, result_id) AS awards FROM m JOIN dd USING (competition_id, team_name, rg) GROUP BY competition_id, team_name, rg""")
def _(t):
    return medals.team_standings(t, nested=False)


@_query("alltime_region", f" SELECT region, {_MEDALS}, count(*) AS total FROM rf WHERE {_WON} AND {_SEEN} GROUP BY region")
def _(t):
    return medals.alltime_regions(t)


@_query("alltime_by_edition", f""",
m AS (SELECT *, coalesce(edition, 0) AS ed FROM rf WHERE {_WON} AND {_SEEN}),
l AS (SELECT ed, arg_min(short_name, (coalesce(start_date, DATE '0001-01-01'), event_id, ranking, result_id)) AS label FROM m GROUP BY ed)
SELECT region, ed AS edition, any_value(label) AS label, {_MEDALS} FROM m JOIN l USING (ed) GROUP BY region, ed""")
def _(t):
    return medals.alltime_by_edition(t)


@_query("top_teams", f""" SELECT region, team_name, count(*) AS medals, CAST(row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, team_name) AS INT) AS rank FROM rf
WHERE {_WON} AND {_SEEN} AND trim(coalesce(team_name, '')) <> '' GROUP BY region, team_name QUALIFY rank <= 5""")
def _(t):
    return medals.top_teams(t)


for _order in ("literal", "intended"):

    @_query(f"top_athletes_{_order}", f""" SELECT region, athlete_name, {_MEDALS}, count(*) AS total,
    CAST(row_number() OVER (PARTITION BY region ORDER BY count(*) {'ASC' if _order == 'literal' else 'DESC'}, count(*) FILTER (ranking = 1) DESC, athlete_name) AS INT) AS rank
    FROM rf WHERE {_WON} AND {_SEEN} GROUP BY region, athlete_name QUALIFY rank <= 5""")
    def _(t, order=_order):
        return medals.top_athletes(t, order=order)


@_query("alltime_summary", f" SELECT count(DISTINCT entry_competition_id) AS competitions, count(DISTINCT event_id) AS events, count(*) AS medals, count(DISTINCT region) FILTER ({_SEEN}) AS regions FROM rf WHERE {_WON}")
def _(t):
    return medals.alltime_summary(t)


@_query("athlete_medals", f" SELECT athlete_name, {_MEDALS}, count(*) AS total FROM rf WHERE {_WON} GROUP BY athlete_name")
def _(t):
    return medals.athlete_medals(t)


@_query("athlete_medals_by_id", f" SELECT athlete_id, {_MEDALS}, count(*) AS total FROM rf WHERE {_WON} GROUP BY athlete_id")
def _(t):
    return medals.athlete_medals(t, by_id=True)


@_query("medal_history", f" SELECT athlete_name, competition_id, division_name, event_name, ranking, result_id FROM rf WHERE {_WON}")
def _(t):
    return _pick(medals.medal_history(t), "athlete_name competition_id division_name event_name ranking result_id")


@_query("participant_totals", f""",
p AS (SELECT competition_id, count(*) FILTER (gender = 'M') AS male, count(*) FILTER (gender IS DISTINCT FROM 'M') AS female, count(DISTINCT region) FILTER ({_SEEN}) AS regions FROM ind GROUP BY ALL),
e AS (SELECT competition_id, count(*) AS events FROM event GROUP BY ALL)
SELECT competition_id, coalesce(male, 0) AS male, coalesce(female, 0) AS female, coalesce(events, 0) AS events, coalesce(regions, 0) AS regions FROM e FULL JOIN p USING (competition_id)""")
def _(t):
    return stats.participant_totals(t)


@_query("division_breakdown", """,
h AS (SELECT DISTINCT event_id, round_id, event_number FROM sf WHERE NOT team_event),
f AS (SELECT round_id FROM h QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY event_number NULLS FIRST, round_id) = 1),
o AS (SELECT DISTINCT competition_id, entry_id, gender, substr(division_name, 2) AS d FROM sf WHERE round_id IN (SELECT round_id FROM f))
SELECT competition_id, CASE WHEN d LIKE '초부%' THEN '초등부' || substr(d, 3) WHEN d LIKE '중부%' THEN '중등부' || substr(d, 3) WHEN d LIKE '고부%' THEN '고등부' || substr(d, 3) WHEN d LIKE '대부%' THEN '대학부' || substr(d, 3) ELSE '일반부' || substr(d, 3) END AS division,
  count(*) FILTER (gender = 'M') AS male, count(*) FILTER (gender <> 'M') AS female, count(*) AS total FROM o GROUP BY ALL""")
def _(t):
    return stats.division_breakdown(t)


@_query("new_records", """,
n AS (SELECT *, CAST(coalesce(nullif(replace(regexp_extract(event_name, '([0-9][0-9,]*)m', 1), ',', ''), ''), '99999') AS INT) AS metres,
  CASE WHEN division_name LIKE '%일반(B조)%' THEN 16 WHEN division_name LIKE '_초부%' THEN 12 WHEN division_name LIKE '_중부%' THEN 20 WHEN division_name LIKE '_고부%' THEN 30 WHEN division_name LIKE '_대부%' THEN 40 ELSE 50 END AS dv FROM rf WHERE new_record IS NOT NULL)
SELECT competition_id, CAST(row_number() OVER (PARTITION BY competition_id ORDER BY list_position(['세계신', '한국신', '부별신', '대회신'], new_record), dv, CASE WHEN division_name LIKE '여%' THEN 0 ELSE 1 END, metres, record NULLS LAST, event_id, result_id) AS INT) AS place,
  new_record, division_name, event_name, round, athlete_name, region, team_name, record, result_id FROM n""")
def _(t):
    return stats.new_records(t)


@_query("round_status", """,
c AS (SELECT sf.round_id, count(*) AS e, count(r.id) AS r FROM sf LEFT JOIN event_result r ON r.heat_entry_id = sf.start_id GROUP BY ALL)
SELECT er.event_id, er.id AS round_id, er.round, er.event_number, CASE WHEN r > 0 AND r >= e THEN '완료' WHEN r > 0 THEN '일부' WHEN e > 0 THEN '엔트리만' ELSE '없음' END AS status, coalesce(e, 0) AS entry_count, coalesce(r, 0) AS result_count
FROM event_round er LEFT JOIN c ON c.round_id = er.id""")
def _(t):
    return rounds.round_status(t)


@_query("round_detail", """,
s AS (SELECT sf.*, r.id AS result_id, r.ranking, r.record, bool_or(r.id IS NOT NULL) OVER (PARTITION BY heat_id) AS hh, bool_or(r.id IS NOT NULL) OVER (PARTITION BY round_id) AS rh FROM sf LEFT JOIN event_result r ON r.heat_entry_id = sf.start_id),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY heat_id ORDER BY CASE WHEN hh THEN coalesce(ranking, 2147483647) ELSE bib_number END, bib_number, start_id) AS INT) AS position FROM s)
SELECT round_id, heat_id, heat_number, position, bib_number, athlete_name, ranking, record FROM o WHERE NOT rh OR result_id IS NOT NULL""")
def _(t):
    return _pick(rounds.round_rows(t), "round_id heat_id heat_number position bib_number athlete_name ranking record")


_RERANK = """ SELECT result_id, round_id, record, ranking AS old_ranking, CASE WHEN record IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY round_id ORDER BY {} NULLS LAST, heat_id, ranking NULLS LAST, result_id) AS INT) END AS new_ranking FROM rf WHERE event_name LIKE '%DTT%'"""


@_query("dtt_rerank", _RERANK.format("record"))
def _(t):
    return rounds.rerank_time_trials(t)


@_query("dtt_rerank_by_time", _RERANK.format("CASE WHEN record LIKE '%:%' THEN CAST(split_part(record, ':', 1) AS BIGINT) * 60000 ELSE 0 END + CAST(round(CAST(split_part(record, ':', -1) AS DOUBLE) * 1000) AS BIGINT)"))
def _(t):
    return rounds.rerank_time_trials(t, by="time")


_MINE = """,
byid AS (SELECT a.id AS master_id, ce.id AS entry_id FROM athlete a JOIN competition_entry ce ON ce.athlete_id = a.id),
mine AS (SELECT * FROM byid UNION ALL SELECT a.id, ce.id FROM athlete a JOIN competition_entry ce ON ce.athlete_name = a.name AND ce.gender = a.gender WHERE a.id NOT IN (SELECT master_id FROM byid))"""


@_query("latest_profile", f"""{_MINE},
l AS (SELECT master_id, ce.* FROM mine JOIN competition_entry ce ON ce.id = entry_id JOIN competition c ON c.id = ce.competition_id QUALIFY row_number() OVER (PARTITION BY master_id ORDER BY start_date DESC NULLS LAST, ce.id) = 1)
SELECT a.id AS athlete_id, a.name, a.gender, a.birth_year, l.region, l.team_name, l.grade, l.id AS latest_entry_id FROM athlete a LEFT JOIN l ON l.master_id = a.id""")
def _(t):
    return athletes.latest_profiles(t)


@_query("athlete_divisions", f"""{_MINE}
SELECT master_id AS athlete_id, string_agg(DISTINCT division_name, ', ' ORDER BY division_name) AS divisions FROM mine JOIN sf USING (entry_id) GROUP BY master_id""")
def _(t):
    return athletes.entry_divisions(t)


_LABEL = "coalesce('제' || edition || '회 ', '') || short_name AS label"


@_query("recent_medals", f""",
m AS (SELECT *, row_number() OVER w AS position FROM rf WHERE {_WON} WINDOW w AS (PARTITION BY athlete_name ORDER BY start_date DESC NULLS LAST, division_name, event_name, result_id)),
s AS (SELECT *, count(DISTINCT competition_id) OVER (PARTITION BY athlete_name ORDER BY position) AS seen FROM m)
SELECT athlete_name, CAST(position AS INT) AS position, competition_id, {_LABEL}, division_name, event_name, ranking, record, result_id FROM s WHERE seen <= 5""")
def _(t):
    return athletes.recent_medals(t)


@_query("performances", f"""{_MINE}
SELECT master_id AS athlete_id, sf.competition_id, {_LABEL}, start_date, division_name, event_name, round, coalesce(event_number, 0) AS event_number, r.ranking, r.record, start_id
FROM mine JOIN sf USING (entry_id) JOIN competition c ON c.id = sf.competition_id LEFT JOIN event_result r ON r.heat_entry_id = start_id""")
def _(t):
    return _pick(athletes.performances(t, by_start=True), "athlete_id competition_id label start_date division_name event_name round event_number ranking record start_id")


@_query("individual_entries", " SELECT id, competition_id, athlete_name, team_name, athlete_id FROM ind")
def _(t):
    return _pick(facts.individual_entries(t), "id competition_id athlete_name team_name athlete_id")


@_query("unmapped_entries", " SELECT id, competition_id, athlete_name, team_name FROM ind WHERE athlete_id IS NULL")
def _(t):
    return _pick(facts.individual_entries(t, unmapped=True), "id competition_id athlete_name team_name")


@_query("events_by_first_number", " SELECT e.id, e.competition_id, e.division_name, e.event_name, min(r.event_number) AS first_number FROM event e LEFT JOIN event_round r ON r.event_id = e.id GROUP BY ALL")
def _(t):
    return _pick(facts.events_by_first_number(t), "id competition_id division_name event_name first_number")


@_query("scoring_results", " SELECT result_id, event_id, ranking FROM rf WHERE round = '결승' AND ranking BETWEEN 1 AND 6")
def _(t):
    return _pick(facts.scoring(t), "result_id event_id ranking")


@_query("entry_suggest", """ SELECT event_id, athlete_name, team_name, region, gender, bib_number FROM sf WHERE athlete_name LIKE '%1%'
QUALIFY row_number() OVER (PARTITION BY event_id, athlete_name, coalesce(team_name, '') ORDER BY heat_id, bib_number, start_id) = 1""")
def _(t):
    return athletes.suggest_entries(t, q="1")


@_query("athlete_search", " SELECT id, name, gender, birth_year, notes FROM athlete WHERE name LIKE '%선수1%' AND birth_year = 1983 AND notes LIKE '%NATION%'")
def _(t):
    return _pick(athletes.search(t, "선수1", 1983, "NATION"), "id name gender birth_year notes")


@_query("homonyms", """ SELECT name, gender, count(*) AS athletes, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM athlete GROUP BY name, gender HAVING count(*) >= 2""")
def _(t):
    return identity.homonyms(t).select("name", "gender", "athletes", F.array_join(F.transform("candidates", lambda c: c["athlete_id"].cast("string")), ",").alias("ids"))


@_query("team_candidates", """ SELECT n.team_name, t.id AS team_id, t.name AS candidate, t.region FROM (SELECT DISTINCT team_name FROM competition_entry WHERE team_id IS NULL AND trim(team_name) <> '') n
JOIN team t ON contains(t.name, n.team_name) OR contains(n.team_name, t.name)""")
def _(t):
    return identity.team_candidates(t)


_CATEGORIES = "cat AS (SELECT entry_id, list_sort(list(DISTINCT CASE WHEN division_name LIKE '%초%' THEN '초등' WHEN division_name LIKE '%중%' THEN '중등' WHEN division_name LIKE '%고%' THEN '고등' ELSE '대일' END)) AS c FROM sf GROUP BY entry_id)"


@_query("entry_categories", f", {_CATEGORIES} SELECT entry_id, array_to_string(c, '/') AS categories FROM cat")
def _(t):
    return identity.categories(t).select("entry_id", F.array_join("categories", "/").alias("categories"))


@_query("auto_match", f""", {_CATEGORIES},
o AS (SELECT i.*, c FROM ind i JOIN cat ON cat.entry_id = i.id WHERE athlete_id IS NULL),
k AS (SELECT DISTINCT ce.athlete_id, a.name, a.gender, ce.team_name, c AS c2 FROM competition_entry ce JOIN cat ON cat.entry_id = ce.id JOIN athlete a ON a.id = ce.athlete_id),
g AS (SELECT o.athlete_name, o.gender, o.team_name, o.c, count(DISTINCT k.athlete_id) AS n, min(k.athlete_id) AS m FROM (SELECT DISTINCT athlete_name, gender, team_name, c FROM o) o
  JOIN k ON k.name = o.athlete_name AND k.gender = o.gender AND k.team_name = o.team_name AND list_has_any(o.c, k.c2) GROUP BY ALL HAVING n = 1)
SELECT o.id AS entry_id, m AS athlete_id FROM o JOIN g ON g.athlete_name = o.athlete_name AND g.gender = o.gender AND g.team_name = o.team_name AND g.c = o.c""")
def _(t):
    return identity.auto_match(t)


@_query("auto_match_teams", f""" SELECT ce.id, coalesce(ce.team_id, CASE WHEN {_SEEN.replace('region', 'ce.region')} THEN (SELECT min(t.id) FROM team t WHERE t.name = ce.team_name AND t.region = ce.region) END) AS team_id FROM competition_entry ce""")
def _(t):
    return _pick(registration.auto_match_teams(t)[0]["competition_entry"], "id team_id")


@_query("mapping_counts", " SELECT competition_id, count(*) AS total, count(athlete_id) AS mapped, count(*) - count(athlete_id) AS unmapped FROM ind GROUP BY ALL")
def _(t):
    return _pick(identity.mapping_counts(t), "competition_id total mapped unmapped")


@_query("candidates", " SELECT i.id AS entry_id, a.id AS athlete_id FROM ind i JOIN athlete a ON a.name = i.athlete_name AND a.gender = i.gender WHERE i.athlete_id IS NULL")
def _(t):
    return _pick(identity.candidates(t), "entry_id athlete_id")


@_query("entry_history", """ SELECT ce.id AS entry_id, year(c.start_date) AS year, string_agg(DISTINCT division_name, ', ' ORDER BY division_name) AS division_names, string_agg(DISTINCT event_name, ', ' ORDER BY event_name) AS event_names
FROM competition_entry ce JOIN competition c ON c.id = ce.competition_id LEFT JOIN sf ON sf.entry_id = ce.id GROUP BY ce.id, c.start_date""")
def _(t):
    return identity.entry_history(t).select("entry_id", F.col("year").cast("long"), "division_names", "event_names")


@_query("upsert_results", """ SELECT he.id AS heat_entry_id, CASE WHEN he.id % 5 = 0 THEN 9 ELSE r.ranking END AS ranking, CASE WHEN he.id % 5 = 0 THEN '1:00.000' ELSE r.record END AS record, CASE WHEN he.id % 5 = 0 THEN NULL ELSE r.note END AS note
FROM heat_entry he LEFT JOIN event_result r ON r.heat_entry_id = he.id WHERE r.id IS NOT NULL OR he.id % 5 = 0""")
def _(t):
    null = F.lit(None).cast("string")
    rows = t["heat_entry"].where("id % 5 = 0").select(F.col("id").alias("heat_entry_id"), F.lit(9).alias("ranking"), F.lit("1:00.000").alias("record"), null.alias("new_record"), null.alias("qualification"), null.alias("note"))
    return _pick(mutate.upsert_results(t, rows)["event_result"], "heat_entry_id ranking record note")


@_query("cascade_delete_event", """,
g AS (SELECT id FROM event WHERE id % 3 = 0), r AS (SELECT id FROM event_round WHERE event_id IN (SELECT id FROM g)), h AS (SELECT id FROM event_heat WHERE event_round_id IN (SELECT id FROM r)), s AS (SELECT id FROM heat_entry WHERE heat_id IN (SELECT id FROM h))
SELECT 'event' AS tab, count(*) AS n FROM event WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'event_round', count(*) FROM event_round WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT 'event_heat', count(*) FROM event_heat WHERE id NOT IN (SELECT id FROM h)
UNION ALL SELECT 'heat_entry', count(*) FROM heat_entry WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT 'event_result', count(*) FROM event_result WHERE heat_entry_id NOT IN (SELECT id FROM s) UNION ALL SELECT 'competition_entry', count(*) FROM competition_entry""")
def _(t):
    left = mutate.delete_cascade(t, "event", t["event"].where("id % 3 = 0"))
    out = None
    for name in ("event", "event_round", "event_heat", "heat_entry", "event_result", "competition_entry"):
        one = left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
        out = one if out is None else out.union(one)
    return out


@_query("merge_athletes", """ SELECT id, CASE WHEN athlete_id % 10 = 3 THEN athlete_id - 1 ELSE athlete_id END AS athlete_id FROM competition_entry""")
def _(t):
    pairs = t["athlete"].where("id % 10 = 3").select(F.col("id").alias("loser_id"), (F.col("id") - 1).alias("keeper_id"))
    return _pick(mutate.merge_athletes(t, pairs)["competition_entry"], "id athlete_id")


@_query("find_or_create_teams", """ SELECT name, region FROM team UNION SELECT DISTINCT segment || '-2', n_name FROM people""")
def _(t):
    rows = t["team"].select(F.concat("name", F.lit("-2")).alias("name"), "region").unionByName(t["team"].select("name", "region"))
    return mutate.find_or_create(t["team"], rows, "team")[0].select("name", "region")


@_query("mark_records", """,
w AS (SELECT DISTINCT competition_id, division_name, replace(event_name, ',', '') AS ev, round, athlete_name, record FROM rf WHERE new_record IS NOT NULL AND record IS NOT NULL AND athlete_name IS NOT NULL AND event_name NOT LIKE '%계주%')
SELECT rf.result_id, CASE WHEN w.record IS NOT NULL THEN '대회신' ELSE rf.new_record END AS new_record FROM rf LEFT JOIN w ON w.competition_id = rf.competition_id AND w.division_name = rf.division_name AND w.ev = replace(rf.event_name, ',', '') AND w.round = rf.round AND w.athlete_name = rf.athlete_name AND w.record = rf.record""")
def _(t):
    """The list names every marked result, with a heat at the end of its round; results that share all it says are marked too."""
    rows = facts.result_fact(t).where("new_record IS NOT NULL AND record IS NOT NULL").select("competition_id", F.col("division_name").alias("division"), F.col("event_name").alias("event"), F.concat("round", F.lit("2조")).alias("round"), F.col("athlete_name").alias("athlete"), "record")
    return listings.mark_records(t, rows)[0]["event_result"].select(F.col("id").alias("result_id"), "new_record")


@_query("not_loaded", " SELECT DISTINCT competition_id, division_name AS division, event_name AS event, '준준결승' AS round FROM event e WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.event_id = e.id AND rf.round = '준준결승')")
def _(t):
    return listings.not_loaded(t, t["event"].select("competition_id", F.col("division_name").alias("division"), F.col("event_name").alias("event"), F.lit("준준결승").alias("round")).distinct())


@_query("schedule_days", """ SELECT competition_id, day_number, min(day_date) AS day_date, count(*) AS entries,
'제' || day_number || '일차' || coalesce(' (' || month(min(day_date)) || '/' || day(min(day_date)) || ' ' || ['월', '화', '수', '목', '금', '토', '일'][isodow(min(day_date))] || ')', '') AS label FROM schedule_entry GROUP BY competition_id, day_number""")
def _(t):
    return schedule.schedule(t).select("competition_id", "day_number", "day_date", F.size("entries").cast("long").alias("entries"), "label")


@_query("competitions", f" SELECT id, name, {_LABEL.replace(' AS label', '')} AS label, start_date, row_number() OVER (ORDER BY start_date DESC NULLS LAST, id) AS place FROM competition")
def _(t):
    from pyspark.sql.window import Window

    # a list of competitions is as short as the calendar
    listed = stats.competitions(t).select("id", "name", x.competition_label(F.col("edition"), F.col("short_name"), F.col("name")).alias("label"), "start_date")
    return listed.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("start_date"), "id")).cast("long"))


@_query("edition_map", " SELECT edition, max(id) AS competition_id FROM competition WHERE edition IS NOT NULL GROUP BY edition")
def _(t):
    return stats.edition_map(t)


@_query("best_records", """ SELECT athlete_name, event_name, min(CASE WHEN record LIKE '%:%' THEN CAST(split_part(record, ':', 1) AS BIGINT) * 60000 ELSE 0 END + CAST(round(CAST(split_part(record, ':', -1) AS DOUBLE) * 1000) AS BIGINT)) AS best_ms, count(*) AS timed
FROM rf WHERE record IS NOT NULL GROUP BY ALL""")
def _(t):
    return athletes.best_records(t)


@_query("region_facet", f" SELECT DISTINCT region FROM competition_entry WHERE {_SEEN}")
def _(t):
    from podium.tables import facets

    return facets(t["competition_entry"], "region")


@_query("division_facet", f" SELECT DISTINCT division_name AS division FROM rf WHERE {_WON} AND trim(coalesce(team_name, '')) <> ''")
def _(t):
    return stats.division_facets(medals.team_standings(t, nested=False))


@_query("fn_division", """ SELECT DISTINCT division_name, CASE substr(division_name, 2, 2) WHEN '초부' THEN '초등부' WHEN '중부' THEN '중등부' WHEN '고부' THEN '고등부' WHEN '대부' THEN '대학부' ELSE '일반부' END || substr(division_name, 4) AS report,
CASE WHEN division_name LIKE '%초%' THEN '초등' WHEN division_name LIKE '%중%' THEN '중등' WHEN division_name LIKE '%고%' THEN '고등' ELSE '대일' END AS category, CASE WHEN division_name LIKE '여%' THEN 0 ELSE 1 END AS gender_rank FROM event""")
def _(t):
    d = F.col("division_name")
    return t["event"].select(d, x.report_division(d).alias("report"), x.division_category(d).alias("category"), x.gender_rank(d).alias("gender_rank")).distinct()


@_query("fn_distance", " SELECT DISTINCT event_name, CAST(coalesce(nullif(replace(regexp_extract(event_name, '([0-9][0-9,]*)m', 1), ',', ''), ''), '99999') AS INT) AS metres, replace(event_name, ',', '') AS plain, event_name LIKE '%계주%' AS relay FROM event")
def _(t):
    e = F.col("event_name")
    return t["event"].select(e, x.distance(e).alias("metres"), x.plain_event(e).alias("plain"), x.is_team_event(e).alias("relay")).distinct()


@_query("fn_heat_number", """ SELECT id, CASE WHEN heat_number = 0 THEN 0 WHEN id % 2 = 0 THEN heat_number ELSE CAST(right(CAST(id AS VARCHAR), 1) AS INT) END AS heat FROM (SELECT h.id, h.heat_number FROM event_heat h)""")
def _(t):
    code = F.when(F.col("heat_number") == 0, F.concat(F.lit("309"), F.col("id").cast("string"))).otherwise(F.col("id").cast("string"))
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("예선"), F.col("heat_number").cast("string"), F.lit("조"))).otherwise("예선")
    return t["event_heat"].select("id", x.heat_from_code(code, name).alias("heat"))
