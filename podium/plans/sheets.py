"""The archive printed as the sheets and pages that the parsers read, so that what they give back can be held against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.operators import facts
from podium.tables import Catalog, keep

NOWHERE = "무소속"


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _string(column: str):
    return F.col(column).cast("string")


def printed(t: Catalog, comp_id: int | None = None, by: tuple[str, ...] = ("heat_id",)) -> DataFrame:
    """Starts as sheets show them, with numbers that are unique in the competition or heat, and their results; dealt ``by`` columns that a heat decides.

    Of starts that share a heat, name and team all but the first have a number behind the name, as sheets have for namesakes.
    """
    results = t["event_result"].select(F.col("heat_entry_id").alias("start_id"), F.col("id").alias("result_id"), "ranking", "record", "new_record", "qualification")
    team = F.when(F.col("team_event"), F.col("athlete_name")).otherwise(F.col("team_name"))
    rows = facts.entry_fact(t if comp_id is None else facts.of_competition(t, comp_id)).join(results, "start_id", "left")
    rows = rows.repartition(*by)  # both windows lie within the heat
    heat = [c for c in by if c != "heat_id"] + ["heat_id"]
    namesakes = Window.partitionBy(*heat, "athlete_name", team).orderBy("start_id")
    rows = rows.withColumn("_k", F.row_number().over(namesakes)).withColumn("athlete_name", F.when(F.col("_k") > 1, F.concat_ws("_", "athlete_name", "_k")).otherwise(F.col("athlete_name")))
    rows = rows.withColumn("shown_team", team).drop("_k", "bib_number")
    number = F.pmod("event_id", F.lit(1000)) * 10 + F.pmod("round_id", F.lit(10))
    region = F.coalesce(F.nullif(F.trim("region"), F.lit("")), F.lit(NOWHERE))
    return rows.withColumns({"bib": F.row_number().over(Window.partitionBy(*heat).orderBy("start_id")), "number": number.cast("int"), "shown_region": region, "city": F.when(F.col("start_id") % 2 == 0, "대구").otherwise("전북")})


def _documents(lines: DataFrame) -> DataFrame:
    """(path, text) of lines (doc, place, line), printed once: parsers look at a text several times."""
    in_order = F.sort_array(F.collect_list(F.struct("place", "line")))
    docs = lines.groupBy("doc").agg(F.array_join(F.transform(in_order, lambda x: x["line"]), "\n").alias("text"))
    return keep(docs.select(_string("doc").alias("path"), "text"), "documents")


def start_lists(t: Catalog, comp_id: int | None = None) -> DataFrame:
    """One list per event: day, header, heat and start lines."""
    rows = printed(t, comp_id, ("event_id",))
    at = F.struct("round_id", F.col("heat_number").alias("h"), F.col("start_id").alias("k"))
    place = lambda heat, k: F.struct("round_id", F.lit(heat).alias("h") if isinstance(heat, int) else F.col(heat).alias("h"), F.lit(k).cast("long").alias("k"))
    plain = (F.col("round") == "결승") & (F.col("event_id") % 2 == 1)
    header = F.concat_ws(" ", _string("number"), "division_name", "event_name", F.when(~plain, F.col("round")))
    name = F.col("athlete_name")
    twice = F.when(F.col("start_id") % 2 == 0, _text(F.col("shown_region"), " ")).otherwise("")
    single = _text(_string("bib"), " ", name, " (", twice, F.col("shown_region"), " ", F.col("team_name"), _string("grade"), ")")
    team = _text(name, " (", F.col("shown_region"), " ", name, ")")
    # a heat's and a round's first row bring the lines above them; all lines come of the one pass over the rows, which lie by event already
    first = lambda *keys: F.row_number().over(Window.partitionBy("event_id", *keys).orderBy("start_id")) == 1
    rows = rows.withColumns({"_heat": first("round_id", "heat_id") & (F.col("heat_number") > 0), "_round": first("round_id")})
    line = lambda at, text: F.struct(at.alias("place"), text.alias("line"))
    none = F.array().cast("array<struct<place:struct<round_id:bigint,h:int,k:bigint>,line:string>>")
    above_round = F.when(F.col("_round"), F.array(line(place(-2, 0), _text("제", _string("day_number"), "일차(2026. 3.20.금)")), line(place(-1, 0), header))).otherwise(none)
    above_heat = F.when(F.col("_heat"), F.array(line(place("heat_number", -1), _text("< ", _string("heat_number"), "조 >")))).otherwise(none)
    lines = F.concat(above_round, above_heat, F.array(line(at, F.when(F.col("team_event"), team).otherwise(single))))
    return _documents(rows.select(F.col("event_id").alias("doc"), F.explode(lines).alias("_l")).select("doc", "_l.*"))


def result_sheets(t: Catalog, comp_id: int | None = None) -> DataFrame:
    """One sheet per heat with a result; the record of every seventh start is corrected by a second line."""
    rows = printed(t, comp_id).where("result_id IS NOT NULL")
    place = lambda k, more: F.struct(F.lit(k).alias("part"), F.coalesce("ranking", F.lit(9999)).alias("r"), F.col("start_id").alias("s"), F.lit(more).alias("m"))
    head = _text(_string("number"), F.when(F.col("heat_number") > 0, _text("-", _string("heat_number"))).otherwise(""), " ", F.col("division_name"), " ", F.col("event_name"), " ", F.col("round"))
    code = _text(F.coalesce(_string("ranking"), F.lit("DQ")), " ", _string("bib"), "   ")
    corrected = (F.col("start_id") % 7 == 0) & F.col("record").isNotNull() & ~F.col("team_event")
    record = F.when(corrected, "9:59.999").otherwise(F.col("record"))
    single = F.concat(code, F.concat_ws("   ", "athlete_name", "shown_region", "team_name", record, "new_record", "qualification"))
    named = F.when(F.col("start_id") % 3 == 0, F.concat_ws(" ", "athlete_name", "city")).otherwise(F.concat_ws("         ", "athlete_name", "city"))
    team = F.concat(code, F.concat_ws("     ", named, "qualification", "record", "new_record"))
    none = lambda k: F.struct(F.lit(k).alias("part"), F.lit(0).alias("r"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("m"))
    line = lambda at, text: F.struct(at.alias("place"), text.alias("line"))
    # a heat's first row brings the lines around all; every line comes of the one pass over the rows, which lie by heat already
    around = F.when(F.col("_at") == 1, F.array(line(none(0), head), line(none(1), F.lit("순위  번호  성명    시도    소속      기록")), line(none(3), F.lit("심판장 아무개"))))
    own = F.array(line(place(2, 0), F.when(F.col("team_event"), team).otherwise(single)))
    more = F.when(corrected, F.array(line(place(2, 1), _text("              ", F.col("record")))))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("heat_id").orderBy("start_id")))
    lines = F.concat(own, *[F.coalesce(x, F.slice(own, 1, 0)) for x in (more, around)])
    return _documents(rows.select(F.col("heat_id").alias("doc"), F.explode(lines).alias("_l")).select("doc", "_l.*"))


def _pages(lines: DataFrame, before: str, after: str) -> DataFrame:
    docs = _documents(lines)
    return docs.select("path", _text(before, F.col("text"), after).alias("html"))


def _cell(x):
    return _text("<td>", x, "</td>")


def result_pages(t: Catalog) -> DataFrame:
    """One HTML page per heat; rows without a rank show a dash."""
    rows = printed(t).where("result_id IS NOT NULL")
    player = _text("<span onclick=\"f('", _string("start_id"), "');\">", F.col("athlete_name"), "</span>")
    note = F.when(F.col("new_record").isNotNull() | (F.col("start_id") % 2 == 0), _cell(F.coalesce("new_record", F.lit("")))).otherwise("")
    line = _text("<tr>", _cell(F.coalesce(_string("ranking"), F.lit("-"))), _cell(F.col("shown_region")), _cell(player), _cell(F.col("team_name")), _cell(F.coalesce("record", F.lit(""))), note, "</tr>")
    return _pages(rows.select(F.col("heat_id").alias("doc"), F.col("start_id").alias("place"), line.alias("line")), '<table class="list pcView"><tbody><tr><th>순위</th></tr>', "</tbody></table>")


def schedule_pages(t: Catalog) -> DataFrame:
    """One HTML page per event: its rounds, of which the first names division and event."""
    rows = facts.rounds(t).withColumn("k", F.row_number().over(Window.partitionBy("event_id").orderBy("round_id")))
    args = F.concat_ws(",", *[F.concat(F.lit("'"), x, F.lit("'")) for x in (_string("competition_id"), _string("event_id"), _string("k"), F.lit(""), _string("round_id"))])
    first = lambda c: _cell(F.when(F.col("k") == 1, F.col(c)).otherwise(""))
    line = _text('<tr onclick="openSide(', args, ')">', first("division_name"), first("event_name"), _cell(F.col("round")), "</tr>")
    return _pages(rows.select(F.col("event_id").alias("doc"), F.col("round_id").alias("place"), line.alias("line")), "<table>", "</table>")


def record_pages(t: Catalog) -> DataFrame:
    """One HTML page per event: its marked results as labelled cells; division and event stand in the first only."""
    rows = printed(t).where("new_record IS NOT NULL AND record IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("event_id").orderBy("result_id")))
    cell = lambda label, x: _text(f'<td data-label="{label}">', x, "</td>")
    first = lambda c: F.when(F.col("k") == 1, F.col(c)).otherwise("")
    line = _text("<tr>", cell("종별", first("division_name")), cell("세부종목", first("event_name")), cell("경기구분", F.col("round")), cell("선수명/팀명", F.col("athlete_name")), cell("기록", F.col("record")), cell("일자", F.lit("1")), "</tr>")
    return _pages(rows.select(F.col("event_id").alias("doc"), F.col("result_id").alias("place"), line.alias("line")), "<table>", "</table>")


def target_rows(t: Catalog) -> DataFrame:
    """CSV rows c0..c9 that name each round's page twice; every other row is of another sport."""
    rows = facts.rounds(t).select("round_id", "event_id", "competition_id", "division_name", "event_name", "round", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    url = _text("http://x/?gameno=0&gameno=", _string("competition_id"), "&=none&kindCd=", F.pmod("event_id", F.lit(7)).cast("string"), "&searchDetailClassCd=", _string("event_id"), "&rhCd=", _string("round_id"), F.when(F.col("copy") == 1, "#again").otherwise(""))
    sport = F.when(F.col("event_id") % 2 == 0, '롤러 "S", 인라인').otherwise("수영")
    blank = [F.lit("").alias(f"c{k}") for k in range(5, 9)]
    return rows.select((F.col("round_id") * 2 + F.col("copy")).alias("pos"), (F.col("round_id") * 2 + F.col("copy")).cast("string").alias("c0"), sport.alias("c1"), F.col("division_name").alias("c2"), F.col("event_name").alias("c3"), F.col("round").alias("c4"), *blank, url.alias("c9"))


#: Common table expression of ``printed`` after those of the archive.
SQL = f""",
pr0 AS (SELECT sf.*, r.id AS result_id, r.ranking, r.record, r.new_record, r.qualification, e.gender AS event_gender, ce.grade, er.day_number,
  CASE WHEN sf.team_event THEN sf.athlete_name ELSE sf.team_name END AS shown_team, CAST(sf.event_id % 1000 * 10 + sf.round_id % 10 AS INT) AS number, coalesce(nullif(trim(sf.region), ''), '{NOWHERE}') AS shown_region,
  CASE WHEN sf.start_id % 2 = 0 THEN '대구' ELSE '전북' END AS city
  FROM sf JOIN event e ON e.id = sf.event_id JOIN competition_entry ce ON ce.id = sf.entry_id JOIN event_round er ON er.id = sf.round_id LEFT JOIN event_result r ON r.heat_entry_id = sf.start_id),
pr1 AS (SELECT *, row_number() OVER (PARTITION BY heat_id, athlete_name, shown_team ORDER BY start_id) AS k FROM pr0),
pr AS (SELECT *, CAST(row_number() OVER (PARTITION BY heat_id ORDER BY start_id) AS INT) AS bib FROM (
  SELECT * EXCLUDE (k) REPLACE (CASE WHEN k > 1 THEN athlete_name || '_' || k ELSE athlete_name END AS athlete_name, CASE WHEN k > 1 AND team_event THEN shown_team || '_' || k ELSE shown_team END AS shown_team) FROM pr1))"""
