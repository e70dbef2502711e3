"""The ten tables of a meet archive, derived from a star schema of orders.

Used to run every report on generated data: customers are athletes, part types are
divisions, return flags are rounds.  ``SQL`` is the same derivation for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium import schema
from podium.tables import Catalog, keep

# Fixed values of the fixture: part type, number and division; part key modulo 5 and event.
DIVISIONS = {"ECONOMY": (0, "초부 5,6학년"), "LARGE": (1, "초부 일반(B조) 5,6학년"), "MEDIUM": (2, "중부"), "PROMO": (3, "고부"), "SMALL": (4, "대부"), "STANDARD": (5, "일부")}
EVENTS = ("500m+D", "1,000m", "DTT200m", "E3,000m", "계주3,000m")
ROUND_IDS = {1: schema.PRELIM, 2: schema.QUARTER, 3: schema.SEMI, 4: schema.FINAL, 5: schema.GROUP_FINAL}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
NAMES = 498


def _choose(x, pairs, otherwise=None):
    out = F.lit(otherwise)
    for key, value in pairs:
        out = F.when(x == key, F.lit(value)).otherwise(out)
    return out


def person(key):
    return F.concat(F.lit("선수"), F.lpad(F.pmod(key, F.lit(NAMES)).cast("string"), 3, "0"))


#: Part types up to this many are sent to every task; more are met by shuffle, so the driver holds no table that grows.
SENT_PARTS = 2_000_000


#: Bits of a place: round and heat within the event, the event within the competition (7 stands for null), absence, and the first row of an order.
_DIVISION, _EVENT, _ROUND_NO, _HEAT, _ABSENT, _LEAD = 12, 9, 6, 3, 1, 0


def _bits(place, at: int, mask: int = 7):
    return F.shiftright(place, at).bitwiseAND(F.lit(mask))


def starts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per start, with its place in the heat (null if absent); ids follow from the columns (``with_ids``).  ``lead`` marks
    rows among which each athlete of each competition is found: one for each order.

    Lines meet their orders, where of those of one start only the first goes on; these are shuffled once more, by heat, and made
    distinct and ranked there.  Both shuffles carry a place as one number.  What only breaks ties is carried where it can change
    whether a start is absent, that is for seventh lines.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    round_no = F.when(flag == "R", 4).when((flag == "A") & (line == 7), 5).when((flag == "A") & (line == 6), 2).when(flag == "A", 3).otherwise(1)
    absent = (F.col("l_linestatus") == "O") & (line == 7)
    competition = F.year("o_orderdate") * 10 + F.pmod("o_orderkey", F.lit(2))
    orders = read("orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), competition.cast("int").alias("competition_id"))
    parts = read("part")
    division = _choose(F.col("p_type"), [(k, v[0]) for k, v in DIVISIONS.items()])
    parts = (F.broadcast if parts.count() <= SENT_PARTS else lambda df: df.hint("merge"))(parts.select("p_partkey", division.alias("division")))
    heat_number = F.when(round_no >= 4, 0).otherwise(line % 3 + 1)
    shifted = lambda x, at: F.shiftleft(F.coalesce(x, F.lit(7)).cast("long"), at)
    place = shifted(F.col("division"), _DIVISION) + shifted(F.pmod("l_partkey", F.lit(5)), _EVENT) + shifted(round_no, _ROUND_NO) + shifted(heat_number, _HEAT) + shifted(F.when(absent, 1).when(~absent, 0).otherwise(2), _ABSENT)
    # by number, lines before the seventh are alike and those behind it too
    by_line = F.when(line < 7, 0).when(line == 7, 1).when(line > 7, 2).cast("tinyint")
    tie = F.when(line != 7, None).otherwise(F.struct("l_partkey", "l_suppkey", "l_extendedprice"))
    lines = read("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select("l_orderkey", place.alias("place"), F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(120_000)).cast("int").alias("ms"), by_line.alias("by_line"), tie.alias("tie"))
    met = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("heat", F.shiftright("place", _HEAT))
    of_order, in_order = ["l_orderkey", "custkey", "competition_id"], ["ms", "by_line", "tie"]
    # one sort serves both
    met = met.withColumn("k", F.row_number().over(Window.partitionBy(*of_order, "heat").orderBy(*in_order))).withColumn("n", F.row_number().over(Window.partitionBy(*of_order).orderBy("heat", *in_order)))
    whole = F.shiftleft(F.coalesce("competition_id", F.lit(-1)).cast("long"), _DIVISION + 3) + F.col("place") + F.when(F.col("n") == 1, 1).otherwise(0)
    number, heat_no = _bits("place", _ROUND_NO), _bits("place", _HEAT)
    # no seventh line runs in these
    same = number.isin(2, 3) | ((number == 1) & ~heat_no.isin(2, 7))
    one = met.where("k = 1").select("custkey", whole.alias("place"), "ms", F.when(~same, F.col("l_orderkey")).alias("by_order"))
    here = one.repartition(F.shiftright("place", _HEAT)).withColumn("heat", F.shiftright("place", _HEAT))
    first, all_ = Window.partitionBy("heat", "custkey").orderBy("ms", "by_order"), Window.partitionBy("heat", "custkey")
    # these windows lie within the heat, so they need no shuffle of their own
    here = here.withColumn("k", F.row_number().over(first)).withColumn("lead", F.max(F.col("place").bitwiseAND(F.lit(1))).over(all_) == 1).where("k = 1")
    null7 = lambda at: F.nullif(_bits("place", at), F.lit(7)).cast("tinyint")
    once = here.select(
        "custkey", "heat", F.nullif(F.shiftright("place", _DIVISION + 3), F.lit(-1)).cast("int").alias("competition_id"), null7(_DIVISION).alias("division"), _bits("place", _EVENT).cast("tinyint").alias("event_no"),
        _bits("place", _ROUND_NO).cast("tinyint").alias("round_no"), null7(_HEAT).alias("heat_number"), "ms", (F.nullif(_bits("place", _ABSENT, 3), F.lit(2)) == 1).alias("absent"), "lead",
    )
    by_time = Window.partitionBy("heat", F.pmod("custkey", F.lit(2)), "absent").orderBy("ms", "custkey")
    return once.withColumn("place", F.when(~F.col("absent"), F.row_number().over(by_time))).drop("heat")


def with_ids(starts: DataFrame) -> DataFrame:
    """Starts with the keys of everything above them."""
    event_id = F.col("competition_id") * 1000 + F.pmod("custkey", F.lit(2)) * 100 + F.col("division") * 10 + F.col("event_no")
    whole = starts.withColumns({c: F.col(c).cast("int") for c in ("division", "event_no", "round_no", "heat_number")}).withColumn("competition_id", F.col("competition_id").cast("long"))
    keyed = whole.withColumn("event_id", event_id).withColumn("round_id", F.col("event_id") * 10 + F.col("round_no")).withColumn("heat_id", F.col("round_id") * 10 + F.col("heat_number"))
    return keyed.withColumns({"start_id": F.col("heat_id") * 1_000_000_000 + F.col("custkey"), "entry_id": F.col("competition_id") * 1_000_000_000 + F.col("custkey")})


def record_text(ms):
    seconds = F.concat(F.lpad(F.floor(F.pmod(ms, F.lit(60_000)) / 1000).cast("string"), 2, "0"), F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))
    return F.when(ms >= 60_000, F.concat(F.floor(ms / 60_000).cast("string"), F.lit(":"), seconds)).otherwise(seconds)


_SOURCES = ("lineitem", "orders", "part", "customer", "nation")
_STORED: dict[tuple, Catalog] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of the source files, by which a change shows."""
    out = []
    for name in _SOURCES:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        out += [fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength()]
    return tuple(out)


def tables(spark: SparkSession, sf_dir: str) -> Catalog:
    """The archive, derived once a session and kept as Parquet in the shared folder; reports read it from there."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir))
    if key not in _STORED:
        starts = with_ids(keep(starts_of(spark, sf_dir), "starts"))
        _STORED[key] = {name: keep(df, name) for name, df in derive(spark, sf_dir, starts).items()}
    # plans of their own, so that no query's columns meet those of another
    return {name: df.select("*") for name, df in _STORED[key].items()}


def derive(spark: SparkSession, sf_dir: str, s: DataFrame) -> Catalog:
    """The ten tables from the starts."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    gender = F.when(F.pmod("custkey", F.lit(2)) == 0, "M").otherwise("F")
    region = F.when(F.col("c_nationkey") == 0, F.lit(None)).when(F.col("c_nationkey") == 1, "").otherwise(F.col("n_name"))
    team_no = _choose(F.col("c_mktsegment"), [(x, k) for k, x in enumerate(SEGMENTS)])
    people = customer.select(F.col("c_custkey").alias("custkey"), region.alias("region"), F.col("n_name"), F.col("c_mktsegment").alias("segment"), (team_no * 100 + F.col("c_nationkey")).cast("long").alias("team_key"))

    comp = s.select("competition_id").distinct()
    year, half = F.floor(F.col("competition_id") / 10).cast("int"), (F.col("competition_id") % 10).cast("int")
    start = F.when((year == 1998) & (half == 1), F.lit(None)).otherwise(F.make_date(year, F.when(half == 0, 1).otherwise(7), F.lit(1)))
    competition = comp.select(F.col("competition_id").alias("id"), F.concat(F.lit("대회 "), F.col("competition_id").cast("string")).alias("name"), F.concat(F.when(half == 0, "봄").otherwise("가을"), F.lit(" "), year.cast("string")).alias("short_name"), F.when(year == 1999, F.lit(None)).otherwise(year - 1994).cast("int").alias("edition"), start.alias("start_date"), F.date_add(start, 2).alias("end_date"), F.lit(3).alias("duration_days"))

    division = F.concat(F.when(F.pmod(F.floor(F.col("event_id") / 100), F.lit(10)) == 0, "남").otherwise("여"), _choose(F.col("division"), DIVISIONS.values()))
    event_name = _choose(F.col("event_no"), list(enumerate(EVENTS)))
    sex = F.when(F.pmod(F.floor(F.col("event_id") / 100), F.lit(10)) == 0, "M").otherwise("F")
    event = s.select("event_id", "competition_id", "division", "event_no").distinct().select(F.col("event_id").alias("id"), "competition_id", division.alias("division_name"), sex.alias("gender"), event_name.alias("event_name"), (F.col("event_no") == 4).alias("team_event"))
    number = F.when(F.col("round_no") == 2, F.lit(None)).otherwise(F.pmod(F.col("event_id"), F.lit(1000)) * 3 + F.col("round_no")).cast("int")
    rounds = s.select("round_id", "event_id", "round_no").distinct()
    event_round = rounds.select(F.col("round_id").alias("id"), "event_id", _choose(F.col("round_no"), ROUND_IDS.items()).alias("round"), number.alias("event_number"), (F.col("round_no") % 3 + 1).cast("int").alias("day_number"))
    event_heat = s.select("heat_id", "round_id", "heat_number").distinct().select(F.col("heat_id").alias("id"), F.col("round_id").alias("event_round_id"), F.col("heat_number").cast("int"))
    heat_entry = s.select(F.col("start_id").alias("id"), "heat_id", "entry_id", (F.pmod("custkey", F.lit(97)) + 1).cast("int").alias("bib_number"))

    ranked = s.where("NOT absent").withColumn("ranking", F.col("place"))
    mark = F.when(F.col("ms") % 997 == 0, "세계신").when(F.col("ms") % 389 == 0, "한국신").when(F.col("ms") % 193 == 0, "부별신").when(F.col("ms") % 97 == 0, "대회신")
    event_result = ranked.select(F.col("start_id").alias("id"), F.col("start_id").alias("heat_entry_id"), F.when(F.col("ms") % 211 == 0, F.lit(None)).otherwise(F.col("ranking")).cast("int").alias("ranking"), F.when(F.col("ms") % 211 == 0, F.lit(None)).otherwise(record_text(F.col("ms"))).alias("record"), mark.alias("new_record"), F.when((F.col("ranking") <= 2) & (F.col("round_no") < 4), "Q").alias("qualification"), F.when(F.col("ms") % 211 == 0, "실격").alias("note"))

    # one shuffle, by customer, for the distinct rows and the join
    entries = s.where("lead").select("competition_id", "custkey").repartition("custkey").distinct().join(people.hint("merge"), "custkey").withColumn("entry_id", F.col("competition_id") * 1_000_000_000 + F.col("custkey"))
    competition_entry = entries.select(F.col("entry_id").alias("id"), "competition_id", person(F.col("custkey")).alias("athlete_name"), gender.alias("gender"), "region", F.col("segment").alias("team_name"), (F.pmod("custkey", F.lit(6)) + 1).cast("int").alias("grade"), F.when(F.pmod("custkey", F.lit(7)) != 0, F.col("custkey")).alias("athlete_id"), F.when(F.pmod("custkey", F.lit(5)) != 0, F.col("team_key")).alias("team_id"))
    athlete = people.select(F.col("custkey").alias("id"), person(F.col("custkey")).alias("name"), gender.alias("gender"), (F.pmod("custkey", F.lit(30)) + 1980).cast("int").alias("birth_year"), F.when(F.pmod("custkey", F.lit(3)) == 0, F.concat_ws(" ", F.col("n_name"), F.col("segment"))).alias("notes"))
    team = people.select("team_key", "segment", "n_name").distinct().select(F.col("team_key").alias("id"), F.col("segment").alias("name"), F.col("n_name").alias("region"))
    day = (F.col("round_no") % 3 + 1).cast("int")
    schedule = rounds.join(event.select(F.col("id").alias("event_id"), "competition_id", "division_name", "event_name"), "event_id").join(competition.select(F.col("id").alias("competition_id"), "start_date"), "competition_id")
    schedule_entry = schedule.select(F.col("round_id").alias("id"), "competition_id", day.alias("day_number"), F.date_add("start_date", day - 1).alias("day_date"), number.alias("order_number"), F.lit("09:00").alias("start_time"), "division_name", "event_name", _choose(F.col("round_no"), ROUND_IDS.items()).alias("round_type"), F.col("round_id").alias("event_round_id"), F.lit("race").alias("entry_type"))
    found = {"competition": competition, "event": event, "event_round": event_round, "event_heat": event_heat, "heat_entry": heat_entry, "event_result": event_result, "competition_entry": competition_entry, "athlete": athlete, "team": team, "schedule_entry": schedule_entry}
    return {name: schema.conform(df, name) for name, df in found.items()}


def _case(x: str, pairs) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in pairs) + " END"


_NAME = f"'선수' || lpad(CAST(custkey % {NAMES} AS VARCHAR), 3, '0')"
_ROUND = "CASE WHEN l_returnflag = 'R' THEN 4 WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN 5 WHEN l_returnflag = 'A' AND l_linenumber = 6 THEN 2 WHEN l_returnflag = 'A' THEN 3 ELSE 1 END"
_SECONDS = "lpad(CAST((ms % 60000) // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0')"

#: Common table expressions that give the same tables in DuckDB; a query's own follow after a comma.
SQL = f"""WITH RECURSIVE keyed0 AS (
  SELECT o_custkey AS custkey, CAST(year(o_orderdate) * 10 + o_orderkey % 2 AS BIGINT) AS competition_id, {_case('p_type', [(k, v[0]) for k, v in DIVISIONS.items()])} AS division,
    p_partkey % 5 AS event_no, {_ROUND} AS round_no, CASE WHEN {_ROUND} >= 4 THEN 0 ELSE l_linenumber % 3 + 1 END AS heat_number,
    CAST(round(l_extendedprice * 100) AS BIGINT) % 120000 AS ms, l_linestatus = 'O' AND l_linenumber = 7 AS absent, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
keyed AS (SELECT *, event_id * 10 + round_no AS round_id, (event_id * 10 + round_no) * 10 + heat_number AS heat_id FROM (
  SELECT *, competition_id * 1000 + custkey % 2 * 100 + division * 10 + event_no AS event_id FROM keyed0)),
st AS (SELECT *, heat_id * 1000000000 + custkey AS start_id, competition_id * 1000000000 + custkey AS entry_id FROM keyed
  QUALIFY row_number() OVER (PARTITION BY heat_id, custkey ORDER BY ms, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1),
people AS (SELECT c_custkey AS custkey, CASE c_nationkey WHEN 0 THEN NULL WHEN 1 THEN '' ELSE n_name END AS region, n_name, c_mktsegment AS segment,
  CAST({_case('c_mktsegment', [(x, k) for k, x in enumerate(SEGMENTS)])} * 100 + c_nationkey AS BIGINT) AS team_key FROM customer JOIN nation ON c_nationkey = n_nationkey),
competition AS (SELECT id, '대회 ' || id AS name, CASE half WHEN 0 THEN '봄' ELSE '가을' END || ' ' || y AS short_name, CASE WHEN y <> 1999 THEN CAST(y - 1994 AS INT) END AS edition,
  CASE WHEN y = 1998 AND half = 1 THEN NULL ELSE make_date(y, CASE half WHEN 0 THEN 1 ELSE 7 END, 1) END AS start_date FROM (
  SELECT DISTINCT competition_id AS id, competition_id // 10 AS y, competition_id % 10 AS half FROM st)),
event AS (SELECT DISTINCT event_id AS id, competition_id, CASE custkey % 2 WHEN 0 THEN '남' ELSE '여' END || {_case('division', DIVISIONS.values())} AS division_name,
  CASE custkey % 2 WHEN 0 THEN 'M' ELSE 'F' END AS gender, {_case('event_no', enumerate(EVENTS))} AS event_name, event_no = 4 AS team_event FROM st),
event_round AS (SELECT DISTINCT round_id AS id, event_id, {_case('round_no', ROUND_IDS.items())} AS round, CASE WHEN round_no <> 2 THEN CAST(event_id % 1000 * 3 + round_no AS INT) END AS event_number, CAST(round_no % 3 + 1 AS INT) AS day_number FROM st),
event_heat AS (SELECT DISTINCT heat_id AS id, round_id AS event_round_id, CAST(heat_number AS INT) AS heat_number FROM st),
heat_entry AS (SELECT start_id AS id, heat_id, entry_id, CAST(custkey % 97 + 1 AS INT) AS bib_number FROM st),
event_result AS (SELECT start_id AS id, start_id AS heat_entry_id, CASE WHEN ms % 211 <> 0 THEN CAST(place AS INT) END AS ranking,
  CASE WHEN ms % 211 <> 0 THEN CASE WHEN ms >= 60000 THEN (ms // 60000) || ':' ELSE '' END || {_SECONDS} END AS record,
  CASE WHEN ms % 997 = 0 THEN '세계신' WHEN ms % 389 = 0 THEN '한국신' WHEN ms % 193 = 0 THEN '부별신' WHEN ms % 97 = 0 THEN '대회신' END AS new_record,
  CASE WHEN place <= 2 AND round_no < 4 THEN 'Q' END AS qualification, CASE WHEN ms % 211 = 0 THEN '실격' END AS note FROM (
  SELECT *, row_number() OVER (PARTITION BY heat_id ORDER BY ms, custkey) AS place FROM st WHERE NOT absent)),
competition_entry AS (SELECT entry_id AS id, competition_id, {_NAME} AS athlete_name, CASE custkey % 2 WHEN 0 THEN 'M' ELSE 'F' END AS gender, region, segment AS team_name,
  CAST(custkey % 6 + 1 AS INT) AS grade, CASE WHEN custkey % 7 <> 0 THEN custkey END AS athlete_id, CASE WHEN custkey % 5 <> 0 THEN team_key END AS team_id
  FROM (SELECT DISTINCT entry_id, competition_id, custkey FROM st) JOIN people USING (custkey)),
athlete AS (SELECT custkey AS id, {_NAME} AS name, CASE custkey % 2 WHEN 0 THEN 'M' ELSE 'F' END AS gender, CAST(custkey % 30 + 1980 AS INT) AS birth_year, CASE WHEN custkey % 3 = 0 THEN n_name || ' ' || segment END AS notes FROM people),
team AS (SELECT DISTINCT team_key AS id, segment AS name, n_name AS region FROM people),
schedule_entry AS (SELECT r.id, e.competition_id, r.day_number, c.start_date + CAST(r.day_number - 1 AS INT) AS day_date, r.event_number AS order_number, e.division_name, e.event_name, r.round AS round_type, 'race' AS entry_type
  FROM event_round r JOIN event e ON e.id = r.event_id JOIN competition c ON c.id = e.competition_id),
rf AS (SELECT er.id AS result_id, er.ranking, er.record, er.new_record, er.qualification, er.note, he.id AS start_id, he.bib_number, h.id AS heat_id, h.heat_number, r.id AS round_id, r.round, r.event_number,
  e.id AS event_id, e.competition_id, e.division_name, e.gender AS event_gender, e.event_name, e.team_event, ce.id AS entry_id, ce.competition_id AS entry_competition_id, ce.athlete_name, ce.gender, ce.region, ce.team_name, ce.athlete_id,
  c.edition, c.short_name, c.name AS competition_name, c.start_date
  FROM event_result er JOIN heat_entry he ON he.id = er.heat_entry_id JOIN competition_entry ce ON ce.id = he.entry_id JOIN event_heat h ON h.id = he.heat_id JOIN event_round r ON r.id = h.event_round_id
  JOIN event e ON e.id = r.event_id JOIN competition c ON c.id = e.competition_id),
sf AS (SELECT he.id AS start_id, he.bib_number, h.id AS heat_id, h.heat_number, r.id AS round_id, r.round, r.event_number, e.id AS event_id, e.competition_id, e.division_name, e.event_name, e.team_event, ce.id AS entry_id, ce.athlete_name, ce.gender, ce.region, ce.team_name, ce.athlete_id
  FROM heat_entry he JOIN competition_entry ce ON ce.id = he.entry_id JOIN event_heat h ON h.id = he.heat_id JOIN event_round r ON r.id = h.event_round_id JOIN event e ON e.id = r.event_id),
ind AS (SELECT * FROM competition_entry WHERE id IN (SELECT entry_id FROM sf WHERE NOT team_event))"""
