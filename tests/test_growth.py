"""What is shuffled grows with the input, not with pairs of rows that share a name or with reports' width."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from podium import tables
from podium.operators import athletes, facts, identity, registration
from podium.operators.names import NameIndex
from podium.plans import star
from tests.small import catalog, meet, rows

SF = "/root/testdata/sf0.001"


def shuffled(spark, df):
    """(rows, records that were written to shuffles for them)."""
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()

    def written():
        time.sleep(1)  # metrics of the last tasks come by events
        stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    found = df.collect()
    return found, written() - before


@pytest.fixture
def no_large_broadcast(spark):
    """Tables of more than 30 kB are met by shuffle, as large ones are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 30_000)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", 30_000)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def _shared_name(spark, n):
    """n athletes without entries and n entries without athletes, all of one name, and one athlete with an entry."""
    day = datetime.date(2020, 1, 1)
    entries = [{"id": i, "competition_id": 1 + i % 2, "athlete_name": "가", "gender": "M", "team_name": f"팀{i}", "athlete_id": -1 if i == 7 else None} for i in range(n)]
    people = [{"id": i, "name": "가", "gender": "M"} for i in range(n)] + [{"id": -1, "name": "가", "gender": "M"}]
    return catalog(
        spark,
        competition=[{"id": 1, "name": "일", "short_name": "일", "start_date": day}, {"id": 2, "name": "이", "short_name": "이", "start_date": None}],
        event=[{"id": c, "competition_id": c, "division_name": f"남{c}", "gender": "M", "event_name": "500m", "team_event": False} for c in (1, 2)],
        event_round=[{"id": c, "event_id": c, "round": "결승", "event_number": c} for c in (1, 2)], event_heat=[{"id": c, "event_round_id": c, "heat_number": 0} for c in (1, 2)],
        heat_entry=[{"id": i, "heat_id": 1 + i % 2, "entry_id": i, "bib_number": 1} for i in range(n)], competition_entry=entries, athlete=people,
    )


def test_athletes_of_one_name_share_the_work(spark, no_large_broadcast):
    n = 1000
    t = {name: df.localCheckpoint() for name, df in _shared_name(spark, n).items()}
    latest, moved = shuffled(spark, athletes.latest_profiles(t).select("athlete_id", "latest_entry_id"))
    assert dict(map(tuple, latest)) == {i: 0 for i in range(n)} | {-1: 7} and moved < 10 * n
    divisions, moved = shuffled(spark, athletes.entry_divisions(t))
    assert dict(map(tuple, divisions)) == {i: "남1, 남2" for i in range(n)} | {-1: "남2"} and moved < 10 * n
    pages, moved = shuffled(spark, athletes.detail(t, 1, 3).select("athlete_id", "total_elements", F.transform("content", lambda c: c["start_id"])))
    assert {r[0]: (r[1], r[2]) for r in pages} == {i: (n, [6, 8, 10]) for i in range(n)} | {-1: (1, [])} and moved < 20 * n


def test_performances_are_not_shuffled_by_pairs(spark, no_large_broadcast):
    n = 300
    t = {name: df.localCheckpoint() for name, df in _shared_name(spark, n).items()}
    found, moved = shuffled(spark, athletes.performances(t).select("athlete_id", "start_id"))
    assert len(found) == n * n + 1 and moved < 20 * n
    # rows of an athlete lie together, latest competition first
    seen = {}
    for at, (athlete, start) in enumerate(found):
        seen.setdefault(athlete, []).append((at, start))
    order = list(range(0, n, 2)) + list(range(1, n, 2))
    for athlete, got in seen.items():
        assert [x[0] for x in got] == list(range(got[0][0], got[0][0] + len(got)))
        assert [x[1] for x in got] == ([7] if athlete == -1 else order)


def test_performances_by_start_lie_together(spark, no_large_broadcast):
    n = 300
    t = {name: df.localCheckpoint() for name, df in _shared_name(spark, n).items()}
    found, moved = shuffled(spark, athletes.performances(t, by_start=True).select("athlete_id", "start_id"))
    assert sorted(found) == sorted(athletes.performances(t).select("athlete_id", "start_id").collect()) and moved < 20 * n
    starts = [start for athlete, start in found if athlete != -1]
    assert sum(a != b for a, b in zip(starts, starts[1:])) == n - 1


def test_medals_shuffle_starts_of_finals_only(spark, no_large_broadcast):
    for conf in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(conf, 6_000)
    races = [{"name": f"가{i}", "rank": 9, "round": "예선"} for i in range(2000)] + [{"name": f"나{i}", "rank": i} for i in (1, 2, 3)]
    t = {name: tables.keep(df.coalesce(1), name) for name, df in meet(spark, races).items()}
    found, moved = shuffled(spark, facts.medals(t).select("athlete_name", "ranking"))
    assert sorted(map(tuple, found)) == [("나1", 1), ("나2", 2), ("나3", 3)] and moved < 2500  # the entries


def test_places_come_with_the_starts(spark):
    """Results and starts of the archive are read off the stored starts; what is ranked within a heat isn't shuffled by heat again."""
    starts = star.with_ids(tables.keep(star.starts_of(spark, SF), "starts"))
    archive = star.derive(spark, SF, starts)
    for name in ("event_result", "heat_entry"):
        assert "Exchange" not in archive[name]._jdf.queryExecution().executedPlan().toString()
    large = star.starts_of(spark, SF)
    assert sorted(rows(large)) == sorted(rows(starts.select(*[F.col(c).cast(large.schema[c].dataType) for c in large.columns])))


def test_sheets_are_printed_once(spark):
    """What parsers read several times is stored text, and a sheet holds its lines in order."""
    from podium.plans import sheets

    t = meet(spark, [{"name": "가", "rank": 2, "record": "01.000", "heat": 1}, {"name": "나", "rank": 1, "record": "00.900", "heat": 1}, {"name": "다", "rank": 1, "comp": 2}])
    printed = sheets.result_sheets(t, 1)
    plan = printed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    [(_, text)] = rows(printed)
    assert [line.split()[0] for line in text.split("\n")] == ["11-1", "순위", "1", "2", "심판장"]


def test_start_lists_run_a_pattern_once_a_line(spark):
    from podium.functions import exprs
    from podium.sources import startlist, text

    texts = ["제1일차", "11 남중부 500m 결승", "< 1조 >", "1 가 (대구 대구 ㄱ중3)", "2 나\u2028 (대구 ㄱ)", "3 다 (대구)\u2028", "4 라 (대구 12)", "12 남중부 계주3,000m 결승", "5 마 (대구 마)"]
    docs = spark.createDataFrame([("d", "\n".join(texts))], "path string, text string")
    parsed = startlist.parse_start_list(docs)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count(startlist.ATHLETE.removesuffix("$")) <= 2
    assert [(r.bib_number, r.athlete_name, r.region, r.team_name, r.grade) for r in parsed.orderBy("pos").collect()] == [(1, "가", "대구", "ㄱ중", 3), (2, "나\u2028", "대구", "ㄱ", None), (3, "다", "대구", "", None), (4, "라", "대구", "", 12), (0, "마", "대구", "마", None)]

    infos = spark.createDataFrame([(x,) for x in ("대구 대구 ㄱ중3", "대구 ㄱ", " 대구  ", "", None, "12", "대구 대구", "a a a 7")], "info string")
    both = exprs.with_affiliation(infos, F.col("info"), "x_").select(exprs.affiliation(F.col("info")).alias("a"), F.struct(F.col("x_region").alias("region"), F.col("x_team").alias("team"), F.col("x_grade").alias("grade")).alias("b"))
    assert both.where("NOT a <=> b").isEmpty()
    # blocks of a list are met by state, not by lines that are shuffled again
    long = spark.createDataFrame([("d", "\n".join(texts[:3] + texts[3:4] * 500))], "path string, text string")
    found, moved = shuffled(spark, text.carried(long, lambda x: x.withColumn("day", F.when(F.col("line").startswith("제"), F.col("line"))), ["day"], block=100).select("day"))
    assert len(found) == 503 and {r.day for r in found} == {"제1일차"} and moved < 503 + 20


def test_a_roster_is_parsed_once(spark):
    from podium.sources import startlist

    docs = spark.createDataFrame([("d", "11 남중부 500m 결승\n1 가 (대구 ㄱ3)\n2 나 (대구 ㄱ)")], "path string, text string")
    out, counts = startlist.apply_roster(catalog(spark, athlete=[{"id": 1, "name": "가", "gender": "M", "notes": "대구 ㄱ"}]), startlist.parse_roster(docs))
    assert rows(counts) == [(1, 1)] and out["athlete"].count() == 2
    for df in (counts, out["athlete"]):
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_not_shuffled_by_pairs(spark, no_large_broadcast):
    n = 300
    t = {name: tables.keep(df, name) for name, df in _shared_name(spark, n).items()}
    found, moved = shuffled(spark, identity.candidates(t).select("entry_id", "athlete_id"))
    assert len(found) == (n - 1) * (n + 1) and moved < 20 * n


def test_candidates_come_athlete_by_athlete(spark, no_large_broadcast):
    """A history is written out before the pairs are formed, and its many rows lie together."""
    from podium.plans.more_queries import _told

    n = 40
    t = {name: tables.keep(df, name) for name, df in _shared_name(spark, n).items()}
    found = identity.candidates(t, shown=_told)
    athletes_in_order = [r.athlete_id for r in found.collect()]
    assert sum(a != b for a, b in zip(athletes_in_order, athletes_in_order[1:])) == n
    assert {r.history for r in found.where("athlete_id = -1").collect()} == {"-/이/-/팀7/남2/500m"}
    above_join = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "array_join" not in above_join


def test_registration_does_not_shuffle_athletes_in_each_round(spark, no_large_broadcast):
    """n athletes of one name and team; groups of seven level sets are decided one after the other."""
    n, levels = 600, ("남초부", "남중부", "남고부")
    sets = [[d for k, d in enumerate(levels) if bits >> k & 1] for bits in range(1, 8)]
    races = [{"comp": 2, "name": "가", "team": "ㄱ", "division": d, "athlete_id": None} for d in levels]
    t = meet(spark, races, athlete=[{"id": i, "name": "가", "gender": "M"} for i in range(1, n + 1)])
    heat = {r["division_name"]: r["heat_id"] for r in facts.heats(t).collect()}
    entries = [{"id": i, "competition_id": 1 if i <= n else 2, "athlete_name": "가", "gender": "M", "team_name": "ㄱ", "athlete_id": i if i <= n else None} for i in range(1, n + 8)]
    starts = [(e["id"], d) for e in entries for d in (levels[:1] if e["id"] <= n else sets[e["id"] - n - 1])]
    t |= {k: v for k, v in catalog(spark, competition_entry=entries, heat_entry=[{"id": k, "heat_id": heat[d], "entry_id": e, "bib_number": 1} for k, (e, d) in enumerate(starts)]).items() if k in ("competition_entry", "heat_entry")}
    t = {name: tables.keep(df.coalesce(1), name) for name, df in t.items()}
    found = []
    moved = _written(spark, lambda: found.append(registration.bulk_register(t, 2)[1].first()["athletes_mapped"]))
    assert found == [7] and moved < 12 * n


def _written(spark, work):
    """Records that were written to shuffles by ``work``."""
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()

    def written():
        time.sleep(1)
        stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    work()
    return written() - before


def test_entries_come_from_a_row_for_each_order(spark, no_large_broadcast):
    """Entries of the archive shuffle the rows that lead an order, not all starts."""
    starts = star.with_ids(tables.keep(star.starts_of(spark, SF), "starts"))
    found, moved = shuffled(spark, star.derive(spark, SF, starts)["competition_entry"].select("id"))
    assert sorted(map(tuple, found)) == sorted(rows(starts.select("entry_id").distinct()))
    people = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert moved <= spark.read.parquet(f"{SF}/orders.parquet").count() + people < starts.count()


def test_an_index_shuffles_a_row_once(spark, tmp_path, no_large_broadcast):
    n = 5000
    t = _shared_name(spark, n)
    entries = tables.keep(t["competition_entry"].withColumn("athlete_name", F.concat(F.lit("선수가나"), (F.col("id") % 7).cast("string"))), "entries")
    t = {**{name: tables.keep(df.coalesce(1), name) for name, df in t.items()}, "competition_entry": entries}
    made = []
    moved = _written(spark, lambda: made.append(NameIndex(spark, str(tmp_path / "i")).build(entries, "id", "athlete_name")))
    assert moved < 1.5 * n and dict(made[0].rarest("가나")) == {"가나": n}
    assert made[0].keys("나3").count() == len(range(3, n, 7))
    moved = _written(spark, lambda: made.append(rows(athletes.suggest_entries(t, q="나3", names=made[0]), "event_id", "athlete_name")))
    assert len(made[1]) == len({(i % 2, f"팀{i}") for i in range(3, n, 7)}) and moved < n


def test_a_long_sheet_is_shuffled_once(spark):
    """A time below a row counts for it, in a later block too; no line is shuffled to meet its header or its row."""
    from podium.sources import results

    line = lambda k: f"{k} {k}   가{k}   대구   ㄱ   1:00.{k % 1000:03d}"
    sheet = ["11 남중부 500m 결승", "순위", *(line(k) for k in range(2, 10_000)), "      9:59.999   Q", line(10_001), "      8:00.001", "      8:00.002   대회신"]
    docs = spark.createDataFrame([("d", "\n".join(sheet))], "path string, text string")
    found, moved = shuffled(spark, results.parse_results(docs))
    got = {r.pos: (r.record, r.new_record, r.qualification) for r in found}
    assert len(found) == len(got) == 9999 and moved < len(sheet) + 100
    assert got[9998] == ("1:00.998", None, None) and got[9999] == ("9:59.999", None, "Q") and got[10_001] == ("8:00.002", "대회신", None)
