"""Changes and identity matching."""

import pytest
from pyspark.sql import functions as F

from podium import schema, tables
from podium.operators import identity, mutate, registration, schedule
from tests.small import catalog, meet, rows


def test_upsert_replaces_and_adds(spark):
    t = meet(spark, [dict(name="가", rank=1, record="50.000"), dict(name="나", result=False)])
    new = spark.createDataFrame([(1, 2, None, None, None, "경고"), (2, 1, "49.000", None, "Q", None)], "heat_entry_id long, ranking int, record string, new_record string, qualification string, note string")
    once = mutate.upsert_results(t, new)
    assert sorted(rows(once["event_result"], "id", "heat_entry_id", "ranking", "record", "note")) == [(1, 1, 2, None, "경고"), (2, 2, 1, "49.000", None)]
    assert sorted(rows(mutate.upsert_results(once, new)["event_result"], "id")) == [(1,), (2,)]


def test_cascades(spark):
    t = meet(spark, [dict(name="가", rank=1), dict(name="나", rank=1, comp=2)])
    left = mutate.delete_cascade(t, "competition", t["competition"].where("id = 1"))
    assert {k: v.count() for k, v in left.items() if v.count()} == {k: 1 for k in ("competition", "event", "event_round", "event_heat", "heat_entry", "event_result", "competition_entry")}
    t = meet(spark, [dict(name="가", rank=1, athlete_id=5)], athlete=[{"id": 5, "name": "가", "gender": "M"}])
    with pytest.raises(ValueError):
        mutate.delete_athlete(t, 5)
    gone = mutate.delete_athlete(t, 5, force=True)
    assert gone["athlete"].count() == gone["event_result"].count() == gone["competition_entry"].count() == 0


def test_null_team_is_saved_once_unless_literal(spark):
    t = meet(spark, [dict(name="가")])
    new = spark.createDataFrame([(1, "나", "M", "경기", None, 1, 9)], "competition_id long, athlete_name string, gender string, region string, team_name string, heat_id long, bib_number int")
    once = mutate.save_entries(t, new)
    twice = mutate.save_entries(once, new)
    assert twice["competition_entry"].count() == 2 and twice["heat_entry"].count() == 2
    assert mutate.save_entries(mutate.save_entries(t, new, literal=True), new, literal=True)["competition_entry"].count() == 3


def test_ids_follow_the_largest_and_create_validates(spark):
    t = catalog(spark, team=[{"id": 41, "name": "가", "region": "경기"}])
    new = spark.createDataFrame([("나", "부산"), (" ", "부산"), ("다", "부산")], "name string, region string")
    out, rejected = mutate.create(t, "team", new)
    assert sorted(r[0] for r in rows(out["team"], "id")) == [41, 42, 43]
    assert rejected.first()["reasons"] == ["name is blank"]
    changed, _ = mutate.update(out, "team", spark.createDataFrame([(41, "라", "서울")], "id long, name string, region string"))
    assert rows(changed["team"].where("id = 41"), "name", "region") == [("라", "서울")]
    assert schema.duplicates(meet(spark, [dict(name="가")])["event_heat"], "event_heat").count() == 0


def test_merge_and_heats(spark):
    t = meet(spark, [dict(name="가", athlete_id=1), dict(name="나", athlete_id=2)], athlete=[{"id": i, "name": "가", "gender": "M"} for i in (1, 2)])
    out = mutate.merge_athletes(t, spark.createDataFrame([(2, 1)], "loser_id long, keeper_id long"))
    assert rows(out["athlete"], "id") == [(1,)] and rows(out["competition_entry"].distinct(), "athlete_id") == [(1,), (1,)]
    heat = spark.createDataFrame([(1, 0), (1, 2)], "event_round_id long, heat_number int")
    assert mutate.add_heat(mutate.add_heat(t, heat), heat)["event_heat"].count() == 2


def test_auto_match_needs_exactly_one(spark):
    a = [{"id": 1, "name": "가", "gender": "M"}, {"id": 2, "name": "나", "gender": "M"}, {"id": 3, "name": "나", "gender": "M"}]
    t = meet(spark, [dict(comp=1, name="가", athlete_id=1), dict(comp=1, name="나", athlete_id=2), dict(comp=1, name="나", athlete_id=3, team="팀", region="부산"), dict(comp=2, name="가"), dict(comp=2, name="나"), dict(comp=2, name="가", team="다른팀")], athlete=a)
    found = identity.auto_match(t, 2)
    assert rows(found.join(t["competition_entry"], F.col("entry_id") == F.col("id")), "athlete_name", "team_name", found["athlete_id"]) == [("가", "팀", 1)]


def test_bulk_register(spark):
    a = [{"id": 1, "name": "가", "gender": "M"}]
    t = meet(spark, [dict(comp=1, name="가", athlete_id=1, division="남중부"), dict(comp=1, name="가", athlete_id=1, division="남중부", event="1,000m"), dict(comp=2, name="가", division="남중부"), dict(comp=2, name="다", division="남중부"), dict(comp=2, name="라", event="계주3,000m")], athlete=a)
    out, counts = registration.bulk_register(t, 2)
    mapped = dict(rows(out["competition_entry"].where("competition_id = 2"), "athlete_name", "athlete_id"))
    assert mapped["가"] == 1 and mapped["다"] == 2 and mapped["라"] is None
    assert tuple(counts.select("athletes_created", "athletes_mapped", "teams_created").first()) == (1, 2, 1)
    again, more = registration.bulk_register(out, 2)
    assert more.first()["athletes_created"] == 0 and again["athlete"].count() == 2


def test_team_candidates_contain_each_other(spark):
    t = meet(spark, [dict(name="가", team="샘플"), dict(name="나", team="예시학교팀")], team=[{"id": 1, "name": "샘플클럽", "region": "경기"}, {"id": 2, "name": "예시학교", "region": "경기"}, {"id": 3, "name": "샘", "region": "경기"}])
    assert sorted(rows(identity.team_candidates(t), "team_name", "candidate")) == [("샘플", "샘"), ("샘플", "샘플클럽"), ("예시학교팀", "예시학교")]
    out, created = registration.auto_match_teams(t)
    assert created.count() == 2 and out["competition_entry"].where("team_id IS NULL").count() == 0


def test_schedule_import(spark):
    t = meet(spark, [dict(name="가")], schedule_entry=[{"id": 9, "competition_id": 1, "day_number": 1, "entry_type": "race"}, {"id": 8, "competition_id": 2, "day_number": 1, "entry_type": "race"}])
    given = spark.createDataFrame([('{"dayNumber": "1", "dayDate": "2026-03-20", "orderNumber": 2, "eventName": "500m"}',), ('{"dayNumber": 2, "orderNumber": "x", "entryType": null}',)], "value string")
    parsed = schedule.parse_rows(given)
    assert rows(parsed.orderBy("day_number"), "day_number", "order_number", "entry_type") == [(1, 2, "race"), (2, None, None)]
    out = schedule.replace_schedule(t, 1, parsed.where("entry_type IS NOT NULL"))
    assert sorted(rows(out["schedule_entry"], "id", "competition_id")) == [(8, 2), (9, 1)]
    day = schedule.schedule(out, 1).first()
    assert day["label"] == "제1일차 (3/20 금)" and day["entries"][0]["event_name"] == "500m"


def test_paging_and_lookup(spark):
    df = spark.range(45).orderBy("id")
    part, about = tables.page(df, 2, 20)
    assert [r[0] for r in part.collect()] == list(range(40, 45)) and about["total_pages"] == 3 and about["last"]
    assert tables.require_one(df, 7)["id"] == 7
    with pytest.raises(KeyError):
        tables.require_one(df, 99)
    with pytest.raises(ValueError):
        tables.page(df, 0, 0)


def test_tables_of_a_database(spark):
    t = catalog(spark, team=[{"id": 1, "name": "가", "region": "경기"}, {"id": 2, "name": "나", "region": "부산"}])
    url, properties = "jdbc:derby:memory:podium;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    t["team"].write.jdbc(url, "team", mode="overwrite", properties=properties)
    got = tables.load_jdbc(spark, url, properties, ["team"])["team"]
    assert got.columns == schema.columns("team")
    assert sorted(rows(got, "id", "name")) == [(1, "가"), (2, "나")]


def test_ids_of_one_competition_go_to_many_slots(spark):
    rows_ = spark.range(5000).selectExpr("1L AS competition_id", "concat('n', id) AS name")
    got = mutate.allocate(rows_, spark.createDataFrame([(7,)], "id long"), ["competition_id", "name"])
    assert sorted(r[0] for r in rows(got, "id")) == list(range(8, 5008))
    assert dict(rows(got, "name", "id")) == dict(rows(mutate.allocate(rows_.repartition(7), spark.createDataFrame([(7,)], "id long"), ["competition_id", "name"]), "name", "id"))
