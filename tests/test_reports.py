"""Reports on hand-made meets, one quirk each."""

import datetime as dt

from podium.operators import athletes, medals, rounds, stats
from tests.small import meet, rows


def test_podium_takes_first_name_and_first_known_id(spark):
    t = meet(spark, [dict(name="가", rank=1), dict(name="나", rank=1, athlete_id=7), dict(name="다", rank=2, round="조별결승")])
    assert rows(medals.podium_by_event(t), "gold", "gold_id", "silver") == [("가", 7, None)]


def test_b_group_wins_medals_without_points(spark):
    t = meet(spark, [dict(name="가", rank=1, division="남초부 일반(B조) 1,2학년"), dict(name="나", rank=4), dict(name="다", rank=7, region="부산"), dict(name="라", rank=1, region=" ")])
    assert rows(medals.region_standings(t).orderBy("region"), "region", "gold", "total", "score", "athletes", "athletes_b_group") == [("경기", 1, 1, 3, 1, 1), ("부산", 0, 0, 0, 1, 0)]


def test_group_final_gives_no_medal(spark):
    t = meet(spark, [dict(name="가", rank=1, round="조별결승"), dict(name="나", rank=2)])
    assert rows(medals.alltime_summary(t)) == [(1, 1, 1, 1)]


def test_team_standings_keep_divisions_in_order_won(spark):
    t = meet(spark, [dict(name="가", rank=2, division="여중부"), dict(name="나", rank=1, division="남고부"), dict(name="다", rank=1, team=None)])
    assert rows(medals.team_standings(t, nested=False), "team_name", "gold", "silver", "total", "divisions", "awards") == [("팀", 1, 1, 2, "여중부, 남고부", "1/나/500m; 2/가/500m")]
    nested = medals.team_standings(t).first()
    assert [a["athlete_name"] for a in nested["awards"]] == ["나", "가"]


def test_editions_shared_or_missing(spark):
    d = dt.date
    t = meet(spark, [dict(comp=1, edition=3, name="가", rank=1, date=d(2020, 1, 1)), dict(comp=2, edition=3, name="나", rank=2, date=d(2019, 1, 1)), dict(comp=3, edition=None, name="다", rank=3)])
    found = rows(medals.alltime_by_edition(t).orderBy("edition"), "edition", "label", "gold", "silver", "bronze")
    assert found == [(0, "대3", 0, 0, 1), (3, "대2", 1, 1, 0)]


def test_top_athletes_literal_keeps_fewest(spark):
    t = meet(spark, [dict(name=f"선수{i}", rank=1, event=f"{e}m") for i in range(1, 8) for e in range(i)])
    literal = rows(medals.top_athletes(t, order="literal").orderBy("rank"), "athlete_name", "total")
    assert [x[1] for x in literal] == [1, 2, 3, 4, 5]
    assert [x[1] for x in rows(medals.top_athletes(t, order="intended").orderBy("rank"), "athlete_name", "total")] == [7, 6, 5, 4, 3]


def test_alltime_order_literal_and_intended(spark):
    wins = [dict(name="가", rank=1, event="1m", region="A"), dict(name="나", rank=3, event="2m", region="B")]
    t = meet(spark, wins)
    assert [r[0] for r in rows(medals.alltime_regions(t, "literal"), "region")] == ["B", "A"]
    assert [r[0] for r in rows(medals.alltime_regions(t, "intended"), "region")] == ["A", "B"]
    nested = medals.alltime_region_standings(t).first()
    assert nested["top_teams"][0]["team_name"] == "팀" and nested["by_competition"][0]["bronze"] == 1


def test_rerank_compares_text_or_time(spark):
    t = meet(spark, [dict(name="가", event="DTT200m", record="59.123", heat=1, rank=1), dict(name="나", event="DTT200m", record="1:02.345", heat=2, rank=1), dict(name="다", event="DTT200m", record=None, heat=2, rank=2)])
    assert dict(rows(rounds.rerank_time_trials(t), "result_id", "new_ranking")) == {1: 2, 2: 1, 3: None}
    ranked = rounds.rerank_time_trials(t, by="time")
    assert dict(rows(ranked, "result_id", "new_ranking")) == {1: 1, 2: 2, 3: None}
    assert dict(rows(rounds.apply_ranking(t, ranked)["event_result"], "id", "ranking")) == {1: 1, 2: 2, 3: None}


def test_status_of_rounds(spark):
    t = meet(spark, [dict(name="가", round="예선", result=False), dict(name="나", round="준결승", rank=1), dict(name="다", round="준결승", result=False), dict(name="라", round="결승", rank=1)], **{})
    assert dict(rows(rounds.round_status(t), "round", "status")) == {"예선": "엔트리만", "준결승": "일부", "결승": "완료"}


def test_round_lists_only_results_once_there_are_any(spark):
    t = meet(spark, [dict(name="가", heat=1, rank=2, bib=1), dict(name="나", heat=1, rank=1, bib=2), dict(name="다", heat=1, result=False, bib=3), dict(name="라", heat=2, result=False, bib=4)])
    assert rows(rounds.round_rows(t).orderBy("heat_number", "position"), "heat_number", "athlete_name") == [(1, "나"), (1, "가")]
    assert [len(r["rows"]) for r in rounds.round_detail(t).collect()] == [2, 0]


def test_recent_medals_stop_at_the_sixth_competition(spark):
    d = [dict(comp=c, name="가", rank=1, date=dt.date(2020, c, 1)) for c in range(1, 8)] + [dict(comp=7, name="가", rank=2, event="1,000m", date=dt.date(2020, 7, 1))]
    t = meet(spark, d)
    assert [r[0] for r in rows(athletes.recent_medals(t).orderBy("position"), "competition_id")] == [7, 7, 6, 5, 4, 3]


def test_entries_by_id_else_by_name(spark):
    t = meet(spark, [dict(name="가", athlete_id=1, comp=1), dict(name="가", comp=2), dict(name="나", comp=1)], athlete=[{"id": 1, "name": "가", "gender": "M"}, {"id": 2, "name": "나", "gender": "M"}, {"id": 3, "name": "다", "gender": "M"}])
    assert sorted(rows(athletes.athlete_entries(t))) == [(1, 1), (2, 3)]
    assert dict(rows(athletes.latest_profiles(t), "athlete_id", "latest_entry_id")) == {1: 1, 2: 3, 3: None}
    assert {r["name"] for r in athletes.athletes_latest(t, "가").collect()} == {"가"}


def test_participants_count_all_but_m_as_female(spark):
    t = meet(spark, [dict(name="가"), dict(name="나", gender="F"), dict(name="다", gender=None, region=None), dict(name="라", event="계주3,000m")])
    assert rows(stats.participant_totals(t)) == [(1, 1, 2, 2, 1)]


def test_breakdown_uses_first_round_with_heats(spark):
    t = meet(spark, [dict(name="가", round="예선", number=1), dict(name="나", round="예선", number=1), dict(name="가", round="결승", number=2), dict(name="다", round="결승", number=2)])
    assert rows(stats.division_breakdown(t)) == [(1, "중등부", 2, 0, 2)]


def test_new_records_order(spark):
    t = meet(spark, [dict(name="가", mark="대회신", record="50.000"), dict(name="나", mark="세계신", division="남일부"), dict(name="다", mark="대회신", division="여초부 1,2학년"), dict(name="라", mark="대회신", record="49.000")])
    assert [r[0] for r in rows(stats.new_records(t).orderBy("place"), "athlete_name")] == ["나", "다", "라", "가"]


def test_profile_and_suggestions(spark):
    t = meet(spark, [dict(name="가나", rank=1), dict(name="가나", rank=2, event="1,000m"), dict(name="가다", rank=3)])
    assert len(athletes.athlete_profile(t, 1, "가나").first()["recent_medals"]) == 2
    assert sorted(r[0] for r in rows(athletes.suggest_entries(t, q="가"), "athlete_name")) == ["가나", "가나", "가다"]
    assert athletes.performances(t, 1).count() == 0
