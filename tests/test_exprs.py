"""Column functions, by table."""

import pytest
from pyspark.sql import functions as F

from podium.functions import exprs as x

CASES = [
    (x.report_division, "여자초부 5,6학년", "초등부 5,6학년"), (x.report_division, "남자18세이하부", "18세이하부"), (x.report_division, "남일부", "일반부"),
    (x.division_category, None, ""), (x.division_category, "여초부", "초등"), (x.division_category, "남일부", "대일"),
    (x.record_rank, "부별신", 2), (x.record_rank, "?", 9), (x.distance, "E3,000m", 3000), (x.distance, "계주", 99999),
    (x.division_rank, "초등부 일반(B조) 3,4학년", 15), (x.division_rank, "초등부 1,2학년", 10), (x.division_rank, "대학부", 40), (x.division_rank, "기타", 99),
    (x.infer_gender, "여자부", "F"), (x.infer_gender, "혼성", "M"), (x.heat_from_youth_code, "19000", 0), (x.heat_from_youth_code, "3092", 2), (x.heat_from_youth_code, "x", 0),
    (x.record_mark, "Q 한국신 대회신", "한국신"), (x.record_mark, "", None), (x.record_mark_two, "세계신 대회신", "대회신"),
    (x.rank_note, "EL", "제외"), (x.rank_note, "DSQ", "실격"), (x.rank_note, "3", None), (x.round_base, "예선2조", "예선"), (x.round_base, "결승경기12", "결승"), (x.plain_event, "E3,000m", "E3000m"),
    (x.affiliation_note, "경기 팀에스6", "경기 팀에스"), (x.affiliation_note, "123", "1"), (x.record_ms, "1:02.345", 62345), (x.record_ms, "59.5", 59500), (x.record_ms, "11", None),
    (x.lenient_int, " 12 ", 12), (x.lenient_int, "x", None), (x.blank_to_null, " \t", None), (x.blank_to_null, " 가 ", "가"), (x.is_blank, " \n", True), (x.is_blank, None, True), (x.is_blank, "가", False),
    (x.medal_score, 1, 7), (x.medal_score, 6, 1), (x.medal_score, 7, 0), (x.is_team_event, "팀dtt200m", True), (x.is_team_event, "DTT200m", False),
]


@pytest.mark.parametrize("f, given, expected", CASES)
def test_function(spark, f, given, expected):
    value = F.lit(given) if given is not None else F.lit(None).cast("string")
    assert spark.range(1).select(f(value).alias("v")).first()["v"] == expected


def test_composite_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(x.division_variants(F.lit("남자초등부"))) == ["남자초등부", "남초", "남자12세이하부", "남자13세이하부"]
    assert one(x.division_variants(F.lit("여자중학부"))) == ["여자중학부", "여중", "여자15세이하부", "여자16세이하부", "여16이하"]
    assert one(x.round_variants(F.lit("예선2조"))) == ["예선2조", "예선"]
    assert tuple(one(x.affiliation(F.lit("경기 경기 샘플클럽6")))) == ("경기", "샘플클럽", 6)
    assert tuple(one(x.affiliation(F.lit("충남")))) == ("충남", "", None)
    assert one(x.day_label(F.lit(1), F.lit("2026-03-20").cast("date"))) == "제1일차 (3/20 금)"
    assert one(x.day_label(F.lit(2), F.lit(None).cast("date"))) == "제2일차"
    assert one(x.heat_from_code(F.lit("30912345"), F.lit("결승"))) == 0
    assert one(x.heat_from_code(F.lit("123456"), F.lit("예선3조"))) == 3
    assert one(x.heat_from_code(F.lit("123456"), F.lit("예선"))) == 6
    assert one(x.heat_from_code(F.lit("12"), F.lit("예선"))) == 0
    assert one(x.with_rank_note(F.lit("경고"), F.lit("DQ"))) == "경고 실격"
    assert one(x.competition_label(F.lit(3), F.lit(None).cast("string"), F.lit("대회"))) == "제3회 대회"
