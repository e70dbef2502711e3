"""Parsers on invented sheets."""

from podium.operators import facts
from podium.sources import listings, results, startlist, text
from tests.small import catalog, meet, rows

START_LIST = """
          제1일차(2026. 3.20.금)
      1 여초부 5,6학년 500m+D 예선
< 1조 >
   4   가나다 (경기 경기 샘플클럽6)
  30   ABCDEF (충남 예시초등학교5)
      2 남중부 E3,000m
   7   사아자 (부산 예시클럽)
      9 여중부 계주3,000m 결승
   예시중학교 (대구 예시중학교)
   (가나다,라마바)
"""
SHEET = """1-1 여초부 5,6학년 500m+D 예선
순위  번호  성명    시도    소속      기록
1     4   가나다   경기   샘플클럽   48.123  대회신 Q
2     30  라마바   충남   예시초등학교
              49.500
DNF   7   사아자   부산   예시클럽
3     8   차카타   부산   예시학교 11
심판장 홍길동
"""
TEAM_SHEET = """9 여중부 계주3,000m 결승
순위  레인 팀명  시도
1    3   예시중학교         대구          Q     4:55.912
(가나다,라마바)
2    5   예시연맹 전북                 4:35.053
"""


def _docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "path string, text string")


def test_start_list(spark):
    parsed = startlist.parse_start_list(_docs(spark, START_LIST, None))
    got = rows(parsed.orderBy("pos"), "day_number", "event_number", "division_name", "gender", "event_name", "round", "heat_number", "bib_number", "athlete_name", "region", "team_name", "grade")
    assert got == [
        (1, 1, "여초부 5,6학년", "F", "500m+D", "예선", 1, 4, "가나다", "경기", "샘플클럽", 6),
        (1, 1, "여초부 5,6학년", "F", "500m+D", "예선", 1, 30, "ABCDEF", "충남", "예시초등학교", 5),
        (1, 2, "남중부", "M", "E3,000m", "결승", 0, 7, "사아자", "부산", "예시클럽", None),
        (1, 9, "여중부", "F", "계주3,000m", "결승", 0, 0, "예시중학교", "대구", "예시중학교", None),
    ]


def test_import_twice_changes_nothing(spark):
    t = catalog(spark, competition=[{"id": 1, "name": "대회", "short_name": "대"}])
    parsed = startlist.parse_start_list(_docs(spark, START_LIST))
    once = startlist.apply_start_list(t, parsed, 1)
    twice = startlist.apply_start_list(once, parsed, 1)
    counts = {k: v.count() for k, v in twice.items() if k in ("event", "event_round", "event_heat", "competition_entry", "heat_entry")}
    assert counts == {"event": 3, "event_round": 3, "event_heat": 3, "competition_entry": 4, "heat_entry": 4}
    sheet = results.parse_results(_docs(spark, SHEET))
    stored = results.apply_results(once, sheet, 1)
    again = results.apply_results(stored, sheet, 1)
    assert again["event_result"].count() == 4 and again["heat_entry"].count() == 6
    assert sorted(r[0] for r in rows(facts.result_fact(again), "athlete_name")) == ["ABCDEF", "가나다", "사아자", "차카타"]


def test_roster(spark):
    parsed = startlist.parse_roster(_docs(spark, START_LIST + START_LIST))
    assert sorted(rows(parsed, "name", "gender", "notes")) == [("ABCDEF", "F", "충남 예시초등학교"), ("가나다", "F", "경기 경기 샘플클럽"), ("사아자", "M", "부산 예시클럽")]
    t = catalog(spark, athlete=[{"id": 1, "name": "ABCDEF", "gender": "F", "notes": "충남 예시초등학교"}])
    out, counts = startlist.apply_roster(t, parsed)
    assert tuple(counts.first()) == (2, 1) and out["athlete"].count() == 3


def test_result_sheet(spark):
    got = rows(results.parse_results(_docs(spark, SHEET, "결과 없음", "3 남중부 결승종합\n순위\n1 2 가  나")).orderBy("pos"), "event_number", "heat_number", "bib_number", "athlete_name", "region", "team_name", "ranking", "record", "new_record", "qualification", "note")
    assert got == [
        (1, 1, 4, "가나다", "경기", "샘플클럽", 1, "48.123", "대회신", "Q", None),
        (1, 1, 30, "라마바", "충남", "예시초등학교", 2, "49.500", None, None, None),
        (1, 1, 7, "사아자", "부산", "예시클럽", None, None, None, None, "미완주"),
        (1, 1, 8, "차카타", "부산", "예시학교", 3, "11", None, None, None),
    ]


def test_team_sheet(spark):
    got = rows(results.parse_results(_docs(spark, TEAM_SHEET)).orderBy("pos"), "team_event", "bib_number", "athlete_name", "region", "ranking", "record", "qualification")
    assert got == [(True, 3, "예시중학교", "대구", 1, "4:55.912", "Q"), (True, 5, "예시연맹", "전북", 2, "4:35.053", None)]


def test_team_sheet_read_literally(spark):
    got = rows(results.parse_results(_docs(spark, TEAM_SHEET), literal=True).orderBy("pos"), "athlete_name", "region")
    assert got == [("예시중학교", "대구"), ("예시연맹 전북", "4:35.053")]


def test_pdf_without_the_program_or_of_no_use_is_null(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"not a pdf")
    found = text.pdf_text(spark, str(tmp_path)).first()
    assert found["text"] is None and found["reason"]


def test_csv_and_targets(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,종목,종별,세부,라운드,a,b,c,d,url\n1,"롤러, ""S""",남고부,500m,예선,,,,,http://x/?gameno=1&searchKindCd=2&detailClassCd=3&rhCd=4&gameno=5\n2,수영,,,,,,,,http://x/?a=b\n3,인라인,남고부,500m,예선,,,,,http://x/?gameno=5&kindCd=2&detailClassCd=3&rhCd=4\n', encoding="utf-8")
    kept = listings.keep_sport(listings.read_csv(spark, str(tmp_path / "a.csv")))
    assert rows(kept.orderBy("c0"), "c1") == [('롤러, "S"',), ("인라인",)]
    got = listings.scrape_targets(kept.withColumn("pos", kept["c0"].cast("int")))
    assert rows(got, "pos", "division", "gameno", "kind", "detail", "rh") == [(1, "남고부", "5", "2", "3", "4")]


def test_html_tables(spark):
    page = """<table class="x pcView"><tbody><tr><th>순위</th></tr>
    <tr><td>1</td><td>경기</td><td><span onclick="f('123');">가나다</span></td><td>팀</td><td>48.1</td><td>대회신</td></tr>
    <tr><td>-</td><td>경기</td><td>라</td><td>팀</td><td></td></tr></tbody></table>"""
    pages = spark.createDataFrame([("p", page), ("q", None)], "path string, html string")
    assert rows(listings.result_rows(pages), "ranking", "athlete_name", "player_id", "record", "new_record") == [(1, "가나다", "123", "48.1", "대회신")]
    plan = """<table><tr onclick="openSide('1','2','3','4','5')"><td>남고</td><td>500m</td><td>예선</td></tr>
    <tr onclick="openSide('1','2','3','4','6')"><td></td><td></td><td>결승</td></tr><tr onclick="openSide('1','2','3','4','7')"><td></td><td>계주</td><td>결승</td></tr></table>"""
    got = listings.schedule_rows(spark.createDataFrame([("p", plan)], "path string, html string"))
    assert rows(got.orderBy("pos"), "division", "event", "round", "a5") == [("남고", "500m", "예선", "5"), ("남고", "500m", "결승", "6")]


def test_pages_are_read_in_pieces(spark, monkeypatch):
    """Rows of a page are the same however it is cut, and leave before it is read to its end."""
    cell = '<td onclick="f(\'7\')">가 &amp; 나</td>'
    page = '<table class="a pcView">' + f"<tr>{cell}<td>ㄱ<table><tr>ㄴ<td>ㄷ</td></tr></table>x</td></tr><script>if (a < 1) b = '<td>'</script><!-- <tr> --><tr></tr><tr><th>h</th>{cell}</tr>" * 50 + "</table> <td>끝</td> <td>auf"
    pages = spark.createDataFrame([("p", page), ("q", None), ("r", ""), ("s", cell)], "path string, html string").coalesce(1)
    parser = listings._Cells()
    parser.feed(page)
    wanted = [("p", k, r["table"], [" ".join(c["text"].split()) for c in r["cells"] if c["tag"] == "td"]) for k, r in enumerate(parser.rows)]
    wanted = [x for x in wanted if x[3]] + [("s", 0, "", ["가 & 나"])]
    for piece, feed, given in ((3, 1, 1), (64, 200, 7), (listings.PIECE, listings.FEED, listings.GIVEN)):
        for name, value in (("PIECE", piece), ("FEED", feed), ("GIVEN", given)):
            monkeypatch.setattr(listings, name, value)
        got = [(r.doc, r.pos, r.in_table, [c.text for c in r.cells]) for r in listings.table_rows(pages).collect()]
        assert got == wanted

    parser, most = listings._Cells(), 0
    for _ in range(1000):
        parser.feed(f"<tr>{cell * 5}</tr>")
        most = max(most, len(parser.rows))
        parser.finished()
    assert most <= 2


def test_record_list_and_marks(spark):
    cell = lambda label, value: f'<td data-label="{label}">{value}</td>'
    first = "".join(cell(*x) for x in (("종별", "남자중학부"), ("세부종목", "1,000m"), ("경기구분", "예선2조"), ("선수명/팀명", "가"), ("기록", "50.000"), ("일자", "1")))
    second = "".join(cell(*x) for x in (("종별", ""), ("선수명/팀명", "나"), ("기록", "51.000"), ("일자", "1")))
    pages = spark.createDataFrame([("p", f"<table><tr>{first}</tr><tr>{second}</tr></table>")], "path string, html string")
    got = listings.record_rows(pages)
    assert rows(got.orderBy("rec"), "division", "event", "round", "athlete", "record") == [("남자중학부", "1,000m", "예선2조", "가", "50.000"), ("남자중학부", "1,000m", "예선2조", "나", "51.000")]
    t = meet(spark, [dict(name="가", division="남중", event="1,000m", round="예선", record="50.000", mark="세계신"), dict(name="나", division="남고", event="1,000m", round="예선", record="51.000")])
    wanted = got.selectExpr("1L AS competition_id", "division", "event", "round", "athlete", "record")
    out, counts = listings.mark_records(t, wanted)
    assert dict(rows(out["event_result"], "id", "new_record")) == {1: "대회신", 2: None} and tuple(counts.first()) == (1, 1, 0)
    assert dict(rows(listings.mark_records(t, wanted, overwrite=False)[0]["event_result"], "id", "new_record")) == {1: "세계신", 2: None}
