"""Name index, stored pages, reading in parts and extraction by a program."""

import os
import random
import stat

import pytest
from pyspark.sql import functions as F

from podium import tables
from podium.operators import athletes, identity
from podium.operators.names import NameIndex, grams_of
from podium.operators.paging import Pages
from podium.sources import results, startlist, text
from tests.small import catalog, meet, rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searches_by_index(spark, tmp_path):
    rng = random.Random(2)
    given = [(i, "".join(rng.choice("가나다라'%_") for _ in range(rng.randrange(5)))) for i in range(500)] + [(900, None), (901, "가나가나가나"), (902, "가나가나가나")]
    df = spark.createDataFrame(given, "id long, name string")
    index = NameIndex(spark, str(tmp_path / "i"), buckets=7).build(df, "id", "name")
    for q in ("가나", "나가나", "가", "", "'%", "_", "라라라라", "없는이름", "가나가나가나"):
        found = index.narrowed(df, q, "id").where(F.col("name").contains(q))
        assert sorted(rows(found, "id")) == sorted((i,) for i, n in given if n is not None and q in n), q
    assert index.keys("가") is None and grams_of("가나가나") == ["가나", "나가"]
    plan = plan_of(index.keys("가나"))
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan and "gram" in plan
    names = [n for _, n in given if n and "가나" in n]
    assert dict(index.rarest("가나")) == {"가나": len(names)}


def test_searches_of_people(spark, tmp_path):
    t = meet(spark, [dict(name="김가나", athlete_id=1, rank=1), dict(name="김다라", athlete_id=2, rank=2), dict(name="박가나", team="팀가나")], athlete=[{"id": 1, "name": "김가나", "gender": "M"}, {"id": 2, "name": "김다라", "gender": "M"}, {"id": 3, "name": "가나", "gender": "M"}])
    own = NameIndex(spark, str(tmp_path / "a")).build(t["athlete"], "id", "name")
    entries = NameIndex(spark, str(tmp_path / "e")).build(t["competition_entry"], "id", "athlete_name")
    assert rows(athletes.search(t, " 가나 ", names=own), "id") == rows(athletes.search(t, "가나"), "id") == [(3,), (1,)]
    assert rows(athletes.athletes_latest(t, "가나", names=own)) == rows(athletes.athletes_latest(t, "가나"))
    assert sorted(rows(athletes.suggest_entries(t, q="가나", names=entries))) == sorted(rows(athletes.suggest_entries(t, q="가나")))


@pytest.mark.parametrize("ranges", [1, 8])
def test_pages_of_a_stored_order(spark, tmp_path, ranges):
    rng = random.Random(3)
    given = [(i, rng.choice(["가", "나", "다", None])) for i in range(333)]
    df = spark.createDataFrame(given, "id long, name string").repartition(5)
    pages = Pages(spark, str(tmp_path / "p"), ["name", "id"]).build(df, ranges)
    want = sorted(given, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    for number, size in ((0, 20), (3, 20), (16, 20), (17, 20), (0, 1000), (110, 3), (5, 64)):
        part, about = pages.page(number, size)
        assert [(r["id"], r["name"], r["position"]) for r in part.collect()] == [(*x, k) for k, x in enumerate(want, 1)][number * size : (number + 1) * size]
        assert about["total_elements"] == 333 and about["total_pages"] == -(-333 // size) and about["last"] == ((number + 1) * size >= 333)
    by_id = Pages(spark, str(tmp_path / "q"), ["id"]).build(df, ranges)
    assert [r["id"] for r in by_id.after(100, 30).collect()] == list(range(101, 131)) and [r["id"] for r in by_id.after(-1, 5).collect()] == [0, 1, 2, 3, 4]
    assert by_id.after(332, 5).collect() == []
    assert "PartitionFilters: [isnotnull(_range" in plan_of(pages.page(3, 20)[0])
    with pytest.raises(ValueError):
        pages.page(0, 0)


def test_pages_of_nothing(spark, tmp_path):
    pages = Pages(spark, str(tmp_path / "p"), ["id"]).build(spark.range(0), 4)
    part, about = pages.page(0, 20)
    assert part.collect() == [] and about["total_elements"] == 0 and about["last"]


def test_candidates_meet_on_rare_grams(spark):
    """Every team begins alike; a brute-force comparison of all names."""
    rng = random.Random(4)
    inner = ["".join(rng.choice("가나다라마") for _ in range(rng.randrange(4))) for _ in range(120)]
    teams = [{"id": i, "name": f"한국{x}", "region": "경기"} for i, x in enumerate(sorted({*inner[:60], "학교"}), 1)]
    given = sorted({f"한국{x}"[rng.randrange(3) :] or "한" for x in inner[60:]} | {"학교", "한국학교팀", "가"})
    t = meet(spark, [dict(name=f"선수{i}", team=x) for i, x in enumerate(given)], team=teams)
    want = sorted((x, y["id"]) for x in given for y in teams if x in y["name"] or y["name"] in x)
    assert sorted(rows(identity.team_candidates(t), "team_name", "team_id")) == want


def test_database_in_parts_with_pushed_filters(spark):
    t = catalog(spark, team=[{"id": i, "name": f"팀{i}", "region": "경기"} for i in range(1, 101)])
    url, properties = "jdbc:derby:memory:parts;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    t["team"].write.jdbc(url, "team", mode="overwrite", properties=properties)
    t["athlete"].write.jdbc(url, "athlete", mode="overwrite", properties=properties)
    got = tables.load_jdbc(spark, url, properties, ["team", "athlete"], where={"team": "id > 40"}, partition_rows=10, connections=6)
    assert got["team"].rdd.getNumPartitions() == 6 and got["athlete"].rdd.getNumPartitions() == 1
    assert sorted(rows(got["team"], "id", "name")) == [(i, f"팀{i}") for i in range(41, 101)] and got["athlete"].count() == 0
    plan = plan_of(got["team"].where("name <> '팀50'").select("id"))
    pushed, read = plan.split("PushedFilters: ")[1].split("ReadSchema: ")
    assert "*GreaterThan(id,40)" in pushed and "*Not(EqualTo(name,팀50))" in pushed and read.startswith("struct<id:bigint>")


def test_long_lists_are_read_by_many_tasks(spark):
    """A start list of a million lines gives what its parts give, and more than one task reads it."""
    parts = []
    for e in range(200):
        parts.append(f"제{1 + e // 100}일차" if e % 100 == 0 else "")
        parts.append(f"{e + 1} 여중부 500m 결승" if e % 2 else f"{e + 1} 남중부 1,000m 예선")
        for h in range(2):
            parts += [f"< {h + 1}조 >"] if e % 3 else []
            parts += [f"{k} 선수{k} (경기 학교3)" for k in range(2500)]
    docs = spark.createDataFrame([("d", "\n".join(parts)), ("e", "\n".join(parts[:30_000])), ("f", None)], "path string, text string")
    assert len(parts) > 1_000_000
    read = startlist.parse_start_list(docs)
    got = read.groupBy("doc", "day_number", "event_number", "gender", "round", "heat_number").agg(F.count("*").alias("n"), F.sum("bib_number").alias("s"))
    want = {}
    for doc, n in (("d", len(parts)), ("e", 30_000)):
        day, event, heat = 0, None, 0
        for x in parts[:n]:
            if x.startswith("제"):
                day = int(x[1])
            elif "중부" in x:
                event, heat = (int(x.split()[0]), "F" if "여" in x else "M", x.split()[-1]), 0
            elif x.startswith("<"):
                heat = int(x[2])
            elif x:
                key = (doc, day, *event, heat)
                n_, s_ = want.get(key, (0, 0))
                want[key] = (n_ + 1, s_ + int(x.split()[0]))
    assert {tuple(r)[:6]: tuple(r)[6:] for r in got.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these lines are small enough to be put together again
    try:
        shares = text.lines(docs).where("doc = 'd'").groupBy(F.spark_partition_id()).count()
        assert shares.count() > 1 and shares.agg(F.max("count")).first()[0] < 600_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_results_across_blocks(spark, monkeypatch, block):
    sheet = """5 팀연습
1-1 여초부 5,6학년 500m+D 예선
1     3   앞선이  경기   앞학교  47.000
      11.111
순위  번호  성명    시도    소속      기록
      22.222
1     4   가나다   경기   샘플클럽   48.123  대회신 Q

2     30  라마바   충남   예시초등학교
심판장 홍길동
              49.500
DNF   7   사아자   부산   예시클럽"""
    team = "9 여중부 계주3,000m 결승\n순위  레인 팀명  시도\n1    3   예시중학교         대구          Q     4:55.912\n(가나다,라마바)\n2    5   예시연맹 전북                 4:35.053"
    docs = spark.createDataFrame([("a", sheet), ("b", team), ("c", "no header")], "path string, text string")
    whole = rows(results.parse_results(docs).orderBy("doc", "pos"))
    monkeypatch.setattr(text.carried, "__defaults__", ("path", "text", block))
    monkeypatch.setattr(text.lines, "__defaults__", ("path", "text", block))
    assert rows(results.parse_results(docs).orderBy("doc", "pos")) == whole
    assert [(r[0], r[5], r[6], r[10]) for r in whole] == [("a", 4, "가나다", "48.123"), ("a", 30, "라마바", "49.500"), ("a", 7, "사아자", None), ("b", 3, "예시중학교", "4:55.912"), ("b", 5, "예시연맹", "4:35.053")]


def test_files_are_extracted_by_a_program(spark, tmp_path):
    """A stand-in for the program: it prints the file, fails, or takes too long, as the file says."""
    program = tmp_path / "program"
    program.write_text("#!/bin/sh\ncase $(head -c 4 $1) in slow) echo early; exec sleep 20;; fail) echo broken >&2; exit 3;; *) cat $1;; esac\n")
    os.chmod(program, os.stat(program).st_mode | stat.S_IXUSR)
    for name, content in (("good", "1 여초부 500m 예선\n가나다\n"), ("slow", "slow"), ("fail", "fail"), ("large", "x" * 3_000_000)):
        (tmp_path / f"{name}.pdf").write_bytes(content.encode())
    found = text.pdf_text(spark, f"{tmp_path}/*.pdf", seconds=3, program=(str(program), "{path}"))
    got = {r["path"].rsplit("/", 1)[1][:-4]: (r["text"], r["reason"]) for r in found.collect()}
    assert got.pop("large") == ("x" * 3_000_000, None)
    assert got == {"good": ("1 여초부 500m 예선\n가나다\n", None), "slow": (None, "not done in 3 s"), "fail": (None, "exit 3: broken")}
    of_none = text.extracted(spark.createDataFrame([("a", b""), ("b", None)], "path string, content binary"), program=(str(program), "{path}"))
    assert sorted(rows(of_none)) == [("a", "", None), ("b", "", None)]
    missing = text.pdf_text(spark, f"{tmp_path}/good.pdf", program=("/no/such/program", "{path}")).first()
    assert (missing["text"], missing["reason"]) == (None, "no program /no/such/program")
