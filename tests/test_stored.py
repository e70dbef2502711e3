"""Ledger of imported files and a store partitioned by competition."""

import os

import pytest

from podium import tables
from podium.operators import schedule
from podium.sources import listings, results
from podium.sources.ledger import Ledger
from tests.small import meet, rows
from tests.test_parsers import SHEET, TEAM_SHEET


def sheets(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def test_files_are_read_once(spark, tmp_path):
    asked = []

    def read(docs):
        asked.append(sorted(rows(docs, "path")))
        return results.parse_results(docs)

    ledger = Ledger(spark, str(tmp_path / "l"))
    first = sheets(spark, a=SHEET, b=SHEET, c=TEAM_SHEET, d=None, e="no header")
    assert ledger.take("1", first, read).count() == 6
    assert asked == [[("a",), ("c",), ("d",), ("e",)]]
    assert ledger.take("1", sheets(spark, z="new"), read) is None
    assert ledger.take("2", first, read) is None and len(asked) == 1 and ledger.batches() == ["1"]
    more = sheets(spark, a=SHEET.replace("48.123", "47.999"), other=TEAM_SHEET)
    assert {r["record"] for r in ledger.take("3", more, read).collect()} >= {"47.999"} and asked[1:] == [[("a",)]]
    assert ledger.rows().count() == 10 and ledger.rows("1").count() == 6 and ledger.files().count() == 5
    assert not os.listdir(tmp_path / "l" / "aside")


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))

    def read(docs):
        raise OSError("lost")

    with pytest.raises(OSError):
        ledger.take("1", sheets(spark, a=SHEET), read)
    assert ledger.batches() == [] and ledger.rows() is None
    assert ledger.take("1", sheets(spark, a=SHEET), results.parse_results).count() == 4


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_change_rewrites_one_competition(spark, tmp_path):
    given = [{"id": i, "competition_id": 1 + i % 3, "day_number": 1 + i % 2, "entry_type": "race", "event_name": f"e{i}"} for i in range(30)]
    t = meet(spark, [dict(name="가", comp=c) for c in (1, 2, 3)], schedule_entry=given)
    store = tables.Store(spark, str(tmp_path / "s")).save(t)
    assert sorted(rows(store.load()["competition_entry"])) == sorted(rows(t["competition_entry"])) and rows(store.load()["team"]) == []
    before = files(tmp_path)
    mine = store.table("schedule_entry", 2)
    schedule.replace_stored(store, 2, mine.where("id < 15").drop("id", "competition_id"))
    after = files(tmp_path)
    assert {f for f in before | after if before.get(f) != after.get(f)} == {f for f in before | after if "schedule_entry" in f and "_competition=2" in f}
    assert sorted(rows(store.table("schedule_entry", 2), "event_name")) == sorted((f"e{i}",) for i in range(15) if i % 3 == 1)
    assert store.table("schedule_entry").where("competition_id <> 2").count() == 20 and len(set(rows(store.table("schedule_entry"), "id"))) == 25
    store.replace("schedule_entry", 2, mine.limit(0))
    assert store.table("schedule_entry", 2).count() == 0 and store.table("schedule_entry").count() == 20
    with pytest.raises(ValueError):
        store.replace("schedule_entry", 2, store.table("schedule_entry", 1))
    plan = store.table("schedule_entry", 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_competition" in plan


@pytest.mark.parametrize("charset", ["EUC-KR", "CP949", "UTF-8", "UTF-16"])
def test_listings_in_their_charsets(spark, tmp_path, charset):
    lines = ["n,종목,종별", '1,"롤러, ""S""",남고부', "2,수영,여중부", "3,,똠" if charset != "EUC-KR" else "3,,똑"]
    (tmp_path / "a.csv").write_bytes("\n".join(lines).encode(charset))
    got = rows(listings.read_csv(spark, str(tmp_path), charset))
    assert got == [("n", "종목", "종별"), ("1", '롤러, "S"', "남고부"), ("2", "수영", "여중부"), ("3", None, lines[3][-1])]
    assert rows(listings.keep_sport(listings.read_csv(spark, str(tmp_path), charset)), "c0") == [("1",)]


def test_bytes_of_another_charset_are_replaced(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n1,\xff\xff\n")
    assert "\ufffd" in rows(listings.read_csv(spark, str(tmp_path), "EUC-KR"))[1][1]
