import base64
import hashlib
import itertools
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from podium.llm import chat, common, queries, warc

from .conftest import SF, ordered

HTML = [(1, "http://a/", "<p>one</p>"), (2, "http://a/", "<p>one</p>"), (3, None, None), (4, "http://b/\r\nx", ""), (5, "http://c/", "ü\r\n\r\nWARC/1.1\r\n\r\n" * 3), (6, "http://c/", "x" * 300_000), (7, "u", "<p>one</p>"), (7, "u", "<p>one</p>"), (None, "n", "<p>one</p>")]


def described(rows):
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = i == best[html or ""]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best[html or ""]))
    return out


def test_archives_of_odd_pages(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in HTML], "page_id long, url string, html string, digest string")
    assert ordered(warc.digest(pages, least_bytes=0).collect()) == ordered(described(HTML))
    assert warc.digest(pages.limit(0), least_bytes=0).collect() == []


def test_archives_of_generated_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert ordered(queries.op2_warc(spark, SF).collect()) == ordered(described(rows))


def test_archives_go_once_they_are_read(spark):
    before = set(Path(common.shared_dir(spark)).glob("warc-*/*-archives"))
    pages = spark.createDataFrame(HTML, "page_id long, url string, html string")
    assert ordered(warc.digest(pages, least_bytes=0).collect()) == ordered(described(HTML))
    assert set(Path(common.shared_dir(spark)).glob("warc-*/*-archives")) <= before


def test_captures_join_their_records(spark, tmp_path):
    pages = spark.createDataFrame(HTML[:2], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    found = warc.captures(warc.read_records(spark, str(tmp_path / "w"))).collect()
    assert len(found) == 2
    for row in found:
        assert row["request"]["concurrent_to"] == row["capture_id"] == row["response"]["record_id"]
        assert row["metadata"][0]["pageId"] in ("1", "2")


def test_damaged_archives_are_errors():
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 90\r\n\r\nshort"))


def test_damaged_payloads_are_errors(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>payload one</p>")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    data = next((tmp_path / "w").rglob("part-*")).read_bytes()
    records = list(warc.parse_archive(data))
    for fields, block in records:
        warc._row(fields, block)
        if fields["warc-type"] == "response":
            with pytest.raises(ValueError, match="digest"):
                warc._row(fields, block.replace(b"one", b"two"))


def test_archives_are_split_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 18)
    pages = spark.createDataFrame([(i, "u", f"{i}" * n) for i, n in enumerate([50_000] * 12 + [200_000] * 4 + [3_000_000])], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    files = [list(warc.parse_archive(f.read_bytes())) for f in (tmp_path / "w").rglob("part-*")]
    blocks = [[len(block) for fields, block in f if fields["warc-type"] == "response"] for f in files]
    assert sum(map(len, blocks)) == 17 and all(len(b) == 1 or sum(b) < (1 << 18) + 10_000 for b in blocks)
    assert ordered(warc.digest(pages, least_bytes=0).collect()) == ordered(described([tuple(r) for r in pages.collect()]))


TURNS = [(1, 1, "user", "hi"), (1, 2, "assistant", r"a\s \### </turn> ###"), (1, 3, "assistant", None), (1, 3, "assistant", None), (2, None, None, "x: y"), (None, 1, "assistant: ", "### user: z</turn>"), (3, 1, "assistant", ""), (4, 1, "assistant", "é\U0001f600" * 3000)]


def test_formatted_turns_come_back(spark):
    rows = spark.createDataFrame([(*r, 0) for r in TURNS], "conv_id long, turn long, role string, text string, start int")
    made = chat.format_chats(rows)
    got = {r["conv_id"]: r for r in made.select("conv_id", "formatted", chat.parse(made.formatted).alias("turns"), chat.loss_text(made.formatted, made.loss_spans).alias("loss")).collect()}
    for conv in {r[0] for r in TURNS}:
        mine = sorted((r for r in TURNS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [tuple(t) for t in got[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[conv]["loss"] == "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert got[1]["formatted"].count("### ") == 2  # adjacent turns of a role share a header
    assert chat.digest(rows.limit(0)).collect() == []


def test_sums_before(spark):
    sizes = [1, 2, 3, 7, 50, 2000]
    rows = spark.createDataFrame([([(k * 37) % 101 for k in range(n)],) for n in sizes], "x array<long>")
    for r in rows.select("x", chat.sums_before(F.col("x")).alias("s")).collect():
        assert r["s"] == [0, *itertools.accumulate(r["x"])][:-1]


def test_a_conversation_of_very_many_turns(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.digest(rows).first()
    assert got["n_turns"] == 30_000 and got["loss_sha256"] == hashlib.sha256("".join(str(i) for i in range(30_000) if i % 3).encode()).hexdigest()


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = queries.op5_chat(spark, SF)
    assert ordered(got.collect()) == ordered(con.sql(f"SELECT {', '.join(got.columns)} FROM ({chat.SQL})").fetchall())
