"""Result listings of national and youth games: CSV, HTML pages and record lists.

Pages come as strings; nothing is fetched here.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.functions.exprs import blank_to_null, division_variants, heat_from_code, heat_from_youth_code, infer_gender, is_team_listing, plain_event, record_mark_two, round_variants, trimmed
from podium.operators import facts
from podium.operators.mutate import find_or_create, upsert_results, with_ids
from podium.sources.text import so_far
from podium.tables import Catalog, keep

# Words that mark the sport, and parameter names of result pages.
SPORTS = ("롤러", "로울러", "인라인")
PARAMETERS = {"gameno": ("searchGameno", "gameno"), "kind": ("searchKindCd", "kindCd"), "detail": ("searchDetailClassCd", "detailClassCd"), "rh": ("rhCd",)}
LABELS = {"종별": "division", "세부종목": "event", "경기구분": "round", "선수명/팀명": "athlete", "기록": "record", "일자": "day"}


#: Charsets that Spark's readers decode themselves.
DECODED = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32")


def read_csv(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """Quoted CSV with a header line; columns c0, c1, ...

    Of a charset that Spark doesn't decode, such as EUC-KR, the bytes are read one to a character,
    so that files are split as others, and each cell is decoded after that; it has to keep ASCII as
    it is.  What isn't of the charset becomes a replacement character.
    """
    own = charset.upper() in DECODED
    # lines of two- and four-byte charsets can't be told by one byte, so such a file is read as a whole
    df = spark.read.option("header", False).option("quote", '"').option("escape", '"').option("encoding", charset if own else "ISO-8859-1").option("multiLine", charset.upper().startswith(("UTF-16", "UTF-32"))).csv(path)
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    if own:
        return df

    @F.pandas_udf("string")
    def decoded(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: x.encode("latin-1").decode(charset, "replace"), na_action="ignore")

    return df.select(*[decoded(c).alias(c) for c in df.columns])


def keep_sport(rows: DataFrame, column: str = "c1") -> DataFrame:
    """Rows whose sport names skating."""
    wanted = F.lit(False)
    for word in SPORTS:
        wanted = wanted | F.coalesce(F.col(column).contains(word), F.lit(False))
    return rows.where(wanted)


def write_sport(rows: DataFrame, path: str, column: str = "c1") -> None:
    """The rows that name skating as quoted CSV in UTF-8, without a header line."""
    keep_sport(rows, column).write.option("quoteAll", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def query_parameters(url: str):
    """Map of a URL's parameters; the last of a repeated name wins, pairs without a name are ignored."""
    pairs = F.filter(F.split(F.regexp_extract(F.col(url), r"\?([^#]*)", 1), "&"), lambda p: p.rlike("^[^=]+="))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substr(p, F.locate("=", p) + 1).alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), e["key"]))
    return F.map_from_entries(last)


def scrape_targets(rows: DataFrame) -> DataFrame:
    """Result pages named by a CSV: division, event, round and parameters; of equal parameters the first row stays.

    ``rows`` has columns c0.. and a line number ``pos``; rows without a tenth field are dropped.
    """
    have = rows.where(blank_to_null(F.col("c9")).isNotNull()).withColumn("q", query_parameters("c9"))
    one = lambda names: F.coalesce(*[F.try_element_at("q", F.lit(n)) for n in names])
    got = have.select("pos", F.col("c2").alias("division"), F.col("c3").alias("event"), F.col("c4").alias("round"), F.col("c9").alias("url"), *[one(v).alias(k) for k, v in PARAMETERS.items()])
    key = [F.coalesce(k, F.lit("")) for k in PARAMETERS]
    return got.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).where("k = 1").drop("k")


class _Cells(HTMLParser):
    """Rows of table cells: text, attributes, and the onclick of the row and of what is inside."""

    def __init__(self):
        super().__init__()
        self.rows: list[dict] = []
        self.tables: list[str] = []
        self.cell: dict | None = None

    def handle_starttag(self, tag, attrs):
        got = dict(attrs)
        if tag == "table":
            self.tables.append(got.get("class") or "")
        elif tag == "tr":
            self.rows.append({"table": self.tables[-1] if self.tables else "", "onclick": got.get("onclick") or "", "cells": []})
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append({"table": "", "onclick": "", "cells": []})
            self.cell = {"tag": tag, "text": "", "label": got.get("data-label") or "", "onclick": got.get("onclick") or ""}
            self.rows[-1]["cells"].append(self.cell)
        elif self.cell is not None and got.get("onclick"):
            self.cell["onclick"] = got["onclick"]

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "table" and self.tables:
            self.tables.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data

    def finished(self, whole: bool = False) -> list[dict]:
        """Takes the rows that no later text changes, or all."""
        n = 0
        while n < len(self.rows) - (not whole) and (whole or self.cell is None or all(c is not self.cell for c in self.rows[n]["cells"])):
            n += 1
        out, self.rows = self.rows[:n], self.rows[n:]
        return out


_CELLS = "doc string, pos int, in_table string, row_onclick string, cells array<struct<text:string,label:string,onclick:string>>"
_CELL_LIST = pa.list_(pa.struct([(k, pa.string()) for k in ("text", "label", "onclick")]))
#: Characters of a page that are handed to a task's parser at a time, characters that it reads at once, and rows that it gives back at a time.
PIECE, FEED, GIVEN = 4096, 65_536, 2000


def table_rows(pages: DataFrame, id_col: str = "path", html_col: str = "html") -> DataFrame:
    """(doc, pos, in_table, row_onclick, cells) of the table rows of each page; null pages have none.

    A page comes in pieces and its rows leave as they end, so what a task holds doesn't grow with pages or their number.
    """

    def parsed(pieces: Iterator[tuple[int, str, str]]) -> Iterator[tuple]:
        """Rows of pages by pieces (place, doc, text); those of a page follow each other."""
        parser, at, doc, held, size = None, 0, None, [], 0

        def taken(whole: bool) -> Iterator[tuple]:
            nonlocal at, held, size
            parser.feed("".join(held))
            held, size = [], 0
            for r in parser.finished(whole):
                cells = [{"text": " ".join(c["text"].split()), "label": c["label"], "onclick": c["onclick"]} for c in r["cells"] if c["tag"] == "td"]
                if cells:
                    yield doc, at, r["table"], r["onclick"], cells
                at += 1

        for place, next_doc, text in pieces:
            if place == 0:
                if parser:
                    yield from taken(True)
                parser, at, doc = _Cells(), 0, next_doc
            held.append(text)
            size += len(text)
            # what the parser has kept, say of a long script, is read again, so it gets as much anew
            if size >= max(FEED, len(parser.rawdata)):
                yield from taken(False)
        if parser:
            yield from taken(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = parsed(x for b in batches for x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        while rows := list(islice(found, GIVEN)):
            columns = zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string(), _CELL_LIST), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns], names=["doc", "pos", "in_table", "row_onclick", "cells"])

    pieces = F.posexplode(F.regexp_extract_all(html_col, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("place", "text")
    return pages.select(F.col(id_col).cast("string").alias("doc"), pieces).select("place", "doc", "text").mapInArrow(run, _CELLS)


def result_rows(pages: DataFrame, **columns: str) -> DataFrame:
    """(doc, pos, ranking, region, athlete_name, player_id, team_name, record, note, new_record) of result tables; rows without a number for rank or with fewer than 5 cells are left out."""
    cell = lambda n: F.get("cells", F.lit(n))["text"]
    rows = table_rows(pages, **columns).where(F.array_contains(F.split("in_table", r"\s+"), "pcView") & (F.size("cells") >= 5))
    rows = rows.withColumn("ranking", trimmed(cell(0)).try_cast("int")).where("ranking IS NOT NULL")
    player = F.nullif(F.regexp_extract(F.get("cells", F.lit(2))["onclick"], r"'(\d+)'", 1), F.lit(""))
    return rows.select("doc", "pos", "ranking", cell(1).alias("region"), cell(2).alias("athlete_name"), player.alias("player_id"), cell(3).alias("team_name"), cell(4).alias("record"), blank_to_null(cell(5)).alias("note"), record_mark_two(F.coalesce(cell(5), F.lit(""))).alias("new_record"))


def schedule_rows(pages: DataFrame, **columns: str) -> DataFrame:
    """(doc, pos, division, event, round, a1..a5) of rows that open a result; blank divisions and events repeat those above, relays go."""
    rows = table_rows(pages, **columns)
    args = F.regexp_extract_all("row_onclick", F.lit(r"'([^']*)'"), F.lit(1))
    rows = rows.where(F.col("row_onclick").startswith("openSide") & (F.size(args) == 5))
    cell = lambda n: blank_to_null(F.get("cells", F.lit(n))["text"])
    out = rows.select("doc", "pos", so_far(cell(0)).alias("division"), so_far(cell(1)).alias("event"), cell(2).alias("round"), *[F.get(args, F.lit(i)).alias(f"a{i + 1}") for i in range(5)])
    return out.where(~F.coalesce(is_team_listing(F.col("event")), F.lit(False)))


def record_rows(pages: DataFrame, **columns: str) -> DataFrame:
    """(doc, rec, division, event, round, athlete, record) of labelled record lists.

    A day cell closes a record.  Division, event and round carry over from records before;
    records that lack one of them are left out.
    """
    cells = table_rows(pages, **columns).select("doc", "pos", F.posexplode("cells").alias("n", "c")).select("doc", F.struct("pos", "n").alias("pos"), F.col("c.label").alias("label"), trimmed(F.col("c.text")).alias("value"))
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    day = next(k for k, v in LABELS.items() if v == "day")
    cells = cells.where(F.col("label").isin(*LABELS)).withColumn("rec", F.coalesce(F.sum(F.when(F.col("label") == day, 1).otherwise(0)).over(before), F.lit(0)))
    kept = {v: F.when(F.col("label") == k, F.nullif("value", F.lit("")) if v in ("division", "event", "round") else F.col("value")) for k, v in LABELS.items()}
    for name in ("division", "event", "round"):
        cells = cells.withColumn(name, so_far(kept[name]))
    closing = cells.where(F.col("label") == day).select("doc", "rec", "division", "event", "round")
    last = cells.groupBy("doc", "rec").agg(*[F.max_by("value", F.when(F.col("label") == k, F.col("pos"))).alias(v) for k, v in LABELS.items() if v in ("athlete", "record")])
    return closing.join(last, ["doc", "rec"]).where("division IS NOT NULL AND event IS NOT NULL AND round IS NOT NULL")


def with_heat(rows: DataFrame, youth: bool = False) -> DataFrame:
    """Listed results (division, event, round, code, ...) with gender and heat number, as their listing gives them."""
    heat = heat_from_youth_code(F.col("code")) if youth else heat_from_code(F.col("code"), F.col("round"))
    return rows.withColumns({"gender": infer_gender(F.col("division")), "heat_number": heat})


def store_results(t: Catalog, rows: DataFrame, comp_id: int, youth: bool = False) -> Catalog:
    """Listed results stored: (division, event, round, code, pos, ranking, region, athlete_name, team_name, record, note).

    Events go by division and name without their gender, as the listings do; events,
    rounds, heats, entries and starts are found or created, and a start that has a result
    keeps it.  National listings tell relays by the event's name, youth ones have none.
    """
    given = with_heat(rows, youth).withColumn("team_event", F.lit(False) if youth else is_team_listing(F.col("event")))
    named = given.select("pos", F.lit(comp_id).cast("long").alias("competition_id"), F.col("division").alias("division_name"), "gender", F.col("event").alias("event_name"), "team_event", "round", "heat_number", "athlete_name", "region", "team_name", F.lit(0).alias("bib_number"), "ranking", F.nullif("record", F.lit("")).alias("record"), F.nullif("note", F.lit("")).alias("note"))
    named = keep(named, "listed")
    key = ["competition_id", "division_name", "event_name"]
    events, _ = find_or_create(t["event"], named.select("pos", *key, "gender", "team_event"), "event", "pos", keys=key)
    named = with_ids(named, events, "event", "event_id", keys=key)
    rounds, _ = find_or_create(t["event_round"], named.select("pos", "event_id", "round"), "event_round", "pos")
    named = with_ids(named, rounds, "event_round", "event_round_id")
    heats, _ = find_or_create(t["event_heat"], named.select("pos", "event_round_id", "heat_number"), "event_heat", "pos")
    named = with_ids(named, heats, "event_heat", "heat_id")
    entries, _ = find_or_create(t["competition_entry"], named.select("pos", "competition_id", "athlete_name", "gender", "region", "team_name"), "competition_entry", "pos")
    named = with_ids(named, entries, "competition_entry", "entry_id")
    starts, _ = find_or_create(t["heat_entry"], named.select("pos", "heat_id", "entry_id", "bib_number"), "heat_entry", "pos")
    named = keep(with_ids(named, starts, "heat_entry", "heat_entry_id"), "listed")
    first = Window.partitionBy("heat_entry_id").orderBy("pos")
    fresh = named.join(t["event_result"].select("heat_entry_id"), "heat_entry_id", "left_anti").withColumn("_k", F.row_number().over(first)).where("_k = 1")
    results = fresh.select("heat_entry_id", "ranking", "record", record_mark_two(F.coalesce("note", F.lit(""))).alias("new_record"), F.lit(None).cast("string").alias("qualification"), "note")
    return upsert_results({**t, "event": events, "event_round": rounds, "event_heat": heats, "competition_entry": entries, "heat_entry": starts}, results)


def find_records(t: Catalog, rows: DataFrame, comp_id: int | None = None) -> DataFrame:
    """Rows (division, event, round, athlete, record, competition_id) with the results they mean.

    Division and round are tried under all their names, in order; the first pair of names with a
    result decides, and all its results count.
    """
    wanted = rows.withColumn("row_no", F.xxhash64("competition_id", "division", "event", "round", "athlete", "record")).select("*", F.posexplode(division_variants(F.col("division"))).alias("d_rank", "d_name")).select("*", F.posexplode(round_variants(F.col("round"))).alias("r_rank", "r_name"))
    facts_ = facts.result_fact(t, comp_id).select("result_id", F.col("competition_id").alias("c"), F.col("division_name").alias("dn"), plain_event(F.col("event_name")).alias("en"), F.col("round").alias("rn"), F.col("athlete_name").alias("an"), F.col("record").alias("rec_text"))
    on = (F.col("competition_id") == F.col("c")) & (F.col("d_name") == F.col("dn")) & (plain_event(F.col("event")) == F.col("en")) & (F.col("r_name") == F.col("rn")) & (F.col("athlete") == F.col("an")) & (F.col("record") == F.col("rec_text"))
    met = wanted.join(facts_, on)
    best = Window.partitionBy("row_no")
    return met.withColumn("place", F.col("d_rank") * 100 + F.col("r_rank")).withColumn("first", F.min("place").over(best)).where("place = first").select("competition_id", "division", "event", "round", "athlete", "record", "result_id").distinct()


def mark_records(t: Catalog, rows: DataFrame, comp_id: int | None = None, overwrite: bool = True) -> tuple[Catalog, DataFrame]:
    """(catalogue with the meet mark set on listed results, one row of counts).

    Relays and rows without a name are skipped.  ``overwrite`` replaces stronger marks, as the
    statement in use does; otherwise only unmarked results change.
    """
    named = rows.where(blank_to_null(F.col("athlete")).isNotNull() & ~is_team_listing(F.col("event")))
    found = find_records(t, named, comp_id)
    hit = found.select(F.col("result_id").alias("id"), F.lit(True).alias("hit")).distinct()
    old = t["event_result"]
    set_ = F.col("hit") if overwrite else F.col("hit") & F.col("new_record").isNull()
    new = old.join(hit, "id", "left").withColumn("new_record", F.when(set_, "대회신").otherwise(F.col("new_record"))).select(*old.columns)
    total = rows.agg(F.count("*").alias("rows")).crossJoin(named.agg(F.count("*").alias("named"))).crossJoin(hit.agg(F.count("*").alias("updated"))).crossJoin(found.select("competition_id", "division", "event", "round", "athlete", "record").distinct().agg(F.count("*").alias("found")))
    return {**t, "event_result": new}, total.select("updated", (F.col("named") - F.col("found")).alias("not_found"), (F.col("rows") - F.col("named")).alias("skipped"))


def not_loaded(t: Catalog, targets: DataFrame) -> DataFrame:
    """Targets (competition_id, division, event, round) of which no result is stored; heats aren't told apart."""
    have = facts.result_fact(t).select("competition_id", F.col("division_name").alias("division"), F.col("event_name").alias("event"), "round").distinct()
    return targets.join(have, ["competition_id", "division", "event", "round"], "left_anti")
