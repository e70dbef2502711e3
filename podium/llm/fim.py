"""Fill-in-the-middle transformation by secondary sort.

A text is cut into prefix, middle and suffix, which are written in another order
behind marks (``<P>``, ``<S>``, ``<M>``).  Nothing longer than CHUNK code points is
handled as one value behind the cut: ``pieces`` emits chunks keyed by row and by
position in the output, one shuffle brings a row's pieces together
(``repartition`` and ``sortWithinPartitions``), and whatever reads them streams them
in order.  ``restored`` reads the marks back from that stream, keys what lies between
them by its place in the original and sorts again inside the same partitions, without
a second shuffle.  ``assembled`` joins either kind of pieces into whole texts, and
``digest`` feeds both streams into incremental SHA-256.

The cut depends on the id alone (``cut``), so the same document is always cut alike.
A text that is empty or holds a mark stays as it is (``plain``), as do some of the
others.  Null texts count as empty; a null id is hashed as an empty one.  Repeated
rows are cut each: rows are told apart by number, so a hot id or text spreads over all
partitions.  The numbers follow from the order of the input, so ``docs`` should be a
stored table, which gives them again when an executor is lost.  An empty table gives
no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import map_arrow, sliced

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_MARK = re.compile("|".join((PREFIX, SUFFIX, MIDDLE)))
#: Of 100 documents so many are cut at all, and of 100 that are cut so many have the suffix first.
CUT_SHARE, SPM_SHARE = 90, 20
#: Code points of a piece, at most.
CHUNK = 1 << 16

#: The row before a row's pieces; it holds what is known of the row and no text.
_HEADER = -1
#: In restored pieces a position is the section's place and the piece's number in it.
_PLACE = {None: 0, PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_SECTION = 1 << 40

_FIELDS = "form string, n long, prefix_chars long, middle_chars long, output_sha256 string"


def cut(doc_id, text: str, seed: int = 1, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE) -> tuple[str, int | None, int | None]:
    """(form, code points of the prefix, of the middle); None for a plain text."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or h3 % 100 >= cut_share or _MARK.search(text):
        return PLAIN, None, None
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return (SPM if h4 % 100 < spm_share else PSM), a, b - a


def _output(text: str, form: str, prefix: int | None, middle: int | None, chunk: int) -> Iterator[str]:
    """The output in pieces, in order; a mark leads the first piece of its section."""
    if form == PLAIN:
        spans = [("", 0, len(text))]
    else:
        at = {PREFIX: (0, prefix), MIDDLE: (prefix, prefix + middle), SUFFIX: (prefix + middle, len(text))}
        spans = [(mark, *at[mark]) for mark in ((PREFIX, SUFFIX, MIDDLE) if form == PSM else (SUFFIX, PREFIX, MIDDLE))]
    for mark, start, end in spans:
        yield mark + text[start : min(end, start + chunk)]
        for i in range(start + chunk, end, chunk):
            yield text[i : min(end, i + chunk)]


class _Sections:
    """Cuts an output that comes in pieces at its marks, wherever the pieces end."""

    def __init__(self) -> None:
        self.section: str | None = None
        self.held = ""

    def feed(self, piece: str) -> Iterator[tuple[str | None, str]]:
        text, at = self.held + piece, 0
        for mark in _MARK.finditer(text):
            if mark.start() > at:
                yield self.section, text[at : mark.start()]
            self.section, at = mark[0], mark.end()
        rest = text[at:]
        hold = next((k for k in (2, 1) if rest[-k:] in ("<P", "<S", "<M", "<")), 0)  # may begin a mark
        self.held = rest[len(rest) - hold :]
        if len(rest) > hold:
            yield self.section, rest[: len(rest) - hold]

    def close(self) -> Iterator[tuple[str | None, str]]:
        if self.held:
            yield self.section, self.held


def _schema(id_type: str) -> str:
    return f"_row long, _pos long, piece string, doc_id {id_type}, {_FIELDS}"


_NAMES = ["_row", "_pos", "piece", "doc_id", "form", "n", "prefix_chars", "middle_chars", "output_sha256"]
#: Where output_sha256 stands behind doc_id in a header.
_EMPTY = (None,) * 6


def _batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], text_at: int, limit: int = 4 << 20, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``limit`` characters."""
    held: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    for row in rows:
        held.append(row)
        size += len(row[text_at] or "")
        if size >= limit or len(held) >= most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _types(id_type: pa.DataType) -> list[pa.DataType]:
    return [pa.int64(), pa.int64(), pa.string(), id_type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE, chunk: int = CHUNK,
) -> DataFrame:
    """The outputs of all rows in chunks (``_row``, ``_pos``, ``piece``), each row's together and in order behind its header."""
    given = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield from _batches(chunks(batch), _NAMES, _types(batch.schema.field("doc_id").type), 2)

    def chunks(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row, doc_id, text in _rows([batch]):
            form, prefix, middle = cut(doc_id, text, seed, cut_share, spm_share)
            yield row, _HEADER, None, doc_id, form, len(text), prefix, middle, None
            for pos, piece in enumerate(_output(text, form, prefix, middle, chunk)):
                yield row, pos, piece, *_EMPTY

    return map_arrow(given, run, _schema(_id_type(given))).repartition("_row").sortWithinPartitions("_row", "_pos")


def restored(outputs: DataFrame) -> DataFrame:
    """The original texts in chunks, rebuilt from nothing but each output and its form; headers gain ``output_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _batches(chunks(_rows(_chained(first, batches))), _NAMES, _types(first.schema.field("doc_id").type), 2)

    def chunks(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, group in groupby(rows, itemgetter(0)):
            header = next(group)
            sections, hashed, seen = _Sections(), hashlib.sha256(), 0
            plain = header[4] == PLAIN
            for _, _, piece, *_ in group:
                hashed.update(piece.encode())
                for section, text in [(None, piece)] if plain else sections.feed(piece):
                    yield row, _PLACE[section] * _SECTION + seen, text, *_EMPTY
                    seen += 1
            for section, text in sections.close():
                yield row, _PLACE[section] * _SECTION + seen, text, *_EMPTY
            yield row, _HEADER, None, *header[3:8], hashed.hexdigest()

    return map_arrow(outputs, run, _schema(_id_type(outputs))).sortWithinPartitions("_row", "_pos")


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def assembled(chunked: DataFrame, out_col: str = "text") -> DataFrame:
    """Whole texts of ``pieces`` or of ``restored``: (doc_id, n, form, prefix_chars, middle_chars, ``out_col``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            types = [first.schema.field("doc_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield from _batches(texts(_rows(_chained(first, batches))), ["doc_id", "n", "form", "prefix_chars", "middle_chars", out_col], types, 5)

    def texts(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(rows, itemgetter(0)):
            _, _, _, doc_id, form, n, prefix, middle, _ = next(group)
            yield doc_id, n, form, prefix, middle, "".join(x[2] for x in group)

    return map_arrow(chunked, run, f"doc_id {_id_type(chunked)}, n long, form string, prefix_chars long, middle_chars long, `{out_col}` string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: id, code points, form, where it was cut, and digests of the output and of the text restored from it."""
    original = restored(pieces(docs, id_col, text_col, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            types = [first.schema.field("doc_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
            yield from _batches(digests(_rows(_chained(first, batches))), names, types, 5)

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(rows, itemgetter(0)):
            _, _, _, doc_id, form, n, prefix, middle, output = next(group)
            hashed = hashlib.sha256()
            for x in group:
                hashed.update(x[2].encode())
            yield doc_id, n, form, prefix, middle, output, hashed.hexdigest()

    schema = f"doc_id {_id_type(original)}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return map_arrow(original, run, schema)


SQL = """
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
hashed AS (
  SELECT *, CAST('0x' || h[1:8] AS UBIGINT) % (n + 1) AS u, CAST('0x' || h[9:16] AS UBIGINT) % (n + 1) AS v,
    n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= 90 AS plain,
    CAST('0x' || h[25:32] AS UBIGINT) % 100 < 20 AS spm
  FROM given),
placed AS (SELECT *, CAST(least(u, v) AS BIGINT) AS a, CAST(greatest(u, v) AS BIGINT) AS b FROM hashed)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN b - a END AS middle_chars,
  sha256(CASE WHEN plain THEN t
    WHEN spm THEN '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM placed
"""
