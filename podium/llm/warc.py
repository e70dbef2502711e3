"""WARC: archives of web captures, written and read with Spark's own file sources.

``write_archives`` gives each page a request, a response or revisit, and a metadata
record, the first and last naming the second in WARC-Concurrent-To.  A record is
a header, an empty line and a block, and ends with CR LF CR LF; that is the line
separator of Spark's text writer, so executors write archives to any file system.
``read_records`` reads them back by Content-Length, and ``captures`` assembles one
nested row per capture: records meet on the identifier of their response, found in
WARC-Concurrent-To or, for the response itself, in its own id.

Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the
largest id is stored as response and the others as revisits of it; rows that
repeat that id and payload are responses too.  Smaller payloads are always
responses.  Pages are numbered once and stored with their numbers before anything
else, so record ids and the references to them can't differ between branches or
after a lost executor; which page is a response is decided on ids and digests alone.
Archives are written by size of payload, so that a file holds about ``FILE_BYTES`` of
payloads at most, or one larger capture.  Payloads are checked against their digests
as they are read.

Page ids are whole numbers or null; a null id sorts below all and is read back as
null.  Null payloads count as empty, null URLs too; payloads of up to what a Spark
string holds (2 GB) are kept whole.  An empty table gives no archive records.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.llm.common import NULL_ID, Scratch, exists, map_arrow

LINE, RECORD_END = "\r\n", "\r\n\r\n"
#: Payload bytes of an archive file at most, and the largest payloads of the size classes.
FILE_BYTES, CLASSES = 128 << 20, (1 << 12, 1 << 16, 1 << 18, 1 << 20, 1 << 22, 1 << 24)
#: Fixed value: the revisit profile of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base 32 of the SHA-1: five hexadecimal digits make four of base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _urn(kind: str) -> Column:
    h = F.md5(F.concat_ws(" ", F.lit(kind), F.col("_row").cast("string"), F.col("page_id").cast("string"), F.col("digest")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column | str, rid: Column, content_type: str, block: Column, more: list[Column], date: str) -> Column:
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), F.col("uri")), *more, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(LINE, *head), F.lit(RECORD_END), block)


def numbered(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(_row, page_id, uri, payload, n_bytes, digest): pages with a number; it holds only once it is stored."""
    uri = F.replace(F.replace(F.coalesce(F.col(url_col), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("page_id"), uri.alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    return rows.withColumns({"n_bytes": F.octet_length("payload"), "digest": base32_sha1(F.col("payload"))})


def typed_pages(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(_row, page_id, uri, payload, n_bytes, digest, revisit_of): what each stored, numbered page is written as.

    ``revisit_of`` is the ``_row`` of the response, or null.
    """
    order = F.coalesce("page_id", F.lit(NULL_ID))
    largest = rows.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.max(F.struct(order.alias("_order"), "_row", "page_id")).alias("_best"), F.min(order).alias("_least")).where("_least < _best._order").drop("_least")
    met = rows.join(largest, "digest", "left")
    revisit = (F.col("n_bytes") >= least_bytes) & (order < F.col("_best._order"))
    return met.select("_row", "page_id", "uri", "payload", "n_bytes", "digest", F.when(revisit, F.col("_best._row")).alias("revisit_of"), F.when(revisit, F.col("_best.page_id")).alias("_best_id"))


def write_archives(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", least_bytes: int = 0, **columns) -> None:
    scratch = Scratch(pages.sparkSession, "warc-pages")
    stored = scratch.keep(numbered(pages, **columns), "pages", "zstd")
    main, of = _urn("main"), F.concat(F.lit("WARC-Concurrent-To: "), _urn("main"))
    refers = F.when(F.col("revisit_of").isNotNull(), F.expr("named_struct('_row', revisit_of, 'page_id', _best_id, 'digest', digest)"))
    h = F.md5(F.concat_ws(" ", F.lit("main"), refers["_row"].cast("string"), refers["page_id"].cast("string"), refers["digest"]))
    refers_to = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    is_revisit = F.col("revisit_of").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(RECORD_END))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    request = F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n"))
    note = F.concat(F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(LINE)), F.lit("")), F.lit("payloadLength: "), F.col("n_bytes").cast("string"), F.lit(LINE))
    answer = F.when(is_revisit, _record("revisit", main, "application/http; msgtype=response", http, [digest, F.lit(f"WARC-Profile: {REVISIT_PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), refers_to)], date)).otherwise(_record("response", main, "application/http; msgtype=response", F.concat(http, F.col("payload")), [digest], date))
    records = F.array(_record("request", _urn("request"), "application/http; msgtype=request", request, [of], date), answer, _record("metadata", _urn("metadata"), "application/warc-fields", note, [of], date))
    size_class = F.size(F.filter(F.array(*[F.lit(c) for c in CLASSES]), lambda c: c < F.col("n_bytes")))
    # Copies of a payload are of one class, so each class is decided and written by itself, from its own rows.
    for k in sorted(r[0] for r in stored.select(size_class).distinct().collect()):
        low, high = ([-1, *CLASSES][k], [*CLASSES, None][k])
        mine = stored.where(F.col("n_bytes") > low) if high is None else stored.where((F.col("n_bytes") > low) & (F.col("n_bytes") <= high))
        captures_a_file = max(1, FILE_BYTES // high) if high else 1
        typed_pages(mine, least_bytes).select(F.explode(records).alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_a_file).text(f"{path}/size-{k}")
    scratch.drop_others()


class _Stream:
    """Bytes of an archive, inflated as they are asked for."""

    def __init__(self, data: bytes, packed: bool):
        self.data, self.at, self.rest = data, 0, b""
        self.unpack = zlib.decompressobj(31) if packed else None

    def _more(self, n: int) -> bool:
        parts, size = [self.rest], len(self.rest)
        while size < n and self.at < len(self.data):
            piece = self.data[self.at : self.at + (1 << 16)]
            self.at += len(piece)
            while piece and self.unpack:
                out = self.unpack.decompress(piece)
                parts.append(out)
                size += len(out)
                piece = self.unpack.unused_data
                if piece:
                    self.unpack = zlib.decompressobj(31)
            if piece:
                parts.append(piece)
                size += len(piece)
        self.rest = b"".join(parts)
        return size >= n

    def take(self, n: int) -> bytes:
        if not self._more(n):
            raise ValueError("an archive ends within a record")
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def head(self) -> bytes | None:
        size = 1 << 12
        while (end := self.rest.find(b"\r\n\r\n")) < 0:
            if not self._more(size) and self.rest.find(b"\r\n\r\n") < 0:
                if self.rest:
                    raise ValueError("an archive ends within a header")
                return None
            size *= 2
        return self.take(end + 4)[:end]


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record."""
    stream = _Stream(data, data[:2] == b"\x1f\x8b")
    while (head := stream.head()) is not None:
        first, *lines = head.decode("utf-8").split(LINE)
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield fields, block


RECORDS = T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("record_id", T.StringType()), ("concurrent_to", T.StringType()), ("refers_to", T.StringType()), ("uri", T.StringType()), ("digest", T.StringType()), ("http_head", T.StringType()), ("payload", T.StringType()), ("fields", T.MapType(T.StringType(), T.StringType())))])


def _row(fields: dict[str, str], block: bytes) -> dict:
    head, payload, notes = None, None, {}
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = stated
    if fields.get("content-type", "").startswith("application/http"):
        start, gap, rest = block.partition(b"\r\n\r\n")
        head = start.decode("utf-8", "replace")
        if fields["warc-type"] == "response":
            payload = rest.decode("utf-8", "replace")
            digest = base64.b32encode(hashlib.sha1(rest).digest()).decode()
            if stated not in ("", digest):
                raise ValueError(f"the payload of {fields.get('warc-record-id')} doesn't match its digest")
    elif fields.get("content-type") == "application/warc-fields":
        notes = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8").split(LINE) if x)}
    return {"type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"), "digest": digest or None, "http_head": head, "payload": payload, "fields": list(notes.items())}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below a path, none if it doesn't exist; damaged archives and payloads raise an error."""
    kind = pa.schema([*((f.name, pa.string()) for f in RECORDS.fields[:-1]), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, block in parse_archive(content.as_py()):
                    rows.append(_row(fields, block))
                    size += len(block) + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    if not exists(spark, path):
        return spark.createDataFrame([], RECORDS)
    return map_arrow(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content"), run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: (capture_id, request, response, metadata).

    ``request`` and ``response`` (a response or revisit) are structs or null, ``metadata``
    an array; a record whose partner is missing keeps its row.
    """
    body = F.struct(*[c for c in records.columns if c != "fields"])
    of = lambda *kinds: F.when(F.col("type").isin(*kinds), body)
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(F.first(of("request"), True).alias("request"), F.first(of("response", "revisit"), True).alias("response"), F.collect_list(F.when(F.col("type") == "metadata", F.col("fields"))).alias("metadata"))


def digest(pages: DataFrame, **columns) -> DataFrame:
    """Writes archives, reads them back, and describes each page as found there; then the archives go."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_archives(pages, path, **columns)
    answer = F.col("response")
    # payloads stay where they were read: only their lengths are shuffled
    records = read_records(spark, path).withColumn("n_bytes", F.octet_length("payload")).drop("payload")
    light = captures(records).select(
        answer["record_id"].alias("record_id"), answer["type"].alias("record_type"), answer["refers_to"].alias("_to"), answer["digest"].alias("payload_digest"),
        answer["n_bytes"].cast("long").alias("_bytes"), F.get("metadata", F.lit(0))["pageId"].cast("long").alias("page_id"),
    )
    light = scratch.keep(light, "captures")
    archives = spark._jvm.org.apache.hadoop.fs.Path(path)
    archives.getFileSystem(spark._jsc.hadoopConfiguration()).delete(archives, True)
    stored = light.where("record_type = 'response'").select(F.col("record_id").alias("_to"), F.col("page_id").alias("_to_page"), F.col("_bytes").alias("_to_bytes"))
    return light.join(stored, "_to", "left").select("page_id", F.coalesce("_bytes", "_to_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("_to_page")).alias("refers_to"))
