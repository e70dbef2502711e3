"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without white space at its ends and with A-Z in lower case.
A ``LineIndex`` is a folder that holds, for every key of the documents it was given,
the number of documents with it (``refs``, exact, 128-bit hashes of keys), and for
each shard of keys a cuckoo filter of those that at least ``min_docs`` documents hold.
Documents can be added and taken out again in batches; a batch counts once, however
often it is sent, and is published by one rename.  Only keys that cross the threshold
touch a filter: they are inserted on the way up and deleted on the way down.

``dedup`` asks the filters first.  A line they don't know is kept for certain; the
lines they know are dropped if the key is one of the HEAVY most frequent ones, which
are exact and bounded, and are else confirmed by a join with ``refs``.  So a key that
a third of all lines share never reaches a shuffle, and any other key has at most one
in HEAVY of all references.  Filters are broadcast while all of them together take at
most FILTER_BYTES; beyond that every line that isn't heavy is confirmed by the join.

Every row is a document of its own, so repeated rows count as several.  A null or
empty text is one empty line.  Keys without a code point are never dropped.  Texts are
read whole.  An empty table gives no rows.  Columns of the input that bear a name of
the result (``n_lines``, ``n_dropped``) are replaced, names with an underscore before
``at``, ``known``, ``pending`` and ``gone`` are the operator's own; others are carried along.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import Scratch, exists, map_arrow, mix, sliced

#: Documents that hold a key before its lines go.
MIN_DOCS = 10
#: Filters of an index.
SHARDS = 256
#: Keys known exactly to every task: 16 bytes each.
HEAVY = 1 << 16
#: Bytes of all filters together that are sent to every task at most.
FILTER_BYTES = 64 << 20
#: Keys counted in a task before they are handed on.
_HELD = 1 << 17

_SPACE = b" \t\n\v\f\r"


def key(line: bytes) -> bytes:
    """What lines are compared by; bytes.lower changes A-Z only."""
    return line.strip(_SPACE).lower()


def _hash(k: bytes) -> bytes:
    return xxhash.xxh3_128_digest(k)


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


# Cuckoo filter ---------------------------------------------------------------


class CuckooFilter:
    """Set of 128-bit keys with deletion: 16-bit fingerprints, four to a bucket, two buckets a key.

    A full table is followed by another of twice its buckets, so inserts never fail; keys
    live in one of the tables.  ``contains`` never misses a key that was inserted.
    """

    SLOTS, KICKS, BUCKETS = 4, 200, 64

    def __init__(self, tables: list[array] | None = None):
        self.tables = tables if tables is not None else []

    @staticmethod
    def _places(k1: np.ndarray, k2: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets."""
        prints = (k2 % np.uint64(65535) + np.uint64(1)).astype(np.uint64)
        mask = np.uint64(buckets - 1)
        first = k1 & mask
        return prints, first, first ^ (mix(prints) & mask)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(k1), bool)
        for table in self.tables:
            slots = np.frombuffer(table, np.uint16).reshape(-1, self.SLOTS)
            prints, one, two = self._places(k1, k2, len(slots))
            wanted = prints.astype(np.uint16)[:, None]
            found |= (slots[one] == wanted).any(1) | (slots[two] == wanted).any(1)
        return found

    def _put(self, table: array, bucket: int, fingerprint: int) -> bool:
        for i in range(bucket * self.SLOTS, bucket * self.SLOTS + self.SLOTS):
            if not table[i]:
                table[i] = fingerprint
                return True
        return False

    def _other(self, bucket: int, fingerprint: int, buckets: int) -> int:
        return bucket ^ (int(mix(np.array([fingerprint], np.uint64))[0]) & (buckets - 1))

    def _insert(self, table: array, fingerprint: int, one: int, two: int) -> bool:
        """False, with the table as it was, if there is no room."""
        if self._put(table, one, fingerprint) or self._put(table, two, fingerprint):
            return True
        buckets, at, moved = len(table) // self.SLOTS, one, []
        for kick in range(self.KICKS):
            slot = at * self.SLOTS + kick % self.SLOTS
            moved.append((slot, table[slot]))
            fingerprint, table[slot] = table[slot], fingerprint
            at = self._other(at, fingerprint, buckets)
            if self._put(table, at, fingerprint):
                return True
        for slot, was in reversed(moved):
            table[slot] = was
        return False

    def insert(self, k1: int, k2: int) -> None:
        while True:
            if self.tables:
                prints, one, two = self._places(np.array([k1], np.uint64), np.array([k2], np.uint64), len(self.tables[-1]) // self.SLOTS)
                if self._insert(self.tables[-1], int(prints[0]), int(one[0]), int(two[0])):
                    return
            buckets = len(self.tables[-1]) // self.SLOTS * 2 if self.tables else self.BUCKETS
            self.tables.append(array("H", bytes(2 * self.SLOTS * buckets)))

    def delete(self, k1: int, k2: int) -> None:
        """Takes out a key that was inserted; KeyError if its fingerprint is nowhere."""
        for table in reversed(self.tables):
            prints, one, two = self._places(np.array([k1], np.uint64), np.array([k2], np.uint64), len(table) // self.SLOTS)
            for bucket in (int(one[0]), int(two[0])):
                for i in range(bucket * self.SLOTS, bucket * self.SLOTS + self.SLOTS):
                    if table[i] == int(prints[0]):
                        table[i] = 0
                        return
        raise KeyError((k1, k2))

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.tables)) + b"".join(struct.pack("<I", len(t)) + t.tobytes() for t in self.tables)

    @classmethod
    def load(cls, data: bytes | None) -> CuckooFilter:
        tables, at = [], 4
        for _ in range(struct.unpack_from("<I", data)[0] if data else 0):
            (n,) = struct.unpack_from("<I", data, at)
            tables.append(array("H", data[at + 4 : at + 4 + 2 * n]))
            at += 4 + 2 * n
        return cls(tables)


# Counting --------------------------------------------------------------------

_COUNTS = "k1 long, k2 long, n long"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _counted(held: dict[bytes, int], sign: int) -> pa.RecordBatch:
    k1, k2 = _halves(list(held))
    return pa.RecordBatch.from_arrays([_signed(k1), _signed(k2), pa.array([sign * n for n in held.values()], pa.int64())], ["k1", "k2", "n"])


def references(docs: DataFrame, text_col: str = "text", sign: int = 1) -> DataFrame:
    """(k1, k2, n): documents by key, times ``sign``; counted in each task first, so a hot key is a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in sliced(batches, "text"):
            for text in batch.column("text").to_pylist():
                keys = {key(x) for x in (text or "").encode().split(b"\n")}
                keys.discard(b"")
                for h in map(_hash, keys):
                    held[h] = held.get(h, 0) + 1
                if len(held) >= _HELD:
                    yield _counted(held, sign)
                    held = {}
        if held:
            yield _counted(held, sign)

    return map_arrow(docs.select(F.col(text_col).alias("text")), run, _COUNTS).groupBy("k1", "k2").agg(F.sum("n").alias("n"))


# Index -----------------------------------------------------------------------


class LineIndex:
    """Reference counts and filters in a folder that all executors share; one driver at a time may write to it.

    Each batch writes a new version aside and renames it into place, so it counts whole
    or not at all.  A version costs a pass over the counts, never over earlier texts.
    """

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, shards: int = SHARDS):
        self.spark, self.path, self.min_docs, self.shards = spark, path.rstrip("/"), min_docs, shards

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _version(self) -> str | None:
        fs, at = self._fs(f"{self.path}/v")
        found = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        return f"{self.path}/v/{found[-1]}" if found else None

    def _table(self, name: str, schema: str) -> DataFrame:
        at = self._version()
        return self.spark.read.schema(schema).parquet(f"{at}/{name}") if at else self.spark.createDataFrame([], schema)

    def refs(self) -> DataFrame:
        """(k1, k2, n): every key and the number of its documents."""
        return self._table("refs", "k1 long, k2 long, was long, n long").select("k1", "k2", "n").where("n > 0")

    def filters(self) -> DataFrame:
        """(shard, filter): the serialized filter of each shard that has one."""
        return self._table("filters", "shard long, filter binary")

    def has(self, batch: str) -> bool:
        return not self._table("batches", "batch string").where(F.col("batch") == batch).isEmpty()

    def insert(self, batch: str, docs: DataFrame, text_col: str = "text") -> bool:
        """Adds documents; False, and nothing changed, if the batch was committed before."""
        return self._commit(batch, docs, text_col, 1)

    def delete(self, batch: str, docs: DataFrame, text_col: str = "text") -> bool:
        """Takes out documents that were added; ValueError, and nothing changed, if a key's count would fall below 0."""
        return self._commit(batch, docs, text_col, -1)

    def _commit(self, batch: str, docs: DataFrame, text_col: str, sign: int) -> bool:
        if self.has(batch):
            return False
        aside, old = f"{self.path}/aside/{uuid.uuid4().hex}", self._version()
        given = references(docs, text_col, sign).select("k1", "k2", F.lit(0).cast("long").alias("was"), "n")
        both = self.refs().select("k1", "k2", F.col("n").alias("was"), "n").unionByName(given) if old else given
        both.groupBy("k1", "k2").agg(F.sum("was").alias("was"), F.sum("n").alias("n")).where("was <> 0 OR n <> 0").write.parquet(f"{aside}/refs")
        merged = self.spark.read.schema("k1 long, k2 long, was long, n long").parquet(f"{aside}/refs")
        if sign < 0 and not merged.where("n < 0").isEmpty():
            raise ValueError("documents to delete hold keys that the index doesn't count as often")
        self._refiltered(merged).write.parquet(f"{aside}/filters")
        self._table("batches", "batch string").unionByName(self.spark.createDataFrame([(batch,)], "batch string")).write.parquet(f"{aside}/batches")
        fs, to = self._fs(f"{self.path}/v/{int(old.rsplit('/', 1)[1]) + 1 if old else 1:09d}")
        fs.mkdirs(to.getParent())
        if not fs.rename(self._fs(aside)[1], to):
            raise OSError(f"can't rename {aside} to {to}")
        if old:
            fs.delete(self._fs(old)[1], True)
        return True

    def _refiltered(self, merged: DataFrame) -> DataFrame:
        """(shard, filter) with the keys that crossed the threshold inserted or deleted."""
        step = (F.col("n") >= self.min_docs).cast("int") - (F.col("was") >= self.min_docs).cast("int")
        shard = F.pmod(F.shiftrightunsigned("k1", 40), F.lit(self.shards)).cast("long").alias("shard")
        null = lambda t: F.lit(None).cast(t)
        changes = merged.select(shard, null("binary").alias("filter"), step.alias("step"), "k1", "k2").where("step <> 0")
        held = self.filters().select("shard", "filter", F.lit(-2).alias("step"), null("long").alias("k1"), null("long").alias("k2"))
        together = held.unionByName(changes).repartition("shard").sortWithinPartitions("shard", "step", "k1", "k2")  # the filter, deletions, insertions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, group in groupby(_rows(batches), itemgetter(0)):
                kept = CuckooFilter()
                for _, data, change, k1, k2 in group:
                    if change == -2:
                        kept = CuckooFilter.load(data)
                    else:
                        (kept.insert if change > 0 else kept.delete)(k1 & _MASK, k2 & _MASK)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([kept.dump()], pa.binary())], ["shard", "filter"])

        return map_arrow(together, run, "shard long, filter binary")

    def repeated(self) -> DataFrame:
        """(k1, k2) of the keys whose lines go."""
        return self.refs().where(F.col("n") >= self.min_docs).select("k1", "k2")


_MASK = (1 << 64) - 1


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class _Screen:
    """What a task asks about hashes of keys: is it heavy, may it be repeated."""

    def __init__(self, heavy: set[bytes], filters: dict[int, CuckooFilter] | None, shards: int):
        self.heavy, self.filters, self.shards = heavy, filters, shards

    def possible(self, hashes: list[bytes]) -> list[bytes]:
        """Those that the filters know, or all where there are no filters."""
        if self.filters is None or not hashes:
            return hashes
        k1, k2 = _halves(hashes)
        shard = (k1 >> np.uint64(40)) % np.uint64(self.shards)
        order = np.argsort(shard, kind="stable")
        found = np.zeros(len(hashes), bool)
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            held = self.filters.get(int(shard[part[0]]))
            if held:
                found[part] = held.contains(k1[part], k2[part])
        return [hashes[i] for i in np.flatnonzero(found)]


def _screen(index: LineIndex, heavy: int, filter_bytes: int):
    """Broadcast of the heavy keys and, if they aren't too large, the filters."""
    top = index.refs().where(F.col("n") >= index.min_docs).orderBy(F.desc("n"), "k1", "k2").limit(heavy).select("k1", "k2").toArrow()
    both = np.column_stack([top.column(c).to_numpy().astype(np.int64) for c in ("k1", "k2")]) if top.num_rows else np.empty((0, 2), np.int64)
    size = index.filters().agg(F.sum(F.length("filter"))).first()[0] or 0
    filters = {r["shard"]: CuckooFilter.load(bytes(r["filter"])) for r in index.filters().collect()} if size <= filter_bytes else None
    return index.spark.sparkContext.broadcast(_Screen({x.tobytes() for x in both}, filters, index.shards))


_PENDING = "array<struct<lines:array<int>,k1:long,k2:long>>"
_ARROW = pa.list_(pa.struct([("lines", pa.list_(pa.int32())), ("k1", pa.int64()), ("k2", pa.int64())]))


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _set(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    names = [*batch.schema.names, *(n for n in new if n not in batch.schema.names)]
    return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names)


def dedup(docs: DataFrame, index: LineIndex, scratch: Scratch, text_col: str = "text", heavy: int = HEAVY, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """All rows with their repeated lines taken out of ``text_col``, and ``n_lines`` (before), ``n_dropped`` added.

    Texts are read once and stored once; only those with a line that the filters know and
    that isn't heavy meet the reference counts.
    """
    screen = _screen(index, heavy, filter_bytes)
    given = docs.drop("n_lines", "n_dropped")
    rest = given.columns
    given = given.withColumn("_at", F.monotonically_increasing_id())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = screen.value
        for batch in sliced(batches, text_col):
            split = [(t or "").encode().split(b"\n") for t in batch.column(text_col).to_pylist()]
            hashes = [[_hash(k) if (k := key(x)) else b"" for x in lines] for lines in split]
            asked = {h for hs in hashes for h in hs}
            asked.discard(b"")
            maybe = set(ask.possible(list(asked)))
            sure = maybe & ask.heavy
            maybe -= sure
            texts, dropped, known, open_ = [], [], [], []
            for lines, hs in zip(split, hashes, strict=True):
                gone = [i for i, h in enumerate(hs) if h in sure]
                waits: dict[bytes, list[int]] = {}
                for i, h in enumerate(hs):
                    if h in maybe:
                        waits.setdefault(h, []).append(i)
                texts.append(b"\n".join(lines).decode() if waits else _without(lines, gone))
                dropped.append(len(gone))
                known.append(gone if waits else None)
                open_.append([_waiting(h, at) for h, at in waits.items()] or None)
            counts = pa.array([len(x) for x in split], pa.int64())
            new = {text_col: pa.array(texts, pa.string()), "n_lines": counts, "n_dropped": pa.array(dropped, pa.int64())}
            yield _set(batch, **new, _known=pa.array(known, pa.list_(pa.int32())), _pending=pa.array(open_, _ARROW))

    schema = f"{_columns(given)}, n_lines long, n_dropped long, _known array<int>, _pending {_PENDING}"
    screened = scratch.keep(map_arrow(given, first, schema), "screened")
    asking = screened.where("_pending IS NOT NULL")
    waiting = asking.select("_at", F.explode("_pending").alias("p")).select("_at", "p.lines", "p.k1", "p.k2")
    verdicts = waiting.join(index.repeated(), ["k1", "k2"]).groupBy("_at").agg(F.flatten(F.collect_list("lines")).alias("_gone"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            gone = [[*x, *(y or [])] for x, y in zip(batch.column("_known").to_pylist(), batch.column("_gone").to_pylist(), strict=True)]
            texts = [_without(t.encode().split(b"\n"), x) for t, x in zip(batch.column(text_col).to_pylist(), gone, strict=True)]
            yield _set(batch, **{text_col: pa.array(texts, pa.string()), "n_dropped": pa.array(list(map(len, gone)), pa.int64())})

    joined = asking.drop("_pending").join(verdicts, "_at", "left")
    confirmed = map_arrow(joined, second, _columns(joined))
    columns = [*rest, "n_lines", "n_dropped"]
    return screened.where("_pending IS NULL").select(*columns).unionByName(confirmed.select(*columns))


def _waiting(h: bytes, lines: list[int]) -> dict:
    k1, k2 = struct.unpack("<qq", h)
    return {"lines": lines, "k1": k1, "k2": k2}


def _without(lines: list[bytes], gone: list[int]) -> str:
    if gone:
        left = set(gone)
        lines = [x for i, x in enumerate(lines) if i not in left]
    return b"\n".join(lines).decode()


def drop_folder(index: LineIndex) -> None:
    """Deletes an index."""
    if exists(index.spark, index.path):
        fs, at = index._fs(index.path)
        fs.delete(at, True)


def digest(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: id, lines, lines dropped and the digest of what stays; the index holds the table itself."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = LineIndex(docs.sparkSession, scratch.path("lines"), min_docs)
    index.insert("all", given)
    kept = dedup(given, index, scratch)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH given AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM given),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
told AS (SELECT keyed.*, repeated.k IS NOT NULL AS goes FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM told GROUP BY r, doc_id
"""
