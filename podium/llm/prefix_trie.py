"""Prefix trie of conversations, built as a burst trie.

A turn's id is a 128-bit digest of its role and text, a conversation the string of its
turns' ids.  Equal conversations are counted once (``sequences``), so copies cost no
more than one.  A container holds sequences that share a prefix, first all of them
under the root.  A container that is too large bursts: its prefix becomes a trie head,
and its sequences go to containers by their next turn id.  Too large is more than one
in SHARE of all sequences, so one depth has fewer than SHARE heads however large the
input, and all heads together are fewer than SHARE times the mean length of a
conversation; these alone are broadcast.  ``_heads`` counts several depths in one job
and twice as many in the next, so a long prefix that many share takes few jobs.

Shards hold whole containers, sorted by sequence; a sweep streams each once, with one
open node per depth, and closes a node when the next sequence leaves it.  Closing order
backwards is parents before children, so a second local sort gives every node its
parent's id without another shuffle.  What the containers' tops hold is then added up
along the heads.

Turns sort by number (null first), equal numbers by their ids.  Null roles and texts
count as empty.  Repeated rows are turns of their own.  Rows without a conversation id
are left out.  A conversation without turns ends at the root.  Texts are hashed whole,
however long; a conversation's ids and lengths, 20 bytes a turn, have to fit into one
row.  An empty table has no nodes.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import Scratch, map_arrow

#: A container bursts when it holds more than one in SHARE of all sequences, and more than LEAST.
SHARE, LEAST = 4096, 64
#: Depths that the first job of bursting counts; each job counts twice as many as the one before.
STRIDE = 4
#: Ids of equal conversations that are joined into one string before they are hashed in order.
CHUNK = 1 << 16
#: Bytes of a turn's id.
WIDTH = 16

_NOTHING = hashlib.sha256(b"").hexdigest()
_ROOT = hashlib.sha256(b"").digest()[:WIDTH]


def _name(ids: bytes) -> bytes:
    """What a prefix is called outside its container."""
    return hashlib.sha256(ids).digest()[:WIDTH]


def _digest(x: Column) -> Column:
    return F.unhex(F.substring(F.sha2(x, 256), 1, 2 * WIDTH))


def _prefix(depth: Column) -> Column:
    return F.substring(F.col("seq"), F.lit(1), depth * WIDTH)


def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq, lens): each conversation's turn ids in order, joined, and the code points of their texts.

    Only ids and lengths are shuffled, not texts.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    named = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    one = F.struct(F.col(turn_col).alias("turn"), named.alias("id"), F.length(text).alias("n"))
    sorted_turns = rows.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return sorted_turns.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["id"]), "")).alias("seq"), F.transform("t", lambda x: x["n"]).alias("lens"))


def branched(convs: DataFrame, every: int = 100, opening: int = 6) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % every before its own turns after the first h; h = crc32(c) % opening."""
    h = (F.crc32(F.col("conv_id").cast("string")) % opening).cast("int")
    base = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.substring("seq", 1, WIDTH * (opening - 1)).alias("base_seq"), F.slice("lens", 1, opening - 1).alias("base_lens"))
    both = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(base, "base", "left")
    seq = F.concat(F.coalesce(F.substring(F.col("base_seq"), F.lit(1), F.col("h") * WIDTH), F.lit(b"")), F.substring(F.col("seq"), F.col("h") * WIDTH + 1, F.greatest(F.length("seq") - F.col("h") * WIDTH, F.lit(0))))
    own = F.slice(F.col("lens"), F.col("h") + 1, F.greatest(F.size("lens") - F.col("h"), F.lit(0)))
    first = F.when(F.col("h") > 0, F.slice(F.col("base_lens"), F.lit(1), F.col("h")))
    return both.select("conv_id", seq.alias("seq"), F.concat(F.coalesce(first, F.array().cast("array<int>")), own).alias("lens"))


# Streams ---------------------------------------------------------------------


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 5_000, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes | str | list))
        if len(held) >= most or size >= limit:
            yield _made(held, schema)
            held, size = [], 0
    if held:
        yield _made(held, schema)


def _made(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_I, _B, _S, _L = pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int32())


def member_chunks(convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(seq, lens, least, n, ids): ids of equal conversations in ascending order, comma-joined, at most ``chunk`` to a row.

    Ranges are cut by sequence and id, so copies in any number spread over tasks.
    """
    schema = pa.schema([("seq", _B), ("lens", _L), ("least", _I), ("n", _I), ("ids", _S)])

    def chunks(rows: Iterator[tuple]) -> Iterator[tuple]:
        for seq, group in groupby(rows, itemgetter(0)):
            held, lens = [], None
            for _, conv, lens in group:
                held.append(conv)
                if len(held) >= chunk:
                    yield seq, lens, held[0], len(held), ",".join(map(str, held))
                    held = []
            if held:
                yield seq, lens, held[0], len(held), ",".join(map(str, held))

    dealt = convs.select("seq", "conv_id", "lens").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    return map_arrow(dealt, lambda batches: _batches(chunks(_rows(batches)), schema), "seq binary, lens array<int>, least long, n long, ids string")


def sequences(convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(seq, lens, n, least, ends_sha256): each distinct conversation, its number of copies, their smallest id and the digest of all ids."""
    schema = pa.schema([("seq", _B), ("lens", _L), ("n", _I), ("least", _I), ("ends_sha256", _S)])

    def merged(rows: Iterator[tuple]) -> Iterator[tuple]:
        for seq, group in groupby(rows, itemgetter(0)):
            hashed, n, first = hashlib.sha256(), 0, None
            for _, least, lens, size, ids in group:
                hashed.update((ids if first is None else "," + ids).encode())
                n, first = n + size, least if first is None else first
            yield seq, lens, n, first, hashed.hexdigest()

    dealt = member_chunks(convs, chunk).select("seq", "least", "lens", "n", "ids").repartition("seq").sortWithinPartitions("seq", "least")
    return map_arrow(dealt, lambda batches: _batches(merged(_rows(batches)), schema), "seq binary, lens array<int>, n long, least long, ends_sha256 string")


# Bursting --------------------------------------------------------------------


def _heads(found: DataFrame, limit: int, scratch: Scratch) -> list[tuple[bytes, int, bytes, int, str]]:
    """(name, depth, parent's name, code points of its last turn, that turn's id) of each prefix below the root that more than ``limit`` sequences share."""
    out: list[tuple[bytes, int, bytes, int, str]] = []
    depth, stride, active = 0, STRIDE, found.select("seq", "lens")
    while True:
        last = depth + stride
        levels = active.where(F.size("lens") > depth).select("seq", "lens", F.explode(F.sequence(F.lit(depth + 1), F.least(F.size("lens"), F.lit(last)))).alias("d"))
        named = levels.select("d", _digest(_prefix(F.col("d"))).alias("name"), F.struct(_digest(_prefix(F.col("d") - 1)).alias("parent"), F.element_at("lens", F.col("d")).alias("size"), F.lower(F.hex(F.substring(F.col("seq"), (F.col("d") - 1) * WIDTH + 1, F.lit(WIDTH)))).alias("turn")).alias("of"))
        big = named.groupBy("d", "name").agg(F.count("*").alias("n"), F.min("of.parent").alias("parent"), F.min("of.size").alias("size"), F.min("of.turn").alias("turn")).where(F.col("n") > limit).collect()
        out += ((bytes(r["name"]), r["d"], bytes(r["parent"]), r["size"], r["turn"]) for r in big)
        deepest = [(r["name"],) for r in big if r["d"] == last]
        if not deepest:
            return out
        names = F.broadcast(active.sparkSession.createDataFrame(deepest, "name binary"))
        held = active.where(F.size("lens") > last).withColumn("name", _digest(_prefix(F.lit(last)))).join(names, "name", "left_semi").drop("name")
        active, depth, stride = scratch.keep(held, "oversized"), last, 2 * stride


def _contained(found: DataFrame, heads: dict[bytes, tuple]) -> DataFrame:
    """Adds each sequence's container (null: it is a head itself) and the name and depth of the head above."""
    known = found.sparkSession.sparkContext.broadcast(frozenset(heads))
    schema = pa.schema([("container", _B), ("head", _B), ("depth", _I), ("seq", _B), ("lens", _L), ("n", _I), ("least", _I), ("ends_sha256", _S)])

    def placed(rows: Iterator[tuple]) -> Iterator[tuple]:
        names = known.value
        for seq, lens, n, least, ends in rows:
            depth, head, name = 0, _ROOT, None
            while depth < len(lens):
                name = _name(seq[: WIDTH * (depth + 1)])
                if name not in names:
                    break
                depth, head, name = depth + 1, name, None
            yield name, head, depth, seq, lens, n, least, ends

    return map_arrow(found.select("seq", "lens", "n", "least", "ends_sha256"), lambda batches: _batches(placed(_rows(batches)), schema), "container binary, head binary, depth long, seq binary, lens array<int>, n long, least long, ends_sha256 string")


# Sweeping --------------------------------------------------------------------

_NODE = "head binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_id string"
_CLOSED = pa.schema([("container", _B), ("place", _I), ("head", _B), ("conv_id", _I), ("depth", _I), ("n_convs", _I), ("n_children", _I), ("n_leaves", _I), ("saved_tokens", _I), ("ends_sha256", _S), ("turn_id", _S)])
_PLACED = pa.schema([("head", _B), ("conv_id", _I), ("depth", _I), ("parent_conv_id", _I), *((n, _I) for n in ("n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", _S), ("turn_id", _S)])


def _shared(a: bytes, b: bytes, low: int) -> int:
    """Turns that two sequences have in common, ``low`` at least."""
    most = min(len(a), len(b)) // WIDTH
    while low < most and a[low * WIDTH : (low + 1) * WIDTH] == b[low * WIDTH : (low + 1) * WIDTH]:
        low += 1
    return low


def _closed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of containers in the order in which they close; only a container's top names its head."""
    for container, group in groupby(rows, itemgetter(0)):
        path: list[list] = []  # of each open node: convs, smallest, children, leaves, saved, ends, code points, turn id
        place, before, top, head = 0, b"", 0, b""

        def close(depth: int) -> tuple:
            nonlocal place
            n, least, children, leaves, saved, ends, size, turn = path.pop()
            leaves, saved, place = leaves or 1, saved + (n - 1) * size, place + 1
            if path:
                above = path[-1]
                above[0] += n
                above[1] = least if above[1] is None else min(above[1], least)
                above[2] += 1
                above[3] += leaves
                above[4] += saved
            return container, place, None if path else head, least, depth, n, children, leaves, saved, ends, turn

        for _, seq, head, top, lens, n, least, ends in group:
            keep = _shared(before, seq, top + 1) if before else top
            while len(path) > keep - top:
                yield close(top + len(path))
            for d in range(keep, len(lens)):
                path.append([0, None, 0, 0, 0, _NOTHING, lens[d], seq[d * WIDTH : (d + 1) * WIDTH].hex()])
            node = path[-1]
            node[0] += n
            node[1] = least if node[1] is None else min(node[1], least)
            node[5], before = ends, seq
        while path:
            yield close(top + len(path))


def _parented(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes with their parents before them, each with its parent's id; a top's is null."""
    for _, group in groupby(rows, itemgetter(0)):
        latest: dict[int, int] = {}
        for _, _, head, conv, depth, *counts in group:
            latest[depth] = conv
            yield head, conv, depth, None if head is not None else latest[depth - 1], *counts


def _swept(contained: DataFrame) -> DataFrame:
    dealt = contained.where("container IS NOT NULL").select("container", "seq", "head", "depth", "lens", "n", "least", "ends_sha256").repartition("container").sortWithinPartitions("container", "seq")
    fields = "container binary, place long, head binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_id string"
    closed = map_arrow(dealt, lambda batches: _batches(_closed(_rows(batches)), _CLOSED), fields)
    return map_arrow(closed.sortWithinPartitions("container", F.desc("place")), lambda batches: _batches(_parented(_rows(batches)), _PLACED), _NODE)


def _head_nodes(heads: dict[bytes, tuple], sums: Iterable[tuple], ends: Iterable[tuple]) -> dict[bytes, list]:
    """Totals of each head from its containers' and its own sequence, children before parents."""
    total = {name: [0, None, 0, 0, 0, _NOTHING] for name in heads}

    def add(name: bytes, n: int, least: int, children: int, leaves: int, saved: int) -> None:
        t = total[name]
        t[0], t[1] = t[0] + n, least if t[1] is None else min(t[1], least)
        t[2], t[3], t[4] = t[2] + children, t[3] + leaves, t[4] + saved

    for name, n, least, children, leaves, saved in sums:
        add(name, n, least, children, leaves, saved)
    for name, n, least, digest in ends:
        add(name, n, least, 0, 0, 0)
        total[name][5] = digest
    for name in sorted(heads, key=lambda x: -heads[x][0]):
        t = total[name]
        t[3], t[4] = t[3] or 1, t[4] + (t[0] - 1) * heads[name][2]
        if heads[name][0]:
            add(heads[name][1], t[0], t[1], 1, t[3], t[4])
    return total


def nodes(convs: DataFrame, scratch: Scratch, share: int = SHARE, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """The trie of conversations (conv_id, seq, lens): a row per node, with ``turn_id`` (hex) of its last turn.

    Heads are bounded (see above), so their totals are added up in one place; every other
    node is made where its container lies.
    """
    spark = convs.sparkSession
    found = scratch.keep(sequences(convs, chunk), "sequences")
    count = found.count()
    limit = max(least, count // share)
    heads = {_ROOT: (0, None, 0, None)}
    if count > limit:
        heads |= {name: of for name, *of in _heads(found, limit, scratch)}
    contained = scratch.keep(_contained(found, heads), "contained")
    swept = scratch.keep(_swept(contained), "nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id"]
    if not count:
        scratch.drop_others(swept)
        return swept.select(*columns)
    tops = swept.where("head IS NOT NULL").groupBy("head").agg(F.sum("n_convs"), F.min("conv_id"), F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens"))
    own = contained.where("container IS NULL").select("head", "n", "least", "ends_sha256")
    plain = lambda rows: ((bytes(r[0]), *r[1:]) for r in rows)
    total = _head_nodes(heads, plain(tops.collect()), plain(own.collect()))
    scratch.drop_others(swept)
    made = []
    for name, (depth, parent, _, turn) in heads.items():
        n, conv, children, leaves, saved, digest = total[name]
        made.append((name, conv, depth, total[parent][1] if depth else None, n, children, leaves, saved, digest, turn))
    above = spark.createDataFrame(made, _NODE)
    names = F.broadcast(above.select(F.col("head"), F.col("conv_id").alias("_above")))
    below = swept.join(names, "head", "left").withColumn("parent_conv_id", F.coalesce("_above", "parent_conv_id"))
    return below.select(*columns).unionByName(above.select(*columns))


def digest(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The trie of a table of turns whose conversations are branched."""
    convs = scratch.keep(branched(turns(rows)), "conversations")
    return nodes(convs, scratch).drop("turn_id")


SQL = """
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (
  SELECT conv_id, ts, conv_id - conv_id % 100 AS base,
    CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, 8 * length(CAST(conv_id AS VARCHAR))),
      lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii(substring(CAST(conv_id AS VARCHAR), i // 8 + 1, 1)) AS BIGINT) ELSE CAST(0 AS BIGINT) END)),
      lambda s, b: xor(xor(s, b) // 2, (xor(s, b) % 2) * CAST(3988292384 AS BIGINT))), CAST(4294967295 AS BIGINT)) % 6 AS INTEGER) AS h
  FROM own),
built AS (
  SELECT a.conv_id, list_concat(coalesce(list_slice(b.ts, 1, a.h), []), list_slice(a.ts, a.h + 1, len(a.ts))) AS ts
  FROM cut a LEFT JOIN own b ON b.conv_id = a.base),
hashed AS (
  SELECT conv_id, ts, list_transform(ts, lambda x: sha256(length(x.r) || ':' || x.r || x.t)) AS ids FROM built),
paths AS (
  SELECT conv_id, d AS depth, len(ids) = d AS ends, list_slice(ids, 1, d) AS path, CASE WHEN d > 0 THEN list_slice(ids, 1, d - 1) END AS parent,
    CASE WHEN d > 0 THEN length(ts[d].t) ELSE 0 END AS size
  FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM hashed)),
nodes AS (
  SELECT path, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY path),
children AS (SELECT parent AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
wide AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
sums AS (
  SELECT list_slice(path, 1, a) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM wide) GROUP BY ALL)
SELECT wide.conv_id, wide.depth, up.conv_id AS parent_conv_id, wide.n_convs, wide.n_children, sums.n_leaves, sums.saved_tokens, wide.ends_sha256
FROM wide JOIN sums USING (path) LEFT JOIN nodes up ON up.path = wide.parent
"""
