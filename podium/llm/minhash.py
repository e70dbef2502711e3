"""Near-duplicates by MinHash with tensored banding.

Two small collections of ``SIDE`` half keys, each of ``ROWS`` minhashes, are
computed for a text's set of word shingles.  Every half key of one collection is
combined with every one of the other, so SIDE * SIDE table keys of 2 * ROWS
minhashes come from 2 * SIDE * ROWS minhash values, about the square root of what
separate tables would take.  A pair with similarity s misses with probability
below 2 * (1 - s**ROWS)**SIDE: 0.00001 at 0.8; one of similarity 0.1 meets in one of
3000 cases, so unlike texts rarely become candidates.  Half keys that only one class has
can't meet, so they are dropped before they are combined.

Texts with equal sets are one class and stand in the tables once, under their
smallest id.  Candidates are verified on the full sets.  In a table bucket every
class is first compared with the bucket's smallest only; classes already linked
need no more.  Where a bucket still holds several components, classes of different ones
that share a table key are screened by parity bitmaps of their sets: the bits in
which two bitmaps differ are at most the shingles in which the sets differ, so no
similar pair is screened out.  What passes is verified, for two components at a
time the closest few first and all of them at last.  Screening goes by one half
key in blocks of at most BLOCK by BLOCK classes, the largest component's members
on one side only; a pair is looked at under its first common half key.  So no pair
within a component is listed, and no link is lost by a cap.

Words are maximal runs of other than ASCII white space, A-Z in lower case.  A text
of fewer words than a shingle has the whole sequence as its one shingle; one
without words (or null) has none and is linked with nothing.  Texts of any length are
taken whole.  Ids are whole numbers or null.  Rows of one id count as one document
with several texts; a null id counts as one below all.  Rows with equal texts are one
class; ties between candidates go by id.  An empty table gives no rows.  Other
columns are ignored by ``near_duplicates``, whatever their names, and carried along
by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import NULL_ID, Rolling, Scratch, map_arrow, mix, sliced
from podium.llm.components import components

WORDS, SIMILAR = 5, 0.8
SIDE, ROWS = 18, 3
#: Pairs verified for two components and a block in the last rounds; None: all that passed the screen.
ROUNDS = (2, 16, None)
#: Classes of a side in a block, and bits of the bitmaps: at least 4 per shingle up to the larger.
BLOCK, BITS = 512, (256, 1 << 16)

_CHUNK = 1 << 20
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_MIXERS = np.random.RandomState(7).randint(1, 2**62, (2, 2 * SIDE * ROWS), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    return word_hashes_of(text.encode("utf-8", "replace"))


def word_hashes_of(text: bytes) -> np.ndarray:
    data = np.frombuffer(text.lower(), np.uint8)
    roll, out, at = Rolling.get(), [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        if end < len(data):
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            if not len(blanks):  # a word of more than a chunk
                rest = np.flatnonzero(_BLANK[data[end:]])
                stop = end + (int(rest[0]) if len(rest) else len(data) - end)
                out.append(np.frombuffer(hashlib.blake2b(data[at:stop].tobytes(), digest_size=8).digest(), np.uint64))
                at = stop
                continue
            end = at + int(blanks[-1]) + 1
        piece = data[at:end]
        solid = np.concatenate([[False], ~_BLANK[piece], [False]])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        start, stop = edges[::2], edges[1::2]
        out.append(roll.of(roll.prefix(roll.table[piece]), start, stop) + (stop - start).astype(np.uint64))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    width, n = min(k, len(w)), max(1, len(w) - k + 1)
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return np.unique(h)


def half_keys(shingles: np.ndarray) -> np.ndarray:
    """2 * SIDE keys, each of ROWS minhashes."""
    least = np.full(2 * SIDE * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 13):
        part = (shingles[at : at + (1 << 13), None] ^ _MIXERS[0]) * _MIXERS[1]
        part ^= part >> np.uint64(31)
        np.minimum(least, part.min(0), out=least)
    h = np.zeros(2 * SIDE, np.uint64)
    for r in range(ROWS):
        h = mix(h * np.uint64(31) + least[r::ROWS])
    return h


def parity_bits(shingles: np.ndarray) -> bytes:
    """For each bit whether an odd number of shingles falls on it; the number of bits is a power of two."""
    bits = min(BITS[1], max(BITS[0], 1 << (4 * len(shingles) - 1).bit_length()))
    counts = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of fewer bits for the same set, rows of bytes."""
    while bitmap.shape[1] > size:
        half = bitmap.shape[1] // 2
        bitmap = bitmap[:, :half] ^ bitmap[:, half:]
    return bitmap


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n_shingles, c1, c2, halves, bits): c1 and c2 name the set, halves are its half keys (null without shingles), bits its bitmap."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sizes, names, halves, bits = [], np.zeros((batch.num_rows, 2), np.uint64), [], []
            for i, text in enumerate(batch.column("text")):
                found = shingle_set(text.as_py(), words)
                sizes.append(len(found))
                names[i] = mix(found).sum(), mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
                halves.append(half_keys(found).view(np.int64) if len(found) else None)
                bits.append(parity_bits(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(names[:, 0].view(np.int64)), pa.array(names[:, 1].view(np.int64)), pa.array(halves, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["id", "n_shingles", "c1", "c2", "halves", "bits"])

    return map_arrow(rows, run, "id long, n_shingles long, c1 long, c2 long, halves array<long>, bits binary")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, id): each class under the combinations of its half keys that another class has too."""
    halves = classes.select("id", F.posexplode("halves").alias("h", "half"))
    shared = halves.groupBy("h", "half").agg(F.count("*").alias("n")).where("n > 1").select("h", "half")
    live = halves.join(shared, ["h", "half"], "left_semi").groupBy("id").agg(F.collect_list(F.struct("h", "half")).alias("halves"))
    side = lambda left: F.filter("halves", lambda x: (x["h"] < SIDE) == left)
    lefts = live.select("id", F.explode(side(True)).alias("left"), side(False).alias("rights"))
    return lefts.select("id", "left", F.explode("rights").alias("right")).select(F.xxhash64("left.h", "left.half", "right.h", "right.half").alias("key"), "id")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (u, v) whose texts are similar by their full sets."""
    left = pairs.select("u", "v").join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u")
    both = left.join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", shingle_set("", words))
        for batch in sliced(batches, "a"):
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                b = b.as_py()
                if b != last[0]:
                    last = b, shingle_set(b, words)
                keep.append(similar(shingle_set(a.as_py(), words), last[1], percent))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, run, "u long, v long").distinct()


def _close_pairs(rows: list[dict], percent: int, most: int | None) -> list[tuple[int, int]]:
    """Pairs of one block that the screen lets pass, larger id first."""
    i = rows[0]["i"]
    comp = np.array([r["component"] for r in rows])
    block = np.array([r["block"] for r in rows])
    size = np.array([r["n_shingles"] for r in rows])
    half = np.array([r["halves"] for r in rows])
    ids = np.array([r["id"] for r in rows])
    one, other = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    if block.min() != block.max() or rows[0]["alone"]:
        at = np.meshgrid(one, other, indexing="ij")
        p, q = at[0].ravel(), at[1].ravel()
        keep = (comp[p] != comp[q]) & (p < q if rows[0]["alone"] else True)
    else:
        return []
    keep &= 100 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q])
    p, q = p[keep], q[keep]
    met = np.zeros(len(p), bool)
    for j in range(SIDE, 2 * SIDE):
        met |= half[p, j] == half[q, j]
    for j in range(i):
        met &= half[p, j] != half[q, j]
    p, q = p[met], q[met]
    if not len(p):
        return []
    widths = np.array([len(r["bits"]) for r in rows])
    grids = {w: np.frombuffer(b"".join(r["bits"] for r in rows if len(r["bits"]) == w), np.uint8).reshape(-1, w) for w in np.unique(widths).tolist()}
    row_of = np.zeros(len(rows), np.int64)
    for w in grids:
        row_of[widths == w] = np.arange(int((widths == w).sum()))
    apart = np.zeros(len(p), np.int64)
    for a in grids:
        for b in grids:
            which = np.flatnonzero((widths[p] == a) & (widths[q] == b))
            small = min(a, b)
            ga, gb = _fold(grids[a], small), _fold(grids[b], small)
            for k in range(0, len(which), max(1, (1 << 24) // small)):
                w = which[k : k + max(1, (1 << 24) // small)]
                apart[w] = np.bitwise_count(ga[row_of[p[w]]] ^ gb[row_of[q[w]]]).sum(1, dtype=np.int64)
    close = (100 + percent) * apart <= (100 - percent) * (size[p] + size[q])
    p, q, apart = p[close], q[close], apart[close]
    if most is not None and len(p):
        low, high = np.minimum(comp[p], comp[q]), np.maximum(comp[p], comp[q])
        by = np.lexsort((apart, high, low))
        new = np.concatenate([[True], (low[by][1:] != low[by][:-1]) | (high[by][1:] != high[by][:-1])])
        place = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        p, q = p[by[place < most]], q[by[place < most]]
    return list(zip(np.maximum(ids[p], ids[q]).tolist(), np.minimum(ids[p], ids[q]).tolist(), strict=True))


def _screened(open_: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs (u, v) of ``open_`` classes (id, n_shingles, halves, bits, component) that pass the screen."""
    sides = open_.select("id", "component", "n_shingles", "halves", "bits", F.posexplode(F.slice("halves", 1, SIDE)).alias("i", "left"))
    parts = sides.groupBy("i", "left", "component").agg(F.count("*").alias("n"))
    groups = parts.groupBy("i", "left").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("big")).where("n > big.n")
    shares = groups.select("i", "left", F.col("big.component").alias("big"), F.ceil((F.col("n") - F.col("big.n")) / BLOCK).cast("int").alias("smalls"), F.ceil(F.col("big.n") / BLOCK).cast("int").alias("bigs"))
    met = sides.join(shares, ["i", "left"]).withColumn("is_big", F.col("component") == F.col("big"))
    own = F.when(F.col("is_big"), F.col("smalls") + F.pmod(F.xxhash64("id"), F.col("bigs"))).otherwise(F.pmod(F.xxhash64("id"), F.col("smalls"))).cast("int")
    small, big = F.sequence(F.lit(0), F.col("smalls") - 1), F.sequence(F.col("smalls"), F.col("smalls") + F.col("bigs") - 1)
    partners = F.when(F.col("is_big"), small).otherwise(F.concat(small, big))
    sent = met.withColumn("block", own).withColumn("partner", F.explode(partners))
    task = F.xxhash64("i", "left", F.least("block", "partner"), F.greatest("block", "partner"))
    sent = sent.select(task.alias("task"), "i", "block", (F.col("block") == F.col("partner")).alias("alone"), "id", "component", "n_shingles", "halves", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in sliced(batches, "bits", 1 << 20):
            out: list[tuple[int, int]] = []
            for r in batch.to_pylist():
                if rows and r["task"] != rows[0]["task"]:
                    out += _close_pairs(rows, percent, most)
                    rows = []
                rows.append(r)
            yield _pair_batch(out)
        if rows:
            yield _pair_batch(_close_pairs(rows, percent, most))

    return map_arrow(sent.repartition("task").sortWithinPartitions("task"), run, "u long, v long").distinct()


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    ``component_id`` is the smallest id reachable over links, ``kept`` whether it is the row's own.
    """
    spark, percent = docs.sparkSession, round(100 * similarity)
    scratch = Scratch(spark, "minhash")
    marks = scratch.keep(signatures(docs, id_col, text_col, words), "signatures")
    classes = scratch.keep(marks.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves"), F.first("bits").alias("bits")), "classes")

    keys = table_keys(classes)
    buckets = keys.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    members = scratch.keep(keys.join(buckets, "key"), "members")
    votes = members.where("id <> least").groupBy(F.col("id").alias("u"), F.col("least").alias("v")).agg(F.count("*").alias("votes"))
    involved = members.select("id").distinct()
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = scratch.keep(rows.join(involved, "id"), "texts")
    votes = scratch.keep(votes, "votes")

    # Each class and the bucket's smallest it meets most often; then its other smallest ones that are still apart.
    best = votes.groupBy("u").agg(F.max(F.struct("votes", (-F.col("v")).alias("w"))).alias("b")).select("u", (-F.col("b.w")).alias("v"))
    links = scratch.keep(verified(best, texts, words, percent), "links")
    found = scratch.keep(components(links, scratch), "components")

    def with_component(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(found.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(f"c_{c}", F.coalesce(f"_{c}", c)).drop(f"_{c}")
        return df

    def more(pairs: DataFrame) -> None:
        nonlocal links, found
        new = scratch.keep(verified(pairs, texts, words, percent), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            found = scratch.keep(components(links, scratch), "components")

    more(with_component(votes.select("u", "v").join(best, ["u", "v"], "left_anti"), "u", "v").where("c_u <> c_v").select("u", "v"))

    for most in ROUNDS:
        inside = with_component(members.where("n > 2").select("key", "id"), "id")
        several = inside.groupBy("key").agg(F.min("c_id").alias("a"), F.max("c_id").alias("b")).where("a <> b").select("key")
        ids = inside.join(several, "key", "left_semi").select("id", F.col("c_id").alias("component")).distinct()
        open_ = scratch.keep(classes.select("id", "n_shingles", "halves", "bits").join(ids, "id"), "open")
        close = scratch.keep(_screened(open_, percent, most), "close")
        if close.isEmpty():
            break
        more(close)
    scratch.drop_others(marks, classes, found)
    ids = classes.select("c1", "c2", F.col("id").alias("first_id"))
    named = marks.select("id", "n_shingles", "c1", "c2").join(ids, ["c1", "c2"], "left").join(found.select(F.col("id").alias("first_id"), "component"), "first_id", "left")
    component = F.coalesce("component", "first_id", "id")
    return named.select(F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "n_shingles", F.nullif(component, F.lit(NULL_ID)).alias("component_id"), (component == F.col("id")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with all its columns: the one of smallest id, null below all.

    Rows are told apart by id and text, so texts of one id, or without any, stand for
    themselves; of rows equal in both one stays.
    """
    node, d = "_node", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    rows = docs.withColumn(node, F.xxhash64(d, F.coalesce(F.col(text_col), F.lit(""))))
    ids = rows.select(F.col(node).alias("doc_id"), d.alias("d")).distinct()
    found = near_duplicates(rows.select(F.col(node).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", **options).select("doc_id", "component_id").distinct()
    kept = ids.join(found, "doc_id").groupBy("component_id").agg(F.min(F.struct("d", "doc_id")).alias("least")).select(F.col("least.doc_id").alias(node))
    return rows.join(kept, node, "left_semi").dropDuplicates([node]).select(*docs.columns)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:least(p + 3, len(w))], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.v FROM reach r JOIN edges e ON r.b = e.u),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""
