"""Document fingerprints: a homomorphic multiset hash, with DataFrame functions only.

A text is the multiset of its paragraphs (lines with a word in them).  Each
paragraph is hashed to a wide vector, and a document's fingerprint is the sum of
its paragraphs' vectors, lane by lane modulo a power of two.  So the order of
paragraphs doesn't matter, and inserting or deleting one adds or subtracts its
vector (``combine``).  A vector has two parts:

* ``EXACT`` lanes modulo 2**32 for equality, two each from hashes of the whole
  paragraph under seeds of their own, so two paragraphs differ in 256 bits;
* one lane that counts the paragraph's runs of ``RUN`` words, and ``STABLE`` lanes
  that add a Cauchy variate hashed from each run, in fixed point, all modulo 2**40,
  for likeness.  Sums of Cauchy variates are Cauchy, their scale being the sum of the
  absolute weights, so the median size of the lanes of a difference estimates how
  many runs two texts don't share.  A run counts as often as it stands, and no more:
  a line that is repeated a hundred times weighs a hundred lines, not their square.
  A run starts at every word that has ``RUN`` - 1 words behind it in the paragraph
  (a shorter paragraph is one run), so a word put in or taken out changes ``RUN``
  runs at most, wherever the paragraph goes on.

``likeness`` is 1 - apart / (runs of a + runs of b), apart being that estimate, at
least the difference of both counts; it is held to 0..1, and is 1 for equal
fingerprints, two texts without words included.

``neighbours`` puts each row beside its successor in ascending (id, text) order,
the last row beside the first.  Ids are cut into ranges whose first id is in the
table; a range's first rows are also sent, as guards, to the range before.  So
texts are shuffled once, by range, and all later steps (sums, comparisons) keep
that partitioning.  The number of ranges grows with the shuffle partitions and with
the bytes of the table, so a range holds about ``RANGE_BYTES`` at most.

Ids are whole numbers or null; null ids sort first, rows of one id by text.  Null
texts count as empty, very long texts are taken whole, repeated rows are rows of
their own, and an empty table gives no rows.  Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podium.llm.common import NULL_ID

#: Words in a run; lanes for equality and for likeness, with their moduli's bits.  STABLE is odd, three times HASHES.
RUN, EXACT, HASHES = 4, 8, 27
STABLE = 3 * HASHES
EXACT_BITS, STABLE_BITS = 32, 40
#: Parts of a variate that one unit of a lane has, and the bits of a hash that decide it.
UNIT, DRAW_BITS = 64, 20
#: Id ranges: so many per shuffle partition, more if they would hold more than RANGE_BYTES, at most RANGES.
PER_PARTITION, RANGE_BYTES, RANGES = 16, 128 << 20, 1 << 16

#: tan(pi x / 2) is x (_A - _B x^2) / (1 - x^2) to within one per cent: right slope at 0, right pole at 1.
_A, _B = 1.5707963267948966, 0.2975568079742861


def units(text: Column, tag: Column) -> Column:
    """array<struct<tag, whole, hash, more>>: paragraphs (whole, with hashes of other seeds in ``more``) and their runs of words.

    Its first element has a null ``whole`` and counts for nothing: texts without words keep a row.
    """
    none = F.lit(None).cast("array<long>")
    unit = lambda whole, h, more=none: F.struct(tag.alias("tag"), whole.cast("boolean").alias("whole"), h.alias("hash"), more.alias("more"))
    others = lambda p: F.array(*[F.xxhash64(F.lit(k), p) for k in range(1, EXACT // 2)])
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p.rlike(r"\S"))
    words = F.transform(paragraphs, lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"\S+"), F.lit(0)), lambda w: F.xxhash64(w)))
    tuples = lambda w: F.arrays_zip(*[F.slice(w, k + 1, F.greatest(F.size(w) - RUN + 1, F.lit(1))).alias(f"w{k}") for k in range(RUN)])
    runs = F.flatten(F.transform(words, lambda w: F.transform(tuples(w), lambda r: F.xxhash64(*[r[f"w{k}"] for k in range(RUN)]))))
    return F.concat(
        F.array(unit(F.lit(None), F.lit(0).cast("long"))),
        F.transform(paragraphs, lambda p: unit(F.lit(True), F.xxhash64(p), others(p))),
        F.transform(runs, lambda h: unit(F.lit(False), h)),
    )


def sums() -> list[Column]:
    """Aggregates over rows (whole, hash, more): the lanes."""
    whole, run = F.coalesce(F.col("whole"), F.lit(False)), ~F.coalesce(F.col("whole"), F.lit(True))
    out = [F.count_if(run).alias("runs")]
    for k in range(EXACT // 2):
        h = F.col("hash") if k == 0 else F.get("more", F.lit(k - 1))
        out.append(F.sum(F.when(whole, h.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(0)).alias(f"x{2 * k}"))
        out.append(F.sum(F.when(whole, F.shiftrightunsigned(h, 32)).otherwise(0)).alias(f"x{2 * k + 1}"))
    for k in range(HASHES):
        h = F.col("hash") if k == 0 else F.xxhash64("hash", F.lit(1000 + k))
        out += [F.sum(F.when(run, _cauchy(h, j)).otherwise(0)).alias(f"s{3 * k + j}") for j in range(3)]
    return out


def _cauchy(h: Column, part: int) -> Column:
    """Cauchy variate in fixed point from one third of a hash: the tangent of an angle that ``DRAW_BITS`` bits choose."""
    draw = F.shiftrightunsigned(h, DRAW_BITS * part).bitwiseAND(F.lit((1 << DRAW_BITS) - 1))
    x = (2 * draw + 1).cast("double") / float(1 << DRAW_BITS) - 1.0
    return F.floor(x * (_A - _B * (x * x)) / (1.0 - x * x) * float(UNIT) + 0.5)


def _wrap(x: Column, bits: int) -> Column:
    return F.pmod(x, F.lit(1 << bits))


def vector() -> Column:
    """array<long> of all lanes from the columns that ``sums`` made."""
    exact = [_wrap(F.col(f"x{k}"), EXACT_BITS) for k in range(EXACT)]
    stable = [_wrap(F.col(c), STABLE_BITS) for c in ("runs", *(f"s{k}" for k in range(STABLE)))]
    return F.array(*exact, *stable)


def shown(lanes: Column) -> Column:
    """Hexadecimal text of a vector, all lanes in order."""
    return F.lower(F.array_join(F.transform(lanes, lambda x, i: F.lpad(F.hex(x), F.when(i < EXACT, F.lit(EXACT_BITS // 4)).otherwise(F.lit(STABLE_BITS // 4)), F.lit("0"))), ""))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the union of two multisets (sign 1), or of the first less the second (-1)."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p, i: F.pmod(p["a"] + sign * p["b"], F.when(i < EXACT, F.lit(1 << EXACT_BITS)).otherwise(F.lit(1 << STABLE_BITS))))


def likeness(a: Column, b: Column) -> Column:
    signed = lambda x: F.when(x >= (1 << (STABLE_BITS - 1)), x - (1 << STABLE_BITS)).otherwise(x)
    tail = lambda v: F.slice(v, EXACT + 2, STABLE)
    runs = lambda v: F.element_at(v, EXACT + 1)
    apart = F.zip_with(tail(a), tail(b), lambda x, y: F.abs(signed(F.pmod(x - y, F.lit(1 << STABLE_BITS)))))
    median = F.element_at(F.sort_array(apart), STABLE // 2 + 1).cast("double") / float(UNIT)
    size = runs(a) + runs(b)
    differ = F.greatest(F.abs(runs(a) - runs(b)).cast("double"), median)
    return F.when(a == b, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - differ / size)))


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Each distinct ``keys`` with the vector of its rows' texts taken together."""
    rows = docs.select(*keys, F.explode_outer(units(F.coalesce(F.col(text_col), F.lit("")), F.lit(0))).alias("u")).select(*keys, "u.whole", "u.hash", "u.more")
    return rows.groupBy(*keys).agg(*sums()).select(*keys, vector().alias("lanes"))


def _ranges(rows: DataFrame) -> list[int]:
    """First ids of the ranges, ascending; each occurs in the table."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = min(RANGES, max(PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1))
    steps = [i / parts for i in range(1, parts)]
    row = rows.agg(F.min("_d").alias("lo"), F.percentile_approx("_d", steps or [0.5], max(10_000, 20 * parts)).alias("cuts")).first()
    return [] if row["lo"] is None else sorted({row["lo"], *row["cuts"]}) if steps else [row["lo"]]


def _constant(values: list) -> Column:
    """Array of whole numbers as one constant."""
    return F.from_json(F.lit(json.dumps(values)), "array<array<bigint>>" if values and isinstance(values[0], list) else "array<bigint>")


def _range_of(x: Column, firsts: list[int]) -> Column:
    """Number of the range that holds x: two short searches instead of a long one."""
    width = max(1, int(len(firsts) ** 0.5))
    groups = [firsts[i : i + width] for i in range(0, len(firsts), width)]
    at = lambda values: F.size(F.filter(values, lambda b: b <= x)) - 1
    group = at(_constant([g[0] for g in groups]))
    return (group * width + at(F.element_at(_constant(groups), group + 1))).cast("int")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, rn, guard, doc_id, text, next_text): each row and its successor's text.

    Guards are copies of the next range's first rows; they have no successor of use.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    firsts = _ranges(rows) or [0]
    n = len(firsts)
    own = _range_of(F.col("_d"), firsts)
    before = F.when(own == 0, n - 1).otherwise(own - 1)
    first_rows = F.col("_d") == F.element_at(_constant(firsts), own + 1)
    places = F.when(first_rows, F.array(F.struct(own.alias("range"), F.lit(0).alias("guard")), F.struct(before.alias("range"), F.lit(1).alias("guard")))).otherwise(F.array(F.struct(own.alias("range"), F.lit(0).alias("guard"))))
    dealt = rows.withColumn("_p", F.explode(places)).select("_p.range", "_p.guard", "doc_id", "_d", "text")
    order = Window.partitionBy("range").orderBy("guard", "_d", "text")
    return dealt.select("range", F.row_number().over(order).alias("rn"), "guard", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: fingerprints of its text and of its edited text, with likenesses.

    The edited text has its last quarter of code points replaced by as many from the next row's start.
    """
    pairs = neighbours(docs, id_col, text_col)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substr("text", F.lit(1), n - quarter), F.coalesce(F.substr("next_text", F.lit(1), quarter), F.lit(""))))
    keys = ["range", "rn", "guard", "doc_id", "n_chars", "edited_sha256"]
    # Digests and units are made before the rows multiply, so no text travels with its units; the array is never empty.
    whole = edited.select(*keys[:-1], F.sha2("edited", 256).alias("edited_sha256"), F.concat(units(F.col("text"), F.lit(0)), units(F.col("edited"), F.lit(1))).alias("units"))
    both = whole.select(*keys, F.explode_outer("units").alias("u"))
    lanes = both.select(*keys, "u.tag", "u.whole", "u.hash", "u.more").groupBy(*keys, "tag").agg(*sums()).select(*keys, "tag", vector().alias("lanes"))
    along = Window.partitionBy("range").orderBy("rn", "tag")
    found = lanes.select(*keys, "tag", "lanes", F.lead("lanes", 1).over(along).alias("edited_lanes"), F.lead("lanes", 2).over(along).alias("next_lanes")).where("tag = 0 AND guard = 0")
    return found.select("doc_id", "n_chars", "edited_sha256", shown(F.col("lanes")).alias("fingerprint"), shown(F.col("edited_lanes")).alias("edited_fingerprint"), likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"))
