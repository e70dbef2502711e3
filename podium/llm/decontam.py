"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Texts are lower-cased words of letters and digits.  A seed is a window of ``WINDOW``
words of which a mask ignores four; every two positions are ignored together by one
of the nine masks, so whatever two words of a window are replaced, one mask still
matches.  The three masks that ignore the last position serve ``SPAN`` words with one
replaced.  Items of fewer than ``SPAN`` words have windows of their own length: up to
four words match as they are, five to eight with one replaced, by a mask that ignores
the odd positions or one that ignores the even ones.  Texts get ``EDGE`` blanks on
both sides: words cut off there count as replaced.  So each overlap that the
verification accepts has a seed, and none is lost.  Seeds of the texts and of the
benchmark are joined by hash.

A hit names a document, an item and a diagonal (word position in the document less
that in the item).  The words along the diagonal verify it: it counts if some stretch
of ``OVERLAP`` words of the item (or all of a shorter item) has no more than a fifth
of its words unmatched.  So an overlap is found with substituted words, and a match
of common words only is not.

Null or wordless texts match nothing.  Items with the same words are searched once
and reported under the smallest item_id, null if all are null.  Repeated documents
share their result; rows that repeat an id are one document in ``contaminated`` and
stand for themselves in ``remove``.  Ids of documents are whole numbers or null.
Very long texts are searched whole.  Columns of any name may stand beside those named;
``remove`` carries them along.  Empty tables give no overlaps.  The benchmark's seeds
are broadcast only if they number at most ``BROADCAST_SEEDS``; otherwise they are
joined by shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import NULL_ID, Scratch, with_row_key

SPAN, OVERLAP, SUBSTITUTED = 9, 13, 0.2
WINDOW, EDGE = 10, 2
#: Positions that the masks of the operator ignore.
IGNORED = ((0, 3, 6, 9), (1, 4, 7, 9), (2, 5, 8, 9), (0, 2, 5, 7), (1, 4, 5, 6), (0, 1, 4, 8), (3, 6, 7, 8), (2, 3, 4, 6), (1, 2, 3, 5))
#: At 24 bytes a seed, a broadcast of about 50 MB at most.
BROADCAST_SEEDS = 2_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _windows(rows: DataFrame, keys: list[str], words_col: str, edge: int, width: int, whole: int) -> DataFrame:
    """(keys, at, w): windows of ``width`` words; the last ones have ``whole`` words, nulls behind them."""
    some = F.size(words_col) > 0
    before = F.array_repeat(F.lit(""), F.when(some, edge).otherwise(0))
    n = F.greatest(F.col("_n") - whole + 1, F.lit(0))
    shifted = [F.slice(F.col("_w"), F.lit(o + 1), n).alias(f"w{o}") for o in range(width)]
    padded = rows.select(*keys, F.concat(before, F.col(words_col), before).alias("_w")).withColumn("_n", F.size("_w"))
    spread = padded.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    return spread.withColumn("at", F.col("at") - edge)


def _hashed(windows: DataFrame, keys: list[str], masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """(keys, at, seed) for masks (number, positions that count)."""
    found = F.array(*[F.xxhash64(F.lit(k), *[F.col(f"w.w{o}") for o in positions]) for k, positions in masks])
    return windows.select(*keys, "at", F.explode(found).alias("seed"))


def seeds(rows: DataFrame, keys: list[str], words_col: str, edge: int = 0) -> DataFrame:
    """(keys, at, seed): every window's masked hashes."""
    masks = [(k, tuple(o for o in range(WINDOW) if o not in ignored)) for k, ignored in enumerate(IGNORED)]
    return _hashed(_windows(rows, keys, words_col, edge, WINDOW, SPAN), keys, masks)


def short_masks(n: int) -> list[tuple[int, tuple[int, ...]]]:
    """Masks for items of n words, fewer than SPAN: all words, or every other one where one may be replaced."""
    first = 100 + 2 * n
    return [(first, tuple(range(n)))] if required(n) == n else [(first + odd, tuple(range(odd, n, 2))) for odd in (0, 1)]


def short_seeds(rows: DataFrame, keys: list[str], words_col: str, n: int, edge: int = 0) -> DataFrame:
    """As ``seeds``, for items of n words."""
    return _hashed(_windows(rows, keys, words_col, edge, n, n), keys, short_masks(n))


def required(n: int) -> int:
    """Words that have to match in a stretch of n."""
    return math.ceil(round(min(OVERLAP, n) * (1 - SUBSTITUTED), 6))


def items_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct word sequences of the benchmark: (item_id, words)."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    return rows.groupBy("words").agg(F.min("item_id").alias("item_id")).select("item_id", "words")


def matched_in_stretch(flags: Column, n: Column) -> Column:
    """Most matched words in any stretch of OVERLAP words; flags: sorted item positions that match."""
    width = F.least(F.lit(OVERLAP), n)
    inside = lambda start: F.size(F.filter(flags, lambda p: (p >= start) & (p < start + width)))
    return F.array_max(F.transform(flags, inside))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Verified overlaps: (_d, _h, doc_id, item_id, doc_word, item_word, n_matched, n_item_words), one row per document, item and diagonal."""
    # Ids may be null or repeated, so items go by a hash of their words.
    items = items_of(benchmark, item_col, item_text_col).withColumn("_i", F.xxhash64("words")).withColumn("n_item_words", F.size("words"))
    texts = with_row_key(docs, id_col, text_col).select("_d", "_h", words(F.col("_text")).alias("words"))
    lengths = sorted(r[0] for r in items.where(F.col("n_item_words").between(1, SPAN - 1)).select("n_item_words").distinct().collect())  # eight at most
    theirs = seeds(items.where(F.col("n_item_words") >= SPAN), ["_i"], "words")
    ours = seeds(texts, ["_d", "_h"], "words", EDGE)
    for n in lengths:
        theirs = theirs.unionByName(short_seeds(items.where(F.col("n_item_words") == n), ["_i"], "words", n))
        ours = ours.unionByName(short_seeds(texts, ["_d", "_h"], "words", n, edge=n - required(n)))
    theirs = theirs.withColumnRenamed("at", "item_at")
    if theirs.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        theirs = F.broadcast(theirs)
    hits = ours.join(theirs, "seed").select("_d", "_h", "_i", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    # Kept as a table: hits are found once, and few of them spare the texts a shuffle.  The words around each hit decide.
    hits = Scratch(docs.sparkSession, "decontam").keep(hits, "hits")
    hit = with_row_key(docs, id_col, text_col).join(hits.select("_d", "_h").distinct(), ["_d", "_h"], "left_semi")
    # A document's words stand once beside an item, whatever the number of diagonals, and go before these become rows.
    diagonals = hits.groupBy("_d", "_h", "_i").agg(F.collect_list("diagonal").alias("diagonals"))
    met = hit.select(F.col("_id").alias("doc_id"), "_d", "_h", words(F.col("_text")).alias("own")).join(diagonals, ["_d", "_h"]).join(items, "_i")
    equal = lambda d: F.filter(F.sequence(F.lit(0), F.col("n_item_words") - 1), lambda p: F.get("own", p + d) == F.get("words", p))
    compared = F.transform("diagonals", lambda d: F.struct(d.alias("diagonal"), equal(d).alias("equal")))
    grouped = met.select("doc_id", "_d", "_h", "item_id", "n_item_words", compared.alias("compared")).select("doc_id", "_d", "_h", "item_id", "n_item_words", F.inline("compared"))
    best = matched_in_stretch(F.col("equal"), F.col("n_item_words"))
    enough = F.element_at(F.array(*[F.lit(required(n)) for n in range(1, OVERLAP + 1)]), F.least(F.lit(OVERLAP), F.col("n_item_words")))
    return grouped.withColumn("best", best).where(F.col("best") >= enough).select("_d", "_h", "doc_id", "item_id", (F.col("diagonal") + F.array_min("equal")).alias("doc_word"), F.array_min("equal").alias("item_word"), F.size("equal").alias("n_matched"), "n_item_words").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, item_id, n_matched, n_item_words, share): pairs of a document and an item it holds words of, best diagonal each."""
    found = overlaps(docs, benchmark, **columns).groupBy("doc_id", "item_id").agg(F.max("n_matched").cast("long").alias("n_matched"), F.max("n_item_words").cast("long").alias("n_item_words"))
    return found.withColumn("share", F.round(F.col("n_matched") / F.col("n_item_words"), 6))


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text overlaps with no item."""
    bad = overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **columns).select("_d", "_h").distinct()
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(bad, (d == bad["_d"]) & (h == bad["_h"]), "left_anti")


def _sql_words(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+')"


#: The same pairs in DuckDB's SQL, without seeds: every equal word of a document and an item puts the pair on a diagonal.
SQL = f"""
WITH own AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM (SELECT doc_id, {_sql_words('text')} AS w FROM documents)),
texts AS (SELECT min(item_id) AS item_id, w, len(w) AS n FROM (SELECT item_id, {_sql_words('text')} AS w FROM benchmark) GROUP BY w),
items AS (SELECT item_id, n, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM texts),
equal AS (SELECT DISTINCT doc_id, item_id, n, q - p AS diagonal, p FROM own JOIN items USING (x)),
many AS (SELECT doc_id, item_id, n, diagonal, list(p ORDER BY p) AS ps FROM equal GROUP BY ALL HAVING count(*) >= ceil(round(least({OVERLAP}, n) * {1 - SUBSTITUTED}, 6))),
found AS (SELECT doc_id, item_id, n, len(ps) AS n_matched FROM many WHERE list_max(list_transform(ps, lambda s: len(list_filter(ps, lambda p: p BETWEEN s AND s + {OVERLAP - 1})))) >= ceil(round(least({OVERLAP}, n) * {1 - SUBSTITUTED}, 6)))
SELECT doc_id, item_id, max(n_matched) AS n_matched, max(n) AS n_item_words, round(max(n_matched) / max(n), 6) AS share FROM found GROUP BY doc_id, item_id
"""
