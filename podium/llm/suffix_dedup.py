"""Removal of long repeated byte strings by prefix-free parsing.

Candidates.  Each ``length``-byte string has one anchor, which its own bytes decide:
the place in it whose rolling hash over ``TRIGGER`` bytes is the least, leftmost
first.  Consecutive start positions with one anchor make a piece: the bytes of all
their strings.  Pieces are grouped by their anchor's bytes; an anchor that occurs once
has nothing repeated and is dropped.  Of pieces that look equal, by two 64-bit hashes of
the anchor and of all bytes, those of the first and the last document go on; what the
sort finds in them holds for all.

Sorting (``repeated_starts``).  The pieces of a batch, whole groups of them, are the
text of a prefix-free parse.  A place whose hash of ``WINDOW`` bytes is divisible by
``EVERY`` is a trigger; phrases run from one trigger to the end of the next.  The
distinct phrases, sorted, are the dictionary, and each piece becomes a list of their
ranks, the parse.  The suffix array of the dictionary orders what is left of a phrase
from a start on, that of the parse orders what comes behind the phrase: as no phrase
begins another, the two numbers combine into the order of all starts in the text.
Neighbours in it with ``length`` bytes in common, by the common lengths of both
arrays, are the repeated strings.

A group of more than ``GROUP`` different pieces is split by longer context before it is
sorted (``_split``): pieces are cut where the distance of their starts to the anchor
reaches a multiple of ``WIDTHS[0]``, and cuts meet only if the bytes that all strings of
such a cut share are equal.  What is too large still is cut by ``WIDTHS[1]``, that is to
single strings, of which equal ones alone meet.

Every byte covered by a string that also starts elsewhere, in the same document
too, is removed; strings are judged on the input.  Texts shorter than ``length``
bytes and null texts keep all they have, a very long text is cut into overlapping
blocks of 1 MiB on the way.  Rows with equal id and text are repeats of each other,
as other copies are; ids are whole numbers or null.  Other columns, also such as
``removed``, are ignored.  An empty table gives an empty result.

Passages.  A passage of many short words has fewer than ``length`` bytes, so nothing of
it is removed.  ``shared`` tells whether a run of ``words`` words of a row, A-Z in lower
case, stands in another row too.  Runs make pieces as byte strings do, with words in
place of bytes.  A piece that two rows have settles both.  For the rows not settled the
runs of the pieces under their anchors are counted one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import Rolling, Scratch, map_arrow, mix, sliced, with_row_key
from podium.llm.minhash import word_hashes_of

LENGTH, TRIGGER = 400, 64
#: Words of a passage that is told as shared, and of its anchor; what stands between texts, as no byte of theirs is 0xFF.
WORDS, SEED, BETWEEN = 51, 8, b" \xff "
#: Different pieces of one anchor that are sorted together at most, and pieces sorted in one go.
GROUP, BATCH = 4_000, 3_000
#: How many neighbouring starts of a piece stay together where larger groups are split, step by step.
WIDTHS = (32, 1)
#: Bytes of a trigger of the parse, and how many places there are to one of them.
WINDOW, EVERY = 8, 32
_BLOCK, _INDEX = 1 << 20, np.uint64((1 << 21) - 1)
_SALT, _SALT2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value, leftmost first, in each run of ``width`` values."""
    n = len(h) - width + 1
    v = (h & ~_INDEX) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _INDEX).astype(np.int64)


def pieces(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor, key, entry) of each piece, arrays in order.

    key hashes the anchor's bytes, entry all bytes of the piece's strings.
    """
    trigger = min(TRIGGER, length)
    roll, found = Rolling.get(), []
    for base in range(0, max(0, len(data) - length + 1), _BLOCK):
        b = np.frombuffer(data, np.uint8)[base : base + _BLOCK + length - 1]
        found.append(_pieces(roll.table[b], length, trigger, base)[:5])
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else tuple(np.zeros(0, np.int64) for _ in range(5))


def _pieces(values: np.ndarray, length: int, trigger: int, base: int, whole: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """What ``pieces`` tells, of one block of 64-bit values whose first one is in place ``base``; then the block's prefix sums.

    ``whole`` tells which starts count; a piece holds none but those.
    """
    roll = Rolling.get()
    sums = roll.prefix(values)
    at = np.arange(len(values) - trigger + 1)
    h = roll.of(sums, at, at + trigger)
    least = _least(h, length - trigger + 1)
    new = least[1:] != least[:-1]
    if whole is not None:
        new |= whole[1:] != whole[:-1]
    change = np.flatnonzero(new) + 1
    first, last = np.concatenate([[0], change]), np.concatenate([change - 1, [len(least) - 1]])
    if whole is not None:
        first, last = first[whole[first]], last[whole[first]]
    place = least[first]
    shape = (last - first).astype(np.uint64) * _SALT + (place - first).astype(np.uint64) * _SALT2
    entry = mix(roll.of(sums, first, last + length) ^ shape)
    return first + base, last + base, place + base, mix(h[place] + _SALT).view(np.int64), entry.view(np.int64), sums


def word_pieces(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, ...]:
    """(text, key, entry) of the different pieces of runs of ``words`` words that each text has."""
    found = [(text, f[3], f[4]) for text, _, f in _word_blocks(texts, words)]
    text, key, entry = map(np.concatenate, zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((entry, text))
    text, key, entry = text[order], key[order], entry[order]
    new = np.ones(len(order), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (text[1:] != text[:-1])
    return text[new], key[new], entry[new]


def word_runs(texts: list[bytes], asked: list[dict[int, bool]], words: int = WORDS) -> tuple[np.ndarray, ...]:
    """(text, run, many): hashes of the runs of ``words`` words in the pieces whose entries are asked of a text, each once, with what is noted there."""
    roll, every = Rolling.get(), np.fromiter({e for x in asked for e in x}, np.int64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for of, base, (first, last, _, _, entry, sums) in _word_blocks(texts, words):
        at = np.array([i for i in np.flatnonzero(np.isin(entry, every)) if int(entry[i]) in asked[of[i]]], np.int64)
        many = np.fromiter((asked[t][e] for t, e in zip(of[at].tolist(), entry[at].tolist(), strict=True)), bool, len(at))
        sizes = last[at] - first[at] + 1
        start = np.repeat(first[at] - base - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out.append((np.repeat(of[at], sizes), roll.of(sums, start, start + words).view(np.int64), np.repeat(many, sizes)))
    text, run, many = map(np.concatenate, zip(*out, strict=True))
    order = np.lexsort((~many, run, text))
    text, run, many = text[order], run[order], many[order]
    new = np.ones(len(order), bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    return text[new], run[new], many[new]


def _word_blocks(texts: list[bytes], words: int) -> Iterator[tuple[np.ndarray, int, tuple[np.ndarray, ...]]]:
    """The texts' pieces by words, block by block, and before them the place of each piece's text and the block's first word.

    No run reaches over a text's end.  Blocks begin at a text's start or in a text that has several of its own, so a text
    has the same pieces whatever lies beside it.
    """
    between, at = word_hashes_of(BETWEEN)[0], 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(BETWEEN) + len(texts[end]) <= _BLOCK:
            size += len(BETWEEN) + len(texts[end])
            end += 1
        w = word_hashes_of(BETWEEN.join(texts[at:end]))
        before = np.zeros(len(w) + 1, np.int64)
        before[1:] = np.cumsum(w == between)
        for base in range(0, max(0, len(w) - words + 1), _BLOCK):
            b = w[base : base + _BLOCK + words - 1]
            start = np.arange(base, base + len(b) - words + 1)
            found = _pieces(b, words, min(SEED, words), base, before[start + words] == before[start])
            yield at + before[found[0]], base, found
        at = end


def _bytes_of(text) -> bytes:
    return text.as_py().encode("utf-8", "replace")


def parse(rows: DataFrame, length: int) -> DataFrame:
    """(key, entry, _d, _h, n): each document's different pieces and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            keys, entries, counts, owner = [], [], [], []
            for i, text in enumerate(batch.column("_text")):
                _, _, _, key, entry = pieces(_bytes_of(text), length)
                entry, at, n = np.unique(entry, return_index=True, return_counts=True)
                keys.append(key[at])
                entries.append(entry)
                counts.append(np.minimum(n, 2))
                owner.append(np.full(len(entry), i))
            take = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(entries)), batch.column("_d").take(take), batch.column("_h").take(take), pa.array(np.concatenate(counts).astype(np.int64))], ["key", "entry", "_d", "_h", "n"])

    return map_arrow(rows, run, "key long, entry long, _d long, _h long, n long")


def parse_words(rows: DataFrame, words: int) -> DataFrame:
    """(key, entry, _d, _h): each row's different pieces of runs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", 1 << 18):
            text, key, entry = word_pieces([_bytes_of(t) for t in batch.column("_text")], words)
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(entry), batch.column("_d").take(take), batch.column("_h").take(take)], ["key", "entry", "_d", "_h"])

    return map_arrow(rows, run, "key long, entry long, _d long, _h long")


def _settled(rows: DataFrame, words: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(_d, _h) of rows that have a piece of words in common with another; (_d, _h, runs), the entries whose runs are to be counted for the others.

    An entry that several rows have is asked of one of them and is ``many``: its runs are shared whatever else has them.
    """
    parsed = scratch.keep(parse_words(rows, words), "word-pieces")
    twice = parsed.groupBy("key").agg(F.count("*").alias("total")).where("total > 1").select("key")
    live = scratch.keep(parsed.join(twice, "key", "left_semi").withColumn("key", F.col("key").bitwiseXOR(F.lit(1))), "word-live")
    scratch.drop(parsed)
    entries = scratch.keep(live.groupBy("key", "entry").agg(F.count("*").alias("n"), F.min(F.struct("_d", "_h")).alias("owner")), "word-entries")
    settled = scratch.keep(live.join(entries.where("n > 1").select("key", "entry"), ["key", "entry"], "left_semi").select("_d", "_h").distinct(), "settled")
    several = entries.groupBy("key").agg(F.min("owner").alias("least"), F.max("owner").alias("greatest"), F.max("n").alias("n")).where("least < greatest or n > 1").select("key")
    open_ = entries.where("n = 1").select("key", "owner.*").join(settled, ["_d", "_h"], "left_anti").select("key").distinct().join(several, "key", "left_semi")
    wanted = entries.join(open_, "key", "left_semi").select("owner.*", F.struct("entry", (F.col("n") > 1).alias("many")).alias("run"))
    return settled, wanted.groupBy("_d", "_h").agg(F.collect_list("run").alias("runs"))


def _contents(wanted: DataFrame, length: int, words: int) -> DataFrame:
    """(key, entry, m, left, content): the bytes of the entries in ``wanted.entries``, of two places if ``twice``; left is what precedes the anchor.

    Beside them (key, many, _d, _h) without content: the runs of words in the entries of ``wanted.runs``, hashed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("entry", pa.int64()), ("m", pa.int64()), ("left", pa.int32()), ("content", pa.binary()), ("many", pa.bool_()), ("_d", pa.int64()), ("_h", pa.int64())])
        for batch in sliced(batches, "_text", 1 << 19):
            out = []
            for text, entries in zip(batch.column("_text"), batch.column("entries"), strict=True):
                asked = {x["entry"]: x for x in entries.as_py() or []}
                if not asked:
                    continue
                places = {e: 1 + x["twice"] for e, x in asked.items()}
                data = _bytes_of(text)
                first, last, place, _, entry = pieces(data, length)
                for i in np.flatnonzero(np.isin(entry, np.fromiter(asked, np.int64, len(asked)))):
                    e = int(entry[i])
                    if places[e]:
                        places[e] -= 1
                        out.append({"key": asked[e]["key"], "entry": e, "m": asked[e]["m"], "left": int(place[i] - first[i]), "content": data[first[i] : last[i] + length]})
            yield pa.RecordBatch.from_pylist(out, schema)
            batch = batch.filter(batch.column("runs").is_valid())
            of, runs, many = word_runs([_bytes_of(t) for t in batch.column("_text")], [{x["entry"]: x["many"] for x in r} for r in batch.column("runs").to_pylist()], words)
            take, none = pa.array(of), {f.name: pa.nulls(len(of), f.type) for f in schema}
            yield pa.RecordBatch.from_pydict(none | {"key": pa.array(runs), "many": pa.array(many), "_d": batch.column("_d").take(take), "_h": batch.column("_h").take(take)}, schema)

    return map_arrow(wanted, run, "key long, entry long, m long, left int, content binary, many boolean, _d long, _h long")


class _Suffixes:
    """Ranks of all suffixes of a sequence by their first w, 2w, 4w, ... symbols, w being ``width``, up to ``depth``.

    A rank is the number of smaller suffixes; only those that share theirs are sorted again.  Symbol 0 ends a string, and nothing behind it counts; ``left`` is each place's distance
    to it.  The first ``width`` symbols are packed into one number, 9 bits each if several.
    """

    def __init__(self, symbols: np.ndarray, left: np.ndarray, depth: int, width: int = 1):
        self.symbols, self.left, self.width = symbols, left, width
        packed = symbols.astype(np.int64)
        for k in range(1, width):
            packed <<= 9
            packed[:-k] |= np.where(left[:-k] >= k, symbols[k:], 0)
        order = np.argsort(packed)
        begin, tied = self._classes(packed[order], np.zeros(len(order), np.int64), order)
        rank = np.empty(len(order), np.int32)
        rank[order] = begin
        self.levels = [rank]
        step = width
        while step < depth:
            # suffixes that end within the symbols compared so far have equals only, those that are alone have none
            tied = tied[left[tied] >= step]
            pair = rank[tied] * np.int64(len(rank)) + rank[tied + step]
            by = np.argsort(pair)
            order, pair = tied[by], pair[by]
            head = rank[order].astype(np.int64)
            begin, tied = self._classes(pair, head, order)
            if np.array_equal(begin, head):
                break
            rank = rank.copy()
            rank[order] = begin
            self.levels.append(rank)
            step *= 2

    @staticmethod
    def _classes(keys: np.ndarray, head: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank of each, those of ``order`` whose rank another has): equal keys lie together, from ``head`` on those of a former class."""
        at = np.arange(len(keys))
        new, former = np.ones(len(keys), bool), np.ones(len(keys), bool)
        new[1:], former[1:] = keys[1:] != keys[:-1], head[1:] != head[:-1]
        begin = head + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(former, at, 0))
        alone = new & np.append(new[1:], True)[: len(new)]
        return begin, order[~alone]

    @property
    def rank(self) -> np.ndarray:
        return self.levels[-1]

    def shared(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Symbols that the suffixes at a and b have in common at their start; ``most`` and more may be told short."""
        n = np.zeros(len(a), np.int64)
        top = len(self.levels) - 1
        for k in [top] * (1 + most // (self.width << top)) + list(range(top - 1, -1, -1)):
            same = self.levels[k][a + n] == self.levels[k][b + n]
            n += np.where(same, np.minimum(self.width << k, self.left[a + n]), 0)
        for _ in range(1, self.width):
            n += (self.symbols[a + n] == self.symbols[b + n]) & (self.left[a + n] > 0)
        return n


def _phrases(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of the phrases of texts that lie one behind another; ends: where each text ends."""
    h = np.zeros(max(0, len(data) - WINDOW + 1), np.uint64)
    for k in range(WINDOW):
        h |= data[k : len(h) + k].astype(np.uint64) << np.uint64(8 * k)
    trigger = np.flatnonzero(mix(h) % np.uint64(EVERY) == 0)
    text = np.searchsorted(ends, trigger, "right")
    begins = np.concatenate([[0], ends[:-1]])
    trigger = trigger[(trigger + WINDOW <= ends[text]) & (trigger > begins[text])]
    first = np.sort(np.concatenate([begins, trigger]))
    end = np.concatenate([first[1:], ends[-1:]])
    return first, np.where(np.isin(end, ends), end, end + WINDOW)


def repeated_starts(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its starts begin a string that another start of the batch begins too.

    Pieces have at least ``length`` bytes; strings that overlap a piece's end aren't looked at.
    Equal pieces have equal parses, so one of them is sorted for all; all their starts are repeated.
    """
    copies = Counter(contents)
    if len(copies) < len(contents):
        flags = dict(zip(copies, repeated_starts(list(copies), length), strict=True))
        return [flags[c] | (copies[c] > 1) for c in contents]
    whole = b"".join(contents)
    data = np.frombuffer(whole, np.uint8)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    ends = np.cumsum(sizes)
    first, stop = _phrases(data, ends)

    # dictionary: distinct phrases in order, each closed by 0
    occurring = [whole[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
    dictionary = sorted(set(occurring))
    rank_of = {p: k for k, p in enumerate(dictionary)}
    widths = np.fromiter(map(len, dictionary), np.int64, len(dictionary)) + 1
    opens = np.concatenate([[0], np.cumsum(widths)[:-1]])
    symbols = np.frombuffer(b"\0".join(dictionary) + b"\0", np.uint8).astype(np.int16) + 1
    symbols[opens + widths - 1] = 0
    left = np.repeat(opens + widths - 1, widths) - np.arange(len(symbols))
    words = _Suffixes(symbols, left, length, 7)

    # parse: ranks from 1, each text closed by 0; ``at`` is a phrase's first byte, at the close the text's end
    rank = np.fromiter((rank_of[p] for p in occurring), np.int64, len(occurring))
    owner = np.searchsorted(ends, first, "right")
    place = np.arange(len(first)) + owner
    parse = np.zeros(len(first) + len(ends), np.int64)
    parse[place] = rank + 1
    at = np.zeros(len(parse), np.int64)
    at[place] = first
    closes = np.flatnonzero(parse == 0)
    at[closes] = ends
    to_close = closes[np.searchsorted(closes, np.arange(len(parse)))] - np.arange(len(parse))
    sentences = _Suffixes(parse, to_close, length)

    # every start, by what is left of its phrase and then by the parse behind
    starts = np.concatenate([np.arange(e - n, e - length + 1) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
    phrase = np.searchsorted(first, starts, "right") - 1
    inside, behind = opens[rank[phrase]] + starts - first[phrase], place[phrase] + 1
    order = np.argsort(words.rank[inside] * (int(sentences.rank.max()) + np.int64(1)) + sentences.rank[behind])
    a, b = order[:-1], order[1:]
    same = words.rank[inside[a]] == words.rank[inside[b]]
    # what differs within two phrases shorter than a string, or is equal in longer ones, needs no count
    rest = np.minimum(left[inside[a]], left[inside[b]])
    common = np.where(same, rest, 0)
    on = np.flatnonzero(~same & (rest >= length))
    common[on] = words.shared(inside[a[on]], inside[b[on]], length)
    on = np.flatnonzero(same & (rest < length))
    p, q = behind[a[on]], behind[b[on]]
    m = sentences.shared(p, q, length)
    further = at[p + m] - at[p]
    open_ = np.flatnonzero((parse[p + m] > 0) & (parse[q + m] > 0))
    further[open_] += words.shared(opens[parse[(p + m)[open_]] - 1], opens[parse[(q + m)[open_]] - 1], length)
    common[on] = rest[on] - WINDOW + further
    meet = common >= length
    flag = np.zeros(len(starts), bool)
    flag[a[meet]] = flag[b[meet]] = True
    return np.split(flag, np.cumsum(sizes - length + 1)[:-1])


def _runs(flags: np.ndarray) -> list[int]:
    """Flat [first, last, ...] of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    edges[1::2] -= 1
    return edges.tolist()


def _solved(contents: DataFrame, length: int) -> DataFrame:
    """(key, entry, runs): the repeated starts of each entry; all rows of a key are sorted together."""

    def flush(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        found = repeated_starts([r["content"] for r in rows], length)
        firsts = [k == 0 or r["entry"] != rows[k - 1]["entry"] or r["key"] != rows[k - 1]["key"] for k, r in enumerate(rows)]
        out = [{"key": r["key"], "entry": r["entry"], "runs": _runs(f)} for r, f, is_first in zip(rows, found, firsts, strict=True) if is_first and f.any()]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.int64()), ("entry", pa.int64()), ("runs", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        begun = 0  # where the last key begins
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["key"] != rows[-1]["key"]:
                    if len(rows) >= BATCH:
                        yield from flush(rows)
                        rows = []
                    begun = len(rows)
                elif len(rows) - begun > 1 and r["entry"] == rows[-2]["entry"]:  # two places of an entry are enough
                    continue
                rows.append(r)
                if len(rows) > BATCH and begun:
                    yield from flush(rows[:begun])
                    rows, begun = rows[begun:], 0
        if rows:
            yield from flush(rows)

    return map_arrow(contents.repartition("key").sortWithinPartitions("key", "entry"), run, "key long, entry long, runs array<int>")


def _split(contents: DataFrame, length: int, width: int) -> DataFrame:
    """(key, entry, at, sub, part, left, content): pieces cut into up to ``width`` neighbouring starts, ``at`` being the first.

    ``sub`` hashes the bytes that any string with a start in the same place before an anchor
    has if it is equal to one of the cut, so equal strings share it; ``part`` hashes all bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling.get()
        schema = pa.schema([(c, pa.int64()) for c in ("key", "entry")] + [("at", pa.int32()), ("sub", pa.int64()), ("part", pa.int64()), ("left", pa.int32()), ("content", pa.binary())])
        for batch in sliced(batches, "content", 1 << 18):
            out = []
            for r in batch.to_pylist():
                data, anchor = r["content"], r["left"]
                sums = roll.prefix(roll.table[np.frombuffer(data, np.uint8)])
                block = (anchor - np.arange(len(data) - length + 1)) // width
                first = np.flatnonzero(np.diff(block, prepend=-1))
                last = np.append(first[1:], len(block)) - 1
                latest = anchor - block[first] * width
                key = np.array([r["key"]]).view(np.uint64)
                sub = mix(roll.of(sums, latest, latest - width + 1 + length) ^ key ^ (block[first].astype(np.uint64) * _SALT))
                part = mix(roll.of(sums, first, last + length) ^ ((last - first).astype(np.uint64) * _SALT + (anchor - first).astype(np.uint64) * _SALT2))
                for a, b, s, p in zip(first.tolist(), last.tolist(), sub.view(np.int64).tolist(), part.view(np.int64).tolist(), strict=True):
                    out.append({"key": r["key"], "entry": r["entry"], "at": a, "sub": s, "part": p, "left": anchor - a, "content": data[a : b + length]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return map_arrow(contents, run, "key long, entry long, at int, sub long, part long, left int, content binary")


def _found(contents: DataFrame, length: int, group: int, scratch: Scratch, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(key, entry, runs): the repeated starts of ``contents`` (key, entry, m, left, content), whatever the size of a group."""
    if not widths:
        return _solved(contents, length)
    light, heavy = _solved(contents.where(F.col("m") <= group), length), contents.where(F.col("m") > group)
    if heavy.isEmpty():
        return light
    cuts = scratch.keep(_split(heavy, length, widths[0]), "cuts")
    # Of cuts that look equal the least and the greatest by their bytes go on, so all are equal if these are.
    parts = scratch.keep(cuts.groupBy("sub", "part").agg(F.count("*").alias("n"), F.first("left").alias("left"), F.min("content").alias("least"), F.max("content").alias("greatest")), "parts")
    groups = parts.groupBy("sub").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("total > 1").select("sub", "m")
    places = F.when(F.col("n") > 1, F.array("least", "greatest")).otherwise(F.array("least"))
    inner = scratch.keep(parts.join(groups, "sub").select(F.col("sub").alias("key"), F.col("part").alias("entry"), "m", "left", F.explode(places).alias("content")), "inner")
    found = _found(inner, length, group, scratch, widths[1:]).select(F.col("key").alias("sub"), F.col("entry").alias("part"), "runs")
    back = cuts.select("key", "entry", "at", "sub", "part").distinct().join(found, ["sub", "part"])
    shifted = back.select("key", "entry", F.transform("runs", lambda x: x + F.col("at")).alias("runs"))
    return light.unionByName(shifted.groupBy("key", "entry").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP, words: int = WORDS) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<start, end>>, kept binary, shared boolean), one row per input row; byte offsets."""
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = with_row_key(docs, id_col, text_col)
    parsed = scratch.keep(parse(rows, length), "parsed")
    twice = parsed.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key")
    # A new name for the key keeps what follows from relying on the join's partitioning, so the join may split hot keys.
    live = scratch.keep(parsed.join(twice, "key", "left_semi").withColumn("key", F.col("key").bitwiseXOR(F.lit(1))), "live")

    owner = F.struct("_d", "_h")
    entries = scratch.keep(live.groupBy("key", "entry").agg(F.sum("n").alias("n"), F.min(owner).alias("owner"), F.max(owner).alias("other")), "entries")
    sizes = entries.groupBy("key").agg(F.count("*").alias("m"))
    wanted = F.struct("key", "entry", "m", "twice")
    asked = entries.join(sizes, "key").withColumn("twice", (F.col("n") > 1) & (F.col("owner") == F.col("other"))).select(F.explode(F.array_distinct(F.array("owner", "other"))).alias("o"), wanted.alias("wanted"))
    asked = asked.groupBy("o._d", "o._h").agg(F.collect_list("wanted").alias("entries"))
    settled, runs = _settled(rows, words, scratch)
    asked = asked.join(runs, ["_d", "_h"], "full_outer")
    fetched = scratch.keep(_contents(rows.join(asked, ["_d", "_h"]).select("_id", "_text", "_d", "_h", "entries", "runs"), length, words), "contents")

    contents = fetched.where("content is not null").select("key", "entry", "m", "left", "content")
    found = _found(contents, length, group, scratch)
    marks = live.select("key", "entry", "_d", "_h").join(found, ["key", "entry"]).groupBy("_d", "_h").agg(F.collect_list(F.struct("entry", "runs")).alias("marks"))
    single = fetched.where("content is null").select("key", "many", "_d", "_h")
    several = single.groupBy("key").agg(F.min(owner).alias("least"), F.max(owner).alias("greatest"), F.max("many").alias("many")).where("least < greatest or many").select("key")
    shared = settled.unionByName(single.where("not many").join(several, "key", "left_semi").select("_d", "_h")).distinct().withColumn("shared", F.lit(True))
    marks = scratch.keep(marks.join(shared, ["_d", "_h"], "full_outer"), "marks")
    scratch.drop_others(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in sliced(batches, "_text"):
            sizes, spans, kept = [], [], []
            for text, marked in zip(batch.column("_text"), batch.column("marks"), strict=True):
                data, marked = _bytes_of(text), marked.as_py() or []
                cuts = _cuts(data, {x["entry"]: x["runs"] for x in marked}, length) if marked else []
                at, left = 0, []
                for a, b in cuts:
                    left.append(data[at:a])
                    at = b
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in cuts])
                kept.append(b"".join([*left, data[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), batch.column("shared")], ["doc_id", "n_bytes", "removed", "kept", "shared"])

    met = rows.join(marks, ["_d", "_h"], "left").select("_id", "_text", "_d", "_h", "marks", F.coalesce("shared", F.lit(False)).alias("shared"))
    return map_arrow(met, run, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary, shared boolean")


def _cuts(data: bytes, marks: dict[int, list[int]], length: int) -> list[tuple[int, int]]:
    first, last, _, _, entry = pieces(data, length)
    step = np.zeros(len(data) + 1, np.int32)
    for i in np.flatnonzero(np.isin(entry, np.fromiter(marks, np.int64, len(marks)))):
        runs = marks[int(entry[i])]
        for a, b in zip(runs[::2], runs[1::2], strict=True):
            step[first[i] + a] += 1
            step[first[i] + b + length] -= 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(step) > 0).astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def digest(docs: DataFrame, **options) -> DataFrame:
    """Per row: bytes, removed bytes, removed runs, the SHA-256 of what is left, whether anything was removed, what is left as text, and whether a passage stands in another row too.

    A character that a cut went through shows as U+FFFD in the text; the digest is of the bytes.
    """
    found = remove_repeats(docs, **options)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    kept = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("removed") > 0).alias("repeats"), kept, F.col("shared").alias("shares_passage"))
