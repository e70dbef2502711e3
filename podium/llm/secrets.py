"""Secret scan: fixed patterns, and novelty by dictionary-primed zstandard.

The patterns find assignments, access keys and hex strings.  The method adds
strings that stand in a sensitive context (soon after a word such as
``authorization``) and that compression can't shorten: a candidate's marginal
bytes are the compressed size of its surroundings with it less that without it,
under a dictionary.  The dictionary is code that many repositories share and the
identifiers that most documents of the table at hand hold (``vocabulary``).  Words,
paths and names that the surroundings or the dictionary hold cost little; keys cost
about their length.  Copies of the candidate itself aren't counted among its
surroundings, and a value found so is reported wherever it stands in the text.

A value of more than LONG characters is measured in pieces, each against the characters
before it, and a run's pieces are measured once for all places where its value may
begin; so the work is in proportion to the text, whatever it holds.

Spans are code points, end exclusive, in order of start, then of kind; of spans of
one start and kind there is one.  A null or empty text has no spans.  Whole texts are
searched, however long; rows that repeat are searched each, and ids may be of any
type.  An empty table gives no rows.  A column that bears the name of the result
(``secrets``) is replaced by ``scan``; others are carried along.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import map_arrow, sliced

# The patterns and lengths asked for.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 8, 16
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")

#: Words, lower case, after which a string is a candidate.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "authorization", "bearer", "credential", "private key", "private_key", "access key", "access_key", "client_id", "session_id", "signature", "connectionstring", "connection_string")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
CANDIDATE_LENGTH = 16
#: What parts a name from its value within a run of a candidate's characters.
_SIGN = re.compile(r"=+(?=[A-Za-z0-9+/_.~-])")
#: How far after a sensitive word candidates begin, and how much text around one primes the measure.
REACH, AROUND = 48, 160
#: Marginal bytes per character from which a candidate is reported.
NOVELTY = 0.7

#: Characters from which a value is measured in pieces, and those of a piece.
LONG, PIECE = 512, 256

#: Identifiers taken from a table for the dictionary, at most, and the characters of one: fewer than a
#: candidate's and no digits, so no key gets in.  The dictionary has some 32 kB.
VOCABULARY = 2_000
#: A name stands in one of so many documents at least: so the names that are ranked are few, however large the table.
ONE_IN = 2_000
NAME = r"(?<![A-Za-z0-9_+/=.~-])[A-Za-z_]{4,15}(?![A-Za-z0-9_+/=~-])"

#: Code that the compressor knows beforehand.
IDENTIFIERS = """
import export from class def function return const static public private protected void string String int long
boolean true false null None self this new throw raise try catch except finally while for if else elif switch case
password passwd username user_name user_id client_id client_secret access_token refresh_token api_key apikey
authorization Authorization: Bearer Basic Content-Type application/json charset=utf-8 https://www.example.com/ http://
localhost:8080 127.0.0.1 connection_string database host port timeout config settings environment production staging
development debug release version request response session cookie header payload signature certificate public_key
private_key BEGIN RSA PRIVATE KEY END CERTIFICATE getElementById addEventListener querySelector console.log
System.out.println logger.info logging.getLogger os.environ.get process.env REDIS_URL DATABASE_URL postgres mysql
mongodb aws_access_key_id aws_secret_access_key region us-east-1 eu-west-1 bucket object storage container cluster
documentation example placeholder changeme your-token-here insert_your_key_here xxxxxxxxxxxxxxxx 0123456789 abcdef
the and of to in is that for with as on by this from are be was it not have which or an at internationalization
"""
_CODECS: dict[str, zstandard.ZstdCompressor] = {}
#: Measures of late by dictionary, surroundings and value: repetitive texts ask for the same ones again.
_LATE: dict[tuple[str, str, str], int] = {}


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = VOCABULARY) -> str:
    """The dictionary for a table: IDENTIFIERS and the ``size`` names that most documents hold, the commonest last.

    Names that fewer than two documents, or one in ONE_IN of them, hold are left out.
    """
    names = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(NAME), F.lit(0)))
    least = max(2, docs.count() // ONE_IN)
    top = docs.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "name").limit(size)
    return " ".join([IDENTIFIERS, *(r["name"] for r in reversed(top.collect()))])


def _codec(dictionary: str) -> zstandard.ZstdCompressor:
    if dictionary not in _CODECS:
        primed = zstandard.ZstdCompressionDict(dictionary.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=6)
        _CODECS.clear()
        _CODECS[dictionary] = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return _CODECS[dictionary]


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """AROUND characters before and after text[start:end] that aren't in a copy of it."""
    value, before, after, at = text[start:end], "", "", start
    while at and len(before) < AROUND:
        need = AROUND - len(before)
        copy = text.rfind(value, max(0, at - need - len(value)), at)
        before = text[max(0, at - need, copy + len(value) if copy >= 0 else 0) : at] + before
        at = max(0, copy)
        if copy < 0:
            break
    at = end
    while at < len(text) and len(after) < AROUND:
        need = AROUND - len(after)
        copy = text.find(value, at, at + need + len(value))
        after += text[at : min(at + need, copy if copy >= 0 else at + need)]
        at = copy + len(value)
        if copy < 0:
            break
    return before, after


def marginal_bytes(text: str, start: int, end: int, dictionary: str = IDENTIFIERS) -> int:
    """Compressed bytes that text[start:end] adds to what surrounds it, other copies of it left out."""
    before, after = _around(text, start, end)
    asked = dictionary, after + before, text[start:end]
    if asked not in _LATE:
        codec, around = _codec(dictionary), asked[1].encode("utf-8", "replace")
        if len(_LATE) >= 4096:
            _LATE.clear()
        _LATE[asked] = len(codec.compress(around + asked[2].encode("utf-8", "replace"))) - len(codec.compress(around))
    return _LATE[asked]


def _starts(text: str, lower: str, start: int, end: int) -> list[int]:
    """Where values may begin in a run of a candidate's characters from ``start`` on, before ``end``.

    Behind each sign in the run; and at the run's own start, unless it goes on from a name on its
    left.  If the run itself holds ``name=value`` with a sensitive name, the value comes first.
    """
    signs = [x.end() for x in _SIGN.finditer(text, start, min(len(text), end + 1)) if x.end() <= end]
    if start > 0 and CANDIDATE.fullmatch(text[start - 1] * 16):
        return signs
    whole = [] if signs and text[start] == "=" else [start]
    named = signs and any(x.end() > start for x in _SENSITIVE.finditer(lower, max(0, start - max(map(len, SENSITIVE))), signs[-1]))
    return [*signs, *whole] if named else [*whole, *signs]


def _joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


_RUN = re.compile(r"[A-Za-z0-9+/_=.~-]+")


class _Run:
    """A longest stretch of a candidate's characters: what its suffixes hold and cost."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        run = text[start:end]
        self.digit = start + max(map(run.rfind, "0123456789"))
        self.letter = start + max(map(run.rfind, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        self.sums: list[int] | None = None

    def mixed(self, start: int) -> bool:
        """Whether a digit and a letter stand from ``start`` on."""
        return min(self.digit, self.letter) >= start

    def cost(self, start: int, dictionary: str) -> float:
        """Marginal bytes per character of the run from ``start`` on."""
        size = self.end - start
        if size <= LONG:
            return marginal_bytes(self.text, start, self.end, dictionary) / size
        if self.sums is None:
            self.sums = [0]
            for at in range(self.end - PIECE, self.start - 1, -PIECE):
                self.sums.append(self.sums[-1] + _piece_bytes(self.text, at, at + PIECE, dictionary))
        pieces, front = divmod(size, PIECE)
        if self.sums[pieces] + front + 16 < NOVELTY * size:  # whatever the front costs
            return self.sums[pieces] / size
        return (self.sums[pieces] + (_piece_bytes(self.text, start, start + front, dictionary) if front else 0)) / size


def _piece_bytes(text: str, start: int, end: int, dictionary: str) -> int:
    codec = _codec(dictionary)
    before = text[max(0, start - AROUND) : start].encode("utf-8", "replace")
    return len(codec.compress(before + text[start:end].encode("utf-8", "replace"))) - len(codec.compress(before))


def _novel(text: str, lower: str, base: list[tuple[int, int]], dictionary: str) -> Iterator[tuple[int, int, float]]:
    seen = -1
    taken, until = _joined(base)
    spans = [m.span() for m in _RUN.finditer(text) if m.end() - m.start() >= CANDIDATE_LENGTH]
    ends = [end for _, end in spans]
    runs: dict[int, _Run] = {}
    for word in _SENSITIVE.finditer(lower):
        for i in range(bisect_right(ends, word.end()), len(spans)):
            first, end = max(spans[i][0], word.end()), ends[i]
            if first > word.end() + REACH:
                break
            starts = [x for x in _starts(text, lower, first, min(end, word.end() + REACH + 1)) if x > seen] if end - first >= CANDIDATE_LENGTH else []
            if starts and i not in runs:
                runs = {i: _Run(text, *spans[i])}
            for start in starts:
                seen = max(seen, start)
                k = bisect_left(taken, end) - 1  # the last stretch that begins before the end
                if end - start < CANDIDATE_LENGTH or k >= 0 and until[k] > start or not runs[i].mixed(start):
                    continue
                cost = runs[i].cost(start, dictionary)
                if cost >= NOVELTY:
                    seen = end
                    yield start, end, cost
                    break


def _places(text: str, values: list[str]) -> Iterator[tuple[str, list[int]]]:
    """Each value, the longest first, with the places where it begins."""
    if len(values) < 8:
        for value in values:
            found, at = [], text.find(value)
            while at >= 0:
                found.append(at)
                at = text.find(value, at + len(value))
            yield value, found
        return
    automaton = ahocorasick.Automaton()
    for value in values:
        automaton.add_word(value, value)
    automaton.make_automaton()
    places: dict[str, list[int]] = {}
    for last, value in automaton.iter(text):
        at, found = last + 1 - len(value), places.setdefault(value, [])
        if not found or at >= found[-1] + len(value):
            found.append(at)
    for value in values:
        yield value, places.get(value, [])


def _everywhere(text: str, novel: list[tuple[int, int, float]], base: list[tuple[int, int]]) -> Iterator[tuple[int, int, float]]:
    """``novel`` and the other places of its values that no span holds yet."""
    yield from novel
    held = bytearray(len(text) if novel else 0)
    for start, end in (*base, *(x[:2] for x in novel)):
        held[start:end] = b"\1" * (end - start)
    costs = {text[start:end]: cost for start, end, cost in reversed(novel)}
    for value, places in _places(text, sorted(costs, key=len, reverse=True)):
        for at in places:
            end = at + len(value)
            if held.find(0, at, end) >= 0:
                held[at:end] = b"\1" * len(value)
                yield at, end, costs[value]


def find(text: str | None, dictionary: str = IDENTIFIERS) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, marginal bytes per character or 0) in order."""
    if not text:
        return []
    lower = text.lower()
    out: list[tuple[str, int, int, float]] = []
    sensitive = _SENSITIVE.search(lower) if any(w in lower for w in SENSITIVE) else None
    if any(w in lower for w in ("passw", "secret", "token", "apikey", "api_key")):
        out += (("assign", *m.span(), 0.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH)
    if "AKIA" in text:
        out += (("access", *m.span(), 0.0) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH)
    out += (("hex", *m.span(), 0.0) for m in HEX.finditer(text))
    if sensitive:
        # offsets in the lower-cased text serve only where lower-casing keeps lengths
        same = lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        base = [x[1:3] for x in out]
        out += (("novel", *x) for x in _everywhere(text, list(_novel(text, same, base, dictionary)), base))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:long,end:long,novelty:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "secrets", dictionary: str | None = None) -> DataFrame:
    """Adds ``out_col``: the spans of each whole text (an empty array if none), by the table's own dictionary if none is given."""
    kept = docs.drop(out_col)
    primed = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, text_col) if dictionary is None else dictionary)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"`{out_col}` {SPANS}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            found = [[dict(zip(("kind", "start", "end", "novelty"), x, strict=True)) for x in find(t.as_py(), primed.value)] for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], [*batch.schema.names, out_col])

    return map_arrow(kept, run, schema)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", dictionary: str | None = None) -> DataFrame:
    """Replaces every span by ``mark``, overlapping spans by one; null texts stay null, all columns and rows stay."""
    schema = docs.schema
    primed = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, text_col) if dictionary is None else dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            texts = []
            for t in batch.column(text_col):
                text = t.as_py()
                parts, at = [], 0
                for _, start, end, _ in find(text, primed.value):
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                texts.append("".join([*parts, text[at:]]) if parts else text)
            new = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([new if n == text_col else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return map_arrow(docs, run, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, digest of the base spans, all spans."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "secrets").drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), F.size("secrets").cast("long").alias("n_spans"))
