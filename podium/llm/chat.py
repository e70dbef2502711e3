"""Chat formatting with DataFrame expressions only.

Rows (conversation, turn, role, text) become one row per conversation.  The turn
structs of a conversation are collected and sorted; array functions then merge
adjacent turns of one role into blocks (``merged``), and a block has one header and
each turn's text with an end mark:

    ### user: text</turn>
    ### assistant: text</turn>text</turn>

Control strings inside texts and roles are escaped reversibly (``escape``), so
``parse`` gives back every turn.  ``loss_spans`` are the code points of the
escaped assistant texts, marks excluded.  Every array is gone through once or cut
into runs, so a conversation of very many turns takes no square of their number;
like any row, it has to fit into one task.

Turns sort by number (null first), then role, then text; repeated rows are turns
of their own.  Null roles and texts count as empty.  A null conversation id is a
conversation like others; ids may be of any type.  Very long texts are kept whole.
An empty table gives no conversations.  Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, END, BLOCK_END = "### ", ": ", "</turn>", "\n"
#: What is replaced inside texts, in this order; undone in reverse.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (": ", "\\c"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(turns: Column) -> Column:
    """array<struct<role, texts>>: adjacent turns of one role as one block; turns: a column of sorted structs (turn, role, text)."""
    role = lambda i: F.get(turns, i)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    block = lambda s, end: F.struct(role(s).alias("role"), F.transform(F.slice(turns, s + 1, end - s), lambda t: t["text"]).alias("texts"))
    return _let(starts, lambda at: F.transform(at, lambda s, k: block(s, F.coalesce(F.get(at, k + 1), F.size(turns)))))


def sums_before(lengths: Column) -> Column:
    """For each number of an array that isn't empty the sum of those before it, over runs of about the root of its size."""
    zero = F.array(F.lit(0).cast("long"))
    scan = lambda xs: F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    width = lambda xs: F.ceil(F.sqrt(F.size(xs))).cast("int")
    runs = lambda xs: F.transform(F.sequence(F.lit(0), F.size(xs) - 1, width(xs)), lambda s: scan(F.slice(xs, s + 1, width(xs))))
    shifted = lambda v: F.flatten(F.transform(v["runs"], lambda r, k: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda x: x + F.get(v["bases"], k))))
    with_bases = lambda r: F.struct(r.alias("runs"), scan(F.transform(r, lambda x: F.element_at(x, -1))).alias("bases"))
    return _let(lengths, lambda xs: _let(runs(xs), lambda r: _let(with_bases(r), shifted)))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted string, loss_spans array<struct<start, n_chars>>)."""
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in (text_col, role_col))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    collected = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = collected.select("conv_id", merged(F.col("turns")).alias("blocks"))

    header = lambda b: F.concat(F.lit(HEAD), escape(b["role"], ROLE_ESCAPES), F.lit(AFTER_ROLE))
    written = lambda b: F.struct(header(b).alias("head"), (b["role"] == learn_role).alias("learn"), F.transform(b["texts"], lambda t: escape(t)).alias("bodies"))
    escaped = blocks.select("conv_id", F.transform("blocks", written).alias("blocks"))

    whole = lambda b: F.concat(b["head"], F.array_join(F.transform(b["bodies"], lambda t: F.concat(t, F.lit(END))), ""), F.lit(BLOCK_END))
    piece = lambda size, n, learn: F.struct(size.cast("long").alias("size"), n.cast("long").alias("n_chars"), learn.alias("learn"))
    before = lambda b, k: piece(F.length(b["head"]) + F.when(k > 0, len(BLOCK_END)).otherwise(0), F.lit(0), F.lit(False))
    inside = lambda b, k: F.concat(F.array(before(b, k)), F.transform(b["bodies"], lambda t: piece(F.length(t) + len(END), F.length(t), b["learn"])))
    pieces = escaped.select("conv_id", F.array_join(F.transform("blocks", whole), "").alias("formatted"), F.flatten(F.transform("blocks", inside)).alias("pieces"))
    placed = F.arrays_zip(F.col("pieces").alias("piece"), sums_before(F.transform("pieces", lambda x: x["size"])).alias("start"))
    spans = F.transform(F.filter(placed, lambda x: x["piece"]["learn"]), lambda x: F.struct(x["start"].alias("start"), x["piece"]["n_chars"].alias("n_chars")))
    return pieces.select("conv_id", "formatted", spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    blocks = F.slice(F.split(formatted, HEAD), 2, 1 << 30)

    def turns(block: Column) -> Column:
        role = F.substring_index(block, AFTER_ROLE, 1)
        texts = F.split(F.substr(block, F.length(role) + 1 + len(AFTER_ROLE)), END)
        return F.transform(F.slice(texts, F.lit(1), F.size(texts) - 1), lambda t: F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["n_chars"].cast("int")))), "")


def digest(rows: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted string: counts and digests."""
    made = format_chats(rows)
    read = made.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) IS DISTINCT FROM role AS starts,
    replace(replace(replace(t, '\', '\s'), '###', '\h'), '</turn>', '\t') AS body,
    replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), ': ', '\c') AS shown
  FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  coalesce(CAST(sum(length(t)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + 7 + CASE WHEN starts THEN 7 + length(shown) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
