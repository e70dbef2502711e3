"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 letters in Spark tasks and sums them by
(bucket, language); what reaches the driver is that table, whose size is bounded
by ``buckets`` times the number of languages, whatever the corpus.  The matrix of
log probabilities is broadcast, and a batch of texts is scored at once in numpy: the
batch's sparse matrix of n-gram counts, texts by buckets, times that matrix.

Null texts and texts without a letter get ``und`` and score 0; so does every text
if nothing could be learned.  Ties go to the language that sorts first.  Very long
texts are counted whole, a piece at a time.  Repeated rows are learned from and
predicted each; ids may be of any type.  An empty table teaches nothing and gets no
predictions.  Columns that bear the names of the results are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import map_arrow, sliced

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Characters handled at a time; bounds a worker's memory.
STEP = 1 << 19
_ALPHA: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # buckets x languages
    prior: np.ndarray
    buckets: int


def features(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a text, a piece of the text at a time."""
    alpha, shift = _alpha(), np.uint32(32 - (buckets.bit_length() - 1))
    for at in range(0, len(text), STEP):
        piece = text[max(0, at - max(ORDERS) + 1) : at + STEP].lower()
        cp = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.where(alpha[cp], cp, np.uint32(32))
        cp = cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])] if len(cp) else cp
        code = np.zeros(len(cp), np.uint32)
        for n in ORDERS:
            code = code[: len(cp) - n + 1] * np.uint32(0x01000193) + (cp[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            if len(code):
                h = code ^ (code >> np.uint32(15))
                yield (h * np.uint32(0x85EBCA6B)) >> shift


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


#: Bytes of a model at most: it is gathered by the driver and sent to every task.  512 languages at the usual buckets.
MODEL_BYTES = 64 << 20


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5) -> Model:
    """Learns from all rows whose text and language are not null.

    ValueError, before anything is counted, if they name more languages than a model of MODEL_BYTES
    holds: such a column isn't one of languages, or needs fewer buckets.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    most = MODEL_BYTES // (4 * buckets)
    if docs.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(most + 1).count() > most:
        raise ValueError(f"column {lang_col} names more than {most} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                text, lang = text.as_py(), lang.as_py()
                if lang not in sums:
                    sums[lang] = np.zeros(buckets, np.int64)
                seen[lang] = seen.get(lang, 0) + 1
                for found in features(text, buckets):
                    np.add.at(sums[lang], found, 1) if len(found) < buckets // 8 else np.add(sums[lang], np.bincount(found, minlength=buckets), out=sums[lang])
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.concatenate([[-1], at]).astype(np.int32)), pa.array(np.concatenate([[seen[lang]], got[at]]))], ["lang", "bucket", "n"])

    table = map_arrow(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    counts, prior = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        gram = own["bucket"].to_numpy() >= 0
        counts[own["bucket"].to_numpy()[gram], k] = own["n"].to_numpy()[gram]
        prior[k] = own["n"].to_numpy()[~gram].sum()
    smooth = counts + smoothing
    return Model(langs, np.log(smooth / smooth.sum(0, keepdims=True)).astype(np.float32), np.log(prior / max(prior.sum(), 1)), buckets)


#: Counts of a sparse matrix that are multiplied at a time.
CELLS = 1 << 20


def score_batch(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """(language, posterior probability) of each text."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    rows: list[int] = []
    columns: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    cells = 0

    def flush() -> None:
        if not rows:
            return
        starts = np.concatenate([[0], np.cumsum([len(c) for c in columns])[:-1]])
        product = np.concatenate(counts)[:, None] * model.log_prob[np.concatenate(columns)]
        total = np.add.reduceat(product, starts, axis=0) + model.prior
        best = total.argmax(1)
        sure = 1 / np.exp(total - total[np.arange(len(rows)), best][:, None]).sum(1)
        for i, k, p in zip(rows, best.tolist(), sure.tolist(), strict=True):
            out[i] = model.langs[k], p
        rows.clear(), columns.clear(), counts.clear()

    for i, text in enumerate(texts):
        if not text or not model.langs or not has_letter(text):
            continue
        found = np.zeros(model.buckets)
        for part in features(text, model.buckets):
            found += np.bincount(part, minlength=model.buckets)
        at = np.flatnonzero(found)
        rows.append(i)
        columns.append(at)
        counts.append(found[at])
        cells += len(at)
        if cells > CELLS:
            flush()
            cells = 0
    flush()
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """Adds the predicted language and its posterior probability to each row.

    Columns of these names are replaced.  Only ``text_col`` is looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(pred_col, score_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"`{pred_col}` string", f"`{score_col}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            found = score_batch(batch.column(text_col).to_pylist(), sent.value)
            columns = [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, pred_col, score_col])

    return map_arrow(kept, run, schema)


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether a row's id falls in a fold, by the CRC-32 of the id as text; a null id falls in none."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))
