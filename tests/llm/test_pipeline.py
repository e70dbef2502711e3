"""The pipeline against its stages written in plain Python."""

import hashlib

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline
from podium.llm import decontam, langid, secrets
from podium.llm.queries import tokenizer_path

from .conftest import SF, ordered
from .test_dedup import groups


def test_as_brute_force(spark):
    con = duckdb.connect()
    rows = con.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()
    rows = [r for r in rows if r[1] and langid.has_letter(r[1])]
    kept = {i for i, _, _, k in groups([r[:2] for r in rows], 5) if k}
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    bad = {r[0] for r in con.sql(f"SELECT doc_id FROM ({decontam.SQL})").fetchall()}
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    want = []
    left = [(i, text) for i, text, *_ in rows if i in kept and i not in bad]
    dictionary = secrets.vocabulary(spark.createDataFrame(left, "doc_id long, text string"))
    for i, text, lang, source in rows:
        if i in kept and i not in bad:
            at = len(text)
            spans = secrets.find(text, dictionary)
            for a, b in reversed(_merged(spans)):
                text = text[:a] + "[REDACTED]" + text[b:]
            ids = t.encode(text, add_special_tokens=False).ids
            want.append((i, lang, source, len(ids), ids, hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
            assert len(text) <= at + 10 * len(spans)
    assert ordered(corpus_pipeline.run(spark, SF).collect()) == ordered(want)


def _merged(spans):
    out = []
    for _, a, b, _ in spans:
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(docs.columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect() == []
