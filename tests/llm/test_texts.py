import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from podium.llm import decontam, fingerprint, langid, queries, secrets, token_rollup
from podium.llm.common import Scratch

from .conftest import SF, ordered

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_base_spans(docs, texts):
    want = []
    for i, text in texts:
        spans = base_spans(text or "")
        count = [sum(x[0] == k for x in spans) for k in ("assign", "access", "hex")]
        want.append((i, *count, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    got = secrets.digest(docs)
    assert ordered(got.drop("spans", "n_spans").collect()) == ordered(want)
    assert secrets.digest(docs.limit(0)).collect() == []
    novel = {r["doc_id"]: r["spans"] for r in got.where("spans LIKE '%novel%'").collect()}
    assert 900018 in novel


def test_novelty_tells_keys_from_names():
    key, name = "q9Zx7LmP2vRt8KwYb4NcJd6HsGfA3eUo", "getElementById1"
    text = f"authorization: {key} and authorization: {name}"
    assert [text[a:b] for k, a, b, _ in secrets.find(text) if k == "novel"] == [key]
    assert not [x for x in secrets.find(f"a plain sentence with {key} alone") if x[0] == "novel"]


@pytest.mark.parametrize("word", secrets.SENSITIVE)
def test_unspaced_values(word):
    key = "q9Zx7LmP2vRt8KwYb4NcJd6HsGfA3eUo"
    for before, after in (("", ""), ("MY_", "_VALUE"), ("https://host/path?a=1&x-", ""), ("authorization ", "")):
        for sign in ("=", ":", '="', '":"', "==", " =", "=/"):
            text = f"{before}{word.upper()}{after}{sign}{key} and on"
            got = [(k, text[a:b]) for k, a, b, _ in secrets.find(text)]
            assert any(v.endswith(key) for _, v in got), text
            assert all(v.lstrip("/") == key for k, v in got if k == "novel"), (text, got)


def test_whole_runs_stay_candidates():
    for value in ("q9Zx7LmP2vRt8Kw=Yb4NcJd6HsGfA3eUo", "q9Zx7LmP2vRt8KwYb4NcJd6HsGfA3eUo=="):
        text = f"authorization: {value} end"
        assert [text[a:b] for k, a, b, _ in secrets.find(text) if k == "novel"] == [value]


def test_repeated_values():
    key = "q9Zx7LmP2vRt8KwYb4NcJd6HsGfA3eUo"
    for text in (f"Authorization: Bearer {key}\n" * 2, f"Authorization: Bearer {key}\n" * 40, f"x {key}{key} " + "pad " * 200 + f"bearer {key} end, again {key}"):
        got = secrets.find(text)
        assert [a for _, a, _, _ in got] == [m.start() for m in re.finditer(key, text)]
        assert all(text[a:b] == key and cost >= secrets.NOVELTY for _, a, b, cost in got)
    assert not secrets.find("authorization: getElementById1\n" * 3)


def test_surroundings_leave_copies_out():
    value, plain = "v" * 20, "".join(chr(33 + i % 60) for i in range(900))
    for at in range(0, 400, 7):
        left, right = plain[:400], plain[400:800]
        text = left[:at] + value + left[at:] + value + right[:at] + value + right[at:]
        assert secrets._around(text, 420, 440) == (left[-secrets.AROUND :], right[: secrets.AROUND])


@pytest.mark.parametrize("unit", ["signature=", "session_id=a1", "token=", "token=a1 ", "secret a1=", "token"])
def test_long_texts_of_sensitive_words_take_linear_time(unit):
    """A megabyte of each; the time of a quadratic scan would be hours."""
    text = unit * (1_000_000 // len(unit))
    began = time.process_time()
    spans = secrets.find(text)
    assert time.process_time() - began < 10
    assert [x[:3] for x in spans if x[0] != "novel"] == base_spans(text)


def test_long_values_are_measured_in_pieces():
    rng = random.Random(4)
    drawn = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    for size in (511, 512, 513, 700, 5000, 100_000):
        text = f"authorization: {drawn(size)} and words"
        assert [x[:3] for x in secrets.find(text)] == [("novel", 15, 15 + size)]
        assert secrets.find(f"authorization: {'session_id=a1' * (size // 13)} and words") == []
    # a random value behind a long name in the same run
    kind, start, end, _ = secrets.find("secret x=" + drawn(600))[0]
    assert kind == "novel" and start <= 9 and end == 609


def test_many_values_are_found_again():
    rng = random.Random(6)
    keys = ["".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789", k=40)) for _ in range(20)]
    lines = "\n".join(f"authorization: {k} for number {i}" for i, k in enumerate(keys))
    text = lines + "\nno word near: " + " and ".join(keys) + " " + keys[0] + keys[0]
    found = {x[1:3] for x in secrets.find(text)}
    values = {text[a:b] for a, b in found}
    assert len(values & set(keys)) >= 10
    for value in values & set(keys):
        assert {m.start() for m in re.finditer(value, text)} <= {a for a, b in found} | {b for a, b in found if text[a:b] != value} | {a + 40 for a, _ in found}


def test_redaction(docs):
    row = secrets.redact(docs.where("doc_id = 900015")).first()
    assert row["text"] == "[REDACTED]\" [REDACTED] [REDACTED]"
    assert secrets.redact(docs.where("doc_id = 900002")).first()["text"] is None


def test_fingerprints_of_texts_and_edited_texts(docs, texts):
    rows = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        q, after = len(t) // 4, rows[(k + 1) % len(rows)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
    got = fingerprint.digest(docs).collect()
    assert ordered((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == ordered(want)
    by_id = {r["doc_id"]: r for r in got}
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert by_id[900002]["fingerprint"] == by_id[900003]["fingerprint"] == by_id[900004]["fingerprint"]
    assert by_id[900010]["fingerprint"] == by_id[900013]["fingerprint"] != by_id[900009]["fingerprint"]
    assert by_id[900009]["near_next"] > 0.6 and by_id[900016]["near_next"] < 0.4
    same = {}
    for (i, t), r in zip(rows, sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)), strict=True):
        assert r["doc_id"] == i and same.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert fingerprint.digest(docs.limit(0)).collect() == []


def test_fingerprints_are_sums(spark):
    df = spark.createDataFrame([(1, "a b c d e\nf g h"), (2, "f g h\na b c d e"), (3, "a b c d e"), (4, "f g h"), (5, "a b c d e\nf g h\nf g h")], "k int, text string")
    v = {r["k"]: r["lanes"] for r in fingerprint.fingerprints(df, ["k"]).collect()}
    assert v[1] == v[2] != v[5]
    pair = spark.createDataFrame([(v[3], v[4], v[5])], "a array<long>, b array<long>, c array<long>")
    row = pair.select(fingerprint.combine(F.col("a"), F.col("b")).alias("up"), fingerprint.combine(F.col("c"), F.col("b"), -1).alias("down")).first()
    assert row["up"] == row["down"] == v[1]


def test_likeness_stands_words_put_in_and_taken_out(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [words, ["new", *words], words[1:], words[:100] + ["new"] + words[100:], words[:50] + words[51:], [f"x{i}" for i in range(200)], ["a", "b"], ["a", "c"]]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "k int, text string")
    v = {r["k"]: r["lanes"] for r in fingerprint.fingerprints(df, ["k"]).collect()}
    pairs = spark.createDataFrame([(k, v[0], v[k]) for k in range(1, 6)] + [(7, v[6], v[7])], "k int, a array<long>, b array<long>")
    got = {r["k"]: r["l"] for r in pairs.select("k", fingerprint.likeness(F.col("a"), F.col("b")).alias("l")).collect()}
    assert all(got[k] > 0.9 for k in range(1, 5)) and got[5] < 0.4 and got[7] < 0.4


def test_variates_are_cauchy():
    """The formula against the tangent, on a grid that holds both ends."""
    for i in [*range(0, 1 << 20, 997), (1 << 20) - 1]:
        x = (2 * i + 1) / (1 << 20) - 1
        assert math.isclose(x * (fingerprint._A - fingerprint._B * x * x) / (1 - x * x), math.tan(math.pi * x / 2), rel_tol=0.01)


def shared(a, b):
    """Exact likeness: twice the runs of words that two texts share over the runs of both, each as often as it stands."""

    def runs(text):
        found = Counter()
        for line in text.split("\n"):
            w = line.split()
            if w:
                found.update(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3)))
        return found

    x, y = runs(a), runs(b)
    return 2 * (x & y).total() / (x.total() + y.total())


def test_a_repeated_line_counts_as_often_as_it_stands_only(spark):
    """Likeness is near the exact share of runs, also where one line stands very often in one of the texts."""
    r = random.Random(5)
    lines = [" ".join(f"w{r.randrange(10**6)}" for _ in range(9)) for _ in range(400)]
    rows = []
    for kept, times, other in ((300, 0, 100), (300, 40, 60), (300, 100, 0), (200, 150, 50), (40, 10, 0), (0, 100, 300)):
        new = [" ".join(f"n{r.randrange(10**6)}" for _ in range(9)) for _ in range(other)]
        rows.append(("\n".join(lines[: kept + 40]), "\n".join(lines[:kept] + [lines[0] if kept else "one line and its words"] * times + new)))
    rows.append(("a b c d\n" * 70_000 + "\n".join(lines), "a b c d\n" * 70_000 + "\n".join(lines[:10])))
    df = spark.createDataFrame([(2 * k + j, t) for k, pair in enumerate(rows) for j, t in enumerate(pair)], "k int, text string")
    v = {x["k"]: x["lanes"] for x in fingerprint.fingerprints(df, ["k"]).collect()}
    pairs = spark.createDataFrame([(k, v[2 * k], v[2 * k + 1]) for k in range(len(rows))], "k int, a array<long>, b array<long>")
    for x in pairs.select("k", fingerprint.likeness(F.col("a"), F.col("b")).alias("l")).collect():
        want = shared(*rows[x["k"]])
        # a median of 81 lanes is off by 0.18 of what differs, two deviations allowed
        assert abs(x["l"] - want) < 0.02 + 0.36 * (1 - want), (x, want)


def test_edited_texts_are_like_their_own(spark):
    """Three quarters of a text stay, whatever is repeated in it."""
    got = queries.op4_fingerprints(spark, SF.replace("0.001", "0.01")).where("n_chars >= 400").agg(F.count("*"), F.min("near_edited"), F.count_if(F.col("near_edited") <= F.col("near_next"))).first()
    assert got[0] > 100 and got[1] >= 0.5 and got[2] == 0


def test_languages_of_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op8_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[1] > 50 and held[0] > 0.95
    assert got.where("score < 0 OR score > 1").isEmpty()


def test_languages_of_odd_documents(docs):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).where("doc_id >= 900000").collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 for i in (900002, 900003, 900004, 900016))
    assert got[900017]["lang_pred"] in model.langs
    nothing = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs.limit(5), nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).collect() == []


def test_models_have_a_bound(spark, monkeypatch):
    rows = spark.range(40).select(F.lit("some words").alias("text"), F.col("id").cast("string").alias("lang"))
    monkeypatch.setattr(langid, "MODEL_BYTES", 39 * 4 * langid.BUCKETS)
    with pytest.raises(ValueError):
        langid.train(rows)
    assert len(langid.train(rows.where("id < 39")).langs) == 39


def test_pieces_of_long_texts_count_alike(monkeypatch):
    text = "Grüße aus der Stadt, hello there " * 40
    count = lambda: np.bincount(np.concatenate(list(langid.features(text, 1 << 12))), minlength=1 << 12)
    whole = count()
    monkeypatch.setattr(langid, "STEP", 100)
    pieces = count()
    # what a cut changes: the n-grams of the two characters that are seen twice
    assert len(text) * 2 < whole.sum() <= pieces.sum() <= whole.sum() + 6 * (len(text) // 100 + 1)
    assert (pieces >= whole).mean() > 0.99


def grams(text):
    """The n-grams of 1 to 3 letters of a text; other characters are a space, several of them one."""
    letters = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    return [letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)]


def bucket(gram, buckets):
    """The hash of the operator, a letter at a time."""
    code = 0
    for n in range(1, len(gram) + 1):
        code = (code * 0x01000193 + (ord(gram[n - 1]) + n) * 0x9E3779B1) & 0xFFFFFFFF
    h = ((code ^ code >> 15) * 0x85EBCA6B) & 0xFFFFFFFF
    return h >> 32 - (buckets.bit_length() - 1)


def test_predictions_as_plain_bayes(spark):
    """Counts, probabilities and posteriors recomputed with dicts and floats."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = {r["doc_id"]: r for r in queries.op8_langid(spark, SF).collect()}
    buckets = langid.BUCKETS
    learn = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({lang for _, lang in learn})
    counts = {lang: Counter() for lang in langs}
    for t, lang in learn:
        counts[lang].update(bucket(g, buckets) for g in grams(t))
    totals = {lang: sum(counts[lang].values()) + 0.5 * buckets for lang in langs}
    prior = Counter(lang for _, lang in learn)
    for i, t, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not t or not any(map(str.isalpha, t)):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        own = Counter(bucket(g, buckets) for g in grams(t))
        log = {lang: math.log(prior[lang] / len(learn)) + sum(n * math.log((counts[lang][b] + 0.5) / totals[lang]) for b, n in own.items()) for lang in langs}
        best = max(log.values())
        assert got[i]["lang_pred"] == max(langs, key=lambda x: log[x])
        assert abs(got[i]["score"] - 1 / sum(math.exp(v - best) for v in log.values())) < 1e-3


def vector(text):
    """A text's fingerprint in plain Python: exact lanes of its paragraphs, a count and Cauchy sums of its runs of words."""
    seeded = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    exact, stable = [0] * fingerprint.EXACT, [0] * (fingerprint.STABLE + 1)
    for p in (text or "").split("\n"):
        words = re.findall(r"[^ \t\n\x0b\f\r]+", p)
        if not words:
            continue
        hashes = [seeded(p.encode()), *(seeded(p.encode(), seeded(struct.pack("<i", k))) for k in range(1, fingerprint.EXACT // 2))]
        for k, h in enumerate(hashes):
            exact[2 * k] += h & 0xFFFFFFFF
            exact[2 * k + 1] += h >> 32
        tokens = [seeded(w.encode()) for w in words]
        for i in range(max(1, len(tokens) - fingerprint.RUN + 1)):
            h = 42
            for t in tokens[i : i + fingerprint.RUN]:
                h = seeded(struct.pack("<Q", t), h)
            stable[0] += 1
            for k in range(fingerprint.HASHES):
                bits = h if k == 0 else seeded(struct.pack("<i", 1000 + k), seeded(struct.pack("<Q", h)))
                for j in range(3):
                    x = (2 * (bits >> 20 * j & 0xFFFFF) + 1) / (1 << 20) - 1
                    stable[1 + 3 * k + j] += math.floor(x * (fingerprint._A - fingerprint._B * (x * x)) / (1 - x * x) * 64 + 0.5)
    return [x % (1 << 32) for x in exact], stable


def alike(a, b):
    if a == b:
        return 1.0
    (_, (na, *sa)), (_, (nb, *sb)) = a, b
    median = sorted(abs(x - y) for x, y in zip(sa, sb, strict=True))[len(sa) // 2] / 64
    return max(0.0, min(1.0, 1 - max(abs(na - nb), median) / (na + nb))) if na + nb else 0.0


def test_fingerprints_in_plain_python(spark):
    rows = sorted(((r[0], r[1] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    got = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, SF).collect()}
    show = lambda v: "".join(f"{x:08x}" for x in v[0]) + "".join(f"{x % (1 << 40):010x}" for x in v[1])
    for n, (i, text) in enumerate(rows[:60]):
        after = rows[(n + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, changed, following = vector(text), vector(edited), vector(after)
        assert got[i]["fingerprint"] == show(own) and got[i]["edited_fingerprint"] == show(changed)
        assert abs(got[i]["near_edited"] - alike(own, changed)) < 1e-9 and abs(got[i]["near_next"] - alike(own, following)) < 1e-9


CODE = """def connect(config, timeout=30):
    session = create_session(config.host, config.port)
    session.headers.update(build_headers(config.user_name))
    authorization: {}
    return session.open_connection(retry_policy, request_timeout)
"""


def test_planted_keys_are_found_and_names_are_not(spark):
    """Recall over random keys and precision over long identifiers of the corpus, in the same sensitive places."""
    r = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choices(alphabet, k=r.randint(24, 48))) for _ in range(150)]
    parts = ["request", "session", "handler", "factory", "manager", "service", "builder", "version", "channel", "wrapper"]
    names = ["_".join(r.sample(parts, 4)) + f"_v{r.randint(1, 9)}" for _ in range(150)]
    rows = [(i, CODE.format(x) + "\n".join(r.sample(parts, 6))) for i, x in enumerate(keys + names)]
    got = {x["doc_id"]: x["secrets"] for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = [i for i in range(300) if got[i]]
    caught, wrong = sum(i < 150 for i in hits), sum(i >= 150 for i in hits)
    assert caught >= 145 and wrong <= 5, (caught, wrong)
    for i in range(150):
        for s in got[i]:
            assert rows[i][1][s["start"] : s["end"]] == keys[i]


def test_dictionary_holds_names_of_many_documents_and_no_keys(spark):
    rows = [(i, f"open_session({i}) by customer_name token q9Zx7LmP2vRt8KwYb4NcJd6HsGfA3eUo once{'abcdefghij'[i]}only") for i in range(10)] + [(11, None), (12, "")]
    found = secrets.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).split()
    assert {"open_session", "customer_name"} <= set(found) and not any("q9Zx" in x or x.startswith("once") for x in found)


def _con(*tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_totals_cover_every_document(spark):
    got = queries.op9_token_rollup(spark, SF)
    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    want = {}
    for source, lang, text in _con("documents").sql("SELECT source, lang, text FROM documents").fetchall():
        text = text or ""
        for name, n in (("words", len(re.findall(token_rollup.WORDS, text.replace("|", " ")))), ("bpe", len(t.encode(text, add_special_tokens=False).ids))):
            docs, tokens, chars = want.get((source, lang, name), (0, 0, 0))
            want[source, lang, name] = docs + 1, tokens + n, chars + len(text)
    assert ordered(got.select("source", "lang", "tokenizer", "docs", "tokens", "chars").collect()) == ordered((*k, *v) for k, v in want.items())


def test_commits_count_once(spark, docs):
    path = Scratch(spark, "rollup-test").path("t")
    rollup = token_rollup.Rollup(spark, path)
    rows = docs.where("doc_id >= 900000").withColumns({"n": token_rollup.count_tokens(F.col("text")), "chars": F.length("text").cast("long"), "op": F.lit("clash")})
    of = lambda op, df=rows: token_rollup.counted(df, "words", op, "n")
    assert rollup.commit("a", of(token_rollup.INSERT)) and not rollup.commit("a", of(token_rollup.INSERT))
    first = rollup.totals().collect()
    assert [(r["source"], r["docs"]) for r in first] == [(None, 19)]
    rollup.compact()
    assert not rollup.commit("a", of(token_rollup.INSERT)) and rollup.batches() == []
    rollup.commit("none", of(token_rollup.INSERT, rows.limit(0)))
    assert rollup.totals().collect() == first
    # a write that a lost driver left aside counts for nothing
    token_rollup.deltas(of(token_rollup.INSERT)).write.parquet(f"{path}/aside/b-lost")
    assert rollup.totals().collect() == first and rollup.commit("b", of(token_rollup.INSERT))
    rollup.compact()
    assert rollup.folded("a", "b", "c", "none") == {"a", "b", "none"}
    rollup.commit("gone", of(token_rollup.DELETE))
    assert rollup.totals().collect() == first
    rollup.commit("gone again", of(token_rollup.DELETE))
    assert rollup.totals().collect() == []


def test_changes_between_two_counts(spark):
    cols = "doc_id long, source string, lang string, tokenizer string, tokens long, chars long"
    old = spark.createDataFrame([(1, "a", "en", "t", 5, 50), (2, "a", "en", "t", 7, 70), (3, "a", None, "t", 1, 10)], cols)
    new = spark.createDataFrame([(1, "a", "en", "t", 6, 60), (2, "b", "en", "t", 7, 70), (4, "a", None, "t", 2, 20)], cols)
    got = token_rollup.deltas(token_rollup.changes_between(old, new)).where("docs <> 0 OR tokens <> 0 OR chars <> 0")
    assert ordered(got.collect()) == ordered([("a", "en", "t", -1, -6, -60), ("b", "en", "t", 1, 7, 70), ("a", None, "t", 0, 1, 10)])


def test_overlaps_as_sql(spark):
    got = queries.op10_decontamination(spark, SF)
    want = _con("documents", "benchmark").sql(f"SELECT {', '.join(got.columns)} FROM ({decontam.SQL})").fetchall()
    assert want and ordered(got.collect()) == ordered(want)


@pytest.fixture(scope="module")
def items(spark):
    item = " ".join(f"item{i} of{i % 5}" for i in range(20))
    return item, spark.createDataFrame([(1, item), (2, "short item text"), (3, None), (4, ""), (5, item.upper())], "item_id long, text string")


def test_overlaps_stand_substitutions(spark, items):
    item, benchmark = items
    words = item.split()
    changed = [w if i % 6 else "other" for i, w in enumerate(words)]
    rows = [(1, f"start {item} end"), (2, "start " + " ".join(changed) + " end"), (3, " ".join(words[:6]) + " and then something else entirely follows here"), (4, "short item text"), (5, None), (6, ""), (1, f"start {item} end"), (7, "a longer short item text"), (None, item)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    assert ordered((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()) == ordered([(None, 1), (1, 1), (2, 1), (4, 2), (7, 2)])
    assert sorted(r["doc_id"] for r in decontam.remove(docs, benchmark).collect()) == [3, 5, 6]
    assert decontam.contaminated(docs.limit(0), benchmark).collect() == [] == decontam.contaminated(docs, benchmark.limit(0)).collect()


def accepted(own, item):
    """Brute force without seeds: whether some diagonal's stretch is accepted."""
    n, width = len(item), min(decontam.OVERLAP, len(item))
    for d in range(-n, len(own) + 1) if n else ():
        same = [0 <= p + d < len(own) and own[p + d] == w for p, w in enumerate(item)]
        if max(sum(same[a : a + width]) for a in range(n)) >= math.ceil(width * (1 - decontam.SUBSTITUTED)):
            return True
    return False


def test_overlaps_as_brute_force_without_seeds(spark):
    r = random.Random(11)
    items = [[f"i{i}w{k}" for k in range(n)] for i, n in enumerate([1, 3, 5, 8, 9, 10, 11, 12, 13, 14, 16, 20, 27, 40])]
    docs = []
    for item in items:
        for _ in range(60):
            a = r.randint(0, max(0, len(item) - 9)) if r.random() < 0.5 else 0
            part = item[a : a + r.randint(8, 16)] if r.random() < 0.5 else list(item)
            for p in r.sample(range(len(part)), min(len(part), r.randint(0, 1 + len(part) // 5))):
                part[p] = f"new{r.randint(0, 9)}"
            docs.append(r.choice([[], ["start"], ["a", "b", "c"] * 4]) + part + r.choice([[], ["end"], ["x", "y"] * 5]))
    # Every two words of ten replaced, and words cut off at both ends.
    docs += [[("new" if k in two else w) for k, w in enumerate(items[5])] for two in itertools.combinations(range(10), 2)]
    docs += [items[k][a:b] for k in range(5, 11) for a in range(4) for b in range(len(items[k]) - 3, len(items[k]) + 1)]
    want = sorted({(d, i) for d, own in enumerate(docs) for i, item in enumerate(items) if accepted(own, item)})
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string"), benchmark)
    assert sorted((x["doc_id"], x["item_id"]) for x in got.collect()) == want and len(want) > 400


def test_every_placement_of_two_substitutions_is_found(spark):
    item = [f"w{k}" for k in range(13)]
    pairs = [(a, b) for a in range(13) for b in range(a)]
    rows = [(n, " ".join(["before", *(f"x{n}" if k in pair else w for k, w in enumerate(item)), "behind"])) for n, pair in enumerate(pairs)]
    three = [(900 + n, " ".join(f"y{n}" if k % 4 == n else w for k, w in enumerate(item))) for n in range(4)]
    docs = spark.createDataFrame(rows + three, "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(78)) and {x["n_matched"] for x in got} == {11}


def test_a_phrase_repeated_very_often(spark):
    """Every fourth diagonal of a long text matches; the words stand once beside them."""
    phrase = "alpha beta gamma delta"
    docs = spark.createDataFrame([(1, " ".join([phrase] * 8000)), (2, " ".join([phrase] * 3)), (3, "clean words only " * 5000), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join([phrase] * 5)), (8, phrase + " epsilon")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontam.contaminated(docs, items).collect()}
    assert found == {(1, 7): 20, (2, 7): 12, (1, 8): 4, (2, 8): 4}
    assert [r[0] for r in decontam.remove(docs, items).select("doc_id").orderBy("doc_id").collect()] == [None, 3]


def test_short_items_stand_anywhere(spark):
    items = [(1, "alpha"), (2, "one two three four five six seven eight"), (3, "red green blue"), (4, "p q r s t")]
    docs = [(1, "before Alpha behind"), (2, "x one two three FIVE five six seven eight y"), (3, "two three four five six seven eight"), (4, "red green yellow"), (5, "so red green blue"), (6, "q r s t"), (7, "p q r x y"), (8, LONG_TEXT + " red, green, blue"), (8, "p q z s t"), (9, None), (10, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, text string, _d string, words string")
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = sorted({(d, i) for d, t in docs for i, x in items if accepted(words(t), words(x))})
    assert sorted((x["doc_id"], x["item_id"]) for x in decontam.contaminated(rows, benchmark).collect()) == want
    assert sorted(x["doc_id"] for x in decontam.remove(rows, benchmark).collect()) == [4, 7, 9, 10]


LONG_TEXT = " ".join(f"long{i}" for i in range(120_000))


def test_items_without_an_id_or_of_one_id(spark):
    one, two, three = (" ".join(f"{x}{k}" for k in range(14)) for x in "abc")
    benchmark = spark.createDataFrame([(None, one), (7, two), (7, three)], "item_id long, text string")
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{three} end"), (4, "another text")], "doc_id long, text string")
    assert ordered((x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs, benchmark).collect()) == [(1, None), (2, 7), (3, 7)]
    assert [x["doc_id"] for x in decontam.remove(docs, benchmark).collect()] == [4]
