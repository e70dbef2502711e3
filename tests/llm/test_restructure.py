"""Fill-in-middle, prefix trie and line dedup against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.llm import fim, line_dedup, prefix_trie, queries
from podium.llm.common import Scratch

from .conftest import SF, ordered


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill-in-middle --------------------------------------------------------------


def cut_plainly(doc_id, text):
    text = text or ""
    n = len(text)
    hexed = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None), text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a), f"<S>{suf}<P>{pre}<M>{mid}", text
    return (doc_id, n, "psm", a, b - a), f"<P>{pre}<S>{suf}<M>{mid}", text


MARKED = [(i, t) for i, t in enumerate(["<P>", "a<", "<P", "<<<<", "P>x", "<S><M>", ">", "<P<P<P", "S>M>P>", "<M", "\U0001f600<"] * 4, 5000)]


@pytest.fixture(scope="module")
def marked(spark, docs):
    return docs.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(i, t, "clash") for i, t in MARKED], "doc_id long, text string, key string"))


@pytest.mark.parametrize("chunk", [1, 2, 7, fim.CHUNK])
def test_cut_and_restored(marked, chunk):
    given = marked.where(F.length("text") < 2000) if chunk < 10 else marked
    rows = [cut_plainly(*r) for r in given.select("doc_id", "text").collect()]
    assert ordered(fim.digest(given, chunk=chunk).collect()) == ordered((*r, sha(out), sha(text)) for r, out, text in rows)


def test_whole_texts_from_pieces(marked):
    rows = [cut_plainly(*r) for r in marked.select("doc_id", "text").collect()]
    made = fim.pieces(marked, chunk=100)
    assert ordered(fim.assembled(made).collect()) == ordered((*r, out) for r, out, _ in rows)
    assert ordered(fim.assembled(fim.restored(made)).collect()) == ordered((*r, text) for r, _, text in rows)


def test_one_shuffle_brings_pieces_together(docs):
    plan = fim.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert fim.digest(docs.limit(0)).collect() == []


def test_shares_are_parameters():
    forms = Counter(fim.cut(i, "some text of a few words", cut_share=50, spm_share=50)[0] for i in range(4000))
    assert abs(forms["plain"] - 2000) < 200 and abs(forms["spm"] - 1000) < 150


# Line dedup ------------------------------------------------------------------


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def dedup_plainly(rows, least):
    seen = Counter(k for _, t in rows for k in {line_key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[line_key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LINES = [
    *((7000 + i, f"own {i}\n  Shared LINE \t\nrare {i % 4}\n\nÄ shared") for i in range(12)), (7100, "shared line\r\nshared line\n\x85shared line"), (7101, None), (7102, ""), (7103, "\n\n"),
    (7104, "\n".join(f"line {i % 3000}" for i in range(20_000))), (7105, "shared line"), (7105, "shared line"), (None, "ä SHARED\nä shared"), (7106, "ÄSHARED　\nKelvin K"),
]


@pytest.fixture(scope="module")
def lined(spark):
    random.seed(5)
    more = [(8000 + i, "\n".join(f"common {int(random.paretovariate(0.6)) % 400}" for _ in range(random.randrange(12)))) for i in range(300)]
    rows = LINES + more
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, k1 string, n_lines int").repartition(3)


@pytest.mark.parametrize(("heavy", "filter_bytes"), [(line_dedup.HEAVY, line_dedup.FILTER_BYTES), (3, line_dedup.FILTER_BYTES), (3, 0), (0, 0)])
def test_lines_in_many_documents_go(spark, lined, tmp_path, heavy, filter_bytes):
    rows, docs = lined
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"), 10, shards=7)
    index.insert("all", docs)
    kept = line_dedup.dedup(docs, index, Scratch(spark, "t"), heavy=heavy, filter_bytes=filter_bytes)
    assert kept.columns == ["doc_id", "text", "k1", "n_lines", "n_dropped"]
    assert ordered(kept.drop("k1").collect()) == ordered(dedup_plainly(rows, 10))


def held(index):
    return {tuple(r) for r in index.refs().collect()}, {r["shard"]: line_dedup.CuckooFilter.load(bytes(r["filter"])) for r in index.filters().collect()}


def test_batches_count_once_and_can_be_taken_out(spark, lined, tmp_path):
    rows, docs = lined
    first, second = docs.where("doc_id % 2 = 0 OR doc_id IS NULL"), docs.where("doc_id % 2 = 1")
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"), 10, shards=5)
    assert index.insert("a", first) and not index.insert("a", first)
    before = held(index)[0]
    assert index.insert("b", second)
    assert ordered(line_dedup.dedup(docs, index, Scratch(spark, "t")).select("doc_id", "text", "n_lines", "n_dropped").collect()) == ordered(dedup_plainly(rows, 10))
    assert index.delete("c", second) and not index.delete("c", second) and not index.insert("b", second)
    after, filters = held(index)
    assert after == before
    some = [r for r in rows if r[0] is None or r[0] % 2 == 0]
    kept = line_dedup.dedup(first, index, Scratch(spark, "t"))
    assert ordered(kept.select("doc_id", "text", "n_lines", "n_dropped").collect()) == ordered(dedup_plainly(some, 10))
    with pytest.raises(ValueError):
        index.delete("d", second)
    assert held(index)[0] == before
    index.delete("e", first)
    assert held(index)[0] == set()
    assert all(not any(t) for f in held(index)[1].values() for t in f.tables)
    line_dedup.drop_folder(index)
    assert index.refs().collect() == []


def test_filter_as_a_set():
    rng = random.Random(3)
    kept, keys = line_dedup.CuckooFilter(), []
    for step in range(6000):
        if keys and rng.random() < 0.35:
            kept.delete(*keys.pop(rng.randrange(len(keys))))
        else:
            keys.append((rng.getrandbits(64), rng.getrandbits(64)))
            kept.insert(*keys[-1])
        if step % 1500 == 0:
            kept = line_dedup.CuckooFilter.load(kept.dump())
    halves = [np.array(x, np.uint64) for x in zip(*keys, strict=True)]
    assert kept.contains(*halves).all() and len(kept.tables) > 1
    other = [np.array([rng.getrandbits(64) for _ in range(200_000)], np.uint64) for _ in range(2)]
    assert kept.contains(*other).mean() < 0.002
    same = line_dedup.CuckooFilter()
    for _ in range(50):  # more copies than two buckets hold
        same.insert(1, 2)
    for _ in range(50):
        same.delete(1, 2)
    with pytest.raises(KeyError):
        same.delete(1, 2)


def test_line_digests(spark, docs, texts):
    found = line_dedup.digest(docs, Scratch(spark, "t"))
    assert ordered(found.collect()) == ordered((i, n, d, sha(t)) for i, t, n, d in dedup_plainly(texts, 10))
    assert line_dedup.digest(docs.limit(0), Scratch(spark, "t")).collect() == []


# Prefix trie -----------------------------------------------------------------


def branched_plainly(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    for ts in own.values():
        ts.sort()
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rest = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = [x[2:] for x in own.get(rest, [])[:h] + own[c][h:]]
    return out


def trie_plainly(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    return [
        (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))) if ends[p] else ""))
        for p, cs in members.items()
    ]


def talk():
    rng = random.Random(11)
    rows = []
    for c in (*range(0, 60), *range(100, 140), *range(205, 240), -5, -100, 10**12):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "cc", "ddd", None, ""])))
    for c in range(1000, 1040):  # copies, and a long prefix that many share
        rows += [(c, t, "user", "copy") for t in range(6)]
        rows += [(c + 100, t, "user", f"deep {t}") for t in range(40)] + [(c + 100, 40, "user", str(c // 2))]
    rows += [(300, None, "user", "no turn"), (300, 3, "user", "tie"), (300, 3, "user", "tie"), (300, 3, "assistant", "other"), (None, 1, "user", "no id"), (301, 1, "user", "x" * 300_000), (302, 1, "us", "er"), (303, 1, "u", "ser")]
    return rows


@pytest.mark.parametrize(("share", "least", "chunk"), [(prefix_trie.SHARE, prefix_trie.LEAST, prefix_trie.CHUNK), (50, 2, 3), (10**6, 0, 1), (5, 1, 7)])
def test_trie_of_odd_conversations(spark, share, least, chunk):
    rows = spark.createDataFrame([(*r, "clash") for r in talk()], "conv_id long, turn int, role string, text string, seq string")
    convs = prefix_trie.branched(prefix_trie.turns(rows))
    found = prefix_trie.nodes(convs, Scratch(spark, "t"), share, least, chunk)
    assert ordered(found.drop("turn_id").collect()) == ordered(trie_plainly(branched_plainly(talk())))


@pytest.mark.parametrize("least", [0, 64])
def test_nodes_name_their_turns(spark, least):
    rows = spark.createDataFrame([(c, t, *x) for c in (1, 2) for t, x in enumerate((("user", "hi"), ("bot", "yo"))[:c])], "conv_id long, turn int, role string, text string")
    found = {r["depth"]: r["turn_id"] for r in prefix_trie.nodes(prefix_trie.turns(rows), Scratch(spark, "t"), least=least).collect()}
    assert found == {0: None, 1: sha("4:userhi")[:32], 2: sha("3:botyo")[:32]}


def test_empty_conversations(spark):
    rows = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert prefix_trie.digest(rows, Scratch(spark, "t")).collect() == []
    turnless = spark.createDataFrame([(150, 0, "user", "only")], "conv_id long, turn int, role string, text string")
    h = zlib.crc32(b"150") % 6
    assert len(prefix_trie.digest(turnless, Scratch(spark, "t")).collect()) == (1 if h else 2)


def test_generated_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ordered(queries.op12_prefix_trie(spark, SF).collect()) == ordered(trie_plainly(branched_plainly(rows)))
