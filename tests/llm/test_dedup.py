import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from podium.llm import minhash, suffix_dedup

from .conftest import ordered

LONG_LINE = "".join(chr(97 + i * i % 23) for i in range(500))


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(rows, k):
    """Brute force: component of each id, over all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in sets]


def test_near_duplicates_as_brute_force(docs, texts):
    rows = [(-(2**63) if i is None else i, t) for i, t in texts]
    want = [(None if i < 0 else i, n, None if c < 0 else c, k) for i, n, c, k in groups(rows, 4)]
    assert ordered(minhash.near_duplicates(docs, words=4).collect()) == ordered(want)


def test_one_document_of_a_group_stays(docs, texts):
    kept = minhash.deduplicate(docs.where("doc_id >= 900000 OR doc_id IS NULL"))
    want = {c for i, _, c, k in groups([(i or 0, t) for i, t in texts if i is None or i >= 900000], 5) if k}
    assert ordered((r["doc_id"] or 0,) for r in kept.collect()) == ordered((i,) for i in want)
    assert kept.columns == docs.columns


def test_documents_without_an_id_or_of_one_id_stay(spark):
    text = lambda n: " ".join(f"t{n}w{k}" for k in range(60))
    near = lambda n: f"{text(n)} tail"
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (7, text(4))]
    rows += [(1, near(1)), (2, near(2)), (8, near(5)), (9, text(6)), (3, near(6)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(None, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (3, near(6)), (None, None)]
    assert ordered(minhash.deduplicate(df).collect()) == ordered(want)


def test_unlike_texts_of_one_id_stay(spark):
    rows = [(i, " ".join(f"t{n}w{k}" for k in range(60))) for n, i in enumerate([None, None, None, 7, 7])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(minhash.deduplicate(df).collect()) == ordered(rows)


def test_no_documents(docs):
    assert minhash.near_duplicates(docs.limit(0)).collect() == []
    assert suffix_dedup.digest(docs.limit(0)).collect() == []


def test_chunks_of_words(monkeypatch):
    text = "Aa  bb\tccc " * 50 + "d" * 90 + " é e　f"
    words = minhash.word_hashes(text)
    assert len(set(words.tolist())) == len(set(re.findall(r"[^\x20\x09-\x0D]+", text)))
    monkeypatch.setattr(minhash, "_CHUNK", 64)
    assert len(minhash.word_hashes(text)) == len(words)
    assert minhash.word_hashes(text)[:-3].tolist()[:150] == words[:150].tolist()


def test_screen_keeps_similar_pairs():
    r = np.random.RandomState(5)
    for n in (1, 7, 40, 3000, 40_000):
        a = np.unique(r.randint(0, 2**62, n, dtype=np.int64).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.95)], r.randint(0, 2**62, n // 25, dtype=np.int64).astype(np.uint64)]))
        x, y = (np.frombuffer(minhash.parity_bits(s), np.uint8)[None] for s in (a, b))
        size = min(x.shape[1], y.shape[1])
        apart = int(np.bitwise_count(minhash._fold(x, size) ^ minhash._fold(y, size)).sum())
        assert apart <= len(np.setxor1d(a, b))


def removed(rows, length):
    """Brute force: for each row (id, bytes, removed, runs, digest of what is left)."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(hashlib.md5(d[i : i + length]).digest() for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, np.int32)
        for p in range(len(d) - length + 1):
            if seen[hashlib.md5(d[p : p + length]).digest()] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        left = bytes(np.frombuffer(d, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def first_five(found):
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()


def test_parse_finds_what_counting_finds():
    """Dictionary and parse against all strings counted, over alphabets of one letter to all bytes."""
    for seed in range(60):
        r = random.Random(seed)
        length, alphabet = r.choice([5, 12, 20, 40, 100]), r.choice([b"a", b"ab", b"abcdefgh", bytes(range(256))])
        base = [bytes(r.choices(alphabet, k=r.randint(1, 150))) for _ in range(6)]
        contents = ["".encode().join(r.choice(base)[r.randint(0, 5) :] for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))]
        contents = [c for c in contents if len(c) >= length] or [b"x" * length]
        seen = Counter(c[i : i + length] for c in contents for i in range(len(c) - length + 1))
        for c, found in zip(contents, suffix_dedup.repeated_starts(contents, length), strict=True):
            assert found.tolist() == [seen[c[i : i + length]] > 1 for i in range(len(c) - length + 1)]


def test_repeats_across_the_seam_of_long_texts(spark):
    r = np.random.RandomState(9)
    long = bytes(r.randint(97, 123, (1 << 20) + 5_000).astype(np.uint8)).decode()
    rows = [(1, long), (2, long[(1 << 20) - 700 : (1 << 20) + 500]), (3, "z" + long[-450:]), (4, long[: 1 << 10])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(first_five(suffix_dedup.digest(df))) == ordered(removed(rows, 400))


def test_kept_text_and_mark_of_repeats(spark):
    same = "é" * 150 + "".join(chr(97 + i * i % 23) for i in range(300))
    df = spark.createDataFrame([(1, "head " + same), (2, same + " tail"), (3, "other"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["repeats"], r["kept_text"]) for r in suffix_dedup.digest(df).collect()}
    assert got == {1: (True, "head "), 2: (True, " tail"), 3: (False, "other"), 4: (False, "")}


def test_repeats_as_brute_force(docs, texts):
    some = docs.where("length(coalesce(text, '')) < 60000")
    rows = [(i, t) for i, t in texts if len(t or "") < 60_000]
    assert ordered(first_five(suffix_dedup.digest(some))) == ordered(removed(rows, 400))


def sharing(rows, k):
    """Brute force: rows of which a run of k words stands in another row."""
    runs = [{r for r in shingles(t, k) if len(r) == k} for _, t in rows]
    seen = Counter(r for x in runs for r in x)
    return [(i, any(seen[r] > 1 for r in x)) for (i, _), x in zip(rows, runs, strict=True)]


def test_shared_passages_as_brute_force(docs, texts):
    assert ordered(suffix_dedup.digest(docs).select("doc_id", "shares_passage").collect()) == ordered(sharing(texts, 51))


def test_passages_shorter_than_the_strings_removed(spark):
    """Passages of 51 words have fewer than 400 bytes: they are told of in every place, nothing is removed; of 50 words they aren't."""
    r = random.Random(7)
    own = lambda n: ["".join(r.choices("abcdefgh", k=r.randint(3, 6))) for _ in range(n)]
    long, short = own(51), own(50)
    rows = [(i, " ".join(own(r.randint(0, 90)) + (long if i % 2 else short) + own(r.randint(0, 90)))) for i in range(40)]
    rows += [(40, " ".join(long[:1] + own(200))), (41, "\n".join(long).upper()), (42, " ".join((own(1) + short) * 3)), (43, "twice " * 120), (44, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.digest(df).collect()
    assert {x["doc_id"] for x in got if x["shares_passage"]} == {*range(1, 40, 2), 41}
    assert all(x["n_removed"] == 0 for x in got if x["doc_id"] < 42)
    for words in (1, 9, 50):
        assert ordered(suffix_dedup.remove_repeats(df, words=words).select("doc_id", "shared").collect()) == ordered(sharing(rows, words))


def test_blocks_of_words(monkeypatch):
    """Every run of words is in some piece, whatever the size of a block; equal pieces have equal runs."""
    text = " ".join(f"w{i * i % 389}x{i % 7}" for i in range(900)).encode()
    texts = [b"", text, b"one", text[:2000], text + b" end"]

    def found():
        asked = [dict.fromkeys(suffix_dedup.word_pieces([t])[2].tolist(), False) for t in texts]
        of, runs, _ = suffix_dedup.word_runs(texts, asked)
        return [runs[of == i].tolist() for i in range(len(texts))]

    alone = found()
    assert [len(x) for x in alone] == [len({r for r in shingles(t.decode(), 51) if len(r) == 51}) for t in texts]
    of, _, entry = suffix_dedup.word_pieces(texts)
    assert [(i, e) for i, t in enumerate(texts) for e in suffix_dedup.word_pieces([t])[2]] == list(zip(of, entry, strict=True))
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 100)
    assert found() == alone


def around(n, length, seed):
    """n texts that hold one passage between words of their own, some of them equal, some with a longer passage."""
    r = random.Random(seed)
    own = lambda k: "".join(r.choices("abcdefghij", k=k))
    passage = own(length + length // 4)
    rows = [(i, own(length // 5) + passage[i % 3 :] + r.choice(["", "y" * 20, "z" * 31]) + own(length // 5)) for i in range(n)]
    return rows + [(n + k, t) for k, (_, t) in enumerate(rows[: n // 10])]


def test_groups_of_any_size_are_split_and_sorted(spark):
    """A group above the bound is cut by longer context, at last to single strings; the result is that of brute force."""
    rows = around(60, 100, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = ordered(removed(rows, 100))
    for group in (1, 2, 7, 1000):
        assert ordered(first_five(suffix_dedup.digest(df, length=100, group=group))) == want


def test_a_group_of_ten_thousand_pieces(spark):
    rows = around(10_000, 100, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(first_five(suffix_dedup.digest(df, length=100))) == ordered(removed(rows, 100))


def test_cuts_of_equal_strings_meet(spark):
    """A string cut out of two pieces has the same ``sub`` in both, whatever stands around it."""
    r = random.Random(5)
    core = bytes(r.choices(b"abcdefgh", k=140))
    contents = [(k, k, 5, 60 + k, bytes(r.choices(b"xyz", k=k)) + core + bytes(r.choices(b"xyz", k=9))) for k in (0, 3, 17)]
    df = spark.createDataFrame(contents, "key long, entry long, m long, left int, content binary").withColumn("key", F.lit(1).cast("long"))
    for width in suffix_dedup.WIDTHS:
        subs = {}
        for c in suffix_dedup._split(df, 100, width).collect():
            for at in range(len(c["content"]) - 99):
                subs.setdefault((bytes(c["content"][at : at + 100]), c["left"] - at), set()).add(c["sub"])
        assert len(subs) > 40 and all(len(x) == 1 for x in subs.values())


def test_repeats_are_found_by_the_sort(spark, monkeypatch):
    """Without the sort nothing is removed, equal documents neither: no count stands in for it."""
    rows = [(1, LONG_LINE), (2, LONG_LINE), (3, LONG_LINE + "tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup._found
    monkeypatch.setattr(suffix_dedup, "_found", lambda contents, *rest: found(contents.where("false"), *rest))
    assert [r["n_removed"] for r in suffix_dedup.digest(df).collect()] == [0, 0, 0]


def test_spans_are_what_was_removed(spark):
    same = "".join(chr(97 + i * i % 23) for i in range(500))
    df = spark.createDataFrame([(1, "head " + same), (2, same + " tail")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df).select("doc_id", "removed", F.col("kept").cast("string").alias("kept")).collect()}
    assert [tuple(x) for x in got[1]["removed"]] == [(5, 505)] and got[1]["kept"] == "head "
    assert [tuple(x) for x in got[2]["removed"]] == [(0, 500)] and got[2]["kept"] == " tail"
