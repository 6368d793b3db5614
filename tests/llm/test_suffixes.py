"""Repeated byte strings against a table of all of them."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, suffix_dedup
from tessera.llm.suffix_dedup import _merge_sorted, anchors, cut_repeats, repeated_starts


def brute(texts, least):
    """(kept, removed, spans) of each text without what repeated strings cover."""
    count = {}
    for t in texts:
        for i in range(len(t) - least + 1):
            w = t[i : i + least]
            count[w] = count.get(w, 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        end = 0
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                gone[max(i, end) : i + least] = b"\1" * (i + least - max(i, end))
                end = i + least
        spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out.append((bytes(b for b, g in zip(t, gone) if not g), sum(gone), spans))
    return out


def some_texts(rng, pieces):
    """Texts with passages in common, periodic stretches, and copies."""
    shared = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(10, 90))) for _ in range(4)]
    out = []
    for _ in range(pieces):
        t = ""
        for _ in range(rng.randrange(5)):
            kind = rng.random()
            t += rng.choice(shared) if kind < 0.4 else rng.choice(["ab", "x", "abcab"]) * rng.randrange(20) if kind < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))
        out.append(t)
    return out + [out[0], "ü".join(shared)]


def test_merge_sort_is_stable():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 60)
        s = [bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(n)]
        group = np.array([rng.randrange(4) for _ in range(n)])

        def less(a, b, even):
            return np.array([s[x] < s[y] or (e and s[x] == s[y]) for x, y, e in zip(a, b, even)])

        assert _merge_sorted(np.arange(n), group, less).tolist() == sorted(range(n), key=lambda i: (group[i], s[i], i))


def test_equal_strings_have_equal_anchors():
    rng = random.Random(3)
    for _ in range(100):
        texts = [t.encode() for t in some_texts(rng, 5)]
        text, k, c, first, number, place = anchors(texts, 20)
        seen, n = {}, 0
        for j in range(len(text)):
            for i in range(number[j]):
                w = texts[text[j]][first[j] + i : first[j] + i + 20]
                assert len(w) == 20 and seen.setdefault(w, (k[j], place[j] - i)) == (k[j], place[j] - i)
                n += 1
        assert n == sum(max(0, len(t) - 19) for t in texts)


@pytest.mark.parametrize("lie", (False, True))
def test_sorted_suffixes(monkeypatch, lie):
    """Also if the hashes say that all strings are equal: bytes decide."""
    if lie:
        monkeypatch.setattr(suffix_dedup.Prefixes, "of", lambda self, at, size: np.zeros(len(at), np.uint64))
    rng = random.Random(4)
    for _ in range(60):
        parts, bucket, place, counts = [], [], [], []
        for b in range(5):
            for _ in range(rng.randrange(1, 9)):
                p = rng.randrange(6)
                n = rng.randrange(1, p + 2)
                parts.append(bytes(rng.choice(b"ab" if rng.random() < 0.2 else b"a") for _ in range(n + 11)))
                bucket.append(b)
                place.append(p)
                counts.append(n)
        where, i = {}, 0
        for j in range(len(parts)):
            for o in range(counts[j]):
                where.setdefault((bucket[j], place[j] - o, parts[j][o : o + 12]), []).append(i)
                i += 1
        want = np.zeros(i, bool)
        for v in where.values():
            want[v] = len(v) > 1
        assert (repeated_starts(parts, np.array(bucket), np.array(place), np.array(counts), 12) == want).all()


@pytest.mark.parametrize("most", (2000, 2))
def test_against_all_strings(spark, most):
    rng = random.Random(most)
    for least in (20, 31):
        texts = some_texts(rng, 40)
        rows = [(k // 2 if k < 10 else k, t) for k, t in enumerate(texts)] + [(None, texts[3]), (100, None), (101, ""), (None, "é" * 40)]
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("h", "k", "id", "marks", "kept", "n_bytes", "first")})
        got = cut_repeats(df, least=least, most_classes=most)
        assert got.columns == ["doc_id", "h", "k", "id", "marks", "kept", "n_bytes", "first", "kept_", "n_bytes_", "n_removed", "n_spans"]
        want = [(i, len((t or "").encode()), *x) for (i, t), x in zip(rows, brute([(t or "").encode() for _, t in rows], least))]
        found = [(r["doc_id"], r["n_bytes_"], bytes(r["kept_"]), r["n_removed"], r["n_spans"]) for r in got.collect()]
        assert sorted(found, key=str) == sorted(want, key=str)
    assert cut_repeats(df.limit(0)).count() == 0


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PLACE", 8)
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghij") for _ in range(1500))
    rows = [(1, base), (2, base[300:900]), (3, "z" * 700), (4, base[:240] + "-" + base[1000:])]
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least=30).collect()}
    assert got == dict(zip((1, 2, 3, 4), brute([t.encode() for _, t in rows], 30)))


def test_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {i: (len(t.encode()), n, spans, hashlib.sha256(kept).hexdigest()) for (i, t), (kept, n, spans) in zip(rows, brute([t.encode() for _, t in rows], 200))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op13_suffix_array(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and sum(v[1] > 0 for v in want.values()) > 5
