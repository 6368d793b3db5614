"""Periodic runs against every period of every place, and the query against its definition."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.tandem_runs import Ranks, Tree, all_runs, collapse_runs, covering_squares, runs_of, vocabulary


def brute(s):
    """Every maximal repetition with two periods at least, by start and period."""
    n, out = len(s), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            size = j - i + p
            if j - i >= p and not any(all(s[i + k] == s[i + k + d] for k in range(size - d)) for d in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def long_runs(words):
    """Runs of 24 words and three periods at least, by longest stretches of words equal to those one period on."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    s = np.array([ids[w] for w in words])
    out, taken = [], set()
    for p in range(1, len(s) // 3 + 1):
        same = np.concatenate(([False], s[p:] == s[:-p], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            size = hi - lo + p
            if size >= max(24, 3 * p) and (lo, size) not in taken:  # a multiple of the smallest period gives the same stretch
                taken.add((lo, size))
                out.append((lo, size, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(s):
    return np.unique(np.array(s), return_inverse=True)[1]


def some_text(rng):
    s = [rng.randrange(rng.choice([1, 2, 2, 3, 4])) for _ in range(rng.randrange(2, 40))]
    if rng.random() < 0.4:
        b = s[: rng.randrange(1, 6)]
        s = (b * 40)[: len(s)]
        if rng.random() < 0.5:
            s[rng.randrange(len(s))] = 7
    return s


def test_all_runs_of_short_texts():
    rng = random.Random(5)
    for _ in range(1500):
        s = some_text(rng)
        assert [tuple(r) for r in all_runs(numbered(s)).tolist()] == brute(s), s


def test_vocabulary_is_every_kind_of_square():
    rng = random.Random(6)
    for _ in range(400):
        s = some_text(rng)
        ids = numbered(s)
        tree = Tree(ids)
        got = {tuple(s[tree.least[v] : tree.least[v] + size]) for v, size in vocabulary(tree, *covering_squares(ids, tree, Ranks(ids)))}
        assert got == {tuple(s[i : i + 2 * p]) for i in range(len(s)) for p in range(1, (len(s) - i) // 2 + 1) if s[i : i + p] == s[i + p : i + 2 * p]}, s


def test_tree_holds_every_suffix():
    rng = random.Random(7)
    for _ in range(200):
        s = some_text(rng)
        t = Tree(numbered(s))
        assert sorted(t.leaves.tolist()) == list(range(len(s) + 1))
        suffixes = [t.s[i:] for i in range(len(s) + 1)]
        for i, size in enumerate(t.earlier().tolist()):
            assert size == max([k for k in range(len(s) - i + 1) if any(s[j : j + k] == s[i : i + k] for j in range(i))], default=0), (s, i)
        assert len(suffixes) == len(t.leaves)


def test_runs_of_many_texts_at_once():
    rng = random.Random(8)
    for _ in range(250):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            w = []
            for _ in range(rng.randrange(7)):
                kind = rng.random()
                if kind < 0.4:
                    w += [f"x{rng.randrange(50)}" for _ in range(rng.randrange(30))]
                elif kind < 0.8:
                    b = [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
                    w += (b * 99)[: rng.randrange(1, 100)]
                else:
                    w += w[: rng.randrange(1, 40)]
            docs.append(w)
        got = runs_of(docs)
        for k, w in enumerate(docs):
            assert [tuple(r) for r in got.get(k, np.empty((0, 3), int)).tolist()] == [r for r in brute(w) if r[1] >= max(24, 3 * r[2])] == long_runs(w), w


def test_a_very_long_text():
    base = [f"w{k}" for k in range(700)]
    w = ["a"] * 30_000 + base * 40 + [f"u{k}" for k in range(50_000)] + base * 3
    got = runs_of([w])[0].tolist()
    assert got == [[0, 30_000, 1], [30_000, 28_000, 700], [108_000, 2100, 700]]


def test_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (2, " \t\n", 2), (3, "a\tb " * 12, 3), (3, "a\tb " * 12, 3), (None, "x y z " * 7 + "x", 4), (5, "x y z " * 8 + "\u00a0 x", 5), (6, "é\x0b" * 30 + "ende", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs long").withColumns({"start": F.lit(1), "text_": F.lit("k")})
    got = collapse_runs(df)
    assert got.columns == ["doc_id", "text", "runs", "start", "text_", "runs_"]
    found = sorted(((r["doc_id"], r["text"], [tuple(x) for x in r["runs_"]]) for r in got.collect()), key=str)
    want = [(1, "", []), (2, "", []), (2, "", []), (3, "a b", [(0, 24, 2)]), (3, "a b", [(0, 24, 2)]), (None, "x y z " * 7 + "x", []), (5, "x y z \u00a0 x", [(0, 24, 3)]), (6, "é ende", [(0, 30, 1)])]
    assert found == sorted(want, key=str)
    assert collapse_runs(df.limit(0)).count() == 0


def test_query_against_its_definition(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900001, None), (900002, ""), (900003, " one two "), (900010, "q " * 50)], docs.schema)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    want, periodic = {}, 0
    for i, text in docs.unionByName(extra).collect():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            periodic += 1
        runs = long_runs(w) if len(w) >= 24 else []
        gone = {k for s, size, p in runs for k in range(s + p, s + size)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        digest = hashlib.sha256("".join(f"{s},{size},{p}\n" for s, size, p in runs).encode()).hexdigest()
        kept = hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
        want[i] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, kept)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == want and periodic > 10 and sum(v[0] for v in want.values()) > 10
