import random

from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import findings as O

SCHEMA = "scan_id string, seq long, severity string, category string, file string, line int, code string, description string"


def make(spark, *rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], SCHEMA)


def test_merge_keeps_the_first_of_equal_rank_and_adds_descriptions(spark):
    f = make(spark, ("medium", "xss", "a", 1, "", "first text"), ("high", "script_injection", "a", 1, "c", "second text"), ("high", "xss", "a", 1, "d", "third text"), ("low", "xss", "a", 2, "", "x"))
    got = {r["line"]: r for r in O.merge_duplicates(f).collect()}
    assert (got[1]["severity"], got[1]["category"], got[1]["code"]) == ("high", "script_injection", "c")
    assert got[1]["description"] == "second text | first text | third text" and got[1]["seq"] == 0
    assert got[2]["description"] == "x"


def test_merge_treats_line_zero_and_null_alike_and_skips_like_descriptions(spark):
    f = make(spark, ("low", "xss", "a", 0, "", "A long description of thirty characters, one"), ("low", "xss", "a", None, "c", "A long description of thirty characters, two"))
    got = O.merge_duplicates(f).collect()
    assert len(got) == 1 and got[0]["line"] is None and got[0]["code"] == "c" and " | " not in got[0]["description"]


def test_cap_and_noise(spark):
    f = make(spark, *[("info", "network", "a", k, "", "n") for k in range(8)], ("medium", "network", "a", 9, "", "m"))
    assert [r["seq"] for r in O.cap_per_file(f).orderBy("seq").collect()] == [0, 1, 2]
    out = O.aggregate_noisy(f).orderBy("seq").collect()
    assert len(out) == 7 and out[-1]["description"] == "...and 3 more network findings (total 8 across repo)" and any(r["severity"] == "medium" for r in out)
    assert O.aggregate_noisy(f.limit(0)).count() == 0


def test_whitelist_by_hash_and_by_part_of_file(spark):
    f = make(spark, ("low", "xss", "src/data.py", 1, "", "d"), ("low", "xss", "src/b.py", 1, "", "e"), ("low", "net", "src/data.py", 1, "", "f"))
    h = f.where("seq = 1").select(S.finding_hash(F.col("category"), F.col("file"), F.col("description")).alias("h")).first()["h"]
    w = spark.createDataFrame([(h, "zzz", ""), ("none", "xss", "a.py"), ("other", "net", "")], "pattern_hash string, category string, file_pattern string")
    assert [r["seq"] for r in O.without_whitelisted(f, w).collect()] == [2]


def test_reviews_without_a_file_stay(spark):
    static = make(spark, ("low", "xss", "src/a.py", 1, "", "d"))
    reviews = make(spark, ("odd", "xss", "a.py", 1, "", "d"), ("odd", "xss", "", 1, "", "d"), ("HIGH", "net", "a.py", 1, "", "d"))
    got = {r["seq"]: r["severity"] for r in O.novel_reviews(reviews, static).collect()}
    assert got == {1: "medium", 2: "high"}


def test_labels(spark):
    rows = spark.createDataFrame([(None,), (8.0,), (7.9,), (5.0,), (4.9,)], "s double")
    assert [r[0] for r in rows.select(S.score_label(F.col("s"))).collect()] == ["N/A", "SAFE", "CAUTION", "CAUTION", "DANGER"]
    v = spark.createDataFrame([("CVSS:3.1/9.8",), ("CVSS:3.1/AV:N",), ("9.8",), ("CVSS/3",)], "s string")
    assert [r[0] for r in v.select(S.vulnerability_severity(F.col("s"))).collect()] == ["critical", "high", "high", "low"]
    m = spark.createDataFrame([("abcdefghijklmnop",), ("short",), (None,)], "s string").select(S.masked(F.col("s"))).collect()
    assert [r[0] for r in m] == ["abcdefgh...mnop", "*****", None]
    assert [r[0] for r in spark.createDataFrame([("a\nb\r\nc\n",), ("",), (None,)], "s string").select(S.lines(F.col("s"))).collect()] == [["a", "b", "c"], [], []]


def random_paths(rng, n):
    return ["/".join(rng.choice(("a", "ab", "b.py", "aab", "")) for _ in range(rng.randrange(4))) or None if rng.random() < 0.9 else None for _ in range(n)]


def test_whitelists_and_reviews_against_every_pair(spark):
    rng = random.Random(6)
    files, cats = random_paths(rng, 120), ("x", "y", None)
    rows = [("s", k, "low", rng.choice(cats), f, 1, "", "d") for k, f in enumerate(files)]
    f = spark.createDataFrame(rows, SCHEMA)
    patterns = [(f"h{k}", rng.choice(cats), rng.choice(("a", "ab", "b.p", "/", "aab/b.py", "", None, "z"))) for k in range(14)]
    w = spark.createDataFrame(patterns, "pattern_hash string, category string, file_pattern string")
    got = O.without_whitelisted(f, w)
    assert sorted(r["seq"] for r in got.collect()) == [r[1] for r in rows if not any(c is not None and c == r[3] and p and r[4] is not None and p in r[4] for _, c, p in patterns)]
    theirs = [("s" if k % 3 else "t", k, "odd" if k % 2 else "HIGH", rng.choice(cats), p, 1, "", "d") for k, p in enumerate(random_paths(rng, 90))]
    ends = lambda a, b: bool(a and b and (a.endswith(b) or b.endswith(a))) or not a and not b
    want = [r[1] for r in theirs if not any(r[0] == s[0] and r[3] is not None and r[3] == s[3] and ends(r[4], s[4]) for s in rows)]
    novel = O.novel_reviews(spark.createDataFrame(theirs, SCHEMA), f)
    assert sorted(r["seq"] for r in novel.collect()) == want and {r["severity"] for r in novel.collect()} <= {"medium", "high"}
    for df in (got, novel):  # equal keys only
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "contains(" not in plan.lower()


def test_paths_give_ends_of_lengths_that_others_have(spark):
    """A row for each length of the category's other paths, not for each character."""
    paths = spark.createDataFrame([("s", "x", "lib/src/a.py"), ("s", "y", "b.py"), ("s", "z", "c.py"), ("s", None, "d.py"), ("s", "x", "")], "scan_id string, category string, file string")
    others = spark.createDataFrame([("t", "x", "src/b.py"), ("s", "x", "a.py"), ("s", "x", "f" * 40), ("s", "y", "lib/b.py"), ("s", "z", ""), ("s", None, "d.py")], "scan_id string, category string, file string")
    assert sorted((r["file"], r["end"]) for r in O._ends(paths, others).collect()) == [("lib/src/a.py", "a.py"), ("lib/src/a.py", "src/a.py")]
