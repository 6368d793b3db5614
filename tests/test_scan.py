"""The whole scan over a small component of every kind, and scans as recorded jobs."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import history
from tessera.plans import jobs
from tessera.plans.expected import EXPECTED
from tessera.plans.sample import SAMPLE
from tessera.plans.scan import scan
from tessera.sources.tables import Tables

SF = "/root/testdata/sf0.001"
FILE = "scan_id string, path string, content string"


def test_scan(spark):
    got = sorted(tuple(str(r[c]) for c in ("scan_id", "file", "severity", "category", "line", "code")) for r in scan(spark.createDataFrame(SAMPLE, FILE)).collect())
    assert got == sorted(tuple(map(str, r)) for r in EXPECTED["full_scan"])


def test_scans_are_recorded(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}")
    files = spark.createDataFrame([r for r in SAMPLE if r[0] == "s1"], FILE)
    scores = spark.createDataFrame([("s1", 7.5)], "scan_id string, score double")
    at = F.lit("2024-01-01").cast("timestamp")
    first = jobs.run_scan(t, files, scores, at)
    assert first["findings"].count() > 20 and first["changes"].count() == 0
    more = files.unionByName(spark.createDataFrame([("s1", "custom_components/x/new.py", "import turtle\n")], FILE))
    second = jobs.run_scan(t, more, scores, F.lit("2024-01-02").cast("timestamp"), batch_id="b")
    assert second["changes"].count() == 1
    assert [r["status"] for r in t.load("jobs").collect()] == ["done"] and t.load("history").count() == 2 and t.load("fingerprints").count() == 2
    assert history.reputation(t.load("history")).first()["avg_score"] == 7.5
    assert history.scans_total(t.load("jobs")).first()[0] == 1 and history.active_batches(t.load("jobs")).count() == 0
    w = jobs.add_whitelist(t.load("whitelist"), "network", "x", "d", "known", at)
    t.save("whitelist", jobs.add_whitelist(w, "network", "x", "d", "again", at))
    row = t.load("whitelist").collect()
    assert len(row) == 1 and row[0]["reason"] == "again"
    t.save("whitelist", jobs.remove_whitelist(t.load("whitelist"), row[0]["pattern_hash"]))
    assert t.load("whitelist").count() == 0


def test_a_failed_scan_leaves_failed_jobs(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}")
    bad = spark.createDataFrame([("s1", "a.py", "x")], FILE).withColumn("path", F.raise_error(F.lit("broken")).cast("string"))
    try:
        jobs.run_scan(t, bad, spark.createDataFrame([], "scan_id string, score double"), F.lit("2024-01-01").cast("timestamp"))
    except Exception:
        pass
    got = t.load("jobs").collect()
    assert [r["status"] for r in got] == ["failed"] and "broken" in got[0]["error"]


def test_a_scan_passes_over_files_once_for_each_language(spark):
    """Python runs five times over files (rules of Python, of the platform, of scripts twice over, of YAML) and once for the totals of scripts; no content is shuffled."""
    plan = scan(spark.createDataFrame(SAMPLE, FILE))._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("MapInArrow") <= 6
    assert "NestedLoop" not in plan


def test_unparsed_scripts_are_told_once_by_the_same_pass(spark):
    x = scan(spark.createDataFrame([("a", "x.js", "f("), ("a", "y/x.js", "eval(x); ("), ("a", "z.js", "a?.b"), ("a", "w.js", "f()"), ("a", "v.js", "el.innerHTML = x"), ("b", "x.js", "f()")], FILE))
    got = sorted((r["scan_id"], r["file"], r["category"], r["description"]) for r in x.collect() if r["category"] != "xss")
    assert [g[:3] for g in got] == [("a", "(repo)", "parse_info"), ("a", "y/x.js", "code_injection")] and got[0][3] == "3 files were read by patterns only"
    assert x._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 5


def test_all_python_rules_in_one_pass_tell_what_each_tells_of_facts(spark):
    from tessera.operators import ast_rules as A

    texts = [c for _, p, c in SAMPLE if p.endswith(".py")] + ["import os.path, osx, pickle.x\nfrom urllib3.util import a\nimport urllib, urllib\nrequest.data and open(request.args)\nb = request.form\nopen(b); run(b); eval(b); run(b, shell=True)\n", "(", "", "x = 1\n" * 90_000]
    py = spark.createDataFrame([("s", f"{k}.py", t) for k, t in enumerate(texts)], FILE)
    f = A.facts(py)
    apart = (A.size_findings(py), A.call_findings(f), A.import_findings(f), A.flow_findings(f), A.platform_findings(f))
    fields = ("file", "severity", "category", "line", "code", "description")
    want = sorted(repr((k, *(r[c] for c in fields))) for k, x in enumerate(apart) for r in x.collect())
    got = A.python_findings(py, *A.PYTHON_GROUPS)
    assert sorted(repr((r["own"], *(r[c] for c in fields))) for r in got.collect()) == want and len(want) > 40


def test_a_recorded_scan_looks_at_each_file_once_for_a_scanner(spark, tmp_path, monkeypatch):
    from tessera.plans import scan as plans

    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    one = plans.Scanner("own", None, None, lambda f: f.select("scan_id", "path").mapInArrow(each, "scan_id string, path string").select("scan_id", F.col("path").alias("file"), F.lit("low").alias("severity"), F.lit("own").alias("category")))
    monkeypatch.setattr(plans, "SCANNERS", {"own": one})
    t = Tables(spark, f"file://{tmp_path}")
    at = F.lit("2024-01-01").cast("timestamp")
    t.save("whitelist", jobs.add_whitelist(t.load("whitelist"), "own", "manifest.json", "d", "known", at))
    files = spark.createDataFrame([r for r in SAMPLE if r[0] == "s1"], FILE)
    out = jobs.run_scan(t, files, spark.createDataFrame([], "scan_id string, score double"), at)
    assert seen.value == files.count()
    assert out["findings"].count() == files.count() - 1 and t.load("history").first()["findings_count"] == files.count() - 1


@pytest.mark.parametrize("name", ("full_scan", "scans_recorded", "size_guards"))
def test_scans_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    cols = want.columns
    assert sorted(repr(tuple(r[c] for c in cols)) for r in entry.queries()[name](spark, SF).collect()) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ("js_rules", "full_scan"))
def test_prose_that_is_a_script_by_chance_equals_sql(spark, tmp_path, name):
    """A component of documents that are in the language of scripts, empty or null, and one of prose."""
    texts = ("Eran. Eran. Eran. sch", "ouch | erzu", "Les, les, la", "word", "", "  \n", "https://example.org/x\nword", None)
    docs = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)] + [(500, "Of this and that.", "en", "web", 17)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/part.parquet").limit(2).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("part", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    cols = want.columns
    assert sorted(repr(tuple(r[c] for c in cols)) for r in entry.queries()[name](spark, str(tmp_path)).collect()) == sorted(map(repr, want.fetchall()))
