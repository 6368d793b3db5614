"""State over time: alerts of streams, tables in parts, scanners and table functions by name, installed components."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import table_functions
from tessera.plans import jobs
from tessera.plans import scan as plan
from tessera.plans.expected import EXPECTED
from tessera.plans.sample import SAMPLE
from tessera.sources import files, storage
from tessera.sources.tables import Tables
from tessera.streaming import watch

CHECK = "component string, checked_at timestamp, id long, alerts array<string>"
AT = datetime(2024, 1, 1)


def run_watch(spark, src, state, out, **how):
    """All there is, a file in a micro-batch; with state that expires, one micro-batch, as batches without data go on for ever then."""
    stream = spark.readStream.schema(CHECK).option("maxFilesPerTrigger", 1).parquet(src)
    w = watch.watch_alerts(stream, **how).writeStream.option("checkpointLocation", state).format("parquet").option("path", out)
    q = (w.trigger(once=True) if how else w.trigger(availableNow=True)).start()
    assert q.awaitTermination(90)


def test_alerts_over_micro_batches_equal_the_batch_form(spark, tmp_path):
    src, state, out = (f"{tmp_path}/{x}" for x in ("src", "state", "out"))
    rows = [(f"c{k % 3}", AT + timedelta(hours=k), k, None if k % 11 == 5 else [f"a{k % 4}", f"b{k // 6}", "x" * 90 + str(k)][: 1 + k % 3]) for k in range(48)]
    for k in range(4):
        spark.createDataFrame(rows[k * 12 : k * 12 + 12], CHECK).coalesce(1).write.mode("append").parquet(src)
        os.utime(max((os.path.join(src, f) for f in os.listdir(src) if f.endswith(".parquet")), key=os.path.getctime), (1_700_000_000 + k, 1_700_000_000 + k))
        if k in (1, 3):  # stops and starts again: state comes from the checkpoint
            run_watch(spark, src, state, out)
    want = watch.new_alerts(spark.createDataFrame(rows, CHECK))
    pick = lambda df: sorted((r["component"], r["id"], r["alert"]) for r in df.collect())
    assert pick(spark.read.parquet(out)) == pick(want) and want.count() > 30


def test_alerts_are_forgotten(spark, tmp_path):
    src, state, out = (f"{tmp_path}/{x}" for x in ("src", "state", "out"))
    for k in range(2):
        spark.createDataFrame([("c", AT + timedelta(hours=k), k, ["a"])], CHECK).coalesce(1).write.mode("append").parquet(src)
        run_watch(spark, src, state, out, forget_after=1)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1]


def job(k, day, status="running"):
    return (f"j{k}", "n", "u", "b", status, datetime(2024, 1, day) if day else None, None, None)


def test_a_change_writes_one_part(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}", parts={"jobs": "coalesce(date_format(created_at, 'yyyy-MM-dd'), 'none')"})
    rows = lambda *x: spark.createDataFrame(list(x), t.schemas["jobs"])
    assert t.load("jobs").count() == 0
    t.save("jobs", rows(*(job(k, 1 + k % 3) for k in range(9)), job(9, None)))
    names = lambda: {p.relative_to(tmp_path).as_posix() for p in tmp_path.glob("jobs/v*/part=*") if any(p.iterdir())}
    files_of = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("jobs/v1/part=*/*.parquet")}
    first = files_of()
    reader = t.load("jobs")
    assert t.update("jobs", rows(job(1, 2, "done")), "id") == ["2024-01-02"]
    assert names() == {"jobs/v1/part=2024-01-01", "jobs/v1/part=2024-01-02", "jobs/v1/part=2024-01-03", "jobs/v1/part=none", "jobs/v2/part=2024-01-02"} and files_of() == first
    assert reader.where("status = 'running'").count() == 10  # one that began before sees what was there
    assert sorted(r["id"] for r in t.load("jobs").where("status = 'done'").collect()) == ["j1"] and t.load("jobs").count() == 10
    assert t.update("jobs", rows(job(1, 3, "done"), job(77, 8)), "id") == ["2024-01-02", "2024-01-03", "2024-01-08"]  # from one day to another
    assert "jobs/v1/part=2024-01-02" not in names() and t.load("jobs").count() == 11
    t.append("jobs", rows(job(78, 8), job(79, None)))
    assert t.load("jobs").count() == 13 and t.load("jobs").where("id = 'j1'").count() == 1
    assert t.update("jobs", rows(job(1, 1, "failed")), "id") == ["2024-01-01", "2024-01-03"]


def test_a_failed_change_is_not_seen(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}")
    t.save("jobs", spark.createDataFrame([job(1, 1), job(2, 2)], t.schemas["jobs"]))
    bad = spark.createDataFrame([job(1, 1, "done"), job(2, 2, "done")], t.schemas["jobs"]).withColumn("error", F.when(F.col("id") == "j2", F.raise_error(F.lit("broken"))).cast("string"))
    with pytest.raises(Exception, match="broken"):
        t.update("jobs", bad, "id")
    assert {r["status"] for r in t.load("jobs").collect()} == {"running"}
    t.update("jobs", spark.createDataFrame([job(2, 2, "done")], t.schemas["jobs"]), "id")
    assert {(r["id"], r["status"]) for r in t.load("jobs").collect()} == {("j1", "running"), ("j2", "done")}


def test_a_scanner_takes_part_by_name(spark):
    def notes(text):
        return text.where("content like '%TODO%'").select("scan_id", F.lit("low").alias("severity"), F.lit("todo").alias("category"), F.col("path").alias("file"), F.lit("has a note").alias("description"))

    f = spark.createDataFrame([("card", "a.js", "a(); // TODO"), ("both", "a.js", "b(); // TODO"), ("both", "b.py", "# TODO")], "scan_id string, path string, content string")
    plan.add_scanner(plan.Scanner("notes", "js", ("card",), notes))
    try:
        got = plan.scan(f).where("category = 'todo'").collect()
        assert [(r["scan_id"], r["file"], r["description"]) for r in got] == [("card", "a.js", "has a note")]
        assert plan.scan(f, scanners={"notes": plan.Scanner("notes", None, None, notes)}).count() == 3
    finally:
        del plan.SCANNERS["notes"]
    assert plan.scan(f).where("category = 'todo'").count() == 0


def test_facts_by_lateral_join(spark):
    table_functions.register(spark)
    f = files.files_for(spark.createDataFrame([*SAMPLE, ("n", "x.py", None), ("n", "y.py", "x = 1\n" * 100_000)], "scan_id string, path string, content string"), "python")
    got = spark.sql("SELECT f.scan_id, f.path, r.severity, r.category, x.line FROM {f} f, LATERAL python_facts(f.content) x JOIN {rules} r ON r.kind = x.kind AND r.name = x.name WHERE r.language = 'python' AND r.kind = 'call'", f=f, rules=table_functions.rule_table(spark))
    assert sorted(map(tuple, got.collect())) == sorted(r[:5] for r in EXPECTED["py_calls"])
    assert [tuple(r) for r in spark.sql("SELECT * FROM script_facts('`x`; eval(x)')").collect()] == [("call", "eval", 1)]
    assert [r["category"] for r in spark.sql("SELECT * FROM yaml_facts('- action: {service_template: x}')").collect()] == ["automation_injection"]
    assert spark.sql("SELECT * FROM script_facts(NULL)").count() == 0


def test_only_files_of_a_reader_are_opened(spark, tmp_path):
    tree = [("s1", "a.py", b"x\xff\xc3\xa9\n"), ("s1", "tests/b.py", b"y"), ("s1", "deep/er/c.yaml", b"c: 1"), ("s2", "d.py", b"z"), ("s2", "e.bin", b"\0\1")]
    assert files.land_files(spark.createDataFrame(tree, "scan_id string, path string, content binary"), f"file://{tmp_path}").selectExpr("sum(bytes)").first()[0] == sum(len(c) for _, _, c in tree)
    os.chmod(tmp_path / "s2/e.bin", 0)
    paths = lambda *a, **k: sorted((r["scan_id"], r["path"]) for r in files.read_files(spark, f"file://{tmp_path}", *a, **k).collect())
    assert paths("python") == [("s1", "a.py"), ("s2", "d.py")] and paths("yaml") == [("s1", "deep/er/c.yaml")]
    assert paths("python", scans=["s2"]) == [("s2", "d.py")]
    assert files.read_files(spark, f"file://{tmp_path}", "python").where("path = 'a.py'").first()["content"] == "x�é\n"
    for bad in ("../x", "a//b", "."):
        with pytest.raises(Exception, match="below its folder"):
            files.land_files(spark.createDataFrame([("s", bad, b"")], "scan_id string, path string, content binary"), f"file://{tmp_path}").count()


def test_installed_components_are_scanned_when_due(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    storage.write_text(f"{tmp_path}/hacs/list.json", '{"domain": "x", "name": "X", "full_name": "o/x", "installed_version": "1", "installed": true}\n{"domain": "y", "name": "Y", "repository": "http://h/y", "installed_version": "2", "installed": true}\n{"domain": "z", "installed": false}\n')
    installed = files.installed_components(spark, f"{tmp_path}/hacs")
    tree = [(d, f"custom_components/{d}/{n}", c) for d in "xyz" for n, c in (("manifest.json", f'{{"domain": "{d}", "version": "1"}}'), ("__init__.py", "eval(x)\n"))]
    f = spark.createDataFrame(tree, "scan_id string, path string, content string")
    at = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    due = jobs.due_components(installed, t.load("history"), at(1))
    assert sorted((r["domain"], r["url"], r["why"]) for r in due.collect()) == [("x", "https://github.com/o/x.git", "never"), ("y", "http://h/y", "never")]
    assert {r["scan_id"] for r in jobs.rescan_installed(t, installed, f, at(1))["findings"].collect()} == {"x", "y"}
    assert [(r["domain"], r["why"]) for r in jobs.due_components(installed, t.load("history"), at(1)).collect()] == [("y", "version")]
    assert {(r["domain"], r["why"]) for r in jobs.due_components(installed, t.load("history"), at(2)).collect()} == {("x", "age"), ("y", "version")}
    assert jobs.rescan_installed(t, installed.where("domain = 'x'"), f, at(1)) is None
    assert [r["batch_id"] for r in t.load("jobs").collect()] == ["scheduled"] * 2


def test_requests_over_reports_and_lists(spark, tmp_path):
    from tessera.plans import requests

    found = "array<struct<severity:string,category:string,file:string,line:int,code:string,description:string>>"
    reports = spark.createDataFrame([("r", [("low", "a", "f", 1, "", ""), ("critical", "b", "f", 2, "", ""), ("odd", "c", "f", 3, "", "")]), ("s", [])], f"id string, findings {found}")
    assert [r["severity"] for r in jobs.report_findings(reports, "r").collect()] == ["critical", "low", "odd"]
    assert jobs.report_findings(reports, "s").count() == 0 and jobs.report(reports, "none").count() == 0
    storage.write_text(f"{tmp_path}/lists/integration", '["o/a",\n "o/b"]')
    assert sorted(r["full_name"] for r in files.default_repositories(spark, f"{tmp_path}/lists", "integration").collect()) == ["o/a", "o/b"]
    assert files.default_repositories(spark, f"{tmp_path}/lists", "other").count() == 0
    t = Tables(spark, f"file://{tmp_path}/t")
    repos = spark.createDataFrame([("o/a", "A"), (" o/a ", "B"), ("http://h/x", None), ("", "none")], "url string, name string")
    got = requests.start_batch(t, repos, "b9", F.lit("2024-01-01").cast("timestamp")).first()
    assert (got["total"], got["completed"], got["status"]) == (2, 0, "running")
    assert sorted(r["repo_url"] for r in t.load("jobs").collect()) == ["http://h/x", "https://github.com/o/a.git"]
    with pytest.raises(ValueError, match="no repositories"):
        requests.start_batch(t, repos.where("url = ''"), "b", F.lit("2024-01-01").cast("timestamp"))


def test_arrivals_are_scanned_as_they_come(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    f = "scan_id string, path string, content string"
    spark.createDataFrame([("a", "custom_components/a/__init__.py", "eval(x)\n")], f).write.parquet(f"{tmp_path}/in")
    s = watch.Scheduler(spark)
    q = s.start("scan", spark.readStream.schema(f).parquet(f"{tmp_path}/in"), jobs.rescan(t, lambda: F.lit("2024-01-01").cast("timestamp")), f"{tmp_path}/state")
    assert q.awaitTermination(150)
    assert [(r["id"], r["status"], r["batch_id"]) for r in t.load("jobs").collect()] == [("a", "done", "scheduled")] and t.load("history").first()["findings_count"] == 1
