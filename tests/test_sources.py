"""Data sources of the engine: reports of any size, and batches of requests with answers by place."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import deps, feed_service, report_files, storage

FOUND = "scan_id string, seq long, severity string, category string, file string, line int, code string, description string"
SARIF = "runs array<struct<automationDetails:struct<id:string>,results:array<struct<ruleId:string,level:string,properties:struct<seq:bigint>>>,tool:struct<driver:struct<rules:array<struct<id:string,defaultConfiguration:struct<level:string>>>>>>>"


def some(spark, n):
    rng = random.Random(n)
    rows = [(f"s/{k % 3 if k % 3 else 0}", k, rng.choice(("critical", "high", "low")), rng.choice(("xss", "net_work")), f"f{k % 5}", None if k % 4 else k, "<c>", 'd & "e" ') for k in range(n)]
    return rows, spark.createDataFrame(rows, FOUND)


def test_a_large_scan_lies_in_several_whole_documents(spark, tmp_path):
    rows, found = some(spark, 700)
    scans = spark.createDataFrame([("s/0", "Zero <0>", "done"), ("s/1", "One", "done"), ("s/2", None, "done"), ("none", "N", "failed")], "id string, name string, status string")
    for kind in ("json", "sarif", "html"):
        report_files.write_reports(scans, found, f"file://{tmp_path}/{kind}", kind, rows_per_file=50)
    docs = [json.loads(p.read_text()) for f in report_files.report_folders(str(tmp_path / "json")) for p in (tmp_path / "json" / f.rpartition("/")[2]).iterdir() if p.suffix == ".json"]
    for s in ("s/0", "s/1", "s/2"):
        own = [d for d in docs if d["id"] == s]
        mine = [r for r in rows if r[0] == s]
        assert len(own) > 3 and max(len(d["findings"]) for d in own) <= 50
        assert sorted(x["seq"] for d in own for x in d["findings"]) == [r[1] for r in mine]
        assert {json.dumps(d["stats"]) for d in own} == {json.dumps({"critical": sum(r[2] == "critical" for r in mine), "high": sum(r[2] == "high" for r in mine), "total_findings": len(mine)})}
    assert [(d["findings"], d["status"], d["stats"]["high"]) for d in docs if d["id"] == "none"] == [([], "failed", 0)]
    got = report_files.read_documents(spark, f"file://{tmp_path}/sarif", SARIF).select(F.explode("runs").alias("r")).select("r.*").collect()
    level = {}
    for s, _, sev, cat, *_ in rows:
        level.setdefault((s, cat), "error" if sev in ("critical", "high") else "note")
    assert sum(len(r["results"]) for r in got) == 700
    for r in got:
        assert {(x["id"], x["defaultConfiguration"]["level"]) for x in r["tool"]["driver"]["rules"]} == {(c, level[r["automationDetails"]["id"], c]) for c in {x["ruleId"] for x in r["results"]}}
    page = next(p for f in report_files.report_folders(str(tmp_path / "html")) for p in (tmp_path / "html" / f.rpartition("/")[2]).glob("s_0*.html")).read_text()
    assert "Zero &lt;0&gt;" in page and "d &amp; &quot;e&quot;" in page and page.endswith("</table></body></html>")


def test_a_failed_write_leaves_nothing_that_counts(spark, tmp_path):
    _, found = some(spark, 60)
    scans = spark.createDataFrame([(f"s/{k}", "n", "done") for k in range(3)], "id string, name string, status string")
    bad = found.withColumn("code", F.when(F.col("seq") == 41, F.raise_error(F.lit("broken"))).otherwise(F.col("code")))
    with pytest.raises(Exception, match="broken"):
        report_files.write_reports(scans, bad, f"file://{tmp_path}/a")
    assert report_files.report_folders(f"file://{tmp_path}/a") == [] and report_files.read_documents(spark, f"file://{tmp_path}/a", "id string").count() == 0
    report_files.write_reports(scans, found, f"file://{tmp_path}/a")
    assert report_files.read_documents(spark, f"file://{tmp_path}/a", "id string, findings array<struct<seq:bigint>>").select(F.explode("findings")).count() == 60


def packages(spark, n):
    return spark.createDataFrame([("PyPI", f"Pack{k % 230}", f"1.{k % 2}", f"s{k % 9}") for k in range(n)], "ecosystem string, package string, version string, scan_id string")


def test_batches_equal_the_join(spark, tmp_path):
    need = packages(spark, 2000)
    feed = spark.createDataFrame([("PyPI", f"pACK{k}", f"1.{k % 2}", f"V-{k}-{j}", "CVSS:3.1/9.8") for k in range(0, 230, 3) for j in range(1 + k % 2)], "ecosystem string, package string, version string, vuln_id string, score string")
    at = f"file://{tmp_path}"
    feed_service.write_batches(need, f"{at}/ask")
    feed_service.answer_from(feed, f"{at}/ask", f"{at}/answers")
    got = feed_service.read_feed(spark, f"{at}/ask", f"{at}/answers")
    names = storage.files_in(f"{at}/ask")
    assert len(names) >= 3 and all(len(storage.read_text(f"{at}/ask/{n}").splitlines()) <= 100 for n in names)
    pick = lambda x: sorted(map(tuple, x.select("scan_id", "package", "version", "vuln_id", "severity").collect()))
    assert pick(deps.vulnerable(need, got)) == pick(deps.vulnerable(need, feed)) and got.where("error is not null").count() == 0


def test_a_failed_batch_is_told(spark, tmp_path):
    class Service:
        def many(self, name, requests):
            if name == "down":
                raise OSError("down")
            return [{"vulns": [{"id": "A", "severity": [{"type": "x"}, {"score": "9"}]}, {}]}, {}][: 1 if name == "short" else 2]

        def one(self, request):
            if request["package"] == "b":
                raise ValueError("none")
            return {"vulns": [{"id": "alone", "summary": "s"}]}

    ask = [{"ecosystem": "npm", "package": p, "version": "1.0"} for p in "ab"]
    rows = lambda name: [r[1:2] + r[3:] for r in feed_service.answered(Service(), name, ask)]
    assert rows("fine") == [("a", "A", "No description", "9", None), ("a", "UNKNOWN", "No description", "", None)]
    assert rows("short") == [*rows("fine"), ("b", None, None, None, "batch short: no answer at place 1")]
    assert rows("down") == [("a", "alone", "s", "", None), ("b", None, None, None, "batch down: OSError; alone: ValueError")]
    at = f"file://{tmp_path}"
    feed_service.write_batches(packages(spark, 5), f"{at}/ask")
    storage.write_text(f"{at}/answers/single/{feed_service.single('PyPI', 'pack1', '1.1')}", '{"vulns": [{"id": "X"}]}')
    got = feed_service.read_feed(spark, f"{at}/ask", f"{at}/answers").collect()
    assert {r["package"] for r in got if r["error"]} == {"pack0", "pack2", "pack3", "pack4"} and [r["vuln_id"] for r in got if not r["error"]] == ["X"]
    assert feed_service.read_feed(spark, f"{at}/nothing", f"{at}/answers").count() == 0


def test_findings_of_reports_are_computed_once(spark, tmp_path):
    from tessera.sources import report_files

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(f"s{k % 3}", k, "high", "xss", "a.js", k, "c", "d") for k in range(30)]
    schema = "scan_id string, seq long, severity string, category string, file string, line int, code string, description string"
    found = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    scans = spark.createDataFrame([(f"s{k}", "n", "done") for k in range(4)], "id string, name string, status string")
    report_files.write_reports(scans, found, f"file://{tmp_path}/r")
    assert seen.value == 30
    assert not [p for p in (tmp_path / "r").iterdir() if p.name.startswith("_findings")]
    got = report_files.read_documents(spark, f"file://{tmp_path}/r", "id string, findings array<struct<seq:bigint>>").collect()
    assert sorted((r["id"], len(r["findings"])) for r in got) == [("s0", 10), ("s1", 10), ("s2", 10), ("s3", 0)]


def test_files_of_several_readers_come_by_one_listing(spark, tmp_path):
    from tessera.sources import files

    for p in ("s1/a.py", "s1/tests/b.py", "s1/c.yaml", "s1/d.js", "s1/.git/e.yaml", "s1/.git/f.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = files.read_files(spark, str(tmp_path), ("python", "yaml"))
    apart = {r["path"] for k in ("python", "yaml") for r in files.read_files(spark, str(tmp_path), k).collect()}
    assert sorted(r["path"] for r in got.collect()) == sorted(apart) and {"a.py", "c.yaml"} <= apart and "tests/b.py" not in apart
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("relation") == 1
