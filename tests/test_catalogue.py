"""A part of the catalogue against its SQL, on the smallest tables, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = ("findings_merge", "findings_aggregate_noisy", "history_reputation", "history_baseline", "fp_diff", "scan_script_patterns", "deps_vulnerable", "watch_new_alerts")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    mine = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    theirs = sorted(repr(r) for r in db.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert mine == theirs and mine


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["scan_id", "file", "critical", "high", "total_findings"]


OVER_FILES = ("py_calls", "py_imports", "py_taint", "api_rules", "js_rules", "yaml_structural", "yaml_patterns", "yaml_includes", "deps_discover", "component_types", "component_manifests", "fp_extract", "code_context")


#: Over rows that vary, through files, services and functions of SQL.
VARIED = ("js_syntax", "yaml_lists", "report_files_json", "report_files_sarif", "deps_feed_batches", "files_landed", "jobs_changed_parts", "installed_due", "calls_by_table_function", "request_diffs", "request_intelligence", "review_replies")


@pytest.mark.parametrize("name", (*OVER_FILES, *VARIED, "report_sarif", "status_messages", "jobs_batch", "whitelist_add", "tables_round_trip", "context_budget"))
def test_rules_and_reports_equal_sql(spark, db, name):
    test_query_equals_sql(spark, db, name)


def test_every_query_has_sql():
    from tessera.plans import catalogue

    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_file_queries_read_whole_tables(spark, db):
    from tessera.plans.catalogue import SAMPLE, _files

    n_docs, n_parts = (db.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("documents", "part"))
    assert _files(spark, SF).count() == 3 * n_docs + (3 + len(SAMPLE)) * n_parts


def test_feed_and_whitelist_grow_with_part(spark):
    from tessera.plans import adapters as A

    large = SF.replace("0.001", "0.01")
    part = spark.read.parquet(f"{large}/part.parquet")
    assert A.make(spark, large, A.WHITELIST).count() == part.count()
    assert A.make(spark, large, A.FEED).select("package").distinct().count() == part.select("p_name").distinct().count()


def test_all_findings_are_reviews(spark):
    from tessera.plans import adapters as A

    blank = A.make(spark, SF, A.FINDINGS).where("seq % 11 = 0").count()
    got = entry.queries()["findings_llm_novel"](spark, SF)
    assert got.count() == blank and got.where("file <> ''").count() == 0  # all others have a static finding of the same file


@pytest.mark.parametrize("name", ("findings_llm_novel", "findings_whitelist_filter", "vuln_severity"))
def test_whole_shapes_equal_sql(spark, db, name):
    test_query_equals_sql(spark, db, name)


def test_rows_that_become_files_are_dealt_to_tasks(spark, monkeypatch):
    from tessera.plans import adapters as A
    from tessera.plans.catalogue import _files

    monkeypatch.setattr(A, "ROWS_PER_TASK", 20)
    for shape in (A.SCRIPTS, A.AUTOMATIONS, A.SIZED):
        assert A.make(spark, SF, shape).rdd.getNumPartitions() == 10  # 200 parts
    assert _files(spark, SF).rdd.getNumPartitions() >= 20


def test_files_are_grouped_without_their_content(spark):
    from tessera.sources import files

    x = spark.createDataFrame([("a", "hacs.json", '{"category": "Theme"}')], "scan_id string, path string, content string")
    for f in (files.component_types, files.manifests):
        plan = f(x)._jdf.queryExecution().sparkPlan().toString()
        assert "content" not in "".join(line for line in plan.splitlines() if "Sort" in line or "Aggregate" in line)


@pytest.mark.parametrize("name", ("report_files_sarif", "report_sarif"))
def test_a_result_is_opened_without_its_run(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    opened = [line for line in plan.splitlines() if "Generate" in line and "explode(" in line and "results" in line]
    assert opened and not [line for line in opened if "run#" in line]


def test_findings_under_review_are_joined_once(spark):
    plan = entry.queries()["findings_llm_novel"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "Window" not in plan
