import random
from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import history as H
from tessera.streaming import watch

AT = datetime(2024, 1, 1)


def hist(spark, scores):
    return spark.createDataFrame([(i, "d", "u", AT, s) for i, s in enumerate(scores)], "id long, domain string, repo_url string, scanned_at timestamp, score double")


def test_trend_and_average(spark):
    r = H.reputation(hist(spark, [5.0, 7.0, None, 8.0])).first()
    assert (r["scan_count"], r["avg_score"], r["latest_score"], r["trend"]) == (4, 6.7, 8.0, "improving")
    assert H.reputation(hist(spark, [8.0, 8.5])).first()["avg_score"] == 8.2  # half to even
    assert H.reputation(hist(spark, [9.0, 8.5, 8.0])).first()["trend"] == "declining"
    assert H.reputation(hist(spark, [None])).first()["trend"] == "stable"
    assert H.reputation(hist(spark, [5.0, 5.5])).first()["trend"] == "stable"


def test_baseline_percentile_is_an_index(spark):
    rows = spark.range(20).select(F.col("id"), F.lit("d").alias("domain"), F.col("id").cast("double").alias("score"), *(F.col("id").alias(m) for m in H.METRICS[1:]))
    b = {r["metric"]: r for r in H.baseline(rows).collect()}
    assert b["score"]["percentile_95"] == 19.0 and b["score"]["mean"] == 9.5 and b["score"]["stddev"] == 5.77 and len(b) == 6
    assert H.baseline(rows.limit(9)).count() == 0
    far = spark.createDataFrame([(1, "d", 100.0, 1, 1, 1)], "id long, domain string, score double, findings_count long, total_lines long, network_domain_count long")
    got = H.deviations(far, H.baseline(rows)).collect()
    assert [(r["metric"], r["direction"]) for r in got] == [("score", "above")]


def test_value_at_a_share_is_exact_however_bad_the_sketch(spark, monkeypatch):
    rng = random.Random(4)
    values = {"ties": [rng.choice((1.0, 2.0, 3.0)) for _ in range(900)], "wide": [rng.expovariate(1) * 10 ** rng.randrange(9) for _ in range(1300)], "one": [5.0], "hot": [7.0] * 800 + [float(k) for k in range(100)]}
    long = spark.createDataFrame([(m, v) for m, x in values.items() for v in [*x, None]], "metric string, v double").repartition(7)
    for around, accuracy in ((0.0005, 10_000), (0.0, 3), (0.2, 2)):
        monkeypatch.setattr(H, "AROUND", around)
        monkeypatch.setattr(H, "ACCURACY", accuracy)
        for share in (0.95, 0.5, 0.0):
            got = {r["metric"]: r["at_share"] for r in H.value_at(long, share).collect()}
            assert got == {m: sorted(x)[min(int(share * len(x)), len(x) - 1)] for m, x in values.items()}


def test_fingerprint_diff(spark):
    rows = [(1, "x", "u", ["a", "b"], [], ["h"], 100, 1), (2, "x", "u", ["b", "c"], [], ["h"], 200, 2), (3, "", "u2", ["a"], [], [], 5, 1)]
    f = spark.createDataFrame(rows, "id long, domain string, repo_url string, imports array<string>, ha_apis array<string>, network_domains array<string>, total_lines long, created_at long")
    f = f.withColumn("fingerprint_hash", H.fingerprint_hash("imports", "ha_apis", "network_domains"))
    d = H.fingerprint_diffs(f).collect()
    assert len(d) == 1 and d[0]["imports_added"] == ["c"] and d[0]["imports_removed"] == ["a"] and d[0]["change_pct"] == 100.0 and d[0]["changed"]
    assert H.total_tracked(f).first()[0] == 2


def test_batches_and_jobs(spark):
    j = spark.createDataFrame([(1, "b", "done"), (2, "b", "failed"), (3, "c", "running"), (4, "c", "done")], "id long, batch_id string, status string")
    got = {r["batch_id"]: (r["completed"], r["failed"], r["status"]) for r in H.batch_status(j).collect()}
    assert got == {"b": (1, 1, "done"), "c": (1, 0, "running")}
    assert H.recovered(j).where("status = 'running'").count() == 0
    assert {r["id"]: r["status"] for r in H.upsert(j, spark.createDataFrame([(3, "c", "done"), (9, "z", "new")], j.schema), "id").collect()}[3] == "done"


def test_watch_in_batch_and_as_a_stream(spark, tmp_path):
    rows = [("c", AT, 1, ["a", "b"]), ("c", datetime(2024, 1, 2), 2, ["b", "c"]), ("c", datetime(2024, 1, 3), 3, []), ("c", datetime(2024, 1, 4), 4, ["b"]), ("d", AT, 5, None)]
    schema = "component string, checked_at timestamp, id long, alerts array<string>"
    checks = spark.createDataFrame(rows, schema)
    want = {(1, "a"), (1, "b"), (2, "c"), (4, "b")}
    assert {(r["id"], r["alert"]) for r in watch.new_alerts(checks).collect()} == want
    src = str(tmp_path / "in")
    checks.where("id <= 2").coalesce(1).write.mode("append").parquet(src)
    got = []
    s = watch.Scheduler(spark)
    run = lambda: s.start("watch", watch.watch_alerts(spark.readStream.schema(schema).parquet(src)), lambda df, _: got.extend((r["id"], r["alert"]) for r in df.collect()), str(tmp_path / "state")).awaitTermination()
    run()
    checks.where("id > 2").coalesce(1).write.mode("append").parquet(src)
    run()  # state outlives the query
    assert set(got) == want
    s.stop("watch")
    assert s.status() == {}
