"""Operators over scan history, jobs and fingerprints: a windowed pass each, whatever the number of components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Metrics of the baseline; those that alerts look at.
METRICS = ("score", "findings_count", "total_lines", "py_files", "js_files", "network_domain_count")
WATCHED = ("score", "findings_count", "total_lines", "network_domain_count")


# Scans of a component: domain, repo_url, id, scanned_at, score (nullable), ...


def reputation(history: DataFrame) -> DataFrame:
    """(domain, scan_count, avg_score, latest_score, trend): all scans count, scores are those that are there. avg is half-even at one place.

    The trend is that of the last three scores: by more than 0.5 up or down from the first to the last of them, else stable; fewer than
    two are stable. Only those three are held for a domain, whatever the number of its scans.
    """
    w = Window.partitionBy("domain").orderBy(F.col("scanned_at").desc(), F.col("id").desc())
    last = history.where("score is not null").select("domain", "score", F.row_number().over(w).alias("n")).where("n <= 3")
    last = last.groupBy("domain").agg(F.max_by("score", F.when(F.col("n") == 1, F.col("n"))).alias("latest_score"), F.max_by("score", "n").alias("oldest"))
    d = F.col("latest_score") - F.col("oldest")
    trend = F.when(d > 0.5, "improving").when(d < -0.5, "declining").otherwise("stable")
    x = history.groupBy("domain").agg(F.count("*").alias("scan_count"), F.bround(F.avg("score"), 1).alias("avg_score"))
    return x.join(last, "domain", "left").select("domain", "scan_count", "avg_score", "latest_score", trend.alias("trend"))


def all_reputations(history: DataFrame) -> DataFrame:
    """The reputation of each (domain, repo_url) with a domain; it is that of the domain."""
    keys = history.where("domain <> ''").select("domain", "repo_url").distinct()
    return keys.join(reputation(history.where("domain <> ''")), "domain")


def timeline(history: DataFrame) -> DataFrame:
    """Scans with their number in the component's order of time; ties by id."""
    return history.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("scanned_at", "id")))


def score_delta(history: DataFrame) -> DataFrame:
    """(domain, latest, previous, delta) of the last two scans; null where a score is missing, no row with one scan."""
    w = Window.partitionBy("domain").orderBy(F.col("scanned_at").desc(), F.col("id").desc())
    two = history.select("domain", "score", F.row_number().over(w).alias("n")).where("n <= 2")
    x = two.groupBy("domain").agg(F.max(F.when(F.col("n") == 1, F.col("score"))).alias("latest"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("previous"), F.count("*").alias("c"))
    return x.where("c = 2").select("domain", "latest", "previous", F.bround(F.col("latest") - F.col("previous"), 1).alias("delta"))


#: How far around the rank that is looked for values are taken, and how exact the sketch is that finds where they lie.
AROUND, ACCURACY = 0.0005, 10_000


def value_at(long: DataFrame, share: float) -> DataFrame:
    """(metric, at_share) of rows (metric, v): the value at index min(int(share * n), n - 1) in order of size, of those that aren't null.

    A sketch brackets the rank, one pass counts what lies below and up to the bracket, and only distinct values inside it are put in
    order: a few in a thousand. If the sketch was off, the bracket is opened to that side, so the value is exact in any case.
    """
    long = long.where("v is not null")
    sketch = long.groupBy("metric").agg(F.percentile_approx("v", [max(0.0, share - AROUND), min(1.0, share + AROUND)], ACCURACY).alias("b"), F.count("*").alias("n"))
    at = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    x = long.join(F.broadcast(sketch.select("metric", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"), at.alias("at"))), "metric")  # a row a metric
    seen = x.groupBy("metric", "lo", "hi", "at").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(F.col("v") <= F.col("hi")).alias("upto"))
    low, high = F.col("at") < F.col("below"), F.col("at") >= F.col("upto")
    bracket = seen.select("metric", F.when(~low, F.col("lo")).alias("lo"), F.when(~high, F.col("hi")).alias("hi"), "at", F.when(low, 0).otherwise(F.col("below")).alias("below"))
    x = long.join(F.broadcast(bracket.select("metric", "lo", "hi", "at", "below")), "metric").where("(lo is null or v >= lo) and (hi is null or v <= hi)")
    inside = x.groupBy("metric", "v", "at", "below").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy("metric").orderBy("v"))
    return inside.withColumn("upto", upto).where(F.col("upto") > F.col("at")).groupBy("metric").agg(F.min("v").alias("at_share"))


def baseline(history: DataFrame, least: int = 10) -> DataFrame:
    """(metric, mean, stddev, percentile_95, sample_count) over scans with a score, if there are `least`.

    Population deviation; both rounded half-even to 2 places. The percentile is the value at index min(int(0.95 n), n - 1) in order of size,
    selected without ordering all values of a metric.
    """
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in METRICS)
    long = history.where("score is not null").select(F.expr(f"stack({len(METRICS)}, {pairs}) as (metric, v)"))
    stats = long.groupBy("metric").agg(F.bround(F.avg("v"), 2).alias("mean"), F.bround(F.stddev_pop("v"), 2).alias("stddev"), F.count("*").alias("sample_count"))
    p = value_at(long, 0.95).withColumnRenamed("at_share", "percentile_95")
    return stats.join(p, "metric").where(F.col("sample_count") >= least).select("metric", "mean", "stddev", "percentile_95", "sample_count")


def deviations(scans: DataFrame, base: DataFrame, above: float = 2.0) -> DataFrame:
    """Alerts of scans whose metrics lie more than `above` deviations from the mean; base has a row for each of a few metrics."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in WATCHED)
    long = scans.select("id", "domain", F.expr(f"stack({len(WATCHED)}, {pairs}) as (metric, value)")).where("value is not null")
    b = F.broadcast(base.where(F.col("stddev") > 0).select("metric", "mean", "stddev"))
    z = F.bround(F.abs(F.col("value") - F.col("mean")) / F.col("stddev"), 1)
    raw = F.abs(F.col("value") - F.col("mean")) / F.col("stddev")
    return long.join(b, "metric").where(raw > above).select("id", "domain", "metric", "value", "mean", "stddev", z.alias("z_score"), F.when(F.col("value") > F.col("mean"), "above").otherwise("below").alias("direction"))


# Fingerprints: id, domain, repo_url, fingerprint_hash, imports, ha_apis, network_domains, total_lines, created_at

LISTS = ("imports", "ha_apis", "network_domains")


def component_key():
    """A component is named by its domain, without one by its repository."""
    return F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.col("repo_url"))


def fingerprint_hash(*lists):
    """16 hex digits over the sorted lists; sizes of files don't count."""
    canon = F.concat_ws("\n", *(F.array_join(F.array_sort(x), ",") for x in lists))
    return F.left(F.sha2(canon.cast("binary"), 256), F.lit(16))


def latest_fingerprints(fps: DataFrame, n: int = 1) -> DataFrame:
    """The newest n of each component, as key and rows with place (1: newest)."""
    w = Window.partitionBy("key").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return fps.withColumn("key", component_key()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def fingerprint_diffs(fps: DataFrame) -> DataFrame:
    """For each component with two fingerprints or more: what the newest adds to and removes from each list, and the size if it changed by over 10 %."""
    two = latest_fingerprints(fps, 2)
    old = {c: F.max_by(c, F.when(F.col("place") == 2, F.col("place"))) for c in (*LISTS, "total_lines", "fingerprint_hash")}
    new = {c: F.max_by(c, F.when(F.col("place") == 1, F.col("place"))) for c in (*LISTS, "total_lines", "fingerprint_hash")}
    x = two.groupBy("key").agg(F.count("*").alias("c"), *(v.alias(f"old_{c}") for c, v in old.items()), *(v.alias(f"new_{c}") for c, v in new.items())).where("c = 2")
    cols = [F.array_sort(F.array_except(f"{a}_{c}", f"{b}_{c}")).alias(f"{c}_{name}") for c in LISTS for name, a, b in (("added", "new", "old"), ("removed", "old", "new"))]
    pct = F.bround((F.col("new_total_lines") - F.col("old_total_lines")) / F.col("old_total_lines") * 100, 1)
    both = (F.col("old_total_lines") > 0) & (F.col("new_total_lines") > 0)
    size = F.when(both & (F.abs(pct) > 10), pct)
    return x.select("key", *cols, "old_total_lines", "new_total_lines", F.when(both, size).alias("change_pct"), (F.col("old_fingerprint_hash") != F.col("new_fingerprint_hash")).alias("changed"), "old_fingerprint_hash", "new_fingerprint_hash")


def changed_components(fps: DataFrame) -> DataFrame:
    return fingerprint_diffs(fps).where("changed")


def total_tracked(fps: DataFrame) -> DataFrame:
    return fps.select(component_key().alias("key")).agg(F.count_distinct("key").alias("total_tracked"))


def _shared(latest: DataFrame, column: str, least: int, top: int | None) -> DataFrame:
    """(item, count, components): items are counted, the most frequent are picked, and only their components are listed."""
    rows = latest.select("key", F.explode(F.array_distinct(column)).alias("item"))
    counts = rows.groupBy("item").agg(F.count("*").alias("count")).where(F.col("count") >= least)
    if top:
        counts = F.broadcast(counts.orderBy(F.desc("count"), "item").limit(top))
    out = rows.join(counts, "item").groupBy("item", "count").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("components"))
    return out.orderBy(F.desc("count"), "item") if top else out


def shared_domains(fps: DataFrame, top: int = 20) -> DataFrame:
    return _shared(latest_fingerprints(fps), "network_domains", 2, top)


#: Imports that every component has, and hosts that few should talk to.
COMMON_IMPORTS = (
    "abc",
    "aiohttp",
    "argparse",
    "asyncio",
    "base64",
    "collections",
    "configparser",
    "contextlib",
    "copy",
    "dataclasses",
    "datetime",
    "enum",
    "functools",
    "hashlib",
    "homeassistant",
    "http",
    "io",
    "itertools",
    "json",
    "logging",
    "math",
    "multiprocessing",
    "os",
    "pathlib",
    "re",
    "shutil",
    "socket",
    "ssl",
    "string",
    "struct",
    "subprocess",
    "sys",
    "tempfile",
    "textwrap",
    "threading",
    "time",
    "typing",
    "unittest",
    "urllib",
    "uuid",
    "voluptuous",
)
SUSPICIOUS_HOSTS = ("hastebin.com", "ngrok.io", "pastebin.com", "pipedream.com", "requestbin.com", "transfer.sh", "webhook.site")


def shared_imports(fps: DataFrame, top: int = 20) -> DataFrame:
    latest = latest_fingerprints(fps).withColumn("imports", F.filter("imports", lambda x: ~x.isin(*COMMON_IMPORTS)))
    return _shared(latest, "imports", 2, top)


def suspicious_hosts(fps: DataFrame) -> DataFrame:
    hit = lambda x: F.forall(F.array(*map(F.lit, SUSPICIOUS_HOSTS)), lambda s: ~F.contains(x, s))
    latest = latest_fingerprints(fps).withColumn("network_domains", F.filter("network_domains", lambda x: ~hit(x)))
    return _shared(latest, "network_domains", 1, None)


def size_outliers(fps: DataFrame) -> DataFrame:
    """Components with over 3 times, or under a tenth of, the mean of the line counts that are positive; from 3 components on."""
    latest = latest_fingerprints(fps).select("key", "total_lines")
    mean = latest.agg(F.avg(F.when(F.col("total_lines") > 0, F.col("total_lines"))).alias("mean"), F.count("*").alias("n"))
    ratio = F.col("total_lines") / F.col("mean")
    one = F.lit(1).alias("one")
    x = latest.select("*", one).join(F.broadcast(mean.select("*", one)), "one").where("n >= 3 and total_lines > 0")
    return x.where((ratio > 3) | (ratio < 0.1)).select("key", "total_lines", F.bround("mean", 0).alias("avg_lines"), F.bround(ratio, 2).alias("ratio"), F.when(ratio > 3, "larger").otherwise("smaller").alias("direction"))


# Jobs: id, batch_id, status, created_at, completed_at


def upsert(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """table with rows put in: of equal keys, the row of `rows` stays. Both have the same columns."""
    return table.join(rows.select(*(F.col(k).alias(f"__{k}") for k in key)).distinct(), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "left_anti").unionByName(rows)


def with_status(jobs: DataFrame, ids: DataFrame, status: str, at) -> DataFrame:
    """jobs with the status of some (id) set; completed_at too, if it is an end."""
    hit = F.col("__id").isNotNull()
    out = jobs.join(ids.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left")
    done = hit & F.lit(status in ("done", "failed"))
    return out.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "completed_at": F.when(done, at).otherwise(F.col("completed_at"))}).drop("__id")


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'running'").orderBy(F.desc("created_at"), F.desc("id"))


def retained(jobs: DataFrame, cutoff) -> DataFrame:
    """Jobs but old ones that don't run any more."""
    return jobs.where(~((F.col("created_at") < cutoff) & (F.col("status") != "running")))


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a crash: those that ran have failed."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


def scans_total(jobs: DataFrame) -> DataFrame:
    """(scans_total): jobs that are done; none is 0."""
    return jobs.agg(F.count_if(F.col("status") == "done").alias("scans_total"))


def batches(jobs: DataFrame) -> DataFrame:
    """batch_status with created_at, that of the first job."""
    return batch_status(jobs).join(jobs.where("batch_id is not null").groupBy("batch_id").agg(F.min("created_at").alias("created_at")), "batch_id")


def batch(jobs: DataFrame, batch_id: str) -> DataFrame:
    """One batch by its id; no row if there is none."""
    return batches(jobs.where(F.col("batch_id") == batch_id))


def active_batches(jobs: DataFrame) -> DataFrame:
    """Batches that run, newest first."""
    return batches(jobs).where("status = 'running'").orderBy(F.desc("created_at"), "batch_id")


def batch_status(jobs: DataFrame) -> DataFrame:
    """(batch_id, total, completed, failed, status), counted from the jobs' own status."""
    s = F.col("status")
    x = jobs.where("batch_id is not null").groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(s == "done").alias("completed"), F.count_if(s == "failed").alias("failed"))
    return x.withColumn("status", F.when(F.col("completed") + F.col("failed") >= F.col("total"), "done").otherwise("running"))


def cache_evictions(repos: DataFrame, now, days: int = 14, most: int = 50) -> DataFrame:
    """(path) of cached repositories to delete: those older than `days`, and the oldest beyond `most`."""
    fresh = F.col("mtime") >= now - F.expr(f"INTERVAL {days} DAYS")
    keep = repos.where(fresh).orderBy(F.desc("mtime"), "path").limit(most).select(F.col("path").alias("__p"))
    return repos.join(keep, F.col("path") == F.col("__p"), "left_anti").select("path")


def system_info(files: DataFrame) -> DataFrame:
    """(kind, files, megabytes) of a listing (kind, length)."""
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.bround(F.sum("length") / (1024 * 1024), 1).alias("megabytes"))
