"""What an application asks for, as functions from tables to rows: differences between scans, shared patterns, batches, the state of the system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import __version__
from tessera.functions.scalar import repository_url
from tessera.operators import history as hst
from tessera.sources.tables import Tables

#: Fields of the two last scans that a difference tells.
TOLD = ("score", "findings_count", "scanned_at")


def domain_diffs(fingerprints: DataFrame, history: DataFrame) -> DataFrame:
    """The last two fingerprints of each domain that has two, and its last two scans: what each list gained and lost, and scores, findings and times.

    A domain with fewer than two scans has nulls there; one with fewer than two fingerprints has no row.
    """
    w = Window.partitionBy("domain").orderBy(F.desc("scanned_at"), F.desc("id"))
    two = history.where("domain <> ''").select("domain", *TOLD, F.row_number().over(w).alias("n")).where("n <= 2")
    of = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    scans = two.groupBy(F.col("domain").alias("__d")).agg(F.count("*").alias("__n"), *(of(c, n).alias(f"{which}_{c}") for c in TOLD for which, n in (("old", 2), ("new", 1)))).where("__n = 2")
    diffs = hst.fingerprint_diffs(fingerprints.where("domain <> ''"))
    return diffs.join(scans, F.col("key") == F.col("__d"), "left").drop("__d", "__n").withColumnRenamed("key", "domain")


def domain_diff(fingerprints: DataFrame, history: DataFrame, domain: str) -> DataFrame:
    """domain_diffs of one domain; the filter reaches the tables."""
    own = F.col("domain") == domain
    return domain_diffs(fingerprints.where(own), history.where(own))


def intelligence(fingerprints: DataFrame, top: int = 20) -> DataFrame:
    """(kind, item, count, components): what components share or stand out by: hosts, imports, suspicious hosts, and sizes as components.

    For a size, item is the component, count its lines, and components says larger or smaller.
    """
    kinds = {"shared_domain": hst.shared_domains(fingerprints, top), "shared_import": hst.shared_imports(fingerprints, top), "suspicious_domain": hst.suspicious_hosts(fingerprints)}
    rows = [df.select(F.lit(k).alias("kind"), "item", "count", "components") for k, df in kinds.items()]
    sizes = hst.size_outliers(fingerprints)
    out = sizes.select(F.lit("size").alias("kind"), F.col("key").alias("item"), F.col("total_lines").cast("long").alias("count"), F.col("direction").alias("components"))
    for r in rows:
        out = out.unionByName(r)
    return out


def system_state(cached: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: version, reports, cached repositories with their megabytes (files: path, kind, length; a repository is the first folder below /repos), scans that run."""
    repo = F.when(F.col("kind") == "repos", F.regexp_extract("path", "^/?repos/([^/]+)", 1))
    x = cached.agg(
        F.count_if(F.col("kind") == "reports").alias("reports"), F.count_distinct(repo).alias("repos_cached"),
        F.bround(F.coalesce(F.sum(F.when(F.col("kind") == "repos", F.col("length"))), F.lit(0)) / (1024 * 1024), 1).alias("cache_size_mb"),
    )
    running = jobs.agg(F.count_if(F.col("status") == "running").alias("running"))
    return x.select(F.lit(__version__).alias("version"), "*", F.lit(1).alias("one")).join(F.broadcast(running.select(F.lit(1).alias("one"), "running")), "one").drop("one")


def batch_jobs(repos: DataFrame, batch_id: str, at: Column) -> DataFrame:
    """The jobs of a batch of repositories (url, name): a name without scheme is one of the usual host; a repository named twice is one job."""
    url = repository_url(F.trim("url"))
    x = repos.where("trim(url) <> ''").groupBy(url.alias("repo_url")).agg(F.max(F.coalesce("name", F.lit(""))).alias("name"))
    none = lambda kind: F.lit(None).cast(kind)
    job = F.left(F.sha2(F.concat_ws("|", F.lit(batch_id), "repo_url").cast("binary"), 256), F.lit(12))
    return x.select(job.alias("id"), "name", "repo_url", F.lit(batch_id).alias("batch_id"), F.lit("running").alias("status"), at.alias("created_at"), none("timestamp").alias("completed_at"), none("string").alias("error"))


def start_batch(tables: Tables, repos: DataFrame, batch_id: str, at: Column) -> DataFrame:
    """Records the jobs of a batch, and returns its status; a ValueError without repositories."""
    rows = batch_jobs(repos, batch_id, at)
    if rows.isEmpty():
        raise ValueError("no repositories")
    tables.update("jobs", rows, "id")
    return hst.batch(tables.load("jobs"), batch_id)
