"""Scans as jobs over the engine's tables, and the requests of an application as functions that return DataFrames.

Nothing here serves requests or fetches: files, feeds and review replies come in as DataFrames, results go out as DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import finding_hash, repository_url
from tessera.operators import findings as fnd
from tessera.operators import history as hst
from tessera.operators.fingerprints import fingerprints
from tessera.plans.scan import scan
from tessera.sources.files import manifests
from tessera.sources.tables import Tables


def learned(files: DataFrame, found: DataFrame, scores: DataFrame, at: Column) -> DataFrame:
    """What is learned of scanned files, a row for each scan: scan_id becomes the id; scores: scan_id, score (null or absent: none)."""
    n = found.groupBy("scan_id").agg(F.count("*").alias("findings_count"))
    m = manifests(files).select("scan_id", "domain", "version")
    x = fingerprints(files).join(m, "scan_id").join(n, "scan_id", "left").join(scores.select("scan_id", "score"), "scan_id", "left")
    return x.select(F.col("scan_id").alias("id"), "domain", F.col("scan_id").alias("repo_url"), "version", at.alias("scanned_at"), "score", F.coalesce("findings_count", F.lit(0)).cast("long").alias("findings_count"), "fingerprint_hash", "total_lines", "py_files", "js_files", F.size("network_domains").cast("long").alias("network_domain_count"), "imports", "ha_apis", "network_domains", "file_types", at.alias("created_at"))


def remembered_as(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, fingerprints) rows of what is learned."""
    return x.drop("imports", "ha_apis", "network_domains", "file_types", "created_at"), x.drop("version", "scanned_at", "score", "findings_count", "network_domain_count")


def run_scan(tables: Tables, files: DataFrame, scores: DataFrame, at: Column, feed: DataFrame | None = None, batch_id: str = "") -> dict[str, DataFrame]:
    """Scans all components in files as one job for each, and records them.

    Returns findings, changes (fingerprints against those recorded last) and deviations (against the baseline so far); jobs, history and
    fingerprints are written. A scan that fails leaves its jobs failed.
    """
    own = files.select(F.col("scan_id").alias("id")).distinct()
    rows = own.select("id", F.col("id").alias("name"), F.col("id").alias("repo_url"), F.lit(batch_id).alias("batch_id"), F.lit("running").alias("status"), at.alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("error"))
    tables.update("jobs", rows, "id")
    at_work = lambda: tables.load("jobs").join(own.select(F.col("id").alias("__own")), F.col("id") == F.col("__own"), "left_semi")
    try:
        # written before a whitelist is applied, which reads findings twice: they are computed once
        found, known = _kept(tables, "findings", scan(files, feed)), tables.load("whitelist")
        if not known.isEmpty():
            found = _kept(tables, "findings", fnd.without_whitelisted(found, known))
        before, base = tables.load("fingerprints"), hst.baseline(tables.load("history"))
        scans, prints = remembered_as(_kept(tables, "learned", learned(files, found, scores, at)))
        keyed = lambda f: f.withColumn("key", hst.component_key())
        last = hst.latest_fingerprints(before).select("key", F.col("fingerprint_hash").alias("last_hash"))
        changes = keyed(prints).join(last, "key").where("fingerprint_hash <> last_hash").select("key", "id", "last_hash", "fingerprint_hash")
        changes, deviations = _kept(tables, "changes", changes), _kept(tables, "deviations", hst.deviations(scans, base))
        tables.append("history", scans)
        tables.append("fingerprints", prints)
    except Exception as e:
        tables.update("jobs", hst.with_status(at_work(), own, "failed", at).withColumn("error", F.coalesce("error", F.lit(_cause(e)[:500]))), "id")
        raise
    tables.update("jobs", hst.with_status(at_work(), own, "done", at), "id")
    return {"findings": found, "changes": changes, "deviations": deviations}


def _cause(e: Exception) -> str:
    """The message of what went wrong first, below all that failed because of it."""
    x = getattr(e, "_origin", None) or getattr(e, "java_exception", None)
    while x is not None and x.getCause() is not None:
        x = x.getCause()
    return str(e) if x is None else x.getMessage() or x.toString()


def _kept(tables: Tables, name: str, rows: DataFrame) -> DataFrame:
    """rows as written, so that what is appended later doesn't change them."""
    import uuid

    path = f"{tables.root}/results/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return tables.spark.read.schema(rows.schema).parquet(path)


def due_components(installed: DataFrame, history: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Installed components (domain, name, repository, version) whose turn it is: never scanned, scanned `hours` ago or longer, or in another version.

    What is due is known by domain; url is where its files come from.
    """
    last = history.where("domain <> ''").groupBy(F.col("domain").alias("__d")).agg(F.max(F.struct("scanned_at", "id", "version")).alias("s"))
    x = installed.join(last, F.col("domain") == F.col("__d"), "left")
    why = F.when(F.col("s").isNull(), "never").when(~F.col("s.version").eqNullSafe(F.col("version")), "version").when(F.col("s.scanned_at") <= now - F.expr(f"INTERVAL {int(hours)} HOURS"), "age")
    return x.withColumn("why", why).where("why is not null").select("domain", "name", repository_url(F.col("repository")).alias("url"), "version", "why")


def rescan_installed(tables: Tables, installed: DataFrame, files: DataFrame, at: Column, hours: int = 24, **scan_with) -> dict[str, DataFrame] | None:
    """The scheduled job over what is installed: scans the files (scan_id: the domain) of components whose turn it is; None if none is."""
    due = due_components(installed, tables.load("history"), at, hours)
    own = files.join(due.select(F.col("domain").alias("__d")), F.col("scan_id") == F.col("__d"), "left_semi")
    if own.isEmpty():
        return None
    return run_scan(tables, own, own.select("scan_id", F.lit(None).cast("double").alias("score")).distinct(), at, batch_id="scheduled", **scan_with)


def rescan(tables: Tables, at: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """The scheduled job, for Scheduler.start over a stream of files: scans each batch of arrivals under the batch id `scheduled`."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            run_scan(tables, batch, batch.select("scan_id", F.lit(None).cast("double").alias("score")).distinct(), at(), batch_id="scheduled")

    return each


# Requests: each takes the tables or reports and returns rows.


def report(reports: DataFrame, report_id: str) -> DataFrame:
    """One report by its id; no row if there is none."""
    return reports.where(F.col("id") == report_id)


def report_findings(reports: DataFrame, report_id: str) -> DataFrame:
    """The findings of a report, worst first."""
    x = report(reports, report_id).select(F.posexplode("findings").alias("seq", "f")).select("seq", "f.*")
    return x.orderBy(*fnd.by_severity(x)).drop("seq")


def add_whitelist(table: DataFrame, category: str, file_pattern: str, description: str, reason: str, at: Column) -> DataFrame:
    """The table with a pattern put in; one with the same hash is replaced."""
    one = table.sparkSession.range(1).select(finding_hash(F.lit(category), F.lit(file_pattern), F.lit(description)).alias("pattern_hash"), F.lit(category).alias("category"), F.lit(file_pattern).alias("file_pattern"), F.lit(description).alias("description"), F.lit(reason).alias("reason"), at.alias("created_at"))
    return hst.upsert(table, one.select(*table.columns), "pattern_hash")


def remove_whitelist(table: DataFrame, pattern_hash: str) -> DataFrame:
    return table.where(~F.col("pattern_hash").eqNullSafe(F.lit(pattern_hash)))


def whitelist_newest(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("created_at"), "pattern_hash")
