"""Sources of scanned components: files, manifests, settings, saved reports, review replies.

Components are folders of files that something else has fetched; nothing here clones or calls out.
A file row: scan_id, path (below the component's folder), content.
"""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes, and folders that a reader of files passes over.
READERS = {
    "python": ((".py",), ("tests", ".venv", "node_modules", "__pycache__")),
    "api": ((".py",), ("tests", ".venv", "node_modules", "__pycache__")),
    "js": ((".js", ".ts", ".jsx", ".tsx", ".mjs"), ("node_modules", ".venv", "__pycache__", "tests", "docs")),
    "yaml": ((".yaml", ".yml"), ("tests", ".venv", "node_modules", "__pycache__", ".git")),
    "context": ((".py", ".js", ".ts", ".yaml", ".yml", ".json"), ("node_modules", ".venv", "__pycache__", "tests", ".git")),
}
VENDOR_STEMS = ("docsify", "prism", "marked", "highlight", "mermaid")
#: Parts in which the files of a scan are trimmed.
SALTS = 16
PRIORITY = ("manifest.json", "hacs.json", "__init__.py", "const.py")


def read_files(spark: SparkSession, root: str, reader: str | tuple[str, ...] | None = None, scans: list[str] | None = None) -> DataFrame:
    """The files below root/<scan_id>/...; bytes that are no UTF-8 become U+FFFD.

    Files without a byte are passed over, as by all of Spark's readers. With a reader, only files of its suffixes are opened (they are picked while folders are listed), and those in folders that it passes
    over are left out; with several, folders are listed once, and a file that any of them looks at comes once. With `scans`, only their folders are listed.
    """
    readers = (reader,) if isinstance(reader, str) else reader or ()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if readers:
        raw = raw.option("pathGlobFilter", "*{" + ",".join(sorted({s for r in readers for s in READERS[r][0]})) + "}")
    raw = raw.load([f"{root.rstrip('/')}/{s}" for s in scans] if scans else root)
    tail = F.regexp_extract("path", r"^(?:[a-z0-9]+:/*)?" + "/*" + re.escape(root.split(":", 1)[-1].strip("/")) + "/+(.*)$", 1)
    out = raw.select(F.split_part(tail, F.lit("/"), F.lit(1)).alias("scan_id"), F.regexp_replace(tail, "^[^/]+/", "").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return out.where(_any_of(readers)) if readers else out


def land_files(files: DataFrame, root: str) -> DataFrame:
    """Writes files (scan_id, path, content as bytes) below root/<scan_id>/, each by the executor that holds it; (scan_id, path, bytes) of what was written.

    It happens as the result is computed; a repeated task writes the same files. A path that leaves its folder is refused.
    """
    from tessera.sources import storage

    def run(batches):
        fs, at = storage.opened(root)
        for b in batches:
            sizes = []
            for scan, path, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                parts = [scan, *path.split("/")]
                if any(p in ("", ".", "..") for p in parts) or "/" in scan:
                    raise ValueError(f"no path below its folder: {scan}/{path}")
                fs.create_dir(f"{at}/{'/'.join(parts[:-1])}", recursive=True)
                with fs.open_output_stream(f"{at}/{'/'.join(parts)}") as f:
                    f.write(data or b"")
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["scan_id", "path", "bytes"])

    x = files.select(F.col("scan_id").cast("string"), F.col("path").cast("string"), F.col("content").cast("binary"))
    return x.mapInArrow(run, "scan_id string, path string, bytes long")


def files_for(files: DataFrame, reader: str) -> DataFrame:
    """The files that a scanner looks at, by suffix and folders."""
    return files.where(_any_of((reader,)))


def _any_of(readers: tuple[str, ...]) -> Column:
    """Does one of the readers look at a file?"""
    out = F.lit(False)
    for reader in readers:
        suffixes, skip = READERS[reader]
        ends = F.lit(False)
        for s in suffixes:
            ends |= F.endswith("path", F.lit(s))
        mine = ends & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip)))
        if reader == "js":
            # a vendor's name anywhere in the file name before its last suffix
            stem = F.regexp_replace(F.lower(F.element_at(F.split("path", "/"), -1)), r"\.[^.]*$", "")
            mine &= ~stem.rlike("|".join(VENDOR_STEMS))
        out |= mine
    return out


def fingerprint_files(files: DataFrame) -> DataFrame:
    """All files but those in hidden and cache folders."""
    parts = F.split("path", "/")
    return files.where(~F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin("__pycache__", "node_modules")))


#: Component types by the category that hacs.json names.
CATEGORIES = {"integration": "integration", "plugin": "card", "lovelace": "card", "card": "card", "theme": "theme", "python_script": "python_script"}


def component_types(files: DataFrame) -> DataFrame:
    """(scan_id, component_type): by manifest, by the category file, else by the kinds of files."""
    hacs = F.when(F.col("path") == "hacs.json", F.lower(F.try_variant_get(F.try_parse_json("content"), "$.category", "string")))
    # the last category by name counts; as a number, its place among those known (odd) or between them, so that files are grouped by hash, without a sort
    known = sorted(CATEGORIES)
    place = F.get(F.transform(F.array(hacs), lambda c: F.when(c.isNotNull(), sum((F.when(c > k, 2).when(c == k, 1).otherwise(0) for k in known), F.lit(0)))), F.lit(0))
    # what is told of a file is picked before files are grouped: no content is sorted
    told = files.select(
        "scan_id", (F.endswith("path", F.lit("/manifest.json")) & F.contains("path", F.lit("custom_components/"))).alias("manifest"),
        F.endswith("path", F.lit(".py")).alias("py"), (F.endswith("path", F.lit(".js")) | F.endswith("path", F.lit(".ts"))).alias("js"),
        F.when(F.col("path") == "hacs.json", place).alias("category"),
    )
    x = told.groupBy("scan_id").agg(*(F.bool_or(c).alias(c) for c in ("manifest", "py", "js")), F.max("category").alias("category"))
    by_category = F.lit(None).cast("string")
    for n, k in enumerate(known):
        by_category = F.when(F.col("category") == 2 * n + 1, CATEGORIES[k]).otherwise(by_category)
    kind = F.when(F.col("manifest"), "integration").otherwise(F.coalesce(by_category, F.when(F.col("js") & ~F.col("py"), "card").when(F.col("py") & ~F.col("js"), "integration"), F.lit("unknown")))
    return x.select("scan_id", kind.alias("component_type"))


MANIFEST = "domain string, name string, version string, documentation string, iot_class string, dependencies array<string>, requirements array<string>"


def manifests(files: DataFrame) -> DataFrame:
    """One row for each scan: the first manifest by path that is valid JSON, else the name in hacs.json, else the scan's id as name."""
    m = F.from_json("content", MANIFEST, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json("content").isNotNull()
    is_manifest = F.endswith("path", F.lit("manifest.json")) & F.contains("path", F.lit("custom_components/")) & ok
    is_hacs = (F.col("path") == "hacs.json") & ok
    # what is told of a file is picked before files are grouped: no content is sorted, and only manifests are parsed
    told = files.select("scan_id", F.when(is_manifest, F.col("path")).alias("at"), F.when(is_manifest, m).alias("m"), F.when(is_hacs, F.get_json_object("content", "$.name")).alias("hacs_name"))
    x = told.groupBy("scan_id").agg(F.min_by("m", "at").alias("m"), F.max("hacs_name").alias("hacs_name"))
    empty = F.array().cast("array<string>")
    return x.select("scan_id", F.coalesce("m.domain", F.lit("")).alias("domain"), F.coalesce("m.name", "hacs_name", "scan_id").alias("name"), *(F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in ("version", "documentation", "iot_class")), *(F.coalesce(f"m.{c}", empty).alias(c) for c in ("dependencies", "requirements")))


def requirements(files: DataFrame) -> DataFrame:
    """(scan_id, requirements) of the manifest of each scan that has one, as manifests tells it."""
    m = files.where(F.endswith("path", F.lit("manifest.json")) & F.contains("path", F.lit("custom_components/"))).where(F.try_parse_json("content").isNotNull())
    return m.select("scan_id", "path", F.from_json("content", MANIFEST, {"mode": "PERMISSIVE"})["requirements"].alias("r")).groupBy("scan_id").agg(F.min_by("r", "path").alias("requirements"))


def code_context(files: DataFrame, most_chars: int = 15_000, per_file: int = 8_000) -> DataFrame:
    """(scan_id, context, n_files): files, telling ones first, each cut to per_file, until the total has reached most_chars."""
    prior = F.lit(False)
    for p in PRIORITY:
        prior |= F.contains("path", F.lit(p))
    return context_budget(files.select("scan_id", "path", "content", F.when(prior, 0).otherwise(1).alias("prio")), most_chars, per_file)


def context_budget(files: DataFrame, most_chars: int = 15_000, per_file: int = 8_000) -> DataFrame:
    """(scan_id, context, n_files, n_chars) of rows (scan_id, path, content, prio): the file that crosses the budget is the last.

    A scan's files are trimmed in SALTS parts first: one beyond the budget of its own part is beyond that of the whole, so only as
    much as SALTS budgets of a scan ever meets in one task.
    """
    kept = files.select("scan_id", "prio", "path", F.left("content", F.lit(per_file)).alias("part"), F.pmod(F.xxhash64("path"), F.lit(SALTS)).alias("salt"))
    for keys in (("scan_id", "salt"), ("scan_id",)):
        w = Window.partitionBy(*keys).orderBy("prio", "path").rowsBetween(Window.unboundedPreceding, -1)
        kept = kept.withColumn("before", F.coalesce(F.sum(F.length("part")).over(w), F.lit(0))).where(F.col("before") < most_chars)
    text = F.transform(F.array_sort(F.collect_list(F.struct("prio", "path", "part"))), lambda x: F.concat(F.lit("--- "), x["path"], F.lit(" ---\n"), x["part"]))
    return kept.groupBy("scan_id").agg(F.array_join(text, "\n\n").alias("context"), F.count("*").alias("n_files"), F.sum(F.length("part")).alias("n_chars"))


def first_object(reply: str | None) -> str | None:
    """The first balanced {...} of a reply, without a code fence around it; None if there is none or it is no JSON."""
    text = (reply or "").strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
    start, depth = text.find("{"), 0
    for k in range(start, len(text)) if start >= 0 else ():
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            try:
                json.loads(text[start : k + 1])
            except ValueError:
                return None
            return text[start : k + 1]
    return None


REPLY = "score double, confidence double, summary string, findings array<struct<severity:string,category:string,file:string,line:int,description:string>>"


def parse_replies(replies: DataFrame) -> DataFrame:
    """(scan_id, reply) -> scan_id, score (0 to 10, 5 if none), summary, findings, ok."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([first_object(x) for x in b.column(1).to_pylist()], pa.string())], ["scan_id", "object"])

    from tessera.functions.scalar import clamp_score, with_confidence

    x = replies.select("scan_id", "reply").mapInArrow(run, "scan_id string, object string").withColumn("r", F.from_json("object", REPLY))
    return x.select("scan_id", F.when(F.col("object").isNotNull(), clamp_score(F.col("r.score").cast("string"))).alias("score"), with_confidence(F.coalesce("r.summary", F.lit("")), F.coalesce("r.confidence", F.lit(100.0)), 100).alias("summary"), "r.findings", F.col("object").isNotNull().alias("ok"))


def installed_components(spark: SparkSession, path: str) -> DataFrame:
    """Installed components of a JSON listing: domain, name, repository, version."""
    return spark.read.schema("domain string, name string, full_name string, repository string, installed_version string, installed boolean").json(path).where("installed").select("domain", "name", F.coalesce("full_name", "repository").alias("repository"), F.col("installed_version").alias("version"))


def default_repositories(spark: SparkSession, folder: str, category: str) -> DataFrame:
    """(full_name) of a category's list, a JSON array of names in folder/<category>; none for a category that isn't known."""
    if category not in ("integration", "plugin", "theme", "python_script", "appdaemon", "netdaemon"):
        return spark.createDataFrame([], "full_name string")
    lists = spark.read.text(f"{folder}/{category}", wholetext=True)
    return lists.select(F.explode(F.from_json("value", "array<string>")).alias("full_name"))


REPORT = "id string, name string, created_at timestamp, status string, stats struct<critical:long,high:long,total_findings:long>, findings array<struct<severity:string,category:string,file:string,line:int,code:string,description:string>>"


def load_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Saved reports, broken files left out, newest first."""
    return spark.read.schema(REPORT).option("multiLine", "true").option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(folder).where("id is not null").orderBy(F.desc("created_at"), F.desc("id"))


#: Settings and what they are without a file or an environment variable.
DEFAULTS = {"max_file_size_kb": 500, "max_code_context": 15_000, "scan_timeout_seconds": 300, "scheduled_scan": False, "scan_interval_hours": 24, "cve_watch": False, "cve_interval_hours": 6}


def settings(saved: str | None, environment: dict[str, str] | None = None, prefix: str = "SANDBOX_") -> dict:
    """Settings: those saved (a JSON text), else those of the environment, else the defaults."""
    env = os.environ if environment is None else environment
    out = dict(DEFAULTS)
    for k, v in DEFAULTS.items():
        if (x := env.get(prefix + k.upper())) is not None:
            out[k] = x.lower() in ("1", "true", "yes", "on") if isinstance(v, bool) else type(v)(x)
    try:
        out |= json.loads(saved) if saved else {}
    except ValueError:
        pass
    return out
