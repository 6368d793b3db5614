"""The engine's own tables (jobs, batches, history, fingerprints, whitelist) as Parquet below one folder.

A table is a folder of versions. A version counts once its write is complete, so readers see the old or the new one and a failed
write leaves nothing behind that is read. Appends add files to the newest version. One writer for a table at a time.

A table with parts (PARTS: jobs, by month of creation) has versions of its parts: a change writes the parts it touches, and a log that says
which version of each part counts. The log is put in place by one rename, so readers see all of a change or none of it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import storage

#: The columns of each table.
SCHEMAS = {
    "jobs": "id string, name string, repo_url string, batch_id string, status string, created_at timestamp, completed_at timestamp, error string",
    "batches": "id string, total long, completed long, failed long, status string, created_at timestamp, completed_at timestamp",
    "history": "id string, domain string, repo_url string, version string, scanned_at timestamp, score double, findings_count long, fingerprint_hash string, total_lines long, py_files long, js_files long, network_domain_count long",
    "fingerprints": "id string, domain string, repo_url string, fingerprint_hash string, imports array<string>, ha_apis array<string>, network_domains array<string>, file_types map<string,int>, py_files long, js_files long, total_lines long, created_at timestamp",
    "whitelist": "pattern_hash string, category string, file_pattern string, description string, reason string, created_at timestamp",
}


#: Tables that are changed part by part, and what a row's part is.
PARTS = {"jobs": "coalesce(date_format(created_at, 'yyyy-MM'), 'none')"}


class Tables:
    """Tables by name below a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None, parts: dict[str, str] | None = None):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), SCHEMAS if schemas is None else schemas
        self.parts = (PARTS if schemas is None else {}) if parts is None else parts

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        at, fs = self._fs(f"{self.root}/{name}")
        if not fs.exists(at):
            return []
        found = [x.getPath().getName() for x in fs.listStatus(at)]
        return sorted(int(v) for v in found if v.isdigit() and fs.exists(self._fs(f"{self.root}/{name}/{v}/_SUCCESS")[0]))

    def load(self, name: str) -> DataFrame:
        """The newest version; a table that was never written is empty."""
        if name in self.parts:
            return self._load_parts(name, self._log(name)[1])
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}/{versions[-1]}")

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        kinds = self.spark.createDataFrame([], self.schemas[name]).schema
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))

    def save(self, name: str, rows: DataFrame) -> None:
        """Writes a new version; rows may be made of the one before, which is removed afterwards, the one before that at once."""
        if name in self.parts:
            self._write_parts(name, rows, {})
            return
        versions = self._versions(name)
        self._shaped(name, rows).write.parquet(f"{self.root}/{name}/{(versions[-1] if versions else 0) + 1}")
        for v in versions[:-1]:
            at, fs = self._fs(f"{self.root}/{name}/{v}")
            fs.delete(at, True)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; columns that a table has and rows haven't are null."""
        if name in self.parts:
            at = rows.select(F.expr(self.parts[name]).alias("p")).distinct()
            log = self._log(name)[1]
            touched = {r["p"] for r in at.collect()}  # months
            self._write_parts(name, self._load_parts(name, {p: v for p, v in log.items() if p in touched}).unionByName(self._shaped(name, rows)), {p: v for p, v in log.items() if p not in touched})
            return
        versions = self._versions(name) or [1]
        self._shaped(name, rows).write.mode("append").parquet(f"{self.root}/{name}/{versions[-1]}")

    def update(self, name: str, rows: DataFrame, key: str) -> list[str]:
        """Puts rows in, in place of those of the same key, and returns the parts that were written: those of the rows, old and new.

        Of other parts nothing but keys is read, and nothing is written.
        """
        rows = self._shaped(name, rows)
        if name not in self.parts:
            self.save(name, _put(self.load(name), rows, key))
            return []
        log = self._log(name)[1]
        keys = rows.select(F.col(key).alias("__k")).distinct()
        stands = self._load_parts(name, log).join(keys, F.col(key).eqNullSafe(F.col("__k")), "left_semi")
        of = F.expr(self.parts[name]).alias("p")
        touched = sorted(r["p"] for r in stands.select(of).union(rows.select(of)).distinct().collect())  # months
        self._write_parts(name, _put(self._load_parts(name, {p: v for p, v in log.items() if p in touched}), rows, key), {p: v for p, v in log.items() if p not in touched})
        return touched

    def _log(self, name: str) -> tuple[int, dict[str, int]]:
        """The number of the newest change, and the version of each part."""
        found = [x.base_name for x in storage.listed(f"{self.root}/{name}/_log") if x.base_name.endswith(".json") and not x.base_name.startswith("_")]
        if not found:
            return 0, {}
        return int(max(found)[:-5]), json.loads(storage.read_text(f"{self.root}/{name}/_log/{max(found)}"))

    def _load_parts(self, name: str, log: dict[str, int]) -> DataFrame:
        if not log:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*(f"{self.root}/{name}/v{v}/part={p}" for p, v in sorted(log.items())))

    def _write_parts(self, name: str, rows: DataFrame, kept: dict[str, int]) -> None:
        """A change: parts of `rows` in a new version, beside the parts that are kept. The change before stays readable, older ones go."""
        n, before = self._log(name)
        at = f"{self.root}/{name}/v{n + 1}"
        storage.delete_folder(at)  # of a change that failed
        x = self._shaped(name, rows).withColumn("part", F.expr(self.parts[name]))
        x.repartition("part", F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(4))).write.partitionBy("part").parquet(at)
        new = {f.base_name.removeprefix("part="): n + 1 for f in storage.listed(at) if f.base_name.startswith("part=")}
        self._commit(name, n + 1, {**kept, **new})
        for p, v in self._older(name, n).items():
            if before.get(p) != v:
                storage.delete_folder(f"{self.root}/{name}/v{v}/part={p}")

    def _older(self, name: str, n: int) -> dict[str, int]:
        at = f"{self.root}/{name}/_log/{n - 1:08d}.json"
        return json.loads(storage.read_text(at)) if n > 1 else {}

    def _commit(self, name: str, n: int, log: dict[str, int]) -> None:
        folder = f"{self.root}/{name}/_log"
        hidden = f"_{uuid.uuid4().hex}.json"
        storage.write_text(f"{folder}/{hidden}", json.dumps(log))
        fs, at = storage.opened(folder)
        fs.move(f"{at}/{hidden}", f"{at}/{n:08d}.json")


def _put(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    gone = rows.select(F.col(key).alias("__k")).distinct()
    return table.join(gone, F.col(key).eqNullSafe(F.col("__k")), "left_anti").unionByName(rows)
