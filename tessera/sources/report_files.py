"""Reports as files of any size, written by a data source of its own: findings stream through, no row and no task holds a scan.

Findings come sorted by scan and place over range partitions, so a scan with very many findings lies in several files, each a complete
document that names its scan and has the scan's own totals and rule levels. A task writes into a folder of its own. The
driver's commit lists the folders of tasks that count; others, of failed or repeated tasks, aren't listed and aren't read.
"""

from __future__ import annotations

import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessera.operators.findings import FIELDS, sarif_rules, severity_counts
from tessera.sources import storage

FORMAT = "tessera_reports"
#: Findings of one file, at most.
ROWS_PER_FILE = 100_000
_NOTE = {"critical": "error", "high": "error", "medium": "warning"}


class _Json:
    """{id, name, status, stats, findings}."""

    def head(self, r: dict) -> str:
        scan = {"id": r["scan_id"], "name": r["name"], "status": r["status"], "stats": {k: r[k] for k in ("critical", "high", "total_findings")}}
        return json.dumps(scan)[:-1] + ', "findings": ['

    def item(self, r: dict) -> str:
        return json.dumps({"seq": r["seq"], **{k: r[k] for k in FIELDS}})

    def foot(self) -> str:
        return "]}"


class _Sarif:
    """SARIF 2.1.0; rules come behind the results, as they are known by then."""

    def __init__(self):
        self.rules: dict[str, str] = {}

    def head(self, r: dict) -> str:
        self.rules = {}
        return '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"automationDetails": ' + json.dumps({"id": r["scan_id"]}) + ', "results": ['

    def item(self, r: dict) -> str:
        self.rules[r["category"]] = r["rule_level"]
        place = {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": max(r["line"] or 1, 1)}}
        return json.dumps({"ruleId": r["category"], "level": _NOTE.get(r["severity"], "note"), "message": {"text": r["description"]}, "locations": [{"physicalLocation": place}], "properties": {"seq": r["seq"]}})

    def foot(self) -> str:
        rules = [{"id": k, "name": k.replace("_", " ").title(), "defaultConfiguration": {"level": v}} for k, v in sorted(self.rules.items())]
        return '], "tool": ' + json.dumps({"driver": {"name": "tessera", "rules": rules}}) + "}]}"


class _Html:
    """A page with a table, all text escaped."""

    def head(self, r: dict) -> str:
        name = html.escape(r["name"] or r["scan_id"] or "")
        cells = "".join(f"<th>{c}</th>" for c in ("Severity", "Category", "File", "Line", "Description"))
        return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{name}</title></head><body><h1>{name}</h1><p>{r["total_findings"]} findings, {r["critical"]} critical, {r["high"]} high</p><table><tr>{cells}</tr>'

    def item(self, r: dict) -> str:
        return "<tr>" + "".join(f"<td>{html.escape(str(r[c])) if r[c] is not None else ''}</td>" for c in ("severity", "category", "file", "line", "description")) + "</tr>"

    def foot(self) -> str:
        return "</table></body></html>"


KINDS = {"json": (_Json, ",\n"), "sarif": (_Sarif, ",\n"), "html": (_Html, "\n")}


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int
    findings: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "json")
        self.most = int(options.get("rows_per_file", ROWS_PER_FILE))
        if self.kind not in KINDS:
            raise ValueError(f"no kind of report: {self.kind}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        maker, between = KINDS[self.kind]
        out, stream, scan, held, files, findings = maker(), None, None, 0, 0, 0
        fs, root = storage.opened(f"{self.path}/{(folder := f'part-{uuid.uuid4().hex}')}")

        def close() -> None:
            if stream is not None:
                stream.write(out.foot().encode())
                stream.close()

        for batch in iterator:
            for r in batch.to_pylist():
                if stream is None or r["scan_id"] != scan or held >= self.most:
                    close()
                    scan, held, files = r["scan_id"], 0, files + 1
                    if files == 1:
                        fs.create_dir(root, recursive=True)
                    name = re.sub(r"[^A-Za-z0-9_-]+", "_", scan or "")[:60]
                    stream = fs.open_output_stream(f"{root}/{name}-{zlib.crc32((scan or '').encode()):08x}-{files:05d}.{self.kind}", buffer_size=1 << 20)
                    stream.write(out.head(r).encode())
                if r["seq"] is not None:
                    stream.write(((between if held else "") + out.item(r)).encode())
                    held += 1
                    findings += 1
        close()
        return _Written(folder, files, findings)

    def commit(self, messages: list[_Written | None]) -> None:
        kept = [{"folder": m.folder, "files": m.files, "findings": m.findings} for m in messages if m and m.files]
        storage.write_text(f"{self.path}/_committed/{uuid.uuid4().hex}.json", "".join(json.dumps(x) + "\n" for x in kept))

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m:
                storage.delete_folder(f"{self.path}/{m.folder}")


class ReportSource(DataSource):
    """Options: path, kind (json, sarif or html), rows_per_file."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("reports are added to a folder, not replaced")
        return _Writer(self.options)


def write_reports(scans: DataFrame, findings: DataFrame, path: str, kind: str = "json", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes a report of each scan (id, name, status); a scan without findings has one without items."""
    spark = findings.sparkSession
    spark.dataSource.register(ReportSource)
    kinds = {"seq": "long", "line": "int"}
    kept = f"{path.rstrip('/')}/_findings-{uuid.uuid4().hex}"
    # findings are read several times, for totals, levels, ranges and reports: they are computed once
    findings.select("scan_id", *(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in ("seq", *FIELDS))).write.parquet(kept)
    try:
        findings = spark.read.parquet(kept)
        about = scans.select(F.col("id").alias("scan_id"), "name", "status").join(severity_counts(findings, "scan_id"), "scan_id", "left")
        levels = sarif_rules(findings).select("scan_id", F.col("rule_id").alias("category"), F.col("level").alias("rule_level"))
        rows = about.join(findings.join(levels, ["scan_id", "category"], "left"), "scan_id", "left")
        rows = rows.fillna(0, ["critical", "high", "total_findings"]).select("scan_id", "name", "status", "critical", "high", "total_findings", "seq", *FIELDS, "rule_level")
        rows = rows.repartitionByRange("scan_id", F.col("seq").asc_nulls_first()).sortWithinPartitions("scan_id", "seq")
        rows.write.format(FORMAT).mode("append").options(path=path, kind=kind, rows_per_file=str(rows_per_file)).save()
    finally:
        storage.delete_folder(kept)


def report_folders(path: str) -> list[str]:
    """The folders whose reports count."""
    names = storage.files_in(f"{path.rstrip('/')}/_committed")
    lines = [json.loads(x) for n in names for x in storage.read_text(f"{path.rstrip('/')}/_committed/{n}").splitlines()]
    return [f"{path.rstrip('/')}/{x['folder']}" for x in lines]


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every JSON document of committed reports, a file in a row."""
    folders = report_folders(path)
    return spark.read.schema(schema).option("multiLine", "true").json(folders) if folders else spark.createDataFrame([], schema)
