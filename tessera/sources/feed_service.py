"""Known vulnerabilities by batches of requests, as a service answers them: a data source whose partitions are batches.

Distinct packages are written as files of a hundred requests. A partition of the source reads one file, asks for all its packages at once,
and matches answers by their place. If a batch has no answer that can be read, its packages are asked for one by one; a package that gets
none either is a row that says so, and the scan goes on. The service at hand is a folder of answers, a file for each request.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources import storage

FORMAT = "tessera_feed"
#: Packages of one request.
BATCH = 100
ROW = "ecosystem string, package string, version string, vuln_id string, summary string, score string, error string"


@dataclass
class _Batch(InputPartition):
    name: str


def single(ecosystem: str, package: str, version: str) -> str:
    """The name of the answer to a request for one package."""
    return f"{zlib.crc32('|'.join((ecosystem, package, version)).encode()):08x}.json"


class FolderService:
    """Answers lie in files: `batch=<name>` is a folder of parts of one JSON text, `single/<hash>.json` the answer for one package."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def many(self, name: str, requests: list[dict]) -> list[dict]:
        at = f"{self.folder}/batch={name}"
        text = "".join(storage.read_text(f"{at}/{f}") for f in storage.files_in(at))
        return json.loads(text)["results"]

    def one(self, request: dict) -> dict:
        return json.loads(storage.read_text(f"{self.folder}/single/{single(*(request[k] for k in ('ecosystem', 'package', 'version')))}"))


def answered(service, name: str, requests: list[dict]) -> Iterator[tuple]:
    """Rows of one batch: a vulnerability each; for packages without an answer, the error."""
    try:
        answers = service.many(name, requests)
        if not isinstance(answers, list) or not all(isinstance(a, dict) for a in answers):
            raise ValueError("no list of answers")
    except (OSError, ValueError, KeyError, TypeError) as e:
        answers = [_alone(service, r, f"batch {name}: {type(e).__name__}") for r in requests]
    for k, r in enumerate(requests):
        key = (r["ecosystem"], r["package"], r["version"])
        answer = answers[k] if k < len(answers) else {"error": f"batch {name}: no answer at place {k}"}
        if "error" in answer:
            yield (*key, None, None, None, answer["error"])
        for v in answer.get("vulns") or []:
            scores = [s["score"] for s in v.get("severity") or [] if isinstance(s, dict) and "score" in s]
            yield (*key, v.get("id", "UNKNOWN"), v.get("summary", "No description"), scores[0] if scores else "", None)


def _alone(service, request: dict, before: str) -> dict:
    try:
        answer = service.one(request)
        return answer if isinstance(answer, dict) else {"error": f"{before}; alone: no object"}
    except (OSError, ValueError, KeyError, TypeError) as e:
        return {"error": f"{before}; alone: {type(e).__name__}"}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.batches, self.answers = options["batches"].rstrip("/"), options["answers"]

    def partitions(self) -> list[_Batch]:
        return [_Batch(n) for n in storage.files_in(self.batches)] or [_Batch("")]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        if partition.name:
            requests = [json.loads(x) for x in storage.read_text(f"{self.batches}/{partition.name}").splitlines()]
            yield from answered(FolderService(self.answers), partition.name, requests)


class FeedSource(DataSource):
    """Options: batches (a folder of request files), answers (the folder of the service)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def write_batches(deps: DataFrame, folder: str, size: int = BATCH) -> None:
    """The distinct packages (ecosystem, package in lower case, version) as files of `size` requests."""
    rows = deps.select("ecosystem", F.lower("package").alias("package"), "version").where("package is not null and version is not null").distinct()
    rows.write.option("maxRecordsPerFile", size).json(folder)


def read_feed(spark: SparkSession, batches: str, answers: str) -> DataFrame:
    """What the service knows of all packages in `batches`: ROW."""
    spark.dataSource.register(FeedSource)
    return spark.read.format(FORMAT).options(batches=batches, answers=answers).load()


def answer_from(feed: DataFrame, batches: str, answers: str) -> None:
    """Plays the service: answers every batch from a table (ecosystem, package, version, vuln_id, score), places as in the request files."""
    spark = feed.sparkSession
    files = spark.read.text(batches, wholetext=True).select(F.col("_metadata.file_name").alias("batch"), F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("place", "line"))
    asked = files.withColumn("q", F.from_json("line", "ecosystem string, package string, version string")).select("batch", "place", "q.*")
    known = feed.groupBy("ecosystem", F.lower("package").alias("package"), "version").agg(F.array_sort(F.collect_list(F.struct(F.col("vuln_id").alias("id"), F.array(F.struct(F.col("score"))).alias("severity")))).alias("vulns"))
    one = F.struct("place", F.struct("vulns").alias("a"))
    told = asked.join(known, ["ecosystem", "package", "version"], "left").groupBy("batch").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["a"]).alias("results"))).alias("value"))
    told.repartition("batch").write.partitionBy("batch").text(answers)
