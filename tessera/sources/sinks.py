"""Sinks: reports as JSON, CSV, HTML and SARIF, and a table of the newest status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import escaped_html
from tessera.operators.findings import FIELDS, sarif_rules


def _ordered(findings: DataFrame, what) -> DataFrame:
    """(scan_id, items): a scan's findings in order, each as `what` makes it."""
    return findings.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", *FIELDS))), what).alias("items"))


def reports(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One nested row for each scan (id, name, created_at, status): its statistics and findings."""
    items = _ordered(findings, lambda x: F.struct(*(x[c].alias(c) for c in FIELDS)))
    x = scans.join(items.withColumnRenamed("scan_id", "id"), "id", "left").withColumn("findings", F.coalesce("items", F.array().cast("array<struct<severity:string,category:string,file:string,line:int,code:string,description:string>>"))).drop("items")
    n = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s))
    return x.withColumn("stats", F.struct(n("critical").cast("long").alias("critical"), n("high").cast("long").alias("high"), F.size("findings").cast("long").alias("total_findings")))


def write_json(reports_: DataFrame, path: str) -> None:
    reports_.write.mode("append").json(path)


def write_csv(findings: DataFrame, path: str) -> None:
    """Six columns with a header; a line that is null is empty."""
    findings.select("severity", "category", "file", "line", "description", "code").write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def html_reports(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """(id, html): a page with a table of the scan's findings, all text escaped."""
    cell = lambda x: F.concat(F.lit("<td>"), escaped_html(F.coalesce(x.cast("string"), F.lit(""))), F.lit("</td>"))
    rows = _ordered(findings, lambda x: F.concat(F.lit("<tr>"), *(cell(x[c]) for c in ("severity", "category", "file", "line", "description")), F.lit("</tr>")))
    x = scans.join(rows.withColumnRenamed("scan_id", "id"), "id", "left")
    body = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), escaped_html(F.col("name")), F.lit("</title></head><body><h1>"), escaped_html(F.col("name")), F.lit("</h1><table><tr><th>Severity</th><th>Category</th><th>File</th><th>Line</th><th>Description</th></tr>"), F.coalesce(F.array_join("items", ""), F.lit("")), F.lit("</table></body></html>"))
    return x.select("id", body.alias("html"))


def sarif(findings: DataFrame, tool: str = "tessera") -> DataFrame:
    """(scan_id, sarif): SARIF 2.1.0 text of each scan."""
    rules = sarif_rules(findings)
    r = rules.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "name", "level"))), lambda x: F.struct(x["rule_id"].alias("id"), x["name"].alias("name"), F.struct(x["level"].alias("level")).alias("defaultConfiguration"))).alias("rules"))

    def result(x):
        level = F.when(x["severity"].isin("critical", "high"), "error").when(x["severity"] == "medium", "warning").otherwise("note")
        place = F.struct(F.struct(x["file"].alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce(x["line"], F.lit(1)), F.lit(1)).alias("startLine")).alias("region"))
        return F.struct(x["category"].alias("ruleId"), level.alias("level"), F.struct(x["description"].alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"))

    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("items").alias("results"))
    doc = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return _ordered(findings, result).join(r, "scan_id").select("scan_id", F.to_json(doc).alias("sarif"))


def status_topics(scans: DataFrame) -> DataFrame:
    """(topic, payload): the newest status of each component, as a broker would retain it; for a sink in foreachBatch."""
    w = Window.partitionBy("domain").orderBy(F.desc("scanned_at"), F.desc("id"))
    last = scans.withColumn("n", F.row_number().over(w)).where("n = 1")
    return last.select(F.concat(F.lit("scanner/"), F.col("domain"), F.lit("/state")).alias("topic"), F.to_json(F.struct("score", "findings_count", "scanned_at")).alias("payload"))


#: Fixed values: (key, name, icon) of the values that a dashboard is told of.
SENSORS = (("status", "Status", "mdi:shield-search"), ("last_scan", "Last Scan", "mdi:clock-check"), ("last_score", "Last Score", "mdi:counter"), ("scans_total", "Total Scans", "mdi:numeric"))


def discovery_messages(nodes: DataFrame, maker: str = "tessera", version: str = "1") -> DataFrame:
    """(topic, payload, retain) for rows (node): a message for each sensor of each node, that tells a dashboard where its value is published."""
    sensors = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.lit(i).alias("icon")) for k, n, i in SENSORS))
    x = nodes.select("node").where("node <> ''").distinct().select("node", F.inline(sensors))
    part = lambda *cs: F.concat(*(F.col(c) if c in ("node", "key") else F.lit(c) for c in cs))
    device = F.struct(F.array("node").alias("identifiers"), F.lit(maker).alias("name"), F.lit(version).alias("model"), F.lit(maker).alias("manufacturer"))
    payload = F.struct("name", part("node", "_", "key").alias("unique_id"), part("node", "/", "key").alias("state_topic"), device.alias("device"), "icon")
    return x.select(part("homeassistant/sensor/", "node", "/", "key", "/config").alias("topic"), F.to_json(payload).alias("payload"), F.lit(True).alias("retain"))


def result_messages(scans: DataFrame, node: str, total: DataFrame) -> DataFrame:
    """(topic, payload, retain): status, name, score (N/A without one) and number of scans, for the newest of scans (name, status, score, scanned_at, id).

    total: one row, scans_total. One scan at least, or no messages.
    """
    last = scans.orderBy(F.desc("scanned_at"), F.desc("id")).limit(1).select(F.lit(1).alias("one"), "status", "name", "score")
    x = last.join(F.broadcast(total.select(F.lit(1).alias("one"), "scans_total")), "one")
    values = {"status": F.col("status"), "last_scan": F.col("name"), "last_score": F.coalesce(F.col("score").cast("string"), F.lit("N/A")), "scans_total": F.col("scans_total").cast("string")}
    told = F.array(*(F.struct(F.lit(f"{node}/{k}").alias("topic"), v.alias("payload"), F.lit(True).alias("retain")) for k, v in values.items()))
    return x.select(F.inline(told))


def publish(messages: DataFrame, send) -> None:
    """Hands every message to send(topic, payload, retain) on the driver, a few at a time; for a sink in foreachBatch with a broker's client."""
    for r in messages.toLocalIterator():
        send(r["topic"], r["payload"], r["retain"] if "retain" in messages.columns else True)
