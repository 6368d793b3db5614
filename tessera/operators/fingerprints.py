"""Fingerprints of components from their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import lines
from tessera.operators.ast_rules import facts
from tessera.operators.history import fingerprint_hash
from tessera.sources.files import fingerprint_files

#: What shows platform use and hosts, and hosts that aren't told.
HOST = r"https?://([a-zA-Z0-9._-]+)"
PLATFORM = r"hass\.(?:async_)?(?:add_job|create_task|services|states|bus|config_entries|helpers)"
PLATFORM_IMPORT = r"from\s+homeassistant\.(\w+(?:\.\w+)*)\s+import"
OWN_HOSTS = ("0.0.0.0", "127.0.0.1", "localhost")


def hosts(text):
    """The hosts of a text's urls, lower-cased, each once, in order of name; loopbacks are left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(HOST), F.lit(1)), F.lower), lambda h: ~h.isin(*OWN_HOSTS))))


def fingerprints(files: DataFrame) -> DataFrame:
    """Per scan: imports, ha_apis, network_domains (sorted lists), file_types, py_files, js_files, total_lines, fingerprint_hash."""
    f = fingerprint_files(files)
    name = F.element_at(F.split("path", "/"), -1)
    f = f.withColumns({"ext": F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))}).withColumns({"py": F.col("ext") == ".py", "js": F.col("ext").isin(".js", ".ts")})
    code = f.where("py or js")
    apis = F.when(F.col("py"), F.concat(F.regexp_extract_all("content", F.lit(PLATFORM), F.lit(0)), F.transform(F.regexp_extract_all("content", F.lit(PLATFORM_IMPORT), F.lit(1)), lambda x: F.concat(F.lit("homeassistant."), x)))).otherwise(F.array().cast("array<string>"))
    per = code.groupBy("scan_id").agg(F.count_if("py").alias("py_files"), F.count_if("js").alias("js_files"), F.sum(F.size(lines(F.col("content")))).alias("total_lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(apis)))).alias("ha_apis"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(hosts(F.col("content")))))).alias("network_domains"))
    known = facts(code.where("py"), ("import", "unparsed"))
    plain = code.where("py").join(known.where("kind = 'unparsed'").select("scan_id", "path"), ["scan_id", "path"], "left_semi")
    names = known.where("kind = 'import'").select("scan_id", F.split_part("name", F.lit("."), F.lit(1)).alias("i")).union(plain.select("scan_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^(?:from|import)\s+([\w.]+)"), F.lit(1))).alias("i")).select("scan_id", F.split_part("i", F.lit("."), F.lit(1))))
    imports = names.groupBy("scan_id").agg(F.array_sort(F.collect_set("i")).alias("imports"))
    types = f.where("ext <> ''").groupBy("scan_id", "ext").agg(F.count("*").cast("int").alias("n")).groupBy("scan_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("file_types"))
    empty = F.array().cast("array<string>")
    x = files.select("scan_id").distinct().join(per, "scan_id", "left").join(imports, "scan_id", "left").join(types, "scan_id", "left")
    x = x.select("scan_id", *(F.coalesce(c, empty).alias(c) for c in ("imports", "ha_apis", "network_domains")), F.coalesce("file_types", F.create_map().cast("map<string,int>")).alias("file_types"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("py_files", "js_files", "total_lines")))
    return x.withColumn("fingerprint_hash", fingerprint_hash(F.col("imports"), F.col("ha_apis"), F.col("network_domains")))
