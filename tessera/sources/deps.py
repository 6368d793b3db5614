"""Dependencies: from requirement strings and dependency files to known-bad packages and vulnerabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import lines, vulnerability_severity

REQUIREMENT = r"^([a-zA-Z0-9_.-]+)\s*[=<>!~]+\s*([\d.]+)"
#: Packages known to be bad, in any version.
MALICIOUS = {
    "PyPI": (
        "clorama",
        "coloramma",
        "colourama",
        "ctx",
        "importlib-metadata",
        "jeIlyfish",
        "noblesse",
        "noblesse2",
        "pip-install",
        "pytagora",
        "pytagoras",
        "python-binance",
        "python3-dateutil",
        "pythondateutil",
        "reequests",
        "requesrs",
        "requestes",
        "setup-tools",
        "urlib3",
        "urrlib3",
    ),
    "npm": (
        "babelcli",
        "coa",
        "colors",
        "crossenv",
        "d3.js",
        "event-stream",
        "faker",
        "flatmap-stream",
        "gruntcli",
        "http-proxy.js",
        "is-promise",
        "jquery.js",
        "mongose",
        "node-fabric",
        "node-opencv",
        "node-opensl",
        "node-openssl",
        "nodecaffe",
        "nodefabric",
        "nodemailer-js",
        "noderequest",
        "nodesass",
        "proxy.js",
        "rc",
        "shadowsock",
        "smb",
        "sqliter",
        "ua-parser-js",
    ),
}


def requirement(text: Column) -> Column:
    """struct<package, version> of a requirement string; null without a version, as for extras."""
    p = F.regexp_extract(text, REQUIREMENT, 1)
    return F.when(p != "", F.struct(p.alias("package"), F.regexp_extract(text, REQUIREMENT, 2).alias("version")))


def _rows(x: DataFrame, ecosystem: str) -> DataFrame:
    return x.where("r is not null").select("scan_id", F.col("r.package").alias("package"), F.col("r.version").alias("version"), F.col("path").alias("source_file"), F.lit(ecosystem).alias("ecosystem"))


def manifest_requirements(manifests: DataFrame) -> DataFrame:
    """The requirements of (scan_id, requirements), as those of its manifest."""
    return _rows(manifests.select("scan_id", F.lit("manifest.json").alias("path"), F.explode("requirements").alias("t")).select("scan_id", "path", requirement(F.col("t")).alias("r")), "PyPI")


def _requirements_txt(text: Column) -> Column:
    """The requirements (package, version) of a file of one to a line."""
    own = F.filter(F.transform(lines(text), lambda t: F.trim(t)), lambda t: (t != "") & ~F.startswith(t, F.lit("#")) & ~F.startswith(t, F.lit("-")))
    return F.transform(own, requirement)


def _pyproject(text: Column) -> Column:
    """The requirements of the first dependency block: from its opening line to ] or the next section."""
    opens = lambda t: t.isin("[project.dependencies]", "dependencies = [")
    closes = lambda t: (t == "]") | F.startswith(t, F.lit("["))

    def inside(own: Column) -> Column:
        numbered = F.transform(own, lambda t, n: F.struct(n.alias("n"), t.alias("t")))
        first = F.get(F.filter(numbered, lambda x: opens(x["t"])), F.lit(0))["n"]
        last = F.get(F.filter(numbered, lambda x: (x["n"] > first) & closes(x["t"]) & ~opens(x["t"])), F.lit(0))["n"]
        kept = F.filter(numbered, lambda x: (x["n"] > first) & (x["n"] < F.coalesce(last, F.size(own))) & ~opens(x["t"]))
        return F.when(first.isNotNull(), F.transform(kept, lambda x: requirement(F.trim(x["t"], F.lit("\"',' ")))))

    # a list of one, so that the lines are cut once
    return F.get(F.transform(F.array(F.transform(lines(text), lambda t: F.trim(t))), inside), F.lit(0))


def _package_json(text: Column) -> Column:
    """dependencies, then devDependencies; what has no version x.y, or isn't a string, is left out."""
    def of(key: str) -> Column:
        named = F.map_entries(F.from_json(F.get_json_object(text, f"$.{key}"), "map<string,string>"))
        v = lambda x: F.regexp_extract(x["value"], r"(\d+\.\d+[\d.]*)", 1)
        return F.coalesce(F.transform(named, lambda x: F.when(v(x) != "", F.struct(x["key"].alias("package"), v(x).alias("version")))), F.array().cast("array<struct<package:string,version:string>>"))

    return F.concat(of("dependencies"), of("devDependencies"))


def discover(files: DataFrame) -> DataFrame:
    """All dependencies of the files of components, with where they are named: one pass over the files, without a shuffle."""
    # a file's name is looked at first: few are opened any further
    ends = lambda name: (F.col("path") == name) | F.endswith("path", F.lit("/" + name))
    out_of = lambda *folders: ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, folders)))
    python = out_of("node_modules", ".venv", ".git")
    kind = F.when(ends("requirements.txt") & python, "requirements").when(ends("pyproject.toml") & python, "pyproject").when(ends("package.json") & out_of("node_modules"), "npm")
    own = files.where(kind.isNotNull()).select("scan_id", "path", "content", kind.alias("kind"))
    found = F.when(F.col("kind") == "requirements", _requirements_txt(F.col("content"))).when(F.col("kind") == "pyproject", _pyproject(F.col("content"))).otherwise(_package_json(F.col("content")))
    x = own.select("scan_id", "path", F.when(F.col("kind") == "npm", "npm").otherwise("PyPI").alias("ecosystem"), F.explode(found).alias("r")).where("r is not null")
    return x.select("scan_id", F.col("r.package").alias("package"), F.col("r.version").alias("version"), F.col("path").alias("source_file"), "ecosystem")


def distinct_first(deps: DataFrame, order: str = "source_file") -> DataFrame:
    """One row for each ecosystem, package (in any case) and version of a scan: the first."""
    w = Window.partitionBy("scan_id", "ecosystem", F.lower("package"), "version").orderBy(order, "package")
    return deps.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def malicious_table(spark) -> DataFrame:
    """(ecosystem, package, version): version null means any."""
    return spark.createDataFrame([(e, p, None) for e, ps in MALICIOUS.items() for p in ps], "ecosystem string, package string, version string")


def malicious(deps: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """The dependencies that the table names; without one, the built-in list, whose size is fixed."""
    t = F.broadcast(malicious_table(deps.sparkSession)) if table is None else table
    t = t.select(F.col("ecosystem").alias("__e"), F.lower("package").alias("__p"), F.col("version").alias("__v"))
    hit = (F.col("ecosystem") == F.col("__e")) & (F.lower("package") == F.col("__p")) & (F.col("__v").isNull() | (F.col("__v") == F.col("version")))
    return deps.join(t, hit, "left_semi")


def vulnerable(deps: DataFrame, feed: DataFrame) -> DataFrame:
    """The dependencies with their known vulnerabilities; feed: ecosystem, package, version, vuln_id, score."""
    f = feed.select(F.col("ecosystem").alias("__e"), F.lower("package").alias("__p"), F.col("version").alias("__v"), "vuln_id", "score")
    x = deps.join(f, (F.col("ecosystem") == F.col("__e")) & (F.lower("package") == F.col("__p")) & (F.col("version") == F.col("__v")))
    return x.select(*deps.columns, "vuln_id", vulnerability_severity(F.col("score")).alias("severity"))
