"""The whole scan as one plan over a registry of scanners: files in, findings out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import ast_rules, line_rules
from tessera.operators.findings import FIELDS, GATES, MOST_PER_FILE, aggregate_noisy, merge_duplicates, without_whitelisted
from tessera.sources import deps
from tessera.sources.files import component_types, files_for, requirements

#: What files that couldn't be parsed are told as, once for a scan, and the file that stands for all of a scan.
UNPARSED, WHOLE = "parse_info", "(repo)"


def _findings(df: DataFrame, scanner: int, own: int) -> DataFrame:
    """Any findings in the common shape, with their scanner and the place among its tables, unless they have one already."""
    kinds = {"line": "int"}
    cols = [(F.col(c) if c in df.columns else F.lit(None if c == "line" else "")).cast(kinds.get(c, "string")).alias(c) for c in FIELDS]
    return df.select("scan_id", *cols, F.lit(scanner).alias("scanner"), F.col("own") if "own" in df.columns else F.lit(own).alias("own"))


def _dealt(spark: SparkSession, *tables: DataFrame) -> list[DataFrame]:
    """By scan, once for all that follows. The number of parts is given: findings shrink so much when written that their bytes would make one task of them."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return [t.repartition(n, "scan_id") for t in tables]


@dataclass(frozen=True)
class Scanner:
    """A scanner by name: which files it looks at (a reader's name, or all), of which component types (none: any), and what it finds.

    find gets the files and gives findings in the common fields, or several such tables, in the order their findings are told (a table
    of several kinds of findings has that place as `own`);
    `capped` keeps the first findings of each file and category.
    """

    name: str
    reader: str | None
    types: tuple[str, ...] | None
    find: Callable[[DataFrame], DataFrame | tuple[DataFrame, ...]]
    capped: bool = True


def _dependencies(files: DataFrame, feed: DataFrame | None = None) -> tuple[DataFrame, ...]:
    named = deps.discover(files).unionByName(deps.manifest_requirements(requirements(files)))
    as_finding = lambda d, sev, cat, text: d.select("scan_id", sev.alias("severity"), F.lit(cat).alias("category"), F.col("source_file").alias("file"), text.alias("description"))
    pin = F.concat("package", F.lit("=="), "version")
    # what makes a package bad is what it is told apart by, so it can be asked before the first of each is picked
    known = (as_finding(deps.distinct_first(deps.malicious(named)), F.lit("critical"), "malicious_package", F.concat(F.lit("Known bad package "), pin)),)
    return known if feed is None else (*known, as_finding(deps.vulnerable(deps.distinct_first(named), feed), F.col("severity"), "cve", F.concat("vuln_id", F.lit(": "), pin)))


def _python(py: DataFrame) -> tuple[DataFrame, ...]:
    groups = ("size", "call", "import", "flow")
    return ast_rules.python_findings(py, *groups), line_rules.scan_parts(py).withColumn("own", F.lit(len(groups)))


def _scripts(js: DataFrame) -> tuple[DataFrame, ...]:
    script = ast_rules.sized_script_findings(js, 4)
    fallback = line_rules.scan_script_patterns(ast_rules.unparsed_scripts(js))
    own = lambda df, k: df.withColumn("own", F.lit(k))
    # files that couldn't be parsed come from the same pass, to be told once for a scan
    info = F.col("category") == UNPARSED
    told = script.withColumns({"own": F.when(info, F.lit(3)).otherwise(F.greatest("own", F.lit(1))), "file": F.when(info, WHOLE).otherwise(F.col("file")), "description": F.when(info, "").otherwise(F.col("description"))})
    return own(line_rules.obfuscation_findings(js), 0), told, own(fallback, 2)


def _yaml(yml: DataFrame) -> tuple[DataFrame, ...]:
    return line_rules.scan_yaml_lines(yml), ast_rules.yaml_structure_findings(yml).withColumn("own", F.lit(3))


def _platform(py: DataFrame) -> DataFrame:
    return ast_rules.python_findings(py, "platform")


#: The scanners that every scan runs, in the order of their findings. add_scanner puts more in.
SCANNERS: dict[str, Scanner] = {
    s.name: s
    for s in (
        Scanner("deps", None, GATES["deps"], _dependencies, capped=False),
        Scanner("python", "python", GATES["python"], _python),
        Scanner("js", "js", GATES["js"], _scripts),
        Scanner("yaml", "yaml", GATES["yaml"], _yaml),
        Scanner("api", "api", GATES["api"], _platform),
    )
}


def add_scanner(scanner: Scanner) -> None:
    """Lets a scanner take part in all further scans; one of the same name is replaced."""
    SCANNERS[scanner.name] = scanner


def scan(files: DataFrame, feed: DataFrame | None = None, whitelist: DataFrame | None = None, scanners: dict[str, Scanner] | None = None) -> DataFrame:
    """Findings of all components in files (scan_id, path, content), capped, aggregated, merged and filtered.

    feed holds known vulnerabilities; scanners are those registered, unless some are named.
    """
    every = list((SCANNERS if scanners is None else scanners).values())
    found, passes, capped = None, F.lit(False), F.lit(False)
    for k, s in enumerate(every):
        own = files_for(files, s.reader) if s.reader else files
        parts = _dependencies(own, feed) if s.find is _dependencies else s.find(own)
        for at, part in enumerate(parts if isinstance(parts, tuple) else (parts,)):
            rows = _findings(part, k, at)
            found = rows if found is None else found.unionByName(rows)
        mine = F.col("scanner") == k
        passes |= mine & (F.col("component_type").isin(*s.types) if s.types else F.lit(True))
        capped |= mine if s.capped else F.lit(False)
    # dealt once: joins, windows and groups below all lie within a scan
    rows, types = _dealt(files.sparkSession, found, component_types(files))
    # a part's types are few beside its findings, which needn't be sorted to meet them
    x = rows.join(types.hint("shuffle_hash"), "scan_id").where(passes)
    w = Window.partitionBy("scan_id", "scanner").orderBy("file", "own", F.coalesce("line", F.lit(0)), "category", "description")
    x = x.withColumn("seq", F.row_number().over(w).cast("long") + F.shiftleft(F.col("scanner").cast("long"), 40))
    each = Window.partitionBy("scan_id", "scanner", "file", "category")
    x = x.withColumns({"__n": F.row_number().over(each.orderBy("seq")), "__of": F.count("*").over(each)})
    info = (F.col("category") == UNPARSED) & (F.col("file") == WHOLE)
    x = x.where(F.when(info, F.col("__n") == 1).otherwise(~capped | (F.col("__n") <= MOST_PER_FILE)))
    x = x.withColumn("description", F.when(info, line_rules.unparsed_text(F.col("__of"))).otherwise(F.col("description"))).select("scan_id", "seq", *FIELDS)
    out = merge_duplicates(aggregate_noisy(x))
    return without_whitelisted(out, whitelist) if whitelist is not None else out
