"""Operators over sets of findings.

A finding: scan_id, seq (place in its scan; every "first" below means by seq), severity, category, file, line (null or 0: none), code, description.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import finding_hash, normal_category, relative_path, severity_rank

FIELDS = ("severity", "category", "file", "line", "code", "description")
#: Findings of a file and category that are kept.
MOST_PER_FILE = 3


def cap_per_file(findings: DataFrame, most: int = MOST_PER_FILE) -> DataFrame:
    """The first `most` findings of each scan, file and category."""
    w = Window.partitionBy("scan_id", "file", "category").orderBy("seq")
    return findings.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def aggregate_noisy(findings: DataFrame, category: str = "network", most: int = 5, info_only: bool = True) -> DataFrame:
    """Of a scan's findings of one category, the first `most`, and a row that counts the rest.

    Only info findings are counted in, so none of a higher severity is lost in the row; info_only=False counts all.
    The row is made once, with true totals, and stands behind all others of its scan.
    """
    noisy = F.col("category") == category
    if info_only:
        noisy &= F.col("severity") == "info"
    # one pass: other rows are numbered by themselves, so that they lie wherever they do; the last that is kept brings the row of totals
    noisy = F.coalesce(noisy, F.lit(False))
    apart = F.when(~noisy, F.pmod(F.xxhash64("seq"), F.lit(64)))
    w = Window.partitionBy("scan_id", "__noisy", "__apart")
    ranked = findings.withColumns({"__noisy": noisy, "__apart": apart}).withColumns({"__n": F.row_number().over(w.orderBy("seq")), "__of": F.count("*").over(w)})
    ranked = ranked.where(~F.col("__noisy") | (F.col("__n") <= most))
    text = F.concat(F.lit("...and "), (F.col("__of") - most).cast("string"), F.lit(f" more {category} findings (total "), F.col("__of").cast("string"), F.lit(" across repo)"))
    total = {"seq": F.lit(2**62), "severity": F.lit("info"), "category": F.lit(category), "file": F.lit("(aggregated)"), "line": F.lit(None), "code": F.lit(""), "description": text}
    kinds = {f.name: f.dataType for f in findings.schema} | {"seq": "long"}
    cols = ("seq", *FIELDS)
    one = F.struct(*(F.col(c).cast(kinds[c]).alias(c) for c in cols))
    row = F.struct(*(total[c].cast(kinds[c]).alias(c) for c in cols))
    told = F.when(F.col("__noisy") & (F.col("__n") == most) & (F.col("__of") > most), F.array(one, row)).otherwise(F.array(one))
    return ranked.select("scan_id", F.inline(told))


def merge_duplicates(findings: DataFrame) -> DataFrame:
    """One finding for each scan, file, line and normalised category.

    A fold in order of seq: a higher severity takes over, code and line are filled from the other where empty, and the
    loser's description is added behind ` | ` unless one starts with the first 30 characters of the other. seq is the first one.
    """
    keyed = findings.withColumns({"__line": F.coalesce(F.nullif(F.col("line"), F.lit(0)), F.lit(-1)), "__cat": normal_category(F.col("category"))})
    item = F.struct("seq", severity_rank(F.col("severity")).alias("rank"), *(F.coalesce(F.col(c), F.lit("")).alias(c) if c in ("code", "description") else F.col(c) for c in FIELDS))
    groups = keyed.groupBy("scan_id", "file", "__line", "__cat").agg(F.array_sort(F.collect_list(item)).alias("xs"))

    def merged(a: Column, b: Column) -> Column:
        up = b["rank"] > a["rank"]
        win = lambda c: F.when(up, b[c]).otherwise(a[c])
        lose = lambda c: F.when(up, a[c]).otherwise(b[c])
        d, e = win("description"), lose("description")
        same = (e == "") | (d == e) | F.startswith(d, F.left(e, F.lit(30))) | F.startswith(e, F.left(d, F.lit(30)))
        return F.struct(
            a["seq"].alias("seq"), F.greatest(a["rank"], b["rank"]).alias("rank"), win("severity").alias("severity"), win("category").alias("category"), a["file"].alias("file"),
            F.coalesce(F.nullif(win("line"), F.lit(0)), lose("line")).alias("line"), F.when(win("code") == "", lose("code")).otherwise(win("code")).alias("code"),
            F.when(same, d).otherwise(F.concat(d, F.lit(" | "), e)).alias("description"),
        )

    one = F.aggregate(F.slice("xs", F.lit(2), F.size("xs")), F.col("xs")[0], merged)
    return groups.select("scan_id", one.alias("m")).select("scan_id", "m.seq", *(f"m.{c}" for c in FIELDS))


def _parts_of(text: Column, lengths: Column) -> Column:
    """All parts of a text that have one of the lengths, each once."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: F.substring(text, at, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(text)), of)))


def files_holding(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(category, file) of `files` that hold a pattern (category, pattern) of their category somewhere in the name.

    An index of whole patterns: a file name gives its parts of those lengths that patterns of its category have, and a part is a
    hit if it is a pattern. The work grows with file names, and with how many lengths there are, not with the number of patterns.
    """
    w = patterns.select(F.col("category").alias("__c"), F.col("pattern").alias("__p")).where("__p <> ''").distinct()
    lengths = w.groupBy("__c").agg(F.collect_set(F.length("__p")).alias("__n"))  # as many as file names have characters, at most
    parts = files.select("category", "file").distinct().join(lengths, F.col("category") == F.col("__c"))
    parts = parts.select("category", "file", F.explode(_parts_of(F.col("file"), F.col("__n"))).alias("__part"))
    return parts.join(w, (F.col("category") == F.col("__c")) & (F.col("__part") == F.col("__p")), "left_semi").select("category", "file").distinct()


def without_whitelisted(findings: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Findings that no whitelist row (pattern_hash, category, file_pattern) names, by hash or by category and a part of the file name.

    Only equal keys are joined, whatever the sizes; each file name is looked up once, however many findings it has.
    """
    h = finding_hash(F.col("category"), F.col("file"), F.col("description"))
    named = files_holding(findings, whitelist.select("category", F.col("file_pattern").alias("pattern")))
    hashes = whitelist.select(F.col("pattern_hash").alias("__h")).where("__h is not null").distinct()
    left = findings.withColumn("__h", h).join(hashes, "__h", "left_anti").drop("__h")
    return left.join(named, ["category", "file"], "left_anti").select(*findings.columns)


def relativised(findings: DataFrame, root: Column | str) -> DataFrame:
    return findings.withColumn("file", relative_path(F.col("file"), F.lit(root) if isinstance(root, str) else root))


#: Which component types each scanner looks at.
GATES = {"python": ("integration", "python_script", "unknown"), "api": ("integration", "python_script", "unknown"), "js": ("card", "unknown"), "yaml": None, "deps": None}


def union_gated(outputs: dict[str, DataFrame], components: DataFrame, gates: dict[str, tuple[str, ...] | None] = GATES) -> DataFrame:
    """All scanners' findings, each only of scans whose component_type its gate lets pass; renumbered by scanner, then own order.

    seq becomes (place of the scanner) * 2**40 + seq, so scanners keep the order of `outputs`.
    """
    types = components.select(F.col("scan_id").alias("__s"), "component_type")
    out = None
    for k, (name, df) in enumerate(outputs.items()):
        gate = gates.get(name)
        kept = df.join(types.where(F.col("component_type").isin(*gate)) if gate else types, F.col("scan_id") == F.col("__s"), "left_semi")
        kept = kept.withColumn("seq", F.lit(k << 40) + F.col("seq"))
        out = kept if out is None else out.unionByName(kept)
    return out


def _ends(paths: DataFrame, others: DataFrame) -> DataFrame:
    """(scan_id, category, file, end) of paths: their ends of those lengths that other paths of the category have, not a row for every character."""
    lengths = others.where("file <> ''").groupBy(F.col("category").alias("__c")).agg(F.collect_set(F.length("file")).alias("__n"))  # as many as paths have characters, at most
    x = paths.where("file <> ''").join(F.broadcast(lengths), F.col("category") == F.col("__c"))
    ends = F.transform(F.filter("__n", lambda n: n <= F.length("file")), lambda n: F.right(F.col("file"), n))
    return x.select("scan_id", "category", "file", F.explode(ends).alias("end"))


def novel_reviews(reviews: DataFrame, static: DataFrame) -> DataFrame:
    """Findings of a review that no static one of the scan has: same category, and one file path ends with the other.

    A severity that is none becomes medium. A review without a file is matched by category alone only if the static one has no file either.
    """
    key = ["scan_id", "category", "file"]
    of = lambda df: df.select("scan_id", "category", F.coalesce("file", F.lit("")).alias("file")).distinct()
    mine, theirs = of(reviews), of(static)
    # a path is known by its ends: the longer one has the shorter among them, so equal keys are all that is joined
    inside = _ends(mine, theirs).join(theirs.withColumnRenamed("file", "end"), ["scan_id", "category", "end"], "left_semi").select(*key)
    outside = mine.join(_ends(theirs, mine).select("scan_id", "category", F.col("end").alias("file")), key, "left_semi")
    nameless = mine.where("file = ''").join(theirs.where("file = ''"), key, "left_semi")
    known = inside.unionByName(outside).unionByName(nameless).distinct().withColumnRenamed("file", "__f")
    out = reviews.withColumn("__f", F.coalesce("file", F.lit(""))).join(known, ["scan_id", "category", "__f"], "left_anti").select(*reviews.columns)
    return out.withColumn("severity", F.when(severity_rank(F.lower("severity")).isNotNull(), F.lower("severity")).otherwise("medium"))


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    s = F.col("severity")
    return findings.groupBy(*by).agg(F.count_if(s == "critical").alias("critical"), F.count_if(s == "high").alias("high"), F.count("*").alias("total_findings"))


def by_severity(findings: DataFrame) -> list[Column]:
    """The order critical to info, unknown last, then seq: for orderBy."""
    return [F.coalesce(severity_rank(F.col("severity")), F.lit(-1)).desc(), F.col("seq").asc()]


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(scan_id, rule_id, level, name, n): one rule for each category; its first finding's severity sets the level."""
    first = findings.groupBy("scan_id", "category").agg(F.min_by("severity", "seq").alias("s"), F.count("*").alias("n"))
    level = F.when(F.col("s").isin("critical", "high"), "error").when(F.col("s") == "medium", "warning").otherwise("note")
    return first.select("scan_id", F.col("category").alias("rule_id"), level.alias("level"), F.initcap(F.replace("category", F.lit("_"), F.lit(" "))).alias("name"), "n")


def static_summary(findings: DataFrame, most: int = 20) -> DataFrame:
    """(scan_id, summary): the first findings as lines of text."""
    first = findings.withColumn("__n", F.row_number().over(Window.partitionBy("scan_id").orderBy("seq"))).where(F.col("__n") <= most)
    line = F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.col("file"), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit(" "), F.col("description"))
    return first.groupBy("scan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))), lambda x: x["t"]), "\n").alias("summary"))
