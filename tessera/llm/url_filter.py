"""URL filter: rules first, mined associations for the rest. DataFrame and SQL functions only.

Rules name a host and the start of a path; the longest that fits decides. Other urls are judged by association: FP-growth
mines combinations of url tokens, and a mark for bad pages, from labelled pages. A combination is held against the same one with the
mark: if that has enough support and confidence, and no part of the combination does as well, it becomes a rule. Rules are matched
by an inverted index: a rule is posted under the token that the fewest urls have, a url looks its tokens up, and a posting
counts if the url has all tokens of the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import fresh, materialize

#: (host, path, verdict): fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUPPORT, CONFIDENCE = 0.002, 0.6
#: Bad pages that a rule must rest on, however few pages are labelled: less is accident.
LEAST = 20
#: Labelled pages that mining looks at; the bound of the sample.
SAMPLE = 200_000
#: Parts of a token's urls that are matched apart, as one token may be in most of them.
SALTS = 8
BAD = "\x00bad"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits host or a domain above it, and the start of path; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a url: each label of the host (but www), each part of a label that has several, and those of path and query, with their place."""
    def parts(of: Column, pattern: str, mark: str) -> Column:
        return F.transform(F.filter(F.split(F.lower(of), pattern), lambda x: F.length(x) > 0), lambda x: F.concat(F.lit(mark), x))

    labels = F.filter(F.split(host_of(url), r"\."), lambda x: (F.length(x) > 0) & (x != "www"))
    joined = F.array_join(F.filter(labels, lambda x: x.rlike("[-_0-9]")), "-")
    tail = F.regexp_extract(url, r"[?#](.*)$", 1)
    return F.coalesce(F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), parts(joined, r"[\-_0-9]+", "w:"), parts(path_of(url), r"[/\-_.,]+", "p:"), parts(tail, r"[=&#?\-_]+", "q:"))), F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, url: str = "url", page_id: str = "page_id", label_id: str = "doc_id", bad: Column | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE, sample: int = SAMPLE) -> DataFrame:
    """(tokens, confidence, support) of the combinations of url tokens that mark bad pages; none with fewer than LEAST labelled pages.

    Labelled pages are those whose id a label names, `sample` of them at most, whose ids hash lowest. bad says which labels
    are bad: by default those of low quality or toxic. A combination that holds a rule of at least its confidence adds nothing and is
    left out. Null ids and urls are left out; of a page with several labels, one bad one counts; repeated pages count each.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = pages.sparkSession
    bad = F.expr("quality = 0 or toxic = 1") if bad is None else bad
    marked = labels.select(F.col(f"`{label_id}`").cast("long").alias("l"), F.coalesce(bad, F.lit(False)).alias("b")).where("l is not null").groupBy("l").agg(F.max("b").alias("b"))
    p = pages.select(F.col(f"`{page_id}`").cast("long").alias("p"), F.col(f"`{url}`").cast("string").alias("u")).where("p is not null and u is not null")
    rows = p.join(marked, F.col("p") == F.col("l")).select("p", "u", "b").orderBy(F.xxhash64("p"), "p", "u").limit(sample)
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), tokens_of(F.col("u")).alias("t"), "b"), "labelled")
    n, n_bad = rows.agg(F.count("*"), F.count_if("b")).first()
    schema = "tokens array<string>, confidence double, support double"
    if n < LEAST or not n_bad:
        return spark.createDataFrame([], schema)
    least = min(n, max(support * n, LEAST))
    # tokens that fewer bad pages have than any rule must rest on can be in none: they needn't reach the trees
    common = rows.where("b").select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("w")
    kept = rows.select("row", "b", F.explode("t").alias("w")).join(common, "w", "left_semi").groupBy("row").agg(F.collect_set("w").alias("t"), F.max("b").alias("b"))
    items = kept.select(F.when(F.col("b"), F.array_append("t", BAD)).otherwise(F.col("t")).alias("items"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = FPGrowth(itemsCol="items", minSupport=least / n, numPartitions=parts).fit(items).freqItemsets
    sets = materialize(sets.select(F.array_sort(F.filter("items", lambda x: x != BAD)).alias("tokens"), F.array_contains("items", BAD).alias("b"), "freq").where(F.size("tokens") > 0), "itemsets")
    share = (F.col("f") / F.col("freq")).alias("confidence")
    rules = sets.where("b").select("tokens", F.col("freq").alias("f")).join(sets.where("not b").select("tokens", "freq"), "tokens").select("tokens", share, (F.col("f") / n).alias("support")).where(F.col("confidence") >= confidence)
    rules = materialize(rules, "rules")
    few = rules.select(F.explode("tokens").alias("k"), F.col("tokens").alias("all"), F.col("confidence").alias("sure"))
    held = rules.select(F.element_at("tokens", 1).alias("k"), F.col("tokens").alias("part"), F.col("confidence").alias("own")).join(few, "k")
    held = held.where((F.size("part") < F.size("all")) & (F.col("own") >= F.col("sure")) & (F.size(F.array_except("part", "all")) == 0)).select(F.col("all").alias("tokens")).distinct()
    return rules.join(held, "tokens", "left_anti").select("tokens", "confidence", "support")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(u) of the distinct urls, rows (u, t), that hold all tokens of a rule: by an index of the rules under the token that fewest urls have."""
    own = rules.select(F.explode("tokens").alias("k"), "tokens")
    counted = urls.select(F.explode("t").alias("k")).join(own.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.count("*").alias("n"))
    # a rule with a token that no url has matches none
    key = own.join(counted, "k", "left").groupBy("tokens").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k")).alias("m")).where("m.n > 0")
    key = key.select("tokens", F.col("m.k").alias("k"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    looked = urls.select("u", "t", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("t").alias("k")).join(key, ["k", "salt"]).where(F.size(F.array_except("tokens", "t")) == 0)
    return looked.select("u").distinct()


def judge(pages: DataFrame, mined: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced, all others and all rows stay.

    A null url, or one without ://, has an empty host and path, fits no rule and is allowed unless its tokens match.
    Columns of pages may have any other names.
    """
    own = ("host", "path", "rule", "verdict")
    names = [c for c in pages.columns if c.lower() not in own]
    u, host, path, rule, bad = fresh(pages.columns, "u", "h", "p", "r", "bad")
    p = pages.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{url}`").cast("string").alias(u))
    p = p.withColumns({host: host_of(F.col(u)), path: path_of(F.col(u))})
    p = p.withColumn(rule, rule_for(F.col(host), F.col(path), rules))
    open_ = p.where(F.col(rule).isNull() & F.col(u).isNotNull()).select(F.col(u).alias("u")).distinct().select("u", tokens_of(F.col("u")).alias("t"))
    found = matches(open_, mined).select(F.col("u").alias(bad))
    p = p.join(found, F.col(u) == F.col(bad), "left")
    verdict = F.coalesce(F.col(f"{rule}.verdict"), F.when(F.col(bad).isNotNull(), "block").otherwise("allow"))
    return p.select(*(F.col(f"`{c}`") for c in names), F.col(host).alias("host"), F.col(path).alias("path"), F.col(f"{rule}.rule").alias("rule"), verdict.alias("verdict"))
