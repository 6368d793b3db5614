"""The named queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import ast_rules, findings, history, line_rules, table_functions
from tessera.plans import adapters as A
from tessera.plans import jobs, requests
from tessera.plans.expected import EXPECTED
from tessera.plans.sample import SAMPLE
from tessera.plans.scan import scan
from tessera.sources import deps, feed_service, files, report_files, sinks
from tessera.sources.tables import Tables
from tessera.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, *shapes: str, sql: str | None = None, **ctes: str):
    """Registers f over DataFrames of the shapes; sql reads them as t0, t1, ... and the ctes by name."""

    def put(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*(A.make(spark, sf_dir, s) for s in shapes))
        if sql:
            parts = [f"t{k} AS ({A.text(s)})" for k, s in enumerate(shapes)] + [f"{k} AS ({v})" for k, v in ctes.items()]
            SQL[name] = f"WITH {', '.join(parts)} {sql}"
        return f

    return put


RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 WHEN 'info' THEN 0 END"
NORMAL = "CASE category WHEN 'taint_code_injection' THEN 'code_injection' WHEN 'script_injection' THEN 'xss' ELSE category END"
#: The fold of duplicates, over lists of structs in order of seq.
MERGED = f"""
SELECT scan_id, r.seq AS seq, r.severity AS severity, r.category AS category, r.file AS file, r.line AS line, r.code AS code, r.description AS description FROM (
  SELECT scan_id, list_reduce(list({{'seq': seq, 'rank': {RANK}, 'severity': severity, 'category': category, 'file': file, 'line': line, 'code': code, 'description': description}} ORDER BY seq), lambda a, b: {{
    'seq': a.seq, 'rank': greatest(a.rank, b.rank),
    'severity': CASE WHEN b.rank > a.rank THEN b.severity ELSE a.severity END, 'category': CASE WHEN b.rank > a.rank THEN b.category ELSE a.category END, 'file': a.file,
    'line': CASE WHEN b.rank > a.rank THEN coalesce(nullif(b.line, 0), a.line) ELSE coalesce(nullif(a.line, 0), b.line) END,
    'code': CASE WHEN b.rank > a.rank THEN (CASE WHEN b.code = '' THEN a.code ELSE b.code END) ELSE (CASE WHEN a.code = '' THEN b.code ELSE a.code END) END,
    'description': CASE WHEN b.rank > a.rank
      THEN (CASE WHEN a.description = '' OR starts_with(b.description, left(a.description, 30)) OR starts_with(a.description, left(b.description, 30)) THEN b.description ELSE b.description || ' | ' || a.description END)
      ELSE (CASE WHEN b.description = '' OR starts_with(a.description, left(b.description, 30)) OR starts_with(b.description, left(a.description, 30)) THEN a.description ELSE a.description || ' | ' || b.description END) END
  }}) AS r
  FROM (SELECT *, coalesce(nullif(line, 0), -1) AS ln, {NORMAL} AS cat FROM t0) GROUP BY scan_id, file, ln, cat)
"""
CAPPED = "SELECT scan_id, seq, severity, category, file, line, code, description FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, file, category ORDER BY seq) AS n FROM t0) WHERE n <= 3"


@query("findings_cap_per_file", A.FINDINGS, sql=CAPPED)
def _(f):
    return findings.cap_per_file(f)


@query("findings_aggregate_noisy", A.FINDINGS, sql="""
SELECT scan_id, seq, severity, category, file, line, code, description FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, category = 'network' AND severity = 'info' ORDER BY seq) AS n FROM t0)
WHERE NOT (category = 'network' AND severity = 'info') OR n <= 5
UNION ALL SELECT scan_id, 4611686018427387904, 'info', 'network', '(aggregated)', NULL, '', concat('...and ', count(*) - 5, ' more network findings (total ', count(*), ' across repo)')
FROM t0 WHERE category = 'network' AND severity = 'info' GROUP BY scan_id HAVING count(*) > 5""")
def _(f):
    return findings.aggregate_noisy(f)


@query("findings_merge", A.FINDINGS, sql=MERGED)
def _(f):
    return findings.merge_duplicates(f)


@query("findings_severity_stats", A.FINDINGS, merged=MERGED, sql="""
SELECT scan_id, file, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) AS total_findings FROM merged GROUP BY scan_id, file""")
def _(f):
    return findings.severity_counts(findings.merge_duplicates(f), "scan_id", "file")


@query("findings_sorted_topk", A.FINDINGS, sql=f"SELECT scan_id, seq, severity, category, file FROM t0 ORDER BY coalesce({RANK}, -1) DESC, seq, scan_id LIMIT 100")
def _(f):
    return f.orderBy(*findings.by_severity(f), "scan_id").limit(100).select("scan_id", "seq", "severity", "category", "file")


@query("findings_proposal", A.FINDINGS, sql="""
SELECT severity, category, CASE WHEN severity IN ('critical', 'high') AND category IN ('code_injection', 'command_execution') THEN 'Remove / Fix' WHEN severity = 'critical' THEN 'Fix'
  WHEN severity = 'high' AND category IN ('deserialization', 'native_code', 'data_exfiltration') THEN 'Fix' WHEN severity IN ('high', 'medium') THEN 'Investigate'
  WHEN severity = 'low' AND category IN ('telemetry', 'tracking') THEN 'Keep / Remove' ELSE 'Keep' END AS proposal, count(*) AS n FROM t0 GROUP BY ALL""")
def _(f):
    return f.groupBy("severity", "category", S.proposal(F.col("severity"), F.col("category")).alias("proposal")).agg(F.count("*").alias("n"))


@query("findings_fix", A.FINDINGS, sql="""
SELECT category, CASE category WHEN 'code_injection' THEN 'Replace eval()/exec() with ast.literal_eval() or a safe parser' WHEN 'telemetry' THEN 'Optionally disable telemetry or verify collected data'
  WHEN 'network' THEN 'Check if network connections are necessary and secure' ELSE 'Review code manually and assess risk' END AS fix, count(*) AS n FROM t0 GROUP BY ALL""")
def _(f):
    return f.groupBy("category", S.suggested_fix(F.col("category")).alias("fix")).agg(F.count("*").alias("n"))


@query("findings_whitelist_filter", A.FINDINGS, A.WHITELIST, sql="""
SELECT scan_id, seq, category, file, description FROM t0 WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.pattern_hash = substr(sha256(concat_ws('|', t0.category, t0.file, t0.description)), 1, 16))
AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.category = t0.category AND t1.file_pattern <> '' AND contains(t0.file, t1.file_pattern))""")
def _(f, w):
    return findings.without_whitelisted(f, w).select("scan_id", "seq", "category", "file", "description")


@query("findings_hash", A.FINDINGS, sql="SELECT scan_id, seq, substr(sha256(concat_ws('|', category, file, description)), 1, 16) AS hash FROM t0")
def _(f):
    return f.select("scan_id", "seq", S.finding_hash(F.col("category"), F.col("file"), F.col("description")).alias("hash"))


@query("findings_llm_novel", A.FINDINGS, sql="""
SELECT scan_id, seq, severity, category, file FROM (SELECT scan_id, seq, CASE WHEN seq % 5 = 0 THEN 'medium' ELSE severity END AS severity, category, CASE WHEN seq % 11 = 0 THEN '' ELSE replace(file, 'src/', 'lib/src/') END AS file FROM t0) r
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT scan_id, category, file FROM t0) s WHERE s.scan_id = r.scan_id AND s.category = r.category AND r.file <> '' AND (ends_with(r.file, s.file) OR ends_with(s.file, r.file)))""")
def _(f):
    """Both sides are made of the findings, which are joined and numbered once, and read three times from what was written."""
    folder = _new_folder(f.sparkSession, "reviewed")
    f.select("scan_id", "seq", "severity", "category", "file").write.parquet(folder)
    f = f.sparkSession.read.parquet(folder)
    r = f.withColumns({"severity": F.when(F.col("seq") % 5 == 0, "odd").otherwise(F.col("severity")), "file": F.when(F.col("seq") % 11 == 0, "").otherwise(F.replace("file", F.lit("src/"), F.lit("lib/src/")))})
    return findings.novel_reviews(r, f).select("scan_id", "seq", "severity", "category", "file")


@query("findings_sarif_rules", A.FINDINGS, sql="""
SELECT scan_id, category AS rule_id, CASE WHEN s IN ('critical', 'high') THEN 'error' WHEN s = 'medium' THEN 'warning' ELSE 'note' END AS level, n
FROM (SELECT scan_id, category, arg_min(severity, seq) AS s, count(*) AS n FROM t0 GROUP BY ALL)""")
def _(f):
    return findings.sarif_rules(f).select("scan_id", "rule_id", "level", "n")


@query("findings_union_gated", A.FINDINGS, A.COMPONENTS, sql="""
SELECT t0.scan_id, category, count(*) AS n, min(seq) AS first_seq FROM t0 JOIN t1 ON t0.scan_id = t1.scan_id
WHERE (category = 'network' AND component_type IN ('integration', 'python_script', 'unknown')) OR (category = 'xss' AND component_type IN ('card', 'unknown')) OR category = 'telemetry' GROUP BY ALL""")
def _(f, c):
    out = findings.union_gated({"python": f.where("category = 'network'"), "js": f.where("category = 'xss'"), "yaml": f.where("category = 'telemetry'")}, c)
    return out.groupBy("scan_id", "category").agg(F.count("*").alias("n"), F.min(F.col("seq") % F.lit(1 << 40)).alias("first_seq"))


@query("findings_relative_paths", A.FINDINGS, sql="SELECT scan_id, seq, CASE WHEN starts_with(file, 'src/') THEN substr(file, 5) ELSE file END AS file FROM t0")
def _(f):
    return findings.relativised(f, "src").select("scan_id", "seq", "file")


@query("findings_static_summary", A.FINDINGS, sql="""
SELECT scan_id, sha256(string_agg(concat('- [', severity, '] ', file, ':', coalesce(CAST(line AS VARCHAR), '?'), ' ', description), chr(10) ORDER BY seq)) AS summary_hash FROM t0 WHERE seq <= 20 GROUP BY scan_id""")
def _(f):
    return findings.static_summary(f).select("scan_id", F.sha2(F.col("summary").cast("binary"), 256).alias("summary_hash"))


TREND = """
scored AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY scanned_at DESC, id DESC) AS back FROM t0 WHERE score IS NOT NULL),
rep AS (SELECT a.domain, scan_count, avg_score, latest_score, CASE WHEN n < 2 OR n IS NULL THEN 'stable' WHEN newest - oldest > 0.5 THEN 'improving' WHEN newest - oldest < -0.5 THEN 'declining' ELSE 'stable' END AS trend
  FROM (SELECT domain, count(*) AS scan_count, round_even(avg(score), 1) AS avg_score FROM t0 GROUP BY domain) a
  LEFT JOIN (SELECT domain, count(*) AS n, max(score) FILTER (WHERE back = 1) AS latest_score, max(score) FILTER (WHERE back = 1) AS newest, arg_max(score, back) FILTER (WHERE back <= 3) AS oldest FROM scored GROUP BY domain) b ON a.domain = b.domain)
"""


def _with(name: str, shape: str, more: str, select: str) -> None:
    SQL[name] = f"WITH t0 AS ({A.text(shape)}), {more.strip()} {select}"


@query("history_reputation", A.HISTORY)
def _(h):
    return history.reputation(h)


@query("history_all_reputations", A.HISTORY)
def _(h):
    return history.all_reputations(h).select("domain", "repo_url", "scan_count", "avg_score", "latest_score", "trend")


_with("history_reputation", A.HISTORY, TREND, "SELECT domain, scan_count, avg_score, latest_score, trend FROM rep")
_with("history_all_reputations", A.HISTORY, TREND, "SELECT k.domain, repo_url, scan_count, avg_score, latest_score, trend FROM (SELECT DISTINCT domain, repo_url FROM t0 WHERE domain <> '') k JOIN rep ON k.domain = rep.domain")


@query("history_timeline", A.HISTORY, sql="SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY scanned_at, id) AS n FROM t0")
def _(h):
    return history.timeline(h).select("domain", "id", F.col("n").cast("long").alias("n"))


@query("history_score_delta", A.HISTORY, sql="""
SELECT domain, max(score) FILTER (WHERE n = 1) AS latest, max(score) FILTER (WHERE n = 2) AS previous, round_even(max(score) FILTER (WHERE n = 1) - max(score) FILTER (WHERE n = 2), 1) AS delta
FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY scanned_at DESC, id DESC) AS n FROM t0) WHERE n <= 2 GROUP BY domain HAVING count(*) = 2""")
def _(h):
    return history.score_delta(h)


LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM t0 WHERE score IS NOT NULL" for m in history.METRICS)
BASE = """SELECT metric, round_even(avg(v), 2) AS mean, round_even(stddev_pop(v), 2) AS stddev, list_sort(list(v))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS percentile_95, count(*) AS sample_count FROM long_ GROUP BY metric HAVING count(*) >= 10"""


@query("history_baseline", A.HISTORY, long_=LONG, sql=BASE)
def _(h):
    return history.baseline(h)


WATCHED = " UNION ALL ".join(f"SELECT id, domain, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM t0" for m in history.WATCHED)


@query("history_deviations", A.HISTORY, long_=LONG, base=BASE, rows_=WATCHED, sql="""
SELECT id, domain, rows_.metric, value, mean, stddev, round_even(abs(value - mean) / stddev, 1) AS z_score, CASE WHEN value > mean THEN 'above' ELSE 'below' END AS direction
FROM rows_ JOIN base ON rows_.metric = base.metric WHERE stddev > 0 AND value IS NOT NULL AND abs(value - mean) / stddev > 2""")
def _(h):
    return history.deviations(h, history.baseline(h))


@query("history_score_label", A.HISTORY, sql="SELECT CASE WHEN score IS NULL THEN 'N/A' WHEN score >= 8 THEN 'SAFE' WHEN score >= 5 THEN 'CAUTION' ELSE 'DANGER' END AS label, count(*) AS n FROM t0 GROUP BY ALL")
def _(h):
    return h.groupBy(S.score_label(F.col("score")).alias("label")).agg(F.count("*").alias("n"))


KEYED = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, id DESC) AS place FROM (SELECT *, coalesce(nullif(domain, ''), repo_url) AS key, substr(sha256(concat_ws(chr(10), array_to_string(list_sort(imports), ','), array_to_string(list_sort(ha_apis), ','), array_to_string(list_sort(network_domains), ','))), 1, 16) AS hash FROM t0)"
DIFFS = """SELECT o.key, array_to_string(list_sort(list_filter(n.imports, lambda x: NOT list_contains(o.imports, x))), ',') AS imports_added, array_to_string(list_sort(list_filter(o.imports, lambda x: NOT list_contains(n.imports, x))), ',') AS imports_removed,
array_to_string(list_sort(list_filter(n.network_domains, lambda x: NOT list_contains(o.network_domains, x))), ',') AS domains_added, array_to_string(list_sort(list_filter(o.network_domains, lambda x: NOT list_contains(n.network_domains, x))), ',') AS domains_removed,
CASE WHEN o.total_lines > 0 AND n.total_lines > 0 AND abs(round_even((n.total_lines - o.total_lines) / o.total_lines * 100, 1)) > 10 THEN round_even((n.total_lines - o.total_lines) / o.total_lines * 100, 1) END AS change_pct, o.hash <> n.hash AS changed
FROM keyed n JOIN keyed o ON n.key = o.key AND n.place = 1 AND o.place = 2"""


def _fps(f: DataFrame) -> DataFrame:
    return f.withColumn("fingerprint_hash", history.fingerprint_hash("imports", "ha_apis", "network_domains"))


def _diff(f: DataFrame, *more: str) -> DataFrame:
    text = lambda c: F.array_join(c, ",")
    return f.select("key", text("imports_added").alias("imports_added"), text("imports_removed").alias("imports_removed"), text("network_domains_added").alias("domains_added"), text("network_domains_removed").alias("domains_removed"), "change_pct", "changed", *more)


@query("fp_latest", A.FINGERPRINTS, keyed=KEYED, sql="SELECT key, id, hash AS fingerprint_hash FROM keyed WHERE place = 1")
def _(f):
    return history.latest_fingerprints(_fps(f)).select("key", "id", "fingerprint_hash")


@query("fp_diff", A.FINGERPRINTS, keyed=KEYED, sql=DIFFS)
def _(f):
    return _diff(history.fingerprint_diffs(_fps(f)))


@query("fp_changed_all", A.FINGERPRINTS, keyed=KEYED, sql=f"SELECT * FROM ({DIFFS}) WHERE changed")
def _(f):
    return _diff(history.changed_components(_fps(f)))


@query("fp_total_tracked", A.FINGERPRINTS, sql="SELECT count(DISTINCT coalesce(nullif(domain, ''), repo_url)) AS total_tracked FROM t0")
def _(f):
    return history.total_tracked(f)


def _items(column: str, where: str, least: int, tail: str) -> str:
    return f"""SELECT item, count(*) AS count, string_agg(key, ',' ORDER BY key) AS components FROM (SELECT DISTINCT key, unnest({column}) AS item FROM keyed WHERE place = 1) {where} GROUP BY item HAVING count(*) >= {least} {tail}"""


@query("intel_shared_domains", A.FINGERPRINTS, keyed=KEYED, sql=_items("network_domains", "", 2, "ORDER BY count DESC, item LIMIT 20"))
def _(f):
    return history.shared_domains(f)


@query("intel_shared_imports", A.FINGERPRINTS, keyed=KEYED, sql=_items("imports", "WHERE item <> 'os'", 2, "ORDER BY count DESC, item LIMIT 20"))
def _(f):
    return history.shared_imports(f)


@query("intel_suspicious", A.FINGERPRINTS, keyed=KEYED, sql=_items("network_domains", "WHERE contains(item, 'pastebin.com')", 1, ""))
def _(f):
    return history.suspicious_hosts(f)


@query("intel_outliers", A.FINGERPRINTS, keyed=KEYED, latest="SELECT key, total_lines, avg(total_lines) FILTER (WHERE total_lines > 0) OVER () AS mean, count(*) OVER () AS n FROM keyed WHERE place = 1", sql="""
SELECT key, total_lines, round_even(mean, 0) AS avg_lines, round_even(total_lines / mean, 2) AS ratio, CASE WHEN total_lines / mean > 3 THEN 'larger' ELSE 'smaller' END AS direction
FROM latest WHERE n >= 3 AND total_lines > 0 AND (total_lines / mean > 3 OR total_lines / mean < 0.1)""")
def _(f):
    return history.size_outliers(f)


REQ = "SELECT id, scan_id, ecosystem, regexp_extract(req, '^([a-zA-Z0-9_.-]+)\\s*[=<>!~]+\\s*([\\d.]+)', 1) AS package, regexp_extract(req, '^([a-zA-Z0-9_.-]+)\\s*[=<>!~]+\\s*([\\d.]+)', 2) AS version FROM t0"


def _required(p: DataFrame) -> DataFrame:
    return p.withColumn("r", deps.requirement(F.col("req"))).where("r is not null").select("id", "scan_id", "ecosystem", "r.package", "r.version")


@query("deps_requirements", A.PACKAGES, req_=REQ, sql="SELECT * FROM req_ WHERE package <> ''")
def _(p):
    return _required(p)


@query("deps_malicious", A.PACKAGES, req_=REQ, sql="SELECT id, scan_id, package, version FROM req_ WHERE lower(package) IN ('colourama', 'ctx', 'jeilyfish')")
def _(p):
    return deps.malicious(_required(p)).select("id", "scan_id", "package", "version")


VULN = """CASE WHEN NOT contains(score, 'CVSS') OR part IS NULL THEN 'high' WHEN part >= 9 THEN 'critical' WHEN part >= 7 THEN 'high' WHEN part >= 4 THEN 'medium' ELSE 'low' END"""
PART = "SELECT *, TRY_CAST(list_filter(string_split(score, '/'), lambda p: regexp_full_match(p, '[0-9.]*[0-9][0-9.]*'))[1] AS DOUBLE) AS part FROM "


@query("deps_vulnerable", A.PACKAGES, A.FEED, req_=REQ, feed_=PART + "t1", sql=f"SELECT id, scan_id, req_.package, req_.version, vuln_id, {VULN} AS severity FROM req_ JOIN feed_ ON lower(req_.package) = lower(feed_.package) AND req_.version = feed_.version WHERE req_.package <> ''")
def _(p, f):
    return deps.vulnerable(_required(p), f).select("id", "scan_id", "package", "version", "vuln_id", "severity")


@query("deps_distinct_first", A.PACKAGES, req_=REQ, sql="SELECT scan_id, lower(package) AS package, version, min(id) AS id FROM req_ WHERE package <> '' GROUP BY ALL")
def _(p):
    return deps.distinct_first(_required(p), "id").select("scan_id", F.lower("package").alias("package"), "version", "id")


@query("vuln_severity", A.FEED, part_=PART + "t0", sql=f"SELECT score, {VULN} AS severity, count(*) AS n FROM part_ GROUP BY ALL")
def _(f):
    return f.groupBy("score", S.vulnerability_severity(F.col("score")).alias("severity")).agg(F.count("*").alias("n"))


LINES = "SELECT scan_id, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM t0"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules_sql(rules, hit) -> str:
    one = [f"SELECT scan_id, path AS file, {k} AS rule, {_quoted(sev)} AS severity, {_quoted(cat)} AS category, min(line) AS line FROM lines WHERE {hit(p)} GROUP BY scan_id, path" for k, (p, sev, cat) in enumerate(rules)]
    return " UNION ALL ".join(one)


@query("scan_script_patterns", A.SOURCES, lines=LINES, sql=_rules_sql(line_rules.SCRIPT_PATTERNS, lambda p: f"regexp_matches(text, {_quoted(p)})"))
def _(s):
    return line_rules.scan_script_patterns(s).select("scan_id", "file", "rule", "severity", "category", F.col("line").cast("long").alias("line"))


@query("scan_text_parts", A.SOURCES, lines=LINES, sql=_rules_sql(line_rules.PYTHON_PARTS, lambda p: f"contains(lower(text), {_quoted(p)})"))
def _(s):
    return line_rules.scan_parts(s).select("scan_id", "file", "rule", "severity", "category", F.col("line").cast("long").alias("line"))


@query("scan_secret_comment", A.SOURCES, lines=LINES, sql=f"""
SELECT scan_id, file, line FROM (SELECT scan_id, path AS file, line, row_number() OVER (PARTITION BY scan_id, path ORDER BY line) AS n FROM lines WHERE regexp_matches(text, {_quoted(line_rules.SECRET_IN_COMMENT)})) WHERE n <= 3""")
def _(s):
    return line_rules.scan_secret_comments(s).select("scan_id", "file", F.col("line").cast("long").alias("line"))


def _count(p: str) -> str:
    return f"len(regexp_extract_all(content, {_quoted(p)}))"


IFRAME = r"(?i)\biframe\b"
#: The hosts of the first 20 urls that aren't safe, each once, ten at most.
FOREIGN = f"""array_to_string(list_slice(list_sort(list_distinct(list_transform(list_slice(list_filter(regexp_extract_all(content, {_quoted(line_rules.URL)}), lambda u: NOT regexp_matches(u, '{'|'.join(h.replace('.', '[.]') for h in line_rules.SAFE_HOSTS)}')), 1, 20), lambda u: string_split(string_split(u, '//')[2], '/')[1]))), 1, 10), ',')"""


@query("scan_obfuscation_score", A.SOURCES, sql=f"""
SELECT scan_id, path, {_count('_0x[0-9a-f]{4,}')} AS hex_refs, {_count(line_rules.PAYWALL[0][0])} + 3 * {_count(line_rules.PAYWALL[1][0])} + 2 * {_count(line_rules.PAYWALL[2][0])} AS paywall_score,
  {_count('(?i)paypal')} AS paypal_refs, {_count('(?i)stripe')} AS stripe_refs, {_count(IFRAME)} AS iframe_refs, {FOREIGN} AS hosts FROM t0 WHERE {_count('_0x[0-9a-f]{4,}')} >= 5""")
def _(s):
    n = ("hex_refs", "paywall_score", "paypal_refs", "stripe_refs", "iframe_refs")
    return line_rules.obfuscation_scores(s).select("scan_id", "path", *(F.col(c).cast("long").alias(c) for c in n), "hosts")


@query("context_budget", A.CONTEXT, cut="SELECT *, coalesce(sum(length(left(content, 8000))) OVER (PARTITION BY scan_id ORDER BY prio, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t0", sql="""
SELECT scan_id, count(*) AS n_files, CAST(sum(length(left(content, 8000))) AS BIGINT) AS n_chars, sha256(string_agg(concat('--- ', path, ' ---', chr(10), left(content, 8000)), concat(chr(10), chr(10)) ORDER BY prio, path)) AS context_hash FROM cut WHERE before < 15000 GROUP BY scan_id""")
def _(c):
    return files.context_budget(c).select("scan_id", "n_files", "n_chars", F.sha2(F.col("context").cast("binary"), 256).alias("context_hash"))


@query("jobs_batch_status", A.JOBS, sql="SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, CASE WHEN count(*) FILTER (WHERE status IN ('done', 'failed')) >= count(*) THEN 'done' ELSE 'running' END AS status FROM t0 GROUP BY batch_id")
def _(j):
    return history.batch_status(j)


@query("jobs_retention", A.JOBS, sql="SELECT id, status FROM t0 WHERE NOT (created_at < TIMESTAMP '1995-01-01 00:00:00' AND status <> 'running')")
def _(j):
    return history.retained(j, F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")).select("id", "status")


@query("jobs_recovery", A.JOBS, sql="SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status FROM t0")
def _(j):
    return history.recovered(j).select("id", "status")


@query("jobs_active", A.JOBS, sql="SELECT id, batch_id FROM t0 WHERE status = 'running'")
def _(j):
    return history.active(j).select("id", "batch_id")


@query("jobs_upsert", A.JOBS, sql="SELECT id, CASE WHEN id % 5 = 0 THEN 'done' ELSE status END AS status FROM t0")
def _(j):
    return history.upsert(j, j.where("id % 5 = 0").withColumn("status", F.lit("done")), "id").select("id", "status")


@query("watch_new_alerts", A.CHECKS, lagged="SELECT *, lag(alerts) OVER (PARTITION BY component ORDER BY checked_at, id) AS before FROM t0", sql="""
SELECT component, id, unnest(list_filter(list_distinct(alerts), lambda a: before IS NULL OR NOT list_contains(before, a))) AS alert FROM lagged""")
def _(c):
    return watch.new_alerts(c).select("component", "id", "alert")


@query("status_newest", A.HISTORY, sql="SELECT domain, arg_max(id, scanned_at) AS id FROM t0 GROUP BY domain")
def _(h):
    return watch.newest_status(h).select("domain", "id")


@query("status_topics", A.HISTORY, sql="""
SELECT concat('scanner/', domain, '/state') AS topic, CASE WHEN score IS NULL THEN 'none' ELSE CAST(CAST(score * 2 AS BIGINT) AS VARCHAR) END AS doubled_score, findings_count
FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY scanned_at DESC, id DESC) AS n FROM t0) WHERE n = 1""")
def _(h):
    """The payloads read again as JSON."""
    x = sinks.status_topics(h).select("topic", F.from_json("payload", "score double, findings_count long").alias("p"))
    return x.select("topic", F.coalesce((F.col("p.score") * 2).cast("long").cast("string"), F.lit("none")).alias("doubled_score"), F.col("p.findings_count").alias("findings_count"))


@query("status_messages", A.HISTORY, A.JOBS, last="SELECT * FROM t0 ORDER BY scanned_at DESC, id DESC LIMIT 1", n="SELECT count(*) AS c FROM t1 WHERE status = 'done'", sql="""
SELECT 'node/status' AS topic, 'done' AS payload, true AS retain UNION ALL SELECT 'node/last_scan', domain, true FROM last
UNION ALL SELECT 'node/last_score', coalesce(CAST(score AS VARCHAR), 'N/A'), true FROM last UNION ALL SELECT 'node/scans_total', CAST(c AS VARCHAR), true FROM n""")
def _(h, j):
    return sinks.result_messages(h.select("id", F.col("domain").alias("name"), F.lit("done").alias("status"), "score", "scanned_at"), "node", history.scans_total(j))


@query("discovery_messages", A.HISTORY, sql="""
SELECT concat('homeassistant/sensor/', d, '/', k, '/config') AS topic, n AS name, concat(d, '_', k) AS unique_id, concat(d, '/', k) AS state_topic, i AS icon
FROM (SELECT DISTINCT domain AS d FROM t0) c, (VALUES ('status', 'Status', 'mdi:shield-search'), ('last_scan', 'Last Scan', 'mdi:clock-check'), ('last_score', 'Last Score', 'mdi:counter'), ('scans_total', 'Total Scans', 'mdi:numeric')) v(k, n, i)""")
def _(h):
    """The messages of every component, their payloads read again as JSON."""
    x = sinks.discovery_messages(h.select(F.col("domain").alias("node")))
    return x.select("topic", F.from_json("payload", "name string, unique_id string, state_topic string, icon string").alias("p")).select("topic", "p.*")


@query("jobs_scans_total", A.JOBS, sql="SELECT count(*) AS scans_total FROM t0 WHERE status = 'done'")
def _(j):
    return history.scans_total(j)


BATCHES = "SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, CASE WHEN count(*) FILTER (WHERE status IN ('done', 'failed')) >= count(*) THEN 'done' ELSE 'running' END AS status, CAST(min(created_at) AS VARCHAR) AS created_at FROM t0 GROUP BY batch_id"


@query("jobs_batch", A.JOBS, b=BATCHES, sql="SELECT * FROM b WHERE batch_id = 'b7'")
def _(j):
    return history.batch(j, "b7").withColumn("created_at", F.col("created_at").cast("string"))


@query("jobs_active_batches", A.JOBS, b=BATCHES, sql="SELECT * FROM b WHERE status = 'running'")
def _(j):
    return history.active_batches(j).withColumn("created_at", F.col("created_at").cast("string"))


@query("whitelist_add", A.WHITELIST, sql="""
SELECT pattern_hash, category, file_pattern FROM t0 WHERE pattern_hash <> substr(sha256('xss|f.js|d'), 1, 16) UNION ALL SELECT substr(sha256('xss|f.js|d'), 1, 16), 'xss', 'f.js'""")
def _(w):
    x = jobs.add_whitelist(w.withColumns({"description": F.lit(""), "reason": F.lit(""), "created_at": F.lit(0)}), "xss", "f.js", "d", "fine here", F.lit(1))
    return x.select("pattern_hash", "category", "file_pattern")


@query("whitelist_remove", A.WHITELIST, sql="SELECT pattern_hash, category, file_pattern FROM t0 WHERE pattern_hash <> 'none1'")
def _(w):
    return jobs.remove_whitelist(w, "none1")


@query("whitelist_newest", A.WHITELIST, sql="SELECT pattern_hash, category, file_pattern FROM t0 WHERE file_pattern <> ''")
def _(w):
    """The whole list, as it is told, newest first."""
    return jobs.whitelist_newest(w.where("file_pattern <> ''").withColumn("created_at", F.col("file_pattern"))).drop("created_at")


def _new_folder(spark: SparkSession, name: str) -> str:
    """A folder of one's own that driver and executors share."""
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith(("local[", "local*")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(folder or 'file:///tmp/tessera-shared').rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("tables_round_trip", A.JOBS, sql="SELECT CAST(id AS VARCHAR) AS id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, batch_id FROM t0 UNION ALL SELECT concat('again', id), status, batch_id FROM t0")
def _(j):
    """Jobs written, recovered into a new version, appended to, and read back."""
    t = Tables(j.sparkSession, _new_folder(j.sparkSession, "tables"))
    t.save("jobs", j)
    t.save("jobs", history.recovered(t.load("jobs")))
    t.append("jobs", j.withColumn("id", F.concat(F.lit("again"), F.col("id").cast("string"))))
    return t.load("jobs").select("id", "status", "batch_id")


@query("text_slugs", A.HISTORY, sql="SELECT DISTINCT domain, regexp_replace(lower(concat(domain, '.X y')), '[^a-z0-9_-]', '', 'g') AS slug FROM t0")
def _(h):
    return h.select("domain", S.slug(F.concat("domain", F.lit(".X y"))).alias("slug")).distinct()


@query("text_masked", A.JOBS, sql="SELECT id, CASE WHEN length(concat('secret', id)) > 12 THEN concat(left(concat('secret', id), 8), '...', right(concat('secret', id), 4)) ELSE repeat('*', length(concat('secret', id))) END AS masked FROM t0")
def _(j):
    return j.select("id", S.masked(F.concat(F.lit("secret"), F.col("id").cast("string"))).alias("masked"))


LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"
RUN = "version string, runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string>>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>>>>>"


@query("report_sarif", A.FINDINGS, merged=MERGED, sql=f"""
SELECT m.scan_id, '2.1.0' AS version, n_rules, row_number() OVER (PARTITION BY m.scan_id ORDER BY seq) AS place, category AS rule_id, {LEVEL} AS level, description AS message, file AS uri, greatest(coalesce(line, 1), 1) AS start_line
FROM merged m JOIN (SELECT scan_id, count(DISTINCT category) AS n_rules FROM merged GROUP BY scan_id) r ON m.scan_id = r.scan_id""")
def _(f):
    """The SARIF text of each scan, read again as JSON: a row for each result."""
    doc = sinks.sarif(findings.merge_duplicates(f)).select("scan_id", F.from_json("sarif", RUN).alias("d")).select("scan_id", "d.version", F.col("d.runs")[0].alias("run"))
    # picked before results are opened: else each result carries its whole run
    x = doc.select("scan_id", "version", F.size("run.tool.driver.rules").cast("long").alias("n_rules"), F.col("run.results").alias("results")).select("scan_id", "version", "n_rules", F.posexplode("results").alias("p", "r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return x.select("scan_id", "version", "n_rules", (F.col("p") + 1).cast("long").alias("place"), F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"), place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].cast("long").alias("start_line"))


@query("report_nested", A.FINDINGS, A.COMPONENTS, merged=MERGED, sql="""
SELECT m.scan_id AS id, 'done' AS status, critical, high, total_findings, row_number() OVER (PARTITION BY m.scan_id ORDER BY seq) AS place, severity, category, file, CAST(line AS BIGINT) AS line, code, description
FROM merged m JOIN (SELECT scan_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) AS total_findings FROM merged GROUP BY scan_id) r ON m.scan_id = r.scan_id""")
def _(f, c):
    """The nested reports, opened again: a row for each finding of a report."""
    scans = c.select(F.col("scan_id").alias("id"), F.col("scan_id").alias("name"), F.lit("done").alias("status"))
    x = sinks.reports(scans, findings.merge_duplicates(f)).select("id", "status", "stats.*", F.posexplode("findings").alias("p", "f"))
    return x.select("id", "status", "critical", "high", "total_findings", (F.col("p") + 1).cast("long").alias("place"), "f.severity", "f.category", "f.file", F.col("f.line").cast("long").alias("line"), "f.code", "f.description")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of whole tables: all documents as files of three languages, a manifest and dependencies for each part, and the sample
    component, in which every rule is hit, once for each part."""
    items = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("own", "path", "content"), row))) for row in SAMPLE))
    part = A.dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")).select("p_partkey", F.inline(items))
    sample = part.select(F.concat("own", F.lit("-"), F.col("p_partkey").cast("string")).alias("scan_id"), "path", "content")
    return A.make(spark, sf_dir, A.FILES).unionByName(sample)


def _values(rows: tuple) -> str:
    """Rows of constants, to be joined to every part."""
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else _quoted(v)
    return ", ".join(f"({', '.join(map(text, r))})" for r in rows)


def _each_part(rows: tuple, *columns: str) -> str:
    """Every part's copies of the sample's rows; the first column is the scan."""
    return f"SELECT concat({columns[0]}, '-', p_partkey) AS {', '.join(columns)} FROM (SELECT p_partkey FROM part) p, (VALUES {_values(rows)}) v({', '.join(columns)})".replace(f"AS {columns[0]}, ", "AS scan_id, ", 1)


FOUND = ("own", "file", "severity", "category", "line", "code")


def _over_files(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(_files(spark, sf_dir))
    SQL[name] = sql


def _rule(name: str, f: Callable[[DataFrame], DataFrame], last: str = "code", more: str = "") -> None:
    """A query of findings over files; its SQL says that of all files only the sample's hold them, and those that `more` selects."""
    fields = (*FOUND[:5], last)
    cast = f"SELECT scan_id, file, severity, category, CAST(line AS BIGINT) AS line, {last} FROM ({_each_part(EXPECTED[name], *fields)})"
    _over_files(name, lambda s: f(s).select("scan_id", "file", "severity", "category", F.col("line").cast("long").alias("line"), last), cast + more)


#: Documents with the component they are files of as their source: ranges, so that components don't grow with the table.
DOCS = "(SELECT * REPLACE (concat(source, '-', CAST(floor(doc_id / 500) AS BIGINT)) AS source) FROM documents) d"


#: Comments of documents that hold a secret, as YAML files: the first three of a file.
SECRET_LINES = f"""SELECT scan_id, file, 'medium' AS severity, 'hardcoded_secret' AS category, line, left(trim(text), 120) AS code FROM (
SELECT *, row_number() OVER (PARTITION BY scan_id, file ORDER BY line) AS n FROM (SELECT source AS scan_id, concat(doc_id, '.yaml') AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {DOCS})
WHERE regexp_matches(text, {_quoted(line_rules.SECRET_IN_COMMENT)})) WHERE n <= 3"""


#: Prose is no script: every document read as one is told as not parsed, and no pattern hits.
NO_SCRIPTS = "SELECT source AS scan_id, concat(doc_id, '.js') AS file, 'info' AS severity, 'parse_info' AS category, NULL AS line, '' AS code FROM " + DOCS
NO_SCRIPT_ROWS = "SELECT DISTINCT source, '(repo)', 'info', 'parse_info', NULL, '' FROM " + DOCS


def _register_over_files() -> None:
    from tessera.operators.fingerprints import fingerprints

    py = lambda s, *kinds: ast_rules.facts(line_rules.analysed(files.files_for(s, "python")), kinds or None)
    _rule("py_calls", lambda s: ast_rules.call_findings(py(s, "call")))
    _rule("py_imports", lambda s: ast_rules.import_findings(py(s, "import", "member")))
    _rule("py_taint", lambda s: ast_rules.flow_findings(py(s, "flow")))
    _rule("api_rules", lambda s: ast_rules.platform_findings(py(s, *ast_rules.PLATFORM_KINDS)))
    _rule("js_rules", lambda s: ast_rules.script_findings(files.files_for(s, "js")), more=f" UNION ALL {NO_SCRIPTS}")
    _rule("yaml_structural", lambda s: ast_rules.yaml_structure_findings(files.files_for(s, "yaml")), "description")
    _rule("yaml_patterns", lambda s: line_rules.scan_yaml_patterns(files.files_for(s, "yaml")))
    _rule("yaml_includes", lambda s: line_rules.scan_includes(files.files_for(s, "yaml")))
    _rule("full_scan", scan, more=f" UNION ALL {SECRET_LINES} UNION ALL {NO_SCRIPT_ROWS}")
    found = (("s2", "event-stream", "3.3.6", "package.json", "npm"), ("s2", "left-pad", "1.3.0", "package.json", "npm"), ("s3", "flask", "2.0", "requirements.txt", "PyPI"), ("s3", "urlib3", "1.0", "requirements.txt", "PyPI"), ("s3", "numpy", "1.20", "pyproject.toml", "PyPI"))
    _over_files("deps_discover", deps.discover, f"""{_each_part(found, "own", "package", "version", "source_file", "ecosystem")}
UNION ALL SELECT concat('p', p_partkey), replace(p_name, ' ', '_'), CAST(p_size AS VARCHAR), concat('custom_components/p', p_partkey, '/requirements.txt'), 'PyPI' FROM part
UNION ALL SELECT concat('p', p_partkey), replace(p_name, ' ', '-'), concat(p_size, '.0.0'), concat('custom_components/p', p_partkey, '/package.json'), 'npm' FROM part""")
    kinds = (("s1", "integration"), ("s2", "card"), ("s3", "unknown"))
    _over_files("component_types", files.component_types, f"""{_each_part(kinds, "own", "component_type")}
UNION ALL SELECT DISTINCT concat('p', p_partkey), 'integration' FROM part UNION ALL SELECT DISTINCT source, 'unknown' FROM {DOCS}""")
    names = (("s1", "x", "X", "ctx==1.0,requests>=2.1"), ("s2", "", "s2", ""), ("s3", "", "s3", ""))
    _over_files("component_manifests", lambda s: files.manifests(s).select("scan_id", "domain", "name", F.array_join("requirements", ",").alias("requirements")), f"""
SELECT scan_id, domain, CASE WHEN domain = '' THEN scan_id ELSE name END AS name, requirements FROM ({_each_part(names, "own", "domain", "name", "requirements")})
UNION ALL SELECT concat('p', p_partkey), concat('p', p_partkey), p_name, concat(replace(p_name, ' ', '-'), '==', p_size) FROM part UNION ALL SELECT DISTINCT source, '', source, '' FROM {DOCS}""")
    imports = "aiohttp,ctypes,ftplib,httpx,marshal,os,pickle,requests,shelve,smtplib,socket,subprocess,telnetlib,urllib,urllib3,voluptuous,webbrowser"
    prints = (("s1", imports, "hass.bus,hass.services,hass.states", "api.example.com", 6, 0, 52), ("s2", "", "", "example.org", 0, 3, 24), ("s3", "", "", "", 0, 0, 0))
    text = lambda c: F.array_join(c, ",").alias(c)
    _over_files("fp_extract", lambda s: fingerprints(s).select("scan_id", text("imports"), text("ha_apis"), text("network_domains"), "py_files", "js_files", "total_lines"), f"""
SELECT scan_id, imports, ha_apis, network_domains, CAST(py_files AS BIGINT) AS py_files, CAST(js_files AS BIGINT) AS js_files, CAST(total_lines AS BIGINT) AS total_lines FROM ({_each_part(prints, "own", "imports", "ha_apis", "network_domains", "py_files", "js_files", "total_lines")})
UNION ALL SELECT DISTINCT concat('p', p_partkey), '', '', '', 0, 0, 0 FROM part
UNION ALL SELECT source, '', '', array_to_string(list_sort(list_distinct(list_filter(flatten(list(list_transform(regexp_extract_all(text, 'https?://([a-zA-Z0-9._-]+)', 1), lambda x: lower(x)))), lambda x: x NOT IN ('0.0.0.0', '127.0.0.1', 'localhost')))), ','),
  count(*), count(*), CAST(2 * sum(len(string_split(text, chr(10))) - CASE WHEN text IS NULL OR text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS BIGINT) FROM {DOCS} GROUP BY source""")
    suffixes = files.READERS["context"][0]
    chars = {own: sum(len(c) for scan, p, c in SAMPLE if scan == own and p.endswith(suffixes) and "tests/" not in p) for own in ("s1", "s2", "s3")}
    told = (("s1", 6, chars["s1"]), ("s2", 4, chars["s2"]), ("s3", 5, chars["s3"]))
    _over_files("code_context", lambda s: files.code_context(files.files_for(s, "context")).select("scan_id", "n_files", F.col("n_chars").cast("long").alias("n_chars")), f"""
WITH f AS (SELECT source AS scan_id, concat(doc_id, suffix) AS path, left(text, 8000) AS part FROM {DOCS}, (VALUES ('.py'), ('.js'), ('.yaml')) s(suffix)),
cut AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY scan_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT scan_id, CAST(n_files AS BIGINT) AS n_files, CAST(n_chars AS BIGINT) AS n_chars FROM ({_each_part(told, "own", "n_files", "n_chars")})
UNION ALL SELECT concat('p', p_partkey), 2, length(concat('{{"domain":"p', p_partkey, '","name":"', p_name, '","requirements":["', replace(p_name, ' ', '-'), '==', p_size, '"]}}')) + length(concat('{{"dependencies":{{"', replace(p_name, ' ', '-'), '":"^', p_size, '.0.0"}}}}')) FROM part
UNION ALL SELECT scan_id, count(*), CAST(sum(length(part)) AS BIGINT) FROM cut WHERE before < 15000 GROUP BY scan_id""")


_register_over_files()

LINE = "string_split(content, chr(10))[{}]"


def _per_part(rules: tuple, columns: str = "scan_id, path AS file") -> str:
    """A row for each rule (condition, severity, category, line) of each file of t0."""
    return " UNION ALL ".join(f"SELECT {columns}, '{sev}' AS severity, '{cat}' AS category, {line} AS line, {LINE.format(line) if line != 'NULL' else _quoted('')} AS code FROM t0 WHERE {where}" for where, sev, cat, line in rules)


@query("js_syntax", A.SCRIPTS, sql=_per_part((
    ("k % 11 = 0", "info", "parse_info", "NULL"), ("k % 11 > 0 AND k % 2 = 0", "critical", "code_injection", 1), ("k % 11 > 0 AND s % 3 = 0", "info", "network", 2), ("k % 11 > 0 AND k % 5 = 0", "medium", "obfuscation", 3),
    ("k % 11 > 0 AND s % 4 = 0", "low", "telemetry", 4), ("k % 11 > 0 AND s % 4 = 1", "medium", "xss", 4), ("k % 11 > 0 AND s % 4 = 3", "medium", "data_access", 4), ("k % 11 > 0 AND k % 7 = 0", "high", "code_injection", 5),
)))
def _(s):
    return ast_rules.script_findings(s).select("scan_id", "file", "severity", "category", F.col("line").cast("long").alias("line"), "code")


@query("yaml_lists", A.AUTOMATIONS, sql="""
SELECT scan_id, path AS file, 'high' AS severity, CASE k % 4 WHEN 2 THEN 'template_injection' ELSE 'automation_injection' END AS category,
       CASE k % 4 WHEN 0 THEN concat('service by template: {{ x', s, ' }}') WHEN 1 THEN 'service_template' ELSE concat('template in v goes to script.s', s) END AS description FROM t0 WHERE k % 4 < 3""")
def _(y):
    return ast_rules.yaml_structure_findings(y).select("scan_id", "file", "severity", "category", "description")


@query("size_guards", A.SIZED, sql="""
SELECT scan_id, path AS file, severity, category, line FROM t0 JOIN (VALUES
  ('a.py', true, 'info', 'size', NULL), ('a.py', false, 'low', 'telemetry', 1), ('a.py', false, 'critical', 'code_injection', 2),
  ('a.js', true, 'info', 'size', NULL), ('a.js', true, 'critical', 'code_injection', 1), ('a.js', false, 'critical', 'code_injection', 1),
  ('a.yaml', false, 'medium', 'unsafe_include', 1), ('a.yaml', false, 'medium', 'hardcoded_secret', 2), ('a.yaml', false, 'medium', 'command_execution', 3)
) v(name, large, severity, category, line) ON path = name AND (k % 500 = 0) = large""")
def _(s):
    py, js, yml = (files.files_for(s, k) for k in ("python", "js", "yaml"))
    found = (ast_rules.size_findings(py), ast_rules.size_findings(js), ast_rules.call_findings(ast_rules.facts(line_rules.analysed(py))), line_rules.scan_parts(py), ast_rules.script_findings(js), line_rules.scan_includes(yml), line_rules.scan_secret_comments(yml), line_rules.scan_yaml_patterns(yml))
    rows = [f.select("scan_id", "file", "severity", "category", F.col("line").cast("long").alias("line")) for f in found]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


COUNTED = "JOIN (SELECT scan_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) AS total_findings FROM merged GROUP BY scan_id) r ON m.scan_id = r.scan_id"
SARIF_FILE = "runs array<struct<automationDetails:struct<id:string>,tool:struct<driver:struct<rules:array<struct<id:string,defaultConfiguration:struct<level:string>>>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>,properties:struct<seq:bigint>>>>>"
JSON_FILE = "id string, status string, stats struct<critical:bigint,high:bigint,total_findings:bigint>, findings array<struct<seq:bigint,severity:string,category:string,file:string,line:bigint,code:string,description:string>>"


def _scans(c: DataFrame) -> DataFrame:
    return c.select(F.col("scan_id").alias("id"), F.col("scan_id").alias("name"), F.lit("done").alias("status"))


@query("report_files_json", A.FINDINGS, A.COMPONENTS, merged=MERGED, sql=f"""
SELECT m.scan_id, CAST(seq AS BIGINT) AS seq, critical, high, total_findings, severity, category, file, CAST(line AS BIGINT) AS line, code, description FROM merged m {COUNTED}""")
def _(f, c):
    """Reports streamed to files of a thousand findings at most, and read back: a row for each finding, with the totals its document tells."""
    folder = _new_folder(f.sparkSession, "reports")
    report_files.write_reports(_scans(c), findings.merge_duplicates(f), folder, "json", 1000)
    x = report_files.read_documents(f.sparkSession, folder, JSON_FILE)
    return x.select(F.col("id").alias("scan_id"), "stats.*", F.inline("findings"))


@query("report_files_sarif", A.FINDINGS, A.COMPONENTS, merged=MERGED, sql=f"""
SELECT m.scan_id, CAST(m.seq AS BIGINT) AS seq, category AS rule_id, {LEVEL} AS level, rule_level, description AS message, file AS uri, CAST(greatest(coalesce(line, 1), 1) AS BIGINT) AS start_line
FROM merged m JOIN (SELECT scan_id AS s, category AS c, CASE WHEN v IN ('critical', 'high') THEN 'error' WHEN v = 'medium' THEN 'warning' ELSE 'note' END AS rule_level FROM (SELECT scan_id, category, arg_min(severity, seq) AS v FROM merged GROUP BY ALL)) ON s = m.scan_id AND c = category""")
def _(f, c):
    """SARIF files read back: each result with the level of its rule, as its document has it."""
    folder = _new_folder(f.sparkSession, "sarif")
    report_files.write_reports(_scans(c), findings.merge_duplicates(f), folder, "sarif", 1000)
    x = report_files.read_documents(f.sparkSession, folder, SARIF_FILE).select(F.explode("runs").alias("run"))
    levels = F.map_from_entries(F.transform("run.tool.driver.rules", lambda r: F.struct(r["id"], r["defaultConfiguration"]["level"])))
    # picked before results are opened: else each result carries its whole run
    x = x.select(F.col("run.automationDetails.id").alias("scan_id"), levels.alias("levels"), F.col("run.results").alias("results")).select("scan_id", "levels", F.explode("results").alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return x.select("scan_id", F.col("r.properties.seq").alias("seq"), F.col("r.ruleId").alias("rule_id"), "r.level", F.col("levels")[F.col("r.ruleId")].alias("rule_level"), F.col("r.message.text").alias("message"), place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("start_line"))


@query("report_csv", A.FINDINGS, sql="SELECT severity, category, file, CAST(line AS BIGINT) AS line, description, nullif(code, '') AS code FROM t0")
def _(f):
    folder = _new_folder(f.sparkSession, "csv")
    sinks.write_csv(f, folder)
    return f.sparkSession.read.option("header", "true").option("escape", '"').schema("severity string, category string, file string, line long, description string, code string").csv(folder)


@query("report_html", A.FINDINGS, A.COMPONENTS, merged=MERGED, sql="SELECT scan_id AS id, count(*) AS n_rows, sum(length(description)) AS n_chars FROM merged GROUP BY scan_id")
def _(f, c):
    """The pages' rows and the characters of their last cells, counted in the HTML."""
    x = sinks.html_reports(_scans(c), findings.merge_duplicates(f)).select("id", F.regexp_extract_all("html", F.lit("<td>([^<]*)</td></tr>"), F.lit(1)).alias("last"))
    return x.select("id", F.size("last").cast("long").alias("n_rows"), F.reduce("last", F.lit(0).cast("long"), lambda a, t: a + F.length(t)).alias("n_chars")).where("n_rows > 0")


@query("deps_feed_batches", A.PACKAGES, A.FEED, req_=REQ, feed_=PART + "t1", sql=f"SELECT id, scan_id, req_.package, req_.version, vuln_id, {VULN} AS severity FROM req_ JOIN feed_ ON lower(req_.package) = lower(feed_.package) AND req_.version = feed_.version WHERE req_.package <> ''")
def _(p, f):
    """As deps_vulnerable, but by requests of a hundred packages to a service that answers by place."""
    need, folder = _required(p), _new_folder(p.sparkSession, "feed")
    feed_service.write_batches(need, f"{folder}/requests")
    feed_service.answer_from(f, f"{folder}/requests", f"{folder}/answers")
    got = feed_service.read_feed(p.sparkSession, f"{folder}/requests", f"{folder}/answers")
    return deps.vulnerable(need, got).select("id", "scan_id", "package", "version", "vuln_id", "severity")


@query("files_landed", A.TREES, sql="""
SELECT scan_id, path, length(text) + CASE WHEN broken THEN 2 ELSE 0 END AS n_chars, CASE WHEN broken THEN 2 ELSE 0 END AS n_replaced FROM t0 WHERE path = 'a/x.py' OR path = 'z.yaml'""")
def _(t):
    """Trees written by executors and read again by suffix: bytes that are no text are replaced."""
    folder = _new_folder(t.sparkSession, "trees")
    data = F.col("text").cast("binary")
    files.land_files(t.select("scan_id", "path", F.when(F.col("broken"), F.concat(data, F.unhex(F.lit("FFFE")))).otherwise(data).alias("content")), folder).write.format("noop").mode("overwrite").save()
    got = files.read_files(t.sparkSession, folder, ("python", "yaml"))
    return got.select("scan_id", "path", F.char_length("content").cast("long").alias("n_chars"), F.regexp_count("content", F.lit("\ufffd")).cast("long").alias("n_replaced"))


@query("jobs_changed_parts", A.JOBS, sql="SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 50 = 7 THEN 'failed' ELSE status END AS status, batch_id FROM t0")
def _(j):
    """A status set for some jobs: only the months they were created in are written."""
    t = Tables(j.sparkSession, _new_folder(j.sparkSession, "parts"))
    t.save("jobs", j.withColumn("created_at", F.col("created_at").cast("timestamp")))
    t.update("jobs", t.load("jobs").where("cast(id as long) % 50 = 7").withColumn("status", F.lit("failed")), "id")
    return t.load("jobs").select("id", "status", "batch_id")


@query("installed_due", A.INSTALLED, A.SCANNED, sql="""
SELECT t0.domain, name, CASE WHEN k % 2 = 0 THEN concat('https://github.com/', repository, '.git') ELSE repository END AS url, t0.version,
       CASE WHEN t1.domain IS NULL THEN 'never' WHEN t1.version <> t0.version THEN 'version' ELSE 'age' END AS why
FROM t0 LEFT JOIN t1 ON t0.domain = t1.domain WHERE t1.domain IS NULL OR t1.version <> t0.version OR t1.scanned_at <= TIMESTAMP '2024-01-02 00:00:00'""")
def _(i, s):
    return jobs.due_components(i, s.withColumn("scanned_at", F.col("scanned_at").cast("timestamp")), F.lit("2024-01-03").cast("timestamp"))


@query("review_replies", A.REPLIES, sql="""
SELECT scan_id, CASE k % 4 WHEN 0 THEN least(CAST(k % 25 AS DOUBLE), 10.0) WHEN 1 THEN 5.0 END AS score, CASE k % 4 WHEN 0 THEN CASE WHEN k % 120 < 100 THEN concat('s (confidence: ', k % 120, '%)') ELSE 's' END WHEN 1 THEN 'a {b}' ELSE '' END AS summary, k % 4 < 2 AS ok FROM t0""")
def _(r):
    return files.parse_replies(r).select("scan_id", "score", "summary", "ok")


@query("cache_evicted", A.CACHED, sql="""
SELECT path FROM (SELECT path, mtime, row_number() OVER (ORDER BY mtime DESC, path) AS n FROM t0) WHERE n > 50 OR mtime < TIMESTAMP '2024-01-17 00:00:00'""")
def _(c):
    return history.cache_evictions(c, F.lit("2024-01-31").cast("timestamp_ntz"))


@query("system_info", A.CACHED, sql="SELECT kind, count(*) AS files, round_even(sum(length) / (1024 * 1024), 1) AS megabytes FROM t0 GROUP BY kind")
def _(c):
    return history.system_info(c)


LAST_TWO = "SELECT replace(domain, 'd', 'c') AS domain, max(score) FILTER (WHERE n = 2) AS old_score, max(score) FILTER (WHERE n = 1) AS new_score, max(findings_count) FILTER (WHERE n = 2) AS old_findings_count, max(findings_count) FILTER (WHERE n = 1) AS new_findings_count FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY scanned_at DESC, id DESC) AS n FROM t1) WHERE n <= 2 GROUP BY domain HAVING count(*) = 2"
HASHES = "SELECT n.key, o.hash AS old_hash, n.hash AS new_hash FROM keyed n JOIN keyed o ON n.key = o.key AND n.place = 1 AND o.place = 2 WHERE n.domain <> ''"


@query("request_diffs", A.FINGERPRINTS, A.HISTORY, keyed=KEYED, sql=f"""
SELECT d.key AS domain, imports_added, imports_removed, domains_added, domains_removed, change_pct, changed, old_hash, new_hash, old_score, new_score, old_findings_count, new_findings_count
FROM ({DIFFS}) d JOIN ({HASHES}) k ON k.key = d.key LEFT JOIN ({LAST_TWO}) s ON s.domain = d.key""")
def _(f, h):
    x = requests.domain_diffs(_fps(f), h.withColumn("domain", F.replace("domain", F.lit("d"), F.lit("c"))))
    told = ("old_score", "new_score", "old_findings_count", "new_findings_count")
    return _diff(x.withColumnRenamed("domain", "key").select("*", F.struct(F.col("old_fingerprint_hash").alias("old_hash"), F.col("new_fingerprint_hash").alias("new_hash"), *told).alias("told")), "told.*").withColumnRenamed("key", "domain")


@query("request_intelligence", A.FINGERPRINTS, keyed=KEYED, latest="SELECT key, total_lines, avg(total_lines) FILTER (WHERE total_lines > 0) OVER () AS mean, count(*) OVER () AS n FROM keyed WHERE place = 1", sql=f"""
SELECT 'shared_domain' AS kind, * FROM ({_items("network_domains", "", 2, "ORDER BY count DESC, item LIMIT 20")}) UNION ALL SELECT 'shared_import', * FROM ({_items("imports", "WHERE item <> 'os'", 2, "ORDER BY count DESC, item LIMIT 20")})
UNION ALL SELECT 'suspicious_domain', * FROM ({_items("network_domains", "WHERE contains(item, 'pastebin.com')", 1, "")})
UNION ALL SELECT 'size', key, total_lines, CASE WHEN total_lines / mean > 3 THEN 'larger' ELSE 'smaller' END FROM latest WHERE n >= 3 AND total_lines > 0 AND (total_lines / mean > 3 OR total_lines / mean < 0.1)""")
def _(f):
    return requests.intelligence(f)


@query("request_system", A.CACHED, A.JOBS, sql="""
SELECT '3' AS version, count(*) FILTER (WHERE kind = 'reports') AS reports, count(DISTINCT CASE WHEN kind = 'repos' THEN path END) AS repos_cached,
       round_even(sum(length) FILTER (WHERE kind = 'repos') / (1024 * 1024), 1) AS cache_size_mb, (SELECT count(*) FROM t1 WHERE status = 'running') AS running FROM t0""")
def _(c, j):
    return requests.system_state(c, j)


@query("request_batch", A.REPOS, sql="""
SELECT 'b1' AS batch_id, repo_url, max(name) AS name, 'running' AS status, substr(sha256(concat('b1|', repo_url)), 1, 12) AS id FROM (
  SELECT CASE WHEN starts_with(trim(url), 'http') THEN trim(url) ELSE concat('https://github.com/', trim(url), '.git') END AS repo_url, name FROM t0 WHERE trim(url) <> '') GROUP BY repo_url""")
def _(r):
    return requests.batch_jobs(r, "b1", F.lit("2024-01-01").cast("timestamp")).select("batch_id", "repo_url", "name", "status", "id")


#: Findings by SQL alone: table functions give facts, a table of rules says what they are worth.
LATERAL_RULES = """SELECT DISTINCT f.scan_id, f.path AS file, r.severity, r.category, CAST(x.line AS BIGINT) AS line FROM {files} f, LATERAL python_facts(f.content) x
JOIN {rules} r ON r.language = 'python' AND r.kind = x.kind AND r.name = x.name WHERE x.kind = 'call'"""


def _calls_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_functions.register(spark)
    return spark.sql(LATERAL_RULES, files=files.files_for(_files(spark, sf_dir), "python"), rules=table_functions.rule_table(spark))


QUERIES["calls_by_table_function"] = _calls_by_sql
SQL["calls_by_table_function"] = f"SELECT scan_id, file, severity, category, CAST(line AS BIGINT) AS line FROM ({_each_part(EXPECTED['py_calls'], *FOUND)})"


def _recorded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of files scanned as jobs: what the tables hold of each afterwards."""
    t = Tables(spark, _new_folder(spark, "scans"))
    f = A.make(spark, sf_dir, A.SIZED).select("scan_id", "path", "content").where("path <> 'a.yaml'")
    scores = f.select("scan_id", F.lit(7.0).alias("score")).distinct()
    jobs.run_scan(t, f, scores, F.lit("2024-01-01").cast("timestamp"), batch_id="b")
    runs = t.load("history").groupBy(F.col("repo_url").alias("id")).agg(F.count("*").alias("scans"), F.sum("findings_count").alias("findings"))
    return t.load("jobs").join(runs, "id").select("id", "status", "batch_id", "scans", "findings")


QUERIES["scans_recorded"] = _recorded_scan
#: Small parts: telemetry and injection in Python, injection in the script; large ones: two sizes, and injection in the script.
SQL["scans_recorded"] = "SELECT concat('p', p_partkey) AS id, 'done' AS status, 'b' AS batch_id, 1 AS scans, 3 AS findings FROM part"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
