"""Scalar expressions over findings, scores and text; all built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities by rank, and category names that mean the same.
SEVERITIES = ("info", "low", "medium", "high", "critical")
ALIASES = {
    "ha_dynamic_service": "ha_api_risk",
    "script_injection": "xss",
    "taint_code_injection": "code_injection",
    "taint_command_injection": "command_execution",
    "taint_deserialization": "deserialization",
    "taint_path_traversal": "path_traversal",
}
#: What to do about a category.
FIXES = {
    "code_injection": "Replace eval()/exec() with ast.literal_eval() or a safe parser",
    "command_execution": "Use subprocess with args list instead of shell=True; restrict commands",
    "credential": "Move secrets to environment variables or vault",
    "data_exfiltration": "Verify target URLs; restrict network access",
    "deserialization": "Replace pickle with json/msgpack; validate input data",
    "file_access": "Restrict file access; use Path with path validation",
    "hidden_paywall": "Component contains hidden licensing system — cannot verify terms",
    "hidden_payment": "Payments hidden in obfuscated code — not auditable",
    "iframe_injection": "Hidden iframes may load external content — verify sources",
    "native_code": "Check if ctypes is necessary; consider a pure Python alternative",
    "network": "Check if network connections are necessary and secure",
    "obfuscation": "Check if base64/codec is used to hide payload",
    "payment": "Unusual payment integration in HA component — check purpose",
    "telemetry": "Optionally disable telemetry or verify collected data",
}
OTHER_FIX = "Review code manually and assess risk"
#: Line ends, as text files of any origin have them.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def _map(values: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.create_map(*pairs)[key]


def severity_rank(severity: Column) -> Column:
    """critical 4 to info 0; null for any other word."""
    out = F.lit(None).cast("int")
    for rank, name in enumerate(SEVERITIES):
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def normal_category(category: Column) -> Column:
    return F.coalesce(_map(ALIASES, category), category)


def suggested_fix(category: Column) -> Column:
    return F.coalesce(_map(FIXES, category), F.lit(OTHER_FIX))


def proposal(severity: Column, category: Column) -> Column:
    """What to do about a finding: the first case that holds."""
    return (
        F.when(severity.isin("critical", "high") & category.isin("code_injection", "command_execution"), "Remove / Fix")
        .when(severity == "critical", "Fix")
        .when((severity == "high") & category.isin("deserialization", "native_code", "data_exfiltration"), "Fix")
        .when(severity.isin("high", "medium"), "Investigate")
        .when((severity == "low") & category.isin("telemetry", "tracking"), "Keep / Remove")
        .otherwise("Keep")
    )


def score_label(score: Column) -> Column:
    return F.when(score.isNull(), "N/A").when(score >= 8, "SAFE").when(score >= 5, "CAUTION").otherwise("DANGER")


def vulnerability_severity(score: Column) -> Column:
    """By the first purely numeric part of a CVSS string; high if there is none."""
    number = F.get(F.filter(F.split(score, "/"), lambda x: x.rlike(r"^[0-9.]*[0-9][0-9.]*$")), F.lit(0)).try_cast("double")
    base = F.when(score.contains("CVSS"), number)
    return F.when(base.isNull(), "high").when(base >= 9, "critical").when(base >= 7, "high").when(base >= 4, "medium").otherwise("low")


def finding_hash(category: Column, file: Column, description: Column) -> Column:
    joined = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (category, file, description)))
    return F.left(F.sha2(joined.cast("binary"), 256), F.lit(16))


def snippet(line: Column, size: int = 120) -> Column:
    return F.left(F.regexp_replace(line, r"^\s+|\s+$", ""), F.lit(size))


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the end opens no further line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def relative_path(path: Column, root: Column) -> Column:
    """path without the folder root in front, if it is there."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(path)


def clamp_score(score: Column) -> Column:
    """A score of 0 to 10; 5 if there is none or it is no number."""
    value = score.try_cast("double")
    return F.least(F.greatest(F.coalesce(value, F.lit(5.0)), F.lit(0.0)), F.lit(10.0))


def with_confidence(text: Column, confidence: Column, below: int) -> Column:
    return F.when(confidence < below, F.concat(text, F.format_string(" (confidence: %d%%)", confidence.cast("int")))).otherwise(text)


def slug(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?i)[^a-z0-9_-]", ""))


def masked(secret: Column) -> Column:
    """First 8 and last 4 characters; one of up to 12 is masked whole."""
    return F.when(F.length(secret) > 12, F.concat(F.left(secret, F.lit(8)), F.lit("..."), F.right(secret, F.lit(4)))).otherwise(F.repeat(F.lit("*"), F.length(secret)))


def repository_url(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("http")), name).otherwise(F.concat(F.lit("https://github.com/"), name, F.lit(".git")))


def escaped_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
