"""Rules that look at lines of text, as tables of patterns; and the score of obfuscated scripts.

A file: scan_id, path, content. All rules of a language run as one pass over the lines: a file whose text no rule can match
is passed over before its lines are opened.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import LINE_END, lines, snippet

#: Most characters of a file that is analysed.
MOST_CHARS = 500 * 1024

#: Fixed values: (part of the lower-cased text, severity, category).
PYTHON_PARTS = (
    ("base64.b64decode", "medium", "obfuscation"),
    ("codecs.decode", "medium", "obfuscation"),
    ("analytics", "low", "telemetry"),
    ("google-analytics", "medium", "telemetry"),
    ("sentry", "low", "telemetry"),
    ("tracking_url", "low", "telemetry"),
)
#: Fixed values: (pattern, severity, category); (?i) where case doesn't matter.
SCRIPT_PATTERNS = (
    (r"(?i)\beval\s*\(", "critical", "code_injection"),
    (r"(?:^|[^a-z])Function\s*\(", "critical", "code_injection"),
    (r"""(?i)setTimeout\s*\(\s*["']""", "high", "code_injection"),
    (r"""(?i)setInterval\s*\(\s*["']""", "high", "code_injection"),
    (r"(?i)\.innerHTML\s*=", "medium", "xss"),
    (r"(?i)document\.write\s*\(", "high", "xss"),
    (r"(?i)\.insertAdjacentHTML\s*\(", "medium", "xss"),
    (r"(?i)\bfetch\s*\(", "info", "network"),
    (r"(?i)XMLHttpRequest", "info", "network"),
    (r"(?i)WebSocket\s*\(", "medium", "network"),
    (r"(?i)workers\.dev", "medium", "network"),
    (r"(?i)navigator\.sendBeacon", "high", "data_exfiltration"),
    (r"""(?i)document\.createElement\s*\(\s*["']script""", "high", "script_injection"),
    (r"""(?i)document\.createElement\s*\(\s*["']iframe""", "high", "script_injection"),
    (r"(?i)atob\s*\(", "medium", "obfuscation"),
    (r"(?i)String\.fromCharCode", "medium", "obfuscation"),
    (r"(?i)unescape\s*\(", "medium", "obfuscation"),
    (r"(?i)localStorage", "low", "data_access"),
    (r"(?i)sessionStorage", "low", "data_access"),
    (r"(?i)document\.cookie", "medium", "data_access"),
    (r"(?i)google[\-_]?analytics|gtag|ga\s*\(", "high", "telemetry"),
    (r"(?i)sentry", "low", "telemetry"),
    (r"(?i)mixpanel|amplitude|segment", "medium", "telemetry"),
    (r"(?i)paypal\.com|paypal\.me|paypalobjects\.com", "medium", "payment"),
    (r"(?i)stripe\.com|stripe\.js", "medium", "payment"),
)
#: Fixed values: (pattern, severity, category, every hit rather than the first, another pattern that the file must hold too).
YAML_SERVICES = r"^\s*(shell_command|command_line)\s*:"
YAML_PATTERNS = (
    (YAML_SERVICES, "medium", "command_execution", True, None),
    (r"""(?i)^\s*(password|api_key|token|secret|client_secret)\s*:\s*["']?[^\s!][^\s#"']{8,}""", "high", "hardcoded_secret", False, None),
    (r"""(?i)^\s*url\s*:\s*["']?http://(?!localhost|127\.0\.0\.1|192\.168\.|10\.|172\.(1[6-9]|2\d|3[01])\.)""", "low", "insecure_transport", False, None),
    (r"\{[%{].*?\b(eval|exec|import|__import__|compile)\b.*?[%}]\}", "critical", "code_injection", False, None),
    (r"\{[{%].*?states\s*\(.*?\).*?[%}]\}", "high", "template_injection", False, YAML_SERVICES),
)
SECRET_IN_COMMENT = r"(?i)#.*\b(password|api_key|token|secret|client_secret)\s*[:=]\s*\S{8,}"
TEMPLATE = r"\{\{.*?\}\}|\{%.*?%\}"
#: Signs of obfuscated scripts, hosts that are fine to see there, and words that tell of payment.
HEX_NAME = r"_0x[0-9a-f]{4,}"
TECHNIQUES = (
    (r"_0x[0-9a-f]{4,}\s*[\(\[=]", "Hex-prefixed variable names (_0x pattern)"),
    (r"function\s+_0x[0-9a-f]{4,}", "Obfuscated function definitions (_0x pattern)"),
    (r"\['push'\]\s*\(\s*\w+\s*\[\s*'shift'\s*\]", "String array rotation (anti-analysis)"),
    (r"parseInt\s*\([^)]+\)\s*/\s*\d+\s*\*\s*\(\s*-?\s*parseInt", "Control flow flattening (parseInt shuffle)"),
)
SAFE_HOSTS = ("github.com", "githubusercontent.com", "hacs.xyz", "home-assistant.io", "jsdelivr.net", "unpkg.com")
URL = r"""https?://[^\s'"\\]{10,}"""
PAYWALL = ((r"(?i)\blicen[sc]e\b", 1), (r"(?i)\bactivat(?:ion|e|ed)\b", 3), (r"(?i)\b(?:premium|freemium|subscription|trial)\b", 2))


def numbered_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(scan_id, path, line, text): lines count from 1."""
    return files.select("scan_id", "path", F.posexplode(lines(F.col(content))).alias("p", "text")).select("scan_id", "path", (F.col("p") + 1).alias("line"), "text")


_TIMES = r"(?:[?*+]|\{\d+,?\d*\})"
_CLASS = re.compile(r"(?<!\\)\[\^?\]?(?:\\.|[^\]\\])*\]")
_GROUP = re.compile(r"(?<!\\)\((\?[:=!<i]+)?((?:[^()\\]|\\.)*)\)(" + _TIMES + ")?")
_WORDS = re.compile(r"[\w-]+(?:\|[\w-]+)+")
_TOKEN = re.compile(_TIMES + r"|(\\[^\w\s]|[\w/:<>,;=\"'#@%&~!-])(" + _TIMES + r")?|\\.|[\s\S]", re.A)


def signs(pattern: str) -> tuple[str, ...]:
    """Lower-cased words of which a text holds one, in any case, if the pattern hits it anywhere; none if that can't be told.

    Words of a plain group such as `(a|b)` count together; of what must stand one after the other, the longest is taken.
    """
    if "\\Q" in pattern:
        pattern = re.sub(r"\\Q(.*?)\\E", lambda m: re.sub(r"[^\w\s]", r"\\\g<0>", m[1]), pattern)
    if re.search(r"\\[\\xu0cpPkN]|\(\?\w*[xu]", pattern):
        return ()
    groups: list[tuple[str, ...]] = []

    def opened(m: re.Match) -> str:
        if not m[1] and not m[3] and _WORDS.fullmatch(m[2]):
            groups.append(tuple(m[2].lower().split("|")))
            return f"\0{len(groups) - 1}\0"
        return "\0\0"

    text = _CLASS.sub("\0\0", pattern)
    while (shorter := _GROUP.sub(opened, text)) != text:
        text = shorter
    out: list[str] = []
    for branch in text.split("|"):
        found, run = [()], ""
        # every other piece stands for a group or a class
        for k, piece in enumerate(branch.split("\0")):
            if k % 2:
                found += [groups[int(piece)]] if piece else []
                continue
            for m in _TOKEN.finditer(piece + "\n"):
                if m[1] and m[2] in (None, "+"):
                    run += m[1][-1].lower()
                if not m[1] or m[2]:
                    found.append((run,))
                    run = ""
        best = max(found, key=lambda ws: min(map(len, ws), default=0))
        if min(map(len, best), default=0) < 2:
            return ()
        out += best
    return tuple(dict.fromkeys(out))


def _holds(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(low, F.lit(w))
    return out


class Rule(NamedTuple):
    """A rule over lines: what of the whole text shows that a line may be hit, the pattern of such lines, what is told of one, how many are told at most, what the file must hold too."""

    can: Column
    pattern: str
    told: Callable[[Column], dict[str, Column | str]]
    most: int | None = None
    also: Column | None = None


#: Line ends other than \n alone: a text without any is cut much faster.
_OTHER_ENDS = r"[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def _any_line(pattern: str) -> str:
    return "(?m)" + pattern


def _firsts(rules: list[tuple[str, str, str, str, str | None]]) -> list[Rule]:
    """The first line of each rule (pattern, severity, category, name, a pattern the file must hold too)."""
    t, out = F.col("content"), []
    for k, (p, sev, cat, name, also) in enumerate(rules):
        out.append(Rule(t.rlike(_any_line(p)), p, lambda _, k=k, sev=sev, cat=cat, name=name: {"rule": F.lit(k), "severity": sev, "category": cat, "description": name}, 1, t.rlike(_any_line(also)) if also else None))
    return out


def _told(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """What the rules tell of each file, in one pass; an empty line isn't hit, and one for which severity is null isn't told.

    A file stays one row: a text that no rule can match isn't cut into lines. Another is cut once, and only the lines that any rule
    may hit are kept, so that each rule looks at few. No row for each line, no shuffle.
    """
    t = F.col("content")
    words = [signs(r.pattern) for r in rules]
    # most rules are passed over by their words alone; a list of one, so that a text is lower-cased once
    def maybe(low: Column) -> Column:
        out = F.lit(False)
        for r, ws in zip(rules, words):
            can = r.can if r.also is None else r.can & r.also
            out |= _holds(low, ws) & can if ws else can
        return out

    known, every = all(words), tuple(dict.fromkeys(w for ws in words for w in ws))
    cut = F.when(t.rlike(_OTHER_ENDS), F.split(t, LINE_END, -1)).otherwise(F.split(t, "\n", -1))
    any_rule = "|".join(f"(?:{r.pattern})" for r in rules)
    hits = lambda x: _holds(x["low"], every) if known else (x["text"] != "") & x["text"].rlike(any_rule)
    hit = F.filter(F.transform(cut, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"), F.lower(x).alias("low"))), hits)

    def told(r: Rule, ws: tuple[str, ...]) -> Column:
        def row(x: Column) -> Column:
            own = {"rule": F.lit(None).cast("int"), "severity": "", "category": "", "line": x["line"], "code": snippet(x["text"]), "description": ""} | r.told(x["text"])
            return F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(c) for c, v in own.items()))

        own = F.filter("hit", lambda x: (_holds(x["low"], ws) & x["text"].rlike(r.pattern)) if ws else x["text"].rlike(r.pattern))
        rows = F.transform(F.slice(own, 1, r.most) if r.most else own, row)
        return rows if r.also is None else F.when(r.also, rows)

    found = F.flatten(F.filter(F.array(*map(told, rules, words)), lambda a: a.isNotNull()))
    x = files.where(t.isNotNull() & F.exists(F.array(F.lower(t)), maybe)).withColumn("hit", hit)
    return x.select("scan_id", F.col("path").alias("file"), F.inline(F.filter(found, lambda h: h["severity"].isNotNull())))


def scan_parts(files: DataFrame, rules=PYTHON_PARTS) -> DataFrame:
    """The first line of each file up to MOST_CHARS that holds each part, in any case."""
    return _told(analysed(files), _firsts([(r"(?i)\Q" + p + r"\E", sev, cat, f"holds {p}", None) for p, sev, cat in rules]))


def scan_script_patterns(files: DataFrame, rules=SCRIPT_PATTERNS) -> DataFrame:
    """The first line of each file that each script pattern hits."""
    return _told(files, _firsts([(p, sev, cat, f"matches {p}", None) for p, sev, cat in rules]))


def _yaml_rules(rules=YAML_PATTERNS) -> list[Rule]:
    out = _firsts([(p, sev, cat, f"matches {p}", also) for p, sev, cat, every, also in rules if not every])
    for p, sev, cat, every, _ in rules:
        if every:
            out.append(Rule(F.col("content").rlike(_any_line(p)), p, lambda t, p=p, sev=sev, cat=cat: {"severity": sev, "category": cat, "code": snippet(F.regexp_extract(t, p, 0)), "description": f"matches {p}"}))
    return out


def scan_yaml_patterns(files: DataFrame, rules=YAML_PATTERNS) -> DataFrame:
    """YAML pattern rules over files up to MOST_CHARS: the first line hit, or every hit, with what was hit as code, where the rule says so."""
    return _told(analysed(files), _yaml_rules(rules)).drop("rule")


def analysed(files: DataFrame) -> DataFrame:
    """Files up to MOST_CHARS characters; others aren't looked into."""
    return files.where(F.char_length("content") <= MOST_CHARS)


def _include_rule() -> Rule:
    def told(t: Column) -> dict[str, Column | str]:
        part = F.trim(F.substr(t, F.instr(t, "!include") + 8))
        sev = F.when(part.rlike(TEMPLATE), "high").when(F.startswith(part, F.lit("/")) | F.contains(part, F.lit("..")), "medium")
        return {"severity": sev, "category": "unsafe_include"}

    return Rule(F.contains("content", F.lit("!include")), "!include", told)


def scan_includes(files: DataFrame) -> DataFrame:
    """Lines of files up to MOST_CHARS with !include: a template in the path is high, an absolute or parent path medium."""
    return _told(analysed(files), [_include_rule()]).drop("rule", "description")


def _comment_rule(most: int) -> Rule:
    return Rule(F.col("content").rlike(SECRET_IN_COMMENT), SECRET_IN_COMMENT, lambda _: {"severity": "medium", "category": "hardcoded_secret"}, most)


def scan_secret_comments(files: DataFrame, most: int = 3) -> DataFrame:
    """The first lines of each file up to MOST_CHARS whose comment seems to hold a secret."""
    return _told(analysed(files), [_comment_rule(most)]).drop("rule", "description")


def scan_yaml_lines(files: DataFrame) -> DataFrame:
    """Patterns, includes and comments with secrets in one pass over the files; `own` is their place among these three."""
    each = (_yaml_rules(), [_include_rule()], [_comment_rule(3)])
    placed = [r._replace(told=lambda t, r=r, k=k: r.told(t) | {"own": F.lit(k)}) for k, rules in enumerate(each) for r in rules]
    return _told(analysed(files), placed).drop("rule")


def obfuscation_scores(files: DataFrame) -> DataFrame:
    """Per file that seems obfuscated (five hex names or more): its counts, techniques, foreign hosts and paywall score.

    Other files are passed over before any further count.
    """
    t = F.col("content")
    gate = files.where(F.contains(t, F.lit("_0x"))).withColumn("hex_refs", F.regexp_count(t, F.lit(HEX_NAME))).where("hex_refs >= 5")
    found = F.filter(F.array(*(F.when(t.rlike(p), F.lit(name)) for p, name in TECHNIQUES)), lambda x: x.isNotNull())
    urls = F.filter(F.regexp_extract_all(t, F.lit(URL), F.lit(0)), lambda u: F.forall(F.array(*map(F.lit, SAFE_HOSTS)), lambda s: ~F.contains(u, s)))
    hosts = F.slice(F.array_sort(F.array_distinct(F.transform(F.slice(urls, 1, 20), lambda u: F.split_part(F.split_part(u, F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))))), 1, 10)
    count = lambda p: F.regexp_count(t, F.lit(p))
    paywall = sum((count(p) * w for p, w in PAYWALL), F.lit(0))
    out = gate.select(
        "scan_id", "path", "hex_refs", snippet(F.left(t, F.lit(120))).alias("code"), F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise("Hex-encoded variable names").alias("techniques"),
        F.array_join(hosts, ",").alias("hosts"), paywall.alias("paywall_score"), count("(?i)paypal").alias("paypal_refs"), count("(?i)stripe").alias("stripe_refs"), count(r"(?i)\biframe\b").alias("iframe_refs"),
    )
    return out.withColumns({"hidden_paywall": F.col("paywall_score") >= 20, "hidden_payment": (F.col("paypal_refs") >= 5) | (F.col("stripe_refs") >= 5), "iframe_injection": F.col("iframe_refs") >= 3})


def obfuscation_findings(files: DataFrame) -> DataFrame:
    """The findings that the scores stand for, one row each."""
    s = obfuscation_scores(files)
    row = lambda sev, cat, text, code=F.lit(""): F.struct(F.lit(sev).alias("severity"), F.lit(cat).alias("category"), code.alias("code"), text.alias("description"))
    provider = F.when(F.col("paypal_refs") > F.col("stripe_refs"), "PayPal").otherwise("Stripe")
    all_ = F.array(
        row("high", "obfuscation", F.concat(F.lit("Obfuscated code: "), F.col("hex_refs").cast("string"), F.lit(" hex names; "), F.col("techniques")), F.col("code")),
        F.when(F.col("hosts") != "", row("high", "data_exfiltration", F.concat(F.lit("External hosts in obfuscated code: "), F.col("hosts")))),
        F.when(F.col("hidden_paywall"), row("high", "hidden_paywall", F.concat(F.lit("License or activation system in obfuscated code, score "), F.col("paywall_score").cast("string")))),
        F.when(F.col("hidden_payment"), row("high", "hidden_payment", F.concat(provider, F.lit(" integration in obfuscated code, "), F.greatest("paypal_refs", "stripe_refs").cast("string"), F.lit(" references")))),
        F.when(F.col("iframe_injection"), row("medium", "iframe_injection", F.concat(F.lit("Iframes in obfuscated code: "), F.col("iframe_refs").cast("string")))),
    )
    return s.select("scan_id", F.col("path").alias("file"), F.inline(F.filter(all_, lambda x: x.isNotNull()))).withColumn("line", F.lit(1))


def unparsed_text(n: Column) -> Column:
    """What is told of a scan's n files that couldn't be parsed."""
    return F.concat(n.cast("string"), F.lit(" files were read by patterns only"))
