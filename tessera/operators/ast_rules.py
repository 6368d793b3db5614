"""Rules that need a syntax tree. One pass over each file emits facts (calls, imports, flows); rules are looked up in tables.

Scanned code is parsed, never run. Files come in Arrow batches; a file that can't be parsed gives one fact of kind `unparsed`.
"""

from __future__ import annotations

import ast
import functools
import re
from collections import OrderedDict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.line_rules import MOST_CHARS, TEMPLATE
from tessera.operators.script_syntax import Node, does_nothing, parse_script

#: Fixed values: (severity, category) by called name, by imported module, and modules that open the network.
CALLS = {"__import__": ("high", "code_injection"), "compile": ("medium", "code_injection"), "eval": ("critical", "code_injection"), "exec": ("critical", "code_injection")}
IMPORTS = {
    "ctypes": ("high", "native_code"),
    "marshal": ("medium", "deserialization"),
    "os.popen": ("high", "command_execution"),
    "os.system": ("critical", "command_execution"),
    "pickle": ("high", "deserialization"),
    "shelve": ("medium", "deserialization"),
    "subprocess": ("high", "command_execution"),
    "webbrowser": ("medium", "data_exfiltration"),
}
NETWORK = ("aiohttp", "ftplib", "httpx", "requests", "smtplib", "socket", "telnetlib", "urllib", "urllib3")
#: Where outside data comes from, and where it must not go.
TAINT_ATTRIBUTES = ("args", "body", "cookies", "data", "form", "headers", "input", "json", "options", "params", "query", "query_string", "user_input")
TAINT_CALLS = ("input", "raw_input")
SINKS = {
    "Popen": ("high", "taint_command_injection"),
    "call": ("high", "taint_command_injection"),
    "check_output": ("high", "taint_command_injection"),
    "eval": ("critical", "taint_code_injection"),
    "exec": ("critical", "taint_code_injection"),
    "load": ("medium", "taint_deserialization"),
    "loads": ("high", "taint_deserialization"),
    "popen": ("high", "taint_command_injection"),
    "run": ("high", "taint_command_injection"),
    "system": ("critical", "taint_command_injection"),
}
FILE_SINKS = ("open", "read_bytes", "read_text", "write_bytes", "write_text")
#: Platform calls (object, method) and attributes of the platform object.
PLATFORM_CALLS = {("bus", "async_fire"): ("medium", "ha_event_injection"), ("bus", "fire"): ("medium", "ha_event_injection"), ("services", "async_call"): ("medium", "ha_api_risk"), ("services", "call"): ("medium", "ha_api_risk")}
PLATFORM_ACCESS = {"auth": ("high", "ha_auth_access"), "config": ("low", "ha_config_access")}
SCHEMAS = ("CONFIG_SCHEMA", "PLATFORM_SCHEMA")
PLATFORM_KINDS = ("access", "dynamic", "platform", "schema", "state")

FINDING = "scan_id string, file string, severity string, category string, line int, code string, description string"
#: Characters of texts whose facts a Python worker remembers, and rows of one batch that it gives, at most.
REMEMBERED = 1 << 24
MOST_ROWS = 50_000


def remembered(f: Callable[[str], list]) -> Callable[[str], list]:
    """f of a text, without doing it again for texts that came not long ago: the same file lies in many scans."""
    known: OrderedDict[str, list] = OrderedDict()
    held = 0

    @functools.wraps(f)
    def of(text: str) -> list:
        nonlocal held
        if text in known:
            known.move_to_end(text)
            return known[text]
        out = f(text)
        known[text] = out
        held += len(text)
        while held > REMEMBERED:
            held -= len(known.popitem(last=False)[0])
        return out

    return of


def _each_text(rows_of: Callable[[str], list[tuple]], fields: str):
    """For mapInArrow over (scan_id, path, content): a row (scan_id, path, and what is told) for each that rows_of gives for a content.

    A text is looked at once for each batch, however many files hold it; its rows are dealt to the files by Arrow.
    """
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = [{"int": pa.int32()}.get(x.split()[1], pa.string()) for x in fields.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            texts = b.column(2).dictionary_encode()
            told = [rows_of(t) for t in texts.dictionary.to_pylist()]
            columns = [pa.array([r[i] for rows in told for r in rows], t) for i, t in enumerate(kinds[2:])]
            n = np.array([len(rows) for rows in told], "int64")
            own = texts.indices.to_numpy(zero_copy_only=False)
            each = n[own]
            file = np.repeat(np.arange(len(own)), each)
            row = np.repeat((np.cumsum(n) - n)[own] - (np.cumsum(each) - each), each) + np.arange(len(file))
            for at in range(0, len(file), MOST_ROWS):
                f, r = pa.array(file[at : at + MOST_ROWS]), pa.array(row[at : at + MOST_ROWS])
                yield pa.RecordBatch.from_arrays([b.column(0).take(f), b.column(1).take(f), *(c.take(r) for c in columns)], names)

    return run


def _name(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""


def _dotted(node: ast.AST) -> list[str]:
    out: list[str] = []
    while isinstance(node, ast.Attribute):
        out.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        out.append(node.id)
    return out[::-1]


def _tainted(node: ast.AST, names: set[str]) -> bool:
    """Does a value hold outside data? By variable, attribute, subscript, call, or any part of an expression."""
    for x in ast.walk(node):
        if isinstance(x, ast.Name) and x.id in names or isinstance(x, ast.Attribute) and x.attr in TAINT_ATTRIBUTES:
            return True
        if isinstance(x, ast.Call) and _name(x.func) in TAINT_CALLS:
            return True
    return False


def _uses(node: ast.AST, names: set[str]) -> bool:
    return any(isinstance(x, ast.Name) and x.id in names for x in ast.walk(node))


def _own(statement: ast.stmt):
    """The expressions of a statement itself, without those of blocks inside it."""
    for field, value in ast.iter_fields(statement):
        if field in ("body", "orelse", "finalbody", "handlers", "cases"):
            continue
        for x in value if isinstance(value, list) else [value]:
            if isinstance(x, ast.AST):
                yield x


def _flows(body: list[ast.stmt], names: set[str]):
    """(node, sink) of calls that a tainted variable reaches, in the order of statements; a block starts from what holds before it."""
    for s in body:
        for e in _own(s):
            for x in ast.walk(e):
                if isinstance(x, ast.Call) and (n := _name(x.func)) in (*SINKS, *FILE_SINKS) and any(_uses(a, names) for a in x.args):
                    yield x, n
        if isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and s.value is not None:
            targets = s.targets if isinstance(s, ast.Assign) else [s.target]
            bad = _tainted(s.value, names)
            for t in targets:
                for x in ast.walk(t):
                    if isinstance(x, ast.Name):
                        if bad:
                            names.add(x.id)
                        elif not isinstance(s, ast.AugAssign):
                            names.discard(x.id)
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield from _flows(s.body, set())
            continue
        for field in ("body", "orelse", "finalbody"):
            yield from _flows(getattr(s, field, []) or [], set(names))
        for h in [*getattr(s, "handlers", []), *getattr(s, "cases", [])]:
            yield from _flows(h.body, set(names))


def _validated(node: ast.AST) -> bool:
    """Is it a call of vol.x or cv.x, or of what such a call returns?"""
    while isinstance(node, ast.Call):
        node = node.func
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id in ("vol", "cv"):
            return True
    return False


@remembered
def python_facts(source: str) -> list[tuple[str, str, int, str]]:
    """(kind, name, line, detail): call, import, flow, platform facts of a file, each once for a name and line."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [("unparsed", "", 0, "")]
    out: dict[tuple, None] = {}

    def put(kind: str, name: str, node: ast.AST, detail: str = "") -> None:
        out.setdefault((kind, name, getattr(node, "lineno", 0), detail))

    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            for a in x.names:
                put("import", a.name, x)
        elif isinstance(x, ast.ImportFrom) and x.module:
            put("import", x.module, x)
            for a in x.names:
                put("member", f"{x.module}.{a.name}", x)
        elif isinstance(x, ast.Call):
            path = _dotted(x.func)
            n = _name(x.func)
            if n in CALLS and path[:-1] != ["re"]:
                put("call", n, x)
            # a method of an attribute of anything: hass.services.call, self.hass.bus.fire, ...
            owner = x.func.value.attr if isinstance(x.func, ast.Attribute) and isinstance(x.func.value, ast.Attribute) else ""
            if (owner, n) in PLATFORM_CALLS:
                put("platform", f"{owner}.{n}", x)
                if owner == "services" and any(not isinstance(a, ast.Constant) for a in x.args[:2]):
                    put("dynamic", f"{owner}.{n}", x)
            if owner == "states" and n in ("set", "async_set") and x.args and not isinstance(x.args[0], ast.Constant):
                put("state", n, x)
        elif isinstance(x, ast.Attribute) and x.attr in PLATFORM_ACCESS and (isinstance(x.value, ast.Name) and x.value.id == "hass" or isinstance(x.value, ast.Attribute) and x.value.attr in ("hass", "_hass")):
            put("access", x.attr, x)
        elif isinstance(x, ast.Assign):
            for t in x.targets:
                if isinstance(t, ast.Name) and t.id in SCHEMAS and not _validated(x.value):
                    put("schema", t.id, x)
    for node, sink in _flows(tree.body, set()):
        shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
        put("flow", sink, node, "shell" if shell else "")
    return list(out)


FACT = "scan_id string, path string, kind string, name string, line int, detail string, code string"


def facts(files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(scan_id, path, kind, name, line, detail, code) of whole Python files of any size; with kinds, only facts of these.

    Scanners, which tell of a file beyond MOST_CHARS instead of looking into it, give line_rules.analysed files.
    """

    def rows_of(text: str) -> list[tuple]:
        own = text.splitlines()
        return [(k, n, at, d, own[at - 1].strip()[:120] if 0 < at <= len(own) else "") for k, n, at, d in python_facts(text) if kinds is None or k in kinds]

    src = files.where("content is not null").select("scan_id", "path", "content")
    return src.mapInArrow(_each_text(rows_of, FACT), FACT)


def _table(df: DataFrame, rules: dict, first: str) -> DataFrame:
    spark = df.sparkSession
    return F.broadcast(spark.createDataFrame([(k, *v) for k, v in rules.items()], f"{first} string, severity string, category string"))


def call_findings(f: DataFrame) -> DataFrame:
    x = f.where("kind = 'call'").join(_table(f, CALLS, "name"), "name")
    return x.select("scan_id", F.col("path").alias("file"), "severity", "category", "line", "code", F.concat("name", F.lit("() runs code")).alias("description"))


def import_findings(f: DataFrame) -> DataFrame:
    """A module named by a rule, or below one; and modules that open the network, by their first part."""
    i = f.where("kind in ('import', 'member')")
    rules = _table(f, IMPORTS, "module")
    hit = i.join(rules, (F.col("name") == F.col("module")) | F.startswith("name", F.concat(F.col("module"), F.lit("."))))
    danger = hit.groupBy("scan_id", "path", "module", "severity", "category", "line").agg(F.min("code").alias("code"))
    danger = danger.select("scan_id", F.col("path").alias("file"), "severity", "category", "line", "code", F.concat(F.lit("imports "), F.col("module")).alias("description"))
    net = i.where("kind = 'import'").where(F.split_part("name", F.lit("."), F.lit(1)).isin(*NETWORK))
    return danger.unionByName(net.select("scan_id", F.col("path").alias("file"), F.lit("info").alias("severity"), F.lit("network").alias("category"), "line", "code", F.concat(F.lit("imports "), F.col("name")).alias("description")))


def flow_findings(f: DataFrame) -> DataFrame:
    """Outside data in a sink; shell=True makes it critical. One for a category and line."""
    x = f.where("kind = 'flow'").join(_table(f, _FLOW_RULES, "name"), "name")
    sev = F.when(F.col("detail") == "shell", "critical").otherwise(F.col("severity"))
    return x.withColumn("severity", sev).groupBy("scan_id", F.col("path").alias("file"), "category", "line").agg(F.min(F.struct("name", "severity", "code")).alias("m")).select("scan_id", "file", "m.severity", "category", "line", "m.code", F.concat(F.lit("Outside data flows into "), F.col("m.name")).alias("description"))


def platform_findings(f: DataFrame) -> DataFrame:
    """Platform calls, service calls whose first two arguments aren't all constants, dynamic states, access to auth and config, schemas
    without validators. One for a category and line."""
    x = f.withColumn("what", F.concat_ws(":", "kind", "name")).join(_table(f, _PLATFORM_RULES, "what"), "what")
    return x.groupBy("scan_id", F.col("path").alias("file"), "category", "line").agg(F.min(F.struct("name", "severity", "code")).alias("m")).select("scan_id", "file", "m.severity", "category", "line", "m.code", F.concat(F.lit("Platform use: "), F.col("m.name")).alias("description"))


def size_findings(files: DataFrame) -> DataFrame:
    """An info finding for each file that is too large to analyse."""
    n = F.char_length("content")
    return files.where(n > MOST_CHARS).select("scan_id", F.col("path").alias("file"), F.lit("info").alias("severity"), F.lit("size").alias("category"), F.lit(None).cast("int").alias("line"), F.lit("").alias("code"), F.concat(F.lit("File of "), (n / 1024).cast("long").cast("string"), F.lit(" KB is too large to analyse")).alias("description"))


#: What a file's findings are of, in the order they are told, and the schema of findings with that place.
PYTHON_GROUPS = ("size", "call", "import", "flow", "platform")
PLACED = FINDING + ", own int"
_FLOW_RULES = SINKS | {n: ("high", "taint_path_traversal") for n in FILE_SINKS}
_PLATFORM_RULES = (
    {f"platform:{'.'.join(k)}": v for k, v in PLATFORM_CALLS.items()} | {f"access:{k}": v for k, v in PLATFORM_ACCESS.items()} | {f"schema:{n}": ("medium", "ha_no_validation") for n in SCHEMAS}
    | {f"dynamic:services.{m}": ("high", "ha_dynamic_service") for m in ("call", "async_call")} | {f"state:{m}": ("medium", "ha_dynamic_entity") for m in ("set", "async_set")}
)


def _too_large(text: str) -> tuple:
    return "info", "size", None, "", f"File of {len(text) // 1024} KB is too large to analyse"


def python_findings_of(text: str) -> dict[str, list[tuple]]:
    """(severity, category, line, code, description) by group: what call_, import_, flow_ and platform_findings tell of the facts of one text."""
    if len(text) > MOST_CHARS:
        return {"size": [_too_large(text)]}
    own = text.splitlines()
    code = lambda line: own[line - 1].strip()[:120] if 0 < line <= len(own) else ""
    calls, imports, net, first = [], {}, [], {}
    for kind, name, line, detail in python_facts(text):
        if kind == "call":
            calls.append((*CALLS[name], line, code(line), f"{name}() runs code"))
        elif kind in ("import", "member"):
            for m, rule in IMPORTS.items():
                if name == m or name.startswith(m + "."):
                    imports[m, line] = (*rule, line, code(line), f"imports {m}")
            if kind == "import" and name.split(".")[0] in NETWORK:
                net.append(("info", "network", line, code(line), f"imports {name}"))
        elif (rule := _FLOW_RULES.get(name) if kind == "flow" else _PLATFORM_RULES.get(f"{kind}:{name}")) is not None:
            sev = "critical" if detail == "shell" and kind == "flow" else rule[0]
            key = ("flow" if kind == "flow" else "platform", rule[1], line)
            first[key] = min(first.get(key, (name, sev)), (name, sev))
    out = {"call": calls, "import": [*imports.values(), *net]}
    for group, text_of in (("flow", "Outside data flows into "), ("platform", "Platform use: ")):
        out[group] = [(sev, cat, line, code(line), text_of + name) for (g, cat, line), (name, sev) in first.items() if g == group]
    return out


def python_findings(files: DataFrame, *groups: str) -> DataFrame:
    """The findings of those groups by one pass over the files, without a shuffle; `own` is the place of the group."""

    def rows_of(text: str) -> list[tuple]:
        found = python_findings_of(text)
        return [(*r, k) for k, g in enumerate(groups) for r in found.get(g, ())]

    src = files.where("content is not null").select("scan_id", "path", "content")
    return src.mapInArrow(_each_text(rows_of, PLACED), PLACED)


#: Fixed values, (severity, category): called names and methods, constructors, members, objects whose members are read, names wherever
#: they stand, assigned members, timers that get a text, elements that are created, and sources set to an address.
SCRIPT = {
    "call": {"Function": ("critical", "code_injection"), "XMLHttpRequest": ("info", "network"), "amplitude": ("medium", "telemetry"), "eval": ("critical", "code_injection"), "fetch": ("info", "network"), "ga": ("high", "telemetry"), "gtag": ("high", "telemetry"), "mixpanel": ("medium", "telemetry"), "segment": ("medium", "telemetry"), "unescape": ("medium", "obfuscation")},
    "method": {"String.fromCharCode": ("medium", "obfuscation"), "document.write": ("high", "xss"), "document.writeln": ("high", "xss"), "navigator.sendBeacon": ("high", "data_exfiltration")},
    "new": {"Image": ("medium", "data_exfiltration"), "WebSocket": ("medium", "network")},
    "member": {"document.cookie": ("medium", "data_access"), "navigator.language": ("low", "telemetry"), "navigator.userAgent": ("low", "telemetry")},
    "storage": {"localStorage": ("low", "data_access"), "sessionStorage": ("low", "data_access")},
    "name": {"atob": ("medium", "obfuscation"), "sentry": ("low", "telemetry")},
    "assign": {"innerHTML": ("medium", "xss"), "insertAdjacentHTML": ("medium", "xss"), "outerHTML": ("medium", "xss")},
    "timer": {"setInterval": ("high", "code_injection"), "setTimeout": ("high", "code_injection")},
    "element": {"iframe": ("high", "script_injection"), "script": ("high", "script_injection")},
    "source": {"src": ("medium", "script_injection")},
}


def _facts_of(x: Node):
    """(kind, name) of what rules know about one node."""
    name = x.value if x.kind == "Name" else None
    if name in SCRIPT["name"]:
        yield "name", name
    if not x.parts:
        return
    first = x.parts[0]
    called = first.value if first.kind == "Name" else None
    member = tuple(y.value if y.kind == "Name" else None for y in first.parts) if first.kind == "Member" else (None, None)
    text = x.parts[1].value if len(x.parts) > 1 and x.parts[1].kind == "Text" else None
    if x.kind == "Call":
        if called in SCRIPT["call"]:
            yield "call", called
        elif called in SCRIPT["timer"] and text is not None:
            yield "timer", called
        if f"{member[0]}.{member[1]}" in SCRIPT["method"]:
            yield "method", f"{member[0]}.{member[1]}"
        elif member == ("document", "createElement") and text in SCRIPT["element"]:
            yield "element", text
        elif member[0] and member[1] == "insertAdjacentHTML":
            yield "assign", member[1]
    elif x.kind == "New" and called in SCRIPT["new"]:
        yield "new", called
    elif x.kind == "Member":
        pair = f"{called}.{x.parts[1].value}" if x.parts[1].kind == "Name" else ""
        if pair in SCRIPT["member"]:
            yield "member", pair
        if called in SCRIPT["storage"]:
            yield "storage", called
    elif x.kind == "Assign" and first.kind == "Member":
        target = first.parts[1].value if first.parts[1].kind == "Name" else None
        if target in ("innerHTML", "outerHTML"):
            yield "assign", target
        elif target in SCRIPT["source"] and (text or "").startswith(("http://", "https://")):
            yield "source", target


@remembered
def script_facts(source: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of a script's syntax tree, in the order of a walk, each once.

    A text that isn't in the parser's language gives one fact `unparsed`: patterns are the fallback then. So does one without a fact
    that does nothing: an empty one, or prose such as `One. Two. Three` and `one | two`, which is in the language by chance.
    """
    try:
        tree = parse_script(source)
    except SyntaxError:
        return [("unparsed", "", 0)]
    found = list(dict.fromkeys((kind, name, x.line) for x in tree.walk() for kind, name in _facts_of(x)))
    return [("unparsed", "", 0)] if not found and does_nothing(tree) else found


#: Severity and category of a fact of a script.
_SCRIPT_RULES = {f"{kind}:{name}": v for kind, names in SCRIPT.items() for name, v in names.items()} | {"unparsed:": ("info", "parse_info")}


def _script_rows(text: str) -> list[tuple]:
    rows, own = {}, text.splitlines()
    for kind, name, line in script_facts(text):
        sev, cat = _SCRIPT_RULES[f"{kind}:{name}"]
        rows.setdefault((cat, line), (sev, cat, line or None, own[line - 1].strip()[:120] if 0 < line <= len(own) else "", f"{kind} {name}".strip()))
    return list(rows.values())


def _scripts(files: DataFrame) -> DataFrame:
    """(scan_id, path, content), a file without content as an empty one: every script is told of."""
    return files.select("scan_id", "path", F.coalesce("content", F.lit("")).alias("content"))


def script_findings(files: DataFrame) -> DataFrame:
    """Script rules by syntax tree; a finding for each category and line, the first of the walk. Kind `unparsed` comes as category parse_info."""
    return _scripts(files).mapInArrow(_each_text(_script_rows, FINDING), FINDING)


def sized_script_findings(files: DataFrame, size_at: int) -> DataFrame:
    """script_findings and size_findings by one pass over the files; `own` is 0, and size_at for sizes."""

    def rows_of(text: str) -> list[tuple]:
        rows = [(*r, 0) for r in _script_rows(text)]
        return [*rows, (*_too_large(text), size_at)] if len(text) > MOST_CHARS else rows

    return _scripts(files).mapInArrow(_each_text(rows_of, PLACED), PLACED)


def unparsed_scripts(files: DataFrame) -> DataFrame:
    """The files (scan_id, path, content) that aren't in the parser's language: where they are read, without a join."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            texts = b.column(2).dictionary_encode()
            bad = np.array([script_facts(t)[:1] == [("unparsed", "", 0)] for t in texts.dictionary.to_pylist()], bool)
            yield b.filter(pa.array(bad[texts.indices.to_numpy(zero_copy_only=False)]))

    return _scripts(files).mapInArrow(run, "scan_id string, path string, content string")


_template = re.compile(TEMPLATE)
#: Hosts of one's own network.
_private = re.compile(r"http://(localhost|127\.0\.0\.1|192\.168\.|10\.|172\.(1[6-9]|2\d|3[01])\.)")


def _may_hold(text: str) -> bool:
    """Can a YAML text have a finding? What a finding rests on stands in a line as it is, unless a quoted value writes it with a backslash."""
    service = "service_template" in text or "service" in text and ("{{" in text or "{%" in text)
    return service or "rest" in text and "http://" in text or "\\" in text


@remembered
def yaml_findings_of(text: str) -> list[tuple[str, str, str]]:
    """(severity, category, description) of the structure of a YAML text; unknown tags are read as plain values, broken texts give none."""
    if not _may_hold(text):
        return []
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def plain(loader, _, node):
        if isinstance(node, yaml.ScalarNode):
            return loader.construct_scalar(node)
        return loader.construct_sequence(node, True) if isinstance(node, yaml.SequenceNode) else loader.construct_mapping(node, True)

    Loader.add_multi_constructor("!", plain)
    try:
        top = yaml.load(text, Loader)  # noqa: S506  a SafeLoader
    except (yaml.YAMLError, RecursionError, ValueError, TypeError, AttributeError):
        return []
    out: list[tuple[str, str, str]] = []
    holds = lambda v: isinstance(v, str) and bool(_template.search(v))
    plain_http = lambda v: isinstance(v, str) and v.startswith("http://") and not _private.match(v)

    def actions(xs) -> None:
        for x in xs if isinstance(xs, list) else []:
            if not isinstance(x, dict):
                continue
            service = x.get("service") if isinstance(x.get("service"), str) else ""
            if "service_template" in x:
                out.append(("high", "automation_injection", "service_template"))
            if holds(service):
                out.append(("high", "automation_injection", f"service by template: {service[:80]}"))
            data = x.get("data_template") or x.get("data")
            if isinstance(data, dict) and service.startswith(("shell_command", "script")):
                out.extend(("high", "template_injection", f"template in {k} goes to {service}") for k, v in data.items() if holds(v))
            for key in ("sequence", "then", "else", "default"):
                actions(x.get(key))
            for y in x.get("choose") if isinstance(x.get("choose"), list) else []:
                actions(y.get("sequence") if isinstance(y, dict) else None)

    own = top.get("automation") if isinstance(top, dict) else top  # a file of its own is a list of automations
    for x in own if isinstance(own, list) else [own] if isinstance(top, dict) else []:
        if isinstance(x, dict):
            first = x.get("action") or x.get("actions") or x.get("sequence")
            actions([first] if isinstance(first, dict) else first)
    if isinstance(top, dict):
        commands = top.get("rest_command")
        for name, x in commands.items() if isinstance(commands, dict) else ():
            if plain_http(x.get("url") if isinstance(x, dict) else x):
                out.append(("medium", "insecure_transport", f"rest_command {name} over http"))
        for x in top.get("rest") if isinstance(top.get("rest"), list) else []:
            if isinstance(x, dict) and plain_http(x.get("resource") or x.get("url")):
                out.append(("medium", "insecure_transport", f"rest resource over http: {(x.get('resource') or x.get('url'))[:60]}"))
    return out


def yaml_structure_findings(files: DataFrame) -> DataFrame:
    def rows_of(text: str) -> list[tuple]:
        return [(s, c, None, "", d) for s, c, d in yaml_findings_of(text)]

    small = files.where("content is not null").where(F.char_length("content") <= MOST_CHARS)
    return small.select("scan_id", "path", "content").mapInArrow(_each_text(rows_of, FINDING), FINDING)
