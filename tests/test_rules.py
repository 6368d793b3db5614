import json

import pytest

from tessera.operators import ast_rules as A
from tessera.operators import line_rules as L
from tessera.operators.script_syntax import parse_script
from tessera.sources import deps, files, sinks


def rows(spark, *contents):
    return spark.createDataFrame([("s", p, c) for p, c in contents], "scan_id string, path string, content string")


def test_python_facts():
    src = "import re, pickle\nre.compile(x)\nmodel.eval()\nd = request.query\nif a:\n    d = 1\nos.system(d)\nsubprocess.run(d, shell=True)\nopen(d)\neval(entry.data['x'])\n"
    f = {(k, n, line) for k, n, line, _ in A.python_facts(src)}
    assert ("call", "eval", 3) in f and ("call", "compile", 2) not in f and ("import", "pickle", 1) in f
    assert {("flow", "system", 7), ("flow", "run", 8), ("flow", "open", 9)} <= f and ("flow", "eval", 10) not in f
    assert A.python_facts("def (:") == [("unparsed", "", 0, "")]


def test_import_rules(spark):
    f = A.facts(rows(spark, ("a.py", "import os\nfrom os import system\nimport subprocess.x\nimport http.client\nimport http\nimport subprocessing\nimport urllib.request\n")))
    got = {(r["category"], r["line"]) for r in A.import_findings(f).collect()}
    assert got == {("command_execution", 2), ("command_execution", 3), ("network", 7)}


def test_platform_rules(spark):
    src = "hass.services.call('a', 'b')\nhass.services.async_call(x, y)\nhass.bus.fire(e)\nz = hass.auth\nPLATFORM_SCHEMA = {}\nCONFIG_SCHEMA = vol.Schema({})\nself._hass.config\nhass.states.set(e, 1)\nother.auth\n"
    got = {(r["line"], r["severity"], r["category"]) for r in A.platform_findings(A.facts(rows(spark, ("a.py", src)))).collect()}
    assert got == {(1, "medium", "ha_api_risk"), (2, "medium", "ha_api_risk"), (2, "high", "ha_dynamic_service"), (3, "medium", "ha_event_injection"), (4, "high", "ha_auth_access"), (5, "medium", "ha_no_validation"), (7, "low", "ha_config_access"), (8, "medium", "ha_dynamic_entity")}


def test_script_rules():
    f = A.script_facts("el.innerHTML = 'x';\n// eval(1)\n'eval(2)';\nnew Image('x');\nif (el.innerHTML == 1) {}\neval(3)\nimg.src = 'http://x'\n")
    assert f == [("assign", "innerHTML", 1), ("new", "Image", 4), ("call", "eval", 6), ("source", "src", 7)]
    assert A.script_facts("f(")[0][0] == "unparsed"


@pytest.mark.parametrize(
    "script, found",
    (
        ("`<b>${eval(x)}</b>`", ["eval"]),
        ("`eval(x) ${`${ `eval(y)` } ${unescape(z)}`}`", ["unescape"]),
        ("/'/.test(b); eval(q); /'/.test(c)", ["eval"]),
        ("a = b / eval / c", []),
        ("if (a) /eval(x)/.test(b); x = y\n/ fetch(u) / z", ["fetch"]),
        ("x.map(atob); ({atob: 1}); atob: for (;;) break atob", ["atob"]),
        ("this.sentry.go(); Sentry.go()", ["sentry"]),
        ("f(async (a, {b = eval(c)}) => { await fetch(u) })", ["eval", "fetch"]),
        ("class A extends B { get x() { return document.cookie } static async m() { localStorage.x = 1 } }", ["document.cookie", "localStorage"]),
        ("setTimeout('a', 1); setTimeout(`a`, 1); setInterval(go, 1)", ["setTimeout"]),
        ("document.createElement('script'); document.createElement('div'); document['createElement']('iframe')", ["script"]),
        ("window.eval(x); (eval)(y)", ["eval"]),
        ("a.b.src = 'https://x'; c.src += y; src = 'http://z'", ["src"]),
        ("export default function* g() { yield* fetch(u) }", ["fetch"]),
    ),
)
def test_script_syntax(script, found):
    assert sorted({name for _, name, _ in A.script_facts(script)}) == found


PARSED = ("a\n++b", "let x; let\n[y] = z", "for (var i in a, b);", "for (let [a] of b) ;", "a ? b : c ? d : e", "({get, set, async, get a() {}, set a(b) {}, 'c': 1, [d]: 2, ...e})", "(a, ...b) => ({})", "async x => await x", "new a.b(c).d()", "x = {if: 1}.if", "try { a } catch ({b}) { c } finally { d }", "import a, * as b from 'c'; import('d')", "export {a as default} from 'b'", "tag`x${y}`", "({a = 1} = b)", "0x1F + .5 + 1e3", "a ** b ** c", "if (a) b\nelse c", "do a; while (b) c", "'\\u{41}\\\nb'", "(" * 500 + "a" + ")" * 500)
NOT_PARSED = ("a?.b", "a ?? b", "class A { x = 1 }", "1n", "1_0", "try {} catch {}", "let x: number = 1", "<a/>", "a b", "`x${", "'a", "()", "(a,)", "({a b})", "async function* f() {}", "=> a", "1 = 2", "/* a", "f(")


def test_what_a_script_is():
    for s in PARSED:
        parse_script(s)
    for s in NOT_PARSED:
        with pytest.raises(SyntaxError):
            parse_script(s)


def test_a_text_that_does_nothing_is_no_script():
    for s in ("", " \n", "// a", "word", "One. Two. Three", "One, two\nthree;", "one | two", "https://example.org\nword", "- a\n- b", "'eval(x)'"):
        assert A.script_facts(s) == [("unparsed", "", 0)]
    for s in ("a()", "a = 1", "a++", "delete a.b", "let x", "import 'a'", "function f() {}", "if (a) b", "new A", "a`b`"):
        assert A.script_facts(s) == []
    assert A.script_facts("document.cookie") == [("member", "document.cookie", 1)]


def test_lines_of_nodes():
    got = {(x.kind, x.value, x.line) for x in parse_script("a = `\n\n${b}`;\n/* \n */ c\n.d('\\\n', e)").walk() if x.kind in ("Name", "Call")}
    assert got == {("Name", "a", 1), ("Name", "b", 3), ("Name", "c", 5), ("Name", "d", 6), ("Call", None, 5), ("Name", "e", 7)}


def test_large_files(spark):
    """A Python or YAML file beyond the size isn't looked into; a script is, and told as well."""
    large = "x = 1\n" * 100_000
    py = rows(spark, ("a.py", "analytics\n" + large), ("b.py", "analytics\n"))
    assert [r["file"] for r in L.scan_parts(py).collect()] == ["b.py"] and [r["file"] for r in A.size_findings(py).collect()] == ["a.py"]
    text = "a: !include /x\n# password: abcdefghijk\nshell_command:\n"
    y = rows(spark, ("a.yaml", text + "#\n" * 300_000), ("b.yaml", text))
    for f in (L.scan_includes, L.scan_secret_comments, L.scan_yaml_patterns):
        assert [r["file"] for r in f(y).collect()] == ["b.yaml"]
    js = rows(spark, ("a.js", "eval(x);\n" + "y;\n" * 300_000))
    assert [r["category"] for r in A.script_findings(js).collect()] == ["code_injection"] and A.size_findings(js).count() == 1


def test_fingerprints_are_of_whole_files(spark):
    """Imports of files beyond the size that scanners look into, by the tree and, of one that is no Python, by pattern."""
    from tessera.operators.fingerprints import fingerprints

    large = "x = 1\n" * 100_000
    x = fingerprints(rows(spark, ("a.py", "import os.path\n" + large + "from json import loads\n"), ("b.py", "from re import match\ndef (:\n" + large + "import sys\n"))).first()
    assert x["imports"] == ["json", "os", "re", "sys"] and (x["py_files"], x["total_lines"]) == (2, 200_005)


def test_yaml_rules(spark):
    text = "automation:\n  - action:\n      - service: \"{{ x }}\"\n      - choose:\n          - sequence:\n              - service: shell_command.x\n                data: {a: \"{{ b }}\"}\n      - service: null\n        data: {a: \"{{ b }}\"}\n      - service_template: x\nother: !secret x\nrest: [{resource: http://a}, {resource: http://192.168.1.1/x}]\n"
    assert [(s, c) for s, c, _ in A.yaml_findings_of(text)] == [("high", "automation_injection"), ("high", "template_injection"), ("high", "automation_injection"), ("medium", "insecure_transport")]
    assert A.yaml_findings_of("a: [") == [] and A.yaml_findings_of("- service: '{{ x }}'") == []
    assert [d for _, _, d in A.yaml_findings_of("- action: {service: '{{ x }}'}\n- actions: [{service_template: a}]\n- b\n- sequence: c")] == ["service by template: {{ x }}", "service_template"]
    y = rows(spark, ("a.yaml", "url: http://10.0.0.1/x\nurl: http://evil.example/x\npassword: abcdefghijk\npassword: !secret x\nshell_command:\nshell_command:\n  a: \"{{ states('x') }}\"\nb: \"{% import x %}\"\n"), ("b.yaml", "a: \"{{ states('x') }}\"\n"))
    got = sorted((r["category"], r["severity"], r["line"]) for r in L.scan_yaml_patterns(y).collect())
    assert got == [("code_injection", "critical", 8), ("command_execution", "medium", 5), ("command_execution", "medium", 6), ("hardcoded_secret", "high", 3), ("insecure_transport", "low", 2), ("template_injection", "high", 7)]
    inc = rows(spark, ("a.yaml", "a: !include {{ x }}.yaml\nb: !include ../x.yaml\nc: !include ok.yaml\nd: !include /abs.yaml"))
    assert sorted((r["line"], r["severity"]) for r in L.scan_includes(inc).collect()) == [(1, "high"), (2, "medium"), (4, "medium")]


def test_vendor_files_are_passed_over(spark):
    f = rows(spark, *((p, "eval(x)") for p in ("a.js", "my-prism.js", "docsify.min.js", "x/highlight.pack.ts", "prism/a.js")))
    assert {r["path"] for r in files.files_for(f, "js").collect()} == {"a.js", "prism/a.js"}


def test_first_line_of_each_pattern(spark):
    got = {(r["rule"], r["line"]) for r in L.scan_script_patterns(rows(spark, ("a.js", "x\nEVAL (1)\neval(2)\nnew Function(1)\nfunction (x)"), ("b.js", None), ("c.js", ""))).collect()}
    assert got == {(0, 2), (1, 4)}


def test_a_text_is_cut_into_lines_once(spark):
    """Each rule looks only at the lines that any rule hits, whatever ends them."""
    y = rows(spark, ("a.yaml", "shell_command:\n\x0cpassword: abcdefghijk\r\n\r\nurl: http://evil.example/x"), ("b.yaml", "\n\nshell_command:\n\n"))
    got = sorted((r["file"], r["category"], r["line"], r["code"]) for r in L.scan_yaml_patterns(y).collect())
    assert got == [("a.yaml", "command_execution", 1, "shell_command:"), ("a.yaml", "hardcoded_secret", 3, "password: abcdefghijk"), ("a.yaml", "insecure_transport", 5, "url: http://evil.example/x"), ("b.yaml", "command_execution", 3, "shell_command:")]
    plan = L.scan_yaml_patterns(y)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # at \n, or at all line ends


def test_a_pattern_hits_only_texts_that_hold_its_words():
    import re

    from tessera.plans.sample import SAMPLE

    patterns = [p for p, *_ in (*L.SCRIPT_PATTERNS, *L.YAML_PATTERNS)] + [L.SECRET_IN_COMMENT, "!include", *(r"(?i)" + re.escape(p) for p, *_ in L.PYTHON_PARTS)]
    own = [x for _, _, c in SAMPLE for x in c.splitlines()]
    hits = [(p, x) for p in patterns for x in (*own, *map(str.upper, own)) if re.search(p, x)]
    assert len({p for p, _ in hits}) > 20
    for p, x in hits:
        assert any(w in x.lower() for w in L.signs(p)), (p, x)
    assert L.signs(r"(?i)google[\-_]?analytics|gtag|ga\s*\(") == ("analytics", "gtag", "ga") and L.signs(r"(?i)\Qbase64.b64decode\E") == ("base64.b64decode",)
    assert L.signs(r"(?i)#.*\b(password|token)\s*[:=]\s*\S{8,}") == ("password", "token") and L.signs(r"^\s*url:\s*http://(?!a|b(c|d))") == ("http://",)
    for p in ("a", "ab?", "(ab|cd)?e", "ab|.", r"[abc]d", r"\x41bc", "(?x)a b", "(?iu)ask", r"a{2}b"):
        assert L.signs(p) == ()


def test_lines_are_found_with_and_without_words(spark):
    y = rows(spark, ("a", "x\nEVAL(1)\n\u00c9val (eval)\n12 eval (2)"), ("b", "EVA\n34"), ("c", "eval"))
    one, two = (r"(?i)\beval\s*\(", "high", "a"), (r"[0-9]{2}", "low", "b")
    told = lambda *rules: sorted((r["file"], r["category"], r["line"]) for r in L.scan_script_patterns(y, rules).collect())
    assert told(one) == [("a", "a", 2)] and told(one, two) == [("a", "a", 2), ("a", "b", 4), ("b", "b", 2)]


def test_dependencies_are_found_in_one_pass(spark):
    f = rows(spark, ("pyproject.toml", "  dependencies = [\n    'a==1.0',\n  ]\n  'b==2.0'"), ("x/requirements.txt", "  c==3.5 \r\n# d==1\n"), (".venv/requirements.txt", "e==1"), ("package.json", '{"dependencies": 5}'), ("b/package.json", None))
    d = deps.discover(f)
    assert sorted((r["package"], r["version"]) for r in d.collect()) == [("a", "1.0"), ("c", "3.5")]
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_component_types_are_grouped_without_a_sort(spark):
    hacs = ("Theme", "zzz", "CARD", "a", "integration", "lovelace")
    f = spark.createDataFrame([(f"s{k}", "hacs.json", '{"category": "%s"}' % c) for k, c in enumerate(hacs)] + [("s5", "hacs.json", '{"category": "theme"}'), ("s1", "a.js", ""), ("s3", "b.py", ""), ("t", "c.yaml", "")], "scan_id string, path string, content string")
    x = files.component_types(f)
    assert {r["scan_id"]: r["component_type"] for r in x.collect()} == {"s0": "theme", "s1": "card", "s2": "card", "s3": "integration", "s4": "integration", "s5": "theme", "t": "unknown"}
    assert "Sort" not in x._jdf.queryExecution().executedPlan().toString()


def test_dependencies(spark):
    f = rows(spark, ("requirements.txt", "# x\n\n-r y\nA.b>=1.2,<2\nnone\nx[y]==1\n"), ("pyproject.toml", "x = [\n'no==1',\n]\ndependencies = [\n  \"numpy>=1.20\",\n  'ctx==0.1',\n]\n'late==1'"), ("package.json", '{"dependencies": {"event-stream": "^3.3.6", "g": "git+x"}, "devDependencies": {"b": "1.2"}}'), ("node_modules/package.json", '{"dependencies": {"c": "1.2"}}'))
    d = deps.discover(f)
    assert {(r["package"], r["version"], r["ecosystem"]) for r in d.collect()} == {("A.b", "1.2", "PyPI"), ("numpy", "1.20", "PyPI"), ("ctx", "0.1", "PyPI"), ("event-stream", "3.3.6", "npm"), ("b", "1.2", "npm")}
    assert {r["package"] for r in deps.malicious(d).collect()} == {"ctx", "event-stream"}


def test_manifest_falls_through_to_the_next(spark):
    f = rows(spark, ("custom_components/a/manifest.json", "{broken"), ("custom_components/b/manifest.json", '{"domain": "b", "requirements": ["x==1"]}'))
    m = files.manifests(f).first()
    assert (m["domain"], m["name"], m["requirements"], m["dependencies"]) == ("b", "s", ["x==1"], [])
    assert files.component_types(f).first()["component_type"] == "integration"


def test_reply_and_settings(spark):
    r = spark.createDataFrame([("a", 'text ```json\n{"score": 12, "summary": "ok", "confidence": 50}\n```'), ("b", "none"), ("c", None)], "scan_id string, reply string")
    got = {x["scan_id"]: (x["score"], x["summary"], x["ok"]) for x in files.parse_replies(r).collect()}
    assert got["a"] == (10.0, "ok (confidence: 50%)", True) and got["b"][2] is False and got["c"][0] is None
    assert files.settings('{"max_code_context": 5}', {"SANDBOX_MAX_CODE_CONTEXT": "7", "SANDBOX_CVE_WATCH": "true"})["max_code_context"] == 5
    assert files.settings(None, {"SANDBOX_CVE_WATCH": "true"})["cve_watch"] is True


def test_files_and_reports_round_trip(spark, tmp_path):
    (tmp_path / "in/s1/tests").mkdir(parents=True)
    (tmp_path / "in/s1/a.py").write_bytes(b"x = 1\xff\n")
    (tmp_path / "in/s1/tests/b.py").write_text("y")
    f = files.read_files(spark, str(tmp_path / "in"))
    assert {(r["scan_id"], r["path"]) for r in f.collect()} == {("s1", "a.py"), ("s1", "tests/b.py")}
    assert [r["content"] for r in files.files_for(f, "python").collect()] == ["x = 1�\n"]
    found = spark.createDataFrame([("s1", 0, "high", "xss", "a", None, "<c>", "d & e")], "scan_id string, seq long, severity string, category string, file string, line int, code string, description string")
    scans = spark.sql("SELECT 's1' AS id, 'N' AS name, timestamp'2024-01-01' AS created_at, 'done' AS status")
    sinks.write_json(sinks.reports(scans, found), str(tmp_path / "out"))
    r = files.load_reports(spark, str(tmp_path / "out")).first()
    assert r["stats"]["high"] == 1 and r["findings"][0]["category"] == "xss"
    assert "d &amp; e" in sinks.html_reports(scans, found).first()["html"]
    doc = json.loads(sinks.sarif(found).first()["sarif"])
    assert doc["runs"][0]["results"][0]["ruleId"] == "xss" and doc["runs"][0]["tool"]["driver"]["rules"][0]["defaultConfiguration"]["level"] == "error"
    sinks.write_csv(found, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["severity", "category", "file", "line", "description", "code"]


def test_a_text_is_parsed_once_for_all_files_that_hold_it(monkeypatch):
    import pyarrow as pa

    from tessera.operators import ast_rules

    asked = []
    rows_of = lambda t: asked.append(t) or [("call", n, k, "", t) for k, n in enumerate(t.split())]
    texts = ["a b", "", "c", "a b", "c", "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array([f"s{k}" for k in range(6)]), pa.array([f"{k}.py" for k in range(6)]), pa.array(texts)], ["scan_id", "path", "content"])
    monkeypatch.setattr(ast_rules, "MOST_ROWS", 3)
    out = list(ast_rules._each_text(rows_of, ast_rules.FACT)([batch]))
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(f"s{k}", f"{k}.py", "call", n, i, "", t) for k, t in enumerate(texts) for i, n in enumerate(t.split())]
    assert asked == ["a b", "", "c"] and [b.num_rows for b in out] == [3, 3, 2]


def test_texts_are_remembered_up_to_a_number_of_characters(monkeypatch):
    from tessera.operators import ast_rules

    asked = []
    f = ast_rules.remembered(lambda t: asked.append(t) or [t])
    monkeypatch.setattr(ast_rules, "REMEMBERED", 5)
    assert [f(t) for t in ("aa", "bb", "aa", "cc", "aa", "bb", "longest", "aa")] == [["aa"], ["bb"], ["aa"], ["cc"], ["aa"], ["bb"], ["longest"], ["aa"]]
    assert asked == ["aa", "bb", "cc", "bb", "longest", "aa"]


def test_yaml_that_can_hold_no_finding_is_not_parsed():
    import time

    from tessera.operators.ast_rules import yaml_findings_of

    start = time.perf_counter()
    assert yaml_findings_of("a few words of prose, at rest\n" * 5_000) == []
    assert time.perf_counter() - start < 0.1
    hidden = '- sequence:\n    - "ser\\x76ice_template": t\n'
    assert yaml_findings_of(hidden) == [("high", "automation_injection", "service_template")]
