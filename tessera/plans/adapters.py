"""The shapes of the engine, made of the tables at hand. The same SQL text serves both sides of a comparison.

{name} stands for a table; Spark gets it as a DataFrame, other engines by its name. Braces of a text are doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FINDINGS = """
SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS seq,
       severity, category, file, line, code, description
FROM (
  SELECT l.*, concat('scan', CAST(CAST(floor(l_orderkey / 1500) AS BIGINT) AS STRING)) AS scan_id,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS severity,
         CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'code_injection' WHEN 'AO' THEN 'taint_code_injection' WHEN 'NF' THEN 'telemetry'
              WHEN 'NO' THEN 'network' WHEN 'RF' THEN 'xss' ELSE 'script_injection' END AS category,
         concat('src/p', CAST(l_partkey % 200 AS STRING), '.py') AS file,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 0 ELSE l_linenumber END AS line,
         CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE concat('call_', CAST(l_suppkey % 5 AS STRING)) END AS code,
         concat(CASE WHEN l_suppkey % 2 = 0 THEN 'The same thirty characters to start with, then ' ELSE 'Text of ' END, CAST(l_suppkey % 7 AS STRING)) AS description
  FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
) x
"""
COMPONENTS = """
SELECT DISTINCT concat('scan', CAST(CAST(floor(l_orderkey / 1500) AS BIGINT) AS STRING)) AS scan_id,
       CASE CAST(floor(l_orderkey / 1500) AS BIGINT) % 4 WHEN 0 THEN 'integration' WHEN 1 THEN 'card' WHEN 2 THEN 'theme' ELSE 'unknown' END AS component_type
FROM {lineitem}
"""
WHITELIST = """
SELECT CASE WHEN p_partkey % 2 = 0 THEN substr(sha2(CAST(concat_ws('|', 'xss', concat('src/p', CAST(p_partkey AS STRING), '.py'), 'Text of 3') AS BINARY), 256), 1, 16) ELSE concat('none', CAST(p_partkey AS STRING)) END AS pattern_hash,
       CASE WHEN p_partkey % 4 = 1 THEN 'network' ELSE 'telemetry' END AS category,
       CASE WHEN p_partkey % 4 = 1 THEN concat('p', CAST(p_partkey AS STRING), '.py') WHEN p_partkey % 4 = 3 THEN concat('p1', CAST(p_partkey AS STRING)) ELSE '' END AS file_pattern
FROM {part}
"""
HISTORY = """
SELECT event_id AS id, concat('d', CAST(user_id AS STRING)) AS domain, concat('https://example.org/', CAST(user_id % 9 AS STRING)) AS repo_url, ts AS scanned_at,
       CASE WHEN event_type = 'error' THEN NULL ELSE least(floor(value) / 2.0E0, 10.0E0) END AS score,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS findings_count, event_id % 500 + 1 AS total_lines, user_id % 7 AS py_files, user_id % 3 AS js_files,
       CASE WHEN event_id % 97 = 0 THEN 300 ELSE event_id % 11 END AS network_domain_count
FROM {events}
"""
FINGERPRINTS = """
SELECT page_id AS id, CASE WHEN CAST(floor(page_id / 12) AS BIGINT) % 4 < 3 THEN concat('c', CAST(CAST(floor(page_id / 12) AS BIGINT) AS STRING)) ELSE '' END AS domain, concat('https://example.org/', CAST(CAST(floor(page_id / 12) AS BIGINT) AS STRING)) AS repo_url,
       page_id AS created_at,
       split(concat('os,lib', CAST(page_id % 7 AS STRING), ',mod', CAST(page_id % 3 AS STRING)), ',') AS imports,
       split(concat('hass.states,hass.bus', CAST(page_id % 2 AS STRING)), ',') AS ha_apis,
       split(concat(regexp_extract(url, '://([^/]+)', 1), CASE WHEN page_id % 17 = 0 THEN ',x.pastebin.com' ELSE '' END), ',') AS network_domains,
       (page_id % 13 + 1) * CASE WHEN CAST(floor(page_id / 12) AS BIGINT) % 9 = 3 THEN 100 ELSE 1 END AS total_lines
FROM {pages}
"""
SOURCES = """
SELECT source AS scan_id, concat(CAST(doc_id AS STRING), '.js') AS path, text AS content FROM {documents}
UNION ALL SELECT 'f1', 'a.js', concat('let a = eval("1");', chr(10), 'el.innerHTML = x; fetch(u)', chr(10), 'eval(2); localStorage.x = 1', chr(10), 'Sentry.init(); google-analytics; base64.b64decode(y)')
UNION ALL SELECT 'f1', 'b.js', concat('new Function("x")', chr(10), 'document.cookie; gtag("event")', chr(10), 'setTimeout("go()", 5)')
UNION ALL SELECT 'f2', 'c.yaml', concat('# password: hunter2hunter2', chr(10), 'ok: 1', chr(10), '# token = abcdefgh12345', chr(10), '# secret: 123456789', chr(10), '# api_key: 987654321')
UNION ALL SELECT 'f2', 'd.js', concat('function _0xabcd(_0x1234);', chr(10), '_0xabcd[0]; _0xbeef(1); _0xcafe=2; ', repeat('license activation premium ', 4), repeat('paypal ', 6), repeat('iframe ', 3), 'https://evil.example.com/path/x https://github.com/some/repo')
"""
#: All documents as files of every language that is scanned, 500 of a source to a component, and a component with a manifest and requirements for each part.
FILES = """
SELECT concat(source, '-', CAST(CAST(floor(doc_id / 500) AS BIGINT) AS STRING)) AS scan_id, concat(CAST(doc_id AS STRING), suffix) AS path, text AS content FROM {documents} CROSS JOIN (SELECT explode(array('.py', '.js', '.yaml')) AS suffix) x
UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), concat('custom_components/p', CAST(p_partkey AS STRING), '/', name),
       CASE name WHEN 'manifest.json' THEN to_json(named_struct('domain', concat('p', CAST(p_partkey AS STRING)), 'name', p_name, 'requirements', array(concat(replace(p_name, ' ', '-'), '==', CAST(p_size AS STRING)))))
            WHEN 'package.json' THEN to_json(named_struct('dependencies', map(replace(p_name, ' ', '-'), concat('^', CAST(p_size AS STRING), '.0.0'))))
            ELSE concat(replace(p_name, ' ', '_'), '>=', CAST(p_size AS STRING), chr(10)) END
FROM {part} CROSS JOIN (SELECT explode(array('manifest.json', 'package.json', 'requirements.txt')) AS name) y
"""
#: A script for each part, whose lines vary by its key and size: code in templates, behind regular expressions, in callbacks; some are no script.
SCRIPTS = """
SELECT concat('p', CAST(p_partkey AS STRING)) AS scan_id, concat('card', CAST(p_partkey % 3 AS STRING), '.js') AS path, p_partkey AS k, p_size AS s,
       concat_ws(chr(10),
         CASE p_partkey % 2 WHEN 0 THEN concat('const a = `<b>$', '{{eval(x)}}</b>`;') ELSE 'const a = `<b>eval(x)</b>`;' END,
         CASE p_size % 3 WHEN 0 THEN 'if (/"/.test(b)) fetch(u); /"/.test(c);' WHEN 1 THEN 'b = 1 / fetch / 2;' ELSE 'b = "fetch(u)"; // fetch(u)' END,
         CASE p_partkey % 5 WHEN 0 THEN 'x.map(atob);' ELSE 'x.map(btoa);' END,
         CASE p_size % 4 WHEN 0 THEN 'this.sentry.go();' WHEN 1 THEN concat('f(() => {{ el.innerHTML = `$', '{{y}}`; }});') WHEN 2 THEN 'if (el.innerHTML == y) z();' ELSE 'g({{key: document.cookie}});' END,
         CASE p_partkey % 7 WHEN 0 THEN 'setTimeout("go()", 1);' WHEN 1 THEN 'setTimeout(() => go(), 1);' ELSE concat('go(/[/`]/, `/$', '{{"`"}}`);') END,
         CASE WHEN p_partkey % 11 = 0 THEN 'a?.b;' ELSE 'a.b;' END) AS content
FROM {part}
"""
#: A file of automations for each part: as a list of its own, below its key, or with nested sequences.
AUTOMATIONS = """
SELECT concat('p', CAST(p_partkey AS STRING)) AS scan_id, concat('auto', CAST(p_partkey % 4 AS STRING), '.yaml') AS path, p_partkey AS k, p_size AS s,
       CASE p_partkey % 4
         WHEN 0 THEN concat('- alias: a', chr(10), '  action:', chr(10), '    - service: "{{{{ x', CAST(p_size AS STRING), ' }}}}"', chr(10), '- alias: b', chr(10), '  actions: {{service: light.on}}')
         WHEN 1 THEN concat('automation:', chr(10), '  action:', chr(10), '    service_template: t', CAST(p_size AS STRING))
         WHEN 2 THEN concat('- sequence:', chr(10), '    - choose:', chr(10), '        - sequence:', chr(10), '            - service: script.s', CAST(p_size AS STRING), chr(10), '              data: {{v: "{{{{ y }}}}", w: plain}}')
         ELSE concat('- service: "{{{{ x }}}}"', chr(10), '- plain', CAST(p_size AS STRING)) END AS content
FROM {part}
"""
#: Three files for each part; of every 500th part they are larger than what is looked into.
SIZED = """
SELECT concat('p', CAST(p_partkey AS STRING)) AS scan_id, name AS path, p_partkey AS k, p_size AS s,
       concat(CASE name WHEN 'a.py' THEN concat('import analytics', chr(10), 'eval(x)') WHEN 'a.js' THEN 'eval(x);' ELSE concat('a: !include /x', CAST(p_size AS STRING), chr(10), '# password: abcdefghijk', chr(10), 'shell_command:') END,
              repeat(concat(chr(10), CASE name WHEN 'a.yaml' THEN '# = 1' ELSE 'x = 1' END), CASE WHEN p_partkey % 500 = 0 THEN 90000 ELSE 2 END)) AS content
FROM {part} CROSS JOIN (SELECT 'a.py' AS name UNION ALL SELECT 'a.js' UNION ALL SELECT 'a.yaml') n
"""
#: A tree of files for each supplier: bytes that are no text, folders that readers pass over, files that none looks at.
TREES = """
SELECT concat('s', CAST(s_suppkey AS STRING)) AS scan_id, path, s_suppkey AS k, concat('name = "', s_name, '"', chr(10)) AS text, path LIKE '%.py' AND s_suppkey % 3 = 0 AS broken
FROM {supplier} CROSS JOIN (SELECT 'a/x.py' AS path UNION ALL SELECT 'tests/y.py' UNION ALL SELECT 'z.yaml' UNION ALL SELECT 'w.bin') t
"""
#: Installed components with the address of their files, and their scans so far.
INSTALLED = """
SELECT concat('d', CAST(s_suppkey AS STRING)) AS domain, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN concat('o/', CAST(s_suppkey AS STRING)) ELSE concat('https://example.org/', CAST(s_suppkey AS STRING)) END AS repository, CAST(s_suppkey % 3 AS STRING) AS version, s_suppkey AS k FROM {supplier}
"""
SCANNED = """
SELECT CAST(s_suppkey AS STRING) AS id, concat('d', CAST(s_suppkey AS STRING)) AS domain, CASE WHEN s_suppkey % 5 = 1 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-02 12:00:00' END AS scanned_at, CASE WHEN s_suppkey % 7 = 0 THEN 'old' ELSE CAST(s_suppkey % 3 AS STRING) END AS version FROM {supplier} WHERE s_suppkey % 4 > 0
"""
REPLIES = """
SELECT CAST(c_custkey AS STRING) AS scan_id, c_custkey AS k,
       CASE c_custkey % 4 WHEN 0 THEN concat('Here: {{"score": ', CAST(c_custkey % 25 AS STRING), ', "summary": "s", "confidence": ', CAST(c_custkey % 120 AS STRING), '}} and more')
            WHEN 1 THEN concat('```json', chr(10), '{{"summary": "a {{b}}", "score": "x"}}', chr(10), '```') WHEN 2 THEN 'no object' ELSE '{{"score": 1' END AS reply FROM {customer}
"""
REPOS = """
SELECT CASE c_custkey % 3 WHEN 0 THEN concat('https://example.org/r', CAST(c_custkey % 40 AS STRING)) WHEN 1 THEN concat(' o/r', CAST(c_custkey AS STRING)) ELSE '' END AS url, CAST(c_nationkey AS STRING) AS name FROM {customer}
"""
CACHED = """
SELECT concat('/repos/', CAST(c_custkey AS STRING)) AS path, TIMESTAMP '2024-01-31 00:00:00' - c_custkey * INTERVAL '4' HOUR AS mtime, CASE c_custkey % 3 WHEN 0 THEN 'repos' ELSE 'reports' END AS kind, c_custkey * 1000 AS length FROM {customer}
"""
PACKAGES = """
SELECT p_partkey AS id, concat('s', CAST(p_partkey % 10 AS STRING)) AS scan_id, name, 'PyPI' AS ecosystem,
       concat(name, CASE p_partkey % 4 WHEN 0 THEN '==' WHEN 1 THEN '>=' WHEN 2 THEN ' ~= ' ELSE '' END, CAST(p_size AS STRING), '.', CAST(p_partkey % 3 AS STRING)) AS req
FROM (SELECT p.*, CASE p_partkey % 50 WHEN 0 THEN 'Colourama' WHEN 1 THEN 'ctx' WHEN 2 THEN 'jeIlyfish' ELSE replace(p_name, ' ', '-') END AS name FROM {part} p) y
"""
FEED = """
SELECT DISTINCT 'PyPI' AS ecosystem, upper(replace(p_name, ' ', '-')) AS package, concat(CAST(p_size AS STRING), '.', CAST(p_partkey % 3 AS STRING)) AS version, concat('V-', CAST(p_partkey % 6 AS STRING)) AS vuln_id,
       CASE p_partkey % 6 WHEN 0 THEN 'CVSS:3.1/9.8' WHEN 1 THEN 'CVSS:3.1/AV:N/7.0' WHEN 2 THEN 'CVSS/4.5/9.9' WHEN 3 THEN 'CVSS:3.1/AV:N/AC:L' WHEN 4 THEN '9.9' ELSE 'CVSS/1' END AS score
FROM {part}
"""
JOBS = """
SELECT o_orderkey AS id, concat('b', CAST(o_custkey % 100 AS STRING)) AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS created_at FROM {orders}
"""
CHECKS = """
SELECT event_id AS id, concat('d', CAST(user_id AS STRING)) AS component, ts AS checked_at,
       split(concat('cve ', CAST(event_id % 4 AS STRING), ',', event_type, ',', 'k', CAST(event_id % 3 AS STRING)), ',') AS alerts
FROM {events}
"""
CONTEXT = """
SELECT concat(source, '-', CAST(CAST(floor(doc_id / 500) AS BIGINT) AS STRING)) AS scan_id, concat('f', lpad(CAST(doc_id AS STRING), 9, '0')) AS path, text AS content, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS prio FROM {documents}
"""

#: Shapes that make files of the rows of a small table, and how many of its rows a task makes files of.
SPREAD = (FILES, SCRIPTS, AUTOMATIONS, SIZED, TREES)
ROWS_PER_TASK = 2_000

TABLES = ("lineitem", "orders", "part", "events", "pages", "documents", "supplier", "customer")


def dealt(table: DataFrame) -> DataFrame:
    """A small table over as many tasks as its rows need once each is some files: its own file is read by a few."""
    return table.repartition(max(-(-table.count() // ROWS_PER_TASK), 1))


def make(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in shape}
    if shape in SPREAD:
        used |= {t: dealt(used[t]) for t in ("part", "supplier") if t in used}
    return spark.sql(shape, **used) if used else spark.sql(shape)


def text(shape: str) -> str:
    """The SQL of a shape over tables by name."""
    for t in TABLES:
        shape = shape.replace("{" + t + "}", t)
    # the one function that goes by another name
    return shape.replace("{{", "{").replace("}}", "}").replace("sha2(CAST(", "sha256(CAST(").replace(" AS BINARY), 256)", " AS STRING))").strip()
