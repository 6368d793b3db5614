"""Facts of a file as table functions, for SQL and LATERAL joins: one call for a file, a row for each fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from tessera.operators.ast_rules import CALLS, PLATFORM_ACCESS, PLATFORM_CALLS, SCHEMAS, SCRIPT, python_facts, script_facts, yaml_findings_of
from tessera.operators.line_rules import MOST_CHARS


@udtf(returnType="kind string, name string, line int, detail string", useArrow=True)
class PythonFacts:
    """Calls, imports, flows and platform use of a Python file up to MOST_CHARS; one fact `unparsed` for a file that isn't Python."""

    def eval(self, content: str):
        if content is not None and len(content) <= MOST_CHARS:
            yield from python_facts(content)


@udtf(returnType="kind string, name string, line int", useArrow=True)
class ScriptFacts:
    """What rules know of a script's syntax tree; one fact `unparsed` for a file in a newer language."""

    def eval(self, content: str):
        if content is not None:
            yield from script_facts(content)


@udtf(returnType="severity string, category string, description string", useArrow=True)
class YamlFacts:
    """Findings of the structure of a YAML file up to MOST_CHARS."""

    def eval(self, content: str):
        if content is not None and len(content) <= MOST_CHARS:
            yield from yaml_findings_of(content)


FUNCTIONS = {"python_facts": PythonFacts, "script_facts": ScriptFacts, "yaml_facts": YamlFacts}


def register(spark: SparkSession) -> tuple[str, ...]:
    """Makes the functions known to SQL, and returns their names."""
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)
    return tuple(FUNCTIONS)


def rule_table(spark: SparkSession) -> DataFrame:
    """(language, kind, name, severity, category): what a fact of some kind and name is worth; rules that are a lookup and no more."""
    rows = [("python", "call", n, *v) for n, v in CALLS.items()]
    rows += [("python", "platform", ".".join(n), *v) for n, v in PLATFORM_CALLS.items()] + [("python", "access", n, *v) for n, v in PLATFORM_ACCESS.items()]
    rows += [("python", "schema", n, "medium", "ha_no_validation") for n in SCHEMAS]
    rows += [("script", kind, n, *v) for kind, names in SCRIPT.items() for n, v in names.items()]
    return spark.createDataFrame(rows, "language string, kind string, name string, severity string, category string")
