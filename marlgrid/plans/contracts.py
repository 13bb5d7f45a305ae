"""Transform contracts: static checks of SQL and Python, schema comparison, and a run that is blocked where they fail."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Statements and modules that a transform may not use.
FORBIDDEN_SQL = ("DELETE", "DROP", "TRUNCATE")
FORBIDDEN_IMPORTS = ("subprocess", "socket", "urllib", "requests", "httpx", "pickle", "shutil", "tempfile")

_QUIET = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
#: Statements that come to one of the forbidden ones, by the name of their plan.
_PLANS = {"DeleteFromTable": "DELETE", "TruncateTable": "TRUNCATE", "TruncatePartition": "TRUNCATE"}


def _plans(spark: SparkSession, text: str) -> list:
    """All nodes of the parsed statement, those of common table expressions too; nothing is resolved or run."""
    found, todo = [], [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    while todo:
        node = todo.pop()
        found.append(node)
        inner = node.innerChildren().iterator()
        while inner.hasNext():
            x = inner.next()
            # a common table expression is a pair of its name and its plan
            x = x._2() if x.getClass().getSimpleName().startswith("Tuple") else x
            if hasattr(x, "innerChildren"):
                todo.append(x)
        below = node.children().iterator()
        while below.hasNext():
            todo.append(below.next())
    return found


def sql_findings(text: str, spark: SparkSession | None = None) -> list[str]:
    """What the parsed statement does besides reading: DELETE, DROP, TRUNCATE, or another change by its plan's name (INSERT, UPDATE, MERGE, CREATE, ...); `syntax`
    if one of its statements can't be parsed.  Names, literals and comments may hold any words."""
    if not (text or "").strip():
        return []
    spark = spark or SparkSession.active()
    found = set()
    for statement in _statements(text):
        try:
            # an input's place, {name}, stands for a table
            found |= _changes(spark, _plans(spark, re.sub(r"\{(\w+)\}", r"`\1`", statement)))
        except ParseException:
            found.add("syntax")
    return [w for w in FORBIDDEN_SQL if w in found] + sorted(found - set(FORBIDDEN_SQL))


def _statements(text: str) -> list[str]:
    """The text cut at semicolons outside literals, quoted names and comments."""
    bare, out, at = _QUIET.sub(lambda m: " " * len(m[0]), text), [], 0
    for m in re.finditer(";|$", bare):
        if bare[at : m.start()].strip():
            out.append(text[at : m.start()])
        at = m.end()
    return out


def _changes(spark: SparkSession, nodes: list) -> set[str]:
    command = spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command", True, nodes[0].getClass().getClassLoader())
    found = set()
    for node in nodes:
        kind = node.getClass().getSimpleName()
        if kind in _PLANS or kind.startswith("Drop"):
            found.add(_PLANS.get(kind, "DROP"))
        elif "ExecuteImmediate" in kind:
            found.add("EXECUTE")
        elif command.isInstance(node) or kind in ("InsertIntoStatement", "CompoundBody", "InsertIntoDir"):
            found.add(re.match("[A-Z][a-z]+", kind)[0].upper())
    return found


def python_findings(source: str) -> list[str]:
    """Forbidden modules that a source imports, and `syntax` if it can't be parsed."""
    try:
        tree = ast.parse(source or "")
    except SyntaxError:
        return ["syntax"]
    names = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names |= {a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            names.add(node.module.split(".")[0])
    return [m for m in FORBIDDEN_IMPORTS if m in names]


def schema_findings(observed: StructType, expected: Mapping[str, str]) -> list[str]:
    """Columns whose names or types differ; without an expectation any columns at all will do."""
    seen = {f.name: f.dataType.simpleString().upper() for f in observed}
    want = {k: v.upper() for k, v in expected.items()}
    if not want:
        return [] if seen else ["no columns"]
    return [f"{k}: {seen.get(k, 'absent')} for {want.get(k, 'nothing')}" for k in sorted(seen.keys() | want.keys()) if seen.get(k) != want.get(k)]


@dataclass
class RunRecord:
    """What a run came to: blocked before it began, failed, or succeeded; `questions` tell what to mend."""

    status: str
    findings: list[str] = field(default_factory=list)
    rows: int | None = None
    observed: dict[str, str] = field(default_factory=dict)

    @property
    def questions(self) -> list[str]:
        return [] if self.status == "succeeded" else [f"mend {f}" for f in self.findings]


def input_names(tables: list[str]) -> dict[str, str]:
    """Each table under the last part of its name; the first of equal ones holds."""
    out: dict[str, str] = {}
    for t in tables:
        out.setdefault(t.rsplit(".", 1)[-1], t)
    return out


def bound_inputs(spark: SparkSession, tables: list[str]) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables by alias, and those that don't exist."""
    names = input_names(tables)
    missing = [f"missing input {t}" for t in names.values() if not spark.catalog.tableExists(t)]
    return ({} if missing else {alias: spark.table(t) for alias, t in names.items()}), missing


def write_table(spark: SparkSession, df: DataFrame, target: str, expected: Mapping[str, str]) -> RunRecord:
    """df in place of the target table, schema and all; nothing is written where its schema isn't the expected one."""
    seen = {f.name: f.dataType.simpleString().upper() for f in df.schema}
    if found := schema_findings(df.schema, expected):
        return RunRecord("failed", found, None, seen)
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(target)
    return RunRecord("succeeded", [], spark.table(target).count(), seen)


def run_transform(spark: SparkSession, transform: Callable[[SparkSession, dict[str, DataFrame]], DataFrame], tables: list[str], target: str, expected: Mapping[str, str], source: str = "") -> RunRecord:
    """Runs a registered callable over tables and writes its result.

    Blocked if its source is refused or an input is missing; failed if it raises or its schema differs, and nothing is written then."""
    inputs, missing = bound_inputs(spark, tables)
    if found := python_findings(source) + missing:
        return RunRecord("blocked", found)
    try:
        df = transform(spark, inputs)
    except Exception as e:  # a transform's own failure is its record
        return RunRecord("failed", [f"{type(e).__name__}: {str(e)[:200]}"])
    return write_table(spark, df, target, expected)


def run_sql(spark: SparkSession, text: str, tables: list[str], target: str, expected: Mapping[str, str]) -> RunRecord:
    """Runs a SELECT over tables, each under its alias, and writes its result; blocked like run_transform, by the statements it holds."""
    inputs, missing = bound_inputs(spark, tables)
    found = sql_findings(text, spark) + ([] if (text or "").strip() else ["empty"]) + missing
    if found:
        return RunRecord("blocked", found)
    try:
        df = spark.sql(text, **inputs) if inputs else spark.sql(text)
    except Exception as e:
        return RunRecord("failed", [f"{type(e).__name__}: {str(e)[:200]}"])
    return write_table(spark, df, target, expected)
