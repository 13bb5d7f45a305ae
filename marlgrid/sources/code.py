"""Python sources to typed rows: modules, classes, functions, fields, and the links between them."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.functions.text import effect_class, phase

ENTITY = "kind string, module string, class_name string, name string, ref_type string, doc string, decorators array<string>, line int, error string"


def _entities(module: str, source: str | None):
    """Rows of one file; a file that can't be parsed gives one row with the error."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError) as e:
        return [("module", module, None, module, None, None, [], 0, str(e)[:200])]
    rows = [("module", module, None, module, None, ast.get_docstring(tree), [], 0, None)]

    def walk(body, owner):
        for node in body:
            if isinstance(node, ast.ClassDef):
                marks = [ast.unparse(d) for d in node.decorator_list]
                kind = "dataclass" if any(m.split("(")[0].split(".")[-1] == "dataclass" for m in marks) else "class"
                rows.append((kind, module, owner, node.name, None, ast.get_docstring(node), marks, node.lineno, None))
                walk(node.body, node.name)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                back = ast.unparse(node.returns) if node.returns else None
                rows.append(("method" if owner else "function", module, owner, node.name, back, ast.get_docstring(node), [ast.unparse(d) for d in node.decorator_list], node.lineno, None))
            elif owner and isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                rows.append(("field", module, owner, node.target.id, ast.unparse(node.annotation), None, [], node.lineno, None))

    walk(tree.body, None)
    return rows


def entities(files: DataFrame) -> DataFrame:
    """files (module, source) as one row an entity, with effect and phase by the name's leading verb."""

    def run(frames):
        for f in frames:
            rows = [r for m, s in zip(f["module"], f["source"], strict=True) for r in _entities(m, s)]
            yield pd.DataFrame(rows, columns=["kind", "module", "class_name", "name", "ref_type", "doc", "decorators", "line", "error"])

    found = files.select("module", "source").mapInPandas(run, ENTITY)
    callable_ = F.col("kind").isin("method", "function")
    return found.withColumn("effect", F.when(callable_, effect_class("name"))).withColumn("phase", F.when(callable_, phase("name")))


def public_methods(found: DataFrame) -> DataFrame:
    return found.where("kind = 'method' and not startswith(name, '_')")


def resolved_types(found: DataFrame) -> DataFrame:
    """(module, class_name, name, target): fields and methods whose type names a class of the same module."""
    classes = found.where("kind in ('class', 'dataclass')").select("module", F.col("name").alias("target"))
    users = found.where("kind in ('field', 'method') and ref_type is not null").select("module", "class_name", "name", F.explode(F.array_distinct(F.regexp_extract_all("ref_type", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("target"))
    return users.join(classes, ["module", "target"]).select("module", "class_name", "name", "target")


def paginated_peers(found: DataFrame) -> DataFrame:
    """(module, class_name, name, peer): methods with an `_iter` twin in the same class."""
    m = found.where("kind = 'method'").select("module", "class_name", "name")
    twins = m.where("endswith(name, '_iter')").select("module", "class_name", F.col("name").alias("peer"), F.regexp_replace("name", "_iter$", "").alias("name"))
    return m.join(twins, ["module", "class_name", "name"]).select("module", "class_name", "name", "peer")


# Fixed value: how a docstring says that its method is deprecated.
DEPRECATED = r"\.\.\s+deprecated\b|deprecated::|\b(?:DEPRECATED|Deprecated)\b"


def deprecation_successors(found: DataFrame) -> DataFrame:
    """(module, class_name, name, successor): deprecated methods whose docstring names another method of the class.

    The docstring must say that it is deprecated, in a sentence or by the directive; of the forms that name a successor the first that fits holds."""
    name = r"([A-Za-z_][\w.]*)"
    patterns = (rf"[Uu]se\s+``{name}``\s+instead", rf"[Rr]eplaced\s+by\s+``{name}``", rf"\.\.\s+deprecated::[^\n]*\n(?:[^\n]+\n)*?\s*[^\n]*?``{name}``", rf":meth:`~?{name}`")
    said = F.coalesce(*[F.nullif(F.regexp_extract("doc", p, 1), F.lit("")) for p in patterns])
    said = F.substring_index(said, ".", -1)
    old = found.where("kind = 'method'").where(F.col("doc").rlike(DEPRECATED)).select("module", "class_name", "name", said.alias("successor")).where("successor is not null")
    known = found.where("kind = 'method'").select("module", "class_name", F.col("name").alias("successor"))
    return old.join(known, ["module", "class_name", "successor"], "left_semi").select("module", "class_name", "name", "successor")


def commands(found: DataFrame) -> DataFrame:
    """Functions that a command-line decorator marks, and those of a known phase."""
    cli = F.exists("decorators", lambda d: d.rlike(r"(^|\.)command(\(|$)"))
    return found.where("kind in ('function', 'method')").withColumn("is_command", cli).where(F.col("is_command") | (F.col("phase") != "unknown"))
