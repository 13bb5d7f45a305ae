"""API descriptions to operations, schemas and references; one document for each operation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.functions.text import normal_effect, path_slug
from marlgrid.operators.relational import latest_per_key

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def _refs(node, seen: list[str]) -> list[str]:
    if isinstance(node, dict):
        ref = node.get("$ref")
        if isinstance(ref, str) and ref.rsplit("/", 1)[-1] not in seen:
            seen.append(ref.rsplit("/", 1)[-1])
        for v in node.values():
            _refs(v, seen)
    elif isinstance(node, list):
        for v in node:
            _refs(v, seen)
    return seen


def _rows(source: str, body: str | None):
    try:
        doc = json.loads(body or "")
    except ValueError as e:
        return [("error", source, None, None, None, None, [], str(e)[:200])]
    rows = []
    for path, item in (doc.get("paths") or {}).items():
        for method, op in (item or {}).items():
            if method.lower() in METHODS and isinstance(op, dict):
                rows.append(("operation", source, method.upper(), path, op.get("operationId"), op.get("x-effect-class"), _refs(op, []), None))
    parts = doc.get("components") or {}
    for name, schema in (parts.get("schemas") or {}).items():
        rows.append(("schema", source, None, None, name, None, _refs(schema, []), None))
    for name in parts.get("securitySchemes") or {}:
        rows.append(("security", source, None, None, name, None, [], None))
    return rows


def described(documents: DataFrame) -> DataFrame:
    """documents (source_url, body) as rows of kind operation, schema, security or error."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([r for s, b in zip(f["source_url"], f["body"], strict=True) for r in _rows(s, b)], columns=["kind", "source_url", "method", "path", "name", "effect", "refs", "error"])

    found = documents.select("source_url", "body").mapInPandas(run, "kind string, source_url string, method string, path string, name string, effect string, refs array<string>, error string")
    named = F.when((F.col("kind") == "operation") & F.col("name").isNull(), path_slug("path", "method")).otherwise(F.col("name"))
    return found.withColumn("name", named).withColumn("effect", normal_effect("effect"))


def best_documents(operations: DataFrame, current_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """One operation for each API version (`api_version`, where operations have it), method, path and name: versioned pages first, then current product names, then the larger url."""
    service = F.lower(F.regexp_extract("source_url", r"/(?:workspace|account)/([^/]+)", 1))
    current = F.lit(0)
    for p in current_prefixes:
        current = F.greatest(current, service.startswith(p).cast("int"))
    ranked = operations.withColumn("_versioned", service.rlike(r"(^|_)\d+(_\d+)?$").cast("int")).withColumn("_current", current)
    version = ["api_version"] if "api_version" in operations.columns else []
    return latest_per_key(ranked, [*version, "method", "path", "name"], [F.desc("_versioned"), F.desc("_current"), F.desc("source_url")]).drop("_versioned", "_current")
