"""Structural scorers of a graph and its surroundings.  Each gives one row: scorer, score, reason, n_violations, examples (the first 32, sorted)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlgrid.functions.text import POINTER
from marlgrid.operators.build import AUTHORITY

EXAMPLES = 32
DAY_MS = 86_400_000
#: Kinds of source that ground an entity; a hand-written one does not.
GROUNDING = tuple(k for k in AUTHORITY if k != "hand")


def scored(violations: DataFrame, scorer: str, reason: str, score: Column | None = None) -> DataFrame:
    """violations (kind, subject) as a scorer's row: 1 without any, else 0 or the given score, the reason, and the first ones as kind:subject."""
    told = violations.select(F.concat_ws(":", "kind", F.coalesce(F.col("subject").cast("string"), F.lit(""))).alias("v"))
    first = told.orderBy("v").limit(EXAMPLES).agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("examples"))
    row = told.agg(F.count("*").alias("n_violations")).join(F.broadcast(first))
    bad = F.col("n_violations") > 0
    return row.select(F.lit(scorer).alias("scorer"), F.when(bad, F.lit(0.0) if score is None else score).otherwise(1.0).alias("score"), F.when(bad, reason).otherwise("").alias("reason"), "n_violations", "examples")


def _kind(rows: DataFrame, kind: str, subject: str | Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def schema_integrity(columns: DataFrame, expected: DataFrame) -> DataFrame:
    """columns (table_name, column_name, ordinal) against expected (table_name, first_column): every table is there, no other one is, and each begins with its column."""
    first = columns.where("ordinal = 0").select("table_name", F.col("column_name").alias("observed"))
    seen = columns.select("table_name").distinct()
    missing = expected.join(seen, "table_name", "left_anti")
    extra = seen.join(expected, "table_name", "left_anti")
    wrong = expected.join(first, "table_name").where("first_column is not null and observed != first_column")
    return scored(_all(_kind(missing, "missing_table", "table_name"), _kind(extra, "extra_table", "table_name"), _kind(wrong, "first_column", "table_name")), "schema_integrity", "PERSIST_FAILED")


def smoke_floor(baseline: DataFrame, observed: DataFrame, gold: DataFrame) -> DataFrame:
    """observed (hit_rate: one row) against the smallest rate of the baseline (query_id, baseline_rate), which must hold every gold query (query_id)."""
    missing = _kind(gold.join(baseline.select("query_id"), "query_id", "left_anti"), "gold_query_missing", "query_id")
    floor = baseline.agg(F.min("baseline_rate").alias("floor"))
    rate = observed.agg(F.coalesce(F.max("hit_rate"), F.lit(0.0)).alias("rate"))
    both = floor.join(F.broadcast(rate))
    low = _kind(both.where("floor is null"), "empty_baseline", F.lit("")).unionByName(_kind(both.where("rate < floor"), "below_floor", F.col("rate")))
    row = scored(missing.unionByName(low), "smoke_floor", "SMOKE_REGRESSION", F.lit(None).cast("double"))
    # a rate below the floor is the score itself, unless something else is amiss
    told = row.join(F.broadcast(both.select("rate")))
    only = F.col("examples").startswith("below_floor") & (F.col("n_violations") == 1)
    return told.withColumn("score", F.when(F.col("n_violations") == 0, 1.0).when(only, F.col("rate")).otherwise(0.0)).drop("rate")


def dag_match(observed: DataFrame, gold: DataFrame) -> DataFrame:
    """Both (task, depends_on array): the same tasks, each with the same set of tasks before it."""
    o = observed.select("task", F.sort_array(F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>")))).alias("o"))
    g = gold.select(F.col("task").alias("g_task"), F.sort_array(F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>")))).alias("g"))
    both = o.join(g, F.col("task") == F.col("g_task"), "full")
    kind = F.when(F.col("task").isNull(), "missing_task").when(F.col("g_task").isNull(), "extra_task").when(F.col("o") != F.col("g"), "depends_on")
    return scored(both.select(kind.alias("kind"), F.coalesce("task", "g_task").alias("subject")).where("kind is not null"), "dag_match", "PROMOTION_FAILED")


def namespace_isolation(ledgers: DataFrame) -> DataFrame:
    """ledgers (namespace, owner, ledger): no ledger belongs to two namespaces, and no namespace to two owners."""
    shared = ledgers.groupBy("ledger").agg(F.countDistinct("namespace").alias("n")).where("n > 1")
    mixed = ledgers.groupBy("namespace").agg(F.countDistinct("owner").alias("n")).where("n > 1")
    return scored(_all(_kind(shared, "shared_ledger", "ledger"), _kind(mixed, "mixed_owner", "namespace")), "namespace_isolation", "NAMESPACE_NOT_ISOLATED")


def principal_isolation(principals: DataFrame, required: DataFrame) -> DataFrame:
    """principals (role, principal) and required (role): every role has its own, and none serves two roles."""
    missing = required.join(principals.where("principal is not null").select("role"), "role", "left_anti")
    shared = principals.where("principal is not null").groupBy("principal").agg(F.countDistinct("role").alias("n")).where("n > 1")
    return scored(_all(_kind(missing, "missing_principal", "role"), _kind(shared, "shared_principal", "principal")), "principal_isolation", "PRINCIPAL_NOT_PROVISIONED")


def grants_match(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Both (endpoint, principal, privilege): the grants that are there are those expected, no more and no fewer."""
    keys = ["endpoint", "principal", "privilege"]
    o, e = observed.select(*keys).distinct(), expected.select(*keys).distinct()
    name = F.concat_ws("/", *keys)
    return scored(_all(_kind(e.join(o, keys, "left_anti"), "missing_grant", name), _kind(o.join(e, keys, "left_anti"), "extra_grant", name)), "grants_match", "GRANTS_MIXED")


def authority_lock(weights: DataFrame, provenance: DataFrame, slack: float = 1e-4) -> DataFrame:
    """weights (source_kind, authority_weight) are the fixed ones (a post's may have decayed), all are there, and provenance (entity_id, source_kind) knows no other kind."""
    fixed = weights.sparkSession.createDataFrame(list(AUTHORITY.items()), "source_kind string, fixed double")
    known = weights.join(F.broadcast(fixed), "source_kind", "left")
    decays = F.col("source_kind") == "blog"
    fine = F.when(decays, F.col("authority_weight").between(-slack, AUTHORITY["blog"] + slack)).otherwise(F.abs(F.col("authority_weight") - F.col("fixed")) <= slack)
    wrong = known.where(F.col("fixed").isNotNull() & ~F.coalesce(fine, F.lit(False)))
    missing = fixed.join(weights.select("source_kind"), "source_kind", "left_anti")
    strange = provenance.where(F.coalesce("source_kind", F.lit("")) != "").join(F.broadcast(fixed), "source_kind", "left_anti")
    return scored(
        _all(_kind(known.where("fixed is null"), "unknown_kind", "source_kind"), _kind(wrong, "weight_drift", "source_kind"), _kind(missing, "missing_kind", "source_kind"), _kind(strange, "unknown_provenance", "entity_id")),
        "authority_lock",
        "PERSIST_FAILED",
    )


def exemplar_linkage(observed: DataFrame, gold: DataFrame, extensions: DataFrame | None = None) -> DataFrame:
    """Both (skill_id, pointer): every gold skill points where it should, to an extension that is there (extension_id, where given), and no other skill points anywhere."""
    o = observed.where("pointer is not null").select("skill_id", "pointer")
    both = gold.select("skill_id", F.col("pointer").alias("expected")).join(o, "skill_id", "full")
    formed = F.col("pointer").rlike(POINTER)
    if extensions is not None:
        both = both.join(extensions.select(F.col("extension_id").alias("pointer"), F.lit(True).alias("there")).distinct(), "pointer", "left")
    absent = F.col("there").isNull() if extensions is not None else F.lit(False)
    kind = (
        F.when(F.col("expected").isNull(), F.when(formed, "unexpected_skill").otherwise("malformed_extra"))
        .when(F.col("pointer").isNull(), "missing_pointer")
        .when(F.col("pointer") != F.col("expected"), "pointer_drift")
        .when(~formed, "malformed_pointer")
        .when(absent, "not_in_graph")
    )
    return scored(both.select(kind.alias("kind"), F.col("skill_id").alias("subject")).where("kind is not null"), "exemplar_linkage", "SKILL_MISSING_EXEMPLAR")


def grounding(observed: DataFrame, provenance: DataFrame, pending: DataFrame) -> DataFrame:
    """(skill_id, pointer, source_kinds, status) of skills' pointers: grounded by any source but hand-written ones, explicitly pending (extension_id), or neither."""
    kinds = provenance.groupBy(F.col("entity_id").alias("pointer")).agg(F.array_join(F.sort_array(F.collect_set("source_kind")), ",").alias("source_kinds"), F.max(F.col("source_kind").isin(*GROUNDING)).alias("sourced"))
    waits = pending.select(F.col("extension_id").alias("pointer"), F.lit(True).alias("waits")).distinct()
    met = observed.where("pointer is not null").join(kinds, "pointer", "left").join(waits, "pointer", "left")
    status = F.when(F.col("sourced"), "source_grounded").when(F.col("waits"), "pending_stub").when(F.col("source_kinds").isNotNull(), "hand_authored_only").otherwise("missing_provenance")
    return met.select("skill_id", "pointer", F.coalesce("source_kinds", F.lit("")).alias("source_kinds"), status.alias("status"))


def anchor_grounding(observed: DataFrame, provenance: DataFrame, pending: DataFrame) -> DataFrame:
    told = grounding(observed, provenance, pending).where("status in ('hand_authored_only', 'missing_provenance')")
    return scored(told.select(F.col("status").alias("kind"), F.col("skill_id").alias("subject")), "anchor_grounding", "ANCHOR_NOT_GROUNDED")


def refresh_slo(active: DataFrame, now_ms: int, tolerance_days: int = 2) -> DataFrame:
    """active (promoted_at_ms: one row, or none before the first run): promoted within the tolerance, which must be positive."""
    newest = active.agg(F.max("promoted_at_ms").alias("at"))
    kind = F.when(F.lit(tolerance_days <= 0), "invalid_tolerance").when(F.col("at").isNull(), "no_active_snapshot").when(F.lit(now_ms) - F.col("at") > tolerance_days * DAY_MS, "snapshot_stale")
    return scored(newest.select(kind.alias("kind"), F.coalesce(F.floor((F.lit(now_ms) - F.col("at")) / DAY_MS).cast("string"), F.lit("")).alias("subject")).where("kind is not null"), "refresh_slo", "SNAPSHOT_STALE")


def vocabulary_coverage(observed: DataFrame, expected: DataFrame, closed: Sequence[str] = ("tab",)) -> DataFrame:
    """Both (part, name): everything expected is there; parts that are closed hold nothing else."""
    keys = ["part", "name"]
    o, e = observed.select(*keys).distinct(), expected.select(*keys).distinct()
    name = F.concat_ws("/", *keys)
    extra = o.where(F.col("part").isin(*closed)).join(e, keys, "left_anti")
    return scored(_all(_kind(e.join(o, keys, "left_anti"), "missing", name), _kind(extra, "extra", name)), "vocabulary_coverage", "SECTION_ALIAS_MISSING")


def manifest_audit(skills: DataFrame) -> DataFrame:
    """skills (skill_id, pointer, links array<string>, null where undeclared): links are declared, and hold the pointer."""
    kind = F.when(F.coalesce(F.size("links"), F.lit(-1)) <= 0, "links_missing").when((F.coalesce("pointer", F.lit("")) != "") & ~F.array_contains("links", F.coalesce("pointer", F.lit(""))), "primary_mismatch")
    return scored(skills.select(kind.alias("kind"), F.col("skill_id").alias("subject")).where("kind is not null"), "manifest_audit", "CAPABILITY_LINKS")


def scorer_category(results: DataFrame, datasets: DataFrame) -> DataFrame:
    """(workflow, status, numerator, denominator) by workflow: results (workflow, run_status, gate_status) of its last run, datasets (workflow, n_records).

    A passed run with observed gates and no failed one is a warning; without a run records are not_scored, and no records a warning."""
    by = results.groupBy("workflow").agg(F.max("run_status").alias("run_status"), F.count("gate_status").alias("gates"), F.count_if(F.col("gate_status") == "passed").alias("passed"), F.count_if(F.col("gate_status") == "failed").alias("failed"), F.count_if(F.col("gate_status") == "observed").alias("observed"))
    met = datasets.groupBy("workflow").agg(F.sum("n_records").alias("records")).join(by, "workflow", "full").withColumn("records", F.coalesce("records", F.lit(0)))
    unrun = F.col("run_status").isNull()
    status = F.when(unrun, F.when(F.col("records") > 0, "not_scored").otherwise("warning")).when((F.col("run_status") == "passed") & (F.col("observed") > 0) & (F.col("failed") == 0), "warning").otherwise(F.col("run_status"))
    numerator = F.when(unrun, 0).when(F.col("gates") > 0, F.col("passed")).when(F.col("run_status") == "passed", F.col("records")).otherwise(0)
    return met.select("workflow", status.alias("status"), numerator.cast("long").alias("numerator"), F.when(unrun | (F.col("gates") == 0), F.col("records")).otherwise(F.col("gates")).cast("long").alias("denominator"))
