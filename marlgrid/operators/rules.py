"""Rules over profiles and plans: problem choice, feature readiness, candidate ranking, gates, plans; all as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlgrid.operators.evaluate import reason_codes
from marlgrid.operators.staging import numbered

# Names that hint at targets, keys and time; problem families.
LABEL_HINTS = "label|target|churn|fraud|outcome|is_|has_|flag|score"
KEY_HINTS = "(^|_)(id|key|uuid)$|key$"
TIME_HINTS = "(^|_)(ts|time|date|at)$|date$"
FAMILIES = {"classification": "tree_ensemble", "regression": "tree_ensemble", "forecasting": "time_series", "clustering": "centroid"}


def label_hint(name: Column) -> Column:
    return F.lower(name).rlike(LABEL_HINTS)


def problem(profiles: DataFrame) -> DataFrame:
    """(table_name, problem, target, status, findings): by the first column that looks like a label, its type and distinct count."""
    numeric = F.col("data_type").isin("int", "bigint", "double", "float")
    ranked = F.when(label_hint(F.col("column_name")) & ~F.lower("column_name").rlike(KEY_HINTS), F.struct("ordinal", "column_name", "distinct_count", numeric.alias("numeric")))
    by = profiles.groupBy("table_name").agg(F.min(ranked).alias("t"), F.max(F.lower("column_name").rlike(TIME_HINTS).cast("int")).alias("timed"), F.max("row_count").alias("n"))
    kind = F.when(F.col("t").isNull(), "clustering").when(F.col("t.distinct_count") <= 20, "classification").when(F.col("t.numeric") & (F.col("timed") == 1), "forecasting").when(F.col("t.numeric"), "regression").otherwise("classification")
    codes = reason_codes((F.col("t").isNotNull(), "NO_TARGET"), (F.col("n") >= 100, "FEW_ROWS"))
    return by.select("table_name", kind.alias("problem"), F.coalesce(F.col("t.column_name"), F.lit("")).alias("target"), F.when(codes == "", "ready").otherwise("needs_input").alias("status"), codes.alias("findings"))


def family(kind: Column) -> Column:
    out = F
    for k, v in FAMILIES.items():
        out = out.when(kind == k, v)
    return out.otherwise("unknown")


def feature_readiness(columns: DataFrame) -> DataFrame:
    """columns (table_name, column_name, ordinal): the key, the label, the number of features, and what is missing or leaks."""
    name = F.lower("column_name")
    key = F.min(F.when(name.rlike(KEY_HINTS), F.struct("ordinal", "column_name")))["column_name"]
    label = F.min(F.when(label_hint(F.col("column_name")) & ~name.rlike(KEY_HINTS), F.struct("ordinal", "column_name")))["column_name"]
    r = columns.groupBy("table_name").agg(key.alias("key"), label.alias("label"), F.count("*").alias("n"), F.max(name.rlike(TIME_HINTS).cast("int")).alias("timed"), F.count_if(name.rlike("future|after|outcome")).alias("leaks"))
    used = F.col("key").isNotNull().cast("int") + F.col("label").isNotNull().cast("int")
    return r.select("table_name", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("label", F.lit("")).alias("label"), (F.col("n") - used).alias("n_features"), reason_codes((F.col("key").isNotNull(), "NO_KEY"), (F.col("label").isNotNull(), "NO_LABEL"), (F.col("timed") == 1, "NO_TIME"), (F.col("leaks") == 0, "LEAKAGE")).alias("findings"))


def candidate_confidence(base: Column, ready: Column, has_key: Column, has_time: Column) -> Column:
    raw = base - 0.12 + F.when(ready, 0.06).otherwise(0.0) + F.when(has_key, 0.04).otherwise(0.0) + F.when(has_time, 0.02).otherwise(0.0)
    return F.round(F.least(F.greatest(raw, F.lit(0.1)), F.lit(0.86)), 2)


def ranked_candidates(rows: DataFrame, levels: Sequence[str] = ("ready", "needs_input", "blocked")) -> DataFrame:
    """rows (readiness, confidence, title) with rank from 1: by readiness, confidence, title; range partitions are ranked on their own."""
    order = F
    for i, level in enumerate(levels):
        order = order.when(F.col("readiness") == level, i)
    placed = numbered(rows.withColumn("_level", order.otherwise(len(levels))), [F.asc("_level"), F.desc("confidence"), F.asc("title")])
    return placed.withColumnRenamed("position", "rank").withColumn("rank", F.col("rank").cast("long")).drop("_level")


def proposals(starters: DataFrame) -> DataFrame:
    """starters (starter_id, proposals array<struct<title, readiness, confidence, evidence_tables>>) as one row a proposal, those without any left out."""
    return starters.select("starter_id", F.explode("proposals").alias("p")).select("starter_id", "p.*")


def evidence_tables(proposals_: DataFrame, tables: DataFrame) -> DataFrame:
    """(proposal_id, place, table_name, table_ref, row_count): a proposal's tables among those that it names, larger ones first.

    proposals: proposal_id, names array<string>; tables: table_ref, table_name (its last part where null), row_count."""
    named = tables.withColumn("table_name", F.coalesce("table_name", F.substring_index("table_ref", ".", -1)))
    wanted = proposals_.select("proposal_id", F.explode(F.array_distinct("names")).alias("table_name"))
    met = wanted.join(named, "table_name").withColumn("row_count", F.coalesce("row_count", F.lit(0)).cast("long"))
    w = Window.partitionBy("proposal_id").orderBy(F.desc("row_count"), "table_name", "table_ref")
    return met.select("proposal_id", F.row_number().over(w).cast("long").alias("place"), "table_name", "table_ref", "row_count")


# What a training run of each kind must be given.
_COMMON = ("feature_table_or_training_set", "evaluation_metric", "split_policy")
BINDINGS = {
    "classification": (*_COMMON, "target_column", "primary_key"),
    "regression": (*_COMMON, "target_column", "primary_key"),
    "forecasting": (*_COMMON, "target_column", "time_column", "entity_key", "forecast_horizon"),
    "ranking": (*_COMMON, "response_label", "entity_key", "candidate_item_key"),
    "segmentation": ("feature_table_or_training_set", "cluster_count_or_selection_policy", "primary_key"),
    "anomaly_detection": ("feature_table_or_training_set", "entity_key", "threshold_policy"),
    "text_or_genai": ("evaluation_set", "retrieval_corpus_or_endpoint", "quality_metrics"),
}


def strategy(rows: DataFrame) -> DataFrame:
    """rows (id, problem, problem_status, feature_status, model_name) with what a strategy needs: (id, status, bindings, findings).

    Blocking findings: the problem or the features aren't ready, the model's name isn't of three parts, nothing can be trained.
    A missing name only adds a binding, except where no model is trained."""
    kind, name = F.coalesce("problem", F.lit("")), F.coalesce("model_name", F.lit(""))
    bindings = F.lit(None).cast("array<string>")
    for k, needs in BINDINGS.items():
        bindings = F.when(kind == k, F.array(*[F.lit(n) for n in needs])).otherwise(bindings)
    bindings = F.coalesce(bindings, F.array().cast("array<string>"))
    unnamed = (name == "") & ~kind.isin("no_ml_yet", "text_or_genai")
    parts = F.size(F.filter(F.split(name, r"\."), lambda p: F.trim(p) != ""))
    blocking = reason_codes(
        (F.col("problem_status") == "ready_for_strategy", "PROBLEM_SELECTION_NOT_READY"),
        (F.col("feature_status") == "feature_ready", "FEATURES_NOT_READY"),
        ((name == "") | (parts == 3), "MODEL_NAME_OF_THREE_PARTS_REQUIRED"),
        (~kind.isin("no_ml_yet", ""), "NO_TRAINABLE_STRATEGY"),
    )
    warning = F.when(unnamed, "MODEL_NAME_NOT_BOUND").otherwise("")
    every = F.array_join(F.filter(F.array(blocking, warning), lambda c: c != ""), ",")
    needs = F.when(unnamed, F.array_union(bindings, F.array(F.lit("model_full_name")))).otherwise(bindings)
    return rows.select("id", F.when(blocking == "", "ready_for_approval").otherwise("blocked").alias("status"), F.array_join(needs, ",").alias("bindings"), every.alias("findings"))


def family_statuses(required: DataFrame, skills: DataFrame) -> DataFrame:
    """(case_id, family, status): each required family's status, `missing` where no skill is known; required: case_id, family; skills: family, status."""
    known = skills.groupBy("family").agg(F.min(F.when(F.col("status") == "available", 0).when(F.col("status") == "covered", 1).otherwise(2)).alias("s"))
    status = F.when(F.col("s") == 0, "available").when(F.col("s") == 1, "covered").when(F.col("s") == 2, "needs_work").otherwise("missing")
    return required.where(F.trim("family") != "").distinct().join(known, "family", "left").select("case_id", "family", status.alias("status"))


def resolution(statuses: DataFrame) -> DataFrame:
    """(case_id, n_skills, n_missing, status) of family_statuses()."""
    lacking = F.count_if(~F.col("status").isin("available", "covered"))
    return statuses.groupBy("case_id").agg(F.count("*").alias("n_skills"), lacking.alias("n_missing")).withColumn("status", F.when(F.col("n_missing") > 0, "resolved_with_gaps").otherwise("ready"))


def readiness_summary(contracts: DataFrame) -> DataFrame:
    """(category, n_skills, n_ready, n_needs_work) of contracts (category, status)."""
    ready = F.count_if(F.col("status") == "ready")
    return contracts.groupBy("category").agg(F.count("*").alias("n_skills"), ready.alias("n_ready"), (F.count("*") - ready).alias("n_needs_work"))


def missing_inputs(required: Sequence[str], given: Mapping[str, Column]) -> Column:
    """The required inputs that are null or blank, in order."""
    return reason_codes(*[(F.trim(given[r].cast("string")) != "" if r in given else F.lit(False), r) for r in required])


def go_no_go(blockers: Column) -> Column:
    return F.when(blockers == "", "go").otherwise("no_go")


def alias_gate(passed: Column, production: Column, approved: Column) -> Column:
    return F.when(~passed, "rejected").when(production & ~F.coalesce(approved, F.lit(False)), "needs_approval").otherwise("assigned")


def first_supported(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, ordinal, option, reason): the first option without a reason against it, and the rejected ones with theirs."""
    return rows.groupBy(key).agg(F.min(F.when(F.col("reason").isNull(), F.struct("ordinal", "option")))["option"].alias("chosen"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("ordinal", "option", "reason")))), lambda r: F.concat(r["option"], F.lit(":"), r["reason"])), ",").alias("rejected"))


def rejected_blocks(rows: DataFrame, key: str, size: int = 1024) -> DataFrame:
    """(key, block, n_rejected, rejected) of rows as above: the rejected options with their reasons, in blocks of `size` ordinals, so that no row holds
    all of a key's."""
    told = F.struct("ordinal", F.concat_ws(":", F.col("ordinal").cast("string"), "option", "reason").alias("said"))
    own = rows.where("reason is not null").groupBy(key, F.floor(F.col("ordinal") / size).cast("long").alias("block"))
    return own.agg(F.count("*").alias("n_rejected"), F.array_join(F.transform(F.sort_array(F.collect_list(told)), lambda x: x["said"]), ",").alias("rejected"))


def validated_steps(plans: DataFrame, allowed: DataFrame, deploy: Sequence[str] = ("endpoint_name", "model_full_name", "alias")) -> DataFrame:
    """(plan_id, step_id, code) of plans (plan_id, strategy, steps array<struct<step_id, skill_id, artifact, inputs map<string,string>>>) against
    the artifacts allowed (strategy, artifact): what blocks each step, and each plan; nothing for a plan that is valid.

    A plan without steps, and one of a strategy that allows nothing, has a finding of its own (step_id null)."""
    kinds = allowed.groupBy("strategy").agg(F.collect_set("artifact").alias("allowed"))
    met = plans.join(kinds, "strategy", "left")
    none = F.coalesce(F.size("steps"), F.lit(0)) <= 0
    own = met.select("plan_id", F.lit(None).cast("string").alias("step_id"), F.when(none, "ARTIFACT_STEPS_MISSING").when(F.col("allowed").isNull(), "STRATEGY_REQUIRES_SKILL_BUILDER").alias("code")).where("code is not null")
    each = met.select("plan_id", "allowed", F.explode("steps").alias("s")).select("plan_id", "allowed", "s.*")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    inputs = F.coalesce(F.size("inputs"), F.lit(0)) > 0
    lacking = [F.when((F.col("artifact") == "model_serving_endpoint") & (~inputs | blank(F.element_at("inputs", F.lit(d)))), f"DEPLOY_INPUT_MISSING:{d}") for d in deploy]
    codes = F.array_compact(
        F.array(
            F.when(blank(F.col("skill_id")), "STEP_SKILL_ID_MISSING"),
            F.when(~F.coalesce(F.array_contains("allowed", F.coalesce("artifact", F.lit(""))), F.lit(False)), "ARTIFACT_KIND_NOT_ALLOWED"),
            F.when(~inputs, "STEP_INPUTS_MISSING"),
            *lacking,
        )
    )
    return own.unionByName(each.select("plan_id", "step_id", F.explode(codes).alias("code")))


def feature_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)
