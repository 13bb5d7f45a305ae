"""Evaluation: ratios, gates and reason codes, windows of live quality, category states, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(condition: Column) -> Column:
    """The share of rows where a condition holds, four digits, halves to even; 0 without rows."""
    return F.coalesce(F.bround(F.avg(F.coalesce(condition.cast("double"), F.lit(0.0))), 4), F.lit(0.0))


def reason_codes(*checks: tuple[Column, str]) -> Column:
    """The codes of the failed checks, comma-separated, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for ok, code in checks])), ",")


def status(codes: Column, ran: Column | None = None, scored: Column | None = None) -> Column:
    out = F.when(F.coalesce(~ran, F.lit(True)), "not_run") if ran is not None else F
    out = out.when(codes != "", "failed")
    if scored is not None:
        out = out.when(~scored, "observed")
    return out.otherwise("passed")


def live_window(events: DataFrame, now_ms: int, hours: int, keys: list[str], ok: Column, metric: Column) -> DataFrame:
    """By key, over the last hours: n, n_ok, ok_rate and the metric's mean; `events` has ts_ms."""
    recent = events.where((F.col("ts_ms") >= now_ms - hours * 3_600_000) & (F.col("ts_ms") <= now_ms))
    return recent.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.round(F.count_if(ok) / F.count("*"), 6).alias("ok_rate"), F.round(F.avg(metric), 4).alias("mean_metric"))


def category_state(failed: Column, n: Column, coverage: Column, low: int = 10, least: float = 0.8) -> Column:
    """fail, then low_volume, then low_coverage, else pass."""
    return F.when(failed > 0, "fail").when(n < low, "low_volume").when(coverage < least, "low_coverage").otherwise("pass")


def matched_context(haystack: Column, needles: Column) -> Column:
    """Whether any expected string occurs in the serialised event; true where nothing is expected."""
    return F.when(F.coalesce(F.size(needles), F.lit(0)) == 0, True).otherwise(F.exists(needles, lambda x: F.coalesce(F.contains(haystack, x), F.lit(False))))


def joined_latest(records: DataFrame, events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """records with their newest event's columns, null where none."""
    w = Window.partitionBy(key).orderBy(*order)
    return records.join(events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"), key, "left")


def linkage(entities: DataFrame, provenance: DataFrame, key: str, most: int = 32) -> DataFrame:
    """(violations, n_entities, share, examples): entities without provenance, at most `most` named."""
    bad = entities.select(key).join(provenance.select(key).distinct(), key, "left_anti")
    named = bad.orderBy(key).limit(most).agg(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ",").alias("examples"))
    return bad.agg(F.count("*").alias("violations")).join(F.broadcast(entities.agg(F.count("*").alias("n_entities")))).join(F.broadcast(named)).withColumn("share", F.when(F.col("n_entities") > 0, F.bround(1 - F.col("violations") / F.col("n_entities"), 4)).otherwise(0.0))


def schema_drift(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Differences of (name, type) rows: missing or changed; extra observed names are tolerated."""
    d, o = declared.select("name", F.upper("type").alias("declared")), observed.select("name", F.upper("type").alias("observed"))
    return d.join(o, "name", "left").where("observed is null or observed != declared").select("name", "declared", "observed", F.when(F.col("observed").isNull(), "missing").otherwise("changed").alias("problem"))


def runtime_metrics(records: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, scored, hit_rate, top1_rate, completion_rate) of records (keys, subject_id, expected array<string>, null where nothing is expected)
    against each subject's newest event (subject_id, created_at_ms, event, evidence array<string>, completed).

    A record hits where any expected string occurs in the serialised event, and at rank 1 where it occurs in the first piece of evidence.
    An empty expectation is met by every event, a missing one by none; rates are over the records that have an event."""
    own = events.select("subject_id", "created_at_ms", "event", "evidence", "completed")
    met = joined_latest(records, own, "subject_id", [F.desc("created_at_ms"), F.desc("event")])
    scored = F.col("event").isNotNull()
    within = lambda said: F.col("expected").isNotNull() & matched_context(said, F.col("expected"))
    first = F.array_join(F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, 1), "\n")
    told = met.select(*keys, scored.alias("scored"), (scored & within(F.col("event"))).alias("hit"), (scored & within(first)).alias("top"), (scored & F.coalesce("completed", F.lit(False))).alias("done"))
    n = F.count_if("scored")
    rate = lambda c: F.coalesce(F.bround(F.count_if(c) / F.nullif(n, F.lit(0)), 4), F.lit(0.0))
    return told.groupBy(*keys).agg(F.count("*").alias("n"), n.alias("scored"), rate("hit").alias("hit_rate"), rate("top").alias("top1_rate"), rate("done").alias("completion_rate"))


def sampled_traces(events: DataFrame, now_ms: int, hours: int, most: int, require_trace: bool = False) -> DataFrame:
    """The newest events (event_id, subject_id, user_id, status, trace_id, inputs, outputs, evidence array, created_at_ms) of the last hours as evaluation records."""
    recent = events.where((F.col("created_at_ms") >= now_ms - max(1, hours) * 3_600_000) & (F.col("created_at_ms") <= now_ms))
    recent = recent.where(F.coalesce("trace_id", F.lit("")) != "") if require_trace else recent
    first = recent.orderBy(F.desc("created_at_ms"), F.desc("event_id")).limit(max(1, min(most, 5000)))
    source = F.struct(F.coalesce("trace_id", F.lit("")).alias("trace_id"), F.col("event_id").cast("string").alias("event_id"), F.coalesce(F.col("subject_id").cast("string"), F.lit("")).alias("subject_id"), "created_at_ms")
    tags = F.create_map(F.lit("dataset_source"), F.lit("live_trace_sample"), F.lit("runtime_status"), F.coalesce("status", F.lit("")), F.lit("user_id"), F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.lit("evidence_count"), F.coalesce(F.size("evidence"), F.lit(0)).cast("string"))
    return first.select(F.concat(F.lit("live-"), "event_id").alias("record_id"), "inputs", "outputs", source.alias("source"), tags.alias("tags"))


# Expectations that mean something to the scorers, and kinds of source that a record may name.
RESERVED = ("expected_facts", "expected_response", "guidelines", "expected_retrieved_context")
SOURCES = ("human", "document", "trace", "synthetic")


def validated_records(records: DataFrame, reserved: tuple[str, ...] = RESERVED, sources: tuple[str, ...] = SOURCES) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with `codes`) of records (inputs, expectations, source: map<string,string>): inputs that aren't empty, no reserved
    expectation without a value, and at most one source, of a known kind."""
    empty = F.map_filter(F.coalesce("expectations", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: k.isin(*reserved) & (F.coalesce(v, F.lit("")) == ""))
    kinds = F.map_keys("source")
    codes = reason_codes(
        (F.coalesce(F.size("inputs"), F.lit(0)) > 0, "EMPTY_INPUTS"),
        (F.size(empty) == 0, "EMPTY_EXPECTATION"),
        (F.col("source").isNull() | ((F.size(kinds) == 1) & F.forall(kinds, lambda k: k.isin(*sources))), "BAD_SOURCE"),
    )
    told = records.withColumn("codes", codes)
    return told.where("codes = ''").drop("codes"), told.where("codes != ''")


# What every claim must have.
CLAIM_KEYS = ("claim_id", "subject", "predicate", "value_json", "emitted_by", "signature_hex")


def claim_checks(claims: DataFrame, least: int) -> DataFrame:
    """(check, score, code, n): the number of claims against a floor, and the share of those that have all of CLAIM_KEYS."""
    whole = [F.coalesce(F.col(k).cast("string"), F.lit("")) != "" for k in CLAIM_KEYS]
    bad = F.count_if(~F.array_min(F.array(*[w.cast("int") for w in whole])).cast("boolean"))
    t = claims.agg(F.count("*").alias("n"), bad.alias("bad"))
    enough = F.struct(F.lit("count").alias("check"), (F.col("n") >= least).cast("double").alias("score"), F.when(F.col("n") >= least, "").otherwise("CLAIM_COUNT_BELOW_MIN").alias("code"), F.col("n").alias("n"))
    shape = F.struct(F.lit("shape").alias("check"), F.when(F.col("bad") == 0, 1.0).otherwise(F.bround(F.greatest(F.lit(0.0), 1 - F.col("bad") / F.greatest(F.col("n"), F.lit(1))), 4)).alias("score"), F.when(F.col("bad") == 0, "").otherwise("CLAIM_SHAPE_INVALID").alias("code"), F.col("bad").alias("n"))
    return t.select(F.explode(F.array(enough, shape)).alias("x")).select("x.*")


def silent_failures(runs: DataFrame, questions: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, score, code): a failed run (key, failed) that left no question is silent."""
    asked = questions.select(key, F.lit(True).alias("asked")).distinct()
    silent = F.col("failed") & F.col("asked").isNull()
    return runs.join(asked, key, "left").select(key, F.when(silent, 0.0).otherwise(1.0).alias("score"), F.when(silent, "SILENT_FAILURE_DETECTED").otherwise("").alias("code"))


def index_drift(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """(name, problem, detail) of indexes (name, endpoint, dimension, primary_key, columns map<string,string>): missing ones, and those whose
    endpoint, dimension, key or declared columns differ; other observed columns are tolerated."""
    o = observed.select("name", *[F.col(c).alias(f"o_{c}") for c in ("endpoint", "dimension", "primary_key", "columns")])
    met = declared.join(o, "name", "left")
    said = lambda label, a, b: F.when(~a.eqNullSafe(b), F.concat(F.lit(f"{label}="), F.coalesce(a.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(b.cast("string"), F.lit("-"))))
    fixed = F.array_compact(F.array(*[said(c, F.col(c), F.col(f"o_{c}")) for c in ("endpoint", "dimension", "primary_key")]))
    wrong = F.filter(F.sort_array(F.map_entries("columns")), lambda e: ~e["value"].eqNullSafe(F.element_at("o_columns", e["key"])))
    columns = F.transform(wrong, lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(":"), F.coalesce(F.element_at("o_columns", e["key"]), F.lit("-"))))
    told = met.withColumn("detail", F.array_join(F.concat(fixed, columns), ";"))
    problem = F.when(F.col("o_columns").isNull(), "missing").when(F.col("detail") != "", "mismatch")
    return told.select("name", problem.alias("problem"), F.when(problem == "missing", "").otherwise(F.col("detail")).alias("detail")).where("problem is not null")
