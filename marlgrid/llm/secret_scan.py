"""Secret scans (operator 7): an incremental blob ledger, in DataFrame functions only.

Every text is addressed by its SHA-256.  The ledger holds one row for each blob and rule version that was scanned; only
unseen pairs are scanned, one text for each, and the findings are joined back to every row that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlgrid.llm.common import table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """kind; the pattern of a leftmost match; which group must have how many characters; what a text must hold to be worth it."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


RULE_VERSION = "base-1"
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"([0-9a-f]+)", 1, 32, r"[0-9a-f]{32}"),
)
#: Characters of a piece of a text that is redacted.
PIECE = 4096
LEDGER = "blob binary, rule_version string, spans array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path (the id) and blob (SHA-256 of the UTF-8 text; a null text counts as empty)."""
    return docs.select(F.col(id_col).alias("path"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("blob"), text_or_empty(text_col).alias("content"))


def _matches(rule: Rule, number: int) -> Column:
    """An array with, for each match of the rule in order: the characters before it since the last one, its own, whether it counts."""
    text, pattern = F.col("content"), F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    whole, part = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    rows = F.zip_with(F.zip_with(gaps, whole, lambda g, w: F.struct(F.length(g).alias("g"), F.length(w).alias("w"))), part, lambda a, p: F.struct(a["g"].cast("bigint").alias("gap"), a["w"].cast("bigint").alias("size"), (F.length(p) >= rule.least).alias("counts")))
    found = F.transform(F.filter(rows, lambda r: r["size"].isNotNull()), lambda r, i: F.struct(F.lit(number).alias("kind_no"), i.alias("at"), r["gap"].alias("gap"), r["size"].alias("size"), r["counts"].alias("counts")))
    return F.when(text.rlike(rule.hint), found)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of (blob, content), each blob once: spans in code points, end exclusive, by start and then kind; blobs without any have an empty array.

    A match's start is the running sum of the gaps and matches before it, so long texts with many matches stay linear.
    """
    empty = F.array().cast("array<struct<kind_no:int,at:int,gap:bigint,size:bigint,counts:boolean>>")
    found = blobs.select("blob", F.concat(*[F.coalesce(_matches(r, i), empty) for i, r in enumerate(rules)]).alias("found"))
    rows = found.select("blob", F.explode_outer("found").alias("m")).select("blob", "m.*")
    order = Window.partitionBy("blob", "kind_no").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    span = F.when(F.col("counts"), F.struct((F.col("end") - F.col("size")).alias("start"), F.col("kind_no").alias("kind_no"), F.col("end").alias("end"), kinds[F.col("kind_no")].alias("kind")))
    return ended.groupBy("blob").agg(F.lit(version).alias("rule_version"), F.sort_array(F.collect_list(span)).alias("spans"))


def unseen(docs: DataFrame, ledger: DataFrame | None, version: str = RULE_VERSION) -> DataFrame:
    """(blob, content), exactly one row for each blob of docs that the ledger lacks at this rule version.

    Copies are brought down to one content in each task before the shuffle, whatever their ids, so they don't meet in one task.
    """
    every = addressed(docs).groupBy("blob").agg(F.first("content").alias("content"))
    if ledger is not None:
        every = every.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    return every


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """The rows that docs add to the ledger (append them to its table): one for each unseen blob, however often its text stands in docs."""
    return scan(unseen(docs, ledger, version), rules, version)


def joined_back(docs: DataFrame, entries: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """docs' rows with blob and spans (empty where nothing was found), from ledger rows; every path of a blob gets its spans."""
    hits = entries.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select(F.col("blob").alias("hit_blob"), "spans")
    keyed = docs.withColumn("blob", F.unhex(F.sha2(text_or_empty(), 256)))
    return keyed.join(hits, F.col("blob") == F.col("hit_blob"), "left").drop("hit_blob").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")))


def secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """path, blob and spans for every row of docs, scanning only what the ledger lacks.

    Null and empty texts share the empty blob, which has no spans; repeated rows come back as often as they stand; a null
    id stays; an empty table gives an empty one; extra columns are ignored, whatever their names.
    """
    bare = docs.select("doc_id", "text")
    entries = table(scan_new(bare, ledger, rules, version), "ledger")
    if ledger is not None:
        entries = entries.unionByName(ledger)
    return joined_back(bare.select("doc_id", text_or_empty().alias("text")), entries, version).select(F.col("doc_id").alias("path"), "blob", "spans")


def redacted(docs: DataFrame, entries: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """docs with every span's characters replaced by `[kind]` (overlapping spans by the first one's), n_chars brought up to date.

    The text between spans stays as it was.  Spans of a kind don't overlap each other; a span that starts inside an earlier
    one is joined to it.  A text is cut into pieces of PIECE characters once, and what stands between two spans is taken from its own pieces, so
    the work is in proportion to the text, however many spans it has.
    """
    order = Window.partitionBy("blob").orderBy("start", "kind_no")
    each = entries.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", F.explode("spans").alias("s")).select("blob", "s.*")
    # where the text before a span begins; a span that starts before that is part of an earlier one
    after = each.withColumn("begin", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))
    cut = F.when(F.col("start") >= F.col("begin"), F.struct("start", "begin", "kind"))
    cuts = after.groupBy(F.col("blob").alias("cut_blob")).agg(F.sort_array(F.collect_list(cut)).alias("cuts"), F.max("end").alias("tail"))
    keyed = docs.withColumn("blob", F.unhex(F.sha2(text_or_empty(), 256)))
    found = keyed.join(cuts, F.col("blob") == F.col("cut_blob"), "left")

    def clean(pieces: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE)
            own = F.slice(pieces, (first + 1).cast("int"), (F.floor((b - 1) / PIECE) - first + 1).cast("int"))
            return F.when(b > a, F.array_join(own, "").substr((a - first * PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")

        said = F.transform("cuts", lambda c: F.concat(between(c["begin"], c["start"]), F.lit("["), c["kind"], F.lit("]")))
        return F.concat(F.array_join(said, ""), between(F.col("tail"), F.length("text").cast("bigint")))

    # bound once for all of a text's spans, as the variable of a lambda
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    text = F.when(F.col("cuts").isNotNull(), F.transform(F.array(pieces), clean)[0]).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def secret_digests(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans of secrets()."""
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [of(r.kind) for r in rules]
    return found.select(F.col("path").cast("bigint").alias("doc_id"), *counts, F.sha2(said, 256).alias("base_sha256"), said.alias("spans"))
