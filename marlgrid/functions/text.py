"""Column functions on text: tokens, similarity, hashes, identifiers, fixed chunks.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """The text's words between any Unicode white space; none for null or blank texts."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text)).cast("long")


def token_estimate(n_words: Column | str) -> Column:
    """Tokens from words: words / 0.75, halves to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(col(n_words) / 0.75, 0).cast("long")).cast("long")


def token_estimate_chars(text: Column | str) -> Column:
    """Tokens from characters: a quarter, rounded up; 0 for empty and null texts."""
    n = F.length(F.coalesce(col(text), F.lit("")))
    return F.ceil(n / 4).cast("long")


def token_set(text: Column | str) -> Column:
    """The distinct lower-case runs of a-z, 0-9 and _, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def content_hash(*parts: Column | str) -> Column:
    """16 hex digits of the SHA-256 of the parts, each closed by a zero byte; a null part is a lone zero byte."""
    return F.substring(F.sha2(F.concat(*[F.concat(F.coalesce(col(p), F.lit("")), F.lit("\u0000")) for p in parts]), 256), 1, 16)


def joined_hash(*parts: Column | str, digits: int = 16) -> Column:
    """Leading hex digits of the SHA-256 of the parts joined by line breaks; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(col(p), F.lit("")) for p in parts]), 256), 1, digits)


def query_hash(text: Column | str) -> Column:
    """16 hex digits for a query regardless of case and spacing; `query_empty` for a blank one."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", " ")))
    return F.when(plain == "", "query_empty").otherwise(F.substring(F.sha2(plain, 256), 1, 16))


def document_id(url: Column | str) -> Column:
    return F.substring(F.sha2(col(url), 256), 1, 24)


def claim_text(subject: Column, predicate: Column, value_json: Column, metadata_json: Column, null_word: str | None = None) -> Column:
    """The claim's fields with spaces between; nulls are left out, or written as null_word."""
    parts = [c if null_word is None else F.coalesce(c, F.lit(null_word)) for c in (subject, predicate, value_json, metadata_json)]
    return F.concat_ws(" ", *parts)


def _json_string(c: Column) -> Column:
    """A JSON string literal in ASCII: other characters as escapes of their UTF-16 units, as standard encoders write them."""
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    # only a text with others is taken apart
    plain = c.rlike(r"\A[\x20-\x7e]*\z")
    units = F.hex(F.encode(c, "UTF-16BE"))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(units) / 4 - 1).cast("int")), lambda i: F.substring(units, i * 4 + 1, F.lit(4)))
    ascii_ = F.transform(each, lambda u: F.when((u >= "0020") & (u < "007F"), F.chr(F.conv(u, 16, 10).cast("long"))).otherwise(F.concat(F.lit("\\u"), F.lower(u))))
    return F.when(c.isNotNull(), F.concat(F.lit('"'), F.when(plain, c).otherwise(F.array_join(ascii_, "")), F.lit('"')))


def claim_id(fields: Mapping[str, Column]) -> Column:
    """`wkg:` and 24 hex digits over the fields as sorted compact JSON; nulls are written as null."""
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.coalesce(_json_string(fields[k]), F.lit("null"))) for k in sorted(fields)])
    return F.concat(F.lit("wkg:"), F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 24))


def slug(text: Column | str) -> Column:
    """Lower case, everything but letters and digits as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def path_slug(path: Column | str, method: Column | str) -> Column:
    """An operation's name from its method and path."""
    clean = F.regexp_replace(F.regexp_replace(col(path), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lower(col(method)), F.lit("_"), F.lower(clean))


def minted_id(name: Column | str) -> Column:
    return F.regexp_replace(F.replace(F.lower(col(name)), F.lit("_"), F.lit("-")), "^-+|-+$", "")


def leading_verb(name: Column | str) -> Column:
    """The name up to its first underscore, lower-cased; one underscore at its end is left out first."""
    bare = F.trim(col(name))
    bare = F.when(bare.endswith("_") & ~bare.endswith("__"), F.regexp_replace(bare, "_$", "")).otherwise(bare)
    return F.lower(F.substring_index(bare, "_", 1))


# Leading verbs that read or write, and those of a migration's phases.
READ_VERBS = "get list describe read fetch download enumerate count exists has is show search find lookup query".split()
WRITE_VERBS = (
    "create update delete put post patch run start stop cancel grant revoke set add remove install uninstall import export "
    "rename transfer share unshare restore rollback refresh sync deploy promote submit trigger send reset rotate renew "
    "publish unpublish register unregister assign unassign attach detach enable disable lock unlock purge"
).split()
PHASE_VERBS = {
    "assessment": "assess scan probe discover inventory profile audit survey diagnose".split(),
    "analysis": "analyze analyse parse lint inspect interpret tokenize tokenise trace explain summarize summarise".split(),
    "transpile": "transpile translate convert rewrite transform render emit generate compile".split(),
    "validation": "validate verify compare diff reconcile match check assert test".split(),
}
# Spellings of effect classes, without hyphens and underscores.
EFFECT_SPELLINGS = {
    "read": ("read", "readonly", "ro"),
    "write": ("write", "mutating", "mutate", "rw", "readwrite"),
    "write·hitl": ("writehitl", "writehumanapproval", "hitl", "destructive"),
    "unclassified": ("unclassified", "unknown", "tbd"),
}


def effect_class(name: Column | str) -> Column:
    """read, write or unclassified, by the name's leading verb."""
    verb = leading_verb(name)
    return F.when(verb.isin(READ_VERBS), "read").when(verb.isin(WRITE_VERBS), "write").otherwise("unclassified")


def phase(name: Column | str) -> Column:
    """A migration phase by the name's leading verb; `unknown` for others and for null."""
    verb = F.lower(F.substring_index(F.coalesce(col(name), F.lit("")), "_", 1))
    out = F
    for kind, verbs in PHASE_VERBS.items():
        out = out.when(verb.isin(verbs), kind)
    return out.otherwise("unknown")


def normal_effect(raw: Column | str) -> Column:
    """The closed set's spelling of an effect class; unknown ones pass through, null stays."""
    bare = F.regexp_replace(F.lower(F.trim(col(raw))), "[-_]", "")
    out = F
    for kind, spellings in EFFECT_SPELLINGS.items():
        out = out.when(bare.isin(*spellings), kind)
    return out.otherwise(col(raw))


def iso_millis(text: Column | str) -> Column:
    """Epoch milliseconds of an ISO date or date and time, read as UTC whatever its offset says; null for anything else."""
    form = r"^(\d{4})-(\d{2})-(\d{2})(?:[T\s](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
    t = F.trim(col(text))
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, form, i), F.lit("")), F.lit("00"))
    stamp = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), part(6))
    # a second of 60 is no time of day
    return F.when(t.rlike(form) & (part(6) != "60"), F.unix_millis(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))))


def fixed_chunks(text: Column | str, size: int = 800, overlap: int = 80) -> Column:
    """array<struct<chunk_index, start, text>>: windows of `size` words, each `size - overlap` after the last, until the end is reached."""
    stride = size - overlap

    def windows(w: Column) -> Column:
        n = F.size(w)
        count = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - overlap) / stride))).cast("int")
        starts = F.when(count == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: (i * stride).cast("int")))
        return F.transform(starts, lambda s, i: F.struct(i.cast("long").alias("chunk_index"), s.cast("long").alias("start"), F.array_join(F.slice(w, s + 1, F.lit(size)), " ").alias("text")))

    # the words are bound as a lambda's variable, so a text is split once and not for each chunk
    return F.transform(F.array(words(text)), windows)[0]


def code_blocks(text: Column | str) -> Column:
    """The bodies of fenced code blocks, in order."""
    return F.regexp_extract_all(col(text), F.lit(r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```"), F.lit(1))


def answer_parts(response: Column | str) -> Column:
    """struct(answer, code): a `## Code` heading divides them, and an `## Explanation` heading goes; without one the fenced Python
    blocks are the code, and the answer is what stands around them.  Blocks are trimmed and joined by an empty line."""
    said = F.coalesce(col(response), F.lit(""))
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    heading, fence = r"(?im)^##\s*Code\s*$", r"(?s)```(?:python|py)?\s*\n(.*?)```"
    blocks = lambda c: F.array_join(F.transform(F.regexp_extract_all(c, F.lit(fence), F.lit(1)), trim), "\n\n")
    parts = F.split(said, heading, 2)
    own = F.element_at(parts, 2)
    answer = trim(F.regexp_replace(trim(F.element_at(parts, 1)), r"(?i)^##\s*Explanation\s*\n*", ""))
    headed = F.struct(answer.alias("answer"), F.when(trim(own).rlike(fence), blocks(own)).otherwise(trim(own)).alias("code"))
    fenced = F.struct(trim(F.regexp_replace(said, fence, "")).alias("answer"), blocks(said).alias("code"))
    plain = F.struct(said.alias("answer"), F.lit("").alias("code"))
    return F.when(F.size(parts) > 1, headed).when(said.rlike(fence), fenced).otherwise(plain)


def ordered_unique(values: Column | str) -> Column:
    """The distinct values that are neither null nor blank, in order of first appearance."""
    return F.array_distinct(F.filter(col(values), lambda v: F.coalesce(F.trim(v), F.lit("")) != ""))


def without_code(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"(?s)```[A-Za-z0-9_+-]*\n.*?```", ""))


POINTER = r"^meta:([A-Za-z0-9_.-]+)/ext:([A-Za-z0-9_.-]+)$"


def pointer_parts(pointer: Column | str) -> Column:
    """struct<meta, ext> of `meta:x/ext:y`, null for anything else."""
    p = col(pointer)
    return F.when(p.rlike(POINTER), F.struct(F.regexp_extract(p, POINTER, 1).alias("meta"), F.regexp_extract(p, POINTER, 2).alias("ext")))


def is_internal(name: Column | str, prefixes: tuple[str, ...]) -> Column:
    """Whether the third dotted part starts with one of the prefixes; false for null."""
    third = F.split_part(F.coalesce(col(name), F.lit("")), F.lit("."), F.lit(3))
    out = F.lit(False)
    for p in prefixes:
        out = out | third.startswith(p)
    return out


def card(predicate: Column, subject: Column, value: Column, templates: Mapping[str, str]) -> Column:
    """A predicate's template with {subject} and {value} filled in; an unknown predicate is an error."""
    out = F
    for name, template in templates.items():
        filled = F.replace(F.replace(F.lit(template), F.lit("{subject}"), subject), F.lit("{value}"), value)
        out = out.when(predicate == name, filled)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown predicate: "), predicate)).cast("string"))
