"""The queries of this folder's operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgrid.llm import bpe, chat, hard_negatives, mixing, near_dup, packing, secret_scan, suffix_dedup, toxicity, url_filter, vectors, whitening
from marlgrid.llm.common import load, table


def op1_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(load(spark, sf_dir, "documents"))


def op3_multi_index_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(load(spark, sf_dir, "embeddings"), 0.95)


def op4_concat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    pieces = packing.pack(load(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), 2048, 1, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    return packing.pack_digests(pieces)


def op5_bucket_refine_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"), 100))


def op6_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", r"r'\### Assistant: </turn> ok' as text")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.prefix_targets(rows))


def op7_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two increments: the ledger of about half of the documents stands when all of them come, of which it leaves the unseen blobs to scan."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    earlier = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    ledger = table(secret_scan.scan_new(earlier), "ledger")
    return secret_scan.secret_digests(secret_scan.secrets(docs, ledger))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, with its probabilities, whether it is toxic, and whether it is kept."""
    found = toxicity.judged(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_low_quality", "p_toxic", "p_toxic_and_low", "toxic", (~F.col("toxic")).alias("kept"))


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return bpe.encode_digests(load(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


#: verdict, host, path
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op10_url_digest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(load(spark, sf_dir, "pages"), URL_RULES)


def op11_range_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digests(mixing.mix(load(spark, sf_dir, "documents")))


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


_ALL = (op1_segment_topk, op2_order_minhash, op3_multi_index_links, op4_concat_pack, op5_bucket_refine_dedup, op6_prefix_target_chat, op7_blob_ledger_secrets, op8_toxicity_chain, op9_bpe_roundtrip, op10_url_digest_filter, op11_range_tree_negatives, op12_fair_queue_mix, op13_lanczos_whitening)
QUERIES = {f.__name__: f for f in _ALL}

SQL: dict[str, str] = {}

SQL["op1_segment_topk"] = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as w from embeddings
 where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, r.vec_id, cast(list_sum(list_transform(list_zip(q.w, r.w), lambda p: p[1] * p[2])) as bigint) as score from v q join v r on q.vec_id % 100 = 0 and r.vec_id <> q.vec_id and len(q.w) = len(r.w)),
k as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, cast(n as integer) as rank, vec_id, score from k where n <= 10"""

SQL["op6_prefix_target_chat"] = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, i, if(i = 0, 'user', 'assistant'), '\### Assistant: </turn> ok' from range(2) r(i)),
e as (select *, replace(replace(replace(replace(role, '\', '\0'), '#', '\1'), '<', '\2'), ':', '\3') as er, replace(replace(replace(replace(text, '\', '\0'), '#', '\1'), '<', '\2'), ':', '\3') as et from c),
o as (select *, 14 + length(er) + length(et) as n, sum(14 + length(er) + length(et)) over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum(n) as bigint) as formatted_chars, count(*) filter (where role = 'assistant') as n_examples, cast(coalesce(sum(upto) filter (where role = 'assistant'), 0) as bigint) as expanded_chars from o group by conv_id"""


def _either_case(words: str) -> str:
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words.split())


_ASSIGN = f"({_either_case('password passwd secret token')}|{_either_case('api')}_?{_either_case('key')})" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = ((0, "assign", _ASSIGN, 2, 8), (1, "access", "AKIA[A-Z0-9]+", 0, 16), (2, "hex", "[0-9a-f]+", 0, 32))
_FOUND = " union all ".join(f"select doc_id, {k} as k, '{kind}' as kind, {least} as least, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}') as hits, regexp_extract_all(t, '{p}', {g}) as parts from d" for k, kind, p, g, least in _KINDS)
SQL["op7_blob_ledger_secrets"] = f"""
with d as (select doc_id, coalesce(text, '') as t from documents), f as ({_FOUND}),
m as (select doc_id, k, kind, least, gaps, hits, parts, unnest(range(1, len(hits) + 1)) as i from f),
s as (select doc_id, k, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as a, length(hits[i]) as n from m where length(parts[i]) >= least),
w as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex, string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, k) as spans from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from d left join w on w.doc_id = d.doc_id"""

_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in URL_RULES)
SQL["op10_url_digest_filter"] = f"""
with u as (select page_id, case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) as path from u),
r(v, h, w) as (values {_RULES}),
f as (select page_id, h || w as rule, v, row_number() over (partition by page_id order by length(h || w) desc, length(h) desc) as n from p join r on (host = h or host like '%.' || h) and starts_with(path, w))
select p.page_id, host, path, rule, coalesce(v, 'allow') as verdict from p left join f on f.page_id = p.page_id and n = 1"""

SQL["op11_range_tree_negatives"] = """
with v as (select vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) as label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as w from embeddings
 where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same, cast(list_sum(list_transform(list_zip(a.w, r.w), lambda p: p[1] * p[2])) as bigint) as score from v a join v r on a.vec_id % 100 = 0 and len(a.w) = len(r.w)),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same and vec_id <> anchor_id qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as n
 from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(n as integer) as rank, negative_id, positive_score, negative_score from n where n <= 10"""

SQL["op12_fair_queue_mix"] = r"""
with d as (select row_number() over () as row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5('mix-1:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key from documents),
s as (select source, sum(size)::hugeint as source_size, row_number() over (order by source nulls last) as place from d group by source),
w as (select *, (place - 1) % 3 + 1 as weight, 3 * source_size as cap, sum(source_size) over () as budget from s),
f as (select *, coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) as full_cap, sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as rest from w),
l as (select (budget - full_cap) as part, rest from f where (budget - full_cap) * weight < cap * rest order by cap / weight, place limit 1),
t as (select source, place, source_size, case when (budget - full_cap) * weight >= cap * f.rest then cap::double else l.part::double * weight::double / l.rest::double end as target,
 case when (budget - full_cap) * weight >= cap * f.rest then cap else least(cap, (l.part * weight) // l.rest) end as quota from f left join l on true),
q as (select d.*, t.place, t.source_size, t.target, t.quota, sum(size) over (partition by t.place order by key, row rows unbounded preceding) - size as start from d join t on d.source is not distinct from t.source),
i as (select *, least(size, quota - (pass * source_size + start)) as words from q, range(3) r(pass)),
m as (select *, sum(words) over (order by (pass * source_size + start + words)::double / target, place rows unbounded preceding) - words as at from i where words > 0)
select q.doc_id, q.size, q.source_size::bigint as source_size, q.target, coalesce(sum(m.words), 0)::bigint as taken, min(m.at)::bigint as first_at from q left join m on m.row = q.row group by q.row, q.doc_id, q.size, q.source_size, q.target"""
