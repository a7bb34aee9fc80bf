"""The queries of this subpackage, by name, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from . import decontam, media, neardup, packing, pii, runs, sharding, suffixes, tokens, topk, toxicity, warc, whitening

QUERIES = {
    "op1_bucket_pointer_refinement": suffixes.op1_bucket_pointer_refinement,
    "op2_odd_sketches": neardup.op2_odd_sketches,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_contextual_pii": pii.op4_contextual_pii,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_warc": warc.op6_warc,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_packing": packing.op8_packing,
    "op9_telephony_audio": media.op9_telephony_audio,
    "op10_histogram_sort": sharding.op10_histogram_sort,
    "op11_jacobi_whitening": whitening.op11_jacobi_whitening,
    "op12_norm_buckets": topk.op12_norm_buckets,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A hash of every window of 200 bytes (400 hex digits); starts of windows met twice make spans, and what lies between them stays.
_OP1 = """
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
g as (select doc_id, s, substr(h, 1 + 2 * s, 1422) as part, length(h) // 2 as n from (select *, unnest(range(0, length(h) // 2 - 199, 512)) as s from d)),
w as (select doc_id, i, hash(substr(part, 2 * (i - s) + 1, 400)) as x from (select *, unnest(range(s, least(s + 512, n - 199))) as i from g)),
r as (select doc_id, i from w where x in (select x from w group by x having count(*) > 1)),
m as (select *, i > coalesce(lag(i) over (partition by doc_id order by i) + 200, -1) as fresh from r),
e as (select doc_id, a, b + 200 as b from (select doc_id, min(i) as a, max(i) as b from (select *, sum(cast(fresh as int)) over (partition by doc_id order by i) as no from m) group by doc_id, no)),
k as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, list(a order by a) as a, list(b order by a) as b from e group by doc_id),
o as (select d.doc_id, h, n_removed, n_spans, list_concat([0], b) as a, list_append(a, length(h) // 2) as b from d left join k on d.doc_id = k.doc_id)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
sha256(unhex(case when n_spans is null then h else array_to_string(list_transform(range(1, n_spans + 2), lambda j: substr(h, 2 * a[j] + 1, 2 * (b[j] - a[j]))), '') end)) as kept_sha256 from o
"""

#: All pairs that share a shingle, then components by reachability.
_OP2 = f"""
with recursive t as (select doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(list_slice(w, i, i + 3), ' ') end as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as i from t where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, l.b from reach join l on reach.r = l.a),
m as (select doc_id, min(r) as component_id from reach group by doc_id)
select m.doc_id, coalesce(n.n, 0) as n_shingles, component_id, m.doc_id = component_id as kept from m left join n on m.doc_id = n.doc_id
"""

_OP6 = """
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
q as (select page_id, n, sha1(h) as d, max(page_id) over (partition by h) as m, n >= 1000 and count(*) over (partition by h) > 1 as again from p),
r as (select *, again and m is not null and (page_id is null or page_id <> m) as revisit from q)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when revisit then 'revisit' else 'response' end as record_type, case when revisit then m end as refers_to from r
"""

_WORDS = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_OP7 = f"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("text")}, {_WORDS}) as w from documents),
i as (select item_id, regexp_extract_all({_LOWER.format("text")}, {_WORDS}) as w from benchmark),
iw as (select distinct item_id, l, array_to_string(list_slice(w, j, j + l - 1), ' ') as x from (select item_id, w, least(13, len(w)) as l, unnest(range(1, len(w) - least(13, len(w)) + 2)) as j from i where len(w) > 0)),
dw as (select doc_id, l, j, array_to_string(list_slice(w, j, j + l - 1), ' ') as x from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as j from d, (select distinct l from iw) where len(w) >= l)),
h as (select doc_id, dw.l, j, item_id from dw join iw on dw.l = iw.l and dw.x = iw.x),
n as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(j, j + l)) as k from h) group by doc_id),
m as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join n on d.doc_id = n.doc_id left join m on d.doc_id = m.doc_id
"""

#: All products of the asked vectors with all others.
_OP12 = """
with v as (select row_number() over () as u, vec_id, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.u, a.vec_id as query_id, b.vec_id, cast(coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda p: coalesce(p[1] * p[2], 0))), 0) as bigint) as score
  from v a join v b on a.u <> b.u where a.vec_id % 50 = 0),
r as (select query_id, vec_id, score, row_number() over (partition by u order by score desc, vec_id nulls last) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""

#: Queries 3 and 8 need a tokenizer, 4, 5 and 10 results of a method, 9 a codec, 11 an eigenvalue solver, and 13 compares all pairs
#: of words of a text: they are tested against brute force instead.
ORACLES: dict[str, str] = {"op12_norm_buckets": _OP12, "op1_bucket_pointer_refinement": _OP1, "op2_odd_sketches": _OP2, "op6_warc": _OP6, "op7_decontamination": _OP7}
