"""SQL of the queries that SQL can say, for a table-by-table check of whole results."""

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as score from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as int) as rank, vec_id, cast(score as bigint) as score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20"""

ESCAPED = "replace(replace(replace({}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"
OP3 = f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
coalesce(length(string_agg(text, '' order by turn, text) filter (role = 'assistant')), 0) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
cast(sum(14 + length(replace({ESCAPED.format('role')}, chr(10), '\\n')) + length({ESCAPED.format('text')})) as bigint) as formatted_chars from c group by conv_id"""

OP5 = f"""with w as (select doc_id, {WORDS} as w from documents where doc_id is not null),
p as (select doc_id, unnest(range(1, len(w) - 48)) as s, w from w where len(w) >= 50),
h as (select doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) as h from p),
m as (select h, min(doc_id) as first from h group by h),
gone as (select distinct doc_id, unnest(range(s, s + 50)) as i from h join m using (h) where first < doc_id),
g as (select doc_id, list(i) as g from gone group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(g), 0) as bigint) as n_removed,
sha256(array_to_string(case when g is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(g, i)), lambda i: w[i]) end, ' ')) as kept_sha256 from w left join g using (doc_id)"""

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
FITS = " union all ".join(f"select page_id, '{r}' as rule, '{a}' as action from parts where (host = '{r.split('/')[0]}' or ends_with(host, '.{r.split('/')[0]}')) and starts_with(path, '{r[r.index('/'):]}')" for a, r in RULES)
OP6 = f"""with parts as (select page_id, url, coalesce({LOWER.format("regexp_extract(substr(url, nullif(strpos(url, '://'), 0) + 3), '^[^/?#]*', 0)")}, '') as host,
coalesce(regexp_extract(substr(url, nullif(strpos(url, '://'), 0) + 3), '^[^/?#]*([^?#]*)', 1), '') as path from pages),
fits as ({FITS}), best as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action from fits group by page_id),
alias as (select page_id, url, host, path, rule, action, case when host <> '' then regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html)$', '') end as form from parts left join best using (page_id)),
forms as (select form, bool_or(action = 'block') as blocked from alias where form is not null group by form)
select page_id, host, path, rule, coalesce(action, case when blocked then 'block' else 'allow' end) as verdict from alias left join forms using (form)"""

NORMAL = f"regexp_extract_all({LOWER.format('coalesce(text, chr(32))')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP10 = f"""with b as (select item_id, {NORMAL} as w from benchmark where item_id is not null),
windows as (select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as k from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from b where len(w) > 0)),
d as (select doc_id, {NORMAL} as w from documents where doc_id is not null),
runs as (select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from windows) where len(w) >= n)),
found as (select doc_id, item_id, s, n from runs join windows using (n, k)),
hit as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(s, s + n)) as i from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)"""

OP1 = f"""with recursive w as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents where doc_id is not null),
s as (select doc_id, list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from w), t as (select doc_id, unnest(s) as t from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from t a join t b using (t) where a.doc_id < b.doc_id group by all),
l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * c >= 80 * (len(x.s) + len(y.s) - c)), e as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as reached from w union select r.node, e.b from r join e on r.reached = e.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, (select min(reached) from r where node = s.doc_id) as component_id, s.doc_id = (select min(reached) from r where node = s.doc_id) as kept from s"""

OP8 = """with h as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents where doc_id is not null), p as (select doc_id, unnest(range(0, length(h) // 2 - 399)) as s, h from h where length(h) >= 800),
f as (select doc_id, s, md5(substr(h, 2 * s + 1, 800)) as f from p), m as (select f from f group by f having count(*) > 1), g as (select distinct doc_id, s from f join m using (f)),
e as (select doc_id, s, case when s > 400 + lag(s, 1, -1000) over (partition by doc_id order by s) then 1 else 0 end as fresh from g),
i as (select doc_id, min(s) as a, max(s) + 400 as b from (select *, sum(fresh) over (partition by doc_id order by s) as k from e) group by doc_id, k),
k as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as before from i),
t as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || max(substr(h, 2 * last + 1)) as kept from (select k.*, h, max(b) over (partition by doc_id) as last from k join h using (doc_id)) group by doc_id)
select h.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from h left join t using (doc_id)"""

# crc32 byte by byte, over a table that the polynomial makes
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i))"
CRC = "xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: 16 * strpos('123456789ABCDEF', h[i]) + strpos('123456789ABCDEF', h[i + 1])), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
OP13 = f"""with d as (select doc_id, {NORMAL} as w from documents where doc_id is not null), b as (select {NORMAL} as w from benchmark),
df as (select doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from d), bf as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from b),
x as (select f, hex(encode(f)) as h, {CRC_TABLE} as crcs from (select f from df union select f from bf)), k as (select f, {CRC} % 10000 as bucket from x),
s as (select bucket, count(*) as s from df join k using (f) group by bucket), t as (select bucket, count(*) as t from bf join k using (f) group by bucket),
g as (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from df) + 10000) / ((coalesce(s, 0) + 1)::double * ((select count(*) from bf) + 10000)))) as bigint) as gain from s full join t using (bucket)),
w as (select doc_id, count(*) as n_features, cast(floor(sum(gain)::double / count(*)) as bigint) as weight from df join k using (f) join g using (bucket) group by doc_id),
u as (select doc_id, len(d.w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, (('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double as u from d left join w using (doc_id)),
v as (select *, weight + cast(floor(-1000 * ln(-ln(u))) as bigint) as score from u), r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from v where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 25 * (select count(*) from r) // 100 then rank end as rank from v left join r using (doc_id)"""

SQL = {"op13_importance_resampling": OP13, "op1_minhash_near_dedup": OP1, "op8_suffix_dedup": OP8, "op2_exact_topk": OP2, "op3_chat_format": OP3, "op5_substring_dedup": OP5, "op6_url_filter": OP6, "op10_decontaminate": OP10}
