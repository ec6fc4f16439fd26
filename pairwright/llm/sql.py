"""DuckDB SQL for the queries that SQL can express on whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as materialized (select distinct doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i:i + 2], ' '))) as g from w where len(w) > 0),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
e as materialized (select a, b from l union all select b, a from l),
r(id, reached) as (select doc_id, doc_id from documents union select r.id, e.b from r join e on e.a = r.reached)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from documents d left join n using (doc_id) join (select id, min(reached) as component_id from r group by id) m on m.id = d.doc_id
"""

OP2 = f"""
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from t),
k as materialized (select *, nullif(translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}'), '') as key from l),
h as (select key from (select distinct doc_id, key from k where key is not null) group by key having count(*) >= 10)
select doc_id, count(*) as n_lines, count(h.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where h.key is null), '')) as kept_sha256
from k left join h on h.key = k.key group by doc_id
"""

OP9 = """
with recursive v as materialized (select vec_id, label, embedding::double[] as e from embeddings),
l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, reached) as (select vec_id, vec_id from v union select r.id, l.b from r join l on l.a = r.reached),
m as (select id, min(reached) as component_id from r group by id), n as (select a, count(*) as n from l group by a)
select v.vec_id, coalesce(n.n, 0) as n_links, m.component_id, v.vec_id = m.component_id as kept from v join m on m.id = v.vec_id left join n on n.a = v.vec_id
"""

#: crc32 is linear over bits: the crc of n bytes is the xor of a table entry for each (byte, bytes after it) and of one for n.
_CRC = """
b0(b, x, k) as (select range, range, 0 from range(256) union all select b, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, k + 1 from b0 where k < 8),
byte as materialized (select b, x from b0 where k = 8),
most as materialized (select coalesce(max(octet_length(encode(g))), 0) as n from g),
after(b, x, k) as (select b, x, 0 from byte union all select a.b, xor(a.x >> 8, t.x), k + 1 from after a join byte t on t.b = a.x & 255 where k < (select n from most)),
entry as materialized (select upper(printf('%02x', b)) as h, k, x from after),
start(k, x) as (select 0, 4294967295 union all select k + 1, xor(s.x >> 8, t.x) from start s join byte t on t.b = s.x & 255 where k < (select n from most)),
kinds as materialized (select distinct g, hex(encode(g)) as h from g),
bytes as (select g, unnest(range(octet_length(encode(g)))) as i, h from kinds),
crc as materialized (select b.g, xor(bit_xor(e.x), 4294967295) as x, max(length(b.h)) // 2 as n from bytes b join entry e on e.k = length(b.h) // 2 - 1 - b.i and e.h = substr(b.h, (2 * b.i + 1)::int, 2) group by b.g),
bucket as materialized (select c.g, xor(c.x, s.x) % 10000 as bucket from crc c join start s on s.k = c.n)
"""

OP12 = f"""
with recursive w as materialized (select 0 as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
  union all select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
p as (select side, id, w, unnest(range(1, len(w) + 1)) as i from w),
g as materialized (select side, id, array_to_string(w[i:i + k], ' ') as g from p, range(3) r(k) where i + k <= len(w)),
{_CRC},
f as materialized (select side, id, bucket, count(*) as n from g join bucket using (g) group by 1, 2, 3),
c as (select b.range as bucket, coalesce(sum(n) filter (where side = 0), 0)::double as s, coalesce(sum(n) filter (where side = 1), 0)::double as t from range(10000) b left join f on f.bucket = b.range group by 1),
a as (select sum(s) as s, sum(t) as t from c),
gain as materialized (select bucket, floor(1000 * ln((c.t + 1) * (a.s + 10000) / ((c.s + 1) * (a.t + 10000))))::bigint as gain from c, a),
v as (select id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from f join gain using (bucket) where side = 0 group by 1),
d as (select doc_id, len(w.w) as n, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint as h from documents join w on w.side = 0 and w.id = doc_id left join v on v.id = doc_id),
o as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from d),
k as (select *, row_number() over (partition by n >= 20 order by score desc, doc_id) as place, count(*) over (partition by n >= 20) as many from o)
select doc_id, n_features, weight, score, case when n >= 20 and place <= 5 * many // 100 then place end as rank from k
"""

OP13 = f"""
with t as materialized (select doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as w from documents),
p as materialized (select doc_id, w, count(*) as tf from t group by 1, 2),
d as materialized (select doc_id, count(*) as n from t group by 1),
a as (select count(*) as docs, sum(n)::bigint as terms from d),
m as (select doc_id, 100 - 90 + (90 * n * docs) // terms as m from d, a),
f as (select w, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as weight from p, a group by w, docs),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as w from benchmark),
s as (select item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from i join p using (w) join f using (w) join m using (doc_id) group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""

ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": OP1, "op2_line_dedup": OP2, "op9_embedding_near_dedup": OP9, "op12_importance_resampling": OP12, "op13_ranked_search": OP13}
