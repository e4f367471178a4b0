"""DuckDB SQL for the queries that SQL can express on whole tables, written from their contracts.

The language profiles' SQL counts all labelled documents, as the operator does while a language has no more than its
sample. Tables have no null ids.
"""

from __future__ import annotations

from . import urls

#: crc32 of a number's decimal text: the reflected polynomial, byte by byte and bit by bit.
_CRC = """crc as (select doc_id, cast(xor(list_reduce(list_concat([4294967295::ubigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda d: cast(ascii(d) as ubigint))),
lambda c, b: list_reduce(list_concat([xor(c, b)], [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384::ubigint) else x // 2 end)), 4294967295::ubigint) as bigint) as crc from (select distinct doc_id from documents))"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"words as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) as w from documents)"

REPEATS = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), n as (select doc_id, h, length(h) // 2 as n from d),
win as (select doc_id, i, substr(h, cast(2 * i + 1 as bigint), 100) as w from n, unnest(range(greatest(0, n - 49))) t(i)),
least_id as (select w, min(doc_id) as m from win group by w having min(doc_id) < max(doc_id)),
hit as (select doc_id, i from win join least_id using (w) where m < doc_id),
mark as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from hit),
part as (select *, sum(new) over (partition by doc_id order by i) as k from mark),
runs as (select doc_id, min(i) as lo, max(i) + 50 as hi from part group by doc_id, k),
cut as (select *, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as since from runs),
rest as (select doc_id, cast(sum(hi - lo) as bigint) as gone, count(*) as spans, max(hi) as upto, string_agg(substr(h, cast(2 * since + 1 as bigint), cast(2 * (lo - since) as bigint)), '' order by lo) as kept from cut join n using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(gone, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept, '') || substr(h, cast(2 * coalesce(upto, 0) + 1 as bigint)))) as kept_sha256 from n left join rest using (doc_id)"""

NEAR = f"""with recursive {_WORDS},
sh as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) where len(w) > 0),
size as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join size x on x.doc_id = a join size y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from words union select r.a, l.b from reach r join both_ways l on l.a = r.b),
least_id as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from least_id left join size using (doc_id)"""

LANGUAGES = f"""with {_CRC}, word as (select doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as w from documents),
edged as (select doc_id, chr(1) || w || chr(1) as w from word),
grams as (select doc_id, substr(w, cast(i as int), k) as g from edged, (values (1), (2), (3)) s(k), unnest(range(1, length(w) - k + 2)) t(i) where not (k = 1 and (i = 1 or i = length(w)))),
own as (select doc_id, g, count(*) as n from grams group by doc_id, g qualify row_number() over (partition by doc_id order by count(*) desc, length(g), g) <= 300),
ranked as (select doc_id, g, row_number() over (partition by doc_id order by n desc, length(g), g) - 1 as r from own),
learned as (select lang, g, count(*) as n from grams join documents using (doc_id) join crc using (doc_id) where crc % 5 <> 0 and lang is not null group by lang, g),
profile as (select lang, g, row_number() over (partition by lang order by n desc, length(g), g) - 1 as r from learned qualify row_number() over (partition by lang order by n desc, length(g), g) <= 300),
langs as (select distinct lang from profile),
apart as (select o.doc_id, l.lang, cast(sum(coalesce(abs(o.r - p.r), 300)) as bigint) as far, count(*) as n from ranked o cross join langs l left join profile p on p.lang = l.lang and p.g = o.g group by 1, 2),
best as (select doc_id, lang, 1 - far / (300 * n) as score from apart qualify row_number() over (partition by doc_id order by far, lang) = 1)
select d.doc_id, crc % 5 = 0 as held_out, coalesce(b.lang, 'und') as lang_pred, coalesce(score, 0.0)::double as score from documents d join crc using (doc_id) left join best b using (doc_id)"""

MEDIA = """with t as (select doc_id, encode(coalesce(text, '')) as b, coalesce(text, '') as text from documents), p as (select doc_id, octet_length(b) as n, greatest(192, (octet_length(b) + 191) // 192 * 192) as m, text from t)
select doc_id, n as n_bytes, m as payload_bytes, sha256(text || repeat(' ', cast(m - n as int))) as payload_sha256 from p"""

BASE_SCORES = f"""with {_CRC}, {_WORDS}, tok as (select doc_id, unnest(list_concat(w, [chr(10)])) as t from words),
learned as (select t, count(*) as c from tok join crc using (doc_id) where crc % 5 <> 1 group by t), total as (select cast(sum(c) as bigint) as n, count(*) as v from learned),
s as (select doc_id, count(*) as n_tokens, count(c) as n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) as b from tok left join learned using (t), total group by doc_id)
select doc_id, crc % 5 = 1 as held_out, n_tokens, n_known, n as train_tokens, round(b, 5) as base_score from s join crc using (doc_id), total"""


def sql(url_rules: list[tuple[str, str, str]]) -> dict[str, str]:
    """Query name to SQL."""
    return {"op1_suffix_dedup": REPEATS, "op2_url_filter": urls.judge_sql(url_rules), "op3_language_id": LANGUAGES, "op7_super_minhash": NEAR, "media_payloads": MEDIA, "word_base_scores": BASE_SCORES}
