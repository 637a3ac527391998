"""DuckDB statements of the contracts that SQL can state.

They follow the contracts' wording, not the operators' methods: exact counts where the
operator sketches, all windows where it anchors, grouping where it compacts.
"""

from __future__ import annotations

from .quality_rules import BOILERPLATE

_SPACE = r"[\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACE}'), lambda x: x <> '')"


def gram(w: str, i: str, k: int) -> str:
    return f"array_to_string({w}[{i} : {i} + {k - 1}], ' ')"


OP1 = f"""
with recursive d as (select doc_id, {words(_LOWER)} as w from documents),
 s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: {gram('w', 'i', 5)}) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
 n as (select doc_id, count(*) as n from s group by 1),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
 e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
 r(node, root) as (select doc_id, doc_id from d union select e.b, r.root from r join e on e.a = r.node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(root) from r where r.node = d.doc_id) as component_id from d left join n using (doc_id)
"""

_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_STOCK = " or ".join("contains(lower(x), '{}')".format(p.replace("'", "''")) for phrases in BOILERPLATE.values() for p in phrases)
# one line x of n words: navigation, links, symbols, shouting, furniture, punctuation
_FAIL = f"""
 (bars >= 2 and bars >= n / 4) or (links >= 2 and links >= n / 4) or (symbols >= 3 and symbols > n / 2) or (shouts >= 4 and shouts > n / 2)
 or (n <= 25 and ({_STOCK})) or (n < 8 and not closed)
"""
OP2 = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
 w as (select *, {words('text')} as w, list_filter(string_split(text, chr(10)), lambda x: {_TRIM.format('x')} <> '') as ls from d),
 g as (select rid, i, {gram('w', 'i', 5)} as g from (select rid, w, unnest(range(1, len(w) - 3)) as i from w)),
 rep as (select rid, i from (select *, count(*) over (partition by rid, g) as c from g) where c >= 2),
 cov as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 5)) as p from rep) group by 1),
 x as (select rid, {_TRIM.format('x')} as x from (select rid, unnest(ls) as x from w)),
 y as (select rid, x, len({words('x')})::double as n, {_COUNT.format('x', '[|»›·•]')} as bars, {_COUNT.format('x', 'https?://|www[.]')} as links, {_COUNT.format('x', '[#*$%&<>]')} as symbols, {_COUNT.format('x', '!')} as shouts,
  right(x, 1) in ('.', '!', '?', ':', ';', '…', '"', '''', ')', ']', '»', '”', '。', '！', '？') as closed from x),
 z as (select rid, length(x) as size, {_FAIL} as fails from y),
 q as (select rid, count(*) as n, count(*) filter (fails) as bad, coalesce(sum(size) filter (not fails), 0) / sum(size) as share from z group by 1),
 b as (select w.rid, doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '{_SPACE}', '', 'g'))::bigint as word_chars, {_COUNT.format('text', '[#*$%&|<>]')}::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words from w left join cov using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
 not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and coalesce(share, 0) >= 0.5 as kept, coalesce(n, 0)::bigint as n_lines, coalesce(bad, 0)::bigint as n_failed_lines from b left join q using (rid)
"""

OP6 = """
with p as (select page_id, coalesce(html, '') as html from pages),
 d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha256(html) as payload_digest from p),
 f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type, case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f
"""

OP7 = f"""
with d as (select doc_id, {words(_LOWER)} as w from documents), b as (select item_id, {words(_LOWER)} as w from benchmark),
 ds as (select doc_id, i, {gram('w', 'i', 5)} as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)),
 bc as (select item_id, {gram('w', 'i', 5)} as g, count(*) as c from (select item_id, w, unnest(range(1, len(w) - 3)) as i from b) group by 1, 2),
 t as (select item_id, sum(c)::bigint as total from bc group by 1),
 pr as (select doc_id, item_id, any_value(total) as total from ds join bc using (g) join t using (item_id) group by 1, 2 having count(*) >= 0.75 * any_value(total)),
 wn as (select doc_id, item_id, total, unnest(range(2 - total, len(w) - 3)) as a from pr join d using (doc_id)),
 dc as (select wn.doc_id, item_id, total, a, g, count(*) as c from wn join ds on ds.doc_id = wn.doc_id and ds.i >= a and ds.i < a + total group by all),
 o as (select dc.doc_id, dc.item_id, total, a, sum(dc.c) as own, sum(least(dc.c, coalesce(bc.c, 0))) as shared from dc left join bc on bc.item_id = dc.item_id and bc.g = dc.g group by all),
 m as (select doc_id, item_id, greatest(a, 1) - 1 as start_word, own + 4 as n_words, shared::double / (own + total - shared)::double as similarity from o)
select doc_id, item_id, start_word::bigint as start_word, n_words::bigint as n_words, similarity from m where similarity >= 0.75 qualify row_number() over (partition by doc_id, item_id order by similarity desc, start_word, n_words desc) = 1
"""

OP8 = f"""
with d as (select doc_id, {words("coalesce(text, '')")} as w from documents),
 g as (select doc_id, i, {gram('w', 'i', 13)} as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
 f as (select doc_id, i from (select *, min(doc_id) over (partition by g) as first from g) where first < doc_id),
 c as (select distinct doc_id, unnest(range(i, i + 13)) as p from f),
 k as (select doc_id, i as p, w[i] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
 s as (select k.doc_id, count(c.p) as gone, string_agg(word, ' ' order by k.p) filter (c.p is null) as kept from k left join c on c.doc_id = k.doc_id and c.p = k.p group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join s using (doc_id)
"""

OP9 = f"""
with l as (select doc_id, source, i, line, {_TRIM.format('line')} as t from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null)),
 s as (select t, count(distinct coalesce(source, chr(1))) as sites, min(doc_id) as first from l where t <> '' group by 1),
 m as (select l.*, coalesce(sites >= 4 and l.doc_id > first, false) as gone from l left join s using (t)),
 a as (select doc_id, count(*) filter (t <> '') as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as kept from m group by 1)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, case when text is not null then sha256(coalesce(kept, '')) end as kept_sha256 from documents d left join a using (doc_id)
"""

OP11 = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
 p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from d),
 w as (select lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') as w from p),
 i as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
 f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as g, count(*) as f from i, (values (1), (2), (3)) v(k) where i + k - 1 <= len(w) group by all),
 n as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
 c as (select *, string_split(g, ' ') as w from f where k > 1 and f >= 10),
 x as (select lang, g, f as a, unnest(range(1, k)) as cut, w from c),
 y as (select x.lang, x.g, a, cut, l.f as l, r.f as r, 1000000::hugeint * a * a // (l.f::hugeint * r.f) as score from x join f l on l.lang = x.lang and l.g = array_to_string(w[:cut], ' ') join f r on r.lang = x.lang and r.g = array_to_string(w[cut + 1:], ' ')),
 b as (select * from y qualify row_number() over (partition by lang, g order by score, cut) = 1),
 h as (select lang, g, max(f) as f from (select lang, array_to_string(w[:2], ' ') as g, f from c where k = 3 union all select lang, array_to_string(w[2:], ' '), f from c where k = 3) group by 1, 2),
 o as (select b.lang, b.g as phrase, a, l, r, n, score::bigint as score from b join n using (lang) left join h on h.lang = b.lang and h.g = b.g where h.f is null or 100 * h.f < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from o qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""

OP12 = """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
 w as (select doc_id, i, array_slice(b, i, i + 99) as x from (select doc_id, b, unnest(range(1, octet_length(b) - 98)) as i from d)),
 f as (select x, min({'d': doc_id, 'i': i}) as m from w group by 1 having count(*) > 1),
 r as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 100, true)::int as head from (select doc_id, i from w join f using (x) where {'d': doc_id, 'i': i} <> m)),
 s as (select doc_id, min(i) as a, max(i) + 99 as z from (select doc_id, i, sum(head) over (partition by doc_id order by i) as run from r) group by doc_id, run),
 g as (select doc_id, list(a order by a) as a, list(z order by a) as z, count(*) as n_spans, sum(z - a + 1)::bigint as n_removed from s group by 1),
 k as (select doc_id, b, coalesce(n_spans, 0) as n_spans, coalesce(n_removed, 0) as n_removed, list_concat([0], coalesce(z, [])) as z, list_concat(coalesce(a, []), [octet_length(b) + 1]) as a from d left join g using (doc_id)),
 p as (select doc_id, string_agg(hex(array_slice(b, z[j] + 1, a[j] - 1)), '' order by j) filter (a[j] > z[j] + 1) as kept from (select *, unnest(range(1, len(a) + 1)) as j from k) group by 1)
select doc_id, octet_length(b)::bigint as n_bytes, n_removed, n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from k join p using (doc_id)
"""

SQL = {
    "op1_ngram_join": OP1,
    "op2_quality_rules": OP2,
    "op6_warc": OP6,
    "op7_decontamination": OP7,
    "op8_substring_dedup": OP8,
    "op9_line_dedup": OP9,
    "op11_phrase_collocations": OP11,
    "op12_suffix_dedup": OP12,
}
