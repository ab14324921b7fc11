"""The registered queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

OP1 = """
with entry as (
  select source, ('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))), 1, 15))::bigint as key,
         doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::bigint as size
  from documents),
queue as (select source, key, doc_id, size, count(*) as times from entry group by all),
sizes as (
  select source, sum(size * times)::bigint as source_size, row_number() over (order by source asc nulls last) - 1 as rank
  from queue group by source),
limits as (select *, [5, 2, 1][(rank % 3 + 1)::int] as weight, source_size * 3 as lim from sizes),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(lim) over (order by lim / weight::double, rank rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by lim / weight::double, rank rows between current row and unbounded following))::double as lvl
  from limits),
shares as (select *, least(lim::double, (max(lvl) over ()) * weight) as target from levels),
placed as (
  select q.source, rank, weight, key, doc_id, size, times, source_size, target,
    (sum(size * times) over (partition by q.source order by key, doc_id nulls first, size rows unbounded preceding))::bigint as through
  from queue q join shares s on q.source is not distinct from s.source),
offers as (
  select p.*, r, (r * source_size + through)::double / weight as finish, size * times as words
  from placed p, (select unnest([0, 1, 2]) as r)),
served as (
  select *, sum(words) over (order by finish, rank, key, doc_id nulls first, size rows unbounded preceding) as upto from offers),
taken as (
  select rank, key, doc_id, size, source_size, target, times,
    count(*) filter (where 2 * upto - words <= 2 * (select sum(size * times) from queue)) as copies
  from served group by all)
select doc_id, size, source_size, target, (size * copies)::bigint as taken
from taken, range(times) as t(i)
"""

OP2 = """
with words as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') as w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^ \\t-\\r]')] as l
  from documents),
place as (select rid, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5),
win as (select p.rid, i, array_to_string(w[i:i + 4], ' ') as k from place p join words using (rid)),
twice as (select rid, i, count(*) over (partition by rid, k) as n from win),
gain as (select rid, least(5, coalesce(lead(i) over (partition by rid order by i) - i, 5)) as g from twice where n > 1),
repeats as (select rid, sum(g)::bigint as n_repeat_words from gain group by rid),
counted as (
  select rid, doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l)::bigint as n_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from words left join repeats using (rid)),
rated as (
  select *, n_symbols * 10000 // greatest(word_chars, 1) as symbol_rate, n_dup_lines * 10000 // greatest(n_lines, 1) as repeat_line_rate,
    n_repeat_words * 10000 // greatest(n_words, 1) as repeat_word_rate, word_chars * 100 // greatest(n_words, 1) as word_length
  from counted),
long as (
  select rid, lang, source, rate, v from (
    select rid, lang, source, unnest([{'rate': 'symbol_rate', 'v': symbol_rate}, {'rate': 'repeat_line_rate', 'v': repeat_line_rate},
      {'rate': 'repeat_word_rate', 'v': repeat_word_rate}, {'rate': 'word_length', 'v': word_length}], recursive := true) from rated)),
bucketed as (
  select *, case when v < 128 then v else (v >> (len(bin(v)) - 7)::int) << (len(bin(v)) - 7)::int end as b from long),
levels as (
  select 1 as level, lang, source, rate, b from bucketed
  union all select 2, lang, null, rate, b from bucketed union all select 3, null, null, rate, b from bucketed),
ranked as (
  select *, count(*) over (partition by level, lang, source, rate order by b) as upto, count(*) over (partition by level, lang, source, rate) as n
  from levels),
quartiles as (
  select level, lang, source, rate, max(n) as n, min(b) filter (where 4 * upto >= n) as q1, min(b) filter (where 4 * upto >= 3 * n) as q3
  from ranked group by all),
fences as (
  select *, q3 + 3 * greatest(q3 - q1, map {'symbol_rate': 200, 'repeat_line_rate': 1000, 'repeat_word_rate': 500, 'word_length': 300}[rate]) as fence
  from quartiles),
high as (
  select x.rid, bool_or(v > case when f1.n >= 50 then f1.fence when f2.n >= 50 then f2.fence else f3.fence end) as out
  from long x
  left join fences f1 on f1.level = 1 and f1.rate = x.rate and f1.lang is not distinct from x.lang and f1.source is not distinct from x.source
  left join fences f2 on f2.level = 2 and f2.rate = x.rate and f2.lang is not distinct from x.lang
  left join fences f3 on f3.level = 3 and f3.rate = x.rate
  group by x.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not out as kept
from rated join high using (rid)
"""


def _op4() -> str:
    rules = [
        ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
        ("access", "AKIA[A-Z0-9]+", 20, 0),
        ("hex", "[0-9a-f]{24,}", 24, 0),
        ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0),
        ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1, 0),
    ]
    parts = " union all ".join(
        f"""select rid, {no} as kind_no, '{kind}' as kind, unnest(string_split_regex(t, '{pattern}')[:-2]) as gap,
        unnest(regexp_extract_all(t, '{pattern}')) as hit, unnest(regexp_extract_all(t, '{pattern}', {group})) as val,
        unnest(range(len(regexp_extract_all(t, '{pattern}')))) as i, {least} as least
        from blob where regexp_matches(t, '{pattern}')""" for no, (kind, pattern, least, group) in enumerate(rules))
    return f"""
with blob as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
piece as ({parts}),
span as (
  select *, (sum(length(gap) + length(hit)) over (partition by rid, kind order by i))::bigint as stop from piece),
good as (
  select rid, kind, kind_no, stop - length(hit) as start, concat_ws(':', kind, stop - length(hit), stop) as s
  from span where length(val) >= least),
per as (
  select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
    count(*) filter (where kind = 'hex') as n_hex,
    coalesce(string_agg(s, ',' order by start, kind_no) filter (where kind_no < 3), '') as base,
    string_agg(s, ',' order by start, kind_no) as spans
  from good group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
  coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from blob left join per using (rid)
"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::bigint)"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: case when d % 2 = 1 then xor(d >> 1, 3988292384) else d >> 1 end)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: {bits}), 4294967295)"


_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11 = f"""
with docs as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
items as (
  select regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
seen as (select rid, unnest(w) as word from docs),
aimed as (select unnest(w) as word from items),
vocabulary as (
  select word, (crc % 10000)::bigint as bucket from (
    select word, {_crc32("word")} as crc from (select word from seen union select word from aimed))),
s as (select bucket, count(*) as n from seen join vocabulary using (word) group by bucket),
t as (select bucket, count(*) as n from aimed join vocabulary using (word) group by bucket),
gains as (
  select b.bucket, floor(1000.0::double * ln(((coalesce(t.n, 0) + 1)::double * ((select count(*) from seen) + 10000)::double)
    / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from aimed) + 10000)::double)))::bigint as gain
  from (select unnest(range(10000)) as bucket) b left join s using (bucket) left join t using (bucket)),
weights as (
  select rid, sum(gain)::bigint as total from seen join vocabulary using (word) join gains using (bucket) group by rid),
scored as (
  select doc_id, len(w)::bigint as n_features,
    coalesce(total // len(w) - (case when total % len(w) < 0 then 1 else 0 end), 0)::bigint as weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from docs left join weights using (rid)),
noisy as (
  select doc_id, n_features, weight, (weight + floor(-1000.0::double * ln(-ln((h + 0.5::double) / 4294967296.0::double))))::bigint as score
  from scored),
placed as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id asc nulls last, n_features, weight) as place from noisy)
select doc_id, n_features, weight, score,
  case when n_features >= 20 and place <= 10 * (select count(*) from noisy where n_features >= 20) // 100 then place end::bigint as rank
from placed
"""

OP12 = f"""
with recursive runs as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), {_CAPITALS}) as run from documents),
checked as (select run, {_crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from runs where length(run) >= 5),
words as materialized (
  select word, count(*)::bigint as n from (
    select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from checked)
  where length(word) >= 5 group by word having count(*) >= 3),
holes as materialized (
  select word, length(word) as size, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, unnest(range(1, length(word) + 1)) as i from words)),
near as materialized (
  select a.word, b.word as near from holes a join holes b on a.rest = b.rest and a.i = b.i and a.word <> b.word and a.size = b.size
  union select h.word, w.word from holes h join words w on h.rest = w.word
  union select w.word, h.word from holes h join words w on h.rest = w.word),
best as (
  select near.word, count(*)::bigint as n_near, first(near.near order by b.n desc, near.near) as form, max(b.n) as form_n
  from near join words b on b.word = near.near group by near.word),
formed as materialized (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 2 * w.n then form end as form,
    case when form_n >= 2 * w.n then form_n end as form_n
  from words w left join best on best.word = w.word),
chain as (
  select word, word as at from formed
  union all select c.word, f.form from chain c join formed f on f.word = c.at where f.form is not null),
roots as (select c.word, c.at as root from chain c join formed f on f.word = c.at where f.form is null)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""

_BASE32 = "concat(" + ", ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, %d, 5))::int >> %d) & 31) + 1, 1)" % (5 * i + 1, shift)
    for i in range(8) for shift in (15, 10, 5, 0)) + ")"

OP13 = f"""
with paid as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as sha from pages),
groups as (select payload, max(page_id) as first from paid group by payload)
select page_id, octet_length(encode(payload))::bigint as payload_bytes, {_BASE32} as payload_digest,
  case when page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from paid join groups using (payload)
"""


ORACLES = {"op1_mix": OP1, "op2_quality_rules": OP2, "op4_secret_scan": _op4(), "op11_importance_resampling": OP11,
           "op12_spelling_variants": OP12, "op13_warc": OP13}
