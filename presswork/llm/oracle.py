"""DuckDB SQL of the training-data operators that SQL can express on whole tables."""

from __future__ import annotations

from . import chat, decontaminate, line_rules, secret_scan

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

WINDOWS = rf"""
with w as (select row_number() over () rid, doc_id, {WORDS} ws from documents),
win as (select rid, doc_id, p, array_to_string(ws[p:p + 49], ' ') s from (select rid, doc_id, ws, unnest(range(1, len(ws) - 48)) p from w)),
firsts as (select s, min(doc_id) d from win group by 1),
bad as (select rid, p from win join firsts using (s) where d < doc_id),
cov as (select distinct rid, p + k pos from bad, range(50) t(k)),
tok as (select rid, unnest(ws) word, unnest(range(1, len(ws) + 1)) pos from w),
kept as (select rid, string_agg(word, ' ' order by pos) k from tok where not exists (select 1 from cov where cov.rid = tok.rid and cov.pos = tok.pos) group by 1),
gone as (select rid, count(*) n from cov group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(k, '')) kept_sha256
from w left join kept using (rid) left join gone using (rid)
"""

NEAR_COPIES = rf"""
with recursive w as (select doc_id, {WORDS} ws from documents),
s as (select distinct doc_id, array_to_string(ws[p:p + 4], ' ') g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) p from w where len(ws) > 0)),
n as (select doc_id, count(*) n, md5(string_agg(g, chr(10) order by g)) m from s group by 1),
c as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 10 * k >= 8 * (a.n + b.n - k)),
r as (select x, y from l union select r.x, l.y from r join l on l.x = r.y)
select d.doc_id, coalesce((select min(o.doc_id) from n o where o.m = n.m), d.doc_id) set_id, least(d.doc_id, coalesce((select min(y) from r where x = d.doc_id), d.doc_id)) class_id,
  (select count(*) from l where x = d.doc_id)::bigint n_links, coalesce(n.n, 0)::bigint n_grams
from documents d left join n on n.doc_id = d.doc_id
"""

_bars = "(length(l) - length(regexp_replace(l, '[|>»›·•]', '', 'g')))"
_signs = "(length(l) - length(regexp_replace(l, '[#*$%&|<>!]', '', 'g')))"
_gaps = "(1 + length(l) - length(replace(l, ' ', '')))"
_words = f"case when length(l) > {line_rules.LONGEST_BOILERPLATE} then '' else ' ' || regexp_replace(lower(l), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' ' end"
_letters = "length(replace({}, ' ', ''))".format
_said = f"array_to_string(regexp_extract_all({_words}, '{line_rules.phrase_pattern()}'), '')"
_bad = f"""(({_letters(_said)} >= 0.5 * {_letters(_words)} and {_letters(_words)} > 0) or ({_bars} >= 3 and {_bars} >= 0.25 * {_gaps})
  or {_signs} >= 1.5 * {_gaps} or ({_gaps} >= 60 and not regexp_matches(l, '[.!?,;:…。！？]')))"""

LINE_RULES = rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t, {WORDS} ws from documents),
g as (select rid, p, array_to_string(ws[p:p + 2], ' ') s from (select rid, ws, unnest(range(1, len(ws) - 1)) p from d)),
twice as (select rid, s from g group by 1, 2 having count(*) > 1),
rep as (select rid, count(distinct p + k) n from g join twice using (rid, s), range(3) t(k) group by 1),
ln as (select rid, l, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) n, {_bad} bad from (select rid, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '[^\x20\x09-\x0D]')),
li as (select rid, count(*) n_lines, count(*) - count(distinct l) dup, count(*) filter (bad) n_bad, coalesce(sum(n) filter (bad), 0) lost from ln group by 1),
m as (select doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  coalesce(dup, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_bad, 0)::bigint n_bad_lines, coalesce(lost, 0)::bigint chars_lost
  from d left join rep using (rid) left join li using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and chars_lost <= 0.5 * word_chars kept, n_lines, n_bad_lines, chars_lost from m
"""

#: 100-byte strings of each text as hex; the earlier start of two equal ones stays.
BYTES = r"""
with t as (select row_number() over () rid, doc_id, hex(encode(coalesce(text, ''))) x from documents),
d as (select *, length(x) // 2 n from t),
c as (select rid, doc_id, n, q, substr(x, 1000 * q + 1, 1198) y from (select *, unnest(range(0, (n - 100) // 500 + 1)) q from d where n >= 100)),
w as (select rid, doc_id, 500 * q + r p, md5(substr(y, 2 * r + 1, 200)) h from (select *, unnest(range(0, least(500, n - 99 - 500 * q))) r from c)),
f as (select h, min((doc_id, p)) o from w group by 1),
bad as (select rid, p from w join f using (h) where (doc_id, p) > o),
runs as (select rid, p, p - row_number() over (partition by rid order by p) g from bad),
joined as (select rid, min(p) a, max(p) + 100 b from runs group by rid, g),
marked as (select *, sum((a > coalesce(before, -1))::int) over (partition by rid order by a) k from (select *, max(b) over (partition by rid order by a rows between unbounded preceding and 1 preceding) before from joined)),
spans as (select rid, k, min(a) a, max(b) b from marked group by 1, 2),
gaps as (select rid, k, coalesce(lag(b) over (partition by rid order by k), 0) s, a e from spans union all select rid, max(k) + 1, max(b), null from spans group by 1),
kept as (select rid, string_agg(case when e is null then substr(x, 2 * s + 1) else substr(x, 2 * s + 1, 2 * (e - s)) end, '' order by k) y from gaps join d using (rid) group by 1),
gone as (select rid, count(*) n_spans, sum(b - a) n_removed from spans group by 1)
select doc_id, n::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(y, x))) kept_sha256
from d left join kept using (rid) left join gone using (rid)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _places(kind: str, number: int, pattern: str, keep: str) -> str:
    """SQL of (rid, s, k, e, kind, m): matches of a pattern by their places."""
    return f"""select rid, s, {number} k, s + length(m) e, '{kind}' kind, m from (
  select rid, m, sum(length(gap) + length(m)) over (partition by rid order by i) - length(m) s from (
    select rid, unnest(found) m, unnest(gaps[:len(found)]) gap, unnest(range(len(found))) i from (
      select rid, regexp_extract_all(t, {_quoted(pattern)}) found, string_split_regex(t, {_quoted(pattern)}) gaps from d))) where {keep}"""


_assign = secret_scan.ASSIGN
SECRETS = rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
base as ({_places("assign", 0, _assign, f"length(regexp_extract(m, {_quoted(_assign)}, 2)) >= 8")}
  union all {_places("access", 1, secret_scan.ACCESS, "length(m) >= 16")}
  union all {_places("hex", 2, secret_scan.HEX, "true")}),
cand as ({_places("entropy", 3, secret_scan.CANDIDATE, f"not regexp_matches(m, {_quoted(secret_scan.ALLOWED)})")}),
least as (select rid, s, m, case when not regexp_matches(m, '[0-9]') then case when 3 * length(regexp_replace(m, '[^AEIOUaeiou]', '', 'g')) >= length(regexp_replace(m, '[^A-Za-z]', '', 'g')) then {secret_scan.BITS["words"]} else {secret_scan.BITS["letters"]} end
  when regexp_full_match(m, '[0-9a-f]+|[0-9A-F]+') then {secret_scan.BITS["hex"]} when regexp_full_match(m, '[A-Za-z0-9]+') then {secret_scan.BITS["alnum"]} else {secret_scan.BITS["base64"]} end::double bits from cand),
win as (select rid, s, bits, p, unnest(string_split(substr(m, p + 1, 20), '')) c from (select rid, s, m, bits, unnest(range(length(m) - 19)) p from least)),
ent as (select rid, s, bits, p, log2(20) - sum(n * log2(n)) / 20 h from (select rid, s, bits, p, c, count(*)::double n from win group by all) group by all),
high as (select rid, s + min(p) s, 3 k, s + max(p) + 20 e, 'entropy' kind from ent where h >= bits - 1e-9 group by rid, ent.s),
every as (select rid, s, k, e, kind from base union all select * from high),
said as (select rid, string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) spans, coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) filter (k < 3), '') b,
  count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex from every group by 1)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans
from d left join said using (rid)
"""

DIVERGENCE = r"""
with d as (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ws from documents),
t as (select rid, lang, source, unnest(ws) w from d),
kept as (select lang, w from t group by 1, 2 having count(distinct rid) >= 10),
v as (select lang, count(*) v from kept group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, w, count(*) n from t join kept using (lang, w) group by 1, 2, 3),
a as (select g.lang, g.source, k.w, coalesce(c.n, 0) n from g join kept k using (lang) left join c using (lang, source, w)),
total as (select lang, source, sum(n) s from a group by 1, 2),
p as (select lang, source, w, n, 1 + (1000000000::hugeint * (n + 2)) // (s + 2 * v)::hugeint p from a join total using (lang, source) join v using (lang)),
e as (select lang, w, sum(n) n from a group by 1, 2),
q as (select lang, w, 1 + (1000000000::hugeint * (n + 2)::hugeint) // ((select sum(n) from e f where f.lang = e.lang) + 2 * v)::hugeint q from e join v using (lang)),
pairs as (select x.lang, x.source, y.source item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) f from p x join p y using (lang, w) where x.source <> y.source group by 1, 2, 3),
found as (
  select x.lang, x.source, 'pair' part, y.source item, coalesce(f, 0)::bigint value from g x join g y on x.lang = y.lang and x.source <> y.source left join pairs z on z.lang = x.lang and z.source = x.source and z.item = y.source
  union all
  select lang, source, 'term', w, ((p - q) * (p - q) // (p + q))::bigint from p join q using (lang, w) where n > 0 and p > q)
select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int "rank" from found)
where part = 'pair' or "rank" <= 10
"""


def clustering(k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256) -> str:
    """Rounds of centroid clustering, one CTE after the other, on rows of components."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
s{r} as (select rid, arg_min(c, (d, c)) c, min(d) d from (select rid, c, sum((v.x - m.x) * (v.x - m.x)) d from v join m{r} m using (i) group by 1, 2) group by 1)""")
        if r < rounds:
            steps.append(f"""
m{r + 1} as (select m.c, i, coalesce(n.x, m.x) x from m{r} m left join (select c, i, ((s - ((s % n) + n) % n) // n)::bigint x from (select c, i, sum(x)::hugeint s, count(*)::hugeint n from v join s{r} using (rid) group by 1, 2)) n using (c, i))""")
    return f"""
with e as (select row_number() over () rid, vec_id, embedding from embeddings where len(embedding) = {size}
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
v as (select rid, generate_subscripts(embedding, 1) i, floor({scale} * unnest(embedding)::double)::bigint x from e),
m0 as (select c, i, x from v join (select rid, row_number() over (order by sha256('{seed}:' || coalesce(vec_id::varchar, '')), embedding) - 1 c from e) using (rid) where c < {k}),{",".join(steps)},
h as (select c, sha256(string_agg(x::varchar, ',' order by i)) h from m{rounds} group by 1)
select vec_id, c::int "cluster", d::bigint distance, (sum(d) over (partition by c))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, h centroid_sha256
from e join s{rounds} using (rid) join h using (c)
"""


SQL: dict[str, str] = {
    "op1_chat_formatting": chat.SQL,
    "op2_benchmark_decontamination": decontaminate.SQL,
    "op3_secret_scans": SECRETS,
    "op4_fm_index_dedup": WINDOWS,
    "op5_suffix_array_dedup": BYTES,
    "op7_ngram_jaccard_join": NEAR_COPIES,
    "op8_line_quality_rules": LINE_RULES,
    "op12_source_divergence": DIVERGENCE,
    "op13_centroid_clustering": clustering(),
}
