"""DuckDB SQL for the queries that SQL can express."""

from lamina.llm import quality, secrets, urls


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_RULES = ", ".join(f"({quoted(h)}, {quoted(p)}, {quoted(v)})" for h, p, v in urls.RULES)

OP3 = f"""
with r(rh, rp, rv) as (values {_RULES}),
u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h0 from u),
p as (select page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') as path from h),
f as (select p.*, rh || rp as rule, rv, row_number() over (partition by page_id order by length(rh || rp) desc nulls last) as k from p left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from f where k = 1
"""

_SYMBOLS = "[^#*$%&|<>]+"

OP6 = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, {quoted(WORD)}) as words from d),
x as (select rid, i, array_to_string(words[i:i + 4], ' ') as s from (select rid, words, unnest(range(1, len(words) - 3)) as i from w)),
again as (select rid, count(distinct k) as n from (select rid, unnest(range(i, i + 5)) as k from (select rid, i, count(*) over (partition by rid, s) as c from x) where c > 1) group by 1),
lines as (select rid, line, length(regexp_replace(line, {quoted(SPACE + '+')}, '', 'g')) as size, len(regexp_extract_all(line, {quoted(WORD)})) as n,
  length(regexp_replace(line, {quoted(_SYMBOLS)}, '', 'g')) as symbols, length(regexp_replace(line, '[^\\p{{L}}]+', '', 'g')) as letters, length(regexp_replace(line, '[^\\p{{Lu}}]+', '', 'g')) as upper_letters
  from (select rid, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, {quoted('[^' + SPACE[1:])})),
judged as (select *, symbols * 100 > 15 * size or len(regexp_extract_all(line, '\\|')) * 3 >= n or (letters >= 8 and upper_letters * 10 > 7 * letters and contains(line, '!!'))
  or (length(line) < 120 and regexp_matches(lower(line), {quoted(quality.BOILERPLATE)})) or not regexp_matches(regexp_replace(line, {quoted(SPACE + '+$')}, ''), '[.!?:;,"''”’»)\\]…。！？]$') as gone from lines),
sums as (select rid, sum(size) as word_chars, count(*) - count(distinct line) as n_dup_lines, count(*) filter (where gone) as n_lines_removed, coalesce(sum(size) filter (where gone), 0) as lost_chars from judged group by 1),
s as (select d.doc_id, len(words) as n_words, coalesce(word_chars, 0) as word_chars, length(regexp_replace(text, {quoted(_SYMBOLS)}, '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(again.n, 0) as n_repeat_words,
  coalesce(n_lines_removed, 0) as n_lines_removed, coalesce(lost_chars, 0) as lost_chars from d join w using (rid) left join sums using (rid) left join again using (rid))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) and lost_chars * 100 <= word_chars * {quality.MAX_LOST_PERCENT} as kept,
  n_lines_removed::bigint as n_lines_removed, lost_chars::bigint as lost_chars from s
"""

OP5 = f"""
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {quoted(WORD)}) as w from documents),
g as (select distinct rid, array_to_string(w[i:i + 2], ' ') as s from (select rid, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
n as (select rid, count(*) as n from g group by 1),
pairs as (select a.rid as a, b.rid as b, count(*) as c from g a join g b on a.s = b.s and a.rid < b.rid group by 1, 2),
links as (select a, b from pairs join n x on x.rid = a join n y on y.rid = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from links union all select b, a from links),
reach(a, b) as (select rid, rid from d union select reach.a, e.b from reach join e on e.a = reach.b),
least as (select reach.a as rid, min(d.doc_id) as component_id from reach join d on d.rid = reach.b group by 1),
fingerprints as (select rid, string_agg(s, chr(10) order by s) as f from g group by 1),
equal as (select rid, count(*) over (partition by f) as n_equal from fingerprints)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, coalesce(n_equal, 1) as n_equal from d left join n using (rid) join least using (rid) left join equal using (rid)
"""


def _found(pattern: str, rank: int, keep: str = "true") -> str:
    """Rows of start, rank and end of the matches of a pattern, by the lengths of what lies between and of the matches."""
    p = quoted(pattern)
    return f"""select rid, s, k, e, hit from (select rid, text, pos + length(piece) as s, {rank} as k, pos + length(piece) + length(hit) as e, hit from (
select rid, text, piece, hit, coalesce(sum(length(piece) + length(hit)) over (partition by rid order by i rows between unbounded preceding and 1 preceding), 0) as pos
from (select rid, text, unnest(range(1, len(hits) + 1)) as i, unnest(hits) as hit, unnest(pieces[1:len(hits)]) as piece from (select rid, text, regexp_extract_all(text, {p}) as hits, string_split_regex(text, {p}) as pieces from d where regexp_matches(text, {p}))))) where {keep}"""


_START = r"\b"
_RUN = "[A-Za-z0-9+/_-]+=*"
_KEY = "regexp_full_match(hit, '[A-Za-z0-9+/_-]{32,}={0,2}') and regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[A-Z]') and not regexp_matches(substr(text, (e + 1)::bigint, 1), '[A-Za-z0-9+/_-]')"
_NEAR = f"x.rid = y.rid and x.s - y.e <= {secrets.SCOPE} and y.s - x.e <= {secrets.SCOPE}"
_NAMES = " ".join(f"when {k} then {quoted(n)}" for k, n in enumerate(secrets.KINDS))

OP2 = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
base as ({_found(secrets.ASSIGN, 0, f"length(regexp_extract(hit, {quoted(secrets.ASSIGN)}, 1)) >= 6")} union all {_found(secrets.ACCESS, 1, "length(hit) >= 20")} union all {_found(secrets.HEX, 2)}),
ids as (select * from ({_found(secrets.WEAK_ID.replace(secrets.BOUNDARY, _START), 3)}) x where not exists (select 1 from base b where b.rid = x.rid and x.s < b.e and b.s < x.e)),
keys as (select * from ({_found(_RUN, 4, _KEY)}) x where not exists (select 1 from base b where b.rid = x.rid and x.s < b.e and b.s < x.e)),
ends as ({_found(secrets.ENDPOINT.replace(secrets.BOUNDARY, _START), 5)}),
near_ids as (select * from ids x where exists (select 1 from (select * from base where k <> 1 union all select * from keys) y where {_NEAR})),
near_keys as (select * from keys x where exists (select 1 from (select * from base where k = 1 union all select * from ids) y where {_NEAR})),
linked_keys as (select * from keys x where exists (select 1 from ids y where {_NEAR})),
near_ends as (select * from ends x where exists (select 1 from (select * from base union all select * from linked_keys) y where {_NEAR})),
spans as (select distinct rid, s, k, e from (select * from base union all select * from near_ids union all select * from near_keys union all select * from near_ends)),
told as (select rid, string_agg(case k {_NAMES} end || ':' || s::bigint || ':' || e::bigint, ',' order by s, k, e) as spans,
  coalesce(string_agg(case k {_NAMES} end || ':' || s::bigint || ':' || e::bigint, ',' order by s, k, e) filter (where k < 3), '') as base,
  count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex from spans group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join told using (rid)
"""

ORACLE: dict[str, str] = {"op2_secret_scan": OP2, "op3_url_filter": OP3, "op5_ngram_jaccard": OP5, "op6_quality_rules": OP6}
