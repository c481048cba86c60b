"""DuckDB SQL of the corpus queries, by plain means: pairs, recursion and whole-table joins."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
with d as (
  select doc_id, row_number() over () as r,
    coalesce(regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) as w
  from documents),
b as (
  select item_id, regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
win as (
  select distinct item_id, w[s:s + least(13, len(w)) - 1] as g, least(13, len(w)) as l
  from b, lateral (select unnest(range(1, len(w) - least(13, len(w)) + 2)) as s) where len(w) > 0),
sizes as (select distinct l from win),
grams as (
  select r, s, l, w[s:s + l - 1] as g
  from d, sizes, lateral (select unnest(range(1, len(w) - l + 2)) as s) where len(w) >= l),
hits as (select distinct r, s, grams.l, item_id from grams join win on grams.g = win.g and grams.l = win.l),
hit_words as (select r, count(distinct p) as n from hits, lateral (select unnest(range(s, s + l)) as p) group by r),
hit_items as (select r, count(*) as n, string_agg(i, ',' order by i) as names
  from (select distinct r, cast(item_id as varchar) as i from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hw.n, 0) as bigint) as n_hit,
  cast(coalesce(hi.n, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(hw.n, 0) > 0 and 20 * coalesce(hw.n, 0) >= len(w) as contaminated
from d left join hit_words hw using (r) left join hit_items hi using (r)
"""

# Every pair with a common shingle is compared; the classes of equal sets stand for their copies.
NEAR_DUPLICATES = rf"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all({LOWER.format('text')}, '[^\x20\x09-\x0D]+'), []::varchar[]) as w from documents),
s as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end)) as g from d),
c as (select min(doc_id) as id, g, len(g) as n from s where len(g) > 0 group by g),
e as (select id, n, unnest(g) as h from c),
p as (select x.id as a, y.id as b, x.n as na, y.n as nb, count(*) as i from e x join e y on x.h = y.h and x.id < y.id group by all),
links as (select a, b from p where 100 * i >= 80 * (na + nb - i)),
both_ways as (select a, b from links union select b, a from links),
reach(id, r) as (select id, id from c union select reach.id, both_ways.b from reach join both_ways on reach.r = both_ways.a),
comp as (select id, min(r) as component_id from reach group by id)
select s.doc_id, cast(len(s.g) as bigint) as n_shingles, coalesce(comp.component_id, s.doc_id) as component_id,
  s.doc_id = coalesce(comp.component_id, s.doc_id) as kept
from s left join c on s.g = c.g left join comp on comp.id = c.id
"""

# Runs along the diagonals of all pairs of equal lines.
LINE_DEDUP = r"""
with d as (select doc_id, text, row_number() over (order by doc_id nulls last, text) as dn, string_split(text, chr(10)) as ls from documents),
l as (select dn, unnest(ls) as s, unnest(range(0, len(ls))) as p from d where text is not null),
w as (select *, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) as n from l),
eq as (select a.dn as da, a.p as pa, b.dn as db, b.p as pb from l a join l b on a.s = b.s and (b.dn < a.dn or b.dn = a.dn and b.p < a.p)),
diag as (select *, pa - row_number() over (partition by da, db, pa - pb order by pa) as island from eq),
runs as (select da, pa, max(pa) over (partition by da, db, pa - pb, island) as hi from diag),
best as (select da as dn, pa as lo, max(hi) as hi from runs group by da, pa),
heavy as (select best.dn, lo, hi from best join w on w.dn = best.dn and w.p between lo and hi group by best.dn, lo, hi having sum(n) >= 50),
gone as (select distinct w.dn, w.p from w join heavy on w.dn = heavy.dn and w.p between lo and hi),
kept as (select w.dn, string_agg(s, chr(10) order by w.p) as t from w anti join gone on w.dn = gone.dn and w.p = gone.p group by w.dn),
lost as (select dn, count(*) as n from gone group by dn)
select doc_id, cast(coalesce(len(ls), 0) as bigint) as n_lines, cast(coalesce(lost.n, 0) as bigint) as n_deleted,
  md5(case when text is null then null else coalesce(t, '') end) as text_md5
from d left join kept using (dn) left join lost using (dn)
"""

# Halvings as a recursion over the list of shares, then one running sum for each source and epoch.
MIXING = r"""
with recursive t as (
  select doc_id, coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) + 1 as n, md5(coalesce(text, '')) as h from documents),
s as (select source, sum(n) as tokens from t group by source),
g as (select sum(tokens) as total, count(*) as k from s),
l as (select list(cast(tokens as double) / total) as ps, any_value(k) as k, any_value(total) as total from s, g),
e(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double union all
  select i + 1, case when up then m else lo end, case when up then hi else m end from (
    select i, lo, hi, m, ln(z) - m * list_sum(list_transform(ps, lambda p: pow(p, m) * ln(p))) / z >= 0.99 * ln(k) as up from (
      select i, lo, hi, (lo + hi) / 2 as m, ps, k, list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) as z from e, l where i < 40))),
r(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double union all
  select i + 1, case when up then m else lo end, case when up then hi else m end from (
    select i, lo, hi, m, list_max(list_transform(ps, lambda p: pow(p, m) / p)) / z > 4 as up from (
      select i, lo, hi, (lo + hi) / 2 as m, ps, list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) as z from r, l where i < 40))),
a as (select round(greatest((select max(lo) from e), (select min(hi) from r)), 9) as x),
z as (select list_sum(list_transform(ps, lambda p: pow(p, x))) as z from l, a),
plan as (
  select source, cast(tokens as bigint) as tokens, cast(total as bigint) as total,
    cast(floor(round(pow(cast(tokens as double) / total, x) / z, 9) * total + 0.5) as bigint) as wanted from s, g, a, z),
ex as (
  select t.*, tokens, wanted, total, epoch, md5(concat_ws('|', 'order', 1, epoch, coalesce(cast(doc_id as varchar), ''), h)) as key
  from (select *, unnest(range(0, cast(wanted // tokens as bigint) + 1)) as epoch from plan) join t using (source)),
placed as (
  select *, sum(n) over (partition by source, epoch order by key, doc_id, n rows unbounded preceding) - n as start, greatest(1, ceil(total / 262144.0)) as blocks from ex),
cut as (
  select *, cast(least(blocks - 1, floor(cast(epoch * tokens + start as double) * cast(blocks as double) / wanted)) as bigint) as block
  from placed where epoch < wanted // tokens or start < wanted % tokens)
select doc_id, source, cast(n as bigint) as n_tokens, cast(epoch as bigint) as epoch, block,
  row_number() over (partition by block order by md5(concat_ws('|', 'block', 1, epoch, coalesce(cast(doc_id as varchar), ''), h)), doc_id, source, n) as position
from cut
"""

# The same bins, counted by list functions; windows by joining each text with itself.
QUALITY = r"""
with d as (
  select row_number() over () as r, doc_id, lang, source, text,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::varchar[]) as w,
    list_filter(coalesce(string_split(text, chr(10)), []::varchar[]), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
win as (select r, s, w[s:s + 4] as g from (select r, w, unnest(range(1, len(w) - 3)) as s from d where len(w) > 4)),
twice as (select r, g from win group by r, g having count(*) > 1),
rep as (select r, count(distinct p) as n from (select r, unnest(range(s, s + 5)) as p from win join twice using (r, g)) group by r),
f as (
  select d.*, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) as n_symbols, coalesce(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')), 0) as n_upper,
    len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
  from d left join rep using (r)),
v as (
  select *, 1000 * n_symbols // greatest(word_chars, 1) as symbol_rate, 1000 * n_dup_lines // greatest(n_lines, 1) as dup_line_rate,
    1000 * n_repeat_words // greatest(n_words, 1) as repeat_rate, 1000 * n_upper // greatest(word_chars, 1) as upper_rate, 100 * word_chars // greatest(n_words, 1) as word_length from f),
long as (
  select r, lang, source, rate, value from v unpivot (value for rate in (symbol_rate, dup_line_rate, repeat_rate, upper_rate, word_length))),
low as (select *, case when value < 64 then value else (value >> (length(bin(value)) - 7)) << (length(bin(value)) - 7) end as b from long),
q0 as (select lang, source, rate, count(*) as n, quantile_disc(b, 0.25) as q1, quantile_disc(b, 0.75) as q3 from low group by all),
q1 as (select lang, rate, count(*) as n, quantile_disc(b, 0.25) as q1, quantile_disc(b, 0.75) as q3 from low group by all),
q2 as (select rate, quantile_disc(b, 0.25) as q1, quantile_disc(b, 0.75) as q3 from low group by all),
slack(rate, s) as (values ('symbol_rate', 20), ('dup_line_rate', 100), ('repeat_rate', 50), ('upper_rate', 60), ('word_length', 60)),
lim as (
  select q0.lang, q0.source, q0.rate, s, case when q0.n >= 200 then q0.q1 when q1.n >= 200 then q1.q1 else q2.q1 end as a,
    case when q0.n >= 200 then q0.q3 when q1.n >= 200 then q1.q3 else q2.q3 end as b
  from q0 join q1 on q0.lang is not distinct from q1.lang and q0.rate = q1.rate join q2 on q2.rate = q0.rate join slack on slack.rate = q0.rate),
bad as (
  select low.r, string_agg(low.rate, ',' order by list_position(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'upper_rate', 'word_length'], low.rate)) as failed
  from low join lim on low.lang is not distinct from lim.lang and low.source is not distinct from lim.source and low.rate = lim.rate
  where value > lim.b + 3 * greatest(lim.b - lim.a, s) or low.rate = 'word_length' and value < lim.a - 3 * greatest(lim.b - lim.a, s)
  group by low.r)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, coalesce(failed, '') as failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and failed is null as kept
from v left join bad using (r)
"""

# Every url against every rule.
URL_RULES = rf"""
with u as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end as rest from pages),
h as (
  select page_id, {LOWER.format("regexp_extract(coalesce(rest, ''), '^[^/?#]*')")} as host,
    regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') as path from u),
rules(host, path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (
  select h.*, rules.host || rules.path as rule, rules.verdict as v,
    row_number() over (partition by page_id order by length(rules.host) + length(rules.path) desc nulls last, length(rules.host) desc) as k
  from h left join rules on (h.host = rules.host or h.host like '%.' || rules.host) and starts_with(h.path, rules.path))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where k = 1
"""

# Record against record, without trees.
FIXITY = r"""
with p as (
  select 'part-' || lpad(cast(page_id // 256 as varchar), 8, '0') || '.warc' as file, page_id,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as payload
  from pages),
r as (select *, cast(coalesce(sum(strlen(payload)) over (partition by file order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as off from p),
a as (select distinct file, off, sha256('+' || payload) as hash from r),
b as (
  select distinct file, off, sha256('+' || case when page_id % 101 = 7 then left(payload, 19) || 'X' || substr(payload, 21) else payload end) as hash from r where page_id % 97 <> 11
  union select file, off + 1, sha256('+' || payload) from r where page_id % 499 = 3),
oa as (select * from a except select * from b),
ob as (select * from b except select * from a)
select coalesce(oa.file, ob.file) as file, coalesce(oa.off, ob.off) as "offset",
  case when ob.hash is null then 'missing' when oa.hash is null then 'extra' else 'changed' end as kind, oa.hash as hash_first, ob.hash as hash_second
from oa full join ob on oa.file = ob.file and oa.off = ob.off
"""

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body, length(COALESCE(text, '')) AS size FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, COUNT(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER same = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW same AS (PARTITION BY body ORDER BY size DESC, doc_id NULLS LAST)
"""


def crc32(text: str) -> str:
    """CRC-32 of a text expression, bit by bit; DuckDB has no function for it."""
    step = "list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda t: CAST(ascii(t) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {step}), 4294967295::BIGINT)"


# Equal words of a text at every distance, their islands, and of islands with the same ends the least distance.
PERIODIC_RUNS = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {crc32("COALESCE(CAST(doc_id AS VARCHAR), '')")} AS h FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN doc_id IS NOT NULL AND h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
x AS (SELECT r, doc_id, n, unnest(range(0, n)) AS i, unnest(CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END) AS word FROM p),
e AS (SELECT x.r, x.i - y.i AS q, x.i FROM x JOIN x AS y ON x.r = y.r AND x.word = y.word AND y.i < x.i AND (x.i - y.i) * 4 <= x.n),
f AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
s AS (SELECT r, MIN(i) - q AS start, COUNT(*) + q AS length, q FROM f GROUP BY r, q, island HAVING COUNT(*) + q >= GREATEST(6, 4 * q)),
runs AS (SELECT r, start, length, MIN(q) AS period FROM s GROUP BY ALL),
g AS (SELECT r, COUNT(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
k AS (SELECT x.r, string_agg(x.word, ' ' ORDER BY x.i) AS text FROM x ANTI JOIN (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs) d ON x.r = d.r AND x.i = d.i GROUP BY x.r)
SELECT doc_id, COALESCE(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(COALESCE(lines, '')) AS runs_sha256, sha256(COALESCE(k.text, '')) AS collapsed_sha256
FROM t LEFT JOIN g USING (r) LEFT JOIN top USING (r) LEFT JOIN k USING (r)
"""


def plus(v: str, cost: str, letter: str) -> str:
    """A path's six-digit cost and its letters with one more edit; such texts compare by cost, then letters."""
    return f"(lpad(CAST(CAST(substr({v}, 1, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || substr({v}, 7) || '{letter}')"


# The cheapest path to each of four states (none, system, user, assistant), row after row.
_LIVE, _CUT = "fault IS NULL OR fault = 'truncated'", "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END"
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE
k AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
  {crc32("COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations),
d AS (SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
f AS (SELECT *, lag(r) OVER (PARTITION BY c ORDER BY i) || r AS pair,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM o),
sums AS (SELECT c, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'blank') AS blank, COUNT(*) FILTER (fault = 'duplicate') AS duplicate,
  COUNT(*) FILTER (fault = 'truncated') AS truncated, COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
dp AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, '000000' AS n, CAST(NULL AS VARCHAR) AS s, '000002I' AS u, '000004II' AS a FROM k
  UNION ALL
  SELECT c, i, n, s, u, LEAST(a, {plus("u", "2", "I")}) FROM (
    SELECT c, i, n, s, LEAST(u, {plus("n", "2", "I")}, {plus("s", "2", "I")}, {plus("a", "2", "I")}) AS u, a FROM (
      SELECT c, f.i AS i, {plus("n", "3", "D")} AS n, LEAST({plus("s", "3", "D")}, CASE WHEN ({_LIVE}) AND r = 's' THEN {plus("n", _CUT, "K")} END) AS s,
        LEAST({plus("u", "3", "D")}, CASE WHEN ({_LIVE}) AND r = 'u' THEN LEAST({plus("n", _CUT, "K")}, {plus("s", _CUT, "K")}, {plus("a", _CUT, "K")})
          WHEN {_LIVE} THEN LEAST({plus("n", f"2 + {_CUT}", "R")}, {plus("s", f"2 + {_CUT}", "R")}, {plus("a", f"2 + {_CUT}", "R")}) END) AS u,
        LEAST({plus("a", "3", "D")}, CASE WHEN ({_LIVE}) AND r = 'a' THEN {plus("u", _CUT, "K")} WHEN {_LIVE} THEN {plus("u", f"2 + {_CUT}", "R")} END) AS a
      FROM (SELECT dp.c, dp.n, dp.s, dp.u, dp.a, f.i, f.r, f.fault FROM dp JOIN f ON f.c = dp.c AND f.i = dp.i + 1) f))),
best AS (SELECT c, CAST(substr(LEAST(n, a), 1, 6) AS BIGINT) AS cost, substr(LEAST(n, a), 7) AS audit FROM dp QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1),
e AS (SELECT c, unnest(range(1, length(audit) + 1)) AS j, substr(audit, j, 1) AS x, j - length(regexp_replace(left(audit, j), '[^I]', '', 'g')) AS i FROM best),
w AS (SELECT e.c, e.j, e.x, f.role, f.text, x = 'K' AND f.r = 's' AS sys FROM e LEFT JOIN f ON f.c = e.c AND f.i = e.i AND e.x <> 'I' WHERE e.x <> 'D'),
z AS (SELECT c, j, CASE WHEN x = 'K' THEN role WHEN COUNT(*) FILTER (NOT COALESCE(sys, FALSE)) OVER (PARTITION BY c ORDER BY j) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END AS line FROM w),
t AS (SELECT c, string_agg(line, chr(10) ORDER BY j) AS text FROM z GROUP BY c)
SELECT conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal,
  cost, audit, sha256(COALESCE(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM k) JOIN best USING (c) LEFT JOIN sums USING (c) LEFT JOIN t USING (c)
"""
