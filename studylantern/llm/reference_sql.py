"""Reference SQL (DuckDB) of the numbered operators that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The table of crc32 by byte, as CTE; and the crc32 of a string expression, given that table as `t`.
CRC_TABLE = "crc as (select list(list_reduce(range(8), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end), i) order by i) as t from range(256) b(i))"


def crc32(text: str) -> str:
    code = f"list_transform(range(octet_length(encode({text}))), lambda j: cast('0x' || substr(hex(encode({text})), 2 * j + 1, 2) as bigint))"
    return f"xor(list_reduce({code}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen(cast({value} as varchar)) || ':' || cast({value} as varchar) end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE = f"""
with recursive {CRC_TABLE},
rows as (select row_number() over () as r, doc_id, source, {_leaf("text")} as leaf,
  case when {crc32("cast(doc_id as varchar)")} % 5 = 0 then {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} else {_leaf("text")} end as claim
  from documents, crc),
leaves as (select *, row_number() over (partition by source order by doc_id nulls first, leaf, r) - 1 as i, count(*) over (partition by source) as n from rows),
nodes(source, level, i, n, h) as (
  select source, 0, i, n, leaf from leaves
  union all
  select source, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by source, level, i // 16, n),
subroots as (select source, h, row_number() over (order by source nulls first) - 1 as i, count(*) over () as n from nodes where n = 1),
tops(level, i, n, h) as (
  select 0, i, n, h from subroots
  union all
  select level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from tops where n > 1 group by level, i // 16, n),
steps as (
  select r, k.level as step, k.i < (l.i >> (4 * k.level)) as before, k.i, k.h
  from leaves l join nodes k on k.source is not distinct from l.source and k.n > 1
    and k.i >> 4 = l.i >> (4 * k.level + 4) and k.i <> l.i >> (4 * k.level)
  union all
  select l.r, 100 + k.level, k.i < (s.i >> (4 * k.level)), k.i, k.h
  from leaves l join subroots s on s.source is not distinct from l.source
  join tops k on k.n > 1 and k.i >> 4 = s.i >> (4 * k.level + 4) and k.i <> s.i >> (4 * k.level)),
levels as (
  select r, step, string_agg(h, '' order by i) as siblings,
    coalesce(string_agg(h, '' order by i) filter (before), '') || '#' || coalesce(string_agg(h, '' order by i) filter (not before), '') as sides
  from steps group by r, step
  union all
  select l.r, k.level, '', '#' from leaves l join nodes k on k.source is not distinct from l.source
    and k.n > 1 and k.n % 16 = 1 and k.i = k.n - 1 and k.i = l.i >> (4 * k.level)
  union all
  select l.r, 100 + k.level, '', '#' from leaves l join subroots s on s.source is not distinct from l.source
  join tops k on k.n > 1 and k.n % 16 = 1 and k.i = k.n - 1 and k.i = s.i >> (4 * k.level)),
ways as (select r, string_agg(siblings, '' order by step) as siblings, list(sides order by step) as sides from levels group by r),
folded as (
  select l.*, coalesce(w.siblings, '') as siblings, (select h from tops where n = 1) as root,
    list_reduce(coalesce(w.sides, []), lambda h, e: sha256(split_part(e, '#', 1) || h || split_part(e, '#', 2)), l.claim) as folded_root
  from leaves l left join ways w using (r))
select f.doc_id, f.leaf, s.h as subroot, f.root, sha256(f.siblings) as proof_sha256, f.folded_root, f.folded_root = f.root as verified
from folded f join subroots s on s.source is not distinct from f.source
"""


def _features(table: str) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    pairs = "list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])"
    return f"select *, len(w) as n_words, list_concat(w, {pairs}) as f from (select *, {words} as w from {table})"


RESAMPLE = f"""
with {CRC_TABLE},
docs as (select row_number() over () as r, doc_id, n_words, f from ({_features("documents")})),
target as ({_features("benchmark")}),
kinds as (select x, {crc32("x")} % 10000 as b from (select distinct x from (select unnest(f) as x from docs union all select unnest(f) from target)), crc),
s as (select b, count(*) as n from (select unnest(f) as x from docs) join kinds using (x) group by b),
t as (select b, count(*) as n from (select unnest(f) as x from target) join kinds using (x) group by b),
sums as (select (select coalesce(sum(n), 0) from s) as s_all, (select coalesce(sum(n), 0) from t) as t_all),
gains as (
  select b, cast(floor(1000 * ln((cast(coalesce(t.n, 0) + 1 as double) * cast(s_all + 10000 as double))
    / (cast(coalesce(s.n, 0) + 1 as double) * cast(t_all + 10000 as double)))) as bigint) as gain
  from (select distinct b from kinds) left join s using (b) left join t using (b), sums),
weights as (
  select r, cast(floor(sum(gain) / count(*)) as bigint) as weight
  from (select r, unnest(f) as x from docs) join kinds using (x) join gains using (b) group by r),
scores as (
  select doc_id, n_words, len(f) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from docs left join weights using (r)),
placed as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last, n_features) as place,
    (select 25 * count(*) // 100 from scores where n_words >= 20) as k
  from scores)
select doc_id, cast(n_features as bigint) as n_features, weight, score, case when n_words >= 20 and place <= k then place end as "rank" from placed
"""

STATEMENTS = {"op11_merkle": MERKLE.strip(), "op13_resample": RESAMPLE.strip()}
