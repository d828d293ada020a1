"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from lisura.llm.common import LOWER, UPPER
from lisura.llm.decontamination import MASKS, SHORT, SPAN, WHOLE
from lisura.llm.filter_audit import CAPITAL_PERCENT, DISTINCT_PERCENT, MIN_WORDS, SYMBOLS
from lisura.llm.manifest import FIELDS
from lisura.llm.secrets import BASE, KINDS, SCOPE

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"

OP1 = f"""
with recursive d as (select doc_id, {WORDS} as w from documents),
s as (select distinct doc_id, unnest(case
        when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle from d),
n as (select doc_id, count(*) as n from s group by 1),
both_have as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from both_have join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
ways as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, w.y from reach r join ways w on w.x = r.other)
select r.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(other) as component_id
from reach r left join n on n.doc_id = r.doc_id group by r.doc_id"""

OP2 = """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
ok as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
       and len(list_filter(e, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
      from ok q join ok c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20"""


def _any_case(pattern: str) -> str:
    """The pattern with ASCII letters in either case, instead of a flag that folds other letters too."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() and c.islower() else c for c in pattern)


def _kind_sql(at: int, kind: str) -> str:
    pattern, group, least, most = KINDS[kind]
    if pattern.startswith("(?i)"):
        # Only the names in the first group are words; classes and escapes stay.
        first, rest = pattern[4:].split(")", 1)
        names = first[1:] if "[" not in first else first[1:].replace("[a-z0-9]+", "\0")
        pattern = "(" + _any_case(names).replace("\0", "[A-Za-z0-9]+") + ")" + rest
    p = pattern.replace("'", "''")
    extra = f" and length(v) <= {most} and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[0-9]')" if most else ""
    return f"""
select doc_id, {at} as kind, stop - n as start, stop from (
  select doc_id, v, n, sum(gap + n) over (partition by doc_id order by i) as stop from (
    select doc_id, i, length(gaps[i]) as gap, length(whole[i]) as n, parts[i] as v from (
      select doc_id, string_split_regex(text, '{p}') as gaps, regexp_extract_all(text, '{p}', 0) as whole,
             regexp_extract_all(text, '{p}', {group}) as parts, unnest(range(1, len(regexp_extract_all(text, '{p}', 0)) + 1)) as i
      from t)))
where length(v) >= {least}{extra}"""


_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_AT = {k: i for i, k in enumerate(KINDS)}


def _near(kinds: tuple[str, ...], gap: int) -> str:
    listed = ", ".join(str(_AT[k]) for k in kinds)
    return f"""exists (select 1 from parts o where o.doc_id = p.doc_id and o.kind in ({listed})
  and o.start < p.stop + {gap} and p.start < o.stop + {gap})"""


OP5 = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
every as ({" union all ".join(_kind_sql(i, k) for i, k in enumerate(KINDS))}),
parts as (select * from every p where kind < {len(BASE)} or not exists (
  select 1 from every o where o.doc_id = p.doc_id and o.kind < {len(BASE)} and o.start < p.stop and p.start < o.stop)),
linked as (select *, kind < {len(BASE)}
    or kind = {_AT["user"]} and {_near(("assign", "key"), SCOPE)}
    or kind = {_AT["key"]} and {_near(("access", "user"), SCOPE)}
    or kind = {_AT["endpoint"]} and {_near(("access", "user"), SCOPE)} and {_near(("assign", "key"), SCOPE)} as keep from parts p),
spans as (select doc_id, kind, start, stop, concat_ws(':', {_NAMES}[kind + 1], start, stop) as s from linked where keep),
per_doc as (select doc_id,
  {", ".join(f"count(*) filter (kind = {i}) as n_{k}" for i, k in enumerate(BASE))},
  coalesce(string_agg(s, ',' order by start, kind, stop) filter (kind < {len(BASE)}), '') as base,
  string_agg(s, ',' order by start, kind, stop) as spans from spans group by 1)
select t.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans
from t left join per_doc using (doc_id)"""


def _masked(words: str, at: str, mask: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"{words}[{at} + {i + 1}]" for i, c in enumerate(mask) if c == "1") + ")"


def _plain_words(name: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({name}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


OP6 = f"""
with d as (select doc_id, {_plain_words("text")} as w from documents),
it as (select distinct item_id, {_plain_words("text")} as w from benchmark),
items as (select * from it where len(w) > 0),
dp as (select doc_id, w, unnest(range(0, len(w))) as pos from d),
ip as (select item_id, w, unnest(range(0, len(w) - {SPAN} + 1)) as pos from items where len(w) >= {SHORT}),
ds as ({" union all ".join(f"select *, '{m}' as mask, {_masked('w', 'pos', m)} as seed from dp where pos <= len(w) - {SPAN}" for m in MASKS)}),
ik as ({" union all ".join(f"select *, '{m}' as mask, {_masked('w', 'pos', m)} as seed from ip" for m in MASKS)}),
few as (select item_id, w, unnest(range(0, len(w))) as pos from items where len(w) < {SHORT}),
hits as (
  select ds.doc_id, ds.w, ds.pos - ik.pos as diagonal, ik.item_id, ik.w as iw from ds join ik on ds.mask = ik.mask and ds.seed = ik.seed
  union select dp.doc_id, dp.w, dp.pos - few.pos, few.item_id, few.w from dp join few on dp.w[dp.pos + 1] = few.w[few.pos + 1]),
laid as (select doc_id, item_id, w, iw, row_number() over () as lay, greatest(diagonal, 0) as f, greatest(-diagonal, 0) as g
  from hits where len(iw) >= {WHOLE} or w = iw and diagonal = 0),
flags as (select doc_id, item_id, lay, len(iw) as item_words, k, w[f + k + 1] = iw[g + k + 1] as hit
  from (select *, unnest(range(0, least(len(iw) - g, len(w) - f))) as k from laid)),
sums as (select *, sum(case when hit then 1 else -3 end) over o as s, sum(hit::int) over o as h
  from flags window o as (partition by lay order by k)),
lows as (select *, s <= least(0, coalesce(min(s) over (partition by lay order by k rows between unbounded preceding and 1 preceding), 0)) as low from sums),
runs as (select *, max(k) filter (low) over o as run, s - coalesce(min(s) filter (low) over o, 0) as score,
    h - coalesce(max(h) filter (low) over o, 0) as run_matched, k - coalesce(max(k) filter (low) over o, -1) as run_aligned
  from lows window o as (partition by lay order by k)),
peaks as (select *, row_number() over (partition by lay, run order by score desc, k) as r from runs),
judged as (
  select doc_id, item_id, item_words, run_matched as matched, run_aligned as aligned from peaks where r = 1 and item_words >= 13
  union all select any_value(doc_id), any_value(item_id), any_value(item_words), sum(hit::int), count(*) from flags where item_words < 13 group by lay),
enough as (select * from judged where matched >= 13 or item_words < 13 and 5 * matched >= 4 * item_words)
select doc_id, item_id, item_words::bigint as item_words, max(matched)::bigint as matched,
  arg_max(aligned, matched * 1000000 - aligned)::bigint as aligned
from enough group by 1, 2, 3"""

OP12 = f"""
with recursive t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from t),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
      from labels group by 1),
f as (select part, w.doc_id,
        case when len(words) < {MIN_WORDS} then 'A' else '' end
        || case when 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) then 'B' else '' end
        || case when 100 * (length(text) - length(translate(text, '{UPPER}', ''))) > {CAPITAL_PERCENT} * length(text) then 'C' else '' end
        || case when regexp_matches(text, '{SYMBOLS}') then 'D' else '' end
        || case when coalesce(w.doc_id, 9223372036854775807) > min(w.doc_id) over (partition by text) then 'E' else '' end as failed,
        coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
      from w left join l on l.doc_id = w.doc_id),
c as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select '' as o union all select o || x from orders, letters where instr(o, x) = 0),
whole as (select o as filter_order from orders where length(o) = 5),
steps as (select filter_order, unnest(range(1, 6)) as step from whole),
parts as (select part, sum(n) as total from c group by 1),
gone as (select part, filter_order, n, good, toxic, failed,
           list_min(list_transform(string_split(failed, ''), lambda x: instr(filter_order, x))) as goes_at from c, whole where failed <> ''),
removed as (select part, filter_order, goes_at, sum(n) as n, sum(good) as good, sum(toxic) as toxic from gone group by 1, 2, 3),
r as (select parts.part, steps.filter_order, step, substr(steps.filter_order, step, 1) as x, total,
        coalesce(n, 0) as removed, coalesce(good, 0) as good_lost, coalesce(toxic, 0) as toxic_lost
      from parts cross join steps left join removed on removed.part = parts.part and removed.filter_order = steps.filter_order and goes_at = step),
fails as (select part, x, sum(n) as fails, sum(case when failed = x then n else 0 end) as alone
          from c, letters where instr(failed, x) > 0 group by 1, 2)
select r.part, filter_order, step::int as step,
  (total - sum(removed) over (partition by r.part, filter_order order by step))::bigint as kept, removed::bigint as removed,
  (coalesce(fails, 0) - removed)::bigint as redundant, coalesce(alone, 0)::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  sum(removed) over (partition by r.part, r.x)::bigint as shapley
from r left join fails on fails.part = r.part and fails.x = r.x"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::varchar)::varchar || ':' || {name}::varchar, '-')"


_CRC = """xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda a, z: xor(a >> 1, (a & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295)"""
_LEAF = "sha256(" + " || ".join(map(_field, FIELDS[:-1])) + " || {})"

OP13 = f"""
with recursive d as (select doc_id, lang, {_LEAF.format(_field("text"))} as leaf,
    case when doc_id is not null and {_CRC} % 3 = 0
      then {_LEAF.format(_field(f"translate(text, '{UPPER}', '{LOWER}')"))} end as tampered from documents),
rows as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n,
    row_number() over () as id from d),
lv as (select 0 as level, lang, n, idx, leaf as digest from rows
  union all select level + 1, lang, (max(n) + 7) // 8, idx // 8, sha256(string_agg(digest, '' order by idx)) from lv where n > 1 group by level, lang, idx // 8),
sub as (select lang, digest, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as n from lv where n = 1),
top as (select 0 as level, n, idx, digest from sub
  union all select level + 1, (max(n) + 7) // 8, idx // 8, sha256(string_agg(digest, '' order by idx)) from top where n > 1 group by level, idx // 8),
runs as (select level, lang, idx // 8 as parent, list(digest order by idx) as run from lv where n > 1 group by 1, 2, 3),
top_runs as (select level, idx // 8 as parent, list(digest order by idx) as run from top where n > 1 group by 1, 2),
found as (
  select id, level, run, (idx // (8 ** level)::bigint) % 8 as slot from rows join runs
    on runs.lang is not distinct from rows.lang and parent = idx // (8 ** (level + 1))::bigint
  union all select id, 100 + level, run, (sub.idx // (8 ** level)::bigint) % 8 from rows join sub on sub.lang is not distinct from rows.lang
    join top_runs on parent = sub.idx // (8 ** (level + 1))::bigint),
path as (select id, row_number() over (partition by id order by level) as k,
  array_to_string(run[1:slot], '') as before, array_to_string(run[slot + 2:], '') as after from found),
proof as (select id, string_agg(before || after, '' order by k) as p from path group by 1),
fold as (select id, 0 as k, coalesce(tampered, leaf) as cur from rows
  union all select fold.id, fold.k + 1, sha256(before || cur || after) from fold join path on path.id = fold.id and path.k = fold.k + 1),
ends as (select id, arg_max(cur, k) as folded_root from fold group by 1)
select doc_id, leaf, sub.digest as subroot, top.digest as root, sha256(coalesce(p, '')) as proof_sha256, folded_root,
  folded_root = top.digest as verified
from rows join sub on sub.lang is not distinct from rows.lang join top on top.n = 1 join ends using (id) left join proof using (id)"""

ORACLES = {
    "op1_ngram_jaccard_join": OP1,
    "op2_block_search": OP2,
    "op5_secret_scan": OP5,
    "op6_decontamination": OP6,
    "op12_filter_audit": OP12,
    "op13_merkle_manifest": OP13,
}
