"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import mixing, secret_scan

_SPACE = r"[^\x20\x09-\x0D]+"

_MIX = rf"""
with recursive d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_SPACE}')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from d group by source),
ranked as (select *, row_number() over (order by encode(source) nulls last) - 1 as rnk from per),
weighted as (select *, case rnk % 3 {" ".join(f"when {i} then {w}::double" for i, w in enumerate(mixing.WEIGHTS))} end as weight,
    source_size * {mixing.MOST} as cap, (sum(source_size) over ()) * {mixing.SHARE}::double as budget from ranked),
-- All share by weight; whoever is above its cap stays there and the others share what is left, until nobody is.
pour as (select 0 as turn, max(budget) / sum(weight) as level from weighted
    union all select max(p.turn) + 1, (max(budget) - coalesce(sum(cap) filter (weight * level >= cap), 0)) / sum(weight) filter (weight * level < cap)
    from pour p, weighted having max(p.turn) < (select count(*) from weighted) and count(*) filter (weight * level < cap) > 0),
targets as (select source, rnk, source_size, budget, least(cap::double, weight * (select arg_max(level, turn) from pour)) as target from weighted),
timed as (select d.doc_id, d.size, t.rnk, t.source_size, t.budget, t.target, md5('{mixing.SEED}|' || coalesce(d.doc_id::varchar, '')) as h
    from d join targets t on d.source is not distinct from t.source),
queued as (select *, sum(size) over (partition by rnk order by h, size range between unbounded preceding and current row) as q from timed),
entries as (select q.*, turn, (source_size * turn + q) / target as vft from queued q, (select unnest(range({mixing.MOST})) as turn) where size > 0 and target > 0),
spent as (select *, sum(size) over (order by vft, rnk, h, size, turn range between unbounded preceding and current row) as total from entries),
copies as (select doc_id, rnk, size, h, count(*) filter (total <= budget) as n, count(*) as of_all from spent group by doc_id, rnk, size, h)
select t.doc_id, t.size, t.source_size, t.target,
    (t.size * coalesce(c.n * {mixing.MOST} / c.of_all, 0))::bigint as taken
from timed t left join copies c on c.h = t.h and c.rnk = t.rnk and c.size = t.size
"""


def _spans(kind: str, pattern: str) -> str:
    """Places of all matches of a pattern: what lies between them gives where they are."""
    p = pattern.replace("'", "''")
    return f"""select doc_id, '{kind}' as kind, {secret_scan.KINDS.index(kind)} as rnk, hit, gap_until + coalesce(hit_before, 0) as start,
    gap_until + coalesce(hit_before, 0) + length(hit) as stop, val from (
    select doc_id, i, hits[i] as hit, vals[i] as val,
        sum(length(gaps[i])) over w as gap_until, sum(length(hits[i])) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as hit_before
    from (select doc_id, hits, gaps, vals, unnest(range(1, len(hits) + 1)) as i from (
        select doc_id, regexp_extract_all(t, '{p}') as hits, string_split_regex(t, '{p}') as gaps,
            regexp_extract_all(t, '{p}', {2 if kind == "assign" else 0}) as vals from d))
    window w as (partition by doc_id order by i))"""


def _runs(kind: str, chars: str, needs: tuple[str, ...], threshold: float) -> str:
    """Long runs of a class whose best window is random enough; each window's entropy is taken afresh."""
    w = secret_scan.WINDOW
    # RE2 has no look-behind; a greedy run starts where the class starts anyway.
    spans = _spans(kind, f"[{chars}]{{{w},}}")
    ok = " and ".join([f"regexp_matches(hit, '{n}')" for n in needs] + [f"not regexp_matches(lower(hit), '{a}')" for a in secret_scan.ALLOW])
    best = f"list_max(list_transform(range(1, length(hit) - {w} + 2), lambda i: list_aggregate(string_split(substring(hit, i, {w}), ''), 'entropy')))"
    return f"select * from ({spans}) where {ok} and {best} >= {threshold}"


_SECRETS = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
base as (
    select * from ({_spans("assign", secret_scan.assign_pattern())}) where length(val) >= {secret_scan.ASSIGN_MIN}
    union all {_spans("access", secret_scan.access_pattern())}
    union all {_spans("hex", secret_scan.hex_pattern())}),
runs as ({" union all ".join(_runs(*c) for c in secret_scan.CLASSES)}),
clear as (select * from runs r where not exists (select 1 from base b where b.doc_id = r.doc_id and r.start < b.stop and b.start < r.stop)),
shown as (select doc_id, kind, start::bigint as start, rnk, kind || ':' || start::bigint || ':' || stop::bigint as s, true as is_base from base
    union all select doc_id, kind, start::bigint, rnk, kind || ':' || start::bigint || ':' || stop::bigint, false from clear),
found as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex, coalesce(string_agg(s, ',' order by start, rnk) filter (is_base), '') as b,
    string_agg(s, ',' order by start, rnk) as spans from shown group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans
from d left join found f on f.doc_id = d.doc_id
"""

_JACCARD = rf"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words),
flat as (select doc_id, hash(unnest(s)) as h from sets),
n as (select doc_id, len(s)::bigint as n from sets),
few as (select h from flat group by h having count(*) > 1),
f as (select flat.* from flat semi join few on flat.h = few.h),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as shared from f a join f b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 90 * (a.n + b.n - shared)),
sym as (select x, y from links union select y, x from links),
reach as (select doc_id as x, doc_id as y from documents union select r.x, s.y from reach r join sym s on r.y = s.x)
select n.doc_id, n.n as n_shingles, min(r.y) as component_id from n join reach r on r.x = n.doc_id group by 1, 2
"""

ORACLE = {"op4_ngram_jaccard": _JACCARD, "op3_mix_sources": _MIX, "op8_secret_scan": _SECRETS}
