"""Oracle SQL of the core queries, for DuckDB over the same tables.

Times are compared as microseconds, so no result depends on a session's time zone.
"""

from __future__ import annotations

NOW = 1709251200000000  # 2024-03-01 00:00:00 UTC
DAY = 86400000000

#: Sum of 1 / (c + 2 + i) for i below n.
_H = "coalesce(list_sum(list_transform(range(cast({n} as bigint)), lambda i: 1.0::double / ({c} + 2 + i))), 0.0)"
_OK = "embedding is not null and embedding_model is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_ACTIVE = f"embedding is not null and not coalesce(archived, false) and (expires_at is null or epoch_us(expires_at) > {NOW})"
_STATUS = "case when temporal_anchor_start is null then null when date '2024-03-01' < temporal_anchor_start then 'upcoming' when date '2024-03-01' > coalesce(temporal_anchor_end, temporal_anchor_start) then 'past' else 'current' end"
_RECENCY = f"case when last_accessed is null then 0.0 else greatest(0.0, 1.0 - floor(({NOW} - epoch_us(last_accessed)) / {DAY}.0) / 60.0) end"
_EVENTS = "ev as (select * exclude (_n) from (select *, row_number() over (partition by id order by attributed_at desc nulls last, created_at) as _n from recall_events) where _n = 1)"
_LOG = "lg as (select * from memory_links where from_id is not null and to_id is not null and from_id <> to_id)"
_EDGES = f"{_LOG}, e as (select from_id, to_id, link_type, {_H.format(n='count(*)', c='0')} as strength, count(*) as hop_count, max(epoch_us(created_at)) as last_walked from lg group by all)"
_CASES = (
    "live as (select * from memories where not coalesce(archived, false) and embedding is not null), "
    "cases as (select distinct c.id as query_id, c.cited as expected from (select id, unnest(list_transform(regexp_extract_all(coalesce(body, ''), '\\[\\[(\\d+)\\]\\]', 1), lambda x: try_cast(x as bigint))) as cited from live) c join live t on t.id = c.cited where c.id <> c.cited)"
)


_MENTIONS = (
    "terms as (select term, canonical from (select *, row_number() over (partition by term order by turn, canonical) as n from (select lower(slug) as term, slug as canonical, 0 as turn from projects union all select lower(display_name), slug, 1 from projects union all select lower(alias), canonical, 2 from project_aliases) where length(term) >= 3) where n = 1), "
    "texts as (select id, project, lower(coalesce(subject, '') || ' ' || coalesce(body, '')) as text from memories), "
    "ment as (select distinct id, canonical from (select id, text, term, canonical from texts join terms on contains(text, term)) where regexp_matches(text, '(^|[^a-z0-9])' || regexp_escape(term) || '([^a-z0-9]|$)'))"
)


def _pool(k: int, pool: str = "true", asked: str = "id % 20 = 0", skip: bool = False) -> str:
    """CTEs q (usable queries), r (usable candidates), pool (the k most similar)."""
    own = "and r.id <> q.query_id" if skip else ""
    return (
        f"q as (select id as query_id, embedding_model as em, embedding::double[] as v from memories where {_OK} and {asked}), "
        f"r as (select id, embedding_model as em, embedding::double[] as v from memories where {_OK} and {_ACTIVE} and {pool}), "
        f"near as (select query_id, r.id, round(list_cosine_similarity(q.v, r.v), 9) as cosine from q join r on q.em = r.em and len(q.v) = len(r.v) {own}), "
        f"pool as (select query_id, id, cosine, pos from (select *, row_number() over (partition by query_id order by cosine desc, id) as pos from near) where pos <= {k})"
    )


def _scored(use: float = 0.1, temporal: bool = True, supersession: bool = True, success: float = 0.0, by: str = "rank", pool: str = "pool", name: str = "scored") -> str:
    w = "coalesce(m.weight, 0.0)"
    norm = {
        "rank": f"(rank() over (partition by query_id order by {w}) - 1 + (count(*) over (partition by query_id, {w}) - 1) / 2.0) / greatest(count(*) over (partition by query_id) - 1, 1)",
        "max": f"{w} / case when max({w}) over (partition by query_id) > 0 then max({w}) over (partition by query_id) else 1.0 end",
        "log": f"ln(1 + {w}) / case when max(ln(1 + {w})) over (partition by query_id) > 0 then max(ln(1 + {w})) over (partition by query_id) else 1.0 end",
    }[by]
    factor = [f"case status when 'current' then 1.05 when 'past' then 0.92 else 1.0 end" if temporal else "1.0"]
    if supersession:
        factor.append("case when superseded_by is not null then 0.4 else 1.0 end")
    if success:
        net = "(coalesce(success_count, 0) - coalesce(fail_count, 0))"
        factor.append(f"case when {net} > 0 then 1.0 + {success} * {net} / ({net} + 2.0) else 1.0 end")
    return (
        f"{name}_in as (select p.query_id, p.id, p.cosine, m.superseded_by, m.success_count, m.fail_count, {norm} as wn, {_RECENCY} as rec, {_STATUS} as status from {pool} p join memories m on m.id = p.id), "
        f"{name}_s as (select *, round_even(cosine * (1.0 + {use} * (0.7 * wn + 0.2 * rec)) * {' * '.join(factor)}, 4) as score from {name}_in), "
        f"{name} as (select *, row_number() over (partition by query_id order by score desc, cosine desc, id) as pos from {name}_s)"
    )


_LADDER = {
    "cosine": dict(use=0.0, temporal=False, supersession=False),
    "use_max": dict(temporal=False, supersession=False, by="max"),
    "use_log": dict(temporal=False, supersession=False, by="log"),
    "use_rank": dict(temporal=False, supersession=False),
    "temporal": dict(supersession=False),
    "shipped": dict(),
    "success": dict(success=0.3),
}
_LENS = "lens as (select m.id as memory_id, a.embedding_model as em, a.embedding from memories m join memories a on a.id = m.id + 1 where m.id % 4 = 0)"
_METRICS = (
    "count(*) as n, " + ", ".join(f"round(avg(case when best <= {k} then 1.0 else 0.0 end), 6) as hit_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0 / best, 0.0)), 6) as mrr, round(avg(found / expected), 6) as recall_all"
)


def _moved(before: dict, after: dict, result: str) -> str:
    """Best places x and y of every case under two policies."""
    best = "select c.query_id, coalesce(min(s.pos), 1 << 30) as {0} from cases c left join (select * from s_{0} where pos <= 10) s on s.query_id = c.query_id and s.id = c.expected group by 1"
    scored = ", ".join(_scored(**kw, name=f"s_{name}") for name, kw in (("x", before), ("y", after)))
    return f"with {_CASES}, {_pool(40, asked='id in (select query_id from cases)', skip=True)}, {scored}, moved as (select * from ({best.format('x')}) join ({best.format('y')}) using (query_id)) {result}"


def _lens_bench() -> str:
    rungs = {"none": None, "all": "true", **{t: f"perspective = '{t}'" for t in ("thematic", "questions", "vantages")}}
    parts, hits = [], []
    for name, chosen in rungs.items():
        if chosen is None:
            parts.append(f"p_{name} as (select query_id, id, cosine from pool)")
        else:
            parts.append(
                f"k_{name} as (select * from (select *, row_number() over (partition by query_id order by cosine desc, id) as p from ln where {chosen}) where p <= 40), "
                f"p_{name} as (select query_id, id, max(cosine) as cosine from (select query_id, id, cosine from pool union all select query_id, id, cosine from k_{name}) where id <> query_id group by 1, 2)"
            )
        parts.append(_scored(temporal=False, supersession=False, pool=f"p_{name}", name=f"s_{name}"))
        hits.append(f"select '{name}' as lenses, c.query_id, c.expected, s.pos from kept c left join (select * from s_{name} where pos <= 10) s on s.query_id = c.query_id and s.id = c.expected")
    lens = _LENS.replace("m.id as memory_id", "m.id as memory_id, case when m.id % 3 = 0 then 'thematic' when m.id % 3 = 1 then 'questions' else 'vantages' end as perspective")
    return (
        f"with {_CASES}, {lens}, kept as (select * from cases where query_id in (select query_id from cases where expected in (select memory_id from lens where embedding is not null))), "
        f"{_pool(40, asked='id in (select query_id from kept)', skip=True)}, "
        f"ln as (select query_id, memory_id as id, perspective, round(list_cosine_similarity(q.v, l.embedding::double[]), 9) as cosine from q join (select l.* from lens l join memories m on m.id = l.memory_id where {_ACTIVE.replace('embedding is', 'm.embedding is')}) l on l.em = q.em "
        "and len(l.embedding) = len(q.v) and len(list_filter(l.embedding, lambda x: isfinite(x))) = len(l.embedding) and len(list_filter(l.embedding, lambda x: x <> 0)) > 0), "
        + ", ".join(parts) + ", every as (" + " union all ".join(hits)
        + f"), sc as (select lenses, query_id, count(distinct expected) as expected, count(pos) as found, min(pos) as best from every group by 1, 2) select lenses, {_METRICS} from sc group by lenses"
    )


def _gap_sql() -> str:
    from memloom.functions.text import CATEGORIES

    text = "lower(coalesce(subject, '') || ' ' || coalesce(body, ''))"
    tests = " union all ".join(f"select tier, '{name}' as c, bool_or({' or '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in words)}) as hit from memories where tier is not null group by tier" for name, words in CATEGORIES.items())
    return f"select t.tier, coalesce(string_agg(c, ',' order by c) filter (where not hit), '') as missing from ({tests}) t group by t.tier"


def _marker_sql() -> str:
    from memloom.functions.text import MARKERS

    return "(?i)\\b(" + "|".join(MARKERS) + ")\\b"


def _trim_sql(column: str, target: int = 400) -> str:
    full = f"trim(coalesce({column}, ''), ' ')"
    part = f"substring({full}, 1, {target})"

    def last(end: str) -> str:
        at = f"(length({part}) - strpos(reverse({part}), {end[::-1]!r}) - {len(end) - 1})" if "\n" not in end else f"(length({part}) - strpos(reverse({part}), chr(10) || '.') - 1)"
        has = f"strpos(reverse({part}), {end[::-1]!r}) > 0" if "\n" not in end else f"strpos(reverse({part}), chr(10) || '.') > 0"
        return f"case when {has} and {at} > {target} * 0.5 then trim(substring({part}, 1, {at} + 1), ' ') end"

    return f"case when length({full}) <= {target} then {full} else coalesce({', '.join(last(e) for e in ('. ', '? ', '! ', '.' + chr(10), '; '))}, rtrim({part}, ' ') || '…') end"


def oracle_sql() -> dict[str, str]:
    from memloom.functions.text import NOUN_WORDS

    noun_text = "lower(coalesce(person, '') || ' ' || coalesce(subject, '') || ' ' || coalesce(body, ''))"
    has = lambda words: " or ".join(f"contains({noun_text}, '{w}')" for w in words)
    prefix = "substring(regexp_replace(trim(coalesce(subject, ''), E' '), '\\d+', '#', 'g'), 1, 40)"
    weak = "case when length(trim(coalesce(subject, ''), E' ')) < 15 then 'short' when regexp_matches(trim(coalesce(subject, ''), E' '), '(?i)^[a-z][a-z0-9+.-]*://|^/|^[a-z_/.-]+\\.(py|js|ts|sql|md|json)\\b') then 'url-like' end"
    siblings = f"sib as (select id, case when length({prefix}) >= 12 then count(*) over (partition by {prefix}) - 1 else 0 end as siblings, {prefix} as prefix from memories)"
    slug = "substring(trim(regexp_replace(lower(coalesce(subject, '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60)"
    collapse = (
        f"with {_pool(60)}, {_scored()}, g as (select *, max(score) over w as hi, min(score) over w as lo, count(*) over w as n, lag(score) over (partition by query_id order by pos) - score as dr from scored window w as (partition by query_id)), "
        "f as (select *, case when pos > 1 and pos <= 6 and dr >= 0.05 * abs(hi) then dr / case when hi > lo then hi - lo else 1.0 end end as gap from g), "
        "b as (select query_id, max(gap) as best, any_value(n) as n from f group by query_id), c as (select b.query_id, b.best, b.n, min(f.pos) as at from b left join f on f.query_id = b.query_id and f.gap = b.best group by all) "
        "select s.query_id, s.id, s.pos, s.score, case when c.best >= 0.18 then round(c.best, 4) end as gap from scored s join c using (query_id) where s.pos <= case when c.best >= 0.18 then least(c.at - 1, 5) else least(5, c.n) end"
    )
    return {
        "active_rows": f"select tier, count(*) as n from memories where {_ACTIVE} group by tier",
        "recall_topk": f"with {_pool(10)} select query_id, id, round(cosine, 6) as cosine, pos from pool",
        "recall_filtered": f"with {_pool(5, pool='tier in (' + chr(39) + 'curated' + chr(39) + ', ' + chr(39) + 'insight' + chr(39) + ') and noun_type = ' + chr(39) + 'place' + chr(39) + ' and origin is distinct from ' + chr(39) + 'recycle' + chr(39))} select query_id, id, round(cosine, 6) as cosine, pos from pool",
        "recall_multi_query": f"with {_pool(40)}, {_scored()} select query_id, id, score, pos from scored where pos <= 10",
        "recall_success_term": f"with {_pool(40)}, {_scored(success=0.3)} select query_id, id, score, pos from scored where pos <= 5",
        "recall_lens_merge": (
            f"with {_pool(20)}, {_LENS}, ln as (select query_id, memory_id as id, round(list_cosine_similarity(q.v, l.embedding::double[]), 9) as cosine from q join (select l.* from lens l join memories m on m.id = l.memory_id where {_ACTIVE.replace('embedding is', 'm.embedding is')}) l on l.em = q.em "
            "and len(l.embedding) = len(q.v) and len(list_filter(l.embedding, lambda x: isfinite(x))) = len(l.embedding) and len(list_filter(l.embedding, lambda x: x <> 0)) > 0), "
            "lk as (select * from (select *, row_number() over (partition by query_id order by cosine desc, id) as p from ln) where p <= 20) "
            "select query_id, id, round(max(cosine), 6) as cosine from (select query_id, id, cosine from pool union all select query_id, id, cosine from lk) group by query_id, id"
        ),
        "recall_collapse": collapse,
        "rank_norm_modes": (
            "select id, round((rank() over (partition by tier order by w) - 1 + (count(*) over (partition by tier, w) - 1) / 2.0) / greatest(count(*) over (partition by tier) - 1, 1), 6) as by_rank, "
            "round(w / case when max(w) over (partition by tier) > 0 then max(w) over (partition by tier) else 1.0 end, 6) as by_max, round(ln(1 + w) / case when max(ln(1 + w)) over (partition by tier) > 0 then max(ln(1 + w)) over (partition by tier) else 1.0 end, 6) as by_log "
            "from (select id, tier, coalesce(weight, 0.0) as w from memories)"
        ),
        "recency_buckets": f"select round({_RECENCY}, 4) as recency, count(*) as n from memories group by 1",
        "temporal_status_sweep": f"select {_STATUS} as status, count(*) as n from memories group by 1",
        "due_for_retensing": f"select id, subject, status from (select *, {_STATUS} as status from memories where temporal_anchor_start is not null and not coalesce(archived, false)) where status in ('past', 'current') order by temporal_anchor_start, id limit 50",
        "near_duplicates": f"with {_pool(8, skip=True)} select query_id as id, id as other, round(cosine, 6) as cosine from (select p.*, row_number() over (partition by p.query_id order by p.pos) as n from pool p join memories m on m.id = p.id where p.cosine >= 0.95 and m.superseded_by is distinct from p.query_id) where n = 1",
        "label_vector_centroids": "select label, any_value(members) as members, cast(pos - 1 as int) as pos, round(avg(x), 6) as x from (select label, count(*) over (partition by label, p) as members, p as pos, x from (select label, unnest(embedding::double[]) as x, unnest(range(1, len(embedding) + 1)) as p from embeddings)) group by label, pos",
        "doorway_match": (
            "with c as (select label, list(m order by p) as v from (select label, p, avg(x) as m from (select label, unnest(embedding::double[]) as x, unnest(range(1, len(embedding) + 1)) as p from embeddings) group by label, p) group by label), "
            "s as (select vec_id, cast(label as varchar) as key, round(list_cosine_similarity(embedding::double[], v), 9) as cosine from (select vec_id, embedding from embeddings where vec_id % 20 = 0) cross join c) "
            "select vec_id as query_id, key, round(cosine, 6) as cosine from (select *, row_number() over (partition by vec_id order by cosine desc, key) as n from s) where n = 1 and cosine >= 0.3"
        ),
        "edge_compaction": f"with {_EDGES} select from_id, to_id, link_type, round(strength, 6) as strength, hop_count, last_walked from e",
        "edge_merge": f"with {_LOG} select from_id, to_id, link_type, round({_H.format(n='sum((id % 2 = 0)::int)', c='0')} + {_H.format(n='sum((id % 2 = 1)::int)', c='0')}, 6) as strength, count(*) as hop_count from lg group by from_id, to_id, link_type",
        "edge_decay_prune": f"with {_EDGES}, x as (select *, case when last_walked < {NOW} - 7 * {DAY} then strength * 0.95 else strength end as s from e) select from_id, to_id, link_type, round(s, 6) as strength from x where s >= 0.02",
        "spreading_activation": (
            f"with {_EDGES}, b as (select from_id as node, to_id as nxt, strength from e union all select to_id, from_id, strength from e), s as (select id as g, id as node from memories where id % 20 = 0), "
            "h1 as (select g, nxt as node, sum(strength * 0.5) as level from s join b using (node) where strength * 0.5 >= 1e-4 group by g, nxt), "
            "h2 as (select g, nxt as node, sum(level * strength * 0.25) as level from h1 join b using (node) where level * strength * 0.25 >= 1e-4 group by g, nxt), "
            "t as (select g, node, sum(level) as a from (select * from h1 union all select * from h2) where g <> node group by g, node), "
            "k as (select *, row_number() over (partition by g order by round(a, 9) desc, node) as n from t) "
            "select g as seed, node as id, round(a, 6) as activation from k join memories m on m.id = k.node where n <= 10 and not coalesce(m.archived, false)"
        ),
        "supersession_edges": "select m.id as from_id, m.superseded_by as to_id, 'supersedes' as link_type from memories m where m.superseded_by is not null and not exists (select 1 from memory_links l where l.link_type = 'supersedes' and l.from_id = m.id and l.to_id = m.superseded_by)",
        "co_recall_pairs": (
            f"with {_EVENTS}, t as (select session_id, created_at, id, list_transform(shown, lambda s: s.id)[1:2] as top from ev), s as (select top, lead(top) over (partition by session_id order by created_at, id) as after from t), "
            "p as (select unnest(top) as from_id, after from s where after is not null), x as (select from_id, unnest(after) as to_id from p) select from_id, to_id, count(*) as walks from x where from_id <> to_id group by all"
        ),
        "edge_statistics": f"with {_EDGES} select link_type, count(*) as edges, round(avg(strength), 6) as mean_strength, round(max(strength), 6) as max_strength from e group by link_type",
        "direct_links": f"with {_EDGES}, {_CASES} select query_id as a, expected as b, exists (select 1 from e where (e.from_id = query_id and e.to_id = expected) or (e.from_id = expected and e.to_id = query_id)) as linked from cases",
        "scoped_edge_reset": f"with {_EDGES}, o as (select id from memories where project = 'marble-passport') select link_type, count(*) as n from e where not (from_id in (select id from o) and to_id in (select id from o)) group by link_type",
        "strengthen_batch": f"with {_EVENTS}, t as (select id, count(*) as n from (select unnest(list_transform(shown, lambda s: s.id)) as id from ev) group by id) select m.id, coalesce(access_count, 0) + coalesce(n, 0) as access_count, round(coalesce(weight, 0.0) + {_H.format(n='coalesce(n, 0)', c='coalesce(access_count, 0)')}, 6) as weight from memories m left join t on t.id = m.id",
        "used_fail_feedback": (
            f"with {_EVENTS}, g as (select distinct unnest(used) as id from ev), f as (select distinct unnest(list_transform(shown, lambda s: s.id)) as id from ev where len(used) = 0), "
            "u as (select m.id, coalesce(success_count, 0) + (g.id is not null)::int as success_count, coalesce(fail_count, 0) + (f.id is not null)::int as fail_count, "
            "coalesce(weight, 0.0) + case when g.id is not null then 1.0 / (coalesce(access_count, 0) + 2) else 0.0 end as w, f.id is not null as bad from memories m left join g on g.id = m.id left join f on f.id = m.id) "
            "select id, success_count, fail_count, round(case when bad then greatest(0.0, w - 0.05) else w end, 6) as weight from u"
        ),
        "node_decay_archive": f"with x as (select *, case when coalesce(epoch_us(last_accessed) < {NOW} - 7 * {DAY}, false) and not coalesce(archived, false) then weight * 0.95 else weight end as w from memories) select id, coalesce(archived, false) or coalesce(w < 0.01 and access_count > 0, false) as archived, round(w, 6) as weight from x",
        "never_accessed_archive": f"select coalesce(archived, false) or coalesce(coalesce(access_count, 0) = 0 and epoch_us(created_at) < {NOW} - 90 * {DAY}, false) as archived, count(*) as n from memories group by 1",
        "consolidated": (
            f"with {_EDGES}, x as (select *, case when coalesce(epoch_us(last_accessed) < {NOW} - 7 * {DAY}, false) and not coalesce(archived, false) then weight * 0.95 else weight end as w from memories), "
            f"y as (select coalesce(archived, false) or coalesce(w < 0.01 and access_count > 0, false) or coalesce(coalesce(access_count, 0) = 0 and epoch_us(created_at) < {NOW} - 90 * {DAY}, false) as a, coalesce(archived, false) as b from x), "
            f"d as (select case when last_walked < {NOW} - 7 * {DAY} then strength * 0.95 else strength end as s from e) select count(*) as rows, count(*) filter (where a) as archived, count(*) filter (where b) as archived_before, (select count(*) from d where s >= 0.02) as edges from y"
        ),
        "list_by_entity": "select id, subject from memories where (person = 'agent-16' or contributor = 'agent-16') and not coalesce(archived, false) order by id limit 20",
        "forget_project": "select (select count(*) from memories where project is distinct from 'marble-passport') as memories, (select count(*) from open_loops l where not exists (select 1 from memories m where m.project = 'marble-passport' and m.id = l.memory_id)) as loops",
        "supersede_pairs": "with p as (select superseded_by as old, max(id) as new from memories where superseded_by is not null group by 1) select m.id, coalesce(p.new, m.superseded_by) as superseded_by from memories m left join p on p.old = m.id where coalesce(p.new, m.superseded_by) is not null",
        "exchange_first": "select min(id) as id, exchange_id from memories where exchange_id is not null group by exchange_id union all select id, exchange_id from memories where exchange_id is null",
        "ingest_verdicts": "select case when id % 7 in (0, 2) then 'empty' when id % 7 = 1 then 'malformed' when trim(coalesce(subject, ''), ' ') = '' and trim(coalesce(body, ''), ' ') = '' then 'empty' else 'stored' end as verdict, count(*) as n from memories group by 1",
        "upsert_by_key": (
            "with st as (select * from (select *, row_number() over (partition by node_key order by id) as n from memories where id % 3 > 0) where node_key is null or n = 1), inc as (select * from memories where id % 3 = 0), "
            "last as (select * from (select *, row_number() over (partition by node_key order by id desc) as n from inc where node_key is not null) where n = 1), top as (select max(id) as t from st), "
            "new as (select node_key, body, project, archived, id from last where node_key not in (select node_key from st where node_key is not null) union all select node_key, body, project, archived, id from inc where node_key is null) "
            "select s.node_key, md5(case when l.id is not null then l.body else s.body end) as body_md5, coalesce(s.project, l.project) as project, case when l.id is not null then false else coalesce(s.archived, false) end as archived from st s left join last l on l.node_key = s.node_key "
            "union all select node_key, md5(body) as body_md5, project, archived from new"
        ),
        "node_keys": "select id, case when person is not null and person <> '' then concat_ws('|', person, trim(substring(regexp_replace(lower(coalesce(subject, '')), '[^a-z0-9]+', '_', 'g'), 1, 40), '_'), substring(sha256(concat_ws('|', person, coalesce(subject, ''), coalesce(body, ''))), 1, 6)) end as key from memories",
        "wikilink_pairs": "select distinct id, unnest(list_transform(regexp_extract_all(coalesce(body, ''), '\\[\\[(\\d+)\\]\\]', 1), lambda x: try_cast(x as bigint))) as cited from memories",
        "previews": "select id, coalesce(nullif(trim(recall_form, ' '), ''), replace(substring(coalesce(body, ''), 1, 220), chr(10), ' ') || case when length(body) > 220 then '...' else '' end) as preview from memories",
        "sentence_trims": f"select id, {_trim_sql('body')} as trimmed from memories",
        "short_forms": f"select id, recall_form from (select id, body, {_trim_sql('body')} as recall_form from memories where length(body) > 400 and tier in ('curated', 'insight', 'decision', 'project') and memories.recall_form is null and not coalesce(archived, false)) where length(recall_form) > 0 and length(recall_form) < length(body)",
        "topic_slugs": f"select id, {slug} as slug from memories",
        "noun_types": f"select case when {has(NOUN_WORDS['place'])} then 'place' when {has(NOUN_WORDS['project'])} then 'project' when regexp_matches(coalesce(person, ''), '^\\p{{Lu}}') and contains(person, ' ') then 'person' else 'thing' end as noun_type, count(*) as n from memories group by 1",
        "gap_categories": _gap_sql(),
        "project_mentions": f"with {_MENTIONS} select canonical, count(*) as n from ment group by canonical",
        "project_classification": (
            f"with {_MENTIONS}, c as (select t.id, t.project as a, count(m.canonical) as k, count(m.canonical) filter (where m.canonical is distinct from t.project) as others, min(m.canonical) as one from texts t left join ment m on m.id = t.id group by 1, 2), "
            "s as (select case when a is not null and others = 0 then a when a is null and k = 1 then one end as s, a from c) select case when s is not null then 'context' else 'fallback' end as method, count(*) as n, count(coalesce(s, a)) as with_project from s group by 1"
        ),
        "json_fold": (
            "with recursive t as (select m.id, j.fullkey, j.type, j.atom, j.value from memories m, json_tree(m.metadata_json::json) j where m.metadata_json is not null and json_valid(m.metadata_json)) "
            "select id, regexp_replace(fullkey, '^\\$\\.?', '') as path, cast(value as varchar) as value from t where type not in ('OBJECT', 'ARRAY')"
        ),
        "event_props_fold": "select event_id, 'k' as path, cast(json_extract(props, '$.k') as varchar) as value from events where json_extract(props, '$.k') is not null",
        "doorway_keys": f"with {_EVENTS}, s as (select list_sort(list_distinct(list_transform(shown, lambda s: s.id)[1:3])) as m from ev) select substring(sha256(array_to_string(list_transform(m, lambda x: cast(x as varchar)), ',')), 1, 16) as key, count(*) as n from s where len(m) >= 2 group by 1",
        "doorway_staleness": f"with {_EVENTS}, s as (select distinct substring(sha256(array_to_string(list_transform(list_sort(list_distinct(list_transform(shown, lambda s: s.id)[1:3])), lambda x: cast(x as varchar)), ',')), 1, 16) as key from ev where len(list_distinct(list_transform(shown, lambda s: s.id)[1:3])) >= 2) select key < '8' and (select max(epoch_us(created_at)) from memories where not coalesce(archived, false)) > 1707523200000000 as stale, count(*) as n from s group by 1",
        "dominant_project": "select person, project from (select person, project, row_number() over (partition by person order by count(*) desc, project) as p from memories where person is not null and project is not null group by person, project) where p = 1",
        "topic_backfill": (
            "with pr as (select project, regexp_extract(lower(coalesce(subject, '')), '(boat shed|tide gauge|bell tower|water tower|ice rink|browser hook|lock table|retry loop)', 1) as term from memories where project is not null), t as (select replace(term, ' ', '-') as slug, term, min(project) as project from pr where term <> '' group by term), "
            "x as (select slug, m.id, row_number() over (partition by slug order by m.id) as n from t join memories m on m.project = t.project where not coalesce(archived, false) and origin is distinct from 'recycle' and contains(lower(coalesce(subject, '') || ' ' || coalesce(body, '')), term)) select slug, id from x where n <= 400"
        ),
        "topic_member_top30": "with t as (select project as slug, id, count(*) over (partition by project) as size, row_number() over (partition by project order by weight desc nulls last, id) as p from memories where project is not null and not coalesce(archived, false) and origin is distinct from 'recycle') select slug, any_value(size) as size, string_agg(cast(id as varchar), ',' order by id) as members from t where size >= 3 and p <= 30 group by slug",
        "topic_extraction_batches": (
            "with k2 as (select coalesce(project, '') as p, cast(floor(max(id) / 2.0) as bigint) as last_id from memories where id % 3 = 0 group by 1), "
            "u as (select coalesce(project, '') as mark_of, id, row_number() over (partition by coalesce(project, '') order by id) as n from memories m left join k2 on k2.p = coalesce(m.project, '') where id > coalesce(last_id, 0) and origin is distinct from 'recycle' and not coalesce(archived, false)) select mark_of, count(*) as n, max(id) as last_id from u where n <= 40 group by mark_of"
        ),
        "topic_repeats": (
            "with u as (select coalesce(project, '') as mark_of, id, body, cast(floor((row_number() over (partition by coalesce(project, '') order by id) - 1) / 40) as int) as batch_no from memories where origin is distinct from 'recycle' and not coalesce(archived, false)), "
            "t as (select mark_of, batch_no, id, replace(unnest(list_distinct(regexp_extract_all(lower(body), '\\b(boat shed|tide gauge|bell tower|water tower|ice rink)\\b', 1))), ' ', '-') as slug from u), c as (select *, count(*) over (partition by mark_of, batch_no, slug) as seen from t) select distinct mark_of, batch_no, id, slug from c where seen >= 2"
        ),
        "watermarks": "select coalesce(project, '') as project, max(id) as last_id from memories group by 1",
        "period_groups": (
            "with t as (select strftime(make_timestamp(epoch_us(created_at)), '%Y-%m-%dT%H') as hour, id from memories where origin is distinct from 'recycle' and not coalesce(archived, false) and epoch_us(created_at) between 1705276800000000 - 365 * 86400000000 and 1705276800000000) "
            "select hour, count(*) as n, string_agg(cast(id as varchar), ',' order by id) as members from t group by hour having count(*) between 2 and 60 order by hour desc limit 1000"
        ),
        "open_loop_candidates": (
            f"with n as (select id, subject, body, created_at from memories m where tier in ('curated', 'insight', 'decision', 'project') and not coalesce(archived, false) and epoch_us(created_at) >= {NOW} - 400 * {DAY} and epoch_us(created_at) <= {NOW} and not exists (select 1 from open_loops l where l.memory_id = m.id) order by created_at desc, id desc limit 480) "
            f"select id from n where regexp_matches(concat_ws(' ', subject, body), '{_marker_sql()}') order by created_at desc, id desc limit 40"
        ),
        "open_loop_outstanding": (
            "with c as (select distinct id as src, unnest(list_transform(regexp_extract_all(coalesce(body, ''), '\\[\\[(\\d+)\\]\\]', 1), lambda x: try_cast(x as bigint))) as memory_id from memories), k as (select memory_id, count(*) as cited from c where src > memory_id group by 1) "
            "select l.memory_id, coalesce(cited, 0) as cited from open_loops l left join k on k.memory_id = l.memory_id where lower(trim(coalesce(status, 'open'), ' ')) = 'open'"
        ),
        "open_loop_sweep": (
            f"with s as (select memory_id, lower(trim(coalesce(status, 'open'), ' ')) as status, close_reason, epoch_us(detected_at) < {NOW} - 45 * {DAY} as old from open_loops), a as (select memory_id, case when status = 'open' and old then 'dismissed' else status end as status, case when status = 'open' and old then 'aged out' else close_reason end as close_reason from s), "
            "b as (select case when a.status = 'open' and m.superseded_by is not null then 'closed' else a.status end as status, case when a.status = 'open' and m.superseded_by is not null then 'superseded' else a.close_reason end as close_reason from a left join memories m on m.id = a.memory_id) select status, close_reason, count(*) as n from b group by all"
        ),
        "loop_statistics": f"select lower(trim(coalesce(status, 'open'), ' ')) as status, count(*) as n, count(*) filter (where epoch_us(detected_at) < {NOW} - 7 * {DAY}) as old from open_loops group by 1",
        "event_funnel": f"with {_EVENTS} select count(*) as total, count(used) as judged, count(*) filter (where len(used) = 0) as nothing_used, coalesce(sum(len(used)), 0)::bigint as used_rows, count(used) >= 200 as ready from ev",
        "event_shown_ranks": f"with {_EVENTS}, f as (select used, unnest(shown) as s from ev where used is not null) select s.rank as rank, count(*) as shown, count(*) filter (where list_contains(used, s.id)) as used from f group by 1",
        "events_waiting": f"with {_EVENTS} select id from ev where used is null and epoch_us(created_at) < {NOW} - 3600000000 order by created_at, id limit 50",
        "repeated_injections": f"with {_EVENTS}, f as (select session_id, created_at, id, unnest(list_transform(shown, lambda s: s.id)) as mid from ev), r as (select row_number() over (partition by session_id, mid order by created_at, id) as n from f) select count(*) as shown, count(*) filter (where n > 1) as repeated from r",
        "template_subjects": f"with {siblings} select id, siblings from sib where siblings >= 5",
        "weak_subjects": f"select {weak} as weakness, count(*) as n from memories group by 1",
        "quality_warnings": f"with {siblings}, {_pool(8, skip=True)}, m as (select m.*, s.siblings from memories m join sib s on s.id = m.id) select code, count(*) as n from (select 'templated_subject' as code from m where siblings >= 5 union all select 'weak_subject' from m where {weak} is not null union all select 'no_project' from m where project is null union all select 'near_duplicate' from (select distinct query_id from pool p join memories o on o.id = p.id where p.cosine >= 0.95 and o.superseded_by is distinct from p.query_id) union all select 'long_body' from m where length(body) > 2000) group by code",
        "vector_models": "select embedding_model, len(embedding) as dimensions, count(*) as n from memories where embedding is not null group by 1, 2",
        "vocabulary_violations": "with r as (select 'noun_type' as rule from memories where noun_type not in ('person', 'place', 'project', 'thing') union all select 'origin' from memories where origin not in ('contribution', 'discovery', 'recycle') union all select 'id' from memories where id is null union all select 'node_key' from (select count(*) over (partition by node_key) as n from memories where node_key is not null) where n > 1) select rule, count(*) as n from r group by rule",
        "citation_cases": f"with {_CASES} select query_id, expected from cases",
        "pair_cosine_split": (
            f"with {_CASES}, p as (select query_id, expected, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c from cases join memories a on a.id = query_id join memories b on b.id = expected where len(a.embedding) = len(b.embedding) "
            "and len(list_filter(a.embedding, lambda x: isfinite(x))) = len(a.embedding) and len(list_filter(b.embedding, lambda x: isfinite(x))) = len(b.embedding) and len(list_filter(a.embedding, lambda x: x <> 0)) > 0 and len(list_filter(b.embedding, lambda x: x <> 0)) > 0) "
            "select query_id, expected, round(c, 6) as cosine, c < (select quantile_cont(c, 0.5) from p) as hard from p"
        ),
        "policy_changes": _moved(dict(use=0.0, temporal=False, supersession=False), {}, "select count(*) as n, count(*) filter (y < x) as better, count(*) filter (y > x) as worse, count(*) filter (y <> x) as changed from moved"),
        "use_signal_readiness": _moved(
            {}, dict(success=0.3),
            "select *, case when n = 0 then 'no cases' when changed = 0 then 'not answerable' when better > worse then 'answerable' else 'harmful' end as verdict from (select count(*) as n, count(*) filter (y < x) as better, count(*) filter (y > x) as worse, count(*) filter (y <> x) as changed, "
            "(select count(*) from memories where not coalesce(archived, false) and success_count > 0) as marked from moved)",
        ),
        "lens_bench": _lens_bench(),
        "exchange_pairing": (
            "with d as (select doc_id, string_split(regexp_replace(text, '\\n\\n((?:user|assistant|Q|A): )', chr(63743) || '\\1', 'g'), chr(63743)) as x from documents where text is not null), p as (select doc_id, unnest(x) as x, unnest(range(len(x))) as turn from d), "
            "t as (select doc_id, turn, regexp_extract(x, '^(user|assistant|Q|A): ', 1) as mark, regexp_replace(x, '^(user|assistant|Q|A): ', '') as text from p), u as (select doc_id, turn, text, mark in ('user', 'Q') as asks from t where mark <> ''), "
            "n as (select q.doc_id, q.turn, any_value(q.text) as prompt, min(a.turn) as next from u q join u a on a.doc_id = q.doc_id and a.turn > q.turn and not a.asks where q.asks group by 1, 2) "
            "select n.doc_id as conv_id, n.turn, length(prompt) as prompt_chars, length(a.text) as answer_chars from n join u a on a.doc_id = n.doc_id and a.turn = n.next"
        ),
        "doorway_centroids": (
            f"with {_EVENTS}, s as (select list_sort(list_distinct(list_transform(shown, lambda s: s.id)[1:3])) as m from ev), k as (select substring(sha256(array_to_string(list_transform(m, lambda x: cast(x as varchar)), ',')), 1, 16) as key, any_value(m) as m, count(*) as qc from s where len(m) >= 2 group by 1), "
            "e as (select key, qc, unnest(m) as id from k), v as (select e.key, e.qc, embedding::double[] as v, coalesce(embedding_model, '') || '|' || len(embedding) as sp from e join memories using (id) where embedding is not null), "
            "w as (select key, sp, row_number() over (partition by key order by count(*) desc, sp) as n from v group by key, sp), "
            "u as (select v.* from v join w using (key, sp) where n = 1 and len(v) > 0 and len(list_filter(v, lambda x: isfinite(x))) = len(v) and len(list_filter(v, lambda x: x <> 0)) > 0), "
            "x as (select key, qc, unnest(v) as x, unnest(range(len(v))) as p from u), c as (select key, qc, p, round(avg(x), 5) as a from x group by 1, 2, 3) select key, qc as query_count, list(a order by p) as centroid from c group by key, qc"
        ),
        "period_summaries": (
            "with t as (select strftime(make_timestamp(epoch_us(created_at)), '%Y-%m-%dT%H') as hour, id, project, subject from memories where origin is distinct from 'recycle' and not coalesce(archived, false) and epoch_us(created_at) between 1705276800000000 - 365 * 86400000000 and 1705276800000000), "
            "g as (select hour, count(*) as n from t group by hour having count(*) between 2 and 60 order by hour desc limit 1000), r as (select t.*, g.n, row_number() over (partition by hour order by id) as p from t join g using (hour)) "
            "select 'period|' || hour as node_key, 'Session summary: ' || hour as subject, 'Projects touched: ' || array_to_string(list_sort(list_distinct(list(coalesce(project, '(none)')))), ', ') || chr(10) || chr(10) || string_agg('- [' || id || '] ' || coalesce(project, '(none)') || ': ' || coalesce(subject, ''), chr(10) order by p) as body, any_value(n) as members from r where p <= 40 group by hour"
        ),
        "policy_ladder": (
            f"with {_CASES}, {_pool(40, asked='id in (select query_id from cases)', skip=True)}, "
            + ", ".join(_scored(**kw, name=f"s_{name}") for name, kw in _LADDER.items())
            + ", every as ("
            + " union all ".join(f"select '{name}' as policy, c.query_id, c.expected, s.pos from cases c left join (select * from s_{name} where pos <= 10) s on s.query_id = c.query_id and s.id = c.expected" for name in _LADDER)
            + f"), sc as (select policy, query_id, count(distinct expected) as expected, count(pos) as found, min(pos) as best from every group by 1, 2) select policy, {_METRICS} from sc group by policy"
        ),
        "subject_index": "select count(*) as n, sum(id)::bigint as total from (select subject, min(id) as id from memories where subject is not null group by subject having count(*) = 1)",
        "lens_todo": "with have as (select id, case when id % 3 = 0 then 'thematic' when id % 3 = 1 then 'questions' else 'vantages' end as p from memories m where id % 4 = 0 and exists (select 1 from memories a where a.id = m.id + 1)), w as (select unnest(['thematic', 'questions']) as perspective) select perspective, count(*) as n from memories m cross join w where not coalesce(archived, false) and not exists (select 1 from have h where h.id = m.id and h.p = w.perspective) group by 1",
        "hourly_events": "select strftime(ts, '%Y-%m-%dT%H') as hour, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
        "event_walks": f"with s as (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as t from events) select event_type as from_type, t as to_type, count(*) as walks, round({_H.format(n='count(*)', c='0')}, 6) as strength from s where t is not null and t <> event_type group by 1, 2",
        "top_orders_of_customers": "select o_custkey, o_orderkey, place from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) where place <= 3",
        "main_supplier_of_parts": "select l_partkey, l_suppkey from (select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by count(*) desc, l_suppkey) as p from lineitem group by 1, 2) where p = 1",
        "co_ordered_parts": "with s as (select l_partkey, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as t from lineitem) select l_partkey as from_part, t as to_part, count(*) as walks from s where t is not null and t <> l_partkey group by 1, 2",
        "project_alias_resolution": "select l.memory_id, coalesce(a.canonical, b.canonical, p.slug) as canonical from (select memory_id, project, substring(trim(regexp_replace(lower(strip_accents(project)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) as s from open_loops) l left join project_aliases a on a.alias = l.project left join project_aliases b on b.alias = l.s left join projects p on p.slug = l.s",
    }
