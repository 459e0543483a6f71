"""Oracle SQL of this subpackage's queries, where SQL can express them on whole tables."""

from __future__ import annotations

_V = (
    "v as (select id, embedding_model as em, embedding::double[] as v from memories where embedding is not null and embedding_model is not null and len(embedding) > 0 "
    "and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0), "
    "near as (select a.id as a, b.id as b, round(list_cosine_similarity(a.v, b.v), 9) as c from v a join v b on a.em = b.em and len(a.v) = len(b.v) and a.id <> b.id), alike as (select * from near where c >= 0.8)"
)
_W = "w as (select id, list_distinct(regexp_extract_all(lower(coalesce(subject, '') || ' ' || coalesce(body, '')), '[\\p{L}\\p{N}]+')) as w from memories), s as (select * from w where len(w) > 0)"


def oracle_sql() -> dict[str, str]:
    return {
        # A closed cluster: every member has the same closed neighbourhood.
        "p1_found": f"with {_V}, n as (select a, list_sort(list_append(list(b), a)) as g from alike group by a), k as (select g, count(*) as n from n group by g having count(*) = len(g) and len(g) >= 3), m as (select g, unnest(g) as id from k) select x.id as id_a, y.id as id_b from m x join m y on x.g = y.g and x.id < y.id",
        "p4_found": f"with {_W}, t as (select id, len(w) as n, unnest(w) as t from s), o as (select a.id as id_a, b.id as id_b, any_value(a.n) as n, any_value(b.n) as m, count(*) as o from t a join t b on a.t = b.t and a.id < b.id and a.n >= 0.7 * b.n and b.n >= 0.7 * a.n group by 1, 2) select id_a, id_b from o where 10 * o >= 7 * (n + m - o)",
        "p5_found": f"with {_V}, k as (select a, b, row_number() over (partition by a order by c desc, b) as p from alike) select distinct least(a, b) as id_a, greatest(a, b) as id_b from k where p <= 5",
    }
