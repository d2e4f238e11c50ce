"""DuckDB's text for the operators whose results plain SQL can state: each by its definition, over all pairs and terms."""

from __future__ import annotations

LINE_DEDUP = r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as position
    from documents
), keyed as (
    select doc_id, position, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
), often as (
    select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), judged as (
    select k.*, o.key is not null and k.doc_id <> o.keeper as dropped from keyed k left join often o on k.key = o.key
)
select doc_id, count(*) as n_lines, count_if(dropped)::bigint as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by position) filter (not dropped), '')) as kept_sha256
from judged group by doc_id
"""

DIVERGENCE = r"""
with texts as (
    select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc from documents
), words as (
    select doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from texts
), kept as (
    select lang, term, count(*) as c from words group by all having count(distinct doc) >= 3
), counts as (
    select lang, source, term, count(*) as c from words semi join kept using (lang, term) group by all
), langs as (
    select t.lang, (select count(*) from kept k where k.lang = t.lang)::hugeint as v, coalesce((select sum(c) from kept k where k.lang = t.lang), 0)::hugeint as n
    from (select distinct lang from texts) t
), groups as (
    select g.lang, g.source, l.v, coalesce(sum(c.c), 0)::hugeint as n
    from (select distinct lang, source from texts) g join langs l using (lang) left join counts c using (lang, source) group by all
), shares as (
    select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (g.n + g.v) as p
    from groups g join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), pairs as (
    select x.lang, x.source, 'pair' as part, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) as value
    from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
), every_pair as (
    select x.lang, x.source, 'pair' as part, y.source as item, coalesce(p.value, 0)::bigint as value
    from groups x join groups y on x.lang = y.lang and x.source <> y.source
    left join pairs p on p.lang = x.lang and p.source = x.source and p.item = y.source
), terms as (
    select s.lang, s.source, 'term' as part, s.term as item, (((p - q) * (p - q)) // q)::bigint as value
    from shares s join (select k.lang, k.term, 1 + (1000000000::hugeint * (k.c + 1)) // (l.n + l.v) as q from kept k join langs l using (lang)) w using (lang, term)
    where s.c > 0 and p > q
), ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from every_pair union all select * from terms)
)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""


def clustering(clusters: int = 16, rounds: int = 3) -> str:
    """Assignment by all distances, a step for each round."""
    steps = [
        """v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)""",
        f"c0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as cluster, v as c from v order by sha256('1:' || vec_id) limit {clusters})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""d{i} as (
    select vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as distance from v, c{i}
), a{i} as (
    select vec_id, any_value(v) as v, min_by(cluster, distance * {clusters} + cluster) as cluster, min(distance) as distance from d{i} group by vec_id
)""")
        if i < rounds:
            steps.append(f"""m{i} as (
    select cluster, list(m order by j) as c from (
        select cluster, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as m
        from (select cluster, unnest(v) as x, unnest(range(64)) as j from a{i}) group by cluster, j) group by cluster
), c{i + 1} as (select c{i}.cluster, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} using (cluster))""")
    return "with " + ", ".join(steps) + f"""
select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
    sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (cluster)"""
