"""SQL of the corpus queries that DuckDB can express."""

from __future__ import annotations

from collections.abc import Sequence

from .host_reputation import LIFT, SUFFIXES, Z, Rule
from .pivot_clusters import CLUSTERS, PARTS, ROUNDS, SCALE
from .shrink import RHO

EXACT_DEDUP = r"""
with digests as (
    select doc_id, length(coalesce(text, '')) as size,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
    from documents)
select doc_id, first_value(doc_id) over best as keep_id,
       count(*) over (partition by text_sha256) as group_size, row_number() over best = 1 as kept, text_sha256
from digests
window best as (partition by text_sha256 order by size desc, doc_id nulls last)
"""


def _assigned(centroids: str) -> str:
    return f"""
    select vec_id, c, dist from (
        select v.vec_id, c.c, sum((v.x - c.y) * (v.x - c.y)) as dist,
               row_number() over (partition by v.vec_id order by sum((v.x - c.y) * (v.x - c.y)), c.c) as nearest
        from parts v join {centroids} c on v.part = c.part group by v.vec_id, c.c)
    where nearest = 1"""


def clusters_sql() -> str:
    out = f"""
with kept as (
    select vec_id, [floor({SCALE} * x::double)::bigint for x in embedding] as v from embeddings
    where len(embedding) = {PARTS} and len([x for x in embedding if x is not null and isfinite(x)]) = {PARTS}),
parts as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as part from kept),
starts as (
    select vec_id, row_number() over (order by sha256('1:' || vec_id)) - 1 as c from kept
    order by sha256('1:' || vec_id) limit {CLUSTERS}),
centroids0 as (select c, part, x as y from parts join starts using (vec_id))"""
    for i in range(1, ROUNDS + 1):
        out += f""",
assigned{i} as ({_assigned(f"centroids{i - 1}")}),
sums{i} as (select c, part, sum(x)::bigint as s, count(*) as n from assigned{i} join parts using (vec_id) group by c, part),
centroids{i} as (
    select o.c, o.part, coalesce((s - ((s % n) + n) % n) // n, o.y) as y
    from centroids{i - 1} o left join sums{i} m on o.c = m.c and o.part = m.part)"""
    return out + f""",
labelled as ({_assigned(f"centroids{ROUNDS}")}),
named as (select c, sha256(string_agg(y::bigint::varchar, ',' order by part)) as centroid_sha256 from centroids{ROUNDS} group by c)
select vec_id, c::int as cluster, dist::bigint as distance,
       (sum(dist) over (partition by c))::bigint as cluster_inertia, (sum(dist) over ())::bigint as inertia, centroid_sha256
from labelled join named using (c)
"""


COLLOCATIONS = r"""
with lowered as (
    select coalesce(lang, 'und') as lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
    from documents),
pieces as (
    select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from lowered),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces),
phrases as (
    select lang, array_to_string(list_slice(w, i, i + size - 1), ' ') as phrase, size, count(*) as f
    from places, range(1, 5) sizes(size) where i + size - 1 <= len(w) group by all having count(*) >= 30),
words as (select *, string_split(phrase, ' ') as w from phrases),
longer as (
    select lang, inner_phrase, max(f) as most from (
        select lang, f, array_to_string(list_slice(w, 1, size - 1), ' ') as inner_phrase from words where size > 2
        union all
        select lang, f, array_to_string(list_slice(w, 2, size), ' ') from words where size > 2)
    group by all),
kept as (
    select p.* from words p left join longer g on p.lang = g.lang and p.phrase = g.inner_phrase
    where size > 1 and not coalesce(100 * g.most::hugeint >= 80 * p.f::hugeint, false)),
cuts as (
    select p.lang, p.phrase, p.f as a, k, l.f as l, r.f as r, (2000000 * p.f::hugeint) // (l.f + r.f) as score
    from (select *, unnest(range(1, size)) as k from kept) p
    join phrases l on l.lang = p.lang and l.phrase = array_to_string(list_slice(p.w, 1, k), ' ')
    join phrases r on r.lang = p.lang and r.phrase = array_to_string(list_slice(p.w, k + 1, p.size), ' ')),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
       a, l, r, n, score::bigint as score
from lowest join totals using (lang)
qualify rank <= 2000
"""


def _level(i: int, keys: Sequence[str], parents: str) -> str:
    """Counts of one level around their parents' means, its prior strength and its posteriors."""
    by = ", ".join(keys)
    return f"""
child{i} as (
    select c.*, parent from (select {by}, sum(n) as n, sum(k) as k from counts group by {by}) c {parents}),
strength{i} as (
    select case when coalesce(sum(one * (n - 1)), 0) = 0 then 1 / {RHO[0]}::double - 1
        else 1 / least(greatest((sum(n * pow(k / n - parent, 2)) - sum(one)) / sum(one * (n - 1)), {RHO[0]}), {RHO[1]}) - 1
        end as s
    from (select n::double as n, k::double as k, parent, parent * (1 - parent) as one from child{i} where n > 0)),
level{i} as (
    select *, a / (a + b) as mean from (
        select {by}, s * parent + k as a, s * (1 - parent) + n - k as b from child{i}, strength{i})),"""


def host_verdicts_sql(rules: Sequence[Rule], page_doc: str) -> str:
    """Rules, and hosts blocked by their posterior bound."""
    named = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    listed = ", ".join(f"('{s}')" for s in SUFFIXES)
    levels = _level(0, ["suffix"], "cross join overall")
    for i, keys in enumerate((["suffix", "domain"], ["suffix", "domain", "site"]), 1):
        above = ", ".join(keys[:-1])
        levels += _level(i, keys, f"join (select {above}, mean as parent from level{i - 1}) using ({above})")
    return rf"""
with cut as (
    select page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) as u
    from pages),
hosts as (
    select page_id, u.path as path, try_cast(nullif(regexp_extract(u.path, '{page_doc}', 1), '') as bigint) as page_doc,
           translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host
    from cut),
sites as (
    select *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.$', '') as site
    from hosts),
outcomes as (
    select site, 1 as n, (quality = 0)::int as k from sites join labels on page_doc = doc_id where quality is not null
    union all select site, 0, 0 from sites),
per_site as (select site, sum(n) as n, sum(k) as k from outcomes group by site),
suffixed as (
    select *, case when regexp_full_match(site, '[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}') or starts_with(site, '[') then site
        else coalesce(
            (select max_by(s, length(s)) from (values {listed}) l(s) where site = s or ends_with(site, '.' || s)),
            string_split(site, '.')[-1]) end as suffix
    from per_site),
counts as (
    select *, case when label = '' then suffix else label || '.' || suffix end as domain
    from (select *, string_split(left(site, greatest(length(site) - length(suffix) - 1, 0)), '.')[-1] as label
          from suffixed)),
overall as (select (coalesce(sum(k), 0) + 0.5::double) / (coalesce(sum(n), 0) + 1) as parent from counts),{levels}
bad as (
    select site from level2, overall
    where a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
          > {LIFT} * parent / (1 - parent + {LIFT} * parent) and site <> ''),
fitting as (
    select page_id, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as ruled
    from sites join (values {named}) r(v, h, p) on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
    group by page_id)
select page_id, host, path, rule,
       coalesce(ruled, case when site in (select site from bad) then 'block' else 'allow' end) as verdict
from sites left join fitting using (page_id)
"""
