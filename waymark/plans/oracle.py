"""SQL fragments that the catalogue's statements share."""

from __future__ import annotations

SITES = "sites as (select p_partkey as id, p_name as name, nullif(p_type, 'STANDARD') as forest_name, p_retailprice % 90 as latitude, p_size * (-2.5)::double as longitude from part)"
REPORTS = "reports as (select l_partkey as campsite_id, l_linestatus = 'O' as is_open from lineitem where l_returnflag <> 'R')"
STATUS = f"{REPORTS}, status as (select campsite_id, bool_or(is_open) as is_open from reports group by 1)"
AMEN = "amen as (select p_partkey as campsite_id, p_size < 25 as water, p_brand < 'Brand#3' as restrooms from part where p_size <= 40)"
WEATHER = "weather as (select user_id as campsite_id, arg_max(props, (ts, event_id)) as forecast_json from events group by 1)"


def filtered(where: str = "true", status: str = "status") -> str:
    return f"""{SITES}, {STATUS}, {AMEN}, {WEATHER},
rows_ as (select c.id, c.name, c.forest_name, c.latitude, c.longitude, s.is_open, w.forecast_json as forecast,
                 coalesce(a.water, false) as has_water, coalesce(a.restrooms, false) as has_restrooms
          from sites c left join {status} s on c.id = s.campsite_id left join weather w on c.id = w.campsite_id
               left join amen a on c.id = a.campsite_id where {where})"""


def masks(pattern: str, text: str) -> str:
    """A list of the places in ``pattern`` of each character of ``text``, as integers."""
    bits = f"list_sum(list_transform(range(0, length({pattern})), lambda i: if({pattern}[(i + 1)::int] = c, (1::hugeint << i::int), 0::hugeint)))"
    return f"list_transform(string_split({text}, ''), lambda c: coalesce({bits}, 0)::hugeint)"


def lcs(pattern: str, text: str) -> str:
    """Length of the longest common subsequence of two texts that are not empty, bit by bit."""
    full = f"((1::hugeint << length({pattern})::int) - 1)"
    step = f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}"
    return f"(length({pattern}) - bit_count(list_reduce({masks(pattern, text)}, {step}, {full})))"


def ratio(a: str, b: str) -> str:
    n = f"(length({a}) + length({b}))"
    return (
        f"(case when {n} = 0 then 100.0::double when length({a}) = 0 or length({b}) = 0 then 0.0::double "
        f"else (1 - ({n} - 2 * {lcs(a, b)})::double / {n}::double) * 100::double end)"
    )


def partials(source: str, column: str, q: str) -> str:
    """CTEs up to ``part(x, p)``: the partial ratio of each distinct ``column`` of ``source`` with a constant."""
    lit = "'" + q.replace("'", "''") + "'"
    return f"""texts as (select distinct {column} as x from {source}),
sides as (select x, case when length(x) < {len(q)} then x else {lit} end as s, case when length(x) < {len(q)} then {lit} else x end as l from texts
          union all select x, x, {lit} from texts where length(x) = {len(q)}),
wins as (select x, s, l[(greatest(i, 0) + 1)::int : least(i + length(s), length(l))::int] as w
         from (select x, s, l, unnest(range(1 - length(s), length(l))) as i from sides where length(s) > 0)),
part as (select t.x, case when length(t.x) = 0 and {len(q)} = 0 then 100.0 when length(t.x) = 0 or {len(q)} = 0 then 0.0 else max(w.r) end as p
         from texts t left join (select x, {ratio("s", "w")} as r from wins) w on t.x = w.x group by t.x)"""


def search(query: str, where: str = "true", threshold: int = 40, limit: int = 200, status: str = "status") -> str:
    """The fuzzy search over ``rows_``; an exact hit is one row."""
    q = "".join(query.lower().split())
    lit = "'" + q.replace("'", "''") + "'"
    flat = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '\\s+', '', 'g')"
    names = partials("flat", "n", q).replace("texts", "ntexts").replace("sides", "nsides").replace("wins", "nwins").replace("part as", "npart as")
    regions = partials("flat", "f", q).replace("texts", "ftexts").replace("sides", "fsides").replace("wins", "fwins").replace("part as", "fpart as")
    return f"""
with {filtered(where, status)},
flat as (select *, {flat("name")} as n, {flat("forest_name")} as f from rows_),
{names},
{regions},
nratio as (select x, {ratio("x", lit)} as r from ntexts),
scored as (select k.*, greatest(r.r, case when length(n) > 0 then np.p * ({float(len(q))}::double / length(n)) else np.p end) as score,
                  fp.p as forest_part, greatest(fp.p * 0.6::double, case when contains(f, {lit}) then 100.0 else 0.0 end) as forest_score
           from flat k join nratio r on k.n = r.x join npart np on k.n = np.x join fpart fp on k.f = fp.x),
facts as (select min(id) filter (where score = 100 and forest_score <> 100) as exact_id, coalesce(max(score), 0) as best_site,
                 coalesce(max(forest_score), 0) as best_forest from scored),
win as (select forest_name from scored where forest_score >= {threshold} order by forest_part desc, id limit 1)
select id, name, forest_name, latitude, longitude, score, is_open, forecast, has_water, has_restrooms
from scored, facts
where case when exact_id is not null then id = exact_id
           when best_forest >= {threshold} and best_forest > best_site
             then forest_score >= {threshold} and forest_name is not distinct from (select forest_name from win)
           else score >= {threshold} end
order by score desc, id, coalesce(is_open, false), coalesce(forecast, ''), has_water, has_restrooms
limit (select case when exact_id is not null then 1 else {limit} end from facts)
"""
