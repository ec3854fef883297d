"""SQL for those of this folder's queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "p1_bounds": """
with a as (select 'node_indicators' as src, country_id, load_day, null::varchar as data, null::varchar as heuristic, null::int as k, x
           from (select distinct on (outid, load_day) country_id, load_day, "Country_physicians" as x from node_indicators) where isfinite(x)),
b as (select 'solver_logs' as src, null::bigint as country_id, null::timestamp as load_day, data, heuristic, k, x
      from (select distinct on (log_id) data, heuristic, k, cpu_time as x from solver_logs) where isfinite(x)),
g as (select src, country_id, load_day, data, heuristic, k, count(*) as n from (select * from a union all select * from b) group by all)
select g.*, p as percentile, true as within from g, (select unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::double as p)
""",
}
