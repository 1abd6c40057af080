"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written directly in SQL against the parquet views (region nation customer
part orders lineitem); the test-domain adapter is restated as CTEs.  Final
double columns are rounded to 6 decimals like the Spark side.  Brute-force
forms are used on purpose (cross joins for year grids, range joins for
cumulative sums): this file is a check, not the engine.
"""

from __future__ import annotations

DBL = "CAST({} AS DOUBLE)".format
H = DBL(8760)
KWH_EJ = "3.6e-12"
KWH_GJ = "3.6e-3"
R6 = "round({0}, 6) + 0.0 AS {0}".format           # + 0.0: no negative zero
# the run's model periods from the base year on, read from the data
YEARS_VALUES = "(SELECT DISTINCT period AS y FROM outputs WHERE period >= 1996) AS yy"
NEXT_YEARS = "SELECT DISTINCT period + 1 FROM outputs WHERE period >= 1996"
REF, EXO, ENDO = "Reference_exogenous", "NZ_exogenous", "Reference_NZ_endogenous"


def _roles(adj: str, noun: str) -> tuple[str, str, str]:
    ccs = f"({noun} || ' (conv CCS)')"
    sector = (f"CASE {adj} WHEN 'new' THEN 'electricity' WHEN 'large' THEN 'electricity' "
              f"WHEN 'old' THEN 'electricity' WHEN 'hot' THEN 'electricity' "
              f"WHEN 'cold' THEN 'elec_' || {ccs} WHEN 'small' THEN 'elect_td_bld' "
              f"WHEN 'blue' THEN 'electricity' WHEN 'red' THEN 'elec_water_td' END")
    subsector = (f"CASE WHEN {adj} IN ('new', 'large', 'old', 'hot', 'blue') THEN {noun} "
                 f"WHEN {adj} = 'cold' THEN {ccs} WHEN {adj} = 'small' THEN 'rooftop_pv' "
                 f"WHEN {adj} = 'red' THEN 'water_td' END")
    technology = (f"CASE {adj} WHEN 'new' THEN {noun} WHEN 'large' THEN {noun} || '_storage' "
                  f"WHEN 'old' THEN {noun} || ' (conv)' WHEN 'hot' THEN {ccs} "
                  f"WHEN 'cold' THEN {ccs} || ' (recirculating)' "
                  f"WHEN 'small' THEN 'rooftop_' || {noun} WHEN 'blue' THEN {noun} || '_offshore' "
                  f"WHEN 'red' THEN {noun} || ' (water)' END")
    return sector, subsector, technology


_S, _SS, _T = _roles("adj", "noun")
ELEC = ("((sector IN ('electricity', 'elect_td_bld') OR coalesce(contains(sector, 'elec_'), false))"
        " AND NOT coalesce(contains(sector, 'water_td'), false))")
TECH6 = "scenario, region, year, sector, subsector, technology"


def rx(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, '{pattern}'), false)"


def strict(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN sum({x}) END"


def case_rules(col: str, rules) -> str:
    body = " ".join(f"WHEN {rx(col, p)} THEN '{label}'" for p, label in rules)
    return f"CASE {body} ELSE {col} END"


def ordinal(col: str, levels) -> str:
    body = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(levels, 1))
    return f"CAST(CASE {col} {body} END AS INTEGER)"


CTES = f"""
nr AS (SELECT n.n_nationkey, r.r_name AS region FROM nation n JOIN region r
       ON n.n_regionkey = r.r_regionkey),
od AS (SELECT o.o_orderkey, nr.region, CAST(year(o.o_orderdate) AS INTEGER) AS period
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nr ON c.c_nationkey = nr.n_nationkey),
pn AS (SELECT p_partkey, p_size, split_part(p_name, ' ', 1) AS adj,
              split_part(p_name, ' ', 2) AS noun FROM part),
pd AS (SELECT p_partkey, p_size, {_S} AS sector, {_SS} AS subsector, {_T} AS technology FROM pn),
base AS (SELECT CASE l.l_returnflag WHEN 'A' THEN '{REF}' WHEN 'N' THEN '{EXO}'
                WHEN 'R' THEN '{ENDO}' END AS scenario,
                od.region, pd.sector, pd.subsector, pd.technology, od.period,
                CAST(year(l.l_shipdate) AS INTEGER) AS year, l.l_linestatus,
                sum(l.l_quantity) AS qty, max(l.l_extendedprice) AS price,
                min(pd.p_size) AS min_size
         FROM lineitem l JOIN od ON l.l_orderkey = od.o_orderkey
         JOIN pd ON l.l_partkey = pd.p_partkey
         GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
outputs AS (SELECT scenario, region, sector, subsector, technology, period,
                   'electricity' AS output, year, sum(qty) * 1e-6 AS value
            FROM base GROUP BY scenario, region, sector, subsector, technology, period, year),
capacity_factors AS (SELECT scenario, region, sector, subsector, technology, period,
                            (min(min_size) % 10) / {DBL(10)} AS value
                     FROM base GROUP BY scenario, region, sector, subsector, technology, period),
input_costs AS (SELECT scenario, region, sector, subsector, technology, period,
                       CASE WHEN l_linestatus = 'O' THEN 'capital' ELSE 'OM-fixed' END AS input,
                       year, price / 1e4 AS value FROM base),
market_prices AS (SELECT CASE o.o_orderstatus WHEN 'F' THEN '{REF}' WHEN 'O' THEN '{EXO}'
                         WHEN 'P' THEN '{ENDO}' END AS scenario,
                         replace(nr.region, ' ', '') || CASE WHEN c.c_mktsegment IN
                           ('BUILDING', 'MACHINERY') THEN 'CO2' ELSE c.c_mktsegment END AS market,
                         CAST(year(o.o_orderdate) AS INTEGER) AS year,
                         max(o.o_totalprice) / 1e3 AS value
                  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                  JOIN nr ON c.c_nationkey = nr.n_nationkey GROUP BY 1, 2, 3),
names AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun
          FROM part),
names_t AS (SELECT adj, noun, {_S} AS sector, {_SS} AS subsector, {_T} AS technology FROM names),
cooling_map AS (SELECT 'electricity' AS sector_passthru, noun AS subsector_passthru,
                       noun || ' (conv CCS)' AS technology_passthru,
                       'elec_' || noun || ' (conv CCS)' AS sector, noun || ' (conv CCS)' AS subsector,
                       noun || ' (conv CCS) (recirculating)' AS technology
                FROM names WHERE adj = 'cold'),
deployment_map AS (
  SELECT sector, subsector, technology, adj AS role, noun || ' module' AS learning_component,
         1 AS multiplier FROM names_t WHERE adj IN ('new', 'large', 'old', 'small')
  UNION ALL SELECT sector, subsector, technology, adj, noun || ' BOS', 1 FROM names_t
         WHERE adj IN ('new', 'large')
  UNION ALL SELECT sector, subsector, technology, adj, 'grid_storage', 2 FROM names_t WHERE adj = 'large'
  UNION ALL SELECT sector, subsector, technology, adj, 'CCS ' || noun, 1 FROM names_t WHERE adj = 'hot'
  UNION ALL SELECT sector, subsector, technology, adj, 'CCS capture', 1 FROM names_t WHERE adj = 'hot'
  UNION ALL SELECT sector, subsector, technology, adj, 'rooftop BOS', 1 FROM names_t WHERE adj = 'small'
  UNION ALL SELECT sector, subsector, technology, adj, noun || '_offshore', 1 FROM names_t
         WHERE adj = 'blue'),
learning_map AS (SELECT sector, subsector, technology, learning_component FROM deployment_map
                 WHERE role <> 'old'),
out_techs AS (SELECT DISTINCT region, sector, subsector, technology FROM outputs),
region_components AS (SELECT DISTINCT o.region, d.learning_component FROM out_techs o
                      JOIN deployment_map d ON o.sector = d.sector AND o.subsector = d.subsector
                      AND o.technology = d.technology),
learning_rates AS (SELECT region, learning_component,
                          {DBL(0.05)} + {DBL(0.01)} * length(learning_component) AS learning_rate
                   FROM region_components),
t0 AS (SELECT region, learning_component, {DBL(100)} * length(learning_component) AS t0_cost,
              CASE WHEN starts_with(learning_component, 'CCS ') OR
                        ends_with(learning_component, '_offshore') THEN {DBL(1)}
                   ELSE {DBL(1000)} * length(learning_component) END AS t0_deployment
       FROM region_components),
tech_fcr AS (SELECT region, sector, subsector, technology,
                    CASE WHEN sector = 'elect_td_bld' THEN {DBL(0.1)} ELSE {DBL(0.13)} END AS FCR
             FROM out_techs o WHERE EXISTS (SELECT 1 FROM learning_map m WHERE m.sector = o.sector
                   AND m.subsector = o.subsector AND m.technology = o.technology)),
rewrites AS (SELECT DISTINCT 'sector' AS level, sector AS from_label, sector_passthru AS to_label
             FROM cooling_map
             UNION SELECT DISTINCT 'subsector', subsector, subsector_passthru FROM cooling_map),
rw_sector AS (SELECT DISTINCT from_label, to_label FROM rewrites WHERE level = 'sector'),
rw_subsector AS (SELECT DISTINCT from_label, to_label FROM rewrites WHERE level = 'subsector'),
relabelled AS (SELECT o.scenario, o.region, coalesce(a.to_label, o.sector) AS sector,
                      coalesce(b.to_label, o.subsector) AS subsector, o.technology, o.period,
                      o.output, o.year, o.value
               FROM outputs o LEFT JOIN rw_sector a ON o.sector = a.from_label
               LEFT JOIN rw_subsector b ON o.subsector = b.from_label),
gen_kept AS (SELECT * FROM outputs WHERE {ELEC}
             AND coalesce(subsector <> 'elect_td_bld', true)
             AND NOT EXISTS (SELECT 1 FROM cooling_map c
                             WHERE c.technology_passthru = outputs.technology)),
gen_filter AS (SELECT o.scenario, o.region, coalesce(a.to_label, o.sector) AS sector,
                      coalesce(b.to_label, o.subsector) AS subsector, o.technology, o.period,
                      o.output, o.year, o.value
               FROM gen_kept o LEFT JOIN rw_sector a ON o.sector = a.from_label
               LEFT JOIN rw_subsector b ON o.subsector = b.from_label),
q1 AS (SELECT scenario, region, sector, subsector, technology, year, sum(value) AS value
       FROM outputs WHERE {ELEC} AND coalesce(subsector <> 'elect_td_bld', true) AND year = period
       AND NOT EXISTS (SELECT 1 FROM cooling_map c WHERE c.technology_passthru = outputs.technology)
       GROUP BY scenario, region, sector, subsector, technology, year),
q3 AS (SELECT scenario, region, sector, subsector, technology, period AS year, value
       FROM capacity_factors),
q4 AS (SELECT scenario, region, sector, subsector,
              technology || ',year=' || CAST(period AS VARCHAR) AS technology, input, year, value
       FROM input_costs WHERE {ELEC} AND year = period),
q6 AS (SELECT scenario, market, year, value FROM market_prices
       WHERE coalesce(contains(market, 'CO2'), false)),
costs AS (SELECT scenario, region, sector, subsector,
                 regexp_replace(split_part(technology, '=', 1), ',year', '', 'g') AS technology,
                 TRY_CAST(trim(string_split(technology, '=')[2]) AS DOUBLE) AS vintage,
                 input, year, value FROM q4 WHERE input = 'capital'),
costs_cf AS (SELECT c.*, f.value AS cap_factor FROM costs c LEFT JOIN q3 f
             USING (scenario, region, year, sector, subsector, technology)),
gen_cap AS (SELECT g.year, g.region, g.sector, g.subsector, g.technology, g.scenario,
                   g.value AS generation, f.value AS cap_factor,
                   g.value / {KWH_EJ} / {H} / f.value AS capacity
            FROM q1 g LEFT JOIN q3 f USING (year, region, sector, subsector, technology, scenario)
            WHERE g.year >= 1996),
cap_rolled AS (SELECT g.year, g.region, coalesce(m.sector_passthru, g.sector) AS sector,
                      coalesce(m.subsector_passthru, g.subsector) AS subsector,
                      coalesce(m.technology_passthru, g.technology) AS technology,
                      g.scenario, g.generation, g.cap_factor, g.capacity
               FROM gen_cap g LEFT JOIN cooling_map m ON g.sector = m.sector
               AND g.subsector = m.subsector AND g.technology = m.technology),
comp AS (SELECT * FROM (SELECT c.scenario, c.region, d.learning_component, c.year,
                               {strict('c.capacity * d.multiplier')} AS capacity
                        FROM cap_rolled c JOIN deployment_map d ON c.sector = d.sector
                        AND c.subsector = d.subsector AND c.technology = d.technology
                        GROUP BY 1, 2, 3, 4) WHERE capacity IS NOT NULL AND NOT isnan(capacity)),
comp_keys AS (SELECT DISTINCT scenario, region, learning_component FROM comp),
cum AS (SELECT k.scenario, k.region, k.learning_component, yy.y AS year,
               coalesce(c.capacity, 0) AS capacity,
               sum(coalesce(c.capacity, 0)) OVER (PARTITION BY k.scenario, k.region,
                   k.learning_component ORDER BY yy.y ROWS BETWEEN UNBOUNDED PRECEDING
                   AND CURRENT ROW) AS cum_cap
        FROM comp_keys k CROSS JOIN {YEARS_VALUES}
        LEFT JOIN comp c ON c.scenario = k.scenario AND c.region = k.region
        AND c.learning_component = k.learning_component AND c.year = yy.y),
learned AS (SELECT c.region, c.learning_component, c.scenario, c.year, c.capacity, c.cum_cap,
                   r.learning_rate, t.t0_cost, t.t0_deployment,
                   CASE WHEN c.cum_cap = 0 THEN {DBL(0)} ELSE t.t0_cost *
                     pow(c.cum_cap / t.t0_deployment, log2(1.0 - r.learning_rate)) END
                     AS learned_cost
            FROM cum c LEFT JOIN learning_rates r USING (region, learning_component)
            LEFT JOIN t0 t USING (region, learning_component)),
lagged AS (SELECT scenario, region, year, learning_component, learned_cost FROM (
             SELECT scenario, region, year, learning_component,
                    lag(learned_cost) OVER (PARTITION BY scenario, region, learning_component
                                            ORDER BY year) AS learned_cost
             FROM learned WHERE learned_cost <> 0) WHERE year > 1996),
tech_narm AS (SELECT l.scenario, l.region, l.year, m.sector, m.subsector, m.technology,
                     coalesce(sum(l.learned_cost), {DBL(0)}) AS learned_cost
              FROM lagged l LEFT JOIN learning_map m USING (learning_component)
              GROUP BY 1, 2, 3, 4, 5, 6),
tech_strict AS (SELECT l.scenario, l.region, l.year, m.sector, m.subsector, m.technology,
                       {strict('l.learned_cost')} AS learned_cost
                FROM lagged l LEFT JOIN learning_map m USING (learning_component)
                GROUP BY 1, 2, 3, 4, 5, 6),
overnight AS (SELECT c.scenario, region, sector, subsector, technology, c.year,
                     c.value / f.FCR * {H} * c.cap_factor * {KWH_GJ} AS cap_cost
              FROM costs_cf c RIGHT JOIN tech_fcr f USING (region, sector, subsector, technology)),
nl_storage_long AS (SELECT scenario, region, year, sector, subsector,
                           split_part(technology, '_', 1) AS technology,
                           coalesce(string_split(technology, '_')[2], 'no_storage') AS storage,
                           value / {DBL(0.13)} * {H} * cap_factor * {KWH_GJ} AS cap_cost
                    FROM costs_cf WHERE {rx('technology', '^gear(_storage)?$')}),
nl_storage AS (SELECT scenario, region, year, sector, subsector, technology || '_storage' AS technology,
                      max(CASE WHEN storage = 'storage' THEN cap_cost END)
                      - max(CASE WHEN storage = 'no_storage' THEN cap_cost END) AS nonlearning_cap
               FROM nl_storage_long GROUP BY scenario, region, year, sector, subsector, technology),
nl_ccs_long AS (SELECT scenario, region, year, sector, subsector,
                       regexp_replace(technology, ' CCS', '', 'g') AS technology,
                       CASE WHEN {rx('technology', 'CCS')} THEN 'CCS' ELSE 'no_CCS' END AS ccs,
                       value / {DBL(0.13)} * {H} * cap_factor * {KWH_GJ} AS cap_cost
                FROM costs_cf WHERE {rx('technology', '\\(conv')}
                AND NOT {rx('technology', 'recirculating')}),
nl_ccs AS (SELECT scenario, region, year, sector, subsector,
                  regexp_replace(technology, '\\)', ' CCS)', 'g') AS technology,
                  max(CASE WHEN ccs = 'no_CCS' THEN cap_cost END) AS nonlearning_cap
           FROM nl_ccs_long GROUP BY scenario, region, year, sector, subsector, technology),
nl_all AS (SELECT * FROM nl_storage UNION ALL SELECT * FROM nl_ccs),
cmp_wide AS (SELECT t.scenario, t.region, t.year, t.sector, t.subsector, t.technology,
                    t.learned_cost, o.cap_cost,
                    t.learned_cost + coalesce(n.nonlearning_cap, 0) AS learned_cost_total
             FROM tech_narm t LEFT JOIN overnight o USING ({TECH6})
             LEFT JOIN nl_all n USING ({TECH6})),
cmp_long AS (SELECT {TECH6}, 'learned_cost' AS source, learned_cost AS value FROM cmp_wide
             UNION ALL SELECT {TECH6}, 'cap_cost', cap_cost FROM cmp_wide
             UNION ALL SELECT {TECH6}, 'learned_cost_total', learned_cost_total FROM cmp_wide),
adders AS (SELECT w.scenario, w.region, w.year, w.sector, w.subsector, w.technology,
                  w.cap_cost - coalesce(w.learned_cost, 0) - coalesce(n.nonlearning_cap, 0)
                    AS cal_adder
           FROM cmp_wide w LEFT JOIN nl_all n USING ({TECH6}) WHERE w.year >= 1997),
plot_rows AS (SELECT * FROM cmp_long WHERE source <> 'learned_cost' AND value > 0
              AND NOT (year = 1997 AND {rx('technology', 'rooftop|storage')})),
gen_all AS (SELECT * FROM outputs WHERE sector = 'electricity' AND NOT EXISTS
              (SELECT 1 FROM cooling_map c WHERE c.technology_passthru = outputs.technology)
            UNION ALL SELECT * FROM outputs WHERE {rx('sector', '^elec_')} AND sector IN
              (SELECT sector FROM cooling_map)
            UNION ALL SELECT * FROM outputs WHERE sector = 'elect_td_bld'
              AND subsector = 'rooftop_pv'),
cf_all AS (SELECT scenario, region, sector, subsector, technology, period, value AS capacity_factor
           FROM capacity_factors WHERE sector = 'electricity' OR (sector = 'elect_td_bld'
           AND subsector = 'rooftop_pv')),
costs_all AS (SELECT scenario, region, sector, subsector, technology, period, input, year,
                     value AS adjusted_cost FROM input_costs WHERE sector = 'electricity'
                     OR (sector = 'elect_td_bld' AND subsector = 'rooftop_pv')),
upd_gen AS (SELECT g.scenario, g.region, coalesce(m.sector_passthru, g.sector) AS sector,
                   coalesce(m.subsector_passthru, g.subsector) AS subsector,
                   coalesce(m.technology_passthru, g.technology) AS technology, g.period, g.value
            FROM gen_all g LEFT JOIN cooling_map m ON g.sector = m.sector
            AND g.subsector = m.subsector AND g.technology = m.technology
            WHERE g.period >= 1996 AND g.period = g.year),
vcap AS (SELECT g.scenario, g.region, g.sector, g.subsector, g.technology, g.period,
                {strict(f'g.value / {KWH_EJ} / {H} / f.capacity_factor')} AS capacity
         FROM upd_gen g LEFT JOIN cf_all f USING (scenario, region, sector, subsector, technology,
                                                  period)
         GROUP BY 1, 2, 3, 4, 5, 6),
comp_p AS (SELECT v.scenario, v.region, d.learning_component, v.period,
                  {strict('v.capacity * d.multiplier')} AS capacity
           FROM vcap v JOIN deployment_map d ON v.sector = d.sector AND v.subsector = d.subsector
           AND v.technology = d.technology GROUP BY 1, 2, 3, 4),
cum_p AS (SELECT c.scenario, c.region, c.learning_component, yy.y AS update_year,
                 {strict('c.capacity')} AS value
          FROM comp_p c JOIN {YEARS_VALUES} ON c.period <= yy.y GROUP BY 1, 2, 3, 4),
grid AS (SELECT s.scenario, s.region, r.learning_component, r.learning_rate, yy.y AS update_year
         FROM (SELECT DISTINCT scenario, region FROM vcap) s JOIN learning_rates r USING (region)
         CROSS JOIN {YEARS_VALUES}),
comp_cost AS (SELECT g.scenario, g.region, g.learning_component, g.update_year + 1 AS year,
                     CASE WHEN c.value = 0 THEN {DBL(0)} ELSE t.t0_cost *
                       pow(c.value / t.t0_deployment, log2(1.0 - g.learning_rate)) END
                       AS cost_adj
              FROM grid g LEFT JOIN cum_p c USING (scenario, region, learning_component, update_year)
              LEFT JOIN t0 t USING (region, learning_component)),
upd_tech AS (SELECT c.scenario, c.region, c.year, m.sector, m.subsector, m.technology,
                    {strict('c.cost_adj')} AS cost_adj
             FROM comp_cost c LEFT JOIN learning_map m USING (learning_component)
             GROUP BY 1, 2, 3, 4, 5, 6),
ref_nl AS (SELECT region, year, sector, subsector, technology, nonlearning_cap FROM nl_all
           WHERE scenario = '{REF}'),
ref_ca AS (SELECT region, year, sector, subsector, technology, cal_adder FROM adders
           WHERE scenario = '{REF}'),
upd_d AS (SELECT t.*, coalesce(n.nonlearning_cap, 0) AS nonlearning_cap,
                 coalesce(a.cal_adder, 0) AS cal_adder
          FROM upd_tech t LEFT JOIN ref_nl n USING (region, year, sector, subsector, technology)
          LEFT JOIN ref_ca a USING (region, year, sector, subsector, technology)),
upd_adj AS (SELECT d.scenario, d.region, d.sector, d.subsector, d.technology,
                   'capital' AS input, d.year AS period,
                   (d.cost_adj + d.cal_adder + d.nonlearning_cap) * f.FCR / {H}
                     / c.capacity_factor / {KWH_GJ} AS adj_cost_new
            FROM upd_d d LEFT JOIN cf_all c ON c.scenario = d.scenario AND c.region = d.region
            AND c.sector = d.sector AND c.subsector = d.subsector AND c.technology = d.technology
            AND c.period = d.year
            LEFT JOIN tech_fcr f ON f.region = d.region AND f.sector = d.sector
            AND f.subsector = d.subsector AND f.technology = d.technology
            WHERE NOT (d.cost_adj = 0 AND d.cal_adder = 0)),
q5 AS (SELECT scenario, region, sector, subsector,
              technology || ',year=' || CAST(period AS VARCHAR) AS technology, year,
              sum(value) AS value
       FROM gen_filter GROUP BY 1, 2, 3, 4, 5, 6),
q5s AS (SELECT scenario, region, sector, subsector, split_part(technology, ',', 1) AS technology,
               string_split(technology, ',')[2] AS vintage, year, value FROM q5),
q2r AS (SELECT scenario, region, sector, subsector, technology, year, sum(value) AS value
        FROM gen_filter WHERE year = period GROUP BY 1, 2, 3, 4, 5, 6),
cap_new AS (SELECT g.scenario, g.region, g.year, g.sector, g.subsector,
                   {case_rules('g.technology', (('gear_storage', 'gear_storage'), ('gear', 'gear'), ('bolt', 'bolt'), ('ring \\(conv CCS', 'ring CCS'), ('CCS', 'other CCS')))} AS technology,
                   'GW' AS units,
                   {strict(f'g.value / {KWH_EJ} / {H} / f.value * 1e-6')} AS capacity
            FROM q2r g LEFT JOIN q3 f USING (year, region, technology, scenario)
            WHERE {rx('g.technology', 'gear|bolt|ring|rooftop|CCS')}
            AND NOT {rx('g.technology', 'water|conv\\)')}
            GROUP BY 1, 2, 3, 4, 5, 6, 7),
fuel AS (SELECT scenario, region,
                {case_rules('technology', (('anvil', 'anvil'), ('bolt', 'bolt'), ('gear', 'gear'), ('gizmo', 'gizmo'), ('plate', 'plate'), ('ring', 'ring'), ('rod', 'rod'), ('widget', 'widget')))} AS technology,
                CASE WHEN {rx('technology', 'CCS')} THEN 'CCS' ELSE 'unabated' END AS CCS,
                year, {strict('value')} AS value
         FROM q5s GROUP BY 1, 2, 3, 4, 5),
fuel_o AS (SELECT *, {ordinal('technology', ('anvil', 'bolt', 'gear', 'gizmo', 'plate', 'ring', 'rod'))}
                  AS technology_ord FROM fuel),
fuel_w AS (SELECT region, technology, CCS, year, technology_ord,
                  coalesce(max(CASE WHEN scenario = '{REF}' THEN value END), 0) AS ref,
                  coalesce(max(CASE WHEN scenario = '{EXO}' THEN value END), 0) AS exo,
                  coalesce(max(CASE WHEN scenario = '{ENDO}' THEN value END), 0) AS endo
           FROM fuel_o GROUP BY 1, 2, 3, 4, 5),
fuel_w2 AS (SELECT region, technology, CCS, year, technology_ord,
                   coalesce(max(CASE WHEN scenario = '{EXO}' THEN value END), 0) AS exo,
                   coalesce(max(CASE WHEN scenario = '{ENDO}' THEN value END), 0) AS endo
            FROM fuel_o WHERE scenario <> '{REF}' GROUP BY 1, 2, 3, 4, 5)
"""

CAPITAL_LEVELS = ("gear", "bolt", "gear_storage", "bolt_storage", "rooftop_gear",
                  "rooftop_bolt", "gear (conv CCS)", "bolt (conv CCS)")

SERIES = f"""SELECT scenario, region, sector, subsector, split_part(technology, ',', 1) AS technology,
       TRY_CAST(trim(regexp_replace(string_split(technology, ',')[2], 'year=', '', 'g')) AS DOUBLE)
         AS vintage, input, year, value,
       {ordinal("split_part(technology, ',', 1)", CAPITAL_LEVELS)} AS technology_ord
FROM q4 WHERE input = 'capital' AND {rx('technology', 'gear|bolt|rooftop|CCS')}
AND NOT {rx('technology', 'water|offshore')}"""

CAP_INSTALLED = f"""SELECT g.scenario, g.region, g.year, g.sector, g.subsector,
       {case_rules('g.technology', (('gear_storage', 'gear_storage'), ('gear', 'gear'), ('bolt', 'bolt'), ('ring \\(conv CCS', 'ring CCS'), ('CCS', 'other CCS')))} AS technology,
       'GW' AS units,
       {strict(f'g.value / {KWH_EJ} / {H} / f.value * 1e-6')} AS capacity
FROM q5s g LEFT JOIN q3 f USING (year, region, technology, scenario)
WHERE {rx('g.technology', 'gear|bolt|ring|rooftop|CCS')} AND NOT {rx('g.technology', 'water|conv\\)')}
GROUP BY 1, 2, 3, 4, 5, 6, 7"""

CAP_LEVELS = ("gear", "gear_storage", "bolt", "ring", "ring CCS", "other CCS", "rooftop_ring")

DIFF_PAIR = (
    "SELECT *, CAST(CASE scenario WHEN 'NZ_exogenous' THEN 1 WHEN "
    "'diff_NZ_endogenous_exogenous' THEN 2 END AS INTEGER) AS scenario_ord FROM ("
    f"SELECT region, technology, CCS, year, technology_ord, endo AS {ENDO}, '{EXO}' AS scenario,"
    " exo AS value FROM fuel_w2 UNION ALL "
    f"SELECT region, technology, CCS, year, technology_ord, endo, "
    "'diff_NZ_endogenous_exogenous', endo - exo FROM fuel_w2)")

CAP_CUMULATIVE = (
    "SELECT *, CASE WHEN count(capacity) OVER w = count(*) OVER w THEN sum(capacity) OVER w "
    "END AS cum_cap FROM cap_new WHERE year >= 1996 WINDOW w AS (PARTITION BY scenario, "
    "region, sector, subsector, technology, units ORDER BY year ROWS BETWEEN UNBOUNDED "
    "PRECEDING AND CURRENT ROW)")


def chart(select: str, levels: tuple[str, ...] | None = None) -> str:
    order = f", {ordinal('technology', levels)} AS technology_ord" if levels else ""
    return f"SELECT *{order} FROM ({select}) WHERE year BETWEEN 1996 AND 2001"


FINAL = {
    "learning_curve": ("SELECT * FROM lagged", ["learned_cost"]),
    "new_vintage_generation": ("SELECT * FROM q1", ["value"]),
    "labelled_generation": ("SELECT * FROM q2r", ["value"]),
    "capacity_factors": ("SELECT * FROM q3", ["value"]),
    "input_costs": ("SELECT * FROM q4", ["value"]),
    "all_vintage_generation": ("SELECT * FROM q5", ["value"]),
    "market_prices": ("SELECT * FROM q6", ["value"]),
    "path_generation": ("SELECT scenario, region, sector, subsector, technology, period, output, "
                        "year, value AS physical_output FROM outputs WHERE sector = 'electricity'",
                        ["physical_output"]),
    "path_rooftop_generation": ("SELECT scenario, region, sector, subsector, technology, period, "
                                "output, year, value AS physical_output FROM outputs WHERE "
                                "sector = 'elect_td_bld' AND subsector = 'rooftop_pv'",
                                ["physical_output"]),
    "path_costs": ("SELECT * FROM costs_all WHERE sector = 'electricity'", ["adjusted_cost"]),
    "path_rooftop_costs": ("SELECT * FROM costs_all WHERE sector = 'elect_td_bld'",
                           ["adjusted_cost"]),
    "path_capacity_factors": ("SELECT * FROM cf_all WHERE sector = 'electricity'",
                              ["capacity_factor"]),
    "path_rooftop_capacity_factors": ("SELECT * FROM cf_all WHERE sector = 'elect_td_bld'",
                                      ["capacity_factor"]),
    "path_cooling_generation": ("SELECT scenario, region, sector, subsector, technology, period, "
                                "output, year, value AS physical_output FROM outputs WHERE "
                                f"{rx('sector', '^elec_')}", ["physical_output"]),
    "label_rewrite": ("SELECT * FROM relabelled", ["value"]),
    "cooling_rollup": ("SELECT * FROM cap_rolled", ["generation", "cap_factor", "capacity"]),
    "generation_union": ("SELECT technology, scenario, region, sector, subsector, period, output, "
                         "year, value AS physical_output FROM gen_all", ["physical_output"]),
    "component_rollup": ("SELECT * FROM comp", ["capacity"]),
    "cumulative_deployment": ("SELECT * FROM cum", ["capacity", "cum_cap"]),
    "learned_cost_unlagged": ("SELECT * FROM learned",
                              ["capacity", "cum_cap", "learning_rate", "t0_cost", "t0_deployment",
                               "learned_cost"]),
    "technology_cost_narm": ("SELECT * FROM tech_narm", ["learned_cost"]),
    "technology_cost_strict": ("SELECT * FROM tech_strict", ["learned_cost"]),
    "overnight_cost": ("SELECT * FROM overnight", ["cap_cost"]),
    "nonlearning_storage": ("SELECT * FROM nl_storage", ["nonlearning_cap"]),
    "nonlearning_ccs": ("SELECT * FROM nl_ccs", ["nonlearning_cap"]),
    "nonlearning_all": ("SELECT * FROM nl_all", ["nonlearning_cap"]),
    "cost_comparison": ("SELECT * FROM cmp_long", ["value"]),
    "calibration_adders": ("SELECT * FROM adders", ["cal_adder"]),
    "calibration_plot_lines": (
        "SELECT scenario, region, year, sector, subsector, technology, CASE WHEN source = "
        "'cap_cost' THEN 'model default' ELSE 'Learning curve output (Ref)' END AS source, value "
        "FROM plot_rows", ["value"]),
    "calibration_plot_segments": (
        "SELECT * FROM (SELECT scenario, region, year, sector, subsector, technology, "
        "max(CASE WHEN source = 'cap_cost' THEN value END) AS cap_cost, "
        "max(CASE WHEN source = 'learned_cost_total' THEN value END) AS learned_cost_total "
        "FROM plot_rows GROUP BY 1, 2, 3, 4, 5, 6) WHERE cap_cost IS NOT NULL AND NOT "
        "isnan(cap_cost) AND learned_cost_total IS NOT NULL AND NOT isnan(learned_cost_total)",
        ["cap_cost", "learned_cost_total"]),
    "period_cost_update": ("SELECT * FROM upd_adj", ["adj_cost_new"]),
    "period_cost_update_one_period": ("SELECT * FROM upd_adj WHERE period = 2000", ["adj_cost_new"]),
    "cost_merge": (
        "SELECT c.scenario, c.region, c.sector, c.subsector, c.technology, c.period, c.input, "
        "c.year, coalesce(a.adj_cost_new, c.adjusted_cost) AS adjusted_cost FROM costs_all c "
        "LEFT JOIN upd_adj a USING (scenario, region, sector, subsector, technology, period, input) "
        f"WHERE c.period IN ({NEXT_YEARS})", ["adjusted_cost"]),
    "non_learning_capital_csv": ("SELECT * FROM ref_nl", ["nonlearning_cap"]),
    "cal_adders_csv": ("SELECT * FROM ref_ca", ["cal_adder"]),
    "scenario_runs": ("SELECT * FROM outputs", ["value"]),
    "xml_outputs": ("SELECT * FROM outputs", ["value"]),
    "xml_input_costs": ("SELECT * FROM input_costs", ["value"]),
    "xml_capacity_factors": ("SELECT * FROM capacity_factors WHERE value IS NOT NULL", ["value"]),
    "xml_market_prices": ("SELECT * FROM market_prices", ["value"]),
    "cost_write_back": (
        "SELECT c.region, c.sector, c.subsector, c.technology, c.input, c.year, "
        "coalesce(a.adj_cost_new, c.adjusted_cost) AS adjusted_cost, c.scenario, c.period "
        "FROM costs_all c LEFT JOIN upd_adj a "
        "USING (scenario, region, sector, subsector, technology, period, input) "
        f"WHERE c.period IN ({NEXT_YEARS})", ["adjusted_cost"]),
    "capital_cost_series": (SERIES, ["vintage", "value"]),
    "capital_cost_view": (
        "SELECT scenario_label AS scenario, * EXCLUDE (scenario, scenario_label) FROM ("
        f"SELECT *, CASE WHEN scenario = '{REF}' THEN 'model default' ELSE 'NZ endogenous' END "
        f"AS scenario_label FROM ({SERIES}) WHERE year BETWEEN 1996 AND 2001 AND scenario IN "
        f"('{REF}', '{ENDO}'))", ["vintage", "value"]),
    "capacity_new": ("SELECT * FROM cap_new", ["capacity"]),
    "capacity_cumulative": (CAP_CUMULATIVE, ["capacity", "cum_cap"]),
    "capacity_installed": (CAP_INSTALLED, ["capacity"]),
    "generation_by_fuel": ("SELECT * FROM fuel_o", ["value"]),
    "diff_to_reference": (
        "SELECT *, CAST(CASE scenario WHEN 'Reference_exogenous' THEN 1 WHEN 'NZ_exogenous' THEN 2 "
        "WHEN 'Reference_NZ_endogenous' THEN 3 END AS INTEGER) AS scenario_ord FROM ("
        f"SELECT region, technology, CCS, year, technology_ord, '{REF}' AS scenario, ref AS value "
        "FROM fuel_w UNION ALL "
        f"SELECT region, technology, CCS, year, technology_ord, '{EXO}', exo - ref FROM fuel_w "
        "UNION ALL "
        f"SELECT region, technology, CCS, year, technology_ord, '{ENDO}', endo - ref FROM fuel_w)",
        ["value"]),
    "diff_pair": (DIFF_PAIR, [ENDO, "value"]),
    "carbon_price": ("SELECT * FROM q6 WHERE market = 'AMERICACO2' AND year BETWEEN 1996 AND 2001",
                     ["value"]),
    "chart_generation": (chart("SELECT * FROM fuel_o"), ["value"]),
    "chart_capacity_new": (chart("SELECT * FROM cap_new", CAP_LEVELS), ["capacity"]),
    "chart_capacity_cumulative": (chart(CAP_CUMULATIVE, CAP_LEVELS), ["capacity", "cum_cap"]),
    "chart_capacity_installed": (chart(CAP_INSTALLED, CAP_LEVELS), ["capacity"]),
    "chart_generation_diff": (chart(DIFF_PAIR), [ENDO, "value"]),
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (select, doubles) in FINAL.items():
        repl = ", ".join(R6(c) for c in doubles)
        outer = f"SELECT * REPLACE ({repl}) FROM ({select}) AS final_rows" if doubles else select
        out[name] = f"WITH {CTES}\n{outer}"
    return out
