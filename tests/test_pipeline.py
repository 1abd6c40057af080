"""The calibration, update and results pipelines on a small hand-made model
output that uses the model's own names and the reference parameter files.

Covers: a missing year (complete), an undeployed component, a zero capacity
factor, a component fed by two technologies, multiplier 2, cooling-level
technologies, an unmapped technology, first-of-a-kind deployment, two
scenarios and two regions."""

import pytest
from pyspark.sql import functions as F

from expcurve import constants as K
from expcurve.operators import capacity as C
from expcurve.operators import capital as P
from expcurve.operators import learning as L
from expcurve.operators import techmap as T
from expcurve.plans import calibration as CAL
from expcurve.plans import results as R
from expcurve.plans import update as U
from expcurve.sources import queries as Q
from tests.conftest import rows

REF, NZ = K.REFERENCE_SCENARIO, K.EXOGENOUS_SCENARIO
PERIODS = (2015, 2020, 2025, 2030, 2035)

# (sector, subsector, technology): {period: generation EJ}
GENERATION = {
    ("electricity", "solar", "PV"): {2015: 0.10, 2020: 0.20, 2025: 0.30, 2030: 0.40},
    ("electricity", "solar", "PV_storage"): {2020: 0.05, 2025: 0.06, 2030: 0.07},
    ("elect_td_bld", "rooftop_pv", "rooftop_pv"): {2015: 0.01, 2020: 0.02, 2025: 0.03, 2030: 0.04},
    ("elec_CSP", "CSP", "CSP (dry_hybrid)"): {2015: 0.01, 2020: 0.01, 2025: 0.02, 2030: 0.02},
    ("elec_CSP_storage", "CSP_storage", "CSP_storage (dry_hybrid)"): {2015: 0.002, 2020: 0.005,
                                                                      2025: 0.01, 2030: 0.01},
    ("electricity", "wind", "wind"): {2015: 0.20, 2025: 0.30, 2030: 0.35},
    ("electricity", "wind", "wind_storage"): {2015: 0.01, 2020: 0.02, 2025: 0.02, 2030: 0.03},
    ("electricity", "wind", "wind_offshore"): {2025: 0.01, 2030: 0.02},
    ("elec_Gen_III", "Gen_III", "Gen_III (seawater)"): {2015: 0.05, 2020: 0.05, 2025: 0.06,
                                                        2030: 0.06},
    ("electricity", "hydro", "hydro"): {2015: 1.0, 2020: 1.0},
    ("elec_water_td", "water_td", "water (x)"): {2020: 0.5},
}
# technologies with capital costs: base cost per period (1975$/GJ)
COSTS = {
    ("electricity", "solar", "PV"): 3.0, ("electricity", "solar", "PV_storage"): 5.0,
    ("elect_td_bld", "rooftop_pv", "rooftop_pv"): 4.0, ("electricity", "solar", "CSP"): 6.0,
    ("electricity", "solar", "CSP_storage"): 8.0, ("electricity", "wind", "wind"): 2.0,
    ("electricity", "wind", "wind_storage"): 3.5, ("electricity", "wind", "wind_offshore"): 4.5,
    ("electricity", "nuclear", "Gen_III"): 7.0, ("electricity", "coal", "coal (conv pul)"): 1.5,
    ("electricity", "coal", "coal (conv pul CCS)"): 2.5,
}


def cap_factor(tech, period):
    if tech.startswith("Gen_III") and period == 2025:
        return 0.0
    return 0.2 if "CSP" not in tech else 0.4


@pytest.fixture(scope="module")
def facts(spark):
    return build_facts(spark)


def build_facts(spark):
    out, cf, cost = [], [], []
    for scen, scale in ((REF, 1.0), (NZ, 1.5)):
        for region, rs in (("USA", 1.0), ("Canada", 0.5)):
            for (s, ss, t), gen in GENERATION.items():
                for p, g in gen.items():
                    out.append((scen, region, s, ss, t, p, "electricity", p, g * scale * rs))
                    if p + 5 in PERIODS:   # the vintage still runs in the next period
                        out.append((scen, region, s, ss, t, p, "electricity", p + 5, g * 0.9 * scale * rs))
            techs = set(GENERATION) | set(COSTS)
            for s, ss, t in techs:
                for p in PERIODS:
                    cf.append((scen, region, s, ss, t, p, cap_factor(t, p)))
            for (s, ss, t), c in COSTS.items():
                for p in PERIODS:
                    v = c * (1 - 0.02 * (p - 2015) / 5) * (1.0 if scen == REF else 0.97)
                    cost.append((scen, region, s, ss, t, p, "capital", p, v))
                    cost.append((scen, region, s, ss, t, p, "OM-fixed", p, 0.1))
    k = "scenario string, region string, sector string, subsector string, technology string, period int"
    return {
        "outputs": spark.createDataFrame(out, f"{k}, output string, year int, value double"),
        "capacity_factors": spark.createDataFrame(cf, f"{k}, value double"),
        "input_costs": spark.createDataFrame(cost, f"{k}, input string, year int, value double"),
    }


@pytest.fixture(scope="module")
def calibration(facts, params):
    q1 = Q.new_vintage_generation(facts["outputs"], region=None)
    q3 = Q.capacity_factor_query(facts["capacity_factors"], region=None)
    q4 = Q.input_cost_query(facts["input_costs"], region=None)
    return CAL.run_calibration(q1, q3, q4, params)


def test_stored_query_predicates(facts):
    q1 = Q.new_vintage_generation(facts["outputs"], region="USA")
    techs = {r[0] for r in q1.select("technology").distinct().collect()}
    # pass-through names reported at cooling level and the water sector are out
    assert "CSP (dry_hybrid)" in techs and "water (x)" not in techs
    assert q1.where("year != 2015 and year != 2020 and year != 2025 and year != 2030").count() == 0
    q5 = Q.all_vintage_generation(facts["outputs"], region="USA")
    labels = {r[0] for r in q5.select("technology").collect()}
    assert "PV,year=2015" in labels
    sectors = {r[0] for r in q5.select("sector").distinct().collect()}
    assert sectors == {"electricity", "elect_td_bld"}   # elec_CSP rewritten


def test_label_rewrite_literal_map_has_no_join(facts):
    df = T.rewrite_labels(facts["outputs"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    got = rows(df.where("technology = 'CSP (dry_hybrid)'").select("sector", "subsector").distinct())
    assert got == [("electricity", "solar")]


def test_capacity_and_component_rollup(facts, params):
    gen = Q.new_vintage_generation(facts["outputs"], region=None).withColumnRenamed("value", "generation")
    cf = Q.capacity_factor_query(facts["capacity_factors"], region=None).withColumnRenamed("value", "cap_factor")
    cap = T.cooling_rollup(C.new_capacity(gen, cf), params["cooling_tech_map"])
    comp = C.component_rollup(cap, params["deployment_map"])
    got = {(r["scenario"], r["region"], r["learning_component"], r["year"]): r["capacity"]
           for r in comp.collect()}
    kw = lambda g, f: g / 3.6e-12 / 8760 / f
    # grid storage: two storage technologies, multiplier 2
    exp = 2 * kw(0.05, 0.2) + 2 * kw(0.02, 0.2)
    assert got[(REF, "USA", "grid_storage", 2020)] == pytest.approx(exp, rel=1e-12)
    # CSP learns from both cooling-level technologies, rolled up
    assert got[(REF, "USA", "CSP", 2020)] == pytest.approx(kw(0.01, 0.4) + kw(0.005, 0.4), rel=1e-12)
    # a zero capacity factor makes nuclear 2025 infinite; no CCS deployment at all
    assert got[(REF, "USA", "nuclear", 2025)] == float("inf")
    assert not any(k[2].startswith("CCS") for k in got)
    # wind_offshore starts in 2025: the complete grid gives it 0 before
    cum = C.cumulative_deployment(comp)
    w = {r["year"]: (r["capacity"], r["cum_cap"]) for r in cum.where(
        f"scenario = '{REF}' and region = 'USA' and learning_component = 'wind_offshore'").collect()}
    assert set(w) == {2015, 2020, 2025, 2030}
    assert w[2015] == (0.0, 0.0) and w[2020] == (0.0, 0.0)
    assert w[2030][1] == pytest.approx(w[2025][0] + w[2030][0], rel=1e-12)


def test_lag_and_first_of_a_kind(calibration):
    lc = calibration.learned_components
    off = dict(rows(lc.where(f"scenario = '{REF}' and region = 'USA' and "
                             "learning_component = 'wind_offshore'"), "year", "learned_cost"))
    assert off == {2025: None, 2030: pytest.approx(1118 * (1 - 0.088) ** 0 * 1.0, rel=1)}
    assert off[2025] is None
    tech = dict(rows(calibration.tech_cost.where(f"scenario = '{REF}' and region = 'USA' and "
                                                 "technology = 'wind_offshore'"), "year", "learned_cost"))
    assert tech[2025] == 0.0       # missing component cost ignored -> 0


def test_technology_cost_strict_vs_ignore(calibration, params):
    lc = calibration.learned_components
    narm = L.technology_cost(lc, params["learning_map"], "ignore")
    strict = L.technology_cost(lc, params["learning_map"], "strict")
    key = f"scenario = '{REF}' and region = 'USA' and technology = 'wind_offshore' and year = 2025"
    assert narm.where(key).first()["learned_cost"] == 0.0
    assert strict.where(key).first()["learned_cost"] is None


def test_calibration_inverse_and_csp_pair(calibration):
    ad = calibration.adders.alias("a")
    cmp = calibration.comparison
    nl = calibration.nonlearning
    j = (ad.join(cmp, ["scenario", "region", "year", "sector", "subsector", "technology"])
           .join(nl, ["scenario", "region", "year", "sector", "subsector", "technology"], "left")
           .na.fill(0.0, ["nonlearning_cap"]).where("cal_adder is not null"))
    assert j.count() > 0
    for r in j.collect():
        assert r["learned_cost"] + r["nonlearning_cap"] + r["cal_adder"] == pytest.approx(r["cap_cost"], rel=1e-9)
    a = {(r["region"], r["year"], r["technology"]): r["cal_adder"]
         for r in calibration.adders.where(f"scenario = '{REF}'").collect()}
    for (region, year, tech), v in a.items():
        if tech == "CSP":
            assert a[(region, year, "CSP_storage")] == pytest.approx(v, rel=1e-9)   # I1


def test_nonlearning_ccs_names(facts):
    q3 = Q.capacity_factor_query(facts["capacity_factors"], region=None)
    costs = P.capital_costs(Q.input_cost_query(facts["input_costs"], region=None))
    nl = P.nonlearning_ccs(costs, q3)
    assert {r[0] for r in nl.select("technology").distinct().collect()} == {"coal (conv pul CCS)"}
    st = P.nonlearning_storage(costs, q3)
    assert {r[0] for r in st.select("technology").distinct().collect()} == {"CSP_storage"}


def _update_inputs(facts, params):
    gen_all, costs_all, cf_all = U.update_inputs(facts["outputs"], facts["input_costs"],
                                                 facts["capacity_factors"], params["cooling_tech_map"])
    return gen_all, costs_all, cf_all


def test_update_all_periods_equals_one_period(facts, params, calibration):
    gen_all, _, cf_all = _update_inputs(facts, params)
    nl = CAL.for_scenario(calibration.nonlearning, REF)
    ca = CAL.for_scenario(calibration.adders, REF)
    allp = U.period_cost_update(gen_all, cf_all, params, nl, ca, update_years=[2015, 2020, 2025, 2030])
    for y in (2020, 2025):
        one = U.period_cost_update(gen_all, cf_all, params, nl, ca, current_year=y)
        assert rows(one) == rows(allp.where(F.col("period") == y + 5))


def test_update_with_own_adders_gives_back_exogenous_cost(facts, params, calibration):
    """Property: in the calibrated scenario, the learned cost + adders +
    non-learning capital, levelised, is the model's own capital cost."""
    gen_all, costs_all, cf_all = _update_inputs(facts, params)
    nl = CAL.for_scenario(calibration.nonlearning, REF)
    ca = CAL.for_scenario(calibration.adders, REF)
    adj = U.period_cost_update(gen_all, cf_all, params, nl, ca, update_years=[2015, 2020, 2025, 2030])
    merged = U.merge_costs(costs_all, adj, [2020, 2025, 2030, 2035])
    # calibrated years only: 2035 has no adder (and Canada has no learning rates)
    m = merged.where(f"scenario = '{REF}' and input = 'capital' and period between 2025 and 2030"
                     ).alias("m")
    o = costs_all.alias("o")
    j = m.join(o, ["scenario", "region", "sector", "subsector", "technology", "period", "input", "year"])
    keys = ["scenario", "region", "sector", "subsector", "technology", "period"]
    zero = cf_all.where("capacity_factor = 0").select(*keys, F.lit(True).alias("zero"))
    diffs = (j.join(zero, keys, "left").select((F.col("m.adjusted_cost") - F.col("o.adjusted_cost")).alias("d"),
                                               "region", "technology", "period", "zero").collect())
    # a zero capacity factor makes the default cost zero; levelising the new one divides by zero
    off = [(r["region"], r["technology"], r["period"], r["zero"]) for r in diffs if not abs(r["d"]) < 1e-9]
    assert diffs and off == [("USA", "Gen_III", 2025, True)]
    # and something was actually replaced (learning technologies with FCR)
    replaced = adj.where(f"scenario = '{REF}' and adj_cost_new is not null and period >= 2025")
    assert replaced.where("region = 'USA'").count() > 0
    assert replaced.where("region = 'Canada'").count() == 0


def test_merge_replaces_only_capital(facts, params, calibration):
    gen_all, costs_all, cf_all = _update_inputs(facts, params)
    nl = CAL.for_scenario(calibration.nonlearning, REF)
    ca = CAL.for_scenario(calibration.adders, REF)
    adj = U.period_cost_update(gen_all, cf_all, params, nl, ca, current_year=2025)
    merged = U.merge_costs(costs_all, adj, [2030])
    assert merged.count() == costs_all.where("period = 2030").count()
    assert merged.where("input = 'OM-fixed' and adjusted_cost != 0.1").count() == 0
    changed = merged.alias("m").join(costs_all.alias("o"), [
        "scenario", "region", "sector", "subsector", "technology", "period", "input", "year"]) \
        .where("abs(m.adjusted_cost - o.adjusted_cost) > 1e-9")
    assert changed.where(f"scenario = '{NZ}'").count() > 0     # learning moved NZ costs


def test_generation_union(facts, params):
    g = T.generation_union(facts["outputs"], params["cooling_tech_map"])
    sectors = {r[0] for r in g.select("sector").distinct().collect()}
    assert sectors == {"electricity", "elec_CSP", "elec_CSP_storage", "elec_Gen_III", "elect_td_bld"}


def test_results_diffs(facts):
    q5 = Q.all_vintage_generation(facts["outputs"], region=None)
    gen = R.generation_by_fuel(q5)
    direct = R.generation_by_fuel(Q.all_vintage_rows(facts["outputs"], region=None))
    assert rows(direct) == rows(gen.select(*direct.columns))
    d = R.diff_to_reference(gen)
    ids = ["region", "technology", "CCS", "year"]
    ref = d.where(f"scenario = '{REF}'").select(*ids, F.col("value").alias("ref"))
    back = (d.where(f"scenario = '{NZ}'").join(ref, ids)
              .select(*ids, (F.col("value") + F.col("ref")).alias("v")))
    orig = gen.where(f"scenario = '{NZ}'").select(*ids, F.col("value").alias("o"))
    for r in back.join(orig, ids).collect():
        assert r["v"] == pytest.approx(r["o"], rel=1e-12)
    pair = R.diff_pair(gen)
    assert {r[0] for r in pair.select("scenario").distinct().collect()} == {NZ, K.PAIR_DIFF_NAME}
    # rooftop_pv and hydro match no fuel rule and keep their names (case-sensitive PV)
    assert {"rooftop_pv", "hydro"} <= {r[0] for r in gen.select("technology").distinct().collect()}


def test_capacity_tables(facts):
    q2 = Q.labelled_new_vintage_generation(facts["outputs"], region=None)
    q3 = Q.capacity_factor_query(facts["capacity_factors"], region=None)
    new = C.capacity_new(q2, q3)
    assert {r[0] for r in new.select("technology").distinct().collect()} >= {"PV", "CSP", "nuclear"}
    cum = C.capacity_cumulative(new)
    # nuclear 2025 has a zero capacity factor: its running sum stays infinite from then on
    nuc = dict(rows(cum.where(f"scenario = '{REF}' and region = 'USA' and technology = 'nuclear'"),
                    "year", "cum_cap"))
    assert 0 < nuc[2020] < float("inf") and nuc[2025] == nuc[2030] == float("inf")
    inst = C.capacity_installed(Q.all_vintage_generation(facts["outputs"], region=None), q3)
    one = inst.where(f"scenario = '{REF}' and region = 'USA' and technology = 'nuclear'").groupBy("year").count()
    assert inst.count() == inst.select("scenario", "region", "year", "sector", "subsector", "technology").distinct().count()
    assert {r["year"] for r in one.collect()} >= {2020, 2025, 2030}


def test_capital_cost_series_and_carbon_price(spark, facts):
    q4 = Q.input_cost_query(facts["input_costs"], region=None)
    s = P.capital_cost_series(q4)
    levels = dict(rows(s.select("technology", "technology_ord").distinct()))
    assert levels["PV"] == 1 and levels["coal (conv pul CCS)"] == 11
    view = P.capital_cost_view(s)
    assert {r[0] for r in view.select("scenario").distinct().collect()} == {"model default"}
    mp = spark.createDataFrame([(REF, "USACO2", 2015, 1.0), (REF, "USACO2", 2020, 2.0),
                                (REF, "USAelec", 2020, 3.0)],
                               "scenario string, market string, year int, value double")
    assert rows(R.carbon_price(Q.market_price_query(mp)), "year", "value") == [(2020, 2.0)]


def test_shared_technology_name_fails_capacity(spark):
    """The capacity factor matches by name alone: a name of two sectors may not count twice."""
    gen = spark.createDataFrame([("S", "USA", "electricity", "solar", "PV", 2020, 1.0)],
                                "scenario string, region string, sector string, subsector string, technology string, "
                                "year int, value double")
    cf = gen.withColumn("value", F.lit(0.25))
    assert C.capacity_new(gen, cf).count() == 1
    with pytest.raises(Exception, match="several sectors"):
        C.capacity_new(gen, cf.union(cf.withColumn("sector", F.lit("hydrogen")))).collect()


def test_overnight_cost_keeps_unmatched_rates(spark):
    costs = spark.createDataFrame([("S", "USA", 2020, "electricity", "solar", "PV", 1.5)],
                                  "scenario string, region string, year int, sector string, subsector string, "
                                  "technology string, value double")
    cf = costs.withColumn("value", F.lit(0.25))
    fcr = spark.createDataFrame([("USA", "electricity", "solar", "PV", 0.13), ("USA", "electricity", "wind", "wind", 0.13)],
                                "region string, sector string, subsector string, technology string, FCR double")
    got = {r["technology"]: r for r in P.overnight_cost(costs, cf, fcr).collect()}
    assert got["PV"]["cap_cost"] > 0
    assert got["wind"]["scenario"] is None and got["wind"]["year"] is None and got["wind"]["cap_cost"] is None
    assert P.overnight_cost(costs, cf, fcr, keep_unmatched=False).count() == 1


def _named(spark, rows_):
    return spark.createDataFrame(rows_, "scenario string, region string, sector string, subsector string, "
                                 "technology string, year int, value double")


def test_shared_names_fail_only_where_generation_meets_them(spark):
    """A capacity factor is matched by name; a name that two sectors share may exist, but not be used."""
    cf = _named(spark, [("S", "R", "electricity", "PV", "PV", 2020, 0.25), ("S", "R", "heat", "coal", "coal", 2020, 0.5),
                        ("S", "R", "industry", "coal", "coal", 2020, 0.75)])
    used = _named(spark, [("S", "R", "electricity", "PV", "PV", 2020, 1.0)])
    kw = {"include": None, "exclude": None, "rules": [("PV", "solar")]}
    got = C.capacity_new(used, cf, **kw).collect()
    assert [(r.technology, r.units) for r in got] == [("solar", "GW")] and got[0].capacity > 0
    clash = used.unionByName(_named(spark, [("S", "R", "electricity", "coal", "coal", 2020, 1.0)]))
    with pytest.raises(Exception, match="several sectors or subsectors"):
        C.capacity_new(clash, cf, **kw).collect()
    labelled = clash.withColumn("technology", F.concat("technology", F.lit(",year=2020")))
    with pytest.raises(Exception, match="several sectors or subsectors"):
        C.capacity_installed(labelled, cf, **kw).collect()


def test_two_costs_for_one_side_fail(spark):
    cf = _named(spark, [("S", "R", "electricity", "CSP", t, 2020, 0.5) for t in ("CSP", "CSP_storage")])
    cost = _named(spark, [("S", "R", "electricity", "CSP", t, 2020, v) for t, v in (("CSP", 1.0), ("CSP_storage", 3.0))])
    nl = P.nonlearning_storage(cost, cf, tech_regex="^CSP").collect()
    assert [r.technology for r in nl] == ["CSP_storage"] and nl[0].nonlearning_cap > 0
    one = P.nonlearning_storage(cost.where("technology = 'CSP'"), cf, tech_regex="^CSP").collect()
    assert [(r.technology, r.nonlearning_cap) for r in one] == [("CSP_storage", None)]
    with pytest.raises(Exception, match="two costs for one side"):
        P.nonlearning_storage(cost.unionByName(cost), cf, tech_regex="^CSP").collect()


def test_label_rewrite_by_table(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), (None, "y")], "sector string, subsector string")
    k = "level string, from string, to string"
    table = spark.createDataFrame([("sector", "a", "A"), ("sector", "a", "A"), ("subsector", "x", "X"), ("sector", None, "N")], k)
    assert rows(T.rewrite_labels(df, table)) == rows(spark.createDataFrame([("A", "X"), ("b", None), (None, "y")], df.schema))
    assert rows(T.rewrite_labels(df, table.limit(0))) == rows(df)
    two = spark.createDataFrame([("sector", "a", "A"), ("sector", "a", "B")], k)
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        T.rewrite_labels(df, two).collect()
