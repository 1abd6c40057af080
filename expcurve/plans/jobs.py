"""The three user-level jobs, end to end, over the flat model tables.

* ``calibrate`` -- the reference run's learned vs default costs ->
  ``non_learning_capital`` and ``cal_adders`` parameter files (K1, K2)
* ``update``    -- next-period capital costs of a run (all periods or one),
  written back by (scenario, period) (D13, D14, K3)
* ``results``   -- the scenario-comparison tables behind the charts (D16-D26)

The flat tables (``outputs``, ``input_costs``, ``capacity_factors``,
``market_prices``) are Parquet folders as written by
``sources.xmldb.write_flat_tables``; parameters are read from an analysis
folder by ``sources.params``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import capacity as C
from ..operators import capital as P
from ..session import ensure_checkpoint_dir
from ..sinks import write_cost_updates, write_param_csv
from ..sources import queries as Q
from ..sources.params import read_params
from . import calibration as CAL
from . import results as R
from . import update as U


def read_flat(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    names = ("outputs", "input_costs", "capacity_factors", "market_prices")
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in names}


def calibrate(spark: SparkSession, flat_root: str, params_root: str, out_root: str,
              scenario: str = K.REFERENCE_SCENARIO, region: str | None = K.DEFAULT_REGION) -> None:
    flat = read_flat(spark, flat_root)
    outputs = flat["outputs"].where(F.col("scenario") == F.lit(scenario))
    params = read_params(spark, params_root, names=["learning_rates", "t0_cost_deployment",
                                                    "tech_FCR", "cooling_tech_map",
                                                    "deployment_map", "learning_map"])
    cal = CAL.run_calibration(Q.new_vintage_generation(outputs, region=region),
                              Q.capacity_factor_query(flat["capacity_factors"], region=region),
                              Q.input_cost_query(flat["input_costs"], region=region), params)
    write_param_csv(CAL.for_scenario(cal.nonlearning, scenario), f"{out_root}/non_learning_capital")
    write_param_csv(CAL.for_scenario(cal.adders, scenario), f"{out_root}/cal_adders")


def update(spark: SparkSession, flat_root: str, params_root: str, out_path: str,
           current_year: int | None = None, region: str | None = K.DEFAULT_REGION) -> None:
    flat = read_flat(spark, flat_root)
    params = read_params(spark, params_root)
    gen_all, costs_all, cf_all = U.update_inputs(flat["outputs"], flat["input_costs"],
                                                 flat["capacity_factors"],
                                                 params["cooling_tech_map"])
    if current_year is not None:
        years, after = [current_year], [current_year + K.PERIOD_STEP]
    else:
        years, after = U.model_periods(gen_all), U.model_periods(gen_all, shift=K.PERIOD_STEP)
    adj = U.period_cost_update(gen_all, cf_all, params, params["non_learning_capital"],
                               params["cal_adders"], update_years=years, region=region)
    if region is not None:              # other regions' rows are not this run's to replace
        costs_all = costs_all.where(F.col("region") == F.lit(region))
    write_cost_updates(U.merge_costs(costs_all, adj, after), out_path)


def results(spark: SparkSession, flat_root: str, out_root: str,
            region: str | None = K.DEFAULT_REGION) -> None:
    flat = read_flat(spark, flat_root)
    q3 = Q.capacity_factor_query(flat["capacity_factors"], region=region)
    q4 = Q.input_cost_query(flat["input_costs"], region=region)
    q2 = Q.labelled_new_vintage_generation(flat["outputs"], region=region)
    q5 = Q.all_vintage_generation(flat["outputs"], region=region)
    # used by several tables each: computed once, kept in the shared checkpoint folder
    ensure_checkpoint_dir(spark)
    gen = R.generation_by_fuel(Q.all_vintage_rows(flat["outputs"], region=region)).checkpoint()
    new = C.capacity_new(q2, q3).checkpoint()
    tables = {
        "capital_cost": P.capital_cost_view(P.capital_cost_series(q4)),
        "new_capacity": R.chart_table(new, levels=K.CAPACITY_LEVELS),
        "cumulative_capacity": R.chart_table(C.capacity_cumulative(new), levels=K.CAPACITY_LEVELS),
        "installed_capacity": R.chart_table(C.capacity_installed(q5, q3), levels=K.CAPACITY_LEVELS),
        "generation_by_fuel": R.chart_table(gen),
        "generation_diff": R.chart_table(R.diff_pair(gen)),
        "generation_diff_reference": R.chart_table(R.diff_to_reference(gen)),
        "carbon_price": R.carbon_price(Q.market_price_query(flat["market_prices"])),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out_root.rstrip('/')}/{name}")


def main(argv=None) -> None:
    from ..session import get_session

    ap = argparse.ArgumentParser(prog="expcurve")
    sub = ap.add_subparsers(dest="job", required=True)
    c = sub.add_parser("calibrate")
    c.add_argument("flat_root"), c.add_argument("params_root"), c.add_argument("out_root")
    c.add_argument("--scenario", default=K.REFERENCE_SCENARIO)
    u = sub.add_parser("update")
    u.add_argument("flat_root"), u.add_argument("params_root"), u.add_argument("out_path")
    u.add_argument("--current-year", type=int)
    r = sub.add_parser("results")
    r.add_argument("flat_root"), r.add_argument("out_root")
    for p in (c, u, r):
        p.add_argument("--region", default=K.DEFAULT_REGION)
    a = ap.parse_args(argv)
    spark = get_session(f"expcurve-{a.job}")
    if a.job == "calibrate":
        calibrate(spark, a.flat_root, a.params_root, a.out_root, a.scenario, a.region)
    elif a.job == "update":
        update(spark, a.flat_root, a.params_root, a.out_path, a.current_year, region=a.region)
    else:
        results(spark, a.flat_root, a.out_root, region=a.region)
