"""The registered queries: every domain operator run on the driver's test
tables through the test-domain adapter.  Each takes (spark, sf_dir) and
returns a lazy DataFrame; double columns are rounded to 6 decimals so the
SQL oracle can be compared value by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import constants as K
from ..operators import capacity as C
from ..operators import capital as P
from ..operators import learning as L
from ..operators import techmap as T
from ..sinks import read_cost_updates, write_cost_updates, write_param_csv
from ..sources import queries as Q
from ..sources.params import read_param_csv
from ..sources.scenarios import load_scenarios, write_scenarios
from ..sources import testdata as TD
from ..sources.xmldb import flatten_model_output, write_model_output
from . import calibration as CAL
from . import results as R
from . import update as U

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round double columns; ``+ 0.0`` turns a negative zero into zero so
    equal values have equal bits."""
    return df.select(*[(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


class Ctx:
    """The test domain plus the stored-query outputs built on it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.d = TD.domain(spark, sf_dir)

    @property
    def years(self) -> Column:
        """The run's model periods from the base year on (year grid of the
        cumulative sums and the update years), read from the data."""
        return self.d.model_periods(TD.BASE_YEAR)

    @property
    def next_years(self) -> Column:
        """The periods after these."""
        return self.d.model_periods(TD.BASE_YEAR, TD.PERIOD_STEP)

    @property
    def params(self) -> dict:
        d = self.d
        return {"cooling_tech_map": d.cooling_tech_map,
                "deployment_map": d.deployment_map_plain(),
                "learning_map": d.learning_map, "learning_rates": d.learning_rates,
                "t0_cost_deployment": d.t0_cost_deployment, "tech_FCR": d.tech_FCR}

    def q1(self) -> DataFrame:
        return Q.new_vintage_generation(
            self.d.outputs, region=None,
            exclude_technologies=self.d.cooling_tech_map.select("technology_passthru"))

    def q2(self) -> DataFrame:
        return Q.labelled_new_vintage_generation(
            self.d.outputs, region=None, rewrites=self.d.label_rewrites,
            exclude_technologies=self.d.cooling_tech_map.select("technology_passthru"))

    def q3(self) -> DataFrame:
        return Q.capacity_factor_query(self.d.capacity_factors, region=None)

    def q4(self) -> DataFrame:
        return Q.input_cost_query(self.d.input_costs, region=None)

    def q5(self) -> DataFrame:
        return Q.all_vintage_generation(
            self.d.outputs, region=None, rewrites=self.d.label_rewrites,
            exclude_technologies=self.d.cooling_tech_map.select("technology_passthru"))

    def q5_rows(self) -> DataFrame:
        return Q.all_vintage_rows(
            self.d.outputs, region=None, rewrites=self.d.label_rewrites,
            exclude_technologies=self.d.cooling_tech_map.select("technology_passthru"))

    def q6(self) -> DataFrame:
        return Q.market_price_query(self.d.market_prices)

    def learned_components(self) -> DataFrame:
        p = self.params
        return CAL.learned_component_costs(self.q1(), self.q3(), p["cooling_tech_map"],
                                           p["deployment_map"], p["learning_rates"],
                                           p["t0_cost_deployment"], TD.BASE_YEAR, self.years)

    def capacity(self) -> DataFrame:
        gen = self.q1().withColumnRenamed("value", "generation")
        cf = self.q3().withColumnRenamed("value", "cap_factor")
        cap = C.new_capacity(gen, cf, min_year=TD.BASE_YEAR)
        return T.cooling_rollup(cap, self.d.cooling_tech_map)

    def costs(self) -> DataFrame:
        return P.capital_costs(self.q4())

    storage_kw = {"tech_regex": TD.STORAGE_TECH_REGEX}
    ccs_kw = {"include": TD.CCS_INCLUDE_REGEX, "exclude": TD.CCS_EXCLUDE_REGEX}

    def calibration(self) -> CAL.CalibrationResult:
        if not hasattr(self, "_calibration"):
            self._calibration = self._run_calibration()
        return self._calibration

    def _run_calibration(self) -> CAL.CalibrationResult:
        return CAL.run_calibration(self.q1(), self.q3(), self.q4(), self.params,
                                   TD.BASE_YEAR, TD.ADDER_FROM_YEAR, self.storage_kw,
                                   self.ccs_kw, self.years)

    def update_inputs(self):
        return U.update_inputs(self.d.outputs, self.d.input_costs, self.d.capacity_factors,
                               self.d.cooling_tech_map)

    def calibration_params(self) -> tuple[DataFrame, DataFrame]:
        """Non-learning capital and calibration adders of the reference
        scenario, written by the calibration job and read by the update."""
        ref = K.REFERENCE_SCENARIO
        nl = self.d.store("non_learning_capital",
                          lambda: CAL.for_scenario(self.calibration().nonlearning, ref))
        ca = self.d.store("cal_adders",
                          lambda: CAL.for_scenario(self.calibration().adders, ref))
        return nl, ca

    def cost_update(self) -> DataFrame:
        nl, ca = self.calibration_params()
        gen_all, _, cf_all = self.update_inputs()
        return U.period_cost_update(gen_all, cf_all, self.params, nl, ca,
                                    base_year=TD.BASE_YEAR, step=TD.PERIOD_STEP,
                                    update_years=self.years)

    def cost_update_one_period(self, current_year: int) -> DataFrame:
        nl, ca = self.calibration_params()
        gen_all, _, cf_all = self.update_inputs()
        return U.period_cost_update(gen_all, cf_all, self.params, nl, ca,
                                    base_year=TD.BASE_YEAR, step=TD.PERIOD_STEP,
                                    current_year=current_year)

    def round_trip(self, name: str, write, read) -> DataFrame:
        """Write with a sink once per session, read back with a source."""
        path = f"{self.d.store_dir}/files/{name}"
        self.d.store(f"_written_{name}", lambda: _mark_written(self.d.spark, write, path))
        return read(path)

    def param_file(self, name: str) -> DataFrame:
        nl, ca = self.calibration_params()
        table = {"non_learning_capital": nl, "cal_adders": ca}[name]
        return self.round_trip(name, lambda p: write_param_csv(table, p),
                               lambda p: read_param_csv(self.d.spark, p, name))

    def scenario_runs(self) -> DataFrame:
        runs = lambda p: {s: f"{p}/scenario={s}" for s in K.SCENARIOS}
        return self.round_trip("scenario_runs", lambda p: write_scenarios(self.d.outputs, p),
                               lambda p: load_scenarios(self.d.spark, runs(p)))

    def xml_table(self, name: str) -> DataFrame:
        """A table flattened from the XML of all scenarios, read at once."""
        return self.round_trip("model_xml", lambda p: write_model_output(
            {t: getattr(self.d, t) for t in ("outputs", "input_costs", "capacity_factors", "market_prices")}, p),
            lambda p: flatten_model_output(self.d.spark, p)[name])

    def cost_write_back(self) -> DataFrame:
        merged = U.merge_costs(self.update_inputs()[1], self.cost_update(),
                               self.next_years)
        return self.round_trip("cost_write_back", lambda p: write_cost_updates(merged, p),
                               lambda p: read_cost_updates(self.d.spark, p))

    def gen_by_fuel(self) -> DataFrame:
        return R.generation_by_fuel(self.q5_rows(), TD.FUEL_RULES, levels=TD.FUEL_LEVELS)

    def capacity_new(self) -> DataFrame:
        return C.capacity_new(self.q2(), self.q3(), TD.CAPACITY_INCLUDE_REGEX,
                              TD.CAPACITY_EXCLUDE_REGEX, TD.CAPACITY_RULES)


def _mark_written(spark: SparkSession, write, path: str) -> DataFrame:
    write(path)
    return spark.range(1)


QUERIES: dict[str, Callable[[Ctx], DataFrame]] = {
    # minimum slice (flagship): D1, D2, D3, D4, D5, D6
    "learning_curve": lambda c: c.learned_components(),
    # stored queries Q1-Q6
    "new_vintage_generation": lambda c: c.q1(),
    "labelled_generation": lambda c: c.q2(),
    "capacity_factors": lambda c: c.q3(),
    "input_costs": lambda c: c.q4(),
    "all_vintage_generation": lambda c: c.q5(),
    "market_prices": lambda c: c.q6(),
    # path queries P1-P7
    "path_generation": lambda c: Q.path_generation(c.d.outputs),
    "path_rooftop_generation": lambda c: Q.path_rooftop_generation(c.d.outputs),
    "path_costs": lambda c: Q.path_costs(c.d.input_costs),
    "path_rooftop_costs": lambda c: Q.path_rooftop_costs(c.d.input_costs),
    "path_capacity_factors": lambda c: Q.path_capacity_factors(c.d.capacity_factors),
    "path_rooftop_capacity_factors": lambda c: Q.path_rooftop_capacity_factors(c.d.capacity_factors),
    "path_cooling_generation": lambda c: Q.path_cooling_generation(c.d.outputs),
    # mappings D2, D15, D27
    "label_rewrite": lambda c: T.rewrite_labels(c.d.outputs, c.d.label_rewrites),
    "cooling_rollup": lambda c: c.capacity(),
    "generation_union": lambda c: T.generation_union(c.d.outputs, c.d.cooling_tech_map),
    # capacity and learning D3, D4, D5, D7
    "component_rollup": lambda c: C.component_rollup(c.capacity(), c.params["deployment_map"]),
    "cumulative_deployment": lambda c: C.cumulative_deployment(
        C.component_rollup(c.capacity(), c.params["deployment_map"]), years=c.years),
    "learned_cost_unlagged": lambda c: L.learning_curve(
        C.cumulative_deployment(C.component_rollup(c.capacity(), c.params["deployment_map"]),
                                years=c.years),
        c.params["learning_rates"], c.params["t0_cost_deployment"]),
    "technology_cost_narm": lambda c: L.technology_cost(c.learned_components(),
                                                        c.params["learning_map"], "ignore"),
    "technology_cost_strict": lambda c: L.technology_cost(c.learned_components(),
                                                          c.params["learning_map"], "strict"),
    # capital D8, D9
    "overnight_cost": lambda c: P.overnight_cost(c.costs(), c.q3(), c.params["tech_FCR"]),
    "nonlearning_storage": lambda c: P.nonlearning_storage(c.costs(), c.q3(), **Ctx.storage_kw),
    "nonlearning_ccs": lambda c: P.nonlearning_ccs(c.costs(), c.q3(), **Ctx.ccs_kw),
    "nonlearning_all": lambda c: P.nonlearning_all(c.costs(), c.q3(), Ctx.storage_kw, Ctx.ccs_kw),
    # calibration D10, D11, D12
    "cost_comparison": lambda c: CAL.cost_comparison(c.calibration().technology_costs, long=True),
    "calibration_adders": lambda c: c.calibration().adders,
    "calibration_plot_lines": lambda c: CAL.calibration_plot_lines(
        CAL.cost_comparison(c.calibration().technology_costs, long=True), TD.ADDER_FROM_YEAR,
        "rooftop|storage"),
    "calibration_plot_segments": lambda c: CAL.calibration_plot_segments(
        CAL.cost_comparison(c.calibration().technology_costs, long=True), TD.ADDER_FROM_YEAR,
        "rooftop|storage"),
    # per-period update D13, D14
    "period_cost_update": lambda c: c.cost_update(),
    "period_cost_update_one_period": lambda c: c.cost_update_one_period(1999),
    "cost_merge": lambda c: U.merge_costs(c.update_inputs()[1], c.cost_update(),
                                          c.next_years),
    # sources and sinks on derived data: K1/K2 -> S1, S3, K3
    "non_learning_capital_csv": lambda c: c.param_file("non_learning_capital"),
    "cal_adders_csv": lambda c: c.param_file("cal_adders"),
    "scenario_runs": lambda c: c.scenario_runs(),
    # The model tables written as XML and flattened back
    "xml_outputs": lambda c: c.xml_table("outputs"),
    "xml_input_costs": lambda c: c.xml_table("input_costs"),
    "xml_capacity_factors": lambda c: c.xml_table("capacity_factors"),
    "xml_market_prices": lambda c: c.xml_table("market_prices"),
    "cost_write_back": lambda c: c.cost_write_back(),
    # results D16-D26
    "capital_cost_series": lambda c: P.capital_cost_series(
        c.q4(), TD.CAPITAL_COST_INCLUDE_REGEX, TD.CAPITAL_COST_EXCLUDE_REGEX,
        TD.CAPITAL_COST_LEVELS),
    "capital_cost_view": lambda c: P.capital_cost_view(
        P.capital_cost_series(c.q4(), TD.CAPITAL_COST_INCLUDE_REGEX,
                              TD.CAPITAL_COST_EXCLUDE_REGEX, TD.CAPITAL_COST_LEVELS),
        TD.CHART_YEARS),
    "capacity_new": lambda c: c.capacity_new(),
    "capacity_cumulative": lambda c: C.capacity_cumulative(c.capacity_new(), TD.BASE_YEAR),
    "capacity_installed": lambda c: C.capacity_installed(
        c.q5(), c.q3(), TD.CAPACITY_INCLUDE_REGEX, TD.CAPACITY_EXCLUDE_REGEX,
        TD.CAPACITY_RULES),
    "generation_by_fuel": lambda c: c.gen_by_fuel(),
    "diff_to_reference": lambda c: R.diff_to_reference(c.gen_by_fuel()),
    "diff_pair": lambda c: R.diff_pair(c.gen_by_fuel()),
    "carbon_price": lambda c: R.carbon_price(c.q6(), TD.CO2_MARKET, TD.CHART_YEARS),
    "chart_generation": lambda c: R.chart_table(c.gen_by_fuel(), TD.CHART_YEARS),
    "chart_capacity_new": lambda c: R.chart_table(c.capacity_new(), TD.CHART_YEARS, TD.CAPACITY_LEVELS),
    "chart_capacity_cumulative": lambda c: R.chart_table(
        C.capacity_cumulative(c.capacity_new(), TD.BASE_YEAR), TD.CHART_YEARS, TD.CAPACITY_LEVELS),
    "chart_capacity_installed": lambda c: R.chart_table(
        C.capacity_installed(c.q5(), c.q3(), TD.CAPACITY_INCLUDE_REGEX, TD.CAPACITY_EXCLUDE_REGEX,
                             TD.CAPACITY_RULES), TD.CHART_YEARS, TD.CAPACITY_LEVELS),
    "chart_generation_diff": lambda c: R.chart_table(R.diff_pair(c.gen_by_fuel()), TD.CHART_YEARS),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name, fn in QUERIES.items():
        def make(f=fn, n=name):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return rounded(f(Ctx(spark, sf_dir)))
            run.__name__ = n
            return run
        out[name] = make()
    return out
