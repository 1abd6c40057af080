"""Calibration job: learned costs of the reference run against its default
capital costs -> calibration adders and non-learning capital (D10-D12)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nasafe import grepl, pivot_checked, unpivot
from ..operators import capacity as C
from ..operators import capital as P
from ..operators import learning as L
from ..operators.joins import small
from ..operators.techmap import cooling_rollup

KEYS = ("scenario", "region", "year", "sector", "subsector", "technology")
SOURCES = ("learned_cost", "cap_cost", "learned_cost_total")


def learned_component_costs(gen_q1: DataFrame, cf_q3: DataFrame, cooling_map: DataFrame,
                            deployment_map: DataFrame, learning_rates: DataFrame,
                            t0_cost_deployment: DataFrame, base_year: int = K.BASE_YEAR,
                            years=None) -> DataFrame:
    """D1 -> D2 -> D3 -> D4 -> D5 -> D6: lagged learned cost per component."""
    gen = gen_q1.withColumnRenamed("value", "generation")
    cf = cf_q3.withColumnRenamed("value", "cap_factor")
    cap = C.new_capacity(gen, cf, min_year=base_year)
    cap = cooling_rollup(cap, cooling_map)
    comp = C.component_rollup(cap, deployment_map)
    cum = C.cumulative_deployment(comp, years=years)
    learned = L.learning_curve(cum, learning_rates, t0_cost_deployment)
    return L.lag_cost(learned, base_year)


def technology_costs(tech_cost: DataFrame, parts: DataFrame, fcr: DataFrame) -> DataFrame:
    """Learned, default (overnight) and non-learning cost of every technology
    with a learned cost, in one join to ``capital.capital_parts``; a missing
    non-learning part counts 0."""
    rates = fcr.select("region", "sector", "subsector", "technology", "FCR")
    j = tech_cost.join(parts, list(KEYS), "left").join(small(rates), rates.columns[:-1], "left")
    once = F.raise_error(F.lit("overnight cost: two costs for one technology and year")).cast("double")
    one_part = F.raise_error(F.lit("non-learning capital: storage and CCS part for one technology")).cast("double")
    cap_cost = F.when(F.col("own_rows") > 1, once).when(F.col("FCR").isNotNull(), P.overnight_expr(
        F.col("own.value"), F.col("FCR"), F.col("own.cap_factor")))
    nonlearning = (F.when(F.col("has_storage") & F.col("has_ccs"), one_part).when(F.col("has_storage"), F.col("storage_cost"))
                   .when(F.col("has_ccs"), F.col("ccs_cost")))
    return j.select(*KEYS, "learned_cost", cap_cost.alias("cap_cost"),
                    F.coalesce(nonlearning, F.lit(0.0)).alias("nonlearning_cap"))


def cost_comparison(costs: DataFrame, long: bool = False) -> DataFrame:
    """Learned cost, default (overnight) cost and learned + non-learning
    cost per technology and year of ``technology_costs``; ``long`` gives
    (source, value) rows."""
    j = costs.select(*KEYS, "learned_cost", "cap_cost",
                     (F.col("learned_cost") + F.col("nonlearning_cap")).alias("learned_cost_total"))
    if long:
        return unpivot(j, KEYS, SOURCES, "source", "value")
    return j


def calibration_adders(costs: DataFrame, from_year: int = K.ADDER_FROM_YEAR) -> DataFrame:
    """adder = default cost - learned cost - non-learning capital of
    ``technology_costs``, from ``from_year`` on (missing learned / non-learning
    parts count 0; a missing default cost leaves the adder missing)."""
    return costs.where(F.col("year") >= F.lit(from_year)).select(
        *KEYS, (F.col("cap_cost") - F.coalesce("learned_cost", F.lit(0.0)) - F.col("nonlearning_cap")).alias("cal_adder"))


def _plot_filter(comparison_long: DataFrame, hide_year: int, hide_regex: str) -> DataFrame:
    hidden = (F.col("year") == F.lit(hide_year)) & grepl("technology", hide_regex)
    return comparison_long.where((F.col("source") != F.lit("learned_cost"))
                                 & (F.col("value") > F.lit(0)) & ~hidden)


def calibration_plot_lines(comparison_long: DataFrame, hide_year: int = K.ADDER_FROM_YEAR,
                           hide_regex: str = K.CALIBRATION_PLOT_HIDE_REGEX,
                           labels: tuple[str, str] = K.CALIBRATION_PLOT_LABELS) -> DataFrame:
    """D12 (lines): default and learned + non-learning costs, relabelled,
    without zero costs and the first-year rows of rooftop/storage."""
    df = _plot_filter(comparison_long, hide_year, hide_regex)
    return df.withColumn("source", F.when(F.col("source") == F.lit("cap_cost"), F.lit(labels[0]))
                         .otherwise(F.lit(labels[1])))


def calibration_plot_segments(comparison_long: DataFrame, hide_year: int = K.ADDER_FROM_YEAR,
                              hide_regex: str = K.CALIBRATION_PLOT_HIDE_REGEX) -> DataFrame:
    """D12 (segments): the gap between both costs where both exist."""
    df = _plot_filter(comparison_long, hide_year, hide_regex)
    w = pivot_checked(df, KEYS, "source", "value", ["cap_cost", "learned_cost_total"])
    return w.na.drop()


@dataclass
class CalibrationResult:
    learned_components: DataFrame
    tech_cost: DataFrame
    overnight: DataFrame
    technology_costs: DataFrame
    nonlearning: DataFrame
    comparison: DataFrame
    adders: DataFrame


def run_calibration(gen_q1: DataFrame, cf_q3: DataFrame, cost_q4: DataFrame, params: dict,
                    base_year: int = K.BASE_YEAR, adder_from: int = K.ADDER_FROM_YEAR,
                    storage_kw: dict | None = None, ccs_kw: dict | None = None,
                    years=None) -> CalibrationResult:
    """The whole calibration job as one set of lazy plans."""
    learned = learned_component_costs(gen_q1, cf_q3, params["cooling_tech_map"],
                                      params["deployment_map"], params["learning_rates"],
                                      params["t0_cost_deployment"], base_year, years)
    tech = L.technology_cost(learned, params["learning_map"], missing="ignore")
    costs = P.capital_costs(cost_q4)
    overnight = P.overnight_cost(costs, cf_q3, params["tech_FCR"], keep_unmatched=False)
    parts = P.capital_parts(costs, cf_q3, P.StorageRule(**(storage_kw or {})), P.CcsRule(**(ccs_kw or {})))
    wide = technology_costs(tech, parts, params["tech_FCR"])
    nonlearning = P.nonlearning_all(costs, cf_q3, storage_kw, ccs_kw)
    return CalibrationResult(learned, tech, overnight, wide, nonlearning, cost_comparison(wide),
                             calibration_adders(wide, adder_from))


def for_scenario(df: DataFrame, scenario: str) -> DataFrame:
    """A calibration output of one scenario, written without the column
    (the parameter files are per run)."""
    return df.where(F.col("scenario") == F.lit(scenario)).drop("scenario")
