"""Per-period capital-cost update (D13) and the cost-table merge.

For every update year Y (a model period), cumulative capacity of each
learning component is taken from the whole vintage history up to Y, the
learning curve gives each component's cost, components are mapped back to
technologies (strict: one missing component cost leaves the technology's
exogenous cost in place), calibration adders and non-learning capital are
added, and the result is levelised with the capacity factor and FCR of the
next period (Y + step).

Nothing is carried from one period to the next, so all periods of a
finished run are computed in one pass ("all-period form"); the one-period
job is the same plan restricted to one Y.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nasafe import distinct_list, divide, strict_sum, year_array
from ..operators import capacity as C
from ..operators import learning as L
from ..operators.joins import small
from ..operators.techmap import cooling_rollup, generation_union

TECH = ("sector", "subsector", "technology")


def vintage_capacity(gen_all: DataFrame, cf_all: DataFrame, cooling_map: DataFrame,
                     base_year: int = K.BASE_YEAR, region: str | None = None) -> DataFrame:
    """New capacity of each technology and vintage from ``base_year`` on
    (cooling roll-up before the capacity-factor join)."""
    g = gen_all.where((F.col("period") >= F.lit(base_year)) & (F.col("period") == F.col("year")))
    if region is not None:
        g = g.where(F.col("region") == F.lit(region))
    g = cooling_rollup(g.drop("year"), cooling_map)
    cf = cf_all.select("scenario", "region", *TECH, "period", "capacity_factor")
    j = g.join(cf, ["scenario", "region", *TECH, "period"], "left")
    j = j.withColumn("capacity", C.capacity_expr(F.col("physical_output"),
                                                 F.col("capacity_factor")))
    return (j.groupBy("scenario", "region", *TECH, "period")
             .agg(strict_sum("capacity").alias("capacity")))


def component_history(vcap: DataFrame, deployment_map: DataFrame) -> DataFrame:
    """(scenario, region, history): new capacity * multiplier of every learning
    component by vintage period, as a map from component to (period, capacity)
    pairs -- some dozen components, at most one entry per model period each.

    A missing vintage value makes its period's sum missing.  A scenario and
    region without any mapped technology keeps its row, with an empty map."""
    # unlike component_rollup, missing sums are kept here: they poison totals
    m = deployment_map.select(*TECH, "learning_component", "multiplier")
    per = (vcap.join(small(m), list(TECH), "left")
               .groupBy("scenario", "region", "learning_component", "period")
               .agg(strict_sum(F.col("capacity") * F.col("multiplier")).alias("capacity")))
    hist = per.groupBy("scenario", "region", "learning_component").agg(
        F.array_sort(F.collect_list(F.struct("period", "capacity"))).alias("hist"))
    entry = F.when(F.col("learning_component").isNotNull(), F.struct("learning_component", "hist"))
    return hist.groupBy("scenario", "region").agg(F.map_from_entries(F.collect_list(entry)).alias("history"))


def component_costs(history: DataFrame, learning_rates: DataFrame, t0_cost_deployment: DataFrame,
                    update_years: Sequence[int] | Column) -> DataFrame:
    """Learning step: every learning-rate row for every scenario and update
    year, with the capacity cumulated up to that year by higher-order functions
    (no deployment -> missing cost, zero deployment -> 0; a missing vintage
    makes every later total missing)."""
    rates = learning_rates.select("region", "learning_component", "learning_rate")
    t0 = t0_cost_deployment.select("region", "learning_component", "t0_cost", "t0_deployment")
    grid = (history.join(small(rates), "region").join(small(t0), ["region", "learning_component"], "left")
            .withColumn("hist", F.try_element_at("history", F.col("learning_component"))).drop("history")
            .select("*", F.explode(year_array(update_years)).alias("update_year")))
    upto = F.filter("hist", lambda e: e["period"] <= F.col("update_year"))
    total = F.aggregate(upto, F.lit(0.0), lambda acc, e: acc + e["capacity"])
    cum = F.when((F.size(upto) > 0) & ~F.exists(upto, lambda e: e["capacity"].isNull()), total)
    return (grid.withColumn("value", cum)
            .select("scenario", "region", "learning_component", "update_year",
                    L.learned_cost_expr(F.col("value"), F.col("t0_cost"), F.col("t0_deployment"),
                                        F.col("learning_rate")).alias("cost_adj")))


def period_cost_update(gen_all: DataFrame, cf_all: DataFrame, params: dict,
                       nonlearning: DataFrame, cal_adders: DataFrame,
                       base_year: int = K.BASE_YEAR, step: int = K.PERIOD_STEP,
                       update_years: Sequence[int] | Column | None = None,
                       current_year: int | None = None, region: str | None = None) -> DataFrame:
    """New capital cost (``adj_cost_new``, levelised, input "capital")
    of every technology with learning, for the period after each update
    year.  ``current_year`` restricts to one period (the one-period job)."""
    vcap = vintage_capacity(gen_all, cf_all, params["cooling_tech_map"], base_year, region)
    if current_year is not None:
        update_years = [current_year]
    elif update_years is None:
        update_years = model_periods(gen_all, base_year)
    history = component_history(vcap, params["deployment_map"])
    costs = component_costs(history, params["learning_rates"], params["t0_cost_deployment"], update_years)
    costs = costs.withColumn("year", F.col("update_year") + F.lit(step)).drop("update_year")
    tech = L.technology_cost(costs, params["learning_map"], missing="strict", cost_col="cost_adj")
    key5 = ["region", "year", *TECH]
    nl = nonlearning.select(*key5, "nonlearning_cap")
    ca = cal_adders.select(*key5, "cal_adder")
    d = (tech.join(small(nl), key5, "left").join(small(ca), key5, "left")
             .na.fill(0.0, ["nonlearning_cap", "cal_adder"]))
    d = d.where(~((F.col("cost_adj") == F.lit(0)) & (F.col("cal_adder") == F.lit(0))))
    cf = cf_all.select("scenario", "region", *TECH, F.col("period").alias("year"),
                       "capacity_factor")
    fcr = params["tech_FCR"].select("region", *TECH, "FCR")
    d = d.join(cf, ["scenario", "region", *TECH, "year"], "left") \
         .join(small(fcr), ["region", *TECH], "left")
    total = F.col("cost_adj") + F.col("cal_adder") + F.col("nonlearning_cap")
    new = divide(total * F.col("FCR") / F.lit(float(K.HOURS_PER_YEAR)),
                 F.col("capacity_factor")) / F.lit(K.CONV_KWH_GJ)
    return d.select("scenario", "region", *TECH, F.lit(K.CAPITAL_INPUT).alias("input"),
                    F.col("year").alias("period"), new.alias("adj_cost_new"))


def model_periods(gen_all: DataFrame, base_year: int = K.BASE_YEAR, shift: int = 0) -> Column:
    """Update years = the model periods from ``base_year`` on, taken from the
    data when the run's period list is not given: a scalar subquery.  With
    ``shift``, the periods that many years later."""
    return distinct_list(gen_all.where(F.col("period") >= F.lit(base_year)), F.col("period") + F.lit(shift))


def merge_costs(costs_all: DataFrame, adj: DataFrame, next_years: Sequence[int] | Column) -> DataFrame:
    """The input-cost rows of the next periods with the capital cost
    replaced where a new one was computed; all other rows unchanged."""
    keys = ["scenario", "region", *TECH, "period", "input"]
    wanted = (F.array_contains(next_years, F.col("period")) if isinstance(next_years, Column)
              else F.col("period").isin(*[int(y) for y in next_years]))
    j = costs_all.where(wanted).join(adj.select(*keys, "adj_cost_new"), keys, "left")
    return j.select(*[F.coalesce(F.col("adj_cost_new"), F.col("adjusted_cost"))
                      .alias("adjusted_cost") if x == "adjusted_cost" else F.col(x)
                      for x in costs_all.columns])


def update_inputs(outputs: DataFrame, input_costs: DataFrame, capacity_factors: DataFrame,
                  cooling_map: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables the update reads from the model (D15, P3+P4, P5+P6)."""
    from ..sources import queries as Q

    return (generation_union(outputs, cooling_map), Q.path_all_costs(input_costs),
            Q.path_all_capacity_factors(capacity_factors))
