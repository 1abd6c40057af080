"""Learning curves (D5), lagged learned cost (D6) and the component ->
technology cost roll-up (D7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nasafe import divide, strict_sum, sum_na_rm
from .joins import small

COMPONENT_KEYS = ("region", "learning_component")
TECH_YEAR_KEYS = ("scenario", "region", "year", "sector", "subsector", "technology")


def learned_cost_expr(cum: Column, t0_cost: Column, t0_deployment: Column,
                      learning_rate: Column) -> Column:
    """0 without deployment, else t0_cost * (cum / t0_deployment) ^ log2(1 - rate):
    every doubling of deployment multiplies the cost by (1 - rate)."""
    curve = t0_cost * F.pow(divide(cum, t0_deployment), F.log2(F.lit(1.0) - learning_rate))
    return F.when(cum == F.lit(0), F.lit(0.0)).otherwise(curve)


def learning_curve(cum: DataFrame, learning_rates: DataFrame, t0_cost_deployment: DataFrame,
                   cum_col: str = "cum_cap") -> DataFrame:
    """Learned cost of each component from its cumulative deployment."""
    r = learning_rates.select(*COMPONENT_KEYS, "learning_rate")
    t = t0_cost_deployment.select(*COMPONENT_KEYS, "t0_cost", "t0_deployment")
    j = cum.join(small(r), list(COMPONENT_KEYS), "left").join(small(t), list(COMPONENT_KEYS), "left")
    return j.withColumn("learned_cost", learned_cost_expr(
        F.col(cum_col), F.col("t0_cost"), F.col("t0_deployment"), F.col("learning_rate")))


def lag_cost(learned: DataFrame, base_year: int = K.BASE_YEAR,
             keys: Sequence[str] = ("scenario", "region", "learning_component")) -> DataFrame:
    """The cost applying in a year is the one learned from deployment up
    to the previous deployed year (zero-cost rows are dropped before the
    lag).  The first deployed year gets a missing cost."""
    w = Window.partitionBy(*keys).orderBy("year")
    df = learned.where(F.col("learned_cost") != F.lit(0))
    df = df.withColumn("learned_cost", F.lag("learned_cost").over(w))
    return df.where(F.col("year") > F.lit(base_year)).select(
        "scenario", "region", "year", "learning_component", "learned_cost")


def technology_cost(learned: DataFrame, learning_map: DataFrame, missing: str = "ignore",
                    cost_col: str = "learned_cost",
                    keys: Sequence[str] = TECH_YEAR_KEYS) -> DataFrame:
    """A technology's cost is the sum of its components' costs.

    ``missing='ignore'`` (calibration): missing component costs are skipped
    and a technology with none gets 0.  ``missing='strict'`` (per-period
    update): one missing component cost makes the technology's cost missing."""
    m = learning_map.select("sector", "subsector", "technology", "learning_component")
    j = learned.join(small(m), "learning_component", "left")
    if missing == "ignore":
        agg = sum_na_rm(cost_col)
    elif missing == "strict":
        agg = strict_sum(cost_col)
    else:
        raise ValueError(missing)
    return j.groupBy(*keys).agg(agg.alias(cost_col))
