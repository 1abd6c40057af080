"""Capacity from generation (D1), component roll-up (D3), cumulative
deployment (D4) and the capacity tables of the results analysis (D19-D21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nasafe import (categorise, complete_years, divide, grepl, not_grepl, separate,
                                strict_cumsum, strict_sum)
from .joins import small

CF_KEYS = ("year", "region", "sector", "subsector", "technology", "scenario")


def capacity_expr(generation: Column, cap_factor: Column, unit: str = "kW") -> Column:
    """generation (EJ) / kWh-per-EJ / hours / capacity factor, left to right.
    A missing capacity factor gives a missing capacity, a zero one an
    infinite capacity (its component is then free of cost, and dropped)."""
    kw = divide(generation / F.lit(K.CONV_KWH_EJ) / F.lit(float(K.HOURS_PER_YEAR)), cap_factor)
    if unit == "GW":
        return kw * F.lit(K.CONV_KW_GW)
    if unit != "kW":
        raise ValueError(unit)
    return kw


def new_capacity(generation: DataFrame, cap_factors: DataFrame, keys: Sequence[str] = CF_KEYS,
                 unit: str = "kW", min_year: int | None = K.BASE_YEAR) -> DataFrame:
    """Capacity of new vintages.  ``generation`` has a ``generation``
    column, ``cap_factors`` a ``cap_factor`` column, both keyed by ``keys``."""
    g = generation if min_year is None else generation.where(F.col("year") >= F.lit(min_year))
    cf = cap_factors.select(*keys, "cap_factor")
    j = g.join(cf, list(keys), "left")
    return j.withColumn("capacity", capacity_expr(F.col("generation"), F.col("cap_factor"), unit))


def component_rollup(capacity: DataFrame, deployment_map: DataFrame,
                     keys: Sequence[str] = ("scenario", "region"), time_col: str = "year",
                     value: str = "capacity") -> DataFrame:
    """D3: capacity of learning components = sum of capacity * multiplier of
    the technologies feeding them.  A missing capacity makes the component's
    sum missing and the row is dropped.

    The original keeps the whole map (right join) and drops the unmatched
    map rows afterwards, as their sums are missing: an inner join to the
    (broadcast) map gives the same rows without making the map the
    preserved side."""
    m = deployment_map.select("sector", "subsector", "technology", "learning_component",
                              "multiplier")
    j = capacity.join(small(m), ["sector", "subsector", "technology"], "inner")
    g = j.groupBy(*keys, "learning_component", time_col).agg(
        strict_sum(F.col(value) * F.col("multiplier")).alias(value))
    return g.na.drop()


def cumulative_deployment(component_capacity: DataFrame,
                          keys: Sequence[str] = ("scenario", "region", "learning_component"),
                          years: Sequence[int] | None = None, value: str = "capacity") -> DataFrame:
    """Every observed year for every key (missing years count 0), then
    the running sum over years."""
    full = complete_years(component_capacity, keys, value, years)
    w = (Window.partitionBy(*keys).orderBy("year")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return full.withColumn("cum_cap", F.sum(value).over(w))


# ---------------------------------------------------------------------------
# results analysis (GW)
# ---------------------------------------------------------------------------
def _filtered(df: DataFrame, include: str | None, exclude: str | None) -> DataFrame:
    if include:
        df = df.where(grepl("technology", include))
    if exclude:
        df = df.where(not_grepl("technology", exclude))
    return df


_CF4 = ("year", "region", "technology", "scenario")


def _cap_factor_4keys(cf_query: DataFrame) -> DataFrame:
    """Q3 output keyed by (year, region, technology, scenario), with the
    number of sectors and subsectors that share the name.  The match ignores
    these; a capacity would count as often, so a shared name fails the job
    (``_checked_factor``) -- but only if a generation row meets it."""
    return cf_query.groupBy(*_CF4).agg(F.max("value").alias("cap_factor"), F.count(F.lit(1)).alias("_names"))


def _checked_factor() -> Column:
    shared = F.raise_error(F.lit("capacity factor: a technology name stands for several sectors or subsectors"))
    return F.when(F.col("_names") > 1, shared.cast("double")).otherwise(F.col("cap_factor"))


def _capacity_by_category(df: DataFrame, cf_query: DataFrame, value_col: str,
                          rules: Sequence[tuple[str, str]]) -> DataFrame:
    j = df.join(_cap_factor_4keys(cf_query), list(_CF4), "left")
    j = j.select("scenario", "region", "sector", "subsector", "technology", "year",
                 capacity_expr(F.col(value_col), _checked_factor(), "GW").alias("capacity"),
                 F.lit("GW").alias("units"))
    j = j.withColumn("technology", categorise(F.col("technology"), rules))
    return (j.groupBy("scenario", "region", "year", "sector", "subsector", "technology", "units")
             .agg(strict_sum("capacity").alias("capacity")))


def capacity_new(gen_q2: DataFrame, cf_query: DataFrame,
                 include: str | None = K.CAPACITY_INCLUDE_REGEX,
                 exclude: str | None = K.CAPACITY_EXCLUDE_REGEX,
                 rules: Sequence[tuple[str, str]] = K.CAPACITY_RULES) -> DataFrame:
    """New capacity (GW) by technology category.  The capacity factor
    is matched on year, region, technology and scenario only."""
    g = _filtered(gen_q2, include, exclude).withColumnRenamed("value", "generation")
    return _capacity_by_category(g, cf_query, "generation", rules)


def capacity_cumulative(new_cap: DataFrame, from_year: int = K.BASE_YEAR) -> DataFrame:
    """Running sum of new capacity from ``from_year`` on; a missing
    value keeps the rest of its series missing."""
    keys = ["scenario", "region", "sector", "subsector", "technology", "units"]
    df = new_cap.where(F.col("year") >= F.lit(from_year))
    return df.withColumn("cum_cap", strict_cumsum("capacity", keys, ["year"]))


def capacity_installed(gen_q5: DataFrame, cf_query: DataFrame,
                       include: str | None = K.CAPACITY_INCLUDE_REGEX,
                       exclude: str | None = K.CAPACITY_EXCLUDE_REGEX,
                       rules: Sequence[tuple[str, str]] = K.CAPACITY_RULES) -> DataFrame:
    """Installed capacity (GW): every vintage still producing, with
    the capacity factor of the operating year."""
    g = separate(gen_q5, "technology", ["technology", "vintage"], ",")
    g = _filtered(g, include, exclude)
    return _capacity_by_category(g, cf_query, "value", rules)
