"""Scenario results: generation by fuel (D22), scenario differences (D23,
D24), carbon price (D25) and chart tables (D26)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nasafe import (categorise, grepl, ordinal, pivot_checked, separate,
                                strict_sum, unpivot)


def generation_by_fuel(gen: DataFrame, rules: Sequence[tuple[str, str]] = K.FUEL_RULES,
                       ccs_regex: str = K.FUEL_CCS_REGEX,
                       ccs_labels: tuple[str, str] = K.FUEL_CCS_LABELS,
                       levels: Sequence[str] = K.FUEL_LEVELS) -> DataFrame:
    """Generation by fuel category and CCS flag (first matching rule
    wins, unmatched technologies keep their name).  ``gen`` is Q5, or its rows
    before the sum (``all_vintage_rows``): these are summed once, straight to
    fuels, and the facts are not shuffled by vintage.  A missing value makes
    its fuel's sum missing in both forms."""
    df = gen if "vintage" in gen.columns else separate(gen, "technology", ["technology", "vintage"], ",")
    df = df.select("scenario", "region", "year", "value",
                   F.when(grepl("technology", ccs_regex), F.lit(ccs_labels[0]))
                    .otherwise(F.lit(ccs_labels[1])).alias("CCS"),
                   categorise(F.col("technology"), rules).alias("technology"))
    g = (df.groupBy("scenario", "region", "technology", "CCS", "year")
           .agg(strict_sum("value").alias("value")))
    return g.withColumn("technology_ord", ordinal("technology", levels))


def diff_to_reference(gen: DataFrame, reference: str = K.REFERENCE_SCENARIO,
                      others: Sequence[str] = (K.EXOGENOUS_SCENARIO, K.ENDOGENOUS_SCENARIO),
                      ids: Sequence[str] = ("region", "technology", "CCS", "year",
                                            "technology_ord")) -> DataFrame:
    """Each other scenario minus the reference (missing -> 0); the
    reference itself stays a level."""
    scen = [reference, *others]
    wide = pivot_checked(gen, ids, "scenario", "value", scen).na.fill(0.0, scen)
    wide = wide.select(*ids, reference, *[(F.col(s) - F.col(reference)).alias(s) for s in others])
    long = unpivot(wide, ids, scen, "scenario", "value")
    return long.withColumn("scenario_ord", ordinal("scenario", scen))


def diff_pair(gen: DataFrame, base: str = K.EXOGENOUS_SCENARIO,
              target: str = K.ENDOGENOUS_SCENARIO, drop: str | None = K.REFERENCE_SCENARIO,
              name: str = K.PAIR_DIFF_NAME,
              ids: Sequence[str] = ("region", "technology", "CCS", "year",
                                    "technology_ord")) -> DataFrame:
    """Target - base next to the base level; the target level stays as
    an extra column, as in the original."""
    df = gen if drop is None else gen.where(F.col("scenario") != F.lit(drop))
    wide = pivot_checked(df, ids, "scenario", "value", [base, target]).na.fill(0.0, [base, target])
    wide = wide.select(*ids, target, base, (F.col(target) - F.col(base)).alias(name))
    long = unpivot(wide, [*ids, target], [base, name], "scenario", "value")
    return long.withColumn("scenario_ord", ordinal("scenario", [base, name]))


def carbon_price(prices_q6: DataFrame, market: str = K.CO2_MARKET,
                 years: tuple[int, int] = K.PRICE_YEARS) -> DataFrame:
    """Carbon price of one market over a year range."""
    return prices_q6.where((F.col("market") == F.lit(market)) & F.col("year").between(*years))


def chart_table(df: DataFrame, years: tuple[int, int] = K.CHART_YEARS,
                levels: Sequence[str] | None = None, col: str = "technology") -> DataFrame:
    """Rows of a chart: year range, category order as an ordinal."""
    out = df.where(F.col("year").between(*years))
    if levels is not None:
        out = out.withColumn(f"{col}_ord", ordinal(col, levels))
    return out
