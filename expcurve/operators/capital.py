"""Capital costs: levelised -> overnight (D8), non-learning capital
and the capital-cost series of the results analysis (D16, D17)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nasafe import divide, grepl, not_grepl, ordinal, separate, to_number
from .capacity import CF_KEYS
from .joins import small

COST_KEYS = ("scenario", "region", "year", "sector", "subsector", "technology")


def overnight_expr(value: Column, fcr: Column, cap_factor: Column) -> Column:
    """1975$/GJ levelised capital -> 1975$/kW overnight, left to right:
    value / FCR * hours * capacity factor * GJ-per-kWh."""
    return (divide(value, fcr) * F.lit(float(K.HOURS_PER_YEAR)) * cap_factor
            * F.lit(K.CONV_KWH_GJ))


def capital_costs(cost_q4: DataFrame, input_name: str = K.CAPITAL_INPUT) -> DataFrame:
    """Capital rows of the cost query, the ``,year=`` label split off:
    technology + numeric vintage."""
    df = cost_q4.where(F.col("input") == F.lit(input_name))
    df = separate(df, "technology", ["technology", "vintage"], "=")
    return (df.withColumn("technology", F.regexp_replace("technology", ",year", ""))
              .withColumn("vintage", to_number("vintage")))


def _with_cap_factor(costs: DataFrame, cf_q3: DataFrame) -> DataFrame:
    cf = cf_q3.select(*CF_KEYS, F.col("value").alias("cap_factor"))
    return costs.join(cf, list(CF_KEYS), "left")


def overnight_cost(costs: DataFrame, cf_q3: DataFrame, fcr: DataFrame,
                   keep_unmatched: bool = True) -> DataFrame:
    """Overnight capital cost of the technologies that have a fixed
    charge rate.  A rate without any cost row stays as a row with missing
    scenario, year and cost; ``keep_unmatched=False`` leaves these out, for
    joins by scenario that no such row can meet."""
    keys = ["region", "sector", "subsector", "technology"]
    rates = fcr.select(*keys, "FCR")
    # an inner join to the (small) rates reduces the facts before anything is shuffled
    j = _with_cap_factor(costs.join(small(rates), keys, "inner"), cf_q3)
    out = j.select("scenario", "region", "sector", "subsector", "technology", "year",
                   overnight_expr(F.col("value"), F.col("FCR"), F.col("cap_factor"))
                   .alias("cap_cost"))
    if not keep_unmatched:
        return out
    # the rates keep their rows: a technology's costs (one a scenario and year) meet its rate as a list
    listed = out.groupBy(*keys).agg(F.collect_list(F.struct("scenario", "year", "cap_cost")).alias("_costs"))
    kept = rates.join(listed, keys, "left").select(*keys, F.explode_outer("_costs").alias("_c"))
    return kept.select("_c.scenario", *keys, "_c.year", "_c.cap_cost")


@dataclass(frozen=True)
class StorageRule:
    """Which technologies are with or without storage, and how names are split."""
    tech_regex: str = K.STORAGE_TECH_REGEX
    sep: str = K.STORAGE_SEP
    fill: str = K.STORAGE_FILL


@dataclass(frozen=True)
class CcsRule:
    """Which technologies are with or without CCS, and how names are matched."""
    include: str = K.CCS_INCLUDE_REGEX
    exclude: str = K.CCS_EXCLUDE_REGEX
    flag: str = K.CCS_FLAG_REGEX
    strip: str = K.CCS_STRIP


def _storage_part(rule: StorageRule) -> Column:
    """(target, side) of a technology in D9a; null if it has none."""
    pieces = F.split(F.col("technology"), rule.sep)
    side = F.coalesce(F.try_element_at(pieces, F.lit(2)), F.lit(rule.fill))
    target = F.concat(F.try_element_at(pieces, F.lit(1)), F.lit("_storage"))
    return F.when(grepl("technology", rule.tech_regex), F.struct(
        target.alias("target"), F.when(side == "storage", F.lit(_STORAGE)).when(side == rule.fill, F.lit(_NO_STORAGE))
        .otherwise(F.lit(_STORAGE_OTHER)).alias("side")))


def _ccs_part(rule: CcsRule) -> Column:
    target = F.regexp_replace(F.regexp_replace("technology", rule.strip, ""), "\\)", f"{rule.strip})")
    return F.when(grepl("technology", rule.include) & not_grepl("technology", rule.exclude), F.struct(
        target.alias("target"), F.when(grepl("technology", rule.flag), F.lit(_CCS)).otherwise(F.lit(_NO_CCS)).alias("side")))


_OWN, _STORAGE, _NO_STORAGE, _STORAGE_OTHER, _CCS, _NO_CCS = range(6)


def capital_parts(costs: DataFrame, cf_q3: DataFrame, storage: StorageRule | None = None, ccs: CcsRule | None = None,
                  own: bool = True, fcr: float = K.DEFAULT_FCR) -> DataFrame:
    """The capital costs behind D8 and D9, one row per technology and year.

    Costs meet the capacity factors once; a cost row counts for its own
    technology (``own_value``, ``own_rows``), for the technology with storage
    that it is one side of and for the CCS technology that it is one side of.
    One aggregate gives all sides as conditional columns: ``storage_cost`` and
    ``ccs_cost`` are the non-learning capital of D9a and D9b, ``has_storage``
    and ``has_ccs`` tell whether the technology has these rows at all.  Two
    rows for one side fail the job.
    """
    j = _with_cap_factor(costs, cf_q3)
    parts = [F.struct(F.col("technology").alias("target"), F.lit(_OWN).alias("side"))] if own else []
    parts += [_storage_part(storage)] if storage else []
    parts += [_ccs_part(ccs)] if ccs else []
    rows = j.select(*COST_KEYS, "value", "cap_factor", F.explode(F.array_compact(F.array(*parts))).alias("_p"))
    rows = rows.select("scenario", "region", "year", "sector", "subsector", F.col("_p.target").alias("technology"),
                       F.col("_p.side").alias("side"), "value", "cap_factor")
    cost = overnight_expr(F.col("value"), F.lit(fcr), F.col("cap_factor"))

    def side(n: int, c: Column) -> Column:
        hit = F.col("side") == F.lit(n)
        twice = F.raise_error(F.lit("non-learning capital: two costs for one side of a technology")).cast("double")
        return F.when(F.count(F.when(hit, F.lit(1))) > 1, twice).otherwise(F.max(F.when(hit, c)))

    def has(*sides: int) -> Column:
        return F.count(F.when(F.col("side").isin(*sides), F.lit(1))) > 0

    return rows.groupBy(*COST_KEYS).agg(
        F.count(F.when(F.col("side") == _OWN, F.lit(1))).alias("own_rows"),
        F.max(F.when(F.col("side") == _OWN, F.struct("value", "cap_factor"))).alias("own"),
        (side(_STORAGE, cost) - side(_NO_STORAGE, cost)).alias("storage_cost"),
        has(_STORAGE, _NO_STORAGE, _STORAGE_OTHER).alias("has_storage"),
        side(_NO_CCS, cost).alias("ccs_cost"), has(_CCS, _NO_CCS).alias("has_ccs"))


def nonlearning_of(parts: DataFrame) -> DataFrame:
    """D9c from ``capital_parts``: one row for each non-learning part of a technology (bag union)."""
    each = F.array_compact(F.array(F.when(F.col("has_storage"), F.struct(F.col("storage_cost").alias("c"))),
                                   F.when(F.col("has_ccs"), F.struct(F.col("ccs_cost").alias("c")))))
    return parts.select(*COST_KEYS, F.explode(each).alias("_e")).select(*COST_KEYS, F.col("_e.c").alias("nonlearning_cap"))


def nonlearning_storage(costs: DataFrame, cf_q3: DataFrame, fcr: float = K.DEFAULT_FCR, **rule) -> DataFrame:
    """Storage part of a storage technology's capital cost = its cost
    minus the cost of the same technology without storage."""
    return nonlearning_of(capital_parts(costs, cf_q3, StorageRule(**rule), own=False, fcr=fcr))


def nonlearning_ccs(costs: DataFrame, cf_q3: DataFrame, fcr: float = K.DEFAULT_FCR, **rule) -> DataFrame:
    """Non-learning part of a CCS technology = the capital cost of its
    twin without CCS; the twin's name gets " CCS)" back."""
    return nonlearning_of(capital_parts(costs, cf_q3, ccs=CcsRule(**rule), own=False, fcr=fcr))


def nonlearning_all(costs: DataFrame, cf_q3: DataFrame, storage_kw: dict | None = None,
                    ccs_kw: dict | None = None) -> DataFrame:
    """Both non-learning parts in one table (bag union)."""
    return nonlearning_of(capital_parts(costs, cf_q3, StorageRule(**(storage_kw or {})), CcsRule(**(ccs_kw or {})),
                                        own=False))


def capital_cost_series(cost_q4: DataFrame, include: str = K.CAPITAL_COST_INCLUDE_REGEX,
                        exclude: str = K.CAPITAL_COST_EXCLUDE_REGEX,
                        levels: Sequence[str] = K.CAPITAL_COST_LEVELS,
                        input_name: str = K.CAPITAL_INPUT) -> DataFrame:
    """Capital cost per technology and vintage, technologies in a fixed
    order (``technology_ord``; null when not among the levels)."""
    df = cost_q4.where((F.col("input") == F.lit(input_name)) & grepl("technology", include)
                       & not_grepl("technology", exclude))
    df = separate(df, "technology", ["technology", "vintage"], ",")
    df = df.withColumn("vintage", to_number(F.regexp_replace("vintage", "year=", "")))
    return df.withColumn("technology_ord", ordinal("technology", levels))


def capital_cost_view(series: DataFrame, years: tuple[int, int] = K.CHART_YEARS,
                      scenarios: Sequence[str] = K.CAPITAL_COST_VIEW_SCENARIOS,
                      labels: Sequence[tuple[str, str]] = K.CAPITAL_COST_VIEW_LABELS,
                      other_label: str = K.CAPITAL_COST_VIEW_OTHER_LABEL) -> DataFrame:
    """The chart table: years in range, two scenarios, relabelled."""
    df = series.where(F.col("year").between(*years) & F.col("scenario").isin(*scenarios))
    lab = F.lit(other_label)
    for name, label in reversed(list(labels)):
        lab = F.when(F.col("scenario") == F.lit(name), F.lit(label)).otherwise(lab)
    return df.withColumn("scenario", lab)
