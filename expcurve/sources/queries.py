"""The model-output queries as predicates over the flat fact tables.

Stored queries (Q1-Q6) and the per-period path queries (P1-P7) are column
filters and projections here; Catalyst pushes them into the Parquet scan.
No query language is parsed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nasafe import grepl, order_free_sum
from ..operators.joins import small
from ..operators.techmap import rewrite_labels

Exclusion = Sequence[str] | DataFrame | None


def _region(df: DataFrame, region: str | None) -> DataFrame:
    return df if region is None else df.where(F.col("region") == F.lit(region))


def elec_sector_predicate(sectors: Sequence[str] = K.ELEC_SECTORS,
                          substring: str = K.ELEC_SECTOR_SUBSTRING,
                          excluded_substring: str = K.EXCLUDED_SECTOR_SUBSTRING):
    # a row passes the first part only with a non-null sector, so the plain
    # (pushable) predicates keep the missing-value meaning of the original
    s = F.col("sector")
    return (s.isin(*sectors) | s.contains(substring)) & ~s.contains(excluded_substring)


def _exclude_technologies(df: DataFrame, exclude: Exclusion) -> DataFrame:
    if exclude is None:
        return df
    if isinstance(exclude, DataFrame):
        # an anti join needs no distinct right side: duplicates do not change it
        names = exclude.select(F.col(exclude.columns[0]).alias("technology"))
        return df.join(small(names), "technology", "left_anti")
    # `not(@name = a or @name = b ...)`: a missing name is not excluded
    return df.where(~F.coalesce(F.col("technology").isin(*exclude), F.lit(False)))


def generation_rows(outputs: DataFrame, region: str | None = K.DEFAULT_REGION,
                    new_vintage_only: bool = True,
                    exclude_technologies: Exclusion = K.PASSTHRU_EXCLUDED_TECHNOLOGIES,
                    rewrites=None, excluded_subsector: str = K.EXCLUDED_SUBSECTOR, **sector_kw) -> DataFrame:
    """The rows that Q1 / Q2 / Q5 sum, with the vintage as ``period``."""
    df = _region(outputs, region).where(elec_sector_predicate(**sector_kw))
    df = df.where(F.coalesce(F.col("subsector") != F.lit(excluded_subsector), F.lit(True)))
    if new_vintage_only:
        df = df.where(F.col("year") == F.col("period"))
    df = _exclude_technologies(df, exclude_technologies)
    if rewrites is not None:
        df = rewrite_labels(df, rewrites)
    return df


def generation_query(outputs: DataFrame, region: str | None = K.DEFAULT_REGION,
                     new_vintage_only: bool = True, vintage_label: bool = False, **kw) -> DataFrame:
    """Q1 / Q2 / Q5: electricity generation by technology.

    ``new_vintage_only`` keeps values whose year is the technology's own
    year; ``rewrites`` relabels sector/subsector (D27); ``vintage_label``
    appends ``,year=<vintage>`` to the technology name.  Values of rows
    that end up with the same labels are summed, as the query tool does."""
    df = generation_rows(outputs, region, new_vintage_only, **kw)
    tech = F.col("technology")
    if vintage_label:
        tech = F.concat(tech, F.lit(",year="), F.col("period").cast("string"))
    return (df.groupBy("scenario", "region", "sector", "subsector", tech.alias("technology"),
                       "year")
              .agg(order_free_sum("value").alias("value")))


def new_vintage_generation(outputs: DataFrame, **kw) -> DataFrame:
    """Q1: new-vintage generation, no label rewrite."""
    return generation_query(outputs, new_vintage_only=True, **kw)


def labelled_new_vintage_generation(outputs: DataFrame, rewrites=K.LABEL_REWRITES, **kw) -> DataFrame:
    """Q2: Q1 with the sector/subsector label rewrites."""
    return generation_query(outputs, new_vintage_only=True, rewrites=rewrites, **kw)


def all_vintage_generation(outputs: DataFrame, rewrites=K.LABEL_REWRITES, **kw) -> DataFrame:
    """Q5: generation of every vintage in every year, ``,year=`` label."""
    return generation_query(outputs, new_vintage_only=False, rewrites=rewrites,
                            vintage_label=True, **kw)


def all_vintage_rows(outputs: DataFrame, rewrites=K.LABEL_REWRITES, **kw) -> DataFrame:
    """The rows of Q5 before its sum, for consumers that sum over vintages
    themselves: the vintage is a column, no label is made to be split again."""
    return (generation_rows(outputs, new_vintage_only=False, rewrites=rewrites, **kw)
            .select("scenario", "region", "sector", "subsector", "technology",
                    F.col("period").alias("vintage"), "year", "value"))


def capacity_factor_query(capacity_factors: DataFrame,
                          region: str | None = K.DEFAULT_REGION) -> DataFrame:
    """Q3: capacity factor of every technology; year = technology year."""
    return _region(capacity_factors, region).select(
        "scenario", "region", "sector", "subsector", "technology",
        F.col("period").alias("year"), "value")


def input_cost_query(input_costs: DataFrame, region: str | None = K.DEFAULT_REGION,
                     **sector_kw) -> DataFrame:
    """Q4: price paid per input in the technology's own year; the
    technology label carries ``,year=<vintage>``."""
    df = _region(input_costs, region).where(elec_sector_predicate(**sector_kw))
    df = df.where(F.col("year") == F.col("period"))
    return df.select("scenario", "region", "sector", "subsector",
                     F.concat(F.col("technology"), F.lit(",year="),
                              F.col("period").cast("string")).alias("technology"),
                     "input", "year", "value")


def market_price_query(market_prices: DataFrame, substring: str = "CO2") -> DataFrame:
    """Q6: prices of markets whose name contains ``substring``."""
    return market_prices.where(F.col("market").contains(substring))


# ---------------------------------------------------------------------------
# path queries of the per-period update
# ---------------------------------------------------------------------------
_REGEX_META = set(".^$*+?{}[]()|\\")


def regex_predicate(c, pattern: str):
    """Regex match; an anchored literal prefix (``^elec_``) becomes a
    ``startswith`` the Parquet reader can use for row-group pruning."""
    if pattern.startswith("^") and not (set(pattern[1:]) & _REGEX_META):
        return c.startswith(pattern[1:])
    return grepl(c, pattern)


def elec_path():
    """Rows of the electricity sector."""
    return F.col("sector") == F.lit(K.PATH_ELEC_SECTOR)


def rooftop_path():
    """Rows of rooftop PV."""
    return (F.col("sector") == F.lit(K.PATH_ROOFTOP_SECTOR)) & (F.col("subsector") == F.lit(K.PATH_ROOFTOP_SUBSECTOR))


def cooling_path():
    """Rows of cooling-level sectors (regex match)."""
    return regex_predicate(F.col("sector"), K.PATH_COOLING_SECTOR_REGEX)


def path_generation(outputs: DataFrame) -> DataFrame:
    """Generation of the electricity sector."""
    return outputs.where(elec_path()).withColumnRenamed("value", "physical_output")


def path_rooftop_generation(outputs: DataFrame) -> DataFrame:
    """Generation of rooftop PV."""
    return outputs.where(rooftop_path()).withColumnRenamed("value", "physical_output")


def path_costs(input_costs: DataFrame) -> DataFrame:
    """Adjusted input costs of the electricity sector."""
    return input_costs.where(elec_path()).withColumnRenamed("value", "adjusted_cost")


def path_rooftop_costs(input_costs: DataFrame) -> DataFrame:
    """Adjusted input costs of rooftop PV."""
    return input_costs.where(rooftop_path()).withColumnRenamed("value", "adjusted_cost")


def path_all_costs(input_costs: DataFrame) -> DataFrame:
    """P3 and P4 in one scan (no row belongs to both)."""
    return input_costs.where(elec_path() | rooftop_path()).withColumnRenamed("value", "adjusted_cost")


def path_capacity_factors(capacity_factors: DataFrame) -> DataFrame:
    """P5: capacity factors of the electricity sector, per vintage."""
    return capacity_factors.where(elec_path()).withColumnRenamed("value", "capacity_factor")


def path_rooftop_capacity_factors(capacity_factors: DataFrame) -> DataFrame:
    """Capacity factors of rooftop PV."""
    return capacity_factors.where(rooftop_path()).withColumnRenamed("value", "capacity_factor")


def path_all_capacity_factors(capacity_factors: DataFrame) -> DataFrame:
    """P5 and P6 in one scan (no row belongs to both)."""
    return capacity_factors.where(elec_path() | rooftop_path()).withColumnRenamed("value", "capacity_factor")


def path_cooling_generation(outputs: DataFrame) -> DataFrame:
    """Generation of cooling-level sectors (regex match)."""
    return outputs.where(cooling_path()).withColumnRenamed("value", "physical_output")
