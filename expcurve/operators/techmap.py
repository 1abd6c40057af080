"""Technology mappings: cooling roll-up (D2), generation union (D15),
and label rewrites (D27)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nasafe import literal_lookup
from .joins import small

TECH = ("sector", "subsector", "technology")


def cooling_rollup(df: DataFrame, cooling_map: DataFrame) -> DataFrame:
    """Replace cooling-level names by their pass-through names where
    the cooling map has them (left join + coalesce of the three levels)."""
    m = cooling_map.select(*TECH, "sector_passthru", "subsector_passthru", "technology_passthru")
    j = df.join(small(m), list(TECH), "left")
    return j.select(*[F.coalesce(F.col(f"{c}_passthru"), F.col(c)).alias(c)
                      if c in TECH else F.col(c) for c in df.columns])


def generation_union(outputs: DataFrame, cooling_map: DataFrame) -> DataFrame:
    """Pass-through generation without the technologies that are also
    reported at cooling level (anti join), cooling-level generation of the
    mapped sectors (semi join) and rooftop generation, as one bag."""
    from ..sources import queries as Q

    # one scan: a row is taken once for every path whose predicate it meets
    kinds = {"elec": Q.elec_path(), "cooling": Q.cooling_path(), "rooftop": Q.rooftop_path()}
    any_kind = kinds["elec"] | kinds["cooling"] | kinds["rooftop"]
    kind = F.explode(F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in kinds.items()])))
    rows = outputs.where(any_kind).withColumnRenamed("value", "physical_output").withColumn("_kind", kind)
    # an anti join needs no distinct right side: duplicates do not change it
    passthru = cooling_map.select(F.col("technology_passthru").alias("_name"))
    rows = rows.join(small(passthru), (F.col("_kind") == "elec") & (F.col("technology") == F.col("_name")), "left_anti")
    cool = cooling_map.select(F.col("sector").alias("_sector"), F.lit(True).alias("_mapped")).distinct()
    rows = rows.join(small(cool), F.col("sector") == F.col("_sector"), "left")
    rows = rows.where((F.col("_kind") != "cooling") | F.col("_mapped"))
    return rows.drop("_kind", "_sector", "_mapped")


def rewrite_labels(df: DataFrame, rewrites=K.LABEL_REWRITES,
                   levels: Sequence[str] = ("sector", "subsector")) -> DataFrame:
    """Relabel levels by a (level, from, to) table; unmatched labels
    stay.  A literal table becomes a map lookup inside the projection (no
    join); a DataFrame, a parameter table of few rows, becomes one map per level
    by a scalar subquery, so the facts meet no join and no shuffle.  Repeated
    rows count once; a label with two new names fails the job."""
    if not isinstance(rewrites, DataFrame):
        rows = list(rewrites)
        out = df
        for lvl in levels:
            pairs = [(f, t) for (lv, f, t) in rows if lv == lvl]
            if pairs:
                out = out.withColumn(lvl, F.coalesce(literal_lookup(F.col(lvl), pairs),
                                                     F.col(lvl)))
        return out
    out = df
    for lvl in levels:
        r = rewrites.where((F.col("level") == F.lit(lvl)) & F.col("from").isNotNull())
        pairs = r.agg(F.map_from_entries(F.collect_set(F.struct("from", "to")))).scalar()
        out = out.withColumn(lvl, F.coalesce(F.try_element_at(pairs, F.col(lvl)), F.col(lvl)))
    return out.select(*df.columns)
