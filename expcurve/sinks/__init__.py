"""Sinks: the calibration parameter files (K1, K2) and the keyed write-back
of next-period costs (K3)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PARAM_KEY_ORDER = ("region", "year", "sector", "subsector", "technology")


def write_param_csv(df: DataFrame, path: str, order_by: Sequence[str] = PARAM_KEY_ORDER) -> None:
    """K1 / K2: a parameter table as CSV with headers, rows sorted by their
    keys over the files.  Adaptive execution makes one file of a small table;
    a large one stays in as many sorted files as the sort has tasks."""
    (df.orderBy(*order_by).write.mode("overwrite")
       .option("header", True).option("nullValue", "NA").csv(path))


COST_KEYS = ("scenario", "region", "period")


def write_cost_updates(merged: DataFrame, path: str, partition_by: Sequence[str] = COST_KEYS) -> None:
    """K3: the merged next-period cost rows replace exactly the (scenario,
    region, period) partitions they belong to; other regions and periods stay.

    Nothing is overwritten: the rows go to a folder of their own, and one file
    that names its partitions is added to the list of writes last.  A reader
    (``read_cost_updates``) sees all partitions of a write or none, and a write
    that dies half-way is never seen.  One writer at a time; of writes that run
    side by side and touch the same partition, the one with the larger id wins."""
    spark = merged.sparkSession
    write = f"w-{uuid.uuid4().hex}"
    rows = f"{path.rstrip('/')}/rows/write={write}"
    merged.write.partitionBy(*partition_by).parquet(rows)
    keys = spark.read.schema(merged.schema).parquet(rows).select(*partition_by).distinct()
    listed = _writes(spark, path)
    last = 0 if listed is None else listed.agg(F.max("seq")).first()[0] or 0
    (keys.select(*partition_by, F.lit(last + 1).cast("long").alias("seq"), F.lit(write).alias("write"))
         .coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/writes"))


def _writes(spark: SparkSession, path: str) -> DataFrame | None:
    """The list of writes, None before the first."""
    try:
        return spark.read.parquet(f"{path.rstrip('/')}/writes")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_cost_updates(spark: SparkSession, path: str, schema: StructType | None = None,
                      partition_by: Sequence[str] = COST_KEYS) -> DataFrame:
    """The published cost table: every partition as its newest complete write
    left it.  ``schema`` (default: as stored) is that of the written rows.  The
    list of writes meets the rows on their partition columns, so folders of
    replaced partitions are not read."""
    rows = spark.read
    if schema is not None:
        rows = rows.schema(StructType([*schema.fields, StructField("write", StringType())]))
    rows = rows.parquet(f"{path.rstrip('/')}/rows")
    newest = (_writes(spark, path).groupBy(*partition_by)
              .agg(F.max(F.struct("seq", "write")).alias("_last"))
              .select(*[F.col(k).alias(f"_{k}") for k in partition_by], F.col("_last.write").alias("_write")))
    same = F.col("write") == F.col("_write")
    for k in partition_by:
        # as text: the type that a reader infers for folder names may differ
        same = same & F.col(k).cast("string").eqNullSafe(F.col(f"_{k}").cast("string"))
    return rows.join(newest, same, "left_semi").drop("write")
