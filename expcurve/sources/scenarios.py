"""Several scenario runs as one table (S3).

Each run's flat tables are read and tagged with the scenario name stored in
the run, then unioned; written back partitioned by scenario so that adding
a run again replaces only that run's partition (dynamic overwrite), as
re-adding a scenario to a project does."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_scenarios(spark: SparkSession, runs: Mapping[str, str], fmt: str = "parquet",
                   **options) -> DataFrame:
    """``runs`` maps scenario name -> path of that run's table."""
    out = None
    for scenario, path in runs.items():
        df = spark.read.format(fmt).options(**options).load(path)
        df = df.select(F.lit(scenario).alias("scenario"),
                       *[c for c in df.columns if c != "scenario"])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no scenario runs given")
    return out


def write_scenarios(df: DataFrame, path: str, partition_by=("scenario",)) -> None:
    """Write (or replace) the scenarios present in ``df`` only."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_by).parquet(path))
