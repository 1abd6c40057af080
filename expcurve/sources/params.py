"""Parameter tables from CSV (S1, S2): explicit schemas, ``NA`` = null,
header names checked against the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import PARAM_SCHEMAS

# FIXED VALUES: where each parameter table lives in an analysis folder
INPUT_LAYOUT = {
    "learning_rates": "input/learning_rates.csv",
    "t0_cost_deployment": "input/t0_cost_deployment.csv",
    "tech_FCR": "input/tech_FCR.csv",
    "cooling_tech_map": "input/mappings/cooling_tech_map.csv",
    "deployment_map": "input/mappings/learning_components_deployment_map.csv",
    "learning_map": "input/mappings/learning_components_learning_map.csv",
    "cal_adders": "params/cal_adders.csv",
    "non_learning_capital": "params/non_learning_capital.csv",
}


def read_param_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One parameter table; a header that does not match the schema's
    column names fails instead of shifting columns."""
    return (spark.read.schema(PARAM_SCHEMAS[name])
            .option("header", True).option("enforceSchema", False)
            .option("nullValue", "NA").option("mode", "FAILFAST")
            .csv(path))


def read_params(spark: SparkSession, root: str, layout: dict[str, str] | None = None,
                names=None) -> dict[str, DataFrame]:
    """All parameter tables of an analysis folder (missing ones skipped
    only when ``names`` does not ask for them)."""
    layout = layout or INPUT_LAYOUT
    names = names or list(layout)
    return {n: read_param_csv(spark, f"{root.rstrip('/')}/{layout[n]}", n) for n in names}
