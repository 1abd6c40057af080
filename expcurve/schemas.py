"""Explicit schemas of the parameter and fact tables."""

from __future__ import annotations

from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField,
                               StructType)


def _schema(*cols: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


S, D, I = StringType(), DoubleType(), IntegerType()

# parameter tables (CSV)
LEARNING_RATES = _schema(("region", S), ("learning_component", S), ("learning_rate", D))
T0_COST_DEPLOYMENT = _schema(("region", S), ("learning_component", S),
                             ("t0_cost", D), ("t0_deployment", D))
TECH_FCR = _schema(("region", S), ("sector", S), ("subsector", S), ("technology", S), ("FCR", D))
COOLING_TECH_MAP = _schema(("sector_passthru", S), ("subsector_passthru", S),
                           ("technology_passthru", S), ("sector", S), ("subsector", S),
                           ("technology", S))
DEPLOYMENT_MAP = _schema(("sector", S), ("subsector", S), ("technology", S),
                         ("learning_component", S), ("multiplier", I))
LEARNING_MAP = _schema(("sector", S), ("subsector", S), ("technology", S),
                       ("learning_component", S))
CAL_ADDERS = _schema(("region", S), ("year", I), ("sector", S), ("subsector", S),
                     ("technology", S), ("cal_adder", D))
NON_LEARNING_CAPITAL = _schema(("region", S), ("year", I), ("sector", S), ("subsector", S),
                               ("technology", S), ("nonlearning_cap", D))

PARAM_SCHEMAS = {
    "learning_rates": LEARNING_RATES,
    "t0_cost_deployment": T0_COST_DEPLOYMENT,
    "tech_FCR": TECH_FCR,
    "cooling_tech_map": COOLING_TECH_MAP,
    "deployment_map": DEPLOYMENT_MAP,
    "learning_map": LEARNING_MAP,
    "cal_adders": CAL_ADDERS,
    "non_learning_capital": NON_LEARNING_CAPITAL,
}

# flat fact tables (one number per row)
TECH_KEYS = ("scenario", "region", "sector", "subsector", "technology")
OUTPUTS = _schema(("scenario", S), ("region", S), ("sector", S), ("subsector", S),
                  ("technology", S), ("period", I), ("output", S), ("year", I), ("value", D))
INPUT_COSTS = _schema(("scenario", S), ("region", S), ("sector", S), ("subsector", S),
                      ("technology", S), ("period", I), ("input", S), ("year", I), ("value", D))
CAPACITY_FACTORS = _schema(("scenario", S), ("region", S), ("sector", S), ("subsector", S),
                           ("technology", S), ("period", I), ("value", D))
MARKET_PRICES = _schema(("scenario", S), ("market", S), ("year", I), ("value", D))
