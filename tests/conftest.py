import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
FIXTURE_LAYOUT = {
    "learning_rates": "learning_rates.csv",
    "t0_cost_deployment": "t0_cost_deployment.csv",
    "tech_FCR": "tech_FCR.csv",
    "cooling_tech_map": "cooling_tech_map.csv",
    "deployment_map": "deployment_map.csv",
    "learning_map": "learning_map.csv",
    "cal_adders": "cal_adders.csv",
    "non_learning_capital": "non_learning_capital.csv",
}


@pytest.fixture(scope="session")
def spark():
    from expcurve.session import get_session

    s = get_session("expcurve-tests", master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def params(spark):
    from expcurve.sources.params import read_params

    return read_params(spark, FIXTURES, FIXTURE_LAYOUT)


def rows(df, *cols):
    """Sorted tuples of the given columns (all columns when none given)."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))
