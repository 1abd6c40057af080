"""Property tests (hypothesis): cumulative deployment is monotone and ends
at the total; the learning curve follows the doubling law."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from expcurve.operators import capacity as C
from expcurve.operators import learning as L

YEARS = [2015, 2020, 2025, 2030, 2035]

series = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]), st.sampled_from(YEARS),
              st.floats(min_value=0, max_value=1e6, allow_nan=False)),
    min_size=1, max_size=20, unique_by=lambda t: (t[0], t[1]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=series)
def test_cumulative_deployment_monotone(spark, data):
    df = spark.createDataFrame([("S", "R", k, y, v) for k, y, v in data],
                               "scenario string, region string, learning_component string, "
                               "year int, capacity double")
    out = C.cumulative_deployment(df, years=YEARS).collect()
    by_key = {}
    for r in out:
        by_key.setdefault(r["learning_component"], []).append((r["year"], r["cum_cap"]))
    for k, vals in by_key.items():
        vals.sort()
        assert [y for y, _ in vals] == YEARS              # complete grid
        cums = [c for _, c in vals]
        assert all(b >= a for a, b in zip(cums, cums[1:]))
        total = sum(v for kk, _, v in data if kk == k)
        assert cums[-1] == pytest.approx(total, rel=1e-9, abs=1e-9)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rate=st.floats(min_value=0.01, max_value=0.5), t0=st.floats(min_value=1, max_value=5000),
       dep=st.floats(min_value=1, max_value=1e8), k=st.integers(min_value=0, max_value=6))
def test_doubling_law(spark, rate, t0, dep, k):
    comp = "x"
    rates = spark.createDataFrame([("R", comp, rate)], "region string, learning_component string, learning_rate double")
    t0df = spark.createDataFrame([("R", comp, t0, dep)],
                                 "region string, learning_component string, t0_cost double, t0_deployment double")
    cum = spark.createDataFrame([("R", comp, dep * 2 ** k), ("R", comp, dep * 2 ** (k + 1))],
                                "region string, learning_component string, cum_cap double")
    got = sorted(r["learned_cost"] for r in L.learning_curve(cum, rates, t0df).collect())
    lo, hi = got
    assert hi == pytest.approx(t0 * (1 - rate) ** k, rel=1e-9)
    assert lo == pytest.approx(hi * (1 - rate), rel=1e-9)
