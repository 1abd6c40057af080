"""Invariants of the reference's parameter and golden files (I1-I8) and the
learning-curve value vectors, read through the CSV source."""

import pytest
from pyspark.sql import functions as F

from expcurve.operators import learning as L
from tests.conftest import rows


def test_param_tables_read_with_schema(params):
    sizes = {k: v.count() for k, v in params.items()}
    assert sizes == {"learning_rates": 11, "t0_cost_deployment": 11, "tech_FCR": 13,
                     "cooling_tech_map": 28, "deployment_map": 24, "learning_map": 18,
                     "cal_adders": 69, "non_learning_capital": 48}
    assert dict(params["deployment_map"].dtypes)["multiplier"] == "int"


def test_csv_header_mismatch_fails(spark, tmp_path):
    from expcurve.sources.params import read_param_csv

    p = tmp_path / "bad.csv"
    p.write_text("region,component,learning_rate\nUSA,PV module,0.2\n")
    with pytest.raises(Exception):
        read_param_csv(spark, str(p), "learning_rates").collect()


def test_i1_csp_and_csp_storage_adders_equal(params):
    ca = params["cal_adders"]
    csp = dict(rows(ca.where("technology = 'CSP'"), "year", "cal_adder"))
    sto = dict(rows(ca.where("technology = 'CSP_storage'"), "year", "cal_adder"))
    assert csp and csp == sto


def test_i2_keys_unique_and_row_counts(params):
    ca = params["cal_adders"]
    keys = ["region", "year", "sector", "subsector", "technology"]
    assert ca.select(*keys).distinct().count() == ca.count()
    per_year = dict(rows(ca.groupBy("year").count()))
    assert per_year.pop(2020) == 9 and set(per_year.values()) == {10}


def test_i3_no_ccs_adders(params):
    assert params["cal_adders"].where(F.col("technology").contains("CCS")).count() == 0


def test_i4_wind_offshore_first_year(params):
    w = dict(rows(params["cal_adders"].where("technology = 'wind_offshore'"), "year", "cal_adder"))
    assert min(w) == 2025
    assert w[2025] == pytest.approx(561.5436, abs=1e-3) and w[2030] == pytest.approx(306.7, abs=0.1)


def test_i5_first_year_sign_flip(params):
    ca = params["cal_adders"]
    for tech in ("PV_storage", "wind_storage", "rooftop_pv"):
        v = dict(rows(ca.where(F.col("technology") == tech), "year", "cal_adder"))
        assert v[2020] > 0 > v[2025], tech


def test_i6_pv_module_deployment_is_sum_of_bos(params):
    t0 = dict(rows(params["t0_cost_deployment"], "learning_component", "t0_deployment"))
    assert t0["PV module"] == t0["PV utility BOS"] + t0["PV rooftop BOS"]


def test_i7_non_learning_capital_shape(params):
    nl = params["non_learning_capital"]
    assert nl.select("technology").distinct().count() == 4
    assert nl.select("year").distinct().count() == 12
    early = nl.where("year <= 2015").groupBy("technology").agg(
        F.countDistinct("nonlearning_cap").alias("n"))
    assert {r["n"] for r in early.collect()} == {1}


VECTORS = [  # component, cumulative deployment, learned cost
    ("PV module", 25689000.0, 188.0),
    ("PV module", 51378000.0, 147.6552),
    ("PV module", 102756000.0, 115.96839408),
    ("grid_storage", 584000.0, 1105.2),
    ("wind_offshore", 2.0, 1019.616),
    ("wind", 0.0, 0.0),
    ("wind", None, None),
]


def test_learning_curve_value_vectors_and_doubling_law(spark, params):  # I8
    cum = spark.createDataFrame([("USA", c, x) for c, x, _ in VECTORS],
                                "region string, learning_component string, cum_cap double")
    out = L.learning_curve(cum, params["learning_rates"], params["t0_cost_deployment"])
    got = [(r["learning_component"], r["cum_cap"], r["learned_cost"]) for r in out.collect()]
    for comp, x, expected in VECTORS:
        val = next(v for c, cx, v in got if c == comp and cx == x)
        if expected is None:
            assert val is None
        else:
            assert val == pytest.approx(expected, rel=1e-9)
