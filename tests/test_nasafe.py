"""Missing-value traps T1-T11 and the reshaping helpers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from expcurve.functions import nasafe as N
from expcurve.operators.joins import join_dim
from tests.conftest import rows


def test_strict_sum_poisons_group(spark):  # T1
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, x double")
    out = dict(rows(df.groupBy("k").agg(N.strict_sum("x").alias("s"))))
    assert out == {"a": None, "b": 5.0}


def test_strict_cumsum_stays_missing(spark):  # T2
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0), ("b", 1, 4.0)],
                               "k string, y int, x double")
    out = rows(df.withColumn("c", N.strict_cumsum("x", ["k"], ["y"])), "k", "y", "c")
    assert out == [("a", 1, 1.0), ("a", 2, None), ("a", 3, None), ("b", 1, 4.0)]


def test_zero_capacity_factor_gives_infinite_capacity(spark):  # T3
    from expcurve.operators.capacity import capacity_expr

    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 1.0), (0.0, 0.0), (None, 0.0)], "g double, cf double")
    out = [r[0] for r in df.select(capacity_expr(F.col("g"), F.col("cf"))).collect()]
    assert out[0] == float("inf") and out[1] is None and out[4] is None
    assert out[2] == pytest.approx(31709791.98, rel=1e-9)   # 1 EJ at cf 1
    assert out[3] != out[3]


def test_infinite_capacity_ends_a_components_costs(spark):  # T3
    from expcurve.operators.capacity import cumulative_deployment
    from expcurve.operators.learning import lag_cost, learning_curve

    cap = spark.createDataFrame([("S", "R", "c", 2015, 4.0), ("S", "R", "c", 2020, float("inf")), ("S", "R", "c", 2025, 1.0),
                                 ("S", "R", "c", 2030, 1.0)],
                                "scenario string, region string, learning_component string, year int, capacity double")
    rates = spark.createDataFrame([("R", "c", 0.5)], "region string, learning_component string, learning_rate double")
    t0 = spark.createDataFrame([("R", "c", 8.0, 2.0)],
                               "region string, learning_component string, t0_cost double, t0_deployment double")
    learned = learning_curve(cumulative_deployment(cap), rates, t0)
    assert rows(learned, "year", "learned_cost") == [(2015, 4.0), (2020, 0.0), (2025, 0.0), (2030, 0.0)]
    assert lag_cost(learned).count() == 0       # no cost but the first year's, which has no year to lag into


def test_sum_na_rm_all_missing_is_zero(spark):  # T4
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", None)], "k string, x double")
    assert dict(rows(df.groupBy("k").agg(N.sum_na_rm("x").alias("s")))) == {"a": 0.0, "b": 1.0}


def test_null_safe_join_matches_missing_keys(spark):  # T5
    fact = spark.createDataFrame([(None, 1.0), ("x", 2.0)], "k string, v double")
    dim = spark.createDataFrame([(None, "n"), ("x", "X")], "k string, label string")
    plain = rows(join_dim(fact, dim, ["k"]), "v", "label")
    safe = rows(join_dim(fact, dim, ["k"], null_safe=True), "v", "label")
    assert plain == [(1.0, None), (2.0, "X")]
    assert safe == [(1.0, "n"), (2.0, "X")]


def test_negated_regex_keeps_missing(spark):  # T6
    df = spark.createDataFrame([("coal",), (None,), ("wind",)], "t string")
    assert df.where(N.not_grepl("t", "coal")).count() == 2
    assert df.where(N.grepl("t", "coal")).count() == 1


def test_literal_paren_replacement(spark):  # T7
    df = spark.createDataFrame([("coal (conv pul)",)], "t string")
    out = df.select(F.regexp_replace("t", "\\)", " CCS)").alias("t")).first()[0]
    assert out == "coal (conv pul CCS)"


def test_text_to_number(spark):  # T8
    df = spark.createDataFrame([("2020",), (" 2025",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(N.to_number("v")).collect()] == [2020.0, 2025.0, None, None]


def test_pivot_duplicate_key_fails(spark):  # T9
    df = spark.createDataFrame([("a", "s", 1.0), ("a", "s", 2.0)], "k string, n string, v double")
    with pytest.raises(Exception, match="duplicate"):
        N.pivot_checked(df, ["k"], "n", "v", ["s", "t"]).collect()


def test_pivot_literal_columns(spark):
    df = spark.createDataFrame([("a", "s", 1.0), ("a", "t", None), ("b", "t", 3.0)],
                               "k string, n string, v double")
    out = rows(N.pivot_checked(df, ["k"], "n", "v", ["s", "t"]), "k", "s", "t")
    assert out == [("a", 1.0, None), ("b", None, 3.0)]


def test_unpivot_keeps_missing(spark):
    df = spark.createDataFrame([("a", 1.0, None)], "k string, s double, t double")
    out = rows(N.unpivot(df, ["k"], ["s", "t"], "name", "value"), "name", "value")
    assert out == [("s", 1.0), ("t", None)]


def test_separate_right_fills_missing(spark):
    df = spark.createDataFrame([("CSP_storage", 1), ("CSP", 2)], "technology string, i int")
    out = N.separate(df, "technology", ["technology", "storage"], "_")
    assert out.columns == ["technology", "storage", "i"]
    assert rows(out) == [("CSP", "storage", 1), ("CSP", None, 2)]


def test_ordinal_outside_levels_is_missing(spark):
    df = spark.createDataFrame([("PV",), ("wind",), ("hydro",)], "t string")
    out = [r[0] for r in df.select(N.ordinal("t", ["PV", "CSP", "wind"])).collect()]
    assert out == [1, 3, None]


def test_categorise_first_match_wins(spark):
    rules = [("CSP_storage", "CSP_storage"), ("CSP", "CSP"), ("Gen", "nuclear")]
    df = spark.createDataFrame([("CSP_storage (dry)",), ("CSP",), ("Gen_III",), ("PV",), (None,)], "t string")
    out = [r[0] for r in df.select(N.categorise(F.col("t"), rules)).collect()]
    assert out == ["CSP_storage", "CSP", "nuclear", "PV", None]


def test_complete_years_fills_grid(spark):
    df = spark.createDataFrame([("a", 2015, 1.0), ("a", 2025, 2.0), ("b", 2020, 3.0)],
                               "k string, year int, v double")
    out = rows(N.complete_years(df, ["k"], "v"), "k", "year", "v")
    assert out == [("a", 2015, 1.0), ("a", 2020, 0.0), ("a", 2025, 2.0),
                   ("b", 2015, 0.0), ("b", 2020, 3.0), ("b", 2025, 0.0)]
    # the grid is built without a join or a cross product
    plan = N.complete_years(df, ["k"], "v", years=[2015, 2020, 2025])._jdf.queryExecution() \
        .executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_distinct_list_is_part_of_the_plan(spark):
    df = spark.range(5000).selectExpr("id % 2500 as y")
    out = spark.range(1).select(F.size(N.distinct_list(df, "y")).alias("n"))
    assert out.first().n == 2500                       # no bound, and no list in the driver program
    assert "Subquery" in out._jdf.queryExecution().executedPlan().toString()
    assert spark.range(1).select(N.distinct_list(df.where("y < 3"), "y")).first()[0] == [0, 1, 2]


def test_zero_divisor(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.0,), (float("nan"),), (None,)], "n double")
    got = [r[0] for r in df.select(N.divide(F.col("n"), F.lit(0.0))).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and math.isnan(got[3]) and got[4] is None


def test_na_drop_and_fill_treat_nan_as_missing(spark):  # R11 / R9
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert df.na.drop().count() == 1
    assert sorted(r[0] for r in df.na.fill(0.0).collect()) == [0.0, 0.0, 1.0]
    assert not any(isinstance(r[0], float) and math.isnan(r[0]) for r in df.na.fill(0.0).collect())


def test_complete_years_never_drops_rows(spark):
    df = spark.createDataFrame([("a", 2015, 1.0), ("a", 2030, 2.0)], "k string, year int, v double")
    out = rows(N.complete_years(df, ["k"], "v", years=[2015, 2020]), "k", "year", "v")
    assert out == [("a", 2015, 1.0), ("a", 2020, 0.0), ("a", 2030, 2.0)]


def test_sums_do_not_depend_on_order(spark):
    """Bit-equal over partition counts, beside values over 1e9, infinities and missing values."""
    rng = random.Random(11)
    data = [(g, rng.uniform(-1, 1) * 10.0 ** rng.choice([-9, 0, 6, 11, 15])) for g in range(5) for _ in range(2_000)]
    data += [(5, None), (5, None), (6, math.inf), (6, 1.0), (7, 1.0), (7, None), (8, math.inf), (8, -math.inf), (9, math.nan)]
    seen = set()
    for n in (1, 7, 200):
        rng.shuffle(data)
        df = spark.createDataFrame(data, "g int, x double").repartition(n)
        got = df.groupBy("g").agg(N.order_free_sum("x").alias("s"), N.strict_sum("x").alias("t")).orderBy("g").collect()
        seen.add(repr([tuple(r) for r in got]))
    assert len(seen) == 1
    got = {r.g: r for r in got}
    for g in range(5):
        assert got[g].s == pytest.approx(math.fsum(x for h, x in data if h == g), rel=1e-15)
    assert got[5].s is None and got[6].s == math.inf and (got[7].s, got[7].t) == (1.0, None)
    assert math.isnan(got[8].s) and math.isnan(got[9].s)
