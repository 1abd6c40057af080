"""Missing-value aware building blocks.

The analysis being reproduced was written against data-frame semantics
where a missing value poisons sums, regex tests on a missing value are
false, pivots fail on duplicate keys and ``complete`` fills the year grid.
Spark's built-ins differ on each point; these helpers give the original
meaning while staying JVM-side (no Python UDF anywhere).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# sums
# ---------------------------------------------------------------------------
def divide(n, d) -> Column:
    """Floating-point division as the original computes it: a zero divisor
    gives an infinity with the dividend's sign, 0/0 gives NaN, and a missing
    value on either side stays missing."""
    over_zero = (F.when(F.isnan(n), F.lit(float("nan")))
                 .when(n > F.lit(0.0), F.lit(float("inf")))
                 .when(n < F.lit(0.0), F.lit(float("-inf")))
                 .when(n.isNotNull(), F.lit(float("nan"))))
    return F.when(d == F.lit(0.0), over_zero).otherwise(F.try_divide(n, d))


def order_free_sum(c: ColumnOrName) -> Column:
    """Sum of doubles that is the same to the last bit in whatever order and
    partitions the rows come; missing values are ignored, all missing is missing.

    Values are added as decimals: below 1e9 with 18 places (1e-18 EJ is one
    joule), below 1e18 with 9 places, which is finer than doubles of that size.
    A group can have 1e11 rows.  Larger values, infinities and NaN are added as
    doubles."""
    c = _c(c).cast("double")
    size = F.abs(c)
    fine = F.sum(F.when(size < 1e9, c.try_cast("decimal(38,18)")))
    large = F.sum(F.when((size >= 1e9) & (size < 1e18), c.try_cast("decimal(38,9)")))
    rest = F.sum(F.when(size >= 1e18, c))
    parts = [F.coalesce(x.cast("double"), F.lit(0.0)) for x in (fine, large, rest)]
    return F.when(F.count(c) > 0, parts[0] + parts[1] + parts[2])


def strict_sum(c: ColumnOrName) -> Column:
    """``sum(x)``: one missing value makes the group's sum missing."""
    c = _c(c)
    return F.when(F.count(c) == F.count(F.lit(1)), order_free_sum(c))


def sum_na_rm(c: ColumnOrName) -> Column:
    """``sum(x, na.rm = TRUE)``: missing values ignored, all missing -> 0."""
    return F.coalesce(order_free_sum(c), F.lit(0.0))


def strict_cumsum(c: ColumnOrName, partition_by: Sequence[str], order_by: Sequence[str]) -> Column:
    """``cumsum(x)`` in a group ordered by ``order_by``: missing from the
    first missing value on (row frame, unbounded preceding to current)."""
    c = _c(c)
    w = (Window.partitionBy(*partition_by).orderBy(*order_by)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(F.count(c).over(w) == F.count(F.lit(1)).over(w), F.sum(c).over(w))


# ---------------------------------------------------------------------------
# regex tests (a missing string never matches)
# ---------------------------------------------------------------------------
def grepl(c: ColumnOrName, pattern: str) -> Column:
    return F.coalesce(_c(c).rlike(pattern), F.lit(False))


def not_grepl(c: ColumnOrName, pattern: str) -> Column:
    return ~grepl(c, pattern)


# ---------------------------------------------------------------------------
# text splitting and parsing
# ---------------------------------------------------------------------------
def separate(df: DataFrame, col: str, into: Sequence[str], sep: str) -> DataFrame:
    """Split ``col`` on the regex ``sep`` into the columns ``into`` (which
    take the place of ``col``); missing pieces are null, extra pieces are
    dropped."""
    parts = F.split(F.col(col), sep)
    new = {name: F.try_element_at(parts, F.lit(i + 1)) for i, name in enumerate(into)}
    cols: list[Column] = []
    for name in df.columns:
        if name == col:
            cols.extend(new[n].alias(n) for n in into)
        elif name not in new:
            cols.append(F.col(name))
    return df.select(*cols)


def to_number(c: ColumnOrName) -> Column:
    """``as.numeric``: text that is not a number becomes null (no error)."""
    return F.expr(f"try_cast(trim({_sql_name(c)}) AS DOUBLE)") if isinstance(c, str) \
        else _c(c).try_cast("double")


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ---------------------------------------------------------------------------
# ordered categories
# ---------------------------------------------------------------------------
def ordinal(c: ColumnOrName, levels: Sequence[str]) -> Column:
    """1-based position of the value among ``levels``; null outside them."""
    arr = F.array(*[F.lit(v) for v in levels])
    return F.nullif(F.array_position(arr, _c(c)), F.lit(0)).cast("int")


def categorise(c: ColumnOrName, rules: Sequence[tuple[str, str]],
               default: ColumnOrName | None = None) -> Column:
    """``case_when(grepl(p1, x) ~ l1, ..., TRUE ~ default)``; first match wins."""
    c = _c(c)
    out = _c(default) if default is not None else c
    for pattern, label in reversed(list(rules)):
        out = F.when(grepl(c, pattern), F.lit(label)).otherwise(out)
    return out


def literal_lookup(c: ColumnOrName, mapping: Iterable[tuple[str, str]]) -> Column:
    """Value of ``c`` in a small literal mapping, null when absent; compiled
    into the plan as a map literal, so no join is needed."""
    pairs = list(mapping)
    if not pairs:
        return F.lit(None).cast("string")
    m = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return F.try_element_at(m, _c(c))


# ---------------------------------------------------------------------------
# reshaping
# ---------------------------------------------------------------------------
def pivot_checked(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
                  values: Sequence[str], message: str | None = None) -> DataFrame:
    """``pivot_wider`` with a literal list of new columns.  A duplicated
    (ids, name) pair fails the job instead of being resolved silently."""
    msg = message or f"pivot: duplicate rows for a key of {names_from}"
    aggs = []
    for v in values:
        hit = F.col(names_from) == F.lit(v)
        n = F.count(F.when(hit, F.lit(1)))
        aggs.append(F.when(n > 1, F.raise_error(F.lit(msg)).cast("double"))
                    .otherwise(F.max(F.when(hit, F.col(values_from)))).alias(v))
    return df.groupBy(*ids).agg(*aggs)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            names_to: str = "name", values_to: str = "value") -> DataFrame:
    """``pivot_longer``: missing values are kept as rows."""
    return df.unpivot(list(ids), list(values), names_to, values_to)


def distinct_list(df: DataFrame, col: ColumnOrName) -> Column:
    """The sorted distinct values of a column as an array: an uncorrelated
    scalar subquery of the plan that uses it, so nothing runs while the plan
    is built and nothing passes through the driver program."""
    return df.agg(F.sort_array(F.collect_set(_c(col)))).scalar()


def year_array(years: Sequence[int] | Column) -> Column:
    """Years as an array column, from a list or a ``distinct_list``."""
    return years if isinstance(years, Column) else F.array(*[F.lit(int(y)) for y in years])


def complete_years(df: DataFrame, keys: Sequence[str], value: str, years: Sequence[int] | Column | None = None,
                   year_col: str = "year", fill: float = 0.0) -> DataFrame:
    """Every key combination present gets one row per year of ``years``
    (default: the years present in ``df``), missing values as ``fill``.

    Built as one aggregation: the (year -> value) pairs of a key are gathered
    into a map -- at most one entry per model year -- and the year list is
    exploded against it, so no join and no cross product is planned."""
    years_arr = distinct_list(df, year_col) if years is None else year_array(years)
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col(year_col), F.col(value))))
    grouped = df.groupBy(*keys).agg(pairs.alias("_by_year"))
    # a key's own years are kept even when the given list misses them:
    # completing only ever adds rows
    grid = F.sort_array(F.array_union(years_arr, F.map_keys("_by_year")))
    out = grouped.select(*keys, F.explode(grid).alias(year_col), "_by_year")
    filled = F.coalesce(F.try_element_at(F.col("_by_year"), F.col(year_col)), F.lit(fill))
    return out.select(*keys, year_col, filled.cast("double").alias(value))
