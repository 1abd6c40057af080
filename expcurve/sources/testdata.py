"""Hosting the domain on the driver's TPC-H-like test tables.

The energy-model output the operators expect (generation, input costs,
capacity factors, market prices) is derived from the parquet tables with
DataFrame operations, so every query's work grows with the tables.

Mapping (the "test domain"):

* scenario   <- ``l_returnflag`` (A, N, R -> the three scenarios); market
  prices use ``o_orderstatus`` (F, O, P) the same way
* region     <- ``r_name`` via orders -> customer -> nation -> region
* period     <- year of ``o_orderdate`` (the vintage);
  year       <- year of ``l_shipdate`` (the year the value applies to)
* technology <- ``p_name`` = "<adjective> <noun>": the noun is the
  technology family, the adjective its role (ROLE_NAMES below), which fixes the
  sector / subsector / technology names in the model's naming grammar
* generation <- sum(l_quantity) * 1e-6 (EJ); input costs <- max of
  ``l_extendedprice`` / 1e4 per input (``l_linestatus``: O = capital);
  capacity factor <- (min(p_size) mod 10) / 10 (so some are zero);
  carbon price <- max(o_totalprice) / 1000 per market and year
* parameter tables (maps, learning rates, t0, FCR) are derived from the
  distinct technology names by rules, so they are data too.

The same definitions are written once more in SQL for the DuckDB oracle
(``oracle_queries.py``).
"""

from __future__ import annotations

import hashlib
import threading
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import small
from ..session import ensure_checkpoint_dir

# ---------------------------------------------------------------------------
# FIXED VALUES of the test domain
# ---------------------------------------------------------------------------
SCENARIO_BY_RETURNFLAG = (("A", "Reference_exogenous"), ("N", "NZ_exogenous"),
                          ("R", "Reference_NZ_endogenous"))
SCENARIO_BY_ORDERSTATUS = (("F", "Reference_exogenous"), ("O", "NZ_exogenous"),
                           ("P", "Reference_NZ_endogenous"))
CAPITAL_LINESTATUS = "O"
OTHER_INPUT = "OM-fixed"
OUTPUT_NAME = "electricity"
GENERATION_SCALE = 1e-6     # l_quantity -> EJ
COST_SCALE = 1e4            # l_extendedprice / COST_SCALE -> 1975$/GJ
PRICE_SCALE = 1e3           # o_totalprice / PRICE_SCALE -> 1990$/tC
CO2_SEGMENTS = ("BUILDING", "MACHINERY")
CO2_SUFFIX = "CO2"

# adjective -> role; names are built from the noun n:
#   new   plain technology        electricity / n / n
#   large storage twin            electricity / n / n_storage
#   old   non-CCS thermal twin    electricity / n / n (conv)
#   hot   CCS twin (pass-through) electricity / n / n (conv CCS)
#   cold  cooling-level child     elec_n (conv CCS) / n (conv CCS) / n (conv CCS) (recirculating)
#   small building level          elect_td_bld / rooftop_pv / rooftop_n
#   blue  first-of-a-kind         electricity / n / n_offshore
#   red   water sector (excluded) elec_water_td / water_td / n (water)

# parameters of the test domain's analyses (the model's own are in constants)
BASE_YEAR = 1996
ADDER_FROM_YEAR = 1997
PERIOD_STEP = 1
CHART_YEARS = (1996, 2001)
CO2_MARKET = "AMERICACO2"
STORAGE_TECH_REGEX = "^gear(_storage)?$"
CCS_INCLUDE_REGEX = "\\(conv"
CCS_EXCLUDE_REGEX = "recirculating"
CAPITAL_COST_INCLUDE_REGEX = "gear|bolt|rooftop|CCS"
CAPITAL_COST_EXCLUDE_REGEX = "water|offshore"
CAPITAL_COST_LEVELS = ("gear", "bolt", "gear_storage", "bolt_storage", "rooftop_gear",
                       "rooftop_bolt", "gear (conv CCS)", "bolt (conv CCS)")
CAPACITY_INCLUDE_REGEX = "gear|bolt|ring|rooftop|CCS"
CAPACITY_EXCLUDE_REGEX = "water|conv\\)"
CAPACITY_RULES = (("gear_storage", "gear_storage"), ("gear", "gear"),
                  ("bolt", "bolt"), ("ring \\(conv CCS", "ring CCS"), ("CCS", "other CCS"))
CAPACITY_LEVELS = ("gear", "gear_storage", "bolt", "ring", "ring CCS", "other CCS",
                   "rooftop_ring")
FUEL_RULES = (("anvil", "anvil"), ("bolt", "bolt"), ("gear", "gear"), ("gizmo", "gizmo"),
              ("plate", "plate"), ("ring", "ring"), ("rod", "rod"), ("widget", "widget"))
FUEL_LEVELS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod")


def stored(fn):
    """A table of the domain that is written once per application (Parquet
    under the shared checkpoint folder) and read back by every query, as
    the flattened model output is in production."""
    @cached_property
    def prop(self):
        return self.store(fn.__name__, lambda: fn(self))
    prop.__doc__ = fn.__doc__
    return prop


# columns of the driver tables this adapter reads (explicit: no inference job)
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def _lookup(c: Column, pairs) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(pairs):
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


# role -> (sector, subsector, technology) name templates; "{n}" is the noun
ROLE_NAMES = {
    "new": ("electricity", "{n}", "{n}"),
    "large": ("electricity", "{n}", "{n}_storage"),
    "old": ("electricity", "{n}", "{n} (conv)"),
    "hot": ("electricity", "{n}", "{n} (conv CCS)"),
    "cold": ("elec_{n} (conv CCS)", "{n} (conv CCS)", "{n} (conv CCS) (recirculating)"),
    "small": ("elect_td_bld", "rooftop_pv", "rooftop_{n}"),
    "blue": ("electricity", "{n}", "{n}_offshore"),
    "red": ("elec_water_td", "water_td", "{n} (water)"),
}


def _template(adj: Column, noun: Column, level: int) -> Column:
    """prefix[adj] + (noun if the template has one) + suffix[adj]; null for
    an unknown role.  Three literal-map lookups instead of a CASE per role."""
    pre, has, suf = [], [], []
    for role, names in ROLE_NAMES.items():
        t = names[level]
        a, _, b = t.partition("{n}")
        pre += [F.lit(role), F.lit(a)]
        has += [F.lit(role), F.lit("{n}" in t)]
        suf += [F.lit(role), F.lit(b)]
    mid = F.when(F.try_element_at(F.create_map(*has), adj), noun).otherwise(F.lit(""))
    return F.concat(F.try_element_at(F.create_map(*pre), adj), mid,
                    F.try_element_at(F.create_map(*suf), adj))


def technology_names(adj: Column, noun: Column) -> tuple[Column, Column, Column]:
    """(sector, subsector, technology) of a role + noun."""
    return tuple(_template(adj, noun, i) for i in range(3))


@dataclass
class TestDomain:
    """Fact and parameter tables of the test domain, as lazy DataFrames."""

    spark: SparkSession
    sf_dir: str
    materialize: bool = True
    _cache: dict = field(default_factory=dict)

    @cached_property
    def store_dir(self) -> str:
        root = ensure_checkpoint_dir(self.spark).rstrip("/")
        key = hashlib.sha1(self.sf_dir.encode()).hexdigest()[:12]
        app = self.spark.sparkContext.applicationId
        return f"{root}/expcurve-tables/{app}/{key}"

    _locks: dict = field(default_factory=lambda: defaultdict(threading.Lock))
    _locks_guard: threading.Lock = field(default_factory=threading.Lock)

    def store(self, name: str, build) -> DataFrame:
        """Write ``build()`` once as Parquet and return the stored table
        (callers in other threads wait for the first writer)."""
        if not self.materialize:
            return build()
        with self._locks_guard:
            lock = self._locks[name]
        with lock:
            if name not in self._cache:
                path = f"{self.store_dir}/{name}"
                build().write.mode("overwrite").parquet(path)
                self._cache[name] = self.spark.read.parquet(path)
        return self._cache[name]

    # tables in dependency order: the tables of one wave only read tables of
    # earlier waves, so each wave's (small) jobs can run concurrently
    WAVES = (("base",),
             ("outputs", "capacity_factors", "input_costs", "market_prices", "cooling_tech_map",
              "deployment_map"),
             ("learning_map", "label_rewrites", "learning_rates", "t0_cost_deployment"),
             ("tech_FCR",))

    def prepare(self, threads: int = 4) -> None:
        """Write every stored table now, independent ones concurrently."""
        for wave in self.WAVES:
            if len(wave) == 1 or threads <= 1:
                for name in wave:
                    getattr(self, name)
                continue
            with ThreadPoolExecutor(max_workers=min(threads, len(wave))) as pool:
                list(pool.map(lambda n: getattr(self, n), wave))

    def model_periods(self, from_year: int, shift: int = 0) -> Column:
        """Distinct vintage periods of the run from ``from_year`` on, ``shift``
        years later, as a scalar subquery over the stored outputs."""
        from ..plans.update import model_periods
        return model_periods(self.outputs, from_year, shift)

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in DRIVER_SCHEMAS:
            reader = reader.schema(DRIVER_SCHEMAS[name])
        return reader.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- dimensions -------------------------------------------------------
    @cached_property
    def nation_region(self) -> DataFrame:
        # 25 x 5 rows by the table's definition: a proven-small broadcast
        n = self.table("nation").select("n_nationkey", "n_regionkey")
        r = self.table("region").select(F.col("r_regionkey").alias("n_regionkey"),
                                        F.col("r_name").alias("region"))
        return F.broadcast(n.join(F.broadcast(r), "n_regionkey").select("n_nationkey", "region"))

    @cached_property
    def order_dim(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        c = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        oc = o.join(c, "o_custkey").join(
            self.nation_region, F.col("c_nationkey") == F.col("n_nationkey"))
        return oc.select("o_orderkey", "region",
                         F.year("o_orderdate").cast("int").alias("period"))

    @cached_property
    def part_dim(self) -> DataFrame:
        p = self.table("part").select("p_partkey", "p_name", "p_size")
        adj = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
        noun = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
        sector, subsector, technology = technology_names(adj, noun)
        return p.select("p_partkey", "p_size", sector.alias("sector"),
                        subsector.alias("subsector"), technology.alias("technology"))

    @cached_property
    def names(self) -> DataFrame:
        """Distinct (adjective, noun) pairs: one row per technology name."""
        p = self.table("part").select("p_name").distinct()
        return p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("adj"),
                        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"))

    # --- facts ------------------------------------------------------------
    @stored
    def base(self) -> DataFrame:
        """Lineitems aggregated to one row per technology, vintage, year and
        line status; the three model tables are all derived from it, so the
        scan and its joins are planned once and the exchange is reused."""
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity",
                                           "l_extendedprice", "l_returnflag", "l_linestatus",
                                           "l_shipdate")
        # lineitem is the fact table: it is never a broadcast side (its
        # compressed-file estimate can fall under the auto-broadcast bound);
        # the order join is a shuffle join on the order key
        j = (li.hint("merge").join(self.order_dim, F.col("l_orderkey") == F.col("o_orderkey"))
               .join(small(self.part_dim), F.col("l_partkey") == F.col("p_partkey")))
        scenario = _lookup(F.col("l_returnflag"), SCENARIO_BY_RETURNFLAG)
        return (j.groupBy(scenario.alias("scenario"), "region", "sector", "subsector",
                          "technology", "period",
                          F.year("l_shipdate").cast("int").alias("year"), "l_linestatus")
                 .agg(F.sum("l_quantity").alias("qty"),
                      F.max("l_extendedprice").alias("price"),
                      F.min("p_size").alias("min_size")))

    @stored
    def outputs(self) -> DataFrame:
        keys = ["scenario", "region", "sector", "subsector", "technology", "period", "year"]
        g = self.base.groupBy(*keys).agg((F.sum("qty") * F.lit(GENERATION_SCALE)).alias("value"))
        return g.select(*keys[:6], F.lit(OUTPUT_NAME).alias("output"), "year", "value") \
                .select("scenario", "region", "sector", "subsector", "technology", "period",
                        "output", "year", "value")

    @stored
    def capacity_factors(self) -> DataFrame:
        keys = ["scenario", "region", "sector", "subsector", "technology", "period"]
        return self.base.groupBy(*keys).agg(
            ((F.min("min_size") % 10) / F.lit(10.0)).alias("value"))

    @stored
    def input_costs(self) -> DataFrame:
        inp = F.when(F.col("l_linestatus") == F.lit(CAPITAL_LINESTATUS), F.lit("capital")) \
               .otherwise(F.lit(OTHER_INPUT))
        b = self.base.select("scenario", "region", "sector", "subsector", "technology",
                             "period", inp.alias("input"), "year",
                             (F.col("price") / F.lit(COST_SCALE)).alias("value"))
        return b

    @stored
    def market_prices(self) -> DataFrame:
        o = self.table("orders").select("o_custkey", "o_orderstatus", "o_totalprice",
                                        "o_orderdate")
        c = self.table("customer").select(F.col("c_custkey").alias("o_custkey"),
                                          "c_nationkey", "c_mktsegment")
        j = o.join(c, "o_custkey").join(
            self.nation_region, F.col("c_nationkey") == F.col("n_nationkey"))
        seg = F.when(F.col("c_mktsegment").isin(*CO2_SEGMENTS), F.lit(CO2_SUFFIX)) \
               .otherwise(F.col("c_mktsegment"))
        market = F.concat(F.regexp_replace("region", " ", ""), seg)
        scenario = _lookup(F.col("o_orderstatus"), SCENARIO_BY_ORDERSTATUS)
        return (j.groupBy(scenario.alias("scenario"), market.alias("market"),
                          F.year("o_orderdate").cast("int").alias("year"))
                 .agg((F.max("o_totalprice") / F.lit(PRICE_SCALE)).alias("value")))

    # --- parameter tables (rules over the distinct names) ----------------------
    @stored
    def cooling_tech_map(self) -> DataFrame:
        n = F.col("noun")
        ccs = F.concat(n, F.lit(" (conv CCS)"))
        return (self.names.where(F.col("adj") == "cold")
                .select(F.lit("electricity").alias("sector_passthru"),
                        n.alias("subsector_passthru"), ccs.alias("technology_passthru"),
                        F.concat(F.lit("elec_"), ccs).alias("sector"), ccs.alias("subsector"),
                        F.concat(ccs, F.lit(" (recirculating)")).alias("technology")))

    @stored
    def deployment_map(self) -> DataFrame:
        adj, n = F.col("adj"), F.col("noun")
        sector, subsector, technology = technology_names(adj, n)
        module = F.concat(n, F.lit(" module"))
        bos = F.concat(n, F.lit(" BOS"))
        entries = F.when(adj == "new", F.array(
                    F.struct(module.alias("c"), F.lit(1).alias("m")),
                    F.struct(bos.alias("c"), F.lit(1).alias("m")))) \
            .when(adj == "large", F.array(
                    F.struct(module.alias("c"), F.lit(1).alias("m")),
                    F.struct(bos.alias("c"), F.lit(1).alias("m")),
                    F.struct(F.lit("grid_storage").alias("c"), F.lit(2).alias("m")))) \
            .when(adj == "old", F.array(F.struct(module.alias("c"), F.lit(1).alias("m")))) \
            .when(adj == "hot", F.array(
                    F.struct(F.concat(F.lit("CCS "), n).alias("c"), F.lit(1).alias("m")),
                    F.struct(F.lit("CCS capture").alias("c"), F.lit(1).alias("m")))) \
            .when(adj == "small", F.array(
                    F.struct(module.alias("c"), F.lit(1).alias("m")),
                    F.struct(F.lit("rooftop BOS").alias("c"), F.lit(1).alias("m")))) \
            .when(adj == "blue", F.array(
                    F.struct(F.concat(n, F.lit("_offshore")).alias("c"), F.lit(1).alias("m"))))
        return (self.names.select(sector.alias("sector"), subsector.alias("subsector"),
                                  technology.alias("technology"), adj.alias("role"),
                                  F.explode(entries).alias("e"))
                .select("sector", "subsector", "technology", "role",
                        F.col("e.c").alias("learning_component"),
                        F.col("e.m").cast("int").alias("multiplier")))

    @stored
    def learning_map(self) -> DataFrame:
        # thermal (conv) twins learn nothing: their deployment counts, their cost stays
        return (self.deployment_map.where(F.col("role") != "old")
                .select("sector", "subsector", "technology", "learning_component"))

    def deployment_map_plain(self) -> DataFrame:
        return self.deployment_map.drop("role")

    @cached_property
    def region_components(self) -> DataFrame:
        """(region, component) pairs that occur in the generation facts."""
        techs = self.outputs.select("region", "sector", "subsector", "technology").distinct()
        dm = self.deployment_map.select("sector", "subsector", "technology",
                                        "learning_component").distinct()
        return techs.join(small(dm), ["sector", "subsector", "technology"]) \
                    .select("region", "learning_component").distinct()

    @stored
    def learning_rates(self) -> DataFrame:
        c = F.col("learning_component")
        return self.region_components.select(
            "region", c, (F.lit(0.05) + F.lit(0.01) * F.length(c)).alias("learning_rate"))

    @stored
    def t0_cost_deployment(self) -> DataFrame:
        c = F.col("learning_component")
        first_of_a_kind = c.startswith("CCS ") | c.endswith("_offshore")
        return self.region_components.select(
            "region", c, (F.lit(100.0) * F.length(c)).alias("t0_cost"),
            F.when(first_of_a_kind, F.lit(1.0))
             .otherwise(F.lit(1000.0) * F.length(c)).alias("t0_deployment"))

    @stored
    def tech_FCR(self) -> DataFrame:
        techs = self.outputs.select("region", "sector", "subsector", "technology").distinct()
        lm = self.learning_map.select("sector", "subsector", "technology").distinct()
        fcr = F.when(F.col("sector") == "elect_td_bld", F.lit(0.1)).otherwise(F.lit(0.13))
        return techs.join(small(lm), ["sector", "subsector", "technology"], "left_semi") \
                    .select("region", "sector", "subsector", "technology", fcr.alias("FCR"))

    @stored
    def label_rewrites(self) -> DataFrame:
        cm = self.cooling_tech_map
        sec = cm.select(F.lit("sector").alias("level"), F.col("sector").alias("from"),
                        F.col("sector_passthru").alias("to"))
        sub = cm.select(F.lit("subsector").alias("level"), F.col("subsector").alias("from"),
                        F.col("subsector_passthru").alias("to"))
        return sec.unionByName(sub).distinct()


_DOMAINS: dict[tuple[str, str], TestDomain] = {}


_DOMAINS_LOCK = threading.Lock()


def domain(spark: SparkSession, sf_dir: str, materialize: bool = True) -> TestDomain:
    """The session's test domain for ``sf_dir`` (tables stored once)."""
    key = (spark.sparkContext.applicationId, sf_dir, materialize)
    with _DOMAINS_LOCK:
        if key not in _DOMAINS:
            _DOMAINS[key] = TestDomain(spark, sf_dir, materialize)
        return _DOMAINS[key]
