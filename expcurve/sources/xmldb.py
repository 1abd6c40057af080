"""Model-output XML -> the flat fact tables (S4), and back.

The stored queries address elements by their ``type`` attribute, whatever
the element's name (a sector may be a ``supplysector`` or a
``pass-through-sector``, a technology a ``stub-technology`` ...).  No list of
names is kept: the *structure* of the ``region`` elements is inferred once
from a set of files and stored beside them (``store_structure``), and every
child with a ``type`` attribute is a candidate for its level.  An element of
such a type that the stored structure does not know fails the job.

Files are cut into records at the end tags of ``region`` (``market``), so one
large file is read by many tasks, and each record is parsed against the
structure: one scan of the files per table, over all scenarios at once, with
one explode per level.  Flatten once, write Parquet (partitioned by scenario
and region), and run every query on the flat tables.

Text that is not well-formed, or not a number where one belongs, fails the
job.  An absent or empty number is missing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

OUTPUT_VALUE = "physical-output"
INPUT_VALUE = "price-paid"
CAPACITY_FACTOR = "capacity-factor"

_ENTRY = "struct<name: string, values: array<struct<year: int, value: double>>>"
_TECHNOLOGY = f"struct<name: string, period: int, capacity_factor: double, entries: array<{_ENTRY}>>"
_SUBSECTOR = f"struct<name: string, children: array<{_TECHNOLOGY}>>"
_SECTOR = f"struct<name: string, children: array<{_SUBSECTOR}>>"
MARKETS = "_name string, price array<struct<_year: int, _VALUE: double>>"


STRUCTURE = "_structure"                        # folders with a leading underscore are no data
TYPES = ("sector", "subsector", "technology", "output", "input")


def _general(kind: DataType, top: bool = False) -> DataType:
    """A structure in which every element may be repeated and every value is text."""
    if isinstance(kind, ArrayType):
        return _general(kind.elementType)
    if not isinstance(kind, StructType):
        return StringType()
    fields = [StructField(f.name, _general(f.dataType)) for f in kind.fields]
    fields = [StructField(f.name, ArrayType(f.dataType)) if isinstance(f.dataType, StructType) else f for f in fields]
    return StructType(fields)


def infer_structure(spark: SparkSession, path: str) -> StructType:
    """The structure of the ``region`` elements, by one pass over the files."""
    regions = spark.read.format("xml").option("rowTag", "region").option("mode", "FAILFAST").option("inferSchema", False)
    return _general(StructType([f for f in regions.load(path).schema.fields if f.name != "scenario"]))


def store_structure(spark: SparkSession, path: str, structure: StructType | None = None) -> StructType:
    """Keep a structure (default: the inferred one) beside the files of ``path``."""
    structure = _general(structure) if structure is not None else infer_structure(spark, path)
    (spark.createDataFrame([(structure.json(),)], "value string").coalesce(1)
          .write.mode("overwrite").text(f"{path.rstrip('/')}/{STRUCTURE}"))
    return structure


def read_structure(spark: SparkSession, path: str) -> StructType:
    """The stored structure of ``path``; inferred from the files, and not kept, where there is none."""
    try:
        stored = spark.read.text(f"{path.rstrip('/')}/{STRUCTURE}").first()
    except AnalysisException:
        return infer_structure(spark, path)
    return StructType.fromJson(json.loads(stored[0]))


def _records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One row per ``tag`` element (``xml``), with the partition columns of the path.

    A record ends at the element's end tag; what comes before its start tag is
    no part of it.  A start tag without an end gives a record that can't be parsed."""
    text = spark.read.option("lineSep", f"</{tag}>").text(path)
    body = F.regexp_replace("value", rf"<{tag}(\s[^>]*)?/>", "")
    element = F.regexp_extract(body, rf"(?s)<{tag}[\s>].*", 0)
    return (text.withColumn("xml", element).where("xml <> ''").drop("value")
            .withColumn("xml", F.concat("xml", F.lit(f"</{tag}>"))))


def _parsed(xml: Column, schema: StructType | str) -> Column:
    return F.from_xml(xml, schema, {"mode": "FAILFAST"})


def _names(kind: DataType) -> set[str]:
    if isinstance(kind, ArrayType):
        return _names(kind.elementType)
    if not isinstance(kind, StructType):
        return set()
    return set(kind.names).union(*(_names(f.dataType) for f in kind.fields))


def _field(e: Column, t: StructType, name: str, cast: str = "string") -> Column:
    """A field of an element as text or number; missing when no element of the files has it."""
    if name not in t.names:
        return F.lit(None).cast(cast)
    c, kind = e[name], t[name].dataType
    if isinstance(kind, StructType):            # text of an element that has attributes too
        c = c["_VALUE"] if "_VALUE" in kind.names else F.lit(None).cast("string")
    return c if cast == "string" else F.when(F.trim(c) != "", F.trim(c).cast(cast))


def _as_array(e: Column, kind: DataType) -> tuple[Column, DataType]:
    """A field that may hold one element or several, as an array of elements."""
    if isinstance(kind, ArrayType):
        return e, kind.elementType
    return F.when(e.isNotNull(), F.array(e)), kind


def _shaped(build: Callable[[Column, StructType], Column], kind: StructType, shape: str):
    return lambda c: build(c, kind).cast(shape)


def _typed(e: Column, t: StructType, type_name: str, build: Callable[[Column, StructType], Column],
           shape: str) -> Column:
    """All children of ``e`` with ``@type = type_name``, in one shape."""
    parts = []
    for f in t.fields:
        children, kind = _as_array(e[f.name], f.dataType)
        if isinstance(kind, StructType) and "_type" in kind.names:
            own = F.filter(children, lambda c: c["_type"] == F.lit(type_name))
            parts.append(F.transform(own, _shaped(build, kind, shape)))
    if not parts:
        return F.array().cast(f"array<{shape}>")
    return F.flatten(F.filter(F.array(*parts), lambda a: a.isNotNull()))


def _values(e: Column, t: StructType, value_tag: str) -> Column:
    """(year, value) of the value elements of an output or input."""
    shape = "array<struct<year: int, value: double>>"
    if value_tag not in t.names:
        return F.array().cast(shape)
    values, kind = _as_array(e[value_tag], t[value_tag].dataType)
    if isinstance(kind, StructType):
        return F.transform(values, lambda v: F.struct(_field(v, kind, "_vintage", "int").alias("year"),
                                                      _field(v, kind, "_VALUE", "double").alias("value")))
    number = lambda v: F.when(F.trim(v) != "", F.trim(v).cast("double"))
    return F.transform(values, lambda v: F.struct(F.lit(None).cast("int").alias("year"), number(v).alias("value")))


def _named(child_type: str, build, shape: str):
    return lambda e, t: F.struct(_field(e, t, "_name").alias("name"),
                                 _typed(e, t, child_type, build, shape).alias("children"))


def read_regions(spark: SparkSession, path: str, structure: StructType) -> DataFrame:
    """The ``region`` elements as they stand (``r``), all values as text."""
    records = _records(spark, path, "region")
    typed = F.regexp_extract_all("xml", F.lit(rf"<([^\s<>/]+)\s[^<>]*?type\s*=\s*[\"'](?:{'|'.join(TYPES)})[\"']"), F.lit(1))
    unknown = F.array_except(F.array_distinct(typed), F.array(*[F.lit(n) for n in sorted(_names(structure))]))
    message = F.concat(F.lit("elements that the stored structure does not have: "), F.concat_ws(", ", unknown))
    checked = F.when(F.size(unknown) > 0, F.raise_error(message).cast("string")).otherwise(F.col("xml"))
    return records.withColumn("r", _parsed(checked, structure)).drop("xml")


def technologies(regions: DataFrame, entry_type: str | None = None, value_tag: str = "") -> DataFrame:
    """One row per technology element of ``regions`` (scenario, r): its keys, capacity factor and the
    (name, values) of its children of ``entry_type``."""

    def entry(e: Column, t: StructType) -> Column:
        return F.struct(_field(e, t, "_name").alias("name"), _values(e, t, value_tag).alias("values"))

    def technology(e: Column, t: StructType) -> Column:
        entries = (F.array().cast(f"array<{_ENTRY}>") if entry_type is None
                   else _typed(e, t, entry_type, entry, _ENTRY))
        return F.struct(_field(e, t, "_name").alias("name"), _field(e, t, "_year", "int").alias("period"),
                        _field(e, t, CAPACITY_FACTOR, "double").alias("capacity_factor"), entries.alias("entries"))

    t = regions.schema["r"].dataType
    subsector = _named("technology", technology, _TECHNOLOGY)
    sector = _named("subsector", subsector, _SUBSECTOR)
    s = regions.select("scenario", _field(F.col("r"), t, "_name").alias("region"),
                       F.explode(_typed(F.col("r"), t, "sector", sector, _SECTOR)).alias("s"))
    ss = s.select("scenario", "region", F.col("s.name").alias("sector"), F.explode("s.children").alias("ss"))
    tech = ss.select("scenario", "region", "sector", F.col("ss.name").alias("subsector"), F.explode("ss.children").alias("t"))
    return tech.select("scenario", "region", "sector", "subsector",
                       F.col("t.name").alias("technology"), F.col("t.period").alias("period"),
                       F.col("t.capacity_factor").alias("capacity_factor"), F.col("t.entries").alias("entries"))


_KEYS = ("scenario", "region", "sector", "subsector", "technology", "period")


def _values_table(tech: DataFrame, name_col: str) -> DataFrame:
    e = tech.select(*_KEYS, F.explode("entries").alias("e"))
    v = e.select(*_KEYS, F.col("e.name").alias(name_col), F.explode("e.values").alias("v"))
    return v.select(*_KEYS, name_col, F.col("v.year").alias("year"), F.col("v.value").alias("value"))


def flatten_model_output(spark: SparkSession, path: str, scenario: str | None = None,
                         structure: StructType | None = None) -> dict[str, DataFrame]:
    """``outputs``, ``input_costs``, ``capacity_factors`` and ``market_prices``
    of one scenario's XML output, or, without ``scenario``, of all scenarios
    below ``path`` (folders ``scenario=...``)."""
    name = F.col("scenario").cast("string") if scenario is None else F.lit(scenario)
    regions = read_regions(spark, path, structure or read_structure(spark, path)).withColumn("scenario", name)
    outputs = _values_table(technologies(regions, "output", OUTPUT_VALUE), "output")
    costs = _values_table(technologies(regions, "input", INPUT_VALUE), "input")
    cf = technologies(regions).where("capacity_factor is not null").select(*_KEYS, F.col("capacity_factor").alias("value"))
    markets = _records(spark, path, "market").select(name.alias("scenario"), _parsed(F.col("xml"), MARKETS).alias("m"))
    prices = (markets.select("scenario", F.col("m._name").alias("market"), F.explode("m.price").alias("p"))
              .select("scenario", "market", F.col("p._year").alias("year"), F.col("p._VALUE").alias("value")))
    return {"outputs": outputs, "input_costs": costs, "capacity_factors": cf,
            "market_prices": prices}


def write_model_output(tables: dict[str, DataFrame], root: str) -> None:
    """The flat tables as model-output XML, one folder per scenario.

    Each ``region`` element holds one entry of one technology, so no row
    grows with the size of a region; flattening joins them again by key.
    """
    tech = F.struct(F.lit("technology").alias("_type"), F.col("technology").alias("_name"),
                    F.col("period").alias("_year"), F.col("capacity_factor").alias(CAPACITY_FACTOR),
                    F.col("output-primary"), F.col("input-cost"))
    sub = F.struct(F.lit("subsector").alias("_type"), F.col("subsector").alias("_name"), tech.alias("technology"))
    sec = F.struct(F.lit("sector").alias("_type"), F.col("sector").alias("_name"), sub.alias("subsector"))
    rooftop = F.col("sector") == F.lit("elect_td_bld")
    rows = (_entries(tables["outputs"], "output", "output-primary", OUTPUT_VALUE)
            .unionByName(_entries(tables["input_costs"], "input", "input-cost", INPUT_VALUE), allowMissingColumns=True)
            .unionByName(tables["capacity_factors"].withColumnRenamed("value", "capacity_factor"),
                         allowMissingColumns=True))
    regions = rows.select("scenario", F.col("region").alias("_name"),
                          F.when(~F.coalesce(rooftop, F.lit(False)), sec).alias("supplysector"),
                          F.when(rooftop, sec).alias("pass-through-sector"))
    prices = (tables["market_prices"].groupBy("scenario", F.col("market").alias("_name"))
              .agg(F.collect_list(F.struct(F.col("year").alias("_year"), F.col("value").alias("_VALUE"))).alias("price")))
    for tag, df, mode in (("region", regions, "overwrite"), ("market", prices, "append")):
        (df.write.format("xml").option("rowTag", tag).option("rootTag", "world").mode(mode)
           .option("partitionOverwriteMode", "static").partitionBy("scenario").save(root))
    store_structure(regions.sparkSession, root, StructType([f for f in regions.schema.fields if f.name != "scenario"]))


def _entries(df: DataFrame, name_col: str, tag: str, value_tag: str) -> DataFrame:
    values = F.collect_list(F.struct(F.col("year").alias("_vintage"), F.col("value").alias("_VALUE")))
    g = df.groupBy(*_KEYS, name_col).agg(values.alias("v"))
    return g.select(*_KEYS, F.struct(F.lit(name_col).alias("_type"), F.col(name_col).alias("_name"),
                                     F.col("v").alias(value_tag)).alias(tag))


def write_flat_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Persist the flat tables; adding a scenario again replaces it only."""
    for name, df in tables.items():
        parts = ["scenario", "region"] if "region" in df.columns else ["scenario"]
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(*parts).parquet(f"{root.rstrip('/')}/{name}"))
