"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expcurve.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-run.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application."""
    import expcurve

    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(expcurve.__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="expcurve-"), "expcurve_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def give_back() -> None:
    """Return freed memory to the system: workers are used again and again, and what one stage freed would
    else count beside what the next one takes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass                                  # another C library


#: Texts are long: a batch of 10,000 of them would take tens of MB several times over in a JVM and its workers.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers and batches of BATCH_BYTES at most (a setting
    of the session, which is made smaller if need be)."""
    ship_package(df.sparkSession)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = df.sparkSession.conf.get(name).rstrip("bB")
    if not limit.isdigit() or int(limit) > BATCH_BYTES:
        df.sparkSession.conf.set(name, f"{BATCH_BYTES}b")

    def trimmed(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(trimmed, schema)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text"):
    """Hash of a text; a null text counts as empty."""
    return F.xxhash64(text_or_empty(column))


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """Hash of a row's id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), text_key(text_col))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


BITMAP_BITS = 1 << 26
_BUCKET_BITS = 1 << 15                    # of Spark's bitmap functions


def split_by_keys(df: DataFrame, key, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that surely have none of the keys, all others), with no shuffle of ``df``.

    ``key`` is a hash over columns of ``df``, ``keys`` has one column of such
    hashes.  A bitmap of their last bits, 8 MB whatever their number, is
    broadcast; the more keys, the more rows without one are among the others,
    so those are still to be joined with what is known of the keys.
    """
    slot = F.pmod(F.col(keys.columns[0]), F.lit(BITMAP_BITS))
    bits = stored(keys.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / _BUCKET_BITS).alias("bucket"))
                  .agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(_BUCKET_BITS))).alias("bits")), "bitmap")
    slot, bucket, block = (fresh(df, n) for n in ("_slot", "_bucket", "_bits"))
    bits = bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(block))
    marked = df.withColumn(slot, F.pmod(key, F.lit(BITMAP_BITS)))
    marked = marked.join(F.broadcast(bits), F.floor(F.col(slot) / _BUCKET_BITS) == F.col(bucket), "left")
    place = F.pmod(F.col(slot), F.lit(_BUCKET_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(block), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce((byte / F.pow(F.lit(2), place % 8)).cast("int") % 2 == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return marked.where(~hit).select(*columns), marked.where(hit).select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(column):
    """CRC-32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def label_sample(labels: DataFrame, label_col: str, rows: int, balanced: bool) -> tuple[DataFrame, dict[int, int]]:
    """((_id, _y) of about ``rows`` labelled ids, number of ids with each label).

    Ids are taken by their hash, so the sample is the same in every run and each
    id counts once however often it is repeated.  With ``balanced`` either label
    gives up to half of the rows; otherwise all ids have the same chance.
    """
    ids = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
           .where("_id is not null and _y in (0, 1)").distinct())
    counts = {r["_y"]: r["count"] for r in ids.groupBy("_y").count().collect()}
    total = sum(counts.values())
    share = {y: min(1.0, (rows / 2 / n) if balanced else (rows / total)) for y, n in counts.items()}
    cut = F.when(F.col("_y") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)) * (1 << 20)
    return ids.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < cut), counts
