"""The per-period cost update as a Structured Streaming job.

The model solves one period at a time and the update must run after each:
generation output of the solved period arrives as new files; every
micro-batch (1) adds them to the vintage history, (2) runs the cost update
(D13) over the whole history for every known period from the earliest one that
just arrived (rows may come late), and (3) writes the merged next-period costs back (D14 + K3).

Replays are harmless: history is written per batch id and the cost table by
(scenario, period) partition, both with dynamic overwrite, so a batch that
is re-run after a failure rewrites the same partitions.  Progress is kept
in the stream's checkpoint location.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from .. import constants as K
from ..plans import update as U
from ..schemas import OUTPUTS
from ..sinks import write_cost_updates


@dataclass
class UpdateJob:
    """Static inputs of the update (parameter tables and readers of the
    model's cost and capacity-factor tables, read fresh per batch)."""
    params: dict
    nonlearning: DataFrame
    cal_adders: DataFrame
    read_input_costs: Callable[[], DataFrame]
    read_capacity_factors: Callable[[], DataFrame]
    history_path: str
    costs_path: str
    base_year: int = K.BASE_YEAR
    step: int = K.PERIOD_STEP

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
              .parquet(self.history_path))
        stored = spark.read.schema(StructType([*batch.schema.fields, StructField("batch_id", LongType())]))
        history = stored.parquet(self.history_path)
        # each period's cost sums all earlier vintages: late rows change every period from theirs on
        first = history.where((F.col("batch_id") == batch_id) & (F.col("period") >= self.base_year)
                              ).agg(F.min("period")).first()[0]
        if first is None:
            return
        current, after = (U.model_periods(history, first, shift) for shift in (0, self.step))
        history = history.drop("batch_id")
        gen_all, costs_all, cf_all = U.update_inputs(history, self.read_input_costs(),
                                                     self.read_capacity_factors(),
                                                     self.params["cooling_tech_map"])
        adj = U.period_cost_update(gen_all, cf_all, self.params, self.nonlearning,
                                   self.cal_adders, self.base_year, self.step,
                                   update_years=current)
        merged = U.merge_costs(costs_all, adj, after)
        write_cost_updates(merged, self.costs_path)


def start_period_updates(spark: SparkSession, outputs_dir: str, job: UpdateJob,
                         checkpoint_location: str, available_now: bool = True,
                         processing_time: str | None = None) -> StreamingQuery:
    """Stream the model's generation output files through ``job``."""
    stream = spark.readStream.schema(OUTPUTS).parquet(outputs_dir)
    w = stream.writeStream.foreachBatch(job.run_batch).option("checkpointLocation",
                                                              checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(
        processingTime=processing_time or "1 minute")
    return w.start()
