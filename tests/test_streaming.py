"""The per-period update as a stream equals the batch update."""

from pyspark.sql import functions as F

from expcurve.plans import calibration as CAL
from expcurve.plans import update as U
from expcurve.sources import queries as Q
from expcurve.sinks import read_cost_updates
from expcurve.streaming.periods import UpdateJob, start_period_updates
from tests.conftest import rows
from tests.test_pipeline import REF, build_facts


def test_stream_of_periods_matches_batch(spark, params, tmp_path):
    facts = build_facts(spark)
    q1 = Q.new_vintage_generation(facts["outputs"], region=None)
    q3 = Q.capacity_factor_query(facts["capacity_factors"], region=None)
    q4 = Q.input_cost_query(facts["input_costs"], region=None)
    cal = CAL.run_calibration(q1, q3, q4, params)
    nl, ca = CAL.for_scenario(cal.nonlearning, REF), CAL.for_scenario(cal.adders, REF)
    out_dir, ckpt = str(tmp_path / "model_out"), str(tmp_path / "ckpt")
    job = UpdateJob(params, nl, ca, lambda: facts["input_costs"], lambda: facts["capacity_factors"],
                    str(tmp_path / "history"), str(tmp_path / "costs"))
    outputs = facts["outputs"]
    for periods in ((2015, 2020), (2025,)):          # the model solves periods one after another
        outputs.where(F.col("period").isin(*periods)).write.mode("append").parquet(out_dir)
        q = start_period_updates(spark, out_dir, job, ckpt)
        q.awaitTermination(300)
        assert q.exception() is None
    streamed = read_cost_updates(spark, str(tmp_path / "costs"))
    assert {r[0] for r in streamed.select("period").distinct().collect()} == {2020, 2025, 2030}

    gen_all, costs_all, cf_all = U.update_inputs(outputs.where("period <= 2025"), facts["input_costs"],
                                                 facts["capacity_factors"], params["cooling_tech_map"])
    adj = U.period_cost_update(gen_all, cf_all, params, nl, ca, update_years=[2015, 2020, 2025])
    batch = U.merge_costs(costs_all, adj, [2020, 2025, 2030])
    cols = batch.columns
    assert rows(streamed.select(*cols)) == rows(batch)


def test_replayed_batch_is_idempotent(spark, params, tmp_path):
    """A batch re-run after a failure rewrites the same partitions."""
    facts = build_facts(spark)
    q1 = Q.new_vintage_generation(facts["outputs"], region=None)
    q3 = Q.capacity_factor_query(facts["capacity_factors"], region=None)
    q4 = Q.input_cost_query(facts["input_costs"], region=None)
    cal = CAL.run_calibration(q1, q3, q4, params)
    nl, ca = CAL.for_scenario(cal.nonlearning, REF), CAL.for_scenario(cal.adders, REF)
    job = UpdateJob(params, nl, ca, lambda: facts["input_costs"], lambda: facts["capacity_factors"],
                    str(tmp_path / "history"), str(tmp_path / "costs"))
    batch = facts["outputs"].where(F.col("period").isin(2015, 2020))
    job.run_batch(batch, 0)
    first = rows(read_cost_updates(spark, str(tmp_path / "costs")))
    hist_n = spark.read.parquet(str(tmp_path / "history")).count()
    job.run_batch(batch, 0)                         # the same batch again
    assert rows(read_cost_updates(spark, str(tmp_path / "costs"))) == first
    assert spark.read.parquet(str(tmp_path / "history")).count() == hist_n


def test_late_rows_update_all_later_periods(spark, params, tmp_path):
    """Vintages of 2015 that arrive after 2015, 2020 and 2025 change every cost from 2020 on."""
    facts = build_facts(spark)
    q1 = Q.new_vintage_generation(facts["outputs"], region=None)
    q3 = Q.capacity_factor_query(facts["capacity_factors"], region=None)
    q4 = Q.input_cost_query(facts["input_costs"], region=None)
    cal = CAL.run_calibration(q1, q3, q4, params)
    nl, ca = CAL.for_scenario(cal.nonlearning, REF), CAL.for_scenario(cal.adders, REF)

    def job(name):
        return UpdateJob(params, nl, ca, lambda: facts["input_costs"], lambda: facts["capacity_factors"],
                         str(tmp_path / name / "history"), str(tmp_path / name / "costs"))

    run = facts["outputs"].where(F.col("period").isin(2015, 2020, 2025))
    late = (F.col("period") == 2015) & (F.col("technology") == "wind")
    late_job, whole = job("late"), job("whole")
    for n, batch in enumerate((run.where(~late), run.where(late))):
        late_job.run_batch(batch, n)
    whole.run_batch(run, 0)
    assert run.where(late).count() > 0
    assert rows(read_cost_updates(spark, late_job.costs_path)) == rows(read_cost_updates(spark, whole.costs_path))
    before = rows(read_cost_updates(spark, late_job.costs_path))
    late_job.run_batch(run.limit(0), 2)             # an empty batch changes nothing
    assert rows(read_cost_updates(spark, late_job.costs_path)) == before
