"""The three jobs end to end on the XML fixture (flatten -> jobs -> files)."""

import os

from expcurve.plans import jobs
from expcurve.sources.params import read_param_csv
from expcurve.sources.xmldb import flatten_model_output, write_flat_tables
from tests.conftest import FIXTURES

XML = os.path.join(FIXTURES, "model_output.xml")


def test_jobs_end_to_end(spark, tmp_path):
    flat = str(tmp_path / "flat")
    write_flat_tables(flatten_model_output(spark, XML, "Reference_exogenous"), flat)
    analysis = tmp_path / "analysis"
    (analysis / "input" / "mappings").mkdir(parents=True)
    (analysis / "params").mkdir()
    layout = {"learning_rates.csv": "input", "t0_cost_deployment.csv": "input",
              "tech_FCR.csv": "input", "cooling_tech_map.csv": "input/mappings",
              "deployment_map.csv": ("input/mappings", "learning_components_deployment_map.csv"),
              "learning_map.csv": ("input/mappings", "learning_components_learning_map.csv"),
              "cal_adders.csv": "params", "non_learning_capital.csv": "params"}
    for src, dst in layout.items():
        folder, name = dst if isinstance(dst, tuple) else (dst, src)
        (analysis / folder / name).write_text(open(os.path.join(FIXTURES, src)).read())
    out = str(tmp_path / "out")
    jobs.calibrate(spark, flat, str(analysis), out)
    assert read_param_csv(spark, f"{out}/cal_adders", "cal_adders").count() >= 0
    jobs.update(spark, flat, str(analysis), str(tmp_path / "costs"), current_year=2020)
    jobs.results(spark, flat, str(tmp_path / "results"))
    cp = spark.read.parquet(str(tmp_path / "results" / "carbon_price"))
    assert [tuple(r) for r in cp.select("market", "year", "value").collect()] == [("USACO2", 2020, 10.0), ("USACO2", 2025, 25.0)]
