"""Sources S1-S4 and sinks K1-K3."""

import os

import pytest

from expcurve.sinks import read_cost_updates, write_cost_updates, write_param_csv
from expcurve.sources import xmldb
from expcurve.sources.params import read_param_csv
from expcurve.sources.scenarios import load_scenarios, write_scenarios
from expcurve.sources.xmldb import flatten_model_output, write_flat_tables, write_model_output
from tests.conftest import FIXTURES, rows

XML = os.path.join(FIXTURES, "model_output.xml")


def test_xml_flatten_matches_by_type(spark):
    t = flatten_model_output(spark, XML, "Reference_exogenous")
    out = rows(t["outputs"], "region", "sector", "technology", "period", "year", "value")
    assert ("USA", "electricity", "PV_storage", 2020, 2020, 0.1) in out      # intermittent-technology
    assert ("USA", "elec_CSP", "CSP (dry_hybrid)", 2025, 2025, 0.2) in out   # pass-through-sector
    assert ("USA", "electricity", "PV", 2020, 2025, 0.45) in out             # older vintage
    assert len(out) == 5
    assert rows(t["input_costs"], "technology", "input", "year", "value") == [("PV", "capital", 2020, 1.5)]
    assert len(rows(t["capacity_factors"])) == 4
    assert rows(t["market_prices"], "market", "year", "value") == [
        ("USACO2", 2020, 10.0), ("USACO2", 2025, 25.0), ("USAelectricity", 2020, 5.0)]


def test_xml_element_names_do_not_matter(spark, tmp_path):
    """Any element name counts by its @type, single or repeated; other types are left alone."""
    doc = """<scenario><world><region name="USA">
      <odd-sector name="electricity" type="sector"><nesting-subsector name="s" type="subsector">
        <new-tech name="T" type="technology" year="2020"><capacity-factor>0.5</capacity-factor>
          <input-OM-fixed name="OM-fixed" type="input"><price-paid vintage="2020">2.5</price-paid></input-OM-fixed>
          <input-capital name="capital" type="input"><price-paid vintage="2020">1.5</price-paid></input-capital>
          <by-product name="heat" type="output"><physical-output vintage="2020">7</physical-output>
            <physical-output vintage="2025"> </physical-output></by-product>
          <other name="x" type="other"><physical-output vintage="2020">9</physical-output></other>
        </new-tech></nesting-subsector></odd-sector>
      <resource name="coal" type="resource"><subresource name="g" type="subresource"/></resource>
    </region></world></scenario>"""
    path = tmp_path / "model.xml"
    path.write_text(doc)
    t = flatten_model_output(spark, str(path), "S")
    assert rows(t["input_costs"], "sector", "subsector", "technology", "period", "input", "year", "value") == [
        ("electricity", "s", "T", 2020, "OM-fixed", 2020, 2.5), ("electricity", "s", "T", 2020, "capital", 2020, 1.5)]
    assert sorted(map(tuple, t["outputs"].select("output", "year", "value").collect())) == [
        ("heat", 2020, 7.0), ("heat", 2025, None)]
    assert rows(t["capacity_factors"], "technology", "value") == [("T", 0.5)]
    for name in t:                                  # one scan of the XML per table
        plan = t[name]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan text") == 1 and "FileScan xml" not in plan


def test_xml_damage_fails(spark, tmp_path):
    path = tmp_path / "model.xml"
    text = open(XML).read()
    path.write_text(text.replace(">0.45<", ">none<"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        flatten_model_output(spark, str(path), "S")["outputs"].collect()


REGION = """<region name="{r}"><supplysector name="electricity" type="sector"><subsector name="s{k}" type="subsector">
  <technology name="T" type="technology" year="2020"><capacity-factor>0.5</capacity-factor>
    <output-primary name="electricity" type="output"><physical-output vintage="2020">{v}</physical-output></output-primary>
  </technology><stub-technology name="U" type="technology" year="2025"/></subsector></supplysector></region>"""


def regions_text(n):
    return "".join(REGION.format(r=f"R{i % 7}", k=i, v=i) for i in range(n))


def test_one_large_xml_file_is_many_tasks(spark, tmp_path):
    path = tmp_path / "model.xml"
    path.write_text(f'<?xml version="1.0"?><world><region name="none"/>\n{regions_text(900)}<market name="m"/></world>')
    structure = xmldb.infer_structure(spark, str(path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        t = flatten_model_output(spark, str(path), "S", structure)["outputs"]
        assert t.rdd.getNumPartitions() > 4
        assert sorted((r.region, r.subsector, r.value) for r in t.collect()) == sorted(
            (f"R{i % 7}", f"s{i}", float(i)) for i in range(900))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_structure_is_stored_and_guarded(spark, tmp_path, monkeypatch):
    """Scenarios of one folder are read at once against the stored structure; nothing is inferred again."""
    for s in ("A", "B"):
        (tmp_path / f"scenario={s}").mkdir()
        (tmp_path / f"scenario={s}" / "m.xml").write_text(f"<world>{regions_text(3 if s == 'A' else 2)}</world>")
    xmldb.store_structure(spark, str(tmp_path))
    monkeypatch.setattr(xmldb, "infer_structure", None)
    t = flatten_model_output(spark, str(tmp_path))
    assert sorted((r.scenario, r.region, r.value) for r in t["outputs"].collect()) == [
        ("A", "R0", 0.0), ("A", "R1", 1.0), ("A", "R2", 2.0), ("B", "R0", 0.0), ("B", "R1", 1.0)]
    assert t["capacity_factors"].count() == 5 and t["market_prices"].count() == 0
    # two technologies where the structure was inferred from one, and a technology by another name
    more = REGION.replace("</technology>", "</technology><technology name='V' type='technology' year='2020'>"
                          "<capacity-factor>0.25</capacity-factor></technology>").format(r="X", k=1, v=1)
    (tmp_path / "scenario=A" / "n.xml").write_text(f"<world>{more}</world>")
    assert flatten_model_output(spark, str(tmp_path))["capacity_factors"].count() == 7
    (tmp_path / "scenario=A" / "n.xml").write_text(f"<world>{more.replace('stub-technology', 'new-technology')}</world>")
    with pytest.raises(Exception, match="new-technology"):
        flatten_model_output(spark, str(tmp_path))["outputs"].collect()


@pytest.mark.parametrize("damage", [lambda t: t[:-60], lambda t: t.replace("</region>", "", 1), lambda t: t.replace("</technology>", "", 1)])
def test_xml_damaged_records_fail(spark, tmp_path, damage):
    path = tmp_path / "model.xml"
    path.write_text("<world>" + damage(regions_text(4)) + "</world>")
    (tmp_path / "good.xml").write_text("<world>" + regions_text(1) + "</world>")
    structure = xmldb.infer_structure(spark, str(tmp_path / "good.xml"))
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        flatten_model_output(spark, str(path), "S", structure)["outputs"].collect()


def test_xml_round_trip(spark, tmp_path):
    t = flatten_model_output(spark, XML, "Reference_exogenous")
    write_model_output(t, str(tmp_path / "xml"))
    back = flatten_model_output(spark, str(tmp_path / "xml" / "scenario=Reference_exogenous"), "Reference_exogenous")
    for name in t:
        assert rows(back[name]) == rows(t[name])


def test_flat_tables_and_scenarios_replace_by_partition(spark, tmp_path):
    root = str(tmp_path / "flat")
    write_flat_tables(flatten_model_output(spark, XML, "A"), root)
    write_flat_tables(flatten_model_output(spark, XML, "B"), root)
    write_flat_tables(flatten_model_output(spark, XML, "A"), root)     # re-adding A replaces A only
    out = spark.read.parquet(f"{root}/outputs")
    assert dict(rows(out.groupBy("scenario").count())) == {"A": 5, "B": 5}
    runs = {"A": f"{root}/outputs/scenario=A", "B": f"{root}/outputs/scenario=B"}
    both = load_scenarios(spark, runs)
    assert both.count() == 10 and both.columns[0] == "scenario"
    path = str(tmp_path / "proj")
    write_scenarios(both, path)
    write_scenarios(both.where("scenario = 'B'").limit(1), path)
    assert dict(rows(spark.read.parquet(path).groupBy("scenario").count())) == {"A": 5, "B": 1}


def test_param_csv_round_trip(spark, params, tmp_path):
    path = str(tmp_path / "cal_adders")
    write_param_csv(params["cal_adders"], path)
    back = read_param_csv(spark, path, "cal_adders")
    assert rows(back) == rows(params["cal_adders"])
    files = [f for f in os.listdir(path) if f.endswith(".csv")]
    assert len(files) == 1


def test_cost_write_back_replaces_one_period(spark, tmp_path):
    k = "scenario string, region string, period int, input string, adjusted_cost double"
    base = spark.createDataFrame([("S", "USA", 2020, "capital", 1.0), ("S", "USA", 2025, "capital", 2.0)], k)
    path = str(tmp_path / "costs")
    write_cost_updates(base, path)
    write_cost_updates(spark.createDataFrame([("S", "USA", 2025, "capital", 9.0)], k), path)
    got = rows(read_cost_updates(spark, path), "period", "adjusted_cost")
    assert got == [(2020, 1.0), (2025, 9.0)]


def test_cost_updates_of_one_region_keep_the_others(spark, tmp_path):
    k = "scenario string, region string, period int, input string, adjusted_cost double"
    path = str(tmp_path / "costs")
    base = spark.createDataFrame([("S", r, 2025, "capital", 2.0) for r in ("USA", "EU")], k)
    write_cost_updates(base, path)
    for region, cost in (("USA", 20.0), ("EU", 30.0)):
        write_cost_updates(spark.createDataFrame([("S", region, 2025, "capital", cost)], k), path)
    assert rows(read_cost_updates(spark, path), "region", "adjusted_cost") == [("EU", 30.0), ("USA", 20.0)]


def test_cost_updates_are_published_whole(spark, tmp_path):
    """A write that ends before its list entry, some partitions done, is never seen."""
    k = "scenario string, region string, period int, input string, adjusted_cost double"
    path = str(tmp_path / "costs")
    write_cost_updates(spark.createDataFrame([("S", "USA", y, "capital", 1.0) for y in (2020, 2025, 2030)], k), path)
    before = rows(read_cost_updates(spark, path))
    half = spark.createDataFrame([("S", "USA", 2020, "capital", 7.0)], k)
    half.write.partitionBy("scenario", "region", "period").parquet(f"{path}/rows/write=w-killed")
    assert rows(read_cost_updates(spark, path)) == before
    write_cost_updates(half, path)
    assert rows(read_cost_updates(spark, path), "period", "adjusted_cost") == [(2020, 7.0), (2025, 1.0), (2030, 1.0)]


def test_cost_updates_with_missing_and_numeric_keys(spark, tmp_path):
    k = "scenario string, region string, period int, input string, adjusted_cost double"
    path = str(tmp_path / "costs")
    write_cost_updates(spark.createDataFrame([("1", None, 2020, "capital", 1.0), ("2", None, 2020, "capital", 2.0)], k), path)
    write_cost_updates(spark.createDataFrame([("2", None, 2020, "capital", 3.0)], k), path)
    assert [r[0] for r in read_cost_updates(spark, path).orderBy("scenario").select("adjusted_cost").collect()] == [1.0, 3.0]
