"""Readers and writers: panel CSVs (index column, mixed-case headers, malformed values),
table writes, CSV export and the incremental streaming loader."""

from __future__ import annotations

import os
import tempfile
from decimal import Decimal

from conftest import d
from tillroll.operators.sampling import sample_by_keys, sample_panel
from tillroll.sources.panel import read_csv_table, read_panel
from tillroll.sources.sinks import export_csv, write_table
from tillroll.streaming import append_panel_files

TRIPS_HEADER = ["", "TC_id", "hh_id", "TC_date", "TC_retailer_code", "TC_total_spent"]


def _write(path: str, header: list[str], rows: list[list[str]]) -> None:
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def _scratch() -> str:
    return tempfile.mkdtemp(prefix="tillroll-test-")


def _panel_csvs(root: str) -> dict[str, str]:
    paths = {n: os.path.join(root, f"{n}.csv") for n in ("households", "products", "trips", "purchases")}
    _write(paths["households"], ["", "hh_id", "hh_income", "hh_state"],
           [["0", "501", "12", "CA"], ["1", "502", "19", "NY"], ["2", "503", "", "TX"]])
    _write(paths["products"], ["", "prod_id", "department_at_prod_id", "group_at_prod_id", "module_at_prod_id",
                               "brand_at_prod_id"],
           [["0", "7000000001", "DAIRY", "MILK", "MILK-2%", "CTL BR"]])
    _write(paths["trips"], TRIPS_HEADER,
           [["0", "1", "501", "2004-01-05", "R1", "12.50"],
            ["1", "2", "502", "not-a-date", "R2", "7.25"],
            ["2", "3", "502", "2004-02-01", "R2", "abc"]])
    _write(paths["purchases"], ["", "TC_id", "prod_id", "quantity_at_TC_prod_id", "total_price_paid_at_TC_prod_id",
                                "deal_flag_at_TC_prod_id"],
           [["0", "1", "7000000001", "2", "3.98", "1"]])
    return paths


def test_read_panel_csv(spark):
    panel = read_panel(spark, _panel_csvs(_scratch()))
    trips = {r["tc_id"]: r for r in panel.trips.collect()}
    assert trips[1]["tc_date"] == d("2004-01-05") and trips[1]["tc_total_spent"] == Decimal("12.50")
    assert trips[2]["tc_date"] is None  # malformed date -> NULL, no failure
    assert trips[3]["tc_total_spent"] is None
    assert panel.trips.columns == ["tc_id", "hh_id", "tc_date", "tc_retailer_code", "tc_total_spent"]
    hh = {r["hh_id"]: r["hh_income"] for r in panel.households.collect()}
    assert hh == {501: 12, 502: 19, 503: None}
    prod = panel.products.first()
    assert prod["prod_id"] == 7000000001 and prod["brand_at_prod_id"] == "CTL BR"
    buy = panel.purchases.first()
    assert (buy["quantity_at_tc_prod_id"], buy["deal_flag_at_tc_prod_id"]) == (2, 1)


def test_sample_by_keys_is_referential(spark):
    panel = read_panel(spark, _panel_csvs(_scratch()))
    keys = spark.createDataFrame([(501,), (501,), (5,)], "hh_id long")
    assert sample_by_keys(panel.households, keys, "hh_id").count() == 1  # no duplication
    sub = sample_panel(panel, keys)
    assert [r["tc_id"] for r in sub.trips.collect()] == [1]
    assert [r["tc_id"] for r in sub.purchases.collect()] == [1]


def test_write_table_modes_and_export(spark):
    root = _scratch()
    panel = read_panel(spark, _panel_csvs(root))
    target = os.path.join(root, "trips_out")
    write_table(panel.trips, target, "append")
    write_table(panel.trips, target, "append")
    assert spark.read.parquet(target).count() == 6
    write_table(panel.trips, target, "replace", partition_by=["tc_retailer_code"])
    assert spark.read.parquet(target).count() == 3
    out = os.path.join(root, "csv_out")
    export_csv(panel.trips, out)
    back = read_csv_table(spark, out, "trips")
    assert sorted(r["tc_id"] for r in back.collect()) == [1, 2, 3]


def test_streaming_append_is_exactly_once(spark):
    root = _scratch()
    src = os.path.join(root, "incoming")
    os.makedirs(src)
    target, ckpt = os.path.join(root, "trips"), os.path.join(root, "ckpt")
    _write(os.path.join(src, "a.csv"), TRIPS_HEADER, [["0", "1", "10", "2004-01-01", "R1", "1.00"]])
    _write(os.path.join(src, "b.csv"), TRIPS_HEADER, [["0", "2", "11", "2004-01-02", "R1", "2.00"],
                                                       ["1", "3", "99", "2004-01-03", "R2", "3.00"]])
    keys = spark.createDataFrame([(10,), (11,)], "hh_id long")
    append_panel_files(spark, "trips", src, TRIPS_HEADER, target, ckpt, keys=keys, key="hh_id")
    assert sorted(r["tc_id"] for r in spark.read.parquet(target).collect()) == [1, 2]
    append_panel_files(spark, "trips", src, TRIPS_HEADER, target, ckpt, keys=keys, key="hh_id")
    assert spark.read.parquet(target).count() == 2  # nothing loaded twice
    _write(os.path.join(src, "c.csv"), TRIPS_HEADER, [["0", "4", "10", "bad", "R1", "4.00"]])
    append_panel_files(spark, "trips", src, TRIPS_HEADER, target, ckpt, keys=keys, key="hh_id")
    got = {r["tc_id"]: r["tc_date"] for r in spark.read.parquet(target).collect()}
    assert got == {1: d("2004-01-01"), 2: d("2004-01-02"), 4: None}


def test_sample_panel_with_product_keys(spark):
    panel = read_panel(spark, _panel_csvs(_scratch()))
    keys = spark.createDataFrame([(502,)], "hh_id long")
    prods = spark.createDataFrame([(1,)], "prod_id long")
    sub = sample_panel(panel, keys, product_keys=prods)
    assert sorted(r["tc_id"] for r in sub.trips.collect()) == [2, 3]
    assert sub.products.count() == 0 and sub.purchases.count() == 0


def test_cli_runs_an_analysis_on_panel_csvs(spark, capsys):
    from tillroll.__main__ import main

    root = _scratch()
    _panel_csvs(root)
    assert main(["--list"]) == 0
    assert "loyal_pair" in capsys.readouterr().out.split()
    out = os.path.join(root, "result")
    assert main(["trip_count", "--panel", root, "--year", "2004", "--out", out]) == 0
    back = spark.read.option("header", True).csv(out).collect()
    assert [int(r["n_trips"]) for r in back] == [2]  # the malformed date is not in 2004
    assert main(["no_such_analysis", "--panel", root]) == 2


def test_write_table_passes_options(spark):
    root = _scratch()
    panel = read_panel(spark, _panel_csvs(root))
    target = os.path.join(root, "trips_zstd")
    write_table(panel.trips, target, "overwrite", options={"compression": "zstd"})
    files = [f for f in os.listdir(target) if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)
    assert spark.read.parquet(target).count() == 3


def test_cli_writes_and_reads_the_year_layout(spark):
    from tillroll.__main__ import main

    root = _scratch()
    _panel_csvs(root)
    stored = os.path.join(root, "stored")
    assert main(["--panel", root, "--write-layout", stored]) == 0
    folders = sorted(f for f in os.listdir(os.path.join(stored, "trips")) if f.startswith("tc_year="))
    assert folders == ["tc_year=2004", "tc_year=__HIVE_DEFAULT_PARTITION__"]  # the undated trip has no year
    out = os.path.join(root, "count")
    assert main(["trip_count", "--panel", stored, "--format", "parquet", "--year", "2004", "--out", out]) == 0
    assert [int(r["n_trips"]) for r in spark.read.option("header", True).csv(out).collect()] == [2]


def test_cli_runs_sql_over_views(spark):
    from tillroll.__main__ import main

    root = _scratch()
    _panel_csvs(root)
    out = os.path.join(root, "sql_out")
    sql = "SELECT tc_retailer_code, count(*) AS n FROM trips WHERE year(tc_date) = 2004 GROUP BY tc_retailer_code"
    assert main(["--panel", root, "--sql", sql, "--out", out]) == 0
    got = sorted((r["tc_retailer_code"], int(r["n"])) for r in spark.read.option("header", True).csv(out).collect())
    assert got == [("R1", 1), ("R2", 1)]


def test_cut_lineage_uses_the_configured_checkpoint_folder(spark):
    from tillroll.session import checkpoint_dir, cut_lineage

    folder = checkpoint_dir(spark)
    assert folder  # set once by the test session (ensure_checkpoint_dir), never assumed
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").groupBy("k").count()
    cut = cut_lineage(df)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, df.collect()))
    written = [p for p, _, files in os.walk(folder.replace("file:", "")) if files]
    assert written  # the checkpoint landed in the configured folder


def test_csv_columns_by_name_any_order(spark):
    from tillroll.sources.panel import read_typed_csv
    from tillroll.sources.schema import PRODUCTS

    path = os.path.join(_scratch(), "products.csv")
    with open(path, "w") as f:
        f.write(",brand_at_prod_id,extra,prod_id,module_at_prod_id,department_at_prod_id,group_at_prod_id\n")
        f.write('0,"CTL BR",x, 17 ,"MILK, 2%",DAIRY,MILK\n')
        f.write("1,OTHER,y,not-a-number,EGGS,DAIRY,EGGS\n")
    rows = {r["module_at_prod_id"]: r for r in read_typed_csv(spark, path, PRODUCTS).collect()}
    assert rows["MILK, 2%"]["prod_id"] == 17 and rows["MILK, 2%"]["brand_at_prod_id"] == "CTL BR"
    assert rows["EGGS"]["prod_id"] is None  # malformed key -> NULL, the row is kept


def test_csv_folder_matches_each_file_by_its_header(spark):
    from tillroll.sources.panel import read_typed_csv
    from tillroll.sources.schema import HOUSEHOLDS

    root = _scratch()
    _write(os.path.join(root, "a.csv"), ["hh_id", "hh_income", "hh_state"], [["1", "10", "AL"]])
    _write(os.path.join(root, "b.csv"), ["hh_income", "hh_id", "hh_state"], [["20", "2", "TX"]])
    _write(os.path.join(root, "c.csv"), ["", "HH_ID", "hh_state", "hh_income"], [["0", "3", "NY", "30"]])
    got = sorted(map(tuple, read_typed_csv(spark, root, HOUSEHOLDS).select("hh_id", "hh_income", "hh_state").collect()))
    assert got == [(1, 10, "AL"), (2, 20, "TX"), (3, 30, "NY")]


def test_stream_stops_at_a_differing_header(spark):
    import pytest

    from pyspark.errors import StreamingQueryException

    from tillroll.streaming.append import append_panel_files

    root = _scratch()
    src, out, ckpt = (os.path.join(root, x) for x in ("src", "out", "ckpt"))
    os.makedirs(src)
    _write(os.path.join(src, "a.csv"), ["hh_income", "hh_id", "hh_state"], [["20", "2", "TX"]])
    with pytest.raises(StreamingQueryException):
        append_panel_files(spark, "households", src, ["hh_id", "hh_income", "hh_state"], out, ckpt)


def test_checkpoints_go_to_the_warehouse_where_no_folder_is_named(spark, monkeypatch):
    from tillroll import session

    asked = []

    class Context:
        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, folder):
            asked.append(folder)

    monkeypatch.setattr(session, "_context", lambda s: Context())
    monkeypatch.setattr(session, "checkpoint_dir", lambda s: None)
    folder = session.ensure_checkpoint_dir(spark)
    assert asked == [folder] and folder.startswith(spark.conf.get("spark.sql.warehouse.dir").rstrip("/"))
