import datetime as dt

import pytest
from conftest import row_set, rows
from pyspark.sql import functions as F

from martwright import schemas
from martwright.plans.warehouse import build_warehouse
from martwright.sources import files, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


PRODUCTS = """prd_id,prd_key,prd_nm,prd_cost,prd_line,prd_start_dt,prd_end_dt
210,CO-RF-FR-R92B-58,HL Road Frame - Black- 58,,R ,2003-07-01,
212,AC-HE-HL-U509-R,"Sport, 100 Helmet",12,S ,2011-07-01,2007-12-28
213,AC-HE-HL-U509-R,Sport-100 Helmet,14,S ,2012-07-01,2008-12-27
214,AC-HE-HL-U509-R,Sport-100 Helmet,13,,2013-07-01,"""


def test_text_scan_keeps_blanks_and_nulls_empty_fields(spark, tmp_path):
    got = files.scan_csv_text(spark, write(tmp_path / "p.csv", PRODUCTS))
    assert {kind for _, kind in got.dtypes} == {"string"}
    assert rows(got, "prd_nm", "prd_cost", "prd_line") == [
        ("HL Road Frame - Black- 58", None, "R "),
        ("Sport, 100 Helmet", "12", "S "),
        ("Sport-100 Helmet", "14", "S "),
        ("Sport-100 Helmet", "13", None),
    ]


def test_typed_load_is_positional_and_strict(spark, frame, tmp_path):
    schema = schemas.BRONZE["crm_prd_info"][1]
    text = files.scan_csv_text(spark, write(tmp_path / "p.csv", PRODUCTS)).toDF(*"abcdefg")
    typed = files.load_bronze_table(text, schema)
    assert typed.columns == schema.names and typed.first().prd_id == 210
    bad = text.withColumn("a", F.lit("not a number"))
    with pytest.raises(Exception):
        files.load_bronze_table(bad, schema).collect()
    with pytest.raises(ValueError):
        files.load_bronze_table(text.drop("g"), schema)


def landing(root, skip=()):
    sources = {
        "source_crm/cust_info.csv": "cst_id,cst_key,cst_firstname,cst_lastname,cst_marital_status,"
        "cst_gndr,cst_create_date\n1,AW1, Ann,Lee ,S,F,2025-10-06\n1,AW1,Anna,Lee,M,F,2025-10-07\n"
        ",AW9,X,Y,S,F,2025-10-07\n2,AW2,Bob,Ray,M,,2025-10-06\n",
        "source_crm/prd_info.csv": PRODUCTS + "\n",
        "source_crm/sales_details.csv": "sls_ord_num,sls_prd_key,sls_cust_id,sls_order_dt,"
        "sls_ship_dt,sls_due_dt,sls_sales,sls_quantity,sls_price\n"
        "SO1,HL-U509-R,1,20240105,20240112,20240117,26,2,13\n"
        "SO1,FR-R92B-58,2,20240106,20240112,20240117,,1,-50\n"
        "SO2,UNKNOWN,7,0,20240112,20240117,10,1,10\n",
        "source_erp/CUST_AZ12.csv": "CID,BDATE,GEN\nNASAW1,1971-10-06,Male\nAW2,2999-01-01,F\n",
        "source_erp/LOC_A101.csv": "CID,CNTRY\nAW-1,DE\nAW-2,\n",
        "source_erp/PX_CAT_G1V2.csv": "ID,CAT,SUBCAT,MAINTENANCE\nAC_HE,Accessories,Helmets,Yes\n"
        "CO_PD,Components,Pedals,No\nCO_RF,Components,Road Frames,Yes",
    }
    for name, text in sources.items():
        if name not in skip:
            write(root / name, text)
    return str(root)


def test_batch_load_isolates_failures(spark, tmp_path):
    root = landing(tmp_path / "raw", skip=("source_erp/LOC_A101.csv",))
    write(tmp_path / "raw" / "source_erp" / "CUST_AZ12.csv", "CID,BDATE\nx,y\n")
    log = tables.load_bronze(spark, root, str(tmp_path / "bronze"))
    got = {r.table_name: (r.status, r.source_rows, r.destination_rows) for r in log.collect()}
    assert got["crm_cust_info"] == ("success", 4, 4)
    assert got["erp_loc_a101"] == ("error", 0, 0)
    assert got["erp_cust_az12"][0] == "error"
    assert got["erp_px_cat_g1v2"] == ("success", 3, 3)
    assert tables.load_failed(log)
    errors = {r.table_name: r.error_message for r in log.filter("status = 'error'").collect()}
    assert errors["erp_loc_a101"].startswith("no source file at")


def test_a_bad_value_fails_only_its_table(spark, tmp_path):
    root = landing(tmp_path / "raw")
    bad = (tmp_path / "raw" / "source_crm" / "prd_info.csv").read_text().replace("212,", "21x,")
    write(tmp_path / "raw" / "source_crm" / "prd_info.csv", bad)
    log = tables.load_bronze(spark, root, str(tmp_path / "bronze"))
    got = {r.table_name: r.status for r in log.collect()}
    assert got.pop("crm_prd_info") == "error" and set(got.values()) == {"success"}


def test_discovery_names_tables(spark, tmp_path):
    root = landing(tmp_path / "raw")
    write(tmp_path / "raw" / "__pycache__" / "x.csv", "a\n1\n")
    write(tmp_path / "raw" / "other" / "Some.csv", " A , b\n1,2\n")
    found = files.discover_csvs(spark, root)
    assert [table for _, table in found] == [
        "other_some",
        "crm_cust_info",
        "crm_prd_info",
        "crm_sales_details",
        "erp_cust_az12",
        "erp_loc_a101",
        "erp_px_cat_g1v2",
    ]
    frame = files.normalize_columns(files.scan_csv_text(spark, found[0][0]))
    assert frame.columns == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        files.discover_csvs(spark, str(tmp_path / "nowhere"))


def test_append_and_refresh(frame, tmp_path):
    path = str(tmp_path / "t")
    df = frame([(1,), (2,)], "a int")
    assert tables.append_rows(df.limit(0), path) == 0
    assert [tables.append_rows(df, path) for _ in range(2)] == [2, 2]
    assert tables.refresh_table(df, path) == 2
    # A failed refresh leaves the old rows, and rows may be replaced by ones made from them.
    with pytest.raises(Exception, match="bad"):
        tables.refresh_table(df.selectExpr("raise_error('bad') as a"), path)
    old = files.read_table(df.sparkSession, path)
    assert old.count() == 2
    assert tables.refresh_table(old.union(old), path) == 4
    assert tables.append_rows(df, path) == 2 and tables.stored_rows(df.sparkSession, path) == 6
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


class Stopped(Exception):
    pass


STEPS = ["new_version", "switch_version", "current_version", "drop_other_versions", "stored_rows"]


@pytest.mark.parametrize("when", ["before", "after"])
@pytest.mark.parametrize("call", [1, 2])
@pytest.mark.parametrize("step", STEPS)
def test_a_refresh_that_stops_leaves_old_or_new_rows(spark, frame, tmp_path, monkeypatch, step, call, when):
    """Stopped around every step, then repaired by the next refresh."""
    path, real, calls = str(tmp_path / "t"), getattr(tables, step), []
    for n in (1, 2):
        tables.refresh_table(frame([(n,)] * n, "a int"), path)

    def stops(*args):
        calls.append(args)
        if len(calls) == call and when == "before":
            raise Stopped
        found = real(*args)
        if len(calls) == call:
            raise Stopped
        return found

    monkeypatch.setattr(tables, step, stops)
    try:
        tables.refresh_table(frame([(3,)] * 3, "a int"), path)
        stopped = False
    except Stopped:
        stopped = True
    monkeypatch.undo()
    held = rows(files.read_table(spark, path))
    assert held in ([(2,)] * 2, [(3,)] * 3) and (stopped or held == [(3,)] * 3)
    assert tables.refresh_table(frame([(4,)] * 4, "a int"), path) == 4
    assert rows(files.read_table(spark, path)) == [(4,)] * 4
    left = [p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")]
    assert "_current" in left and len(left) == 3  # the marker, this version and the one before


def test_a_marker_written_in_part_is_not_read(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    tables.refresh_table(frame([(1,)], "a int"), path)
    (tmp_path / "t" / "_current.v_half").write_text("v_ha")
    (tmp_path / "t" / "v_half").mkdir()
    assert rows(files.read_table(spark, path)) == [(1,)]
    tables.refresh_table(frame([(2,)], "a int"), path)
    assert not any("half" in p.name for p in (tmp_path / "t").iterdir())


def test_plain_tables_become_versioned(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    frame([(1,)], "a int").write.parquet(path)
    assert rows(files.read_table(spark, path)) == [(1,)]
    for n in (2, 3):
        tables.refresh_table(files.read_table(spark, path).selectExpr("a + 1 as a"), path)
        assert rows(files.read_table(spark, path)) == [(n,)]
    assert not list((tmp_path / "t").glob("*.parquet"))


def test_large_files_without_quoted_breaks_are_split(spark, tmp_path, monkeypatch):
    lines = "".join(f"{i},name {i}\n" for i in range(20_000))
    path = write(tmp_path / "big.csv", "a,b\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert files.scan_csv_text(spark, path).rdd.getNumPartitions() == 1
        split = files.scan_csv_text(spark, path, quoted_breaks=False)
        assert split.rdd.getNumPartitions() > 2 and split.count() == 20_000
        schema = schemas.table("a long, b string")
        assert tables.load_table(spark, path, schema, str(tmp_path / "out"), False) == (20_000, 20_000)
        assert len(list((tmp_path / "out").glob("v_*/*.parquet"))) > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_names_are_guarded(spark):
    for bad in ("a b", "1a", "a;drop", "../x", ""):
        with pytest.raises(ValueError):
            tables.checked_name(bad)
    log = tables.replicate_tables(spark, "/nonexistent", "/nonexistent2", ["bad name", "missing"])
    assert {r.status for r in log.collect()} == {"error"}


def test_day_replacement_is_repeatable(spark, frame, tmp_path):
    path = str(tmp_path / "days")
    day = lambda d, h=0: dt.datetime(2026, 1, d, h)
    tables.replace_day(frame([("a", day(1)), ("b", day(2))], "k string, at timestamp"), path, "at")
    again = frame([("c", day(2, 3))], "k string, at timestamp")
    for _ in range(2):
        tables.replace_day(again, path, "at")
    assert row_set(spark.read.parquet(path), "k") == [("a",), ("c",)]


def test_absent_section_is_empty_with_declared_columns(spark, tmp_path):
    got = files.read_section(spark, str(tmp_path / "none"), schemas.INGESTION_LOGS)
    assert got.columns == schemas.INGESTION_LOGS.names and got.count() == 0
    (tmp_path / "junk").mkdir()
    assert files.read_section(spark, str(tmp_path / "junk"), schemas.SUMMARY).count() == 0


def test_whole_build_twice(spark, tmp_path):
    root, out = landing(tmp_path / "raw"), str(tmp_path / "lake")
    first = build_warehouse(spark, root, out, "run-1", "2026-01-01 00:00:00")
    fact = row_set(
        first["gold"]["fct_sales"].selectExpr(
            "order_number", "customer_key is null", "product_key is null", "cast(order_date as string)",
            "cast(unit_price as double)", "cast(gross_sales_amount as double)",
        )
    )
    assert fact == [
        ("SO1", False, False, "2024-01-05", 13.0, 26.0),
        ("SO1", False, False, "2024-01-06", 50.0, 50.0),
        ("SO2", True, True, "1900-01-01", 10.0, 10.0),
    ]
    people = {r.customer_id: r for r in first["gold"]["dim_customers"].collect()}
    assert (people[1].first_name, people[1].country, people[1].gender) == ("Anna", "Germany", "Female")
    assert people[2].birthdate is None and people[2].gender == "Female"
    assert first["gold"]["dim_products"].count() == 2  # current versions only
    logs = {r.node_name: r for r in first["telemetry"]["execution_logs"].collect()}
    assert len(logs) == 122
    assert logs["unique_crm_cust_info_cst_id"].status == "warn"
    assert logs["not_null_fct_sales_customer_key"].status == "fail"
    assert logs["relationships_stg_crm_sales_details_sls_prd_key"].rows_affected == 1
    assert first["telemetry"]["ingestion_logs"].count() == 6
    summary = first["telemetry"]["summary"].first()
    assert summary.total_models == 10 and summary.overall_system_status == "CRITICAL"
    assert summary.passed_tests + summary.failed_tests + summary.warning_tests == 122
    coverage = {r.model_name: r for r in first["telemetry"]["model_coverage"].collect()}
    assert coverage["dim_customers"].columns_with_tests == 2
    assert coverage["dim_customers"].total_tests == 3
    tested = first["telemetry"]["column_coverage"].filter("has_tests").count()
    assert tested == summary.total_columns_with_tests

    second = build_warehouse(spark, root, out, "run-2", "2026-01-02 00:00:00")
    assert second["gold"]["fct_sales"].count() == 3
    assert second["telemetry"]["ingestion_logs"].count() == 12
    fresh = second["telemetry"]["source_freshness"]
    assert {r.last_loaded for r in fresh.collect()} == {dt.datetime(2026, 1, 2)}
