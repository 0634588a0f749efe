"""What keeps the work in proportion to the input: one pass, one join, one store."""

import json

import pytest
from conftest import rows

from martwright.operators import artifacts, telemetry
from martwright.plans.telemetry_export import telemetry_sections
from martwright.registry import loads
from martwright.registry.catalog import CATALOG
from martwright.schemas import INGESTION_LOGS
from martwright.sources import files, tables
from martwright.sources.star import merged_sales

FOLDER = "/root/testdata/sf0.001"
NODE = (
    "unique_id string, resource_type string, name string, alias string, schema string, database string,"
    f"columns {artifacts.COLUMNS_TYPE}, attached_node string, column_name string, test_model string"
)
SOURCE = "unique_id string, source_name string, name string, identifier string, schema string"


def node_rows(frame):
    column = {"a": ("a", "d", "t")}
    return frame(
        [
            ("model.p.m", "model", "m", None, "gold", "db", column, None, None, None),
            ("test.p.one.1", "test", "one", None, None, None, {}, "model.p.m", "a", None),
            ("test.p.two.2", "test", "two", None, None, None, {}, "source.p.r.s", None, None),
            ("test.p.three.3", "test", "three", None, None, None, {}, None, None, "source('r', 's')"),
            ("test.p.four.4", "test", "four", None, None, None, {}, None, None, None),
        ],
        NODE,
    )


def source_rows(frame):
    return frame([("source.p.r.s", "r", "s", "s_raw", "bronze")], SOURCE)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_targets_need_one_join_on_keys_that_are_never_null(frame):
    found = telemetry.node_targets(node_rows(frame), source_rows(frame))
    assert sorted(rows(found, "unique_id", "_target")) == [
        ("model.p.m", "gold.m"),
        ("test.p.four.4", None),
        ("test.p.one.1", "gold.m"),
        ("test.p.three.3", "bronze.s_raw"),
        ("test.p.two.2", "bronze.s_raw"),
    ]
    assert plan(found).count("Join") == 1


def test_artifacts_are_parsed_once(frame):
    texts = frame([(' \n{"a": 1}',), ("[1]",), ('"{"',), ("{",), (None,)], "value string")
    found = artifacts.as_variant(texts)
    assert [row[0] is not None for row in found.collect()] == [True, False, False, False, False]
    assert "jsonObjectKeys" not in plan(found) and "json_object_keys" not in plan(found)


def test_a_node_field_that_does_not_fit_is_null_alone(frame):
    node = {"resource_type": ["x"], "name": 7, "columns": {"a": {"name": "a", "description": {}}, "b": 1}}
    text = json.dumps({"nodes": {"n": node, "no_object": 5}})
    found = artifacts.manifest_nodes(artifacts.as_variant(frame([(text,)], "value string")))
    kept = {row.unique_id: row for row in found.collect()}
    one = artifacts._get("value", "$.columns", artifacts.COLUMNS_TYPE).alias("columns")
    alone = artifacts.entries(artifacts.as_variant(frame([(text,)], "value string")), "$.nodes").select("key", one)
    assert kept["n"].columns == {row.key: row.columns for row in alone.collect()}["n"]
    assert (kept["n"].name, kept["no_object"].name) == ("7", None)
    assert kept["n"].test_model is None


@pytest.mark.parametrize(
    "name",
    ["t02_execution_logs_variant", "t03_source_target_variant", "t04_model_coverage_variant",
     "t05_column_coverage_variant", "t06_coverage_flat"],
)
def test_what_is_read_several_times_is_stored_first(spark, name):
    read = CATALOG[name].run(spark, FOLDER).inputFiles()
    assert any("/cut-" in file for file in read)


def test_sections_follow_from_stored_nodes_and_tests(spark, frame):
    results = frame(
        [("run", "s", "2025-01-01T00:00:00Z", "test.p.one.1", "pass", 1.0, None, None)],
        "invocation_id string, invocation_started_at string, generated_at string, unique_id string,"
        "status string, execution_time double, failures long, message string",
    )
    new = spark.createDataFrame([], INGESTION_LOGS)
    sections = telemetry_sections(results, node_rows(frame), source_rows(frame), new)
    for name in ("model_coverage", "column_coverage", "execution_logs"):
        assert all("/cut-" in file for file in sections[name].inputFiles())
    assert sections["column_coverage"].collect()[0].test_names == "one"
    assert sections["summary"].collect()[0].total_tests == 1


def test_a_limit_holds_for_the_fact_before_the_joins(frame):
    fact = frame(
        [(f"k{i}", "p", "c", f"o{i}", None, i, 1.0, 1.0) for i in range(5)],
        "sales_item_key string, product_key string, customer_key string, order_number string,"
        "order_date string, quantity long, unit_price double, gross_sales_amount double",
    ).selectExpr("* except (order_date)", "date '2020-01-01' AS order_date")
    products = frame([("p", "n", "x", 1.0)] * 2, "product_key string, product_name string, category string, cost double")
    people = frame([("c", "f", "l", "x")], "customer_key string, first_name string, last_name string, country string")
    found = merged_sales(fact, products, people, limit=3)
    assert sorted(r.order_number for r in found.collect()) == ["o0", "o0", "o1"]
    assert plan(found).count("GlobalLimit") == 2


def test_the_mart_reads_the_stored_fact_and_tables_are_stored_small(spark, frame, tmp_path):
    held = f"{tmp_path}/fct_sales"
    tables.refresh_table(frame([("p", "o", "c", 1, 2.0)], "product_key string, order_number string,"
                               "customer_key string, quantity long, gross_sales_amount double")
                         .selectExpr("*", "date '2020-01-01' AS order_date"), held)
    star = {
        "fct_sales": files.read_table(spark, held),
        "dim_products": frame([("p", "n", "c", "s", 1.0)], "product_key string, product_name string,"
                              "category string, subcategory string, cost double"),
    }
    mart = loads.mart_tables(star)["product_360"]
    assert all(".zstd." in file and held in file for file in mart.inputFiles())
    assert rows(mart, "product_key", "total_orders", "total_unique_customers") == [("p", 1, 1)]
