import datetime as dt
import random

import pytest
from conftest import row_set, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from martwright.operators import gold, silver

CUSTOMER = (
    "cst_id long, cst_key string, cst_firstname string, cst_lastname string,"
    "cst_marital_status string, cst_gndr string, cst_create_date string"
)


def test_customer_keeps_the_newest_row_and_cleans_it(frame):
    bronze = frame(
        [
            (1, " AW1 ", "Ann ", " Lee", "s", "f ", "2024-01-01"),
            (1, "AW1", "Anna", "Lee", "M", "n/a", "2024-03-01"),
            (None, "AW2", "No", "Id", "S", "M", "2024-01-01"),
            (3, "AW3", None, "Poe", None, " m", None),
        ],
        CUSTOMER,
    )
    got = silver.stg_customer(bronze, "2026-01-01")
    assert row_set(got.drop("ingested_at")) == [
        (1, "AW1", "Anna", "Lee", "Married", None, dt.date(2024, 3, 1)),
        (3, "AW3", None, "Poe", None, "Male", None),
    ]


def test_latest_row_matches_a_window_on_random_versions(frame):
    pick = random.Random(3)
    data = [
        ("hot" if i % 3 else f"k{pick.randrange(20)}", i, f"2024-01-{pick.randrange(1, 28):02d}")
        for i in range(500)
    ]
    df = frame(data, "key string, id long, at string")
    stamp = F.col("at").cast("timestamp")
    order = Window.partitionBy("key").orderBy(stamp.desc(), F.desc("id"))
    expected = df.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    assert row_set(silver.latest_per_key(df, "key", stamp, ["id"])) == row_set(expected)


def test_product_versions_end_the_day_before_the_next(frame):
    df = frame(
        [
            (1, "AC-HE-HL-U509", "2011-07-01"),
            (2, "AC-HE-HL-U509", "2012-07-01"),
            (3, "AC-HE-HL-U509", "2013-07-01"),
            (4, "CO-RF-FR-R92B", "2003-07-01"),
        ],
        "prd_id long, prd_key string, prd_start_dt string",
    )
    got = silver.version_end_date(df, "prd_key", "prd_start_dt", "prd_id")
    assert row_set(got, "prd_id", "prd_end_dt") == [
        (1, dt.date(2012, 6, 30)),
        (2, dt.date(2013, 6, 30)),
        (3, None),
        (4, None),
    ]


def test_version_end_matches_lead_with_ties_and_nulls(frame):
    pick = random.Random(5)
    starts = [None, "bad", "2011-01-01", "2012-01-01", "2013-01-01"]
    data = [(i, "hot" if i % 3 else f"k{i % 7}", pick.choice(starts)) for i in range(200)]
    df = frame(data, "id long, key string, start string")
    order = Window.partitionBy("key").orderBy(F.asc_nulls_last("start"), "id")
    expected = df.withColumn(
        "end", F.date_sub(F.lead("start").over(order).try_cast("date"), 1)
    )
    got = silver.version_end_date(df, "key", "start", "id", "end")
    assert row_set(got, "id", "end") == row_set(expected, "id", "end")


def test_product_is_split_decoded_and_defaulted(frame):
    bronze = frame(
        [(212, "AC-HE-HL-U509-R", " Helmet ", None, "S ", "2011-07-01", "2007-12-28")],
        "prd_id long, prd_key string, prd_nm string, prd_cost double, prd_line string,"
        "prd_start_dt string, prd_end_dt string",
    )
    assert rows(silver.stg_product(bronze, "2026-01-01").drop("ingested_at")) == [
        (212, "AC_HE", "HL-U509-R", "Helmet", 0.0, "Standard", dt.date(2011, 7, 1), None)
    ]


SALES = (
    "sls_ord_num string, sls_prd_key string, sls_cust_id long, sls_order_dt long, sls_ship_dt long,"
    "sls_due_dt long, sls_sales double, sls_quantity long, sls_price double"
)


def test_sales_dates_and_amounts_are_repaired(frame):
    bronze = frame(
        [
            ("a", "p", 1, 20240105, 20240101, None, None, 2, -10.0),
            ("b", "p", 1, 0, 20240101, 20240110, 30.0, 3, None),
            ("c", "p", 1, 5489, None, 0, -5.0, 0, 0.0),
            ("d", "p", 1, None, 20240107, 20240112, 40.0, 2, 20.0),
        ],
        SALES,
    )
    got = silver.stg_sales(bronze).select(
        "sls_ord_num",
        F.col("sls_order_dt").cast("string"),
        F.col("sls_ship_dt").cast("string"),
        F.col("sls_due_dt").cast("string"),
        "sls_price",
        "sls_sales",
    )
    assert row_set(got) == [
        ("a", "2024-01-05", "2024-01-05", "2024-01-05", 10.0, 20.0),
        ("b", "1900-01-01", "2024-01-01", "2024-01-10", 10.0, 30.0),
        ("c", "1900-01-01", "1900-01-01", "1900-01-01", None, None),
        ("d", "1900-01-01", "2024-01-07", "2024-01-12", 20.0, 40.0),
    ]


def test_eight_digits_that_are_no_date_raise(frame):
    bronze = frame([("a", "p", 1, 20241399, None, None, 1.0, 1, 1.0)], SALES)
    with pytest.raises(Exception):
        silver.stg_sales(bronze).collect()


def test_demographics_location_and_category(frame):
    demo = frame(
        [("NASAW1", "1980-02-03", "F"), ("AW2", "2999-01-01", "male "), ("AW3", "x", "?")],
        "cid string, bdate string, gen string",
    )
    got = silver.stg_demographics(demo, today="2026-01-01").drop("ingested_at")
    assert rows(got) == [
        ("AW1", dt.date(1980, 2, 3), "Female"),
        ("AW2", None, "Male"),
        ("AW3", None, None),
    ]
    loc = frame(
        [("AW-1", "DE"), ("AW-2", " USA "), ("AW-3", "  "), ("AW-4", None), ("AW-5", "France ")],
        "cid string, cntry string",
    )
    assert rows(silver.stg_location(loc).drop("ingested_at")) == [
        ("AW1", "Germany"),
        ("AW2", "United States"),
        ("AW3", None),
        ("AW4", None),
        ("AW5", "France"),
    ]
    cat = frame(
        [("CO_PD", "Components", "Pedals", "No"), ("AC_HE", "Accessories", "Helmets", "Yes")],
        "id string, cat string, subcat string, maintenance string",
    )
    assert [r[0] for r in rows(silver.stg_category(cat))] == ["CO_PE", "AC_HE"]


FACT = (
    "sales_item_key string, customer_key string, product_key string, order_number string,"
    "order_date date, quantity long, unit_price decimal(38,9), gross_sales_amount decimal(38,9)"
)


def fact_rows(frame):
    from decimal import Decimal as D

    data = [
        ("s1", "c1", "p1", "o1", dt.date(2020, 1, 15), 2, D(100), D(200)),
        ("s2", "c1", "p1", "o2", dt.date(2021, 3, 1), 1, D(60000), D("60000.5")),
        ("s3", "c2", "p2", "o3", dt.date(2021, 3, 31), 0, D(0), D(0)),
        ("s4", None, "p9", "o4", dt.date(2022, 1, 1), 1, D(1), D(1)),
    ]
    return frame(data, FACT)


def test_product_mart_tiers_and_safe_ratios(frame):
    products = frame(
        [("p1", "Bike", "Bikes", "Road", 10.0), ("p2", "Cap", None, None, 1.0)],
        "product_key string, product_name string, category string, subcategory string, cost double",
    )
    got = {r.product_key: r for r in gold.product_360(fact_rows(frame), products).collect()}
    assert set(got) == {"p1", "p2"}
    bike, cap = got["p1"], got["p2"]
    assert (bike.total_orders, bike.total_sales, bike.total_unique_customers) == (2, 60201, 1)
    assert bike.product_segment == "High-Performer"
    assert (bike.lifespan_days, bike.lifespan_months) == (411, 13.5)
    assert bike.recency_months == 10  # anchor 2022-01-01 counts although its product is unknown
    assert cap.avg_selling_price is None and cap.avg_monthly_revenue == 0.0
    assert (cap.lifespan_days, cap.lifespan_months) == (0, 1.0)


def many_sales(spark):
    """One product with most sales, keys as hex digits and as other text, repeats and NULLs."""
    i = F.col("id")
    return spark.range(6000).select(
        F.lit("s").alias("sales_item_key"),
        F.when(i % 7 > 0, F.md5((i % 50).cast("string"))).alias("customer_key"),
        F.when(i % 3 > 0, F.md5(F.lit("hot")))
        .when(i % 31 == 0, F.upper(F.md5(F.lit("hot"))))
        .when(i % 11 > 0, F.concat(F.lit("p"), (i % 40).cast("string")))
        .alias("product_key"),
        F.when(i % 13 > 0, (i / 2).cast("long").cast("string")).alias("order_number"),
        F.date_add(F.lit("2020-01-01").cast("date"), (i % 900).cast("int")).alias("order_date"),
        (i % 4).alias("quantity"),
        F.lit(1).cast("decimal(38,9)").alias("unit_price"),
        (i % 100).cast("decimal(38,9)").alias("gross_sales_amount"),
    )


@pytest.mark.parametrize("crowd", [500_000, 1])
def test_sold_products_of_quiet_and_crowded_ones(spark, crowd):
    sales = many_sales(spark)
    found = sales.select(gold.crowded_products(sales.filter("product_key is not null"), crowd)).first()[0]
    assert (len(found) > 0) == (crowd == 1)
    plain = sales.filter("product_key is not null").groupBy("product_key").agg(
        F.count_distinct("order_number").alias("total_orders"),
        F.sum("gross_sales_amount").alias("total_sales"),
        F.sum("quantity").alias("total_quantity"),
        F.count_distinct("customer_key").alias("total_unique_customers"),
        F.max("order_date").alias("last_sale_date"),
        F.min("order_date").alias("_first"),
    )
    sold = gold.sold_products(sales, crowd)
    assert sold.dtypes == plain.dtypes
    assert row_set(sold) == row_set(plain) and sold.count() > 30


def test_product_mart_shuffles_a_sale_once(spark, frame):
    """Only sales of crowded products are doubled for the two distinct counts."""
    products = frame([], "product_key string, product_name string, category string, subcategory string, cost double")
    mart = gold.product_360(many_sales(spark), products)
    plan = mart._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [product_key") == 1
    assert plan.count("Expand") == 1


def test_customer_mart_segments(frame):
    customers = frame(
        [("c1", "AW1", "A", "B", dt.date(1980, 6, 1)), ("c2", "AW2", "C", "D", None)],
        "customer_key string, customer_number string, first_name string, last_name string,"
        "birthdate date",
    )
    got = {r.customer_key: r for r in gold.customer_360(fact_rows(frame), customers).collect()}
    assert got["c1"].customer_segment == "VIP" and got["c1"].age == 42
    assert got["c1"].age_group == "40-49" and got["c1"].customer_name == "A B"
    # A missing age falls in the last band, as the report defines it.
    assert got["c2"].age is None and got["c2"].age_group == "50 and above"
    assert got["c2"].customer_segment == "New"
