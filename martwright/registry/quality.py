"""Data-quality checks and drift gates (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from martwright.operators import quality
from martwright.operators.gold import product_360
from martwright.plans.suites import all_checks, bronze_checks, gold_checks, silver_checks
from martwright.registry import GOLD, Catalog, d, r, rounded
from martwright.registry.silver import SILVER, SILVER_CTES
from martwright.registry.star import TIERS, staged

QUERIES = Catalog()


def failures(t, table: str, check: quality.Check, **more):
    return quality.suite_failures({table: getattr(t, table), **more}, [check]).select(
        "node_name", "failures"
    )


def one(name: str, where: str, table: str) -> str:
    return f"SELECT '{name}' AS node_name, count(*) AS failures FROM {table} WHERE {where}"


@QUERIES.add(
    "q01_not_null", one("not_null_fct_sales_product_key", "product_key IS NULL", "fct_sales"), GOLD[:1]
)
def _(t):
    return failures(t, "fct_sales", quality.not_null("fct_sales", "product_key"))


@QUERIES.add(
    "q02_unique",
    """
SELECT 'unique_fct_sales_sales_item_key' AS node_name, count(*) AS failures
FROM (SELECT sales_item_key FROM fct_sales WHERE sales_item_key IS NOT NULL
      GROUP BY 1 HAVING count(*) > 1)""",
    GOLD[:1],
)
def _(t):
    return failures(t, "fct_sales", quality.unique("fct_sales", "sales_item_key"))


@QUERIES.add(
    "q03_accepted_values",
    one("accepted_values_lineitem_l_returnflag", "l_returnflag NOT IN ('A', 'N')", "lineitem"),
)
def _(t):
    return failures(t, "lineitem", quality.accepted("lineitem", "l_returnflag", ["A", "N"]))


@QUERIES.add(
    "q04_relationships",
    """
SELECT 'relationships_fct_sales_product_key' AS node_name, count(*) AS failures
FROM fct_sales f WHERE product_key IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM dim_products p WHERE p.product_key = f.product_key
                  AND p.category IS NOT NULL)""",
    GOLD[:2],
)
def _(t):
    check = quality.relationships("fct_sales", "product_key", "known", "product_key")
    known = t.dim_products.filter(F.col("category").isNotNull())
    return failures(t, "fct_sales", check, known=known)


@QUERIES.add(
    "q05_expression_is_true",
    one(
        "expression_is_true_crm_sales_details_sls_order_dt",
        "NOT (sls_order_dt > 0 AND length(cast(sls_order_dt AS varchar)) = 8)",
        "crm_sales_details",
    ),
    SILVER[2:3],
)
def _(t):
    rule = "> 0 and length(cast(sls_order_dt as string)) = 8"
    check = quality.expression("crm_sales_details", "sls_order_dt", rule)
    return failures(t, "crm_sales_details", check)


@QUERIES.add(
    "q06_is_clean_trimmed",
    one(
        "is_clean_trimmed_crm_cust_info_cst_firstname",
        "cst_firstname != trim(cst_firstname) OR cst_firstname LIKE '%  %'",
        "crm_cust_info",
    ),
    SILVER[:1],
)
def _(t):
    return failures(t, "crm_cust_info", quality.clean_trimmed("crm_cust_info", "cst_firstname"))


@QUERIES.add(
    "q07_is_date_before",
    one("is_date_before_fct_sales_order_date", "order_date >= ship_date", "fct_sales"),
    GOLD[:1],
)
def _(t):
    return failures(t, "fct_sales", quality.date_before("fct_sales", "order_date", "ship_date"))


@QUERIES.add(
    "q08_is_date_before_columns",
    one(
        "is_date_before_columns_crm_sales_details_sls_order_dt",
        "sls_order_dt >= sls_ship_dt OR sls_order_dt >= sls_due_dt",
        "crm_sales_details",
    ),
    SILVER[2:3],
)
def _(t):
    others = ["sls_ship_dt", "sls_due_dt"]
    check = quality.date_before_any("crm_sales_details", "sls_order_dt", others)
    return failures(t, "crm_sales_details", check)


@QUERIES.add(
    "q09_grade",
    """
SELECT o_orderkey, o_orderkey % 4 AS failures, CASE WHEN o_custkey % 2 = 0 THEN 'warn' ELSE 'error' END
           AS severity,
       CASE WHEN o_orderkey % 4 = 0 THEN 'pass' WHEN o_custkey % 2 = 0 THEN 'warn' ELSE 'fail' END
           AS status
FROM orders""",
)
def _(t):
    results = t.orders.select(
        "o_orderkey",
        (F.col("o_orderkey") % 4).alias("failures"),
        F.when(F.col("o_custkey") % 2 == 0, "warn").otherwise("error").alias("severity"),
    )
    return quality.grade(results)


def suite_tables(t):
    """Every table of the declared suite, the gold ones as the benchmark has them."""
    s = staged(t)
    bronze = {name: getattr(t, name) for name in SILVER}
    return {
        **bronze,
        "stg_crm_cust_info": s["customers"],
        "stg_crm_prd_info": s["products"],
        "stg_crm_sales_details": s["sales"],
        "stg_erp_cust_az12": s["demographics"],
        "stg_erp_loc_a101": s["locations"],
        "stg_erp_px_cat_g1v2": s["categories"],
        "fct_sales": t.fct_sales,
        "dim_customers": t.dim_customers,
        "dim_products": t.dim_products,
        "product_360": product_360(t.fct_sales, t.dim_products, TIERS),
    }


# The same tables in SQL; the load stamp is never NULL.
SUITE_RELATIONS = {
    "stg_crm_cust_info": "stg_customer",
    "stg_crm_prd_info": "(SELECT *, 1 AS ingested_at FROM stg_product)",
    "stg_crm_sales_details": "stg_sales",
    "stg_erp_cust_az12": "stg_demographics",
    "stg_erp_loc_a101": "stg_location",
    "stg_erp_px_cat_g1v2": "stg_category",
    "product_360": "(SELECT DISTINCT product_key FROM fct_sales JOIN dim_products USING (product_key))",
}


def check_sql(check: quality.Check) -> str:
    """Failing count of a declared check, from its rule and terms alone."""
    table = SUITE_RELATIONS.get(check.table, check.table)
    column, terms = check.column, check.terms
    if check.rule == "unique":
        groups = f"SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
        count = f"SELECT count(*) FROM ({groups})"
    elif check.rule == "relationships":
        parent = SUITE_RELATIONS.get(check.parent, check.parent)
        known = f"SELECT {check.parent_column} AS k FROM {parent}"
        count = (
            f"SELECT count(*) FROM {table} AS child ANTI JOIN ({known}) AS parent ON child.{column} = k"
            f" WHERE child.{column} IS NOT NULL"
        )
    else:
        where = {
            "not_null": lambda: f"{column} IS NULL",
            "accepted_values": lambda: f"{column} NOT IN ({', '.join(repr(v) for v in terms)})",
            "expression_is_true": lambda: f"NOT ({column} {terms[0]})",
            "is_clean_trimmed": lambda: f"{column} <> trim({column}) OR {column} LIKE '%  %'",
            "is_date_before": lambda: f"{column} >= {terms[0]}",
            "is_date_before_columns": lambda: " OR ".join(f"{column} >= {other}" for other in terms),
        }[check.rule]()
        count = f"SELECT count(*) FROM {table} WHERE {where}"
    return (
        f"SELECT '{check.name}' AS node_name, '{check.table}' AS target_table,"
        f" '{column}' AS column_name, '{check.severity}' AS severity, ({count}) AS failures"
    )


def suite_sql(checks: list[quality.Check]) -> str:
    counts = "\nUNION ALL ".join(check_sql(c) for c in checks)
    return f"""{SILVER_CTES}
SELECT 'suite-1' AS execution_id, '2026-01-01 00:00:00' AS run_timestamp, 'test' AS resource_type,
       node_name, target_table, column_name,
       CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END
           AS status,
       failures AS rows_affected,
       CASE WHEN failures > 0
            THEN concat('Got ', cast(failures AS varchar), ' results, expected 0') END
           AS error_message
FROM ({counts})"""


def few_checks():
    """A suite of one's own beside the declared one."""
    return [
        quality.not_null("crm_cust_info", "cst_id", "warn"),
        quality.clean_trimmed("crm_cust_info", "cst_key", "warn"),
        quality.expression("crm_sales_details", "sls_sales", "> 0", "warn"),
        quality.unique("stg_crm_cust_info", "cst_id"),
        quality.accepted("stg_crm_cust_info", "cst_gndr", ["Male", "Female"]),
        quality.not_null("stg_crm_cust_info", "cst_lastname"),
        quality.expression("stg_crm_sales_details", "sls_quantity", "> 0"),
        quality.date_before_any(
            "stg_crm_sales_details", "sls_order_dt", ["sls_ship_dt", "sls_due_dt"]
        ),
        quality.unique("fct_sales", "sales_item_key"),
        quality.not_null("fct_sales", "customer_key"),
        quality.relationships("fct_sales", "customer_key", "dim_customers", "customer_key"),
    ]


def suite_logs(t, checks, **size):
    logs = quality.run_suite(suite_tables(t), checks, "suite-1", "2026-01-01", **size)
    return logs.drop("execution_time_seconds")


@QUERIES.add("q10_run_suite", suite_sql(few_checks()), (*SILVER, *GOLD))
def _(t):
    return suite_logs(t, few_checks())


# Both engines read a day written as a date.
DECLARED_DAY = "date '2026-01-01'"


@QUERIES.add(
    "q10_declared_suite",
    suite_sql([*bronze_checks(DECLARED_DAY), *silver_checks(DECLARED_DAY), *gold_checks()]),
    (*SILVER, *GOLD),
)
def _(t):
    # The mart and the key rules on the sales of every layer shuffle a fifth more in partitions of 8 MB.
    return suite_logs(t, all_checks("2026-01-01"), size="64m")


def shipped_fact(t):
    """The fact as an older artifact would hold it: two orders' amounts differ."""
    changed = F.col("order_number").isin("10", "11")
    return t.fct_sales.withColumn(
        "gross_sales_amount",
        F.when(changed, F.col("gross_sales_amount") + 1).otherwise(F.col("gross_sales_amount")),
    )


SHIPPED = "CASE WHEN order_number IN ('10', '11') THEN gross_sales_amount + 1 ELSE gross_sales_amount END"


MART_SUMS = ("total_sales", "total_quantity", "total_orders")
SOLD_SQL = """
SELECT f.product_key, cast(sum(gross_sales_amount) AS bigint) AS total_sales,
       cast(sum(quantity) AS bigint) AS total_quantity, count(DISTINCT order_number) AS total_orders
FROM fct_sales f JOIN dim_products p ON f.product_key = p.product_key GROUP BY 1"""


@QUERIES.add(
    "q11_table_drift",
    f"""
WITH mart AS ({SOLD_SQL})
SELECT 'fct_sales' AS table_name, 'sum_gross_sales_amount' AS measure,
       {r('sum(gross_sales_amount)')} AS built_value, {r(f'sum({SHIPPED})')} AS shipped_value
FROM fct_sales
UNION ALL SELECT 'dim_products', 'row_count', count(*),
                 count(*) FILTER (category IS NOT NULL) FROM dim_products
UNION ALL SELECT 'product_360', 'sum_total_sales', {r('sum(total_sales)')}, {r('sum(total_sales) + 7')}
          FROM mart
UNION ALL SELECT 'customer_360', 'missing from shipped', NULL, NULL""",
    GOLD,
)
def _(t):
    mart = product_360(t.fct_sales, t.dim_products, TIERS)
    # One product's sales differ in the artifact; every other sum of the mart agrees.
    one = mart.agg(F.min("product_key").alias("k")).scalar()
    changed = F.col("total_sales") + F.when(F.col("product_key") == one, 7).otherwise(0)
    built = {
        "fct_sales": t.fct_sales,
        "dim_products": t.dim_products,
        "dim_customers": t.dim_customers,
        "product_360": mart,
        "customer_360": t.dim_customers,
    }
    shipped = {
        "fct_sales": shipped_fact(t),
        "dim_products": t.dim_products.filter(F.col("category").isNotNull()),
        "dim_customers": t.dim_customers,
        "product_360": mart.withColumn("total_sales", changed),
    }
    numeric = {
        "fct_sales": ["gross_sales_amount", "unit_price", "quantity"],
        "dim_products": ["cost"],
        "dim_customers": [],
        "product_360": list(MART_SUMS),
        "customer_360": [],
    }
    return rounded(
        quality.table_drift(built, shipped, numeric), 2, "built_value", "shipped_value"
    )


@QUERIES.add(
    "q12_row_drift",
    f"""
WITH b AS (SELECT DISTINCT order_number, quantity, gross_sales_amount AS amount FROM fct_sales),
s AS (SELECT DISTINCT order_number, quantity, {SHIPPED} AS amount FROM fct_sales)
SELECT order_number, quantity, {r('amount')} AS gross_sales_amount, difference FROM (
    SELECT *, 'missing from shipped' AS difference FROM (SELECT * FROM b EXCEPT SELECT * FROM s)
    UNION ALL
    SELECT *, 'no longer built' FROM (SELECT * FROM s EXCEPT SELECT * FROM b))""",
    GOLD[:1],
)
def _(t):
    columns = ["order_number", "quantity", "gross_sales_amount"]
    drift = quality.row_drift(t.fct_sales, shipped_fact(t), columns)
    return rounded(drift, 2, "gross_sales_amount")


@QUERIES.add(
    "q13_field_drift",
    f"""
WITH b AS (SELECT count(*) AS n, {d('max(order_date)')} AS newest, max(quantity) AS largest
           FROM fct_sales),
s AS (SELECT count(*) AS n, {d('max(order_date)')} AS newest, max(quantity) AS largest
      FROM fct_sales WHERE order_date < date '2001-01-01')
SELECT 'n' AS field, cast(b.n AS varchar) AS built_value, cast(s.n AS varchar) AS shipped_value
FROM b, s
UNION ALL SELECT 'newest', b.newest, s.newest FROM b, s""",
    GOLD[:1],
)
def _(t):
    def summary(fact):
        return fact.agg(
            F.count(F.lit(1)).alias("n"),
            F.max("order_date").alias("newest"),
            F.max("quantity").alias("largest"),
        )

    older = t.fct_sales.filter(F.col("order_date") < F.lit("2001-01-01").cast("date"))
    return quality.field_drift(summary(t.fct_sales), summary(older), ["n", "newest", "largest"])


@QUERIES.add(
    "q14_latest_drift",
    """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY target_table
               ORDER BY run_timestamp DESC, cast(source_rows AS varchar) DESC) AS n
           FROM ingestion_logs),
b AS (SELECT * FROM l WHERE n = 1 AND target_table <> 'bronze.t3'),
o AS (SELECT *, row_number() OVER (PARTITION BY target_table
               ORDER BY run_timestamp DESC, cast(source_rows AS varchar) DESC) AS m
      FROM (SELECT * EXCLUDE (n) FROM l)
      WHERE run_timestamp < timestamp '2024-01-28 00:00:00' AND target_table <> 'bronze.t4'),
s AS (SELECT * FROM o WHERE m = 1),
j AS (SELECT coalesce(b.target_table, s.target_table) AS target_table,
             b.target_table IS NOT NULL AS in_b, s.target_table IS NOT NULL AS in_s,
             cast(b.source_rows AS varchar) AS b1, cast(s.source_rows AS varchar) AS s1,
             cast(b.destination_rows AS varchar) AS b2, cast(s.destination_rows AS varchar) AS s2,
             b.status AS b3, s.status AS s3
      FROM b FULL JOIN s ON b.target_table = s.target_table)
SELECT target_table, '*' AS field, CASE WHEN in_b THEN 'present' END AS built_value,
       CASE WHEN in_s THEN 'present' END AS shipped_value FROM j WHERE in_b <> in_s
UNION ALL SELECT target_table, 'source_rows', b1, s1 FROM j WHERE in_b AND in_s AND b1 <> s1
UNION ALL SELECT target_table, 'destination_rows', b2, s2 FROM j WHERE in_b AND in_s AND b2 <> s2
UNION ALL SELECT target_table, 'status', b3, s3 FROM j WHERE in_b AND in_s AND b3 <> s3""",
    ("ingestion_logs",),
)
def _(t):
    built = t.ingestion_logs.filter("target_table <> 'bronze.t3'")
    shipped = t.ingestion_logs.filter(
        "run_timestamp < timestamp '2024-01-28 00:00:00' AND target_table <> 'bronze.t4'"
    )
    return quality.latest_drift(
        built, shipped, "target_table", "run_timestamp", ["source_rows", "destination_rows", "status"]
    )
