"""Shape the shared benchmark tables like the warehouse's own layers.

Each adapter is one portable SQL text over the benchmark tables, so that any
other engine can build the very same input. Plain modular arithmetic adds the
NULLs, duplicates and bad values the cleaning rules exist for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    # --- gold shape -----------------------------------------------------
    "fct_sales": """
SELECT md5(concat(cast(l_orderkey AS string), '-', cast(l_partkey AS string))) AS sales_item_key,
       CASE WHEN o_custkey % 97 <> 0 THEN md5(cast(o_custkey AS string)) END AS customer_key,
       CASE WHEN l_partkey % 89 <> 0 THEN md5(cast(l_partkey AS string)) END AS product_key,
       cast(l_orderkey AS string) AS order_number,
       cast(o_orderdate AS date) AS order_date,
       cast(l_shipdate AS date) AS ship_date,
       cast(l_shipdate AS date) + cast(l_linenumber AS int) AS due_date,
       cast(l_quantity AS bigint) AS quantity,
       cast(l_extendedprice / l_quantity AS decimal(38, 9)) AS unit_price,
       cast(l_extendedprice AS decimal(38, 9)) AS gross_sales_amount
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "dim_products": """
SELECT md5(cast(p_partkey AS string)) AS product_key,
       p_partkey AS product_id,
       concat('P-', cast(p_partkey AS string)) AS product_number,
       p_name AS product_name,
       p_brand AS category_id,
       CASE WHEN p_partkey % 37 <> 0 THEN p_type END AS category,
       p_brand AS subcategory,
       CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END AS maintenance,
       CASE WHEN p_partkey % 499 <> 7 THEN p_retailprice END AS cost,
       CASE p_size % 3 WHEN 0 THEN 'Road' WHEN 1 THEN 'Mountain' END AS product_line,
       date '1994-01-01' + cast(p_partkey % 300 AS int) AS start_date
FROM {part}""",
    "dim_customers": """
SELECT md5(cast(c_custkey AS string)) AS customer_key,
       c_custkey AS customer_id,
       concat('AW', lpad(cast(c_custkey AS string), 8, '0')) AS customer_number,
       CASE WHEN c_custkey % 43 <> 0 THEN split_part(c_name, '#', 1) END AS first_name,
       cast(c_custkey % 800 AS string) AS last_name,
       CASE WHEN c_custkey % 41 <> 0 THEN concat('NATION_', cast(c_nationkey AS string)) END
           AS country,
       CASE c_custkey % 3 WHEN 0 THEN 'Single' WHEN 1 THEN 'Married' END AS marital_status,
       CASE c_custkey % 5 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' WHEN 2 THEN 'Male'
            WHEN 3 THEN 'Female' END AS gender,
       CASE WHEN c_custkey % 31 <> 0
            THEN date '1930-01-01' + cast((c_custkey * 37) % 20000 AS int) END AS birthdate,
       date '1994-01-01' + cast(c_custkey % 300 AS int) AS create_date
FROM {customer}""",
    # --- bronze shape, with dirt ------------------------------------------
    "crm_cust_info": """
SELECT cst_id, cst_key, cst_firstname, cst_lastname, cst_marital_status, cst_gndr,
       cst_create_date
FROM (
    SELECT CASE WHEN version = 2 THEN NULL ELSE c_custkey END AS cst_id,
           concat(CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE '' END, 'AW',
                  lpad(cast(c_custkey AS string), 8, '0')) AS cst_key,
           concat(split_part(c_name, '#', 1), CASE WHEN c_custkey % 6 = 0 THEN '  ' ELSE '' END)
               AS cst_firstname,
           CASE WHEN c_custkey % 53 = 0 THEN NULL
                ELSE concat(split_part(c_name, '#', 2), cast(version AS string)) END AS cst_lastname,
           CASE c_custkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'm ' WHEN 2 THEN 'x' END
               AS cst_marital_status,
           CASE c_custkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN ' m' WHEN 2 THEN 'n/a'
                WHEN 3 THEN 'f' END AS cst_gndr,
           cast(date '2024-01-01' + cast(c_custkey % 700 + version * 30 AS int) AS string)
               AS cst_create_date
    FROM (
        SELECT c_custkey, c_name, 0 AS version FROM {customer}
        UNION ALL SELECT c_custkey, c_name, 1 FROM {customer} WHERE c_custkey % 10 = 0
        UNION ALL SELECT c_custkey, c_name, 2 FROM {customer} WHERE c_custkey % 61 = 0
    ) AS versions
) AS copies""",
    "crm_prd_info": """
SELECT p_partkey AS prd_id,
       concat('CO-', CASE p_size % 3 WHEN 0 THEN 'PE' WHEN 1 THEN 'PD' ELSE 'RF' END, '-FR-',
              cast(p_partkey - p_partkey % 3 AS string)) AS prd_key,
       concat(p_name, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE '' END) AS prd_nm,
       CASE WHEN p_partkey % 29 <> 0 THEN p_retailprice END AS prd_cost,
       CASE p_size % 6 WHEN 0 THEN 'M ' WHEN 1 THEN 'R' WHEN 2 THEN 's ' WHEN 3 THEN 'T'
            WHEN 4 THEN 'Z' END AS prd_line,
       CASE WHEN p_partkey % 71 = 0 THEN 'unknown'
            ELSE cast(date '2011-07-01' + cast((p_partkey % 3) * 365 AS int) AS string) END
           AS prd_start_dt,
       CASE WHEN p_partkey % 2 = 0 THEN '2007-12-28' END AS prd_end_dt
FROM {part}""",
    "crm_sales_details": """
SELECT concat('SO', cast(l_orderkey AS string)) AS sls_ord_num,
       cast(l_partkey AS string) AS sls_prd_key,
       o_custkey AS sls_cust_id,
       CASE WHEN l_orderkey % 97 = 0 THEN 0 WHEN l_orderkey % 101 = 0 THEN 32154
            WHEN l_orderkey % 113 = 0 THEN NULL
            ELSE cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)
                      AS bigint) END AS sls_order_dt,
       CASE WHEN l_orderkey % 103 = 0 THEN -1
            ELSE cast(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)
                      AS bigint) END AS sls_ship_dt,
       CASE WHEN l_orderkey % 107 = 0 THEN NULL
            ELSE cast(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + 28 AS bigint) END
           AS sls_due_dt,
       CASE WHEN l_partkey % 83 = 0 THEN NULL WHEN l_partkey % 79 = 0 THEN -l_extendedprice
            ELSE l_extendedprice END AS sls_sales,
       CASE WHEN l_partkey % 131 = 0 THEN 0 ELSE cast(l_quantity AS bigint) END AS sls_quantity,
       CASE WHEN l_partkey % 89 = 0 THEN -(l_extendedprice / l_quantity)
            WHEN l_partkey % 73 = 0 THEN NULL WHEN l_partkey % 131 = 0 THEN 0.0
            ELSE l_extendedprice / l_quantity END AS sls_price
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "erp_cust_az12": """
SELECT concat(CASE WHEN c_custkey % 2 = 0 THEN 'NAS' ELSE '' END, 'AW',
              lpad(cast(c_custkey AS string), 8, '0')) AS cid,
       CASE c_custkey % 5
            WHEN 0 THEN cast(date '1940-01-01' + cast((c_custkey * 37) % 20000 AS int) AS string)
            WHEN 1 THEN replace(cast(date '1940-01-01' + cast((c_custkey * 37) % 20000 AS int)
                                     AS string), '-', '')
            WHEN 2 THEN '2999-05-17'
            WHEN 3 THEN 'not a date' END AS bdate,
       CASE c_custkey % 6 WHEN 0 THEN 'F' WHEN 1 THEN 'female ' WHEN 2 THEN ' M'
            WHEN 3 THEN 'MALE' WHEN 4 THEN 'n/a' END AS gen
FROM {customer}""",
    "erp_loc_a101": """
SELECT concat('AW-', lpad(cast(c_custkey AS string), 8, '0')) AS cid,
       CASE c_custkey % 7 WHEN 0 THEN 'DE' WHEN 1 THEN ' US ' WHEN 2 THEN 'USA' WHEN 3 THEN '  '
            WHEN 4 THEN NULL ELSE concat(n_name, ' ') END AS cntry
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "erp_px_cat_g1v2": """
SELECT DISTINCT concat('CO_', CASE p_size % 3 WHEN 0 THEN 'PX' WHEN 1 THEN 'PD' ELSE 'RF' END) AS id,
       'Components' AS cat,
       CASE p_size % 3 WHEN 0 THEN 'Posts' WHEN 1 THEN 'Pedals' ELSE 'Road Frames' END AS subcat,
       CASE p_size % 3 WHEN 1 THEN 'No' ELSE 'Yes' END AS maintenance
FROM {part}""",
    # --- telemetry shape ----------------------------------------------------
    "run_results": """
SELECT concat('run-', cast(cast(ts AS date) AS string)) AS invocation_id,
       concat(cast(cast(ts AS date) AS string), 'T06:00:00Z') AS generated_at,
       CASE event_type
            WHEN 'view' THEN concat('model.shop.m', cast(user_id AS string))
            WHEN 'signup' THEN concat('test.shop.unique_m', cast(user_id AS string), '_c',
                                      cast(event_id % 5 AS string), '.h', cast(event_id AS string))
            ELSE concat('test.shop.check', cast(event_id AS string)) END AS unique_id,
       CASE event_type WHEN 'view' THEN 'success' WHEN 'error' THEN 'error'
            WHEN 'purchase' THEN 'warn' ELSE 'pass' END AS status,
       CASE WHEN event_id % 17 <> 0 THEN value END AS execution_time,
       CASE WHEN event_type = 'error' THEN event_id % 7 END AS failures,
       CASE WHEN event_type = 'error' THEN props END AS message
FROM {events}""",
    "node_models": """
SELECT concat('model.shop.m', cast(p_partkey AS string)) AS unique_id,
       concat('m', cast(p_partkey AS string)) AS name,
       CASE WHEN p_partkey % 11 <> 0 THEN concat('m', cast(p_partkey AS string), '_v') END AS alias,
       CASE p_size % 2 WHEN 0 THEN 'gold' ELSE 'silver' END AS schema,
       'shop' AS database,
       CASE WHEN p_size % 9 = 0 THEN 0 WHEN p_partkey % 13 = 0 THEN 5
            ELSE 5 + 2 * (p_size % 9) END AS declared_columns
FROM {part}""",
    "node_tests": """
SELECT concat('test.shop.t', cast(l_orderkey AS string), '_', cast(l_linenumber AS string), '_',
              cast(l_partkey AS string)) AS unique_id,
       concat(min(l_returnflag), '_rule_', cast(l_orderkey % 3 AS string)) AS name,
       CASE WHEN l_orderkey % 19 = 0 THEN NULL
            WHEN l_orderkey % 19 = 1 THEN concat('source.shop.raw.s', cast(min(l_suppkey) AS string))
            ELSE concat('model.shop.m', cast(l_partkey AS string)) END AS attached_node,
       CASE WHEN l_orderkey % 23 <> 0 THEN concat('c', cast(l_linenumber AS string)) END
           AS column_name,
       CASE WHEN l_orderkey % 19 = 0
            THEN concat('get_where(source(', chr(39), 'raw', chr(39), ', ', chr(39), 's',
                        cast(min(l_suppkey) AS string), chr(39), '))') END AS test_model
FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_partkey""",
    "node_sources": """
SELECT concat('source.shop.raw.s', cast(s_suppkey AS string)) AS unique_id,
       'raw' AS source_name, concat('s', cast(s_suppkey AS string)) AS name,
       CASE WHEN s_suppkey % 4 <> 0 THEN concat('s', cast(s_suppkey AS string), '_raw') END
           AS identifier,
       CASE WHEN s_suppkey % 10 <> 0 THEN 'bronze' END AS schema
FROM {supplier}""",
    "test_results": """
SELECT 'run-1' AS invocation_id, '1999-01-01T00:00:20Z' AS invocation_started_at,
       '1999-01-01T00:00:23Z' AS generated_at,
       concat('test.shop.t', cast(l_orderkey AS string), '_', cast(l_linenumber AS string), '_',
              cast(l_partkey AS string)) AS unique_id,
       CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'warn' ELSE 'pass' END AS status,
       l_tax * 12.5 AS execution_time,
       CASE l_returnflag WHEN 'R' THEN l_orderkey % 7 END AS failures,
       CASE l_returnflag WHEN 'R' THEN l_linestatus END AS message
FROM {lineitem}
UNION ALL
SELECT 'run-1', '1999-01-01T00:00:20Z', '1999-01-01T00:00:23Z',
       concat('model.shop.m', cast(p_partkey AS string)), 'success', p_retailprice / 100, NULL, NULL
FROM {part}""",
    "freshness_logs": """
SELECT date_trunc('second', ts) AS check_timestamp, event_id % 300 AS freshness_lag_minutes,
       CASE WHEN event_id % 300 > 295 THEN 'STALE' WHEN event_id % 300 > 120 THEN 'DELAYED'
            ELSE 'HEALTHY' END AS status
FROM {events}""",
    "ingestion_logs": """
SELECT concat('log-', cast(event_id AS string)) AS log_id,
       date_trunc('second', ts) AS run_timestamp,
       CASE event_type WHEN 'view' THEN 'sql_copy' ELSE 'csv_load' END AS resource_type,
       concat('file_', cast(user_id AS string), '.csv') AS table_name,
       concat('bronze.t', cast(user_id AS string)) AS target_table,
       event_id AS source_rows,
       CASE WHEN event_type = 'error' THEN event_id - 1 ELSE event_id END AS destination_rows,
       CASE WHEN event_type = 'error' THEN event_id - 1 ELSE event_id END AS rows_inserted,
       value AS duration_seconds,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'pass' ELSE 'success' END
           AS status,
       CASE WHEN event_type = 'error' THEN props END AS error_message
FROM {events}""",
}

BASE_TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def base(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shaped(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One adapted table as a lazy DataFrame."""
    text = SQL[name]
    used = {t: base(spark, folder, t) for t in BASE_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def portable_sql(name: str) -> str:
    """The same table as SQL over views named like the benchmark tables."""
    return SQL[name].format(**{t: t for t in BASE_TABLES})
