"""Cleaning rules (V) over the deliberately dirty bronze shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from martwright.operators import silver
from martwright.registry import Catalog, d, r, rounded

QUERIES = Catalog()

TODAY = "2026-01-01"

SILVER = (
    "crm_cust_info",
    "crm_prd_info",
    "crm_sales_details",
    "erp_cust_az12",
    "erp_loc_a101",
    "erp_px_cat_g1v2",
)

LATEST_SQL = """
SELECT cst_id, cst_key, cst_firstname, cst_lastname, cst_marital_status, cst_gndr, cst_create_date
FROM (SELECT *, row_number() OVER (PARTITION BY cst_id
                                   ORDER BY cast(cst_create_date AS timestamp) DESC) AS n
      FROM crm_cust_info WHERE cst_id IS NOT NULL) WHERE n = 1"""

STG_CUSTOMER_SQL = f"""
SELECT cst_id, trim(cst_key) AS cst_key, trim(cst_firstname) AS cst_firstname,
       trim(cst_lastname) AS cst_lastname,
       CASE upper(trim(cst_marital_status)) WHEN 'S' THEN 'Single' WHEN 'M' THEN 'Married' END
           AS cst_marital_status,
       CASE upper(trim(cst_gndr)) WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' END AS cst_gndr,
       cast(cst_create_date AS date) AS cst_create_date
FROM ({LATEST_SQL})"""

STG_PRODUCT_SQL = """
SELECT prd_id, replace(substr(prd_key, 1, 5), '-', '_') AS cat_id,
       substr(prd_key, 7) AS prd_key, trim(prd_nm) AS prd_nm, coalesce(prd_cost, 0) AS prd_cost,
       CASE upper(trim(prd_line)) WHEN 'M' THEN 'Mountain' WHEN 'R' THEN 'Road'
            WHEN 'S' THEN 'Standard' WHEN 'T' THEN 'Touring' END AS prd_line,
       try_cast(prd_start_dt AS date) AS prd_start_dt,
       cast(try_cast(lead(prd_start_dt) OVER (PARTITION BY prd_key
                                              ORDER BY prd_start_dt, prd_id) AS date)
            - INTERVAL 1 DAY AS date) AS prd_end_dt
FROM crm_prd_info"""

_DATE = """CASE WHEN {0} > 0 AND length(cast({0} AS varchar)) = 8
       THEN cast(strptime(cast({0} AS varchar), '%Y%m%d') AS date) END"""

STG_SALES_SQL = f"""
SELECT sls_ord_num, sls_prd_key, sls_cust_id, o AS sls_order_dt,
       greatest(coalesce(s, o), o) AS sls_ship_dt, greatest(coalesce(u, o), o) AS sls_due_dt,
       sls_quantity, p AS sls_price,
       CASE WHEN sls_sales IS NULL OR sls_sales <= 0 THEN sls_quantity * p ELSE sls_sales END
           AS sls_sales
FROM (SELECT *, coalesce({_DATE.format('sls_order_dt')}, date '1900-01-01') AS o,
             {_DATE.format('sls_ship_dt')} AS s, {_DATE.format('sls_due_dt')} AS u,
             CASE WHEN sls_price IS NULL OR sls_price = 0 THEN sls_sales / nullif(sls_quantity, 0)
                  ELSE abs(sls_price) END AS p
      FROM crm_sales_details)"""

STG_DEMOGRAPHICS_SQL = f"""
SELECT cid, CASE WHEN b <= date '{TODAY}' THEN b END AS bdate, gen
FROM (SELECT CASE WHEN starts_with(cid, 'NAS') THEN substr(cid, 4) ELSE cid END AS cid,
             cast(coalesce(try_strptime(bdate, '%Y-%m-%d'), try_strptime(bdate, '%Y%m%d')) AS date)
                 AS b,
             CASE WHEN upper(trim(gen)) IN ('F', 'FEMALE') THEN 'Female'
                  WHEN upper(trim(gen)) IN ('M', 'MALE') THEN 'Male' END AS gen
      FROM erp_cust_az12)"""

STG_LOCATION_SQL = """
SELECT replace(cid, '-', '') AS cid,
       CASE WHEN trim(cntry) = 'DE' THEN 'Germany'
            WHEN trim(cntry) IN ('US', 'USA') THEN 'United States'
            WHEN trim(cntry) = '' THEN NULL ELSE trim(cntry) END AS cntry
FROM erp_loc_a101"""

STG_CATEGORY_SQL = """
SELECT CASE WHEN id = 'CO_PD' THEN 'CO_PE' ELSE id END AS id, cat, subcat, maintenance
FROM erp_px_cat_g1v2"""

SILVER_CTES = f"""WITH stg_customer AS ({STG_CUSTOMER_SQL}),
stg_product AS ({STG_PRODUCT_SQL}),
stg_sales AS ({STG_SALES_SQL}),
stg_demographics AS ({STG_DEMOGRAPHICS_SQL}),
stg_location AS ({STG_LOCATION_SQL}),
stg_category AS ({STG_CATEGORY_SQL})
"""


@QUERIES.add("v01_latest_per_key", LATEST_SQL, SILVER[:1])
def _(t):
    return silver.latest_per_key(
        t.crm_cust_info, "cst_id", F.col("cst_create_date").cast("timestamp")
    )


@QUERIES.add(
    "v02_decode_codes",
    """
SELECT cst_marital_status AS raw_status, cst_gndr AS raw_gender,
       CASE upper(trim(cst_marital_status)) WHEN 'S' THEN 'Single' WHEN 'M' THEN 'Married' END
           AS marital_status,
       CASE upper(trim(cst_gndr)) WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' END AS gender
FROM crm_cust_info""",
    SILVER[:1],
)
def _(t):
    return t.crm_cust_info.select(
        F.col("cst_marital_status").alias("raw_status"),
        F.col("cst_gndr").alias("raw_gender"),
        silver.decode("cst_marital_status", silver.MARITAL_STATUS).alias("marital_status"),
        silver.decode("cst_gndr", silver.GENDER).alias("gender"),
    )


@QUERIES.add(
    "v03_clean_text",
    """
SELECT prd_id, trim(prd_nm) AS prd_nm, cast(try_cast(prd_start_dt AS date) AS varchar)
           AS prd_start_dt
FROM crm_prd_info""",
    SILVER[1:2],
)
def _(t):
    return silver.clean_text(
        t.crm_prd_info.select("prd_id", "prd_nm", "prd_start_dt"),
        ["prd_nm"],
        {"prd_start_dt": "date"},
    )


@QUERIES.add(
    "v04_split_product_key",
    """
SELECT prd_id, replace(substr(prd_key, 1, 5), '-', '_') AS cat_id, substr(prd_key, 7) AS prd_key
FROM crm_prd_info""",
    SILVER[1:2],
)
def _(t):
    return silver.split_product_key(t.crm_prd_info.select("prd_id", "prd_key"), "prd_key")


@QUERIES.add(
    "v05_clean_product",
    """
SELECT prd_id, trim(prd_nm) AS prd_nm, coalesce(prd_cost, 0) AS prd_cost,
       CASE upper(trim(prd_line)) WHEN 'M' THEN 'Mountain' WHEN 'R' THEN 'Road'
            WHEN 'S' THEN 'Standard' WHEN 'T' THEN 'Touring' END AS prd_line
FROM crm_prd_info""",
    SILVER[1:2],
)
def _(t):
    return silver.clean_product(t.crm_prd_info.select("prd_id", "prd_nm", "prd_cost", "prd_line"))


@QUERIES.add(
    "v06_version_end_date",
    """
SELECT prd_id, prd_key, prd_start_dt,
       cast(cast(try_cast(lead(prd_start_dt) OVER (PARTITION BY prd_key
                                                   ORDER BY prd_start_dt, prd_id) AS date)
                 - INTERVAL 1 DAY AS date) AS varchar) AS prd_end_dt
FROM crm_prd_info""",
    SILVER[1:2],
)
def _(t):
    versions = t.crm_prd_info.select("prd_id", "prd_key", "prd_start_dt")
    return silver.version_end_date(versions, "prd_key", "prd_start_dt", "prd_id")


@QUERIES.add(
    "v07_int_date_parse",
    f"""
SELECT sls_ord_num, sls_prd_key, sls_order_dt AS raw_date,
       {d("coalesce(" + _DATE.format('sls_order_dt') + ", date '1900-01-01')")} AS order_date,
       {d(_DATE.format('sls_ship_dt'))} AS ship_date
FROM crm_sales_details""",
    SILVER[2:3],
)
def _(t):
    return t.crm_sales_details.select(
        "sls_ord_num",
        "sls_prd_key",
        F.col("sls_order_dt").alias("raw_date"),
        silver.int_date("sls_order_dt", silver.MISSING_ORDER_DATE).alias("order_date"),
        silver.int_date("sls_ship_dt").alias("ship_date"),
    )


@QUERIES.add(
    "v08_repair_price",
    f"""
SELECT sls_ord_num, sls_prd_key,
       {r('''CASE WHEN sls_price IS NULL OR sls_price = 0 THEN sls_sales / nullif(sls_quantity, 0)
                  ELSE abs(sls_price) END''', 8)} AS price
FROM crm_sales_details""",
    SILVER[2:3],
)
def _(t):
    price = silver.repair_price("sls_price", "sls_sales", "sls_quantity").alias("price")
    return rounded(t.crm_sales_details.select("sls_ord_num", "sls_prd_key", price), 8, "price")


@QUERIES.add(
    "v09_clamp_after",
    SILVER_CTES
    + f"""
SELECT sls_ord_num, sls_prd_key, {d('sls_ship_dt')} AS ship_date, {d('sls_due_dt')} AS due_date
FROM stg_sales""",
    SILVER,
)
def _(t):
    order = silver.int_date("sls_order_dt", silver.MISSING_ORDER_DATE)
    return t.crm_sales_details.select(
        "sls_ord_num",
        "sls_prd_key",
        silver.clamp_after(silver.int_date("sls_ship_dt"), order).alias("ship_date"),
        silver.clamp_after(silver.int_date("sls_due_dt"), order).alias("due_date"),
    )


@QUERIES.add(
    "v10_repair_sales",
    SILVER_CTES
    + f"""
SELECT sls_ord_num, sls_prd_key, sls_quantity, {r('sls_sales', 4)} AS sales FROM stg_sales""",
    SILVER,
)
def _(t):
    price = silver.repair_price("sls_price", "sls_sales", "sls_quantity")
    sales = silver.repair_sales("sls_sales", "sls_quantity", price).alias("sales")
    return rounded(
        t.crm_sales_details.select("sls_ord_num", "sls_prd_key", "sls_quantity", sales), 4, "sales"
    )


@QUERIES.add(
    "v11_strip_prefix",
    """
SELECT cid AS raw_id, CASE WHEN starts_with(cid, 'NAS') THEN substr(cid, 4) ELSE cid END AS cid
FROM erp_cust_az12""",
    SILVER[3:4],
)
def _(t):
    return t.erp_cust_az12.select(F.col("cid").alias("raw_id"), silver.strip_prefix("cid").alias("cid"))


PARSED = """cast(coalesce(try_strptime(bdate, '%Y-%m-%d'), try_strptime(bdate, '%Y%m%d')) AS date)"""


@QUERIES.add(
    "v12_parse_date_any",
    f"SELECT cid, bdate AS raw_date, {d(PARSED)} AS birthdate FROM erp_cust_az12",
    SILVER[3:4],
)
def _(t):
    return t.erp_cust_az12.select(
        "cid", F.col("bdate").alias("raw_date"), silver.parse_date_any("bdate").alias("birthdate")
    )


@QUERIES.add(
    "v13_decode_set",
    """
SELECT cid, CASE WHEN upper(trim(gen)) IN ('F', 'FEMALE') THEN 'Female'
                 WHEN upper(trim(gen)) IN ('M', 'MALE') THEN 'Male' END AS gender
FROM erp_cust_az12""",
    SILVER[3:4],
)
def _(t):
    return t.erp_cust_az12.select(
        "cid", silver.decode_set("gen", silver.GENDER_SETS).alias("gender")
    )


@QUERIES.add(
    "v14_null_if_future",
    f"""
SELECT cid, CASE WHEN {PARSED} <= date '{TODAY}' THEN {d(PARSED)} END AS birthdate
FROM erp_cust_az12""",
    SILVER[3:4],
)
def _(t):
    born = silver.null_if_future(silver.parse_date_any("bdate"), TODAY)
    return t.erp_cust_az12.select("cid", born.alias("birthdate"))


@QUERIES.add("v15_standardize_country", STG_LOCATION_SQL, SILVER[4:5])
def _(t):
    return silver.standardize_country(t.erp_loc_a101)


@QUERIES.add(
    "v16_remap",
    """
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'STANDARD' ELSE p_type END AS p_type FROM part""",
)
def _(t):
    return silver.remap(t.part.select("p_partkey", "p_type"), "p_type", {"PROMO": "STANDARD"})


@QUERIES.add(
    "v17_load_stamp",
    f"""
SELECT cid, '{TODAY} 00:00:00' AS ingested_at FROM erp_loc_a101""",
    SILVER[4:5],
)
def _(t):
    return silver.with_load_stamp(t.erp_loc_a101.select("cid"), TODAY)


@QUERIES.add(
    "v18_stg_customer",
    SILVER_CTES
    + f"SELECT * REPLACE ({d('cst_create_date')} AS cst_create_date) FROM stg_customer",
    SILVER,
)
def _(t):
    return silver.stg_customer(t.crm_cust_info).drop("ingested_at")


@QUERIES.add(
    "v19_stg_product",
    SILVER_CTES
    + f"""SELECT * REPLACE ({d('prd_start_dt')} AS prd_start_dt, {d('prd_end_dt')} AS prd_end_dt)
FROM stg_product""",
    SILVER,
)
def _(t):
    return silver.stg_product(t.crm_prd_info).drop("ingested_at")


@QUERIES.add(
    "v20_stg_sales",
    SILVER_CTES
    + f"""SELECT * REPLACE ({d('sls_order_dt')} AS sls_order_dt, {d('sls_ship_dt')} AS sls_ship_dt,
    {d('sls_due_dt')} AS sls_due_dt, {r('sls_price', 8)} AS sls_price,
    {r('sls_sales', 8)} AS sls_sales) FROM stg_sales""",
    SILVER,
)
def _(t):
    return rounded(
        silver.stg_sales(t.crm_sales_details).drop("ingested_at"), 8, "sls_price", "sls_sales"
    )


@QUERIES.add(
    "v21_stg_demographics",
    SILVER_CTES + f"SELECT * REPLACE ({d('bdate')} AS bdate) FROM stg_demographics",
    SILVER,
)
def _(t):
    return silver.stg_demographics(t.erp_cust_az12, today=TODAY).drop("ingested_at")


@QUERIES.add("v22_stg_location", SILVER_CTES + "SELECT * FROM stg_location", SILVER)
def _(t):
    return silver.stg_location(t.erp_loc_a101).drop("ingested_at")


@QUERIES.add("v23_stg_category", SILVER_CTES + "SELECT * FROM stg_category", SILVER)
def _(t):
    return silver.stg_category(t.erp_px_cat_g1v2).drop("ingested_at")
