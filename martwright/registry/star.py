"""Gold marts (G), star analyses (A) and notebook analyses (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from martwright.functions.columns import surrogate_key
from martwright.operators import analyses, gold, silver
from martwright.registry import GOLD, MERGED, MERGED_SINCE, Catalog, d, r, rounded
from martwright.registry.silver import SILVER, SILVER_CTES
from martwright.sources.star import merged_sales

QUERIES = Catalog()
SINCE = "1996-01-01"
TIERS = (1_000_000, 1_400_000)
VIP = 1_500_000
COST_EDGES = (925, 950, 1000)


def merged(t):
    if "merged" in t.stored:
        return t.merged
    return merged_sales(t.fct_sales, t.dim_products, t.dim_customers, MERGED_SINCE)


def staged(t):
    return {
        "customers": silver.stg_customer(t.crm_cust_info, "2026-01-01"),
        "products": silver.stg_product(t.crm_prd_info, "2026-01-01"),
        "sales": silver.stg_sales(t.crm_sales_details, "2026-01-01"),
        "demographics": silver.stg_demographics(t.erp_cust_az12, "2026-01-01", "2026-01-01"),
        "locations": silver.stg_location(t.erp_loc_a101, "2026-01-01"),
        "categories": silver.stg_category(t.erp_px_cat_g1v2, "2026-01-01"),
    }


@QUERIES.add(
    "g01_surrogate_key",
    """
SELECT order_number, quantity,
       md5(concat(order_number, '-', coalesce(product_key, '_dbt_utils_surrogate_key_null_'), '-',
                  cast(quantity AS varchar))) AS item_key
FROM fct_sales""",
    GOLD[:1],
)
def _(t):
    return t.fct_sales.select(
        "order_number",
        "quantity",
        surrogate_key("order_number", "product_key", "quantity").alias("item_key"),
    )


DIM_CUSTOMERS_SQL = f"""
SELECT md5(cast(c.cst_id AS varchar)) AS customer_key, c.cst_id AS customer_id,
       c.cst_key AS customer_number, c.cst_firstname AS first_name, c.cst_lastname AS last_name,
       l.cntry AS country, c.cst_marital_status AS marital_status,
       coalesce(c.cst_gndr, e.gen) AS gender, {d('e.bdate')} AS birthdate,
       {d('c.cst_create_date')} AS create_date
FROM stg_customer c LEFT JOIN stg_demographics e ON c.cst_key = e.cid
LEFT JOIN stg_location l ON c.cst_key = l.cid"""

DIM_PRODUCTS_SQL = f"""
SELECT md5(cast(p.prd_id AS varchar)) AS product_key, p.prd_id AS product_id,
       p.prd_key AS product_number, p.prd_nm AS product_name, p.cat_id AS category_id,
       c.cat AS category, c.subcat AS subcategory, c.maintenance, p.prd_cost AS cost,
       p.prd_line AS product_line, {d('p.prd_start_dt')} AS start_date
FROM stg_product p LEFT JOIN stg_category c ON p.cat_id = c.id
WHERE p.prd_end_dt IS NULL"""


@QUERIES.add("g02_dim_customers", SILVER_CTES + DIM_CUSTOMERS_SQL, SILVER)
def _(t):
    s = staged(t)
    return gold.dim_customers(s["customers"], s["demographics"], s["locations"])


@QUERIES.add("g03_dim_products", SILVER_CTES + DIM_PRODUCTS_SQL, SILVER)
def _(t):
    s = staged(t)
    return gold.dim_products(s["products"], s["categories"])


def built_fact(t):
    s = staged(t)
    customers = gold.dim_customers(s["customers"], s["demographics"], s["locations"])
    # The fixture's sales name products by id, so the dimension is looked up by it.
    products = t.dim_products.withColumn("product_number", F.col("product_id").cast("string"))
    return gold.fct_sales(s["sales"], customers, products)


@QUERIES.add(
    "g04_fct_sales",
    SILVER_CTES
    + f"""
SELECT md5(concat(s.sls_ord_num, '-', s.sls_prd_key)) AS sales_item_key,
       md5(cast(c.cst_id AS varchar)) AS customer_key, p.product_key,
       s.sls_ord_num AS order_number, {d('s.sls_order_dt')} AS order_date,
       {d('s.sls_ship_dt')} AS ship_date, {d('s.sls_due_dt')} AS due_date,
       s.sls_quantity AS quantity, {r('cast(s.sls_price AS decimal(38, 9))', 6)} AS unit_price,
       {r('cast(s.sls_sales AS decimal(38, 9))', 6)} AS gross_sales_amount
FROM stg_sales s LEFT JOIN stg_customer c ON s.sls_cust_id = c.cst_id
LEFT JOIN dim_products p ON s.sls_prd_key = cast(p.product_id AS varchar)""",
    (*SILVER, "dim_products"),
)
def _(t):
    return rounded(built_fact(t), 6, "unit_price", "gross_sales_amount")


MONTHS = "((year({0}) - year({1})) * 12 + month({0}) - month({1}))"


@QUERIES.add(
    "g05_product_360",
    f"""
WITH sold AS (
    SELECT product_key, count(DISTINCT order_number) AS total_orders,
           cast(sum(gross_sales_amount) AS bigint) AS total_sales,
           cast(sum(quantity) AS bigint) AS total_quantity,
           count(DISTINCT customer_key) AS total_unique_customers,
           max(order_date) AS last_order, min(order_date) AS first_order,
           (SELECT max(order_date) FROM fct_sales) AS anchor
    FROM fct_sales GROUP BY product_key),
shaped AS (
    SELECT *, date_diff('day', first_order, last_order) AS lifespan_days,
           greatest({r("date_diff('day', first_order, last_order) / 30.4375", 1)}, 1.0)
               AS lifespan_months
    FROM sold)
SELECT p.product_key, p.product_name, p.category, p.subcategory, p.cost,
       {d('last_order')} AS last_sale_date,
       {MONTHS.format('anchor', 'last_order')} AS recency_months,
       CASE WHEN total_sales > {TIERS[1]} THEN 'High-Performer'
            WHEN total_sales >= {TIERS[0]} THEN 'Mid-Range' ELSE 'Low-Performer' END
           AS product_segment,
       lifespan_days, lifespan_months, total_orders, total_sales, total_quantity,
       total_unique_customers,
       {r('total_sales / nullif(total_quantity, 0)')} AS avg_selling_price,
       {r('total_sales / nullif(total_orders, 0)')} AS avg_order_revenue,
       round(total_sales / lifespan_months, 2) AS avg_monthly_revenue
FROM shaped s JOIN dim_products p ON s.product_key = p.product_key""",
    GOLD[:2],
)
def _(t):
    return gold.product_360(t.fct_sales, t.dim_products, TIERS)


@QUERIES.add(
    "g06_customer_360",
    f"""
WITH bought AS (
    SELECT customer_key, count(DISTINCT order_number) AS total_orders,
           cast(sum(gross_sales_amount) AS bigint) AS total_sales,
           cast(sum(quantity) AS bigint) AS total_quantity, count(product_key) AS total_products,
           max(order_date) AS last_order,
           {MONTHS.format('max(order_date)', 'min(order_date)')} AS lifespan_months,
           (SELECT max(order_date) FROM fct_sales) AS anchor
    FROM fct_sales GROUP BY customer_key),
aged AS (
    SELECT b.*, c.customer_number,
           CASE WHEN c.first_name IS NOT NULL THEN concat(c.first_name, ' ', c.last_name) END
               AS customer_name,
           year(anchor) - year(c.birthdate) AS age
    FROM bought b JOIN dim_customers c ON b.customer_key = c.customer_key)
SELECT customer_key, customer_number, customer_name, age,
       CASE WHEN age < 20 THEN 'Under 20' WHEN age BETWEEN 20 AND 29 THEN '20-29'
            WHEN age BETWEEN 30 AND 39 THEN '30-39' WHEN age BETWEEN 40 AND 49 THEN '40-49'
            ELSE '50 and above' END AS age_group,
       CASE WHEN lifespan_months >= 12 AND total_sales > {VIP} THEN 'VIP'
            WHEN lifespan_months >= 12 AND total_sales <= {VIP} THEN 'Regular' ELSE 'New' END
           AS customer_segment,
       {d('last_order')} AS last_order_date,
       date_diff('day', last_order, anchor) AS recency_days,
       {MONTHS.format('anchor', 'last_order')} AS recency_months,
       total_orders, total_sales, total_quantity, total_products, lifespan_months,
       {r('total_sales / nullif(total_orders, 0)')} AS avg_order_value,
       {r('total_sales / coalesce(nullif(lifespan_months, 0), 1)')} AS avg_monthly_spend
FROM aged""",
    ("fct_sales", "dim_customers"),
)
def _(t):
    return gold.customer_360(t.fct_sales, t.dim_customers, VIP)


# --- A ------------------------------------------------------------------------


@QUERIES.add(
    "a01_yearly_running",
    f"""
WITH yearly AS (
    SELECT date_trunc('year', order_date) AS y, cast(sum(gross_sales_amount) AS bigint) AS s,
           cast(round(avg(unit_price)) AS bigint) AS p
    FROM fct_sales WHERE order_date >= date '{SINCE}' GROUP BY 1)
SELECT {d('y')} AS order_date, s AS total_sales,
       cast(sum(s) OVER (ORDER BY y) AS bigint) AS running_total_sales, p AS avg_price,
       cast(round(avg(p) OVER (ORDER BY y)) AS bigint) AS moving_avg_price
FROM yearly""",
    GOLD[:1],
)
def _(t):
    return analyses.yearly_running(t.fct_sales, SINCE)


SEGMENT_SQL = f"""
WITH spending AS (
    SELECT customer_key, sum(gross_sales_amount) AS spend,
           {MONTHS.format('max(order_date)', 'min(order_date)')} AS months
    FROM fct_sales WHERE {{0}} GROUP BY customer_key)
SELECT CASE WHEN months >= 12 AND spend > {VIP} THEN 'VIP'
            WHEN months >= 12 AND spend <= {VIP} THEN 'Regular' ELSE 'New' END
           AS customer_segment,
       count(customer_key) AS total_customers
FROM spending GROUP BY 1"""


@QUERIES.add("a02_segment_counts", SEGMENT_SQL.format("true"), GOLD[:1])
def _(t):
    return analyses.segment_counts(t.fct_sales, VIP)


@QUERIES.add(
    "a03_order_span",
    f"""
SELECT {d('min(order_date)')} AS first_order_date, {d('max(order_date)')} AS last_order_date,
       year(max(order_date)) - year(min(order_date)) AS order_range_year
FROM fct_sales""",
    GOLD[:1],
)
def _(t):
    return analyses.order_span(t.fct_sales)


@QUERIES.add(
    "a04_birthdate_span",
    f"""
SELECT {d('max(birthdate)')} AS oldest_birthdate, {d('min(birthdate)')} AS youngest_birthdate,
       2026 - year(min(birthdate)) AS oldest_age
FROM dim_customers""",
    GOLD[2:],
)
def _(t):
    return analyses.birthdate_span(t.dim_customers, "2026-01-01")


BY_SQL = """
SELECT {0}, count(customer_key) AS total_customers
FROM dim_customers WHERE {0} IS NOT NULL GROUP BY {0}"""


@QUERIES.add("a05_customers_by_country", BY_SQL.format("country"), GOLD[2:])
def _(t):
    return analyses.customers_by(t.dim_customers, "country")


@QUERIES.add("a06_customers_by_gender", BY_SQL.format("gender"), GOLD[2:])
def _(t):
    return analyses.customers_by(t.dim_customers, "gender")


@QUERIES.add(
    "a07_product_stats",
    f"""
SELECT category, count(product_key) AS total_products, {r('avg(cost)')} AS avg_cost
FROM dim_products GROUP BY category""",
    GOLD[1:2],
)
def _(t):
    return analyses.product_stats(t.dim_products)


@QUERIES.add(
    "a08_revenue_by_category",
    f"""
SELECT category, {r('sum(gross_sales_amount)')} AS total_revenue
FROM fct_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key GROUP BY category""",
    GOLD[:2],
)
def _(t):
    return rounded(analyses.revenue_by_category(t.fct_sales, t.dim_products), 2, "total_revenue")


@QUERIES.add(
    "a09_rank_customers_revenue",
    f"""
SELECT customer_id, first_name, last_name, {r('sum(gross_sales_amount)')} AS total_revenue,
       row_number() OVER (ORDER BY sum(gross_sales_amount) DESC, customer_id NULLS LAST) AS rank
FROM fct_sales f LEFT JOIN dim_customers c ON f.customer_key = c.customer_key
GROUP BY 1, 2, 3""",
    ("fct_sales", "dim_customers"),
)
def _(t):
    return rounded(
        analyses.rank_customers_revenue(t.fct_sales, t.dim_customers), 2, "total_revenue"
    )


@QUERIES.add(
    "a10_units_by_country",
    """
SELECT country, cast(sum(quantity) AS bigint) AS total_sold_items
FROM fct_sales f LEFT JOIN dim_customers c ON f.customer_key = c.customer_key
WHERE country IS NOT NULL GROUP BY country""",
    ("fct_sales", "dim_customers"),
)
def _(t):
    return analyses.units_by_country(t.fct_sales, t.dim_customers)


@QUERIES.add(
    "a11_metric_audit",
    f"""
WITH s AS (SELECT sum(gross_sales_amount) AS a, sum(quantity) AS b, avg(unit_price) AS c,
                  count(DISTINCT order_number) AS o, count(DISTINCT customer_key) AS u
           FROM fct_sales)
SELECT 'Total Sales' AS measure_name, {r('a')} AS measure_value FROM s
UNION ALL SELECT 'Total Quantity', cast(b AS double) FROM s
UNION ALL SELECT 'Average Unit Price', {r('c')} FROM s
UNION ALL SELECT 'Distinct Total Orders', cast(o AS double) FROM s
UNION ALL SELECT 'Active Purchasing Customers', cast(u AS double) FROM s
UNION ALL SELECT 'Total Products (Catalog)', cast(count(*) AS double) FROM dim_products
UNION ALL SELECT 'Total Customers (Registered)', cast(count(*) AS double) FROM dim_customers""",
    GOLD,
)
def _(t):
    return rounded(
        analyses.metric_audit(t.fct_sales, t.dim_products, t.dim_customers), 2, "measure_value"
    )


@QUERIES.add(
    "a12_product_yoy",
    f"""
WITH yearly AS (
    SELECT date_trunc('year', order_date) AS y, product_name,
           cast(sum(gross_sales_amount) AS bigint) AS current_sales
    FROM fct_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key
    WHERE order_date >= date '{SINCE}' GROUP BY 1, 2),
m AS (
    SELECT *, cast(round(avg(current_sales) OVER (PARTITION BY product_name)) AS bigint) AS avg_sales,
           lag(current_sales) OVER (PARTITION BY product_name ORDER BY y) AS py_sales
    FROM yearly)
SELECT {d('y')} AS order_year, product_name, current_sales, avg_sales,
       current_sales - avg_sales AS diff_avg,
       CASE WHEN current_sales > avg_sales THEN 'Above Avg'
            WHEN current_sales < avg_sales THEN 'Below Avg' ELSE 'Avg' END AS avg_change,
       py_sales, current_sales - py_sales AS diff_py,
       CASE WHEN current_sales > py_sales THEN 'Increase'
            WHEN current_sales < py_sales THEN 'Decrease' ELSE 'No Change' END AS py_change
FROM m""",
    GOLD[:2],
)
def _(t):
    return analyses.product_yoy(t.fct_sales, t.dim_products, SINCE)


@QUERIES.add(
    "a13_cost_bands",
    """
SELECT CASE WHEN cost < {0} THEN 'Below {0}' WHEN cost < {1} THEN '{0} - {1}'
            WHEN cost <= {2} THEN '{1} - {2}' ELSE 'Above {2}' END AS cost_range,
       count(product_key) AS total_products
FROM dim_products GROUP BY 1""".format(*COST_EDGES),
    GOLD[1:2],
)
def _(t):
    return analyses.cost_bands(t.dim_products, COST_EDGES)


RANK_PRODUCTS_SQL = f"""
SELECT product_name, {r('sum(gross_sales_amount)')} AS total_revenue,
       row_number() OVER (ORDER BY sum(gross_sales_amount) {{0}}, product_name NULLS LAST)
           AS product_rank
FROM fct_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key
GROUP BY product_name"""


@QUERIES.add("a14_rank_products_best", RANK_PRODUCTS_SQL.format("DESC"), GOLD[:2])
def _(t):
    return rounded(analyses.rank_products(t.fct_sales, t.dim_products), 2, "total_revenue")


@QUERIES.add("a15_rank_products_worst", RANK_PRODUCTS_SQL.format("ASC"), GOLD[:2])
def _(t):
    return rounded(
        analyses.rank_products(t.fct_sales, t.dim_products, desc=False), 2, "total_revenue"
    )


@QUERIES.add(
    "a16_top_customers",
    f"""
SELECT c.customer_key, first_name, last_name, {r('sum(gross_sales_amount)')} AS total_revenue,
       row_number() OVER (ORDER BY sum(gross_sales_amount) DESC, c.customer_key NULLS LAST)
           AS customer_rank
FROM fct_sales f LEFT JOIN dim_customers c ON f.customer_key = c.customer_key
GROUP BY 1, 2, 3 ORDER BY customer_rank LIMIT 10""",
    ("fct_sales", "dim_customers"),
)
def _(t):
    return rounded(analyses.top_customers(t.fct_sales, t.dim_customers), 2, "total_revenue")


@QUERIES.add(
    "a17_rank_customers_orders",
    """
SELECT c.customer_key, first_name, last_name, count(DISTINCT order_number) AS total_orders,
       row_number() OVER (ORDER BY count(DISTINCT order_number), c.customer_key NULLS LAST)
           AS customer_rank
FROM fct_sales f LEFT JOIN dim_customers c ON f.customer_key = c.customer_key
GROUP BY 1, 2, 3""",
    ("fct_sales", "dim_customers"),
)
def _(t):
    return analyses.rank_customers_orders(t.fct_sales, t.dim_customers)


@QUERIES.add(
    "a18_category_share",
    """
WITH s AS (
    SELECT category, cast(sum(gross_sales_amount) AS bigint) AS total_sales
    FROM fct_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key GROUP BY category)
SELECT category, total_sales, cast(sum(total_sales) OVER () AS bigint) AS overall_sales,
       concat(cast(cast(round(cast(total_sales / sum(total_sales) OVER () * 100
                                   AS decimal(38, 10)), 2) AS decimal(9, 2)) AS varchar), '%')
           AS percentage_of_total
FROM s""",
    GOLD[:2],
)
def _(t):
    return analyses.category_share(t.fct_sales, t.dim_products)


@QUERIES.add(
    "a19_yearly_performance",
    f"""
SELECT year(order_date) AS order_year, {r('sum(gross_sales_amount)')} AS total_sales,
       count(DISTINCT customer_key) AS total_customers,
       cast(sum(quantity) AS bigint) AS total_quantity
FROM fct_sales WHERE year(order_date) >= 1996 GROUP BY 1""",
    GOLD[:1],
)
def _(t):
    return rounded(analyses.yearly_performance(t.fct_sales, 1996), 2, "total_sales")


@QUERIES.add(
    "a20_top_country_category",
    f"""
SELECT row_number() OVER (ORDER BY sum(gross_sales_amount) DESC, country, category) AS rank,
       country, category, {r('sum(gross_sales_amount)')} AS total_revenue
FROM fct_sales f JOIN dim_customers c ON f.customer_key = c.customer_key
JOIN dim_products p ON f.product_key = p.product_key
GROUP BY country, category ORDER BY rank LIMIT 10""",
    GOLD,
)
def _(t):
    return rounded(
        analyses.top_country_category(t.fct_sales, t.dim_customers, t.dim_products),
        2,
        "total_revenue",
    )


# --- N ------------------------------------------------------------------------

YEAR_CATEGORY_CTE = """
WITH yc AS (
    SELECT cast(year(order_date) AS varchar) AS order_year, category,
           cast(round_even(sum(gross_sales_amount), 0) AS bigint) AS category_sales,
           cast(round_even(avg(unit_price), 0) AS bigint) AS avg_price
    FROM merged WHERE category IS NOT NULL AND year(order_date) >= 1996 GROUP BY 1, 2)"""

ROLLUP_CTE = (
    YEAR_CATEGORY_CTE
    + """,
yr AS (
    SELECT order_year, sum(category_sales) AS s, avg(avg_price) AS p FROM yc GROUP BY order_year)"""
)


@QUERIES.add("n01_year_category", YEAR_CATEGORY_CTE + " SELECT * FROM yc", MERGED)
def _(t):
    return analyses.year_category(merged(t), 1996)


@QUERIES.add(
    "n02_yearly_rollup",
    ROLLUP_CTE
    + """
SELECT order_year, cast(s AS bigint) AS total_sales,
       cast(round_even(p, 0) AS bigint) AS avg_price,
       cast(sum(s) OVER (ORDER BY order_year) AS bigint) AS running_total,
       cast(round_even(avg(p) OVER (ORDER BY order_year), 0) AS bigint) AS moving_avg_price
FROM yr""",
    MERGED,
)
def _(t):
    return analyses.yearly_rollup(analyses.year_category(merged(t), 1996))


@QUERIES.add(
    "n03_top_products_rounded",
    """
SELECT product_name, cast(round_even(sum(gross_sales_amount), 0) AS bigint) AS product_revenue
FROM merged WHERE product_name IS NOT NULL GROUP BY 1
ORDER BY product_revenue DESC, product_name LIMIT 10""",
    MERGED,
)
def _(t):
    return analyses.top_products_rounded(merged(t))


@QUERIES.add(
    "n04_grand_total",
    ROLLUP_CTE + " SELECT cast(sum(s) AS bigint) AS grand_total_revenue FROM yr",
    MERGED,
)
def _(t):
    return analyses.grand_total(analyses.yearly_rollup(analyses.year_category(merged(t), 1996)))


@QUERIES.add(
    "n05_yearly_customers",
    f"""
WITH yearly AS (
    SELECT cast(year(order_date) AS varchar) AS order_year,
           cast(trunc(sum(gross_sales_amount)) AS bigint) AS s,
           count(DISTINCT customer_key) AS c
    FROM fct_sales WHERE order_date >= date '{SINCE}' GROUP BY 1)
SELECT order_year, s AS total_sales, c AS total_customers,
       cast(sum(s) OVER (ORDER BY order_year) AS bigint) AS running_total_sales,
       cast(sum(c) OVER (ORDER BY order_year) AS bigint) AS running_total_customers
FROM yearly""",
    GOLD[:1],
)
def _(t):
    return analyses.yearly_customers(t.fct_sales, SINCE)


@QUERIES.add(
    "n06_segment_counts_since",
    SEGMENT_SQL.format(f"customer_key IS NOT NULL AND order_date >= date '{SINCE}'"),
    GOLD[:1],
)
def _(t):
    return analyses.segment_counts_since(t.fct_sales, SINCE, VIP)


@QUERIES.add(
    "n07_merged_kpi_totals",
    f"""
SELECT {r('sum(gross_sales_amount)')} AS total_sales,
       count(DISTINCT order_number) AS total_orders,
       cast(sum(quantity) AS bigint) AS total_quantity,
       count(DISTINCT f.customer_key) AS total_customers
FROM fct_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key
LEFT JOIN dim_customers c ON f.customer_key = c.customer_key""",
    GOLD,
)
def _(t):
    return rounded(
        analyses.merged_kpi_totals(t.fct_sales, t.dim_products, t.dim_customers), 2, "total_sales"
    )


@QUERIES.add(
    "n08_category_share_dropnull",
    """
WITH s AS (
    SELECT category, cast(trunc(sum(gross_sales_amount)) AS bigint) AS total_sales
    FROM fct_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key
    WHERE category IS NOT NULL GROUP BY category)
SELECT category, total_sales,
       concat(cast(round_even(total_sales / sum(total_sales) OVER () * 100, 2) AS varchar), '%')
           AS percentage_of_total
FROM s""",
    GOLD[:2],
)
def _(t):
    return analyses.category_share_dropnull(t.fct_sales, t.dim_products)
