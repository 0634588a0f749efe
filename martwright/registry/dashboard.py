"""Merged star read and reports (S10, S11, S17, S18) and dashboard operators (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from martwright.functions.columns import pct_change
from martwright.operators import kpis
from martwright.registry import MERGED, MERGED_SINCE, Catalog, d, r, rounded
from martwright.registry.star import merged
from martwright.session import scratch_path
from martwright.sources.reports import report_customer, report_product, write_report
from martwright.sources.star import merged_sales

QUERIES = Catalog()

START, END = "1997-03-10", "1999-02-20"  # long: monthly buckets
WEEK_START, WEEK_END = "1998-01-05", "1998-02-26"  # short: weekly buckets, daily grain
PRIOR = "1995-03-28"  # START minus the length of the window
CATEGORY, COUNTRY = "PROMO", "NATION_7"
PRODUCT = "red widget"
RULES = {"champion": (11, 60), "loyal": (8, 150), "lost_after": 200}


def window(t, start=START, end=END):
    return kpis.slice_sales(merged(t), start, end)


def in_range(start=START, end=END) -> str:
    return f"order_date BETWEEN date '{start}' AND date '{end}'"


COLUMNS = """product_key, customer_key, {0} AS order_date, order_number, quantity,
       {1} AS gross_sales_amount, {2} AS unit_price, product_name, category, cost,
       first_name, last_name, country""".format(
    d("order_date"), r("gross_sales_amount", 6), r("unit_price", 6)
)


def money(df):
    return rounded(df, 6, "gross_sales_amount", "unit_price")


@QUERIES.add("s10_merged_sales", f"SELECT {COLUMNS} FROM merged", MERGED)
def _(t):
    return money(merged(t))


@QUERIES.add(
    "s11_merged_sales_limit",
    f"""
SELECT * EXCLUDE (sales_item_key) FROM (
    SELECT f.sales_item_key, f.product_key, f.customer_key, {d('f.order_date')} AS order_date,
           f.order_number, f.quantity, {r('f.gross_sales_amount', 6)} AS gross_sales_amount,
           {r('f.unit_price', 6)} AS unit_price, p.product_name, p.category, p.cost,
           c.first_name, c.last_name, c.country
    FROM fct_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key
    LEFT JOIN dim_customers c ON f.customer_key = c.customer_key
    WHERE f.order_date >= date '{MERGED_SINCE}'
    ORDER BY f.sales_item_key, f.order_date, f.quantity, f.gross_sales_amount, f.unit_price
    LIMIT 500)""",
    MERGED[:3],
)
def _(t):
    return money(
        merged_sales(t.fct_sales, t.dim_products, t.dim_customers, MERGED_SINCE, limit=500)
    )


FILTERS = {"start": START, "end": END}


def txt(expression: str) -> str:
    """Report text of a number: two places, no exponent."""
    return f"cast(cast({expression} AS decimal(38, 2)) AS varchar)"


@QUERIES.add(
    "s17_report_product_kpi",
    f"""
WITH k AS (SELECT {r('sum(gross_sales_amount)')} AS s, count(DISTINCT order_number) AS o,
                  cast(sum(quantity) AS bigint) AS u FROM merged WHERE {in_range()})
SELECT 'Date Range' AS "Metric", '{START} to {END}' AS "Value"
UNION ALL SELECT 'Total Revenue ($)', {txt('s')} FROM k
UNION ALL SELECT 'Total Orders', cast(o AS varchar) FROM k
UNION ALL SELECT 'Units Sold', cast(u AS varchar) FROM k
UNION ALL SELECT 'Average Order Value ($)', {txt(r('s / o'))} FROM k""",
    MERGED,
)
def _(t):
    return report_product(merged(t), FILTERS)[0]


@QUERIES.add(
    "s17_report_product_top",
    f"""
SELECT product_name, {r('sum(gross_sales_amount)')} AS "Revenue",
       cast(sum(quantity) AS bigint) AS "Units_Sold", count(DISTINCT order_number) AS "Orders"
FROM merged WHERE {in_range()} AND product_name IS NOT NULL
GROUP BY 1 ORDER BY sum(gross_sales_amount) DESC, 1 LIMIT 10""",
    MERGED,
)
def _(t):
    # Through the CSV sink and back, with the declared types.
    out = scratch_path(t.spark, "report")
    write_report(report_product(merged(t), FILTERS), out)
    return t.spark.read.csv(
        f"{out}/top",
        header=True,
        schema="product_name string, Revenue double, Units_Sold long, Orders long",
    )


PER_CUSTOMER = """
SELECT customer_key, sum(gross_sales_amount) AS spend, count(DISTINCT order_number) AS orders,
       sum(quantity) AS units
FROM merged WHERE customer_key IS NOT NULL AND {0} GROUP BY customer_key"""


@QUERIES.add(
    "s18_report_customer_kpi",
    f"""
WITH c AS ({PER_CUSTOMER.format(in_range() + f" AND category = '{CATEGORY}'")}),
k AS (SELECT count(*) AS n, sum(spend) AS s, sum(orders) AS o,
             sum(CASE WHEN orders > 1 THEN 1 ELSE 0 END) AS m FROM c)
SELECT 'Date Range' AS "Metric", '{START} to {END}' AS "Value"
UNION ALL SELECT 'Category Filter', '{CATEGORY}'
UNION ALL SELECT 'Region Filter', 'ALL'
UNION ALL SELECT 'Active Customers', cast(n AS varchar) FROM k
UNION ALL SELECT 'Avg Spend per Customer ($)', {txt(r('s / n'))} FROM k
UNION ALL SELECT 'Avg Order Frequency', {txt(r('o / n'))} FROM k
UNION ALL SELECT 'Repeat Rate (%)',
       concat(cast(cast(m * 100 / n AS decimal(9, 1)) AS varchar), '%') FROM k""",
    MERGED,
)
def _(t):
    return report_customer(merged(t), {**FILTERS, "category": CATEGORY})[0]


TOP_CUSTOMERS_SQL = f"""
SELECT first_name, last_name, country, sum(gross_sales_amount) AS spend,
       count(DISTINCT order_number) AS orders
FROM merged
WHERE {in_range()} AND first_name IS NOT NULL AND last_name IS NOT NULL AND country IS NOT NULL
GROUP BY 1, 2, 3 ORDER BY spend DESC, 1, 2, 3 LIMIT 10"""


@QUERIES.add(
    "s18_report_customer_top",
    f"""
SELECT concat(first_name, ' ', last_name) AS "Customer_Name", country AS "Country",
       orders AS "Total_Orders", {r('spend')} AS "Total_Spend" FROM ({TOP_CUSTOMERS_SQL})""",
    MERGED,
)
def _(t):
    return report_customer(merged(t), FILTERS)[1]


@QUERIES.add(
    "d01_slice_sales",
    f"""
SELECT {COLUMNS} FROM merged
WHERE {in_range()} AND category = '{CATEGORY}' AND country = '{COUNTRY}'""",
    MERGED,
)
def _(t):
    return money(kpis.slice_sales(merged(t), START, END, CATEGORY, COUNTRY))


@QUERIES.add(
    "d02_kpi_totals",
    f"""
SELECT {r('sum(gross_sales_amount)')} AS total_sales, count(DISTINCT order_number) AS total_orders,
       cast(sum(quantity) AS bigint) AS total_quantity,
       count(DISTINCT customer_key) AS total_customers
FROM merged WHERE {in_range()}""",
    MERGED,
)
def _(t):
    return rounded(kpis.kpi_totals(window(t)), 2, "total_sales")


@QUERIES.add(
    "d03_kpi_ratios",
    f"""
WITH k AS (SELECT sum(gross_sales_amount) AS s, count(DISTINCT order_number) AS o,
                  sum(quantity) AS u, count(DISTINCT customer_key) AS c,
                  count(DISTINCT order_date) AS n FROM merged WHERE {in_range()})
SELECT n AS active_days, {r('s / o', 4)} AS aov, {r('s / n', 4)} AS daily_revenue,
       {r('o / n', 4)} AS daily_orders, {r('u / n', 4)} AS daily_units,
       {r('u / o', 4)} AS units_per_order, {r('s / u', 4)} AS unit_price,
       {r('s / c', 4)} AS revenue_per_customer, {r('o / c', 4)} AS orders_per_customer
FROM k""",
    MERGED,
)
def _(t):
    ratios = kpis.kpi_ratios(window(t))
    return rounded(ratios, 4, *[c for c in ratios.columns if c != "active_days"])


PAIR_TAIL = f"""
SELECT metric, {r('now', 4)} AS current_value, {r('prior', 4)} AS prior_value,
       {r('(now - prior) / abs(nullif(prior, 0)) * 100', 4)} AS pct_change
FROM pairs"""


def both(expression: str, cast_to: str = "double") -> str:
    return ", ".join(
        f"cast(coalesce({expression.format(side)}, 0) AS {cast_to})"
        for side in (in_range(), f"order_date BETWEEN date '{PRIOR}' AND date '1997-03-09'")
    )


@QUERIES.add(
    "d04_period_over_period",
    f"""
WITH pairs(metric, now, prior) AS (
    SELECT 'sales', {both('sum(CASE WHEN {0} THEN gross_sales_amount END)')} FROM merged
    UNION ALL SELECT 'orders', {both('count(DISTINCT CASE WHEN {0} THEN order_number END)')}
              FROM merged
    UNION ALL SELECT 'units', {both('sum(CASE WHEN {0} THEN quantity END)')} FROM merged
    UNION ALL SELECT 'customers', {both('count(DISTINCT CASE WHEN {0} THEN customer_key END)')}
              FROM merged)
{PAIR_TAIL}""",
    MERGED,
)
def _(t):
    pairs = kpis.period_over_period(merged(t), START, END)
    return rounded(pairs, 4, "current_value", "prior_value", "pct_change")


@QUERIES.add(
    "d05_pct_change",
    f"""
SELECT order_number, quantity,
       {r('(quantity - quantity % 5) / abs(nullif(quantity % 5, 0)) * 100', 4)} AS change
FROM fct_sales""",
    MERGED[:1],
)
def _(t):
    prior = F.col("quantity") % 5
    change = pct_change(F.col("quantity"), prior).alias("change")
    return rounded(t.fct_sales.select("order_number", "quantity", change), 4, "change")


MONTH_SPINE = f"""
SELECT b AS bucket, greatest(b, date '{START}') AS period_start,
       least(last_day(b), date '{END}') AS period_end,
       (b < date '{START}' OR last_day(b) > date '{END}') AS partial
FROM (SELECT cast(unnest(generate_series(date_trunc('month', date '{START}'), date '{END}',
                                         INTERVAL 1 MONTH)) AS date) AS b)"""

WEEK_SPINE = f"""
SELECT b AS bucket, b AS period_start, least(b + 6, date '{WEEK_END}') AS period_end,
       (b + 6 > date '{WEEK_END}') AS partial
FROM (SELECT cast(unnest(generate_series(date '{WEEK_START}', date '{WEEK_END}',
                                         INTERVAL 7 DAY)) AS date) AS b)"""

MONTH_OF = "cast(date_trunc('month', order_date) AS date)"
WEEK_OF = f"""date '{WEEK_START}'
    + cast(floor(date_diff('day', date '{WEEK_START}', order_date) / 7) * 7 AS int)"""


def product_trend_sql(spine, bucket, start, end):
    return f"""
WITH spine AS ({spine}),
m AS (SELECT {bucket} AS bucket, sum(gross_sales_amount) AS s, count(DISTINCT order_number) AS o,
             sum(quantity) AS u, count(DISTINCT customer_key) AS c
      FROM merged WHERE {in_range(start, end)} GROUP BY 1)
SELECT {d('period_start')} AS period_start, {d('period_end')} AS period_end, partial,
       {r('coalesce(s, 0)')} AS revenue, coalesce(o, 0) AS orders,
       cast(coalesce(u, 0) AS bigint) AS units, coalesce(c, 0) AS customers
FROM spine LEFT JOIN m ON spine.bucket = m.bucket"""


def customer_trend_sql(spine, bucket, start, end):
    return f"""
WITH spine AS ({spine}),
p AS (SELECT {bucket} AS bucket, customer_key, sum(gross_sales_amount) AS s,
             count(DISTINCT order_number) AS o
      FROM merged WHERE customer_key IS NOT NULL AND {in_range(start, end)} GROUP BY 1, 2),
m AS (SELECT bucket, count(*) AS n, sum(s) AS s, sum(o) AS o,
             sum(CASE WHEN o > 1 THEN 1 ELSE 0 END) AS k FROM p GROUP BY 1)
SELECT {d('period_start')} AS period_start, {d('period_end')} AS period_end, partial,
       coalesce(n, 0) AS active_customers, {r('s / n', 4)} AS spend_per_customer,
       {r('o / n', 4)} AS orders_per_customer, {r('k / n * 100', 4)} AS repeat_rate
FROM spine LEFT JOIN m ON spine.bucket = m.bucket"""


RATIOS = ("spend_per_customer", "orders_per_customer", "repeat_rate")


@QUERIES.add(
    "d06_kpi_trend_product_monthly", product_trend_sql(MONTH_SPINE, MONTH_OF, START, END), MERGED
)
def _(t):
    return rounded(kpis.kpi_trend_product(merged(t), START, END), 2, "revenue")


@QUERIES.add(
    "d06_kpi_trend_product_weekly",
    product_trend_sql(WEEK_SPINE, WEEK_OF, WEEK_START, WEEK_END),
    MERGED,
)
def _(t):
    return rounded(kpis.kpi_trend_product(merged(t), WEEK_START, WEEK_END), 2, "revenue")


@QUERIES.add(
    "d07_kpi_trend_customer_monthly", customer_trend_sql(MONTH_SPINE, MONTH_OF, START, END), MERGED
)
def _(t):
    return rounded(kpis.kpi_trend_customer(merged(t), START, END), 4, *RATIOS)


@QUERIES.add(
    "d07_kpi_trend_customer_weekly",
    customer_trend_sql(WEEK_SPINE, WEEK_OF, WEEK_START, WEEK_END),
    MERGED,
)
def _(t):
    return rounded(kpis.kpi_trend_customer(merged(t), WEEK_START, WEEK_END), 4, *RATIOS)


# Every fourth month has no known customer, so that some months really are empty.
SPARSE_FROM, SPARSE_TO = "1995-01-01", "2002-06-30"
SPARSE = f"""
WITH spine AS (SELECT cast(unnest(generate_series(date '{SPARSE_FROM}', date '{SPARSE_TO}',
                                                  INTERVAL 1 MONTH)) AS date) AS bucket),
p AS (SELECT {MONTH_OF} AS bucket, customer_key, sum(gross_sales_amount) AS s
      FROM merged WHERE customer_key IS NOT NULL AND month(order_date) % 4 <> 0 GROUP BY 1, 2),
m AS (SELECT bucket, count(*) AS n, sum(s) AS s FROM p GROUP BY 1),
trend AS (SELECT spine.bucket, n, s / n AS spend FROM spine LEFT JOIN m ON spine.bucket = m.bucket)
"""


def sparse_trend(t):
    sparse = merged(t).withColumn(
        "customer_key", F.when(F.month("order_date") % 4 != 0, F.col("customer_key"))
    )
    return rounded(
        kpis.kpi_trend_customer(sparse, SPARSE_FROM, SPARSE_TO), 4, "spend_per_customer"
    )


@QUERIES.add(
    "d08_trend_endpoints",
    SPARSE
    + f"""
SELECT 'spend_per_customer' AS metric, {d('min(bucket) FILTER (spend IS NOT NULL)')} AS first_period,
       {r('arg_min(spend, bucket) FILTER (spend IS NOT NULL)', 4)} AS first_value,
       {d('max(bucket) FILTER (spend IS NOT NULL)')} AS last_period,
       {r('arg_max(spend, bucket) FILTER (spend IS NOT NULL)', 4)} AS last_value,
       count(*) AS periods FROM trend
UNION ALL
SELECT 'active_customers', {d('min(bucket)')}, cast(arg_min(coalesce(n, 0), bucket) AS double),
       {d('max(bucket)')}, cast(arg_max(coalesce(n, 0), bucket) AS double), count(*) FROM trend""",
    MERGED,
)
def _(t):
    return kpis.trend_endpoints(sparse_trend(t), ["spend_per_customer", "active_customers"])


@QUERIES.add(
    "d09_gap_islands",
    SPARSE
    + f"""
SELECT {d('bucket')} AS period_start, {r('spend', 4)} AS spend_per_customer, island
FROM (SELECT *, cast(sum(CASE WHEN spend IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY bucket)
                     AS bigint) AS island FROM trend) WHERE spend IS NOT NULL""",
    MERGED,
)
def _(t):
    return kpis.gap_islands(sparse_trend(t), "period_start", "spend_per_customer")


def margin_sql(period, step, floor, label, start, end):
    return f"""
WITH m AS (
    SELECT {period} AS p, sum(gross_sales_amount) AS s,
           coalesce(sum(CASE WHEN cost >= 0 AND quantity >= 0 THEN quantity * cost END), 0) AS k,
           sum(CASE WHEN cost >= 0 AND quantity >= 0 THEN 0 ELSE 1 END) AS bad
    FROM merged WHERE {in_range(start, end)} GROUP BY 1),
spine AS (SELECT {label} AS p FROM (
    SELECT cast(unnest(generate_series(lo, hi, INTERVAL 1 {step})) AS date) AS b
    FROM (SELECT {floor} AS lo, max(p) AS hi FROM m)))
SELECT {d('spine.p')} AS period, {r('coalesce(s, 0)')} AS revenue,
       {r('coalesce(k, 0)')} AS total_cost, cast(coalesce(bad, 0) AS bigint) AS missing_cost,
       CASE WHEN s > 0 AND bad = 0 THEN {r('(s - k) / s', 6)} END AS margin
FROM spine LEFT JOIN m ON spine.p = m.p"""


@QUERIES.add(
    "d10_sales_margin_daily",
    margin_sql("order_date", "DAY", "min(p)", "b", WEEK_START, WEEK_END),
    MERGED,
)
def _(t):
    trend = kpis.sales_margin_trend(merged(t), WEEK_START, WEEK_END)
    return rounded(rounded(trend, 2, "revenue", "total_cost"), 6, "margin")


@QUERIES.add(
    "d10_sales_margin_monthly",
    margin_sql(
        "last_day(order_date)", "MONTH", "date_trunc('month', min(p))", "last_day(b)", START, END
    ),
    MERGED,
)
def _(t):
    trend = kpis.sales_margin_trend(merged(t), START, END)
    return rounded(rounded(trend, 2, "revenue", "total_cost"), 6, "margin")


@QUERIES.add(
    "d11_revenue_by_category",
    f"""
SELECT concat(upper(substr(category, 1, 1)), lower(substr(category, 2))) AS category,
       {r('sum(gross_sales_amount)')} AS revenue
FROM merged WHERE category IS NOT NULL AND {in_range()} GROUP BY merged.category""",
    MERGED,
)
def _(t):
    return rounded(kpis.revenue_by_category(window(t)), 2, "revenue")


@QUERIES.add(
    "d12_revenue_by_country",
    f"""
SELECT concat(upper(substr(country, 1, 1)), lower(substr(country, 2))) AS country,
       {r('sum(gross_sales_amount)')} AS revenue
FROM merged WHERE country IS NOT NULL AND {in_range()} GROUP BY merged.country""",
    MERGED,
)
def _(t):
    return rounded(kpis.revenue_by_country(window(t)), 2, "revenue")


@QUERIES.add(
    "d13_revenue_by_iso3",
    f"""
WITH alias AS (SELECT lower(n_name) AS alias, concat('R', cast(n_nationkey % 7 AS varchar)) AS iso3
               FROM nation WHERE n_nationkey % 6 <> 0)
SELECT iso3, CASE WHEN iso3 IS NOT NULL THEN concat('Group ', iso3) END AS country,
       {r('sum(gross_sales_amount)')} AS revenue, iso3 IS NULL AS unknown
FROM merged LEFT JOIN alias ON lower(trim(merged.country)) = alias.alias
WHERE {in_range()} GROUP BY iso3""",
    MERGED,
)
def _(t):
    code = F.concat(F.lit("R"), (F.col("n_nationkey") % 7).cast("string"))
    aliases = t.nation.filter("n_nationkey % 6 <> 0").select(
        F.lower("n_name").alias("alias"),
        code.alias("iso3"),
        F.concat(F.lit("Group "), code).alias("name"),
    )
    return rounded(kpis.revenue_by_iso3(window(t), aliases), 2, "revenue")


TOP_PRODUCTS_SQL = f"""
SELECT product_name, {r('sum(gross_sales_amount)')} AS revenue,
       cast(sum(quantity) AS bigint) AS units, count(DISTINCT order_number) AS orders
FROM merged WHERE product_name IS NOT NULL AND {in_range()}
GROUP BY 1 ORDER BY sum(gross_sales_amount) DESC, 1 LIMIT 10"""


@QUERIES.add(
    "d14_top_products", f"SELECT * EXCLUDE (orders) FROM ({TOP_PRODUCTS_SQL})", MERGED
)
def _(t):
    return rounded(kpis.top_products(window(t)), 2, "revenue")


@QUERIES.add("d15_top_products_orders", TOP_PRODUCTS_SQL, MERGED)
def _(t):
    return rounded(kpis.top_products_orders(window(t)), 2, "revenue")


@QUERIES.add(
    "d16_product_totals",
    f"""
SELECT {r('sum(gross_sales_amount)')} AS revenue, cast(sum(quantity) AS bigint) AS units,
       count(DISTINCT order_number) AS orders
FROM merged WHERE product_name = '{PRODUCT}' AND {in_range()}""",
    MERGED,
)
def _(t):
    return rounded(kpis.product_totals(window(t), PRODUCT), 2, "revenue")


NAME = "concat(coalesce(first_name, ''), ' ', coalesce(last_name, ''))"


@QUERIES.add(
    "d17_recent_transactions",
    f"""
SELECT order_number, {d('order_date')} AS order_date, {NAME} AS customer_name, country, quantity,
       {r('gross_sales_amount', 6)} AS gross_sales_amount
FROM (SELECT * FROM merged WHERE product_name = '{PRODUCT}' AND {in_range()}
      ORDER BY merged.order_date DESC, order_number, gross_sales_amount, quantity, {NAME}
      LIMIT 50)""",
    MERGED,
)
def _(t):
    return rounded(kpis.recent_transactions(window(t), PRODUCT), 6, "gross_sales_amount")


@QUERIES.add(
    "d18_product_export",
    f"""
SELECT order_number AS "Order Number", {d('order_date')} AS "Order Date", {NAME} AS "Customer",
       country AS "Country", category AS "Category", quantity AS "Quantity",
       {r('gross_sales_amount', 6)} AS "Revenue ($)"
FROM merged WHERE product_name = '{PRODUCT}' AND {in_range()}""",
    MERGED,
)
def _(t):
    return rounded(kpis.product_export(window(t), PRODUCT), 6, "Revenue ($)")


PRIOR_RANGE = f"order_date BETWEEN date '{PRIOR}' AND date '1997-03-09'"


@QUERIES.add(
    "d19_customer_kpis",
    f"""
WITH c AS (SELECT 'now' AS w, * FROM ({PER_CUSTOMER.format(in_range())})
           UNION ALL SELECT 'prior', * FROM ({PER_CUSTOMER.format(PRIOR_RANGE)})),
k AS (SELECT w, cast(count(*) AS double) AS n, sum(spend) / count(*) AS s, sum(orders) / count(*) AS o,
             sum(CASE WHEN orders > 1 THEN 1 ELSE 0 END) / count(*) * 100 AS m FROM c GROUP BY w),
pairs(metric, now, prior) AS (
    SELECT 'active_customers', max(n) FILTER (w = 'now'), max(n) FILTER (w = 'prior') FROM k
    UNION ALL SELECT 'spend_per_customer', max(s) FILTER (w = 'now'), max(s) FILTER (w = 'prior')
              FROM k
    UNION ALL SELECT 'orders_per_customer', max(o) FILTER (w = 'now'), max(o) FILTER (w = 'prior')
              FROM k
    UNION ALL SELECT 'repeat_rate', max(m) FILTER (w = 'now'), max(m) FILTER (w = 'prior') FROM k)
{PAIR_TAIL}""",
    MERGED,
)
def _(t):
    pairs = kpis.customer_kpis(merged(t), START, END)
    return rounded(pairs, 4, "current_value", "prior_value", "pct_change")


@QUERIES.add(
    "d20_customer_detail",
    f"""
WITH c AS ({PER_CUSTOMER.format(in_range())})
SELECT sum(CASE WHEN orders = 1 THEN 1 ELSE 0 END)::bigint AS single_order_customers,
       sum(CASE WHEN orders > 1 THEN 1 ELSE 0 END)::bigint AS repeat_customers,
       {r('max(spend)')} AS max_spend, {r('median(spend)')} AS median_spend,
       sum(orders)::bigint AS total_orders, {r('sum(units) / count(*)', 4)} AS units_per_customer
FROM c""",
    MERGED,
)
def _(t):
    detail = kpis.customer_detail(window(t))
    return rounded(rounded(detail, 2, "max_spend", "median_spend"), 4, "units_per_customer")


RFM_SQL = f"""
SELECT CASE WHEN f >= 11 AND n <= 60 THEN 'Champions' WHEN f >= 8 AND n <= 150 THEN 'Loyal Customers'
            WHEN n > 200 THEN 'Hibernating / Lost' ELSE 'Promising / Recent' END AS segment, m
FROM (SELECT date_diff('day', max(order_date), date '{END}') AS n,
             count(DISTINCT order_number) AS f, sum(gross_sales_amount) AS m
      FROM merged WHERE customer_key IS NOT NULL AND {in_range()} GROUP BY customer_key)"""


@QUERIES.add(
    "d21_rfm_segments",
    f"SELECT segment, count(*) AS customers FROM ({RFM_SQL}) GROUP BY segment",
    MERGED,
)
def _(t):
    return kpis.rfm_segments(window(t), END, RULES)


@QUERIES.add(
    "d22_rfm_summary",
    f"""
SELECT segment, count(*) AS customer_count, {r('sum(m)')} AS total_segment_spend,
       {r('avg(m)')} AS avg_spend_per_customer
FROM ({RFM_SQL}) GROUP BY segment""",
    MERGED,
)
def _(t):
    return rounded(
        kpis.rfm_summary(window(t), END, RULES), 2, "total_segment_spend", "avg_spend_per_customer"
    )


@QUERIES.add(
    "d23_spend_histogram",
    f"""
WITH c AS (SELECT {r('spend', 4)} AS s FROM ({PER_CUSTOMER.format(in_range())})),
e AS (SELECT min(s) AS lo, max(s) AS hi FROM c)
SELECT bin, {r('any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 30')} AS bin_start,
       count(*) AS customers
FROM (SELECT cast(least(floor((s - (SELECT lo FROM e)) * 30
                              / ((SELECT hi FROM e) - (SELECT lo FROM e))), 29) AS bigint) AS bin,
             (SELECT lo FROM e) AS lo, (SELECT hi FROM e) AS hi FROM c)
GROUP BY bin""",
    MERGED,
)
def _(t):
    return rounded(kpis.spend_histogram(window(t)), 2, "bin_start")


@QUERIES.add(
    "d24_top_customers",
    f"""
SELECT first_name, last_name, country, {r('spend')} AS total_spend, orders AS total_orders,
       concat(first_name, ' ', last_name) AS customer_name
FROM ({TOP_CUSTOMERS_SQL})""",
    MERGED,
)
def _(t):
    return rounded(kpis.top_customers(window(t)), 2, "total_spend")


@QUERIES.add(
    "d25_monthly_active",
    f"""
SELECT {d(MONTH_OF)} AS year_month, count(DISTINCT customer_key) AS active_customers
FROM merged WHERE {in_range()} GROUP BY 1""",
    MERGED,
)
def _(t):
    return kpis.monthly_active(window(t))


def _title(column: str) -> str:
    return f"concat(upper(substr({column}, 1, 1)), lower(substr({column}, 2)))"


@QUERIES.add(
    "d26_filter_options",
    f"""
SELECT DISTINCT 'category' AS kind, category AS value, {_title('category')} AS label
FROM merged WHERE category IS NOT NULL
UNION ALL SELECT DISTINCT 'country', country, {_title('country')} FROM merged
WHERE country IS NOT NULL
UNION ALL SELECT 'category', 'ALL', 'All Categories'
UNION ALL SELECT 'country', 'ALL', 'All Countries'""",
    MERGED,
)
def _(t):
    return kpis.filter_options(merged(t))


@QUERIES.add(
    "d26_date_bounds",
    f"SELECT {d('min(order_date)')} AS min_date, {d('max(order_date)')} AS max_date FROM merged",
    MERGED,
)
def _(t):
    return kpis.date_bounds(merged(t))


@QUERIES.add(
    "d27_default_window",
    f"""
SELECT {d('min(order_date)')} AS start_date, {d('max(order_date)')} AS end_date
FROM merged WHERE year(order_date) = (SELECT max(year(order_date)) FROM merged)""",
    MERGED,
)
def _(t):
    return kpis.default_window(merged(t))


@QUERIES.add(
    "d28_metric_rows",
    f"""
WITH k AS (SELECT sum(gross_sales_amount) AS s, count(DISTINCT order_number) AS o,
                  sum(quantity) AS u FROM merged WHERE {in_range()})
SELECT 'Sales' AS "Metric", {txt('s')} AS "Value" FROM k
UNION ALL SELECT 'Orders', cast(o AS varchar) FROM k
UNION ALL SELECT 'Units', cast(cast(u AS bigint) AS varchar) FROM k""",
    MERGED,
)
def _(t):
    return kpis.metric_rows(
        kpis.kpi_totals(window(t)),
        {"total_sales": "Sales", "total_orders": "Orders", "total_quantity": "Units"},
    )
