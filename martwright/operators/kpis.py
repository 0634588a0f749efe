"""Dashboard operators over the merged sales frame."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martwright.functions.columns import (
    divide_or_zero,
    full_name,
    is_finite,
    pct_change,
    safe_divide,
    title_case,
    to_money,
)
from martwright.operators.ranking import exact_median, top_k

# Longest span shown in weeks / days, and recency-frequency rules.
DAILY_SPAN_DAYS = 60
RFM_RULES = {
    "champion": (3, 30),
    "loyal": (2, 60),
    "lost_after": 90,
}
POP_METRICS = {
    "sales": ("gross_sales_amount", "sum"),
    "orders": ("order_number", "distinct"),
    "units": ("quantity", "sum"),
    "customers": ("customer_key", "distinct"),
}


def _day(value) -> date:
    return value if isinstance(value, date) else date.fromisoformat(str(value)[:10])


def _between(start, end) -> Column:
    return F.col("order_date").between(F.lit(_day(start)), F.lit(_day(end)))


def slice_sales(df: DataFrame, start, end, category="ALL", country="ALL") -> DataFrame:
    """Inclusive date range, category and country; without dates an empty frame."""
    if not start or not end:
        return df.limit(0)
    sliced = df.filter(_between(start, end))
    if category and category != "ALL":
        sliced = sliced.filter(F.col("category") == category)
    if country and country != "ALL":
        sliced = sliced.filter(F.col("country") == country)
    return sliced


def kpi_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.coalesce(F.sum("gross_sales_amount"), F.lit(0.0)).alias("total_sales"),
        F.count_distinct("order_number").alias("total_orders"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("total_quantity"),
        F.count_distinct("customer_key").alias("total_customers"),
    )


def kpi_ratios(df: DataFrame) -> DataFrame:
    """Averages per day, order, unit and customer; 0 for a zero divisor."""
    totals = df.agg(
        F.sum("gross_sales_amount").alias("sales"),
        F.count_distinct("order_number").alias("orders"),
        F.sum("quantity").alias("units"),
        F.count_distinct("customer_key").alias("customers"),
        F.count_distinct("order_date").alias("active_days"),
    )
    return totals.select(
        "active_days",
        divide_or_zero("sales", "orders").alias("aov"),
        divide_or_zero("sales", "active_days").alias("daily_revenue"),
        divide_or_zero("orders", "active_days").alias("daily_orders"),
        divide_or_zero("units", "active_days").alias("daily_units"),
        divide_or_zero("units", "orders").alias("units_per_order"),
        divide_or_zero("sales", "units").alias("unit_price"),
        divide_or_zero("sales", "customers").alias("revenue_per_customer"),
        divide_or_zero("orders", "customers").alias("orders_per_customer"),
    )


def _windows(start, end) -> tuple[date, date, date]:
    """(first prior day, first day, last day); the prior window ends the day before."""
    start, end = _day(start), _day(end)
    return start - (end - start) - timedelta(days=1), start, end


def _two_windows(df: DataFrame, start, end) -> DataFrame:
    """Rows of both windows, tagged; the windows touch, so one range filter does."""
    prior, start, end = _windows(start, end)
    return df.filter(_between(prior, end)).withColumn(
        "_current", F.col("order_date") >= F.lit(start)
    )


def _metric_pairs(by_window: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows per window → one row per metric: current, prior, percent change."""
    picked = by_window.agg(
        *[
            F.coalesce(F.max(F.when(side, F.col(m).cast("double"))), F.lit(0.0)).alias(f"{m}_{tag}")
            for m in metrics
            for tag, side in (("now", F.col("_current")), ("before", ~F.col("_current")))
        ]
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"{m}_now").alias("current_value"),
                F.col(f"{m}_before").alias("prior_value"),
            )
            for m in metrics
        ]
    )
    return picked.select(F.inline(pairs)).withColumn(
        "pct_change", pct_change("current_value", "prior_value")
    )


def period_over_period(
    df: DataFrame,
    start,
    end,
    metrics: dict | None = None,
    category="ALL",
    country="ALL",
) -> DataFrame:
    """Each metric in the window and in the equally long one before it, from one scan."""
    metrics = metrics or POP_METRICS
    prior, _, last = _windows(start, end)
    tagged = _two_windows(slice_sales(df, prior, last, category, country), start, end)
    aggs = [
        (F.count_distinct(column) if kind == "distinct" else F.sum(column)).alias(name)
        for name, (column, kind) in metrics.items()
    ]
    return _metric_pairs(tagged.groupBy("_current").agg(*aggs), list(metrics))


def _one_row(spark: SparkSession) -> DataFrame:
    return spark.range(1).select()


def _buckets(spark: SparkSession, start: date, end: date) -> tuple[DataFrame, Column]:
    """Bucket spine of a range and the bucket start of a row's order date."""
    first = F.lit(start)
    if (end - start).days + 1 <= DAILY_SPAN_DAYS:
        starts = F.sequence(first, F.lit(end), F.expr("interval 7 days"))
        natural_end = F.date_add("bucket", 6)
        weeks = F.floor(F.datediff("order_date", first) / 7).cast("int")
        row_bucket = F.date_add(first, weeks * 7)
    else:
        starts = F.sequence(F.trunc(first, "month"), F.lit(end), F.expr("interval 1 month"))
        natural_end = F.last_day("bucket")
        row_bucket = F.trunc("order_date", "month")
    spine = (
        _one_row(spark)
        .select(F.explode(starts).alias("bucket"))
        .select(
            "bucket",
            F.greatest("bucket", first).alias("period_start"),
            F.least(natural_end, F.lit(end)).alias("period_end"),
            ((F.col("bucket") < first) | (natural_end > F.lit(end))).alias("partial"),
        )
    )
    return spine, row_bucket


def kpi_trend_product(df: DataFrame, start, end) -> DataFrame:
    """Revenue, orders, units, customers per week or month; empty buckets are 0.

    A row's bucket is arithmetic on its date, so the spine is joined by equality.
    """
    start, end = _day(start), _day(end)
    spine, row_bucket = _buckets(df.sparkSession, start, end)
    measured = (
        df.filter(_between(start, end))
        .groupBy(row_bucket.alias("bucket"))
        .agg(
            F.sum("gross_sales_amount").alias("revenue"),
            F.count_distinct("order_number").alias("orders"),
            F.sum("quantity").alias("units"),
            F.count_distinct("customer_key").alias("customers"),
        )
    )
    # One measured row per bucket of the range.
    return spine.join(F.broadcast(measured), "bucket", "left").select(
        "period_start",
        "period_end",
        "partial",
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.coalesce("orders", F.lit(0)).alias("orders"),
        F.coalesce("units", F.lit(0)).alias("units"),
        F.coalesce("customers", F.lit(0)).alias("customers"),
    )


def _per_customer(df: DataFrame, *by) -> DataFrame:
    return (
        df.filter(F.col("customer_key").isNotNull())
        .groupBy(*by, "customer_key")
        .agg(
            F.sum("gross_sales_amount").alias("total_spend"),
            F.count_distinct("order_number").alias("total_orders"),
            F.sum("quantity").alias("total_units"),
        )
    )


def _customer_ratios() -> list[Column]:
    size = F.count(F.lit(1))
    return [
        size.alias("active_customers"),
        safe_divide(F.sum("total_spend"), size).alias("spend_per_customer"),
        safe_divide(F.sum("total_orders"), size).alias("orders_per_customer"),
        (safe_divide(F.count_if(F.col("total_orders") > 1), size) * 100).alias("repeat_rate"),
    ]


def kpi_trend_customer(df: DataFrame, start, end) -> DataFrame:
    """Active customers and their ratios per bucket; ratios NULL in empty buckets."""
    start, end = _day(start), _day(end)
    spine, row_bucket = _buckets(df.sparkSession, start, end)
    inside = df.filter(_between(start, end)).withColumn("bucket", row_bucket)
    measured = _per_customer(inside, "bucket").groupBy("bucket").agg(*_customer_ratios())
    # One measured row per bucket of the range.
    return spine.join(F.broadcast(measured), "bucket", "left").select(
        "period_start",
        "period_end",
        "partial",
        F.coalesce("active_customers", F.lit(0)).alias("active_customers"),
        "spend_per_customer",
        "orders_per_customer",
        "repeat_rate",
    )


def trend_endpoints(trend: DataFrame, metrics: list[str], period: str = "period_start") -> DataFrame:
    """First and last available period and value of each metric, and the bucket count."""
    rows = []
    for m in metrics:
        # min_by / max_by skip rows whose ordering value is NULL.
        when = F.when(F.col(m).isNotNull(), F.col(period))
        value = F.col(m).cast("double")
        rows.append(
            F.struct(
                F.lit(m).alias("metric"),
                F.min(when).alias("first_period"),
                F.min_by(value, when).alias("first_value"),
                F.max(when).alias("last_period"),
                F.max_by(value, when).alias("last_value"),
                F.count(F.lit(1)).alias("periods"),
            ).alias(m)
        )
    return trend.agg(*rows).select(F.inline(F.array(*[F.col(m) for m in metrics])))


def gap_islands(trend: DataFrame, order: str, value: str) -> DataFrame:
    """Available periods with the id of their contiguous run.

    The id is the number of missing periods before; one row per bucket.
    """
    missing = F.sum(F.col(value).isNull().cast("long")).over(Window.orderBy(order))
    return (
        trend.select(order, value, missing.alias("island"))
        .filter(F.col(value).isNotNull())
    )


def sales_margin_trend(df: DataFrame, start, end, grain: str = "auto") -> DataFrame:
    """Revenue and margin per day or month end, gaps filled between first and last date.

    A period's margin is NULL when its revenue is not positive or any of its
    rows lacks a finite, non-negative cost and quantity.
    """
    start, end = _day(start), _day(end)
    if grain == "auto":
        grain = "day" if (end - start).days <= DAILY_SPAN_DAYS else "month"
    period = F.col("order_date") if grain == "day" else F.last_day("order_date")
    sales, units, cost = (to_money(c) for c in ("gross_sales_amount", "quantity", "cost"))
    usable = (
        is_finite(sales) & is_finite(units) & is_finite(cost) & (cost >= 0) & (units >= 0)
    )
    measured = (
        df.filter(_between(start, end))
        .groupBy(period.alias("period"))
        .agg(
            F.coalesce(F.sum(sales), F.lit(0.0)).alias("revenue"),
            F.coalesce(F.sum(F.when(usable, units * cost)), F.lit(0.0)).alias("total_cost"),
            F.count_if(~F.coalesce(usable, F.lit(False))).alias("missing_cost"),
        )
    )
    # One row per period from here on: each fills the gap up to the next one.
    following = F.lead("period").over(Window.orderBy("period"))
    if grain == "day":
        last = F.coalesce(F.date_sub(following, 1), F.col("period"))
        covered = F.sequence(F.col("period"), last, F.expr("interval 1 day"))
    else:
        first = F.trunc("period", "month")
        last = F.coalesce(F.add_months(F.trunc(following, "month"), -1), first)
        covered = F.transform(F.sequence(first, last, F.expr("interval 1 month")), F.last_day)
    own = F.col("period") == F.col("_measured")
    filled = (
        measured.withColumn("_covered", covered)
        .withColumnRenamed("period", "_measured")
        .withColumn("period", F.explode("_covered"))
        .select(
            "period",
            F.when(own, F.col("revenue")).otherwise(0.0).alias("revenue"),
            F.when(own, F.col("total_cost")).otherwise(0.0).alias("total_cost"),
            F.when(own, F.col("missing_cost")).otherwise(0).alias("missing_cost"),
        )
    )
    known = (F.col("revenue") > 0) & (F.col("missing_cost") == 0)
    return filled.withColumn(
        "margin", F.when(known, (F.col("revenue") - F.col("total_cost")) / F.col("revenue"))
    )


def _revenue_by(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.sum("gross_sales_amount").alias("revenue"))
    )


def revenue_by_category(df: DataFrame) -> DataFrame:
    return _revenue_by(df, "category").select(title_case("category").alias("category"), "revenue")


def revenue_by_country(df: DataFrame) -> DataFrame:
    return (
        _revenue_by(df, "country")
        .orderBy(F.desc("revenue"), "country")
        .select(title_case("country").alias("country"), "revenue")
    )


# Spellings the alias roll-up knows on top of the caller's table.
EXTRA_ALIASES = [
    ("uk", "GBR", "United Kingdom"),
    ("south korea", "KOR", "Korea, Republic of"),
    ("russia", "RUS", "Russian Federation"),
]


def revenue_by_iso3(df: DataFrame, alias_df: DataFrame) -> DataFrame:
    """Revenue per country code, largest first; what no alias covers stays as one flagged row.

    ``alias_df`` holds (alias, iso3, name), aliases in lower case. The frame is
    summed per raw country text first, so the alias join sees distinct names only.
    """
    extra = alias_df.sparkSession.createDataFrame(EXTRA_ALIASES, ["alias", "iso3", "name"])
    aliases = extra.unionByName(
        alias_df.select("alias", "iso3", "name").join(extra.select("alias"), "alias", "left_anti")
    )
    raw = (
        df.groupBy("country")
        .agg(F.sum(to_money("gross_sales_amount")).alias("revenue"))
        .withColumn("alias", F.lower(F.trim("country")))
    )
    return (
        raw.join(aliases, "alias", "left")
        .groupBy("iso3")
        .agg(
            F.max("name").alias("country"),
            F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
        )
        .withColumn("unknown", F.col("iso3").isNull())
        .orderBy(F.desc("revenue"), F.asc_nulls_last("iso3"))
    )


def _by_product(df: DataFrame, *extra: Column) -> DataFrame:
    return (
        df.filter(F.col("product_name").isNotNull())
        .groupBy("product_name")
        .agg(
            F.sum("gross_sales_amount").alias("revenue"),
            F.sum("quantity").alias("units"),
            *extra,
        )
    )


def top_products(df: DataFrame, k: int = 10) -> DataFrame:
    return top_k(_by_product(df), [F.desc("revenue"), F.col("product_name")], k)


def top_products_orders(df: DataFrame, k: int = 10) -> DataFrame:
    orders = F.count_distinct("order_number").alias("orders")
    return top_k(_by_product(df, orders), [F.desc("revenue"), F.col("product_name")], k)


def product_totals(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("product_name") == name).agg(
        F.sum("gross_sales_amount").alias("revenue"),
        F.sum("quantity").alias("units"),
        F.count_distinct("order_number").alias("orders"),
    )


def recent_transactions(df: DataFrame, name: str, n: int = 50) -> DataFrame:
    """Newest ``n`` sales of a product with the buyer's name."""
    rows = df.filter(F.col("product_name") == name).select(
        "order_number",
        "order_date",
        full_name("first_name", "last_name").alias("customer_name"),
        "country",
        "quantity",
        "gross_sales_amount",
    )
    order = [
        F.desc("order_date"),
        F.col("order_number"),
        F.col("gross_sales_amount"),
        F.col("quantity"),
        F.col("customer_name"),
    ]
    return top_k(rows, order, n).withColumn(
        "order_date", F.date_format("order_date", "yyyy-MM-dd")
    )


def product_export(df: DataFrame, name: str) -> DataFrame:
    """All transactions of a product under their report headings."""
    return df.filter(F.col("product_name") == name).select(
        F.col("order_number").alias("Order Number"),
        F.col("order_date").alias("Order Date"),
        full_name("first_name", "last_name").alias("Customer"),
        F.col("country").alias("Country"),
        F.col("category").alias("Category"),
        F.col("quantity").alias("Quantity"),
        F.col("gross_sales_amount").alias("Revenue ($)"),
    )


def customer_summary(df: DataFrame) -> DataFrame:
    """Active customers and their ratios as one row, 0 when nobody bought."""
    return _per_customer(df).agg(*_customer_ratios()).na.fill(0.0)


def customer_kpis(df: DataFrame, start, end) -> DataFrame:
    """The customer ratios in the window and in the one before, from one scan."""
    by_window = (
        _per_customer(_two_windows(df, start, end), "_current")
        .groupBy("_current")
        .agg(*_customer_ratios())
    )
    return _metric_pairs(
        by_window,
        ["active_customers", "spend_per_customer", "orders_per_customer", "repeat_rate"],
    )


def customer_detail(df: DataFrame) -> DataFrame:
    """Single-order and repeat customers, largest and exact median spend, order volume."""
    customers = _per_customer(df)
    found = customers.agg(
        F.count_if(F.col("total_orders") == 1).alias("single_order_customers"),
        F.count_if(F.col("total_orders") > 1).alias("repeat_customers"),
        F.max("total_spend").alias("max_spend"),
        F.sum("total_orders").alias("total_orders"),
        safe_divide(F.sum("total_units"), F.count(F.lit(1))).alias("units_per_customer"),
    )
    return found.select(
        "single_order_customers",
        "repeat_customers",
        "max_spend",
        exact_median(customers, "total_spend").scalar().alias("median_spend"),
        "total_orders",
        "units_per_customer",
    )


def _rfm(df: DataFrame, end, rules: dict | None) -> DataFrame:
    rules = rules or RFM_RULES
    recency = F.datediff(F.lit(_day(end)), F.col("_last"))
    (champion_orders, champion_days) = rules["champion"]
    (loyal_orders, loyal_days) = rules["loyal"]
    frequency = F.col("frequency")
    # The order of the branches is part of the definition.
    label = (
        F.when((frequency >= champion_orders) & (F.col("recency") <= champion_days), "Champions")
        .when((frequency >= loyal_orders) & (F.col("recency") <= loyal_days), "Loyal Customers")
        .when(F.col("recency") > rules["lost_after"], "Hibernating / Lost")
        .otherwise("Promising / Recent")
    )
    return (
        df.filter(F.col("customer_key").isNotNull())
        .groupBy("customer_key")
        .agg(
            F.max("order_date").alias("_last"),
            F.count_distinct("order_number").alias("frequency"),
            F.sum("gross_sales_amount").alias("monetary"),
        )
        .withColumn("recency", recency)
        .withColumn("segment", label)
    )


def rfm_segments(df: DataFrame, end, rules: dict | None = None) -> DataFrame:
    return (
        _rfm(df, end, rules)
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy(F.desc("customers"), "segment")
    )


def rfm_summary(df: DataFrame, end, rules: dict | None = None) -> DataFrame:
    return (
        _rfm(df, end, rules)
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.sum("monetary").alias("total_segment_spend"),
            F.avg("monetary").alias("avg_spend_per_customer"),
        )
        .orderBy(F.desc("customer_count"), "segment")
    )


def spend_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Customers per equal-width spend bin; empty bins are left out."""
    spend = _per_customer(df).select(F.round("total_spend", 4).alias("spend"))
    span = spend.agg(
        F.struct(F.min("spend").alias("low"), F.max("spend").alias("high")).alias("span")
    ).scalar()
    placed = spend.withColumn("_span", span)
    low, high = F.col("_span.low"), F.col("_span.high")
    position = F.floor(F.try_divide((F.col("spend") - low) * bins, high - low))
    number = F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("long")
    return (
        placed.groupBy(number.alias("bin"), low.alias("_low"), high.alias("_high"))
        .agg(F.count(F.lit(1)).alias("customers"))
        .select(
            "bin",
            (F.col("_low") + F.col("bin") * (F.col("_high") - F.col("_low")) / bins).alias(
                "bin_start"
            ),
            "customers",
        )
    )


def top_customers(df: DataFrame, k: int = 10) -> DataFrame:
    """Best customers by name and country; people of one name and country merge."""
    by_name = (
        df.dropna(subset=["first_name", "last_name", "country"])
        .groupBy("first_name", "last_name", "country")
        .agg(
            F.sum("gross_sales_amount").alias("total_spend"),
            F.count_distinct("order_number").alias("total_orders"),
        )
    )
    order = [F.desc("total_spend"), F.col("first_name"), F.col("last_name"), F.col("country")]
    return top_k(by_name, order, k).withColumn(
        "customer_name", full_name("first_name", "last_name")
    )


def monthly_active(df: DataFrame) -> DataFrame:
    return df.groupBy(F.trunc("order_date", "month").alias("year_month")).agg(
        F.count_distinct("customer_key").alias("active_customers")
    )


# The "no filter" choice of each filter.
ALL_LABELS = {"category": "All Categories", "country": "All Countries"}


def filter_options(df: DataFrame) -> DataFrame:
    """Choices of the category and country filters, from one scan."""
    choices = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value"))
            for kind in ALL_LABELS
        ]
    )
    found = df.select(F.inline(choices)).filter(F.col("value").isNotNull()).distinct()
    fixed = df.sparkSession.createDataFrame(
        [(kind, "ALL", label) for kind, label in ALL_LABELS.items()], "kind string, value string, label string"
    )
    return fixed.unionByName(found.withColumn("label", title_case("value"))).orderBy(
        "kind", F.desc(F.col("value") == "ALL"), "value"
    )


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(
        F.date_format(F.min("order_date"), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max("order_date"), "yyyy-MM-dd").alias("max_date"),
    )


def default_window(df: DataFrame) -> DataFrame:
    """First and last order date of the latest year in the data."""
    yearly = (
        df.filter(F.col("order_date").isNotNull())
        .groupBy(F.year("order_date").alias("_year"))
        .agg(F.min("order_date").alias("start_date"), F.max("order_date").alias("end_date"))
    )
    return top_k(yearly, [F.desc("_year")], 1).drop("_year")


def _as_text(field) -> Column:
    # Doubles as two-place decimals, so that no exponent shows up in a report.
    if field.dataType.typeName() in ("double", "float", "decimal"):
        return F.col(field.name).cast("decimal(38,2)").cast("string")
    return F.col(field.name).cast("string")


def metric_rows(kpis: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One KPI row → (Metric, Value text) rows in the order of ``labels``."""
    texts = {f.name: _as_text(f) for f in kpis.schema.fields if f.name in labels}
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("Metric"), texts[name].alias("Value"))
            for name, label in labels.items()
        ]
    )
    return kpis.select(F.inline(rows))
