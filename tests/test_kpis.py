import datetime as dt
from decimal import Decimal

import pytest
from conftest import row_set, rows
from pyspark.sql import functions as F

from martwright.operators import analyses, kpis
from martwright.plans.interaction import customer_page, sales_page
from martwright.schemas import MERGED_COLUMNS
from martwright.sources.reports import report_customer, report_product
from martwright.sources.star import merged_sales

MERGED = (
    "product_key string, customer_key string, order_date date, order_number string, quantity long,"
    "gross_sales_amount double, unit_price double, product_name string, category string,"
    "cost double, first_name string, last_name string, country string"
)


@pytest.fixture
def merged(frame):
    def make(*partial):
        base = dict.fromkeys(MERGED_COLUMNS)
        data = []
        for part in partial:
            row = {**base, **part}
            if isinstance(row["order_date"], str):
                row["order_date"] = dt.date.fromisoformat(row["order_date"])
            data.append(tuple(row[c] for c in MERGED_COLUMNS))
        return frame(data, MERGED)

    return make


def sale(day, order, customer, amount, units, **more):
    return {
        "order_date": day,
        "order_number": order,
        "customer_key": customer,
        "gross_sales_amount": float(amount),
        "quantity": units,
        **more,
    }


@pytest.fixture
def two_weeks(merged):
    return merged(
        sale("2026-01-03", "a", "one", 10, 1),
        sale("2026-01-03", "a", "one", 20, 2),
        sale("2026-01-03", "b", "two", 70, 7),
        sale("2026-01-10", "c", "one", 60, 6),
        sale("2026-01-10", "d", "one", 40, 4),
    )


def columns_of(df, *names):
    ordered = df.orderBy("period_start").collect()
    return [[row[name] for row in ordered] for name in names]


def test_weekly_buckets(two_weeks):
    trend = kpis.kpi_trend_product(two_weeks, "2026-01-03", "2026-01-25")
    assert columns_of(trend, "revenue", "orders", "units", "customers", "partial") == [
        [100, 100, 0, 0],
        [2, 2, 0, 0],
        [10, 10, 0, 0],
        [2, 1, 0, 0],
        [False, False, False, True],
    ]


def test_customer_buckets_are_not_cumulative(two_weeks):
    trend = kpis.kpi_trend_customer(two_weeks, "2026-01-03", "2026-01-25")
    assert columns_of(
        trend, "active_customers", "spend_per_customer", "orders_per_customer", "repeat_rate"
    ) == [[2, 1, 0, 0], [50, 100, None, None], [1, 2, None, None], [0, 100, None, None]]


def test_monthly_buckets_are_clipped(two_weeks):
    trend = kpis.kpi_trend_product(two_weeks, "2025-11-15", "2026-01-20")
    assert columns_of(trend, "revenue", "partial", "period_start", "period_end") == [
        [0, 0, 200],
        [True, False, True],
        [dt.date(2025, 11, 15), dt.date(2025, 12, 1), dt.date(2026, 1, 1)],
        [dt.date(2025, 11, 30), dt.date(2025, 12, 31), dt.date(2026, 1, 20)],
    ]


def test_bucket_grain_boundary(two_weeks):
    assert kpis.kpi_trend_product(two_weeks, "2026-01-01", "2026-03-01").count() == 9  # 60 days
    assert kpis.kpi_trend_product(two_weeks, "2026-01-01", "2026-03-02").count() == 3  # 61 days


def test_endpoints_and_islands(frame):
    trend = frame(
        [(1, None), (2, 5.0), (3, 6.0), (4, None), (5, 7.0), (6, None)], "p int, v double"
    )
    assert rows(kpis.trend_endpoints(trend, ["v"], "p")) == [("v", 2, 5.0, 5, 7.0, 6)]
    assert rows(kpis.gap_islands(trend, "p", "v").orderBy("p")) == [
        (2, 5.0, 1),
        (3, 6.0, 1),
        (5, 7.0, 2),
    ]


def margin_frame(merged, **first):
    return merged(
        {**sale("2026-01-01", "a", "c", 100, 2, cost=40.0), **first},
        sale("2026-01-01", "b", "c", 900, 3, cost=100.0),
        sale("2026-01-03", "c", "c", 100, 1, cost=150.0),
    )


def test_weighted_margin_and_gap(merged):
    trend = kpis.sales_margin_trend(margin_frame(merged), "2026-01-01", "2026-01-31")
    daily = rows(trend.orderBy("period"), "revenue", "margin")
    assert daily == [(1000, pytest.approx(0.62)), (0, None), (100, -0.5)]
    monthly = kpis.sales_margin_trend(margin_frame(merged), "2026-01-01", "2026-01-31", "month")
    assert rows(monthly, "period", "margin") == [
        (dt.date(2026, 1, 31), pytest.approx((1100 - 530) / 1100))
    ]


def test_invalid_cost_or_quantity_never_invents_a_margin(merged):
    for bad in ({"cost": None}, {"cost": -5.0}, {"cost": float("inf")}, {"quantity": None}):
        trend = kpis.sales_margin_trend(margin_frame(merged, **bad), "2026-01-01", "2026-01-31")
        first = trend.orderBy("period").first()
        assert (first.revenue, first.margin) == (1000, None), bad


def test_margin_grain_switches_after_sixty_days(merged):
    df = margin_frame(merged)
    assert kpis.sales_margin_trend(df, "2026-01-01", "2026-03-02").count() == 3
    assert kpis.sales_margin_trend(df, "2026-01-01", "2026-03-03").count() == 1


def test_country_aliases_and_unknown_revenue(merged, frame):
    data = [("US", 10), ("United States", 20), ("DE", 40), (None, 5), ("Atlantis", 6), (" ph", 80)]
    df = merged(*[{"country": c, "gross_sales_amount": float(v)} for c, v in data])
    aliases = frame(
        [("us", "USA", "US"), ("united states", "USA", "US"), ("de", "DEU", "DE"), ("ph", "PHL", "PH")],
        "alias string, iso3 string, name string",
    )
    got = {r.iso3: (r.revenue, r.unknown) for r in kpis.revenue_by_iso3(df, aliases).collect()}
    assert got == {"USA": (30, False), "DEU": (40, False), "PHL": (80, False), None: (11, True)}


def test_top_products(merged):
    df = merged(
        *[
            {"product_name": f"P{i}", "gross_sales_amount": 10.0 * i, "quantity": i}
            for i in range(12)
        ]
    )
    got = rows(kpis.top_products(df))
    assert len(got) == 10 and got[0] == ("P11", 110.0, 11)


FACT = (
    "sales_item_key string, product_key string, customer_key string, order_date string,"
    "order_number string, quantity long, gross_sales_amount string, unit_price string"
)


def star(frame, *dates, amount="20"):
    fact = frame(
        [(f"s{i}", "p1", "c1", day, str(i), 1, amount, amount) for i, day in enumerate(dates)],
        FACT,
    )
    products = frame(
        [("p1", "Bike", "bikes", Decimal("2.75"))],
        "product_key string, product_name string, category string, cost decimal(38,9)",
    )
    customers = frame(
        [("c1", "A", "B", "PH")],
        "customer_key string, first_name string, last_name string, country string",
    )
    return fact, products, customers


def test_merged_frame_drops_old_and_unreadable_dates(frame):
    got = merged_sales(*star(frame, "2009-12-31", None, "bad-date"))
    assert got.columns == MERGED_COLUMNS and got.count() == 0
    assert rows(kpis.date_bounds(got)) == [(None, None)]


def test_merged_frame_keeps_joins_and_types(frame):
    got = merged_sales(*star(frame, "2010-01-01", "2026-09-01"))
    assert rows(got, "product_name", "country", "cost", "gross_sales_amount") == [
        ("Bike", "PH", 2.75, 20.0)
    ] * 2
    assert rows(kpis.date_bounds(got)) == [("2010-01-01", "2026-09-01")]
    assert dict(got.dtypes)["order_date"] == "date"


def test_merged_frame_without_dimensions_or_numbers(frame):
    fact, products, customers = star(frame, "2026-09-01", amount="not-a-number")
    got = merged_sales(fact, products.limit(0), customers.limit(0))
    assert rows(got, "category", "gross_sales_amount", "unit_price") == [(None, None, None)]


def test_slice_and_empty_dates(merged):
    df = merged(
        {"order_date": "2026-01-01", "category": "bikes", "country": "US"},
        {"order_date": "2026-01-02", "category": "bikes", "country": "PH"},
        {"order_date": "2026-01-02", "category": "parts", "country": "PH"},
    )
    assert kpis.slice_sales(df, "2026-01-02", "2026-01-02", "bikes", "PH").count() == 1
    empty = kpis.slice_sales(df, None, None)
    assert empty.count() == 0 and empty.columns == df.columns


def test_empty_slice_gives_zero_kpis(merged):
    nothing = merged().limit(0)
    assert rows(kpis.kpi_totals(nothing)) == [(0.0, 0, 0, 0)]
    assert set(rows(kpis.kpi_ratios(nothing))[0]) == {0, 0.0}
    change = kpis.period_over_period(nothing, "2026-01-01", "2026-01-31")
    assert set(rows(change, "current_value", "prior_value", "pct_change")) == {(0.0, 0.0, None)}
    assert rows(kpis.customer_summary(nothing)) == [(0, 0.0, 0.0, 0.0)]


def test_period_over_period_windows_touch(two_weeks):
    got = {
        r.metric: (r.current_value, r.prior_value, r.pct_change)
        for r in kpis.period_over_period(two_weeks, "2026-01-08", "2026-01-14").collect()
    }
    assert got["sales"] == (100, 100, 0.0)
    assert got["orders"] == (2, 2, 0.0)
    assert got["customers"] == (1, 2, -50.0)
    apart = kpis.period_over_period(two_weeks, "2026-01-10", "2026-01-12")
    assert {r.metric: r.pct_change for r in apart.collect()}["sales"] is None


def test_customer_kpis_and_detail(two_weeks):
    got = {r.metric: r.current_value for r in kpis.customer_kpis(two_weeks, "2026-01-03", "2026-01-25").collect()}
    assert got == {
        "active_customers": 2,
        "spend_per_customer": 100,
        "orders_per_customer": 2,
        "repeat_rate": 50,
    }
    assert rows(kpis.customer_detail(two_weeks)) == [(1, 1, 130.0, 100.0, 4, 10.0)]


def test_rfm_branches_in_order(merged):
    spec = {"champ": (3, 10), "loyal": (2, 50), "new": (1, 80), "lost": (1, 200), "slow": (3, 95)}
    end = dt.date(2026, 6, 30)
    data = []
    for who, (orders, age) in spec.items():
        for n in range(orders):
            day = end - dt.timedelta(days=age if n == 0 else 300)
            data.append(sale(day, f"{who}{n}", who, 10, 1))
    df = merged(*data, sale(end, "x", None, 99, 1))
    assert dict(rows(kpis.rfm_segments(df, end))) == {
        "Champions": 1,
        "Loyal Customers": 1,
        "Promising / Recent": 1,
        "Hibernating / Lost": 2,
    }
    summary = {r.segment: r.avg_spend_per_customer for r in kpis.rfm_summary(df, end).collect()}
    assert summary["Hibernating / Lost"] == 20.0


def test_histogram_puts_the_largest_in_the_last_bin(merged):
    df = merged(*[sale("2026-01-01", str(i), f"c{i}", i, 1) for i in range(31)])
    got = dict(rows(kpis.spend_histogram(df), "bin", "customers"))
    assert got[29] == 2 and sum(got.values()) == 31 and len(got) == 30
    same = merged(*[sale("2026-01-01", str(i), f"c{i}", 5, 1) for i in range(3)])
    assert rows(kpis.spend_histogram(same), "bin", "customers") == [(0, 3)]


def test_top_customers_merge_by_name_and_drop_nulls(merged):
    def person(key, first, country, amount):
        return sale("2026-01-01", key, key, amount, 1, first_name=first, last_name="X", country=country)

    df = merged(
        person("1", "Ann", "PH", 5),
        person("2", "Ann", "PH", 6),
        person("3", None, "PH", 100),
        person("4", "Bob", None, 100),
    )
    got = rows(kpis.top_customers(df), "customer_name", "total_spend", "total_orders")
    assert got == [("Ann X", 11.0, 2)]


def test_options_default_window_and_recent(merged):
    df = merged(
        sale("2024-05-01", "1", "c", 1, 1, category="road bikes", product_name="P"),
        sale("2025-02-01", "2", "c", 1, 1, country="US", product_name="P", first_name="A"),
        sale("2025-07-01", "3", "c", 1, 1, country="US", product_name="Q"),
    )
    assert rows(kpis.filter_options(df)) == [
        ("category", "ALL", "All Categories"),
        ("category", "road bikes", "Road Bikes"),
        ("country", "ALL", "All Countries"),
        ("country", "US", "Us"),
    ]
    assert rows(kpis.default_window(df)) == [(dt.date(2025, 2, 1), dt.date(2025, 7, 1))]
    assert rows(kpis.recent_transactions(df, "P", 1), "order_number", "order_date", "customer_name") == [
        ("2", "2025-02-01", "A ")
    ]
    assert kpis.product_export(df, "P").columns[0] == "Order Number"


def test_metric_rows_have_no_exponent(frame):
    kpi = frame([(30_012_345_678.5, 3)], "sales double, orders long")
    assert rows(kpis.metric_rows(kpi, {"sales": "Sales", "orders": "Orders"})) == [
        ("Sales", "30012345678.50"),
        ("Orders", "3"),
    ]


def test_reports_and_pages(two_weeks):
    filters = {"start": "2026-01-01", "end": "2026-01-31"}
    kpi, top = report_product(two_weeks.withColumn("product_name", F.lit("P")), filters)
    assert dict(rows(kpi))["Total Revenue ($)"] == "200.00"
    assert rows(top) == [("P", 200.0, 20, 4)]
    kpi, _ = report_customer(two_weeks, filters)
    assert dict(rows(kpi))["Repeat Rate (%)"] == "50.0%"
    page = sales_page(two_weeks, "2026-01-03", "2026-01-25")
    assert rows(page["totals"]) == [(200.0, 4, 20, 2)]
    assert {name: frame.count() for name, frame in page.items()}["trend"] == 4
    people = customer_page(two_weeks, "2026-01-03", "2026-01-25")
    assert sum(r.customers for r in people["rfm"].collect()) == 2


def test_notebook_rules_differ_from_the_star_ones(frame):
    from test_silver import fact_rows

    fact = fact_rows(frame)
    products = frame([("p1", "Bikes"), ("p2", None)], "product_key string, category string")
    kept = {r.category for r in analyses.category_share(fact, products).collect()}
    dropped = {r.category for r in analyses.category_share_dropnull(fact, products).collect()}
    assert kept == {"Bikes", None} and dropped == {"Bikes"}
    yearly = rows(analyses.yearly_customers(fact), "order_year", "total_sales")
    assert ("2021", 60000) in yearly  # cut, while the star version rounds to 60001
    assert dict(rows(analyses.yearly_running(fact), F.year("order_date"), "total_sales"))[2021] == 60001
    counts = dict(rows(analyses.segment_counts(fact)))
    assert counts == {"VIP": 1, "New": 1}


def test_cost_bands_put_missing_cost_last(frame):
    products = frame([("a", 99.0), ("b", 100.0), ("c", 1000.0), ("d", None)], "product_key string, cost double")
    assert rows(analyses.cost_bands(products)) == [
        ("Below 100", 1),
        ("100 - 500", 1),
        ("500 - 1000", 1),
        ("Above 1000", 1),
    ]


def test_rounding_text_shares(frame):
    fact = frame(
        [("p1", Decimal(1), 1), ("p2", Decimal(2), 1)],
        "product_key string, gross_sales_amount decimal(38,9), quantity long",
    )
    products = frame([("p1", "A"), ("p2", "B")], "product_key string, category string")
    assert row_set(analyses.category_share(fact, products), "category", "percentage_of_total") == [
        ("A", "33.33%"),
        ("B", "66.67%"),
    ]
