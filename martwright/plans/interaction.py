"""What one filter change on the sales dashboard computes, from a shared slice."""

from __future__ import annotations

from pyspark.sql import DataFrame

from martwright.operators import kpis


def sales_page(merged: DataFrame, start, end, category="ALL", country="ALL") -> dict[str, DataFrame]:
    """Totals, changes, trends and rankings of the overview page, all lazy.

    ``merged`` is best a stored or cached frame: every entry reads it once.
    """
    sliced = kpis.slice_sales(merged, start, end, category, country)
    return {
        "totals": kpis.kpi_totals(sliced),
        "ratios": kpis.kpi_ratios(sliced),
        "change": kpis.period_over_period(merged, start, end, None, category, country),
        "trend": kpis.kpi_trend_product(sliced, start, end),
        "margin": kpis.sales_margin_trend(sliced, start, end),
        "by_category": kpis.revenue_by_category(sliced),
        "by_country": kpis.revenue_by_country(sliced),
        "top_products": kpis.top_products(sliced),
    }


def customer_page(merged: DataFrame, start, end, category="ALL", country="ALL") -> dict[str, DataFrame]:
    """Ratios, segments, distribution and rankings of the customer page, all lazy
    but ``detail``, whose exact median sorts right away."""
    sliced = kpis.slice_sales(merged, start, end, category, country)
    everywhere = merged
    if category and category != "ALL":
        everywhere = everywhere.filter(everywhere["category"] == category)
    if country and country != "ALL":
        everywhere = everywhere.filter(everywhere["country"] == country)
    return {
        "kpis": kpis.customer_kpis(everywhere, start, end),
        "detail": kpis.customer_detail(sliced),
        "trend": kpis.kpi_trend_customer(sliced, start, end),
        "rfm": kpis.rfm_segments(sliced, end),
        "rfm_summary": kpis.rfm_summary(sliced, end),
        "spend": kpis.spend_histogram(sliced),
        "top_customers": kpis.top_customers(sliced),
        "monthly_active": kpis.monthly_active(sliced),
    }
