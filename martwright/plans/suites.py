"""The declared data tests of each layer, as Check lists.

Fixed values: the rules, columns, limits and severities are the established declaration.
"""

from __future__ import annotations

from martwright.operators.quality import (
    Check,
    accepted,
    clean_trimmed,
    date_before,
    date_before_any,
    expression,
    not_null,
    relationships,
    unique,
)
from martwright.operators.silver import MISSING_ORDER_DATE


def _each(make, table: str, columns: str, severity: str) -> list[Check]:
    return [make(table, column, severity) for column in columns.split()]


def bronze_checks(day: str = "current_date()") -> list[Check]:
    """Raw tables: every rule only warns, except two parent checks left at the default."""
    cust, prd, sales = "crm_cust_info", "crm_prd_info", "crm_sales_details"
    demo, loc, cat = "erp_cust_az12", "erp_loc_a101", "erp_px_cat_g1v2"
    eight_digits = "> 0 and length(cast({0} as string)) = 8"
    return [
        *_each(unique, cust, "cst_id", "warn"),
        *_each(not_null, cust, "cst_id cst_key cst_firstname cst_lastname cst_create_date", "warn"),
        *_each(
            clean_trimmed,
            cust,
            "cst_key cst_firstname cst_lastname cst_marital_status cst_gndr",
            "warn",
        ),
        *_each(unique, prd, "prd_id", "warn"),
        *_each(not_null, prd, "prd_id prd_cost prd_start_dt", "warn"),
        *_each(clean_trimmed, prd, "prd_nm", "warn"),
        # The severity of this rule sits where the runner ignores it.
        expression(prd, "prd_cost", ">= 0"),
        date_before(prd, "prd_start_dt", "prd_end_dt", "warn"),
        *_each(clean_trimmed, sales, "sls_ord_num sls_prd_key", "warn"),
        relationships(sales, "sls_prd_key", "stg_crm_prd_info", "prd_key"),
        relationships(sales, "sls_cust_id", "stg_crm_cust_info", "cst_id"),
        *[
            expression(sales, column, eight_digits.format(column), "warn")
            for column in ("sls_order_dt", "sls_ship_dt", "sls_due_dt")
        ],
        date_before_any(sales, "sls_order_dt", ["sls_ship_dt", "sls_due_dt"], "warn"),
        *_each(not_null, sales, "sls_sales sls_quantity sls_price", "warn"),
        *[
            expression(sales, column, "> 0", "warn")
            for column in ("sls_sales", "sls_quantity", "sls_price")
        ],
        *_each(not_null, demo, "cid", "warn"),
        *_each(clean_trimmed, demo, "cid gen", "warn"),
        expression(
            demo, "bdate", f"is null or try_cast(bdate as date) <= {day}", "warn"
        ),
        *_each(not_null, loc, "cid", "warn"),
        *_each(unique, loc, "cid", "warn"),
        *_each(clean_trimmed, loc, "cid cntry", "warn"),
        *_each(not_null, cat, "id", "warn"),
        *_each(unique, cat, "id", "warn"),
        *_each(clean_trimmed, cat, "id cat subcat maintenance", "warn"),
    ]


def silver_checks(day: str = "current_date()") -> list[Check]:
    cust, prd, sales = "stg_crm_cust_info", "stg_crm_prd_info", "stg_crm_sales_details"
    demo, loc, cat = "stg_erp_cust_az12", "stg_erp_loc_a101", "stg_erp_px_cat_g1v2"
    since_1900 = f">= date '{MISSING_ORDER_DATE}'"
    return [
        *_each(unique, cust, "cst_id", "error"),
        *_each(not_null, cust, "cst_id cst_key cst_firstname cst_lastname", "error"),
        *_each(
            clean_trimmed,
            cust,
            "cst_key cst_firstname cst_lastname cst_marital_status cst_gndr",
            "error",
        ),
        accepted(cust, "cst_marital_status", ["Single", "Married"]),
        accepted(cust, "cst_gndr", ["Male", "Female"]),
        *_each(unique, prd, "prd_id", "error"),
        *_each(
            not_null,
            prd,
            "prd_id cat_id prd_key prd_nm prd_cost prd_start_dt ingested_at",
            "error",
        ),
        *_each(clean_trimmed, prd, "cat_id prd_nm prd_line", "error"),
        accepted(prd, "prd_line", ["Mountain", "Road", "Standard", "Touring"]),
        *_each(clean_trimmed, sales, "sls_ord_num sls_prd_key", "error"),
        relationships(sales, "sls_prd_key", prd, "prd_key"),
        relationships(sales, "sls_cust_id", cust, "cst_id"),
        *_each(not_null, sales, "sls_order_dt sls_sales sls_quantity sls_price", "error"),
        *[
            expression(sales, column, since_1900)
            for column in ("sls_order_dt", "sls_ship_dt", "sls_due_dt")
        ],
        date_before_any(sales, "sls_order_dt", ["sls_ship_dt", "sls_due_dt"]),
        *[
            expression(sales, column, "> 0")
            for column in ("sls_sales", "sls_quantity", "sls_price")
        ],
        *_each(not_null, demo, "cid", "error"),
        *_each(clean_trimmed, demo, "cid gen", "error"),
        relationships(demo, "cid", cust, "cst_key"),
        expression(demo, "bdate", f"<= {day}"),
        expression(demo, "bdate", since_1900, "warn", label="since_1900"),
        accepted(demo, "gen", ["Male", "Female"]),
        *_each(not_null, loc, "cid", "error"),
        *_each(unique, loc, "cid", "error"),
        *_each(clean_trimmed, loc, "cid cntry", "error"),
        relationships(loc, "cid", cust, "cst_key"),
        *_each(not_null, cat, "id", "error"),
        *_each(unique, cat, "id", "error"),
        relationships(cat, "id", prd, "cat_id"),
        *_each(clean_trimmed, cat, "cat subcat maintenance", "error"),
    ]


def gold_checks() -> list[Check]:
    cust, prd, fact, mart = "dim_customers", "dim_products", "fct_sales", "product_360"
    return [
        *_each(unique, cust, "customer_key", "error"),
        *_each(not_null, cust, "customer_key", "error"),
        accepted(cust, "gender", ["Male", "Female", "n/a"]),
        *_each(unique, prd, "product_key product_id", "error"),
        *_each(not_null, prd, "product_key product_id category", "error"),
        expression(prd, "cost", ">= 0"),
        *_each(unique, fact, "sales_item_key", "error"),
        *_each(not_null, fact, "sales_item_key customer_key product_key", "error"),
        relationships(fact, "customer_key", cust, "customer_key"),
        relationships(fact, "product_key", prd, "product_key"),
        expression(fact, "gross_sales_amount", ">= 0"),
        *_each(unique, mart, "product_key", "error"),
        *_each(not_null, mart, "product_key", "error"),
        relationships(mart, "product_key", prd, "product_key"),
    ]


def all_checks(as_of=None) -> list[Check]:
    """Every declared check; dates are compared with the day of the run, today if not given."""
    day = "current_date()" if as_of is None else f"to_date(timestamp '{as_of}')"
    return [*bronze_checks(day), *silver_checks(day), *gold_checks()]
