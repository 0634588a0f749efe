"""The merged star read every dashboard operator starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import safe_cast, to_money
from martwright.schemas import MERGED_COLUMNS


def merged_sales(
    fact: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    min_date: str = "2010-01-01",
    limit: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Fact with its product and customer attributes, 13 fixed columns.

    A real DATE column is compared as it is, so the bound reaches the scan;
    text dates are cast leniently and unreadable ones drop out. The full sort
    by fact key is only paid for when asked for (``ordered`` or ``limit``). A limit
    holds for the fact first: every sale is in the joined rows at least once and the
    order is by fact columns alone, so no later sale can be among the first ones.
    """
    order = ["sales_item_key", "order_date", "quantity", "gross_sales_amount", "unit_price"]
    day = F.col("order_date")
    if dict(fact.dtypes)["order_date"] != "date":
        day = safe_cast(day, "date")
    recent = fact.filter(day >= F.lit(min_date).cast("date")).withColumn("order_date", day)
    if limit is not None:
        recent = recent.orderBy(*order).limit(limit)
    prod = products.select("product_key", "product_name", "category", "cost")
    cust = customers.select("customer_key", "first_name", "last_name", "country")
    joined = recent.join(prod, "product_key", "left")
    joined = joined.join(cust, "customer_key", "left")
    if ordered or limit is not None:
        joined = joined.orderBy(*order)
    if limit is not None:
        joined = joined.limit(limit)
    money = {c: to_money(c) for c in ("gross_sales_amount", "unit_price", "cost")}
    return joined.withColumns(money).select(*MERGED_COLUMNS)
