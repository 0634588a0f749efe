"""Registered queries: a callable over the benchmark tables plus its check in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.adapters import SQL as SHAPES
from martwright.adapters import portable_sql, shaped


@dataclass(frozen=True)
class Query:
    function: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.on(Tables(spark, folder))

    def on(self, tables: Tables) -> DataFrame:
        return plain(self.function(tables))


class Catalog(dict):
    """Name → Query; ``add`` is the decorator the sections register with."""

    def add(self, name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
        def register(function):
            self[name] = Query(function, None if sql is None else with_shapes(sql, uses))
            return function

        return register


class Tables:
    """Lazy access to the tables of one folder by attribute.

    Adapted shapes are derived from the benchmark tables unless ``stored`` names
    a directory that holds them.
    """

    def __init__(self, spark: SparkSession, folder: str, stored: dict[str, str] | None = None):
        self.spark, self.folder, self.stored = spark, folder, stored or {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.stored:
            return self.spark.read.parquet(self.stored[name])
        if name in SHAPES:
            return shaped(self.spark, self.folder, name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def with_shapes(sql: str, uses: tuple[str, ...]) -> str:
    """Prefix the adapted tables a check needs as common table expressions."""
    ctes = [f"{name} AS ({portable_sql(name) if name in SHAPES else EXTRA_CTES[name]})" for name in uses]
    if not ctes:
        return sql.strip()
    body = sql.strip()
    head = "WITH " + ",\n".join(ctes)
    return f"{head},\n{body[5:].lstrip()}" if body.upper().startswith("WITH ") else f"{head}\n{body}"


MERGED_SINCE = "1995-06-01"

EXTRA_CTES = {
    "merged": f"""
SELECT f.product_key, f.customer_key, f.order_date, f.order_number, f.quantity,
       cast(f.gross_sales_amount AS double) AS gross_sales_amount,
       cast(f.unit_price AS double) AS unit_price,
       p.product_name, p.category, cast(p.cost AS double) AS cost,
       c.first_name, c.last_name, c.country
FROM fct_sales f
LEFT JOIN dim_products p ON f.product_key = p.product_key
LEFT JOIN dim_customers c ON f.customer_key = c.customer_key
WHERE f.order_date >= date '{MERGED_SINCE}'""",
}

GOLD = ("fct_sales", "dim_products", "dim_customers")
MERGED = (*GOLD, "merged")


def plain(df: DataFrame) -> DataFrame:
    """Engine-neutral output types: dates and timestamps as text, decimals as doubles."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind == "date":
            column = column.cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif kind == "decimal":
            column = column.cast("double")
        elif kind in ("integer", "short", "byte"):
            column = column.cast("long")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Round doubles for comparison; sums of doubles depend on their order."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def r(expression: str, places: int = 2) -> str:
    """The same rounding in SQL: through a decimal, half away from zero."""
    return f"cast(round(cast({expression} AS decimal(38, 10)), {places}) AS double)"


def d(expression: str) -> str:
    """A date as text in SQL."""
    return f"cast(cast({expression} AS date) AS varchar)"
