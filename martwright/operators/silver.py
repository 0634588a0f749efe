"""Cleaning rules that turn bronze tables into silver ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.functions.columns import (
    as_column,
    as_day,
    as_stamp,
    decode,
    decode_set,
    lenient_date,
    safe_cast,
    safe_divide,
    strict_int_date,
)

# Source codes and their labels.
MARITAL_STATUS = {"S": "Single", "M": "Married"}
GENDER = {"F": "Female", "M": "Male"}
GENDER_SETS = {"Female": ["F", "FEMALE"], "Male": ["M", "MALE"]}
PRODUCT_LINE = {"M": "Mountain", "R": "Road", "S": "Standard", "T": "Touring"}
COUNTRIES = {"DE": "Germany", "US": "United States", "USA": "United States"}
CATEGORY_REMAP = {"CO_PD": "CO_PE"}
DEMOGRAPHIC_PREFIX = "NAS"
BIRTHDATE_FORMATS = ("yyyy-M-d", "yyyyMMdd")
MISSING_ORDER_DATE = "1900-01-01"


def latest_per_key(
    df: DataFrame, key: str, order_ts: Column | str, tiebreak: list[str] | None = None
) -> DataFrame:
    """Newest row of every non-NULL key.

    A max over (timestamp, tiebreak) combines before the shuffle, so a key with
    very many versions never gathers in one task as a ranking window would.
    NULL timestamps come last; equal timestamps are settled by the other columns.
    """
    tiebreak = tiebreak or [c for c in df.columns if c != key]
    rank = F.struct(as_column(order_ts).alias("_ts"), *[F.col(c) for c in tiebreak])
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max_by(row, rank).alias("_row"))
        .select("_row.*")
    )


def clean_text(
    df: DataFrame, text_cols: list[str], cast_cols: dict[str, str] | None = None
) -> DataFrame:
    """Trim text columns and leniently cast others, in place."""
    changes = {c: F.trim(F.col(c)) for c in text_cols}
    changes.update({c: safe_cast(c, to) for c, to in (cast_cols or {}).items()})
    return df.withColumns(changes)


def split_product_key(df: DataFrame, column: str) -> DataFrame:
    """Composite key → category id (five characters) and product key (from the seventh)."""
    raw = F.col(column)
    return df.withColumns(
        {
            "cat_id": F.replace(F.substring(raw, 1, 5), F.lit("-"), F.lit("_")),
            column: raw.substr(F.lit(7), F.length(raw)),
        }
    )


def clean_product(df: DataFrame, line_map: dict[str, str] | None = None) -> DataFrame:
    """Trim the name, default a missing cost to 0, decode the product line."""
    return df.withColumns(
        {
            "prd_nm": F.trim("prd_nm"),
            "prd_cost": F.coalesce(F.col("prd_cost"), F.lit(0.0)),
            "prd_line": decode("prd_line", line_map or PRODUCT_LINE),
        }
    )


def version_end_date(
    df: DataFrame, key: str, start_col: str, tiebreak: str, name: str = "prd_end_dt"
) -> DataFrame:
    """Day before the next version of the same key starts; NULL for the current one.

    Starts are compared as text. The window runs over the distinct starts of a
    key, so its size is bounded by calendar days rather than by rows. Rows with
    the same key and start follow each other by ``tiebreak`` (unique per row):
    all but the last of them are followed by their own start.
    """
    starts = df.groupBy(key, start_col).agg(F.max(tiebreak).alias("_last"))
    following = Window.partitionBy(key).orderBy(F.col(start_col).asc_nulls_last())
    starts = starts.select(
        F.col(key).alias("_key"),
        F.coalesce(F.col(start_col), F.lit("")).alias("_start"),
        F.col(start_col).isNull().alias("_open"),
        "_last",
        F.lead(start_col).over(following).alias("_next"),
    )
    tagged = df.withColumns(
        {
            "_key": F.col(key),
            "_start": F.coalesce(F.col(start_col), F.lit("")),
            "_open": F.col(start_col).isNull(),
        }
    )
    joined = tagged.join(starts, ["_key", "_start", "_open"], "left")
    next_start = F.when(F.col(tiebreak) == F.col("_last"), F.col("_next")).otherwise(
        F.col(start_col)
    )
    return joined.withColumn(name, F.date_sub(safe_cast(next_start, "date"), 1)).select(
        *[c for c in df.columns if c != name], name
    )


def int_date(column, fallback: str | None = None) -> Column:
    """yyyymmdd integer → date; not positive or not eight digits → NULL, else strict."""
    value = as_column(column)
    invalid = (value <= 0) | (F.length(value.cast("string")) != 8)
    parsed = F.when(~F.coalesce(invalid, F.lit(False)), strict_int_date(value))
    return parsed if fallback is None else F.coalesce(parsed, F.lit(fallback).cast("date"))


def repair_price(price, sales, quantity) -> Column:
    """Missing or zero price → sales / quantity (NULL for no quantity); else absolute."""
    price = as_column(price)
    return F.when(price.isNull() | (price == 0), safe_divide(sales, quantity)).otherwise(
        F.abs(price)
    )


def clamp_after(date, floor) -> Column:
    """A missing date, or one before ``floor``, becomes ``floor``."""
    date, floor = as_column(date), as_column(floor)
    return F.greatest(F.coalesce(date, floor), floor)


def repair_sales(sales, quantity, price) -> Column:
    """Missing or non-positive sales → quantity × repaired price."""
    sales = as_column(sales)
    return F.when(
        sales.isNull() | (sales <= 0), as_column(quantity) * as_column(price)
    ).otherwise(sales)


def strip_prefix(column, prefix: str = DEMOGRAPHIC_PREFIX) -> Column:
    value = as_column(column)
    rest = value.substr(F.lit(len(prefix) + 1), F.length(value))
    return F.when(value.startswith(prefix), rest).otherwise(value)


def parse_date_any(column, formats=BIRTHDATE_FORMATS) -> Column:
    """First format that fits; NULL when none does."""
    return F.coalesce(*[lenient_date(column, f) for f in formats])


def null_if_future(column, as_of=None) -> Column:
    value = as_column(column)
    return F.when(value > as_day(as_of), F.lit(None).cast("date")).otherwise(value)


def standardize_country(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Hyphens out of ``cid``; country codes to names, blank to NULL, else trimmed."""
    name = F.trim("cntry")
    country = F.when(name == "", F.lit(None).cast("string"))
    for code, label in (mapping or COUNTRIES).items():
        country = country.when(name == code, label)
    return df.withColumns(
        {
            "cid": F.replace(F.col("cid"), F.lit("-"), F.lit("")),
            "cntry": country.otherwise(name),
        }
    )


def remap(df: DataFrame, column: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Replace single values of a text column, leaving the others alone."""
    return df.replace(mapping or CATEGORY_REMAP, subset=[column])


def with_load_stamp(df: DataFrame, as_of=None) -> DataFrame:
    stamp = F.current_timestamp() if as_of is None else as_stamp(as_of)
    return df.withColumn("ingested_at", stamp)


def stg_customer(bronze: DataFrame, as_of=None) -> DataFrame:
    newest = latest_per_key(bronze, "cst_id", F.col("cst_create_date").cast("timestamp"))
    cleaned = clean_text(
        newest, ["cst_key", "cst_firstname", "cst_lastname"], {"cst_id": "bigint"}
    ).withColumns(
        {
            "cst_marital_status": decode("cst_marital_status", MARITAL_STATUS),
            "cst_gndr": decode("cst_gndr", GENDER),
            "cst_create_date": F.col("cst_create_date").cast("date"),
        }
    )
    return with_load_stamp(cleaned, as_of)


def stg_product(bronze: DataFrame, as_of=None) -> DataFrame:
    # The source's own end date is ignored; versions are ordered by the raw key.
    versions = version_end_date(bronze.drop("prd_end_dt"), "prd_key", "prd_start_dt", "prd_id")
    cleaned = clean_text(
        clean_product(split_product_key(versions, "prd_key")),
        [],
        {"prd_id": "bigint", "prd_start_dt": "date"},
    )
    return with_load_stamp(
        cleaned.select(
            "prd_id",
            "cat_id",
            "prd_key",
            "prd_nm",
            "prd_cost",
            "prd_line",
            "prd_start_dt",
            "prd_end_dt",
        ),
        as_of,
    )


def stg_sales(bronze: DataFrame, as_of=None) -> DataFrame:
    based = bronze.select(
        "sls_ord_num",
        "sls_prd_key",
        "sls_cust_id",
        int_date("sls_order_dt", MISSING_ORDER_DATE).alias("sls_order_dt"),
        int_date("sls_ship_dt").alias("_ship"),
        int_date("sls_due_dt").alias("_due"),
        "sls_quantity",
        repair_price("sls_price", "sls_sales", "sls_quantity").alias("sls_price"),
        F.col("sls_sales").alias("_sales"),
    )
    return with_load_stamp(
        based.select(
            "sls_ord_num",
            "sls_prd_key",
            "sls_cust_id",
            "sls_order_dt",
            clamp_after("_ship", "sls_order_dt").alias("sls_ship_dt"),
            clamp_after("_due", "sls_order_dt").alias("sls_due_dt"),
            "sls_quantity",
            "sls_price",
            repair_sales("_sales", "sls_quantity", "sls_price").alias("sls_sales"),
        ),
        as_of,
    )


def stg_demographics(bronze: DataFrame, as_of=None, today=None) -> DataFrame:
    return with_load_stamp(
        bronze.select(
            strip_prefix("cid").alias("cid"),
            null_if_future(parse_date_any("bdate"), today).alias("bdate"),
            decode_set("gen", GENDER_SETS).alias("gen"),
        ),
        as_of,
    )


def stg_location(bronze: DataFrame, as_of=None) -> DataFrame:
    return with_load_stamp(standardize_country(bronze.select("cid", "cntry")), as_of)


def stg_category(bronze: DataFrame, as_of=None) -> DataFrame:
    return with_load_stamp(
        remap(bronze, "id").select("id", "cat", "subcat", "maintenance"), as_of
    )
