"""Scalar column helpers shared by every layer; all stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: placeholder hashed in place of a NULL key part.
NULL_KEY_PART = "_dbt_utils_surrogate_key_null_"


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_cast(column, to: str) -> Column:
    """Cast that gives NULL for malformed input."""
    return as_column(column).try_cast(to)


def strict_date(column, pattern: str = "yyyyMMdd") -> Column:
    """Parse that raises on malformed input (ANSI sessions)."""
    return F.to_date(as_column(column).cast("string"), pattern)


def strict_int_date(column) -> Column:
    """yyyymmdd integer → date by arithmetic; raises on an impossible date (ANSI sessions)."""
    value = as_column(column)
    days = F.call_function("div", value, F.lit(100))
    year = F.call_function("div", value, F.lit(10000))
    return F.make_date(year.cast("int"), (days % 100).cast("int"), (value % 100).cast("int"))


def lenient_date(column, pattern: str) -> Column:
    return F.try_to_date(as_column(column).cast("string"), pattern)


def days_between(end, start) -> Column:
    return F.datediff(as_column(end), as_column(start))


def months_between_boundaries(end, start) -> Column:
    """Calendar month boundaries crossed, not whole months elapsed."""
    end, start = as_column(end), as_column(start)
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))


def years_between_boundaries(end, start) -> Column:
    return F.year(as_column(end)) - F.year(as_column(start))


def safe_divide(numerator, denominator) -> Column:
    """Double division; NULL where the divisor is zero."""
    return F.try_divide(
        as_column(numerator).cast("double"), as_column(denominator).cast("double")
    )


def divide_or_zero(numerator, denominator) -> Column:
    return F.coalesce(safe_divide(numerator, denominator), F.lit(0.0))


def round_to_long(column) -> Column:
    """Rounding cast; a plain Spark cast would truncate."""
    return F.round(as_column(column)).cast("long")


def half_even_to_long(column) -> Column:
    return F.bround(as_column(column).cast("double")).cast("long")


def pct_change(current, previous) -> Column:
    """Percent change against the absolute prior value; NULL when prior is 0 or NULL."""
    current = as_column(current).cast("double")
    previous = as_column(previous).cast("double")
    return F.try_divide(current - previous, F.abs(previous)) * 100


def is_finite(column) -> Column:
    """False for NULL, NaN and both infinities."""
    value = as_column(column).cast("double")
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def to_money(column) -> Column:
    """Numeric text, decimals or numbers to double; NULL when not a number."""
    value = safe_cast(column, "double")
    return F.when(~F.isnan(value), value)


def title_case(column) -> Column:
    return F.initcap(as_column(column))


def file_token(column) -> Column:
    """Every character that is neither letter nor digit becomes ``_``."""
    return F.regexp_replace(as_column(column), r"[^\p{L}\p{N}]", "_")


def full_name(first, last) -> Column:
    """Names joined by a blank, NULL parts as empty text."""
    blank = F.lit("")
    return F.concat(
        F.coalesce(as_column(first), blank),
        F.lit(" "),
        F.coalesce(as_column(last), blank),
    )


def surrogate_key(*columns) -> Column:
    """md5 over the text of each part, NULL parts replaced, joined by ``-``."""
    parts = [
        F.coalesce(as_column(c).cast("string"), F.lit(NULL_KEY_PART)) for c in columns
    ]
    return F.md5(F.concat_ws("-", *parts))


def packed_text(column) -> Column:
    """Text as bytes, one form for each text: 32 lowercase hex digits as 16 bytes, other text as UTF-8.

    Only packed digits have 16 bytes: text of 16 bytes and more gets one byte behind it.
    """
    text = as_column(column)
    # Upper case would not come back; what holds other characters is NULL here.
    digits = F.when((F.octet_length(text) == 32) & (F.lower(text) == text), F.unhex(text))
    plain = text.cast("binary")
    longer = F.concat(plain, F.lit(b"\0"))
    return F.coalesce(digits, F.when(F.octet_length(text) < 16, plain).otherwise(longer))


def unpacked_text(column) -> Column:
    """The text that ``packed_text`` packed."""
    packed = as_column(column)
    size = F.octet_length(packed)
    longer = F.substring(packed, F.lit(1), size - 1).cast("string")
    return F.when(size == 16, F.lower(F.hex(packed))).when(size < 16, packed.cast("string")).otherwise(longer)


def decode(column, mapping: dict[str, str], normalize: bool = True) -> Column:
    """Code → label; values outside the mapping become NULL."""
    value = as_column(column)
    if normalize:
        value = F.upper(F.trim(value))
    branches = list(mapping.items())
    code, label = branches[0]
    chain = F.when(value == code, label)
    for code, label in branches[1:]:
        chain = chain.when(value == code, label)
    return chain


def decode_set(column, sets: dict[str, list[str]]) -> Column:
    """Label → accepted codes; anything else NULL."""
    value = F.upper(F.trim(as_column(column)))
    labels = list(sets.items())
    chain = F.when(value.isin(labels[0][1]), labels[0][0])
    for label, codes in labels[1:]:
        chain = chain.when(value.isin(codes), label)
    return chain


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def as_stamp(value) -> Column:
    """A timestamp parameter given as text, datetime or Column."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def as_day(value) -> Column:
    """A date parameter given as text, date or Column; default is today."""
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("date")
