import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from martwright.functions import columns as c
from martwright.functions.redaction import mask_map, redact_text
from martwright.operators import silver
from pyspark.sql import types as T


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def day(text):
    return F.lit(text).cast("date")


def test_month_and_year_differences_count_boundaries(spark):
    assert value(spark, c.months_between_boundaries(day("2024-02-01"), day("2024-01-31"))) == 1
    assert value(spark, c.years_between_boundaries(day("2025-01-01"), day("2024-12-31"))) == 1
    assert value(spark, c.days_between(day("2024-03-01"), day("2024-02-28"))) == 2


def test_safe_divide_and_rounding_cast(spark):
    assert value(spark, c.safe_divide(F.lit(7), F.lit(0))) is None
    assert value(spark, c.divide_or_zero(F.lit(7), F.lit(0))) == 0.0
    assert value(spark, c.round_to_long(F.lit("2.5").cast("decimal(38,9)"))) == 3
    assert value(spark, c.half_even_to_long(F.lit(2.5))) == 2


def test_percent_change_uses_the_absolute_prior(spark):
    assert value(spark, c.pct_change(F.lit(50), F.lit(-100))) == 150.0
    assert value(spark, c.pct_change(F.lit(50), F.lit(0))) is None
    assert value(spark, c.pct_change(F.lit(50), F.lit(None).cast("int"))) is None


def test_surrogate_key_known_hash_and_null_part(spark):
    import hashlib

    got = value(spark, c.surrogate_key(F.lit(12), F.lit(None).cast("string")))
    assert got == hashlib.md5(b"12-_dbt_utils_surrogate_key_null_").hexdigest()


def test_lenient_and_strict_dates(spark):
    formats = silver.BIRTHDATE_FORMATS
    parse = lambda text: value(spark, silver.parse_date_any(F.lit(text), formats))
    assert parse("2010-01-09") == dt.date(2010, 1, 9)
    assert parse("2010-1-9") == dt.date(2010, 1, 9)
    assert parse("20100109") == dt.date(2010, 1, 9)
    assert parse("nonsense") is None
    assert value(spark, c.strict_date(F.lit(20101231))) == dt.date(2010, 12, 31)
    assert value(spark, c.strict_int_date(F.lit(20101231))) == dt.date(2010, 12, 31)
    for strict in (c.strict_date, c.strict_int_date):
        with pytest.raises(Exception):
            value(spark, strict(F.lit(20101399)))
        with pytest.raises(Exception):
            value(spark, strict(F.lit(20100230)))


def test_finite_money_title_and_names(spark):
    assert value(spark, c.is_finite(F.lit(float("inf")))) is False
    assert value(spark, c.is_finite(F.lit(None).cast("double"))) is False
    assert value(spark, c.is_finite(F.lit(-3))) is True
    assert value(spark, c.to_money(F.lit("not-a-number"))) is None
    assert value(spark, c.to_money(F.lit("10.50"))) == 10.5
    assert value(spark, c.title_case(F.lit("uNITED states"))) == "United States"
    assert value(spark, c.full_name(F.lit("A"), F.lit(None).cast("string"))) == "A "
    assert value(spark, c.file_token(F.lit("Héllo 1/2"))) == "Héllo_1_2"


def test_redaction_order_and_patterns(spark):
    cases = {
        "api_key: 'abcdef123456'": "api_key=[REDACTED]'",
        "password=privatepassword": "[REDACTED]",
        "postgres://me:pw@host/db": "[REDACTED]host/db",
        "server=db1;user=me;": "[REDACTED][REDACTED]",
        "could not SELECT x FROM t\nnext": "could not [SQL_REDACTED]\nnext",
        "see /var/log/app.log now": "see [PATH_REDACTED] now",
        "see var/log/app.log now": "see var/log/app.log now",
        "token=short": "token=short",
    }
    for text, expected in cases.items():
        assert value(spark, redact_text(F.lit(text))) == expected, text


def test_redaction_of_very_long_texts(spark):
    long_path = "/a" * 20_000
    assert value(spark, redact_text(F.lit(f"x {long_path} y"))) == "x [PATH_REDACTED] y"
    late = "word " * 200_000 + "token=abcdefgh1234"
    # "password" and friends are found at the very end of a long text as well.
    assert value(spark, redact_text(F.lit(late))).endswith("token=[REDACTED]")


def test_secret_keys_are_masked_at_every_depth(spark):
    text = T.StringType()
    inner = T.StructType([T.StructField("token", text), T.StructField("rows", T.LongType())])
    schema = T.StructType(
        [T.StructField("d", T.MapType(text, T.ArrayType(inner))), T.StructField("m", T.MapType(text, text))]
    )
    df = spark.createDataFrame(
        [({"items": [("s3cret", 3)], "my_secret": [("x", 1)]}, {"Connection_String": "v", "n": "ok"})],
        schema,
    )
    row = df.select(
        mask_map("d", schema["d"].dataType).alias("d"), mask_map("m").alias("m")
    ).first()
    assert row.d["items"][0].token == "[REDACTED]" and row.d["items"][0].rows == 3
    assert row.d["my_secret"] is None
    assert row.m == {"Connection_String": "[REDACTED]", "n": "ok"}


def test_decode_without_default(frame):
    df = frame([("s ",), ("M",), ("x",), (None,)], "v string")
    assert rows(df.select(c.decode("v", {"S": "Single", "M": "Married"}))) == [
        ("Single",),
        ("Married",),
        (None,),
        (None,),
    ]


def test_packed_text_comes_back_and_differs(frame):
    digits = "0123456789abcdef" * 2
    texts = ["", "a", "x" * 15, "x" * 16, "x" * 16 + "\0", "x" * 32, digits, digits.upper(), digits[1:], digits + "0", "g" * 32, "é" * 8, None]
    packed = c.packed_text("t")
    got = rows(frame([(t,) for t in texts], "t string").select("t", packed.alias("p"), c.unpacked_text(packed).alias("u")))
    assert [u for _, _, u in got] == texts
    assert len({bytes(p) for _, p, _ in got if p is not None}) == len(texts) - 1
    assert [len(p) for t, p, _ in got if t == digits] == [16]
