"""Masking of secrets in log text and in nested detail columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.functions.columns import any_of, as_column

# What counts as sensitive, applied in this order. Quantifiers of the
# path pattern are possessive, so that long texts need no deep recursion.
CREDENTIAL = (
    r"(?iU)(api[_-]?key|secret|token|password|passwd|pwd|credential)"
    r"[:=]\s*[\"']?([A-Za-z0-9_\-./+]{8,})"
)
URL_LOGIN = r"(?iU)[a-z][a-z0-9+\-.]*://[^:@/\s]+:[^@/\s]+@"
CONNECTION = r"(?iU)(driver|server|host|uid|user|pwd|password|database|db)=[^;\"']+(?:;|$)"
SQL_TEXT = (
    r"(?iU)(?:SELECT|FROM|JOIN|WHERE|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)[^\n]{0,200}"
)
ABSOLUTE_PATH = (
    r"(?<![A-Za-z0-9_./-])/(?:[A-Za-z0-9._-]++/)++[A-Za-z0-9._-]++(?![A-Za-z0-9_./-])"
)
MASK = "[REDACTED]"
SECRET_KEY_PARTS = ("password", "secret", "token", "credential", "connection_string", "api_key")


def redact_text(column) -> Column:
    """Credentials, URL logins, connection strings, SQL text and absolute paths, in turn."""
    text = as_column(column)
    text = F.regexp_replace(text, CREDENTIAL, f"$1={MASK}")
    text = F.regexp_replace(text, URL_LOGIN, MASK)
    text = F.regexp_replace(text, CONNECTION, MASK)
    text = F.regexp_replace(text, SQL_TEXT, "[SQL_REDACTED]")
    return F.regexp_replace(text, ABSOLUTE_PATH, "[PATH_REDACTED]")


def _is_secret(name: str, key_parts) -> bool:
    return any(part in name.lower() for part in key_parts)


def _masked(value: Column, kind: T.DataType, key_parts) -> Column:
    if isinstance(kind, T.StringType):
        return redact_text(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _masked(item, kind.elementType, key_parts))
    if isinstance(kind, T.StructType):
        fields = [
            (F.lit(MASK) if _is_secret(f.name, key_parts) else
             _masked(value[f.name], f.dataType, key_parts)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        return F.transform_values(
            value, lambda key, item: _masked_entry(key, item, kind.valueType, key_parts)
        )
    return value


def _masked_entry(key: Column, item: Column, kind: T.DataType, key_parts) -> Column:
    secret = any_of([F.contains(F.lower(key), F.lit(part)) for part in key_parts])
    clean = _masked(item, kind, key_parts)
    if isinstance(kind, T.StringType):
        return F.when(secret, F.lit(MASK)).otherwise(clean)
    # A nested value keeps its type: everything below a secret key is masked or dropped.
    return F.when(secret, _blanked(item, kind)).otherwise(clean)


def _blanked(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.lit(MASK)
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, item: _blanked(item, kind.valueType))
    return F.lit(None).cast(kind)


def mask_map(column, kind: T.DataType | None = None, key_parts=SECRET_KEY_PARTS) -> Column:
    """Details column with secret keys masked and every other text redacted.

    ``kind`` is the column's type, a map of text by default; nested maps, structs
    and arrays are followed.
    """
    kind = kind or T.MapType(T.StringType(), T.StringType())
    return _masked(as_column(column), kind, tuple(key_parts))
