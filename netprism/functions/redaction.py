"""Redaction before an export: secrets inside texts, and values by the name of their key."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv

MASK = "[REDACTED]"


def redact_export(text: Column) -> Column:
    """Tokens, passwords, communities and keys of a text; what names them stays."""
    for pattern in fv.EXPORT_REDACTIONS:
        text = F.regexp_replace(text, "(?i)" + pattern, "$1" + MASK)
    return text


def _clean(value: Column, kind: T.DataType, name: str | None) -> Column:
    if name is not None and _secret_name(name):
        return F.when(value.isNotNull(), F.lit(MASK))
    if isinstance(kind, T.StringType):
        return redact_export(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_clean(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _clean(x, kind.elementType, None))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        # a map has one kind of value: masked ones are texts, or null where values are none
        masked = F.lit(MASK) if isinstance(kind.valueType, T.StringType) else F.lit(None)
        return F.transform_values(value, lambda k, v: F.when(k.rlike("(?i)" + fv.EXPORT_SECRET_KEYS), masked).otherwise(_clean(v, kind.valueType, None)))
    return value


def _secret_name(name: str) -> bool:
    return re.search(fv.EXPORT_SECRET_KEYS, name, re.IGNORECASE) is not None


def sanitized(df: DataFrame) -> DataFrame:
    """All columns, however nested: values under secret names masked, secrets inside texts masked."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])
