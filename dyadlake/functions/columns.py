"""Choosing and padding columns by type and name, on the schema alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K


def numeric(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    """The numeric and boolean columns, but for some."""
    return [f.name for f in df.schema if isinstance(f.dataType, K.NumericType | K.BooleanType) and f.name not in but]


def named(df: DataFrame, prefix: str = "", suffix: str = "", holding: str = "") -> list[str]:
    """The columns whose names begin, end and hold so."""
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and holding in c]


def having(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Those of the wanted columns that the frame has."""
    return [c for c in wanted if c in df.columns]


def padded(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The frame with a typed zero for every wanted column that it lacks."""
    return df.withColumns({c: F.lit(0).cast(t) for c, t in wanted.items() if c not in df.columns})


def finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN, infinities and nulls of these columns become 0."""
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c)) for c in columns})
