"""Application properties of an event: as a map, or as one column per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROPERTY_MAP_TYPE = T.MapType(T.StringType(), T.StringType(), True)


def properties_map(source: str | Column = "props") -> Column:
    """JSON object text -> ``map<string,string>``; non-string values keep their JSON text."""
    col = F.col(source) if isinstance(source, str) else source
    return F.from_json(col, PROPERTY_MAP_TYPE)


def property_columns(source: str | Column = "props", keys: Sequence[str] | None = None) -> list[Column]:
    """The ``properties`` map, or with ``keys`` one STRING column per key; an absent (or null) key gives ``""``."""
    parsed = properties_map(source)
    if keys is None:
        return [parsed.alias("properties")]
    if not keys:
        raise ValueError("keys must name at least one property")
    return [F.coalesce(parsed.getItem(k), F.lit("")).alias(k) for k in keys]


def with_properties(df: DataFrame, source: str = "props", drop_source: bool = True) -> DataFrame:
    """Add the ``properties`` map column (null values allowed)."""
    kept = [c for c in df.columns if c != "properties" and not (drop_source and c == source)]
    return df.select(*kept, *property_columns(source))


def with_property_keys(df: DataFrame, keys: Sequence[str], source: str = "props",
                       drop_source: bool = True) -> DataFrame:
    """Add one STRING column per key; an absent (or null) key gives ``""``."""
    kept = [c for c in df.columns if c not in keys and not (drop_source and c == source)]
    return df.select(*kept, *property_columns(source, list(keys)))
