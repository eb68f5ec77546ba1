"""Typed values from raw strings: blank and unreadable values are null, so they are told from zero and false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YES, NO = ("true", "yes", "1"), ("false", "no", "0")


def integer(raw: Column) -> Column:
    return F.trim(raw).try_cast("int")


def boolean(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin(*YES), True).when(low.isin(*NO), False)


def listed(raw: Column, separator: str = ";") -> Column:
    """Trimmed items that are not empty; null and blank strings give an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def json_or_raw(raw: Column, name: str) -> Column:
    """A property of a JSON object; text that does not parse is returned as it is."""
    return F.when(F.try_parse_json(raw).isNull(), raw).otherwise(F.get_json_object(raw, f"$.{name}"))
