"""Integrity checks: each returns the offending rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def repeats(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every row after the first of its key."""
    return rows.withColumn("occurrence", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("occurrence > 1")


def broken_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-blank reference has no parent."""
    return child.filter(F.trim(F.col(column).cast("string")) != "").join(parent.select(F.col(key).alias(column)), column, "left_anti")


def broken_documents(docs: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """Documents (type, entity, ...) whose type is none of ``entities``, or whose entity is not among those of its type; adds problem."""
    unknown = docs.filter(F.col("type").isNull() | ~F.col("type").isin(*entities)).withColumn("problem", F.lit("unknown type"))
    for kind, rows in entities.items():
        missing = docs.filter(F.col("type") == kind).join(rows.select("entity"), "entity", "left_anti")
        unknown = unknown.unionByName(missing.withColumn("problem", F.lit("missing entity")))
    return unknown


def identifier(value: str) -> str:
    """The identifier without blanks around it; a blank one raises."""
    if not isinstance(value, str) or not value.strip():
        raise ValueError("an identifier must not be blank")
    return value.strip()


def relationship_types(values) -> list[str]:
    """The distinct relationship types in order; a bare string, or a type that is not upper-case letters, digits and underscores, raises."""
    if isinstance(values, str):
        raise ValueError("relationship types must be a sequence")
    found = list(dict.fromkeys(values))
    for value in found:
        if not re.fullmatch(r"[A-Z][A-Z0-9_]*", value or ""):
            raise ValueError(f"not a relationship type: {value!r}")
    return found


def count_mismatches(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, declared, actual, status) of all names on either side."""
    both = declared.join(actual, "name", "full")
    status = F.when(F.col("declared").isNull(), "unmapped").when(F.col("actual").isNull(), "missing").when(F.col("declared") == F.col("actual"), "ok").otherwise("mismatch")
    return both.withColumn("status", status)


def unknown_ids(rows: DataFrame, key: str, ids, known: DataFrame) -> DataFrame:
    """(key, unknown): identifiers that a text cites and no node has; ``ids`` is an array column, ``known`` has id."""
    cited = rows.select(key, F.explode(ids).alias("unknown"))
    return cited.join(known.select(F.col("id").alias("unknown")), "unknown", "left_anti")
