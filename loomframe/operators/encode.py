"""Codes of categories by first appearance, back again, and one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.expr import columns_like
from loomframe.operators.relational import numbered_rows

#: Maps up to so many values are broadcast; larger ones join by shuffle.
BROADCAST_VALUES = 100_000


def code_map(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): codes from 0 in the order of each value's first appearance."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("_first"))
    return numbered_rows(first, ["_first", "value"], "code").select("value", F.col("code").cast("long").alias("code"))


def _small(m: DataFrame) -> DataFrame:
    return F.broadcast(m) if m.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES else m


def factorize(
    df: DataFrame, columns: Sequence[str] = (), order: str = "", in_place: bool = False, all_categories: bool = False, all_booleans: bool = False
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The columns as codes (missing: -1) and the map of each. Columns may have wildcards. The result has the coded
    columns and ``order`` alone unless ``in_place``."""
    names = columns_like(df, columns) if columns else []
    for f in df.schema:
        if f.name not in names and (all_categories and isinstance(f.dataType, T.StringType) or all_booleans and isinstance(f.dataType, T.BooleanType)):
            names.append(f.name)
    maps = {c: code_map(df, c, order) for c in names}
    out = df if in_place else df.select(*dict.fromkeys([order, *names]))
    for c, m in maps.items():
        coded = m.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        out = out.join(_small(coded), F.col(c) == F.col("_v"), "left").withColumn(c, F.coalesce("_c", F.lit(-1).cast("long"))).drop("_v", "_c")
    return out, maps


def defactorize(df: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """Codes back to values; -1 and codes without a value become missing."""
    out = df
    for c, m in maps.items():
        back = m.select(F.col("code").alias("_c"), F.col("value").alias("_v"))
        out = out.join(_small(back), F.col(c) == F.col("_c"), "left").withColumn(c, F.col("_v")).drop("_v", "_c")
    return out


def one_hot(df: DataFrame, columns: Sequence[str], values: dict[str, Sequence] | None = None, as_type: str = "boolean", most: int = 2000) -> DataFrame:
    """A column ``name_value`` for each value, true where it is equal and false elsewhere, missing values included.

    Values that aren't given are collected, sorted: as many as there are columns to make, and at most ``most``; more are
    an error.
    """
    made: list[Column] = []
    for c in columns:
        found = (values or {}).get(c)
        if found is None:
            found = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(most + 1).collect()]
            if len(found) > most:
                raise ValueError(f"column {c!r} has over {most} values; give those that count")
        made += [F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast(as_type).alias(f"{c}_{v}") for v in found]
    return df.select("*", *made)


def map_values(df: DataFrame, column: str, mapping: dict, default: object = None) -> DataFrame:
    """Values replaced by a dictionary; others become the default."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(column, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(default)))
