"""Filter, project, apply, merge, concatenate, split, distinct, top and small groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.expr import KNOWN, query


def select(df: DataFrame, queries: Sequence[str | Column] = (), columns: Sequence[str] = (), continue_if_failure: bool = False) -> DataFrame:
    """Rows that meet all queries, then the columns. A query or column that fails raises ValueError, or gives no rows of
    the wanted columns if ``continue_if_failure``."""
    try:
        out = reduce(lambda d, q: d.filter(query(q) if isinstance(q, str) else q), queries, df)
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"no columns {missing}")
        return out.select(*[F.col(f"`{c}`") for c in columns]) if columns else out
    except (AnalysisException, ValueError) as e:
        if not continue_if_failure:
            raise ValueError(f"selection failed: {e}") from e
        if not columns:
            return df.limit(0)
        fields = [df.schema[c] if c in df.columns else T.StructField(c, T.StringType()) for c in columns]
        return df.sparkSession.createDataFrame([], T.StructType(fields))


def apply(
    df: DataFrame,
    func: Callable | str,
    out: str | None = None,
    on: str | Sequence[str] | None = None,
    entire: bool = False,
    returns: str | None = None,
    **kwargs,
) -> DataFrame:
    """A function on a column (Column to Column, or a name in KNOWN), on a row of columns, or on the whole frame.

    With a type ``returns`` the function is of pandas Series instead (one for each column of ``on``), as a pandas UDF in
    Arrow batches. Without it a function that doesn't give a Column is an error, not a slower way.
    """
    if entire:
        result = func(df, **kwargs)
        return df.withColumn(out, result) if isinstance(result, Column) else result
    if isinstance(func, str) and func not in KNOWN:
        raise ValueError(f"no function {func!r}; register it first")
    func = KNOWN[func] if isinstance(func, str) else func
    names = [on] if isinstance(on, str) else list(on or df.columns)
    columns = [F.col(f"`{c}`") for c in names]
    if returns:
        return df.withColumn(out or names[0], F.pandas_udf(lambda *s: pd.Series(func(*s, **kwargs)), returns)(*columns))
    result = func(*columns, **kwargs)
    if not isinstance(result, Column):
        raise TypeError("the function gives no Column; name the type that it returns to run it over pandas Series")
    return df.withColumn(out or names[0], result)


class Functions:
    """Functions to apply in turn: the builder of ``apply`` with checks when a function is added."""

    def __init__(self):
        self.items: list[dict] = []

    def add(self, func: Callable | str, out: str, on: str | Sequence[str] | None = None, returns: str | None = None, store: str | None = None, **kwargs) -> Functions:
        """store: the result is a side result under this name, and the frame stays as it is."""
        if not callable(func) and func not in KNOWN:
            raise TypeError(f"{func!r} is neither a function nor the name of one")
        if not isinstance(out, str) or not out:
            raise TypeError("the new column needs a name")
        if not (on is None or isinstance(on, str) or all(isinstance(c, str) for c in on)):
            raise TypeError("columns are given by name")
        self.items.append({"func": func, "out": out, "on": on, "returns": returns, "store": store, "kwargs": kwargs})
        return self

    def run(self, df: DataFrame) -> tuple[DataFrame, dict]:
        """The frame after all functions, and the side results by name."""
        aside = {}
        for x in self.items:
            made = apply(df, x["func"], x["out"], x["on"], returns=x["returns"], **x["kwargs"])
            if x["store"]:
                aside[x["store"]] = made.select(x["out"])
            else:
                df = made
        return df, aside


def apply_rows(df: DataFrame, func: Callable[[pd.DataFrame], pd.Series], out: str, columns: Sequence[str], returns: str = "double") -> DataFrame:
    """A function of a pandas frame of the columns to a series: one value for each row."""
    return df.withColumn(out, F.pandas_udf(lambda rows: func(rows), returns)(F.struct(*columns)))


def grouped_apply(df: DataFrame, by: Sequence[str], func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Split, apply, combine: a pandas frame for each group gives a frame. A group is held by one task; aggregates that
    Column expressions can express belong in ``grouped_column``."""
    return df.groupBy(*by).applyInPandas(func, schema)


def grouped_column(df: DataFrame, by: Sequence[str], value: Column, out: str) -> DataFrame:
    """An aggregate of each row's group in a column: aggregated with partial sums and joined back, so that no group is
    gathered in one task. Missing keys have no group and get null."""
    keys = [F.col(c) for c in by]
    small = df.groupBy(*[k.alias(f"_g{i}") for i, k in enumerate(keys)]).agg(value.alias(out))
    small = small.dropna(subset=[f"_g{i}" for i in range(len(keys))])
    on = reduce(lambda a, b: a & b, [k == F.col(f"_g{i}") for i, k in enumerate(keys)])
    return df.join(small, on, "left").select(*[c for c in df.columns if c != out], out)


def add_constants(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def merge(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    columns1: Sequence[str] = (),
    columns2: Sequence[str] = (),
    drop_duplicate_columns: bool = True,
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_safe: bool = True,
    indicator: bool = False,
    left_on: Sequence[str] = (),
    right_on: Sequence[str] = (),
    validate: str | None = None,
) -> DataFrame:
    """Equi-join with one copy of the keys; inner, left, right or outer. Missing keys match each other if ``null_safe``.

    Other columns that both sides have come from the left alone, or from both with suffixes. left_on and right_on, instead
    of on: keys of different names, which both stay; of a row without a partner the other side's key is null. validate:
    1:1, 1:m, m:1 or m:m; ValueError where the keys of a side marked 1 aren't unique (an aggregate of that side).
    """
    if left_on or right_on:
        left_on, right_on = ([x] if isinstance(x, str) else list(x) for x in (left_on, right_on))
        if on or len(left_on) != len(right_on):
            raise ValueError("give on, or as many keys left as right")
        pairs = list(zip(left_on, right_on, strict=True))
        made = [f"__key{k}" for k in range(len(pairs))]
        a = left.select("*", *[F.col(x).alias(m) for (x, _), m in zip(pairs, made, strict=True)])
        b = right.select("*", *[F.col(y).alias(m) for (_, y), m in zip(pairs, made, strict=True)])
        out = merge(a, b, made, how, [*columns1, *made] if columns1 else (), [*columns2, *made] if columns2 else (), drop_duplicate_columns, suffixes, null_safe, indicator, validate=validate)
        return out.drop(*made)
    if validate:
        ones = {"one_to_one": "1:1", "one_to_many": "1:m", "many_to_one": "m:1", "many_to_many": "m:m"}.get(validate, validate)
        if ones not in ("1:1", "1:m", "m:1", "m:m"):
            raise ValueError(f"no such check: {validate!r}")
        for side, mark, name in ((left, ones[0], "left"), (right, ones[2], "right")):
            keys = [on] if isinstance(on, str) else list(on)
            if mark == "1" and not side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
                raise ValueError(f"the keys of the {name} side aren't unique")
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"no such join: {how!r}")
    on = [on] if isinstance(on, str) else list(on)
    for side, chosen in ((left, columns1), (right, columns2)):
        if missing := [c for c in on if c not in (chosen or side.columns)]:
            raise ValueError(f"keys {missing} aren't among the columns")
    left = left.select(*columns1) if columns1 else left
    right = right.select(*columns2) if columns2 else right
    both = [c for c in right.columns if c in left.columns and c not in on]
    if drop_duplicate_columns:
        right = right.drop(*both)
    else:
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    a = left.withColumnsRenamed({c: f"_l_{c}" for c in on}).withColumn("_in_l", F.lit(True))
    b = right.withColumnsRenamed({c: f"_r_{c}" for c in on}).withColumn("_in_r", F.lit(True))
    same = [F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")) if null_safe else F.col(f"_l_{c}") == F.col(f"_r_{c}") for c in on]
    out = a.join(b, reduce(lambda x, y: x & y, same), how)
    keys = [F.coalesce(F.col(f"_l_{c}"), F.col(f"_r_{c}")).alias(c) for c in on]
    flag = F.when(F.col("_in_r").isNull(), "left_only").when(F.col("_in_l").isNull(), "right_only").otherwise("both").alias("_merge")
    return out.select(*keys, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on], *([flag] if indicator else []))


def concat(frames: Sequence[DataFrame | None], join: str = "outer", ignore_missing: bool = False) -> DataFrame:
    """All rows of all frames, columns by name: all of them (missing ones null), or those that all frames have.
    Where all are missing and that is ignored, a frame without rows and columns."""
    found = [f for f in frames if f is not None]
    if len(found) < len(frames) and not ignore_missing:
        raise ValueError("a frame to concatenate is missing")
    if not found:
        return SparkSession.active().createDataFrame([], T.StructType([]))
    if join == "inner":
        names = [c for c in found[0].columns if all(c in f.columns for f in found)]
        found = [f.select(*names) for f in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def concat_columns(frames: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Side by side, row n with row n in the order of each frame's own column ``order[i]``; shorter frames give nulls."""
    numbered = [numbered_rows(f, [o]) for f, o in zip(frames, order, strict=True)]
    return reduce(lambda a, b: a.join(b, "__row_id", "full"), numbered).drop("__row_id")


#: Sampled keys for each part of a running sum, and how many parts there are at most.
SAMPLED, PARTS = 40, 512


def range_part(df: DataFrame, order: Sequence[str | Column]) -> Column:
    """The number of a row's part in an order, by bounds from a bounded random sample of the keys.

    The bounds are literals, found by halving: wherever this expression is used, a row is in the same part. Rows of
    equal keys are in one part.
    """
    key = F.struct(*order)
    n = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), PARTS)
    found = df.select(key.alias("k")).orderBy(F.rand(11)).limit(SAMPLED * n).agg(F.array_sort(F.collect_list("k")).alias("k")).first()["k"]
    bounds = list(dict.fromkeys(found[k * len(found) // n] for k in range(1, n))) if found else []
    types = df.select(key.alias("k")).schema["k"].dataType

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bound = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(bounds[mid], types.fields, strict=True)])
        return F.when(key >= bound, half(mid + 1, hi)).otherwise(half(lo, mid))

    return half(0, len(bounds))


def running_sum(df: DataFrame, order: Sequence[str | Column], value: Column, out: str) -> DataFrame:
    """A running sum in an order, without a window over one partition: rows go to parts by ranges of the order, and each
    part adds the sum of those before it (one row for each part is all that meets in one place)."""
    ordered = df.withColumns({"_v": value, "_part": range_part(df, order)})
    local = ordered.withColumn("_s", F.sum("_v").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = ordered.groupBy("_part").agg(F.sum("_v").alias("_c"))
    before = sums.select(F.col("_part").alias("_p"), (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_b"))  # at most PARTS rows
    return local.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(out, F.col("_s") + F.col("_b")).drop("_v", "_part", "_p", "_s", "_b")


def numbered_rows(df: DataFrame, order: Sequence[str | Column], name: str = "__row_id") -> DataFrame:
    """Rows numbered from 0 in an order, by a running sum of ones."""
    return running_sum(df, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def distinct(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    return df.dropDuplicates(list(columns) or None)


def split_sizes(n: int, fractions: Sequence[float] = (), counts: Sequence[int] = (), classes: int | None = None) -> list[int]:
    """Exact sizes: int(n f) or as given; of one class that is left out the rest; fractions over 1 in all are scaled;
    the running total never passes n."""
    if bool(fractions) == bool(counts):
        raise ValueError("give fractions or counts")
    total = sum(fractions)
    sizes = [int(n * f / max(total, 1)) for f in fractions] if fractions else [int(c) for c in counts]
    classes = classes or len(sizes)
    if len(sizes) == classes - 1:
        sizes.append(max(0, n - sum(sizes)))
    if len(sizes) != classes:
        raise ValueError("sizes and classes differ in number")
    out, used = [], 0
    for s in sizes:
        out.append(max(0, min(s, n - used)))
        used += out[-1]
    return out


def random_class(df: DataFrame, key: Sequence[str], sizes: Sequence[int], seed: int = 0, column: str = "randomclass") -> DataFrame:
    """A class for each row, exactly so many rows of each, by a random order that depends on key and seed alone; rows left over are in class 0."""
    if column in df.columns:
        raise ValueError(f"column {column!r} exists")
    numbered = numbered_rows(df.withColumn("_h", F.xxhash64(F.lit(seed), *key)), ["_h", *key])
    out, upto = F.lit(0), 0
    for k, s in enumerate(sizes):
        out = F.when((F.col("__row_id") >= upto) & (F.col("__row_id") < upto + s), k).otherwise(out)
        upto += s
    return numbered.withColumn(column, out).drop("_h", "__row_id")


def random_split(df: DataFrame, key: Sequence[str], sizes: Sequence[int], seed: int = 0) -> list[DataFrame]:
    """Disjoint frames of exactly these sizes; what is left over goes to none."""
    classed = random_class(df, key, [*sizes], seed, "_class")
    if sum(sizes) < df.count():
        numbered = numbered_rows(df.withColumn("_h", F.xxhash64(F.lit(seed), *key)), ["_h", *key])
        bounds = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
        return [numbered.where((F.col("__row_id") >= a) & (F.col("__row_id") < b)).drop("_h", "__row_id") for a, b in zip(bounds, bounds[1:], strict=False)]
    return [classed.where(F.col("_class") == k).drop("_class") for k in range(len(sizes))]


def top(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values with their counts; of equal counts the lesser values."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def drop_small_groups(df: DataFrame, by: Sequence[str], least: int = 400) -> DataFrame:
    """Rows of groups with so many rows or more."""
    by = [by] if isinstance(by, str) else list(by)
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return df.join(large, by, "left_semi")


def bootstrap(df: DataFrame, size: int, order: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly ``size`` rows drawn with replacement, with the number of each draw and of its source row."""
    n = df.count()
    draws = df.sparkSession.range(size).select(F.col("id").alias("draw"), F.floor(unit("id", seed) * n).cast("long").alias("__row_id"))
    return draws.join(numbered_rows(df, order), "__row_id").withColumnRenamed("__row_id", "source_row")


def unit(key: str | Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone, however rows are partitioned."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)) / F.lit(float(1 << 53))


class Splitter:
    """``random_class`` with a seed of its own for each execution: the settings' seed, then one more each time."""

    def __init__(self, key: Sequence[str], fractions: Sequence[float] = (), counts: Sequence[int] = (), classes: int | None = None, seed: int = 1, column: str = "randomclass"):
        self.key, self.fractions, self.counts, self.classes, self.seed, self.column, self.executions = list(key), fractions, counts, classes, seed, column, 0

    def __call__(self, df: DataFrame) -> DataFrame:
        seed = self.seed + self.executions
        self.executions += 1
        return random_class(df, self.key, split_sizes(df.count(), self.fractions, self.counts, self.classes), seed, self.column)
