"""Sparse histograms in any number of dimensions: filling, projection, normalising, combining, simulating."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce, total_ordering

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.expr import DEFAULT_NUMERIC, DEFAULT_TIME, Bins, kind_of, micros
from loomframe.operators.relational import running_sum, unit


def parse_columns(spec: str | Sequence[str]) -> list[str]:
    """``'x'``, ``'x:y'`` or a list."""
    return spec.split(":") if isinstance(spec, str) else list(spec)


def bins_for(df: DataFrame, names: Sequence[str], specs: dict) -> list[Bins | None]:
    """The bins of each variable: from ``specs['x:y'][i]``, else ``specs['x']``, else the defaults; None for categories."""
    joint = specs.get(":".join(names)) if len(names) > 1 else None
    out = []
    for i, c in enumerate(names):
        kind = kind_of(df, c)
        spec = Bins.of((joint[i] if joint else None) or specs.get(c))
        out.append(None if kind == "category" else spec or (DEFAULT_TIME if kind == "time" else DEFAULT_NUMERIC))
    return out


def key_columns(df: DataFrame, names: Sequence[str], specs: dict, null_time_as_epoch: bool = False) -> list[Column]:
    """An expression for each variable: bin number (long), or the category; booleans are True and False as text."""
    out = []
    for c, b in zip(names, bins_for(df, names, specs), strict=True):
        kind, col = kind_of(df, c), F.col(c)
        if b is None:
            out.append(F.initcap(col.cast("string")) if isinstance(df.schema[c].dataType, T.BooleanType) else col)
            continue
        if kind == "time" and null_time_as_epoch:
            col = F.coalesce(col.cast("timestamp"), F.timestamp_micros(F.lit(0)))
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            col = F.nanvl(col, F.lit(None))
        out.append(b.index(col, kind == "time"))
    return out


class ValueCounts:
    """A sparse table of counts: a frame of key columns and ``count`` (long), one row for each key."""

    def __init__(self, frame: DataFrame, keys: Sequence[str]):
        if not keys or set(frame.columns) != {*keys, "count"}:
            raise AttributeError("counts need key columns and a column count")
        self.frame, self.keys = frame, list(keys)

    @classmethod
    def of(cls, counts: dict, keys: Sequence[str], spark) -> ValueCounts:
        """From a dict of key (or tuple of keys) to count."""
        if not counts:
            raise AttributeError("no counts")
        rows = [(*(k if isinstance(k, tuple) else (k,)), int(n)) for k, n in counts.items()]
        return cls(spark.createDataFrame(rows, [*keys, "count"]), keys)

    def project(self, keys: Sequence[str], only: dict[str, Sequence] | None = None) -> ValueCounts:
        """Counts summed over all other keys, of the rows that have the chosen values."""
        keys = parse_columns(keys)
        rows = reduce(lambda d, kv: d.where(F.col(kv[0]).isin(list(kv[1]))), (only or {}).items(), self.frame)
        return ValueCounts(rows.groupBy(*keys).agg(F.sum("count").alias("count")), keys)

    def count(self, value: dict) -> int:
        """The count at a key; 0 where there is none."""
        rows = reduce(lambda d, kv: d.where(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), value.items(), self.frame)
        return rows.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]

    def values(self, keys: Sequence[str]) -> DataFrame:
        return self.frame.select(*parse_columns(keys)).distinct().orderBy(*parse_columns(keys))

    def without_missing(self) -> DataFrame:
        return self.frame.dropna(subset=self.keys).orderBy(*self.keys)

    def drop(self, values: Sequence, key: str | None = None) -> ValueCounts:
        return ValueCounts(self.frame.where(~F.coalesce(F.col(key or self.keys[0]).isin(list(values)), F.lit(False))), self.keys)

    def totals(self) -> dict[str, int]:
        full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        n = F.coalesce(F.sum("count"), F.lit(0))
        return self.frame.agg(
            F.count(F.lit(1)).alias("num_bins"),
            F.count(F.when(full, 1)).alias("num_nonone_bins"),
            n.alias("sum_counts"),
            F.coalesce(F.sum(F.when(full, F.col("count"))), F.lit(0)).alias("sum_nonone_counts"),
        ).first().asDict()

    def __add__(self, other: ValueCounts) -> ValueCounts:
        both = self.frame.unionByName(other.frame)
        return ValueCounts(both.groupBy(*self.keys).agg(F.sum("count").alias("count")), self.keys)

    def consistent(self, prefer: str | None = None) -> ValueCounts:
        """For text keys of mixed content: only keys of the most common kind (int, float, bool, str), by summed counts."""
        out = self
        for k in self.keys:
            if not isinstance(self.frame.schema[k].dataType, T.StringType):
                continue
            c = F.col(k)
            kind = F.when(c.try_cast("long").isNotNull(), "int").when(c.try_cast("double").isNotNull(), "float").when(F.lower(c).isin("true", "false"), "bool").otherwise("str")
            rows = out.frame.withColumn("_kind", kind)
            best = prefer or rows.groupBy("_kind").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), F.desc("_kind")).first()[0]
            out = ValueCounts(rows.where(F.col("_kind") == best).drop("_kind"), self.keys)
        return out

    def __eq__(self, other) -> bool:
        """By the number of keys, as the other comparisons."""
        return isinstance(other, (ValueCounts, int)) and int.__eq__(*self._dims(other))

    __hash__ = None

    def _dims(self, other) -> tuple[int, int]:
        return len(self.keys), len(other.keys) if isinstance(other, ValueCounts) else int(other)


for _name, _test in {"__lt__": int.__lt__, "__gt__": int.__gt__, "__le__": int.__le__, "__ge__": int.__ge__}.items():
    setattr(ValueCounts, _name, lambda self, other, test=_test: test(*self._dims(other)))


def fill(df: DataFrame, columns: str | Sequence[str], specs: dict | None = None, drop: dict[str, Sequence] | None = None, null_time_as_epoch: bool = False) -> ValueCounts:
    """Counts of the bins and categories of one set of columns; rows with a missing key don't count. One shuffle of partial counts."""
    names = parse_columns(columns)
    keys = key_columns(df, names, specs or {}, null_time_as_epoch)
    counts = df.select(*[k.alias(c) for k, c in zip(keys, names, strict=True)]).dropna().groupBy(*names).agg(F.count(F.lit(1)).alias("count"))
    out = ValueCounts(counts, names)
    for c, values in (drop or {}).items():
        out = out.drop(values, c) if c in names else out
    return out


def fill_all(df: DataFrame, columns: Sequence[str] = (), specs: dict | None = None) -> DataFrame:
    """One-dimensional histograms of many columns in one scan and one shuffle: (variable, bin, category, count)."""
    names = list(columns) or sorted(df.columns)
    parts = []
    for c, k, b in zip(names, key_columns(df, names, specs or {}), bins_for(df, names, specs or {}), strict=True):
        parts.append(F.struct(F.lit(c).alias("variable"), (F.lit(None).cast("long") if b is None else k).alias("bin"), (k if b is None else F.lit(None).cast("string")).alias("category")))
    rows = df.select(F.explode(F.array(*parts)).alias("v")).select("v.*").where("bin is not null or category is not null")
    return rows.groupBy("variable", "bin", "category").agg(F.count(F.lit(1)).alias("count"))


def fill_sums(df: DataFrame, columns: str | Sequence[str], quantity: Column, specs: dict | None = None) -> DataFrame:
    """Counts and the sum of a quantity in each bin."""
    names = parse_columns(columns)
    keys = key_columns(df, names, specs or {})
    return df.select(*[k.alias(c) for k, c in zip(keys, names, strict=True)], quantity.alias("_q")).dropna(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("count"), F.sum("_q").alias("total"))


@total_ordering
class Histogram:
    """One variable's histogram on the driver: bin number or category to count; it has as many entries as filled bins."""

    def __init__(self, counts: dict, bins: Bins | dict | None = None, variable: str = "x", kind: str | None = None):
        if not counts:
            raise AttributeError("no counts")
        self.bins, self._variable = Bins.of(bins), variable
        self._kind = kind or ("numeric" if self.bins else "category")
        mixed = len({type(k) for k in counts if k is not None and not isinstance(k, (int, float))} | {int for k in counts if isinstance(k, (int, float))}) > 1
        self.counts = {k: counts[k] for k in sorted(counts, key=lambda k: (k is None, type(k).__name__ if mixed else "", k if k is not None else 0))}

    @property
    def variable(self) -> str:
        return self._variable

    @variable.setter
    def variable(self, name: str) -> None:
        if self._variable not in ("x", name):
            raise AttributeError(f"the variable is {self._variable!r} already")
        self._variable = name

    @property
    def kind(self) -> str:
        return self._kind

    @kind.setter
    def kind(self, name: str) -> None:
        if name != self._kind:
            raise AttributeError(f"the kind is {self._kind!r} already")

    @classmethod
    def of(cls, counts: ValueCounts, bins: Bins | dict | None = None, most: int = 1_000_000) -> Histogram:
        """The counts on the driver; over ``most`` filled bins are an error."""
        rows = counts.frame.select(counts.keys[0], "count").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"over {most} bins are filled")
        return cls({r[0]: r[1] for r in rows}, bins, counts.keys[0])

    def consistent(self, prefer: type | None = None) -> Histogram:
        """Only the keys of the type that has the largest counts in all (or the preferred one); of equals the first name by alphabet."""
        sums: dict[type, float] = {}
        for k, n in self.filled().items():
            sums[type(k)] = sums.get(type(k), 0) + n
        best = prefer or min(sums, key=lambda t: (-sums[t], t.__name__))
        return Histogram({k: n for k, n in self.filled().items() if type(k) is best}, self.bins, self.variable, self.kind)

    @classmethod
    def from_arrays(cls, counts: Sequence, edges_or_labels: Sequence, variable: str = "x") -> Histogram:
        if all(isinstance(e, str) for e in edges_or_labels):
            if len(counts) != len(edges_or_labels):
                raise ValueError("as many counts as labels are needed")
            return cls(dict(zip(edges_or_labels, counts, strict=True)), None, variable)
        if len(counts) != len(edges_or_labels) - 1:
            raise ValueError("one edge more than counts is needed")
        return cls(dict(enumerate(counts)), Bins(edges=tuple(edges_or_labels)), variable)

    def __eq__(self, other) -> bool:
        return isinstance(other, Histogram) and self.n_bins == other.n_bins

    def __lt__(self, other) -> bool:
        return self.n_bins < other.n_bins

    __hash__ = None
    n_dim = 1

    @property
    def n_bins(self) -> int:
        return len(self.counts)

    def filled(self) -> dict:
        return {k: n for k, n in self.counts.items() if k is not None}

    def labels(self) -> list:
        return list(self.filled())

    def entries(self) -> list:
        return list(self.filled().values())

    def centers(self) -> list:
        return [self.bins.center_of(k) for k in self.filled()] if self.bins else self.labels()

    def edges(self) -> list:
        """All edges from the first filled bin to the last."""
        if not self.bins:
            return []
        k = self.labels()
        return [self.bins.edge_of(n) for n in range(k[0], k[-1] + 2)]

    def range(self) -> tuple:
        k = self.labels()
        return (self.bins.edge_of(k[0]), self.bins.edge_of(k[-1] + 1)) if self.bins else (k[0], k[-1])

    def at(self, value) -> int:
        """The count of the bin of a value."""
        return self.counts.get(self.bins.label_of(value) if self.bins and value is not None else value, 0)

    def bin_count(self, label) -> int:
        return self.counts.get(label, 0)

    def values(self, low=None, high=None) -> tuple[list, list]:
        """Counts of all bins of a range, empty ones too, and the edges; of categories counts and labels."""
        if not self.bins:
            return self.entries(), self.labels()
        low, high = (self.range()[0] if low is None else low), (self.range()[1] if high is None else high)
        edges = self.bins.truncated_edges(low, high)
        first = self.bins.label_of(low)
        return [self.counts.get(first + i, 0) for i in range(len(edges) - 1)], edges

    def normalized(self) -> Histogram:
        total = sum(self.counts.values())
        return Histogram({k: n / total for k, n in self.counts.items()}, self.bins, self.variable, self.kind)

    def surface(self) -> float:
        if not self.bins:
            raise TypeError("categories have no width")
        return sum(n * (self.bins.edge_of(k + 1) - self.bins.edge_of(k)) for k, n in self.filled().items())

    def copy(self) -> Histogram:
        return Histogram(dict(self.counts), self.bins, self.variable, self.kind)

    @staticmethod
    def combine(hists: Sequence[Histogram], tolerance: float = 1e-6) -> Histogram:
        """The sum of histograms of equal bins."""
        one = hists[0]
        for h in hists[1:]:
            a, b = one.bins, h.bins
            near = lambda x, y, w: abs(x - y) <= tolerance * w
            same = (a is None) == (b is None) and (a is None or (a.edges == b.edges if a.edges or b.edges else near(a.width, b.width, a.width) and near(a.offset, b.offset, a.width)))
            if not same:
                raise ValueError("the bins differ")
        keys = {k for h in hists for k in h.counts}
        return Histogram({k: sum(h.counts.get(k, 0) for h in hists) for k in keys}, one.bins, one.variable, one.kind)

    def simulate(self, spark, size: int, seed: int = 0) -> DataFrame:
        """(id, bin, value): draws from the histogram by its cumulative counts; value is the bin's centre or the category."""
        return simulate(spark, self.labels(), self.entries(), self.centers(), size, seed)


def simulate(spark, labels: Sequence, weights: Sequence[float], values: Sequence, size: int, seed: int = 0) -> DataFrame:
    """Draws of labels by weight, by the inverse of the cumulative distribution; a draw depends on its id and the seed alone."""
    total, upto, bounds = sum(weights), 0.0, []
    for w in weights:
        upto += w / total
        bounds.append(upto)
    edges = F.array(*[F.lit(b) for b in bounds[:-1]]) if len(bounds) > 1 else F.array().cast("array<double>")
    u = unit("id", seed)
    at = F.size(F.filter(edges, lambda b: b <= u)) + 1
    return spark.range(size).select("id", F.element_at(F.array(*[F.lit(x) for x in labels]), at).alias("bin"), F.element_at(F.array(*[F.lit(x) for x in values]), at).alias("value"))


def normalized(counts: ValueCounts) -> DataFrame:
    total = counts.frame.agg(F.sum("count").alias("_t"))
    return counts.frame.join(F.broadcast(total)).withColumn("fraction", F.col("count") / F.col("_t")).drop("_t")


def zero_filled(counts: ValueCounts, low: int | None = None, high: int | None = None) -> DataFrame:
    """All bin numbers from low to high, empty ones with count 0."""
    k = counts.keys[0]
    span = counts.frame.agg((F.min(k) if low is None else F.lit(low)).alias("_a"), (F.max(k) if high is None else F.lit(high)).alias("_b"))
    every = span.select(F.explode(F.sequence(F.col("_a").cast("long"), F.col("_b").cast("long"))).alias(k))
    return every.join(counts.frame, k, "left").select(k, F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def cumulative(counts: ValueCounts) -> DataFrame:
    """Counts and their running sum; by parts, as there may be as many bins as there are categories."""
    return running_sum(counts.frame, [counts.keys[0]], F.col("count"), "upto")


def surface(counts: ValueCounts, bins: Bins) -> DataFrame:
    k = F.col(counts.keys[0])
    return counts.frame.agg(F.sum(F.col("count") * (bins.right(k) - bins.left(k))).alias("surface"))


def combined(parts: Sequence[ValueCounts]) -> ValueCounts:
    return reduce(lambda a, b: a + b, parts)


def days(c: Column) -> Column:
    return micros(c) / 86_400e6


def finite(x: float | None) -> bool:
    return x is not None and math.isfinite(x)
