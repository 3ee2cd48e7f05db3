"""Column profiles: counts, moments, midpoint quantiles, mode, automatic histograms; also by group."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from math import ceil, floor, inf, sqrt

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.expr import TIMES, Bins, kind_of, micros, nan_to_null
from loomframe.operators.relational import numbered_rows, top

PROBABILITIES = (0.01, 0.05, 0.16, 0.5, 0.84, 0.95, 0.99)
#: Those that the range of an automatic histogram comes from.
ENDS = (0.05, 0.95)


def properties(df: DataFrame, column: str) -> dict[str, bool]:
    t = df.schema[column].dataType
    kind = kind_of(df, column)
    return {"is_num": kind in ("numeric", "time"), "is_int": kind == "numeric" and t.simpleString() in ("tinyint", "smallint", "int", "bigint"), "is_ts": isinstance(t, TIMES)}


#: Rows that a step of narrowing samples for its pivots, and rows that may be left for the last step.
SAMPLED, LEFT = 50_000, 500_000


@dataclass(frozen=True)
class _Stretch:
    """The values from first to last of a column: how many rows, their weight, that of all before, and the values next to them."""

    first: float
    last: float
    n: int
    weight: float
    before: float = 0.0
    previous: float | None = None
    next: float | None = None

    def holds(self, x: float) -> bool:
        return _order(self.first) <= _order(x) <= _order(self.last)


def _order(x: float) -> tuple[bool, float]:
    """NaN is the greatest, as in Spark."""
    return x != x, 0.0 if x != x else x


def _once(x: Column) -> Column:
    """A value that is dear to compute as a generator's: the optimizer would copy the computation into every comparison."""
    return F.explode(F.array(x))


def _within(spans: Sequence[tuple[float, float]]) -> Column:
    return reduce(lambda a, b: a | b, [F.col("x").between(*span) for span in spans], F.lit(False))


def _pivots(stretch: _Stretch, sample: Sequence[tuple[float, float]], targets: Sequence[float]) -> set[float]:
    """Values that part a stretch: closely about the targets, which are cumulated weights, as far as the sample tells, and its quarters."""
    out = {stretch.first, stretch.last}
    seen = [(x, w) for x, w in sample if stretch.holds(x)]
    if seen:
        upto = list(accumulate(w for _, w in seen))
        m = len(seen)
        out |= {seen[m * k // 4][0] for k in (1, 2, 3)}
        for t in targets:
            share = min(max((t - stretch.before) / stretch.weight, 0.0), 1.0)
            at, off = bisect_left(upto, share * upto[-1]), ceil(3 * sqrt(share * (1 - share) * m)) + 1
            out |= {seen[max(at - off, 0)][0], seen[min(at + off, m - 1)][0]}
    return {x if x == x else inf for x in out}  # above infinity there is NaN alone


def _cells(pivots: Sequence[float]) -> Column:
    """The number of x's cell, found by halving: each pivot is a cell of its own between those of the values below and above it."""

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bound = F.lit(pivots[mid // 2])
        return F.when(F.col("x") > bound if mid % 2 else F.col("x") >= bound, half(mid + 1, hi)).otherwise(half(lo, mid))

    return half(0, 2 * len(pivots))


def _narrowed(rows: DataFrame, probabilities: Sequence[float]) -> tuple[list[_Stretch], float]:
    """The stretch around each probability, and the weight of all rows (x, w).

    Each step parts the stretches by pivots from a sample and counts all rows of each cell, so that the cell of a
    probability is known and not guessed; no row is shuffled. It ends when so few rows are left that they can be sorted,
    besides stretches of one value, which are one row by a partial sum.
    """
    stats = [F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.min("x").alias("first"), F.max("x").alias("last")]
    every = rows.agg(*stats).first()
    if not every["n"]:
        return [], 1.0
    total, was = every["w"], None
    at = [_Stretch(every["first"], every["last"], every["n"], total)] * len(probabilities)
    while True:
        wide = {s.first: s for s in at if _order(s.first) != _order(s.last)}
        left = sum(s.n for s in wide.values())
        if left <= LEFT or left == was:
            return at, total
        was, inside = left, rows.where(_within([(s.first, s.last) for s in wide.values()]))
        sample = sorted(((r["x"], r["w"]) for r in inside.where(F.rand(11) < SAMPLED / left).collect()), key=lambda r: _order(r[0]))
        pivots = set().union(*[_pivots(s, sample, [p * total for p, t in zip(probabilities, at, strict=True) if t.first == s.first]) for s in wide.values()])
        found = inside.groupBy(_cells(sorted(pivots)).alias("cell")).agg(*stats).collect()
        found.sort(key=lambda r: r["cell"])
        for i, (s, p) in enumerate(zip(at, probabilities, strict=True)):
            if s.first not in wide:
                continue
            cells, before, k = [c for c in found if s.holds(c["first"])], s.before, 0
            while k < len(cells) - 1 and before + cells[k]["w"] < p * total:
                before += cells[k]["w"]
                k += 1
            c = cells[k]
            at[i] = _Stretch(c["first"], c["last"], c["n"], c["w"], before, cells[k - 1]["last"] if k else s.previous, cells[k + 1]["first"] if k + 1 < len(cells) else s.next)


def _cumulated(rows: DataFrame, probabilities: Sequence[float]) -> tuple[DataFrame, float]:
    """(x, w, a, b, c): the distinct values around the probabilities with their weight, that of their first and last row, and
    the weight up to them; and the weight of all."""
    at, total = _narrowed(rows, probabilities)
    spans: list[list] = []  # first, last, weight before; with the values next to a stretch, and without overlaps
    for s in sorted(at, key=lambda s: (_order(s.first), _order(s.last))):
        first, last = s.first if s.previous is None else s.previous, s.last if s.next is None else s.next
        if spans and _order(first) <= _order(spans[-1][1]):
            spans[-1][1] = max(spans[-1][1], last, key=_order)
        else:
            spans.append([first, last, s.before, s.previous])
    x = F.col("x")
    number, before, own = F.lit(0), F.lit(0.0), F.col("w")
    for k, (_, last, weight, previous) in reversed(list(enumerate(spans))):
        number, before = F.when(x <= last, k).otherwise(number), F.when(x <= last, weight).otherwise(before)
        own = own if previous is None else F.when(x == previous, 0.0).otherwise(own)  # is in the weight before
    distinct = rows.where(_within([s[:2] for s in spans])).groupBy("x").agg(F.sum("w").alias("w"), F.min("w").alias("a"), F.max("w").alias("b"))
    upto = F.sum("own").over(Window.partitionBy("span").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return distinct.withColumns({"span": number, "own": own}).withColumn("c", before + upto), total


def _sides(df: DataFrame, column: str, probabilities: Sequence[float], weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., b0, a0, b1, ...): for each probability the last value that begins at or below it with its end, and the first that ends
    at or above it with its begin."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*by, F.col(column).cast("double").alias("x"), w.alias("w")).where("x is not null and w > 0" + "".join(f" and `{b}` is not null" for b in by))
    # a row of weight w among n equal ones: the first and the last midpoint need the first and last row's weight
    if by:
        distinct = rows.groupBy(*by, "x").agg(F.sum("w").alias("w"), F.min("w").alias("a"), F.max("w").alias("b"))
        cum = distinct.withColumn("c", F.sum("w").over(Window.partitionBy(*by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
        cum = cum.join(distinct.groupBy(*by).agg(F.sum("w").alias("t")), by)
    else:
        cum, total = _cumulated(rows, probabilities)
        cum = cum.withColumn("t", F.lit(total))
    ends = cum.select(*by, "x", ((F.col("c") - F.col("w") + F.col("a") / 2) / F.col("t")).alias("lo"), ((F.col("c") - F.col("b") / 2) / F.col("t")).alias("hi"))
    aggs: list[Column] = []
    for i, p in enumerate(probabilities):
        below, above = F.col("lo") <= p, F.col("hi") >= p
        aggs += [
            F.max(F.when(below, F.struct("x", "hi"))).alias(f"b{i}"),
            F.min(F.when(above, F.struct("x", "lo"))).alias(f"a{i}"),
        ]
    return ends.groupBy(*by).agg(*aggs)


def quantiles(df: DataFrame, column: str, probabilities: Sequence[float], weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., p, quantile): weighted midpoint quantiles. With pn = (cumulated weight - weight / 2) / total weight, linear
    between neighbouring pn, and at the ends the least and largest value.

    Without groups the values around each probability are found by counting, and only they are sorted. In groups equal
    values are one row first, by a shuffle of partial sums, so that the window over a group runs over its distinct
    values. Ties are spread as the rows they are: between the pn of the first and the last row of a value it is flat.
    Each row of the window gives at most the two ends of its value; every probability meets the rows around it by a
    minimum and a maximum, not by a join of all with all.
    """
    by = list(by)
    one = _sides(df, column, probabilities, weight, by)
    values = []
    for i, p in enumerate(probabilities):
        b, a = F.col(f"b{i}"), F.col(f"a{i}")
        between = b["x"] + (a["x"] - b["x"]) * (F.lit(p) - b["hi"]) / (a["lo"] - b["hi"])
        q = F.when(b.isNull(), a["x"]).when(a.isNull() | (a["x"] <= b["x"]), b["x"]).otherwise(between)
        values.append(F.struct(F.lit(float(p)).alias("p"), q.alias("quantile")))
    return one.select(*by, F.explode(F.array(*values)).alias("v")).select(*by, "v.p", "v.quantile")


def _quantile(b: Row | None, a: Row | None, p: float, unit: int = 1) -> float:
    """The quantile between the sides of a probability, of values that are whole numbers of a unit where that isn't 1."""
    low, high = (None if side is None else side["x"] if unit == 1 else float(int(side["x"]) * unit) for side in (b, a))
    if low is None or high is None or high <= low:
        return high if low is None else low
    return low + (high - low) * (p - b["hi"]) / (a["lo"] - b["hi"])


def profile(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row for each column: count, filled, distinct, nan and, of numbers and times, mean, std (population), min, max.

    One pass for all columns, and one shuffle of partial counts for the distinct values of all. Times are in days since
    1970. With weights, count and filled are summed weights.
    """
    df = nan_to_null(df)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    aggs, parts = [], []
    for i, c in enumerate(columns):
        kind = kind_of(df, c)
        x = micros(F.col(c)) / 86_400e6 if kind == "time" else F.col(c).cast("double") if kind == "numeric" else None
        some = F.col(c).isNotNull()
        aggs += [
            F.sum(w).cast("long").alias(f"count{i}"),
            F.coalesce(F.sum(F.when(some, w)).cast("long"), F.lit(0)).alias(f"filled{i}"),
            F.count(F.when(~some, 1)).alias(f"nan{i}"),
        ]
        if x is not None:
            s, n = F.sum(F.when(some, w * x)), F.sum(F.when(some, w))
            aggs += [F.try_divide(s, n).alias(f"mean{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
            aggs.append((F.stddev_pop(x) if not weight else F.sqrt(F.greatest(F.try_divide(F.sum(F.when(some, w * x * x)), n) - F.pow(F.try_divide(s, n), 2), F.lit(0.0)))).alias(f"std{i}"))
        number = [F.col(f"{k}{i}").alias(k) if x is not None else F.lit(None).cast("double").alias(k) for k in ("mean", "std", "min", "max")]
        parts.append(F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in ("count", "filled", "nan")], *number))
    row = df.agg(*aggs).select(F.explode(F.array(*parts)).alias("v")).select("v.*")
    out = row.join(F.broadcast(distinct_counts(df, columns)), "i", "left")  # a row for each column
    return out.select("column", "count", "filled", F.coalesce("distinct", F.lit(0).cast("long")).alias("distinct"), "nan", "mean", "std", "min", "max")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, distinct): filled values of the i-th column, as (column, value) rows that are counted twice, with partial sums; not
    a copy of every row for each column. Numbers and times stay numbers; each such type has a shuffle of its own."""
    typed: dict[str, list[Column]] = {}
    for i, c in enumerate(columns):
        t, x = df.schema[c].dataType, F.col(c)
        kind = "double" if isinstance(t, (T.FloatType, T.DoubleType)) else "long" if isinstance(t, T.IntegralType) else t.simpleString() if isinstance(t, TIMES) else "string"
        x = x + F.lit(0) if kind == "double" else x
        typed.setdefault(kind, []).append(F.struct(F.lit(i).alias("i"), x.cast(kind).alias("v")))
    counts = []
    for each in typed.values():
        rows = df.select(F.explode(F.array(*each)).alias("e") if len(each) > 1 else each[0].alias("e")).select("e.*").where("v is not null")
        counts.append(rows.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("i").agg(F.count(F.lit(1)).alias("distinct")))
    return reduce(DataFrame.unionByName, counts)


#: The statistics of ``statistics``, in order.
STATISTICS = ("count", "filled", "distinct", "nan", "mean", "std", "min", "max", "p01", "p05", "p16", "p50", "p84", "p95", "p99", "mode")


def weighted(df: DataFrame, column: str, weights: str | Sequence[float] | dict, order: Sequence[str] = (), name: str = "__weight") -> tuple[DataFrame, str]:
    """The frame with its column of weights: a column's name, a dict from the column's values (others weigh 0), or a list, one
    number for each row in an order."""
    if isinstance(weights, str):
        return df, weights
    if isinstance(weights, dict):
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        return df.withColumn(name, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(0.0))), name
    rows = numbered_rows(df, list(order), "__n")
    table = df.sparkSession.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], f"__n long, {name} double")
    if rows.count() != len(weights):
        raise ValueError("as many weights as rows are needed")
    return rows.join(table, "__n").drop("__n"), name


def statistics(df: DataFrame, columns: Sequence[str], weights: str | Sequence[float] | dict | None = None, order: Sequence[str] = (), n: int = 30) -> DataFrame:
    """One row for each column with all of STATISTICS as numbers, of times as microseconds since 1970 (std in days), and as
    ``times`` the statistics of a time that are points in time; ``top``: the mode as text, for all kinds.

    mode: the centre of the fullest bin of the automatic histogram (of equals the lowest) of numbers and times, the most
    frequent category (the least of equals). A column without values has counts only.
    """
    if weights is not None and not isinstance(weights, str):
        if len(columns) != 1:
            raise ValueError("weights by list or dict are those of one column")
        df, weights = weighted(df, columns[0], weights, order)
    base = {r["column"]: r.asDict() for r in profile(df, columns, weights).collect()}
    rows = []
    for c in columns:
        kind, found = kind_of(df, c), base[c]
        if found["filled"] and kind != "category":
            x = (_once(micros(F.col(c)).cast("double")) if kind == "time" else F.col(c).cast("double")).alias("x")
            values = nan_to_null(df.select(x, *([F.col(weights).alias("w")] if weights else [])))
            if kind == "time":
                found |= {k: found[k] * 86_400e6 for k in ("mean", "min", "max")}
            sides = _sides(values, "x", PROBABILITIES, "w" if weights else None).first()
            around = {p: (sides[f"b{i}"], sides[f"a{i}"], p) for i, p in enumerate(PROBABILITIES)}
            found |= {f"p{round(p * 100):02d}": _quantile(*v) for p, v in around.items()}
            ends = None if weights else [_quantile(*around[p], 1000 if kind == "time" else 1) for p in ENDS]
            best = auto_histogram(df, c, n, ends=ends).orderBy(F.desc("count"), "bin").first()
            found["mode"] = (best["low"] + best["high"]) / 2 / (1000 if kind == "time" else 1)
            found["top"] = str(found["mode"]) if kind == "numeric" else None
        elif found["filled"]:
            found["top"] = str(top(df, c, 1).first()[0])
        times = {k: found.get(k) for k in STATISTICS[4:] if k != "std"} if kind == "time" and found["filled"] else {}
        rows.append((c, kind, *[None if found.get(k) is None else float(found[k]) for k in STATISTICS], found.get("top"), {k: int(v) for k, v in times.items() if v is not None}))
    out = df.sparkSession.createDataFrame(rows, "column string, kind string, " + ", ".join(f"{k} double" for k in STATISTICS) + ", top string, times map<string,long>")
    return out.withColumn("times", F.transform_values("times", lambda _, v: F.timestamp_micros(v)))


def group_profile(df: DataFrame, column: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """The profile of a number in each group, with quantiles; rows without a group don't count."""
    by = [by] if isinstance(by, str) else list(by)
    rows = nan_to_null(df).dropna(subset=by)
    x = F.col(column).cast("double")
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.count(x).alias("filled"), F.count_distinct(x).alias("distinct"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles(rows, column, PROBABILITIES, weight, by).groupBy(*by).pivot("p", [float(p) for p in PROBABILITIES]).agg(F.first("quantile"))
    q = q.withColumnsRenamed({f"{p}": f"p{round(p * 100):02d}" for p in PROBABILITIES})
    return stats.join(q, by, "left").orderBy(*by)


def null_counts(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    row = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)])).alias("v")).select("v.*")


def auto_bins(low: float, high: float, n: int = 30, whole: bool = False) -> tuple[float, float, int]:
    """(first edge, width, bins) from the 5 % and 95 % quantiles: widened by a twentieth of the range below, then above,
    and down or up to 0 where that is near; whole numbers get whole widths on half edges."""
    lo, hi = low, high
    lo -= 0.05 * (hi - lo)
    hi += 0.05 * (hi - lo)
    if 0 < lo < 0.2 * (hi - lo):
        lo = 0.0
    elif -0.2 * (hi - lo) < hi < 0:
        hi = 0.0
    if whole:
        width = max(round((hi - lo) / n), 1)
        lo = floor(lo - 0.5) + 0.5
        n = int((hi - lo) // width) + ((hi - lo) % width > 0)
        return lo, float(width), max(n, 1)
    return lo, ((hi - lo) / n) or 1.0, n


def auto_histogram(df: DataFrame, column: str, n: int = 30, edges: Sequence[float] = (), ends: Sequence[float] | None = None) -> DataFrame:
    """(bin, low, high, count): values outside the range don't count, the last bin is closed; of categories the n most frequent.

    Two passes: quantiles first (two numbers reach the driver), then one aggregate. ``ends``: these quantiles, where they
    are known; of a time in nanoseconds.
    """
    kind = kind_of(df, column)
    if kind == "category":
        return top(df, column, n)
    df = nan_to_null(df)
    x = micros(F.col(column)) * 1000 if kind == "time" else F.col(column).cast("double")
    if edges:
        bins, count, last = Bins(edges=tuple(edges)), len(edges) - 1, edges[-1]
        k, lo = F.least(bins.index(x), F.lit(count - 1)), edges[0]
    else:
        values = df.select((_once(x.cast("double")) if kind == "time" else x).alias("x"))
        low, high = ends or (r["quantile"] for r in quantiles(values, "x", ENDS).orderBy("p").collect())
        lo, width, count = auto_bins(low, high, n, properties(df, column)["is_int"] or kind == "time")
        bins, last = Bins(width=width, offset=lo), lo + width * count
        k = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(count - 1)).cast("long")
    rows = df.select(x.alias("x"), k.alias("bin")).where((F.col("x") >= lo) & (F.col("x") <= last))
    found = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(count).select(F.col("id").alias("bin"))
    out = every.join(F.broadcast(found), "bin", "left")
    return out.select("bin", bins.left(F.col("bin")).cast("double").alias("low"), bins.right(F.col("bin")).cast("double").alias("high"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def mode(counts: DataFrame, key: str) -> DataFrame:
    """The key of the largest count, of any type; of equals the least."""
    best = F.min_by(F.struct(F.col(key).alias("mode"), "count"), F.struct(-F.col("count"), key)).alias("m")
    return counts.agg(best).select("m.mode", "m.count")
