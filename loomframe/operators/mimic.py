"""Data mimicry: mixed-variable generators, preparation, kernel bandwidths, resampling, evaluation."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators import assoc
from loomframe.operators.assoc import chi2_survival
from loomframe.operators.encode import code_map
from loomframe.operators.relational import bootstrap, numbered_rows, running_sum, unit

# --- generators ---


def normal(key: str | Column, seed: int, mean: float = 0.0, std: float = 1.0) -> Column:
    """A normal number that depends on key and seed alone (Box and Muller)."""
    r = F.sqrt(-2 * F.log(1 - unit(key, seed)))
    return mean + std * r * F.cos(2 * np.pi * unit(key, seed + 7919))


def choice(key: str | Column, seed: int, values: Sequence, weights: Sequence[float] | None = None) -> Column:
    weights = weights or [1.0] * len(values)
    bounds = np.cumsum(np.array(weights) / sum(weights))[:-1].tolist()
    u = unit(key, seed)
    edges = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.size(F.filter(edges, lambda b: b <= u)) + 1)


def generate(spark: SparkSession, columns: dict[str, dict], size: int, seed: int = 1) -> DataFrame:
    """Columns of normal numbers (mean, std, type) or of categories (choices, probabilities), as each one's options say."""
    out = spark.range(size)
    for k, (name, o) in enumerate(columns.items()):
        if "choices" in o:
            out = out.withColumn(name, choice("id", seed * 1000 + k, o["choices"], o.get("probabilities")))
        else:
            out = out.withColumn(name, normal("id", seed * 1000 + k, o.get("mean", 0.0), o.get("std", 1.0)).cast(o.get("type", "double")))
    return out


def mixed_variables(
    spark: SparkSession,
    size: int,
    continuous: Sequence[dict] = (),
    unordered: Sequence[Sequence[float]] = (),
    ordered: Sequence[Sequence[float]] = (),
    heaps: dict[str, dict] | None = None,
    missing: dict[str, int] | None = None,
    seed: int = 1,
) -> DataFrame:
    """Columns a, b, c ...: continuous (normal with a wide uniform part), unordered (letters), ordered (whole numbers).

    heaps: {column: {value, size}} sets so many random rows to the value; missing: so many draws of rows to null.
    """
    names = iter("abcdefghijklmnopqrstuvwxyz")
    out, k = spark.range(size), seed * 1000
    for o in continuous:
        m, s, part = o.get("mean", 0.0), o.get("std", 1.0), o.get("uniform", 0.05)
        wide = m - 5 * s + unit("id", k + 1) * 10 * s
        out = out.withColumn(next(names), F.when(unit("id", k + 2) < part, wide).otherwise(normal("id", k + 3, m, s)))
        k += 10
    for p in unordered:
        out, k = out.withColumn(next(names), choice("id", k, list("ABCDEFGHIJKLMNOPQRSTUVWXYZ")[: len(p)], p)), k + 10
    for p in ordered:
        out, k = out.withColumn(next(names), choice("id", k, list(range(len(p))), p)), k + 10
    for column, value, n, once in [(c, h["value"], h["size"], True) for c, h in (heaps or {}).items()] + [(c, None, n, False) for c, n in (missing or {}).items()]:
        k += 10
        rows = spark.range(size).orderBy(unit("id", k)).limit(n) if once else spark.range(n).select(F.floor(unit("id", k) * size).cast("long").alias("id")).distinct()
        out = out.join(rows.withColumn("_hit", F.lit(True)), "id", "left").withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))).drop("_hit")
    return out


# --- preparation ---


def hash_names(names: Sequence[str], salt: str = "") -> dict[str, str]:
    return {c: hashlib.pbkdf2_hmac("sha1", c.encode(), salt.encode(), 1000, 8).hex() for c in names}


def anonymize(df: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """The column's values under a random one-to-one map of its distinct values."""
    values = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    a = numbered_rows(values, ["v"], "n").withColumnRenamed("v", "_old")
    b = numbered_rows(values.withColumn("_h", F.xxhash64(F.lit(seed), "v")), ["_h", "v"], "n").select("n", F.col("v").alias("_new"))
    return df.join(a.join(b, "n").drop("n"), F.col(column) == F.col("_old"), "left").withColumn(column, F.col("_new")).drop("_old", "_new")


def to_codes(df: DataFrame, columns: Sequence[str], order: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    maps = {c: code_map(df, c, order) for c in columns}
    out = df
    for c, m in maps.items():
        out = out.join(m.select(F.col("value").alias("_v"), F.col("code").alias("_c")), F.col(c) == F.col("_v"), "left").withColumn(c, F.col("_c")).drop("_v", "_c")
    return out, maps


def peaks(df: DataFrame, column: str, over: int) -> DataFrame:
    """Values that come more than so often, with their counts."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > over)


def smooth_peaks(df: DataFrame, column: str, over: int, key: str, fraction: float = 0.0001, seed: int = 0) -> DataFrame:
    """Rows at a peak move by a normal number whose width is a fraction of the column's range."""
    at = peaks(df, column, over).select(F.col(column).alias("_peak"))
    span = df.agg((F.max(column) - F.min(column)).alias("_span"))
    moved = F.col(column) + normal(key, seed) * F.col("_span") * fraction
    return df.join(at, F.col(column) == F.col("_peak"), "left").join(F.broadcast(span)).withColumn(column, F.when(F.col("_peak").isNotNull(), moved).otherwise(F.col(column))).drop("_peak", "_span")


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df
    for c, t in df.dtypes:
        if c in columns and t in ("double", "float"):
            out = out.where(~F.isnan(c) | F.col(c).isNull())
    return out.dropna("any", subset=list(columns))


def extremes(df: DataFrame, columns: Sequence[str], fraction: float = 0.15) -> DataFrame:
    """Two rows: below the least and above the largest value by a fraction of the range."""
    row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))])
    side = lambda s: F.struct(*[(F.col(f"{'lo' if s < 0 else 'hi'}{i}") + s * fraction * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias(c) for i, c in enumerate(columns)])
    return row.select(F.explode(F.array(side(-1), side(1))).alias("v")).select("v.*")


def append_extremes(df: DataFrame, columns: Sequence[str], fraction: float = 0.15) -> DataFrame:
    return df.unionByName(extremes(df, columns, fraction), allowMissingColumns=True)


def percent_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, q): the mean rank of each distinct value from 0 to 1."""
    one = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = one.agg(F.sum("n").alias("t"))
    upto = running_sum(one, ["value"], F.col("n"), "upto").join(F.broadcast(total))
    return upto.select("value", F.coalesce(F.try_divide(F.col("upto") - (F.col("n") + 1) / 2, F.col("t") - 1), F.lit(0.5)).alias("q"))


def _once(value: Column, body) -> Column:
    """``body(v)`` with ``v`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    return reduce(lambda a, c: a * x + c, coefficients[1:], F.lit(coefficients[0]))


_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_MIDDLE = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def inverse_normal(q: str | Column) -> Column:
    """The standard normal quantile, by the rational approximations of algorithm AS 241 (16 digits); q is held to [1e-7, 1 - 1e-7]."""
    q = F.least(F.greatest(F.col(q) if isinstance(q, str) else q, F.lit(1e-7)), F.lit(1 - 1e-7))

    def ratio(x: Column, c) -> Column:
        return _once(x, lambda v: _polynomial(v, c[0]) / _polynomial(v, c[1]))

    def far(p: Column) -> Column:
        return _once(F.sqrt(-F.log(p)), lambda r: F.when(r <= 5, ratio(r - 1.6, _MIDDLE)).otherwise(ratio(r - 5, _TAIL)))

    def of(p: Column) -> Column:
        d = p - 0.5
        return F.when(F.abs(d) <= 0.425, d * ratio(0.180625 - d * d, _CENTRE)).when(d < 0, -far(p)).otherwise(far(1 - p))

    return _once(q, of)


def normal_cdf(z: str | Column) -> Column:
    """The standard normal distribution function, by Hart's rational approximation (15 digits) and a continued fraction in the tails."""
    z = F.col(z) if isinstance(z, str) else z

    def of(z: Column) -> Column:
        x = F.abs(z)
        top = _polynomial(x, (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376))
        bottom = _polynomial(x, (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752))
        tail = x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))
        upper = F.exp(-x * x / 2) * F.when(x < 7.07106781186547, top / bottom).otherwise(1 / (tail * 2.506628274631))
        return F.when(x > 37, F.when(z > 0, 1.0).otherwise(0.0)).when(z > 0, 1 - upper).otherwise(upper)

    return _once(z, of)


def normal_scores(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """The column through its own quantiles to a standard normal; missing stays missing."""
    table = percent_ranks(df, column).select(F.col("value").alias("_v"), inverse_normal("q").alias("_z"))
    return df.join(table, F.col(column) == F.col("_v"), "left").withColumn(out or column, F.col("_z")).drop("_v", "_z")


def quantile_table(df: DataFrame, column: str, n: int = 1000) -> tuple[list[float], list[float]]:
    """(q, value) at n + 1 even probabilities, a bounded table for ``from_normal``.

    Of the distinct values the first and last of each n-th of the ranks reach the driver, and what lies between is linear.
    """
    near = percent_ranks(df, column).withColumn("k", F.floor(F.col("q") * n))
    found = near.groupBy("k").agg(F.min(F.struct("q", "value")).alias("a"), F.max(F.struct("q", "value")).alias("b")).collect()
    points = sorted({(float(x["q"]), float(x["value"])) for r in found for x in (r["a"], r["b"])})
    q = [k / n for k in range(n + 1)]
    return q, np.interp(q, [a for a, _ in points], [b for _, b in points]).tolist() if points else [0.0] * (n + 1)


def from_normal(c: Column, table: tuple[list[float], list[float]]) -> Column:
    """Standard normal numbers back through the quantiles, linear between them."""
    q, v = table
    n = len(q) - 1
    p = normal_cdf(c)
    k = F.least(F.floor(p * n), F.lit(n - 1)).cast("int")
    values = F.array(*[F.lit(x) for x in v])
    return F.element_at(values, k + 1) + (F.element_at(values, k + 2) - F.element_at(values, k + 1)) * (p * n - k)


def principal_axes(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and axes (columns of the matrix): one pass of sums of products, a small eigenproblem on the driver."""
    d = len(columns)
    row = df.agg(*[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i in range(d) for j in range(i, d)]).first()
    cov, k = np.zeros((d, d)), d
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = row[k]
            k += 1
    values, axes = np.linalg.eigh(cov)
    return np.array(row[:d], float), axes[:, np.argsort(-values)]


def rotate(df: DataFrame, columns: Sequence[str], means: np.ndarray, axes: np.ndarray, inverse: bool = False) -> DataFrame:
    m = axes.T if inverse else axes
    new = []
    for j in range(len(columns)):
        terms = [(F.col(c) if inverse else F.col(c) - float(means[i])) * float(m[i, j]) for i, c in enumerate(columns)]
        new.append((reduce(lambda a, b: a + b, terms) + (float(means[j]) if inverse else 0.0)).alias(columns[j]))
    return df.select(*[c for c in df.columns if c not in columns], *new)


# --- kernels ---


def bandwidths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, bandwidth) by the normal reference rule: 1.06 std n^(-1/(4+d)), in one pass."""
    d = len(columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)])
    parts = [F.struct(F.lit(c).alias("column"), (F.lit(1.06) * F.col(f"s{i}") * F.pow(F.col("n").cast("double"), F.lit(-1.0 / (4 + d)))).alias("bandwidth")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*parts)).alias("v")).select("v.*")


def aitchison_aitken(h: np.ndarray, same: np.ndarray, categories: np.ndarray) -> np.ndarray:
    return np.where(same, 1 - h, h / (categories - 1))


def aitchison_aitken_convolution(h: np.ndarray, same: np.ndarray, categories: np.ndarray) -> np.ndarray:
    """The kernel convolved with itself."""
    r = h / (categories - 1)
    return np.where(same, (1 - h) ** 2 + (categories - 1) * r**2, 2 * (1 - h) * r + (categories - 2) * r**2)


def wang_ryzin(s: float, value: int, categories: Sequence[int]) -> np.ndarray:
    """Weights of the categories around a value, summing to 1."""
    far = np.abs(np.asarray(categories) - value)
    w = np.where(far == 0, 1 - s, 0.5 * (1 - s) * s**far.astype(float))
    return w / w.sum()


def delta_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(pattern, n, n_cv) for the patterns of equal and different columns over all ordered pairs of rows.

    The bits of a pattern are set where the rows agree, the first column's the highest. Rows are counted by their
    distinct combinations and those by each subset of columns: pairs that agree on a subset are the sum of squared
    counts, and exact patterns follow by inclusion and exclusion; so no pair of rows or combinations is ever formed.
    n_cv leaves out pairs of a row with itself.
    """
    d = len(columns)
    combos = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("c"))
    parts = None
    for bits in product((0, 1), repeat=d):
        keep = [c for c, b in zip(columns, bits, strict=True) if b]
        one = combos.groupBy(*keep).agg(F.sum("c").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("m"))
        one = one.select(F.lit(int("".join(map(str, bits)), 2)).alias("pattern"), "m")
        parts = one if parts is None else parts.unionByName(one)
    subsets = parts.agg(F.map_from_entries(F.collect_list(F.struct("pattern", "m"))).alias("m"))  # 2^d numbers
    rows = []
    for p in range(1 << d):
        terms = [F.col("m")[q] * (-1) ** (bin(q).count("1") - bin(p).count("1")) for q in range(1 << d) if q & p == p]
        rows.append(F.struct(F.lit(p).alias("pattern"), reduce(lambda a, b: a + b, terms).alias("n")))
    full, n = (1 << d) - 1, df.agg(F.count(F.lit(1)).alias("rows"))
    out = subsets.select(F.explode(F.array(*rows)).alias("v")).select("v.*").join(F.broadcast(n))
    return out.select("pattern", "n", F.when(F.col("pattern") == full, F.col("n") - F.col("rows")).otherwise(F.col("n")).alias("n_cv"))


def cross_validation(h: Sequence[float], categories: Sequence[int], n: int, delta: np.ndarray, delta_cv: np.ndarray) -> float:
    """The least-squares score of bandwidths, from the pattern counts."""
    c = np.asarray(categories, float)
    score_conv = score_kern = 0.0
    for p in range(1 << len(c)):
        same = np.array([(p >> (len(c) - 1 - i)) & 1 for i in range(len(c))], bool)
        score_conv += delta[p] * np.prod(aitchison_aitken_convolution(np.asarray(h), same, c))
        score_kern += delta_cv[p] * np.prod(aitchison_aitken(np.asarray(h), same, c))
    return score_conv / n**2 - 2 * score_kern / (n * (n - 1))


def unordered_bandwidths(df: DataFrame, columns: Sequence[str], seed: int = 0, rounds: int = 200, tolerance: float = 1e-10) -> list[float]:
    """Bandwidths of categories that minimise the cross-validation score, by differential evolution on the driver."""
    counts = df.agg(F.count(F.lit(1)), *[F.count_distinct(c) for c in columns]).first()
    n, categories = counts[0], np.maximum(2, np.array(counts[1:]))
    table = {r["pattern"]: (r["n"], r["n_cv"]) for r in delta_frequencies(df, columns).collect()}
    delta, cv = (np.array([table[p][k] for p in range(1 << len(columns))], float) for k in (0, 1))
    top, rng = (categories - 1) / categories, np.random.default_rng(seed)
    score = lambda h: cross_validation(h, categories, n, delta, cv)
    some = rng.random((15 * len(columns), len(columns))) * top
    values = np.array([score(h) for h in some])
    for _ in range(rounds):
        for i in range(len(some)):
            a, b, c = some[rng.choice(len(some), 3, replace=False)]
            new = np.where(rng.random(len(top)) < 0.7, np.clip(a + 0.7 * (b - c), 0, top), some[i])
            if (v := score(new)) < values[i]:
                some[i], values[i] = new, v
        if values.std() <= tolerance * max(abs(values.mean()), 1e-300):
            break
    return some[values.argmin()].tolist()


def resample(
    df: DataFrame, size: int, order: Sequence[str], continuous: dict[str, float], unordered: dict[str, tuple[float, Sequence]], ordered: dict[str, tuple[float, Sequence[int]]], seed: int = 0
) -> DataFrame:
    """Rows drawn with replacement and moved by each column's kernel: normal numbers of the bandwidth, another category
    with the bandwidth's probability, an ordered one by its weights. Missing stays missing. ``source_row`` and ``draw`` come along."""
    out, k = bootstrap(df, size, order, seed), seed + 100
    for c, h in continuous.items():
        out, k = out.withColumn(c, F.col(c) + normal("draw", k) * h), k + 10
    for c, (h, values) in unordered.items():
        rest = F.array_remove(F.array(*[F.lit(v) for v in values]), F.col(c))
        other = F.try_element_at(rest, (F.floor(unit("draw", k + 1) * F.size(rest)) + 1).cast("int"))
        out, k = out.withColumn(c, F.when(F.col(c).isNotNull(), F.when(unit("draw", k) < h, F.coalesce(other, F.col(c))).otherwise(F.col(c)))), k + 10
    for c, (h, values) in ordered.items():
        pick = F.lit(None).cast(dict(df.dtypes)[c])
        for v in values:
            pick = F.when(F.col(c) == v, choice("draw", k, list(values), wang_ryzin(h, v, values).tolist()).cast(dict(df.dtypes)[c])).otherwise(pick)
        out, k = out.withColumn(c, pick), k + 10
    return out


# --- evaluation ---


def two_sample_chi2(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """chi2 and dof of two tables of counts (keys, count), scaled by their totals: sum of (k1 o - k2 e)^2 / (o + e).

    Keys in neither don't count; with equal totals dof is one less than the keys.
    """
    both = a.select(*keys, F.col("count").alias("o")).join(b.select(*keys, F.col("count").alias("e")), list(keys), "full")
    both = both.select(F.coalesce("o", F.lit(0)).cast("double").alias("o"), F.coalesce("e", F.lit(0)).cast("double").alias("e")).where("o + e > 0")
    s = both.agg(F.sum("o").alias("so"), F.sum("e").alias("se"))
    k1, k2 = F.sqrt(F.try_divide(F.col("se"), F.col("so"))), F.sqrt(F.try_divide(F.col("so"), F.col("se")))
    terms = both.join(F.broadcast(s)).select(((k1 * F.col("o") - k2 * F.col("e")) ** 2 / (F.col("o") + F.col("e"))).alias("t"), "so", "se")
    return terms.agg(F.sum("t").alias("chi2"), (F.count(F.lit(1)) - F.when(F.max("so") == F.max("se"), 1).otherwise(0)).cast("long").alias("dof"))


def chi2_p_value(chi2: float, dof: int) -> float:
    return chi2_survival(chi2, dof)


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The largest distance of two cumulative distributions, by running sums over the distinct values of both."""
    one = a.select(F.col(column).alias("x"), F.lit(1).alias("na"), F.lit(0).alias("nb")).unionByName(b.select(F.col(column).alias("x"), F.lit(0).alias("na"), F.lit(1).alias("nb"))).where("x is not null")
    per = one.groupBy("x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    total = per.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb")).first()
    diff = F.col("na") / F.lit(float(total["ta"] or 1)) - F.col("nb") / F.lit(float(total["tb"] or 1))
    d = running_sum(per, ["x"], diff, "d").agg(F.max(F.abs("d")).alias("d"))
    return d.select("d", F.lit(total["ta"]).cast("long").alias("n_a"), F.lit(total["tb"]).cast("long").alias("n_b"))


def ks_p_value(d: float, n_a: int, n_b: int) -> float:
    """By the asymptotic series."""
    from math import exp, sqrt

    en = sqrt(n_a * n_b / (n_a + n_b))
    x = (en + 0.12 + 0.11 / en) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0


def cosine_distances(pairs: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Each row's cosine distance of two vectors of columns scaled by their largest values; rows with different missing columns are left out."""
    both = [*left, *right]
    top = pairs.agg(*[F.max(F.abs(c)).alias(f"_m{i}") for i, c in enumerate(both)])
    rows = pairs.join(F.broadcast(top))
    v = [F.col(c) / F.when(F.col(f"_m{i}") == 0, 1).otherwise(F.col(f"_m{i}")) for i, c in enumerate(both)]
    a, b = v[: len(left)], v[len(left) :]
    same = reduce(lambda x, y: x & y, [x.isNull() == y.isNull() for x, y in zip(a, b, strict=True)])
    dot, na, nb = (reduce(lambda x, y: x + y, [F.coalesce(x * y, F.lit(0.0)) for x, y in zip(p, q, strict=True)]) for p, q in ((a, b), (a, a), (b, b)))
    return rows.where(same).select((1 - F.try_divide(dot, F.sqrt(na * nb))).alias("distance")).where("distance is not null")


def describe(df: DataFrame, column: str) -> DataFrame:
    q = F.percentile(column, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    return df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q.alias("_q"), F.max(column).alias("max"), F.sum(column).alias("sum")).select(
        "count", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max", "sum"
    )


def binned_counts(df: DataFrame, columns: Sequence[str], edges: dict[str, Sequence[float]]) -> DataFrame:
    """Counts over the bins between given edges (the last closed), values outside left out; columns without edges as they are."""
    out, keys = df, []
    for c in columns:
        if c in edges:
            e = list(edges[c])
            out = out.where((F.col(c) >= e[0]) & (F.col(c) <= e[-1]))
            k = F.least(F.size(F.filter(F.array(*[F.lit(float(x)) for x in e]), _at_most(c))) - 1, F.lit(len(e) - 2))
        else:
            k = F.col(c)
        keys.append(k.alias(c))
    return out.select(*keys).groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def _at_most(c: str):
    return lambda e: e <= F.col(c)


def evaluate(original: DataFrame, sample: DataFrame, columns: Sequence[str], edges: dict[str, Sequence[float]]) -> list[dict]:
    """chi2 over all columns, of each column and each pair, and the KS distance of each column with edges, with p-values."""
    found = []
    for keys in [list(columns)] * (len(columns) > 2) + [[c] for c in columns] + [list(p) for p in combinations(columns, 2)]:  # (y, x) has the table of (x, y)
        r = two_sample_chi2(binned_counts(original, keys, edges), binned_counts(sample, keys, edges), keys).first()
        found.append({"test": "chi2", "columns": keys, "value": r["chi2"], "dof": r["dof"], "p": chi2_p_value(r["chi2"] or 0.0, r["dof"])})
    for c in columns:
        if c in edges:
            r = ks_statistic(original, sample, c).first()
            found.append({"test": "ks", "columns": [c], "value": r["d"], "dof": None, "p": ks_p_value(r["d"], r["n_a"], r["n_b"])})
    return found


def insert_missing(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """All rows of df with the other columns of values by row id; null where values has no such row."""
    return df.select(key).join(values, key, "left")


#: A frame made ready for resampling: ``frame`` has ID, codes for the categories and normal scores for the numbers.
@dataclass
class Prepared:
    frame: DataFrame
    unordered: list[str]
    ordered: list[str]
    continuous: list[str]
    maps: dict[str, DataFrame] = field(default_factory=dict)
    tables: dict[str, tuple[list[float], list[float]]] = field(default_factory=dict)
    warnings: list[tuple[str, str, float]] = field(default_factory=list)
    axes: tuple[np.ndarray, np.ndarray] | None = None
    names: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.unordered, *self.ordered, *self.continuous]


def prepare(
    df: DataFrame,
    key: str,
    unordered: Sequence[str] = (),
    ordered: Sequence[str] = (),
    continuous: Sequence[str] = (),
    strings: Sequence[str] = (),
    maps: dict[str, DataFrame] | None = None,
    count: int = 1,
    extremes_fraction: float = 0.15,
    smoothing_fraction: float = 0.0002,
    pca: bool = False,
    anonymized: Sequence[str] = (),
    hashed_names: Sequence[str] = (),
    salt: str = "",
    correlation: str = "pearson",
    seed: int = 0,
) -> Prepared:
    """All steps before resampling: names hashed, values anonymized, texts to codes, warnings of high correlations, peaks
    smoothed, two extreme rows, each number through its own quantiles to a standard normal (its filled values; missing ones
    stay missing), and principal axes if asked for. key: the column that identifies a row; it becomes ID."""
    names = hash_names(hashed_names, salt)
    df = df.withColumnsRenamed(names)
    u, o, c, texts = ([names.get(x, x) for x in xs] for xs in (unordered, ordered, continuous, strings))
    rows = df.select(F.col(names.get(key, key)).alias("ID"), *u, *o, *c)
    for x in anonymized:
        rows = anonymize(rows, names.get(x, x), seed)
    if maps is None:
        rows, maps = to_codes(rows, texts, "ID")
    else:
        for x, m in maps.items():
            rows = rows.join(m.select(F.col("value").alias("_v"), F.col("code").alias("_c")), F.col(x) == F.col("_v"), "left").withColumn(x, F.col("_c")).drop("_v", "_c")
    if missing := [x for x in texts if x not in maps]:
        raise ValueError(f"no maps for {missing}")
    held = [rows := rows.persist()]  # each step reads the one before several times
    high = assoc.high_correlations(assoc.correlations(rows, correlation, [*u, *o, *c])).collect() if correlation else []
    for k, x in enumerate(c):
        held.append(rows := smooth_peaks(rows, x, count, "ID", smoothing_fraction, seed + k).persist())
    out = Prepared(rows, u, o, c, maps, {}, [(r["x"], r["y"], r["cor"]) for r in high], None, names)
    for x in c:
        values = append_extremes(drop_missing(rows, [x]).select(x), [x], extremes_fraction)
        table = percent_ranks(values, x).select(F.col("value").alias("_v"), inverse_normal("q").alias("_z"))
        out.tables[x] = quantile_table(values, x)
        held.append(rows := rows.join(table, F.col(x) == F.col("_v"), "left").withColumn(x, F.col("_z")).drop("_v", "_z").persist())
    if pca and c:
        out.axes = principal_axes(rows, c)
        rows = rotate(rows, c, *out.axes)
    out.frame = rows.select("ID", *out.columns).persist()  # the caller's to unpersist, as its resamples may be many
    out.frame.count()
    for one in held:
        one.unpersist()
    return out


def kernel_bandwidths(p: Prepared, seed: int = 0) -> dict[str, float]:
    """A bandwidth for each column: by cross-validation where all are unordered, else by the normal reference rule over all."""
    complete = drop_missing(p.frame, p.columns)
    if not p.ordered and not p.continuous:
        return dict(zip(p.columns, unordered_bandwidths(complete, p.columns, seed), strict=True))
    return {r["column"]: r["bandwidth"] for r in bandwidths(complete, p.columns).collect()}


def resample_prepared(p: Prepared, widths: dict[str, float], size: int | None = None, seed: int = 0, most: int = 10_000) -> DataFrame:
    """ID (of the source row), draw and all columns as they were before ``prepare``: drawn, moved by the kernels, numbers made
    standard again and back through their quantiles, codes back to texts. A category column has at most ``most`` values."""
    values = {}
    for c in [*p.unordered, *p.ordered]:
        found = [r[0] for r in p.frame.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"column {c!r} has over {most} categories")
        values[c] = found
    n = size or p.frame.count()
    out = resample(
        p.frame, n, ["ID"], {c: widths[c] for c in p.continuous}, {c: (min(widths[c], 1.0), values[c]) for c in p.unordered}, {c: (min(widths[c], 1.0), values[c]) for c in p.ordered}, seed
    )
    if p.axes is not None:
        out = rotate(out, p.continuous, *p.axes, inverse=True)
    if p.continuous:
        span = out.agg(*[f(c).alias(f"_{k}{i}") for i, c in enumerate(p.continuous) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
        out = out.join(F.broadcast(span))
        for i, c in enumerate(p.continuous):
            standard = F.coalesce(F.try_divide(F.col(c) - F.col(f"_m{i}"), F.col(f"_s{i}")), F.col(c) - F.col(f"_m{i}"))
            out = out.withColumn(c, from_normal(standard, p.tables[c]))
    for c, m in p.maps.items():
        out = out.join(m.select(F.col("code").alias("_c"), F.col("value").alias("_v")), F.col(c) == F.col("_c"), "left").withColumn(c, F.col("_v")).drop("_c", "_v")
    return out.select("ID", "draw", *p.columns)


def insert_back_missing(values: DataFrame, original: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """All rows of the original; its ``columns`` from values by key, and missing where the original is or values has no such row."""
    new = values.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = original.join(new, F.col(key) == F.col("_k"), "left")
    return both.select(*[F.when(F.col(c).isNotNull(), F.col(f"_n_{c}")).alias(c) if c in columns else F.col(c) for c in original.columns])


def mesh(categories: Sequence[Sequence]) -> list[tuple]:
    """All combinations of the categories of each column, in order."""
    return list(product(*categories))


def mesh_values(h: Sequence[float], categories: Sequence[int], convolution: bool = False) -> dict[int, float]:
    """The kernel product (or that of the convolved kernels) of each pattern of equal and different columns."""
    c, kernel = np.asarray(categories, float), aitchison_aitken_convolution if convolution else aitchison_aitken
    patterns = {p: np.array([(p >> (len(c) - 1 - i)) & 1 for i in range(len(c))], bool) for p in range(1 << len(c))}
    return {p: float(np.prod(kernel(np.asarray(h, float), same, c))) for p, same in patterns.items()}


def mesh_density(counts: dict[tuple, int], h: Sequence[float], categories: Sequence[Sequence]) -> dict[tuple, float]:
    """The density of each cell of the mesh: the kernels of all rows, by their distinct combinations."""
    values, n = mesh_values(h, [len(c) for c in categories]), sum(counts.values())
    pattern = lambda a, b: sum((x == y) << (len(a) - 1 - i) for i, (x, y) in enumerate(zip(a, b, strict=True)))
    return {cell: sum(k * values[pattern(cell, row)] for row, k in counts.items()) / n for cell in mesh(categories)}


def evaluation(original: DataFrame, sample: DataFrame, columns: Sequence[str], continuous: Sequence[str], key: str = "ID", bins: int = 20) -> dict:
    """The tests of ``evaluate``, the cosine distances of rows and their sources (``describe`` of them), and Pearson's matrices
    before and after."""
    edges = {c: edges_of(original, c, bins) for c in continuous}
    found = {"tests": evaluate(original, sample, [*columns, *continuous], edges)}
    if continuous:
        a = original.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in continuous])
        pairs = sample.join(a, F.col(key) == F.col("_k"))
        found["distance"] = describe(cosine_distances(pairs, continuous, [f"_o_{c}" for c in continuous]), "distance").first().asDict()
        found["before"], found["after"] = ({(r["x"], r["y"]): r["cor"] for r in assoc.pearson(d, continuous).collect()} for d in (original, sample))
    return found


def edges_of(df: DataFrame, column: str, n: int) -> list[float]:
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    return [lo + (hi - lo) * k / n for k in range(n)] + [hi]

