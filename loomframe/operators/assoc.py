"""Association of columns: seven correlation matrices in long form (x, y, cor)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import erf, exp, log, pi, sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.expr import nan_to_null
from loomframe.operators.relational import numbered_rows, running_sum

METHODS = ("pearson", "spearman", "kendall", "correlation_ratio", "mutual_information", "phik", "significance")
RATIO_BINS, TABLE_BINS = 11, 10


def numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _both(pairs: DataFrame, names: Sequence[str], diagonal: float = 1.0) -> DataFrame:
    """The other triangle and the diagonal of (x, y, cor)."""
    spark = pairs.sparkSession
    ones = spark.createDataFrame([(c, c, diagonal) for c in names], "x string, y string, cor double")
    return pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "cor")).unionByName(ones)


def pearson(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Over the rows in which both are filled; all pairs in one pass."""
    names = list(columns) or numbers(df)
    df = nan_to_null(df)
    pairs = list(combinations(names, 2))
    if not pairs:
        return _both(df.sparkSession.createDataFrame([], "x string, y string, cor double"), names)
    both = [(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs]
    row = df.agg(*[F.corr(F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)).alias(f"c{i}") for i, (a, b) in enumerate(both)])
    parts = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("cor")) for i, (a, b) in enumerate(pairs)]
    return _both(row.select(F.explode(F.array(*parts)).alias("v")).select("v.*"), names)


def _table(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): distinct pairs of filled values with their counts."""
    return df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _ranks(counts: DataFrame) -> DataFrame:
    """(value, rank): average ranks, from a table of distinct values (value, n)."""
    upto = running_sum(counts, ["value"], F.col("n"), "upto")
    return upto.select("value", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Pearson of average ranks, over the rows in which both are filled.

    Columns without missing values are ranked once for all pairs; others for each pair, as its rows differ.
    """
    names, out = list(columns) or numbers(df), None
    df = nan_to_null(df)
    if len(names) < 2:
        return _both(df.sparkSession.createDataFrame([], "x string, y string, cor double"), names)
    missing = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names]).first()
    once = {}
    for c in names:
        if not missing[c]:
            once[c] = _ranks(df.groupBy(F.col(c).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    for x, y in combinations(names, 2):
        t = _table(df, x, y)

        def ranks(c: str, side: str) -> DataFrame:
            found = once[c] if x in once and y in once else _ranks(t.groupBy(F.col(side).alias("value")).agg(F.sum("n").alias("n")))  # noqa: B023
            return found.select(F.col("value").alias(side), F.col("rank").alias(f"r{side}"))

        r = t.join(ranks(x, "a"), "a").join(ranks(y, "b"), "b")
        n, sa, sb = F.sum("n"), F.sum(F.col("n") * F.col("ra")), F.sum(F.col("n") * F.col("rb"))
        cov = F.sum(F.col("n") * F.col("ra") * F.col("rb")) - sa * sb / n
        va, vb = (F.sum(F.col("n") * F.pow(c, 2)) - s * s / n for c, s in (("ra", sa), ("rb", sb)))
        one = r.agg(F.try_divide(cov, F.sqrt(va * vb)).alias("cor")).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "cor")
        out = one if out is None else out.unionByName(one)
    return _both(out, names)


def _concordance(t: DataFrame) -> DataFrame:
    """(s,): concordant less discordant pairs of rows of a table (a, b, n).

    The values of a are numbered; two of them part at exactly one bit, the highest in which their numbers differ. So each
    row counts once for each bit: among the rows of equal higher bits, those with the bit set against those without, in
    the order of b. The sums over b run in one order of all bits and groups, dealt by ranges: no group, not even the one
    of the highest bit, is gathered in one task, and no pair is formed.
    """
    numbered = numbered_rows(t.select("a").distinct(), ["a"], "k")
    size = numbered.count()
    bits = F.array(*[F.struct(F.lit(b).alias("bit"), F.shiftright("k", b + 1).alias("group"), (F.shiftright("k", b) % 2).alias("set")) for b in range(max(1, (size - 1).bit_length()))])
    rows = t.join(numbered, "a").select("b", "n", F.explode(bits).alias("v")).select("v.*", "b", "n")
    one = rows.groupBy("bit", "group", "b").agg(F.sum(F.when(F.col("set") == 0, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("set") == 1, F.col("n")).otherwise(0)).alias("high"))
    run = running_sum(one, ["bit", "group", "b"], F.col("low"), "upto")
    groups = run.groupBy("bit", "group").agg(F.min(F.col("upto") - F.col("low")).alias("before"), F.max("upto").alias("all"))
    less, more = F.col("upto") - F.col("low") - F.col("before"), F.col("all") - F.col("upto")
    return run.where("high > 0").join(groups, ["bit", "group"]).agg(F.sum(F.col("high").cast("double") * (less - more)).alias("s"))


def kendall(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Tau-b from the table of distinct pairs; see ``_concordance``. The column of fewer values is the one that is numbered."""
    names, out = list(columns) or numbers(df), None
    df = nan_to_null(df)
    if len(names) < 2:
        return _both(df.sparkSession.createDataFrame([], "x string, y string, cor double"), names)
    distinct = df.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    for x, y in combinations(names, 2):
        a, b = (x, y) if distinct[x] <= distinct[y] else (y, x)
        t = _table(df, a, b)
        ties = lambda c: t.groupBy(c).agg(F.sum("n").alias("k")).agg(F.sum(F.col("k").cast("double") * (F.col("k") - 1) / 2).alias(f"t{c}"))  # noqa: B023, E731
        one = _concordance(t).join(F.broadcast(ties("a"))).join(F.broadcast(ties("b"))).join(F.broadcast(t.agg(F.sum("n").alias("m"))))  # one row each
        total = F.col("m").cast("double") * (F.col("m") - 1) / 2
        tau = F.try_divide(F.coalesce("s", F.lit(0.0)), F.sqrt((total - F.col("ta")) * (total - F.col("tb"))))
        one = one.select(F.lit(x).alias("x"), F.lit(y).alias("y"), tau.cast("double").alias("cor"))
        out = one if out is None else out.unionByName(one)
    return _both(out, names)


def ratio_bin(c: Column, low: Column, high: Column, n: int = RATIO_BINS) -> Column:
    """Equal, right-closed bins from low to high; the clamp takes what rounding puts beside the first and the last."""
    return F.least(F.greatest(F.ceil(F.try_divide(c - low, (high - low) / n)) - 1, F.lit(0)), F.lit(n - 1))


def correlation_ratio(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """eta squared of y by bins of x: sum of n (mean of y in the bin - mean of y)^2 over n times the sample variance. Not symmetric."""
    names, out = list(columns) or numbers(df), None
    df = nan_to_null(df).select(*[F.col(c).cast("double").alias(c) for c in names])
    span = df.agg(*[f(c).alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("var", F.var_samp))])
    rows = df.join(F.broadcast(span))
    for i, x in enumerate(names):
        b = ratio_bin(F.col(x), F.col(f"lo_{i}"), F.col(f"hi_{i}")).alias("bin")
        stats = rows.dropna(subset=names).groupBy(b).agg(F.count(F.lit(1)).alias("n"), *[F.avg(y).alias(f"m{j}") for j, y in enumerate(names)], *[F.first(f"{k}_{j}").alias(f"{k}{j}") for j in range(len(names)) for k in ("mean", "var")])
        eta = [F.try_divide(F.sum(F.col("n") * F.pow(F.col(f"m{j}") - F.col(f"mean{j}"), 2)), F.sum("n") * F.first(f"var{j}")).alias(f"e{j}") for j in range(len(names))]
        one = stats.agg(*eta).select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"e{j}").alias("cor")) for j, y in enumerate(names)])).alias("v")).select("v.*")
        out = one if out is None else out.unionByName(one)
    return out


def contingencies(df: DataFrame, pairs: Sequence[tuple[str, str]], bins: int = TABLE_BINS) -> DataFrame:
    """(pair, a, b, n): counts of pairs of variables, over the rows in which both are filled; numbers in equal-width bins, the
    last closed, others as they are. One pass and one shuffle of partial counts for all pairs; the ranges come from one before."""
    df = nan_to_null(df)
    names = list(dict.fromkeys(c for p in pairs for c in p))
    wide = [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]
    keys = {c: F.col(c).cast("string") for c in names if c not in wide}
    if wide:
        span = df.agg(*[f(F.col(c).cast("double")).alias(f"_{k}{i}") for i, c in enumerate(wide) for k, f in (("lo", F.min), ("hi", F.max))])
        df = df.join(F.broadcast(span))
    for i, c in enumerate(wide):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        keys[c] = F.when(F.col(c).isNotNull(), F.coalesce(F.least(F.floor(F.try_divide(F.col(c) - lo, (hi - lo) / bins)), F.lit(bins - 1)), F.lit(0))).cast("string")
    rows = df.select(*[keys[c].alias(f"k{i}") for i, c in enumerate(names)])
    at = {c: F.col(f"k{i}") for i, c in enumerate(names)}
    each = F.array(*[F.struct(F.lit(i).alias("pair"), at[x].alias("a"), at[y].alias("b")) for i, (x, y) in enumerate(pairs)])
    return rows.select(F.explode(each).alias("v")).select("v.*").where("a is not null and b is not null").groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, x: str, y: str, bins: int = TABLE_BINS) -> DataFrame:
    """(a, b, n): the table of two variables; see ``contingencies``."""
    return contingencies(df, [(x, y)], bins).drop("pair")


def table_stats(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """chi2, g (twice the log likelihood ratio), mutual information (nats), rows, columns, n and dof of contingency tables.

    Cells without rows count through the margins: chi2 is n times (the sum of n_ab^2 / (n_a n_b) less 1).
    """
    by = list(by)
    a = table.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    b = table.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    total = table.groupBy(*by).agg(F.sum("n").alias("t"))
    full = table.join(a, [*by, "a"]).join(b, [*by, "b"])
    full = full.join(total, by) if by else full.join(F.broadcast(total))
    n, na, nb, t = (F.col(c).cast("double") for c in ("n", "na", "nb", "t"))
    mi = F.sum(n / t * F.log(n * t / (na * nb)))
    sizes = a.groupBy(*by).agg(F.count(F.lit(1)).alias("n_a")), b.groupBy(*by).agg(F.count(F.lit(1)).alias("n_b"))
    out = full.groupBy(*by).agg((F.first(t) * (F.sum(n * n / (na * nb)) - 1)).alias("chi2"), mi.alias("mi"), F.first("t").alias("n"))
    for one in sizes:
        out = out.join(one, by) if by else out.join(F.broadcast(one))
    return out.withColumn("g", 2 * F.col("n") * F.col("mi")).withColumn("dof", (F.col("n_a") - 1) * (F.col("n_b") - 1))


def mutual_information(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Plug-in mutual information of binned variables, in nats: an approximation to nearest-neighbour estimates that needs
    no neighbours, which are a search of all rows against all."""
    names = list(columns) or numbers(df)
    return _mirrored(df.sparkSession, names, lambda pairs: table_stats(contingencies(df, pairs), ["pair"]).select("pair", F.col("mi").alias("cor")))


def neighbour_information(df: DataFrame, x: str, y: str, rows: int = 2000, k: int = 3, seed: int = 1) -> float:
    """Nearest-neighbour mutual information (Kraskov's first estimator) of two numbers, over a bounded random sample of rows.

    For comparison with the binned values; the sample is a parameter, as all neighbours of all rows are quadratic.
    """
    import numpy as np

    found = nan_to_null(df).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().orderBy(F.rand(seed)).limit(rows).collect()
    if len(found) <= k:
        return 0.0
    v = np.array([tuple(r) for r in found])
    v = (v - v.mean(axis=0)) / np.where(v.std(axis=0) > 0, v.std(axis=0), 1)
    v += 1e-10 * np.random.default_rng(seed).normal(size=v.shape)
    dx, dy = (np.abs(v[:, None, i] - v[None, :, i]) for i in (0, 1))
    for d in (dx, dy):
        np.fill_diagonal(d, np.inf)
    reach = np.partition(np.maximum(dx, dy), k - 1, axis=1)[:, k - 1]
    nx, ny = ((d < reach[:, None]).sum(axis=1) for d in (dx, dy))
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, len(v) + 1))])  # digamma(n) = harmonic(n - 1) - Euler's constant
    return max(0.0, float(harmonic[k - 1] + harmonic[len(v) - 1] - (harmonic[nx] + harmonic[ny]).mean()))


def _mirrored(spark, names: Sequence[str], values) -> DataFrame:
    """The whole matrix from a value (pair, cor) of each pair of columns i <= j."""
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i:]]
    rows = [(k, *p) for k, (x, y) in enumerate(pairs) for p in dict.fromkeys([(x, y), (y, x)])]
    both = spark.createDataFrame(rows, "pair int, x string, y string")
    return F.broadcast(both).join(values(pairs), "pair", "left").select("x", "y", F.coalesce("cor", F.lit(0.0)).alias("cor"))


def bivariate_cell(rho: float, a: Sequence[float], b: Sequence[float]) -> list[list[float]]:
    """Probabilities of a standard bivariate normal in the cells of a grid, by quadrature over the first variable."""
    cdf = NormalDist().cdf
    root = sqrt(max(1e-12, 1 - rho * rho))
    out = []
    for lo, hi in zip(a, a[1:], strict=False):
        lo, hi, steps = max(lo, -8.0), min(hi, 8.0), 64
        row = [0.0] * (len(b) - 1)
        for k in range(steps):
            x = lo + (k + 0.5) * (hi - lo) / steps
            p = exp(-x * x / 2) / sqrt(2 * pi) * (hi - lo) / steps
            c = [cdf((e - rho * x) / root) for e in b]
            for j in range(len(row)):
                row[j] += p * (c[j + 1] - c[j])
        out.append(row)
    return out


def chi2_from_rho(rho: float, n: float, pa: Sequence[float], pb: Sequence[float]) -> float:
    """The chi2 of n rows of a bivariate normal cut into cells of these marginal fractions."""

    def edges(p: Sequence[float]) -> list[float]:
        upto, out = 0.0, [-8.0]
        for x in p[:-1]:
            upto += x
            out.append(NormalDist().inv_cdf(min(max(upto, 1e-12), 1 - 1e-12)))
        return [*out, 8.0]

    cells, flat = bivariate_cell(rho, edges(pa), edges(pb)), bivariate_cell(0.0, edges(pa), edges(pb))
    return n * sum((x - y) ** 2 / max(y, 1e-300) for r, s in zip(cells, flat, strict=True) for x, y in zip(r, s, strict=True))


def rho_from_chi2(chi2: float, n: float, pa: Sequence[float], pb: Sequence[float]) -> float:
    """The inverse by bisection; 0 under the noise pedestal of (rows - 1)(columns - 1), 1 beyond the largest chi2."""
    if chi2 <= 0 or len(pa) < 2 or len(pb) < 2:
        return 0.0
    lo, hi = 0.0, 1.0 - 1e-9
    if chi2_from_rho(hi, n, pa, pb) <= chi2:
        return 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_from_rho(mid, n, pa, pb) < chi2 else (lo, mid)
    return (lo + hi) / 2


def upper_normal(z: float) -> float:
    return 0.5 * (1 - erf(z / sqrt(2)))


def chi2_survival(x: float, dof: float) -> float:
    """P(chi2 > x) by the incomplete gamma function, as a series or a continued fraction."""
    from math import lgamma

    a, x = dof / 2, x / 2
    if x <= 0 or a <= 0:
        return 1.0
    scale = exp(-x + a * log(x) - lgamma(a)) if -x + a * log(x) - lgamma(a) > -745 else 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def z_from_g(g: float, dof: float) -> float:
    """The normal deviation with the tail probability of a G statistic; far out by the asymptotic expansion."""
    if dof <= 0:
        return 0.0
    p = chi2_survival(g, dof)
    if 1e-300 < p < 1:
        return -NormalDist().inv_cdf(p) if p > 1e-16 else sqrt(max(0.0, -2 * log(p) - log(-4 * pi * log(p))))
    return 0.0 if p >= 1 else sqrt(max(0.0, g - (dof - 1) * log(max(g, 1.0))))


def phik(df: DataFrame, columns: Sequence[str] = (), most: int = 1000) -> DataFrame:
    """The correlation of the bivariate normal whose binned chi2, less its noise, is the table's.

    The margins of the tables reach the driver: ten bins of a number, and of categories at most ``most``; more are an error.
    """
    names = list(columns) or numbers(df)

    def values(pairs):
        table = contingencies(df, pairs)
        kept = table_stats(table, ["pair"]).collect()
        if any(max(r["n_a"], r["n_b"]) > most for r in kept):
            raise ValueError(f"a column has over {most} categories")
        sums = [table.groupBy("pair", F.lit(k).alias("side"), F.col(k).alias("key")).agg(F.sum("n").alias("n")) for k in ("a", "b")]
        margins: dict[tuple, list] = {}
        for r in sums[0].unionByName(sums[1]).orderBy("pair", "side", "key").collect():
            margins.setdefault((r["pair"], r["side"]), []).append(r["n"])
        rows = []
        for r in kept:
            pa, pb = ([n / r["n"] for n in margins[r["pair"], k]] for k in ("a", "b"))
            rows.append((r["pair"], float(rho_from_chi2((r["chi2"] or 0.0) - r["dof"], r["n"], pa, pb))))
        return df.sparkSession.createDataFrame(rows, "pair int, cor double")

    return _mirrored(df.sparkSession, names, values)


def significance(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Normal deviations of the hypothesis of independence, by the asymptotic G test."""

    def values(pairs):
        rows = [(r["pair"], float(z_from_g(r["g"] or 0.0, r["dof"]))) for r in table_stats(contingencies(df, pairs), ["pair"]).collect()]
        return df.sparkSession.createDataFrame(rows, "pair int, cor double")

    return _mirrored(df.sparkSession, list(columns) or numbers(df), values)


def correlations(df: DataFrame, method: str, columns: Sequence[str] = ()) -> DataFrame:
    """The matrix of a method in long form; columns without values are left out."""
    if method not in METHODS:
        raise ValueError(f"no such method: {method!r}")
    names = list(columns) or numbers(df)
    filled = df.agg(*[F.count(F.col(c)).alias(c) for c in names]).first()
    return globals()[method](df, [c for c in names if filled[c]])


def high_correlations(matrix: DataFrame, over: float = 0.95) -> DataFrame:
    return matrix.where((F.col("x") > F.col("y")) & (F.abs("cor") > over))


def correlation_summary(matrix: DataFrame) -> DataFrame:
    """Of the pairs of different columns: how many are above and below 0, mean, largest and least."""
    off = matrix.where("x <> y")
    return off.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("cor") > 0, 1)).alias("above"), F.count(F.when(F.col("cor") < 0, 1)).alias("below"), F.avg("cor").alias("mean"), F.max("cor").alias("max"), F.min("cor").alias("min"))
