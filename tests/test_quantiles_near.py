"""Quantiles without groups: narrowed to the values around each probability, with the same result as from all rows."""

import numpy as np
import pytest

from loomframe import registry
from loomframe.operators import profile

P = (0.0, 0.01, 0.05, 0.16, 0.25, 0.5, 0.84, 0.95, 0.99, 1.0)


def _midpoints(x, w):
    """Every row with its own midpoint; flat between the rows of a value."""
    order = np.lexsort((w, x))
    x, w = x[order], w[order]
    return np.interp(P, (np.cumsum(w) - w / 2) / w.sum(), x)


_RNG = np.random.default_rng(5)
CASES = {
    "apart": _RNG.permutation(4_000).astype(float) / 7,
    "few": _RNG.integers(0, 4, 4_000).astype(float),
    "hot": np.concatenate([np.zeros(2_000), _RNG.normal(size=2_000), [1e300, -1e300], np.full(500, 3.0)]),
    "wide": np.exp(_RNG.normal(size=4_000) * 40),
}


@pytest.fixture
def small_steps(monkeypatch):
    monkeypatch.setattr(profile, "SAMPLED", 300)
    monkeypatch.setattr(profile, "LEFT", 200)


@pytest.mark.parametrize("case, weighted", [("apart", False), ("few", False), ("hot", False), ("hot", True), ("wide", True)])
def test_same_as_all_rows(spark, small_steps, case, weighted):
    x = CASES[case]
    w = np.random.default_rng(6).integers(1, 5, len(x)).astype(float) if weighted else np.ones(len(x))
    df = spark.createDataFrame(list(zip(x.tolist(), w.tolist(), strict=True)), "x double, w double")
    got = [r["quantile"] for r in profile.quantiles(df, "x", P, "w" if weighted else None).orderBy("p").collect()]
    assert got == pytest.approx(_midpoints(x, w).tolist(), rel=1e-9, abs=1e-12)


def test_nothing_and_nan(spark, small_steps):
    empty = spark.createDataFrame([(None,)], "x double")
    assert [r["quantile"] for r in profile.quantiles(empty, "x", (0.1, 0.5)).collect()] == [None, None]
    x = [float(i) for i in range(1000)] + [float("nan")] * 1000
    got = {r["p"]: r["quantile"] for r in profile.quantiles(spark.createDataFrame([(v,) for v in x], "x double"), "x", (0.25, 0.9)).collect()}
    assert got[0.25] == 499.5 and got[0.9] != got[0.9]


def test_few_rows_are_left_to_sort(spark, small_steps):
    rows = spark.range(20_000).selectExpr("cast(id * 7919 % 50021 as double) as x", "1.0d as w")
    cumulated, total = profile._cumulated(rows, profile.PROBABILITIES)
    assert total == 20_000 and cumulated.count() <= 200 + 2 * len(profile.PROBABILITIES)


def test_profile_has_one_shuffle_of_values(spark, sf_dir, monkeypatch):
    """Values are sorted once for a column, also for the range of its histogram, and not written as text to count them."""
    calls, sides = [], profile._sides
    monkeypatch.setattr(profile, "_sides", lambda *a: calls.append(a[1]) or sides(*a))
    registry.QUERIES["profile_full"](spark, sf_dir)
    assert len(calls) == 2
    plan = profile.distinct_counts(registry.t(spark, sf_dir, "lineitem"), ["l_extendedprice"])._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan


def test_distinct_of_all_types(spark):
    df = spark.sql(
        "select * from values (1, 1L, 0.0d, float(1.5), 1.50, date'2024-03-31', timestamp_ntz'2024-03-31 02:30:00', timestamp'2024-10-27 00:30:00Z', 'a', true), "
        "(2, 1L, -0.0d, float(1.5), 2.50, date'2024-03-31', timestamp_ntz'2024-03-31 03:30:00', timestamp'2024-10-27 01:30:00Z', 'A', false), "
        "(null, 3L, 0.1d, null, 2.5, null, null, null, null, true) as t(i, l, d, f, n, day, local, ts, s, b)"
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = {r["i"]: r["distinct"] for r in profile.distinct_counts(df, df.columns).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [got[i] for i in range(len(df.columns))] == [2, 2, 2, 1, 2, 1, 2, 2, 2, 2]


def test_statistics_of_a_time_as_its_histogram(spark, sf_dir):
    """The mode by the quantiles that are known is that of the histogram that finds its own."""
    df = registry.t(spark, sf_dir, "events")
    best = profile.auto_histogram(df, "ts").orderBy("count", ascending=False).first()
    row = profile.statistics(df, ["ts"]).first()
    own = profile.auto_histogram(df, "ts").where(f"count = {best['count']}").orderBy("bin").first()
    assert row["mode"] == (own["low"] + own["high"]) / 2 / 1000
