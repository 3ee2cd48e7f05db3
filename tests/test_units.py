import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomframe.functions import expr as X
from loomframe.operators import assoc, encode, hist, mimic, profile, quality, relational, report
from loomframe.plans.chain import Accumulate, AssertIn, Apply, Chain, Collect, Read, Repeat, Runner, Settings, SkipIfEmpty, Store
from loomframe.sources import io
from loomframe.streaming import counts


def test_query_strings(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y"), (3, 5.0, None)], "a int, b double, c string")
    rows = lambda q: [r.a for r in df.filter(X.query(q)).orderBy("a").collect()]
    assert rows("a > 1") == [2, 3]
    assert rows("b != 2") == [2, 3]
    assert rows("c in ['x', 'y'] and not a == 2") == [1]
    assert rows("c not in ['x']") == [2, 3]
    assert rows("1 <= a < 3 | `b` == 5") == [1, 2, 3]
    assert rows("~(a * 2 + 1 > 4)") == [1]
    with pytest.raises(ValueError):
        X.query("a >")


def test_bins():
    b = X.Bins(width=1)
    assert [b.label_of(v) for v in (-0.5, 0, 0.99, 1)] == [-1, 0, 0, 1]
    assert X.Bins(width=1).truncated_edges(5.5, 12.5) == list(range(5, 14))
    e = X.Bins(edges=(0, 1, 3, 7))
    assert [e.label_of(v) for v in (-9, 0, 2, 3, 99)] == [0, 0, 1, 2, 2]
    for wrong in ({"width": 1, "edges": (0, 1)}, {}, {"edges": (2, 1)}, {"width": 0}):
        with pytest.raises(ValueError):
            X.Bins(**wrong)


def test_bin_columns_agree(spark):
    values = [-3.2, -1.0, 0.0, 0.5, 2.0, 6.999, 7.0, 12.0]
    for b in (X.Bins(width=0.5, offset=0.25), X.Bins(edges=(0.0, 1.0, 3.0, 7.0))):
        for closed in (False, True):
            got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(b.index(F.col("v"), right_closed=closed)).collect()]
            assert got == [b.label_of(v, closed) for v in values]


def test_histogram():
    h = hist.Histogram({1: 3, 3: 4, 5: 5, 7: 6, 0: 1, 18: 2}, {"bin_width": 1, "bin_offset": 0})
    assert h.range() == (0, 19)
    assert h.values(5.5, 12.5)[0] == [5, 0, 6, 0, 0, 0, 0, 0]
    assert hist.Histogram.from_arrays([3, 2, 4, 2, 5], [0, 1, 3, 4, 6, 7]).surface() == 3 + 4 + 4 + 4 + 5
    assert sum(h.normalized().counts.values()) == pytest.approx(1)
    assert hist.Histogram.combine([h, h]).counts[18] == 4
    with pytest.raises(ValueError):
        hist.Histogram.combine([h, hist.Histogram({1: 1}, {"bin_width": 2})])
    with pytest.raises(AttributeError):
        hist.Histogram({})


def test_value_counts(spark):
    v = hist.ValueCounts.of({(1, "a"): 2, (1, "b"): 3, (2, "a"): 5}, ["x", "y"], spark)
    assert v.count({"x": 1}) == 5 and v.count({"x": 9}) == 0
    assert {tuple(r) for r in v.project("y").frame.collect()} == {("a", 7), ("b", 3)}
    assert v.totals() == {"num_bins": 3, "num_nonone_bins": 3, "sum_counts": 10, "sum_nonone_counts": 10}
    assert v > v.project("y") and v >= 2 and not v < v
    mixed = hist.ValueCounts.of({"1": 5, "2": 4, "x": 6}, ["k"], spark)
    assert {r.k for r in mixed.consistent().frame.collect()} == {"1", "2"}


def test_quantiles_against_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, 500) / 4.0
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probabilities = (0.0, 0.01, 0.16, 0.5, 0.84, 0.99, 1.0)
    got = [r["quantile"] for r in profile.quantiles(df, "x", probabilities).orderBy("p").collect()]
    pn = (np.arange(500) + 0.5) / 500
    assert got == pytest.approx(np.interp(probabilities, pn, np.sort(x)).tolist())


def test_correlations_against_pandas(spark):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"a": rng.integers(0, 9, 300), "b": rng.normal(size=300).round(1), "c": rng.integers(0, 4, 300)})
    p["b"] += p["a"] / 4
    df = spark.createDataFrame(p)
    want = {"pearson": p.corr(), "spearman": p.rank().corr()}
    for m, w in want.items():
        for r in assoc.correlations(df, m).collect():
            assert r.cor == pytest.approx(w.loc[r.x, r.y], abs=1e-9)
    got = {(r.x, r.y): r.cor for r in assoc.correlations(df, "kendall").collect()}
    for i, j in (("a", "b"), ("a", "c")):
        x, y = p[i].to_numpy(), p[j].to_numpy()
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        assert got[i, j] == pytest.approx((sx * sy).sum() / math.sqrt((sx**2).sum() * (sy**2).sum()))
    phik = {(r.x, r.y): r.cor for r in assoc.correlations(df, "phik").collect()}
    assert phik["a", "b"] > 0.5 > phik["a", "c"]
    z = {(r.x, r.y): r.cor for r in assoc.correlations(df, "significance").collect()}
    assert z["a", "b"] > 5 > z["a", "c"]
    with pytest.raises(ValueError):
        assoc.correlations(df, "other")


def test_rho_inverse():
    p = [0.2, 0.3, 0.5]
    assert assoc.rho_from_chi2(assoc.chi2_from_rho(0.6, 1000, p, p), 1000, p, p) == pytest.approx(0.6, abs=1e-3)
    assert assoc.chi2_survival(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)


def test_repair(spark):
    df = spark.createDataFrame([("1", "True", " a b! "), ("2", "False", "nan"), ("x", "None", "c"), ("", "True", "c")], ["n um", "t.b", "s"])
    out, seen = quality.repair(df, quality.Repair(cleanup=["s"], fill_missing=True))
    assert out.columns == ["n_um", "t_b", "s"]
    assert [tuple(r) for r in out.collect()] == [(1, 1, "a_b"), (2, 0, "not_a_str"), (-999, None, "c"), (-999, 1, "c")]
    assert {r["column"]: r["nan"] for r in seen.collect()} == {"n_um": 1, "t_b": 1, "s": 1}
    assert quality.majority({"int": 2, "str": 2}) == "str"
    with pytest.raises(ValueError):
        quality.fix_name(" é ")


def test_factorize_round_trip(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None)], "i int, k string")
    coded, maps = encode.factorize(df, ["k"], "i")
    assert [r.k for r in coded.orderBy("i").collect()] == [0, 1, 0, -1]
    assert [r.k for r in encode.defactorize(coded, maps).orderBy("i").collect()] == ["b", "a", "b", None]
    assert encode.one_hot(df, ["k"]).columns == ["i", "k", "k_a", "k_b"]
    with pytest.raises(ValueError):
        encode.factorize(df, ["z*"], "i")


def test_split_sizes():
    assert relational.split_sizes(10, [0.5, 0.25], classes=3) == [5, 2, 3]
    assert relational.split_sizes(10, counts=[8, 8]) == [8, 2]
    assert relational.split_sizes(10, [1.0, 1.0]) == [5, 5]
    with pytest.raises(ValueError):
        relational.split_sizes(10)


def test_mimic_maths(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    got = {r.pattern: (r.n, r.n_cv) for r in mimic.delta_frequencies(df, ["x", "y"]).collect()}
    assert got == {0: (4, 4), 1: (0, 0), 2: (0, 0), 3: (5, 2)}
    assert mimic.wang_ryzin(0.3, 1, [0, 1, 2]).sum() == pytest.approx(1)
    assert mimic.aitchison_aitken(np.array([0.2]), np.array([True]), np.array([3])) == pytest.approx(0.8)
    h = mimic.unordered_bandwidths(spark.createDataFrame([(k % 3, k % 2) for k in range(60)], "x int, y int"), ["x", "y"], rounds=10)
    assert 0 <= h[0] <= 2 / 3 and 0 <= h[1] <= 0.5
    assert mimic.ks_p_value(0.9, 50, 50) < 0.001 < 0.9 < mimic.ks_p_value(0.01, 50, 50)
    z = [r.v for r in mimic.normal_scores(spark.createDataFrame([(float(k),) for k in range(101)], "v double"), "v").orderBy("v").collect()]
    assert z[50] == pytest.approx(0) and z[0] < -5 < 5 < z[-1]


def test_pca_round_trip(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(50, 3)), columns=list("abc")).assign(i=range(50)))
    means, axes = mimic.principal_axes(df, list("abc"))
    back = mimic.rotate(mimic.rotate(df, list("abc"), means, axes), list("abc"), means, axes, inverse=True)
    a, b = (d.orderBy("i").select(*"abc").toPandas().to_numpy() for d in (df, back))
    assert np.allclose(a, b)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(k, float(k), f"t{k}") for k in range(12)], "x long, y double, s string")
    for kind in ("csv", "parquet", "json", "orc", "feather", "npz", "npy"):
        at = io.write(df.coalesce(1), f"{tmp_path}/a.{kind}")
        assert io.read(spark, at).orderBy("x").select("x", "y", "s").collect() == df.orderBy("x").collect(), kind
        assert io.read(spark, [at] * 3).count() == 36
    assert [d.count() for d in io.read_chunks(spark, [f"{tmp_path}/a.csv"] * 2, 5)] == [5, 5, 2, 5, 5, 2]
    with pytest.raises(io.UnhandledFileType):
        io.read(spark, "a.pkl")
    with pytest.raises(io.AmbiguousFileType):
        io.read(spark, "a")
    with pytest.raises(RuntimeError):
        io.read(spark, f"{tmp_path}/none*.csv")


def test_chain_of_chunks(spark, tmp_path):
    df = spark.createDataFrame([(k,) for k in [0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1]], "x long")
    at = io.write(df.coalesce(1), f"{tmp_path}/x.csv")
    first = Chain("count", [
        Read(spark, [at] * 3, "in", chunk=5),
        SkipIfEmpty(["in"]),
        Apply(lambda d: relational.select(d, ["x > 1"]), "in", "some"),
        Collect("some", "all"),
        Accumulate("in", "counts", lambda d: hist.fill(d, "x")),
        Repeat(["in"]),
    ])
    ds = Runner([first, Chain("check", [AssertIn(["all", "counts"])])], Settings(results=f"{tmp_path}/r", store="all"), spark).run()
    assert ds["n_sum_in"] == 36 and ds["n_all"] == 24
    assert ds["counts"].count({"x": 1}) == 9
    assert Store.load(spark, f"{tmp_path}/r/check")["n_all"] == 24


def test_stream_accumulates(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k % 2,)] * (k + 1), "x int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = counts.accumulate(counts.read_files(spark, f"{tmp_path}/in", "x int"), "x", f"{tmp_path}/t", checkpoint=f"{tmp_path}/c")
    q.awaitTermination()
    assert {tuple(r) for r in counts.accumulated(spark, f"{tmp_path}/t", "x").collect()} == {(0, 4), (1, 2)}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(float(k), f"c{k % 3}", None) for k in range(60)], "x double, k string, z double")
    pages = report.summary(df)
    assert [p["label"] for p in pages] == ["missing values", "x", "k"]
    files = report.write_report(pages, str(tmp_path))
    assert "\\section*{x}" in open(files[0]).read() and "== x" in open(files[1]).read()
    assert [r.count for r in report.boxplot_stats(df, "x", "k", least=5).select("count").collect()] is not None
