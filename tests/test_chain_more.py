"""Stages, files, reports and resources that the other units leave out."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomframe.functions import expr as X
from loomframe.operators import encode, hist, mimic, quality, relational, report
from loomframe.plans.chain import Break, Chain, Delete, Fork, Hello, Import, LineLoop, Print, Read, Rename, Runner, Settings, Split, Stage, Store, WordCount, Write, main
from loomframe.sources import io


def test_resources():
    assert io.fixture("words.txt").read_text().startswith("warp")
    assert io.template("page.tex").exists() and io.config("defaults.json").exists() and io.tutorial("words.py").exists()
    with pytest.raises(FileNotFoundError):
        io.fixture("nothing")
    with pytest.raises(ValueError):
        io.resource("words.txt", "notebook of others")


def test_tutorial_by_command_line(spark, tmp_path, capsys):
    ds = main([str(io.tutorial("words.py")), "--store", "all", "--results", f"{tmp_path}/r", "-c", "other=1", "-P"])
    assert {r.word: r.n for r in ds["words"].collect()} == {"warp": 3, "weft": 1, "loom": 1, "shuttle": 1}
    again = main([str(io.tutorial("words.py")), "-b", "count", "--results", f"{tmp_path}/r"])
    assert again["words"].count() == 4 and "words" in capsys.readouterr().out
    with pytest.raises(ValueError):
        main([str(io.tutorial("words.py")), "-s", "nothing"])


def test_forked_files(spark, tmp_path):
    for k in range(5):
        io.write(spark.range(k + 1).toDF("x").coalesce(1), f"{tmp_path}/in{k}.parquet")
    slices = io.Slices(size=2)
    slices.configure([f"{tmp_path}/in{k}.parquet" for k in range(5)], lock=True)
    with pytest.raises(RuntimeError):
        slices.configure(["other"])
    assert slices.workers == 3 and slices.of(2) == [f"{tmp_path}/in4.parquet"]

    class Counted(Stage):
        def execute(self, ds):
            ds["n"] = ds["df"].agg(F.count(F.lit(1)).alias("n"), F.lit(ds["fork"]).alias("fork"))

    ds = Store()
    Chain("fork", [Fork(spark, slices, "df", [Counted(), Write("n", "n.csv", results=f"{tmp_path}/out")], "n", "all")]).run(ds)
    assert sorted(tuple(r) for r in ds["all"].collect()) == [(3, 0), (5, 2), (7, 1)]
    assert io.read(spark, f"{tmp_path}/out/n_f2.csv").first().n == 5


def test_small_stages(spark, tmp_path, capsys):
    ds = Store()
    ds["a"] = spark.createDataFrame([(" x y ",), ("",), ("z x",)], "value string")
    Chain("c", [
        WordCount("a", "words"), LineLoop("a", "lines", [F.trim, F.upper]), Rename({"words": "w"}, move=True), Split("a", "split", ["value"], counts=[2], classes=2),
        Rename({"w": "w"}, into="both"), Hello("there", 2), Print(["w"]), Delete(["a"]), Break(), Delete(["w"]),
    ]).run(ds)
    assert {r.word: r.n for r in ds["w"].collect()} == {"x": 2, "y": 1, "z": 1}
    assert sorted(r.value for r in ds["lines"].collect()) == ["X Y", "Z X"]
    assert ds["split"].where("randomclass = 0").count() == 2 and "a" not in ds and "words" not in ds and set(ds["both"]) == {"w"}
    assert capsys.readouterr().out.count("Hello there") == 2
    ds.pop("both")
    ds.save(f"{tmp_path}/s")
    other = Store()
    Chain("i", [Import(spark, f"{tmp_path}/s")]).run(other)
    assert other["n_w"] == 3
    other.drop(keep_only=["w"])
    assert [k for k in other if not k.startswith("n_")] == ["w"]
    assert Runner(settings=Settings()).run() == {}


def test_typed_files(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime.date(2020, 1, 2), None, True), (2, None, "t", False)], "x int, d date, s string, b boolean")
    for kind in ("npz", "feather"):
        at = io.write(df.coalesce(1), f"{tmp_path}/t.{kind}", store_index=True)
        back = io.read(spark, at)
        assert back.schema == df.schema and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect())), kind
        assert io.read(spark, at, restore_index=True).columns[0] == "__index__"
    with pytest.raises(io.UnhandledFileType):
        io.READERS["numpy"](spark, "a.txt")
    with pytest.raises(io.AmbiguousFileType):
        io.READERS["numpy"](spark, "a")
    assert io.write(df, "x.csv", counter=3, fork=1, results=f"{tmp_path}/r").endswith("r/x_p3_f1.csv")


def test_read_stage_and_chunks(spark, tmp_path):
    at = io.write(spark.range(10).toDF("x").repartition(3), f"{tmp_path}/c.parquet")
    ds = Store()
    Chain("one", [Read(spark, at, "df")]).run(ds)
    assert ds["n_df"] == 10
    parts = [sorted(r.x for r in d.collect()) for d in io.read_chunks(spark, at, 4)]
    assert [len(p) for p in parts] == [4, 4, 2] and sorted(sum(parts, [])) == list(range(10))
    rows = spark.createDataFrame([(f, k) for f in "ab" for k in range(5)], "f string, k int")
    assert {(r.f, r.k): r.chunk for r in io.with_chunks(rows, 2, ["k"], "f").collect()} == {(f, k): k // 2 for f in "ab" for k in range(5)}


def test_functions(spark):
    df = spark.createDataFrame([(4.0, "12"), (9.0, "x")], "a double, s string")
    X.register("half", lambda c: c / 2)
    out, aside = relational.Functions().add("half", "h", "a").add(lambda s: s + 1, "up", "a", returns="double").add("square", "sq", "a", store="side").run(df)
    assert [(r.h, r.up) for r in out.orderBy("a").collect()] == [(2.0, 5.0), (4.5, 10.0)] and aside["side"].columns == ["sq"] and "sq" not in out.columns
    for wrong in (("nothing", "o", "a"), ("half", "", "a"), ("half", "o", 3)):
        with pytest.raises(TypeError):
            relational.Functions().add(*wrong)
    with pytest.raises(TypeError):
        relational.apply(df, lambda c: 3, "o", "a")
    with pytest.raises(TypeError):
        X.register("not a name", lambda c: c)
    assert X.parse_time("1970-01-02") == 86_400 * 10**9 and X.parse_period("2d") == 2 * 86_400 * 10**9
    with pytest.raises(ValueError):
        X.parse_time("soon")


def test_merge_checks(spark):
    a, b = spark.createDataFrame([(1, 2), (1, 3)], "k int, x int"), spark.createDataFrame([(1, 5)], "j int, y int")
    assert relational.merge(a, b, [], left_on="k", right_on="j", validate="m:1").columns == ["k", "x", "j", "y"]
    with pytest.raises(ValueError):
        relational.merge(a, b, [], left_on="k", right_on="j", validate="1:1")
    with pytest.raises(ValueError):
        relational.merge(a, b, ["k"], left_on="k", right_on="j")
    assert relational.concat([None, None], ignore_missing=True).count() == 0
    with pytest.raises(ValueError):
        encode.one_hot(a, ["x"], most=1)


def test_histogram_keys():
    h = hist.Histogram({1.5: 3, "a": 5, "b": 1})
    assert h.consistent().counts == {"a": 5, "b": 1} and h.consistent(float).counts == {1.5: 3}
    h.variable = "v"
    with pytest.raises(AttributeError):
        h.variable = "w"
    with pytest.raises(AttributeError):
        h.kind = "numeric"
    assert h.copy().variable == "v" and h.n_dim == 1 and h.n_bins == 3


def test_running_sum_over_parts(spark):
    rows = spark.createDataFrame([(None if k % 11 == 0 else k % 17, k, 1) for k in range(300)], "a int, b int, v int")
    got = [(r.a, r.b, r.s) for r in relational.running_sum(rows, ["a", "b"], F.col("v"), "s").collect()]
    order = sorted(got, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [x[2] for x in order] == list(range(1, 301))
    assert relational.numbered_rows(rows.limit(0), ["a"]).count() == 0


def test_repair_goldens(spark):
    """Columns of several types each, as texts: what they become by their majority, by fills and by choice."""
    none = None
    rows = list(zip(["True", "False", none, "nan", ""], ["foo", "bar", "3", none, "nan"], ["1.0", "2.0", "bal", none, ""], ["1", "2", "3", none, "nan"], ["1", "2", "bla", "nan", none], ["1", "2.5", "bar", none, "nan"], ["a", "b", "c", "d", none], ["a", "b", "1", "2", "3"], range(5), strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in "ABCDEFGH") + ", i int")
    column = lambda d, c: [r[c] for r in d.orderBy("i").collect()]
    one = quality.repair(df)[0]
    assert column(one, "A") == [1, 0, none, none, none] and column(one, "B") == ["foo", "bar", "3", none, none]
    assert column(one, "C") == [1.0, 2.0, none, none, none] and column(one, "D") == [1, 2, 3, none, none]
    assert column(one, "E") == [1, 2, none, none, none] and column(one, "F") == ["1", "2.5", "bar", none, none]
    assert column(one, "G") == ["a", "b", "c", "d", none] and column(one, "H") == [none, none, 1, 2, 3]
    two = quality.repair(df, quality.Repair(types={"B": "int"}, inconsistent={"E": -1}, bool_to_int={"A": False}, skip=["C"], missing=["bla"]))[0]
    assert column(two, "B") == [none, none, 3, none, none] and column(two, "C") == ["1.0", "2.0", "bal", none, ""] and column(two, "A")[:2] == [True, False] and column(two, "E") == [1, 2, none, none, none]
    three = quality.repair(df, quality.Repair(fill_missing=True, fill={"G": "GREPME"}))[0]
    assert column(three, "B") == ["foo", "bar", "3", "not_a_str", "not_a_str"] and column(three, "E") == [1, 2, -999, -999, -999]
    assert column(three, "F") == ["1", "2.5", "bar", "not_a_str", "not_a_str"] and column(three, "G") == ["a", "b", "c", "d", "GREPME"] and column(three, "H") == [-999, -999, 1, 2, 3]
    four = quality.repair(df.select("i", F.concat(F.lit("'"), "G", F.lit("'")).alias("G"), "E"), quality.Repair(literals=True, inconsistent={"E": 7}, fill_by_type={"str": "?"}, fill_missing=True, nan_values={"i": [4]}))[0]
    assert column(four, "G")[1:] == ["a", "b", "c", "d"] and column(four, "E")[0] is not None
    assert [quality.interpret(x) for x in ("3", "2.5", "[1, 'a']", "True", "word", None)] == [3, 2.5, [1, "a"], True, "word", None]


def test_mesh():
    assert mimic.mesh([["a", "b"], [0, 1, 2]])[:2] == [("a", 0), ("a", 1)]
    values = mimic.mesh_values([0.2, 0.3], [2, 3])
    assert sum(v * {0: 2, 1: 1, 2: 2, 3: 1}[p] for p, v in values.items()) == pytest.approx(1)
    assert mimic.mesh_values([0.0, 0.0], [2, 3], convolution=True)[3] == pytest.approx(1)
    density = mimic.mesh_density({("a", 0): 3, ("b", 2): 1}, [0.1, 0.1], [["a", "b"], [0, 1, 2]])
    assert sum(density.values()) == pytest.approx(1) and max(density, key=density.get) == ("a", 0)


def test_more_reports(spark, tmp_path):
    df = spark.createDataFrame([(float(k), float(k * k % 7), f"c{k % 3}") for k in range(90)], "x double, y double, k string")
    page = report.boxplots(df, "x", ["k"], least=5)[0]
    assert page["label"] == "x by k" and len(page["groups"]) == 3 and page["limit"] == pytest.approx(85.0) and all("|" in v for v in page["stats"].values())
    assert report.histogram_pages([hist.Histogram({1: 3, 2: 5}, {"bin_width": 2}, "v")])[0]["stats"]["mode"] == 5.0
    corr = report.correlation_pages(df, ["pearson", "kendall"])
    assert corr[0]["stats"]["different values of x"] == 90 and "x" in corr[0]["text"]
    with pytest.raises(ValueError):
        report.correlation_pages(df, ["mutual_information"])
    assert len(report.pair_pages(df, ["x", "y"])) == 3
    own = tmp_path / "own.tex"
    own.write_text("[$label]")
    assert "[pearson]" in report.as_latex(corr, page=str(own))
