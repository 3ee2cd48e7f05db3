"""All queries over the standard tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import expr as X
from loomframe.operators import assoc, encode, hist, mimic, profile, quality, relational
from loomframe.operators.hist import ValueCounts, fill
from loomframe.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, n: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# --- sources ---


@query("select r_regionkey, r_name from region union all select r_regionkey, r_name from region union all select r_regionkey, r_name from region")
def scan_multi_file(spark, sf):
    return io.read(spark, [f"{sf}/region.parquet"] * 3)


@query("select chunk, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from (select o_orderkey, cast(floor((row_number() over (order by o_orderkey) - 1) / 4000) as bigint) as chunk from orders) group by 1")
def chunk_ids(spark, sf):
    rows = io.with_chunks(t(spark, sf, "orders").select("o_orderkey"), 4000, ["o_orderkey"])
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("long").alias("keys"))


_PASSES = "(select 9 * k as lo from range((select (count(*) + 8) // 9 from nation)) r(k))"


@query(f"select cast(row_number() over (order by f, lo) - 1 as bigint) as pass, least(9, (select count(*) from nation) - lo) as n from {_PASSES}, (select unnest([0, 1]) as f)")
def chunk_read(spark, sf):
    chunks = io.read_chunks(spark, [f"{sf}/nation.parquet"] * 2, 9)
    return relational.concat([c.select(F.lit(k).cast("long").alias("pass")) for k, c in enumerate(chunks)]).groupBy("pass").agg(F.count(F.lit(1)).alias("n"))


@query("select c_mktsegment, count(*) as n from customer group by 1")
def sql_source(spark, sf):
    t(spark, sf, "customer").createOrReplaceTempView("_customer")
    return io.read(spark, "select c_mktsegment, count(*) as n from _customer group by 1", "sql")


# --- filter, project, apply ---


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_discount > 0.05 and l_quantity < l_extendedprice and l_quantity > 40")
def filter_query_chain(spark, sf):
    return relational.select(t(spark, sf, "lineitem"), ["l_discount > 0.05", "l_quantity < l_extendedprice and l_quantity > 40"], ["l_orderkey", "l_linenumber", "l_quantity"])


@query("select l_orderkey, l_returnflag from lineitem where l_returnflag in ('A', 'R') and l_shipdate is not null and not (l_quantity <= 45) and l_tax between 0.02 and 0.04")
def filter_project(spark, sf):
    return relational.select(t(spark, sf, "lineitem"), ["l_returnflag in ['A', 'R']", F.col("l_shipdate").isNotNull(), "not (l_quantity <= 45)", "0.02 <= l_tax <= 0.04"], ["l_orderkey", "l_returnflag"])


@query("select o_orderkey, case when o_orderkey % 3 = 0 then null else o_orderstatus end as s from orders where case when o_orderkey % 3 = 0 then null else o_orderstatus end is distinct from 'F'")
def filter_missing_neq(spark, sf):
    rows = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("s"))
    return relational.select(rows, ["s != 'F'"])


@query("select 'fails' as q, cast(0 as bigint) as n, 'o_orderkey,o_totalprice' as columns union all select 'holds', count(*), 'o_orderkey,o_totalprice' from orders where o_totalprice > 100000")
def filter_failure_policy(spark, sf):
    found = {q: relational.select(t(spark, sf, "orders"), [x], ["o_orderkey", "o_totalprice"], continue_if_failure=True) for q, x in (("fails", "no_such_column > 1"), ("holds", "o_totalprice > 100000"))}
    return relational.concat([d.agg(F.lit(q).alias("q"), F.count(F.lit(1)).alias("n"), F.lit(",".join(d.columns)).alias("columns")) for q, d in found.items()])


@query("select l_orderkey, l_linenumber, l_quantity * l_quantity as sq, round(sqrt(abs(l_discount - 0.05)), 6) as root, l_quantity + 1 as inc, l_extendedprice * 1.60934::double as km from lineitem")
def apply_scalar(spark, sf):
    df = t(spark, sf, "lineitem").withColumn("d", F.col("l_discount") - 0.05)
    for func, on, out in (("square", "l_quantity", "sq"), ("sqrt_abs", "d", "root"), ("increment", "l_quantity", "inc"), ("miles_to_km", "l_extendedprice", "km")):
        df = relational.apply(df, func, out, on)
    return df.select("l_orderkey", "l_linenumber", "sq", r("root", 6).alias("root"), "inc", "km")


@query("select o_orderkey, true as same, strftime(cast('1976-01-01' as date) + cast(o_orderkey % 365 as integer), '%Y-%m-%d') as day from orders")
def apply_dates(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd 00:00:00").alias("text"), "o_orderdate", (F.col("o_orderkey") % 365 + 1).alias("nth"))
    df = relational.apply(relational.apply(df, "text_to_date", "date", "text"), "day_of_year_to_date", "day", "nth")
    return df.select("o_orderkey", (F.col("date") == F.col("o_orderdate").cast("date")).alias("same"), F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("select 'frame' as part, count(*) as n, round(sum(o_totalprice + 1), 2) as total from orders union all select 'aside', count(*), round(sum(o_totalprice * o_totalprice), 2) from orders")
def apply_side_result(spark, sf):
    todo = relational.Functions().add("increment", "up", "o_totalprice").add("square", "sq", "o_totalprice", store="squares")
    df, aside = todo.run(t(spark, sf, "orders"))
    one = lambda d, c, part: d.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.sum(c), 2).alias("total"))
    return one(df, "up", "frame").unionByName(one(aside["squares"], "sq", "aside"))


@query("select o_orderkey, o_totalprice * 2 + o_custkey as v from orders")
def apply_row(spark, sf):
    df = relational.apply_rows(t(spark, sf, "orders"), lambda p: p.o_totalprice * 2 + p.o_custkey, "v", ["o_totalprice", "o_custkey"])
    return df.select("o_orderkey", "v")


@query("select o_orderkey, o_totalprice / 1000 as v from orders")
def apply_arrow(spark, sf):
    import numpy as np

    df = relational.apply(t(spark, sf, "orders"), lambda s: np.asarray(s.to_numpy()) / 1000, "v", "o_totalprice", returns="double")
    return df.select("o_orderkey", "v")


@query("select c_custkey, round(c_acctbal - (select avg(c_acctbal) from customer), 4) as off from customer")
def apply_entire(spark, sf):
    def off(df):
        return df.join(F.broadcast(df.agg(F.avg("c_acctbal").alias("_m")))).withColumn("off", F.col("c_acctbal") - F.col("_m"))

    return relational.apply(t(spark, sf, "customer"), off, entire=True).select("c_custkey", r("off").alias("off"))


@query("select n_nationkey, n_name, 'x' as tag, cast(7 as integer) as k from nation")
def add_const_column(spark, sf):
    return relational.add_constants(t(spark, sf, "nation"), {"tag": "x", "k": 7}).select("n_nationkey", "n_name", "tag", "k")


@query("select o_orderstatus, count(*) as n, round(max(o_totalprice), 2) as top from orders group by 1")
def grouped_apply_frame(spark, sf):
    import pandas as pd

    def one(p):
        return pd.DataFrame({"o_orderstatus": [p.o_orderstatus.iloc[0]], "n": [len(p)], "top": [round(p.o_totalprice.max(), 2)]})

    return relational.grouped_apply(t(spark, sf, "orders").select("o_orderstatus", "o_totalprice"), ["o_orderstatus"], one, "o_orderstatus string, n long, top double")


@query("select o_orderkey, max(o_totalprice) over (partition by o_custkey) as m from orders")
def grouped_apply_broadcast(spark, sf):
    return relational.grouped_column(t(spark, sf, "orders"), ["o_custkey"], F.max("o_totalprice"), "m").select("o_orderkey", "m")


# --- joins and sets ---


def _merge(how):
    def run(spark, sf):
        a = t(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
        b = t(spark, sf, "orders").select((F.col("o_custkey") + 7).alias("key"), "o_orderkey")  # moved, so that both sides have keys of their own
        return relational.merge(a, b, ["key"], how)

    run.__name__ = f"merge_{how}"
    return run


for _how in ("inner", "left", "right", "outer"):
    query(
        f"select coalesce(a.key, b.key) as key, c_name, o_orderkey from (select c_custkey as key, c_name from customer) a {'full' if _how == 'outer' else _how} join "
        "(select o_custkey + 7 as key, o_orderkey from orders) b on a.key = b.key"
    )(_merge(_how))


@query("select c_custkey, c_name, o_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey")
def merge_left_on(spark, sf):
    a, b = t(spark, sf, "customer").select("c_custkey", "c_name"), t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return relational.merge(a, b, [], "left", left_on=["c_custkey"], right_on=["o_custkey"], validate="1:m")


@query("select a.n_nationkey as n_nationkey, a.n_name as n_name_x, a.n_regionkey as n_regionkey_x, upper(b.n_name) as n_name_y, b.n_regionkey as n_regionkey_y from nation a join nation b using (n_nationkey)")
def merge_dup_cols_suffix(spark, sf):
    n = t(spark, sf, "nation")
    return relational.merge(n, n.withColumn("n_name", F.upper("n_name")), ["n_nationkey"], drop_duplicate_columns=False).select("n_nationkey", "n_name_x", "n_regionkey_x", "n_name_y", "n_regionkey_y")


@query("select n_nationkey, n_name, n_regionkey from nation")
def merge_column_subset(spark, sf):
    n = t(spark, sf, "nation")
    return relational.merge(n, n.withColumn("n_name", F.lit("right")), ["n_nationkey"], columns1=["n_nationkey", "n_name"], columns2=["n_nationkey", "n_name", "n_regionkey"])


@query("with a as (select case when n_nationkey < 5 then null else n_nationkey end as k, n_nationkey as x from nation), b as (select case when n_nationkey < 3 then null else n_nationkey end as k, n_nationkey as y from nation) select a.k as k, x, y from a join b on a.k is not distinct from b.k")
def merge_null_keys(spark, sf):
    n = t(spark, sf, "nation")
    a = n.select(F.when(F.col("n_nationkey") >= 5, F.col("n_nationkey")).alias("k"), F.col("n_nationkey").alias("x"))
    b = n.select(F.when(F.col("n_nationkey") >= 3, F.col("n_nationkey")).alias("k"), F.col("n_nationkey").alias("y"))
    return relational.merge(a, b, ["k"])


@query("select coalesce(a.k, b.k) as k, case when b.k is null then 'left_only' when a.k is null then 'right_only' else 'both' end as _merge from (select n_nationkey as k from nation) a full join (select n_nationkey + 9 as k from nation) b on a.k = b.k")
def merge_indicator(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    return relational.merge(n, n.select((F.col("k") + 9).alias("k")), ["k"], "outer", indicator=True)


@query("select n_regionkey, n_name, cast(null as varchar) as r_name from nation union all select r_regionkey, null, r_name from region")
def concat_by_name(spark, sf):
    return relational.concat([t(spark, sf, "nation").select("n_regionkey", "n_name"), t(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), None], ignore_missing=True)


@query("select n_regionkey from nation union all select r_regionkey from region")
def concat_inner_cols(spark, sf):
    return relational.concat([t(spark, sf, "nation"), t(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")], join="inner")


@query("select n.n_name, s.s_name from (select n_name, row_number() over (order by n_name) as i from nation) n full join (select s_name, row_number() over (order by s_name) as i from supplier) s on n.i = s.i")
def concat_side_by_side(spark, sf):
    return relational.concat_columns([t(spark, sf, "nation").select("n_name"), t(spark, sf, "supplier").select("s_name")], ["n_name", "s_name"])


@query("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def distinct_rows(spark, sf):
    return relational.distinct(t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


_SIZES = "(select 0 as part, cast(floor(n * 0.3) as bigint) as rows from n union all select 1, cast(floor(n * 0.5) as bigint) from n union all select 2, n - cast(floor(n * 0.3) as bigint) - cast(floor(n * 0.5) as bigint) from n)"


@query(f"with n as (select count(*) as n from customer) select part, rows, (select n from n) as keys, (select cast(sum(c_custkey) as bigint) from customer) as total from {_SIZES}")
def split_exact_sizes(spark, sf):
    """The sizes, and of all parts together how many different keys there are and their sum: parts share no row and lose none."""
    df = t(spark, sf, "customer").select("c_custkey")
    parts = relational.random_split(df, ["c_custkey"], relational.split_sizes(df.count(), [0.3, 0.5], classes=3), seed=7)
    rows = relational.concat([p.select(F.lit(i).alias("part"), "c_custkey") for i, p in enumerate(parts)])
    every = rows.agg(F.count_distinct("c_custkey").alias("keys"), F.sum("c_custkey").cast("long").alias("total"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(every))


@query("with c as (select count(*) as n, cast(sum(c_custkey) as bigint) as total from customer) select 0 as randomclass, n - 60 as rows, n as keys, total from c union all select 1, 60, n, total from c")
def split_class_column(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey")
    rows = relational.random_class(df, ["c_custkey"], relational.split_sizes(df.count(), counts=[40, 60]), seed=7)
    every = rows.agg(F.count_distinct("c_custkey").alias("keys"), F.sum("c_custkey").cast("long").alias("total"))
    return rows.groupBy("randomclass").agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(every))


@query("select e as execution, cast(50 as bigint) as rows, e > 0 as moved from (select unnest([0, 1, 2]) as e)")
def split_seeds(spark, sf):
    """Three executions of one splitter: each has a seed of its own, so other rows are in the class."""
    df, split = t(spark, sf, "customer").select("c_custkey"), relational.Splitter(["c_custkey"], counts=[50], classes=2, seed=3)
    parts = [split(df).where("randomclass = 0").select(F.lit(e).alias("execution"), "c_custkey") for e in range(3)]
    rows, first = relational.concat(parts), parts[0].select(F.col("c_custkey").alias("k"), F.lit(1).alias("same"))
    return rows.join(first, F.col("c_custkey") == F.col("k"), "left").groupBy("execution").agg(F.count(F.lit(1)).alias("rows"), (F.count("same") < F.count(F.lit(1))).alias("moved"))


@query("select o_orderpriority, count(*) as n from orders group by 1 order by n desc, 1 limit 3")
def topk_categories(spark, sf):
    return relational.top(t(spark, sf, "orders"), "o_orderpriority", 3)


@query("select o_custkey, o_orderkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) >= 12)")
def drop_small_groups(spark, sf):
    return relational.drop_small_groups(t(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 12)


@query("select cast(200 as bigint) as draws, cast(200 as bigint) as ids, true as repeats, cast(200 as bigint) as right from (select 1)")
def bootstrap_rows(spark, sf):
    """Draws, different draw numbers, whether rows come twice, and how many draws are the row whose number they carry."""
    df = t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = relational.bootstrap(df, 200, ["c_custkey"], 3).join(relational.numbered_rows(df.select(F.col("c_custkey").alias("k")), ["k"], "n"), F.col("n") == F.col("source_row"))
    right = F.count(F.when(F.col("k") == F.col("c_custkey"), 1))
    return out.agg(F.count(F.lit(1)).alias("draws"), F.count_distinct("draw").alias("ids"), (F.count_distinct("c_custkey") < 200).alias("repeats"), right.alias("right"))


# --- encoding ---

_CODES = "(select o_orderpriority as v, row_number() over (order by min(o_orderkey)) - 1 as c from orders group by 1)"


@query(f"select o_orderkey, c as o_orderpriority from orders join {_CODES} on v = o_orderpriority")
def factorize(spark, sf):
    return encode.factorize(t(spark, sf, "orders"), ["o_orderprio*"], "o_orderkey")[0].select("o_orderkey", "o_orderpriority")


@query("select o_orderkey, o_orderpriority, o_orderstatus from orders")
def defactorize(spark, sf):
    coded, maps = encode.factorize(t(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", in_place=True)
    return encode.defactorize(coded, maps).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query(f"select v as value, c as code from {_CODES}")
def factorize_map(spark, sf):
    return encode.factorize(t(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey")[1]["o_orderpriority"]


@query("select o_orderkey, o_orderstatus = 'F' as \"o_orderstatus_F\", o_orderstatus = 'O' as \"o_orderstatus_O\", o_orderstatus = 'P' as \"o_orderstatus_P\" from orders")
def onehot(spark, sf):
    return encode.one_hot(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], {"o_orderstatus": ["F", "O", "P"]}).drop("o_orderstatus")


@query("select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' else 'other' end as s from orders")
def map_values(spark, sf):
    return encode.map_values(t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s")), "s", {"F": "final", "O": "open"}, "other")


# --- histograms ---


def _quantity(spark, sf) -> ValueCounts:
    return fill(relational.select(t(spark, sf, "lineitem"), ["l_discount > 0.02"]), "l_quantity", {"l_quantity": {"bin_width": 5}})


_Q = "(select cast(floor(l_quantity / 5) as bigint) as l_quantity, count(*) as count from lineitem where l_discount > 0.02 group by 1)"


@query(f"select * from {_Q}")
def hist_numeric(spark, sf):
    return _quantity(spark, sf).frame


@query("select event_type, count(*) as count from events where event_type is not null group by 1")
def hist_category(spark, sf):
    return fill(t(spark, sf, "events"), "event_type").frame


@query("select o_orderstatus = 'F' as done, count(*) as count from orders group by 1")
def hist_boolean(spark, sf):
    counts = fill(t(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("done")), "done").frame
    return counts.select((F.col("done") == "True").alias("done"), "count")


@query("select cast(floor((epoch_us(ts) - 1262563200000000) / 2592000000000.0) as bigint) as ts, count(*) as count from events where ts is not null group by 1")
def hist_timestamp_30d(spark, sf):
    return fill(t(spark, sf, "events"), "ts").frame


@query("select cast(floor(l_quantity / 10) as bigint) as l_quantity, l_returnflag, cast(floor(l_discount / 0.025) as bigint) as l_discount, count(*) as count from lineitem group by 1, 2, 3")
def hist_2d(spark, sf):
    return fill(t(spark, sf, "lineitem"), "l_quantity:l_returnflag:l_discount", {"l_quantity": {"bin_width": 10}, "l_discount": {"bin_width": 0.025}}).frame


@query("select cast(greatest(least(case when l_quantity >= 40 then 3 when l_quantity >= 20 then 2 when l_quantity >= 10 then 1 else 0 end, 2), 0) as bigint) as l_quantity, count(*) as count from lineitem group by 1")
def hist_bin_edges(spark, sf):
    return fill(t(spark, sf, "lineitem"), "l_quantity", {"l_quantity": {"bin_edges": [5.0, 10.0, 20.0, 40.0]}}).frame


@query("select event_type, count(*) as count from events where event_type is not null and event_type not in (select event_type from events group by 1 order by count(*) desc, 1 limit 1) group by 1")
def hist_drop_keys(spark, sf):
    e = t(spark, sf, "events")
    first = relational.top(e, "event_type", 1).first()[0]
    return fill(e, "event_type", drop={"event_type": [first]}).frame


@query("select cast(floor(l_quantity / 10) as bigint) as l_quantity, count(*) as count, round(sum(l_extendedprice), 2) as total from lineitem group by 1")
def hist_quantity_sum(spark, sf):
    out = hist.fill_sums(t(spark, sf, "lineitem"), "l_quantity", F.col("l_extendedprice"), {"l_quantity": {"bin_width": 10}})
    return out.withColumn("total", r("total", 2))


@query(
    "select 'l_linestatus' as variable, cast(null as bigint) as bin, l_linestatus as category, count(*) as count from lineitem group by 3 union all "
    "select 'l_quantity', cast(floor(l_quantity) as bigint), null, count(*) from lineitem group by 2 union all "
    "select 'l_returnflag', null, l_returnflag, count(*) from lineitem group by 3"
)
def hist_fused(spark, sf):
    return hist.fill_all(t(spark, sf, "lineitem"), ["l_quantity", "l_returnflag", "l_linestatus"])


_FLAGS = "(select l_returnflag, l_linestatus, cast(floor(l_quantity / 10) as bigint) as q, count(*) as c from lineitem group by 1, 2, 3)"


def _flags(spark, sf) -> ValueCounts:
    return fill(t(spark, sf, "lineitem").withColumnRenamed("l_quantity", "q"), "l_returnflag:l_linestatus:q", {"q": {"bin_width": 10}})


@query(f"select l_returnflag, cast(sum(c) as bigint) as count from {_FLAGS} group by 1")
def counts_marginal(spark, sf):
    return _flags(spark, sf).project("l_returnflag").frame


@query(f"select l_linestatus, cast(sum(c) as bigint) as count from {_FLAGS} where l_returnflag in ('A', 'N') and q = 2 group by 1")
def counts_select(spark, sf):
    return _flags(spark, sf).project("l_linestatus", {"l_returnflag": ["A", "N"], "q": [2]}).frame


_HOLES = "(select event_type as e, cast(floor(value) as bigint) as v, count(*) as c from events group by 1, 2)"


def _holes(spark, sf) -> ValueCounts:
    rows = X.nan_to_null(t(spark, sf, "events")).select(F.col("event_type").alias("e"), F.floor("value").cast("long").alias("v"))
    return ValueCounts(rows.groupBy("e", "v").agg(F.count(F.lit(1)).alias("count")), ["e", "v"])


_FULL = "e is not null and v is not null"


@query(f"select cast(count(*) as bigint) as num_bins, count(*) filter (where {_FULL}) as num_nonone_bins, cast(sum(c) as bigint) as sum_counts, cast(sum(c) filter (where {_FULL}) as bigint) as sum_nonone_counts from {_HOLES}")
def counts_totals(spark, sf):
    got = _holes(spark, sf).totals()
    return spark.createDataFrame([tuple(got[k] for k in sorted(got))], ", ".join(f"{k} long" for k in sorted(got)))


@query(f"select e, v, c as count from {_HOLES} where {_FULL}")
def counts_without_missing(spark, sf):
    return _holes(spark, sf).without_missing()


@query("select true as lt, true as le, true as eq, true as ge, false as gt")
def counts_compared(spark, sf):
    """Counts compare by their number of keys: two are more than one and equal to two."""
    two, one = _holes(spark, sf), _holes(spark, sf).project("e")
    return spark.createDataFrame([(one < two, one <= two, two == _flags(spark, sf).project("l_returnflag:l_linestatus"), two >= one, one > two)], "lt boolean, le boolean, eq boolean, ge boolean, gt boolean")


@query("select cast(floor(l_quantity / 20) as bigint) as l_quantity, cast(floor(l_discount) as bigint) as l_discount, count(*) as count from lineitem group by 1, 2")
def hist_joint_spec(spark, sf):
    """The bins of a pair of variables count before those of each; a missing one of the pair gives way to the variable's own."""
    return fill(t(spark, sf, "lineitem"), "l_quantity:l_discount", {"l_quantity:l_discount": [{"bin_width": 20}, None], "l_quantity": {"bin_width": 3}, "l_discount": {"bin_width": 1}}).frame


@query("select event_id, coalesce(epoch_us(ts) * 1000, 0) as ns from events")
def time_to_nanos(spark, sf):
    return t(spark, sf, "events").select("event_id", X.to_nanos(F.col("ts")).alias("ns"))


@query("select kind, count(*) as n from (select case when regexp_full_match(v, '[0-9]+') then 'int' when try_cast(v as double) is not null then 'float' when v in ('True', 'False') then 'bool' else 'str' end as kind from (select case event_id % 4 when 0 then event_id::varchar when 1 then event_id || '.5' when 2 then 'True' else event_type end as v from events) where v is not null) group by 1")
def type_filters(spark, sf):
    i = F.col("event_id")
    v = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, F.concat(i.cast("string"), F.lit(".5"))).when(i % 4 == 2, "True").otherwise(F.col("event_type"))
    rows = t(spark, sf, "events").select(v.alias("v"))
    return relational.concat([rows.select(X.only(F.col("v"), k).alias("x")).where("x is not null").agg(F.lit(k).alias("kind"), F.count("x").alias("n")) for k in ("int", "float", "bool", "str")]).where("n > 0")


@query("select 'float' as kind, cast(9 as bigint) as kept union all select 'str', cast(6 as bigint)")
def hist_consistent_keys(spark, sf):
    h = hist.Histogram({1.0: 5, 2.0: 4, "x": 6})
    return spark.createDataFrame([("float", sum(h.consistent().entries())), ("str", sum(h.consistent(str).entries()))], "kind string, kept long")


@query(f"select distinct l_returnflag, l_linestatus from {_FLAGS}")
def counts_values(spark, sf):
    return _flags(spark, sf).values("l_returnflag:l_linestatus")


@query(f"select l_quantity, count, round(count / (sum(count) over ()), 8) as fraction from {_Q}")
def hist_normalized(spark, sf):
    return hist.normalized(_quantity(spark, sf)).withColumn("fraction", r("fraction", 8))


@query(f"select cast(k as bigint) as l_quantity, coalesce(count, 0) as count from range(-3, 15) x(k) left join {_Q} on l_quantity = k")
def hist_zero_filled(spark, sf):
    return hist.zero_filled(_quantity(spark, sf), -3, 14)


@query(f"select cast(sum(count * 5) as bigint) as surface from {_Q}")
def hist_surface(spark, sf):
    return hist.surface(_quantity(spark, sf), X.Bins(width=5)).select(F.col("surface").cast("long").alias("surface"))


@query(f"select l_quantity, cast(sum(count) as bigint) as count from (select * from {_Q} union all select * from {_Q}) group by 1")
def hist_combined(spark, sf):
    return hist.combined([_quantity(spark, sf), _quantity(spark, sf)]).frame


@query(f"select l_quantity, count, cast(sum(count) over (order by l_quantity) as bigint) as upto from {_Q}")
def hist_cdf(spark, sf):
    return hist.cumulative(_quantity(spark, sf))


@query(f"select l_quantity, l_quantity * 5::double as low, l_quantity * 5::double + 5 as high, l_quantity * 5::double + 2.5 as center from {_Q}")
def hist_bin_centers(spark, sf):
    b, k = X.Bins(width=5.0, offset=0.0), F.col("l_quantity")
    return _quantity(spark, sf).frame.select(k, b.left(k).alias("low"), b.right(k).alias("high"), b.center(k).alias("center"))


@query(f"select count(*) as bins, true as inside, true as near from {_Q}")
def simulate_from_hist(spark, sf):
    """20,000 draws: only of filled bins, and each bin's share is within a hundredth of its share of the counts."""
    counts = _quantity(spark, sf)
    h = hist.Histogram.of(counts, X.Bins(width=5))
    drawn = h.simulate(spark, 20_000, 5).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    both = hist.normalized(counts).join(drawn, F.col("l_quantity") == F.col("bin"), "full")
    return both.agg(F.count("l_quantity").alias("bins"), (F.count(F.when(F.col("l_quantity").isNull(), 1)) == 0).alias("inside"), (F.max(F.abs(F.coalesce("n", F.lit(0)) / 20_000 - F.col("fraction"))) < 0.01).alias("near"))


# --- periods ---


@query("select cast(floor((epoch_us(ts) - 3600000000) / 43200000000.0) as bigint) as p, count(*) as n from events where ts is not null group by 1")
def period_uniform(spark, sf):
    return t(spark, sf, "events").where("ts is not null").groupBy(X.uniform_period(F.col("ts"), "12h", "1h").alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("select (year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 as m, cast(floor(((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1) / 3) as bigint) as q, year(o_orderdate) - 1970 as y, count(*) as n from orders group by 1, 2, 3")
def period_month_ordinal(spark, sf):
    d = F.col("o_orderdate")
    return t(spark, sf, "orders").groupBy(X.calendar_period(d, "M").alias("m"), X.calendar_period(d, "Q").alias("q"), X.calendar_period(d, "A").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as week, strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as n from orders group by 1, 2, 3")
def period_start(spark, sf):
    d = F.col("o_orderdate")
    keys = [X.period_start(X.calendar_period(d, f), f).alias(n) for f, n in (("M", "month"), ("W", "week"), ("D", "day"))]
    return t(spark, sf, "orders").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) filter (where epoch_us(ts) * 1000 >= 1577836800000000000) as n, 5400000000000 as period from events")
def period_parsed(spark, sf):
    at, period = X.parse_time("2020-01-01"), X.parse_period("1h30min")
    return t(spark, sf, "events").where("ts is not null").agg(F.count(F.when(X.to_nanos(F.col("ts")) >= at, 1)).alias("n"), F.lit(period).cast("long").alias("period"))


# --- profiles ---


def _stats(c: str, x: str | None, table: str) -> str:
    number = f"round(avg({x}), 4) as mean, round(stddev_pop({x}), 4) as std, round(min({x}), 4) as min, round(max({x}), 4) as max" if x else "cast(null as double) as mean, cast(null as double) as std, cast(null as double) as min, cast(null as double) as max"
    return f"select '{c}' as \"column\", count(*) as count, count({c}) as filled, count(distinct {c}) as \"distinct\", count(*) - count({c}) as nan, {number} from {table}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r(c) for c in ("mean", "std", "min", "max")})


@query(" union all ".join(_stats(c, f"cast({c} as double)", "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")))
def profile_numeric(spark, sf):
    return _rounded(profile.profile(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]))


@query(" union all ".join(_stats(c, None, "events") for c in ("event_type", "props")))
def profile_category(spark, sf):
    return _rounded(profile.profile(t(spark, sf, "events"), ["event_type", "props"]))


@query(_stats("ts", "(epoch_us(ts) / 86400000000.0)", "events"))
def profile_timestamp(spark, sf):
    return _rounded(profile.profile(t(spark, sf, "events"), ["ts"]))


_W = "sum(l_quantity * l_extendedprice) / sum(l_quantity)"


@query(
    f"with m as (select {_W} as m from lineitem) select 'l_extendedprice' as \"column\", cast(sum(l_quantity) as bigint) as count, cast(sum(l_quantity) as bigint) as filled, count(distinct l_extendedprice) as \"distinct\", "
    "cast(0 as bigint) as nan, round(max(m), 2) as mean, round(sqrt(sum(l_quantity * (l_extendedprice - m) * (l_extendedprice - m)) / sum(l_quantity)), 2) as std, min(l_extendedprice) as min, max(l_extendedprice) as max from lineitem, m"
)
def profile_weighted(spark, sf):
    return profile.profile(t(spark, sf, "lineitem"), ["l_extendedprice"], "l_quantity").withColumns({"mean": r("mean", 2), "std": r("std", 2)})


@query("select sum(case l_returnflag when 'A' then 2 when 'R' then 0.5 else 0 end)::double as by_dict, (sum(l_linenumber) / 2.0)::double as by_list from lineitem")
def profile_weights_given(spark, sf):
    """Weights as a dict of values (others weigh nothing) and as a list by row."""
    df = t(spark, sf, "lineitem")
    by_value, name = profile.weighted(df, "l_returnflag", {"A": 2, "R": 0.5})
    one = by_value.agg(F.sum(name).alias("by_dict"))
    few = df.groupBy("l_linenumber").agg(F.count(F.lit(1)).cast("double").alias("n"))
    half = [k / 2 for (k,) in few.orderBy("l_linenumber").select("l_linenumber").collect()]
    by_row, name = profile.weighted(few, "l_linenumber", half, ["l_linenumber"])
    return one.join(by_row.agg(F.sum(F.col(name) * F.col("n")).alias("by_list")))


_HAZEN = (
    "select {g}p, round(case when min_lo >= p then min_x when max_hi <= p then max_x else quantile_x end, 4) as quantile from ("
    "select {g}p, min(pn) as min_lo, max(pn) as max_hi, min(x) as min_x, max(x) as max_x, "
    "max(case when pn <= p then x end) + (min(case when pn >= p then x end) - max(case when pn <= p then x end)) * coalesce((p - max(case when pn <= p then pn end)) / nullif(min(case when pn >= p then pn end) - max(case when pn <= p then pn end), 0), 0) as quantile_x "
    "from (select {g}x, (row_number() over ({part} order by x) - 0.5) / count(*) over ({part}) as pn from ({rows})), (select unnest([0.05, 0.5, 0.95])::double as p) group by {g}p)"
)


@query(_HAZEN.format(g="", part="", rows="select l_extendedprice as x from lineitem where l_extendedprice is not null"))
def quantiles_hazen(spark, sf):
    return profile.quantiles(t(spark, sf, "lineitem"), "l_extendedprice", (0.05, 0.5, 0.95)).withColumn("quantile", r("quantile"))


@query(_HAZEN.format(g="l_returnflag, ", part="partition by l_returnflag", rows="select l_returnflag, l_quantity as x from lineitem where l_quantity is not null and l_returnflag is not null"))
def quantiles_by_group(spark, sf):
    return profile.quantiles(t(spark, sf, "lineitem"), "l_quantity", (0.05, 0.5, 0.95), by=["l_returnflag"]).withColumn("quantile", r("quantile"))


_P = (0.01, 0.05, 0.16, 0.5, 0.84, 0.95, 0.99)
_GROUPED = _HAZEN.format(g="c_mktsegment, ", part="partition by c_mktsegment", rows="select c_mktsegment, c_acctbal as x from customer where c_mktsegment is not null and c_acctbal is not null").replace("[0.05, 0.5, 0.95]", str(list(_P)))


@query(
    f"with q as ({_GROUPED}), w as (select c_mktsegment, " + ", ".join(f"max(case when p = {p} then quantile end) as p{round(p * 100):02d}" for p in _P) + " from q group by 1) "
    "select c.c_mktsegment, count(*) as count, count(distinct c_acctbal) as \"distinct\", round(avg(c_acctbal), 4) as mean, round(stddev_pop(c_acctbal), 4) as std, min(c_acctbal) as min, max(c_acctbal) as max, "
    + ", ".join(f"max(p{round(p * 100):02d}) as p{round(p * 100):02d}" for p in _P) + " from customer c join w on w.c_mktsegment = c.c_mktsegment group by 1"
)
def group_stats(spark, sf):
    out = profile.group_profile(t(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])
    return out.select("c_mktsegment", "count", "distinct", r("mean").alias("mean"), r("std").alias("std"), "min", "max", *[r(f"p{round(p * 100):02d}").alias(f"p{round(p * 100):02d}") for p in _P])


_ALL = {c: _HAZEN.format(g="", part="", rows=f"select {x} as x from {tb} where {c} is not null").replace("[0.05, 0.5, 0.95]", str(list(_P))) for c, x, tb in (("l_extendedprice", "l_extendedprice", "lineitem"), ("ts", "epoch_us(ts)::double", "events"))}


def _wide(c: str) -> str:
    return ", ".join(f"(select quantile from ({_ALL[c]}) where p = {p}) as p{round(p * 100):02d}" for p in _P)


@query(
    f"select 'l_extendedprice' as \"column\", count(*)::double as count, count(distinct l_extendedprice)::double as \"distinct\", round(avg(l_extendedprice), 3) as mean, round(stddev_pop(l_extendedprice), 3) as std, min(l_extendedprice)::double as min, max(l_extendedprice)::double as max, {_wide('l_extendedprice')}, cast(null as varchar) as top from lineitem union all "
    f"select 'ts', count(*)::double, count(distinct ts)::double, null, round(stddev_pop(epoch_us(ts) / 86400000000.0), 3), min(epoch_us(ts))::double, max(epoch_us(ts))::double, {_wide('ts')}, null from events union all "
    "select 'event_type', count(*)::double, count(distinct event_type)::double, null, null, null, null, " + ", ".join("null" for _ in _P) + ", (select event_type from events where event_type is not null group by 1 order by count(*) desc, 1 limit 1) from events"
)
def profile_full(spark, sf):
    """All statistics of a number, a time (microseconds; std in days) and a category in one call; the mean of a time is left out here, as its sums differ in the last digits."""
    a = profile.statistics(t(spark, sf, "lineitem"), ["l_extendedprice"])
    b = profile.statistics(t(spark, sf, "events"), ["ts", "event_type"])
    kept = F.when(F.col("kind") == "category", F.col("top")).alias("top")
    mean = F.when(F.col("kind") == "numeric", F.round("mean", 3)).alias("mean")
    return a.unionByName(b).select("column", "count", "distinct", mean, F.round("std", 3).alias("std"), "min", "max", *[r(f"p{round(p * 100):02d}").alias(f"p{round(p * 100):02d}") for p in _P], kept)


@query("select to_timestamp(min(epoch_us(ts)) / 1000000)::timestamp as low, to_timestamp(max(epoch_us(ts)) / 1000000)::timestamp as high from events")
def profile_times(spark, sf):
    times = profile.statistics(t(spark, sf, "events"), ["ts"])
    return times.select(F.col("times")["min"].cast("timestamp_ntz").alias("low"), F.col("times")["max"].cast("timestamp_ntz").alias("high"))


@query("select event_type as mode, n as count from (select event_type, count(*) as n from events where event_type is not null group by 1) order by n desc, event_type limit 1")
def mode_of_text(spark, sf):
    return profile.mode(fill(t(spark, sf, "events"), "event_type").frame, "event_type")


@query("select 'l_linenumber' as \"column\", true as is_num, true as is_int, false as is_ts union all select 'l_tax', true, false, false union all select 'l_shipdate', true, false, true union all select 'l_returnflag', false, false, false")
def column_properties(spark, sf):
    df = t(spark, sf, "lineitem")
    rows = [(c, *[profile.properties(df, c)[k] for k in ("is_num", "is_int", "is_ts")]) for c in ("l_linenumber", "l_tax", "l_shipdate", "l_returnflag")]
    return spark.createDataFrame(rows, "column string, is_num boolean, is_int boolean, is_ts boolean")


@query(f"select l_quantity as mode, count from {_Q} order by count desc, l_quantity limit 1")
def mode_from_hist(spark, sf):
    return profile.mode(_quantity(spark, sf).frame, "l_quantity")


@query(" union all ".join(f"select '{c}' as \"column\", count(*) - count({c}) as nulls from events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))
def null_counts(spark, sf):
    return profile.null_counts(t(spark, sf, "events"))


_ENDS = _HAZEN.format(g="", part="", rows="select l_extendedprice as x from lineitem where l_extendedprice is not null").replace("[0.05, 0.5, 0.95]", "[0.05, 0.95]").replace(", 4) as quantile", ", 12) as quantile")


@query(
    f"with q as ({_ENDS}), a as (select min(quantile) as l, max(quantile) as h from q), b as (select l - 0.05 * (h - l) as l, h from a), c as (select l, h + 0.05 * (h - l) as h from b), d as (select case when l > 0 and l < 0.2 * (h - l) then 0.0 else l end as l, h from c), "
    "e as (select l, (h - l) / 30 as w from d), n as (select least(cast(floor((l_extendedprice - l) / w) as bigint), 29) as bin, count(*) as count from lineitem, e where l_extendedprice >= l and l_extendedprice <= l + w * 30 group by 1) "
    "select cast(k as bigint) as bin, round(l + k * w, 4) as low, round(l + (k + 1) * w, 4) as high, coalesce(count, 0) as count from range(30) r(k) cross join e left join n on bin = k"
)
def auto_histogram(spark, sf):
    return profile.auto_histogram(t(spark, sf, "lineitem"), "l_extendedprice").withColumns({"low": r("low"), "high": r("high")})


@query("select event_type, count(*) as n from events where event_type is not null group by 1 order by 2 desc, 1 limit 3")
def auto_histogram_top(spark, sf):
    return profile.auto_histogram(t(spark, sf, "events"), "event_type", 3)


@query("select cast(least(case when l_quantity >= 30 then 2 when l_quantity >= 20 then 1 else 0 end, 1) as bigint) as bin, count(*) as count from lineitem where l_quantity between 10 and 30 group by 1")
def auto_histogram_edges(spark, sf):
    return profile.auto_histogram(t(spark, sf, "lineitem"), "l_quantity", edges=[10.0, 20.0, 30.0]).select("bin", "count")


# --- association ---

_L = ("l_quantity", "l_extendedprice", "l_discount")


def _cor(df: DataFrame) -> DataFrame:
    return df.select("x", "y", (r("cor", 5) + 0.0).alias("cor"))


def _pairs(names, f) -> str:
    return " union all ".join(f"select '{a}' as x, '{b}' as y, round({f(a, b)}, 5) + 0.0 as cor {{tail}}" for a in names for b in names)


@query(_pairs(_L, lambda a, b: "1.0" if a == b else f"corr({a}, {b})").replace("{tail}", "from lineitem").replace("round(1.0, 5) + 0.0 as cor from lineitem", "1.0::double as cor"))
def corr_pearson(spark, sf):
    return _cor(assoc.pearson(t(spark, sf, "lineitem"), _L))


@query(
    "with k as (select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in _L) + " from lineitem) "
    + _pairs(_L, lambda a, b: "1.0" if a == b else f"corr({a}, {b})").replace("{tail}", "from k").replace("round(1.0, 5) + 0.0 as cor from k", "1.0::double as cor")
)
def corr_spearman(spark, sf):
    return _cor(assoc.spearman(t(spark, sf, "lineitem"), _L))


@query(
    "with c as (select l_linenumber::double as a, l_tax as b, count(*)::double as n from lineitem group by 1, 2), p as (select sum(x.n * y.n * sign(x.a - y.a) * sign(x.b - y.b)) / 2 as s from c x, c y), m as (select sum(n) as m from c), "
    "ta as (select sum(k * (k - 1) / 2) as t from (select sum(n) as k from c group by a)), tb as (select sum(k * (k - 1) / 2) as t from (select sum(n) as k from c group by b)), "
    "v as (select round(s / sqrt((m * (m - 1) / 2 - ta.t) * (m * (m - 1) / 2 - tb.t)), 5) + 0.0 as cor from p, m, ta, tb) "
    "select 'l_linenumber' as x, 'l_tax' as y, cor from v union all select 'l_tax', 'l_linenumber', cor from v union all select 'l_tax', 'l_tax', 1.0::double union all select 'l_linenumber', 'l_linenumber', 1.0::double"
)
def corr_kendall(spark, sf):
    return _cor(assoc.kendall(t(spark, sf, "lineitem"), ["l_linenumber", "l_tax"]))


@query(
    " union all ".join(
        f"select '{x}' as x, '{y}' as y, round(sum(n * (m - mean) * (m - mean)) / (sum(n) * max(var)), 6) as cor from (select b, count(*) as n, avg({y}) as m from (select {y}, least(greatest(ceil(({x} - lo) / ((hi - lo) / 11)) - 1, 0), 10) as b "
        f"from lineitem, (select min({x}) as lo, max({x}) as hi from lineitem)) group by b), (select avg({y}) as mean, var_samp({y}) as var from lineitem)"
        for x in _L
        for y in _L
    )
)
def corr_ratio(spark, sf):
    return assoc.correlation_ratio(t(spark, sf, "lineitem"), _L).withColumn("cor", r("cor", 6))


_TABLE = "(select l_returnflag as a, l_linestatus as b, count(*)::double as n from lineitem group by 1, 2)"


@query(
    f"with c as {_TABLE}, f as (select n, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, sum(n) over () as t, a, b from c) "
    "select round(max(t) * (sum(n * n / (na * nb)) - 1), 3) as chi2, round(sum(n / t * ln(n * t / (na * nb))), 6) as mi, (count(distinct a) - 1) * (count(distinct b) - 1) as dof from f"
)
def contingency_chi2(spark, sf):
    return assoc.table_stats(assoc.contingency(t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")).select(r("chi2", 3).alias("chi2"), r("mi", 6).alias("mi"), "dof")


def _tenth(c: str) -> str:
    return f"least(cast(floor(({c} - (select min({c}) from lineitem)) / (((select max({c}) from lineitem) - (select min({c}) from lineitem)) / 10)) as bigint), 9)"


def _information(x: str, y: str) -> str:
    return f"(select sum(n / t * ln(n * t / (na * nb))) from (select n, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, sum(n) over () as t from (select {_tenth(x)} as a, {_tenth(y)} as b, count(*)::double as n from lineitem group by 1, 2)))"


@query(" union all ".join(f"select '{x}' as x, '{y}' as y, round({_information(x, y)}, 6) as cor" for x in _L for y in _L))
def mutual_info_binned(spark, sf):
    return assoc.mutual_information(t(spark, sf, "lineitem"), _L).withColumn("cor", r("cor", 6))


@query("select true as near")
def mutual_info_neighbours(spark, sf):
    """Of a bivariate normal of correlation 0.8, whose mutual information is -ln(0.36) / 2."""
    rows = spark.range(4000).select(mimic.normal("id", 1).alias("a"), mimic.normal("id", 50).alias("b")).select("a", (0.8 * F.col("a") + 0.6 * F.col("b")).alias("b"))
    return spark.createDataFrame([(abs(assoc.neighbour_information(rows, "a", "b") - 0.5108) < 0.08,)], "near boolean")


_LOADED = "['l_quantity', 'load', 'l_returnflag']"


def _loaded(spark, sf) -> DataFrame:
    """With a column that follows the quantity but for some noise; the flag has nothing to do with either."""
    return t(spark, sf, "lineitem").withColumn("load", F.col("l_quantity") + F.col("l_discount") * 200)


@query(f"select x, y, x = y as one, (x = 'l_returnflag') = (y = 'l_returnflag') as strong from (select unnest({_LOADED}) as x), (select unnest({_LOADED}) as y)")
def corr_phik(spark, sf):
    out = assoc.phik(_loaded(spark, sf), ["l_quantity", "load", "l_returnflag"])
    return out.select("x", "y", (F.col("cor") > 0.999).alias("one"), (F.col("cor") > 0.5).alias("strong"))


@query(f"select x, y, (x = 'l_returnflag') = (y = 'l_returnflag') as dependent from (select unnest({_LOADED}) as x), (select unnest({_LOADED}) as y)")
def corr_significance(spark, sf):
    out = assoc.significance(_loaded(spark, sf), ["l_quantity", "load", "l_returnflag"])
    return out.select("x", "y", (F.col("cor") > 5).alias("dependent"))


@query("select 'load' as x, 'l_quantity' as y, round(corr(l_quantity, l_quantity + l_discount * 200), 5) as cor from lineitem")
def corr_warnings(spark, sf):
    return assoc.high_correlations(assoc.pearson(_loaded(spark, sf), ["l_quantity", "load", "l_tax"]), 0.9).withColumn("cor", r("cor", 5))


@query("with v as (select corr(l_quantity, l_extendedprice) as q, corr(l_quantity, l_discount) as d, corr(l_extendedprice, l_discount) as p from lineitem) select cast(6 as bigint) as n, round((2 * q + 2 * d + 2 * p) / 6, 5) as mean, round(greatest(q, d, p), 5) as max, round(least(q, d, p), 5) as min from v")
def corr_summary(spark, sf):
    return assoc.correlation_summary(assoc.pearson(t(spark, sf, "lineitem"), _L)).select("n", *[r(c, 5).alias(c) for c in ("mean", "max", "min")])


# --- repair ---


def _dirty(spark, sf) -> DataFrame:
    """Texts as they come: numbers, words and ways to say that a value is missing."""
    i, v = F.col("event_id"), F.col("value")
    text = F.when(i % 7 == 0, " nan ").when(i % 11 == 0, "None").when(i % 13 == 0, "").otherwise(F.floor(v).cast("long").cast("string"))
    return t(spark, sf, "events").select("event_id", text.alias("dirty value!"), F.concat(F.lit(" "), "event_type", F.lit("  ")).alias(" type "))


_D = "(select event_id, case when event_id % 7 = 0 then ' nan ' when event_id % 11 = 0 then 'None' when event_id % 13 = 0 then '' else cast(cast(floor(value) as bigint) as varchar) end as v, event_type as type from events)"
_NONE = "(v is null or lower(trim(v)) in ('', 'none', 'nan'))"


@query("select event_id, event_type as \"type\" from events")
def fix_names(spark, sf):
    return quality.fix_names(_dirty(spark, sf)).select("event_id", F.trim("type").alias("type"))


@query(f"select event_id, {_NONE} as missing from {_D}")
def fix_missing(spark, sf):
    return _dirty(spark, sf).select("event_id", X.missing_text(F.col("`dirty value!`")).alias("missing"))


@query(f"select 'dirty_value_' as \"column\", cast(count(*) filter (where {_NONE}) as bigint) as nan, cast(0 as bigint) as str, cast(count(*) filter (where not {_NONE}) as bigint) as int from {_D}")
def infer_types(spark, sf):
    return quality.type_counts(quality.fix_names(_dirty(spark, sf)), ["dirty_value_"]).select("column", "nan", "str", "int")


@query(f"select event_id, case when {_NONE} then null else cast(v as bigint) end as dirty_value_, trim(type) as type from {_D}")
def coerce_types(spark, sf):
    return quality.repair(_dirty(spark, sf))[0].select("event_id", "dirty_value_", "type")


@query(f"select event_id, case when {_NONE} then -999 else cast(v as bigint) end as dirty_value_ from {_D}")
def fill_nulls(spark, sf):
    return quality.repair(_dirty(spark, sf), quality.Repair(fill_missing=True))[0].select("event_id", "dirty_value_")


@query("select doc_id, regexp_replace(replace(trim(text), ' ', '_'), '[^A-Za-z0-9_]', '', 'g') as text from documents")
def clean_strings(spark, sf):
    return t(spark, sf, "documents").select("doc_id", quality.clean_text(F.col("text"), aggressive=True).alias("text"))


# --- mimicry ---


@query("select l_quantity, count(*) as n from lineitem group by 1 having count(*) > (select count(*) / 55 from lineitem)")
def peaks(spark, sf):
    df = t(spark, sf, "lineitem")
    return mimic.peaks(df, "l_quantity", df.count() / 55)


@query("select round(min(c_acctbal) - 0.15 * (max(c_acctbal) - min(c_acctbal)), 4) as c_acctbal from customer union all select round(max(c_acctbal) + 0.15 * (max(c_acctbal) - min(c_acctbal)), 4) from customer")
def extremes(spark, sf):
    return mimic.extremes(t(spark, sf, "customer"), ["c_acctbal"]).withColumn("c_acctbal", r("c_acctbal"))


@query("select event_id, value from events where value is not null and user_id is not null and not isnan(value)")
def drop_any_null(spark, sf):
    return mimic.drop_missing(t(spark, sf, "events"), ["value", "user_id"]).select("event_id", "value")


@query("select c_acctbal as value, round((rank() over (order by c_acctbal) - 1 + (count(*) over (partition by c_acctbal) - 1) / 2.0) / (count(*) over () - 1), 8) as q from customer where c_acctbal is not null qualify row_number() over (partition by c_acctbal) = 1")
def normal_scores_rank(spark, sf):
    return mimic.percent_ranks(t(spark, sf, "customer"), "c_acctbal").withColumn("q", r("q", 8))


@query("select c_custkey, round((rank() over (order by c_acctbal) - 1 + (count(*) over (partition by c_acctbal) - 1) / 2.0) / (count(*) over () - 1), 6) as q from customer where c_acctbal is not null")
def normal_scores(spark, sf):
    """The scores, given back as the probabilities that they stand for (but for the two ends, which are held to 1e-7)."""
    out = mimic.normal_scores(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return out.where("c_acctbal is not null").select("c_custkey", F.round(mimic.normal_cdf("c_acctbal"), 6).alias("q"))


@query(" union all ".join(f"select '{c}' as \"column\", round(1.06 * stddev_pop({c}) * pow(count(*), -1.0 / 7), 5) as bandwidth from lineitem" for c in _L))
def kde_bandwidth_rule(spark, sf):
    return mimic.bandwidths(t(spark, sf, "lineitem"), _L).withColumn("bandwidth", r("bandwidth", 5))


@query(
    "with c as (select l_returnflag as a, l_linestatus as b, l_linenumber as d, count(*) as n from lineitem group by 1, 2, 3), p as (select (x.a = y.a)::int * 4 + (x.b = y.b)::int * 2 + (x.d = y.d)::int as pattern, sum(x.n * y.n) as n from c x, c y group by 1) "
    "select cast(k as integer) as pattern, cast(coalesce(n, 0) as bigint) as n, cast(coalesce(n, 0) - case when k = 7 then (select count(*) from lineitem) else 0 end as bigint) as n_cv from range(8) r(k) left join p on pattern = k"
)
def delta_frequencies(spark, sf):
    return mimic.delta_frequencies(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


_HALF = "(select cast(floor(l_quantity / 5) as bigint) as k, count(*)::double as n from lineitem where l_orderkey % 2 = {} group by 1)"


@query(
    f"with b as (select coalesce(x.n, 0) as o, coalesce(y.n, 0) as e from {_HALF.format(0)} x full join {_HALF.format(1)} y on x.k = y.k), s as (select sum(o) as so, sum(e) as se from b) "
    "select round(sum(pow(sqrt(se / so) * o - sqrt(so / se) * e, 2) / (o + e)), 5) as chi2, cast(count(*) - (max(so) = max(se))::int as bigint) as dof from b, s"
)
def two_sample_chi2(spark, sf):
    df, spec = t(spark, sf, "lineitem"), {"l_quantity": {"bin_width": 5}}
    a, b = (fill(df.where(f"l_orderkey % 2 = {k}"), "l_quantity", spec).frame for k in (0, 1))
    return mimic.two_sample_chi2(a, b, ["l_quantity"]).withColumn("chi2", r("chi2", 5))


@query(
    "with u as (select l_extendedprice as x, (l_orderkey % 2 = 0)::int as a, (l_orderkey % 2 = 1)::int as b from lineitem), p as (select x, sum(a) as a, sum(b) as b from u group by 1), "
    "c as (select sum(a) over (order by x) / (select sum(a) from u) - sum(b) over (order by x) / (select sum(b) from u) as d from p) select round(max(abs(d)), 8) as d, (select cast(sum(a) as bigint) from u) as n_a, (select cast(sum(b) as bigint) from u) as n_b from c"
)
def ks_statistic(spark, sf):
    df = t(spark, sf, "lineitem")
    return mimic.ks_statistic(df.where("l_orderkey % 2 = 0"), df.where("l_orderkey % 2 = 1"), "l_extendedprice").withColumn("d", r("d", 8))


@query(
    "with m as (select max(abs(l_quantity)) as q, max(abs(l_extendedprice)) as e, max(abs(l_discount)) as d, max(abs(l_tax)) as x from lineitem), v as (select l_quantity / q as a, l_extendedprice / e as b, l_discount / d as c, l_tax / x as f from lineitem, m), "
    "z as (select 1 - (a * c + b * f) / nullif(sqrt((a * a + b * b) * (c * c + f * f)), 0) as distance from v) select count(distance) as count, round(avg(distance), 6) as mean, round(min(distance), 6) as min, round(max(distance), 6) as max from z"
)
def cosine_distance_summary(spark, sf):
    d = mimic.cosine_distances(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"])
    return mimic.describe(d, "distance").select("count", *[r(c, 6).alias(c) for c in ("mean", "min", "max")])


@query("select cast(1000 as bigint) as n, true as mean, true as share, true as whole")
def generate_random(spark, sf):
    df = mimic.generate(spark, {"x": {"mean": 5, "std": 2}, "k": {"choices": ["a", "b"], "probabilities": [0.3, 0.7]}, "n": {"std": 10, "type": "int"}}, 1000, 1)
    share = F.avg((F.col("k") == "a").cast("double"))
    return df.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("x") - 5) < 0.3).alias("mean"), (F.abs(share - 0.3) < 0.05).alias("share"), (F.max(F.abs(F.col("n") - F.floor("n"))) == 0).alias("whole"))


@query("select cast(1000 as bigint) as n, cast(30 as bigint) as heaped, true as missing, 'A,B' as letters, '0,1,2' as numbers")
def generate_mixed(spark, sf):
    df = mimic.mixed_variables(spark, 1000, [{"mean": 1.0}, {"std": 3.0}], [[0.2, 0.8]], [[0.5, 0.3, 0.2]], {"a": {"value": 0.5, "size": 30}}, {"b": 20})
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    gone = F.count(F.when(F.col("b").isNull(), 1))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("a") == 0.5, 1)).alias("heaped"), gone.between(10, 20).alias("missing"), listed("c").alias("letters"), listed("d").alias("numbers"))


@query("select cast(1000 as bigint) as n, true as moved, true as changed, true as known")
def kde_resample(spark, sf):
    """1,000 draws: numbers move by some 0.8, about a tenth of the flags changes, and all flags are known ones."""
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    out = mimic.resample(df.withColumns({"q": F.col("l_quantity"), "f": F.col("l_returnflag")}), 1000, ["l_orderkey", "l_linenumber"], {"l_quantity": 0.8}, {"l_returnflag": (0.1, ["A", "N", "R"])}, {"l_linenumber": (0.1, [1, 2, 3, 4, 5, 6, 7])}, 4)
    changed = F.avg((F.col("f") != F.col("l_returnflag")).cast("double"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.stddev(F.col("l_quantity") - F.col("q")).between(0.7, 0.9).alias("moved"), changed.between(0.05, 0.15).alias("changed"), (F.count(F.when(~F.col("l_returnflag").isin("A", "N", "R"), 1)) == 0).alias("known"))


@query("select n, count(*) as values, true as one, true as changed from (select p_brand, count(*) as n from part group by 1) group by 1")
def anonymize(spark, sf):
    """How many values come how often is as before; each old value has one new one and each new one one old; most change."""
    df = t(spark, sf, "part").select("p_brand", F.col("p_brand").alias("old"))
    per = mimic.anonymize(df, "p_brand", 3).groupBy("p_brand", "old").agg(F.count(F.lit(1)).alias("n"))
    every = per.agg(((F.count(F.lit(1)) == F.count_distinct("p_brand")) & (F.count(F.lit(1)) == F.count_distinct("old"))).alias("one"), (F.count(F.when(F.col("p_brand") != F.col("old"), 1)) * 2 > F.count(F.lit(1))).alias("changed"))
    return per.groupBy("n").agg(F.count(F.lit(1)).alias("values")).join(F.broadcast(every))


@query("select true as near")
def inverse_normal(spark, sf):
    """The quantile and the distribution function are each other's inverse."""
    x = spark.range(1, 100_000).select((F.col("id") / 100_000).alias("q")).select(F.abs(mimic.normal_cdf(mimic.inverse_normal("q")) - F.col("q")).alias("d"))
    return x.agg((F.max("d") < 1e-12).alias("near"))


# --- streaming ---


@query("select event_type, count(*) as count from events where event_type is not null group by 1")
def stream_histogram(spark, sf):
    from loomframe.streaming.counts import running_counts

    schema = t(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf)
    q = running_counts(stream, "event_type").writeStream.format("memory").queryName("stream_histogram").outputMode("complete").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    return spark.table("stream_histogram")

