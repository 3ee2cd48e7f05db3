"""Readers and writers by name or extension, several files at once, files or blocks of rows in turn, resources."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from importlib import resources as _resources
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.operators.relational import concat, numbered_rows


class AmbiguousFileType(ValueError):
    """The extension doesn't tell the file's type."""


class UnhandledFileType(ValueError):
    """No reader or writer has this type."""


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _frame(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    unsigned = {c: "object" for c, t in pdf.dtypes.items() if str(t) == "uint64"}
    out = spark.createDataFrame(pdf.astype(unsigned)) if unsigned else spark.createDataFrame(pdf)
    return out


def _typed(spark: SparkSession, pdf: pd.DataFrame, types: str | None, restore_index: bool) -> DataFrame:
    """The frame with the types that were kept, and the index as a first column if it is wanted."""
    index = [_INDEX] if restore_index and _INDEX in pdf.columns else []
    out = _frame(spark, pdf[[*index, *[c for c in pdf.columns if c != _INDEX]]])
    if not types:
        return out
    kept = T.StructType.fromJson(json.loads(types))
    return out.select(*index, *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kept])


def _numpy(spark: SparkSession, path: str, restore_index: bool = False, **_) -> DataFrame:
    """.npy: a record array; .npz: one array for each column. Types are those that the writer kept, else the arrays' own; texts
    are never unpickled. Another extension is an error: what a file without one holds can't be told."""
    import numpy as np

    kind = Path(path).suffix.lower()
    if kind not in (".npy", ".npz"):
        raise (UnhandledFileType if kind else AmbiguousFileType)(f"{path!r} is neither .npy nor .npz")
    data = np.load(_local(path), allow_pickle=False)
    names = data.dtype.names if hasattr(data, "dtype") else [x for x in data.files if x != _TYPES]
    pdf = pd.DataFrame({c: data[c] for c in names})
    for c in pdf.columns:
        if pdf[c].dtype.kind == "S":
            pdf[c] = pdf[c].str.decode("utf-8")
    for c in pdf.columns:
        if data[c].dtype.kind in "US":
            pdf[c] = pdf[c].astype(object).where(pdf[c] != "\ue000", None)
    return _typed(spark, pdf, str(data[_TYPES]) if not hasattr(data, "dtype") and _TYPES in data.files else None, restore_index)


def _feather(spark: SparkSession, path: str, restore_index: bool = False, **_) -> DataFrame:
    import pyarrow.feather

    table = pyarrow.feather.read_table(_local(path))
    kept = (table.schema.metadata or {}).get(_TYPES.encode())
    return _typed(spark, table.to_pandas(), kept.decode() if kept else None, restore_index)


def _native(kind: str, **defaults) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, path: str | Sequence[str], schema=None, restore_index: bool = False, **options) -> DataFrame:
        reader = spark.read.format(kind).options(**defaults | options)
        return (reader.schema(schema) if schema else reader).load(path if isinstance(path, str) else list(path))

    read.many = True
    return read


def _pandas(name: str) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, path: str, restore_index: bool = False, **options) -> DataFrame:
        found = getattr(pd, f"read_{name}")(_local(path), **options)
        return _frame(spark, found[0] if isinstance(found, list) else found)

    return read


def _sql(spark: SparkSession, path: str, connection: str | dict | None = None, **_) -> DataFrame:
    """A query in the session's catalog, or a table or query of a JDBC connection (its URL or options)."""
    if connection is None:
        return spark.sql(path)
    options = {"url": connection} if isinstance(connection, str) else connection
    return spark.read.format("jdbc").options(**options).option("query" if " " in path.strip() else "dbtable", path).load()


_CSV = {"header": "true", "inferSchema": "true"}
READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": _native("csv", **_CSV),
    "tsv": _native("csv", sep="\t", **_CSV),
    "json": _native("json"),
    "parquet": _native("parquet"),
    "orc": _native("orc"),
    "text": _native("text"),
    "txt": _native("text"),
    "sql": _sql,
    "xls": _pandas("excel"),
    "xlsx": _pandas("excel"),
    "html": _pandas("html"),
    "h5": _pandas("hdf"),
    "hdf": _pandas("hdf"),
    "dta": _pandas("stata"),
    "stata": _pandas("stata"),
    "npy": _numpy,
    "npz": _numpy,
    "numpy": _numpy,
    "ft": _feather,
    "feather": _feather,
}


def kind_of_file(path: str, known: dict) -> str:
    parts = Path(path.rstrip("/")).name.lower().split(".")[1:]
    parts = [p for p in parts if p not in ("gz", "bz2", "zst", "snappy", "xz")]
    if not parts:
        raise AmbiguousFileType(f"{path!r} has no extension; name the reader or writer")
    if parts[-1] in ("pkl", "pickle"):
        raise UnhandledFileType("pickles run code when they are read; use parquet")
    if parts[-1] not in known:
        raise UnhandledFileType(f"nothing reads or writes {parts[-1]!r}")
    return parts[-1]


def reader(path: str, name: str | Callable | None = None) -> Callable[..., DataFrame]:
    """By function, by name, or by the path's extension."""
    if callable(name):
        return name
    if name is not None and name not in READERS:
        raise UnhandledFileType(f"no reader {name!r}")
    return READERS[name or kind_of_file(path, READERS)]


def expand(spark: SparkSession, path: str) -> list[str]:
    """The files that a pattern matches, in any store that Spark reads; none is an error."""
    if not any(c in path for c in "*?[{"):
        return [path]
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    out = sorted(s.getPath().toString() for s in found or [])
    if not out:
        raise RuntimeError(f"nothing matches {path!r}")
    return out


def read(spark: SparkSession, path: str | Sequence[str], name: str | Callable | None = None, restore_index: bool = False, **options) -> DataFrame:
    """One frame of all files; a file listed several times counts several times."""
    paths = [p for one in ([path] if isinstance(path, str) else path) for p in (expand(spark, one) if name != "sql" else [one])]
    by = reader(paths[0], name)
    if getattr(by, "many", False):
        return by(spark, paths, restore_index=restore_index, **options)
    return concat([by(spark, p, restore_index=restore_index, **options) if not callable(name) else by(p, **options) for p in paths])


def read_each(spark: SparkSession, path: str | Sequence[str], name: str | None = None, **options) -> Iterator[DataFrame]:
    """A frame for each file in turn."""
    for one in [path] if isinstance(path, str) else path:
        for p in expand(spark, one):
            yield read(spark, p, name, **options)


def with_chunks(df: DataFrame, size: int, order: Sequence[str], file: str | None = None) -> DataFrame:
    """A column chunk: rows numbered in blocks of ``size`` in an order, within each file (a column that names it), so that no
    chunk spans two files. Numbered by parts, whatever the size of a file."""
    rows = numbered_rows(df, [*([file] if file else []), *order], "_n")
    if file:
        first = rows.groupBy(F.col(file).alias("_f")).agg(F.min("_n").alias("_first"))
        rows = rows.join(F.broadcast(first), F.col(file).eqNullSafe(F.col("_f"))).withColumn("_n", F.col("_n") - F.col("_first")).drop("_f", "_first")
    return rows.withColumn("chunk", F.floor(F.col("_n") / size).cast("long")).drop("_n")


def read_chunks(spark: SparkSession, path: str | Sequence[str], size: int, name: str | None = None, **options) -> Iterator[DataFrame]:
    """Blocks of ``size`` rows of each file in turn; none spans files, empty ones are left out.

    A row's place is that of its block of the file and within it; each pass reads those rows alone. (Where passes aren't
    wanted for their own sake, ``read`` is one distributed frame.)
    """
    for df in read_each(spark, path, name, **options):
        placed = df.select("*", F.monotonically_increasing_id().alias("_n"))
        bits = 33  # the upper bits are the partition, the lower count its rows
        counts = {r[0]: r[1] for r in placed.groupBy(F.shiftright("_n", bits).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
        first, upto = {}, 0
        for part in sorted(counts):
            first[part], upto = upto, upto + counts[part]
        if not upto:
            continue
        starts = F.create_map(*[F.lit(x) for part, n in first.items() for x in (part, n)])
        ranked = placed.withColumn("_r", F.element_at(starts, F.shiftright("_n", bits)) + F.col("_n") % (1 << bits))
        for lo in range(0, upto, size):
            yield ranked.where((F.col("_r") >= lo) & (F.col("_r") < lo + size)).drop("_n", "_r")


def file_slice(paths: Sequence[str], index: int, size: int) -> list[str]:
    """The files of one of several workers; Spark's own tasks need none."""
    return list(paths[size * index : size * (index + 1)])


class Slices:
    """The files dealt to workers in slices of ``size``; once ``lock``ed, the paths don't change."""

    def __init__(self, paths: Sequence[str] = (), size: int = 1):
        self.paths, self.size, self.locked = list(paths), size, False

    def configure(self, paths: Sequence[str], lock: bool = False) -> None:
        if self.locked and list(paths) != self.paths:
            raise RuntimeError("the paths are locked")
        self.paths, self.locked = list(paths), self.locked or lock

    def of(self, worker: int) -> list[str]:
        return file_slice(self.paths, worker, self.size)

    @property
    def workers(self) -> int:
        return -(-len(self.paths) // self.size)


def _write_native(kind: str, **defaults):
    def write(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
        df.write.mode(mode).format(kind).options(**defaults | options).save(path)

    return write


def _write_pandas(name: str, **defaults):
    def write(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
        getattr(df.toPandas(), f"to_{name}")(_local(path), **defaults | options)

    return write


#: What numpy and feather files keep besides: the columns' Spark types, so that dates, decimals and nulls come back as they were.
_TYPES, _INDEX = "__types__", "__index__"


def _with_index(df: DataFrame, store_index: bool) -> pd.DataFrame:
    pdf = df.toPandas()
    return pdf.rename_axis(_INDEX).reset_index() if store_index else pdf


def _write_numpy(df: DataFrame, path: str, mode: str = "overwrite", store_index: bool = False, **_) -> None:
    import numpy as np

    pdf = _with_index(df, store_index)
    texts = [c for c in pdf.columns if pdf[c].dtype == object or str(pdf[c].dtype) in ("str", "string")]
    arrays = {c: (pdf[c].where(pdf[c].notna(), "\ue000").astype(str).to_numpy().astype("U") if c in texts else pdf[c].to_numpy()) for c in pdf.columns}
    if path.endswith(".npy"):
        np.save(_local(path), np.rec.fromarrays(list(arrays.values()), names=list(arrays)))
    else:
        np.savez(_local(path), **arrays, **{_TYPES: np.array(json.dumps(df.schema.jsonValue()))})


def _write_feather(df: DataFrame, path: str, mode: str = "overwrite", store_index: bool = False, **_) -> None:
    import pyarrow as pa
    import pyarrow.feather

    table = pa.Table.from_pandas(_with_index(df, store_index), preserve_index=False)
    types = {_TYPES.encode(): json.dumps(df.schema.jsonValue()).encode()}
    pyarrow.feather.write_feather(table.replace_schema_metadata((table.schema.metadata or {}) | types), _local(path))


def _write_sql(df: DataFrame, path: str, mode: str = "overwrite", connection: str | dict | None = None, **_) -> None:
    if connection is None:
        df.createOrReplaceTempView(path)
    else:
        df.write.format("jdbc").mode(mode).options(**({"url": connection} if isinstance(connection, str) else connection)).option("dbtable", path).save()


#: Formats without a writer in Spark go through one pandas frame on the driver: for results, not for data.
WRITERS: dict[str, Callable[..., None]] = {
    "csv": _write_native("csv", header="true"),
    "tsv": _write_native("csv", header="true", sep="\t"),
    "json": _write_native("json"),
    "parquet": _write_native("parquet"),
    "orc": _write_native("orc"),
    "sql": _write_sql,
    "xls": _write_pandas("excel", index=False),
    "xlsx": _write_pandas("excel", index=False),
    "html": _write_pandas("html", index=False),
    "h5": _write_pandas("hdf", key="df"),
    "dta": _write_pandas("stata", write_index=False),
    "npy": _write_numpy,
    "npz": _write_numpy,
    "ft": _write_feather,
    "feather": _write_feather,
}


def write(df: DataFrame, path: str, name: str | Callable | None = None, counter: int | None = None, results: str | None = None, fork: int | None = None, **options) -> str:
    """Writes by function, name or extension; a bare file name goes to the results folder, the number of the execution and
    that of the worker before the extension."""
    for mark, number in (("p", counter), ("f", fork)):
        if number is not None:
            p = Path(path)
            path = str(p.with_name(f"{p.stem}_{mark}{number}{p.suffix}")) if "://" not in path else f"{path.removesuffix(p.suffix)}_{mark}{number}{p.suffix}"
    if results and "/" not in path:
        path = f"{results.rstrip('/')}/{path}"
    if name is not None and not callable(name) and name not in WRITERS:
        raise UnhandledFileType(f"no writer {name!r}")
    by = name if callable(name) else WRITERS[name or kind_of_file(path, WRITERS)]
    by(df, path, **options)
    return path


#: Kinds of resources: the folder of this package that holds them.
RESOURCES = {"data": "data", "template": "templates", "tutorial": "tutorials", "config": "config"}


def resource(name: str, kind: str = "data") -> Path:
    """A file that this package comes with, by kind."""
    if kind not in RESOURCES:
        raise ValueError(f"no such kind: {kind!r}")
    at = Path(str(_resources.files("loomframe"))) / RESOURCES[kind] / name
    if not at.exists():
        raise FileNotFoundError(f"no {kind} {name!r}")
    return at


def fixture(name: str) -> Path:
    return resource(name, "data")


def template(name: str) -> Path:
    return resource(name, "template")


def tutorial(name: str) -> Path:
    return resource(name, "tutorial")


def config(name: str) -> Path:
    return resource(name, "config")
