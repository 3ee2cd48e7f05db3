"""Chains of stages over a store of frames: initialize, execute, finalize; repeat, skip, break, resume; the command line."""

from __future__ import annotations

import argparse
import json
import logging
import runpy
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators import relational
from loomframe.sources import io

log = logging.getLogger("loomframe")


class Status(Enum):
    SUCCESS = 0
    BREAK_CHAIN = 1
    SKIP_CHAIN = 2
    REPEAT_CHAIN = 3
    RECOVERABLE = 4
    FAILURE = 5


@dataclass
class Settings:
    seed: int = 1
    results: str = "results"
    store: str = "none"  # all, one or none: which chains leave a checkpoint
    begin_with: str | None = None
    end_with: str | None = None
    single_chain: str | None = None
    profile: bool = False
    conf: dict = field(default_factory=dict)


class Store(dict):
    """Names to frames and other objects. A frame's count ``n_<name>`` is made when it is asked for; a frame is a view of its name too."""

    def __setitem__(self, key, value):
        super().__setitem__(key, value)
        super().pop(f"n_{key}", None)
        if isinstance(value, DataFrame) and key.isidentifier():
            value.createOrReplaceTempView(key)

    def __missing__(self, key):
        if key.startswith("n_") and isinstance(self.get(key[2:]), DataFrame):
            super().__setitem__(key, n := self[key[2:]].count())
            return n
        raise KeyError(key)

    def frame(self, key: str) -> DataFrame:
        if not isinstance(found := self[key], DataFrame):
            raise TypeError(f"{key!r} isn't a frame")
        return found

    def drop(self, keys: Sequence[str] = (), keep_only: Sequence[str] | None = None) -> None:
        for k in [k for k in self if k not in keep_only] if keep_only is not None else keys:
            found = self.pop(k, None)
            if isinstance(found, DataFrame):
                found.unpersist()

    def save(self, folder: str) -> None:
        """Frames as parquet, plain values as JSON."""
        plain = {}
        for k, v in self.items():
            if isinstance(v, DataFrame):
                v.write.mode("overwrite").parquet(f"{folder}/{k}")
            elif isinstance(v, (str, int, float, bool, list, dict, type(None))):
                plain[k] = v
        names = [k for k, v in self.items() if isinstance(v, DataFrame)]
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps({"frames": names, "plain": plain}),)], "state string").coalesce(1).write.mode("overwrite").text(f"{folder}/_state")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Store:
        state = json.loads(spark.read.text(f"{folder}/_state").first()[0])
        out = cls(state["plain"])
        for k in state["frames"]:
            out[k] = spark.read.parquet(f"{folder}/{k}")
        return out


class Stage:
    """One step. ``execute`` may run several times when its chain repeats."""

    def __init__(self, name: str | None = None):
        self.name = name or type(self).__name__

    def initialize(self, ds: Store) -> Status | None:
        return None

    def execute(self, ds: Store) -> Status | None:
        return None

    def finalize(self, ds: Store) -> Status | None:
        return None


class Embed(Stage):
    """An interactive console in the middle of a chain."""

    def execute(self, ds):
        import code

        code.interact(local={"ds": ds})


class Apply(Stage):
    """A function of frames (and other objects) of the store, to a frame or several."""

    def __init__(self, func: Callable, read: str | Sequence[str], store: str | Sequence[str] | None = None, name: str | None = None, **kwargs):
        super().__init__(name)
        self.func, self.read, self.kwargs = func, [read] if isinstance(read, str) else list(read), kwargs
        self.store = self.read[:1] if not store else [store] if isinstance(store, str) else list(store)

    def execute(self, ds):
        found = self.func(*[ds.get(k) if k not in ds and not k.startswith("n_") else ds[k] for k in self.read], **self.kwargs)
        for k, v in zip(self.store, [found] if len(self.store) == 1 else found, strict=True):
            ds[k] = v


class Read(Stage):
    """Reads files; ``each`` a file and ``chunk`` so many rows for each pass of the chain, until none is left."""

    def __init__(self, spark: SparkSession, path, key: str, reader=None, each: bool = False, chunk: int = 0, **options):
        super().__init__()
        self.spark, self.path, self.key, self.reader, self.each, self.chunk, self.options = spark, path, key, reader, each, chunk, options
        self.turn: Iterator[DataFrame] | None = None
        self.held: DataFrame | None = None

    def initialize(self, ds):
        if self.chunk or self.each:
            self.turn = io.read_chunks(self.spark, self.path, self.chunk, self.reader, **self.options) if self.chunk else io.read_each(self.spark, self.path, self.reader, **self.options)
            self.held = next(self.turn, None)

    def execute(self, ds):
        if self.turn is None:
            ds[self.key] = io.read(self.spark, self.path, self.reader, **self.options)
            return None
        if self.held is None:
            return Status.BREAK_CHAIN
        ds[self.key] = self.held
        ds[f"n_sum_{self.key}"] = ds.get(f"n_sum_{self.key}", 0) + ds[f"n_{self.key}"]
        self.held = next(self.turn, None)
        ds[f"more_{self.key}"] = self.held is not None
        return None


class Write(Stage):
    def __init__(self, key: str | None = None, path: str | None = None, writer=None, paths: dict[str, str] | None = None, count: bool = False, results: str | None = None, **options):
        super().__init__()
        self.paths, self.writer, self.count, self.results, self.options, self.n = paths or {key: path}, writer, count, results, options, 0

    def execute(self, ds):
        for key, path in self.paths.items():
            io.write(ds.frame(key), path, self.writer, self.n if self.count else None, self.results, ds.get("fork"), **self.options)
        self.n += 1


class Repeat(Stage):
    """Asks for another pass of the chain while a reader has more, at most ``most`` times."""

    def __init__(self, keys: Sequence[str], most: int = 1_000_000):
        super().__init__()
        self.keys, self.most, self.n = keys, most, 0

    def execute(self, ds):
        self.n += 1
        return Status.REPEAT_CHAIN if self.n < self.most and any(ds.get(f"more_{k}") for k in self.keys) else None


class SkipIfEmpty(Stage):
    def __init__(self, keys: Sequence[str]):
        super().__init__()
        self.keys = keys

    def execute(self, ds):
        return Status.SKIP_CHAIN if any(ds.get(k) is None or ds.frame(k).isEmpty() for k in self.keys) else None


class Collect(Stage):
    """Appends a frame to what other passes left under another name, or reduces both by a function."""

    def __init__(self, read: str, store: str, func: Callable[[DataFrame, DataFrame], DataFrame] | None = None):
        super().__init__()
        self.read, self.store, self.func = read, store, func or (lambda a, b: relational.concat([a, b]))

    def execute(self, ds):
        ds[self.store] = self.func(ds[self.store], ds[self.read]) if self.store in ds else ds[self.read]


class Accumulate(Stage):
    """Counts summed over the passes of a chain, stored when it ends."""

    def __init__(self, read: str, store: str, count: Callable[[DataFrame], object]):
        super().__init__()
        self.read, self.store, self.count, self.parts = read, store, count, []

    def execute(self, ds):
        self.parts.append(self.count(ds.frame(self.read)))

    def finalize(self, ds):
        if self.parts:
            ds[self.store] = reduce(lambda a, b: a + b, self.parts)


class Fork(Stage):
    """Stages run for each of several workers' files, over a store of its own each; the results are reduced under one name.

    Each worker has its slice of the files as one frame, its number as ``fork``, and a copy of the store otherwise. Spark runs
    the tasks of one worker's frame on all executors, so the workers follow each other.
    """

    def __init__(self, spark: SparkSession, slices: io.Slices, key: str, stages: Sequence[Stage], collect: str, store: str, func: Callable[[DataFrame, DataFrame], DataFrame] | None = None, reader=None, **options):
        super().__init__()
        self.spark, self.slices, self.key, self.stages, self.collect, self.store = spark, slices, key, stages, collect, store
        self.func, self.reader, self.options = func or (lambda a, b: relational.concat([a, b])), reader, options

    def execute(self, ds):
        parts = []
        for worker in range(self.slices.workers):
            own = Store(ds)
            own["fork"] = worker
            own[self.key] = io.read(self.spark, self.slices.of(worker), self.reader, **self.options)
            Chain(f"{self.name}-{worker}", self.stages).run(own)
            parts.append(own[self.collect])
        if parts:
            ds[self.store] = reduce(self.func, parts)


class Split(Stage):
    """Rows dealt to classes; the seed is the settings' and one more for each execution."""

    def __init__(self, read: str, store: str, key: Sequence[str], seed: int = 1, **options):
        super().__init__()
        self.read, self.store, self.split = read, store, relational.Splitter(key, seed=seed, **options)

    def execute(self, ds):
        ds[self.store] = self.split(ds.frame(self.read))


class LineLoop(Stage):
    """Lines of a file through functions, one after the other: each maps a Column of text; empty results go."""

    def __init__(self, read: str, store: str, functions: Sequence[Callable] = (), column: str = "value"):
        super().__init__()
        self.read, self.store, self.functions, self.column = read, store, functions, column

    def execute(self, ds):
        line = reduce(lambda c, f: f(c), self.functions, F.col(self.column))
        ds[self.store] = ds.frame(self.read).select(line.alias(self.column)).where(F.coalesce(F.length(self.column), F.lit(0)) > 0)


class Import(Stage):
    """The store that another run has left, into this one."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def execute(self, ds):
        for k, v in Store.load(self.spark, self.folder).items():
            ds[k] = v


class Hello(Stage):
    def __init__(self, to: str = "World", times: int = 1):
        super().__init__()
        self.to, self.times = to, times

    def execute(self, ds):
        for _ in range(self.times):
            print(f"Hello {self.to}")


class Delete(Stage):
    def __init__(self, keys: Sequence[str] = (), keep_only: Sequence[str] | None = None):
        super().__init__()
        self.keys, self.keep_only = keys, keep_only

    def execute(self, ds):
        ds.drop(self.keys, self.keep_only)


class Print(Stage):
    def __init__(self, keys: Sequence[str] = (), rows: int = 20):
        super().__init__()
        self.keys, self.rows = keys, rows

    def execute(self, ds):
        for k in self.keys or list(ds):
            if isinstance(ds[k], DataFrame):
                print(f"--- {k}")
                ds[k].show(self.rows)
            else:
                print(f"--- {k}: {ds[k]}")


class AssertIn(Stage):
    def __init__(self, keys: Sequence[str]):
        super().__init__()
        self.keys = keys

    def execute(self, ds):
        if missing := [k for k in self.keys if k not in ds]:
            raise KeyError(f"{missing} aren't in the store")


class Break(Stage):
    def execute(self, ds):
        return Status.BREAK_CHAIN


class Rename(Stage):
    """Copies or moves objects, or gathers them in a dict under one name."""

    def __init__(self, names: dict[str, str], move: bool = False, into: str | None = None):
        super().__init__()
        self.names, self.move, self.into = names, move, into

    def execute(self, ds):
        found = {new: ds[old] for old, new in self.names.items()}
        if self.move:
            ds.drop(list(self.names))
        ds.update(found) if not self.into else ds.__setitem__(self.into, found)
        for k, v in found.items() if not self.into else ():
            ds[k] = v


class WordCount(Stage):
    """Counts the words of lines of text."""

    def __init__(self, read: str, store: str, column: str = "value"):
        super().__init__()
        self.read, self.store, self.column = read, store, column

    def execute(self, ds):
        words = ds.frame(self.read).select(F.explode(F.split(F.trim(self.column), r"\s+")).alias("word")).where("word <> ''")
        ds[self.store] = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Chain:
    def __init__(self, name: str, stages: Sequence[Stage] = ()):
        self.name, self.stages = name, list(stages)

    def add(self, stage: Stage) -> Chain:
        self.stages.append(stage)
        return self

    def run(self, ds: Store) -> Status:
        for s in self.stages:
            s.initialize(ds)
        status = Status.REPEAT_CHAIN
        while status is Status.REPEAT_CHAIN:
            status = Status.SUCCESS
            for s in self.stages:
                found = s.execute(ds) or Status.SUCCESS
                if found is Status.FAILURE:
                    raise RuntimeError(f"stage {s.name} of chain {self.name} failed")
                if found is not Status.SUCCESS and found is not Status.RECOVERABLE:
                    status = found
                    break
        for s in self.stages:
            s.finalize(ds)
        return Status.SUCCESS if status in (Status.BREAK_CHAIN, Status.SKIP_CHAIN) else status


class Runner:
    """Runs chains in order, from one to another or a single one, with a checkpoint of the store for each to resume from."""

    def __init__(self, chains: Sequence[Chain] = (), settings: Settings | None = None, spark: SparkSession | None = None):
        self.chains, self.settings, self.spark = list(chains), settings or Settings(), spark

    def chain(self, name: str) -> Chain:
        self.chains.append(Chain(name))
        return self.chains[-1]

    def run(self, ds: Store | None = None) -> Store:
        o, names = self.settings, [c.name for c in self.chains]
        if wrong := [n for n in (o.begin_with, o.end_with, o.single_chain) if n and n not in names]:
            raise ValueError(f"no chains {wrong}")
        first = names.index(o.single_chain or o.begin_with) if o.single_chain or o.begin_with else 0
        last = names.index(o.single_chain or o.end_with) if o.single_chain or o.end_with else len(names) - 1
        if ds is None:
            ds = Store.load(self.spark, f"{o.results}/{names[first - 1]}") if first and self.spark else Store()
        for k in range(first, last + 1):
            began = time.time()
            self.chains[k].run(ds)
            if o.profile:
                log.warning("chain %s took %.1f s", names[k], time.time() - began)
            if o.store == "all" or (o.store == "one" and k == last):
                ds.save(f"{o.results}/{names[k]}")
        return ds


def main(args: Sequence[str] | None = None) -> Store:
    """Runs a macro: a Python file that defines ``build(spark, settings) -> Runner``."""
    p = argparse.ArgumentParser(prog="loomframe")
    p.add_argument("macro")
    p.add_argument("-b", "--begin-with")
    p.add_argument("-e", "--end-with")
    p.add_argument("-s", "--single-chain")
    p.add_argument("--store", choices=["all", "one", "none"], default="none")
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--results", default="results")
    p.add_argument("-c", "--conf", action="append", default=[], help="name=value")
    p.add_argument("-L", "--log-level", default="WARNING")
    p.add_argument("-P", "--profile", action="store_true")
    p.add_argument("-i", "--interactive", action="store_true")
    o = p.parse_args(args)
    logging.basicConfig(level=o.log_level)
    settings = Settings(o.seed, o.results, o.store, o.begin_with, o.end_with, o.single_chain, o.profile, dict(x.split("=", 1) for x in o.conf))
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    runner = runpy.run_path(o.macro)["build"](spark, settings)
    runner.settings, runner.spark = settings, spark
    ds = runner.run()
    if o.interactive:
        import code

        code.interact(local={"ds": ds, "spark": spark})
    return ds
