"""Repair of dirty frames: names, missing values, types by majority, coercion, fill values, text cleaning."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.expr import missing_text, nan_to_null

FILL = {"int": -999, "float": float("nan"), "str": "not_a_str", "bool": "not_a_bool", "time": None}
SPARK = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string", "time": "timestamp"}
#: Of equal counts the earlier wins.
ORDER = ("str", "float", "int", "bool")
_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd", "dd-MM-yyyy", "dd/MM/yyyy")


def fix_name(name: str, strip_table: bool = False) -> str:
    """Outer blanks and (if asked) a ``table.`` go, blanks and punctuation become _, all else but letters and digits goes."""
    out = name.strip()
    if strip_table and "." in out:
        out = out.split(".", 1)[1]
    out = re.sub(r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^`{|}~]", "_", out.replace(" ", "_"))
    out = re.sub(r"[^A-Za-z0-9_]", "", out)
    if not out:
        raise ValueError(f"nothing is left of the name {name!r}")
    return out


def fix_names(df: DataFrame, strip_table: bool = False) -> DataFrame:
    return df.toDF(*[fix_name(c, strip_table) for c in df.columns])


def interpret(text: str | None):
    """One text as the number, truth value, list, dict or other literal it spells; as it is where it spells none."""
    import ast

    if text is None:
        return None
    for number in (int, float):
        try:
            return number(text)
        except ValueError:
            continue
    try:
        return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return text


def unquoted(c: Column) -> Column:
    """A text in quotes as what is between them, as a literal spells it."""
    t = F.trim(c)
    return F.when(t.rlike(r"^'[^']*'$") | t.rlike(r'^"[^"]*"$'), F.substring(t, 2, F.length(t) - 2)).otherwise(c)


def guess(c: Column, missing=missing_text) -> Column:
    """int, float, bool or str, as the text reads; null where it is missing."""
    return (
        F.when(missing(c), None)
        .when(c.rlike(r"^\s*[+-]?\d+\s*$") & c.try_cast("bigint").isNotNull(), "int")
        .when(c.try_cast("double").isNotNull(), "float")
        .when(F.trim(c).isin("True", "False", "true", "false"), "bool")
        .otherwise("str")
    )


def type_counts(df: DataFrame, columns: Sequence[str] = (), missing=missing_text) -> DataFrame:
    """(column, nan, str, float, int, bool): how the texts of each column read. One pass."""
    names = list(columns) or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, nan long, str long, float long, int long, bool long")
    guesses = df.select(*[guess(F.col(f"`{c}`"), missing).alias(f"g{i}") for i, c in enumerate(names)])
    row = guesses.agg(*[F.count(F.when(F.col(f"g{i}").isNull() if k == "nan" else F.col(f"g{i}") == k, 1)).alias(f"{k}{i}") for i in range(len(names)) for k in ("nan", *ORDER)])
    parts = [F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in ("nan", *ORDER)]) for i, c in enumerate(names)]
    return row.select(F.explode(F.array(*parts)).alias("v")).select("v.*")


def majority(counts: dict[str, int]) -> str:
    """The most frequent type; of equals str, float, int, bool in this order; str where all is missing."""
    return max(ORDER, key=lambda k: (counts.get(k, 0), -ORDER.index(k))) if any(counts.get(k) for k in ORDER) else "str"


def infer_types(df: DataFrame, columns: Sequence[str] = ()) -> dict[str, str]:
    return {r["column"]: majority(r.asDict()) for r in type_counts(df, columns).collect()}


def coerce(c: Column, to: str, bool_to_int: bool = False, missing=missing_text) -> Column:
    """A text as the type; null where it isn't."""
    c = F.when(missing(c), None).otherwise(c)
    if to == "str":
        return c
    if to == "int":
        return F.coalesce(c.try_cast("bigint"), F.round(c.try_cast("double")).try_cast("bigint"), F.lower(F.trim(c)).try_cast("boolean").cast("bigint"))
    if to == "float":
        return F.coalesce(F.nanvl(c.try_cast("double"), F.lit(None)), F.lower(F.trim(c)).try_cast("boolean").cast("double"))
    if to == "bool":
        b = F.when(F.trim(c).isin("True", "true", "1", "1.0"), True).when(F.trim(c).isin("False", "false", "0", "0.0"), False)
        return b.cast("bigint") if bool_to_int else b
    if to == "time":
        return F.coalesce(c.try_cast("timestamp"), *[F.try_to_timestamp(c, F.lit(f)) for f in _FORMATS])
    raise ValueError(f"no such type: {to!r}")


def clean_text(c: Column, aggressive: bool = False) -> Column:
    """Without outer blanks; aggressive: blanks to _ and nothing but letters, digits and _."""
    c = F.trim(c)
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("_")), "[^A-Za-z0-9_]", "") if aggressive else c


@dataclass
class Repair:
    """Options of ``repair``; names are those after fixing."""

    fix_column_names: bool = True
    strip_table: bool = False
    types: dict[str, str] = field(default_factory=dict)
    converters: dict = field(default_factory=dict)
    keep_inconsistent: bool = False
    fill_missing: bool = False
    fill: dict[str, object] = field(default_factory=dict)
    drop_duplicates: bool = False
    strip: bool = True
    cleanup: Sequence[str] = ()
    #: whether truth values become 0 and 1, for all columns or by column
    bool_to_int: bool | dict[str, bool] = True
    #: which texts mean missing: a function of the Column to a truth value, or texts besides the usual ones
    missing: object = None
    #: fills by type instead of FILL, and what counts as missing by column besides
    fill_by_type: dict[str, object] = field(default_factory=dict)
    nan_values: dict[str, Sequence] = field(default_factory=dict)
    #: by column: what a value becomes that doesn't read as the type (else missing), or a function of the text
    inconsistent: dict[str, object] = field(default_factory=dict)
    #: only these columns, or all but those
    only: Sequence[str] = ()
    skip: Sequence[str] = ()
    #: keep texts of several types whose majority is text as they are, without a look at the others
    literals: bool = False


def _missing(o: Repair):
    if callable(o.missing):
        return o.missing
    more = [str(x).lower() for x in o.missing or ()]
    return (lambda c: missing_text(c) | F.lower(F.trim(c)).isin(*more)) if more else missing_text


def repair(df: DataFrame, options: Repair | None = None) -> tuple[DataFrame, DataFrame]:
    """The repaired frame and the counts of types it was decided by.

    Only columns that need it change: of an imposed type, or texts. A text column becomes the type that most of its
    filled values read as; values that don't become missing (or stay, as text, with ``keep_inconsistent``). Missing
    values get the fill of their type with ``fill_missing``. Repeated rows go before texts are stripped.
    """
    o = options or Repair()
    df = nan_to_null(fix_names(df, o.strip_table) if o.fix_column_names else df)
    chosen = [c for c in o.only or df.columns if c not in o.skip]
    for c, values in o.nan_values.items():
        df = df.withColumn(c, F.when(~F.col(c).isin(list(values)), F.col(c)))
    if o.literals:
        df = df.select(*[unquoted(F.col(f"`{f.name}`")).alias(f.name) if f.name in chosen and isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])
    missing = _missing(o)
    texts = [f.name for f in df.schema if f.name in chosen and isinstance(f.dataType, T.StringType)]
    counts = type_counts(df, texts, missing) if texts else type_counts(df.select())
    found = counts.collect()  # a row for each column
    counts = df.sparkSession.createDataFrame(found, counts.schema)
    kinds = {r["column"]: majority(r.asDict()) for r in found} | o.types
    if o.drop_duplicates:
        df = df.dropDuplicates()
    made = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name not in chosen:
            made.append(c)
            continue
        kind = kinds.get(f.name)
        if f.name in o.converters:
            c = o.converters[f.name](c)
        elif kind and not (o.keep_inconsistent and f.name not in o.types):
            whole = o.bool_to_int.get(f.name, True) if isinstance(o.bool_to_int, dict) else o.bool_to_int
            text = c.cast("string")
            c = coerce(text, kind, whole, missing)
            if f.name in o.inconsistent:
                other = o.inconsistent[f.name]
                c = F.coalesce(c, F.when(~missing(text), other(text) if callable(other) else F.lit(other)))
        if kind == "str" and o.strip:
            c = clean_text(c, f.name in o.cleanup)
        if o.fill_missing or f.name in o.fill:
            value = o.fill.get(f.name, (FILL | o.fill_by_type).get(kind or _kind(f.dataType)))
            c = c if value is None or (kind == "bool" and isinstance(value, str)) else F.coalesce(c, F.lit(value))
        made.append(c.alias(f.name))
    return df.select(*made), counts


def _kind(t: T.DataType) -> str:
    return {"string": "str", "boolean": "bool", "double": "float", "float": "float"}.get(t.simpleString(), "time" if isinstance(t, (T.TimestampType, T.DateType)) else "int")
