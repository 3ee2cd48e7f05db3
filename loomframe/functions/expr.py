"""Column expressions: query strings, missing values, bins and time periods."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.NumericType,)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# --- query strings ---

_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>'[^']*'|"[^"]*")|(?P<name>`[^`]+`|[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|<>|[-+*/%<>&|~()\[\],]))"""
)


class _Query:
    """Recursive descent over the expression language of data-frame queries: comparisons (chained too), in and not in,
    and/or/not or & | ~, arithmetic. As there, != keeps rows in which a side is missing."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:]!r} in query {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, value: str) -> None:
        if self.take()[1] != value:
            raise ValueError(f"{value!r} is missing in the query")

    def parse(self) -> Column:
        out = self.disjunction()
        if self.at < len(self.tokens):
            raise ValueError(f"{self.tokens[self.at][1]!r} isn't expected in the query")
        return out

    def disjunction(self) -> Column:
        out = self.conjunction()
        while self.peek("or", "|"):
            self.take()
            out = out | self.conjunction()
        return out

    def conjunction(self) -> Column:
        out = self.negation()
        while self.peek("and", "&"):
            self.take()
            out = out & self.negation()
        return out

    def negation(self) -> Column:
        if self.peek("not", "~"):
            self.take()
            return ~F.coalesce(self.negation(), F.lit(False))
        return self.comparison()

    def comparison(self) -> Column:
        left, out = self.sum(), None
        while True:
            if self.peek("==", "!=", "<>", "<", "<=", ">", ">="):
                op, right = self.take()[1], self.sum()
                one = {"==": lambda a, b: a == b, "!=": lambda a, b: ~a.eqNullSafe(b), "<>": lambda a, b: ~a.eqNullSafe(b), "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op](left, right)
                left = right
            elif self.peek("in") or (self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]):
                negated = self.take()[1] == "not"
                if negated:
                    self.take()
                self.expect("[" if self.peek("[") else "(")
                values = []
                while not self.peek("]", ")"):
                    values.append(self.literal())
                    if self.peek(","):
                        self.take()
                self.take()
                one = left.isin(values)
                one = ~F.coalesce(one, F.lit(False)) if negated else one
            else:
                return left if out is None else out
            out = one if out is None else out & one

    def literal(self):
        sign = -1 if self.peek("-") and self.take() else 1
        kind, value = self.take()
        if kind == "num":
            return sign * (float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "str":
            return value[1:-1]
        raise ValueError(f"{value!r} isn't a literal")

    def sum(self) -> Column:
        out = self.product()
        while self.peek("+", "-"):
            out = out + self.product() if self.take()[1] == "+" else out - self.product()
        return out

    def product(self) -> Column:
        out = self.atom()
        while self.peek("*", "/", "%"):
            op = self.take()[1]
            right = self.atom()
            out = out * right if op == "*" else F.try_divide(out, right) if op == "/" else F.pmod(out, right)
        return out

    def atom(self) -> Column:
        if self.peek("("):
            self.take()
            out = self.disjunction()
            self.expect(")")
            return out
        if self.peek("-"):
            self.take()
            return -self.atom()
        kind, value = self.take()
        if kind == "num":
            return F.lit(float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "str":
            return F.lit(value[1:-1])
        if kind == "name" and value in ("True", "False"):
            return F.lit(value == "True")
        if kind == "name":
            return F.col(f"`{value.strip('`')}`")
        raise ValueError(f"{value!r} isn't expected in the query")


def query(text: str) -> Column:
    """The condition of a query string such as ``a > 0 and b in ['x', 'y']``."""
    return _Query(text).parse()


# --- missing values ---


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing value: NaN of float columns becomes null."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns]) if floats else df


def to_nanos(c: Column) -> Column:
    """A time as whole nanoseconds since 1970; a missing one is 0."""
    return F.coalesce(micros(c) * 1000, F.lit(0).cast("long"))


def only(c: Column, kind: str) -> Column:
    """The value where it reads as an int, float, bool or str, else null; a text that reads as a number or truth is no str."""
    text = c.cast("string")
    whole, number, truth = text.try_cast("long"), text.try_cast("double"), F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")
    found = {
        "int": F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), whole),
        "float": F.when(whole.isNull() | ~text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.nanvl(number, F.lit(None))),
        "bool": truth,
        "str": F.when(number.isNull() & truth.isNull(), text),
    }
    if kind not in found:
        raise ValueError(f"no such kind: {kind!r}")
    return found[kind]


def missing_text(c: Column) -> Column:
    """Whether a text means missing: null, blank, 'none' or 'nan' in any case."""
    return c.isNull() | F.lower(F.trim(c)).isin("", "none", "nan")


# --- bins ---


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


@dataclass(frozen=True)
class Bins:
    """Bins of a variable: of one width from an offset, or between edges. Times take widths in seconds.

    By width, bin n holds [offset + n width, offset + (n+1) width). Between edges, what is outside goes to the first or
    the last bin.
    """

    width: float | None = None
    offset: float | datetime = 0
    edges: tuple = ()

    def __post_init__(self):
        if (self.width is None) == (not self.edges):
            raise ValueError("give a width or edges, not both")
        if self.width is not None and self.width <= 0:
            raise ValueError("the width must be positive")
        if self.edges and (len(self.edges) < 2 or list(self.edges) != sorted(set(self.edges))):
            raise ValueError("edges must rise")

    @classmethod
    def of(cls, spec: Bins | dict | None) -> Bins | None:
        """From a dict of bin_width and bin_offset, or of bin_edges."""
        if spec is None or isinstance(spec, Bins):
            return spec
        if "bin_edges" in spec:
            if "bin_width" in spec:
                raise ValueError("give bin_width or bin_edges, not both")
            return cls(edges=tuple(spec["bin_edges"]))
        return cls(width=spec["bin_width"], offset=spec.get("bin_offset", 0))

    def _offset(self, time: bool) -> Column:
        if time:
            at = self.offset
            return F.lit(round(at.timestamp() * 1e6) if isinstance(at, datetime) else int(at * 1_000_000))
        return F.lit(self.offset)

    def index(self, c: Column, time: bool = False, right_closed: bool = False) -> Column:
        """The bin's number (long)."""
        if self.edges:
            x = micros(c) if time else c
            edges = F.array(*[micros(F.lit(e)) if time else F.lit(e) for e in self.edges])
            under = F.size(F.filter(edges, (lambda e: e < x) if right_closed else (lambda e: e <= x)))
            return F.when(c.isNotNull(), F.least(F.greatest(under - 1, F.lit(0)), F.lit(len(self.edges) - 2))).cast("long")
        x = (micros(c) if time else c) - self._offset(time)
        n = x / F.lit(self.width * 1_000_000 if time else self.width)
        return ((F.ceil(n) - 1) if right_closed else F.floor(n)).cast("long")

    def left(self, n: Column, time: bool = False) -> Column:
        return self._at(n, time)

    def right(self, n: Column, time: bool = False) -> Column:
        return self._at(n + 1, time)

    def center(self, n: Column, time: bool = False) -> Column:
        if self.edges and not time:
            return (self.left(n) + self.right(n)) / 2
        if time:
            a, b = (F.unix_micros(x) for x in (self.left(n, True), self.right(n, True)))
            return F.timestamp_micros(((a + b) / 2).cast("long"))
        return self._offset(False) + (n + 0.5) * F.lit(self.width)

    def _at(self, n: Column, time: bool) -> Column:
        if self.edges:
            return F.element_at(F.array(*[F.lit(e) for e in self.edges]), n.cast("int") + 1)
        if time:
            return F.timestamp_micros((self._offset(True) + n * F.lit(int(self.width * 1_000_000))).cast("long"))
        return self._offset(False) + n * F.lit(self.width)

    def label_of(self, value: float, right_closed: bool = False) -> int:
        """The bin's number of one value, on the driver."""
        from bisect import bisect_left, bisect_right
        from math import ceil, floor

        if self.edges:
            return min(max((bisect_left if right_closed else bisect_right)(self.edges, value) - 1, 0), len(self.edges) - 2)
        n = (value - self.offset) / self.width
        return ceil(n) - 1 if right_closed else floor(n)

    def edge_of(self, n: int):
        return self.edges[n] if self.edges else self.offset + n * self.width

    def center_of(self, n: int):
        return (self.edge_of(n) + self.edge_of(n + 1)) / 2

    def truncated_edges(self, low: float, high: float) -> list:
        """Edges of the bins that meet [low, high]; a high end on an edge stays in the bin before."""
        if high <= low:
            raise ValueError("the range must rise")
        first, last = self.label_of(low), self.label_of(high, right_closed=True)
        return [self.edge_of(n) for n in range(first, last + 2)]


DEFAULT_NUMERIC = Bins(width=1, offset=0)
DEFAULT_TIME = Bins(width=30 * 86_400, offset=1_262_563_200)  # 30 days from 2010-01-04


# --- time periods ---

_UNITS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1, "min": 60, "t": 60, "h": 3600, "d": 86_400, "w": 604_800}


def seconds(period: str | float) -> float:
    """A period such as ``1d``, ``12h`` or ``1h30min`` in seconds."""
    if isinstance(period, (int, float)):
        return float(period)
    parts = re.findall(r"(\d*\.?\d*)\s*(ns|us|ms|min|[a-zA-Z])[a-z]*", period.strip())
    if not parts or any(u.lower() not in _UNITS for _, u in parts):
        raise ValueError(f"can't read the period {period!r}")
    return sum(float(n or 1) * _UNITS[u.lower()] for n, u in parts)


def parse_time(value: str | float | datetime) -> int:
    """A point in time as nanoseconds since 1970: an ISO date or time, a number of nanoseconds, or a datetime; UTC where it says no zone."""
    if isinstance(value, bool):
        raise ValueError("a truth value is no time")
    if isinstance(value, (int, float)):
        return int(value)
    try:
        at = value if isinstance(value, datetime) else datetime.fromisoformat(value.strip())
    except ValueError:
        raise ValueError(f"can't read the time {value!r}") from None
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) * 1000


def parse_period(period: str | float) -> int:
    """A period such as 1d or 12h in nanoseconds; a number is nanoseconds already."""
    return int(period) if isinstance(period, (int, float)) else round(seconds(period) * 1e9)


def uniform_period(c: Column, period: str | float = "1d", offset: str | float = 0) -> Column:
    """floor((time - offset) / period), counted from 1970."""
    return F.floor((micros(c) - int(seconds(offset) * 1e6)) / F.lit(int(seconds(period) * 1e6))).cast("long")


def calendar_period(c: Column, freq: str = "D") -> Column:
    """Days, weeks (from Monday), months, quarters or years since 1970."""
    days = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    months = ((F.year(c) - 1970) * 12 + F.month(c) - 1).cast("long")
    return {"D": days, "W": F.floor((days + 3) / 7).cast("long"), "M": months, "Q": F.floor(months / 3).cast("long"), "A": (F.year(c) - 1970).cast("long"), "Y": (F.year(c) - 1970).cast("long")}[freq[:1].upper()]


def period_start(n: Column, freq: str = "D") -> Column:
    """The first day of a calendar period, as text."""
    epoch = F.lit("1970-01-01").cast("date")
    by = {"D": F.date_add(epoch, n.cast("int")), "W": F.date_add(epoch, (n * 7 - 3).cast("int")), "M": F.add_months(epoch, n.cast("int")), "Q": F.add_months(epoch, (n * 3).cast("int"))}
    return F.date_format(by.get(freq[:1].upper(), F.add_months(epoch, (n * 12).cast("int"))), "yyyy-MM-dd")


def kind_of(df: DataFrame, column: str) -> str:
    """numeric, time, or category (texts and booleans)."""
    try:
        t = df.schema[column].dataType
    except KeyError:
        raise ValueError(f"no column {column!r}") from None
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, TIMES):
        return "time"
    if isinstance(t, (T.StringType, T.BooleanType)):
        return "category"
    raise TypeError(f"column {column!r} of type {t.simpleString()} has no bins")


def columns_like(df: DataFrame, patterns: Sequence[str]) -> list[str]:
    """The columns that match the wildcards; each must match one at least."""
    from fnmatch import filter as matching

    out: list[str] = []
    for p in patterns:
        found = matching(df.columns, p)
        if not found:
            raise ValueError(f"no column is like {p!r}")
        out += [c for c in found if c not in out]
    return out


#: Scalar functions that have an expression of their own; others go through Arrow.
KNOWN: dict[str, Callable[..., Column]] = {
    "square": lambda c: c * c,
    "sqrt_abs": lambda c: F.sqrt(F.abs(c)),
    "increment": lambda c: c + 1,
    "miles_to_km": lambda c: c * 1.60934,
    "text_to_date": lambda c: F.try_to_timestamp(F.split(c, " ")[0]).cast("date"),
    "day_of_year_to_date": lambda c, year=1976: F.date_add(F.make_date(F.lit(year), F.lit(1), F.lit(1)), c.cast("int") - 1),
}


def register(name: str, func: Callable[..., Column]) -> None:
    """Makes a function of Columns known by a name."""
    if not isinstance(name, str) or not name.isidentifier():
        raise TypeError(f"{name!r} is no name")
    if not callable(func):
        raise TypeError("only functions can be registered")
    KNOWN[name] = func
