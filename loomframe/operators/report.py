"""Reports of aggregates as text and LaTeX pages; plots only where matplotlib is installed."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path
from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.expr import kind_of
from loomframe.operators import assoc, profile, relational
from loomframe.operators.hist import Histogram
from loomframe.sources import io

PAGE, DOCUMENT = "page.tex", "report.tex"
_SPECIAL = str.maketrans({c: "\\" + c for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"})


def text_table(rows: Sequence[Sequence], header: Sequence[str] = ()) -> str:
    cells = [[_show(v) for v in r] for r in ([header] if header else []) + list(rows)]
    widths = [max(len(r[k]) for r in cells) for k in range(len(cells[0]))] if cells else []
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def latex_table(rows: Sequence[Sequence], header: Sequence[str] = ()) -> str:
    lines = [" & ".join(_show(v).translate(_SPECIAL) for v in r) + r" \\" for r in ([header] if header else []) + list(rows)]
    n = max((len(r) for r in rows), default=len(header) or 1)
    return "\\begin{tabular}{" + "l" * n + "}\n" + "\n".join(lines) + "\n\\end{tabular}"


def _show(v) -> str:
    return f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v)


def bars(rows: Sequence[tuple[str, int]], width: int = 40) -> str:
    """A histogram as lines of text."""
    most = max((n for _, n in rows), default=0) or 1
    return text_table([(label, n, "#" * round(width * n / most)) for label, n in rows])


def summary(df: DataFrame, columns: Sequence[str] = (), bins: int = 30) -> list[dict]:
    """A page for each column that has values: statistics, quantiles and histogram; and one of the missing values."""
    names = [c for c in columns or df.columns]
    stats = {r["column"]: r.asDict() for r in profile.profile(df, names).collect()}
    pages = [{"label": "missing values", "stats": {r["column"]: r["nulls"] for r in profile.null_counts(df.select(*names)).collect()}, "histogram": []}]
    for c in names:
        if not stats[c]["filled"]:
            continue
        kind = kind_of(df, c)
        page = {"label": c, "stats": {k: v for k, v in stats[c].items() if k != "column" and v is not None}}
        if kind == "category":
            rows = [(str(r[0]), r["n"]) for r in relational.top(df, c, bins).collect()]
        else:
            x = df.select((F.unix_micros(F.col(c).cast("timestamp")) / 86_400e6 if kind == "time" else F.col(c)).alias("x"))
            page["stats"] |= {f"p{round(r['p'] * 100):02d}": r["quantile"] for r in profile.quantiles(x, "x", profile.PROBABILITIES).orderBy("p").collect()}
            rows = [(f"[{r['low']:.6g}, {r['high']:.6g})", r["count"]) for r in profile.auto_histogram(df, c, bins).orderBy("bin").collect()]
        pages.append(page | {"histogram": rows})
    return pages


def histogram_pages(hists: Sequence[Histogram]) -> list[dict]:
    """Pages of histograms that are there already: entries, filled bins, range, mode and bars."""
    pages = []
    for h in hists:
        counts = h.filled()
        best = min(counts, key=lambda k: (-counts[k], k))
        stats = {"entries": sum(counts.values()), "bins": h.n_bins, "mode": h.bins.center_of(best) if h.bins else best}
        stats |= {"low": h.range()[0], "high": h.range()[1]} if h.bins else {}
        pages.append({"label": h.variable, "stats": stats, "histogram": [(_show(x), n) for x, n in zip(h.centers(), h.entries(), strict=True)]})
    return pages


def boxplot_stats(df: DataFrame, column: str, by: str, least: int = 400, most: int = 20) -> DataFrame:
    """The profile of a number in the most frequent groups that have enough rows."""
    large = relational.drop_small_groups(df.where(F.col(by).isNotNull()), [by], least)
    chosen = relational.top(large, by, most).select(by)
    return profile.group_profile(large.join(F.broadcast(chosen), by, "left_semi"), column, [by])


def boxplot_limit(df: DataFrame, column: str, p: float = 0.95) -> float | None:
    """Where a box plot's axis ends: a quantile of all values."""
    found = profile.quantiles(df, column, [p]).first()
    return found["quantile"] if found else None


def boxplots(df: DataFrame, column: str, causes: Sequence[str], least: int = 400, most: int = 20, folder: str | None = None) -> list[dict]:
    """For each cause a page of its groups: the statistics, and boxes drawn as text between the 5 % and 95 % quantiles; as
    images too where a folder is given and matplotlib is installed."""
    limit, pages = boxplot_limit(df, column), []
    for by in causes:
        rows = [r.asDict() for r in boxplot_stats(df, column, by, least, most).collect()]
        lo = min((r["p05"] for r in rows), default=0.0)
        hi = max(max((r["p95"] for r in rows), default=1.0), limit or 0.0)
        page = {"label": f"{column} by {by}", "stats": {str(r[by]): box(r, lo, hi) for r in rows}, "histogram": [(str(r[by]), r["count"]) for r in rows], "groups": rows, "limit": limit}
        if folder:
            plot([(str(r[by]), r["p05"], r["p16"], r["p50"], r["p84"], r["p95"]) for r in rows], f"{folder}/{column}_{by}.png", "box", page["label"])
        pages.append(page)
    return pages


def box(r: dict, low: float, high: float, width: int = 40) -> str:
    """|---[==|==]---| between two ends."""
    at = lambda v: min(width - 1, max(0, round((v - low) / ((high - low) or 1) * (width - 1))))
    a, b, m, c, d = (at(r[k]) for k in ("p05", "p16", "p50", "p84", "p95"))
    line = [" "] * width
    line[a : d + 1] = "-" * (d - a + 1)
    line[b : c + 1] = "=" * (c - b + 1)
    line[m] = "|"
    return "".join(line).rstrip()


def heat_rows(matrix: Sequence[tuple]) -> str:
    """A matrix (x, y, value) as a table of text."""
    xs, ys = (sorted({r[k] for r in matrix}) for k in (0, 1))
    found = {(x, y): v for x, y, v in matrix}
    return text_table([[y, *[found.get((x, y)) for x in xs]] for y in ys], ["", *xs])


def correlation_pages(df: DataFrame, methods: Sequence[str], columns: Sequence[str] = (), folder: str | None = None) -> list[dict]:
    """For each method the matrix, its summary and how many different values the columns have. Methods of values without a
    bound (mutual information) have no summary and are refused."""
    if wrong := [m for m in methods if m not in assoc.METHODS or m == "mutual_information"]:
        raise ValueError(f"no summaries of {wrong}")
    names, pages = list(columns) or assoc.numbers(df), []
    distinct = {r["column"]: r["distinct"] for r in profile.profile(df, names).collect()} if names else {}
    for m in methods:
        matrix = assoc.correlations(df, m, columns)
        rows = [tuple(r) for r in matrix.orderBy("x", "y").collect()]
        stats = assoc.correlation_summary(matrix).first().asDict() | {f"different values of {c}": n for c, n in distinct.items()}
        pages.append({"label": m, "stats": stats, "matrix": rows, "histogram": [], "text": heat_rows(rows)})
        if folder:
            plot(rows, f"{folder}/{m}.png", "heat", m)
    return pages


def heat_map_pages(before: dict, after: dict, label: str = "correlations", folder: str | None = None) -> list[dict]:
    """Two matrices (x, y) to value side by side, and their difference."""
    both = {"before": before, "after": after, "difference": {k: None if before[k] is None or after.get(k) is None else after[k] - before[k] for k in before}}
    pages = []
    for name, m in both.items():
        rows = [(x, y, v) for (x, y), v in sorted(m.items())]
        filled = [v for v in m.values() if v is not None]
        pages.append({"label": f"{label} {name}", "stats": {"cells": len(m), "least": min(filled, default=None), "largest": max(filled, default=None)}, "matrix": rows, "histogram": [], "text": heat_rows(rows)})
        if folder:
            plot(rows, f"{folder}/{label}_{name}.png", "heat", f"{label} {name}")
    return pages


def mimic_pages(found: dict | Sequence[dict], original: DataFrame | None = None, sample: DataFrame | None = None, continuous: Sequence[str] = (), bins: int = 20) -> list[dict]:
    """The report of a resampling: tests with p-values, distances of rows and their sources, correlations before and after, and
    each number's histogram before and after over the same bins."""
    tests = found["tests"] if isinstance(found, dict) else found
    pages = [{"label": f"{f['test']} of {', '.join(f['columns'])}", "stats": {"value": f["value"], "dof": f["dof"], "p": f["p"]}, "histogram": []} for f in tests]
    if isinstance(found, dict) and "distance" in found:
        pages.append({"label": "cosine distances", "stats": found["distance"], "histogram": []})
        pages += heat_map_pages(found["before"], found["after"])
    for c in continuous if original is not None and sample is not None else ():
        pages.append(overlay_page(original, sample, c, bins))
    return pages


def overlay_page(a: DataFrame, b: DataFrame, column: str, bins: int = 20, names: tuple[str, str] = ("before", "after")) -> dict:
    """A number's shares in the same bins of two frames."""
    lo, hi = a.agg(F.min(column), F.max(column)).first()
    edges = [lo + (hi - lo) * k / bins for k in range(bins)] + [hi] if lo is not None and hi > lo else [lo or 0.0, (lo or 0.0) + 1.0]
    shares = []
    for d in (a, b):
        rows = profile.auto_histogram(d, column, edges=edges).orderBy("bin").collect()
        total = sum(r["count"] for r in rows) or 1
        shares.append([(r["low"], r["count"] / total, r["count"]) for r in rows])
    rows = [(f"{x[0]:.6g}", x[2], y[2]) for x, y in zip(*shares, strict=True)]
    far = max((abs(x[1] - y[1]) for x, y in zip(*shares, strict=True)), default=0.0)
    return {"label": f"{column} {names[0]} and {names[1]}", "stats": {"largest difference of shares": far}, "histogram": [(r[0], r[1]) for r in rows], "overlay": rows, "text": text_table(rows, ["from", *names])}


def pair_pages(df: DataFrame, columns: Sequence[str], bins: int = 10) -> list[dict]:
    """For each pair of numbers the counts in a grid of equal bins, and for each number its histogram: a grid of pairs as pages."""
    pages = [{"label": c, "stats": {}, "histogram": [(f"{r['low']:.6g}", r["count"]) for r in profile.auto_histogram(df, c, bins).orderBy("bin").collect()]} for c in columns]
    for i, x in enumerate(columns):
        for y in columns[i + 1 :]:
            rows = [(int(r["a"]), int(r["b"]), r["n"]) for r in assoc.contingency(df, x, y, bins).orderBy("a", "b").collect()]
            pages.append({"label": f"{x} against {y}", "stats": {"filled cells": len(rows)}, "matrix": rows, "histogram": [], "text": heat_rows(rows)})
    return pages


def as_text(pages: Sequence[dict]) -> str:
    def one(p: dict) -> str:
        more = p.get("text") or (bars(p["histogram"]) if p["histogram"] else "")
        return f"== {p['label']}\n" + text_table(list(p["stats"].items())) + ("\n" + more if more else "")

    return "\n\n".join(one(p) for p in pages)


def as_latex(pages: Sequence[dict], page: str | None = None, document: str | None = None) -> str:
    """By templates with the places $label, $table and $histogram, and $pages: those of this package, or files of one's own."""
    one, whole = (Template(Path(own or io.template(name)).read_text()) for own, name in ((page, PAGE), (document, DOCUMENT)))
    body = "\n".join(one.substitute(label=p["label"].translate(_SPECIAL), table=latex_table(list(p["stats"].items())), histogram=latex_table(p["histogram"]) if p["histogram"] else "") for p in pages)
    return whole.substitute(pages=body)


def write_report(pages: Sequence[dict], folder: str, name: str = "report") -> list[str]:
    """report.tex and report.txt."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for kind, text in (("tex", as_latex(pages)), ("txt", as_text(pages))):
        (out / f"{name}.{kind}").write_text(text)
    return [str(out / f"{name}.{kind}") for kind in ("tex", "txt")]


def plot(rows: Sequence[tuple], path: str, kind: str = "bar", title: str = "") -> bool:
    """Bars of (label, count), a heat map of (x, y, value), boxes of (label, five quantiles) or two overlaid lines of (label,
    before, after); False where matplotlib isn't installed."""
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return False
    figure = Figure()
    axes = figure.subplots()
    if kind == "heat":
        xs, ys = (sorted({r[k] for r in rows}) for k in (0, 1))
        grid = [[next((r[2] for r in rows if r[0] == x and r[1] == y), 0) for x in xs] for y in ys]
        axes.imshow(grid)
        axes.set_xticks(range(len(xs)), xs)
        axes.set_yticks(range(len(ys)), ys)
    elif kind == "box":
        axes.bxp([dict(zip(("label", "whislo", "q1", "med", "q3", "whishi"), r, strict=True)) for r in rows], showfliers=False)
    elif kind == "overlay":
        for k, name in ((1, "before"), (2, "after")):
            axes.step([str(r[0]) for r in rows], [r[k] for r in rows], label=name)
        axes.legend()
    else:
        axes.bar([str(r[0]) for r in rows], [r[1] for r in rows])
    axes.set_title(title)
    figure.savefig(path)
    return True
