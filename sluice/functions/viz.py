"""What plots need, worked out in Spark; drawing is left to matplotlib if present.

Every function gives a bounded table for the driver: bins, a matrix, or a seeded
sample of points. Nothing here gathers a whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans import values as V
from sluice.plans.frame import Frame
from sluice.plans.values import PipeError

POINTS = 10_000  # points of a scatter or line plot, by hash where there are more


def histogram(f: Frame, column: str, bins: int = 10) -> list[dict]:
    """Equal bins between least and greatest value; the last one is closed."""
    x = F.col(f"`{column}`").cast("double")
    sound = x.isNotNull() & ~F.isnan(x)
    data = f.data.filter(sound)
    lo, hi = data.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return []
    width = (hi - lo) / bins if hi > lo else 1.0
    at = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    counts = {r["b"]: r["n"] for r in data.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return [{"bin": b, "low": lo + b * width, "high": lo + (b + 1) * width, "n": counts.get(b, 0)} for b in range(bins)]


def correlations(f: Frame) -> dict[str, dict[str, float]]:
    """Pearson matrix of the numeric columns, in one aggregate."""
    names = [n for n, k in f.kinds().items() if isinstance(k, (*V.INTS, *V.REALS))]
    if not names:
        raise PipeError("no numeric columns")
    col = lambda n: F.col(f"`{n}`").cast("double")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = f.data.agg(*[F.corr(col(a), col(b)) for a, b in pairs]).first()
    out: dict = {n: {} for n in names}
    for (a, b), v in zip(pairs, row):
        out[a][b] = out[b][a] = v
    return out


def points(f: Frame, columns: list[str], most: int = POINTS) -> list[dict]:
    """Rows for scatter and line plots, at most ``most`` of them: a plot's points
    are all on the driver."""
    for c in columns:
        if c not in f.columns:
            raise PipeError(f"no field {c}")
    df = f.data.select(*[F.col(f"`{c}`") for c in columns])
    rows = df.orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in columns])).limit(most)
    return [r.asDict() for r in rows.collect()]


def series(f: Frame, x: str, y: str, *more: str, most: int = POINTS) -> list[dict]:
    return sorted(points(f, [x, y, *more], most), key=lambda r: (r[x] is None, r[x]))


def draw(kind: str, data, path: str | None, **settings):
    """Draw with matplotlib if there is one; else give the data back."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return {"kind": kind, "data": data, "settings": settings, "path": None}
    size, display = settings.get("size"), settings.get("display") or {}
    display = display if isinstance(display, dict) else dict.fromkeys(display, True)
    fig, ax = plt.subplots(figsize=tuple(size) if isinstance(size, list) and len(size) == 2 else None)
    if kind == "histogram":
        ax.bar([b["low"] for b in data], [b["n"] for b in data], width=[b["high"] - b["low"] for b in data], align="edge")
    elif kind == "heatmap":
        names = list(data)
        ax.imshow([[data[a][b] for b in names] for a in names])
    else:
        xs, ys, color, dots = settings["x"], settings["y"], settings.get("color"), display.get("dotsize")
        for value in sorted({r[color] for r in data}, key=str) if color else [None]:
            own = [r for r in data if not color or r[color] == value]
            s = [r[dots] for r in own] if isinstance(dots, str) else dots
            if kind == "scatter" or dots is not None:
                ax.scatter([r[xs] for r in own], [r[ys] for r in own], s=s, alpha=0.7, label=str(value) if color else None)
            if kind != "scatter":
                ax.plot([r[xs] for r in own], [r[ys] for r in own], label=str(value) if color and dots is None else None)
        label = display.get("label") if isinstance(display.get("label"), str) else settings.get("label") if display.get("label") else None
        for r in data if label else []:
            if r[label] is not None and r[label] == r[label]:
                ax.annotate(str(r[label]), (r[xs], r[ys]), textcoords="offset points", xytext=(5, 5), fontsize=8)
        if display.get("axes"):
            ax.set_xlabel(xs)
            ax.set_ylabel(ys)
        if color and display.get("legend"):
            ax.legend()
    title = display.get("title") if isinstance(display.get("title"), str) else settings.get("title")
    if title:
        ax.set_title(title)
    if path:
        fig.savefig(path)
    plt.close(fig)
    return {"kind": kind, "data": data, "settings": settings, "path": path}


def step(kind: str, f: Frame, named: dict):
    """The artifact of a viz step."""
    path = named.pop("file", None) or named.pop("path", None)
    if kind == "histogram":
        data = histogram(f, named.get("x") or named.get("on"), int(named.get("bins", 10)))
    elif kind == "heatmap":
        data = correlations(f)
    elif kind in ("scatter", "line", "plot"):
        need = [named[k] for k in ("x", "y") if k in named]
        if len(need) != 2:
            raise PipeError(f"viz.{kind} needs x and y")
        display = named.get("display") if isinstance(named.get("display"), dict) else {}
        more = [named.get("color"), named.get("label"), display.get("label"), display.get("dotsize")]
        extra = [c for c in dict.fromkeys(more) if isinstance(c, str) and c in f.columns and c not in need]
        most = int(named.pop("points", POINTS))
        data = points(f, [*need, *extra], most) if kind == "scatter" else series(f, *need, *extra, most=most)
    elif kind == "grid":
        numeric = [n for n, k in f.kinds().items() if isinstance(k, (*V.INTS, *V.REALS)) and not isinstance(k, T.BooleanType)]
        return {"kind": "grid", "data": {n: histogram(f, n) for n in numeric}, "settings": named, "path": None}
    else:
        raise PipeError(f"viz has no {kind}")
    return draw(kind, data, path, **named)
