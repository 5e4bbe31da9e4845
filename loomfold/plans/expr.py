"""Panel expressions and their compilation to staged DataFrame projections.

A panel is a long table with one row for each (t_idx, symbol) of a dense grid.
Expressions are trees of five kinds of nodes: ``cell`` (a projection), ``ts``
(a window over one symbol's rows by t_idx), ``xs`` (a window over one date's
rows), ``scan`` (an exponential mean along one symbol's rows) and ``slide`` (a numpy
kernel over a long window of one symbol's rows). Window functions
do not nest in Spark, so the compiler numbers the nodes by depth and adds all
windows of one depth and kind in one projection; equal nodes are computed once,
and windows of one kind in a row share an exchange.

A scan is done by blocks of a symbol's rows. Inside a block a mean is an affine map
of the mean at its first value, a running product and a running sum; the maps of a
symbol's blocks, a row for each block, are applied one after the other, and give
each block the state it starts from. So a symbol's rows need not be one task's, and
the block's size changes no result. A slide is done by blocks too: a block and the one
before it, both at least as long as the window, hold all that its rows need.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sliding import Kernel, over_blocks

SYMBOL, TIME = "symbol", "t_idx"
EPS = 1e-10
#: Rows of a block of a scan, at most; less where the weights of so many rows would leave the range of doubles.
SCAN_ROWS = 256
_LEAST_WEIGHT = 1e-100
#: Rows of a block of a slide, or the longest window where that is more.
SLIDE_ROWS = 1024


def along() -> Any:
    """One symbol's rows by time."""
    return Window.partitionBy(SYMBOL).orderBy(TIME)


def trailing(n: int, lag: int = 0) -> Any:
    """The last ``n`` rows of a symbol, ending ``lag`` rows ago."""
    return along().rowsBetween(-(n + lag - 1), -lag)


def across() -> Any:
    """All rows of a date."""
    return Window.partitionBy(TIME)


@dataclass(frozen=True, eq=False)
class Expr:
    kind: str
    key: tuple
    args: tuple[Expr, ...] = ()
    build: Callable[..., Any] | None = field(default=None, repr=False)

    def __add__(self, other: Any) -> Expr:
        return cell("+", lambda a, b: a + b, self, other)

    def __radd__(self, other: Any) -> Expr:
        return cell("+", lambda a, b: a + b, other, self)

    def __sub__(self, other: Any) -> Expr:
        return cell("-", lambda a, b: a - b, self, other)

    def __rsub__(self, other: Any) -> Expr:
        return cell("-", lambda a, b: a - b, other, self)

    def __mul__(self, other: Any) -> Expr:
        return cell("*", lambda a, b: a * b, self, other)

    def __rmul__(self, other: Any) -> Expr:
        return cell("*", lambda a, b: a * b, other, self)

    def __truediv__(self, other: Any) -> Expr:
        return cell("/", lambda a, b: F.try_divide(a, b), self, other)

    def __rtruediv__(self, other: Any) -> Expr:
        return cell("/", lambda a, b: F.try_divide(a, b), other, self)

    def __neg__(self) -> Expr:
        return cell("neg", lambda a: -a, self)

    def __gt__(self, other: Any) -> Expr:
        return cell(">", lambda a, b: a > b, self, other)

    def __lt__(self, other: Any) -> Expr:
        return cell("<", lambda a, b: a < b, self, other)

    def __ge__(self, other: Any) -> Expr:
        return cell(">=", lambda a, b: a >= b, self, other)

    def __le__(self, other: Any) -> Expr:
        return cell("<=", lambda a, b: a <= b, self, other)

    def __and__(self, other: Any) -> Expr:
        return cell("and", lambda a, b: a & b, self, other)

    def __or__(self, other: Any) -> Expr:
        return cell("or", lambda a, b: a | b, self, other)

    def __invert__(self) -> Expr:
        return cell("not", lambda a: ~a, self)

    def abs(self) -> Expr:
        return cell("abs", F.abs, self)

    def where(self, condition: Expr) -> Expr:
        """This value where the condition holds, else null."""
        return cell("where", lambda c, a: F.when(c, a), condition, self)

    def clip(self, low: float | None = None, high: float | None = None) -> Expr:
        def bound(a: Column) -> Column:
            out = a if low is None else F.greatest(a, F.lit(float(low)))
            out = out if high is None else F.least(out, F.lit(float(high)))
            return F.when(a.isNotNull(), out)

        return cell(("clip", low, high), bound, self)

    def between(self, low: float, high: float) -> Expr:
        return cell(("between", low, high), lambda a: a.between(low, high), self)

    def nullif(self, value: float) -> Expr:
        return cell(("nullif", value), lambda a: F.when(a != value, a), self)

    def fillna(self, value: Any) -> Expr:
        return cell("coalesce", lambda a, b: F.coalesce(a, b), self, value)

    def notnull(self) -> Expr:
        return cell("notnull", lambda a: a.isNotNull(), self)


def col(name: str) -> Expr:
    return Expr("field", ("field", name))


def lit(value: Any) -> Expr:
    value = float(value) if isinstance(value, int) and not isinstance(value, bool) else value
    return Expr("cell", ("lit", value), (), lambda: F.lit(value))


def as_expr(x: Any) -> Expr:
    return x if isinstance(x, Expr) else col(x) if isinstance(x, str) else lit(x)


def _node(kind: str, name: Any, build: Callable[..., Any], *args: Any) -> Expr:
    args = tuple(map(as_expr, args))
    return Expr(kind, (kind, name, *(a.key for a in args)), args, build)


def cell(name: Any, build: Callable[..., Column], *args: Any) -> Expr:
    return _node("cell", name, build, *args)


def ts(name: Any, build: Callable[..., Column], *args: Any) -> Expr:
    return _node("ts", name, build, *args)


def xs(name: Any, build: Callable[..., Column], *args: Any) -> Expr:
    return _node("xs", name, build, *args)


def ewm(x: Any, alpha: float, min_periods: int) -> Expr:
    """Exponential mean without adjustment: through gaps the old weight decays, and the mean is carried on."""
    x = as_expr(x)
    if alpha >= 1:  # nothing older than the last value counts
        value = cell("nan", lambda c: F.nanvl(c.cast("double"), F.lit(None)), x)
        return ts(("last", min_periods), lambda c: F.when(F.count(c).over(_so_far()) >= max(1, min_periods), F.last(c, ignorenulls=True).over(_so_far())), value)
    return Expr("scan", ("scan", alpha, min_periods, x.key), (x,), lambda: (alpha, min_periods))


def slide(name: Any, kernel: Kernel, x: Any, window: int) -> Expr:
    """``kernel`` over the trailing window; see :mod:`.sliding`."""
    x = as_expr(x)
    return Expr("slide", ("slide", name, window, x.key), (x,), lambda: (kernel, window))


def _so_far() -> Any:
    return along().rowsBetween(Window.unboundedPreceding, 0)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often and deep in lambdas it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def eps_guard(x: Any) -> Expr:
    """Null where the absolute value is under 1e-10."""
    return cell("eps", lambda a: F.when(F.abs(a) >= EPS, a), x)


def compile_exprs(panel: DataFrame, outputs: dict[str, Any], date_tasks: int | None = None) -> DataFrame:
    """``panel`` with a column for each of ``outputs``.

    Each rank over a date sorts its rows once more in the same task; ``date_tasks`` deals the
    dates to so many tasks first, where a plan has many ranks, else Spark pools small ones.
    """
    outputs = {k: as_expr(v) for k, v in outputs.items()}
    depth: dict[tuple, int] = {}
    nodes: dict[tuple, Expr] = {}

    def number(e: Expr) -> int:
        if e.key not in depth:
            below = max((number(a) for a in e.args), default=0)
            depth[e.key] = below + (e.kind in ("ts", "xs", "scan", "slide"))
            if e.kind in ("ts", "xs", "scan", "slide"):
                nodes[e.key] = e
        return depth[e.key]

    for e in outputs.values():
        number(e)
    names = {k: f"_x{i}" for i, k in enumerate(nodes)}

    def column(e: Expr) -> Column:
        if e.kind == "field":
            return F.col(e.key[1])
        if e.key in names:
            return F.col(names[e.key])
        return e.build(*map(column, e.args))

    for level in range(1, max(depth.values(), default=0) + 1):
        now = [e for k, e in nodes.items() if depth[k] == level]
        scans = {names[e.key]: (column(e.args[0]), *e.build()) for e in now if e.kind == "scan"}
        panel = _scanned(panel, scans) if scans else panel
        slides = {names[e.key]: (column(e.args[0]), *e.build()) for e in now if e.kind == "slide"}
        panel = _slid(panel, slides) if slides else panel
        for kind in ("ts", "xs"):
            windows = {names[e.key]: e.build(*map(column, e.args)) for e in now if e.kind == kind}
            panel = panel.repartition(date_tasks, TIME) if windows and kind == "xs" and date_tasks else panel
            panel = panel.withColumns(windows) if windows else panel
    panel = panel.withColumns({k: column(e) for k, e in outputs.items()})
    return panel.drop(*names.values())


def _scanned(panel: DataFrame, means: dict[str, tuple[Column, float, int]]) -> DataFrame:
    """``panel`` with exponential means (value, alpha, min_periods) of one depth."""
    rows = min(SCAN_ROWS, *(max(1, int(math.log(_LEAST_WEIGHT) / math.log1p(-alpha))) for _, alpha, _ in means.values()))
    block = Window.partitionBy(SYMBOL, "_block").orderBy(TIME)
    upto, before = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(Window.unboundedPreceding, -1)
    alphas = {n: alpha for n, (_, alpha, _) in means.items()}
    df = panel.withColumns({n: F.nanvl(x.cast("double"), F.lit(None)) for n, (x, _, _) in means.items()} | {"_block": F.floor(F.col(TIME) / rows).cast("int")})

    def decay(gap: Column, alpha: float) -> Column:
        return F.pow(F.lit(1 - alpha), gap)

    # in a block, from its first value on: the weight of that value's mean, and what later values add, by that weight
    seen = {n: F.when(F.col(n).isNotNull(), F.col(TIME).cast("bigint")) for n in means}
    df = df.withColumns({f"{n}_d": F.when(F.col(n).isNotNull(), decay(F.col(TIME) - F.last(seen[n], ignorenulls=True).over(before), a)) for n, a in alphas.items()})
    df = df.withColumns({f"{n}_w": F.product(F.coalesce(F.col(f"{n}_d") / (F.col(f"{n}_d") + a), F.lit(1.0))).over(upto) for n, a in alphas.items()})
    added = {f"{n}_s": F.coalesce(F.sum(a * F.col(n) / (F.col(f"{n}_d") + a) / F.col(f"{n}_w")).over(upto), F.lit(0.0)) for n, a in alphas.items()}
    df = df.withColumns(added | {f"{n}_n": F.count(n).over(upto) for n in means})

    # a row for each block, with its own rows, and the state that those before it lead to
    def end(n: str) -> Column:
        parts = {"first": F.min(seen[n]), "last": F.max(seen[n]), "x": F.min_by(n, seen[n]), "w": F.max_by(f"{n}_w", TIME), "s": F.max_by(f"{n}_s", TIME), "n": F.count(n)}
        return F.struct(*(c.alias(k) for k, c in parts.items())).alias(n)

    def first_mean(state: Column, end: Column, alpha: float) -> Column:
        d = decay(end["first"] - state["last"], alpha)
        return F.when(state["mean"].isNull(), end["x"]).otherwise((d * state["mean"] + alpha * end["x"]) / (d + alpha))

    def advance(alpha: float) -> Callable[[Column, Column], Column]:
        def step(state: Column, end: Column) -> Column:
            mean = end["w"] * (first_mean(state, end, alpha) + end["s"])
            return F.when(end["n"] == 0, state).otherwise(F.struct(mean.alias("mean"), end["last"].alias("last"), (state["n"] + end["n"]).alias("n")))

        return step

    own = [*panel.columns, *(f"{n}_{k}" for n in means for k in "wsn")]
    nothing = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(None).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n"))
    earlier = Window.partitionBy(SYMBOL).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(SYMBOL, "_block").agg(F.collect_list(F.struct(*own)).alias("_rows"), *map(end, means))
    blocks = blocks.withColumn("_ends", F.collect_list(F.struct(*means)).over(earlier))
    blocks = blocks.withColumns({f"{n}_at": F.aggregate(f"_ends.{n}", nothing, advance(a)) for n, a in alphas.items()})
    blocks = blocks.select("_rows", *(F.struct(F.col(f"{n}_at.mean"), F.col(f"{n}_at.n"), F.col(f"{n}.first"), first_mean(F.col(f"{n}_at"), F.col(n), a).alias("first_mean")).alias(f"{n}_at") for n, a in alphas.items()))
    df = blocks.select(F.explode("_rows").alias("_row"), *(f"{n}_at" for n in means)).select("_row.*", *(f"{n}_at" for n in means))

    def mean_at(n: str, least: int) -> Column:
        at = F.col(f"{n}_at")
        mean = F.when(F.col(TIME) >= at["first"], F.col(f"{n}_w") * (at["first_mean"] + F.col(f"{n}_s"))).otherwise(at["mean"])
        return F.when(at["n"] + F.col(f"{n}_n") >= max(1, least), mean)

    return df.select(*panel.columns, *(mean_at(n, least).alias(n) for n, (_, _, least) in means.items()))


def _slid(panel: DataFrame, slides: dict[str, tuple[Column, Kernel, int]]) -> DataFrame:
    """``panel`` with kernels (value, kernel, window) of one depth; only their values leave the JVM, in blocks."""
    rows = max(SLIDE_ROWS, *(n for _, _, n in slides.values()))
    df = panel.withColumns({k: F.nanvl(x.cast("double"), F.lit(None)) for k, (x, _, _) in slides.items()})
    df = df.withColumn("_block", F.floor((F.row_number().over(along()) - 1) / rows).cast("int"))
    held = F.struct(F.col(TIME).alias("_at"), F.struct(*panel.columns).alias("row"), *slides)
    blocks = df.groupBy(SYMBOL, "_block").agg(F.sort_array(F.collect_list(held)).alias("_rows"))
    blocks = blocks.withColumns({k: F.col(f"_rows.{k}") for k in slides})
    blocks = blocks.withColumns({f"{k}_before": F.lag(k).over(Window.partitionBy(SYMBOL).orderBy("_block")) for k in slides})
    blocks = blocks.select(F.col("_rows.row").alias("row"), *(over_blocks(kernel, n)(f"{k}_before", k).alias(k) for k, (_, kernel, n) in slides.items()))
    return blocks.select(F.explode(F.arrays_zip("row", *slides)).alias("_row")).select("_row.row.*", *(f"_row.{k}" for k in slides))
