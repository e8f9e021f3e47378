"""Window primitives over a panel: every function takes the keys and the order it works in."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10
#: A block of the exponential filter is so long that weights grow by no more than e ** EWM_GROWTH in it, far from overflow.
EWM_GROWTH, EWM_LONGEST = 500, 4096


def over(by: str | list[str] = "stock", order: str = "d"):
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def finite(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log_ratio(a: Column, b: Column) -> Column:
    return log(ratio(a, b))


def lag(x: Column, n: int, w) -> Column:
    return F.lag(x, n).over(w)


def diff(x: Column, w, n: int = 1) -> Column:
    return x - lag(x, n, w)


def pct_change(x: Column, w, n: int = 1) -> Column:
    return ratio(x, lag(x, n, w)) - 1


def rolling(function, x: Column, n: int, w) -> Column:
    """An aggregate over the last n rows, NULL unless all n are non-null."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, function(x).over(frame))


def mean(x, n, w):
    return rolling(F.avg, x, n, w)


def std(x, n, w):
    return rolling(F.stddev_samp, x, n, w)


def forward_fill(x: Column, w) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running(function, x: Column, w) -> Column:
    return function(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def pct_rank(x: Column, by: list[str]) -> Column:
    """Average rank / number of non-null values within the group, NULL for NULL."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*by)))


def ewm(df: DataFrame, specs: dict[str, tuple[str, float, int]], by: str | list[str] = "stock", order: str = "d") -> DataFrame:
    """Exponential moving averages without adjustment: y0 = x0, y = (1 - a) y' + a x.

    ``specs``: new column -> (column, a, least observations). Leading NULLs are no
    observations; a NULL between others is not expected and stays NULL.

    A row's value is the weighted sum of its block of observations up to it, by a scaled
    prefix sum, plus the decayed value at the end of the block before. That value is the
    same sum over the blocks before; their weights fall by (1 - a) ** block, so one or two
    of them give every bit of a double. Windows only, linear in the rows.
    """
    fastest = max((a for _, a, _ in specs.values() if a < 1), default=0.5)
    block_rows = max(1, min(EWM_LONGEST, int(EWM_GROWTH / -math.log(1 - fastest))))
    by = [by] if isinstance(by, str) else by
    w = over(by, order)
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    kept = df.columns
    inputs = dict.fromkeys(x for x, *_ in specs.values())
    df = df.select("*", *[(F.count(x).over(upto) - 1).alias(f"__n_{x}") for x in inputs])
    place = {x: F.col(f"__n_{x}") % block_rows for x in inputs}

    def local(x: str, a: float) -> Column:
        weight = F.when(F.col(f"__n_{x}") == 0, F.lit(1.0)).otherwise(F.lit(a))
        block = Window.partitionBy(*by, F.floor(F.col(f"__n_{x}") / block_rows)).orderBy(order)
        summed = F.sum(F.col(x) * weight * F.pow(F.lit(1 - a), -place[x])).over(block.rowsBetween(Window.unboundedPreceding, 0))
        return summed * F.pow(F.lit(1 - a), place[x])

    df = df.select("*", *[local(x, a).alias(f"__local_{out}") for out, (x, a, _) in specs.items()])
    ends = {out: F.when((place[x] == block_rows - 1) & F.col(x).isNotNull(), F.col(f"__local_{out}")) for out, (x, *_) in specs.items()}
    before = lambda out: F.coalesce(F.last(f"__end_{out}", ignorenulls=True).over(earlier), F.lit(0.0))
    rest = df.columns
    df = df.select("*", *[ends[out].alias(f"__end_{out}") for out in specs])
    rounds = max(math.ceil(math.log(1e-20) / (block_rows * math.log(1 - a))) if 0 < a < 1 else 1 for _, a, _ in specs.values())
    for _ in range(rounds):
        df = df.select(*rest, *[(ends[out] + before(out) * (1 - a) ** block_rows).alias(f"__end_{out}") for out, (_, a, _) in specs.items()])
    columns = []
    for out, (x, a, least) in specs.items():
        y = F.col(f"__local_{out}") + before(out) * F.pow(F.lit(1 - a), place[x] + 1)
        columns.append(F.when(F.col(x).isNotNull() & (F.col(f"__n_{x}") + 1 >= least), y).alias(out))
    return df.select(*kept, *columns)
