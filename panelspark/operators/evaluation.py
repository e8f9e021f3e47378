"""Walk-forward folds and the metrics of probability forecasts, for any grouping at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import windows as W
from panelspark.functions.ranks import sums_before
from panelspark.sources.io import stored


def date_index(rows: DataFrame) -> DataFrame:
    """Each distinct day with its place, from 0."""
    return rows.select("d").distinct().withColumn("i", F.row_number().over(Window.orderBy("d")) - 1)


def fold_bounds(rows: DataFrame, horizon: int, folds: int = 4, test: float = 0.15, start: float = 0.45) -> DataFrame:
    """One row a fold, the test block as fold -1: first and last place that is evaluated, and the
    place that training rows stay before, ``horizon`` days earlier."""
    n = rows.select("d").distinct().agg(F.count(F.lit(1)).cast("double").alias("n"))
    n = n.select(F.col("n").cast("int").alias("n"), F.floor(F.col("n") * (1 - test)).cast("int").alias("test_start"), F.floor(F.col("n") * start).cast("int").alias("cv_start"))
    n = n.withColumn("size", F.floor((F.col("test_start") - horizon - F.col("cv_start")) / folds).cast("int"))
    k = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    first = F.col("cv_start") + F.col("fold") * F.col("size")
    validation = k.select("fold", first.alias("first"), (first + F.col("size") - 1).alias("last"))
    tested = n.select(F.lit(-1).alias("fold"), F.col("test_start").alias("first"), (F.col("n") - 1).alias("last"))
    return validation.unionByName(tested).withColumn("train_before", F.greatest(F.col("first") - horizon, F.lit(0)))


def fold_roles(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every row with each fold and role (train, evaluate) that it has there; a few folds meet every row."""
    placed = rows.join(F.broadcast(date_index(rows)), "d")
    meets = (F.col("i") < F.col("train_before")) | F.col("i").between(F.col("first"), F.col("last"))
    role = F.when(F.col("i") < F.col("train_before"), "train").otherwise("evaluate")
    return placed.join(F.broadcast(bounds), meets).select(*rows.columns, "fold", role.alias("role"))


def split_integrity(rows: DataFrame, bounds: DataFrame, embargo: int) -> DataFrame:
    """For each fold the days strictly between the last training and the first evaluated day."""
    used = fold_roles(rows, bounds).groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("d"))).alias("last_train"),
        F.min(F.when(F.col("role") == "evaluate", F.col("d"))).alias("first_eval"),
    )
    days = rows.select("d").distinct()
    between = F.broadcast(used).join(days, (F.col("d") > F.col("last_train")) & (F.col("d") < F.col("first_eval")), "left")
    gaps = between.groupBy("fold").agg(F.count("d").alias("gap"))
    return gaps.withColumn("ok", F.col("gap") >= embargo - 1)


def auc(rows: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """ROC AUC of each group, ties counted half: from the counts at each distinct score, summed by ranges of scores."""
    counts = rows.groupBy(*by, p).agg(F.sum(y).cast("double").alias("n1"), F.sum(1 - F.col(y)).cast("double").alias("n0"))
    placed = sums_before(counts, by, p, ["n0"])
    summed = placed.withColumn("won", F.col("n1") * (F.col("before_n0") + F.col("n0") / 2)).groupBy(*by)
    return summed.agg(F.try_divide(F.sum("won"), F.sum("n1") * F.sum("n0")).alias("roc_auc"))


def evaluate(rows: DataFrame, by: list[str], up_signal: float = 60.0) -> DataFrame:
    """All metrics of forecasts p of outcomes y (0 or 1), per group; a forecast says UP if it
    reaches the median of its group's day."""
    middle = rows.groupBy(*by, "d").agg(F.median("p").alias("__median"))
    x = rows.join(middle, [*by, "d"]).withColumn("__pct", W.pct_rank(F.col("p"), [*by, "d"]) * 100)
    y, up = F.col("y"), F.col("p") >= F.col("__median")
    hit = lambda a, b: F.sum(F.when((y == a) & (up == F.lit(bool(b))), 1.0).otherwise(0.0))
    p = F.least(F.greatest(F.col("p"), F.lit(2.220446049250313e-16)), F.lit(1 - 2.220446049250313e-16))
    sums = x.groupBy(*by).agg(
        hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"),
        F.avg(F.when(F.col("__pct") >= up_signal, y)).alias("up_signal_precision"),
        F.avg(F.when(F.col("__pct") >= 80, y)).alias("up_rate_top_quintile"),
        F.avg(F.when(F.col("__pct") <= 20, y)).alias("up_rate_bottom_quintile"),
        F.avg(y).alias("up_rate"),
        (-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
        F.avg(F.pow(F.col("p") - y, F.lit(2.0))).alias("brier_score"),
        F.count(F.lit(1)).alias("n"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = sums.select(
        *by, "n",
        ((tp + tn) / F.col("n")).alias("directional_accuracy"),
        ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "up_signal_precision", "up_rate_top_quintile", "up_rate_bottom_quintile", "up_rate",
        F.greatest(F.col("up_rate"), 1 - F.col("up_rate")).alias("majority_baseline_accuracy"),
        "log_loss", "brier_score", F.sqrt("brier_score").alias("rmse_probability"),
    )
    return out.join(auc(rows, by), by)


def mid_ranks(rows: DataFrame, reference: DataFrame, near: float = 1e-4, relative: float = 1e-5) -> DataFrame:
    """``rows`` with pct: the share (in per cent) of the reference's p below theirs, near ties counted half.

    Both tables are put in one order of p: running counts of the reference up to the lower and up
    to the upper edge of each row's tolerance give the two numbers. No row meets every reference row.
    """
    names = rows.columns
    rows = stored(rows.select("*", F.monotonically_increasing_id().alias("__row")), "ranked-forecasts")  # a row that repeats stays two
    width = near + relative * F.abs("p")
    edge = lambda value, kind: rows.select(*rows.columns, value.alias("__at"), F.lit(kind).alias("__kind"))
    # at equal places the lower edge comes before reference values, the upper one after them
    marks = edge(F.col("p") - width, 0).unionByName(edge(F.col("p") + width, 2))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in rows.dtypes]
    all_ = marks.unionByName(reference.select(*nothing, F.col("p").alias("__at"), F.lit(1).alias("__kind")))
    counts = all_.groupBy("__at", "__kind").agg(F.sum((F.col("__kind") == 1).cast("long")).alias("__n"))
    counts = counts.withColumn("__place", F.struct("__at", "__kind"))
    placed = sums_before(counts.select("__place", "__n"), [], "__place", ["__n"])
    found = marks.withColumn("__place", F.struct("__at", "__kind")).join(placed.drop("__n"), "__place")
    total = reference.agg(F.count(F.lit(1)).alias("__total"))
    both = found.groupBy(*rows.columns).agg(
        F.max(F.when(F.col("__kind") == 0, F.col("before___n"))).alias("__below"), F.max(F.when(F.col("__kind") == 2, F.col("before___n"))).alias("__upto")
    )
    share = (F.col("__below") + F.col("__upto")) / 2 / F.col("__total") * 100
    return both.join(F.broadcast(total), F.lit(True)).select(*names, share.alias("pct"))


#: The columns of a report on forecasts.
METRICS = ["roc_auc", "directional_accuracy", "balanced_accuracy", "precision", "recall", "f1", "up_signal_precision", "up_rate_top_quintile",
           "up_rate_bottom_quintile", "up_rate", "majority_baseline_accuracy", "log_loss", "brier_score", "rmse_probability"]
