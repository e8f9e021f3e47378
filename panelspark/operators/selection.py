"""Feature selection and look-ahead checks over many features at once, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import windows as W
from panelspark.functions.ranks import medians, sums_before, value_ranks
from panelspark.operators.evaluation import auc
from panelspark.sources.io import ensure_checkpoints, stored

#: Parts of names that speak of the future.
FORBIDDEN = "(?i)target|future|forward|fwd|next_|label"


def long_form(frame: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, x: one row for each value, missing ones too."""
    wide = frame.select(*keys, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    return wide.unpivot(keys, features, "feature", "x")


def seeded_sample(rows: DataFrame, by: list[str], keys: list[str], n: int, seed: int = 42, salts: int = 32) -> DataFrame:
    """``n`` rows of each group, all where there are no more: those with the least hash of seed and keys.

    The least of parts of a group are found first, so no task orders a whole group; which rows they
    are depends on keys and seed alone. Rows with equal keys are ordered by nothing else.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    x = rows.withColumn("__hash", F.md5(text)).withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    some = F.row_number().over(Window.partitionBy(*by, "__salt").orderBy("__hash"))
    x = x.withColumn("__turn", some).where(F.col("__turn") <= n)
    last = F.row_number().over(Window.partitionBy(*by).orderBy("__hash"))
    return x.withColumn("__turn", last).where(F.col("__turn") <= n).drop("__hash", "__salt", "__turn")


def low_coverage(long: DataFrame, most_missing: float = 0.5) -> DataFrame:
    share = long.groupBy("feature").agg(F.avg(F.col("x").isNull().cast("double")).alias("missing"))
    return share.where(F.col("missing") > most_missing)


def near_constant(long: DataFrame, most: float = 0.99) -> DataFrame:
    """Features whose commonest value holds more than ``most`` of the non-missing ones, or that have one value."""
    counts = long.where("x is not null").groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), (F.max("n") / F.sum("n")).alias("top_share"))
    return top.where((F.col("values") <= 1) | (F.col("top_share") > most))


def correlation(a, b):
    """Pearson's correlation, NULL where a side doesn't vary."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-12, F.covar_pop(a, b) / spread)


def gap_classes(wide: DataFrame, features: list[str]) -> dict[str, int]:
    """Of each feature (a column f<place> of ``wide``) the class of those that are missing in the same rows.

    Features whose gaps have one sum of row hashes may share them, which is checked on the rows.
    """
    column = {f: F.col(f"f{i}") for i, f in enumerate(features)}
    gap = lambda f: F.sum(F.when(column[f].isNull(), F.xxhash64("row").cast("decimal(20,0)")))
    sums = wide.agg(*[gap(f).alias(f"f{i}") for i, f in enumerate(features)]).first()
    alike: dict = {}
    for f, total in zip(features, sums, strict=True):
        alike.setdefault(total, []).append(f)
    pairs = [(fs[0], f) for fs in alike.values() for f in fs[1:]]
    unlike = wide.agg(*[F.bool_or(column[a].isNull() != column[b].isNull()).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    same = {b: a for (a, b), differs in zip(pairs, unlike, strict=True) if not differs}
    firsts = [f for f in features if f not in same]
    return {f: firsts.index(same.get(f, f)) for f in features}


def spearman(frame: DataFrame, features: list[str], chunk: int = 1000) -> DataFrame:
    """a, b, rho of every pair of features a < b, each over the rows that have both; null where there
    are none or a side doesn't vary.

    Beside every value stands a mask: which other features, told apart by where they are missing,
    its row has. Each feature is ordered once, by ranges of its values; running sums of the
    masks are the ranks of a value among the rows that any other feature has. A row then
    carries for each feature one rank a class of gaps, and all pairs come out of wide aggregates.
    """
    features = sorted(features)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    found = frame.sparkSession.createDataFrame([], "a string, b string, rho double")
    if not pairs:
        return found
    columns = [F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")).alias(f"f{i}") for i, f in enumerate(features)]
    wide = stored(frame.select(F.monotonically_increasing_id().alias("row"), *columns), "ranked-rows")
    of = gap_classes(wide, features)
    classes = max(of.values()) + 1
    first = [next(i for i, f in enumerate(features) if of[f] == k) for k in range(classes)]
    masked = wide.select("row", *[F.col(f"f{i}").isNotNull().cast("long").alias(f"m{k}") for k, i in enumerate(first)], *[f"f{i}" for i in range(len(features))])
    masks = [f"m{k}" for k in range(classes)]
    long = masked.unpivot(["row", *masks], [f"f{i}" for i in range(len(features))], "feature", "x").where("x is not null")
    counts = long.groupBy("feature", "x").agg(*[F.sum(m).alias(m) for m in masks], F.count(F.lit(1)).alias("n"))
    placed = sums_before(counts, ["feature"], "x", masks)
    rank = F.array(*[F.col(f"before_{m}") + (F.col(m) + 1) / 2 for m in masks])
    sizes = placed.groupBy("feature").agg(F.sum("n").alias("total"))  # a row for each feature
    ranked = join_values(long.select("row", "feature", "x"), placed.select("feature", "x", "n", rank.alias("rank")).join(F.broadcast(sizes), "feature"))
    ranks = stored(ranked.groupBy("row").agg(*[F.max(F.when(F.col("feature") == f"f{i}", F.col("rank"))).alias(f"f{i}") for i in range(len(features))]), "ranks")

    place = {f: i for i, f in enumerate(features)}
    for at in range(0, len(pairs), chunk):
        some = pairs[at : at + chunk]
        values = []
        for i, (a, b) in enumerate(some):
            x, y = F.col(f"f{place[a]}"), F.col(f"f{place[b]}")
            values.append(correlation(F.when(y.isNotNull(), x[of[b]]), F.when(x.isNotNull(), y[of[a]])).alias(f"p{i}"))
        one = ranks.agg(*values)
        rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("rho")) for i, (a, b) in enumerate(some)])
        found = found.unionByName(one.select(F.inline(rows)))
    return found


def join_values(long: DataFrame, ranks: DataFrame) -> DataFrame:
    """``long`` (feature, x and more) with the rank of each value.

    A value that holds a hundredth of its feature's rows is broadcast: there are at most a
    hundred of them for each feature, or side of a pair where pairs are ranked.
    """
    often = (F.col("n") * 100 >= F.col("total")) & (F.col("n") > 1000)
    common = F.broadcast(ranks.where(often).select("feature", "x", F.col("rank").alias("common")))
    marked = long.join(common, ["feature", "x"], "left")
    rest = marked.where("common is null").drop("common").join(ranks.where(~often).select("feature", "x", "rank"), ["feature", "x"])
    return marked.where("common is not null").withColumnRenamed("common", "rank").unionByName(rest)


def long_ranks(long: DataFrame) -> DataFrame:
    """``long`` without missing values, with the rank of x among its feature's values."""
    held = stored(long.where("x is not null"), "ranked-values")
    return join_values(held, value_ranks(held, ["feature"], "x"))


def target_correlation(long: DataFrame) -> DataFrame:
    """feature, rho: rank correlation of x with the outcome y over the rows that have x."""
    x = stored(long.where("x is not null"), "correlated-values")
    of_y = value_ranks(x, ["feature"], "y").select("feature", "y", F.col("rank").alias("ry"))  # a row for each outcome of a feature
    # y is an outcome with few values; where it is continuous Spark joins as the sizes ask for
    ranked = long_ranks(x).withColumnRenamed("rank", "rx").join(of_y, ["feature", "y"])
    return ranked.groupBy("feature").agg(correlation("rx", "ry").alias("rho"))


def duplicates(pairs: DataFrame, order: list[str], threshold: float = 0.999) -> DataFrame:
    """feature, of: features to drop as copies of an earlier one that stays, in the order of candidates.

    A feature whose earlier copies are all dropped stays; that is settled for all that have
    no open earlier copy, and again until nothing is open. Pairs of features are few.
    """
    place = F.create_map(*[y for i, f in enumerate(order) for y in (F.lit(f), F.lit(i))])
    close = pairs.where(F.abs("rho") >= threshold).select("a", "b")
    both = close.union(close.select("b", "a")).toDF("a", "b").where(place[F.col("a")] < place[F.col("b")])
    edges = [(r["a"], r["b"]) for r in both.orderBy(place[F.col("b")], place[F.col("a")]).collect()]  # of features
    dropped: dict[str, str] = {}
    for f in order:
        for a, b in edges:
            if b == f and a not in dropped:
                dropped.setdefault(b, a)
    return pairs.sparkSession.createDataFrame(list(dropped.items()), "feature string, of string")


def clusters(pairs: DataFrame, features: DataFrame, threshold: float = 0.90) -> DataFrame:
    """feature, cluster (its smallest member): components of |rho| >= threshold.

    Labels spread along the pairs until none changes; each round is a join and a minimum.
    """
    ensure_checkpoints(pairs.sparkSession)
    a, b = (features.select(F.col("feature").alias(x)) for x in "ab")
    close = pairs.where(F.abs("rho") >= threshold).select("a", "b").join(a, "a", "left_semi").join(b, "b", "left_semi")
    edges = close.union(close.select("b", "a")).toDF("a", "b").checkpoint()
    labels = features.select("feature", F.col("feature").alias("cluster")).checkpoint()
    while True:
        near = edges.join(labels, edges["b"] == labels["feature"]).select(F.col("a").alias("feature"), "cluster")
        after = labels.union(near).groupBy("feature").agg(F.min("cluster").alias("cluster")).checkpoint()
        if after.exceptAll(labels).isEmpty():
            return after
        labels = after


def mutual_information(long: DataFrame, y: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """feature, mi: mutual information of a 0/1 outcome and the feature's quantile bin, the median for missing
    ones; null for a feature without any value."""
    middle = medians(long, ["feature"], "x").select("feature", "middle")  # a row for each feature
    filled = long.join(F.broadcast(middle), "feature").select(*keys, "feature", F.coalesce("x", "middle").alias("x")).join(y, keys)
    binned = long_ranks(filled).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("rank") * bins)))
    cell = binned.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    row, column = F.sum("n").over(Window.partitionBy("feature", "bin")), F.sum("n").over(Window.partitionBy("feature", "y"))
    part = cell.select("feature", (F.col("n") / total * F.ln(F.col("n") * total / (row * column))).alias("part"))
    return middle.select("feature").join(part.groupBy("feature").agg(F.sum("part").alias("mi")), "feature", "left")


def single_feature_auc(long: DataFrame, y: DataFrame, keys: list[str], least: int = 1000) -> DataFrame:
    """feature, roc_auc of each feature by itself, of those with over ``least`` values and both outcomes."""
    rows = long.where("x is not null").join(y, keys)
    counts = rows.groupBy("feature", "x").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    placed = sums_before(counts, ["feature"], "x", ["n0"])
    won = F.sum(F.col("n1") * (F.col("before_n0") + F.col("n0") / 2))
    summed = placed.groupBy("feature").agg(won.alias("won"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    enough = (F.col("n1") + F.col("n0") > least) & (F.col("n1") > 0) & (F.col("n0") > 0)
    return summed.where(enough).select("feature", (F.col("won") / (F.col("n1") * F.col("n0"))).alias("roc_auc"))


def drop_invalid(features: DataFrame, reasons: DataFrame) -> DataFrame:
    """The features that no row of ``reasons`` (feature, reason) names."""
    return features.join(reasons.select("feature").distinct(), "feature", "left_anti")


def is_harmful() -> Column:
    """Shuffling the feature helps on the whole, and hurts in a quarter of the folds at most."""
    return (F.col("permutation") < 0) & (F.col("positive_folds") <= 0.25)


def votes(importances: DataFrame, methods: list[str], least: int = 2) -> DataFrame:
    """Each method's percentile, how many put the feature in the upper half, and whether it stays.

    With the columns ``permutation`` and ``positive_folds`` a harmful feature goes whatever its votes.
    """
    ranked = importances.select("*", *[_share_rank(m).alias(f"rank_{m}") for m in methods])
    count = sum((F.coalesce((F.col(f"rank_{m}") > 0.5).cast("int"), F.lit(0)) for m in methods), F.lit(0))
    known = sum((F.coalesce(F.col(f"rank_{m}"), F.lit(0.0)) for m in methods), F.lit(0.0))
    there = sum((F.col(f"rank_{m}").isNotNull().cast("int") for m in methods), F.lit(0))
    harmful = F.coalesce(is_harmful(), F.lit(False)) if {"permutation", "positive_folds"} <= {*importances.columns} else F.lit(False)
    voted = ranked.withColumn("votes", count).withColumn("harmful", harmful)
    return voted.withColumn("selected", (F.col("votes") >= least) & ~F.col("harmful")).withColumn("composite", F.try_divide(known, there))


def _share_rank(m: str):
    everything = Window.partitionBy(F.lit(1))
    rank = F.rank().over(everything.orderBy(F.col(m).asc_nulls_last()))
    ties = F.count(m).over(Window.partitionBy(F.lit(1), F.col(m)))
    return F.when(F.col(m).isNotNull(), (rank + (ties - 1) / 2) / F.count(m).over(everything))


def best_of_clusters(voted: DataFrame, clustered: DataFrame) -> DataFrame:
    """Of the selected features of each cluster, the one with the best mean percentile; ``of`` names it."""
    x = voted.where("selected").join(clustered, "feature")
    best = F.first("feature").over(Window.partitionBy("cluster").orderBy(F.desc("composite"), "feature"))
    return x.select("feature", "cluster", best.alias("of")).withColumn("stays", F.col("feature") == F.col("of"))


def report(candidates: DataFrame, removed: DataFrame, voted: DataFrame, chosen: DataFrame) -> DataFrame:
    """A row for each candidate: its scores, votes, whether it is selected, and why not if it isn't.

    ``removed`` (feature, reason) are those that never came to a vote, ``chosen`` the result
    of best_of_clusters; the selected ones come first, then by attribution.
    """
    kept = chosen.select("feature", "of", "stays")
    x = candidates.join(removed.groupBy("feature").agg(F.min("reason").alias("early")), "feature", "left").join(voted, "feature", "left").join(kept, "feature", "left")
    selected = F.coalesce(F.col("stays"), F.lit(False))
    late = F.when(F.col("harmful"), "shuffling it improves held-out forecasts").when(~F.col("selected"), "too few methods rank it high")
    redundant = F.when(~F.col("stays"), F.concat(F.lit("follows "), F.col("of")))
    reason = F.when(selected, "").otherwise(F.coalesce("early", late, redundant, F.lit("not scored")))
    scores = [c for c in voted.columns if c not in ("feature", "selected", "harmful", "composite") and not c.startswith("rank_")]
    out = x.select("feature", *scores, selected.alias("selected"), reason.alias("removal_reason"))
    order = [F.desc("selected"), *([F.col("attribution").desc_nulls_last()] if "attribution" in scores else []), F.col("feature")]
    return out.orderBy(*order)


def forbidden_names(spark, features: list[str]) -> DataFrame:
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    return names.where(F.col("feature").rlike(FORBIDDEN))


def equal_to_targets(frame: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """feature, target: pairs that agree on all rows that have both, of which there must be one."""
    checks = {(f, t): F.bool_and(F.abs(F.col(f) - F.col(t)) <= 1e-8 + 1e-5 * F.abs(F.col(t))) for f in features for t in targets}
    one = frame.agg(*[c.alias(f"{f}|{t}") for (f, t), c in checks.items()])
    found = one.unpivot([], [f"{f}|{t}" for f, t in checks], "pair", "same").where("same")
    return found.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("feature"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("target"))


def point_in_time_mismatches(build, bars: DataFrame, features: list[str], quantiles=(0.3, 0.6, 0.9)) -> DataFrame:
    """stock, cutoff, feature and both values where a build on the past alone differs from the full build.

    Cutoffs are each stock's rows at the quantiles and its last but one. The truncated
    histories of all stocks and cutoffs form one panel whose stocks are (stock, cutoff), so
    ``build`` runs once over them: a handful of copies of the table, not one job each.
    """
    w = W.over()
    placed = bars.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("stock")))
    cut = F.array_distinct(F.array(*[F.floor(F.col("n") * q).cast("int") for q in quantiles], F.col("n").cast("int") - 2))
    cutoffs = placed.where("i = n - 1").select("stock", F.explode(cut).alias("at"))
    ends = placed.join(F.broadcast(cutoffs), "stock").where("i = at").select("stock", "at", F.col("d").alias("cutoff"))
    past = placed.join(F.broadcast(ends), "stock").where("i <= at").withColumn("stock", F.struct("stock", "at"))
    seen = build(past.select(*bars.columns)).select(F.col("stock.stock").alias("s"), F.col("stock.at").alias("at"), "d", *features)
    seen = seen.join(F.broadcast(ends.select(F.col("stock").alias("s"), "at", "cutoff")), ["s", "at"]).where("d = cutoff")
    then = long_form(seen.drop("d", "at"), ["s", "cutoff"], features).withColumnRenamed("x", "past_value")
    full = build(bars).select(F.col("stock").alias("s"), F.col("d").alias("cutoff"), *features)
    now = long_form(full.join(F.broadcast(ends.select(F.col("stock").alias("s"), "cutoff").distinct()), ["s", "cutoff"], "left_semi"), ["s", "cutoff"], features)
    both = then.join(now, ["s", "cutoff", "feature"])
    same = (F.col("x").isNull() & F.col("past_value").isNull()) | F.coalesce(F.abs(F.col("x") - F.col("past_value")) <= 1e-10 + 1e-7 * F.abs("past_value"), F.lit(False))
    return both.where(~same).select(F.col("s").alias("stock"), "cutoff", "feature", F.col("x").alias("full_value"), "past_value")


def frame_comparison(build, sources: dict[str, DataFrame], features: list[str], quantiles=(0.3, 0.6, 0.9), close_minutes: int = 930) -> DataFrame:
    """stock, cutoff, feature, both values, and whether both builds have the row and agree: a build from truncated
    sources beside the full build.

    ``build(sources, by)`` makes the feature frame; ``sources`` has ``bars``, ``market``, ``vix``,
    ``fx`` and intraday bars under the names of their timeframes. At each cutoff, days at the
    quantiles of the calendar and the last but one, every source ends: bars and context with
    the day, the exchange rate before it, intraday bars at its close. The truncated sources of
    all cutoffs are one set of tables with a key ``cut``, so the build runs once over all of
    them: a copy of the table for each of a handful of cutoffs.
    """
    days = sources["bars"].select("d").distinct().withColumn("i", F.row_number().over(Window.orderBy("d")) - 1)
    days = stored(days, "audit-days")
    n = days.count()
    places = sorted({*(int(n * q) for q in quantiles), max(0, n - 2)})
    cuts = F.broadcast(stored(days.where(F.col("i").isin(places)).select(F.col("i").alias("cut"), F.col("d").alias("cutoff")), "audit-cuts"))
    ends = {"fx": F.col("d") < F.col("cutoff")}
    past = {}
    for name, table in sources.items():
        daily = "d" in table.columns
        upto = ends.get(name, F.col("d") <= F.col("cutoff") if daily else F.col("bar_end") <= F.col("cutoff").cast("timestamp") + F.expr(f"INTERVAL {close_minutes} MINUTES"))
        past[name] = table.join(cuts, upto).drop("cutoff")
    seen = build(past, ["cut"]).join(cuts, "cut").where("d = cutoff")
    then = long_form(seen, ["stock", "cutoff"], features).withColumnRenamed("x", "past_value")
    full = build(sources, []).join(cuts.select(F.col("cutoff").alias("d")), "d").withColumnRenamed("d", "cutoff")
    both = then.withColumn("in_past", F.lit(True)).join(long_form(full, ["stock", "cutoff"], features).withColumn("in_full", F.lit(True)), ["stock", "cutoff", "feature"], "full")
    near = F.abs(F.col("x") - F.col("past_value")) <= 1e-10 + 1e-7 * F.abs("past_value")
    same = (F.col("x").isNull() & F.col("past_value").isNull()) | F.coalesce(near, F.lit(False))
    there = F.col("in_past").isNotNull() & F.col("in_full").isNotNull()
    return both.select("stock", "cutoff", "feature", F.col("x").alias("full_value"), "past_value", there.alias("compared"), (there & same).alias("same"))


def frame_mismatches(build, sources: dict[str, DataFrame], features: list[str], quantiles=(0.3, 0.6, 0.9), close_minutes: int = 930) -> DataFrame:
    """stock, cutoff, feature and both values where the builds differ, rows that one of them alone has included."""
    return frame_comparison(build, sources, features, quantiles, close_minutes).where("not same").drop("compared", "same")


def audit_counts(compared: DataFrame) -> DataFrame:
    """cutoff, feature, compared, differing, one_sided: what a comparison of builds covered and found; without
    rows nothing was audited."""
    count = lambda c: F.count_if(c)
    return compared.groupBy("cutoff", "feature").agg(
        count(F.col("compared")).alias("compared"), count(F.col("compared") & ~F.col("same")).alias("differing"), count(~F.col("compared")).alias("one_sided"))


def audit_report(mismatches: DataFrame, price_levels: list[str]) -> DataFrame:
    """feature, reason: those that no model may use, as the audit found them or as they carry a price."""
    leaky = mismatches.select("feature").distinct().withColumn("reason", F.lit("differs once later rows are cut off"))
    spark = mismatches.sparkSession
    levels = spark.createDataFrame([(f,) for f in price_levels], "feature string").withColumn("reason", F.lit("price level that differs between stocks"))
    return leaky.unionByName(levels.join(leaky.select("feature"), "feature", "left_anti"))
