"""Boosted trees by MLlib: folds, truncated ensembles, attributions."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators import trees as trees_
from panelspark.operators.evaluation import auc, evaluate, fold_roles
from panelspark.operators.filling import MedianFill
from panelspark.operators.parallel import run_all
from panelspark.sources.io import stored


#: The grids of both families, as tree depths for the leaves that they allow.
FAMILIES = {
    "plain": {
        "sampling": {"subsamplingRate": 1.0, "featureSubsetStrategy": "all"},
        "configs": {"leaf15": {"maxDepth": 4}, "leaf7": {"maxDepth": 3}, "depth2": {"maxDepth": 2}},
        "trees": [25, 50, 100, 150, 200, 300],
    },
    "sampled": {
        "sampling": {"subsamplingRate": 0.8, "featureSubsetStrategy": "0.7"},
        "configs": {"leaf7": {"maxDepth": 3}, "leaf15": {"maxDepth": 4}, "leaf31": {"maxDepth": 5}, "depth2": {"maxDepth": 2}},
        "trees": [50, 100, 200, 300, 400],
    },
}


def fit(rows: DataFrame, features: list[str], config: dict, trees: int, label: str = "label", family: str = "sampled") -> PipelineModel:
    """Medians of the training rows for missing values, then boosted trees of a family.

    A feature that no training row has is constant and says only that it is missing.
    """
    fill = MedianFill(inputCols=features)
    steps = [
        fill,
        VectorAssembler(inputCols=fill.outputs(), outputCol="features"),
        GBTClassifier(labelCol=label, stepSize=0.03, maxIter=trees, seed=42, **FAMILIES[family]["sampling"], **config),
    ]
    return Pipeline(stages=steps).fit(rows)


def score(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(rows).select(*rows.columns, vector_to_array("probability")[1].alias("p"))


def staged_scores(model: PipelineModel, rows: DataFrame, features: list[str], trees: list[int]) -> DataFrame:
    """The rows with p_<i>, the forecast of the first i trees, for each i: one fit, several lengths."""
    *before, boosted = model.stages
    kept = rows.columns
    x = PipelineModel(before).transform(rows)
    weights = boosted.treeWeights
    for i, tree in enumerate(boosted.trees[: max(trees)]):
        tree.setPredictionCol(f"__t{i}").setFeaturesCol("features")
        x = tree.transform(x)
    total = F.lit(0.0)
    columns = []
    for i in range(max(trees)):
        total = total + F.col(f"__t{i}") * weights[i]
        if i + 1 in trees:
            columns.append((1 / (1 + F.exp(-2 * total))).alias(f"p_{i + 1}"))
    return x.select(*kept, *columns)


def cross_validate(
    rows: DataFrame, features: list[str], bounds: DataFrame, configs: dict[str, dict], trees: list[int], family: str = "sampled", keep: bool = False, at_once: int = 4
):
    """config, trees, fold, roc_auc for every fold but the test block; ``best`` marks the key with the best mean.

    With ``keep`` also the forecasts of the best key out of fold: stock, d, label, fold, p. The
    rows of the folds are stored once and read by all fits, of which ``at_once`` run side by side.
    """
    placed = stored(fold_roles(rows, bounds.where("fold >= 0")), "folds")
    folds = [r["fold"] for r in bounds.where("fold >= 0").select("fold").distinct().orderBy("fold").collect()]
    def fitted(name: str, config: dict, fold: int):
        one = placed.where(F.col("fold") == fold)
        model = fit(one.where("role = 'train'"), features, config, max(trees), family=family)
        out = staged_scores(model, one.where("role = 'evaluate'"), features, trees)
        long = out.withColumn("y", F.col("label")).unpivot(["fold", "y"], [f"p_{i}" for i in trees], "trees", "p")
        return out, [(name, int(r["trees"][2:]), fold, r["roc_auc"]) for r in auc(long, ["fold", "trees"]).collect()]  # a row for each number of trees

    keys = [(name, fold) for name in configs for fold in folds]
    results = run_all(rows.sparkSession, [functools.partial(fitted, name, configs[name], fold) for name, fold in keys], at_once)
    scored = {k: out for k, (out, _) in zip(keys, results, strict=True)}
    found = [row for _, part in results for row in part]
    scores = rows.sparkSession.createDataFrame(found, "config string, trees int, fold int, roc_auc double")
    means: dict[tuple[str, int], list[float]] = {}
    for name, n, _, value in found:
        means.setdefault((name, n), []).append(value if value is not None else 0.0)
    order = [(c, n) for c in configs for n in trees]
    best = max(order, key=lambda k: sum(means[k]) / len(means[k]))  # the first of equals
    mean = scores.groupBy("config", "trees").agg(F.avg("roc_auc").alias("cv_auc"))
    chosen = (F.col("config") == best[0]) & (F.col("trees") == best[1])
    scores = scores.join(mean, ["config", "trees"]).withColumn("best", chosen)
    if not keep:
        return scores
    oof = None
    for fold in folds:
        part = scored[best[0], fold].select("stock", "d", "label", "fold", F.col(f"p_{best[1]}").alias("p"))
        oof = part if oof is None else oof.unionByName(part)
    return scores, best, means[best], stored(oof, "out-of-fold")


@dataclass
class Result:
    """What an experiment found: its key, scores, and forecasts out of fold and on the test block."""

    name: str
    family: str
    config: str | None
    trees: int | None
    features: list[str]
    fold_aucs: list[float]
    oof: DataFrame | None
    test: DataFrame
    parts: tuple = ()

    @property
    def cv_auc(self) -> float:
        return sum(self.fold_aucs) / len(self.fold_aucs)


def run_experiment(name: str, rows: DataFrame, features: list[str], bounds: DataFrame, family: str, configs: dict, trees: list[int], keep: bool = True) -> Result:
    """Tune on the folds, refit the best key on all rows before the test block, score the block once."""
    _, (config, n), fold_aucs, oof = cross_validate(rows, features, bounds, configs, trees, family, keep=True)
    placed = stored(fold_roles(rows, bounds.where("fold = -1")), "test-block")
    model = fit(placed.where("role = 'train'"), features, configs[config], n, family=family)
    test = score(model, placed.where("role = 'evaluate'"), features).select("stock", "d", "label", "p")
    return Result(name, family, config, n, features, fold_aucs, oof if keep else None, stored(test, "test-forecasts"))


def ensemble_of(results: list[Result]) -> Result | None:
    """The mean of the first plain model and the best sampled one, scored by the mean AUC of the folds that hold both outcomes."""
    first = next((r for r in results if r.family == "plain"), None)
    second = max((r for r in results if r.family == "sampled"), key=lambda r: r.cv_auc, default=None)
    if first is None or second is None or first.oof is None or second.oof is None:
        return None
    key = ["stock", "d", "label"]

    def mean(a: DataFrame, b: DataFrame, extra: list[str]) -> DataFrame:
        return a.select(*key, *extra, F.col("p").alias("p1")).join(b.select(*key, F.col("p").alias("p2")), key).select(*key, *extra, ((F.col("p1") + F.col("p2")) / 2).alias("p"))

    both = mean(first.oof, second.oof, ["fold"])
    aucs = [r["roc_auc"] for r in auc(both.withColumnRenamed("label", "y"), ["fold"]).orderBy("fold").collect() if r["roc_auc"] is not None]
    if not aucs:
        return None
    features = sorted({*first.features, *second.features})
    name = f"ensemble({first.name}+{second.name})"
    return Result(name, "ensemble", None, None, features, aucs, None, mean(first.test, second.test, []), (first, second))


def choose(results: list[Result], ensemble: Result | None) -> Result:
    """The best mean AUC of the folds; the ensemble only if it is strictly better."""
    best = max(results, key=lambda r: r.cv_auc)
    return ensemble if ensemble is not None and ensemble.cv_auc > best.cv_auc else best


def comparison(spark, results: list[Result], chosen: Result) -> DataFrame:
    """A row for each experiment: its key, fold scores, metrics out of fold and on the test block, and whether it is chosen."""
    table = spark.createDataFrame(
        [(r.name, r.family, r.config, r.trees, len(r.features), r.cv_auc, r.fold_aucs, r is chosen) for r in results],
        "experiment string, model string, config string, iterations int, n_features int, cv_auc double, cv_fold_aucs array<double>, chosen boolean",
    )
    for prefix in ("val", "test"):
        rows = None
        for r in results:
            part = r.oof if prefix == "val" else r.test
            if part is not None:
                part = part.select(F.lit(r.name).alias("experiment"), "stock", "d", F.col("label").alias("y"), "p")
                rows = part if rows is None else rows.unionByName(part)
        metrics = evaluate(rows, ["experiment"])
        table = table.join(metrics.select("experiment", *[F.col(c).alias(f"{prefix}_{c}") for c in metrics.columns if c != "experiment"]), "experiment", "left")
    return table


def final_fit(rows: DataFrame, chosen: Result, configs: dict[str, dict], groups: dict[str, list[str]], bounds: DataFrame, horizon: int):
    """The chosen model (or both parts of an ensemble) fitted to all labelled rows, and what it was made of."""
    parts = chosen.parts or (chosen,)
    models = [fit(rows, r.features, configs[r.family][r.config], r.trees, family=r.family) for r in parts]
    roles = fold_roles(rows.select("stock", "d"), bounds)
    span = roles.groupBy(F.when(F.col("fold") < 0, "test").otherwise("validation").alias("block"), "role").agg(F.min("d").alias("a"), F.max("d").alias("b")).collect()
    periods = {(r["block"], r["role"]): f"{r['a']}..{r['b']}" for r in span}
    used = [g for g, names in groups.items() if {*names} & {*chosen.features}]
    metadata = {
        "experiment": chosen.name, "model_type": chosen.family, "horizon_days": horizon, "n_features": len(chosen.features), "cv_auc": round(chosen.cv_auc, 4),
        "feature_groups": ",".join(used), "training_period": periods.get(("test", "train"), ""), "validation_period": periods.get(("validation", "evaluate"), ""),
        "test_period": periods.get(("test", "evaluate"), ""), "features": ",".join(chosen.features),
    }
    return models, metadata


def intraday_study(rows: DataFrame, features: list[str], extra: list[str], bounds_of, family: str, configs: dict, trees: list[int], least: int = 2000) -> DataFrame | None:
    """variant, n_features, cv_auc, cv_fold_aucs and test metrics without and with ``extra``, on the rows that have any of it.

    None where a validation fold or the test block holds fewer than ``least`` rows. ``bounds_of``
    makes the folds of the rows.
    """
    held = stored(rows.dropna(how="all", subset=extra), "study-rows")
    if held.isEmpty():
        return None
    bounds = stored(bounds_of(held), "study-folds")
    sizes = fold_roles(held, bounds).where("role = 'evaluate'").groupBy("fold").count().collect()
    if len(sizes) < bounds.count() or min(r["count"] for r in sizes) < least:
        return None
    results = [run_experiment(n, held, f, bounds, family, configs, trees, keep=False) for n, f in (("without", features), ("with", [*features, *extra]))]
    table = comparison_of_variants(rows.sparkSession, results)
    return table


def comparison_of_variants(spark, results: list[Result]) -> DataFrame:
    table = spark.createDataFrame([(r.name, len(r.features), r.cv_auc, r.fold_aucs) for r in results], "variant string, n_features int, cv_auc double, cv_fold_aucs array<double>")
    rows = None
    for r in results:
        part = r.test.select(F.lit(r.name).alias("variant"), "stock", "d", F.col("label").alias("y"), "p")
        rows = part if rows is None else rows.unionByName(part)
    metrics = evaluate(rows, ["variant"])
    return table.join(metrics.select("variant", *[F.col(c).alias(f"test_{c}") for c in metrics.columns if c != "variant"]), "variant", "left")


def importances(models: list[PipelineModel], features: list[str]) -> DataFrame:
    """feature, gain, split: shares of gain and of splits, a feature with its missing-value column, averaged over the models."""
    parts = [trees_.shares_of_splits(trees_.splits_of(m.stages[-1]), features) for m in models]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("feature").agg(F.avg("gain").alias("gain"), F.avg("split").alias("split"))


def exact_attributions(model: PipelineModel, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """keys, feature, value, score, base: exact Shapley values of the boosted score (half its log odds), a feature
    with its missing-value column."""
    fill, boosted = model.stages[0], model.stages[-1]
    return trees_.attributions(trees_.leaves_of(boosted), fill.transform(rows), fill.outputs(), keys, features * 2)


def permutation_importance(folds: list[tuple[PipelineModel, DataFrame]], features: list[str], repeats: int = 3, bucket: int = 256) -> DataFrame:
    """feature, permutation, positive_folds: the loss of AUC where a feature's values are dealt to other rows.

    Rows are dealt at random to buckets of about ``bucket`` rows, and within each a feature takes
    the values of the bucket in another random order: no row number over the whole table is
    needed. All features and repeats of a fold are scored in one plan.
    """
    parts = None
    for fold, (model, rows) in enumerate(folds):
        keys = ["stock", "d", "label"]
        n = max(1, rows.count() // bucket)
        base = stored(rows.select(*keys, *[f"`{f}`" for f in features]), "permuted-rows")
        variants = None
        for r in range(repeats):
            place = F.pmod(F.xxhash64("stock", "d", F.lit(r)), F.lit(n))
            order = lambda salt, r=r: F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("stock", "d", F.lit(f"{salt}-{r}")), "stock", "d"))
            dealt = base.withColumn("b", place).withColumn("i", order("own"))
            given = base.withColumn("b", place).withColumn("i", order("other")).select("b", "i", F.struct(*[f"`{f}`" for f in features]).alias("other"))
            both = dealt.join(given, ["b", "i"]).withColumn("variant", F.explode(F.array(*[F.lit(f) for f in features])))
            mixed = [F.when(F.col("variant") == f, F.col(f"other.`{f}`")).otherwise(F.col(f"`{f}`")).alias(f) for f in features]
            part = both.select("label", F.lit(r).alias("repeat"), "variant", *mixed)
            variants = part if variants is None else variants.unionByName(part)
        shuffled = auc(score(model, variants, features).withColumnRenamed("label", "y"), ["variant", "repeat"]).groupBy("variant").agg(F.avg("roc_auc").alias("after"))
        before = auc(score(model, base, features).select(F.lit(0).alias("g"), F.col("label").alias("y"), "p"), ["g"]).select(F.col("roc_auc").alias("before"))
        drop = shuffled.join(F.broadcast(before), F.lit(True)).select(F.lit(fold).alias("fold"), F.col("variant").alias("feature"), (F.col("before") - F.col("after")).alias("drop"))
        parts = drop if parts is None else parts.unionByName(drop)
    return parts.groupBy("feature").agg(F.avg("drop").alias("permutation"), F.avg((F.col("drop") > 0).cast("double")).alias("positive_folds"))


def mean_attributions(values: DataFrame) -> DataFrame:
    """feature, attribution, attribution_signed: mean size and mean of attributions (feature, value)."""
    return values.groupBy("feature").agg(F.avg(F.abs("value")).alias("attribution"), F.avg("value").alias("attribution_signed"))


def attributions(model: PipelineModel, rows: DataFrame, background: DataFrame, features: list[str], keys: list[str], permutations: int = 4, top: int = 6) -> DataFrame:
    """keys, feature, value: sampled Shapley values against a background row a permutation, the ``top`` by size.

    Each row is scored for every prefix of every permutation; all of it is one plan. The
    permutations and their background rows are a handful of rows.
    """
    import random

    draw = random.Random(42)
    orders = [draw.sample(features, len(features)) for _ in range(permutations)]
    spark = rows.sparkSession
    others = background.orderBy(F.xxhash64(*features)).limit(permutations).collect()  # a missing value is one like any other
    steps = []
    for n, order in enumerate(orders[: len(others)]):
        for k in range(len(order) + 1):
            steps.append((n, k, order[k - 1] if k else None, order[:k], [None if others[n][f] is None else float(others[n][f]) for f in features]))
    plan = F.broadcast(spark.createDataFrame(steps, "n int, k int, added string, own array<string>, other array<double>"))
    mixed = [F.when(F.array_contains("own", f), F.col(f)).otherwise(F.col("other")[i]).alias(f) for i, f in enumerate(features)]
    scored = score(model, rows.crossJoin(plan).select(*keys, "n", "k", "added", *mixed), features).select(*keys, "n", "k", "added", "p")
    before = scored.select(*keys, "n", (F.col("k") + 1).alias("k"), F.col("p").alias("before"))
    gained = scored.join(before, [*keys, "n", "k"]).groupBy(*keys, F.col("added").alias("feature")).agg(F.avg(F.col("p") - F.col("before")).alias("value"))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("value")), "feature")
    return gained.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= top)
