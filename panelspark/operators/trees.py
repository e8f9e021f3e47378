"""Ensembles of trees as tables: a row for each leaf with the bounds of its box.

A leaf table (tree, leaf, weight, value, share, low, high, parts) says everything of a model:
``low`` < x <= ``high`` for every feature bounds the leaf's box, ``share`` is the part of the
tree's training rows in it, and ``parts`` holds for each feature that bounds it the share of rows
that pass its splits, given those above them. Scores, scores of the first trees, and
attributions are sums over leaves. A model's leaves are its own size (trees times 2 ** depth)
whatever the data's; they are compiled into column expressions or sent to the tasks.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.sources.io import scratch

LEAVES = "tree int, leaf int, weight double, value double, share double, low array<double>, high array<double>, parts array<double>"
SPLITS = "tree int, node int, feature int, threshold double, gain double, rows double"


def nodes_of(model: GBTClassificationModel) -> DataFrame:
    """tree, node, feature (-1 at a leaf), threshold, left, right, value, rows, gain, as the model stores itself.

    Written to the shared folder and read as a table: the format is the library's own.
    """
    spark = SparkSession.active()
    path = scratch(spark, "tree-nodes")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    tree = F.col("treeID").cast("int").alias("tree")
    if "nodeData" in data.columns:
        data = data.select(tree, "nodeData.*")
    else:
        data = data.withColumnRenamed("treeID", "tree")
    return data.select(
        F.col("tree").cast("int").alias("tree"), F.col("id").cast("int").alias("node"), F.col("split.featureIndex").cast("int").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", 0).alias("threshold"), F.col("leftChild").cast("int").alias("left"), F.col("rightChild").cast("int").alias("right"),
        F.col("prediction").alias("value"), F.col("rawCount").cast("double").alias("rows"), "gain")


def splits_of(model: GBTClassificationModel) -> DataFrame:
    """Every split: tree, node, feature, threshold, gain (of impurity times rows) and rows."""
    inner = nodes_of(model).where("left >= 0")
    return inner.select("tree", "node", "feature", "threshold", (F.col("gain") * F.col("rows")).alias("gain"), "rows")


def leaves_of(model: GBTClassificationModel) -> DataFrame:
    """The leaf table of boosted trees: boxes grow from the roots down. As large as the model, so it is made in the driver."""
    width, weights = model.numFeatures, list(model.treeWeights)
    nodes = {(r["tree"], r["node"]): r for r in nodes_of(model).collect()}  # of a model
    table = []
    open_ = [(tree, 0, 1.0, [-math.inf] * width, [math.inf] * width, [1.0] * width) for tree in range(len(weights))]
    while open_:
        tree, at, share, low, high, parts = open_.pop()
        node = nodes[tree, at]
        if node["left"] < 0:
            table.append((tree, at, float(weights[tree]), node["value"], share, low, high, parts))
            continue
        i, t = node["feature"], node["threshold"]
        for side in ("left", "right"):
            part = nodes[tree, node[side]]["rows"] / node["rows"]
            box = [list(x) for x in (low, high, parts)]
            box[2][i] *= part
            if side == "left":
                box[1][i] = min(high[i], t)
            else:
                box[0][i] = max(low[i], t)
            open_.append((tree, node[side], share * part, *box))
    return SparkSession.active().createDataFrame(sorted(table), LEAVES)


def grid_leaves(rows: DataFrame, groups: list[list[int]], columns: list[str], label: str, weight: float = 1.0) -> DataFrame:
    """A leaf table made of the data by one rule: for each group of features a tree that splits the first at the median
    of all rows, the next at the median of each half, and so on; a leaf's value is the mean label of its rows.

    Rows without one of the features take no part in a tree. A few features a tree: 2 ** features leaves.
    """
    from panelspark.functions.ranks import medians

    spark = rows.sparkSession
    out = None
    for tree, group in enumerate(groups):
        names = [columns[i] for i in group]
        x = rows.select(F.col(label).alias("y"), *[F.col(n) for n in names]).dropna().withColumn("box", F.lit(""))
        x = x.withColumn("cuts", F.array().cast("array<double>"))
        for n in names:
            middle = F.broadcast(medians(x, ["box"], n).select("box", F.col("middle").alias("cut")))  # a row for each box so far
            x = x.join(middle, "box").withColumn("box", F.concat("box", F.when(F.col(n) <= F.col("cut"), "0").otherwise("1")))
            x = x.withColumn("cuts", F.array_append("cuts", F.col("cut"))).drop("cut")
        found = x.groupBy("box", "cuts").agg(F.avg("y").alias("value"), F.count(F.lit(1)).alias("n")).collect()  # of the leaves
        total = sum(r["n"] for r in found)
        held = lambda prefix, found=found: sum(r["n"] for r in found if r["box"].startswith(prefix))
        table = []
        for r in found:
            low, high, parts = [float("-inf")] * len(columns), [float("inf")] * len(columns), [1.0] * len(columns)
            for k, (i, side, cut) in enumerate(zip(group, r["box"], r["cuts"], strict=True)):
                if side == "0":
                    high[i] = cut
                else:
                    low[i] = cut
                parts[i] = held(r["box"][: k + 1]) / held(r["box"][:k])
            table.append((tree, int(r["box"], 2), weight, r["value"], r["n"] / total, low, high, parts))
        part = spark.createDataFrame(table, LEAVES)
        out = part if out is None else out.unionByName(part)
    return out


def inside(leaf, columns: list[str]) -> Column:
    """Whether a row lies in the leaf's box, by the features that bound it."""
    bounds = [F.col(f"`{c}`") > lo for c, lo in zip(columns, leaf["low"], strict=True) if lo > float("-inf")]
    bounds += [F.col(f"`{c}`") <= hi for c, hi in zip(columns, leaf["high"], strict=True) if hi < float("inf")]
    return functools.reduce(lambda a, b: a & b, bounds, F.lit(True))


def tree_columns(leaves: DataFrame, columns: list[str]) -> list[Column]:
    """What each tree adds to the score of a row: its weight times the value of the one leaf that holds the row."""
    found: dict[int, list] = {}
    for r in leaves.orderBy("tree", "leaf").collect():  # of a model
        found.setdefault(r["tree"], []).append(r)
    out = []
    for _, rs in sorted(found.items()):
        value = F.lit(None).cast("double")
        for r in rs:
            value = F.when(inside(r, columns), F.lit(r["weight"] * r["value"])).otherwise(value)
        out.append(value)
    return out


def staged(leaves: DataFrame, rows: DataFrame, columns: list[str], trees: list[int], link: bool = True) -> DataFrame:
    """The rows with p_<i>, the forecast of the first i trees (with ``link`` as a probability, else their sum)."""
    kept = rows.columns
    values = tree_columns(leaves, columns)
    x = rows.select("*", *[v.alias(f"__t{i}") for i, v in enumerate(values)])
    sums = []
    for n in trees:
        total = functools.reduce(lambda a, b: a + b, [F.col(f"__t{i}") for i in range(n)])
        sums.append((1 / (1 + F.exp(-2 * total)) if link else total).alias(f"p_{n}"))
    return x.select(*kept, *sums)


def shares_of_splits(splits: DataFrame, features: list[str]) -> DataFrame:
    """feature, gain, split: each feature's share of all gain and of all splits (a feature stands for itself and the
    column that says where it is missing)."""
    names = F.array(*[F.lit(f) for f in features])
    own = splits.groupBy(F.element_at(names, F.col("feature") % len(features) + 1).alias("feature")).agg(F.sum("gain").alias("g"), F.count(F.lit(1)).cast("double").alias("n"))
    every = splits.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    whole = Window.partitionBy(F.lit(1))  # a row for each feature
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(whole)), F.lit(0.0))
    return every.join(own, "feature", "left").select("feature", share("g").alias("gain"), share("n").alias("split"))


def attributions(leaves: DataFrame, rows: DataFrame, columns: list[str], keys: list[str], names: list[str] | None = None) -> DataFrame:
    """keys, feature, value, score, base: exact Shapley values of each row's score, in closed form over the leaves.

    Without a feature, a row passes its splits by their shares of the training rows. A leaf's
    part in the score of a set of known features is then a product over the features that
    bound it, whose Shapley values are sums over the subsets of the others: 2 ** (depth - 1)
    at most. The values of a row add to its score less the base, the mean over the training rows.
    ``names`` joins columns under one feature (a feature and its missing-value column).
    """
    table = [(r["weight"] * r["value"], r["low"], r["high"], r["parts"]) for r in leaves.collect()]  # of a model
    names = names or columns
    features = list(dict.fromkeys(names))
    groups = [[i for i, n in enumerate(names) if n == f] for f in features]
    bounded = []
    for value, low, high, parts in table:
        own = []
        for g, members in enumerate(groups):
            used = [(i, low[i], high[i]) for i in members if low[i] > -math.inf or high[i] < math.inf]
            if used:
                own.append((g, used, math.prod(parts[i] for i in members)))
        bounded.append((value, own))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            x = {i: np.array(batch.column(f"__x{i}").to_numpy(zero_copy_only=False), float) for i in range(len(columns))}
            phi, score, base = np.zeros((n, len(features))), np.zeros(n), 0.0
            for value, own in bounded:
                m = len(own)
                one = [np.logical_and.reduce([(x[i] > lo) & (x[i] <= hi) for i, lo, hi in used]).astype(float) for _, used, _ in own]
                zero = [part for _, _, part in own]
                score += value * np.prod(one, axis=0) if m else value
                base += value * math.prod(zero)
                for k, (g, _, _) in enumerate(own):
                    others = [j for j in range(m) if j != k]
                    total = np.zeros(n)
                    for size in range(m):
                        part = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                        for known in itertools.combinations(others, size):
                            product = np.full(n, part * math.prod(zero[j] for j in others if j not in known))
                            for j in known:
                                product = product * one[j]
                            total += product
                    phi[:, g] += value * total * (one[k] - zero[k])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(phi.ravel()), len(features)).cast(pa.list_(pa.float64()))
            kept = [batch.column(c) for c in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(score), pa.array(np.full(n, base))], names=[*keys, "values", "score", "base"])

    given = rows.select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keys)]), "values array<double>", "score double", "base double"])
    found = given.mapInArrow(run, fields).select(*keys, F.posexplode("values").alias("place", "value"), "score", "base")
    return found.select(*keys, F.element_at(F.array(*[F.lit(f) for f in features]), F.col("place") + 1).alias("feature"), "value", "score", "base")


def strongest(values: DataFrame, keys: list[str], top: int = 6) -> DataFrame:
    """The ``top`` features of each row by the size of their attribution; ``turn`` numbers them."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("value")), "feature")
    return values.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= top)
