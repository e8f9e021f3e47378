"""Queries on models: folds, experiments, the final fit, attributions and the selection report.

Grids are parameters of the operators; the queries run on small ones, which the README names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import context as C
from panelspark.operators import evaluation as E
from panelspark.operators import indicators as I
from panelspark.operators import models as M
from panelspark.operators import selection as X
from panelspark.operators import trees as TR
from panelspark.operators.filling import MedianFill
from panelspark.operators.parallel import run_all
from panelspark.plans import sql as S
from panelspark.plans.context import frame_of, intraday
from panelspark.plans.panel import rounded
from panelspark.sources import tables as T
from panelspark.sources.io import stored

QUERIES, ORACLE_SQL = {}, {}
_SCORES = ["p_1", "p_2", "p_3"]

LEARNED = ["Ret_5", "Ret_21", "RSI", "Volatility", "SMA20_Ratio"]
DEPTH2 = {"depth2": {"maxDepth": 2, "minInstancesPerNode": 50}}
SMALL = [5, 10]


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def learning_rows(spark, d, features=LEARNED, horizon: int = 5):
    x = I.add_labels(I.baseline(T.nation_bars(spark, d)), {"H": horizon}).where("Target_H is not null")
    return stored(x.select("stock", "d", F.col("Target_H").alias("label"), *features), "learning-rows")


def labelled_frame(spark, d, names, horizon: int = 5):
    """The feature frame's rows with the label of the stock's close ``horizon`` rows ahead."""
    y = I.add_labels(T.nation_bars(spark, d), {"H": horizon}).select("stock", "d", F.col("Target_H").alias("label"))
    frame = frame_of(spark, d).select("stock", "d", *[f"`{n}`" for n in names]).join(y, ["stock", "d"]).where("label is not null")
    return stored(frame, "labelled-frame")


@query("m5_cross_validated_gbt")
def m5_cross_validated_gbt(spark, d):
    """AUC of each fold for each number of trees, from one fit a fold."""
    x = learning_rows(spark, d)
    return M.cross_validate(x, LEARNED, E.fold_bounds(x, 5, folds=2), DEPTH2, SMALL)


EXPERIMENTS = [("plain_baseline", "plain", ["baseline"]), ("sampled_baseline", "sampled", ["baseline"]), ("sampled_market", "sampled", ["baseline", "market"])]
CHOSEN = {"baseline": ["Ret_5", "Ret_21", "RSI", "Volatility", "SMA20_Ratio", "Rel_Ret_21"], "market": ["vix_return", "index_return_5", "sector_return_5", "vs_sector_return"]}


def experiments(spark, d):
    names = [n for g in CHOSEN.values() for n in g]
    x = labelled_frame(spark, d, names)
    bounds = stored(E.fold_bounds(x, 5, folds=2), "bounds")
    found = [M.run_experiment(n, x, [f for g in groups for f in CHOSEN[g]], bounds, family, DEPTH2, SMALL) for n, family, groups in EXPERIMENTS]
    ensemble = M.ensemble_of(found)
    return x, bounds, [*found, *([ensemble] if ensemble else [])], M.choose(found, ensemble)


@query("m6_experiments")
def m6_experiments(spark, d):
    """Every experiment and the ensemble, tuned on the folds and scored once on the test block; ``chosen`` marks one."""
    _, _, found, chosen = experiments(spark, d)
    return M.comparison(spark, found, chosen)


@query("m10_final_model")
def m10_final_model(spark, d):
    """Forecasts of each stock's latest row by the chosen model, fitted to all labelled rows, and what it was made of."""
    x, bounds, _, chosen = experiments(spark, d)
    models, metadata = M.final_fit(x, chosen, {f: DEPTH2 for f in M.FAMILIES}, CHOSEN, bounds, 5)
    names = [n for g in CHOSEN.values() for n in g]
    last = Window.partitionBy("stock").orderBy(F.desc("d"))
    rows = frame_of(spark, d).select("stock", "d", *names).withColumn("turn", F.row_number().over(last)).where("turn = 1").drop("turn")
    rows = stored(rows, "latest-rows")
    parts = None
    for m, r in zip(models, chosen.parts or (chosen,), strict=True):
        one = M.score(m, rows, r.features).select("stock", "d", "p")
        parts = one if parts is None else parts.unionByName(one)
    mean = parts.groupBy("stock", "d").agg(F.avg("p").alias("p"))
    threshold = mean.agg(F.median("p").alias("threshold"))
    return mean.join(F.broadcast(threshold), F.lit(True)).select("stock", "d", "p", "threshold", *[F.lit(str(metadata[k])).alias(k) for k in ("experiment", "model_type", "feature_groups", "test_period")])


@query("m13_sampled_attributions")
def m13_sampled_attributions(spark, d):
    """The strongest features of each stock's latest forecast by sampled Shapley values."""
    x = learning_rows(spark, d)
    model = M.fit(x, LEARNED, {"maxDepth": 2}, 5)
    last = Window.partitionBy("stock").orderBy(F.desc("d"))
    latest = x.withColumn("turn", F.row_number().over(last)).where("turn = 1").select("stock", "d", *LEARNED)
    return M.attributions(model, latest, x.select(*LEARNED), LEARNED, ["stock", "d"], top=6)


@query("m14_intraday_study")
def m14_intraday_study(spark, d):
    """Whether features of hourly bars help, on the rows that have any."""
    extra = ["1h_return", "1h_volume_change", "1h_price_vs_EMA"]
    bars = T.nation_bars(spark, d)
    own = I.baseline(bars).join(I.add_labels(bars, {"H": 1}).select("stock", "d", "Target_H"), ["stock", "d"])
    x = C.with_timeframes(I.technical(own, "daily", *C.TIMEFRAMES["daily"]), intraday(spark, d)).where("Target_H is not null")
    x = stored(x.select("stock", "d", F.col("Target_H").alias("label"), *LEARNED, *[f"`{f}`" for f in extra]), "study")
    bounds = lambda rows: E.fold_bounds(rows, 1, folds=2, test=0.25, start=0.30)
    found = M.intraday_study(x, LEARNED, extra, bounds, "sampled", {"depth2": {"maxDepth": 2}}, [3, 5], least=20)
    empty = "variant string, n_features int, cv_auc double, cv_fold_aucs array<double>, test_roc_auc double"
    return spark.createDataFrame([], empty) if found is None else found


CANDIDATES = [*LEARNED, "Ret_1", "Stoch_K", "BB_PctB"]


@query("x13_selection_report")
def x13_selection_report(spark, d):
    """Every candidate with its scores by five methods, votes, and why it goes: coverage, constancy, copies, harm, redundancy."""
    rows = learning_rows(spark, d, CANDIDATES).withColumn("Twin", F.col("Ret_5") * 2).withColumn("Flat", F.lit(1.0)).withColumn("Sparse", F.when(F.col("stock") < 3, F.col("Ret_5")))
    names = [*CANDIDATES, "Twin", "Flat", "Sparse", "Level"]
    rows = stored(rows.withColumn("Level", F.col("RSI") * 1.0), "selection-rows")
    bounds = stored(E.fold_bounds(rows, 5, folds=2), "selection-folds")
    return select_features(spark, rows, names, bounds, {"Level": "price level that differs between stocks"})


def select_features(spark, rows, candidates, bounds, invalid, trees: int = 8, config=None):
    """All steps of the selection on the rows before the test block; the block itself is never read."""
    config = config or {"maxDepth": 3}
    roles = stored(E.fold_roles(rows, bounds), "selection-roles")
    train = stored(roles.where("fold = -1 and role = 'train'").drop("fold", "role"), "selection-train")
    named = lambda xs: spark.createDataFrame([(x,) for x in xs], "feature string")
    reasons = dict(invalid)
    kept = [r["feature"] for r in X.drop_invalid(named(candidates), spark.createDataFrame([*reasons.items()], "feature string, reason string")).collect()]
    kept = [c for c in candidates if c in kept]
    long = X.long_form(train, ["stock", "d", "label"], kept)
    reasons |= {r["feature"]: f"missing in {r['missing']:.0%} of the rows" for r in X.low_coverage(long).collect()}
    reasons |= {r["feature"]: "constant or nearly so" for r in X.near_constant(long).collect() if r["feature"] not in reasons}
    kept = [f for f in kept if f not in reasons]
    pairs = stored(X.spearman(train, kept), "selection-pairs")
    reasons |= {r["feature"]: f"copy of {r['of']}" for r in X.duplicates(pairs, kept).collect()}
    kept = [f for f in kept if f not in reasons]

    long = X.long_form(train, ["stock", "d"], kept)
    related = X.target_correlation(X.long_form(train.withColumnRenamed("label", "y"), ["stock", "d", "y"], kept)).select("feature", F.col("rho").alias("correlation"))
    information = X.mutual_information(long, train.select("stock", "d", F.col("label").alias("y")), ["stock", "d"])
    numbers = [r["fold"] for r in bounds.where("fold >= 0").orderBy("fold").collect()]
    part = lambda k, role: roles.where((F.col("fold") == k) & (F.col("role") == role))
    fits = run_all(spark, [functools.partial(M.fit, part(k, "train"), kept, config, trees) for k in numbers])
    folds = [(m, part(k, "evaluate")) for m, k in zip(fits, numbers, strict=True)]
    gains = M.importances([m for m, _ in folds], kept)
    shuffled = M.permutation_importance(folds, kept)
    values = None
    for m, held in folds:
        part = M.exact_attributions(m, held, kept, ["stock", "d"]).select("feature", "value")
        values = part if values is None else values.unionByName(part)
    scores = named(kept).join(related, "feature", "left").join(information, "feature", "left").join(gains, "feature", "left").join(shuffled, "feature", "left").join(M.mean_attributions(values), "feature", "left")
    voted = stored(X.votes(scores, ["mi", "gain", "permutation", "attribution"]), "selection-votes")
    clustered = X.clusters(pairs, voted.where("selected").select("feature"))
    chosen = X.best_of_clusters(voted, clustered)
    removed = spark.createDataFrame([*reasons.items()], "feature string, reason string")
    return X.report(named(candidates), removed, voted, chosen)





#: Trees over the learned features, by their places: the first splits, the second splits both halves.
PAIRS = [[0, 2], [1, 3], [4, 0]]
LEARNING_SQL = f"learn AS (SELECT stock, d, label, {', '.join(LEARNED)} FROM (SELECT *, CASE WHEN lead(c, 5) OVER ({S.P}) IS NOT NULL THEN CASE WHEN lead(c, 5) OVER ({S.P}) > c * 1.005 THEN 1.0::DOUBLE ELSE 0.0 END END AS label FROM base) WHERE label IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in LEARNED)})"


def _tree_sql(t: int, a: str, b: str) -> str:
    """Of one tree: every row's leaf value, what is known of it with each feature alone, and the mean."""
    return f"""m{t} AS (SELECT *, {a} <= (SELECT median({a}) FROM learn) AS side FROM learn), k{t} AS (SELECT side, median({b}) AS cut, avg(label) AS v, count(*) AS n FROM m{t} GROUP BY 1),
    l{t} AS (SELECT m{t}.*, {b} <= cut AS part FROM m{t} JOIN k{t} USING (side)), g{t} AS (SELECT side, part, avg(label) AS v FROM l{t} GROUP BY ALL),
    o{t} AS (SELECT l{t}.stock, l{t}.d, sum(k.n / (SELECT count(*) FROM learn) * g.v) AS v_b FROM l{t}, k{t} k JOIN g{t} g USING (side) WHERE g.part = (l{t}.{b} <= k.cut) GROUP BY ALL),
    t{t} AS (SELECT l{t}.stock, l{t}.d, g.v AS both_, k.v AS v_a, v_b, (SELECT avg(label) FROM learn) AS base FROM l{t} JOIN g{t} g USING (side, part) JOIN k{t} k USING (side) JOIN o{t} USING (stock, d))"""


TREES_SQL = [S.BARS, S.BASELINE, LEARNING_SQL, *[_tree_sql(t, LEARNED[a], LEARNED[b]) for t, (a, b) in enumerate(PAIRS)]]


def grid_model(spark, d):
    """All rows with every feature, and the leaf table of three trees that split them at medians."""
    x = stored(learning_rows(spark, d).dropna(subset=LEARNED), "tree-rows")
    return x, TR.grid_leaves(x, PAIRS, LEARNED, "label")


@query("m3_staged_scores", S.statement(*TREES_SQL, f"z AS (SELECT t0.stock, t0.d, t0.both_ AS p_1, t0.both_ + t1.both_ AS p_2, t0.both_ + t1.both_ + t2.both_ AS p_3 FROM t0 JOIN t1 USING (stock, d) JOIN t2 USING (stock, d))", S.rounded("z", ["stock", "d"], _SCORES)))
def m3_staged_scores(spark, d):
    """Every row's score by the first one, two and three trees of a leaf table."""
    x, leaves = grid_model(spark, d)
    return rounded(TR.staged(leaves, x, LEARNED, [1, 2, 3], link=False), ["stock", "d"], _SCORES)


_SHARES = " UNION ALL ".join(f"SELECT stock, d, '{LEARNED[f]}' AS feature, {v} AS value FROM t{t}" for t, (a, b) in enumerate(PAIRS) for f, v in ((a, "(v_a - base + both_ - v_b) / 2"), (b, "(v_b - base + both_ - v_a) / 2")))


@query("m13_tree_attributions", S.statement(*TREES_SQL, f"s AS (SELECT stock, d, feature, sum(value) AS value FROM ({_SHARES}) GROUP BY ALL)", "w AS (SELECT t0.stock, t0.d, t0.both_ + t1.both_ + t2.both_ AS score, t0.base + t1.base + t2.base AS base FROM t0 JOIN t1 USING (stock, d) JOIN t2 USING (stock, d))",
    "SELECT stock, d, feature, round(value, 6) + 0.0 AS value, round(score, 6) AS score, round(base, 6) AS base FROM s JOIN w USING (stock, d)"))
def m13_tree_attributions(spark, d):
    """Exact Shapley values of every row's score by the leaf table of three trees."""
    x, leaves = grid_model(spark, d)
    found = TR.attributions(leaves, x, LEARNED, ["stock", "d"])
    return rounded(found, ["stock", "d", "feature"], ["value", "score", "base"])


_LONG = " UNION ALL ".join(f"SELECT stock, d, '{f}' AS feature, {f} AS x FROM learn" for f in LEARNED)


@query("q12_attribution_spread", S.statement(*TREES_SQL, f"s AS (SELECT stock, d, feature, sum(value) AS value FROM ({_SHARES}) GROUP BY ALL), long AS ({_LONG})", f"r AS (SELECT stock, d, feature, {S.pct_rank('x', 'feature')} AS pct FROM long)",
    "SELECT stock, d, feature, round(pct, 6) AS pct, round(value, 6) + 0.0 AS value FROM r JOIN s USING (stock, d, feature)"))
def q12_attribution_spread(spark, d):
    """What a view of all attributions shows: for every row and feature the value's percentile and its attribution."""
    x, leaves = grid_model(spark, d)
    ranked = X.long_ranks(X.long_form(x, ["stock", "d"], LEARNED)).select("stock", "d", "feature", F.col("rank").alias("pct"))
    values = TR.attributions(leaves, x, LEARNED, ["stock", "d"]).select("stock", "d", "feature", "value")
    return rounded(ranked.join(values, ["stock", "d", "feature"]), ["stock", "d", "feature"], ["pct", "value"])


@query("m13_boosted_attributions", S.statement(S.BARS, S.BASELINE, LEARNING_SQL.replace(f" AND {' AND '.join(f'{f} IS NOT NULL' for f in LEARNED)}", ""), "SELECT stock, count(*) AS n, 5 AS features, 0::BIGINT AS apart, 0::BIGINT AS other_scores FROM learn GROUP BY 1"))
def m13_boosted_attributions(spark, d):
    """Of every stock's rows, gaps included: whether the values of all features add up to the boosted score less the
    base, and whether the score by the leaf table is the library's."""
    x = learning_rows(spark, d)
    model = M.fit(x, LEARNED, {"maxDepth": 3}, 5)
    values = M.exact_attributions(model, x, LEARNED, ["stock", "d"]).groupBy("stock", "d").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("features"), F.first("score").alias("score"), F.first("base").alias("base"))
    both = values.join(M.score(model, x, LEARNED).select("stock", "d", "p"), ["stock", "d"])
    apart = F.count_if(F.abs(F.col("total") - F.col("score") + F.col("base")) > 1e-9)
    other = F.count_if(F.abs(1 / (1 + F.exp(-2 * F.col("score"))) - F.col("p")) > 1e-9)
    return both.groupBy("stock").agg(F.count(F.lit(1)).alias("n"), F.max("features").cast("int").alias("features"), apart.alias("apart"), other.alias("other_scores"))


FILLED = [*LEARNED, "Ret_252", "Nothing"]
FOLDS_SQL = """days AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT d FROM fill)), n AS (SELECT count(*) AS n, floor(count(*)::DOUBLE * 0.85::DOUBLE)::INT AS a, floor(count(*)::DOUBLE * 0.45::DOUBLE)::INT AS b FROM days),
    bounds AS (SELECT k.fold, b + k.fold * floor((a - 5 - b) / 2.0)::INT - 5 AS before FROM n, range(2) k(fold)), train AS (SELECT fill.*, fold FROM fill JOIN days USING (d) JOIN bounds ON i < before)"""


@query("c11_median_fill", S.statement(S.BARS, S.BASELINE, LEARNING_SQL.replace(f" AND {' AND '.join(f'{f} IS NOT NULL' for f in LEARNED)}", "").replace("Ret_21,", "Ret_21, Ret_252,", 1).replace("learn AS", "fill AS"), FOLDS_SQL,
    " UNION ALL ".join(f"SELECT fold, '{f}' AS feature, count(*) AS n, count(*) - count({f if f != 'Nothing' else 'NULL'}) AS missing, true AS middle, 0::BIGINT AS left_over FROM train GROUP BY 1" for f in FILLED)))
def c11_median_fill(spark, d):
    """Medians of each fold's training rows, an all-missing feature among them: rows filled, whether the fill lies in the
    middle of the known values (0 where there are none), and what is still missing afterwards."""
    x = learning_rows(spark, d, [*LEARNED, "Ret_252"]).withColumn("Nothing", F.lit(None).cast("double"))
    roles = stored(E.fold_roles(x, E.fold_bounds(x, 5, folds=2)).where("fold >= 0 and role = 'train'"), "filled-rows")
    out = None
    for fold in range(2):
        rows = roles.where(F.col("fold") == fold)
        model = MedianFill(inputCols=FILLED).fit(rows)
        medians = dict(zip(FILLED, model.getOrDefault(model.medians), strict=True))
        filled = model.transform(rows)
        checks = []
        for f in FILLED:
            known = F.count(f)
            low, high = F.count_if(F.col(f) < medians[f]) / known, F.count_if(F.col(f) <= medians[f]) / known
            inside = F.when(known == 0, medians[f] == 0.0).otherwise((low <= 0.501) & (high >= 0.499))
            checks.append(F.struct(F.lit(f).alias("feature"), F.count(F.lit(1)).alias("n"), F.sum(f"{f}_missing").cast("long").alias("missing"), inside.alias("middle"), F.count_if(F.col(f"{f}_filled").isNull()).alias("left_over")))
        part = filled.agg(F.array(*checks).alias("x")).select(F.lit(fold).cast("long").alias("fold"), F.explode("x").alias("x")).select("fold", "x.*")
        out = part if out is None else out.unionByName(part)
    return out


@query("s10_model_store", S.statement(S.BARS, S.BASELINE, LEARNING_SQL.replace(f" AND {' AND '.join(f'{f} IS NOT NULL' for f in LEARNED)}", ""), """v AS (SELECT 1 AS version, * FROM learn WHERE d < (SELECT max(d) FROM learn) - INTERVAL 365 DAY UNION ALL SELECT 2, * FROM learn),
    m AS (SELECT version, count(*) AS n, min(d) AS first_day, max(d) AS last_day, count(DISTINCT stock) AS stocks FROM v GROUP BY 1)""",
    f"SELECT version, key, value, 2 AS latest, 0::BIGINT AS other_scores FROM (SELECT version, 'rows' AS key, n::VARCHAR AS value FROM m UNION ALL SELECT version, 'first_day', first_day::VARCHAR FROM m UNION ALL SELECT version, 'last_day', last_day::VARCHAR FROM m UNION ALL SELECT version, 'stocks', stocks::VARCHAR FROM m UNION ALL SELECT version, 'features', '{','.join(LEARNED)}' FROM m)"))
def s10_model_store(spark, d):
    """Two versions of a model kept with what they were made of, and a third whose writer stopped before it committed:
    what a reader finds, and whether the model read back scores as the one that was kept."""
    from panelspark.sources import io

    x, path = learning_rows(spark, d), io.scratch(spark, "model-store")
    last = x.agg(F.max("d")).first()[0]
    models = []
    for rows in (x.where(F.col("d") < F.lit(last) - F.expr("INTERVAL 365 DAYS")), x):
        about = rows.agg(F.count(F.lit(1)).alias("rows"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.countDistinct("stock").alias("stocks")).first().asDict()
        models.append(M.fit(rows, LEARNED, {"maxDepth": 2}, 3))
        io.save_model(models[-1], path, about | {"features": ",".join(LEARNED)})
    models[0].write().save(f"{path}/versions/aborted/model")  # no manifest follows
    again, metadata = io.load_model(spark, path, ("features", "last_day"))
    names = metadata["features"].split(",")
    both = M.score(again, x, names).select("stock", "d", F.col("p").alias("q")).join(M.score(models[1], x, LEARNED).select("stock", "d", "p"), ["stock", "d"])
    other = both.agg(F.count_if(F.col("p") != F.col("q")).alias("other_scores"))
    latest = io.versions(spark, path).agg(F.max("version").alias("latest"))
    return io.versions(spark, path).join(F.broadcast(latest), F.lit(True)).join(F.broadcast(other), F.lit(True))
