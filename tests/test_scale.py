"""Selections by ranges, leaf tables, sweeps, stores, threads and late ticks, each against a plain version."""

import datetime as dt
import itertools
import math
import random
import statistics
import threading
import time

import pytest
from pyspark.sql import functions as F

from panelspark.operators import backtest as B
from panelspark.operators import models as M
from panelspark.operators import selection as S
from panelspark.operators import trees as TR

DAY = dt.date(2020, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


# medians, ranks, samples


@pytest.mark.parametrize("accuracy", [1000, 8])
def test_medians_by_selection(spark, accuracy):
    from panelspark.functions.ranks import medians

    r = random.Random(1)
    groups = {"odd": [r.gauss(0, 1) for _ in range(2001)], "even": [r.random() for _ in range(1500)], "ties": [1.0] * 900 + [2.0] * 900 + [5.0], "two": [1.0, 4.0], "one": [7.0], "none": [None] * 3, "gaps": [None, 3.0, None, 1.0, 9.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, x double").repartition(7)
    got = {x.g: (x.n, x.middle) for x in medians(rows, ["g"], "x", accuracy).collect()}
    known = {g: [v for v in vs if v is not None] for g, vs in groups.items()}
    assert got == {g: (len(vs), statistics.median(vs) if vs else None) for g, vs in known.items()}


def test_medians_where_the_sketch_misses(spark, monkeypatch):
    from panelspark.functions import ranks

    rows = spark.createDataFrame([("a", float(i)) for i in range(11)] + [("b", 1.0)], "g string, x double")
    monkeypatch.setattr(ranks.F, "percentile_approx", lambda *_: F.when(F.max("__x") > 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0))))
    assert {x.g: x.middle for x in ranks.medians(rows, ["g"], "x").collect()} == {"a": 5.0, "b": 1.0}


def test_rank_correlation_where_all_features_have_gaps(spark):
    import numpy as np

    r = random.Random(3)
    names = ["a", "b", "c", "e", "gone"]
    rows = []
    for i in range(150):
        v = [float(r.randrange(12)), r.gauss(0, 1), None, None, None]
        v[2], v[3] = v[1] + r.gauss(0, 0.3), float(i % 3)
        rows.append((i, *[None if k == 4 or (i * (k + 3)) % 7 == 0 else float("nan") if k == 1 and i == 5 else v[k] for k in range(5)]))
    got = {(x.a, x.b): x.rho for x in S.spearman(spark.createDataFrame(rows, "i int, a double, b double, c double, e double, gone double"), names).collect()}
    rank = lambda v: np.array([sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v])
    for (i, a), (j, b) in itertools.combinations(enumerate(names), 2):
        both = [(x[i + 1], x[j + 1]) for x in rows if x[i + 1] is not None and x[j + 1] is not None and not math.isnan(x[i + 1]) and not math.isnan(x[j + 1])]
        if both:
            assert abs(got[a, b] - np.corrcoef(*(rank(v) for v in zip(*both)))[0, 1]) < 1e-12
        else:
            assert got[a, b] is None
    assert len(got) == 10


def test_mid_ranks_keep_rows_that_repeat(spark):
    from panelspark.operators.evaluation import mid_ranks

    reference = spark.createDataFrame([(0.1,), (0.2,), (0.9,)], "p double")
    rows = spark.createDataFrame([(1, 0.2), (1, 0.2), (2, 0.95)], "stock int, p double")
    assert sorted((r.stock, r.pct) for r in mid_ranks(rows, reference).collect()) == [(1, 50.0), (1, 50.0), (2, 100.0)]


def test_seeded_samples(spark):
    import hashlib

    rows = [("a" if i % 3 else "b", i) for i in range(300)] + [("c", 1), ("c", 2)]
    draw = lambda frame, n, seed=42: {(r.g, r.k) for r in S.seeded_sample(frame, ["g"], ["g", "k"], n, seed).collect()}
    frame = spark.createDataFrame(rows, "g string, k int")
    want = set()
    for g in "abc":
        want |= set(sorted((x for x in rows if x[0] == g), key=lambda x: hashlib.md5(f"42|{x[0]}|{x[1]}".encode()).hexdigest())[:20])
    assert draw(frame.repartition(5), 20) == draw(frame.coalesce(1), 20) == want and len(want) == 42
    assert draw(frame, 20, 7) != want and draw(frame, 1000) == set(rows)


# learning


def test_a_feature_without_any_value(spark, tmp_path):
    from panelspark.sources import io

    r = random.Random(2)
    rows = [(i, DAY, r.random(), None, float("nan") if i % 4 == 0 else r.random(), float(r.random() > 0.5)) for i in range(120)]
    rows = spark.createDataFrame(rows, "stock int, d date, a double, nothing double, b double, label double")
    model = M.fit(rows, ["a", "nothing", "b"], {"maxDepth": 2}, 3)
    fill = model.stages[0]
    known = sorted(x.b for x in rows.collect() if not math.isnan(x.b))
    assert fill.getOrDefault(fill.medians)[1] == 0.0 and abs(fill.getOrDefault(fill.medians)[2] - known[len(known) // 2]) < 0.02
    path = str(tmp_path / "store")
    assert io.save_model(model, path, {"features": "a,nothing,b"}) == 1
    again, _ = io.load_model(spark, path)
    key = lambda m: [x.p for x in M.score(m, rows, ["a", "nothing", "b"]).orderBy("stock").collect()]
    assert key(again) == key(model) and None not in key(model)
    filled = again.stages[0].transform(rows)
    assert filled.where("nothing_filled <> 0 or nothing_missing <> 1 or (isnan(b) and b_missing <> 1)").count() == 0


def _known_score(leaves, x, known):
    """The score with only some features known: other splits are passed by their shares of rows."""
    total = 0.0
    for leaf in leaves:
        part = leaf["weight"] * leaf["value"]
        for i, v in enumerate(x):
            if leaf["low"][i] > -math.inf or leaf["high"][i] < math.inf:
                part *= (leaf["low"][i] < v <= leaf["high"][i]) if i in known else leaf["parts"][i]
        total += part
    return total


def test_attributions_are_shapley_values(spark):
    r = random.Random(6)
    rows = [(i, *[r.random() for _ in range(4)], float(r.random() > 0.4)) for i in range(300)]
    frame = spark.createDataFrame(rows, "i int, a double, b double, c double, e double, label double")
    model = M.fit(frame, ["a", "b", "c", "e"], {"maxDepth": 4}, 3)
    boosted, fill = model.stages[-1], model.stages[0]
    table = TR.leaves_of(boosted)
    leaves = table.collect()
    assert all(abs(sum(x["share"] for x in leaves if x["tree"] == t) - 1) < 1e-9 for t in range(3))
    some = frame.where("i < 12")
    got = {(x.i, x.feature): x for x in TR.attributions(table, fill.transform(some), fill.outputs(), ["i"]).collect()}
    for row in rows[:12]:
        x = [*row[1:5], 0.0, 0.0, 0.0, 0.0]
        for k, name in enumerate("abce"):
            others, value = [j for j in range(4) if j != k], 0.0
            for size in range(4):
                for known in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    value += w * (_known_score(leaves, x, {*known, k}) - _known_score(leaves, x, {*known}))
            found = got[row[0], f"{name}_filled"]
            assert abs(found.value - value) < 1e-12 and abs(found.score - _known_score(leaves, x, range(8))) < 1e-12 and abs(found.base - _known_score(leaves, x, ())) < 1e-12
    shares = {x.feature: (x.gain, x.split) for x in M.importances([model], ["a", "b", "c", "e"]).collect()}
    gains = boosted.featureImportances.toArray()
    assert all(abs(shares[n][0] - gains[i] - gains[i + 4]) < 1e-9 for i, n in enumerate("abce")) and abs(sum(s for _, s in shares.values()) - 1) < 1e-9
    top = TR.strongest(TR.attributions(table, fill.transform(some), fill.outputs(), ["i"]), ["i"], 2)
    assert top.groupBy("i").count().where("count <> 2").count() == 0


def test_tasks_side_by_side(spark):
    from panelspark.operators.parallel import run_all

    now, peak, lock = [0], [0], threading.Lock()

    def task(k):
        with lock:
            now[0] += 1
            peak[0] = max(peak[0], now[0])
        time.sleep(0.2)
        found = spark.range(k).count()
        with lock:
            now[0] -= 1
        return found

    assert run_all(spark, [lambda k=k: task(k) for k in range(7)], 3) == list(range(7)) and 1 < peak[0] <= 3
    begun = []

    def fails():
        raise KeyError("first")

    def endless():
        begun.append(1)
        for _ in range(40):
            spark.range(8).repartition(8).mapInArrow(lambda batches: (time.sleep(2), iter(batches))[1], "id long").count()

    before = time.time()
    with pytest.raises(KeyError):
        run_all(spark, [endless, lambda: (time.sleep(2), fails())[1], endless, endless], 2)
    assert time.time() - before < 60 and len(begun) == 1  # 160 s if nothing were cancelled


# backtests


def _prices(spark, closes):
    rows = [(s, d, float(c), float(c)) for s, cs in closes.items() for d, c in zip(days(99), cs)]
    return spark.createDataFrame(rows, "stock int, d date, o double, c double")


def test_a_loss_of_everything(spark):
    prices = _prices(spark, {1: [10, 10, 0.0, 5, 10], 2: [10, 11, 0.0, 5, 10], 3: [10, 10, 0.0, 5, 11]})
    config = B.Config(rebalance=1, execution="close", least=3, top=1.0, cost_bps=0.0, slippage_bps=0.0)
    predictions = prices.where("c > 0").select("stock", "d", (F.col("stock") / 10).alias("p"))
    held = B.positions(predictions.unionByName(prices.where("c = 0").select("stock", "d", F.lit(0.5).alias("p"))), prices, config)
    curve = B.equity_curve(held.where("gross is not null"), config).orderBy("step").collect()
    assert curve[1].period_return == -1.0 and [r.equity for r in curve[1:]] == [0.0] * (len(curve) - 1) and curve[0].equity > 1e6
    found = B.metrics(spark.createDataFrame(curve), B.trades(held.where("gross is not null"), config), config).first()
    assert found.cumulative_return == found.annualised_return == -1.0 and found.max_drawdown == -1.0
    flat = B.long_flat(predictions, prices.withColumn("o", F.col("c")), B.Config(rebalance=1), entry=0.0, leave=0.0).where("equity is null")
    assert flat.count() == 0


@pytest.mark.parametrize("name", ["b12_equity_curve", "b18_two_strategies", "b8_inverse_volatility"])
def test_growth_that_a_double_holds_without_the_capital(spark, monkeypatch, name):
    """A unit grows to 1e305, so a million of them are too many for a double; logs and ratios are of the unit."""
    from panelspark.plans import evaluation

    day = 305 / 95  # decades
    bars = _prices(spark, {stock: [10 ** (day * i - 100) for i in range(99)] for stock in range(5)}).withColumn("v", F.lit(1.0))
    found = bars.select("stock", "d", F.lit(1.0).alias("y"), (F.col("stock") / 10).alias("p"))
    monkeypatch.setattr(evaluation, "scored", lambda spark, d: found)
    monkeypatch.setattr(evaluation.T, "nation_bars", lambda spark, d: bars)
    curve = evaluation.QUERIES[name](spark, "").orderBy("d").collect()
    logs = [c for c in ("log_equity", "log_benchmark", "strategy", "benchmark", "baseline") if c in curve[0]]
    assert len(curve) == 19 and len(logs) >= 2
    assert all(abs(r[c] - 5 * day * (i + 1) * math.log(10)) < 0.01 for i, r in enumerate(curve) for c in logs)
    if name == "b12_equity_curve":
        config = B.Config()
        held, own = evaluation.curve_of(spark, "", config)
        metrics = B.metrics(own, B.trades(held, config), config).first()
        assert 1e304 < metrics.cumulative_return < 1e306 and metrics.max_drawdown == 0.0 and math.isfinite(metrics.excess_return)


def test_every_setting_of_a_sweep_equals_its_own_run(spark):
    r = random.Random(9)
    closes = {s: [50.0] for s in range(9)}
    for cs in closes.values():
        while len(cs) < 60:
            cs.append(cs[-1] * math.exp(r.gauss(0, 0.03)))
    prices = _prices(spark, closes)
    predictions = prices.select("stock", "d", (F.pmod(F.xxhash64("stock", "d"), F.lit(1000)) / 1000).alias("p"))
    configs = {
        "plain": B.Config(rebalance=2), "close": B.Config(rebalance=3, execution="close", top=0.5), "kept": B.Config(rebalance=1, entry=70.0, leave=40.0),
        "kept wide": B.Config(rebalance=4, entry=60.0, leave=20.0, least=4, execution="close"), "vol": B.Config(rebalance=2, sizing="inverse_vol", cost_bps=50.0, capital=5.0), "few": B.Config(rebalance=1, entry=99.9, leave=99.0, least=5),
    }
    curve, ledger, metrics = (x.collect() for x in B.sweep(predictions, prices, configs))
    plain = lambda row: [round(v, 9) if isinstance(v, float) else v for k, v in sorted(row.asDict().items()) if k != "config"]
    rows = lambda table, name: sorted(repr(plain(x)) for x in table if x["config"] == name)
    for name, config in configs.items():
        held = B.positions(predictions, prices, config)
        own = B.equity_curve(held, config)
        trades = B.trades(held, config)
        assert rows(curve, name) == sorted(repr(plain(x)) for x in own.collect()) and rows(ledger, name) == sorted(repr(plain(x)) for x in trades.collect())
        assert rows(metrics, name) == [repr(plain(B.metrics(own, trades, config).first()))]


def test_a_chain_of_fallbacks_takes_few_jobs(spark):
    """Nothing is ever picked and nothing may stay: every period falls back."""
    prices = _prices(spark, {s: [10.0 + (s * i) % 7 for i in range(60)] for s in range(6)})
    predictions = prices.select("stock", "d", (F.col("stock") / 10).alias("p"))
    config = B.Config(rebalance=1, entry=200.0, leave=150.0, execution="close", least=3)
    group = "fallbacks"
    spark.sparkContext.setJobGroup(group, group)
    held = B.positions(predictions, prices, config).where("chosen").collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.stock for r in held} == {3, 4, 5} and len(held) == 59 * 3 and jobs < 25


def test_days_without_forecasts_are_no_days(spark):
    rows = [(s, d, None if i in (2, 5) else 0.5) for s in (1, 2) for i, d in enumerate(days(9))]
    got = B.calendar(spark.createDataFrame(rows, "stock int, d date, p double"), 2).orderBy("period").collect()
    left = [d for i, d in enumerate(days(9)) if i not in (2, 5)][::2]
    assert [(r.d, r.next) for r in got] == list(zip(left, left[1:]))


# audits, stores, streams


def test_a_build_that_returns_nothing_is_no_clean_audit(spark):
    own = spark.createDataFrame([(s, d, 1.0 + s) for s in (1, 2) for d in days(20)], "stock int, d date, c double")
    build = lambda sources, by: sources["bars"].where("false" if by else "true")
    compared = S.frame_comparison(build, {"bars": own}, ["c"])
    counts = S.audit_counts(compared).collect()
    assert len(counts) == 3 and all((r.compared, r.differing, r.one_sided) == (0, 0, 2) for r in counts)
    assert S.frame_mismatches(build, {"bars": own}, ["c"]).count() == 6
    same = S.audit_counts(S.frame_comparison(lambda s, by: s["bars"], {"bars": own}, ["c"])).collect()
    assert len(same) == 3 and all((r.compared, r.differing, r.one_sided) == (2, 0, 0) for r in same)


def test_versions_of_a_model(spark, tmp_path):
    from panelspark.sources import io

    rows = spark.createDataFrame([(float(i % 5), float(i % 2)) for i in range(40)], "a double, label double")
    models = [M.fit(rows, ["a"], {"maxDepth": 1}, n) for n in (1, 2)]
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        io.load_model(spark, path)
    models[0].write().save(f"{path}/versions/half/model")  # without a manifest
    with pytest.raises(FileNotFoundError):
        io.load_model(spark, path)
    assert [io.save_model(m, path, {"trees": n}) for n, m in enumerate(models, 1)] == [1, 2]
    with pytest.raises(FileExistsError):
        io._write_small(spark, f"{path}/manifests/00000002.json", "{}")
    assert io.load_model(spark, path)[1] == {"trees": "2"} and io.load_model(spark, path, version=1)[1] == {"trees": "1"}
    assert {(r.version, r.key, r.value) for r in io.versions(spark, path).collect()} == {(1, "trees", "1"), (2, "trees", "2")}
    with pytest.raises(ValueError):
        io.load_model(spark, path, ("horizon",))


def test_late_and_repeated_ticks_over_a_restart(spark, tmp_path):
    from panelspark.streaming import bars as ST
    from panelspark.streaming.late import bars_and_late_ticks

    at = lambda m: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m)
    batches = [
        [("a", at(1), 5.0, 1), ("a", at(1), 5.0, 1), ("a", at(3), 4.0, 2)],
        [("a", at(70), 7.0, 4), ("a", at(2), 9.0, 3), ("b", at(1), 1.0, 9)],  # 3 comes with the tick that closes its bar
        [("a", at(4), 1.0, 5), ("a", at(3), 4.0, 2), ("a", at(70), 7.0, 4)],  # two for a closed bar, one again
        [("a", at(200), 2.0, 6)],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "stock string, ts timestamp, price double, tick long").coalesce(1).write.mode("append").parquet(source)
        if i != 0:
            stream = spark.readStream.schema("stock string, ts timestamp, price double, tick long").option("maxFilesPerTrigger", 1).parquet(source)
            ST.run_available(bars_and_late_ticks(stream), out, str(tmp_path / "state"))
    got = spark.read.parquet(out).collect()
    bars = sorted((r.stock, r.start, r.o, r.h, r.l, r.c, r.v, r.repeats) for r in got if r.kind == "bar")
    assert bars == [("a", at(0), 5.0, 9.0, 4.0, 4.0, 3, 1), ("a", at(60), 7.0, 7.0, 7.0, 7.0, 1, 1)]
    assert sorted((r.tick, r.ts, r.price) for r in got if r.kind == "late") == [(2, at(3), 4.0), (5, at(4), 1.0)]


NEW = ["x11_votes", "x18_point_in_time", "b19_sweep", "b12_total_loss", "m12_repeated_rows", "m13_tree_attributions", "m3_staged_scores", "c11_median_fill", "s10_model_store", "s3_bars_laid_out", "s7_changed_sector", "c13_rows_a_stock", "st2_late_and_repeated_ticks", "st3_repeated_ticks"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    import test_panel

    test_panel.test_query_equals_sql(spark, name)
