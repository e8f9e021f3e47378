"""Hand-made edge cases of the panel operators, and the registered queries against their SQL."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from panelspark.functions import windows as W
from panelspark.operators import backtest as B
from panelspark.operators import context as X
from panelspark.operators import indicators as I
from panelspark.operators import selection as S

DAY = dt.date(2020, 1, 1)


def bars(spark, closes, stock=1):
    rows = [(stock, 0, DAY + dt.timedelta(days=i), c, c, c, c, 10.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "stock int, sector int, d date, o double, h double, l double, c double, v double")


def column(df, name, order="d"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_rolling_needs_all_its_rows(spark):
    got = column(bars(spark, [float(i) for i in range(1, 22)]).select("d", W.mean(F.col("c"), 20, W.over()).alias("m")), "m")
    assert got[:19] == [None] * 19 and got[19:] == [10.5, 11.5]


def test_constant_close(spark):
    x = I.baseline(bars(spark, [5.0] * 30)).orderBy("d").collect()[-1]
    assert x["RSI"] == 0 and x["BB_PctB"] == 0 and x["Stoch_K"] == 0


def test_first_rsi_is_at_the_fifteenth_close(spark):
    got = column(I.baseline(bars(spark, [10.0 + i % 3 for i in range(16)])), "RSI")
    assert got[:14] == [None] * 14 and got[14] is not None


@pytest.mark.parametrize("longest", [100, 4096])
def test_ewm_over_many_blocks(spark, monkeypatch, longest):
    monkeypatch.setattr(W, "EWM_LONGEST", longest)
    values = [math.sin(i) * 10 + 50 + i % 7 for i in range(1500)]
    rows = [(k, DAY + dt.timedelta(days=i), None if i < k else v) for k in (0, 3) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "stock int, d date, c double")
    for a, least in ((0.2, 1), (1 / 14, 14), (2 / 51, 50)):
        got = {(r.stock, r.d): r.y for r in W.ewm(df, {"y": ("c", a, least)}).collect()}
        for k in (0, 3):
            y, n = None, 0
            for i, v in enumerate(values):
                if i >= k:
                    y, n = v if y is None else (1 - a) * y + a * v, n + 1
                want = y if n >= least else None
                found = got[k, DAY + dt.timedelta(days=i)]
                assert found is None if want is None else abs(found - want) < 1e-9


def test_labels_are_strict_and_unknown_at_the_end(spark):
    got = column(I.add_labels(bars(spark, [1000.0, 1000.0 * 1.005, 2000.0]), {"T": 1}), "Target_T")
    assert got == [0.0, 1.0, None]


def test_percentile_of_ties(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0), (1, None)], "d int, p double")
    assert sorted(column(df.select("d", W.pct_rank(F.col("p"), ["d"]).alias("r")), "r"), key=str) == sorted([1 / 3, 2.5 / 3, 2.5 / 3, None], key=str)


def test_asof_is_strict_and_bounded(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    days = spark.createDataFrame([(day(n),) for n in (10, 15, 16)], "d date")
    source = spark.createDataFrame([(day(10), 1.0)], "d date, c double")
    got = {r.d: r.c for r in X.asof_before(days, source, 5).collect()}
    assert got == {day(10): None, day(15): 1.0, day(16): None}


def test_sector_needs_two_peers(spark):
    two = bars(spark, [1.0, 2.0, 3.0], 1).union(bars(spark, [1.0, 2.0, 4.0], 2))
    assert set(column(X.sector_levels(two), "c")) == {None}
    three = two.union(bars(spark, [1.0, 2.0, 8.0], 3))
    got = X.sector_levels(three).where("stock = 1").orderBy("d").collect()
    assert got[0].c is None and abs(got[2].c - 2 * math.exp((math.log(2) + math.log(4)) / 2)) < 1e-9


def test_coarse_bars_must_be_reached(spark):
    at = lambda m: dt.datetime(2020, 1, 1, 9, m)
    row = lambda m: (1, at(m), at(m) + dt.timedelta(minutes=5), DAY, 1.0, 1.0, 1.0, 1.0, 1)
    schema = "stock int, start timestamp, bar_end timestamp, session date, o double, h double, l double, c double, v int"
    got = lambda ms: column(X.resample_bars(spark.createDataFrame([row(m) for m in ms], schema), 15), "start", "start")
    assert got([15, 20]) == [] and got([15, 25]) == [at(15)] and got([15, 30]) == [at(15)]


def test_backtest_by_hand(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(4)]
    prices = [(s, d, float(10 + s * i), float(10 + s * i)) for s in (1, 2, 3) for i, d in enumerate(days)]
    prices = spark.createDataFrame(prices, "stock int, d date, o double, c double")
    predictions = prices.select("stock", "d", (F.col("stock") / 10).alias("p"))
    config = B.Config(rebalance=1, execution="close", least=3)
    held = B.positions(predictions, prices, config)
    curve = B.equity_curve(held, config).orderBy("step").collect()
    assert [r.positions for r in curve] == [3, 3, 3]
    weights, equity, before = {s: 1 / 3 for s in (1, 2, 3)}, 1.0, {}
    for i, r in enumerate(curve):
        gross = {s: (10 + s * (i + 1)) / (10 + s * i) - 1 for s in weights}
        turnover = sum(abs(weights[s] - before.get(s, 0)) for s in weights)
        net = sum(weights[s] * gross[s] for s in weights) - turnover * config.rate
        total = sum(w * (1 + gross[s]) for s, w in weights.items())
        before = {s: w * (1 + gross[s]) / total for s, w in weights.items()}
        if i == 2:
            net = (1 + net) * (1 - config.rate) - 1
        equity *= 1 + net
        assert abs(r.period_return - net) < 1e-12 and abs(r.equity - equity * config.capital) < 1e-3


def test_hysteresis_with_the_fallback(spark):
    import random

    r = random.Random(3)
    days = [DAY + dt.timedelta(days=i) for i in range(30)]
    p = {(s, d): r.random() for s in range(8) for d in days if r.random() < 0.8}
    rows = [(s, d, 1.0, 1.0, p.get((s, d))) for s in range(8) for d in days]
    prices = spark.createDataFrame(rows, "stock int, d date, o double, c double, p double")
    config = B.Config(rebalance=1, entry=75.0, leave=45.0, execution="close", least=3)
    held = B.positions(prices.where("p is not null").select("stock", "d", "p"), prices, config).where("chosen")
    got = {(x.d, x.stock) for x in held.collect()}
    want, before = set(), set()
    for d in days[:-1]:
        day = {s: v for (s, e), v in p.items() if e == d}
        if len(day) < 3:
            continue
        order = sorted(day, key=day.get)
        pct = {s: (i + 1) / len(order) * 100 for i, s in enumerate(order)}
        chosen = {s for s in day if pct[s] >= 75 or (s in before and pct[s] >= 45)}
        if len(chosen) < 3:
            chosen = set(order[-3:])
        want |= {(d, s) for s in chosen}
        before = chosen
    assert got == want


def test_forbidden_names(spark):
    assert column(S.forbidden_names(spark, ["next_close", "RSI", "Target_x"]), "feature", "feature") == ["Target_x", "next_close"]


def test_missing_reports_and_models(spark, tmp_path):
    from panelspark.operators import models as M
    from panelspark.sources import io

    rows = spark.createDataFrame([(float(i % 7), float(i % 5) if i % 3 else None, float(i % 2)) for i in range(60)], "a double, b double, label double")
    model = M.fit(rows, ["a", "b"], {"maxDepth": 2}, 2)
    io.save_model(model, str(tmp_path / "m"), {"features": "a,b"})
    again, metadata = io.load_model(spark, str(tmp_path / "m"), ("features",))
    assert metadata == {"features": "a,b"}
    assert column(M.score(again, rows, ["a", "b"]), "p", "a") == column(M.score(model, rows, ["a", "b"]), "p", "a")
    staged = M.staged_scores(model, rows, ["a", "b"], [2]).select((F.col("p_2")).alias("x"))
    assert abs(staged.agg(F.sum("x")).first()[0] - M.score(model, rows, ["a", "b"]).agg(F.sum("p")).first()[0]) < 1e-9
    with pytest.raises(ValueError):
        io.load_model(spark, str(tmp_path / "m"), ("horizon",))


QUICK = ["c1_clean_daily", "w_primitives", "w7_ewm", "j3_fx_asof", "t1_resample", "l4_fold_roles", "e_metrics", "b12_equity_curve", "q2_stats_row", "st1_streaming_bars", "momentum_quintiles"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    from panelspark.plans.registry import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, folder)
    names = sorted(got.columns)
    want = con.execute(ORACLE_SQL[name]).to_arrow_table().select(names).to_pylist()
    plain = lambda rows: sorted(repr([(str(v)[:19] if isinstance(v, dt.date) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else v) for v in r]) for r in rows)
    assert plain([r.values() for r in want]) == plain([[r[n] for n in names] for r in got.collect()])


FILTER = " AND (stock * 7919 + date_diff('day', DATE '1970-01-01', d) * 104729 + 42) % 10 = 0"


@pytest.mark.parametrize("name", ["x2_low_coverage", "x4_spearman", "x4_target_correlation", "x7_mutual_information", "x11_votes", "x14_single_feature_auc", "q10_top_features", "q12_feature_percentiles"])
def test_selection_reads_all_labelled_rows(spark, name):
    """Against the registered SQL without its filter, which keeps a tenth of the rows."""
    from panelspark.plans.registry import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"  # where Sparse has no value at all
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, folder)
    names = sorted(got.columns)
    found = con.execute(ORACLE_SQL[name].replace(FILTER, ""))
    order = [[c[0] for c in found.description].index(n) for n in names]
    plain = lambda v: str(v) if isinstance(v, dt.date) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else v
    want = sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())
    assert want and want == sorted(repr([plain(r[n]) for n in names]) for r in got.collect())


def test_pivot_has_every_region(spark):
    from panelspark.plans.registry import QUERIES
    from panelspark.sources import tables as T

    folder = "/root/testdata/sf0.001"
    last = {}
    for r in T.nation_bars(spark, folder).collect():
        key = (r.d, f"s{r.sector}")
        last[key] = max(last.get(key, (-1, 0.0)), (r.stock, r.c))
    got = QUERIES["a2_pivot_panel"](spark, folder)
    assert got.columns == ["d", "s0", "s1", "s2", "s3", "s4"]
    assert {(r.d, n): r[n] for r in got.collect() for n in got.columns[1:] if r[n] is not None} == {k: c for k, (_, c) in last.items()}


def test_ranks_by_ranges_of_values(spark):
    from panelspark.functions.ranks import value_ranks
    from panelspark.operators.evaluation import mid_ranks

    values = [("a", 1.0), ("a", 1.0), ("a", 5.0), ("a", None), ("b", 2.0), ("b", -1.0), ("b", 2.0), ("b", 2.0)]
    got = value_ranks(spark.createDataFrame(values, "feature string, x double"), ["feature"], "x").collect()
    assert {(r.feature, r.x): round(r["rank"], 9) for r in got} == {("a", 1.0): 0.5, ("a", 5.0): 1.0, ("b", -1.0): 0.25, ("b", 2.0): 0.75}
    reference = spark.createDataFrame([(0.1,), (0.2,), (0.20005,), (0.9,)], "p double")
    rows = spark.createDataFrame([(1, 0.2), (2, 0.95), (3, 0.0), (4, 0.2)], "stock int, p double")
    assert {r.stock: r.pct for r in mid_ranks(rows, reference).collect()} == {1: 50.0, 2: 100.0, 3: 0.0, 4: 50.0}


def test_spearman_with_missing_values(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (80, 4)).astype(float)
    x[:, 3] = 1.0
    rows = [(i, *[None if k == 1 and i % 3 == 0 else float(v) for k, v in enumerate(r)]) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "i int, a double, b double, c double, e double")

    def rank(v):
        return np.array([(v < y).sum() + ((v == y).sum() + 1) / 2 for y in v])

    want = {}
    for m, a in enumerate("abc"):
        for n, b in list(enumerate("abc"))[m + 1 :]:
            both = [(r[m + 1], r[n + 1]) for r in rows if r[m + 1] is not None and r[n + 1] is not None]
            want[a, b] = np.corrcoef(*[rank(np.array(v)) for v in zip(*both)])[0, 1]
    got = {(r.a, r.b): r.rho for r in S.spearman(frame, ["a", "b", "c", "e"]).collect()}
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and all(got[k, "e"] is None for k in "abc")


def test_volatility_on_the_calendar_of_all_stocks(spark):
    import statistics

    days = [DAY + dt.timedelta(days=i) for i in range(30)]
    close = {(s, d): 10.0 + (i * (s + 3)) % 7 for s in (1, 2) for i, d in enumerate(days) if not (s == 2 and i == 5)}
    prices = spark.createDataFrame([(s, d, c) for (s, d), c in close.items()], "stock int, d date, c double")
    got = {(r.stock, r.d): r.vol for r in B.calendar_volatility(prices).collect()}
    for (s, d), vol in got.items():
        i = days.index(d)
        near = [(close.get((s, days[j - 1])), close.get((s, days[j]))) for j in range(i - 19, i + 1) if j > 0]
        whole = len(near) == 20 and all(a is not None and b is not None for a, b in near)
        assert (vol is not None) == whole
        if whole:
            assert abs(vol - statistics.stdev(math.log(b / a) for a, b in near)) < 1e-12


def test_votes_harm_and_redundancy(spark):
    scores = [("a", 0.9, 0.9, 0.9, 0.1, 1.0), ("b", 0.8, 0.8, 0.8, 0.2, 1.0), ("c", 0.7, 0.7, 0.7, -0.1, 0.25), ("d", 0.1, 0.1, 0.1, 0.0, 0.5), ("f", 0.2, 0.2, 0.2, 0.05, 0.5)]
    scores = spark.createDataFrame(scores, "feature string, mi double, gain double, attribution double, permutation double, positive_folds double")
    voted = S.votes(scores, ["mi", "gain", "permutation", "attribution"])
    assert {r.feature: (r.votes, r.harmful, r.selected) for r in voted.collect()} == {
        "a": (4, False, True), "b": (4, False, True), "c": (3, True, False), "d": (0, False, False), "f": (1, False, False)}
    pairs = spark.createDataFrame([("a", "b", -0.95), ("a", "d", 0.99)], "a string, b string, rho double")
    chosen = S.best_of_clusters(voted, S.clusters(pairs, voted.where("selected").select("feature")))
    assert {(r.feature, r.of, r.stays) for r in chosen.collect()} == {("a", "a", True), ("b", "a", False)}
    names = spark.createDataFrame([(x,) for x in "abcdfg"], "feature string")
    invalid = spark.createDataFrame([("g", "price level")], "feature string, reason string")
    assert column(S.drop_invalid(names, invalid), "feature", "feature") == [*"abcdf"]
    got = S.report(names, invalid, voted, chosen).collect()
    assert [r.feature for r in got if r.selected] == ["a"]
    assert {r.feature: r.removal_reason for r in got} == {
        "a": "", "b": "follows a", "c": "shuffling it improves held-out forecasts", "d": "too few methods rank it high",
        "f": "too few methods rank it high", "g": "price level"}


def test_choice_of_models(spark):
    from panelspark.operators import models as M

    days = [DAY + dt.timedelta(days=i) for i in range(8)]
    rows = [(s, d, float((s + i) % 2), (s * 3 + i * 5) % 11 / 11, i // 4) for s in range(6) for i, d in enumerate(days)]
    oof = spark.createDataFrame(rows, "stock int, d date, label double, p double, fold int")
    test = oof.drop("fold")
    result = lambda name, family, aucs, frame=oof: M.Result(name, family, "x", 1, ["f"], aucs, frame, test)
    a, b, c = result("a", "plain", [0.5, 0.6]), result("b", "sampled", [0.6, 0.6]), result("c", "sampled", [0.7, 0.5])
    ensemble = M.ensemble_of([a, b, c])
    assert ensemble.parts == (a, b) and len(ensemble.fold_aucs) == 2  # the first of equals
    assert M.choose([a, b, c], None) is b and M.choose([a, b], M.Result("e", "ensemble", None, None, [], [0.6, 0.6], None, test)) is b
    assert M.choose([a, b], M.Result("e", "ensemble", None, None, [], [0.7, 0.6], None, test)).name == "e"
    assert M.ensemble_of([a]) is None
    table = {r.experiment: r for r in M.comparison(spark, [a, b, ensemble], b).collect()}
    assert table["b"].chosen and not table["a"].chosen and table["a"].val_roc_auc is not None and table[ensemble.name].val_roc_auc is None


def test_stored_bars_reports_and_alignment(spark, tmp_path):
    from panelspark.sources import io
    from panelspark.sources import tables as T

    path = str(tmp_path / "bars")
    bars(spark, [1.0, 2.0, 3.0]).unionByName(bars(spark, [4.0, 5.0, 6.0], 7)).write.parquet(path)
    read = T.read_bars(spark, path, [7], DAY + dt.timedelta(days=1))
    assert column(read, "c") == [5.0, 6.0]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(stock,7)" in plan.replace(" ", "") and "GreaterThanOrEqual(d" in plan
    io.write_report(spark.createDataFrame([("x", "y")], "feature string, reason string"), str(tmp_path / "audit"), "json")
    assert io.read_named_report(spark, str(tmp_path), "audit", "json").collect()[0].asDict() == {"feature": "x", "reason": "y"}
    assert all(io.read_named_report(spark, str(tmp_path / "none"), n).count() == 0 for n in io.REPORTS)
    at = lambda day, h, m=0: dt.datetime(2020, 1, day, h, m)
    frame = spark.createDataFrame([(DAY, at(1, 15, 30), at(1, 15, 35), None), (DAY, at(2, 9), None, at(1, 12))], "d date, `5m_bar_end` timestamp, `15m_bar_end` timestamp, `1h_bar_end` timestamp")
    assert {r.timeframe: (r.bars_after_close, r.bars_from_other_session) for r in X.misaligned_bars(frame).collect()} == {"5m": (1, 1), "15m": (1, 0), "1h": (0, 0)}


def test_a_stream_drops_what_it_has_seen(spark, tmp_path):
    from panelspark.streaming import bars as ST

    t = dt.datetime(2024, 1, 1, 10)
    rows = [(1, t, 1.0), (1, t, 2.0), (2, t, 3.0), (1, t + dt.timedelta(minutes=5), 4.0)]
    spark.createDataFrame(rows, "stock int, start timestamp, c double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stock int, start timestamp, c double").parquet(str(tmp_path / "in"))
    ST.run_available(ST.deduplicated(source), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.stock, r.start) for r in got) == sorted({(s, x) for s, x, _ in rows})


def test_a_leak_in_any_source_is_found(spark):
    """A frame whose market features look one day ahead, and one whose day takes bars after the close."""
    days = [DAY + dt.timedelta(days=i) for i in range(40)]
    own = spark.createDataFrame([(s, d, 10.0 + (i * (s + 2)) % 9) for s in (1, 2) for i, d in enumerate(days)], "stock int, d date, c double")
    market = own.where("stock = 1").select("d", "c")
    fine = spark.createDataFrame([(1, d, dt.datetime.combine(d, dt.time(h, 0)), float(h)) for d in days for h in (12, 17)], "stock int, session date, bar_end timestamp, c double")

    def build(sources, by, ahead=0, close=930):
        w = W.Window.partitionBy(*by).orderBy("d")
        context = sources["market"].select(*by, "d", (F.lead("c", ahead).over(w) if ahead else F.col("c")).alias("m"))
        last = sources["5m"].where(F.col("bar_end") <= F.col("session").cast("timestamp") + F.expr(f"INTERVAL {close} MINUTES"))
        last = last.groupBy(*by, "stock", F.col("session").alias("d")).agg(F.max_by("c", "bar_end").alias("x"))
        return sources["bars"].join(context, [*by, "d"], "left").join(last, [*by, "stock", "d"], "left")

    sources = {"bars": own, "market": market, "5m": fine}
    found = lambda **k: {(r.stock, r.feature) for r in S.frame_mismatches(lambda a, b: build(a, b, **k), sources, ["c", "m", "x"]).collect()}
    assert found() == set() and found(ahead=1) == {(1, "m"), (2, "m")} and found(close=1440) == {(1, "x")}
