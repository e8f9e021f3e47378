"""Queries for views, sinks, streams and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import windows as W
from panelspark.operators import context as X
from panelspark.operators import indicators as I
from panelspark.plans import selection as SEL
from panelspark.plans import sql as S
from panelspark.plans.context import (
    CONTEXT_SQL,
    DAILY,
    FILLED,
    FX_NAMES,
    INDEX_NAMES,
    MTF,
    OFFICIAL,
    QUARTET,
    RELATIVE,
    SECTOR,
    SECTOR_NAMES,
    TIMEFRAME_SQL,
    intraday,
    official_sectors,
)
from panelspark.plans.evaluation import SCORED, backtest_sql, scored
from panelspark.plans.panel import rounded
from panelspark.sources import io
from panelspark.sources import tables as T
from panelspark.streaming import bars as ST

QUERIES, ORACLE_SQL = {}, {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def latest(df, by="stock", order="d"):
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("__turn", F.row_number().over(w)).where("__turn = 1").drop("__turn")


LATEST = "QUALIFY row_number() OVER (PARTITION BY stock ORDER BY d DESC) = 1"


@query("q1_last_quote", S.statement(S.BARS, f"SELECT stock, d, c, round(c / {S.lag('c')} - 1, 6) AS change FROM bars {LATEST}"))
def q1_last_quote(spark, d):
    bars = T.nation_bars(spark, d)
    return latest(bars.select("stock", "d", "c", F.round(W.pct_change(F.col("c"), W.over()), 6).alias("change")))


@query("q2_stats_row", S.statement(S.BARS, f"""r AS (SELECT *, {S.log_ratio('c', 1)} AS r, c / nullif({S.lag('c', 21)}, 0) - 1 AS m, c / nullif({S.lag('c', 252)}, 0) - 1 AS y, row_number() OVER (PARTITION BY stock ORDER BY d DESC) AS back FROM bars)""",
    "SELECT stock, round(max(CASE WHEN back = 1 THEN m END), 6) AS month_return, round(max(CASE WHEN back = 1 THEN y END), 6) AS year_return, max(h) AS high, min(l) AS low, round(stddev_samp(r) * sqrt(252), 6) AS volatility FROM r WHERE back <= 252 GROUP BY 1"))
def q2_stats_row(spark, d):
    w, c = W.over(), F.col("c")
    r = T.nation_bars(spark, d).withColumn("r", W.log_ratio(c, W.lag(c, 1, w))).withColumn("m", W.ratio(c, W.lag(c, 21, w)) - 1).withColumn("y", W.ratio(c, W.lag(c, 252, w)) - 1)
    r = r.withColumn("back", F.row_number().over(Window.partitionBy("stock").orderBy(F.desc("d")))).where("back <= 252")
    return r.groupBy("stock").agg(
        F.round(F.max(F.when(F.col("back") == 1, F.col("m"))), 6).alias("month_return"), F.round(F.max(F.when(F.col("back") == 1, F.col("y"))), 6).alias("year_return"),
        F.max("h").alias("high"), F.min("l").alias("low"), F.round(F.stddev_samp("r") * 252**0.5, 6).alias("volatility"))


TAGS = """CASE WHEN RSI > 70 THEN 'overbought' WHEN RSI < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_tag, CASE WHEN SMA50_Ratio > 1 THEN 'above' ELSE 'below' END AS sma50_tag,
    CASE WHEN SMA200_Ratio > 1 THEN 'uptrend' ELSE 'downtrend' END AS trend_tag, CASE WHEN SMA50_200_Ratio > 1 THEN 'golden' ELSE 'death' END AS cross_tag, CASE WHEN MACD_Hist_Ratio > 0 THEN 'bullish' ELSE 'bearish' END AS macd_tag,
    CASE WHEN Rel_Ret_63 > 0 THEN 'outperforming' WHEN Rel_Ret_63 <= 0 THEN 'underperforming' END AS relative_tag, round(High252_Dist, 6) + 0.0 AS from_high"""


@query("q4_signal_tags", S.statement(S.BARS, S.MARKET, QUARTET, S.BASELINE, FILLED.replace("AND dayofweek(b.d) <> 0", ""), f"both_ AS (SELECT b.*, r.Rel_Ret_63 FROM base b JOIN rel r USING (stock, d))", f"SELECT stock, {TAGS} FROM both_ {LATEST}"))
def q4_signal_tags(spark, d):
    x = latest(X.with_market(I.baseline(T.nation_bars(spark, d)), T.market_series(spark, d)))
    either = lambda test, a, b: F.when(test, a).otherwise(b)
    return x.select(
        "stock", F.when(F.col("RSI") > 70, "overbought").when(F.col("RSI") < 30, "oversold").otherwise("neutral").alias("rsi_tag"),
        either(F.col("SMA50_Ratio") > 1, "above", "below").alias("sma50_tag"), either(F.col("SMA200_Ratio") > 1, "uptrend", "downtrend").alias("trend_tag"),
        either(F.col("SMA50_200_Ratio") > 1, "golden", "death").alias("cross_tag"), either(F.col("MACD_Hist_Ratio") > 0, "bullish", "bearish").alias("macd_tag"),
        F.when(F.col("Rel_Ret_63") > 0, "outperforming").when(F.col("Rel_Ret_63") <= 0, "underperforming").alias("relative_tag"),
        (F.round("High252_Dist", 6) + F.lit(0.0)).alias("from_high"))


#: The readings of a timeframe.
SNAPSHOT = ["RSI", "volatility", "return", "momentum", "momentum_z", "trend_direction", "rsi_regime", "price_vs_EMA", "ATR_pct", "MACD_hist_norm", "volume_change"]
FRAMES = ["5m", "15m", "1h", "daily"]


def trend(value):
    return F.when(value > 0, "uptrend").when(value < 0, "downtrend").when(value.isNotNull(), "mixed")


@query("q6_timeframe_snapshot", S.statement(S.BARS, *TIMEFRAME_SQL, DAILY, MTF, f"x AS (SELECT * FROM mtf {LATEST})",
    " UNION ALL ".join(f"""SELECT stock, '{p}' AS timeframe, '{n}' AS reading, round("{p}_{n}", 5) + 0.0 AS "value", CASE WHEN "{p}_trend_direction" > 0 THEN 'uptrend' WHEN "{p}_trend_direction" < 0 THEN 'downtrend' WHEN "{p}_trend_direction" IS NOT NULL THEN 'mixed' END AS trend FROM x""" for p in FRAMES for n in SNAPSHOT)))
def q6_timeframe_snapshot(spark, d):
    """All readings of the four timeframes on each stock's latest day, with the trend in words."""
    daily = I.technical(T.nation_bars(spark, d), "daily", *X.TIMEFRAMES["daily"])
    last = latest(X.with_timeframes(daily, intraday(spark, d)))
    rows = [F.struct(F.lit(p).alias("timeframe"), F.lit(n).alias("reading"), (F.round(F.col(f"`{p}_{n}`").cast("double"), 5) + F.lit(0.0)).alias("value"), trend(F.col(f"`{p}_trend_direction`")).alias("trend")) for p in FRAMES for n in SNAPSHOT]
    return last.select("stock", F.explode(F.array(*rows)).alias("x")).select("stock", "x.*")


@query("q8_live_metadata", S.statement(S.BARS, S.MARKET, S.FX, SECTOR, OFFICIAL, S.SESSION_BARS, S.coarser("b15", 15), S.coarser("b60", 60), """ends AS (SELECT s.stock, max(a.bar_end) AS last_5m FROM (SELECT DISTINCT stock FROM bars) s LEFT JOIN fine a ON a.stock = s.stock GROUP BY 1),
    e15 AS (SELECT stock, max(bar_end) AS last_15m FROM b15 GROUP BY 1), e60 AS (SELECT stock, max(bar_end) AS last_1h FROM b60 GROUP BY 1),
    src AS (SELECT stock, bool_or(c IS NOT NULL) AS has FROM level GROUP BY 1),
    rets AS (SELECT stock, d, """ + ", ".join(f"{S.log_ratio('c', n)} AS r{n}" for n in (1, 20, 252)) + """ FROM bars QUALIFY row_number() OVER (PARTITION BY stock ORDER BY d DESC) = 1)""",
    "own AS (SELECT stock, max(d) AS last_date, count(*) AS n FROM bars GROUP BY 1)",
    """SELECT n_name AS name, n_regionkey AS sector, CASE WHEN n_regionkey = 0 THEN 'index:market' WHEN n_regionkey = 3 THEN 'index:fx' WHEN has THEN 'peers:' || n_regionkey END AS sector_source, last_date, last_5m, last_15m, last_1h,
    round(((r1 IS NOT NULL)::INT + (r20 IS NOT NULL)::INT + (r252 IS NOT NULL)::INT) / 3.0, 6) AS coverage, n
    FROM own b JOIN nation ON n_nationkey = b.stock LEFT JOIN ends USING (stock) LEFT JOIN e15 USING (stock) LEFT JOIN e60 USING (stock) LEFT JOIN src USING (stock) LEFT JOIN rets r USING (stock)"""))
def q8_live_metadata(spark, d):
    """What a stock's live view rests on: sector and its source, the last bar of each interval, and how much of its latest row is filled."""
    nation = T.read_table(spark, d, "nation").select(F.col("n_nationkey").alias("stock"), F.col("n_name").alias("name"))
    bars, w = T.nation_bars(spark, d), W.over()
    own = bars.groupBy("stock", "sector").agg(F.max("d").alias("last_date"), F.count(F.lit(1)).alias("n")).join(F.broadcast(nation), "stock")
    source = X.sector_series(bars, official_sectors(spark, d)).groupBy("stock").agg(F.max("source").alias("sector_source"))
    fine = intraday(spark, d)
    fine["15m"] = X.resample_bars(fine["5m"], 15)
    x = own.join(source, "stock", "left")
    for p in ("5m", "15m", "1h"):
        ends = fine[p].groupBy("stock").agg(F.max("bar_end").cast("timestamp_ntz").alias(f"last_{p}"))
        x = x.join(ends, "stock", "left")
    row = latest(bars.select("stock", "d", *[W.log_ratio(F.col("c"), W.lag(F.col("c"), n, w)).alias(f"r{n}") for n in (1, 20, 252)]))
    filled = sum((F.col(f"r{n}").isNotNull().cast("int") for n in (1, 20, 252)), F.lit(0)) / 3
    x = x.join(row.select("stock", F.round(filled, 6).alias("coverage")), "stock", "left")
    return x.select("name", "sector", "sector_source", "last_date", "last_5m", "last_15m", "last_1h", "coverage", "n")


@query("q13_relative_strength", S.statement(S.BARS, S.MARKET, f"o AS (SELECT stock, d, {S.log_ratio('c', 20)} AS r FROM bars), m AS (SELECT d, {S.log_ratio('c', 20, 'ORDER BY d')} AS r FROM market), x AS (SELECT o.stock, o.d, (o.r - m.r) * 100 AS strength, row_number() OVER (PARTITION BY o.stock ORDER BY o.d DESC) AS back FROM o LEFT JOIN m ON m.d = o.d)", S.rounded("x WHERE back <= 252", ["stock", "d"], ["strength"])))
def q13_relative_strength(spark, d):
    """The last 252 rows of each stock's month against the market's, in per cent."""
    w = W.over()
    own = T.nation_bars(spark, d).select("stock", "d", W.log_ratio(F.col("c"), W.lag(F.col("c"), 20, w)).alias("r"))
    index = X.index_features(T.market_series(spark, d), "index").select("d", "index_return_20")
    both = own.join(F.broadcast(index), "d", "left").withColumn("strength", (F.col("r") - F.col("index_return_20")) * 100)
    both = both.withColumn("back", F.row_number().over(Window.partitionBy("stock").orderBy(F.desc("d")))).where("back <= 252")
    return rounded(both, ["stock", "d"], ["strength"])


#: The readings of a market snapshot.
SNAP = [*INDEX_NAMES, *SECTOR_NAMES, "vix", "vix_change", "vix_return", "vix_volatility", *FX_NAMES, *RELATIVE]


@query("q5_market_snapshot", S.statement(*CONTEXT_SQL, f"x AS (SELECT * FROM ctx {LATEST})",
    " UNION ALL ".join(f"""SELECT stock, d, '{n}' AS reading, round({n}, 6) + 0.0 AS "value", CASE WHEN '{n}' <> 'vix' THEN CASE WHEN {n} > 0 THEN 'up' WHEN {n} <= 0 THEN 'down' END WHEN {n} > 20 THEN 'high' WHEN {n} <= 20 THEN 'calm' END AS band FROM x""" for n in SNAP)))
def q5_market_snapshot(spark, d):
    """All context readings of each stock's latest day; the volatility index in bands, the others by their direction."""
    last = latest(X.market_features(T.nation_bars(spark, d), T.market_series(spark, d), T.volatility_series(spark, d), T.fx_series(spark, d)))
    rows = []
    for n in SNAP:
        x = F.col(n)
        band = F.when(x > 20, "high").when(x <= 20, "calm") if n == "vix" else F.when(x > 0, "up").when(x <= 0, "down")
        rows.append(F.struct(F.lit(n).alias("reading"), (F.round(x.cast("double"), 6) + F.lit(0.0)).alias("value"), band.alias("band")))
    return last.select("stock", "d", F.explode(F.array(*rows)).alias("x")).select("stock", "d", "x.*")


@query("q10_top_features", S.statement(*SEL.BASE, SEL.AUCS, "SELECT feature, round(abs(auc - 0.5), 6) AS importance, row_number() OVER (ORDER BY round(abs(auc - 0.5), 9) DESC, feature) AS place FROM a QUALIFY place <= 5"))
def q10_top_features(spark, d):
    """The features of the largest single-feature importance."""
    x = SEL.labelled(spark, d)
    found = SEL.X.single_feature_auc(SEL.X.long_form(x, SEL.EXACT, [*SEL.USED, *SEL.EXTRA]), x.select(*SEL.EXACT, "y"), SEL.EXACT)
    found = found.withColumn("importance", F.abs(F.col("roc_auc") - 0.5))
    top = found.orderBy(F.desc(F.round("importance", 9)), "feature").limit(5)
    return top.select("feature", F.round("importance", 6).alias("importance"), F.row_number().over(Window.orderBy(F.desc(F.round("importance", 9)), "feature")).alias("place"))


@query("q12_feature_percentiles", S.statement(*SEL.BASE, f"SELECT stock, d, feature, round({S.pct_rank('x', 'feature')}, 6) AS pct FROM long WHERE x IS NOT NULL AND feature IN ('RSI', 'Ret_5')"))
def q12_feature_percentiles(spark, d):
    """Where each row's value lies among the feature's values."""
    x = SEL.X.long_ranks(SEL.long(spark, d).where("feature in ('RSI', 'Ret_5')"))
    return x.select("stock", "d", "feature", F.round("rank", 6).alias("pct"))


@query("q10_selection_counts", S.statement(*SEL.BASE, SEL.AUCS, SEL.PAIRS, "near AS (SELECT DISTINCT b AS feature FROM rho WHERE abs(rho) >= 0.9)", """SELECT (SELECT count(DISTINCT feature) FROM long) AS candidates, (SELECT count(*) FROM a WHERE abs(auc - 0.5) > 0.01) AS selected,
    (SELECT count(DISTINCT feature) FROM long) - (SELECT count(*) FROM a WHERE abs(auc - 0.5) > 0.01) AS removed, (SELECT string_agg(feature, ',' ORDER BY feature) FROM near) AS redundant"""))
def q10_selection_counts(spark, d):
    """Candidates, those with an edge of their own, the rest, and the features that follow another one closely."""
    x = SEL.labelled(spark, d)
    names = [*SEL.USED, *SEL.EXTRA]
    found = SEL.X.single_feature_auc(SEL.X.long_form(x, SEL.EXACT, names), x.select(*SEL.EXACT, "y"), SEL.EXACT)
    edge = found.agg(F.count_if(F.abs(F.col("roc_auc") - 0.5) > 0.01).alias("selected"))
    near = SEL.X.spearman(x, names).where("abs(rho) >= 0.9").agg(F.array_join(F.array_sort(F.collect_set("b")), ",").alias("redundant"))
    both = edge.join(near, F.lit(True))
    return both.select(F.lit(len(names)).alias("candidates"), "selected", (F.lit(len(names)) - F.col("selected")).alias("removed"), F.nullif("redundant", F.lit("")).alias("redundant"))


@query("q11_correlation_matrix", S.statement(*SEL.BASE, SEL.AUCS, SEL.PAIRS, "top AS (SELECT feature FROM a ORDER BY round(abs(auc - 0.5), 9) DESC, feature LIMIT 5)", """SELECT a, b, round(rho, 6) + 0.0 AS rho FROM rho WHERE a IN (SELECT feature FROM top) AND b IN (SELECT feature FROM top)
    UNION ALL SELECT b, a, round(rho, 6) + 0.0 FROM rho WHERE a IN (SELECT feature FROM top) AND b IN (SELECT feature FROM top) UNION ALL SELECT feature, feature, 1.0 FROM top"""))
def q11_correlation_matrix(spark, d):
    """Rank correlations among the features of the largest importance, both ways and with themselves."""
    x = SEL.labelled(spark, d)
    names = [*SEL.USED, *SEL.EXTRA]
    found = SEL.X.single_feature_auc(SEL.X.long_form(x, SEL.EXACT, names), x.select(*SEL.EXACT, "y"), SEL.EXACT)
    top = found.orderBy(F.desc(F.round(F.abs(F.col("roc_auc") - 0.5), 9)), "feature").limit(5).select("feature")
    top = io.stored(top, "top-features")
    pairs = SEL.X.spearman(x, [r["feature"] for r in top.collect()]).withColumn("rho", F.round("rho", 6) + F.lit(0.0))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho")).unionByName(top.select(F.col("feature").alias("a"), F.col("feature").alias("b"), F.lit(1.0).alias("rho")))


#: Rows of the chart ranges.
RANGES = {"3M": 63, "6M": 126, "1Y": 252, "3Y": 756, "Max": None}


@query("q15_chart_range", S.statement(S.BARS, "r AS (SELECT *, row_number() OVER (PARTITION BY stock ORDER BY d DESC) AS back FROM bars)", " UNION ALL ".join(f"""SELECT stock, '{n}' AS "range", count(*) AS n, min(d) AS first_day, max(h) AS high, min(l) AS low FROM r {f'WHERE back <= {k}' if k else ''} GROUP BY 1""" for n, k in RANGES.items())))
def q15_chart_range(spark, d):
    """The part of each stock's history that each range of the chart shows."""
    back = F.row_number().over(Window.partitionBy("stock").orderBy(F.desc("d")))
    ranges = spark.createDataFrame([*RANGES.items()], "range string, rows int")
    shown = T.nation_bars(spark, d).withColumn("back", back).join(F.broadcast(ranges), F.col("rows").isNull() | (F.col("back") <= F.col("rows")))
    return shown.groupBy("stock", "range").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_day"), F.max("h").alias("high"), F.min("l").alias("low"))


#: The timeframes that a group of features reads.
GROUP_FRAMES = {"daily_mtf": ["daily"], "intraday_1h": ["1h"], "intraday_short": ["5m", "15m"]}


@query("q16_model_timeframes", """WITH g(region, grp) AS (SELECT n_regionkey, CASE WHEN n_nationkey % 4 = 0 THEN 'baseline' WHEN n_nationkey % 4 = 1 THEN 'daily_mtf' WHEN n_nationkey % 4 = 2 THEN 'intraday_1h' ELSE 'intraday_short' END FROM nation),
    f AS (SELECT region, unnest(CASE grp WHEN 'daily_mtf' THEN ['daily'] WHEN 'intraday_1h' THEN ['1h'] WHEN 'intraday_short' THEN ['5m', '15m'] ELSE [] END) AS timeframe FROM g) SELECT region, timeframe, count(*) AS n FROM f GROUP BY ALL""")
def q16_model_timeframes(spark, d):
    """The timeframes that the models' feature groups read; a model a nation here, each with one group."""
    kinds = F.array(*[F.lit(g) for g in ("baseline", *GROUP_FRAMES)])
    frames = F.create_map(*[y for g, names in GROUP_FRAMES.items() for y in (F.lit(g), F.array(*[F.lit(n) for n in names]))])
    models = T.read_table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.element_at(kinds, F.col("n_nationkey") % 4 + 1).alias("grp"))
    return models.select("region", F.explode(F.try_element_at(frames, F.col("grp"))).alias("timeframe")).groupBy("region", "timeframe").agg(F.count(F.lit(1)).alias("n"))


@query("s9_named_reports", S.statement(*backtest_sql(), "SELECT 'equity_curve' AS report, count(*) AS n, round(sum(period_return), 6) + 0.0 AS total FROM curve UNION ALL SELECT 'trades', count(*), round(sum(net_return), 6) + 0.0 FROM ledger UNION ALL SELECT 'audit', 0, NULL"))
def s9_named_reports(spark, d):
    """A backtest's reports, written as CSV and JSON and read back by name; one that wasn't written is empty."""
    from panelspark.operators import backtest as B

    config, folder = B.Config(), io.scratch(spark, "reports")
    held = B.positions(scored(spark, d), T.nation_bars(spark, d), config)
    curve = B.equity_curve(held, config).select("d", "equity", "positions", "turnover", "cost", "period_return", "benchmark_equity")
    io.write_report(curve, f"{folder}/equity_curve")
    io.write_report(B.trades(held, config), f"{folder}/trades", "json")
    read = {"equity_curve": ("csv", "period_return"), "trades": ("json", "net_return"), "audit": ("csv", None)}
    out = None
    for name, (kind, column) in read.items():
        total = (F.round(F.sum(column), 6) + F.lit(0.0)) if column else F.lit(None).cast("double")
        part = io.read_named_report(spark, folder, name, kind).agg(F.count(F.lit(1)).alias("n"), total.alias("total")).select(F.lit(name).alias("report"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("a2_pivot_panel", S.statement(S.BARS, "SELECT d, max(CASE WHEN sector = 0 THEN c END) AS s0, max(CASE WHEN sector = 1 THEN c END) AS s1, max(CASE WHEN sector = 2 THEN c END) AS s2, max(CASE WHEN sector = 3 THEN c END) AS s3, max(CASE WHEN sector = 4 THEN c END) AS s4 FROM (SELECT d, sector, arg_max(c, stock) AS c FROM bars GROUP BY ALL) GROUP BY 1"))
def a2_pivot_panel(spark, d):
    """The close of each region's last stock by day, a column for every row of the region table."""
    sectors = sorted(r[0] for r in T.read_table(spark, d, "region").select("r_regionkey").distinct().collect())
    wide = T.nation_bars(spark, d).groupBy("d").pivot("sector", sectors).agg(F.max_by("c", "stock"))
    return wide.where("d is not null").select("d", *[F.col(str(k)).alias(f"s{k}") for k in sectors])


@query("a8_top_by_day", S.statement(S.BARS, SCORED, "SELECT d, stock, round(p, 6) AS p, turn FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY p DESC, stock) AS turn FROM scored) WHERE turn <= 3"))
def a8_top_by_day(spark, d):
    best = Window.partitionBy("d").orderBy(F.desc("p"), "stock")
    return scored(spark, d).withColumn("turn", F.row_number().over(best)).where("turn <= 3").select("d", "stock", F.round("p", 6).alias("p"), "turn")


@query("s7_dataset_reuse", S.statement(S.BARS, "SELECT stock, d, sector, c FROM bars WHERE stock IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"))
def s7_dataset_reuse(spark, d):
    """The panel stored by sector and read back for the stocks of the present universe."""
    path = io.scratch(spark, "panel-dataset")
    io.write_dataset(T.nation_bars(spark, d), path, "sector")
    universe = T.read_table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("stock")).distinct()
    return io.read_dataset(spark, path, universe).select("stock", "d", F.col("sector").cast("int").alias("sector"), "c")


@query("s8_report_round_trip", "SELECT s_nationkey AS stock, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1")
def s8_report_round_trip(spark, d):
    """A CSV report, written and read with its schema; a missing one is an empty table."""
    report = T.read_table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("stock")).agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    path = io.scratch(spark, "panel-report")
    io.write_report(report, path)
    return io.read_report(spark, path, report.schema).unionByName(io.read_report(spark, f"{path}-missing", report.schema))


@query("s11_metrics_merge", "SELECT n_regionkey AS horizon, CASE WHEN n_regionkey % 2 = 0 THEN 'new' ELSE 'old' END AS run, count(*) AS n FROM nation GROUP BY ALL")
def s11_metrics_merge(spark, d):
    old = T.read_table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("horizon")).agg(F.count(F.lit(1)).alias("n")).select("horizon", F.lit("old").alias("run"), "n")
    return io.merge_metrics(old, old.where("horizon % 2 = 0").withColumn("run", F.lit("new")))


@query("st1_streaming_bars", """WITH t AS (SELECT event_type AS stock, make_timestamp(CAST(floor(epoch(ts) / 900) AS BIGINT) * 900000000) AS start, ts, event_id, value FROM events)
    SELECT stock, start, arg_min(value, row(ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, row(ts, event_id)) AS c, count(*) AS v FROM t
    GROUP BY ALL HAVING start + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""")
def st1_streaming_bars(spark, d):
    """Bars of a stream over the events, those that the watermark has closed."""
    schema = T.read_table(spark, d, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    ticks = source.select(F.col("event_type").alias("stock"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("tick"))
    path = io.scratch(spark, "stream-bars")
    ST.run_available(ST.streaming_bars(ticks), path, f"{path}-checkpoint")
    return spark.read.parquet(path).select("stock", F.col("start").cast("timestamp_ntz").alias("start"), "o", "h", "l", "c", "v")


ARRIVALS = """t AS (SELECT event_type AS stock, CAST(ts AS TIMESTAMP) AS ts, value, event_id, CAST(floor(4 * (row_number() OVER (ORDER BY CAST(ts AS TIMESTAMP), event_id) - 1) / count(*) OVER ()) AS INTEGER) AS b FROM events),
    arrivals AS (SELECT stock, ts, value, event_id, b + CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS b FROM t UNION ALL SELECT stock, ts, value, event_id, b + 1 FROM t WHERE event_id % 23 = 0 UNION ALL SELECT stock, ts, value, event_id, b FROM t WHERE event_id % 29 = 0 AND event_id % 37 <> 0)"""


def arrivals(spark, d):
    """Ticks and the batch (0 to 4) that each comes in: some a batch late, some once more in the next one or in the same."""
    placed = T.read_table(spark, d, "events").select(F.col("event_type").alias("stock"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("tick"))
    order = Window.orderBy("ts", "tick")
    placed = io.stored(placed.withColumn("n", F.row_number().over(order) - 1).withColumn("b", F.floor(4 * F.col("n") / F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).cast("int")).drop("n"), "stream-arrivals")
    late = placed.withColumn("b", F.col("b") + (F.col("tick") % 37 == 0).cast("int"))
    again = placed.where("tick % 23 = 0").withColumn("b", F.col("b") + 1)
    return late.unionByName(again).unionByName(placed.where("tick % 29 = 0 and tick % 37 <> 0"))


def fed(spark, table, batches, run):
    """Write a table's batches one after another to a folder that ``run`` streams from, starting anew from the checkpoint
    after every second one."""
    path = io.scratch(spark, "stream-input")
    for b in range(batches):
        table.where(F.col("b") == b).drop("b").coalesce(1).write.mode("append").parquet(path)
        if b % 2 or b == batches - 1:
            run(path)


@query("st2_late_and_repeated_ticks", f"""WITH {ARRIVALS}, c AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) AS start, max(ts) OVER (PARTITION BY stock ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM arrivals),
    l AS (SELECT *, coalesce(start + INTERVAL 45 MINUTE <= clock, false) AS late FROM c), ends AS (SELECT stock, max(ts) AS reached FROM arrivals GROUP BY 1),
    once AS (SELECT stock, start, ts, event_id, value, count(*) - 1 AS again FROM l WHERE NOT late GROUP BY ALL),
    bars AS (SELECT stock, start, arg_min(value, row(ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, row(ts, event_id)) AS c, count(*) AS v, sum(again) AS repeats FROM once GROUP BY ALL)
    SELECT 'bar' AS kind, stock, start, o, h, l, c, v, CAST(repeats AS BIGINT) AS repeats FROM bars JOIN ends USING (stock) WHERE start + INTERVAL 45 MINUTE <= reached
    UNION ALL SELECT 'late', stock, start, NULL, NULL, NULL, NULL, count(*), NULL FROM l WHERE late GROUP BY stock, start""")
def st2_late_and_repeated_ticks(spark, d):
    """Bars of a stream with late and repeated ticks, fed in five batches over three runs, and the late ticks by their bars."""
    from panelspark.streaming.late import bars_and_late_ticks

    out = io.scratch(spark, "stream-late")

    def run(path):
        source = spark.readStream.schema("stock string, ts timestamp, price double, tick long").option("maxFilesPerTrigger", 1).parquet(path)
        ST.run_available(bars_and_late_ticks(source), out, f"{out}-checkpoint")

    fed(spark, arrivals(spark, d), 5, run)
    found = spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))
    bars = found.where("kind = 'bar'").select("kind", "stock", "start", "o", "h", "l", "c", "v", "repeats")
    late = found.where("kind = 'late'").groupBy("kind", "stock", "start").agg(F.count(F.lit(1)).alias("v"))
    return bars.unionByName(late, allowMissingColumns=True)


@query("st3_repeated_ticks", f"WITH {ARRIVALS} SELECT DISTINCT stock, event_id AS tick, CAST(ts AS TIMESTAMP) AS ts, value AS price FROM arrivals")
def st3_repeated_ticks(spark, d):
    """The first arrival of every tick of that stream, within a delay that covers the late ones."""
    out = io.scratch(spark, "stream-once")

    def run(path):
        source = spark.readStream.schema("stock string, ts timestamp, price double, tick long").option("maxFilesPerTrigger", 1).parquet(path)
        ST.run_available(ST.deduplicated(source, "60 days", ("stock", "tick"), "ts"), out, f"{out}-checkpoint")

    fed(spark, arrivals(spark, d), 5, run)
    return spark.read.parquet(out).select("stock", "tick", F.col("ts").cast("timestamp_ntz").alias("ts"), "price")
