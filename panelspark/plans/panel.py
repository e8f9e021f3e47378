"""Queries on bars: scans, cleaning, windows, indicators, labels."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import windows as W
from panelspark.operators import indicators as I
from panelspark.plans import sql as S
from panelspark.sources import tables as T

QUERIES, ORACLE_SQL = {}, {}
EXACT = ["stock", "d"]


OHLCV = ["o", "h", "l", "c", "v"]


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def rounded(df, exact, doubles, places: int = 6):
    """Doubles to so many places, without negative zeros."""
    return df.select(*exact, *[(F.round(F.col(f"`{x}`").cast("double"), places) + F.lit(0.0)).alias(x) for x in doubles])


FEATURES = ["Daily_Return", *I.STOCK_FEATURES]


@query("t3_event_bars", S.statement(S.tick_bars("bars", 5), S.rounded("bars", ["stock", "start", "v"], ["o", "h", "l", "c"])))
def t3_event_bars(spark, d):
    return rounded(T.tick_bars(T.ticks(spark, d), 5).withColumn("start", F.col("start").cast("timestamp_ntz")), ["stock", "start", "v"], ["o", "h", "l", "c"])


@query("s1_read_bars", S.statement(S.BARS, "picked AS (SELECT * FROM bars WHERE stock IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AND d >= (SELECT max(d) FROM bars) - INTERVAL 1826 DAY)", S.rounded("picked", EXACT + OHLCV, [])))
def s1_read_bars(spark, d):
    """Stored bars of the stocks in a universe table, over the last five years: both filters reach the scan."""
    from panelspark.sources import io

    path = io.scratch(spark, "bars")
    io.write_dataset(T.nation_bars(spark, d), path, "sector")
    symbols = [r[0] for r in T.read_table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey").distinct().collect()]  # of nations
    last = spark.read.parquet(path).agg(F.max("d")).first()[0]
    since = last and last - timedelta(days=1826)
    return T.read_bars(spark, path, symbols, since).select(*EXACT, *OHLCV)


@query("s3_intraday_history", S.statement(S.tick_bars("bars", 60), "recent AS (SELECT * FROM bars WHERE start >= (SELECT max(start) FROM bars) - INTERVAL 7 DAY)", S.rounded("recent", ["stock", "start", "v"], ["o", "h", "l", "c"])))
def s3_intraday_history(spark, d):
    bars = T.tick_bars(T.ticks(spark, d), 60)
    last = bars.agg(F.max("start").alias("last"))
    recent = bars.join(F.broadcast(last), F.col("start") >= F.col("last") - F.expr("INTERVAL 7 DAYS"))
    return rounded(recent.withColumn("start", F.col("start").cast("timestamp_ntz")), ["stock", "start", "v"], ["o", "h", "l", "c"])


@query("s4_universe", "SELECT s_suppkey AS stock, min(place) AS place FROM (SELECT s_suppkey, s_suppkey AS place FROM supplier UNION ALL SELECT l_suppkey, l_suppkey + 1000000 FROM lineitem) GROUP BY 1")
def s4_universe(spark, d):
    """Symbols to load, each once, at its first place in the lists."""
    listed = T.read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("stock"), F.col("s_suppkey").alias("place"))
    used = T.read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stock"), (F.col("l_suppkey") + 1000000).alias("place"))
    return listed.unionByName(used).groupBy("stock").agg(F.min("place").alias("place"))


CONTEXT = f"{S.SHIPMENTS}, {S.MARKET}, {S.VIX}, {S.FX}"


@query("s5_context_profile", S.statement(CONTEXT, "SELECT role, count(*) AS n, min(d) AS first_day, max(d) AS last_day FROM (SELECT 'market' AS role, d FROM market UNION ALL SELECT 'volatility', d FROM vix UNION ALL SELECT 'fx', d FROM fx) GROUP BY 1"))
def s5_context_profile(spark, d):
    roles = {"market": T.market_series(spark, d), "volatility": T.volatility_series(spark, d), "fx": T.fx_series(spark, d)}
    parts = [x.select(F.lit(r).alias("role"), "d") for r, x in roles.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


@query("s6_sector_peers", "SELECT a.n_nationkey AS stock, a.n_regionkey AS sector, b.n_nationkey AS peer FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def s6_sector_peers(spark, d):
    nation = T.read_table(spark, d, "nation").select(F.col("n_nationkey").alias("stock"), F.col("n_regionkey").alias("sector"))
    peers = nation.select(F.col("stock").alias("peer"), "sector")
    return nation.join(F.broadcast(peers), "sector").where("stock <> peer").select("stock", "sector", "peer")


RAW = f"""{S.SHIPMENTS}, raw AS (SELECT l_suppkey AS stock, d, CASE WHEN quantity = 1 THEN NULL WHEN quantity = 2 THEN 0 ELSE price END AS c, k FROM shipments)"""


@query("c1_clean_daily", S.statement(RAW, "ranked AS (SELECT *, row_number() OVER (PARTITION BY stock, d ORDER BY k) AS turn FROM raw WHERE c IS NOT NULL AND c > 0)", S.rounded("ranked WHERE turn = 1", [*EXACT, "c"], [])))
def c1_clean_daily(spark, d):
    """Rows with a positive close, the first arrival of each stock and day."""
    q = F.col("quantity")
    raw = T.shipments(spark, d).select(F.col("l_suppkey").alias("stock"), "d", F.when(q == 1, None).when(q == 2, 0.0).otherwise(F.col("price")).alias("c"), "k")
    first = Window.partitionBy("stock", "d").orderBy("k")
    kept = raw.where("c > 0").withColumn("turn", F.row_number().over(first)).where("turn = 1")
    return kept.select(*EXACT, "c")


@query("c2_clean_intraday", S.statement(S.tick_bars("bars", 60), """SELECT stock, start + INTERVAL 330 MINUTE AS local_start, CAST(start + INTERVAL 330 MINUTE AS DATE) AS session,
        least(start + INTERVAL 390 MINUTE, CAST(CAST(start + INTERVAL 330 MINUTE AS DATE) AS TIMESTAMP) + INTERVAL 930 MINUTE) AS bar_end, round(c, 6) AS c FROM bars"""))
def c2_clean_intraday(spark, d):
    """UTC bars in exchange time, ended at the session's close, one for each start."""
    bars = T.tick_bars(T.ticks(spark, d), 60)
    local = F.from_utc_timestamp("start", "Asia/Kolkata")
    bars = bars.withColumn("local_start", local).withColumn("session", F.to_date("local_start"))
    close = F.col("session").cast("timestamp") + F.expr("INTERVAL 930 MINUTES")
    first = Window.partitionBy("stock", "local_start").orderBy("start")
    bars = bars.withColumn("bar_end", F.least(F.col("local_start") + F.expr("INTERVAL 60 MINUTES"), close)).withColumn("turn", F.row_number().over(first))
    return bars.where("turn = 1").select("stock", F.col("local_start").cast("timestamp_ntz"), "session", F.col("bar_end").cast("timestamp_ntz"), F.round("c", 6).alias("c"))


@query("c3_complete_bars", S.statement(S.tick_bars("bars", 60), "SELECT stock, start, v FROM bars WHERE start + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 10:30:00' AND CAST(start AS DATE) + INTERVAL 930 MINUTE <= TIMESTAMP '2024-01-20 10:30:00'"))
def c3_complete_bars(spark, d):
    """Bars that have ended, of sessions that have closed, at a moment."""
    now = F.lit("2024-01-20 10:30:00").cast("timestamp")
    bars = T.tick_bars(T.ticks(spark, d), 60).where((F.col("bar_end") <= now) & (F.col("session").cast("timestamp") + F.expr("INTERVAL 930 MINUTES") <= now))
    return bars.select("stock", F.col("start").cast("timestamp_ntz").alias("start"), "v")


@query("c5_history_gate", S.statement(S.SUPPLIER_BARS, "SELECT stock, d, v FROM (SELECT *, count(*) OVER (PARTITION BY stock) AS n FROM bars) WHERE n >= 500"))
def c5_history_gate(spark, d):
    return I.enough_history(T.supplier_bars(spark, d), 500).select("stock", "d", "v")


@query("c13_seeded_sample", S.statement(S.BARS, "SELECT stock, d FROM bars WHERE (stock * 7919 + date_diff('day', DATE '1970-01-01', d) * 104729 + 42) % 10 = 0"))
def c13_seeded_sample(spark, d):
    """A sample that depends on keys and seed alone."""
    return T.nation_bars(spark, d).where((F.col("stock") * 7919 + F.unix_date("d") * 104729 + 42) % 10 == 0).select("stock", "d")


@query("c13_rows_a_stock", S.statement(S.BARS, "h AS (SELECT stock, d, row_number() OVER (PARTITION BY stock ORDER BY md5('42|' || stock || '|' || d)) AS turn FROM bars)", "SELECT stock, d FROM h WHERE turn <= 50"))
def c13_rows_a_stock(spark, d):
    """Fifty rows of each stock, drawn by keys and seed."""
    from panelspark.operators.selection import seeded_sample

    return seeded_sample(T.nation_bars(spark, d).select("stock", "d"), ["stock"], ["stock", "d"], 50)


@query("s7_changed_sector", S.statement(S.BARS, "SELECT sector, count(*) AS n, round(sum(CASE WHEN sector = 2 THEN 2 * c ELSE c END), 2) AS total, sector = 2 AS rewritten FROM bars GROUP BY ALL"))
def s7_changed_sector(spark, d):
    """A stored panel whose one sector was written anew: the files of the others are those of before."""
    from panelspark.sources import io

    path = io.scratch(spark, "panel-by-sector")
    bars = T.nation_bars(spark, d).select("stock", "sector", "d", "c")
    io.write_dataset(bars, path, "sector")
    held = io.stored(spark.read.parquet(path).select(F.col("sector").cast("int").alias("sector"), F.input_file_name().alias("file")).distinct(), "panel-files")
    io.replace_partitions(bars.where("sector = 2").withColumn("c", F.col("c") * 2), path, "sector")
    now = spark.read.parquet(path).withColumn("file", F.input_file_name()).withColumn("sector", F.col("sector").cast("int"))
    joined = now.join(F.broadcast(held.withColumn("old", F.lit(True))), ["sector", "file"], "left")  # a row a file
    return joined.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c"), 2).alias("total"), F.bool_or(F.col("old").isNull()).alias("rewritten"))


@query("s3_bars_laid_out", S.statement(S.BARS, S.technical("bars", "tech", "daily", 20, 50, 5), "SELECT stock, count(*) AS n, round(sum(\"daily_RSI\"), 3) AS rsi, round(sum(\"daily_MACD\"), 2) AS macd, 0 AS exchanges FROM tech GROUP BY 1"))
def s3_bars_laid_out(spark, d):
    """Windows over a table bucketed and sorted by stock, profiled by stock, and the exchanges that their plan needs."""
    import uuid

    from panelspark.sources import io

    name = f"bars_{uuid.uuid4().hex}"
    bars = io.write_bucketed(T.nation_bars(spark, d), name, io.scratch(spark, "bars-laid-out"), buckets=8)
    found = I.technical(bars, "daily", 20, 50, 5).groupBy("stock").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("daily_RSI"), 3).alias("rsi"), F.round(F.sum("daily_MACD"), 2).alias("macd"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return found.withColumn("exchanges", F.lit(plan.count("Exchange hashpartitioning")))


@query("c14_truncate", S.statement(S.BARS, "SELECT stock, max(d) AS upto, count(*) FILTER (WHERE d < DATE '1997-06-30') AS strictly, count(*) AS n FROM bars WHERE d <= DATE '1997-06-30' GROUP BY 1"))
def c14_truncate(spark, d):
    cutoff = F.lit("1997-06-30").cast("date")
    return T.nation_bars(spark, d).where(F.col("d") <= cutoff).groupBy("stock").agg(F.max("d").alias("upto"), F.count_if(F.col("d") < cutoff).alias("strictly"), F.count(F.lit(1)).alias("n"))


WINDOWED = ["back_1", "ahead_5", "change", "pct", "mean_20", "std_20", "max_252", "filled", "total", "peak"]
RAW_WINDOWED = ["back_1", "ahead_5", "change", "max_252", "filled", "total", "peak"]


@query("w_primitives", S.statement(S.BARS, f"""w AS (SELECT stock, d, {S.lag('c')} AS back_1, lead(c, 5) OVER ({S.P}) AS ahead_5, c - {S.lag('c')} AS change, c / {S.lag('c')} - 1 AS pct,
        {S.roll('avg', 'c', 20)} AS mean_20, {S.roll('stddev_samp', 'c', 20)} AS std_20, {S.roll('max', 'h', 252)} AS max_252,
        last_value(CASE WHEN v > 100 THEN c END IGNORE NULLS) OVER ({S.P} ROWS UNBOUNDED PRECEDING) AS filled, sum(v) OVER ({S.P} ROWS UNBOUNDED PRECEDING) AS total, max(c) OVER ({S.P} ROWS UNBOUNDED PRECEDING) AS peak FROM bars)""", S.rounded("w", EXACT + RAW_WINDOWED, ["pct", "mean_20", "std_20"])))
def w_primitives(spark, d):
    w, c = W.over(), F.col("c")
    columns = [W.lag(c, 1, w), F.lead(c, 5).over(w), W.diff(c, w), W.pct_change(c, w), W.mean(c, 20, w), W.std(c, 20, w), W.rolling(F.max, F.col("h"), 252, w),
               W.forward_fill(F.when(F.col("v") > 100, c), w), W.running(F.sum, F.col("v"), w), W.running(F.max, c, w)]
    bars = T.nation_bars(spark, d)
    return rounded(bars.select("stock", "d", *[x.alias(n) for n, x in zip(WINDOWED, columns, strict=True)]), EXACT + RAW_WINDOWED, ["pct", "mean_20", "std_20"])


@query("w7_ewm", S.statement(S.BARS, f"x AS (SELECT *, c - {S.lag('c')} AS diff FROM bars)", S.numbered("c diff", "x", "y"), f"e AS (SELECT stock, d, {S.ewm('c', 2 / 10)} AS span_9, {S.ewm('c', 2 / 51, 50)} AS ema_50, {S.ewm('diff', 1 / 14, 14)} AS wilder FROM y)", S.rounded("e", EXACT, ["span_9", "ema_50", "wilder"])))
def w7_ewm(spark, d):
    bars = T.nation_bars(spark, d)
    bars = bars.withColumn("diff", W.diff(F.col("c"), W.over()))
    return rounded(W.ewm(bars, {"span_9": ("c", 2 / 10, 1), "ema_50": ("c", 2 / 51, 50), "wilder": ("diff", 1 / 14, 14)}), EXACT, ["span_9", "ema_50", "wilder"])


@query("w12_cross_section", S.statement(S.BARS, f"x AS (SELECT stock, d, round(c / 500) AS p FROM bars), r AS (SELECT stock, d, {S.pct_rank('p')} AS pct, median(p) OVER (PARTITION BY d) AS middle FROM x)", S.rounded("r", EXACT, ["pct", "middle"])))
def w12_cross_section(spark, d):
    """Average-rank percentile and median of each day's stocks."""
    x = T.nation_bars(spark, d).select("stock", "d", F.round(F.col("c") / 500).alias("p"))
    middle = x.groupBy("d").agg(F.median("p").alias("middle"))
    return rounded(x.withColumn("pct", W.pct_rank(F.col("p"), ["d"])).join(middle, "d"), EXACT, ["pct", "middle"])


@query("w14_last_rows", S.statement(S.BARS, "t AS (SELECT *, row_number() OVER (PARTITION BY stock ORDER BY d DESC) AS back FROM bars)", S.rounded("t WHERE back <= 5", ["stock", "d", "back", "c"], [])))
def w14_last_rows(spark, d):
    latest = Window.partitionBy("stock").orderBy(F.desc("d"))
    return rounded(T.nation_bars(spark, d).withColumn("back", F.row_number().over(latest)).where("back <= 5"), ["stock", "d", "back", "c"], [])


@query("i_baseline", S.statement(S.BARS, S.BASELINE, S.rounded("base", EXACT, FEATURES)))
def i_baseline(spark, d):
    return rounded(I.baseline(T.nation_bars(spark, d)), EXACT, FEATURES)


def technical_names(prefix: str, fast: int, slow: int) -> list[str]:
    names = ["RSI", "MACD", "MACD_signal", "ATR", "volatility", "return", "volume_change", f"EMA_{fast}", f"EMA_{slow}", "price_vs_EMA"]
    names += ["MACD_norm", "MACD_signal_norm", "MACD_hist_norm", "ATR_pct", "EMA_fast_vs_slow", "momentum", "momentum_z", "trend_direction", "rsi_regime"]
    return [f"{prefix}_{n}" for n in names]


@query("i12_daily_technical", S.statement(S.BARS, S.technical("bars", "tech", "daily", 20, 50, 5), S.rounded("tech", EXACT, technical_names("daily", 20, 50))))
def i12_daily_technical(spark, d):
    return rounded(I.technical(T.nation_bars(spark, d), "daily", 20, 50, 5), EXACT, technical_names("daily", 20, 50))


OVERLAYS = ["SMA_50", "SMA_200", "BB_Upper", "BB_Lower", "RSI", "MACD", "Signal"]


@query("i19_chart_overlays", S.statement(S.BARS, S.macd_and_rsi("bars", "osc", least=1), f"""x AS (SELECT stock, d, {S.roll('avg', 'c', 50)} AS SMA_50, {S.roll('avg', 'c', 200)} AS SMA_200,
        {S.roll('avg', 'c', 20)} + 2 * {S.roll('stddev_samp', 'c', 20)} AS BB_Upper, {S.roll('avg', 'c', 20)} - 2 * {S.roll('stddev_samp', 'c', 20)} AS BB_Lower, rsi AS RSI, macd AS MACD, signal AS Signal FROM osc)""", S.rounded("x", EXACT, OVERLAYS)))
def i19_chart_overlays(spark, d):
    return rounded(I.chart_overlays(T.nation_bars(spark, d)), EXACT, OVERLAYS)


HORIZONS = {"Weekly": 5, "Monthly": 21, "Yearly": 252}
TARGETS = [f"Target_{n}" for n in HORIZONS]


@query("l1_labels", S.statement(S.BARS, S.labels("bars", "lab", HORIZONS), S.rounded("lab", EXACT, TARGETS)))
def l1_labels(spark, d):
    return rounded(I.add_labels(T.nation_bars(spark, d), HORIZONS), EXACT, TARGETS)


@query("c7_warm_up", S.statement(S.BARS, S.BASELINE, f"""SELECT stock, count(*) AS n, min(d) AS first_day FROM base WHERE {' AND '.join(f'{x} IS NOT NULL' for x in I.STOCK_FEATURES)} GROUP BY 1"""))
def c7_warm_up(spark, d):
    """What is left once every feature of the stock's own bars exists."""
    return I.baseline(T.nation_bars(spark, d)).dropna(subset=I.STOCK_FEATURES).groupBy("stock").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_day"))


@query("c12_coverage", S.statement(S.BARS, S.BASELINE, " UNION ALL ".join(f"SELECT '{x}' AS feature, round(avg(CASE WHEN {x} IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share FROM base" for x in I.STOCK_FEATURES)))
def c12_coverage(spark, d):
    """Share of rows that have each feature (float32, infinities as missing, as stored)."""
    base = I.baseline(T.nation_bars(spark, d)).select(*[F.col(x).cast("float").alias(x) for x in I.STOCK_FEATURES])
    long = base.unpivot([], I.STOCK_FEATURES, "feature", "x")
    return long.groupBy("feature").agg(F.round(F.avg(F.col("x").isNotNull().cast("double")), 6).alias("share"))


@query("momentum_quintiles", S.statement(S.BARS, f"r AS (SELECT *, {S.log_ratio('c', 21)} AS p, CASE WHEN lead(c, 5) OVER ({S.P}) IS NOT NULL THEN CASE WHEN lead(c, 5) OVER ({S.P}) > c * 1.005 THEN 1.0 ELSE 0.0 END END AS y FROM bars)",
        f"q AS (SELECT *, least(4, floor(({S.pct_rank('p')}) * 5)) AS quintile FROM r WHERE p IS NOT NULL AND y IS NOT NULL)", "SELECT CAST(quintile AS INTEGER) AS quintile, count(*) AS n, round(avg(y), 6) AS up_rate FROM q GROUP BY 1"))
def momentum_quintiles(spark, d):
    """How often stocks rise after a month's return in each fifth of the day's cross-section."""
    bars = I.add_labels(T.nation_bars(spark, d), {"Weekly": 5})
    bars = bars.withColumn("p", W.log_ratio(F.col("c"), W.lag(F.col("c"), 21, W.over()))).where("p IS NOT NULL AND Target_Weekly IS NOT NULL")
    bars = bars.withColumn("quintile", F.least(F.lit(4), F.floor(W.pct_rank(F.col("p"), ["d"]) * 5)).cast("int"))
    return bars.groupBy("quintile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("Target_Weekly"), 6).alias("up_rate"))
