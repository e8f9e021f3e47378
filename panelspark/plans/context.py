"""Queries on context features, alignment and intraday bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import windows as W
from panelspark.operators import context as X
from panelspark.operators import indicators as I
from panelspark.plans import sql as S
from panelspark.plans.panel import EXACT, rounded
from panelspark.sources import tables as T
from panelspark.sources.io import stored

QUERIES, ORACLE_SQL = {}, {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


ALL = "ORDER BY d"
QUARTET = f"quartet AS (SELECT d, {S.log_ratio('c', 21, ALL)} AS Mkt_Ret_21, {S.log_ratio('c', 63, ALL)} AS Mkt_Ret_63, c / {S.roll('avg', 'c', 200, ALL).replace('CASE', '(CASE', 1)}) AS Mkt_SMA200_Ratio, {S.roll('stddev_samp', 'r', 20, ALL)} AS Mkt_Vol_20 FROM (SELECT *, {S.log_ratio('c', 1, ALL)} AS r FROM market))"
FOUR = ["Mkt_Ret_21", "Mkt_Ret_63", "Mkt_SMA200_Ratio", "Mkt_Vol_20"]


def index_sql(source: str, out: str, prefix: str, by: str = "", extras: bool = False) -> str:
    p = f"PARTITION BY {by} ORDER BY d" if by else ALL
    more = f", c / sma200 AS {prefix}_sma200_ratio, CASE WHEN sma200 IS NULL THEN NULL WHEN c > sma50 AND sma50 > sma200 THEN 1.0 WHEN c < sma50 AND sma50 < sma200 THEN -1.0 ELSE 0.0 END AS {prefix}_trend_direction" if extras else ""
    return f"""{out}_r AS (SELECT *, {S.log_ratio('c', 1, p)} AS r, {S.log_ratio('c', 5, p)} AS r5, {S.log_ratio('c', 20, p)} AS r20, {S.roll('avg', 'c', 50, p)} AS sma50, {S.roll('avg', 'c', 200, p)} AS sma200 FROM {source}),
    {out}_v AS (SELECT *, {S.roll('stddev_samp', 'r', 20, p)} AS vol FROM {out}_r),
    {out} AS (SELECT {by + ', ' if by else ''}d, r AS {prefix}_return_1, r5 AS {prefix}_return_5, r20 AS {prefix}_return_20, vol AS {prefix}_volatility, r20 / (vol * sqrt(20) + 1e-10) AS {prefix}_momentum, c / sma50 AS {prefix}_sma_ratio{more} FROM {out}_v)"""


VIX_F = f"vix_f AS (SELECT d, c AS vix, c - {S.lag('c', 1, ALL)} AS vix_change, r AS vix_return, {S.roll('stddev_samp', 'r', 20, ALL)} AS vix_volatility FROM (SELECT *, {S.log_ratio('c', 1, ALL)} AS r FROM vix))"
FX_F = f"fx_f AS (SELECT d, r AS fx_return_1, {S.log_ratio('c', 5, ALL)} AS fx_return_5, {S.log_ratio('c', 20, ALL)} AS fx_return_20, {S.roll('stddev_samp', 'r', 20, ALL)} AS fx_volatility FROM (SELECT *, {S.log_ratio('c', 1, ALL)} AS r FROM fx))"
SECTOR = f"""calendar AS (SELECT sector, d, row_number() OVER (PARTITION BY sector ORDER BY d) AS day FROM (SELECT DISTINCT sector, d FROM bars)),
    member AS (SELECT sector, stock, d, CASE WHEN day - lag(day) OVER (PARTITION BY stock ORDER BY day) = 1 THEN ln(c / lag(c) OVER (PARTITION BY stock ORDER BY day)) END AS r FROM bars JOIN calendar USING (sector, d)),
    grid AS (SELECT k.sector, k.d, s.stock, m.r FROM calendar k JOIN (SELECT DISTINCT stock, sector FROM bars) s USING (sector) LEFT JOIN member m ON m.stock = s.stock AND m.d = k.d),
    peer AS (SELECT g.sector, g.stock, g.d, CASE WHEN t.n - (g.r IS NOT NULL)::INT >= 2 THEN (t.total - coalesce(g.r, 0)) / (t.n - (g.r IS NOT NULL)::INT) END AS mean
        FROM grid g JOIN (SELECT sector, d, sum(r) AS total, count(r) AS n FROM member GROUP BY ALL) t USING (sector, d)),
    level AS (SELECT stock, sector, d, CASE WHEN count(mean) OVER w > 0 THEN exp(round(sum(coalesce(mean, 0)) OVER w, 12)) END AS c FROM peer WINDOW w AS (PARTITION BY stock ORDER BY d ROWS UNBOUNDED PRECEDING))"""


@query("f2_market_quartet", S.statement(S.SHIPMENTS, S.MARKET, QUARTET, S.rounded("quartet", ["d"], FOUR)))
def f2_market_quartet(spark, d):
    return rounded(X.market_quartet(T.market_series(spark, d)), ["d"], FOUR)


REL = [*FOUR, "Rel_Ret_21", "Rel_Ret_63"]
FILLED = f"""joined AS (SELECT b.*, {', '.join(FOUR)} FROM ret b LEFT JOIN quartet q ON q.d = b.d AND dayofweek(b.d) <> 0),
    filled AS (SELECT stock, d, Ret_21, Ret_63, {', '.join(f"last_value({x} IGNORE NULLS) OVER ({S.P} ROWS UNBOUNDED PRECEDING) AS {x}" for x in FOUR)} FROM joined),
    rel AS (SELECT *, Ret_21 - Mkt_Ret_21 AS Rel_Ret_21, Ret_63 - Mkt_Ret_63 AS Rel_Ret_63 FROM filled)"""


@query("j1_market_filled", S.statement(S.BARS, S.MARKET, QUARTET, f"ret AS (SELECT stock, d, {S.log_ratio('c', 21)} AS Ret_21, {S.log_ratio('c', 63)} AS Ret_63 FROM bars)", FILLED, S.rounded("rel", EXACT, REL)))
def j1_market_filled(spark, d):
    """Market features of days on which the market series has no row (Sundays here) are the latest ones."""
    bars = I.returns(T.nation_bars(spark, d)).select("stock", "d", "Ret_21", "Ret_63")
    quartet = X.market_quartet(T.market_series(spark, d)).where(F.dayofweek("d") != 1)
    w = W.over()
    joined = bars.join(F.broadcast(quartet), "d", "left")
    filled = joined.select("stock", "d", "Ret_21", "Ret_63", *[W.forward_fill(F.col(n), w).alias(n) for n in FOUR])
    filled = filled.withColumn("Rel_Ret_21", F.col("Ret_21") - F.col("Mkt_Ret_21")).withColumn("Rel_Ret_63", F.col("Ret_63") - F.col("Mkt_Ret_63"))
    return rounded(filled, EXACT, REL)


@query("j2_same_session", S.statement(S.BARS, "vix AS (SELECT d, max(price) - min(price) + 1 AS c FROM shipments WHERE dayofweek(d) <> 0 GROUP BY ALL)", "SELECT stock, b.d, x.c AS vix FROM bars b LEFT JOIN vix x ON x.d = b.d"))
def j2_same_session(spark, d):
    vix = T.volatility_series(spark, d).where(F.dayofweek("d") != 1).select("d", F.col("c").alias("vix"))
    return T.nation_bars(spark, d).select("stock", "d").join(F.broadcast(vix), "d", "left").select("stock", "d", "vix")


@query("j3_fx_asof", S.statement(S.SHIPMENTS, S.FX, "days AS (SELECT DISTINCT d FROM shipments)", "SELECT t.d, CASE WHEN date_diff('day', f.d, t.d) <= 5 THEN f.d END AS source_d, round(CASE WHEN date_diff('day', f.d, t.d) <= 5 THEN f.c END, 7) AS c FROM days t ASOF LEFT JOIN fx f ON t.d > f.d"))
def j3_fx_asof(spark, d):
    days = T.shipments(spark, d).select("d").distinct()
    return X.asof_before(days, T.fx_series(spark, d), 5).select("d", "source_d", F.round("c", 7).alias("c"))


INDEX_NAMES = [f"index_{n}" for n in [*X.INDEX, "sma200_ratio", "trend_direction"]]


@query("f4_index_features", S.statement(S.SHIPMENTS, S.MARKET, index_sql("market", "idx", "index", extras=True), S.rounded("idx", ["d"], INDEX_NAMES)))
def f4_index_features(spark, d):
    return rounded(X.index_features(T.market_series(spark, d), "index", extras=True), ["d"], INDEX_NAMES)


VIX_NAMES = ["vix_return", "vix_volatility"]


@query("f6_volatility_features", S.statement(S.SHIPMENTS, S.VIX, VIX_F, S.rounded("vix_f", ["d", "vix", "vix_change"], VIX_NAMES)))
def f6_volatility_features(spark, d):
    return rounded(X.volatility_features(T.volatility_series(spark, d)), ["d", "vix", "vix_change"], VIX_NAMES)


FX_NAMES = ["fx_return_1", "fx_return_5", "fx_return_20", "fx_volatility"]


@query("f7_fx_features", S.statement(S.FX, FX_F, S.rounded("fx_f", ["d"], FX_NAMES)))
def f7_fx_features(spark, d):
    return rounded(X.fx_features(T.fx_series(spark, d)), ["d"], FX_NAMES)


@query("p_sector_composite", S.statement(S.BARS, SECTOR, "logs AS (SELECT stock, sector, d, ln(c) AS c FROM level)", S.rounded("logs", ["stock", "sector", "d"], ["c"])))
def p_sector_composite(spark, d):
    return rounded(X.sector_levels(T.nation_bars(spark, d)).withColumn("c", F.ln("c")), ["stock", "sector", "d"], ["c"])


SECTOR_NAMES = [f"sector_{n}" for n in X.INDEX]
RELATIVE = ["vs_index_return", "vs_sector_return", "index_relative_strength", "sector_relative_strength"]
CONTEXT_NAMES = [*INDEX_NAMES, "vix_return", "vix_volatility", *FX_NAMES, *SECTOR_NAMES, *RELATIVE]
CONTEXT_SQL = [
    S.BARS, S.MARKET, S.VIX, S.FX, index_sql("market", "idx", "index", extras=True), VIX_F, FX_F, SECTOR, index_sql("level", "sec", "sector", "stock"),
    "days AS (SELECT DISTINCT d FROM bars)",
    f"fx_a AS (SELECT t.d, {', '.join(f'CASE WHEN date_diff(chr(100) || chr(97) || chr(121), f.d, t.d) <= 5 THEN f.{n} END AS {n}' for n in FX_NAMES)} FROM days t ASOF LEFT JOIN fx_f f ON t.d > f.d)".replace("chr(100) || chr(97) || chr(121)", "'day'"),
    f"own AS (SELECT stock, d, {S.log_ratio('c', 1)} AS r1, {S.log_ratio('c', 20)} AS r20 FROM bars)",
    f"""ctx AS (SELECT o.stock, o.d, {', '.join(INDEX_NAMES)}, vix, vix_change, vix_return, vix_volatility, {', '.join(FX_NAMES)}, {', '.join(SECTOR_NAMES)},
        r1 - index_return_1 AS vs_index_return, r1 - sector_return_1 AS vs_sector_return, r20 - index_return_20 AS index_relative_strength, r20 - sector_return_20 AS sector_relative_strength
        FROM own o LEFT JOIN idx i ON i.d = o.d LEFT JOIN vix_f v ON v.d = o.d LEFT JOIN fx_a f ON f.d = o.d LEFT JOIN sec s ON s.stock = o.stock AND s.d = o.d)""",
]


@query("f9_market_features", S.statement(*CONTEXT_SQL, S.rounded("ctx", EXACT, CONTEXT_NAMES)))
def f9_market_features(spark, d):
    bars = stored(T.nation_bars(spark, d), "daily-bars")
    found = X.market_features(bars, T.market_series(spark, d), T.volatility_series(spark, d), T.fx_series(spark, d))
    return rounded(found, EXACT, CONTEXT_NAMES)


def sessions(spark, d):
    """Bars of 5 minutes within the sessions of the nations' stocks."""
    return X.in_session(T.tick_bars(T.stock_ticks(spark, d), 5))


def intraday(spark, d):
    """5-minute bars, made of the ticks once, and hourly ones of them."""
    fine = stored(sessions(spark, d), "session-bars")
    return {"5m": fine, "1h": X.resample_bars(fine, 60)}


@query("t1_resample", S.statement(S.SESSION_BARS, S.coarser("b15", 15), S.coarser("b60", 60), "SELECT 15 AS minutes, stock, start, bar_end, o, h, l, c, CAST(v AS BIGINT) AS v FROM b15 UNION ALL SELECT 60, stock, start, bar_end, o, h, l, c, CAST(v AS BIGINT) FROM b60"))
def t1_resample(spark, d):
    """Quarter hours and hours from 09:15 on; the last hour ends at the close."""
    fine = sessions(spark, d)
    both = [X.resample_bars(fine, n).withColumn("minutes", F.lit(n)) for n in (15, 60)]
    times = [F.col(t).cast("timestamp_ntz").alias(t) for t in ("start", "bar_end")]
    return both[0].unionByName(both[1]).select("minutes", "stock", *times, "o", "h", "l", "c", "v")


P_BAR = "PARTITION BY stock ORDER BY start"
SOURCES = {"5m": "fine", "15m": "b15", "1h": "b60"}
BARS_SQL = [S.SESSION_BARS, S.coarser("b15", 15), S.coarser("b60", 60)]
TIMEFRAME_SQL = [
    *BARS_SQL,
    *[f"p{p} AS (SELECT * FROM {t} WHERE c > 0), {S.technical(f'p{p}', f't{p}', p, *X.TIMEFRAMES[p], P_BAR, 'stock, start, session, bar_end')}" for p, t in SOURCES.items()],
    *[f"""a{p} AS (SELECT stock, session AS d, bar_end AS "{p}_bar_end", * EXCLUDE (stock, session, start, bar_end) FROM t{p} WHERE bar_end <= session + INTERVAL 930 MINUTE QUALIFY row_number() OVER (PARTITION BY stock, session ORDER BY bar_end DESC) = 1)""" for p in SOURCES],
]
CROSS_SQL = ", ".join(f'"{a}_momentum_z" - "{b}_momentum_z" AS "{n}"' for n, (a, b) in X.CROSS.items())
INTRADAY = [n for p in SOURCES for n in X.timeframe_names(p)]


@query("f11_intraday_features", S.statement(*TIMEFRAME_SQL, f"""longest AS (SELECT stock, start, {', '.join(f't5m."{n}"' for n in X.timeframe_names('5m'))}, {', '.join(f't15m."{n}"' for n in X.timeframe_names('15m'))}, {', '.join(f't1h."{n}"' for n in X.timeframe_names('1h'))}
        FROM t5m FULL JOIN t15m USING (stock, start) FULL JOIN t1h USING (stock, start))""", S.rounded("longest", ["stock", "start"], INTRADAY, 5)))
def f11_intraday_features(spark, d):
    """The features of 5-minute, 15-minute and 1-hour bars, side by side where bars start together."""
    bars = intraday(spark, d)
    bars["15m"] = X.resample_bars(bars["5m"], 15)
    found = None
    for p in SOURCES:
        part = I.technical(bars[p].where("c > 0"), p, *X.TIMEFRAMES[p], by="stock", order="start").select("stock", "start", *[f"`{n}`" for n in X.timeframe_names(p)])
        found = part if found is None else found.join(part, ["stock", "start"], "full")
    return rounded(found.withColumn("start", F.col("start").cast("timestamp_ntz")), ["stock", "start"], INTRADAY, 5)


DAILY = S.technical("bars", "dly", "daily", *X.TIMEFRAMES["daily"])
MTF = f"""mtf0 AS (SELECT y.*, {', '.join(f'a{p}.* EXCLUDE (stock, d)' for p in SOURCES)} FROM dly y {' '.join(f'LEFT JOIN a{p} ON a{p}.stock = y.stock AND a{p}.d = y.d' for p in SOURCES)}),
    mtf AS (SELECT *, {CROSS_SQL} FROM mtf0)"""
CROSSED = list(X.CROSS)


@query("j4_intraday_to_daily", S.statement(S.BARS, *TIMEFRAME_SQL, DAILY, MTF, "sess AS (SELECT DISTINCT session AS d FROM fine), held AS (SELECT m.* FROM mtf m SEMI JOIN sess USING (d))", S.rounded("held", [*EXACT, *[f'"{p}_bar_end"' for p in SOURCES]], [*INTRADAY, *CROSSED], 5)))
def j4_intraday_to_daily(spark, d):
    """The last bar of each session by its close beside the day, and momentum across timeframes, on the days of sessions."""
    fine = intraday(spark, d)
    daily = I.technical(T.nation_bars(spark, d), "daily", *X.TIMEFRAMES["daily"])
    found = X.with_timeframes(daily, fine).join(fine["5m"].select(F.col("session").alias("d")).distinct(), "d", "left_semi")
    ends = [F.col(f"`{p}_bar_end`").cast("timestamp_ntz").alias(f"{p}_bar_end") for p in SOURCES]
    return rounded(found.select(*EXACT, *ends, *[f"`{n}`" for n in [*INTRADAY, *CROSSED]]), [*EXACT, *[f"`{p}_bar_end`" for p in SOURCES]], [*INTRADAY, *CROSSED], 5)


FRAME = [*I.STOCK_FEATURES, *I.MARKET_FEATURES, *X.timeframe_names("daily"), *INTRADAY, *CROSSED, *CONTEXT_NAMES]
LEVEL = ["vix", "vix_change"]
FRAME_SQL = [
    *CONTEXT_SQL, S.BASELINE, QUARTET, FILLED.replace("AND dayofweek(b.d) <> 0", ""), *TIMEFRAME_SQL, DAILY, MTF,
    f"frame AS (SELECT b.* EXCLUDE (Daily_Return), {', '.join('m.' + x for x in I.MARKET_FEATURES)}, y.* EXCLUDE (stock, d), x.* EXCLUDE (stock, d) FROM base b JOIN rel m USING (stock, d) JOIN mtf y USING (stock, d) JOIN ctx x USING (stock, d) WHERE {' AND '.join(f'b.{x} IS NOT NULL' for x in I.STOCK_FEATURES)})",
]


def frame_of(spark, d):
    bars = stored(T.nation_bars(spark, d), "daily-bars")  # far fewer rows than line items, read by several branches
    return X.feature_frame(bars, T.market_series(spark, d), T.volatility_series(spark, d), T.fx_series(spark, d), intraday(spark, d))


@query("f14_feature_frame", S.statement(*FRAME_SQL, S.rounded("frame", [*EXACT, *LEVEL], FRAME, 5)))
def f14_feature_frame(spark, d):
    return rounded(frame_of(spark, d), [*EXACT, *LEVEL], FRAME, 5)


GROUPS = {
    "baseline": [*I.STOCK_FEATURES, *I.MARKET_FEATURES],
    "market": ["vix", "vix_change", *CONTEXT_NAMES],
    "daily_mtf": X.timeframe_names("daily")[:14],
    "intraday_1h": [*X.timeframe_names("1h")[:14], "1h_vs_daily_momentum"],
    "intraday_short": [*X.timeframe_names("5m")[:14], *X.timeframe_names("15m")[:14], "5m_vs_15m_momentum", "15m_vs_1h_momentum"],
}


@query("f15_dataset", S.statement(*FRAME_SQL, "SELECT coalesce(CAST(sector AS VARCHAR), 'NONE') AS sector, count(*) AS n, count(DISTINCT stock) AS stocks, min(d) AS first_day, max(d) AS last_day, round(avg(CAST(RSI AS FLOAT)), 3) AS rsi FROM frame GROUP BY 1"))
def f15_dataset(spark, d):
    """The stored feature table: single precision, tagged by sector, without the columns that only book-keep; profiled when read back."""
    from panelspark.sources import io

    frame = frame_of(spark, d).withColumn("sector", F.coalesce(F.col("sector").cast("string"), F.lit("NONE")))
    frame = frame.drop(*[f"{p}_bar_end" for p in SOURCES])
    single = [F.col(f"`{n}`").cast("float").alias(n) if t == "double" else F.col(f"`{n}`") for n, t in frame.dtypes]
    path = io.scratch(spark, "feature-table")
    io.write_dataset(frame.select(*single), path, "sector")
    stored = io.read_dataset(spark, path)
    return stored.groupBy(F.col("sector").cast("string").alias("sector")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("stock").alias("stocks"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.round(F.avg("RSI"), 3).alias("rsi"))


OFFICIAL = "official AS (SELECT 0 AS sector, 'market' AS \"index\", d, c FROM market UNION ALL SELECT 3, 'fx', d, c FROM fx)"


def official_sectors(spark, d):
    """sector, index, d, c of the two regions whose index stands in for their peers."""
    market, fx = T.market_series(spark, d), T.fx_series(spark, d)
    named = lambda x, sector, name: x.select(F.lit(sector).alias("sector"), F.lit(name).alias("index"), "d", "c")
    return named(market, 0, "market").unionByName(named(fx, 3, "fx"))


@query("p4_sector_source", S.statement(S.BARS, S.MARKET, S.FX, SECTOR, OFFICIAL, """members AS (SELECT DISTINCT stock, sector FROM bars),
    series AS (SELECT stock, m.sector, d, ln(c) AS c, 'index:' || "index" AS source FROM members m JOIN official o USING (sector) UNION ALL SELECT stock, sector, d, ln(c), 'peers:' || sector FROM level WHERE c IS NOT NULL AND sector NOT IN (SELECT sector FROM official))""",
    S.rounded("series", ["stock", "sector", "d", "source"], ["c"])))
def p4_sector_source(spark, d):
    """Two regions have an official index here, the others the level of each stock's peers."""
    found = X.sector_series(T.nation_bars(spark, d), official_sectors(spark, d)).withColumn("c", F.ln("c"))
    return rounded(found, ["stock", "sector", "d", "source"], ["c"])


@query("x19_intraday_alignment", S.statement(S.SESSION_BARS, """ends AS (SELECT stock, session, max(start) + INTERVAL 5 MINUTE AS bar_end FROM every5 GROUP BY ALL)""",
    "SELECT '5m' AS timeframe, count(*) FILTER (WHERE bar_end > session + INTERVAL 930 MINUTE) AS bars_after_close, count(*) FILTER (WHERE CAST(bar_end AS DATE) <> session) AS bars_from_other_session FROM ends UNION ALL SELECT '15m', 0, 0 UNION ALL SELECT '1h', 0, 0"))
def x19_intraday_alignment(spark, d):
    """A frame that took the last 5-minute bar of the day, not of the session: what the check finds."""
    late = T.tick_bars(T.stock_ticks(spark, d), 5).groupBy("stock", F.col("session").alias("d")).agg(F.max("bar_end").alias("5m_bar_end"))
    fine = sessions(spark, d)
    for p, n in (("15m", 15), ("1h", 60)):
        last = X.last_of_session(X.resample_bars(fine, n)).select("stock", F.col("session").alias("d"), F.col("bar_end").alias(f"{p}_bar_end"))
        late = late.join(last, EXACT, "left")
    return X.misaligned_bars(late)
