"""Context of a stock: market, volatility, exchange rate, sector; joins that never look ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import windows as W
from panelspark.functions.windows import EPS
from panelspark.operators import indicators as I

#: Minutes of the day at which a session opens and closes.
OPEN, CLOSE = 9 * 60 + 15, 15 * 60 + 30
#: Spans of the two averages and of momentum, in bars of each timeframe, and the differences of momentum across them.
TIMEFRAMES = {"5m": (9, 21, 12), "15m": (9, 21, 8), "1h": (9, 21, 7), "daily": (20, 50, 5)}
CROSS = {"5m_vs_15m_momentum": ("5m", "15m"), "15m_vs_1h_momentum": ("15m", "1h"), "1h_vs_daily_momentum": ("1h", "daily")}

INDEX = ["return_1", "return_5", "return_20", "volatility", "momentum", "sma_ratio"]


def market_quartet(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """d and the four market features of one index series, a table of one row a day (and ``by``)."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("d")
    r = series.select(*by, "d", "c", W.log_ratio(F.col("c"), W.lag(F.col("c"), 1, w)).alias("__r"))
    return r.select(
        *by,
        "d",
        W.log_ratio(F.col("c"), W.lag(F.col("c"), 21, w)).alias("Mkt_Ret_21"),
        W.log_ratio(F.col("c"), W.lag(F.col("c"), 63, w)).alias("Mkt_Ret_63"),
        W.ratio(F.col("c"), W.mean(F.col("c"), 200, w)).alias("Mkt_SMA200_Ratio"),
        W.std(F.col("__r"), 20, w).alias("Mkt_Vol_20"),
    )


def index_features(series: DataFrame, prefix: str, by: list[str] | None = None, extras: bool = False) -> DataFrame:
    """Returns, volatility, momentum and average ratio of an index, or of many series keyed by ``by``."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("d")
    r = series.withColumn("__r", W.log_ratio(F.col("c"), W.lag(F.col("c"), 1, w)))
    r = r.withColumn("__r20", W.log_ratio(F.col("c"), W.lag(F.col("c"), 20, w))).withColumn("__vol", W.std(F.col("__r"), 20, w))
    sma50, sma200 = W.mean(F.col("c"), 50, w), W.mean(F.col("c"), 200, w)
    columns = {
        "return_1": F.col("__r"),
        "return_5": W.log_ratio(F.col("c"), W.lag(F.col("c"), 5, w)),
        "return_20": F.col("__r20"),
        "volatility": F.col("__vol"),
        "momentum": F.col("__r20") / (F.col("__vol") * 20**0.5 + EPS),
        "sma_ratio": W.ratio(F.col("c"), sma50),
    }
    if extras:
        trend = F.when((F.col("c") > sma50) & (sma50 > sma200), 1.0).when((F.col("c") < sma50) & (sma50 < sma200), -1.0).otherwise(0.0)
        columns |= {"sma200_ratio": W.ratio(F.col("c"), sma200), "trend_direction": F.when(sma200.isNotNull(), trend)}
    return r.select(*by, "d", *[W.finite(x).alias(f"{prefix}_{n}") for n, x in columns.items()])


def volatility_features(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    w = Window.partitionBy(*by).orderBy("d")
    r = series.withColumn("__r", W.log_ratio(F.col("c"), W.lag(F.col("c"), 1, w)))
    return r.select(
        *by, "d", F.col("c").alias("vix"), W.diff(F.col("c"), w).alias("vix_change"), F.col("__r").alias("vix_return"), W.std(F.col("__r"), 20, w).alias("vix_volatility")
    )


def fx_features(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    w = Window.partitionBy(*by).orderBy("d")
    r = series.withColumn("__r", W.log_ratio(F.col("c"), W.lag(F.col("c"), 1, w)))
    names = {f"fx_return_{n}": W.log_ratio(F.col("c"), W.lag(F.col("c"), n, w)) for n in (1, 5, 20)}
    return r.select(*by, "d", *[x.alias(n) for n, x in names.items()], W.std(F.col("__r"), 20, w).alias("fx_volatility"))


def asof_before(days: DataFrame, source: DataFrame, tolerance_days: int, by: list[str] | None = None) -> DataFrame:
    """For each day the latest source row strictly before it and not older than the tolerance.

    Days and source rows are put in one order, source rows after the days they share, and
    the last source row before each day is taken: one sort, no range join. Days are dates,
    at most one row each, so the result can be broadcast to the panel.
    """
    by = by or []
    names = [c for c in source.columns if c not in ("d", *by)]
    row = F.struct(F.col("d").alias("source_d"), *names)
    both = days.select(*by, "d", F.lit(0).alias("kind"), F.lit(None).cast(source.select(row.alias("x")).schema["x"].dataType).alias("x"))
    both = both.unionByName(source.select(*by, "d", F.lit(1).alias("kind"), row.alias("x")))
    w = Window.partitionBy(*by).orderBy("d", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("x", F.last("x", ignorenulls=True).over(w)).where("kind = 0")
    near = F.datediff("d", "x.source_d") <= tolerance_days
    return found.select(*by, "d", F.when(near, F.col("x.source_d")).alias("source_d"), *[F.when(near, F.col(f"x.{n}")).alias(n) for n in names])


def sector_levels(bars: DataFrame, by: list[str] | None = None) -> DataFrame:
    """stock, sector, d, c: the level of the other members of the stock's sector.

    On the sector's calendar a member has a return if it traded on two days that follow
    each other. The peers' mean excludes the stock and needs two of them; the level adds
    these means up, stays where they are missing and exists from the first on.
    """
    by = by or []
    sector = [*by, "sector"]
    calendar = bars.select(*sector, "d").distinct()
    calendar = calendar.withColumn("day", F.row_number().over(Window.partitionBy(*sector).orderBy("d")))
    placed = bars.select(*sector, "stock", "d", "c").join(calendar, [*sector, "d"])
    w = Window.partitionBy(*sector, "stock").orderBy("day")
    follows = F.col("day") - F.lag("day").over(w) == 1
    returns = placed.withColumn("r", F.when(follows, W.log_ratio(F.col("c"), F.lag("c").over(w))))
    totals = returns.groupBy(*sector, "d").agg(F.sum("r").alias("total"), F.count("r").alias("members"))
    grid = calendar.join(bars.select(*sector, "stock").distinct(), sector)
    grid = grid.join(returns.select(*sector, "stock", "d", "r"), [*sector, "stock", "d"], "left").join(totals, [*sector, "d"])
    peers = F.col("members") - F.col("r").isNotNull().cast("int")
    grid = grid.withColumn("mean", F.when(peers >= 2, (F.col("total") - F.coalesce("r", F.lit(0.0))) / peers))
    upto = Window.partitionBy(*sector, "stock").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    # to 12 places, so that a stretch without returns is flat whatever the order of the sum
    level = F.exp(F.round(F.sum(F.coalesce("mean", F.lit(0.0))).over(upto), 12))
    return grid.select(*by, "stock", "sector", "d", F.when(F.count("mean").over(upto) > 0, level).alias("c"))


def sector_series(bars: DataFrame, official: DataFrame | None, by: list[str] | None = None) -> DataFrame:
    """stock, sector, d, c, source: the sector's official index where it has one, else its peers' level, else none.

    ``official`` has sector, index, d, c. ``source`` is 'index:<name>', 'peers:<sector>' or NULL.
    """
    by = by or []
    peers = sector_levels(bars, by).where("c is not null")
    named = peers.withColumn("source", F.concat(F.lit("peers:"), F.col("sector").cast("string")))
    if official is None:
        return named
    members = bars.select(*by, "stock", "sector").distinct()
    direct = members.join(F.broadcast(official), "sector").select(*by, "stock", "sector", "d", "c", F.concat(F.lit("index:"), F.col("index")).alias("source"))
    covered = F.broadcast(official.select("sector").distinct())  # a row a sector
    return direct.unionByName(named.join(covered, "sector", "left_anti"))


def with_market(features: DataFrame, series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The market quartet on the stock's days, filled forward over its rows, and returns relative to it."""
    by = by or []
    quartet = market_quartet(series, by)
    names = [c for c in quartet.columns if c not in ("d", *by)]
    joined = features.join(F.broadcast(quartet), [*by, "d"], "left")
    w = W.over([*by, "stock"])
    filled = joined.select(*features.columns, *[W.forward_fill(F.col(n), w).alias(n) for n in names])
    return filled.withColumn("Rel_Ret_21", F.col("Ret_21") - F.col("Mkt_Ret_21")).withColumn("Rel_Ret_63", F.col("Ret_63") - F.col("Mkt_Ret_63"))


def market_features(bars: DataFrame, market: DataFrame | None, vix: DataFrame | None, fx: DataFrame | None, by: list[str] | None = None, official: DataFrame | None = None) -> DataFrame:
    """stock, d and all context features; a source that is missing gives NULL columns.

    Same-session sources join on the exact day; the exchange rate is the one of the latest
    earlier day within five. Context tables hold a row a day (and ``by``) and are broadcast.
    """
    by = by or []
    w = W.over([*by, "stock"])
    out = bars.select(*by, "stock", "sector", "d", "c")
    out = out.withColumn("__r1", W.log_ratio(F.col("c"), W.lag(F.col("c"), 1, w))).withColumn("__r20", W.log_ratio(F.col("c"), W.lag(F.col("c"), 20, w)))

    def attach(out, found, names):
        if found is None:
            return out.select("*", *[F.lit(None).cast("double").alias(n) for n in names])
        return out.join(F.broadcast(found.select(*by, "d", *names)), [*by, "d"], "left")

    out = attach(out, market and index_features(market, "index", by, extras=True), [f"index_{n}" for n in [*INDEX, "sma200_ratio", "trend_direction"]])
    out = attach(out, vix and volatility_features(vix, by), ["vix", "vix_change", "vix_return", "vix_volatility"])
    days = bars.select(*by, "d").distinct()
    out = attach(out, fx and asof_before(days, fx_features(fx, by), 5, by), ["fx_return_1", "fx_return_5", "fx_return_20", "fx_volatility"])
    sector = index_features(sector_series(bars, official, by), "sector", [*by, "stock"])
    out = out.join(sector, [*by, "stock", "d"], "left")
    return out.select(
        *by,
        "stock",
        "d",
        *[c for c in out.columns if c.split("_")[0] in ("index", "vix", "fx") or c.startswith("sector_")],
        (F.col("__r1") - F.col("index_return_1")).alias("vs_index_return"),
        (F.col("__r1") - F.col("sector_return_1")).alias("vs_sector_return"),
        (F.col("__r20") - F.col("index_return_20")).alias("index_relative_strength"),
        (F.col("__r20") - F.col("sector_return_20")).alias("sector_relative_strength"),
    )


def _minutes(n: int):
    return F.expr(f"INTERVAL {n} MINUTES")


def in_session(bars: DataFrame, opens: int = OPEN, closes: int = CLOSE) -> DataFrame:
    """The bars that start between a session's open and close (minutes of its day)."""
    day = F.col("session").cast("timestamp")
    return bars.where((F.col("start") >= day + _minutes(opens)) & (F.col("start") < day + _minutes(closes)))


def resample_bars(bars: DataFrame, minutes: int, by: list[str] | None = None, opens: int = OPEN, closes: int = CLOSE) -> DataFrame:
    """Finer bars as bars of ``minutes`` from each session's open, the last one cut at its close; a
    bar that the session's finer bars don't reach the end of is left out."""
    key = [*(by or []), "stock", "session"]
    length = F.lit(minutes * 60)
    day = F.col("session").cast("timestamp")
    anchor = F.unix_timestamp(day) + opens * 60
    start = F.timestamp_seconds(anchor + F.floor((F.unix_timestamp("start") - anchor) / length) * length)
    coarse = bars.withColumn("bucket", start).groupBy(*key, "bucket").agg(
        F.min_by("o", "start").alias("o"),
        F.max("h").alias("h"),
        F.min("l").alias("l"),
        F.max_by("c", "start").alias("c"),
        F.sum("v").alias("v"),
    )
    reached = bars.groupBy(*key).agg(F.max("bar_end").alias("reached"))
    coarse = coarse.withColumn("bar_end", F.least(F.col("bucket") + _minutes(minutes), day + _minutes(closes)))
    kept = coarse.join(reached, key).where("bar_end <= reached")
    return kept.select(*(by or []), "stock", F.col("bucket").alias("start"), "bar_end", "session", "o", "h", "l", "c", "v")


def last_of_session(features: DataFrame, close_minutes: int = CLOSE, by: list[str] | None = None) -> DataFrame:
    """Of each stock and session the last bar that ended by the close."""
    close = F.col("session").cast("timestamp") + _minutes(close_minutes)
    latest = Window.partitionBy(*(by or []), "stock", "session").orderBy(F.desc("bar_end"))
    done = features.where(F.col("bar_end") <= close).withColumn("__turn", F.row_number().over(latest))
    return done.where("__turn = 1").drop("__turn")


def timeframe_names(prefix: str) -> list[str]:
    """The columns of a timeframe, those of its bars in price units last."""
    fast, slow, _ = TIMEFRAMES[prefix]
    free = ["RSI", "volatility", "return", "volume_change", "price_vs_EMA", "MACD_norm", "MACD_signal_norm", "MACD_hist_norm", "ATR_pct", "EMA_fast_vs_slow", "momentum", "momentum_z", "trend_direction", "rsi_regime"]
    return [f"{prefix}_{n}" for n in [*free, "MACD", "MACD_signal", "ATR", f"EMA_{fast}", f"EMA_{slow}"]]


def with_timeframes(daily: DataFrame, intraday: dict[str, DataFrame], by: list[str] | None = None, close_minutes: int = CLOSE) -> DataFrame:
    """``daily``, which has the daily timeframe, with the last bar of each session in the others, and
    the differences of momentum across them.

    15m bars are made of 5m ones if they aren't given; a timeframe without bars gives NULL
    columns, so the columns are always the same.
    """
    by = by or []
    if "15m" not in intraday and "5m" in intraday:
        intraday = intraday | {"15m": resample_bars(intraday["5m"], 15, by)}
    out = daily
    for prefix in ("5m", "15m", "1h"):
        names = timeframe_names(prefix)
        if prefix not in intraday:
            nothing = [F.lit(None).cast("double").alias(n) for n in names]
            out = out.select("*", *nothing, F.lit(None).cast("timestamp").alias(f"{prefix}_bar_end"))
            continue
        bars = intraday[prefix].where("c > 0")
        found = last_of_session(I.technical(bars, prefix, *TIMEFRAMES[prefix], by=[*by, "stock"], order="start"), close_minutes, by)
        found = found.select(*by, "stock", F.col("session").alias("d"), *[f"`{n}`" for n in names], F.col("bar_end").alias(f"{prefix}_bar_end"))
        out = out.join(found, [*by, "stock", "d"], "left")
    return out.select("*", *[(F.col(f"`{a}_momentum_z`") - F.col(f"`{b}_momentum_z`")).alias(n) for n, (a, b) in CROSS.items()])


def feature_frame(bars, market, vix, fx, intraday: dict[str, DataFrame] | None = None, by: list[str] | None = None, official: DataFrame | None = None) -> DataFrame:
    """Every feature of every stock and day after the warm-up: the one view that training, audit and serving share.

    The stock's own baseline and daily timeframe come from one order of its rows; context
    is broadcast, a row a day.
    """
    by = by or []
    stock = [*by, "stock"]
    own = I.technical(I.baseline(bars, stock, keep_oscillators=True).drop("Daily_Return"), "daily", *TIMEFRAMES["daily"], by=stock)
    base = with_market(own, market, by).dropna(subset=I.STOCK_FEATURES)
    framed = with_timeframes(base, intraday or {}, by)
    return framed.join(market_features(bars, market, vix, fx, by, official), [*by, "stock", "d"], "left")


def misaligned_bars(frame: DataFrame, prefixes=("5m", "15m", "1h"), close_minutes: int = CLOSE) -> DataFrame:
    """timeframe, bars_after_close, bars_from_other_session: over the rows that have a bar of the timeframe."""
    close = F.col("d").cast("timestamp") + _minutes(close_minutes)
    counts = []
    for p in prefixes:
        end = F.col(f"`{p}_bar_end`")
        counts += [F.count_if(end > close).alias(f"{p}|late"), F.count_if(F.to_date(end) != F.col("d")).alias(f"{p}|other")]
    one = frame.agg(*counts)
    rows = [F.struct(F.lit(p).alias("timeframe"), F.col(f"`{p}|late`").alias("bars_after_close"), F.col(f"`{p}|other`").alias("bars_from_other_session")) for p in prefixes]
    return one.select(F.inline(F.array(*rows)))


