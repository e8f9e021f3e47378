"""Indicators of all stocks of a panel at once: columns stock, d, o, h, l, c, v in, features out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import windows as W
from panelspark.functions.windows import EPS


#: The names of the baseline features that need no market series.
STOCK_FEATURES = [
    "Ret_1", "Ret_5", "Ret_21", "Ret_63", "Ret_126", "Ret_252", "Ret21_Z",
    "SMA20_Ratio", "SMA50_Ratio", "SMA200_Ratio", "SMA50_200_Ratio", "MACD_Ratio", "MACD_Hist_Ratio",
    "RSI", "Stoch_K", "BB_PctB", "High252_Dist", "Low252_Dist",
    "Volatility", "Vol_60", "Vol_Ratio", "ATR_Ratio", "Volume_Ratio",
]
#: Those that do.
MARKET_FEATURES = ["Mkt_Ret_21", "Mkt_Ret_63", "Mkt_SMA200_Ratio", "Mkt_Vol_20", "Rel_Ret_21", "Rel_Ret_63"]
MIN_HISTORY = 260
OSCILLATORS = ["__macd", "__signal", "__rsi"]


def true_range(w) -> Column:
    """The greatest of the bar's range and its distances to the close before; the first bar has its range alone."""
    before = W.lag(F.col("c"), 1, w)
    return F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before))


def gains_and_losses(df: DataFrame, w) -> DataFrame:
    change = W.diff(F.col("c"), w)
    return df.withColumn("__gain", F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))).withColumn(
        "__loss", F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))
    )


def rsi(gain: Column, loss: Column) -> Column:
    return 100 - 100 / (1 + gain / (loss + EPS))


def macd_and_rsi(df: DataFrame, by, order: str, rsi_least: int = 14) -> DataFrame:
    """Adds __macd, __signal, __rsi; the signal averages the line, so it is a second pass on the same order."""
    df = gains_and_losses(df, W.over(by, order))
    df = W.ewm(
        df,
        {"__fast": ("c", 2 / 13, 1), "__slow": ("c", 2 / 27, 1), "__g": ("__gain", 1 / 14, rsi_least), "__ls": ("__loss", 1 / 14, rsi_least)},
        by,
        order,
    )
    df = df.withColumn("__macd", F.col("__fast") - F.col("__slow")).withColumn("__rsi", rsi(F.col("__g"), F.col("__ls")))
    df = W.ewm(df, {"__signal": ("__macd", 2 / 10, 1)}, by, order)
    return df.drop("__gain", "__loss", "__fast", "__slow", "__g", "__ls")


def returns(df: DataFrame, by="stock", order="d") -> DataFrame:
    """Log returns over 1 to 252 rows and the plain daily return."""
    w = W.over(by, order)
    return df.select(
        "*",
        W.pct_change(F.col("c"), w).alias("Daily_Return"),
        *[W.log_ratio(F.col("c"), W.lag(F.col("c"), n, w)).alias(f"Ret_{n}") for n in (1, 5, 21, 63, 126, 252)],
    )


def baseline(df: DataFrame, by="stock", order="d", keep_oscillators: bool = False) -> DataFrame:
    """The features that need the stock's own bars; one shuffle by stock.

    ``keep_oscillators`` leaves MACD and RSI as they are for ``technical`` on the same rows.
    """
    w = W.over(by, order)
    df = macd_and_rsi(returns(df, by, order), by, order)
    df = df.withColumn("__tr", true_range(w))
    r1, close, volume = F.col("Ret_1"), F.col("c"), F.col("v").cast("double")
    steps = {f"sma{n}": W.mean(close, n, w) for n in (20, 50, 200)} | {
        "vol20": W.std(r1, 20, w),
        "vol60": W.std(r1, 60, w),
        "std20": W.std(close, 20, w),
        "low14": W.rolling(F.min, F.col("l"), 14, w),
        "high14": W.rolling(F.max, F.col("h"), 14, w),
        "high252": W.rolling(F.max, F.col("h"), 252, w),
        "low252": W.rolling(F.min, F.col("l"), 252, w),
        "atr": W.mean(F.col("__tr"), 14, w),
        "v5": W.mean(volume, 5, w),
        "v60": W.mean(volume, 60, w),
    }
    df = df.select("*", *[x.alias(f"__{n}") for n, x in steps.items()])  # each window once
    x = {n: F.col(f"__{n}") for n in steps}
    features = {
        "Volatility": x["vol20"],
        "Vol_60": x["vol60"],
        "Vol_Ratio": x["vol20"] / (x["vol60"] + EPS),
        "ATR_Ratio": W.ratio(x["atr"], close),
        "Ret21_Z": F.col("Ret_21") / (x["vol20"] * 21**0.5 + EPS),
        "SMA20_Ratio": W.ratio(close, x["sma20"]),
        "SMA50_Ratio": W.ratio(close, x["sma50"]),
        "SMA200_Ratio": W.ratio(close, x["sma200"]),
        "SMA50_200_Ratio": W.ratio(x["sma50"], x["sma200"]),
        "MACD_Ratio": W.ratio(F.col("__macd"), close),
        "MACD_Hist_Ratio": W.ratio(F.col("__macd") - F.col("__signal"), close),
        "RSI": F.col("__rsi"),
        "Stoch_K": 100 * (close - x["low14"]) / (x["high14"] - x["low14"] + EPS),
        "BB_PctB": (close - (x["sma20"] - 2 * x["std20"])) / (4 * x["std20"] + EPS),
        "High252_Dist": W.ratio(close, x["high252"]) - 1,
        "Low252_Dist": W.ratio(close, x["low252"]) - 1,
        "Volume_Ratio": W.log((x["v5"] + 1) / (x["v60"] + 1)),
    }
    out = df.select("*", *[W.finite(x).alias(n) for n, x in features.items()])
    return out.drop(*([] if keep_oscillators else OSCILLATORS), "__tr", *[f"__{n}" for n in steps])


def technical(
    df: DataFrame, prefix: str, fast: int, slow: int, momentum_bars: int = 5, vol_window: int = 20, by="stock", order="d"
) -> DataFrame:
    """The 19 features of one timeframe, named by its prefix, beside the bars' own columns."""
    w = W.over(by, order)
    kept = [c for c in df.columns if c not in OSCILLATORS]
    if len(kept) == len(df.columns):
        df = macd_and_rsi(df, by, order)
    df = W.ewm(df, {"__ema_f": ("c", 2 / (fast + 1), fast), "__ema_s": ("c", 2 / (slow + 1), slow)}, by, order)
    df = df.withColumn("__r", W.log_ratio(F.col("c"), W.lag(F.col("c"), 1, w))).withColumn("__tr", true_range(w))
    df = df.withColumn("__vol", W.std(F.col("__r"), vol_window, w)).withColumn("__atr", W.mean(F.col("__tr"), 14, w))
    df = df.withColumn("__mom", W.log_ratio(F.col("c"), W.lag(F.col("c"), momentum_bars, w)))
    volume = F.col("v").cast("double")
    ema_f, ema_s, line, signal, r = (F.col(x) for x in ("__ema_f", "__ema_s", "__macd", "__signal", "__rsi"))
    trend = F.when((F.col("c") > ema_f) & (ema_f > ema_s), 1.0).when((F.col("c") < ema_f) & (ema_f < ema_s), -1.0).otherwise(0.0)
    regime = F.when(r > 60, 1.0).when(r < 40, -1.0).otherwise(0.0)
    features = {
        "RSI": r,
        "MACD": line,
        "MACD_signal": signal,
        "ATR": F.col("__atr"),
        "volatility": F.col("__vol"),
        "return": F.col("__r"),
        "volume_change": W.log((volume + 1) / (W.mean(volume, vol_window, w) + 1)),
        f"EMA_{fast}": ema_f,
        f"EMA_{slow}": ema_s,
        "price_vs_EMA": W.ratio(F.col("c"), ema_f) - 1,
        "MACD_norm": W.ratio(line, F.col("c")),
        "MACD_signal_norm": W.ratio(signal, F.col("c")),
        "MACD_hist_norm": W.ratio(line - signal, F.col("c")),
        "ATR_pct": W.ratio(F.col("__atr"), F.col("c")),
        "EMA_fast_vs_slow": W.ratio(ema_f, ema_s) - 1,
        "momentum": F.col("__mom"),
        "momentum_z": F.col("__mom") / (F.col("__vol") * momentum_bars**0.5 + EPS),
        "trend_direction": F.when(ema_s.isNotNull(), trend),
        "rsi_regime": F.when(r.isNotNull(), regime),
    }
    return df.select(*kept, *[W.finite(x).alias(f"{prefix}_{n}") for n, x in features.items()])


def chart_overlays(df: DataFrame, by="stock", order="d") -> DataFrame:
    """Bands, averages, RSI (from the first change on) and MACD to draw over the bars."""
    w = W.over(by, order)
    kept = df.columns
    df = macd_and_rsi(df, by, order, rsi_least=1)
    sma20, std20 = W.mean(F.col("c"), 20, w), W.std(F.col("c"), 20, w)
    return df.select(
        *kept,
        W.mean(F.col("c"), 50, w).alias("SMA_50"),
        W.mean(F.col("c"), 200, w).alias("SMA_200"),
        (sma20 + 2 * std20).alias("BB_Upper"),
        (sma20 - 2 * std20).alias("BB_Lower"),
        F.col("__rsi").alias("RSI"),
        F.col("__macd").alias("MACD"),
        F.col("__signal").alias("Signal"),
    )


def add_labels(df: DataFrame, horizons: dict[str, int], threshold: float = 0.005, by="stock", order="d") -> DataFrame:
    """1 if the close ``h`` rows ahead is above the close by more than the threshold, else 0; NULL if unknown."""
    w = W.over(by, order)
    future = lambda h: F.lead(F.col("c"), h).over(w)
    return df.select(
        "*",
        *[F.when(future(h).isNotNull(), (future(h) > F.col("c") * (1 + threshold)).cast("double")).alias(f"Target_{n}") for n, h in horizons.items()],
    )


def enough_history(df: DataFrame, rows: int, by="stock") -> DataFrame:
    """The stocks with at least so many rows."""
    return df.withColumn("__n", F.count(F.lit(1)).over(W.Window.partitionBy(by))).where(F.col("__n") >= rows).drop("__n")
