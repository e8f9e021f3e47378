"""Bars from live ticks: windows close at the watermark, late ticks are dropped, repeats count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, minutes: int = 15, delay: str = "30 minutes") -> DataFrame:
    """Bars of stock, ts, price and tick that are complete; in append mode each is emitted once."""
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("stock", F.window("ts", f"{minutes} minutes"))
        .agg(
            F.min_by("price", F.struct("ts", "tick")).alias("o"),
            F.max("price").alias("h"),
            F.min("price").alias("l"),
            F.max_by("price", F.struct("ts", "tick")).alias("c"),
            F.count(F.lit(1)).alias("v"),
        )
        .select("stock", F.col("window.start").alias("start"), F.col("window.end").alias("bar_end"), "o", "h", "l", "c", "v")
    )


def deduplicated(bars: DataFrame, delay: str = "30 minutes", keys: tuple[str, ...] = ("stock", "start"), time: str = "start") -> DataFrame:
    """The first arrival of each key within the delay."""
    return bars.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is there, append the result as Parquet, and stop."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
