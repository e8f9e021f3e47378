"""Bars out of the star-schema tables, and loaders that push their filters to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_bars(spark: SparkSession, path: str, symbols: list | None = None, since=None, stock: str = "stock", date: str = "d") -> DataFrame:
    """Daily bars of some symbols from a date on; both filters reach the Parquet scan."""
    bars = spark.read.parquet(path)
    if symbols is not None:
        bars = bars.where(F.col(stock).isin(list(symbols)))
    return bars if since is None else bars.where(F.col(date) >= F.lit(since))


def ohlcv(rows: DataFrame, keys: list[str], price: Column, volume: Column, order: Column) -> DataFrame:
    """Bars of one row for each key: first, highest, lowest, last price by ``order``, and total volume."""
    flat = rows.select(*keys, price.alias("px"), volume.alias("qty"), order.alias("k"))
    return flat.groupBy(*keys).agg(
        F.min_by("px", "k").alias("o"),
        F.max("px").alias("h"),
        F.min("px").alias("l"),
        F.max_by("px", "k").alias("c"),
        F.sum("qty").alias("v"),
    )


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Priced line items with the keys that order them within a day."""
    return read_table(spark, folder, "lineitem").select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("d"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"),
    )


def nation_bars(spark: SparkSession, folder: str) -> DataFrame:
    """stock (nation), sector (region), d, o, h, l, c, v."""
    supplier = read_table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("stock"))
    nation = read_table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").alias("sector"))
    # suppliers grow with the data: broadcast only below the session's own threshold, which Catalyst checks
    rows = shipments(spark, folder).join(supplier.join(F.broadcast(nation), F.col("stock") == F.col("n_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    return ohlcv(rows, ["stock", "sector", "d"], F.col("price"), F.col("quantity"), F.col("k"))


def supplier_bars(spark: SparkSession, folder: str) -> DataFrame:
    rows = shipments(spark, folder).withColumnRenamed("l_suppkey", "stock")
    return ohlcv(rows, ["stock", "d"], F.col("price"), F.col("quantity"), F.col("k"))


def market_series(spark: SparkSession, folder: str) -> DataFrame:
    """The whole market's bar of each day."""
    return ohlcv(shipments(spark, folder), ["d"], F.col("price"), F.col("quantity"), F.col("k"))


def volatility_series(spark: SparkSession, folder: str) -> DataFrame:
    return shipments(spark, folder).groupBy("d").agg((F.max("price") - F.min("price") + 1).alias("c"))


def fx_series(spark: SparkSession, folder: str) -> DataFrame:
    """A series on another calendar."""
    return read_table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("c"))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """stock, ts (timestamp), price, tick id."""
    return read_table(spark, folder, "events").select(
        F.col("event_type").alias("stock"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("tick")
    )


def stock_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks of the nations' stocks: each user trades one, and the sessions end with the last shipping day."""
    events = read_table(spark, folder, "events")
    nations = read_table(spark, folder, "nation").agg(F.count(F.lit(1)).alias("stocks"))
    shift = events.agg(F.max(F.to_date("ts")).alias("a")).join(read_table(spark, folder, "lineitem").agg(F.max(F.to_date("l_shipdate")).alias("b")), F.lit(True))
    rows = events.join(F.broadcast(nations), F.lit(True)).join(F.broadcast(shift.select(F.datediff("b", "a").alias("days"))), F.lit(True))  # a row each
    return rows.select(
        (F.col("user_id") % F.col("stocks")).cast("int").alias("stock"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("days") * F.lit(86_400_000_000)).alias("ts"),
        F.col("value").alias("price"),
        F.col("event_id").alias("tick"),
    )


def tick_bars(rows: DataFrame, minutes: int = 5) -> DataFrame:
    """Ticks as bars: stock, start, bar_end, session, o, h, l, c, v (the number of ticks)."""
    length = minutes * 60
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / length) * length)
    bars = ohlcv(rows.withColumn("start", start), ["stock", "start"], F.col("price"), F.lit(1), F.struct("ts", "tick"))
    return bars.select(
        "stock", "start", (F.col("start") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("bar_end"), F.to_date("start").alias("session"), "o", "h", "l", "c", "v"
    )
