"""Bars from ticks that come late or twice: state of its own for each stock, late ticks kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "kind string, stock string, start long, o double, h double, l double, c double, v long, repeats long, tick long, ts long, price double"


def bars_and_late_ticks(ticks: DataFrame, minutes: int = 15, delay_minutes: int = 30) -> DataFrame:
    """Rows of two kinds from a stream of stock, ts, price and tick: ``bar``, a bar that is complete, and
    ``late``, a tick whose bar had been closed before it came. Appended, each once.

    A stock's clock is its latest tick of the batches before. A bar closes when the clock, moved on
    by a batch, is ``delay_minutes`` past its end; a tick of a closed bar is late. A tick that comes
    again while its bar is open counts once, and ``repeats`` says how often that happened. The
    state of a stock is its clock, the open bars and the numbers of their ticks: it grows with the
    delay, not with the stream. First and last price go by time, then number of the tick.
    """
    width, delay = minutes * 60_000_000, delay_minutes * 60_000_000

    def follow(key, batches, state):
        import json

        import pandas as pd

        clock, text = state.get if state.exists else (None, "{}")
        bars = {int(k): v for k, v in json.loads(text).items()}
        out, latest = [], clock
        for batch in batches:
            for ts, price, tick in zip(batch["ts"].tolist(), batch["price"].tolist(), batch["tick"].tolist(), strict=True):
                start = ts // width * width
                if clock is not None and start + width + delay <= clock:
                    out.append(("late", key[0], start, None, None, None, None, None, None, tick, ts, price))
                    continue
                latest = ts if latest is None else max(latest, ts)
                bar = bars.setdefault(start, {"first": [ts, tick, price], "last": [ts, tick, price], "h": price, "l": price, "repeats": 0, "ticks": {}})
                if str(tick) in bar["ticks"]:
                    bar["repeats"] += 1
                    continue
                bar["ticks"][str(tick)] = 1
                bar["first"], bar["last"] = min(bar["first"], [ts, tick, price]), max(bar["last"], [ts, tick, price])
                bar["h"], bar["l"] = max(bar["h"], price), min(bar["l"], price)
        for start in sorted(bars):
            if start + width + delay <= latest:
                bar = bars.pop(start)
                out.append(("bar", key[0], start, bar["first"][2], bar["h"], bar["l"], bar["last"][2], len(bar["ticks"]), bar["repeats"], None, None, None))
        state.update((latest, json.dumps(bars)))
        names = [x.split()[0] for x in OUT.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        whole = {n: "Int64" for n in ("start", "v", "repeats", "tick", "ts")}
        yield frame.astype(whole | {n: "float64" for n in ("o", "h", "l", "c", "price")})

    given = ticks.select(F.col("stock").cast("string").alias("stock"), F.unix_micros("ts").alias("ts"), F.col("price").cast("double").alias("price"), F.col("tick").cast("long").alias("tick"))
    found = given.groupBy("stock").applyInPandasWithState(follow, OUT, "clock long, bars string", "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("start", F.timestamp_micros("start")).withColumn("ts", F.timestamp_micros("ts"))
