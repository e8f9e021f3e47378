"""Pieces of SQL from which the statements of expected results are put together."""

from __future__ import annotations

P = "PARTITION BY stock ORDER BY d"
KEY = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey)"

SHIPMENTS = """shipments AS (
    SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS price, l_quantity AS quantity,
           row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k
    FROM lineitem)"""
_OHLCV = "arg_min(price, k) AS o, max(price) AS h, min(price) AS l, arg_max(price, k) AS c, sum(quantity) AS v"
BARS = f"""{SHIPMENTS}, bars AS (
    SELECT s_nationkey AS stock, n_regionkey AS sector, d, {_OHLCV}
    FROM shipments JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)"""
SUPPLIER_BARS = f"{SHIPMENTS}, bars AS (SELECT l_suppkey AS stock, d, {_OHLCV} FROM shipments GROUP BY ALL)"
MARKET = f"market AS (SELECT d, {_OHLCV} FROM shipments GROUP BY ALL)"
VIX = "vix AS (SELECT d, max(price) - min(price) + 1 AS c FROM shipments GROUP BY ALL)"
FX = "fx AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS c FROM orders GROUP BY ALL)"
TICK_BARS = """{name} AS (
    SELECT event_type AS stock, make_timestamp(CAST(floor(epoch(ts) / {s}) AS BIGINT) * {s} * 1000000) AS start,
           arg_min(value, row(ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, row(ts, event_id)) AS c,
           count(*) AS v FROM events GROUP BY ALL)"""


#: Ticks of the nations' stocks within the sessions, in bars of 5 minutes, and coarser bars of them.
SESSION_BARS = """moved AS (SELECT CAST(user_id % (SELECT count(*) FROM nation) AS INTEGER) AS stock, value, event_id,
        CAST(ts AS TIMESTAMP) + to_days(CAST(date_diff('day', (SELECT max(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)) AS INTEGER)) AS ts FROM events),
    every5 AS (SELECT stock, CAST(ts AS DATE) AS session, time_bucket(INTERVAL 5 MINUTE, ts) AS start, arg_min(value, row(ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, row(ts, event_id)) AS c, count(*) AS v FROM moved GROUP BY ALL),
    fine AS (SELECT *, start + INTERVAL 5 MINUTE AS bar_end FROM every5 WHERE start >= session + INTERVAL 555 MINUTE AND start < session + INTERVAL 930 MINUTE),
    reached AS (SELECT stock, session, max(bar_end) AS reached FROM fine GROUP BY ALL)"""


def coarser(name: str, minutes: int) -> str:
    """Bars of ``minutes`` from 09:15 on, cut at 15:30, that the session's finer bars reach the end of."""
    return f"""{name}_b AS (SELECT stock, session, session + INTERVAL 555 MINUTE + to_minutes(CAST(floor(date_diff('minute', session + INTERVAL 555 MINUTE, start) / {minutes}.0) * {minutes} AS INTEGER)) AS bucket, * EXCLUDE (stock, session) FROM fine),
    {name}_g AS (SELECT stock, session, bucket AS start, arg_min(o, start) AS o, max(h) AS h, min(l) AS l, arg_max(c, start) AS c, sum(v) AS v FROM {name}_b GROUP BY stock, session, bucket),
    {name}_e AS (SELECT *, least(start + INTERVAL {minutes} MINUTE, session + INTERVAL 930 MINUTE) AS bar_end FROM {name}_g),
    {name} AS (SELECT e.* FROM {name}_e e JOIN reached r USING (stock, session) WHERE bar_end <= reached)"""


def tick_bars(name: str, minutes: int) -> str:
    return TICK_BARS.format(name=name, s=minutes * 60)


def log(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"


def lag(x: str, n: int = 1, p: str = P) -> str:
    return f"lag({x}, {n}) OVER ({p})"


def log_ratio(x: str, n: int, p: str = P) -> str:
    return log(f"{x} / nullif({lag(x, n, p)}, 0)")


def roll(f: str, x: str, n: int, p: str = P) -> str:
    w = f"OVER ({p} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {f}({x}) {w} END"


def ewm(x: str, a: float, least: int = 1, p: str = P) -> str:
    """By prefix sums over the whole history, which has few enough rows here not to overflow."""
    w = f"OVER ({p} ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN {x} IS NOT NULL AND n_{x} + 1 >= {least} THEN pow({1 - a!r}, n_{x}) * sum({x} * (CASE WHEN n_{x} = 0 THEN 1.0 ELSE {a!r} END) * pow({1 - a!r}, -n_{x})) {w} END"


def numbered(columns: str, source: str, out: str, p: str = P) -> str:
    """A step that counts the observations of each column before each row's own."""
    counts = ", ".join(f"count({x}) OVER ({p} ROWS UNBOUNDED PRECEDING) - 1 AS n_{x}" for x in columns.split())
    return f"{out} AS (SELECT *, {counts} FROM {source})"


def macd_and_rsi(source: str, out: str, p: str = P, least: int = 14) -> str:
    return f"""{out}_0 AS (SELECT *, c - {lag('c', 1, p)} AS change FROM {source}),
    {out}_1 AS (SELECT *, CASE WHEN change IS NOT NULL THEN greatest(change, 0) END AS gain, CASE WHEN change IS NOT NULL THEN greatest(-change, 0) END AS loss FROM {out}_0),
    {numbered('c gain loss', out + '_1', out + '_2', p)},
    {out}_3 AS (SELECT *, {ewm('c', 2 / 13, 1, p)} - {ewm('c', 2 / 27, 1, p)} AS macd, {ewm('gain', 1 / 14, least, p)} AS g, {ewm('loss', 1 / 14, least, p)} AS ls FROM {out}_2),
    {numbered('macd', out + '_3', out + '_4', p)},
    {out} AS (SELECT *, {ewm('macd', 2 / 10, 1, p)} AS signal, 100 - 100 / (1 + g / (ls + 1e-10)) AS rsi FROM {out}_4)"""


BASELINE = f"""{macd_and_rsi('bars', 'osc')},
    ret AS (SELECT *, c / nullif({lag('c')}, 0) - 1 AS Daily_Return, {', '.join(f"{log_ratio('c', n)} AS Ret_{n}" for n in (1, 5, 21, 63, 126, 252))},
        greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')})) AS tr FROM osc),
    roll AS (SELECT *, {roll('stddev_samp', 'Ret_1', 20)} AS Volatility, {roll('stddev_samp', 'Ret_1', 60)} AS Vol_60,
        {roll('avg', 'c', 20)} AS sma20, {roll('avg', 'c', 50)} AS sma50, {roll('avg', 'c', 200)} AS sma200, {roll('stddev_samp', 'c', 20)} AS std20,
        {roll('min', 'l', 14)} AS low14, {roll('max', 'h', 14)} AS high14, {roll('max', 'h', 252)} AS high252, {roll('min', 'l', 252)} AS low252,
        {roll('avg', 'tr', 14)} AS atr, {roll('avg', 'v', 5)} AS v5, {roll('avg', 'v', 60)} AS v60 FROM ret),
    base AS (SELECT stock, sector, d, o, h, l, c, v, Daily_Return, Ret_1, Ret_5, Ret_21, Ret_63, Ret_126, Ret_252,
        Volatility, Vol_60, Volatility / (Vol_60 + 1e-10) AS Vol_Ratio, atr / c AS ATR_Ratio, Ret_21 / (Volatility * sqrt(21) + 1e-10) AS Ret21_Z,
        c / sma20 AS SMA20_Ratio, c / sma50 AS SMA50_Ratio, c / sma200 AS SMA200_Ratio, sma50 / sma200 AS SMA50_200_Ratio,
        macd / c AS MACD_Ratio, (macd - signal) / c AS MACD_Hist_Ratio, rsi AS RSI, 100 * (c - low14) / (high14 - low14 + 1e-10) AS Stoch_K,
        (c - (sma20 - 2 * std20)) / (4 * std20 + 1e-10) AS BB_PctB, c / high252 - 1 AS High252_Dist, c / low252 - 1 AS Low252_Dist,
        ln((v5 + 1) / (v60 + 1)) AS Volume_Ratio FROM roll)"""


def technical(source: str, out: str, prefix: str, fast: int, slow: int, momentum: int, p: str = P, keep: str = "stock, d") -> str:
    q = lambda n: f'"{prefix}_{n}"'
    return f"""{macd_and_rsi(source, out + '_osc', p)},
    {out}_r AS (SELECT *, {ewm('c', 2 / (fast + 1), fast, p)} AS ema_f, {ewm('c', 2 / (slow + 1), slow, p)} AS ema_s, {log_ratio('c', 1, p)} AS r,
        {log_ratio('c', momentum, p)} AS mom, greatest(h - l, abs(h - {lag('c', 1, p)}), abs(l - {lag('c', 1, p)})) AS tr FROM {out}_osc),
    {out}_w AS (SELECT *, {roll('stddev_samp', 'r', 20, p)} AS vol, {roll('avg', 'tr', 14, p)} AS atr, {roll('avg', 'v', 20, p)} AS v20 FROM {out}_r),
    {out} AS (SELECT {keep}, rsi AS {q('RSI')}, macd AS {q('MACD')}, signal AS {q('MACD_signal')}, atr AS {q('ATR')}, vol AS {q('volatility')}, r AS {q('return')},
        ln((v + 1) / (v20 + 1)) AS {q('volume_change')}, ema_f AS {q(f'EMA_{fast}')}, ema_s AS {q(f'EMA_{slow}')}, c / ema_f - 1 AS {q('price_vs_EMA')},
        macd / nullif(c, 0) AS {q('MACD_norm')}, signal / nullif(c, 0) AS {q('MACD_signal_norm')}, (macd - signal) / nullif(c, 0) AS {q('MACD_hist_norm')}, atr / nullif(c, 0) AS {q('ATR_pct')},
        ema_f / ema_s - 1 AS {q('EMA_fast_vs_slow')}, mom AS {q('momentum')}, mom / (vol * sqrt({momentum}) + 1e-10) AS {q('momentum_z')},
        CASE WHEN ema_s IS NULL THEN NULL WHEN c > ema_f AND ema_f > ema_s THEN 1.0 WHEN c < ema_f AND ema_f < ema_s THEN -1.0 ELSE 0.0 END AS {q('trend_direction')},
        CASE WHEN rsi IS NULL THEN NULL WHEN rsi > 60 THEN 1.0 WHEN rsi < 40 THEN -1.0 ELSE 0.0 END AS {q('rsi_regime')} FROM {out}_w)"""


def labels(source: str, out: str, horizons: dict[str, int]) -> str:
    columns = ", ".join(
        f"CASE WHEN lead(c, {h}) OVER ({P}) IS NOT NULL THEN CASE WHEN lead(c, {h}) OVER ({P}) > c * 1.005 THEN 1.0 ELSE 0.0 END END AS Target_{n}" for n, h in horizons.items()
    )
    return f"{out} AS (SELECT *, {columns} FROM {source})"


def pct_rank(x: str, by: str = "d") -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by})"


def rounded(source: str, exact: list[str], doubles: list[str], places: int = 6) -> str:
    columns = [*exact, *(f'round(CAST("{x}" AS DOUBLE), {places}) + 0.0 AS "{x}"' for x in doubles)]
    return f"SELECT {', '.join(columns)} FROM {source}"


def statement(*parts: str) -> str:
    *steps, last = parts
    return f"WITH {', '.join(steps)} {last}" if steps else last
