"""Queries on folds, metrics and backtests of a score that SQL can repeat: the rank of a month's return."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import windows as W
from panelspark.operators import backtest as B
from panelspark.operators import evaluation as E
from panelspark.operators import indicators as I
from panelspark.plans import sql as S
from panelspark.plans.panel import EXACT, rounded
from panelspark.sources import tables as T

QUERIES, ORACLE_SQL = {}, {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def scored(spark, d, horizon: int = 5):
    """stock, d, y, p of all labelled rows."""
    bars = I.add_labels(T.nation_bars(spark, d), {"Weekly": horizon})
    bars = bars.withColumn("r", W.log_ratio(F.col("c"), W.lag(F.col("c"), 21, W.over()))).where("r IS NOT NULL AND Target_Weekly IS NOT NULL")
    return bars.select("stock", "d", F.col("Target_Weekly").alias("y"), W.pct_rank(F.col("r"), ["d"]).alias("p"))


SCORED = f"""labelled AS (SELECT stock, d, {S.log_ratio('c', 21)} AS r, CASE WHEN lead(c, 5) OVER ({S.P}) IS NOT NULL THEN CASE WHEN lead(c, 5) OVER ({S.P}) > c * 1.005 THEN 1.0 ELSE 0.0 END END AS y FROM bars),
    scored AS (SELECT stock, d, y::DOUBLE AS y, {S.pct_rank('r')} AS p FROM labelled WHERE r IS NOT NULL AND y IS NOT NULL)"""
FOLDS = """days AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT d FROM scored)),
    n AS (SELECT count(*) AS n, floor(count(*)::DOUBLE * (1 - 0.15::DOUBLE))::INT AS test_start, floor(count(*)::DOUBLE * 0.45::DOUBLE)::INT AS cv_start FROM days),
    s AS (SELECT *, floor((test_start - 5 - cv_start) / 4.0)::INT AS size FROM n),
    bounds AS (SELECT k.fold::INT AS fold, (cv_start + k.fold * size)::INT AS first, (cv_start + k.fold * size + size - 1)::INT AS last FROM s, range(4) k(fold) UNION ALL SELECT -1, test_start, (n - 1)::INT FROM s),
    folds AS (SELECT *, greatest(first - 5, 0)::INT AS train_before FROM bounds),
    roles AS (SELECT x.*, fold, CASE WHEN i < train_before THEN 'train' ELSE 'evaluate' END AS role FROM scored x JOIN days USING (d) JOIN folds ON i < train_before OR i BETWEEN first AND last)"""
BASE = [S.BARS, SCORED, FOLDS]


@query("l2_fold_bounds", S.statement(*BASE, "SELECT * FROM folds"))
def l2_fold_bounds(spark, d):
    return E.fold_bounds(scored(spark, d), 5)


@query("l4_fold_roles", S.statement(*BASE, "SELECT fold, role, count(*) AS n, min(d) AS first_day, max(d) AS last_day FROM roles GROUP BY ALL"))
def l4_fold_roles(spark, d):
    x = scored(spark, d)
    roles = E.fold_roles(x, E.fold_bounds(x, 5))
    return roles.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


@query("l5_split_integrity", S.statement(*BASE, "ends AS (SELECT fold, max(CASE WHEN role = 'train' THEN d END) AS a, min(CASE WHEN role = 'evaluate' THEN d END) AS b FROM roles GROUP BY 1)", "SELECT fold, count(d) AS gap, count(d) >= 4 AS ok FROM ends LEFT JOIN days ON d > a AND d < b GROUP BY 1"))
def l5_split_integrity(spark, d):
    x = scored(spark, d)
    return E.split_integrity(x, E.fold_bounds(x, 5), 5)


METRIC_SQL = f"""v AS (SELECT *, median(p) OVER (PARTITION BY fold, d) AS middle, ({S.pct_rank('p', 'fold, d')}) * 100 AS pct, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS q FROM roles WHERE role = 'evaluate'),
    m AS (SELECT fold, count(*) AS n, sum(CASE WHEN y = 1 AND p >= middle THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p >= middle THEN 1.0 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND p < middle THEN 1.0 ELSE 0 END) AS fn,
        sum(CASE WHEN y = 0 AND p < middle THEN 1.0 ELSE 0 END) AS tn, avg(CASE WHEN pct >= 60 THEN y END) AS up_signal_precision, avg(CASE WHEN pct >= 80 THEN y END) AS up_rate_top_quintile, avg(CASE WHEN pct <= 20 THEN y END) AS up_rate_bottom_quintile,
        avg(y) AS up_rate, -avg(y * ln(q) + (1 - y) * ln(1 - q)) AS log_loss, avg((p - y) * (p - y)) AS brier_score FROM v GROUP BY 1),
    k AS (SELECT fold, p, sum(y) AS n1, sum(1 - y) AS n0 FROM v GROUP BY ALL),
    w AS (SELECT *, coalesce(sum(n0) OVER (PARTITION BY fold ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k),
    a AS (SELECT fold, sum(n1 * (below + n0 / 2)) / (sum(n1) * sum(n0)) AS roc_auc FROM w GROUP BY 1),
    e AS (SELECT fold, n, roc_auc, (tp + tn) / n AS directional_accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
        up_signal_precision, up_rate_top_quintile, up_rate_bottom_quintile, up_rate, greatest(up_rate, 1 - up_rate) AS majority_baseline_accuracy, log_loss, brier_score, sqrt(brier_score) AS rmse_probability FROM m JOIN a USING (fold))"""


@query("e_metrics", S.statement(*BASE, METRIC_SQL, S.rounded("e", ["fold", "n"], E.METRICS)))
def e_metrics(spark, d):
    x = scored(spark, d)
    rows = E.fold_roles(x, E.fold_bounds(x, 5)).where("role = 'evaluate'")
    return rounded(E.evaluate(rows, ["fold"]), ["fold", "n"], E.METRICS)


@query("m8_ensemble_score", S.statement(*BASE, f"""other AS (SELECT stock, d, fold, y, p, {S.pct_rank('v', 'd')} AS p2 FROM roles JOIN bars b USING (stock, d) WHERE role = 'evaluate' AND fold >= 0),
    mean AS (SELECT fold, y, (p + p2) / 2 AS p FROM other), k AS (SELECT fold, p, sum(y) AS n1, sum(1 - y) AS n0 FROM mean GROUP BY ALL),
    w AS (SELECT *, coalesce(sum(n0) OVER (PARTITION BY fold ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k), a AS (SELECT fold, sum(n1 * (below + n0 / 2)) / nullif(sum(n1) * sum(n0), 0) AS auc FROM w GROUP BY 1)""",
    "SELECT count(auc) AS folds, round(avg(auc), 6) AS cv_auc FROM a"))
def m8_ensemble_score(spark, d):
    """The mean of two models' forecasts, joined on day, stock and outcome, scored by the mean AUC of its folds."""
    x = scored(spark, d)
    first = E.fold_roles(x, E.fold_bounds(x, 5)).where("role = 'evaluate' and fold >= 0").drop("role")
    volume = T.nation_bars(spark, d).select("stock", "d", "v")
    second = first.select("stock", "d", "y", "fold").join(volume, EXACT).select(*EXACT, "y", W.pct_rank(F.col("v"), ["d"]).alias("p2"))
    both = first.join(second, [*EXACT, "y"]).select("fold", "y", ((F.col("p") + F.col("p2")) / 2).alias("p"))
    return E.auc(both, ["fold"]).agg(F.count("roc_auc").alias("folds"), F.round(F.avg("roc_auc"), 6).alias("cv_auc"))


@query("m11_reference_cross_section", S.statement(S.BARS, SCORED, "l AS (SELECT *, row_number() OVER (PARTITION BY stock ORDER BY d DESC) AS back FROM scored)", "SELECT stock, d, round(p, 6) AS p, round(median(p) OVER (), 6) AS threshold FROM l WHERE back = 1 AND d >= (SELECT max(d) FROM scored) - INTERVAL 10 DAY"))
def m11_reference_cross_section(spark, d):
    """Each stock's last forecast if it is at most ten days older than the latest, and their median."""
    x = scored(spark, d)
    last = x.groupBy("stock").agg(F.max_by(F.struct("d", "p"), "d").alias("x")).select("stock", "x.*")
    last = last.join(F.broadcast(x.agg(F.max("d").alias("latest"))), F.lit(True)).where(F.datediff("latest", "d") <= 10)
    return last.join(last.agg(F.median("p").alias("threshold")), F.lit(True)).select("stock", "d", F.round("p", 6).alias("p"), F.round("threshold", 6).alias("threshold"))


REFERENCE = "l AS (SELECT *, row_number() OVER (PARTITION BY stock ORDER BY d DESC) AS back FROM scored), ref AS (SELECT p FROM l WHERE back = 1 AND d >= (SELECT max(d) FROM scored) - INTERVAL 10 DAY)"


@query("m12_direction", S.statement(S.BARS, SCORED, REFERENCE, """x AS (SELECT stock, d, p FROM l WHERE back <= 3),
    r AS (SELECT stock, d, 100 * (SELECT (sum(CASE WHEN abs(ref.p - x.p) <= 1e-4 + 1e-5 * abs(x.p) THEN 0.5 WHEN ref.p < x.p THEN 1.0 ELSE 0 END)) / count(*) FROM ref) AS pct FROM x)""",
    "SELECT stock, d, round(pct, 6) AS pct, CASE WHEN round(pct, 9) >= 60 THEN 'UP' WHEN round(pct, 9) <= 40 THEN 'DOWN' ELSE 'NEUTRAL' END AS direction FROM r"))
def m12_direction(spark, d):
    """Mid-rank of each stock's last three forecasts in the reference cross-section, one row a stock at most."""
    from pyspark.sql import Window

    x = scored(spark, d)
    back = Window.partitionBy("stock").orderBy(F.desc("d"))
    rows = x.withColumn("back", F.row_number().over(back))
    reference = rows.where("back = 1").join(F.broadcast(x.agg(F.max("d").alias("latest"))), F.lit(True)).where(F.datediff("latest", "d") <= 10)
    exact = F.round("pct", 9)
    direction = F.when(exact >= 60, "UP").when(exact <= 40, "DOWN").otherwise("NEUTRAL")
    ranked = E.mid_ranks(rows.where("back <= 3").select("stock", "d", "p"), reference.select("p"))
    return ranked.select("stock", "d", F.round("pct", 6).alias("pct"), direction.alias("direction"))


@query("m12_repeated_rows", S.statement(S.BARS, SCORED, REFERENCE, """x AS (SELECT stock, d, p FROM l WHERE back <= 3), again AS (SELECT * FROM x UNION ALL SELECT * FROM x WHERE stock % 2 = 0),
    r AS (SELECT stock, d, 100 * (SELECT (sum(CASE WHEN abs(ref.p - again.p) <= 1e-4 + 1e-5 * abs(again.p) THEN 0.5 WHEN ref.p < again.p THEN 1.0 ELSE 0 END)) / count(*) FROM ref) AS pct FROM again)""",
    "SELECT stock, d, round(pct, 6) AS pct, count(*) AS n FROM r GROUP BY ALL"))
def m12_repeated_rows(spark, d):
    """Mid-ranks of rows some of which come twice: as many come out."""
    from pyspark.sql import Window

    x = scored(spark, d)
    rows = x.withColumn("back", F.row_number().over(Window.partitionBy("stock").orderBy(F.desc("d"))))
    reference = rows.where("back = 1").join(F.broadcast(x.agg(F.max("d").alias("latest"))), F.lit(True)).where(F.datediff("latest", "d") <= 10)
    three = rows.where("back <= 3").select("stock", "d", "p")
    ranked = E.mid_ranks(three.unionAll(three.where("stock % 2 = 0")), reference.select("p"))
    return ranked.groupBy("stock", "d", F.round("pct", 6).alias("pct")).agg(F.count(F.lit(1)).alias("n"))


def backtest_sql(sizing: str = "equal", every: int = 5, top: float = 0.2, rate: float = 0.0015, execution: str = "next_open", entry: float | None = None, leave: float | None = None, least: int = 3) -> list[str]:
    """With ``leave`` no period may have fewer than ``least`` stocks to choose: SQL has no fallback there."""
    fill = f"fill AS (SELECT stock, d, lead(o) OVER ({S.P}) AS fill FROM bars)" if execution == "next_open" else "fill AS (SELECT stock, d, c AS fill FROM bars)"
    pct = f"({S.pct_rank('p', 'period')}) * 100"
    picked = f"{pct} >= {entry}" if entry is not None else f"{pct} > {(1 - top) * 100!r}::DOUBLE"
    chosen = f"t2 AS (SELECT *, CASE WHEN sum(picked::INT) OVER (PARTITION BY period) < {least} THEN best <= {least} ELSE picked END AS chosen FROM t1)"
    if leave is not None:
        chosen = f"""h1 AS (SELECT *, dense_rank() OVER (ORDER BY period) AS turn FROM t1), h2 AS (SELECT *, coalesce((turn - lag(turn) OVER (PARTITION BY stock ORDER BY turn) <> 1)::INT, 1) AS starts FROM h1),
    h3 AS (SELECT *, sum(starts) OVER (PARTITION BY stock ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM h2),
    t2 AS (SELECT *, coalesce(last_value(CASE WHEN picked THEN true WHEN pct < {leave} THEN false END IGNORE NULLS) OVER (PARTITION BY stock, run ORDER BY turn ROWS UNBOUNDED PRECEDING), false) AS chosen FROM h3)"""
    weight = "CASE WHEN chosen THEN 1.0::DOUBLE / sum(chosen::INT) OVER (PARTITION BY period) ELSE 0 END"
    join = ""
    if sizing == "inverse_vol":
        inv = "CASE WHEN chosen AND vol > 0 THEN 1 / vol END"
        weight = f"CASE WHEN sum({inv}) OVER (PARTITION BY period) > 0 THEN coalesce(({inv}) / sum({inv}) OVER (PARTITION BY period), 0) ELSE {weight} END"
        days = "(SELECT d, row_number() OVER (ORDER BY d) AS day FROM (SELECT DISTINCT d FROM bars))"
        follows = f"CASE WHEN day - lag(day) OVER ({S.P}) = 1 THEN {S.log_ratio('c', 1)} END"
        near = "OVER (PARTITION BY stock ORDER BY day RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)"
        vol = f"CASE WHEN count(r) {near} = 20 THEN stddev_samp(r) {near} END"
        join = f" LEFT JOIN (SELECT stock, d, {vol} AS vol FROM (SELECT stock, d, day, {follows} AS r FROM bars JOIN {days} USING (d))) USING (stock, d)"
    return [S.BARS, SCORED, f"""{fill},
    cal AS (SELECT d, lead(d) OVER (ORDER BY d) AS next, row_number() OVER (ORDER BY d) - 1 AS period FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT d FROM scored)) WHERE i % {every} = 0),
    t0 AS (SELECT x.stock, x.d, c.next, period, p, f.fill AS entry, g.fill AS exit, count(*) OVER (PARTITION BY period) AS tradable FROM scored x JOIN cal c USING (d) JOIN fill f ON f.stock = x.stock AND f.d = x.d JOIN fill g ON g.stock = x.stock AND g.d = c.next WHERE f.fill IS NOT NULL AND g.fill IS NOT NULL),
    t1 AS (SELECT *, {pct} AS pct, {picked} AS picked, row_number() OVER (PARTITION BY period ORDER BY p DESC, stock) AS best FROM t0 WHERE tradable >= {least}),
    {chosen},
    held AS (SELECT dense_rank() OVER (ORDER BY period) AS step, d, next, stock, p, chosen, {weight} AS weight, exit / entry - 1 AS gross FROM t2{join}),
    drift AS (SELECT step, stock, weight * (1 + gross) / sum(weight * (1 + gross)) OVER (PARTITION BY step) AS drift FROM held WHERE chosen),
    turned AS (SELECT coalesce(a.step, b.step + 1) AS step, sum(abs(coalesce(weight, 0) - coalesce(drift, 0))) AS turnover FROM (SELECT * FROM held WHERE chosen) a FULL JOIN drift b ON b.step + 1 = a.step AND a.stock = b.stock GROUP BY 1),
    per AS (SELECT step, next, sum(weight * gross) AS gross, sum(chosen::INT)::BIGINT AS positions, avg(gross) AS benchmark_return FROM held GROUP BY ALL),
    last_ AS (SELECT *, CASE WHEN step = (SELECT max(step) FROM held) THEN 1.0 ELSE 0.0 END AS out_ FROM per JOIN turned USING (step)),
    net AS (SELECT step, next AS d, positions, turnover + out_ AS turnover, (turnover + out_) * {rate} AS cost, (1 + gross - turnover * {rate}) * (1 - out_ * {rate}) - 1 AS period_return, benchmark_return FROM last_),
    curve AS (SELECT *, exp(sum(ln(1 + period_return)) OVER (ORDER BY step)) AS growth, exp(sum(ln(1 + benchmark_return)) OVER (ORDER BY step)) AS benchmark_growth FROM net),
    ledger AS (SELECT d AS entry_date, next AS exit_date, stock, weight, gross AS gross_return, gross - {2 * rate} AS net_return, weight * {2 * rate} AS cost FROM held WHERE chosen)"""]


CURVE = ["turnover", "cost", "period_return", "benchmark_return", "log_equity", "log_benchmark"]


def curve_of(spark, d, config):
    held = B.positions(scored(spark, d), T.nation_bars(spark, d), config)
    return held, B.equity_curve(held, config)


def _curve_query(sizing):
    def run(spark, d):
        config = B.Config(sizing=sizing)
        _, curve = curve_of(spark, d, config)
        logs = curve.withColumn("log_equity", F.ln("growth")).withColumn("log_benchmark", F.ln("benchmark_growth"))
        return rounded(logs, ["step", "d", "positions"], CURVE)

    return run


for _name, _sizing in (("b12_equity_curve", "equal"), ("b8_inverse_volatility", "inverse_vol")):
    query(_name, S.statement(*backtest_sql(_sizing), "z AS (SELECT *, ln(growth) AS log_equity, ln(benchmark_growth) AS log_benchmark FROM curve)", S.rounded("z", ["CAST(step AS INTEGER) AS step", "d", "positions"], CURVE)))(_curve_query(_sizing))

LEDGER = ["weight", "gross_return", "net_return", "cost"]


@query("b14_trades", S.statement(*backtest_sql(), S.rounded("ledger", ["entry_date", "exit_date", "stock"], LEDGER)))
def b14_trades(spark, d):
    config = B.Config()
    return rounded(B.trades(B.positions(scored(spark, d), T.nation_bars(spark, d), config), config), ["entry_date", "exit_date", "stock"], LEDGER)


SUMMARY = ["annualised_volatility", "sharpe_ratio", "win_rate", "profit_factor", "average_trade_return", "total_cost_paid"]


@query("b16_metrics", S.statement(*backtest_sql(), """m AS (SELECT count(*) AS periods, avg(period_return) AS m, stddev_samp(period_return) AS s FROM curve),
    t AS (SELECT count(*) AS number_of_trades, avg((net_return > 0)::INT) AS win_rate, sum(net_return) FILTER (WHERE net_return > 0) AS won, sum(net_return) FILTER (WHERE net_return < 0) AS lost, avg(net_return) AS average_trade_return, sum(cost) AS total_cost_paid FROM ledger),
    z AS (SELECT periods, number_of_trades, s * sqrt(252 / 5.0) AS annualised_volatility, m / s * sqrt(252 / 5.0) AS sharpe_ratio, win_rate, won / abs(lost) AS profit_factor, average_trade_return, total_cost_paid FROM m, t)""", S.rounded("z", ["periods", "number_of_trades"], SUMMARY, 5)))
def b16_metrics(spark, d):
    config = B.Config()
    held, curve = curve_of(spark, d, config)
    return rounded(B.metrics(curve, B.trades(held, config), config), ["periods", "number_of_trades"], SUMMARY, 5)


SWEPT = {
    "plain": {}, "every 10": {"every": 10}, "top 40": {"top": 0.4}, "dear": {"rate": 0.004}, "at close": {"execution": "close"},
    "by volatility": {"sizing": "inverse_vol", "every": 10}, "keeps": {"entry": 80.0, "leave": 50.0, "least": 1}, "keeps longer": {"entry": 70.0, "leave": 40.0, "least": 1, "every": 10, "rate": 0.0005},
}


def swept() -> dict[str, B.Config]:
    names = {"every": "rebalance"}
    of = lambda x: {names.get(k, k): v for k, v in x.items() if k != "rate"} | ({"cost_bps": x["rate"] * 10_000, "slippage_bps": 0.0} if "rate" in x else {})
    return {name: B.Config(**of(x)) for name, x in SWEPT.items()}


@query("b19_sweep", " UNION ALL ".join("SELECT * FROM (" + S.statement(*backtest_sql(**x), f"""SELECT '{name}' AS config, count(*) AS periods, sum(positions)::BIGINT AS positions, round(sum(turnover), 5) AS turnover, round(sum(ln(1 + period_return)), 5) + 0.0 AS log_equity,
    round(sum(ln(1 + benchmark_return)), 5) + 0.0 AS log_benchmark, (SELECT count(*) FROM ledger) AS number_of_trades, round((SELECT sum(cost) FROM ledger), 5) AS total_cost_paid FROM curve""") + ")" for name, x in SWEPT.items()))
def b19_sweep(spark, d):
    """Eight settings of a backtest in one plan, two of them with hysteresis."""
    configs = swept()
    curve, _, metrics = B.sweep(scored(spark, d), T.nation_bars(spark, d), configs)
    total = lambda c, n: (F.round(F.sum(c), 5) + F.lit(0.0)).alias(n)
    sums = curve.groupBy("config").agg(F.count(F.lit(1)).alias("periods"), F.sum("positions").alias("positions"), total("turnover", "turnover"), total(F.log1p("period_return"), "log_equity"), total(F.log1p("benchmark_return"), "log_benchmark"))
    return sums.join(metrics.select("config", "number_of_trades", F.round("total_cost_paid", 5).alias("total_cost_paid")), "config")


@query("b12_total_loss", S.statement(*backtest_sql(), "hit AS (SELECT step, d, CASE WHEN step = 100 THEN -1.0 WHEN step = 120 THEN -1.5 ELSE period_return END AS r FROM curve), w AS (SELECT *, sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER (ORDER BY step) AS logs, max((r <= -1)::INT) OVER (ORDER BY step) AS lost FROM hit)",
    "SELECT CAST(step AS INTEGER) AS step, d, lost = 1 AS lost, round(CASE WHEN lost = 0 THEN logs END, 6) AS log_equity FROM w"))
def b12_total_loss(spark, d):
    """A curve in which a period loses everything, and a later one more than that: nothing comes back."""
    config = B.Config()
    _, curve = curve_of(spark, d, config)
    lost = F.when(F.col("step") == 100, -1.0).when(F.col("step") == 120, -1.5).otherwise(F.col("period_return"))
    periods = curve.select(F.lit("").alias("config"), "step", "d", lost.alias("period_return"), "benchmark_return", F.lit(config.capital).alias("capital"))
    return B.with_equity(periods).select("step", "d", (F.col("growth") == 0).alias("lost"), F.round(F.ln(F.nullif(F.col("growth"), F.lit(0.0))), 6).alias("log_equity"))


@query("b2_days_without_forecasts", S.statement(S.BARS, SCORED, "kept AS (SELECT DISTINCT d FROM scored WHERE day(d) <> 13), i AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM kept), c AS (SELECT d, lead(d) OVER (ORDER BY d) AS next, row_number() OVER (ORDER BY d) - 1 AS period FROM i WHERE i % 5 = 0)", 'SELECT d, "next", CAST(period AS INTEGER) AS period FROM c WHERE "next" IS NOT NULL'))
def b2_days_without_forecasts(spark, d):
    """The rebalance calendar where the forecasts of every 13th of a month are missing."""
    x = scored(spark, d).withColumn("p", F.when(F.dayofmonth("d") != 13, F.col("p")))
    return B.calendar(x, 5)


HELD = backtest_sql()[2]
HYSTERESIS = HELD[: HELD.index("t1 AS")] + f"""t1 AS (SELECT *, ({S.pct_rank('p', 'period')}) * 100 AS pct, dense_rank() OVER (ORDER BY period) AS step FROM t0),
    t2 AS (SELECT *, coalesce((step - lag(step) OVER (PARTITION BY stock ORDER BY step) <> 1)::INT, 1) AS starts FROM t1),
    t3 AS (SELECT *, sum(starts) OVER (PARTITION BY stock ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM t2),
    t4 AS (SELECT *, coalesce(last_value(CASE WHEN pct >= 80 THEN true WHEN pct < 50 THEN false END IGNORE NULLS) OVER (PARTITION BY stock, run ORDER BY step ROWS UNBOUNDED PRECEDING), false) AS chosen FROM t3)"""


@query("b7_hysteresis", S.statement(S.BARS, SCORED, HYSTERESIS, "SELECT CAST(step AS INTEGER) AS step, d, stock, round(1.0 / count(*) OVER (PARTITION BY step), 6) AS weight FROM t4 WHERE chosen"))
def b7_hysteresis(spark, d):
    """Stocks enter at the 80th percentile and stay to the 50th."""
    held = B.positions(scored(spark, d), T.nation_bars(spark, d), B.Config(entry=80.0, leave=50.0, least=1))
    return held.where("chosen").select("step", "d", "stock", F.round("weight", 6).alias("weight"))


VOLUME_SCORED = SCORED.replace(f"{S.log_ratio('c', 21)} AS r", f"CASE WHEN {S.log_ratio('c', 21).replace('CASE WHEN', 'CASE WHEN', 1)} IS NOT NULL THEN v END AS r")
CURVE_SQL = "SELECT d, round(ln(growth), 6) AS strategy, round(ln(benchmark_growth), 6) AS benchmark FROM curve"


@query("b3_notes", S.statement(*backtest_sql(), "few AS (SELECT 'first 4 periods' AS run, count(*) AS periods FROM curve WHERE step <= 4 UNION ALL SELECT 'whole', count(*) FROM curve)", "SELECT run, periods || ' periods are few: read with care' AS note FROM few WHERE periods < 6 UNION ALL SELECT 'one day', 'fewer than two rebalance days: no result'"))
def b3_notes(spark, d):
    """What a backtest says of itself: none on the whole table, few periods, or one day only."""
    config = B.Config()
    x = scored(spark, d)
    _, curve = curve_of(spark, d, config)
    one = x.join(F.broadcast(x.agg(F.min("d").alias("d"))), "d")
    whole = B.notes(curve, x, config).withColumn("run", F.lit("whole"))
    few = B.notes(curve.where("step <= 4"), x, config).withColumn("run", F.lit("first 4 periods"))
    single = B.notes(curve.where("step < 0"), one, config).withColumn("run", F.lit("one day"))
    return whole.unionByName(few).unionByName(single).select("run", "note")


def at_horizon(h: int) -> list[str]:
    """BASE for another horizon of labels and embargo."""
    return [S.BARS, SCORED.replace("lead(c, 5)", f"lead(c, {h})"), FOLDS.replace("test_start - 5", f"test_start - {h}").replace("first - 5", f"first - {h}")]


INSIGHT = ["roc_auc", "balanced_accuracy", "up_rate_top_quintile", "up_rate_bottom_quintile", "up_rate", "n"]


@query("q9_model_insight", " UNION ALL ".join("SELECT * FROM (" + S.statement(*at_horizon(h), METRIC_SQL, "span AS (SELECT min(d) AS first_day, max(d) AS last_day FROM roles WHERE fold = -1 AND role = 'evaluate')", f"SELECT {h} AS horizon, {', '.join(f'round(CAST({m} AS DOUBLE), 6) + 0.0 AS {m}' for m in INSIGHT)}, first_day, last_day FROM e, span WHERE fold = -1") + ")" for h in (5, 21)))
def q9_model_insight(spark, d):
    """Test metrics and test period of each horizon."""
    out = None
    for h in (5, 21):
        x = scored(spark, d, h)
        rows = E.fold_roles(x, E.fold_bounds(x, h)).where("role = 'evaluate' and fold = -1")
        found = rounded(E.evaluate(rows, ["fold"]).withColumn("horizon", F.lit(h)), ["horizon"], INSIGHT)
        found = found.join(rows.agg(F.min("d").alias("first_day"), F.max("d").alias("last_day")), F.lit(True))
        out = found if out is None else out.unionByName(found)
    return out


CARD_AUC = """k AS (SELECT p, sum(y) AS n1, sum(1 - y) AS n0 FROM roles WHERE fold = -1 AND role = 'evaluate' GROUP BY 1), w AS (SELECT *, coalesce(sum(n0) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k),
    a AS (SELECT sum(n1 * (below + n0 / 2)) / (sum(n1) * sum(n0)) AS auc FROM w)"""


@query("q3_forecast_card", S.statement(*BASE, REFERENCE, CARD_AUC, """x AS (SELECT stock, d, p FROM l WHERE back = 1),
    r AS (SELECT stock, d, p, 100 * (SELECT (sum(CASE WHEN abs(ref.p - x.p) <= 1e-4 + 1e-5 * abs(x.p) THEN 0.5 WHEN ref.p < x.p THEN 1.0 ELSE 0 END)) / count(*) FROM ref) AS pct FROM x)""",
    "SELECT stock, d, round(p * 100, 2) AS up_probability, round(pct, 1) AS percentile, CASE WHEN round(pct, 9) >= 60 THEN 'UP' WHEN round(pct, 9) <= 40 THEN 'DOWN' ELSE 'NEUTRAL' END AS direction, round(auc, 4) AS test_auc FROM r, a"))
def q3_forecast_card(spark, d):
    """Each stock's latest forecast: direction, probability, rank among all, and what the test block says of the model."""
    from pyspark.sql import Window

    x = scored(spark, d)
    last = x.withColumn("back", F.row_number().over(Window.partitionBy("stock").orderBy(F.desc("d")))).where("back = 1").select("stock", "d", "p")
    reference = last.join(F.broadcast(x.agg(F.max("d").alias("latest"))), F.lit(True)).where(F.datediff("latest", "d") <= 10).select("p")
    tested = E.auc(E.fold_roles(x, E.fold_bounds(x, 5)).where("fold = -1 and role = 'evaluate'"), ["fold"]).select(F.round("roc_auc", 4).alias("test_auc"))
    exact = F.round("pct", 9)
    direction = F.when(exact >= 60, "UP").when(exact <= 40, "DOWN").otherwise("NEUTRAL")
    ranked = E.mid_ranks(last, reference).join(F.broadcast(tested), F.lit(True))
    return ranked.select("stock", "d", F.round(F.col("p") * 100, 2).alias("up_probability"), F.round("pct", 1).alias("percentile"), direction.alias("direction"), "test_auc")


@query("b18_two_strategies", f"SELECT a.d, a.strategy, a.benchmark, b.strategy AS baseline FROM ({S.statement(*backtest_sql(), CURVE_SQL)}) a LEFT JOIN ({S.statement(*[x if x != SCORED else VOLUME_SCORED for x in backtest_sql()], CURVE_SQL)}) b USING (d)")
def b18_two_strategies(spark, d):
    """Log growth of the score's strategy, the benchmark, and a strategy that follows volume."""
    config, prices = B.Config(), T.nation_bars(spark, d)
    first = scored(spark, d)
    second = first.drop("p").join(prices.select(*EXACT, "v"), EXACT).withColumn("p", W.pct_rank(F.col("v"), ["d"]))
    log = lambda x: F.round(F.ln(x), 6)
    a = B.equity_curve(B.positions(first, prices, config), config).select("d", log("growth").alias("strategy"), log("benchmark_growth").alias("benchmark"))
    b = B.equity_curve(B.positions(second, prices, config), config).select("d", log("growth").alias("baseline"))
    return a.join(b, "d", "left")


@query("b17_long_flat", S.statement(S.BARS, SCORED, f"""ranked AS (SELECT stock, d, ({S.pct_rank('p')}) * 100 AS pct, row_number() OVER ({S.P}) - 1 AS i FROM scored),
    f AS (SELECT r.stock, r.d, pct, fill FROM ranked r LEFT JOIN (SELECT stock, d, lead(o) OVER ({S.P}) AS fill FROM bars) USING (stock, d) WHERE i % 5 = 0),
    x AS (SELECT * FROM (SELECT *, lead(fill) OVER ({S.P}) AS exit FROM f) WHERE fill IS NOT NULL AND exit IS NOT NULL),
    w AS (SELECT *, coalesce(last_value(CASE WHEN pct >= 60 THEN true WHEN pct < 50 THEN false END IGNORE NULLS) OVER ({S.P} ROWS UNBOUNDED PRECEDING), false) AS want FROM x),
    r AS (SELECT stock, d, want, CASE WHEN want THEN exit / fill - 1 ELSE 0 END - CASE WHEN want = coalesce(lag(want) OVER ({S.P}), false) THEN 0 ELSE 0.0015 END AS period_return FROM w),
    e AS (SELECT *, sum(ln(1 + period_return)) OVER ({S.P}) AS log_equity FROM r)""", S.rounded("e", ["stock", "d", "want"], ["period_return", "log_equity"])))
def b17_long_flat(spark, d):
    found = B.long_flat(scored(spark, d), T.nation_bars(spark, d), B.Config())
    return rounded(found.withColumn("log_equity", F.ln("equity")), ["stock", "d", "want"], ["period_return", "log_equity"])
