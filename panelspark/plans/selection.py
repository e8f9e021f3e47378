"""Queries on feature selection and look-ahead audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import windows as W
from panelspark.operators import indicators as I
from panelspark.operators import selection as X
from panelspark.plans import sql as S
from panelspark.plans.panel import EXACT
from panelspark.sources import tables as T

QUERIES, ORACLE_SQL = {}, {}
USED = ["Ret_1", "Ret_5", "Ret_21", "RSI", "Stoch_K", "SMA20_Ratio", "BB_PctB", "Volatility"]
EXTRA = ["Twin", "Flat", "Sparse"]


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def labelled(spark, d):
    """All labelled rows with a few features, a copy, a constant and a sparse one."""
    bars = I.add_labels(I.baseline(T.nation_bars(spark, d)), {"Weekly": 5}).where("Target_Weekly is not null")
    rounded = [F.round(F.col(f), 6).alias(f) for f in USED]
    r5 = F.round("Ret_5", 6)
    return bars.select(*EXACT, F.col("Target_Weekly").alias("y"), *rounded, (r5 * 2).alias("Twin"), F.lit(1.0).alias("Flat"), F.when(F.col("stock") < 3, r5).alias("Sparse"))


ROWS = f"""smp AS (SELECT stock, d, y, {', '.join(f'round({f}, 6) AS {f}' for f in USED)}, round(Ret_5, 6) * 2 AS Twin, 1.0::DOUBLE AS Flat, CASE WHEN stock < 3 THEN round(Ret_5, 6) END AS Sparse
    FROM (SELECT *, CASE WHEN lead(c, 5) OVER ({S.P}) IS NOT NULL THEN CASE WHEN lead(c, 5) OVER ({S.P}) > c * 1.005 THEN 1.0::DOUBLE ELSE 0.0 END END AS y FROM base)
    WHERE y IS NOT NULL),
    long AS ({' UNION ALL '.join(f"SELECT stock, d, y, '{f}' AS feature, {f} AS x FROM smp" for f in [*USED, *EXTRA])})"""
BASE = [S.BARS, S.BASELINE, ROWS]


def long(spark, d):
    return X.long_form(labelled(spark, d), [*EXACT, "y"], [*USED, *EXTRA])


@query("x2_low_coverage", S.statement(*BASE, "SELECT feature, round(avg((x IS NULL)::INT), 6) AS missing FROM long GROUP BY 1 HAVING avg((x IS NULL)::INT) > 0.5"))
def x2_low_coverage(spark, d):
    return X.low_coverage(long(spark, d)).select("feature", F.round("missing", 6).alias("missing"))


@query("x3_near_constant", S.statement(*BASE, "k AS (SELECT feature, x, count(*) AS n FROM long WHERE x IS NOT NULL GROUP BY ALL)", 'SELECT feature, count(*) AS "values", round(max(n) / sum(n), 6) AS top_share FROM k GROUP BY 1 HAVING count(*) <= 1 OR max(n) / sum(n) > 0.99'))
def x3_near_constant(spark, d):
    return X.near_constant(long(spark, d)).select("feature", "values", F.round("top_share", 6).alias("top_share"))


PAIRS = f"""pair AS (SELECT a.feature AS a, b.feature AS b, a.x AS xa, b.x AS xb FROM long a JOIN long b USING (stock, d) WHERE a.feature < b.feature AND a.x IS NOT NULL AND b.x IS NOT NULL),
    ranked AS (SELECT a, b, {S.pct_rank('xa', 'a, b')} AS ra, {S.pct_rank('xb', 'a, b')} AS rb FROM pair), rho AS (SELECT a, b, CASE WHEN count(DISTINCT ra) > 1 AND count(DISTINCT rb) > 1 THEN corr(ra, rb) END AS rho FROM ranked GROUP BY ALL)"""


NAMES = ", ".join(f"('{f}')" for f in [*USED, *EXTRA])


@query("x4_spearman", S.statement(*BASE, PAIRS, f"names(f) AS (VALUES {NAMES})", "SELECT x.f AS a, y.f AS b, round(rho, 6) + 0.0 AS rho FROM names x JOIN names y ON x.f < y.f LEFT JOIN rho ON a = x.f AND b = y.f"))
def x4_spearman(spark, d):
    pairs = X.spearman(labelled(spark, d), [*USED, *EXTRA])
    return pairs.select("a", "b", (F.round(F.col("rho"), 6) + F.lit(0.0)).alias("rho"))


@query("x4_target_correlation", S.statement(*BASE, f"r AS (SELECT feature, {S.pct_rank('x', 'feature')} AS rx, {S.pct_rank('y', 'feature')} AS ry FROM long WHERE x IS NOT NULL)", "SELECT feature, round(CASE WHEN count(DISTINCT rx) > 1 THEN corr(rx, ry) END, 6) + 0.0 AS rho FROM r GROUP BY 1"))
def x4_target_correlation(spark, d):
    return X.target_correlation(long(spark, d)).select("feature", (F.round("rho", 6) + F.lit(0.0)).alias("rho"))


PLACES = ", ".join(f"('{f}', {i})" for i, f in enumerate([*USED, *EXTRA]))


@query("x5_duplicates", S.statement(*BASE, PAIRS, f"""place(feature, i) AS (VALUES {PLACES}),
    close AS (SELECT x.i AS i, y.i AS j FROM rho JOIN place x ON x.feature = a JOIN place y ON y.feature = b WHERE abs(rho) >= 0.999 UNION ALL SELECT y.i, x.i FROM rho JOIN place x ON x.feature = a JOIN place y ON y.feature = b WHERE abs(rho) >= 0.999)""",
    """walk AS (WITH RECURSIVE w(step, kept) AS (SELECT 0, CAST([] AS BIGINT[]) UNION ALL SELECT step + 1, CASE WHEN EXISTS (SELECT 1 FROM close c WHERE c.j = step AND list_contains(kept, c.i)) THEN kept ELSE list_append(kept, step) END FROM w WHERE step < (SELECT count(*) FROM place)) SELECT kept FROM w ORDER BY step DESC LIMIT 1)""",
    """SELECT p.feature, (SELECT q.feature FROM place q JOIN close c ON c.i = q.i WHERE c.j = p.i AND q.i < p.i AND list_contains(kept, q.i) ORDER BY q.i LIMIT 1) AS "of" FROM place p, walk WHERE NOT list_contains(kept, p.i)"""))
def x5_duplicates(spark, d):
    return X.duplicates(X.spearman(labelled(spark, d), [*USED, *EXTRA]), [*USED, *EXTRA])


@query("x6_clusters", S.statement(*BASE, PAIRS, "edge AS (SELECT a, b FROM rho WHERE abs(rho) >= 0.9 UNION SELECT b, a FROM rho WHERE abs(rho) >= 0.9)",
    "reach AS (WITH RECURSIVE r(feature, to_) AS (SELECT feature, feature FROM (SELECT DISTINCT feature FROM long) UNION SELECT r.feature, e.b FROM r JOIN edge e ON e.a = r.to_) SELECT * FROM r)",
    "SELECT feature, min(to_) AS cluster FROM reach GROUP BY 1"))
def x6_clusters(spark, d):
    names = spark.createDataFrame([(f,) for f in [*USED, *EXTRA]], "feature string")
    return X.clusters(X.spearman(labelled(spark, d), [*USED, *EXTRA]), names)


INFORMATION = f"""mf AS (SELECT feature, y, coalesce(x, median(x) OVER (PARTITION BY feature)) AS x FROM long), mb AS (SELECT feature, y, least(9, floor(({S.pct_rank('x', 'feature')}) * 10)) AS bin FROM mf WHERE x IS NOT NULL),
    mk AS (SELECT feature, bin, y, count(*)::DOUBLE AS n FROM mb GROUP BY ALL), mt AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS total, sum(n) OVER (PARTITION BY feature, bin) AS r, sum(n) OVER (PARTITION BY feature, y) AS c FROM mk),
    mi AS (SELECT feature, mi FROM (SELECT DISTINCT feature FROM long) LEFT JOIN (SELECT feature, sum(n / total * ln(n * total / (r * c))) AS mi FROM mt GROUP BY 1) USING (feature))"""


@query("x7_mutual_information", S.statement(*BASE, INFORMATION, "SELECT feature, round(mi, 6) + 0.0 AS mi FROM mi"))
def x7_mutual_information(spark, d):
    x = labelled(spark, d)
    found = X.mutual_information(X.long_form(x, EXACT, [*USED, *EXTRA]), x.select(*EXACT, "y"), EXACT)
    return found.select("feature", (F.round("mi", 6) + F.lit(0.0)).alias("mi"))


AUCS = """k AS (SELECT feature, x, sum(y) AS n1, sum(1 - y) AS n0 FROM long WHERE x IS NOT NULL AND feature IN (SELECT feature FROM long WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) > 1000 AND count(DISTINCT y) = 2) GROUP BY ALL),
    w AS (SELECT *, coalesce(sum(n0) OVER (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k), a AS (SELECT feature, sum(n1 * (below + n0 / 2)) / (sum(n1) * sum(n0)) AS auc FROM w GROUP BY 1)"""


@query("x14_single_feature_auc", S.statement(*BASE, AUCS, "SELECT feature, round(auc, 6) AS auc, abs(auc - 0.5) > 0.15 AS suspicious FROM a"))
def x14_single_feature_auc(spark, d):
    x = labelled(spark, d)
    found = X.single_feature_auc(X.long_form(x, EXACT, [*USED, *EXTRA]), x.select(*EXACT, "y"), EXACT)
    return found.select("feature", F.round("roc_auc", 6).alias("auc"), (F.abs(F.col("roc_auc") - 0.5) > 0.15).alias("suspicious"))


TARGET_CORRELATION = f"""tr AS (SELECT feature, {S.pct_rank('x', 'feature')} AS rx, {S.pct_rank('y', 'feature')} AS ry FROM long WHERE x IS NOT NULL), target AS (SELECT feature, CASE WHEN count(DISTINCT rx) > 1 THEN corr(rx, ry) END AS rho FROM tr GROUP BY 1)"""
METHODS = ["correlation", "mi", "edge"]


@query("x11_votes", S.statement(*BASE, AUCS, INFORMATION, TARGET_CORRELATION, "j AS (SELECT feature, round(abs(rho), 9) AS correlation, round(mi, 9) AS mi, round(abs(auc - 0.5), 9) AS edge FROM mi LEFT JOIN target USING (feature) LEFT JOIN a USING (feature))",
    f"v AS (SELECT feature, {', '.join(f'CASE WHEN {m} IS NOT NULL THEN {S.pct_rank(m, chr(49))} END AS {m}' for m in METHODS)} FROM j)",
    f"s AS (SELECT feature, {' + '.join(f'(coalesce({m} > 0.5, false))::INT' for m in METHODS)} AS votes, {' + '.join(f'coalesce({m}, 0)' for m in METHODS)} AS known, {' + '.join(f'({m} IS NOT NULL)::INT' for m in METHODS)} AS there FROM v)",
    "SELECT feature, votes, votes >= 2 AS selected, round(known / nullif(there, 0), 6) AS composite FROM s"))
def x11_votes(spark, d):
    """Votes of three methods: rank correlation with the outcome, mutual information, AUC by itself."""
    x = X.stored(labelled(spark, d), "voted-rows")
    values, y = X.long_form(x, EXACT, [*USED, *EXTRA]), x.select(*EXACT, "y")
    edge = X.single_feature_auc(values, y, EXACT).select("feature", F.round(F.abs(F.col("roc_auc") - 0.5), 9).alias("edge"))
    related = X.target_correlation(X.long_form(x, [*EXACT, "y"], [*USED, *EXTRA])).select("feature", F.round(F.abs("rho"), 9).alias("correlation"))
    informed = X.mutual_information(values, y, EXACT).select("feature", F.round("mi", 9).alias("mi"))
    found = X.votes(informed.join(related, "feature", "left").join(edge, "feature", "left"), METHODS)
    return found.select("feature", "votes", "selected", F.round("composite", 6).alias("composite"))


@query("x17_target_identity", S.statement(*BASE, "SELECT feature, 'y' AS target FROM (SELECT 'Ret_5' AS feature, bool_and(abs(Ret_5 - y) <= 1e-8 + 1e-5 * abs(y)) AS same FROM smp UNION ALL SELECT 'y_copy', bool_and(abs(y - y) <= 1e-8) FROM smp) WHERE same"))
def x17_target_identity(spark, d):
    return X.equal_to_targets(labelled(spark, d).withColumn("y_copy", F.col("y")), ["Ret_5", "y_copy"], ["y"])


def audit_sources(spark, d):
    from panelspark.plans.context import intraday

    context = {"market": T.market_series(spark, d), "vix": T.volatility_series(spark, d), "fx": T.fx_series(spark, d)}
    fixed = {n: X.stored(t, f"audit-{n}") for n, t in ({"bars": T.nation_bars(spark, d)} | context).items()}
    return fixed | intraday(spark, d)


def whole_frame(sources, by):
    from panelspark.operators import context as C

    fine = {p: sources[p] for p in ("5m", "1h")}
    return C.feature_frame(sources["bars"], sources["market"], sources["vix"], sources["fx"], fine, by)


def x18_sql() -> str:
    from panelspark.plans.context import FRAME, FRAME_SQL, LEVEL

    names = ", ".join(f"('{n}')" for n in [*LEVEL, *FRAME])
    cuts = "cuts AS (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM bars)) WHERE i IN (floor(n * 0.3::DOUBLE), floor(n * 0.6::DOUBLE), floor(n * 0.9::DOUBLE), n - 2))"
    counted = "held AS (SELECT d AS cutoff, count(*) AS n FROM frame SEMI JOIN cuts USING (d) GROUP BY 1)"
    return S.statement(*FRAME_SQL, cuts, counted, f"names(feature) AS (VALUES {names})", "SELECT cutoff, feature, n AS compared, 0::BIGINT AS differing, 0::BIGINT AS one_sided FROM held, names")


@query("x18_point_in_time", x18_sql())
def x18_point_in_time(spark, d):
    """Of every feature of the whole frame at every cutoff: the rows compared, and those that differ where every
    source ends there."""
    from panelspark.plans.context import FRAME, LEVEL

    return X.audit_counts(X.frame_comparison(whole_frame, audit_sources(spark, d), [*LEVEL, *FRAME]))


@query("x18_late_bar", S.statement(S.BARS, S.SESSION_BARS, """days AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM bars)),
    cuts AS (SELECT d FROM days WHERE i IN (floor(n * 0.3::DOUBLE), floor(n * 0.6::DOUBLE), floor(n * 0.9::DOUBLE), n - 2)),
    day AS (SELECT stock, session AS d, arg_max(c, start) AS x, arg_max(c, start) FILTER (WHERE start + INTERVAL 5 MINUTE <= session + INTERVAL 930 MINUTE) AS past FROM every5 GROUP BY ALL)""",
    "SELECT b.stock, b.d AS cutoff, 'last_close' AS feature, x AS full_value, past AS past_value FROM bars b JOIN cuts USING (d) JOIN day USING (stock, d) WHERE past IS NULL OR abs(x - past) > 1e-10 + 1e-7 * abs(past)"))
def x18_late_bar(spark, d):
    """A feature that takes the day's last bar, even one after the close, is found wherever there is such a bar."""
    def late(sources, by):
        last = sources["5m"].groupBy(*by, "stock", F.col("session").alias("d")).agg(F.max_by("c", "start").alias("last_close"))
        return sources["bars"].select(*by, "stock", "d").join(last, [*by, "stock", "d"], "left")

    sources = {"bars": T.nation_bars(spark, d), "5m": T.tick_bars(T.stock_ticks(spark, d), 5)}
    return X.frame_mismatches(late, sources, ["last_close"])


LEVELS = [f"{p}_{n}" for p, (a, b) in (("5m", (9, 21)), ("15m", (9, 21)), ("1h", (9, 21)), ("daily", (20, 50))) for n in ("MACD", "MACD_signal", "ATR", f"EMA_{a}", f"EMA_{b}")]


@query("x20_audit_report", S.statement(S.BARS, f"levels(feature) AS (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in LEVELS)}), days AS (SELECT count(DISTINCT d) AS n FROM bars)",
    "SELECT feature, 'price level that differs between stocks' AS reason FROM levels UNION ALL SELECT 'next_close', 'differs once later rows are cut off' FROM days WHERE n > 1"))
def x20_audit_report(spark, d):
    """What the audit keeps from every model: price levels, and a planted column that looks one row ahead."""
    def build(sources, by):
        return sources["bars"].withColumn("next_close", F.lead("c").over(W.over([*by, "stock"]))).withColumn("same_close", F.col("c"))

    found = X.frame_mismatches(build, {"bars": T.nation_bars(spark, d)}, ["next_close", "same_close"])
    return X.audit_report(found, LEVELS)


@query("x18_peeking_feature", S.statement(S.BARS, """n AS (SELECT stock, d, row_number() OVER (PARTITION BY stock ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY stock) AS n FROM bars)""",
    "SELECT stock, count(*) AS cutoffs FROM n WHERE i IN (floor(n * 0.3::DOUBLE), floor(n * 0.6::DOUBLE), floor(n * 0.9::DOUBLE), n - 2) GROUP BY 1"))
def x18_peeking_feature(spark, d):
    """A feature that looks one row ahead is found at every cutoff of every stock."""
    peek = lambda bars: bars.withColumn("peek", F.lead("c").over(W.over()))
    return X.point_in_time_mismatches(peek, T.nation_bars(spark, d), ["peek"]).groupBy("stock").agg(F.count(F.lit(1)).alias("cutoffs"))
