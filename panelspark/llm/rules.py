"""Quality by a sparse ensemble of rules over statistics of the text.

Trees grown on the statistics give rules: the conjunction of conditions on each path from
the root to a node. A logistic regression with an L1 penalty weighs them, most with
nothing; those that stay become one Spark column expression over the statistics.

Training uses at most ``SAMPLE`` labelled documents, those with the least hash of their id.
Statistics are of whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import held_out, map_batches, materialise, text_or_empty
from panelspark.llm.tokens import text_batches

SAMPLE = 20_000
TREES, DEPTH = 20, 4
PENALTY = 0.002

STATISTICS = (
    "log_bytes",
    "log_words",
    "mean_word",
    "upper_share",
    "digit_share",
    "mark_share",
    "symbol_share",
    "beyond_ascii_share",
    "distinct_words",
    "top_word_share",
    "marks_per_word",
    "short_words",
    "lines_per_word",
    "repeated_lines",
    "ended_lines",
    "mean_line",
    "byte_entropy",
    "repeated_pairs",
)


def statistics(text: str) -> tuple[float, ...]:
    """The values of STATISTICS; of an empty text all are 0."""
    import numpy as np

    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return (0.0,) * len(STATISTICS)
    counts = np.bincount(data, minlength=256)
    words = text.split()
    n_words = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    ended = sum(1 for x in lines if x.rstrip()[-1] in ".!?")
    letters = counts[65:91].sum() + counts[97:123].sum()
    upper, digits = counts[65:91].sum(), counts[48:58].sum()
    marks = sum(int(counts[ord(c)]) for c in ".,;:!?'\"-()")
    printable = counts[33:127].sum()
    symbols = printable - letters - digits - marks
    distinct = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    share = counts[counts > 0] / n
    top = max(distinct.values()) / n_words if words else 0.0
    lengths = sum(map(len, words))
    return tuple(
        float(x)
        for x in (
            np.log1p(n),
            np.log1p(len(words)),
            lengths / n_words,
            upper / max(1, letters),
            digits / n,
            marks / n,
            symbols / n,
            counts[128:].sum() / n,
            len(distinct) / n_words,
            top,
            (marks + symbols) / n_words,
            sum(1 for w in words if len(w) < 3) / n_words,
            len(lines) / n_words,
            1 - len(set(lines)) / n_lines if lines else 0.0,
            ended / n_lines,
            n / n_lines,
            -(share * np.log2(share)).sum(),
            1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        )
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the named extra long columns, and the statistics of each row's whole text."""

    def run(batches):
        import pyarrow as pa

        for *kept, texts in text_batches(batches, ["doc_id", *extra, "text"]):
            values = [*zip(*map(statistics, texts))] or [[]] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(k, pa.int64()) for k in kept), *(pa.array(v, pa.float64()) for v in values)],
                names=["doc_id", *extra, *STATISTICS],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *extra, text_or_empty(text_col).alias("text"))
    kinds = [f"{c} long" for c in ("doc_id", *extra)] + [f"{c} double" for c in STATISTICS]
    return map_batches(rows, run, ", ".join(kinds))


Condition = tuple[str, bool, float]  # statistic, whether at most, bound


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, bound in self.conditions:
            out = out & (F.col(name) <= bound if at_most else F.col(name) > bound)
        return out

    def holds(self, values: dict):
        """The same of arrays of the statistics."""
        import numpy as np

        out = np.True_
        for name, at_most, bound in self.conditions:
            out = out & (values[name] <= bound if at_most else values[name] > bound)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if a else '>'} {b:.4g}" for n, a, b in self.conditions)


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    intercept: float

    def column(self) -> Column:
        """The score over the columns of STATISTICS."""
        z = F.lit(self.intercept)
        for r in self.rules:
            z = z + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


_NODE = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)$")


def tree_rules(description: str, names: tuple[str, ...]) -> list[Rule]:
    """Each path from a root to a node, from the printed form of an ensemble of trees."""
    found: dict[tuple[Condition, ...], Rule] = {}
    path: list[tuple[int, Condition]] = []
    for line in description.splitlines():
        if m := _NODE.match(line):
            depth = len(m[1])
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (names[int(m[3])], m[4] == "<=", float(m[5]))))
            tightest: dict[tuple[str, bool], float] = {}
            for _, (name, at_most, bound) in path:
                key = (name, at_most)
                tightest[key] = (min if at_most else max)(tightest.get(key, bound), bound)
            conditions = tuple(sorted((n, a, b) for (n, a), b in tightest.items()))
            found.setdefault(conditions, Rule(conditions))
        elif line.strip().startswith("Tree"):
            path = []
    return list(found.values())


def fit_lasso(x, y, penalty: float, steps: int = 3000, tolerance: float = 2e-5):
    """Weights and intercept of least mean logistic loss plus ``penalty`` times the sum of absolute weights.

    Accelerated proximal steps, started anew where they overshoot, until no derivative is off by
    more than ``tolerance``.
    """
    import numpy as np

    n, m = x.shape
    v = np.ones(m + 1)
    for _ in range(30):  # the largest curvature, by power iteration
        u = x @ v[:m].astype(x.dtype) + v[m]
        v = np.append(u @ x, u.sum())
        v /= (top := np.linalg.norm(v))
    rate = 1 / (0.26 * top / n)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    vw, vb, momentum = w, b, 1.0
    for step in range(steps):
        error = ((1 / (1 + np.exp(-(x @ vw.astype(x.dtype) + vb)))) - y) / n
        slope, lift = error.astype(x.dtype) @ x, error.sum()
        moved = vw - rate * slope
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        new_b = vb - rate * lift
        if ((vw - new_w) * (new_w - w)).sum() + (vb - new_b) * (new_b - b) > 0:
            momentum = 1.0
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        pull = (momentum - 1) / following
        vw, vb = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        off = max(np.abs(new_w - w).max(initial=0), abs(new_b - b)) / rate
        w, b, momentum = new_w, new_b, following
        if step > 10 and off < tolerance:
            break
    return w, b


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> RuleModel:
    """A model from the labelled documents that aren't held out (crc32 of the id mod 5 is not 0).

    Of repeated labels of one id the largest counts; null labels and ids don't. With labels
    of one class only, or none, the model has no rule and scores by the classes' shares.
    """
    import math

    import numpy as np
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("long").alias("label"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    # a few MB at most, which many rounds of fitting read: a few partitions
    data = materialise(with_statistics(rows, "doc_id", "text", ("label",)), "quality-sample").coalesce(4)
    shares = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    if not (n0 and n1):
        return RuleModel((), math.log((n1 + 0.5) / (n0 + 0.5)))

    as_vector = array_to_vector(F.array(*STATISTICS)).alias("features")
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=11, minInstancesPerNode=5, featureSubsetStrategy="onethird", cacheNodeIds=False
    )
    grown = forest.fit(data.select(F.col("label").cast("double").alias("label"), as_vector))
    rules = tree_rules(grown.toDebugString, STATISTICS)
    if not rules:
        return RuleModel((), math.log(n1 / n0))
    rows = data.select(*STATISTICS, "label").toArrow()  # the bounded sample: 8 * 19 * ``sample`` bytes at most
    values = {c: rows[c].to_numpy() for c in STATISTICS}
    held = np.empty((len(rows), len(rules)), np.float32)
    for i, r in enumerate(rules):
        held[:, i] = r.holds(values)
    weights, intercept = fit_lasso(held, rows["label"].to_numpy().astype(float), PENALTY)
    weighed = tuple(Rule(r.conditions, float(w)) for r, w in zip(rules, weights, strict=True) if w)
    return RuleModel(weighed, float(intercept))


def score_quality(
    docs: DataFrame, model: RuleModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher: good quality is likelier), predicted.

    Only the text counts. A null or empty text has all statistics 0 and is scored by them.
    Rows that repeat get equal scores; other columns are ignored.
    """
    scored = with_statistics(docs, id_col, text_col).select("doc_id", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
