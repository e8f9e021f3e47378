"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

The features are hashed n-grams of 3 to 5 characters of the lower-cased text, present or
not. Each is scaled by the log ratio of its smoothed document counts in the two classes;
the ``FEATURES`` features with the most telling ratios stay, a document's row is brought to
unit length, and a logistic regression with an L2 penalty is fitted to the rows.

Training uses at most ``PER_CLASS`` labelled documents of each class, those with the least
hash of their id; the intercept is then moved to the classes' shares among all labels.
Scoring reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import held_out, map_batches, materialise, text_or_empty
from panelspark.llm.tokens import text_batches

PER_CLASS = 4_000
FEATURES = 20_000
ORDERS = (3, 4, 5)
BUCKET_BITS = 20
LEAST_DOCUMENTS = 3
PENALTY = 1e-5
_BLOCK = 500_000


def _runs(texts: list[str]):
    """The texts in lower case between blanks, in runs of about _BLOCK characters, with the index of each.

    A longer text is cut into several runs, which overlap so that no n-gram is lost.
    """
    parts, owners, size = [], [], 0
    for i, t in enumerate(texts):
        padded = f" {t.lower()} "
        for at in range(0, len(padded), _BLOCK):
            part = padded[at : at + _BLOCK + max(ORDERS) - 1]
            if parts and size + len(part) > _BLOCK:
                yield parts, owners
                parts, owners, size = [], [], 0
            parts.append(part)
            owners.append(i)
            size += len(part)
    if parts:
        yield parts, owners


def ngram_buckets(parts: list[str], owners: list[int]):
    """For each order: the hashed n-grams of all parts, and the text that each belongs to."""
    import numpy as np

    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    codes[(codes >= 9) & (codes <= 13)] = 32
    lengths = [len(t) for t in parts]
    part = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
    owner = np.array(owners, np.int32)[part]
    mixed = codes * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    for n in ORDERS:
        if len(codes) < n:
            continue
        end = len(codes) - n + 1
        h = np.full(end, n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ mixed[i : i + end]) * np.uint32(0x85EBCA77)
            h ^= h >> np.uint32(13)
        inside = part[:end] == part[n - 1 :]
        yield (h * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BUCKET_BITS))[inside].astype(np.int32), owner[:end][inside]


def _distinct(texts: list[str], among=None):
    """(text, bucket) of the distinct n-grams of every text; with ``among``, (text, slot) of those with a slot there."""
    import numpy as np

    found = np.zeros(0, np.int64)
    for parts, owners in _runs(texts):
        pairs = [found]
        for bucket, owner in ngram_buckets(parts, owners):
            if among is not None:
                bucket = among[bucket]
                owner, bucket = owner[bucket >= 0], bucket[bucket >= 0]
            pairs.append(owner.astype(np.int64) << BUCKET_BITS | bucket)
        found = np.unique(np.concatenate(pairs))
    return found >> BUCKET_BITS, (found & ((1 << BUCKET_BITS) - 1)).astype(np.int32)


@dataclass
class ToxicityModel:
    """Weights of the features that stayed, each already times its ratio."""

    buckets: object
    weights: object
    squares: object  # of the ratios, for the row's length
    intercept: float
    settings: dict = field(default_factory=dict)

    def scores(self, texts: list[str]):
        import numpy as np

        slot = self.__dict__.get("_slot")
        if slot is None:
            slot = self._slot = np.full(1 << BUCKET_BITS, -1, np.int32)
            slot[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        text, s = _distinct(texts, slot)
        total = np.bincount(text, self.weights[s], len(texts))
        length = np.sqrt(np.bincount(text, self.squares[s], len(texts)))
        z = total / np.maximum(length, 1e-9) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(rows, columns, values, labels, n_features: int, penalty: float = PENALTY, steps: int = 150):
    """Weights and intercept by accelerated gradient steps; rows of the matrix have length 1 at most."""
    import numpy as np

    n = len(labels)
    w, b = np.zeros(n_features), 0.0
    vw, vb, momentum = w, b, 1.0
    rate = 1 / (0.5 + penalty)  # the curvature of the mean loss is at most (1 + 1) / 4
    for _ in range(steps):
        z = np.bincount(rows, values * vw[columns], n) + vb
        error = (1 / (1 + np.exp(-z)) - labels) / n
        new_w = vw - rate * (np.bincount(columns, values * error[rows], n_features) + penalty * vw)
        new_b = vb - rate * error.sum()
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        pull = (momentum - 1) / following
        vw, vb = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b, momentum = new_w, new_b, following
    return w, b


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = PER_CLASS,
    features: int = FEATURES,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """A model from the labelled documents that aren't held out (crc32 of the id mod 5 is not 0).

    Its driver holds for each document of the sample the features that it has, four bytes each: at
    most 2 * ``per_class`` times ``features`` of them, 640 MB as a rule that no real text comes near.

    Of repeated labels of one id the largest counts; null labels and ids don't. With labels
    of one class only, or none, the model scores every text by the classes' shares.
    """
    import numpy as np

    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = materialise(known.where(~held_out(F.col("doc_id"))), "toxicity-labels")
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    shares = {c: shares.get(c, 0) for c in (0, 1)}
    settings = {"per_class": per_class, "features": features, "labelled": shares}
    base = float(np.log((shares[1] + 0.5) / (shares[0] + 0.5)))
    if not (shares[0] and shares[1]):
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0), np.zeros(0), base, settings)

    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # per_class rows of each class at most
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = materialise(texts.join(sample, "doc_id").select("doc_id", "label", "text"), "toxicity-sample")

    def count(batches):
        import pyarrow as pa

        found = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for _, kinds, contents in text_batches(batches, ["doc_id", "label", "text"], _BLOCK):
            text, bucket = _distinct(contents)
            for c in (0, 1):
                found[c] += np.bincount(bucket[np.array(kinds)[text] == c], minlength=1 << BUCKET_BITS)
        met = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(found[0][met]), pa.array(found[1][met])], names=["bucket", "n0", "n1"]
        )

    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not (n0 and n1):
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0), np.zeros(0), base, settings)
    counts = map_batches(rows, count, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = F.log((F.col("n1") + 1) / (n1 + 2)) - F.log((F.col("n0") + 1) / (n0 + 2))
    telling = F.abs(ratio) * F.sqrt(F.col("n0") + F.col("n1"))
    picked = (
        counts.where(F.col("n0") + F.col("n1") >= LEAST_DOCUMENTS)
        .select("bucket", ratio.alias("ratio"), telling.alias("telling"))
        .orderBy(F.desc("telling"), "bucket")
        .limit(features)
        .toPandas()
        .sort_values("bucket")
    )
    buckets, ratios = picked["bucket"].to_numpy(np.int32), picked["ratio"].to_numpy(float)

    def vectors(batches):
        import pyarrow as pa

        for _, kinds, contents in text_batches(batches, ["doc_id", "label", "text"], _BLOCK):
            text, bucket = _distinct(contents)
            at = np.searchsorted(buckets, bucket)
            at[at == len(buckets)] = 0
            met = buckets[at] == bucket
            places = np.searchsorted(text[met], np.arange(len(contents) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(at[met].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), lists], names=["label", "met"])

    if not len(buckets):
        return ToxicityModel(buckets, np.zeros(0), np.zeros(0), base, settings)
    data = map_batches(rows, vectors, "label int, met array<int>").toArrow()
    met = data["met"].combine_chunks()
    columns = met.flatten().to_numpy()
    lengths = np.diff(met.offsets.to_numpy())
    owner = np.repeat(np.arange(len(lengths)), lengths)
    norm = np.sqrt(np.bincount(owner, ratios[columns] ** 2, len(lengths)))
    values = ratios[columns] / np.maximum(norm, 1e-9)[owner]
    w, b = fit_logistic(owner, columns, values, data["label"].to_numpy(), len(buckets))
    return ToxicityModel(buckets, w * ratios, ratios**2, b + base - float(np.log(n1 / n0)), settings)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher: toxic is likelier), predicted (1 from 0.5 on).

    Only the text counts. A null or empty text gets the score of a text without features.
    Rows that repeat get equal scores; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for ids, texts in text_batches(batches, ["doc_id", "text"], _BLOCK):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(model.scores(texts), pa.float64())], names=["doc_id", "score"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    scored = map_batches(rows, run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input's rows and columns without the rows whose text scores ``threshold`` or more.

    A null text scores as an empty one, and stays null where it is kept. Rows that repeat stay or go together,
    null ids and other columns play no part, an empty table stays empty.
    """

    def run(batches):
        import pyarrow as pa

        from panelspark.llm.bytehash import byte_runs

        for batch in batches:
            for i, j in byte_runs(batch.column(text_col), _BLOCK):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(model.scores([t or "" for t in part.column(text_col).to_pylist()]) < threshold))

    return map_batches(docs, run, docs.schema)
