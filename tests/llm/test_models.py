"""The two classifiers against plain Python on a small table."""

import math
import random
import zlib

import numpy as np
import pytest

MASK = 0xFFFFFFFF


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(8)
    nice, nasty = ["garden", "river", "letter", "music", "bread", "summer"], ["vermin", "scum", "filth", "rotten", "hatred"]
    rows = []
    for i in range(240):
        bad = i % 3 == 0
        words = [r.choice(nasty if bad and r.random() < 0.3 else nice) for _ in range(r.randint(3, 30))]
        rows.append((i, " ".join(words) + ("!!! 777" if bad and i % 2 else "."), int(bad), int(not bad and len(words) > 8)))
    rows += [(500, "", 0, 0), (501, None, None, None), (502, "ÉTÉ\t\n x", None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int").repartition(3)


def _buckets(text):
    """The hashed n-grams of one text, character by character."""
    codes = [32 if 9 <= ord(c) <= 13 else ord(c) for c in f" {(text or '').lower()} "]
    found = set()
    for n in (3, 4, 5):
        for i in range(len(codes) - n + 1):
            h = n
            for c in codes[i : i + n]:
                m = c * 0x9E3779B1 & MASK
                h = (h ^ m ^ (m >> 15)) * 0x85EBCA77 & MASK
                h ^= h >> 13
            found.add((h * 0xC2B2AE3D & MASK) >> 12)
    return found


def test_toxicity_equals_plain_python(labelled):
    from panelspark.llm.toxicity import BUCKET_BITS, LEAST_DOCUMENTS, PENALTY, fit_toxicity, score_toxicity

    assert BUCKET_BITS == 20
    rows, docs = labelled
    model = fit_toxicity(docs, docs, features=300)
    train = [(_buckets(t), y) for i, t, y, _ in rows if y is not None and zlib.crc32(str(i).encode()) % 5]
    n = [sum(y == c for _, y in train) for c in (0, 1)]
    counts = {}
    for found, y in train:
        for b in found:
            counts.setdefault(b, [0, 0])[y] += 1
    ratio = {b: math.log((c[1] + 1) / (n[1] + 2)) - math.log((c[0] + 1) / (n[0] + 2)) for b, c in counts.items() if sum(c) >= LEAST_DOCUMENTS}
    order = sorted(ratio, key=lambda b: (-round(abs(ratio[b]) * math.sqrt(sum(counts[b])), 9), b))
    chosen = sorted(order[:300])
    assert len(set(chosen) ^ set(model.buckets.tolist())) <= 2  # of ties to the last digit either may stay
    weight = dict(zip(model.buckets.tolist(), model.weights))
    square = {b: ratio[b] ** 2 for b in weight}
    assert np.allclose(model.squares, [square[b] for b in weight])

    def z(text):
        met = _buckets(text) & weight.keys()
        return sum(weight[b] for b in met) / max(1e-9, math.sqrt(sum(square[b] for b in met))) + model.intercept

    for r in score_toxicity(docs, model).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z(text))), abs=1e-9) and r.predicted == (r.score >= 0.5)

    slope = dict.fromkeys(weight, 0.0)  # of the penalised loss at the fitted weights
    for found, y in train:
        met = found & weight.keys()
        length = max(1e-9, math.sqrt(sum(square[b] for b in met)))
        raw = sum(weight[b] for b in met) / length + model.intercept
        for b in met:
            slope[b] += (1 / (1 + math.exp(-raw)) - y) / len(train) * ratio[b] / length
    assert max(abs(s + PENALTY * weight[b] / ratio[b]) for b, s in slope.items() if ratio[b]) < 2e-3


def test_long_texts_lose_no_ngram(monkeypatch):
    from panelspark.llm import toxicity as t

    r = random.Random(3)
    texts = ["".join(r.choice("abcdé \n") for _ in range(n)) for n in (0, 1, 40, 400, 3, 90)]
    whole = [set(b) for b in map(_buckets, texts)]
    for block in (7, 50, 10_000):
        monkeypatch.setattr(t, "_BLOCK", block)
        text, bucket = t._distinct(texts)
        assert [set(bucket[text == i].tolist()) for i in range(len(texts))] == whole


def test_quality_rules_equal_plain_python(labelled):
    from panelspark.llm.rules import PENALTY, STATISTICS, fit_rules, score_quality, statistics

    rows, docs = labelled
    model = fit_rules(docs, docs)
    assert model.rules and all(r.weight for r in model.rules)

    def holds(rule, stats):
        return all(stats[c] <= bound if at_most else stats[c] > bound for c, at_most, bound in rule.conditions)

    of = {i: dict(zip(STATISTICS, statistics(t or ""))) for i, t, *_ in rows}
    z = {i: model.intercept + sum(r.weight for r in model.rules if holds(r, s)) for i, s in of.items()}
    for r in score_quality(docs, model).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-z[r.doc_id])), abs=1e-9) and r.predicted == (r.score >= 0.3)
    train = [(i, y) for i, _, _, y in rows if y is not None and zlib.crc32(str(i).encode()) % 5]
    errors = {i: (1 / (1 + math.exp(-z[i])) - y) / len(train) for i, y in train}
    assert abs(sum(errors.values())) < 1e-4
    for rule in model.rules:  # at the optimum of the lasso each weight's slope is minus the penalty
        slope = sum(e for i, e in errors.items() if holds(rule, of[i]))
        assert slope == pytest.approx(-math.copysign(PENALTY, rule.weight), abs=2e-4)


def test_paths_of_a_printed_tree_are_rules():
    from panelspark.llm.rules import tree_rules

    text = """Ensemble
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 1 <= 1.0)
      Predict: 0.0
     Else (feature 1 > 1.0)
      Predict: 1.0
    Else (feature 0 > 2.5)
     Predict: 1.0
"""
    assert {str(r) for r in tree_rules(text, ("a", "b"))} == {"a <= 2.5", "a > 2.5", "a <= 2.5 and b <= 1", "a <= 2.5 and b > 1"}


@pytest.mark.parametrize("text", ["", "One two two.\n\nThree!\nThree!\n", "ÀB cd 12 #@", "a" * 50])
def test_statistics_in_plain_python(text):
    from panelspark.llm.rules import STATISTICS, statistics

    got = dict(zip(STATISTICS, statistics(text)))
    data, words = text.encode(), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    assert got["log_bytes"] == pytest.approx(math.log1p(len(data))) and got["log_words"] == pytest.approx(math.log1p(len(words)))
    if text:
        share = [data.count(b) / len(data) for b in set(data)]
        assert got["byte_entropy"] == pytest.approx(-sum(p * math.log2(p) for p in share))
        assert got["beyond_ascii_share"] == pytest.approx(sum(b > 127 for b in data) / len(data))
        assert got["distinct_words"] == pytest.approx(len(set(words)) / max(1, len(words)))
        assert got["repeated_lines"] == pytest.approx(1 - len(set(lines)) / max(1, len(lines)) if lines else 0)
        assert got["ended_lines"] == pytest.approx(sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)))
