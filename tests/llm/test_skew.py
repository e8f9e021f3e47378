"""Hot keys, long texts, large groups: the branches that small tables don't take by themselves."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from test_operators import SCHEMA, _check_repeats, _components, _texts


@pytest.fixture()
def all_hot(monkeypatch):
    """Every key counts as hot that holds a thousandth of the rows."""
    from panelspark.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 0)


@pytest.fixture(scope="module")
def rows():
    found = [(i * 7 - 20, t, "en", "k", 3) for i, t in enumerate(_texts())]
    return found + [(None, "no id " * 60, None, None, None), found[3], (found[4][0], "another text of this id", "en", None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_to_one(spark, all_hot, how):
    from panelspark.llm.shared import join_to_one

    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2, 3, 4, 4, None])], "k long, i int")
    right = spark.createDataFrame([(1, "a"), (3, "b"), (9, "c")], "k long, v string")
    got, want = join_to_one(left, right, ["k"], how), left.join(right, ["k"], how)
    assert got.columns == want.columns and Counter(got.collect()) == Counter(want.collect())


def test_text_batches_keep_their_limit():
    from panelspark.llm.tokens import text_batches

    texts = ["a", "b" * 10] + ["c" * 1000] * 100 + ["d" * 5000, "", "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(text_batches([batch.slice(0, 0), batch.slice(1), batch.slice(0, 1)], ["doc_id", "text"], 3000))
    assert [t for _, part in parts for t in part] == texts[1:] + texts[:1]
    assert all(sum(map(len, part)) <= 3000 or len(part) == 1 for _, part in parts)


def test_a_very_long_text_and_many_long_ones(spark):
    """One text of 20 MB, and 100 of 200 kB side by side."""
    from panelspark.llm.near_dedup import near_duplicates
    from panelspark.llm.suffix_repeats import find_repeats
    from panelspark.llm.toxicity import fit_toxicity, score_toxicity

    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(30_000)]
    long = " ".join(r.choice(words) for _ in range(2_860_000))
    several = [" ".join(r.choice(words) for _ in range(28_000)) for _ in range(50)]
    table = [(0, long)] + [(i + 1, t) for i, t in enumerate(several * 2)]
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(1)
    got = {x.doc_id: x.component_id for x in near_duplicates(frame, words=4).collect()}
    assert got == {0: 0} | {i: (i - 1) % 50 + 1 for i in range(1, 101)}
    gone = {x.doc_id: x for x in find_repeats(frame).selectExpr("doc_id", "n_bytes", "spans").collect()}
    assert gone[0].spans == [] and all(gone[i].spans == [(0, gone[i].n_bytes)] for i in range(1, 101))
    labels = spark.createDataFrame([(i, i % 2) for i in range(101)], "doc_id long, toxic int")
    assert score_toxicity(frame, fit_toxicity(frame, labels)).count() == 101


def test_exact_dedup_of_hot_and_of_clashing_digests(spark, docs, rows, all_hot, monkeypatch):
    from pyspark.sql import functions as F

    from panelspark.llm import exact_dedup as e

    key = ["doc_id", "keep_id", "group_size", "kept", "keep_copies"]
    want = Counter(e.exact_duplicates(docs).select(key).collect())
    groups = Counter(t or "" for _, t, *_ in rows)
    best = {t: max((i for i, u, *_ in rows if (u or "") == t and i is not None), default=None) for t in groups}
    assert Counter(x[:4] for x in want.elements()) == Counter((i, best[t or ""], groups[t or ""], i == best[t or ""]) for i, t, *_ in rows)
    monkeypatch.setattr(e, "digest_of", lambda text: F.encode(F.substring(text, 1, 1), "utf-8"))
    monkeypatch.setattr(e, "second_hash_of", lambda text: F.lit(0).cast("long"))
    assert Counter(e.exact_duplicates(docs, salts=3).select(key).collect()) == want


def test_near_dedup_with_hot_keys(docs, rows, all_hot):
    from panelspark.llm.near_dedup import near_duplicates

    component = _components([(i, t) for i, t, *_ in rows if i is not None], 4)
    got = near_duplicates(docs, words=4).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, component.get(i)) for i, *_ in rows)


def test_near_dedup_of_300_drifting_copies(spark):
    """Copies of drifting texts with up to 14 edits, inserted and deleted words: many pairs lie around 0.8."""
    from panelspark.llm.near_dedup import near_duplicates

    r = random.Random(9)
    texts, number = [], 0
    for family in range(3):
        words = [f"f{family}w{i}" for i in range(110)]
        for i in range(100):
            if i % 9 == 0:
                words[r.randrange(110)] = f"drift{family}-{i}"
            copy = words[:]
            for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14])):
                at = r.randrange(len(copy))
                copy[at : at + r.choice([0, 1, 1, 1, 3])] = [f"own{number}-{r.random()}"] * r.choice([0, 1, 1])
            texts.append((number, " ".join(copy)))
            number += 1
    r.shuffle(texts)
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=4).collect()}
    want = _components(texts, 4)
    assert got == want and len(set(want.values())) > 20


def test_repeats_with_hot_keys(docs, rows, all_hot, monkeypatch):
    from panelspark.llm import suffix_repeats as s

    monkeypatch.setattr(s, "SMALL_GROUP", 2)
    _check_repeats(s, docs, rows)


def test_fill_of_packs():
    from panelspark.llm.packing import pack_histogram

    def fill(counts, capacity=2048):
        patterns = pack_histogram(counts, capacity)
        for length, n in counts.items():
            assert sum(packs * lengths.count(length) for packs, lengths in patterns) == n
        assert all(0 < sum(lengths) <= capacity for _, lengths in patterns)
        return sum(length * n for length, n in counts.items()) / capacity / sum(n for n, _ in patterns)

    for length in (1, 2, 8, 13, 30, 64, 99, 128, 204, 256, 341, 512, 682, 1024, 2048):
        assert fill({length: 50_000}) > 0.95
    assert fill({9: 2000, 11: 300, 12: 40}) > 0.95  # short texts alone
    assert fill({1030: 500, 30: 20_000}) > 0.95
    assert fill({n: 1 + n % 7 for n in range(1, 2049)}) > 0.95
    assert pack_histogram({}, 2048) == []


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_with_default_settings(spark, folder):
    from panelspark.llm.queries import QUERIES
    from panelspark.llm.shared import table

    vectors = {
        r.vec_id: np.array(r.embedding, float)
        for r in table(spark, f"/root/testdata/{folder}", "embeddings").collect()
        if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)
    }
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    found = {}
    for r in QUERIES["op3_multi_index"](spark, f"/root/testdata/{folder}").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((x - vectors[q]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits += len(set(got) & set(want))
    assert sorted(found) == [i for i in ids.tolist() if i % 100 == 0] and hits >= 0.9 * 10 * len(found)


def test_lookup_over_several_blocks(spark, monkeypatch, tmp_path):
    from panelspark.llm import sstable as t

    monkeypatch.setattr(t, "BLOCK_BYTES", 64)
    path = str(tmp_path / "shard.sst")
    with open(path, "wb") as f:
        writer = t.Writer(f)
        entries = [(i // 2 * 3 - 50, np.arange(i % 9, dtype="<u4").tobytes()) for i in range(200)]  # each id twice
        for i, ids in entries:
            writer.add(t.key_of(i), ids)
        writer.close()
    reader = t.Reader(path)
    assert len(reader.blocks) > 20 and [(t.id_of(k), v) for k, v in reader] == entries
    for i in range(-60, 260):
        assert reader.get(i) == [v for k, v in entries if k == i]
