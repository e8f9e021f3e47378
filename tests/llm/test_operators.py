"""Each operator against a brute-force version on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, keep_id string, row long"  # clashing extra columns


def _texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, long = make(60), make(3000)
    texts = [make(r.randint(5, 120)) for _ in range(25)]
    texts += [texts[0]] * 4 + [texts[1] + " extra", texts[1].upper(), texts[2].replace(" ", "\n", 3)]
    texts += [make(20) + " " + passage + " " + make(20) for _ in range(4)] + [long, long + " tail", "x" * 700]
    return texts + ["", None, " \t\n", "one two", "one two", "héé ñandú " * 40, "Ünï " + passage + " ß<|endoftext|>漢字"]


@pytest.fixture(scope="module")
def rows():
    found = [(i * 7 - 20, t, "en", "k", 3) for i, t in enumerate(_texts())]
    return found + [(None, "no id " * 60, None, None, None), found[3], (found[4][0], "another text of this id", "en", None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    from panelspark.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter(
        (i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, *_ in rows
    )
    for share in (1000, 2):  # all digests salted, few salted
        got = exact_duplicates(docs, salts=3, hot_share=share).drop("keep_copies").collect()
        assert Counter(map(tuple, got)) == want
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter((i, t) for t, i in best.items())
    assert exact_duplicates(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0


def test_sharding(docs, rows, empty):
    from panelspark.llm.sharding import shard_by_bytes

    got = shard_by_bytes(docs, shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id for r in ordered]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    for s in range(4):
        assert [r.slot for r in ordered if r.shard == s] == list(range(sum(r.shard == s for r in got)))
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    assert all(abs(sum(r.size for r in got if r.shard == s) - total / 4) <= largest for s in range(4))
    assert shard_by_bytes(empty).count() == 0


def test_nearest_neighbours(spark, monkeypatch):
    from panelspark.llm import multi_index
    from panelspark.llm.multi_index import nearest_neighbours, walk

    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8)).astype("float32")
    v[50:90] = v[50]  # a group of equal vectors
    table = [(i, [float(x) for x in v[i]], 1) for i in range(400)]
    table += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [1.0, None] * 4, 1), (None, [1.0] * 8, 1), (1100, [1.0] * 3, 1)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, entry int")
    got = defaultdict(list)
    for r in nearest_neighbours(frame, every=10, centroids=8, share=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 10))
    wide = v.astype(float)
    for q, found in got.items():
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        assert [x[1] for x in found] == want and [x[0] for x in found] == list(range(1, 11))
        assert np.allclose([x[2] for x in found], d[want], rtol=1e-14, atol=0)
    few = spark.createDataFrame(table[:4], frame.schema)
    assert nearest_neighbours(few).count() == 3
    assert nearest_neighbours(frame.limit(0)).count() == 0

    monkeypatch.setattr(multi_index, "BLOCK", 16)  # groups of centroids, fuller ones in blocks, queries in blocks
    parts = {tuple(sorted((r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(frame, every=10, centroids=c, share=1.0).collect())) for c in (1, 3, 8, 64)}
    assert parts == {tuple((q, n, i) for q in sorted(got) for n, i, _ in got[q])}
    found = nearest_neighbours(frame, every=10).collect()
    right = {(q, i) for q in got for _, i, _ in got[q]}
    assert len(found) == len(right) and len({(r.query_id, r.vec_id) for r in found} & right) > 0.95 * len(right)

    twice = [(0, [0.0, 1.0]), (0, [0.0, 1.0]), (0, [9.0, 0.0]), (1, [0.0, 2.0]), (2, [9.0, 0.5]), (2, [0.0, 4.0]), (100, [0.0, 1.0])]
    twice = nearest_neighbours(spark.createDataFrame(twice, "vec_id long, embedding array<double>"), k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in twice] == [(0, 1, 100, 0.0), (0, 2, 2, 0.5), (100, 1, 0, 0.0), (100, 2, 1, 1.0)]

    a, b, counts = rng.random(5), rng.random(6), np.ones((5, 6), int)
    order = [a[i] + b[j] for i, j in walk(a, b, counts, 30)]
    assert len(order) == 30 and order == sorted(order)


def _shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def _components(items, words):
    parent = {i: i for i, _ in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, _shingles(t, words)) for i, t in items]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_near_dedup(docs, rows, empty):
    from panelspark.llm.near_dedup import drop_near_duplicates, near_duplicates

    component = _components([(i, t) for i, t, *_ in rows if i is not None], 4)
    want = Counter((i, len(_shingles(t, 4)), component.get(i), component.get(i) == i) for i, t, *_ in rows)
    assert Counter(map(tuple, near_duplicates(docs, words=4).collect())) == want
    kept = drop_near_duplicates(docs, words=4)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in rows if component.get(i) == i)
    assert near_duplicates(empty).count() == 0


def test_near_dedup_of_an_id_that_represents_nothing(spark):
    from panelspark.llm.near_dedup import near_duplicates

    x, y = "red green blue black white", "one two three four five six"
    rows = [(1, x), (5, x), (3, y), (5, y), (7, "other words that stand quite alone")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(1, 1), (5, 1), (3, 1), (5, 1), (7, 7)])


def test_near_dedup_of_a_large_group(spark):
    """Near copies that drift: every link is between neighbours, and some copies belong to none."""
    from panelspark.llm.near_dedup import near_duplicates

    r = random.Random(2)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        if i % 3 == 0:
            words[r.randrange(120)] = f"n{i}"
        copy = words[:]
        for _ in range(r.choice([0, 1, 2, 6])):
            copy[r.randrange(120)] = f"c{i}-{r.random()}"
        texts.append((i, " ".join(copy)))
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=4).collect()}
    assert got == _components(texts, 4)


def test_suffix_repeats(docs, rows, empty):
    from panelspark.llm import suffix_repeats as s

    for small in (64, 1):  # groups compared in one row, groups dealt out
        s.SMALL_GROUP, before = small, s.SMALL_GROUP
        try:
            _check_repeats(s, docs, rows)
        finally:
            s.SMALL_GROUP = before
    assert s.find_repeats(empty).count() == 0 and s.drop_repeats(empty).count() == 0


def _check_repeats(s, docs, rows, n=60):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[p : p + n] for _, b in data for p in range(len(b) - n + 1))
    want, texts = Counter(), Counter()
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int)]))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist()))
        want[i, len(b), spans, bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])] += 1
        texts[i, s.without(b, s.whole_characters(b, list(spans))).decode()] += 1
    got = s.find_repeats(docs, threshold=n).collect()
    assert Counter((r.doc_id, r.n_bytes, tuple((x.start, x.end) for x in r.spans), bytes(r.kept)) for r in got) == want
    cleaned = s.drop_repeats(docs, threshold=n)
    assert cleaned.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in cleaned.collect()) == texts


def test_long_texts_are_read_in_blocks():
    from panelspark.llm.suffix_repeats import find_anchors

    rng = np.random.default_rng(1)
    data = rng.integers(97, 105, 5000).astype(np.uint8)
    k, s, text, low, at, high = find_anchors(data, np.array([0, 3000]), np.array([3000, 5000]), 200, 64)
    assert (high - low).sum() + len(low) == 5000 - 2 * 199
    assert ((low <= at) & (at <= low + 136) & (at <= high + 136)).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders_equal_the_library(name):
    from tokenizers import Tokenizer

    from panelspark.llm.bpe import Vocabulary
    from panelspark.llm.tokens import Encoder, vocabulary_path

    r = random.Random(4)
    marks = " \t\n\r\x0b\x1c\x85\xa0 　aAbBzZéÉñßİΣσςДд漢字か̧́'´’sSlLrR0189½²,.;!?-_#@$%|<>😀​\xad"
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 30))) for _ in range(800)]
    texts += [t for t in _texts() if t] + ["a" * 3000, "x<|endoftext|>Y z", "Word, word. WORD Word"]
    path = vocabulary_path(name)
    library, own, cached = Tokenizer.from_file(path), Vocabulary(path), Encoder(path)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == want
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in cached.encode(texts)] == want
    assert [own.decode(np.array(x, "<u4").tobytes()) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_new_words_go_to_the_library_together(monkeypatch):
    from tokenizers import Tokenizer

    from panelspark.llm import tokens as t

    r = random.Random(6)
    path = t.vocabulary_path("byte_bpe_50k.json")
    library, cached = Tokenizer.from_file(path), t.Encoder(path)
    cached.spaced.most = 2000  # words met before are given up and met again
    monkeypatch.setattr(t, "RUN_PIECES", 1000)
    calls = Counter()

    class Counted:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            calls[name] += 1
            return getattr(self.of, name)

    cached.model, cached.tokenizer = Counted(cached.model), Counted(cached.tokenizer)
    letters = "abcdefghijklmnopqrstuvwxyzABCéñßÿªºİſſı"
    word = lambda: "".join(r.choice(letters) for _ in range(r.choice((1, 3, 8, 90))))
    plain = ["".join(word() + r.choice((" ", ", ", ". ", "\n", ".\n")) for _ in range(500)) + "end" for _ in range(10)]
    odd = ["),", "'s", "1a", "\x00", "\xffĀ", "a\tb", "x\x85y", "漢字", "ǆ", "é\u0301", "--", ".", ",", "don't", "a.,"]
    texts = [*plain, *plain[:3]]
    texts += ["".join(r.choice(odd + [word()]) + r.choice((" ", "\n", "  ", ", ")) for _ in range(40)) + r.choice(("z", "")) for _ in range(200)]
    texts += ["", " a", "\na", "\ta b", "\t\tb c", "\n", "a ", "a\x1c", "a\x1cb c", ",", ". .", "\n, a"]
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    got = [x for i in range(0, 10, 2) for x in cached.encode(plain[i : i + 2])]
    assert got == want[:10] and sum(calls.values()) < 100  # of over 2,000 new words
    for i in range(0, len(texts), 5):
        assert cached.encode(texts[i : i + 5]) == want[i : i + 5]


def test_bpe_query_rows(docs, rows, empty):
    from panelspark.llm.bpe import encode_and_decode, vocabulary
    from panelspark.llm.tokens import vocabulary_path

    model = vocabulary(vocabulary_path("word_bpe_49k.json"))
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in encode_and_decode(docs).collect())
    assert got == Counter((i, x := model.encode(t or ""), model.decode(x)) for i, t, *_ in rows)
    assert encode_and_decode(empty).count() == 0


def test_packing(docs, rows, empty):
    from panelspark.llm.packing import pack_documents, pack_histogram
    from panelspark.llm.tokens import encoder, vocabulary_path

    got = pack_documents(docs, capacity=128).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert sorted(sequences) == list(range(len(sequences)))
    want = Counter()
    model = encoder(vocabulary_path("word_bpe_49k.json"))
    for i, t, *_ in rows:
        ids = model.encode([t or ""])[0] + (1).to_bytes(4, "little")
        n = len(ids) // 4
        for at in range(0, n, 128):
            part = ids[4 * at : 4 * at + 512]
            want[i, at, len(part) // 4, zlib.crc32(part), n] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert pack_documents(empty).count() == 0
    patterns = pack_histogram({5: 3, 4: 2, 3: 7, 1: 1}, 8)
    assert sum(c * lengths.count(3) for c, lengths in patterns) == 7 and all(sum(x) <= 8 for _, x in patterns)


def test_token_shards(docs, rows, empty, spark):
    from panelspark.llm.sstable import lookup, read_shards, write_shards
    from panelspark.llm.tokens import encoder, vocabulary_path

    model = encoder(vocabulary_path("byte_bpe_50k.json"))
    manifest = write_shards(docs)
    got = sorted(read_shards(manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, model.encode([t or ""])[0] + b"\0\0\0\0") for i, t, *_ in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    keys = spark.createDataFrame([(rows[3][0],), (rows[4][0],), (10**9,), (None,)], "doc_id long")
    assert Counter(r.doc_id for r in lookup(manifest, keys).collect()) == Counter({rows[3][0]: 2, rows[4][0]: 2})
    assert read_shards(write_shards(empty)).count() == 0


def test_models_on_odd_tables(docs, rows, empty, spark):
    from panelspark.llm.rules import fit_rules, score_quality
    from panelspark.llm.toxicity import drop_toxic, fit_toxicity, score_toxicity

    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    odd = spark.createDataFrame([(i, n % 2, n % 3 > 0, None) for n, (i, *_) in enumerate(rows)] + [(None, 1, True, None)], "doc_id long, toxic int, q boolean, text string")
    odd = odd.selectExpr("doc_id", "toxic", "cast(q as int) quality", "text")
    for labels in (none, odd):
        toxic, quality = fit_toxicity(docs, labels), fit_rules(docs, labels)
        for scored in (score_toxicity(docs, toxic), score_quality(docs, quality)):
            got = scored.collect()
            assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
            assert all(0 <= r.score <= 1 for r in got)
        assert drop_toxic(docs, toxic).columns == docs.columns
        assert score_toxicity(empty, toxic).count() == 0 and score_quality(empty, quality).count() == 0
    assert fit_toxicity(empty, none).intercept == 0.0


def test_toxic_rows_leave_with_all_their_columns(spark, docs, rows, empty):
    from panelspark.llm.toxicity import drop_toxic, fit_toxicity, score_toxicity

    texts = [("bad " * 9 if i % 2 else "good " * 9, i % 2) for i in range(80)]
    learned = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    model = fit_toxicity(learned, spark.createDataFrame([(i, k) for i, (_, k) in enumerate(texts)], "doc_id long, toxic int"))
    odd = [*rows, (1, "bad " * 5, "x", None, 1), (1, "bad " * 5, "x", None, 1), (None, "so bad " * 5, None, None, None), (2, "good " * 5, "y", "k", 2), (2, "good " * 5, "y", "k", 2)]
    frame = spark.createDataFrame(odd, SCHEMA)
    score = {t or "": float(s) for t, s in zip([r[1] for r in odd], model.scores([r[1] or "" for r in odd]))}
    assert score["bad " * 5] >= 0.5 > score["good " * 5]
    assert Counter(map(tuple, drop_toxic(frame, model).collect())) == Counter(r for r in odd if score[r[1] or ""] < 0.5)
    assert drop_toxic(frame, model).columns == frame.columns and drop_toxic(empty, model).count() == 0
    assert score_toxicity(frame, model).count() == len(odd)


def test_near_dedup_of_an_empty_table_drops_nothing(empty):
    from panelspark.llm.near_dedup import drop_near_duplicates

    found = drop_near_duplicates(empty)
    assert found.count() == 0 and found.columns == empty.columns


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, copies, columns whose names clash; and no rows at all."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, rep long, keep_id long"
    r = random.Random(4)
    make = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, passage = make(80), make(90), make(60)
    near = " ".join(["other", *a.split()[1:]])
    texts = [(1, a), (2, a), (3, near), (4, None), (5, ""), (None, b), (7, b), (8, make(30) + " " + passage), (9, make(30) + " " + passage), (10, make(40)), (10, make(40))]
    documents = [(i, t, "en", None, None, 1, 2, 3) for i, t in texts]
    folder = str(tmp_path / "odd")
    spark.createDataFrame(documents, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pieces = corpus_pipeline.run(spark, folder).collect()
    # 1 and 2 are copies, 3 is near them, 4 and 5 are empty, 7 is a copy of the row without an id
    assert Counter(p.doc_id for p in pieces) == Counter([2, 5, 7, 8, 9, 10, 10])
    assert [p.length for p in pieces if p.doc_id == 5] == [1]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).columns == schema.replace(" long", "").replace(" string", "").split(", "), name
    nothing = str(tmp_path / "nothing")
    spark.createDataFrame([], schema).write.parquet(f"{nothing}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{nothing}/labels.parquet")
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_the_commonest_word_may_come_late():
    from panelspark.llm.rules import STATISTICS, statistics

    share = lambda text: statistics(text)[STATISTICS.index("top_word_share")]
    assert share("a b c d d d d e") == share("d d d d a b c e") == 0.5
    assert share(" \n") == share("") == 0.0
    for text in filter(None, _texts()):
        words = text.split()
        assert share(text) == max(map(words.count, words), default=0) / max(1, len(words))


@pytest.mark.parametrize("query, column, least", [("op1_toxicity", "toxic", 0.9), ("op8_quality_rules", "quality", 0.95)])
def test_held_out_accuracy(spark, query, column, least):
    from panelspark.llm.queries import QUERIES
    from panelspark.llm.shared import table

    folder = "/root/testdata/sf0.01"
    scored = QUERIES[query](spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out")
    hits = scored.selectExpr(f"avg(cast(predicted = {column} as double)) as share").first().share
    assert hits >= least


def test_pipeline_stages(spark):
    """Each stage against brute force on what the one before kept."""
    import math

    from tokenizers import Tokenizer

    import corpus_pipeline
    from panelspark.llm.shared import table
    from panelspark.llm.suffix_repeats import whole_characters, without
    from panelspark.llm.tokens import vocabulary_path
    from panelspark.llm.toxicity import fit_toxicity
    from test_models import _buckets

    folder = "/root/testdata/sf0.001"
    source = docs = table(spark, folder, "documents")
    model = fit_toxicity(docs, table(spark, folder, "labels"))
    weight, square = dict(zip(model.buckets.tolist(), model.weights)), dict(zip(model.buckets.tolist(), model.squares))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == source.columns, name
        before = {r.doc_id: r.text for r in docs.collect()}
        kept = {r.doc_id: r.text for r in after.collect()}
        if name == "toxicity":
            want = {}
            for i, t in before.items():
                met = _buckets(t) & weight.keys()
                z = sum(weight[b] for b in met) / max(1e-9, math.sqrt(sum(square[b] for b in met))) + model.intercept
                if z < 0:
                    want[i] = t
            assert kept == want and 0 < len(want) < len(before)
        if name == "exact_dedup":
            best = {t: i for i, t in sorted(before.items())}
            assert kept == {i: t for t, i in best.items()}
        if name == "near_dedup":
            component = _components(list(before.items()), 5)
            assert kept == {i: t for i, t in before.items() if component[i] == i}
        if name == "suffix_repeats":
            data = {i: t.encode() for i, t in before.items()}
            seen = Counter(hash(b[p : p + 200]) for b in data.values() for p in range(len(b) - 199))
            for i, b in data.items():
                gone = np.zeros(len(b) + 1, int)
                for p in range(len(b) - 199):
                    if seen[hash(b[p : p + 200])] > 1:
                        gone[p : p + 200] = 1
                edges = np.flatnonzero(np.diff(np.r_[0, gone]))
                spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
                assert kept[i] == without(b, whole_characters(b, spans)).decode()
            assert kept.keys() == before.keys()
        docs = after
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    want, room = Counter(), defaultdict(list)
    for i, t in kept.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            want[i, at, len(part) // 4, zlib.crc32(part), len(ids)] += 1
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces) == want
    for r in pieces:
        room[r.sequence_id].append((r.offset, r.length))
    for places in room.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op4_near_dedup", "op7_suffix_repeats", "op10_sharding", "op12_collocations"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from panelspark.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    got = QUERIES[name](spark, folder)
    found = con.execute(ORACLE_SQL[name])
    order = [[c[0] for c in found.description].index(n) for n in got.columns]
    assert Counter(tuple(r[i] for i in order) for r in found.fetchall()) == Counter(map(tuple, got.collect()))


def _thue_morse(length: int, letters: str = "ab") -> str:
    """Words on which sums of byte values times powers modulo 2**64 agree with those of the complement."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(length))


@pytest.mark.parametrize("length", [64, 256, 1024, 4096, 16384])
def test_words_of_regular_build_are_told_apart(spark, length):
    from panelspark.llm.bytehash import word_hashes
    from panelspark.llm.near_dedup import near_duplicates

    x, y = _thue_morse(length), _thue_morse(length, "ba")
    data = f"{x} {y} {x}".encode()
    found, _ = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert found[0] == found[2] != found[1]
    table = [(1, x), (2, y), (3, x.upper() + "\n"), (4, f"{x} {y} " * 4), (5, f"{y} {x} " * 4)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), words=4).collect()}
    assert got == _components(table, 4) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_contexts_of_regular_build_repeat_nothing(spark):
    from panelspark.llm import suffix_repeats as s

    x, y, middle = _thue_morse(128), _thue_morse(128, "ba"), "".join(chr(33 + (i * 37) % 90) for i in range(64))
    table = [(1, x + middle + y), (2, y + middle + x), (3, x + middle + x), (4, y + middle + y)]
    _check_repeats(s, spark.createDataFrame(table, "doc_id long, text string"), table, 200)


def test_contexts_that_leave_a_common_passage_anywhere(spark, monkeypatch):
    """Copies of one passage with a changed byte here and there, some alike: one group, met by its commonest context."""
    from panelspark.llm import suffix_repeats as s

    monkeypatch.setattr(s, "SMALL_GROUP", 3)
    r = random.Random(8)
    passage = [chr(97 + r.randrange(20)) for _ in range(260)]
    table = []
    for i in range(160):
        copy = passage[:]
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            copy[r.choice([5, 90, 91, 100, 180, r.randrange(260)])] = r.choice("XYZ")
        table.append((i, "".join(r.choice("mno") for _ in range(r.randrange(30))) + "".join(copy[: r.randrange(120, 261)]) + "".join(r.choice("mno") for _ in range(9))))
    _check_repeats(s, spark.createDataFrame(table, "doc_id long, text string"), table)


def test_word_polynomials_in_plain_python():
    from panelspark.llm import bytehash as b

    r = random.Random(3)
    words = [bytes(r.randrange(33, 255) for _ in range(n)) for n in (1, 2, 7, 4095, 4096, 4097, 9000, 20_000)]
    data = b"  ".join(words) + b"\n"
    values = np.frombuffer(data, np.uint8)
    found, count = b.word_hashes(values, np.array([0, len(data)]))
    inner, outer = (int(b.seeds(1, 77_000 + i)[0]) % b.PRIME for i in (3, 4))
    for w, h in zip(words, found, strict=True):
        total = sum((c + 1) * pow(inner, i % 4096, b.PRIME) * pow(outer, i // 4096, b.PRIME) for i, c in enumerate(w.lower())) % b.PRIME
        assert b.mix(np.array([total], np.uint64))[0] == h
    sequences = b.word_sequences(values, np.array([0, 2, 2, len(data)]))
    assert [bytes(s) for s in sequences] == [b" ".join(data[a:e].lower().split()) for a, e in ((0, 2), (2, 2), (2, len(data)))]
