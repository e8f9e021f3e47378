"""Languages, collocations and whitening against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

FOLDER = "/root/testdata/sf0.001"


# languages


def _held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_languages_of_held_out_documents(spark):
    from panelspark.llm.queries import QUERIES

    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op11_languages"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang) and all(r.held_out == _held_out(r.doc_id) for r in got)
    tested = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(tested) > 30 and np.mean(tested) >= 0.98 and all(0 <= r.score <= 1 for r in got)


def _plain_likelihoods(counts, languages, text):
    """Word by word: the product of the chances of each character after the two before it."""
    from panelspark.llm import languages as L

    def cells(word):
        return [int(c) for c in L.word_cells([word], [0])[0]]

    def chance(cell, lang):
        context = cell >> L.NEXT_BITS << L.NEXT_BITS
        near = range(context, context + (1 << L.NEXT_BITS))
        everything = sum(counts[x][c] for x in languages for c in near)
        pooled = (sum(counts[x][cell] for x in languages) + 0.1) / (everything + 0.1 * len(near))
        return (counts[lang][cell] + L.PRIOR * pooled) / (sum(counts[lang][c] for c in near) + L.PRIOR)

    words = re.findall(r"[^\W\d_]+", text.lower())
    return [[sum(math.log(chance(c, x)) for c in cells(w)) for x in languages] for w in words]


def test_language_shares_in_plain_python(spark):
    from panelspark.llm import languages as L

    texts = {"a": "the cat and the dog were here then there", "b": "der hund und die katze waren hier dann dort", "c": "el perro y el gato aqui estaban"}
    ids = [i for i in range(60) if not _held_out(i)]
    rows = [(i, texts["abc"[i % 3]] + " " + texts["abc"[i % 3]].split()[i % 5], "abc"[i % 3]) for i in ids]
    model = L.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["a", "b", "c"]
    counts = {x: Counter() for x in "abc"}
    for _, t, lang in rows:
        for w in t.split():
            counts[lang].update(int(c) for c in L.word_cells([w], [0])[0])
    mixed = "the dog was there then und der hund war dort und die katze war hier 123 the cat"
    want = np.array(_plain_likelihoods(counts, "abc", mixed))
    owner, got = model.words(["", mixed])
    assert set(owner) == {1} and np.allclose(got, want, atol=1e-4)

    shares = L.mixture_shares(np.zeros(len(want), int), want, 1, penalty=0.5)[0]
    p = np.exp(want - want.max(axis=1, keepdims=True))
    w = np.array([x if s else 0.0 for x, s in zip((0.5, 0.5, 0.5), shares > 0)])
    for _ in range(3000):
        w = ((p * w) / (p * w).sum(axis=1, keepdims=True)).mean(axis=0)
    assert (shares > 0).tolist() == [True, True, False] and np.allclose(w, shares, atol=5e-3)
    assert L.mixture_shares(np.zeros(len(want), int), want, 1, penalty=1e9)[0].tolist() == [1.0 if i == want.sum(axis=0).argmax() else 0.0 for i in range(3)]


def test_languages_on_odd_tables(spark):
    from panelspark.llm.languages import fit_languages, identify_languages

    schema = "doc_id long, text string, lang string, score string, languages int"  # clashing names
    known = [(i, ("the and of that " if i % 2 else "der die und das ") * 9, "en" if i % 2 else "de", None, 1) for i in range(40)]
    odd = [(None, "the and that", "en", None, 1), (1, None, "en", None, 1), (2, "", None, None, 1), (3, "123 ... \n", "de", None, 1), (4, "the and", None, None, 1), (4, "the and", None, None, 1), (5, "x" * 300_000 + " und", "de", None, 1)]
    docs = spark.createDataFrame(known + odd, schema)
    model = fit_languages(docs)
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in identify_languages(docs, model).where("doc_id is null or doc_id < 6").collect())
    assert got[None, "en", 1.0] == 1 and got[1, "und", 0.0] == got[2, "und", 0.0] == got[3, "und", 0.0] == 1 and got[4, "en", 1.0] == 2
    assert identify_languages(docs, model).count() == 47
    empty = spark.createDataFrame([], schema)
    nothing = fit_languages(empty)
    assert nothing.languages == [] and identify_languages(empty, model).count() == 0
    assert {(r.lang_pred, r.score) for r in identify_languages(docs, nothing).collect()} == {("und", 0.0)}


# collocations


def _plain_collocations(rows, least, top):
    f, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p))
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(scored)[:top])]
    return Counter(out)


@pytest.mark.parametrize("slice_bytes, shard, ranges, top", [(4_000_000, 300_000, 100_000, 2000), (300, 20, 15, 7)])
def test_collocations_equal_plain_python(spark, monkeypatch, slice_bytes, shard, ranges, top):
    """Also with texts in several slices, many shards and ranges."""
    from panelspark.llm import phrases as P

    monkeypatch.setattr(P, "_SLICE", slice_bytes)
    monkeypatch.setattr(P, "SHARD_WORDS", shard)
    monkeypatch.setattr(P, "UNITED", 2)
    r = random.Random(4)
    words = ["a", "A", "b", "the", "né", "x\x00y", "ß", "\x1f", "of-it", "漢", "“q”", "z"]
    rows = []
    for i in range(120):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "; "]) for _ in range(r.randrange(120)))
        rows.append((i % 50, text, r.choice(["en", "en", "en", None, "fr"]), "p", 1))
    rows += [(7, None, "en", None, None), (None, "the of-it " * 40, "en", None, None), (8, "", "de", None, None), (8, " .", "de", None, None), (9, "b the " * 400, "fr", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, n int").repartition(5)
    got = Counter(tuple(x) for x in P.collocations(docs, least=6, top=top, range_sequences=ranges).collect())
    want = _plain_collocations([(t, lang) for _, t, lang, *_ in rows], 6, top)
    assert got == want and len(want) > (20 if top < 2000 else 60)


def test_collocations_of_nothing(spark):
    from panelspark.llm.phrases import collocations

    empty = spark.createDataFrame([], "text string, lang string")
    few = spark.createDataFrame([("one two", "en"), (None, None)], "text string, lang string")
    assert collocations(empty).count() == 0 and collocations(few).count() == 0


def test_shards_stay_bounded_within_a_batch(monkeypatch):
    """A batch whose sequences all pass comes in many shards, none much larger than it may be, and loses nothing."""
    import pyarrow as pa

    from panelspark.llm import phrases as P
    from panelspark.llm.automata import Transducer

    class Passes:
        value = b"\xff" * (1 << 13)

    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") + str(r.randrange(60)) for _ in range(400)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "fr"] * 10), pa.array([t.encode() for t in texts], pa.binary())], names=["lang", "text"])
    want = Counter()
    for i, t in enumerate(texts):
        w = t.encode().split()
        want.update((b"fr" if i % 2 else b"en", *w[j : j + k]) for k in range(1, 6) for j in range(len(w) - k + 1))
    for most, words in ((1000, 300_000), (300_000, 100)):
        monkeypatch.setattr(P, "SHARD_SEQUENCES", most)
        monkeypatch.setattr(P, "SHARD_WORDS", words)
        monkeypatch.setattr(P, "ADDED_SEQUENCES", 500, raising=False)
        got, sizes = Counter(), []
        for shard in P._shards(16, [Passes, Passes])(iter([batch])):
            sizes += shard.column("keys").to_pylist()
            found = list(Transducer.from_bytes(shard.column("data")[0].as_py()).items())
            assert len(found) == sizes[-1] and found == sorted(found)
            got.update(dict(found))
        assert got == want and max(sizes) <= (1500 if most == 1000 else len(want)) and len(sizes) > 1


def test_buckets_are_counted_in_parts(monkeypatch):
    """Buckets that a task sends in several parts, with counts over a byte, pass where their sum is enough."""
    from panelspark.llm import phrases as P

    r = np.random.default_rng(3)
    buckets = (r.random(40_000) ** 4 * (1 << 18)).astype(np.uint32)
    rows = sorted(row for part in np.array_split(buckets, 7) for row in P._encoded(np.sort(part), 400))
    found = [(b.column("chunk")[0].as_py(), b.column("data")[0].as_py()) for b in P._add_chunks(400)(iter([P._chunk_rows([(None, None, *row)]) for row in rows]))]
    assert [c for c, _ in found] == sorted({c for c, _ in rows}) and len(found) > 1
    got = {(c << P.CHUNK_BITS) + i for c, bits in found for i in np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).tolist()}
    assert got == {b for b, n in Counter(buckets.tolist()).items() if n >= 400} and got


def test_transducers_are_minimal_and_exact():
    from panelspark.llm.automata import Transducer, union

    r = random.Random(2)
    parts = []
    for _ in range(6):
        keys = {tuple(r.choice([b"a", b"b", b"c", b"\xff"]) for _ in range(r.randrange(0, 5))) for _ in range(r.randrange(60))}
        parts.append({k: r.randrange(1, 50) for k in keys})
    total = Counter()
    for p in parts:
        total.update(p)
        built = Transducer.build(sorted(p.items()))
        again = Transducer.from_bytes(built.to_bytes())
        assert list(again.items()) == sorted(p.items())
        # no two states continue alike
        states = [(again.final[s], *[(again.label[a], again.weight[a], again.target[a]) for a in range(again.first[s], again.first[s + 1])]) for s in range(len(again.final))]
        assert len(set(states)) == len(states)
    whole = union([Transducer.build(sorted(p.items())) for p in parts])
    assert list(whole.items()) == sorted(total.items())
    assert list(union([Transducer.build(sorted(p.items())) for p in parts], 40).items()) == sorted((k, n) for k, n in total.items() if n >= 40)
    asked = sorted({tuple(r.choice([b"a", b"b", b"zz"]) for _ in range(r.randrange(0, 4))) for _ in range(80)})
    found = list(whole.compose(Transducer.build((k, 0) for k in asked)))
    assert found == [(k, total[k]) for k in asked if k in total]
    assert list(Transducer.build([]).items()) == [] and list(union([]).items()) == []


# whitening


def _plain_whitening(vectors, components=8):
    x = np.floor(1024 * vectors.astype(float)).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1][:, :components]
    return n, deviation, centred @ axes / np.sqrt(values[:components]), values / values.sum()


def test_whitening_equals_eigenvectors(spark):
    from panelspark.llm.whitening import whiten

    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    odd = [(9001, None), (9002, [1.0] * 63 + [None]), (9003, [float("nan")] * 64), (9004, [float("inf")] + [0.0] * 63), (9005, []), (9006, [1.0, 2.0])]
    rows = [(r.vec_id, r.embedding, 1.0) for r in table] + [(table[0].vec_id, table[0].embedding, 2.0), (None, table[1].embedding, 3.0)]
    docs = spark.createDataFrame(rows + [(i, v, None) for i, v in odd], "vec_id long, embedding array<float>, whitened double").repartition(7)
    got = whiten(docs).collect()
    vectors = np.array([v for _, v, _ in rows], np.float32)
    n, deviation, white, explained = _plain_whitening(vectors)
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    by = defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r)
    for c in range(8):
        signs = set()
        for (i, _, _), d, w in zip(rows, deviation, white):
            found = by[i, c + 1]
            assert all(f.deviation == d for f in found) and all(abs(f.explained / explained[c] - 1) < 1e-10 for f in found)
            assert all(abs(abs(f.whitened) - abs(w[c])) < 1e-7 for f in found)
            signs |= {f.whitened * w[c] > 0 for f in found if abs(w[c]) > 1e-3}
        assert len(signs) == 1


def test_whitening_of_equal_eigenvalues_and_of_no_variance(spark):
    from panelspark.llm.whitening import whiten

    d = 12
    rows = [(i, [2.0 * (j == i % d) * (1 if i < d else -1) for j in range(d)]) for i in range(2 * d)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 8 * len(rows) and got[0].identity_error < 1e-9 and all(abs(r.explained - 1 / d) < 1e-9 for r in got)
    flat = [(i, [1.0, float(i), float(2 * i), 5.0]) for i in range(9)]  # one direction varies
    got = whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and got[0].identity_error < 1e-9 and abs(got[0].explained - 1) < 1e-9
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert whiten(same).count() == 0 and whiten(empty).count() == 0
    large = [(i, [1e12 * i, -1e30, 0.5]) for i in range(4)]  # beyond 64 bits: no deviation
    got = whiten(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect()
    assert got and all(r.deviation is None for r in got)


@pytest.mark.parametrize("kind", ["plain", "graded", "split", "close", "zeros"])
def test_dqds_and_twisted_factors(kind):
    from panelspark.llm.whitening import bidiagonal, directions, dqds

    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 10, 33):
        a, b = rng.uniform(0.5, 2, d), rng.normal(size=d - 1)
        if kind == "graded":
            a, b = a * 10.0 ** -np.arange(d), b * 10.0 ** -np.arange(d - 1) * 0.1
        if kind == "split":
            b[::2] = 0
        if kind == "close":
            a[:], b[:] = 1, 1e-7
        if kind == "zeros":
            a[::3] = 0
        found = np.array(dqds(a.tolist(), b.tolist()))
        matrix = np.diag(a) + (np.diag(b, 1) if d > 1 else 0)
        want = np.linalg.svd(matrix, compute_uv=False) ** 2
        assert np.allclose(found, want, rtol=1e-12, atol=1e-13 * want[0])
        if kind == "graded":  # the least one is right to its own size: the determinant says so
            assert abs(np.log(found).sum() / 2 - np.log(np.abs(a)).sum()) < 1e-11
        full = np.triu(rng.normal(size=(d, d))) if kind == "plain" else matrix
        diagonal, above, w = bidiagonal(full)
        assert np.allclose(np.linalg.svd(np.diag(diagonal) + (np.diag(above, 1) if d > 1 else 0), compute_uv=False), np.linalg.svd(full, compute_uv=False))
        values, axes = directions(full)
        gram = full.T @ full
        assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-11)
        assert all(np.linalg.norm(gram @ z - v * z) < 1e-11 * values[0] for v, z in zip(values, axes.T))
