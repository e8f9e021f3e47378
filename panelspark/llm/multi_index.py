"""Nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised by codebooks of their own, so a cell of the index
is a pair of centroids. A query walks over the pairs by the sum of its two distances, least
first, with a heap (multi-sequence order), until the cells that it has met hold ``share`` of
all entries; every entry of those cells is reranked by its exact distance.

Codebooks grow with the square root of the entries, twice that between ``LEAST`` and ``MOST``
centroids, and are fitted to a sample that grows with them (``SAMPLE`` entries or
``A_CENTROID`` for each centroid); every vector is indexed. The share is measured on the whole
index: the true neighbours of ``PROBES`` entries among all entries are found by brute force in
one pass, and the share is the one at which walks of the probes reach ``RECALL`` of them. Recall
over few queries scatters more, so few ask for more of it, up to ``STRICT``.

Equal vectors are one entry that keeps its smallest ids, one more than are asked for, which
is all of it that a result can hold. Neighbouring centroids of the first half form groups of about
``BLOCK`` entries; a fuller centroid's are dealt to blocks. Groups and queries meet in blocks
of at most about ``BLOCK`` by ``BLOCK`` rows, so no cell, however full, ends up in one task,
and a side is copied once for each block of the other.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import join_to_one, map_batches, materialise, ship

LEAST, MOST = 128, 1024
SAMPLE, A_CENTROID = 20_000, 40
RECALL, STRICT = 0.95, 0.99
PROBES = 256
BLOCK = 16_384
QUERIES_A_TASK = 64


def fit_codebook(x, centroids: int, rounds: int = 12, seed: int = 7):
    """Lloyd's k-means; a centroid without members stays where it is."""
    import numpy as np

    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(centroids, len(x))]].copy()
    for _ in range(rounds):
        nearest = nearest_centroids(x, c)
        order = np.argsort(nearest, kind="stable")
        found, starts = np.unique(nearest[order], return_index=True)
        c[found] = np.add.reduceat(x[order], starts, axis=0) / np.diff(np.append(starts, len(x)))[:, None]
    return c


def squared_distances(x, c):
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


def nearest_centroids(x, c, rows: int = 4096):
    import numpy as np

    return np.concatenate([squared_distances(x[i : i + rows], c).argmin(1) for i in range(0, len(x), rows)])


def walk(first, second, counts, wanted: int) -> list[tuple[int, int]]:
    """Pairs of centroids by summed distance until their cells hold ``wanted`` entries; empty cells are left out.

    The heap holds the next cell of every row that is open, and the next row by its nearest corner,
    place -1, which opens before any cell of it is due.
    """
    import numpy as np

    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a], second[b]
    heap, rows, out = [(x[0] + y[0], 0, -1)], {}, []
    while heap and wanted > 0:
        _, i, j = heap[0]
        if j < 0:
            heapq.heappop(heap)
            held = counts[a[i], b]
            full = np.flatnonzero(held)
            if len(full):
                rows[i] = ((x[i] + y[full]).tolist(), [(int(a[i]), c) for c in b[full].tolist()], held[full].tolist())
                heapq.heappush(heap, (rows[i][0][0], i, 0))
            if i + 1 < len(x):
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, -1))
            continue
        sums, cells, held = rows[i]
        wanted -= held[j]
        out.append(cells[j])
        if j + 1 < len(sums):
            heapq.heapreplace(heap, (sums[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
    return out


def neighbours_of_probes(index: DataFrame, probes, names, k: int) -> DataFrame:
    """probe (place), c1, c2: the cells of the ``k`` nearest entries of each probe, itself left out, by brute force.

    A partition keeps the nearest that it has met, so it gives back k rows a probe whatever its size.
    """

    def nearest(batches):
        import numpy as np
        import pyarrow as pa

        held = [np.zeros((len(probes), 0), t) for t in (float, np.int64, np.int64)]
        for batch in batches:
            m, entry = _matrix(batch.column("v")), batch.column("entry").to_numpy()
            for i in range(0, len(m), 4096):
                part = slice(i, i + 4096)
                d = squared_distances(probes, m[part])
                d[names[:, None] == entry[part][None]] = np.inf
                new = [d, *(np.broadcast_to(batch.column(c).to_numpy()[part], d.shape) for c in ("c1", "c2"))]
                held = [np.concatenate(x, axis=1) for x in zip(held, new, strict=True)]
                if held[0].shape[1] > k:
                    keep = np.argpartition(held[0], k - 1, axis=1)[:, :k]
                    held = [np.take_along_axis(x, keep, axis=1) for x in held]
        probe = np.repeat(np.arange(len(probes)), held[0].shape[1])
        d, c1, c2 = (x.ravel() for x in held)
        there = np.isfinite(d)
        yield pa.RecordBatch.from_arrays([pa.array(x[there], t) for x, t in ((probe, pa.int32()), (d, pa.float64()), (c1, pa.int32()), (c2, pa.int32()))], names=["probe", "d", "c1", "c2"])

    found = map_batches(index, nearest, "probe int, d double, c1 int, c2 int")
    least = Window.partitionBy("probe").orderBy("d")
    return found.withColumn("turn", F.row_number().over(least)).where(F.col("turn") <= k).select("probe", "c1", "c2")


def needed_share(probes, books, half: int, counts, targets, recall: float) -> float:
    """The share of entries that walks from the probes must meet to reach ``recall`` of the targets (probe, c1, c2)."""
    import numpy as np

    cells: dict[int, list[tuple[int, int]]] = {}
    for q, i, j in targets:
        cells.setdefault(q, []).append((i, j))
    full = np.flatnonzero(counts.ravel())
    needed = []
    for q, found in cells.items():
        first, second = (squared_distances(x[None], c)[0] for x, c in ((probes[q, :half], books[0]), (probes[q, half:], books[1])))
        sums = (first[:, None] + second[None]).ravel()[full]
        order = np.argsort(sums)
        before = np.concatenate([[0], np.cumsum(counts.ravel()[full][order])])
        places = np.searchsorted(sums[order], [first[i] + second[j] for i, j in found])
        needed += list((before[places] + 1) / before[-1])
    return float(np.quantile(needed, recall)) if needed else 1.0


def _matrix(column):
    import numpy as np

    flat = column.flatten() if hasattr(column, "flatten") else column
    return np.asarray(flat, dtype=float).reshape(len(column), -1)


def nearest_neighbours(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    centroids: int | None = None,
    share: float | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Of each query, the rows whose id is divisible by ``every``, its ``k`` nearest others that
    the index finds: query_id, rank (from 1), vec_id, score (Euclidean distance in double).
    ``share`` of all entries is reranked for each query; None: as many as the probes ask for.
    ``centroids`` of each half; None: as many as the entries ask for.

    Ties go to the smaller id. Vectors that are null, zero, of another length than most,
    or hold null or non-finite components take no part, nor do rows with a null id; a row
    never finds its own id. Rows that repeat count once; an id with several vectors asks at all
    of them and is found at the nearest. If fewer than ``k`` others exist, all are returned. Other columns
    are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    length = (
        given.where("vec_id is not null and size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    )
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None or length["n"] < 2:
        return spark.createDataFrame([], schema)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = given.where(
        F.col("vec_id").isNotNull() & (F.size("v") == length["n"]) & finite & F.exists("v", lambda x: x != 0)
    )
    least = Window.partitionBy("v").orderBy("vec_id")
    some = valid.withColumn("turn", F.row_number().over(least)).where(F.col("turn") <= k + 1)
    distinct = some.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    entries = materialise(distinct.select("v", F.monotonically_increasing_id().alias("entry"), "ids"), "ann-entries")
    n_entries = entries.count()
    if not n_entries:
        return spark.createDataFrame([], schema)

    import numpy as np

    asked = valid.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    asked = materialise(join_to_one(asked, entries.select("v", "entry"), ["v"]).select("query_id", "entry").distinct(), "ann-queries")
    n_asked = asked.count()

    centroids = centroids or min(MOST, max(LEAST, int(np.ceil(2 * n_entries**0.5))))
    drawn = max(SAMPLE, A_CENTROID * centroids)
    sample = entries.orderBy(F.xxhash64("v"), "v").limit(drawn + PROBES).select("v", "entry").toArrow()
    half = length["n"] // 2
    x, names = _matrix(sample["v"].combine_chunks()), sample["entry"].to_numpy()
    books = [fit_codebook(x[:drawn, :half], centroids), fit_codebook(x[:drawn, half:], centroids)]
    width = len(books[1])

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v"))
                for i, (name, part) in enumerate((("c1", m[:, :half]), ("c2", m[:, half:]))):
                    batch = batch.append_column(name, pa.array(nearest_centroids(part, books[i]), pa.int32()))
                yield batch

    index = map_batches(entries, assign, "v array<double>, entry long, ids array<long>, c1 int, c2 int")
    index = materialise(index, "ann-index")

    counts = np.zeros((len(books[0]), width), np.int64)  # bounded by the codebooks
    for r in index.groupBy("c1", "c2").count().collect():
        counts[r["c1"], r["c2"]] = r["count"]
    if share is None:
        probes, its_names = x[-PROBES:], names[-PROBES:]  # past the sample where there are more entries
        targets = neighbours_of_probes(index, probes, its_names, k).collect()  # k rows a probe
        share = needed_share(probes, books, half, counts, targets, min(STRICT, RECALL + 0.5 / max(1, n_asked) ** 0.5))

    sizes = counts.sum(1)
    _, group_of = np.unique((np.cumsum(sizes) - sizes) // BLOCK, return_inverse=True)  # of each first centroid
    first_of = np.searchsorted(group_of, np.arange(group_of[-1] + 1))  # a group's first centroid
    spans = np.bincount(group_of) * width
    blocks = [max(1, -(-int(n) // BLOCK)) for n in np.bincount(group_of, weights=sizes)]
    of_centroid = lambda values: F.element_at(F.array(*[F.lit(int(n)) for n in values]), F.col("c1") + 1)
    block_count = F.element_at(F.array(*[F.lit(n) for n in blocks]), F.col("group") + 1)

    queries = index.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "v")
    n_queries = queries.count()
    query_blocks = max(1, -(-n_queries // BLOCK))
    wanted = max(k + 1, int(np.ceil(share * n_entries)))

    def plan(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("v"))
            first, second = squared_distances(m[:, :half], books[0]), squared_distances(m[:, half:], books[1])
            rows = []
            for q, v, a, b in zip(batch.column("entry").to_pylist(), batch.column("v").to_pylist(), first, second, strict=True):
                met = np.array(walk(a, b, counts, wanted))
                group = group_of[met[:, 0]]
                place = (met[:, 0] - first_of[group]) * width + met[:, 1]
                for g in np.unique(group):
                    bits = np.zeros(spans[g], np.uint8)
                    bits[place[group == g]] = 1
                    rows.append((q, v, int(g), np.packbits(bits).tobytes()))
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["entry", "v", "group", "cells"])

    key = ["group", "block", "query_block"]
    plans = map_batches(queries.repartition(max(1, -(-n_queries // QUERIES_A_TASK)), "entry"), plan, "entry long, v array<double>, group int, cells binary")
    left = plans.withColumn("block", F.explode(F.sequence(F.lit(0), block_count - 1))).withColumn(
        "query_block", F.pmod(F.xxhash64("entry"), F.lit(query_blocks)).cast("int")
    )
    grouped = index.withColumn("group", of_centroid(group_of)).withColumn("cell", ((F.col("c1") - of_centroid(first_of[group_of])) * width + F.col("c2")).cast("int"))
    right = grouped.drop("c1", "c2").withColumn("block", F.pmod(F.xxhash64("entry"), block_count).cast("int")).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )

    def rerank(asking, held):
        import pyarrow as pa

        out_q, out_id, out_d = [], [], []
        if asking.num_rows and held.num_rows:
            v = _matrix(held.column("v").combine_chunks())
            cell = held.column("cell").to_numpy()
            ids = held.column("ids").to_pylist()
            q = _matrix(asking.column("v").combine_chunks())
            for name, x, cells in zip(asking.column("entry").to_pylist(), q, asking.column("cells").to_pylist(), strict=True):
                met = np.flatnonzero(np.unpackbits(np.frombuffer(cells, np.uint8))[cell])
                if not len(met):
                    continue
                d = np.sqrt(((v[met] - x) ** 2).sum(1))
                if len(d) > k:
                    near = d <= np.partition(d, k)[k]
                    met, d = met[near], d[near]
                found = sorted((float(s), i) for s, e in zip(d, met, strict=True) for i in ids[e])[: k + 1]
                out_q += [name] * len(found)
                out_d += [s for s, _ in found]
                out_id += [i for _, i in found]
        return pa.table({"entry": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_d, pa.float64())})

    ship(spark)
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rerank, "entry long, vec_id long, score double")
    nearest = Window.partitionBy("entry").orderBy("score", "vec_id")
    best = met.withColumn("turn", F.row_number().over(nearest)).where(F.col("turn") <= k + 1)
    best = best.groupBy("entry").agg(F.collect_list(F.struct("score", "vec_id")).alias("found"))  # at most k + 1
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        join_to_one(asked, best, ["entry"])
        .select("query_id", F.inline("found"))
        .where("vec_id <> query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
