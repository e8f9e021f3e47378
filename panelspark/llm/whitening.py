"""Embedding whitening: blockwise QR, bidiagonal form, dqds, twisted factorisations.

Entries become integers, so counts and sums are exact. Every task reduces its centred rows
to one triangle by QR, block by block; triangles are reduced together, ``FAN`` at a time,
until one is left: R'R is n times the covariance, which itself is never formed. The triangle
is as large as the vectors are long and is worked on in the driver: Householder reflections
make it bidiagonal, R = U B W'; differential quotient-difference steps with shifts (dqds) find
the squares of B's singular values to high relative accuracy; for each of the largest ones
a twisted factorisation of B'B - lambda gives the eigenvector, inverse iteration with the same
factorisation those of eigenvalues that lie close together. W carries them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import map_batches, materialise

COMPONENTS = 8
FAN = 32
SCALE, SHIFT = 1024, 100_000  # of the integers
LARGEST = 1 << 52  # integers beyond this size are held to it
CLOSE = 1e-3  # relative distance within which eigenvalues share a cluster
BLOCK_ENTRIES = 1 << 20
EPS = 2.0**-52


def bidiagonal(triangle):
    """(diagonal, superdiagonal, W) of B with A = U B W', by Householder reflections."""
    import numpy as np

    a = np.array(triangle, float)
    d = len(a)
    w = np.eye(d)

    def reflector(x):
        size = np.linalg.norm(x)
        if size == 0:
            return None
        v = x.copy()
        v[0] += size if x[0] >= 0 else -size
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v = reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), w


def _step(q: list[float], e: list[float], shift: float):
    """One dqds transform: (q, e, least pivot), the least pivot negative where the shift is too large."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for k in range(n - 1):
        new_q[k] = d + e[k]
        if d < 0 or new_q[k] <= 0:
            if d >= 0:  # nothing left of this row: it decouples
                new_e[k], d = 0.0, q[k + 1] - shift
                least = min(least, d)
                continue
            return new_q, new_e, min(least, d)
        t = q[k + 1] / new_q[k]
        new_e[k] = e[k] * t
        d = d * t - shift
        least = min(least, d)
    new_q[n - 1] = d
    return new_q, new_e, least


def dqds(diagonal, superdiagonal) -> list[float]:
    """Squares of the singular values of an upper bidiagonal matrix, largest first."""
    size = max([abs(x) for x in (*diagonal, *superdiagonal)], default=0.0)
    if size == 0:
        return [0.0] * len(diagonal)
    tolerance = (16 * EPS) ** 2
    found: list[float] = []
    open_ = [([(x / size) ** 2 for x in diagonal], [(x / size) ** 2 for x in superdiagonal], 0.0)]
    while open_:
        q, e, shifted = open_.pop()
        for _ in range(400):
            n = len(q)
            if n == 1:
                found.append(shifted + q[0])
                break
            cut = next((k for k in range(n - 1) if e[k] <= tolerance * (shifted + min(q[k], q[k + 1])) or e[k] < 1e-300), None)
            if cut is not None:
                open_ += [(q[: cut + 1], e[:cut], shifted), (q[cut + 1 :], e[cut + 1 :], shifted)]
                break
            if n == 2:
                total = q[0] + e[0] + q[1]
                large = (total + ((q[0] - q[1]) ** 2 + e[0] * (e[0] + 2 * (q[0] + q[1]))) ** 0.5) / 2
                found += [shifted + large, shifted + q[0] / large * q[1]]
                break
            if q[0] < q[-1]:
                q, e = q[::-1], e[::-1]  # the small ones last
            # the smaller eigenvalue of the last two rows is never below the least of all
            total, product = q[-2] + e[-1] + q[-1], q[-2] * q[-1]
            large = (total + max(0.0, total * total - 4 * product) ** 0.5) / 2
            guess = product / large if large else 0.0
            for attempt in range(5):
                after = _step(q, e, guess)
                if after[2] >= 0:
                    break
                lower = guess + after[2] * (1 + 2 * EPS)  # a negative last pivot says how far too large
                guess = lower if attempt == 0 and lower > 0 else guess / 4 if attempt < 3 else 0.0
            else:
                after = _step(q, e, guess := 0.0)
            q, e, shifted = after[0], after[1], shifted + guess
        else:
            raise ArithmeticError("the singular values don't settle")
    return sorted((x * size * size for x in found), reverse=True)


class Twisted:
    """Factors of B'B - value from both ends, meeting at the row where what is left is least."""

    def __init__(self, diagonal, superdiagonal, value: float):
        n = len(diagonal)
        scale = max([abs(x) for x in (*diagonal, *superdiagonal)])
        least = (EPS * scale) ** 2
        d = [max(x * x, least * EPS) for x in diagonal]
        low = [b * (1 if a >= 0 else -1) / max(abs(a), EPS**1.5 * scale) for a, b in zip(diagonal, superdiagonal)]  # noqa: B905
        safe = lambda x: x if abs(x) > least else least
        self.down, self.up = [0.0] * (n - 1), [0.0] * (n - 1)  # multipliers
        self.above, self.below = [0.0] * n, [0.0] * n  # pivots from the first row, from the last
        s, shares = -value, []
        for i in range(n):
            shares.append(s)
            self.above[i] = safe(s + d[i])
            if i < n - 1:
                self.down[i] = d[i] * low[i] / self.above[i]
                s = self.down[i] * low[i] * s - value
        p = d[n - 1] - value
        gamma = [0.0] * n
        self.below[n - 1] = safe(p)
        gamma[n - 1] = shares[n - 1] + d[n - 1]
        for i in range(n - 2, -1, -1):
            pivot = safe(d[i] * low[i] ** 2 + p)
            self.below[i + 1] = pivot
            t = d[i] / pivot
            self.up[i] = low[i] * t
            p = p * t - value
            gamma[i] = shares[i] + p + value
        self.below[0] = safe(p)
        self.at = min(range(n), key=lambda i: abs(gamma[i]))
        self.left = safe(gamma[self.at])

    def vector(self):
        """The solution for a right side that is ``left`` at the twist and nothing else."""
        import numpy as np

        z = np.zeros(len(self.above))
        z[self.at] = 1.0
        for i in range(self.at - 1, -1, -1):
            z[i] = -self.down[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] = -self.up[i] * z[i]
        return z / np.linalg.norm(z)

    def solve(self, x):
        import numpy as np

        x = np.array(x, float)
        n, r = len(x), self.at
        for i in range(r):
            x[i + 1] -= self.down[i] * x[i]
        for i in range(n - 2, r - 1, -1):
            x[i] -= self.up[i] * x[i + 1]
        x[:r] /= self.above[:r]
        x[r + 1 :] /= self.below[r + 1 :]
        x[r] /= self.left
        for i in range(r - 1, -1, -1):
            x[i] -= self.down[i] * x[i + 1]
        for i in range(r, n - 1):
            x[i + 1] -= self.up[i] * x[i]
        return x / np.linalg.norm(x)


def directions(triangle, most: int = COMPONENTS):
    """(eigenvalues of R'R, largest first; their first ``most`` unit eigenvectors as columns).

    Eigenvectors of numerically nothing are left out.
    """
    import numpy as np

    diagonal, superdiagonal, w = bidiagonal(triangle)
    values = dqds(diagonal.tolist(), superdiagonal.tolist())
    floor = values[0] * (8 * len(values) * EPS) ** 2 if values else 0.0
    chosen: list = []
    for i, value in enumerate(values[:most]):
        if value <= floor or value == 0:
            break
        cluster = [chosen[j] for j in range(i) if values[j] - value <= CLOSE * values[j]]
        factors = Twisted(diagonal.tolist(), superdiagonal.tolist(), value)

        def apart(x, cluster=cluster):
            for _ in range(2):
                for v in cluster:
                    x = x - (v @ x) * v
            return x, np.linalg.norm(x)

        z = factors.vector()
        if cluster:
            z, size = apart(z)
            if size < 0.5:
                z, size = apart(np.cos(np.arange(1, len(z) + 1) ** 2 * (1.0 + i)))
            for _ in range(4):
                z, size = apart(factors.solve(z / size))
            z = z / size
        chosen.append(z)
    vectors = w @ np.array(chosen).T if chosen else np.zeros((len(w), 0))
    for v in vectors.T:  # one of the two signs
        v *= 1 if v[np.argmax(np.abs(v))] > 0 else -1
    return values, vectors


def _integers(column):
    """Rows of whole numbers floor(SCALE * entry) + SHIFT from a list column without nulls."""
    import numpy as np

    entries = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(float)) + SHIFT
    return np.clip(entries, -LARGEST, LARGEST).astype(np.int64).reshape(len(column), -1)


def _blocks(batches):
    for batch in batches:
        if batch.num_rows:
            width = max(1, len(batch.column("vector")[0]))
            rows = max(width, BLOCK_ENTRIES // width)
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)


def _deviations(x, n: int, sums: list[int]):
    """n * x - sums, exactly: 64-bit integers where all fit, Python's otherwise."""
    import numpy as np

    if n * int(np.abs(x).max(initial=0)) < 1 << 61 and max(map(abs, sums), default=0) < 1 << 61:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(y) -> list[int | None]:
    """Exact sums of squares of each row; None where 64 bits don't hold one."""
    import numpy as np

    if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    found = (y.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in found]


def _triangle(stack):
    import numpy as np

    r = np.linalg.qr(stack, mode="r")
    return np.vstack([r, np.zeros((stack.shape[1] - len(r), stack.shape[1]))]) if len(r) < stack.shape[1] else r


def _reduce_triangles(triangles: DataFrame, width: int) -> DataFrame:
    """One triangle of several, a task reads ``FAN`` of them or so."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for batch in batches:
            for x in batch.column("triangle"):
                r = np.array(x.values).reshape(width, width)
                held = r if held is None else _triangle(np.vstack([held, r]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.ravel()], pa.list_(pa.float64()))], names=["triangle"])

    while (count := triangles.count()) > 1:
        tasks = -(-count // FAN)
        triangles = materialise(map_batches(triangles.repartition(tasks), run, "triangle array<double>"), "whitening-triangles")
    return triangles


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector that takes part and each component: vec_id, component (from 1, by falling
    eigenvalue), n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, or hold null or non-finite entries, take no part, nor do those of
    another length than the commonest (of equally common ones the longest). An entry c counts
    as floor(1024 c) + 100000 (held to 2**52 in size). ``deviation`` is the exact sum of squares of
    n * x - S over the dimensions, null where 64 bits don't hold it. Components without
    variance can't be whitened and have no rows, so equal vectors alone give an empty result,
    as does an empty table. Rows that repeat and rows with a null id count like any other;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    entries = F.col(vector_col).cast("array<double>")
    unfit = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), entries.alias("vector"), unfit.alias("unfit"))
    rows = rows.where("not unfit and size(vector) > 0").drop("unfit")
    length = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    n, width = length["count"], length["width"]
    rows = rows.where(F.size("vector") == width)

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in _blocks(batches):
            x = _integers(batch.column("vector"))
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    parts = map_batches(rows, sums, "i int, high long, low long").groupBy("i").agg(exact("high").alias("high"), exact("low").alias("low"))
    total = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in parts.collect()}  # a row for each dimension
    total = [total[i] for i in range(width)]

    def triangles(batches):
        import numpy as np
        import pyarrow as pa

        held = np.zeros((width, width))
        for batch in _blocks(batches):
            y = _deviations(_integers(batch.column("vector")), n, total)
            held = _triangle(np.vstack([held, y.astype(float) / n]))
        yield pa.RecordBatch.from_arrays([pa.array([held.ravel()], pa.list_(pa.float64()))], names=["triangle"])

    found = materialise(map_batches(rows, triangles, "triangle array<double>"), "whitening-triangles")
    import numpy as np

    triangle = np.array(_reduce_triangles(found, width).first()["triangle"]).reshape(width, width)
    values, axes = directions(triangle, components)
    kept = axes.shape[1]
    if not kept:
        return spark.createDataFrame([], schema)
    explained = [values[i] / sum(values) for i in range(kept)]
    weights = axes / np.sqrt(np.array(values[:kept]) / n)

    def project(batches):
        import pyarrow as pa

        for batch in _blocks(batches):
            y = _deviations(_integers(batch.column("vector")), n, total)
            w = (y.astype(float) / n) @ weights
            lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), kept).cast(pa.list_(pa.float64()))
            columns = [batch.column("vec_id"), pa.array(_squares(y), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "w"])

    projected = materialise(map_batches(rows, project, "vec_id long, deviation long, w array<double>"), "whitened")
    means = projected.agg(*[F.avg(F.col("w")[i]) for i in range(kept)]).first()
    centred = [F.col("w")[i] - F.lit(means[i]) for i in range(kept)]
    pairs = [(i, j) for i in range(kept) for j in range(i, kept)]
    covariance = projected.agg(*[F.avg(centred[i] * centred[j]) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs, strict=True))
    shares = F.array(*[F.lit(x) for x in explained])
    return projected.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
