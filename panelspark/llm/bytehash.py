"""Vectorised hashes over the bytes of Arrow strings."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits of the input."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, start: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(start)) * U(0x9E3779B97F4A7C15))


@functools.lru_cache(maxsize=8)
def byte_values(which: int) -> np.ndarray:
    return seeds(256, 1000 * which)


def bases(which: int) -> int:
    return int(seeds(1, 77_000 + which)[0]) | 5  # odd, so that it has an inverse modulo 2**64


@functools.lru_cache(maxsize=16)
def powers(base: int, size: int) -> np.ndarray:
    """base**0 .. base**(size-1) modulo 2**64."""
    out = np.full(size, base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def power_table(base: int, size: int) -> np.ndarray:
    return powers(base, 1 << max(10, (size - 1).bit_length()))[:size]


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary Arrow column without nulls, and where each value starts and ends."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_runs(column, most: int):
    """(first, last) of runs of rows of a string or binary Arrow column that hold about ``most`` bytes.

    A run ends before the row that would go beyond ``most``; a longer row is a run by itself.
    """
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    places = column.buffers()[1]
    if places is None:
        return
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


class Rolling:
    """Hashes of substrings from prefix sums modulo 2**64, at every place at once.

    They choose places (equal strings have equal hashes) and never tell strings apart: in this
    ring different strings of regular build collide whatever the bases are.
    """

    def __init__(self, values: np.ndarray, which: int):
        base = bases(which)
        n = len(values)
        self.inverse = power_table(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(byte_values(which)[values] * power_table(base, n + 1)[:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Of the substrings of one length, at every place."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


#: Words are hashed modulo the prime 2**61 - 1, in pieces of at most PIECE bytes.
PRIME = (1 << 61) - 1
PIECE = 4096


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of halves of 30 and 31 bits."""
    low = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    middle = a1 * b0 + a0 * b1
    return reduced(a1 * b1 * U(2) + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << U(31)) + a0 * b0)


def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high * 2**32 + low modulo the prime."""
    high = reduced(high)
    return reduced(reduced(low) + ((high & U((1 << 29) - 1)) << U(32)) + (high >> U(29)))


@functools.lru_cache(maxsize=8)
def prime_powers(which: int, size: int) -> np.ndarray:
    """base**0 .. base**(size-1) modulo the prime."""
    base = int(seeds(1, 77_000 + which)[0]) % PRIME
    out = np.ones(1, dtype=U)
    while len(out) < size:
        out = np.concatenate([out, times(out, np.array([pow(base, len(out), PRIME)], dtype=U))])
    return out[:size]


def polynomials(values: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each run of ``values`` (below 2**10; from its start to the next) the polynomial of ``at``, its places."""
    power = prime_powers(3, PIECE)
    first = np.flatnonzero(at % PIECE == 0) if at.max() >= PIECE else starts
    power = power[at % PIECE if len(first) > len(starts) else at]
    high, low = np.add.reduceat(values * (power >> U(32)), first), np.add.reduceat(values * (power & U(0xFFFFFFFF)), first)
    total = joined(high, low)
    if len(first) == len(starts):
        return total
    piece = at[first] // PIECE
    total = times(total, prime_powers(4, 1 << int(piece.max()).bit_length())[piece])
    of = np.searchsorted(first, starts)
    return joined(np.add.reduceat(total >> U(32), of), np.add.reduceat(total & U(0xFFFFFFFF), of))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z as a-z, of every text; the number of words in each."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACES[data]
    begins = np.ones(len(data), bool)
    begins[1:] = ~inside[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & begins)
    per_text = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    if not len(starts):
        return np.zeros(0, U), per_text
    # each word's bytes, and then the white space up to the next word, which counts nothing
    lengths = np.diff(np.append(starts, len(data)))
    at = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], lengths)
    used = data[starts[0] :]
    value = LOWER[used].astype(U) + U(1)
    value[SPACES[used]] = 0
    return mix(polynomials(value, at, starts - starts[0])), per_text


def word_sequences(data: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
    """Of every text its words, A-Z as a-z, between single blanks: equal bytes where the words are equal."""
    inside = ~SPACES[data]
    stays = inside.copy()
    stays[1:] |= inside[:-1]  # the first white space after a word
    starts = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    stays[starts] = inside[starts]
    places = np.r_[0, np.cumsum(stays)][offsets]
    kept = np.where(inside, LOWER[data], np.uint8(32))[stays]
    ends = places[1:].copy()
    filled = ends > places[:-1]
    ends[filled] -= kept[ends[filled] - 1] == 32
    view = memoryview(kept)
    return [view[a:b] for a, b in zip(places[:-1].tolist(), ends.tolist(), strict=True)]
