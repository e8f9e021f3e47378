"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The tree's root is the leftmost of the lowest-ranked pairs. A merge changes three leaves,
each in a logarithmic number of steps, until no pair can be merged. Ids and texts equal
those of the tokenizers library for the vocabulary files that the class below understands;
the library itself takes no part.
"""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import map_batches, text_or_empty
from panelspark.llm.tokens import (
    KEPT_LENGTH,
    Recent,
    blanks_white_space,
    byte_characters,
    cut_before_spaces,
    little_endian,
    text_batches,
    vocabulary_path,
    words,
)

#: Fixed value: the pattern of byte-level vocabularies that name none.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = 1 << 62


def merge_symbols(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge until no adjacent pair is in ``pairs``: (left, right) -> (rank, merged)."""
    n = len(symbols)
    if n < 2:
        return symbols
    find = pairs.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    shift = size.bit_length()  # a leaf holds its rank, then its place: the minimum is the leftmost
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        if found := find((symbols[i], symbols[i + 1])):
            tree[size + i] = found[0] << shift | i
    for p in range(size - 1, 0, -1):
        a, b = tree[2 * p], tree[2 * p + 1]
        tree[p] = a if a < b else b
    symbols = symbols[:]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))

    def put(i: int, value: int) -> None:
        p = size + i
        tree[p] = value
        p >>= 1
        while p:
            a, b = tree[2 * p], tree[2 * p + 1]
            least = a if a < b else b
            if tree[p] == least:
                return
            tree[p] = least
            p >>= 1

    def rank(i: int, j: int) -> int:
        found = find((symbols[i], symbols[j]))
        return found[0] << shift | i if found else _NONE

    while (root := tree[1]) != _NONE:
        i = root & ((1 << shift) - 1)
        j = after[i]
        symbols[i] = find((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        after[i] = k = after[j]
        if j < n - 1:
            put(j, _NONE)
        if k < n:
            before[k] = i
            put(i, rank(i, k))
        else:
            put(i, _NONE)
        if (h := before[i]) >= 0:
            put(h, rank(h, i))
    return [s for s in symbols if s >= 0]


class Vocabulary:
    """A byte-level BPE file: its normalisation, its pattern, its ranks, and its decoder."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain byte-level BPE is understood")
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in config.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        normal = config.get("normalizer") or {}
        steps = normal.get("normalizers", [normal] if normal else [])
        if not all(x["type"] in ("NFC", "Lowercase") or blanks_white_space(x) for x in steps):
            raise ValueError(f"{path}: a normaliser that isn't understood")
        self.steps = [x["type"] for x in steps]
        pre = config["pre_tokenizer"]
        split = next((x for x in pre.get("pretokenizers", []) if x["type"] == "Split"), None)
        self.drops_space = split is not None and bool(split.get("invert")) and split.get("behavior") == "Removed"
        if "Replace" in self.steps and not self.drops_space:
            raise ValueError(f"{path}: blanks that the pattern keeps aren't understood")
        self.pattern = regex.compile(split["pattern"]["Regex"] if split else BYTE_LEVEL_PATTERN)
        self.cut = words if self.drops_space else cut_before_spaces
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.decoder = (config.get("decoder") or {}).get("type")
        shown = byte_characters()
        self.first = [self.ids[c] for c in shown]
        self.last = [self.ids[c + self.suffix] for c in shown]
        self.bytes_of = {c: b for b, c in enumerate(shown)}
        self.words, self.pieces = Recent(), Recent()

    def normalise(self, text: str) -> str:
        for step in self.steps:
            if step == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif step == "Lowercase":  # each character by itself, without the rule for a final sigma
                text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return text  # a run of white space that becomes one blank is dropped by the pattern

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        try:
            return self.words[word]
        except KeyError:
            raw = word.encode("utf-8")
            first = self.first
            symbols = [first[b] for b in raw]
            symbols[-1] = self.last[raw[-1]]
            ids = tuple(merge_symbols(symbols, self.pairs))
            if len(word) <= KEPT_LENGTH:
                self.words[word] = ids
            return ids

    def piece(self, piece: str) -> bytes:
        return little_endian([i for m in self.pattern.findall(self.normalise(piece)) for i in self.word(m)])

    def _plain(self, text: str) -> bytes:
        kept, out = self.pieces, []
        for p in self.cut(text):
            try:
                out.append(kept[p])
            except KeyError:
                out.append(ids := self.piece(p))
                if len(p) <= KEPT_LENGTH:
                    kept[p] = ids
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; added tokens in the text keep their own id."""
        self.pieces.trim()
        self.words.trim()
        if self.special is None or not any(s in text for s in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes behind the tokens with a byte-level decoder, else tokens set apart by blanks."""
        import numpy as np

        tokens = map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        if self.decoder is None:
            return " ".join(tokens)
        of = self.bytes_of
        parts = []
        for t in tokens:
            parts.append(t.encode("utf-8") if t in self.added else bytes([of[c] for c in t]))
        return b"".join(parts).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_and_decode(
    docs: DataFrame, vocabulary_file: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, ids (binary, little-endian unsigned 32-bit), decoded.

    A null or empty text has no ids and decodes to the empty text. Texts are encoded whole,
    whatever their length. Other columns of the input are ignored; rows that repeat are
    encoded each by itself.
    """
    path = vocabulary_path(vocabulary_file)

    def run(batches):
        import pyarrow as pa

        model = vocabulary(path)
        for doc_ids, texts in text_batches(batches, ["doc_id", "text"]):
            ids = [model.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary()), pa.array([model.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, ids binary, decoded string")
