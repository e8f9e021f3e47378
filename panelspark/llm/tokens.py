"""Token ids by the tokenizers library, many documents at a time.

A vocabulary file's ids of a text are those of its pieces one after another, if it is cut
only where no token can span the cut. Words come back often, so each Python worker keeps
the ids of the pieces it has met; the library encodes each new piece, words of byte-level
files many in one string. Files with other rules than the two kinds below are encoded text by text.
"""

from __future__ import annotations

import array
import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

_WORDS = re.compile(f"[^{WHITE_SPACE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to Python alone
_RUN = re.compile(r"[ \n]\s")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \t\n\r])")

KEPT_PIECES = 500_000
KEPT_LENGTH = 64
BATCH_BYTES = 4_000_000
RUN_PIECES = 1 << 18


class Recent(dict):
    """The values of keys met lately: between one and two times ``most`` of them, then the oldest go."""

    def __init__(self, most: int = KEPT_PIECES):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        """The value of a key met before the present ones; KeyError if unknown."""
        value = self[key] = self.old[key]
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def little_endian(ids: list[int]) -> bytes:
    packed = array.array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def words(text: str) -> list[str]:
    """The runs without white space."""
    return _WORDS.findall(text) if _SEPARATORS.search(text) else text.split()


def cut_before_spaces(text: str) -> list[str]:
    """The text cut wherever white space follows something else."""
    return _BEFORE_SPACE.split(text) if text else []


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def blanks_white_space(step: dict) -> bool:
    """The normaliser makes one blank of a run of white space, which changes nothing where the pattern drops it."""
    return step["type"] == "Replace" and step.get("pattern") == {"Regex": "\\s+"} and step.get("content") == " "


def splitter(config: dict):
    """How texts may be cut before this vocabulary encodes them; None if not at all."""
    normalizer, pre = config.get("normalizer"), config.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normalizer:
        return cut_before_spaces
    steps = pre.get("pretokenizers") or []
    drops_space = steps and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
    given = normalizer.get("normalizers", []) if normalizer else []
    if drops_space and {x["type"] for x in given} == {"NFC", "Replace", "Lowercase"} and all(x["type"] != "Replace" or blanks_white_space(x) for x in given):
        return words
    return None


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.split = splitter(config)
        self.specials = [x["content"] for x in config.get("added_tokens", [])]
        self.kept, self.spaced = Recent(), Recent()  # pieces as they are; words behind a blank, or with the line end before them
        self.lower = self.split is words  # such vocabularies take letters as lower-case ones
        self.shown = dict(enumerate(byte_characters()))
        self.marks = dict(zip(("", ",", "."), self._library(["", ",", "."]), strict=True))
        if self.split is cut_before_spaces:
            self.line_end = self._library(["\n"])[0]
            self.bare = Tokenizer(self.model)  # takes byte characters as they are
            merged = set("".join(t for t in config["model"]["vocab"] if len(t) > 1))
            self.apart = next((c for c in map(self.shown.get, range(32)) if c not in merged), None)  # never in a letter

    def _library(self, texts: list[str]) -> list[bytes]:
        return [little_endian(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Of a word of Latin letters, which is one piece to the library's pre-tokenizers, by its model alone."""
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1").translate(self.shown)
        return little_endian([t.id for t in self.model.tokenize(word)])

    def _learn(self, kept: Recent, pieces: list[set]) -> list[str]:
        """Keep the ids of pieces that are new."""
        kept.trim()
        new: set[str] = set().union(*pieces)
        new.difference_update(kept)
        old, marks = kept.old, self.marks
        fresh = [p for p in new if p not in old]
        unknown = []
        for p in fresh:
            mark = p[-1] if p[-1:] in marks and p else ""
            word = p[:-1] if mark else p
            if self.lower:
                word = word.lower()
            if word.isalpha() and (word.isascii() or max(word) < "\u0180" and p.isascii() is False and unicodedata.is_normalized("NFC", p)):
                ids = kept.get(word) or old.get(word)
                if ids is None:
                    ids = kept[word] = self._word(word)
                if word != p:
                    kept[p] = ids + marks[mark]
            else:
                unknown.append(p)
        for at in range(0, len(unknown), 10_000):
            part = unknown[at : at + 10_000]
            kept.update(zip(part, self._library(part), strict=True))
        return [p for p in fresh if len(p) > KEPT_LENGTH]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.split is None:
            return self._library(texts)
        odd = [any(s in t for s in self.specials) for t in texts]
        plain = [t for t, o in zip(texts, odd, strict=True) if not o]
        done = iter(self._plain_words(plain) if self.lower else self._plain_lines(plain))
        rest = iter(self._library([t for t, o in zip(texts, odd, strict=True) if o]) if any(odd) else ())
        return [next(rest if o else done) for o in odd]

    def _plain_words(self, texts: list[str]) -> list[bytes]:
        pieces = [words(t) for t in texts]
        long = self._learn(self.kept, [set(p) for p in pieces])
        kept = self.kept
        out = [b"".join([kept[p] for p in ps]) for ps in pieces]
        for p in long:
            kept.pop(p, None)
        return out

    def _plain_lines(self, texts: list[str]) -> list[bytes]:
        """Texts whose white space stands alone are cut at blanks and line ends, others piece by piece."""
        lone = [bool(t) and not t[-1].isspace() and not _RUN.search(t) for t in texts]
        done = iter(self._lone_spaces([t for t, x in zip(texts, lone, strict=True) if x]) if any(lone) else ())
        rest = iter(self._pieces([t for t, x in zip(texts, lone, strict=True) if not x]) if not all(lone) else ())
        return [next(done if x else rest) for x in lone]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        pieces = [cut_before_spaces(t) for t in texts]
        long = self._learn(self.kept, [set(p) for p in pieces])
        kept = self.kept
        out = [b"".join([kept[p] for p in ps]) for ps in pieces]
        for p in long:
            kept.pop(p, None)
        return out

    def _lone_spaces(self, texts: list[str]) -> list[bytes]:
        """Each text gets a line end before it, so that a piece is behind a blank or begins with its line end."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lines = pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string())
        cut = pc.split_pattern(lines, " ")
        pieces = cut.values.dictionary_encode()
        ids = self._behind(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = pieces.indices.to_numpy()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        places, known = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        out = np.empty(ends[-1], "<u4")
        for i in range(0, len(codes), RUN_PIECES):
            j = min(i + RUN_PIECES, len(codes))
            shift = places[codes[i:j]] - ends[i:j]
            out[ends[i] : ends[j]] = known[np.repeat(shift, np.diff(ends[i : j + 1])) + np.arange(ends[i], ends[j])]
        bounds = ends[cut.offsets.to_numpy()].tolist()
        return [out[a + 1 : b].tobytes() for a, b in zip(bounds, bounds[1:])]  # without that line end

    def _behind(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces, behind a blank or with the line end that they begin with."""
        kept = self.spaced
        kept.trim()
        ids = [*map(kept.get, pieces)]
        old, marks = kept.old, self.marks
        fresh, stems, other, learned = [], [], [], {}
        for i in [i for i, x in enumerate(ids) if x is None]:
            p = pieces[i]
            if (x := old.get(p)) is not None:
                ids[i] = kept[p] = x
                continue
            stem = p[:-1] if p[-1:] in marks else p
            word = stem[1:] if stem[:1] == "\n" else stem
            if self.apart and word.isalpha() and (word.isascii() or max(word) < "\u0180"):
                fresh.append(i)
                stems.append(stem)
                if stem not in kept and stem not in old:
                    learned[stem] = b""
            else:
                other.append(i)
        new = [*learned]
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            learned.update(zip(part, self._letters(part), strict=True))
        for i, stem in zip(fresh, stems, strict=True):
            ids[i] = (learned.get(stem) or kept.get(stem) or old[stem]) + marks[pieces[i][len(stem) :]]
        for at in range(0, len(other), 10_000):
            places = other[at : at + 10_000]
            lines = [pieces[i][1:] if pieces[i][:1] == "\n" else " " + pieces[i] for i in places]
            for i, x in zip(places, self._library(lines), strict=True):
                ids[i] = self.line_end + x if pieces[i][:1] == "\n" else x
        for p, x in chain(learned.items(), ((pieces[i], ids[i]) for i in chain(fresh, other))):
            if len(p) <= KEPT_LENGTH:
                kept[p] = x
        return ids

    def _letters(self, stems: list[str]) -> list[bytes]:
        """The ids of words of Latin letters by the model alone, many in one string, set apart by a byte that merges with none."""
        import numpy as np

        table = np.array([ord(c) for c in self.shown.values()], "<u4")
        table[10] = ord(self.apart)
        lines = [s[1:] if s[0] == "\n" else " " + s for s in stems]
        groups = ["\n".join(lines[i : i + 64]) + "\n" for i in range(0, len(lines), 64)]
        texts = [table[np.frombuffer(g.encode("utf-8"), np.uint8)].tobytes().decode("utf-32-le") for g in groups]
        packed = b"".join([little_endian(x.ids) for x in self.bare.encode_batch_fast(texts, add_special_tokens=False)])
        cuts = 4 * np.flatnonzero(np.frombuffer(packed, "<u4") == self.model.token_to_id(self.apart))
        out = [packed[a:b] for a, b in zip([0, *(cuts[:-1] + 4).tolist()], cuts.tolist(), strict=True)]
        return [self.line_end + x if s[0] == "\n" else x for s, x in zip(stems, out, strict=True)]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's own encoder of a vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task a core
    return Encoder(path)


def text_batches(batches: Iterator, columns: list[str], most: int = BATCH_BYTES) -> Iterator[tuple[list, ...]]:
    """Columns of Arrow batches as lists, in runs of at most ``most`` bytes of text (the last column).

    A longer text comes alone.
    """
    from panelspark.llm.bytehash import byte_runs

    for batch in batches:
        for i, j in byte_runs(batch.column(columns[-1]), most):
            part = batch.slice(i, j - i)
            yield tuple(part.column(c).to_pylist() for c in columns)
