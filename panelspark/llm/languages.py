"""Language identification by mixtures: expectation-maximisation of each document's language shares.

*Model.* Every language has a chain of characters: the chance of a letter, or of the word's
end, after the two characters before it within the word. Pairs of characters fall into
``2**CONTEXT_BITS`` contexts and the next character into ``2**NEXT_BITS`` cells by hash, so the
model's size is fixed; counts cover every document that may be learned from. A language's
chances are drawn towards those of all languages together, by ``PRIOR`` counts, so a context
that a language never met says nothing for or against it.

*Document.* A word's n-gram likelihood under each language is the product of its chances. A
document is a mixture: each word comes from one language, drawn by the document's shares.
The set of languages starts with the single best and grows: of all others the one whose
best mixture with the present set gains most joins if the log likelihood grows by more than
the penalty, and expectation-maximisation finds the shares of the new set. The largest share
names the document.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import map_batches
from panelspark.llm.tokens import text_batches

CONTEXT_BITS, NEXT_BITS = 12, 6
CELLS = 1 << (CONTEXT_BITS + NEXT_BITS)
MOST_LANGUAGES = 64
PRIOR = 4.0
PENALTY = 2.0  # times the log of the number of words and of languages, for each language more
ROUNDS, TRIALS = 30, 8
SETTLED = 1e-4
UNKNOWN = "und"
_BLOCK = 250_000


def learned_from(doc_id):
    """True for documents whose lang may be learned: crc32 of the id as text, mod 4, isn't 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


@functools.lru_cache(maxsize=1)
def _letters():
    """Of every code point whether it is a letter."""
    import numpy as np

    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _runs(texts: list[str]):
    """The texts in lower case, in runs of about _BLOCK characters, with the index of each; a longer one in several
    parts, cut where a word ends or, in a word of more than _BLOCK characters, inside it."""
    parts, owners, size = [], [], 0
    for i, t in enumerate(texts):
        t = t.lower()
        at = 0
        while at < len(t):
            end = min(len(t), at + _BLOCK)
            if end < len(t):
                cut = next((p for p in range(end, at, -1) if not t[p - 1].isalpha()), end)
                end = cut
            if parts and size + end - at > _BLOCK:
                yield parts, owners
                parts, owners, size = [], [], 0
            parts.append(t[at:end])
            owners.append(i)
            size += end - at
            at = end
    if parts:
        yield parts, owners


def word_cells(parts: list[str], owners: list[int]):
    """(cells, first cell of each word, text of each word): the model's cells of all words' characters."""
    import numpy as np

    codes = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    owner = np.repeat(np.array(owners), [len(p) + 1 for p in parts])
    codes[~_letters()[np.minimum(codes, 0x10FFFF)]] = 0
    before, before2 = np.r_[np.uint32(0), codes[:-1]], np.r_[np.zeros(2, np.uint32), codes[:-2]]
    before2[before == 0] = 0
    used = (codes != 0) | (before != 0)  # letters, and what ends a word
    begins = (codes != 0) & (before == 0)
    with np.errstate(over="ignore"):
        context = before * np.uint32(0x9E3779B1) ^ (before2 * np.uint32(0x85EBCA77) + np.uint32(0x165667B1))
        context = (context ^ context >> np.uint32(15)) * np.uint32(0xC2B2AE3D)
        following = (codes * np.uint32(0x27D4EB2F) + np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA77)
    cells = context >> np.uint32(32 - CONTEXT_BITS) << np.uint32(NEXT_BITS) | following >> np.uint32(32 - NEXT_BITS)
    place = np.cumsum(used) - 1
    return cells[used].astype(np.int64), place[begins], owner[begins]


@dataclass
class LanguageModel:
    """Log chances, a row for each cell and a column for each language."""

    languages: list[str]
    chances: object
    settings: dict = field(default_factory=dict)

    def words(self, texts: list[str]):
        """(text of each word, its log likelihood under each language)."""
        import numpy as np

        owners, found = [np.zeros(0, np.int64)], [np.zeros((0, len(self.languages)))]
        for parts, of in _runs(texts):
            cells, first, owner = word_cells(parts, of)
            if len(first):
                owners.append(owner)
                found.append(np.add.reduceat(self.chances[cells], first, axis=0, dtype=np.float64))
        return np.concatenate(owners), np.concatenate(found)

    def shares(self, texts: list[str]):
        """Of every text the share of each language; zeros where there is no word or nothing was learned."""
        import numpy as np

        owner, likelihood = self.words(texts)
        return mixture_shares(owner, likelihood, len(texts), self.settings.get("penalty", PENALTY))


def mixture_shares(owner, likelihood, n: int, penalty: float = PENALTY):
    """Shares (n rows, a column for each language) of documents whose words, in the order of ``owner``, have
    these log likelihoods."""
    import numpy as np

    languages = likelihood.shape[1]
    shares = np.zeros((n, languages))
    if not len(owner) or not languages:
        return shares
    held, first, count = np.unique(owner, return_index=True, return_counts=True)
    shares[held, np.add.reduceat(likelihood, first, axis=0).argmax(axis=1)] = 1.0
    if languages == 1:
        return shares
    likely = np.exp(likelihood - likelihood.max(axis=1, keepdims=True))
    likely = np.maximum(likely, 1e-300)
    price = np.zeros(n)
    price[held] = penalty * (np.log(count) + np.log(languages))

    active = np.ones(len(owner), bool)  # words of documents whose set may still grow
    while active.any():
        own, p = owner[active], likely[active]
        docs, first, count = np.unique(own, return_index=True, return_counts=True)
        row = np.repeat(np.arange(len(docs)), count)
        w = shares[docs]
        present = (p * w[row]).sum(axis=1)
        base = np.add.reduceat(np.log(present), first)
        part = np.full((len(docs), languages), 0.1)  # of a language that joins
        for _ in range(TRIALS):
            new = p * part[row]
            new /= new + present[:, None] * (1 - part[row])
            part = np.clip(np.add.reduceat(new, first, axis=0) / count[:, None], 1e-9, 1 - 1e-9)
        gain = np.add.reduceat(np.log(p * part[row] + present[:, None] * (1 - part[row])), first, axis=0) - base[:, None]
        gain[w > 0] = -np.inf
        joins = gain.argmax(axis=1)
        grows = gain[np.arange(len(docs)), joins] > price[docs]
        if not grows.any():
            break
        k = np.flatnonzero(grows)
        w[k] *= 1 - part[k, joins[k]][:, None]
        w[k, joins[k]] = part[k, joins[k]]
        shares[docs[k]] = _maximised(own, p, grows[row], docs[k], w[k])
        active[active] = grows[row]
    return shares


def _maximised(own, p, chosen, docs, w):
    """Shares ``w`` of ``docs`` after expectation-maximisation over their words."""
    import numpy as np

    own, p = own[chosen], p[chosen]
    _, first, count = np.unique(own, return_index=True, return_counts=True)
    row = np.repeat(np.arange(len(docs)), count)
    for _ in range(ROUNDS):
        mixed = p * w[row]
        mixed /= mixed.sum(axis=1, keepdims=True)
        after = np.add.reduceat(mixed, first, axis=0) / count[:, None]
        moved = np.abs(after - w).max()
        w = after
        if moved < SETTLED:
            break
    return w


def fit_languages(
    docs: DataFrame, penalty: float = PENALTY, most_languages: int = MOST_LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel:
    """A model from every document with a lang whose id may be learned from (``learned_from``).

    The ``most_languages`` commonest values of lang are learned (of equally common ones the first
    in order): this bounds the model. Null texts count nothing; a table without such documents
    gives a model without languages.
    """
    import numpy as np

    known = docs.where(learned_from(F.col(id_col))).where(F.col(lang_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    names = sorted(r["lang"] for r in common)
    place = {name: i for i, name in enumerate(names)}

    def count(batches):
        import pyarrow as pa

        found: dict[int, object] = {}
        for langs, texts in text_batches(batches, ["lang", "text"]):
            for lang in set(langs) & place.keys():
                own = found.setdefault(place[lang], np.zeros(CELLS, np.int64))
                for parts, owners in _runs([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    own += np.bincount(word_cells(parts, owners)[0], minlength=CELLS)
        for i, own in found.items():
            met = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), i, np.int32)), pa.array(met.astype(np.int32)), pa.array(own[met])], names=["i", "cell", "n"])

    table = np.zeros((CELLS, len(names)))
    if names:  # most_languages * CELLS rows at most
        counts = map_batches(known, count, "i int, cell int, n long").groupBy("i", "cell").agg(F.sum("n").alias("n")).toArrow()
        table[counts["cell"].to_numpy(), counts["i"].to_numpy()] = counts["n"].to_numpy()
    grid = table.reshape(1 << CONTEXT_BITS, 1 << NEXT_BITS, len(names))
    everything = grid.sum(axis=2)
    pooled = (everything + 0.1) / (everything.sum(axis=1, keepdims=True) + 0.1 * (1 << NEXT_BITS))
    chances = np.log((grid + PRIOR * pooled[:, :, None]) / (grid.sum(axis=1, keepdims=True) + PRIOR))
    settings = {"penalty": penalty, "documents": {r["lang"]: r["count"] for r in common}}
    return LanguageModel(names, chances.reshape(CELLS, len(names)).astype(np.float32), settings)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score and languages (array of lang and share, largest first).

    lang_pred has the largest share of the text's words, of equal shares the first in order;
    score is that share. A text that is null or has no letter is ``und`` with score 0 and no
    languages, as is every text where the model has none. Only the text counts: rows that
    repeat get equal results, null ids pass through, other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for ids, texts in text_batches(batches, ["doc_id", "text"], _BLOCK):
            found = []
            for w in model.shares(texts).tolist():
                best = sorted(((-x, lang) for x, lang in zip(w, model.languages, strict=True) if x > 0))
                found.append([{"lang": lang, "share": -x} for x, lang in best])
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([f[0]["lang"] if f else UNKNOWN for f in found], pa.string()),
                pa.array([min(1.0, f[0]["share"]) if f else 0.0 for f in found], pa.float64()),
                pa.array(found, kind),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>")
