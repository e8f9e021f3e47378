"""Repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are told apart by most-significant-digit passes and only as far as ``threshold``
bytes; those that stay together through the last pass are exactly the repeated windows.

*Which suffixes.* Every window of ``threshold`` bytes holds an anchor: the place of its
least hashed substring of ``digit`` bytes, the leftmost if there are several. Equal windows
have their anchor at the same offset, so suffixes are sorted at their anchors, with the run
of windows around each that share it. An anchor stands for about threshold/3 suffixes.

*Pass 1*, the digit of ``digit`` bytes at the anchor: an anchor alone with its digit has no
repeated window and leaves. If all anchors of a digit have the same whole context, all
their windows are repeated and leave, too.

*Pass 2*, the whole contexts: of anchors with equal context all windows are repeated, and
one of them stands for all from here on.

*Pass 3*, the windows of the contexts that differ: those found twice are repeated. The
contexts of one digit, up to ``SMALL_GROUP``, are compared in one row. Those of larger groups
meet the commonest context of their digit first, byte by byte: the windows that equal its own
are repeated and leave. The others are dealt out, first in blocks of windows, which leave if
what all their windows share is found once, or if all that share it are equal, then window
by window.

Digits, contexts and windows that are dealt out are told apart by cryptographic digests of
their bytes: 16 bytes for digit and context, 16 for digit and window. Windows of small groups
and of a digit's commonest context are compared byte by byte. A polynomial hash chooses the
anchors and nothing else. Matches never cross texts.
"""

from __future__ import annotations

from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import discard, hot_among, join_to_one, map_batches, materialise, text_or_empty, unused_name
from panelspark.llm.tokens import text_batches

SMALL_GROUP = 64
BLOCK = 8
_BLOCK = 500_000
_PLACE_BITS = 24


def digest(data) -> bytes:
    """Eight bytes of a cryptographic digest."""
    return blake2b(data, digest_size=8).digest()


def _longs(digests: list[bytes]):
    import numpy as np

    return np.frombuffer(b"".join(digests), "<i8")


def find_anchors(values, starts, ends, threshold: int, digit: int):
    """(digit, context, text, first window, anchor, last window) of each run of windows, digit and context digested.

    Texts lie in ``values``, each between its start and end; text is an index of ``starts``.
    """
    import numpy as np

    from panelspark.llm.bytehash import Rolling, U, sliding_minimum

    n_windows = len(values) - threshold + 1
    if n_windows <= 0:
        return None
    hashes = Rolling(values, 1).every(digit)
    place = U((1 << _PLACE_BITS) - 1)
    ranked = (hashes & ~place) | np.arange(len(hashes), dtype=U)
    anchors = (sliding_minimum(ranked, threshold - digit + 1) & place).astype(np.int64)
    counts = np.maximum(ends - starts - threshold + 1, 0)
    text = np.repeat(np.arange(len(starts)), counts)
    if not len(text):
        return None
    window = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[text]
    anchor = anchors[window]
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) + 1
    begin, end = np.r_[0, change], np.r_[change - 1, len(text) - 1]
    low, high, at = window[begin], window[end], anchor[begin]
    data = values.tobytes()
    digits = _longs([digest(data[a : a + digit]) for a in at.tolist()])
    # where the anchor lies in its context counts, too
    contexts = _longs([digest(b"%d %s" % (c - a, data[a:b])) for a, b, c in zip(low.tolist(), (high + threshold).tolist(), at.tolist(), strict=True)])
    return digits, contexts, text[begin], low, at, high


def _anchor_rows(threshold: int, digit: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from panelspark.llm.bytehash import byte_runs, string_bytes

        def rows(keys, values, starts, ends, shift):
            found = find_anchors(values, starts, ends, threshold, digit)
            if found is not None:
                k1, s1, text, low, at, high = found
                span = (low - starts[text] + shift) << 16 | (at - low) << 8 | (high - low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (k1, s1, keys[text], span)], names=["k1", "s1", "row", "span"]
                )

        for batch in batches:
            values, offsets = string_bytes(batch.column("text"))
            keys = batch.column("row").to_numpy()
            for i, j in byte_runs(batch.column("text"), _BLOCK):
                begin, size = offsets[i], offsets[j] - offsets[i]
                if size <= 2 * _BLOCK:
                    yield from rows(keys[i:j], values[begin : offsets[j]], offsets[i:j] - begin, offsets[i + 1 : j + 1] - begin, 0)
                else:  # one long text: its windows, block by block
                    for at in range(0, size, _BLOCK):
                        part = values[begin + at : min(begin + at + _BLOCK + threshold - 1, offsets[j])]
                        yield from rows(keys[i:j], part, np.array([0]), np.array([len(part)]), at)

    return run


def _contexts(threshold: int):
    """The bytes around the anchors of a text that its list names."""

    def run(batches):
        import pyarrow as pa

        for keys, lists, texts in text_batches(batches, ["row", "wanted", "text"]):
            rows, size = [], 0
            for row, wanted, text in zip(keys, lists, texts, strict=True):
                for x in wanted:
                    low, before, more = x["span"] >> 16, x["span"] >> 8 & 255, x["span"] & 255
                    rows.append((x["k1"], row, low, before, more, x["copies"], x["copies"] == 1, text[low : low + more + threshold]))
                    size += more + threshold
                if size > 4_000_000:
                    yield _context_batch(pa, rows)
                    rows, size = [], 0
            if rows:
                yield _context_batch(pa, rows)

    return run


def _context_batch(pa, rows):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
    names = ["k1", "row", "low", "before", "more", "copies", "alone", "context"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _runs(places: list[int]):
    """(first, how many more) of runs of neighbouring places."""
    at = 0
    while at < len(places):
        end = at
        while end + 1 < len(places) and places[end + 1] == places[end] + 1:
            end += 1
        yield places[at], end - at
        at = end + 1


def _compare_small(threshold: int):
    """Repeated windows of the contexts that one row holds, for those that stand for themselves alone."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out_row, out_range = [], []
            for group in batch.column("contexts").to_pylist():
                seen: dict[tuple[int, bytes], int] = {}
                for x in group:
                    for i in range(x["more"] + 1):
                        window = (x["before"] - i, x["context"][i : i + threshold])
                        seen[window] = seen.get(window, 0) + 1
                for x in group:
                    if x["alone"]:
                        found = [
                            x["low"] + i
                            for i in range(x["more"] + 1)
                            if seen[(x["before"] - i, x["context"][i : i + threshold])] > 1
                        ]
                        for first, more in _runs(found):
                            out_row.append(x["row"])
                            out_range.append(first << 8 | more)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_row, pa.int64()), pa.array(out_range, pa.int64())], names=["row", "range"]
            )

    return run


def _equal_windows(context: bytes, before: int, central: bytes, central_before: int, threshold: int) -> list[tuple[int, int]]:
    """(first, last) offsets from the anchor, counted back, of runs of windows equal in both contexts.

    Byte by byte: a window is equal if it reaches over no place where the contexts differ.
    """
    import numpy as np

    start = -min(before, central_before)
    size = min(len(context) - before, len(central) - central_before) - start
    if size < threshold:
        return []
    a = np.frombuffer(context, np.uint8)[before + start :][:size]
    b = np.frombuffer(central, np.uint8)[central_before + start :][:size]
    edges = np.r_[-1, np.flatnonzero(a != b), size]
    found = np.flatnonzero(np.diff(edges) > threshold)
    return [(-start - int(edges[i]) - 1, -start - int(edges[i + 1]) + threshold) for i in found]


def _meet_centre(threshold: int):
    """Of contexts with the commonest one of their digit: windows that equal its own, and the rest in blocks of
    equal anchor offsets, with what all windows of a block share (core), what they span together (whole), and the
    digest of each one."""

    def run(batches):
        import pyarrow as pa

        names = ["k1", "block", "core", "whole", "row", "p", "more", "alone", "windows"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]
        long = lambda data: int.from_bytes(digest(data), "little", signed=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                out: list[list] = [[] for _ in names]

                def add(*values, out=out):
                    for column, v in zip(out, values, strict=True):
                        column.append(v)

                for x in batch.slice(at, 1_000).to_pylist():
                    k1, row, low, before, context, alone = (x[c] for c in ("k1", "row", "low", "before", "context", "alone"))
                    last = before - x["more"]  # the last window's anchor offset
                    if (row, low) == (x["c_row"], x["c_low"]):
                        continue
                    equal = _equal_windows(context, before, x["c_context"], x["c_before"], threshold)
                    open_ = set(range(last, before + 1))
                    for first, final in equal:
                        open_.difference_update(range(final, first + 1))
                        if alone:
                            add(k1, None, None, None, row, low + before - first, first - final, True, None)
                        if x["c_alone"]:  # its window is found twice, too
                            add(k1, None, None, None, x["c_row"], x["c_low"] + x["c_before"] - first, first - final, True, None)
                    for block in range(last // BLOCK, before // BLOCK + 1):
                        offsets = [o for o in range(block * BLOCK + BLOCK - 1, block * BLOCK - 1, -1) if o in open_]
                        if offsets:
                            core = context[before - block * BLOCK :][: threshold - BLOCK + 1]
                            a, b = before - offsets[0], before - offsets[-1]
                            windows = [long(context[before - o :][:threshold]) if o in open_ else None for o in range(offsets[0], offsets[-1] - 1, -1)]
                            whole = long(b"%d %d %d " % (offsets[0], offsets[-1], len(offsets)) + context[a : b + threshold])
                            add(k1, block, long(core), whole, row, low + a, b - a, alone, windows)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def _of_large_groups(large: DataFrame, threshold: int, hot: list[int]) -> DataFrame:
    """row and ranges of repeated windows among many contexts of one digit: against the commonest, by blocks, one by one."""
    centre = F.max_by(F.struct("row", "low", "before", "alone", "context"), F.struct("copies", F.length("context"), "row", "low"))
    centres = large.groupBy("k1").agg(centre.alias("c"))
    centres = materialise(centres.select("k1", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("row", "low", "before", "alone", "context")]), "repeats-centres")
    schema = "k1 long, block int, core long, whole long, row long, p long, more int, alone boolean, windows array<long>"
    blocks = materialise(map_batches(join_to_one(large, centres, ["k1"], hot=hot), _meet_centre(threshold), schema), "repeats-blocks")
    as_range = F.shiftleft("p", 8).bitwiseOR(F.col("more").cast("long")).alias("range")
    central = blocks.where("block is null").select("row", as_range).distinct()
    blocks = blocks.where("block is not null")
    key = ["k1", "block", "core"]
    digits = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    shared = materialise(digits.where("n > 1").select(*key, "n", (F.col("a") == F.col("b")).alias("same")), "repeats-cores")
    hot = hot_among(shared, key, blocks.count())
    met = materialise(join_to_one(blocks, shared.drop("n"), key, hot=hot), "repeats-blocks-met")
    whole = met.where("same and alone").select("row", as_range)  # windows missing between are repeated: the centre has them
    single = met.where("not same").select("k1", "row", "p", "alone", F.posexplode("windows").alias("i", "w")).where("w is not null")
    twice = single.groupBy("k1", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = materialise(twice, "repeats-windows")
    total = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = hot_among(twice, ["k1", "w"], total)
    found = join_to_one(single.where("alone"), twice.select("k1", "w"), ["k1", "w"], "left_semi", hot)
    return central.unionByName(whole).unionByName(found.select("row", F.shiftleft(F.col("p") + F.col("i"), 8).alias("range")))


def repeated_ranges(keyed: DataFrame, threshold: int) -> DataFrame:
    """row and the ranges of its repeated windows, as first window << 8 | windows after it.

    ``keyed`` has a key ``row`` and a non-null ``text``.
    """
    digit = max(8, threshold * 8 // 25)
    if not 2 * digit <= threshold <= 255:
        raise ValueError("the threshold must lie between 16 and 255 bytes")
    fields = "k1 long, s1 long, row long, span long"
    anchors = materialise(map_batches(keyed.select("row", "text"), _anchor_rows(threshold, digit), fields), "repeats-anchors")

    digits = anchors.groupBy("k1").agg(F.count(F.lit(1)).alias("n"), F.min("s1").alias("a"), F.max("s1").alias("b"))
    shared = materialise(digits.where("n > 1").select("k1", "n", (F.col("a") == F.col("b")).alias("same")), "repeats-shared")
    hot = hot_among(shared, ["k1"], anchors.count())
    together = materialise(join_to_one(anchors, shared.drop("n"), ["k1"], hot=hot), "repeats-digits")
    discard(anchors)

    as_range = (F.shiftleft(F.shiftright("span", 16), 8) + F.col("span").bitwiseAND(F.lit(255))).alias("range")
    mixed = together.where("not same")
    classes = materialise(
        mixed.groupBy("k1", "s1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "span")).alias("first")),
        "repeats-contexts",
    )
    several = classes.where("n > 1").select("k1", "s1", "n")
    hot = hot_among(several, ["k1", "s1"], together.count())
    copies = join_to_one(mixed, several.drop("n"), ["k1", "s1"], "left_semi", hot)

    wanted = classes.select("k1", "first.row", F.struct("k1", "first.span", F.col("n").alias("copies")).alias("x"))
    lists = wanted.groupBy("row").agg(F.collect_list("x").alias("wanted"))
    texts = keyed.select("row", F.col("text").cast("binary").alias("text"))
    context = "k1 long, row long, low long, before int, more int, copies long, alone boolean, context binary"
    contexts = materialise(map_batches(texts.join(lists, "row"), _contexts(threshold), context), "repeats-bytes")

    sizes = materialise(contexts.groupBy("k1").agg(F.count(F.lit(1)).alias("n")), "repeats-sizes")
    hot = hot_among(sizes, ["k1"], contexts.count())
    sized = join_to_one(contexts, sizes, ["k1"], hot=hot)
    groups = sized.where(F.col("n") <= SMALL_GROUP).groupBy("k1").agg(
        F.collect_list(F.struct("row", "low", "before", "more", "alone", "context")).alias("contexts")
    )
    from_small = map_batches(groups.select("contexts"), _compare_small(threshold), "row long, range long")
    from_large = _of_large_groups(sized.where(F.col("n") > SMALL_GROUP).drop("n"), threshold, hot)

    found = (
        together.where("same").select("row", as_range)
        .unionByName(copies.select("row", as_range))
        .unionByName(from_small)
        .unionByName(from_large)
    )
    return found.groupBy("row").agg(F.collect_set("range").alias("ranges"))


def covered(ranges: list[int], threshold: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows of these ranges cover, as (start, end)."""
    out: list[tuple[int, int]] = []
    for x in sorted(ranges):
        start, end = x >> 8, (x >> 8) + (x & 255) + threshold
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in spans:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters at their ends, so that what is left is valid UTF-8."""
    out = []
    for start, end in spans:
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def _row_key(docs: DataFrame, id_col: str, text_col: str):
    """A key of rows: the id where no id repeats or is null, which is looked up first, else a hash of id and text.

    Rows that share the hash are taken to have the same id and text, and so the same repeats.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    odd = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
    return F.col(id_col).cast("long") if odd.isEmpty() else F.xxhash64(F.col(id_col), text_or_empty(text_col))


def find_repeats(docs: DataFrame, threshold: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (array of start, end in bytes), kept (binary).

    A byte is removed if it is covered by a string of ``threshold`` bytes that also starts
    anywhere else, in the same text or another; overlapping occurrences count, and strings
    are judged on the input. Texts are UTF-8 bytes, a null text is empty; texts shorter than
    the threshold lose nothing. Rows that repeat remove each other's bytes. Other columns
    are ignored. An empty table gives an empty result.
    """
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), _row_key(docs, id_col, text_col).alias("row")
    )
    ranges = materialise(repeated_ranges(keyed, threshold), "repeats-ranges")

    def run(batches):
        import pyarrow as pa

        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for ids, found, texts in text_batches(batches, ["doc_id", "ranges", "text"]):
            spans = [covered(x or [], threshold) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], spans_type),
                    pa.array([without(t, s) for t, s in zip(texts, spans, strict=True)], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    joined = keyed.select("row", "doc_id", F.col("text").cast("binary").alias("text")).join(ranges, "row", "left")
    return map_batches(
        joined.select("doc_id", "text", "ranges"),
        run,
        "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary",
    )


def drop_repeats(docs: DataFrame, threshold: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, the text without its repeated parts, in whole characters.

    A null text stays null. Every row stays, even where nothing is left of its text.
    """
    row, spans = unused_name(docs, "row_key"), unused_name(docs, "repeated")
    keyed = docs.withColumn(row, _row_key(docs, id_col, text_col))
    texts = keyed.select(F.col(row).alias("row"), text_or_empty(text_col).alias("text"))
    ranges = materialise(repeated_ranges(texts, threshold), "repeats-ranges").select(F.col("row").alias(row), F.col("ranges").alias(spans))

    def run(batches):
        import pyarrow as pa

        from panelspark.llm.bytehash import byte_runs

        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for i, j in byte_runs(batch.column(at), _BLOCK):
                part, out = batch.slice(i, j - i), []
                for text, found in zip(part.column(at).to_pylist(), part.column(spans).to_pylist(), strict=True):
                    if text and found:
                        data = text.encode("utf-8")
                        text = without(data, whole_characters(data, covered(found, threshold))).decode("utf-8")
                    out.append(text)
                yield part.set_column(at, text_col, pa.array(out, pa.string())).drop_columns([spans])

    joined = keyed.join(ranges, row, "left").drop(row)
    return map_batches(joined, run, docs.schema)
