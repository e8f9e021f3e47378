"""Shortest-pack-first packing over the histogram of lengths.

Documents are cut into full sequences and a rest. The histogram of the pieces' lengths, at
most one row for each length, is all that the driver sees: lengths are placed longest first
into the pattern with the most room (the shortest pack), whose count is split where it holds
more packs than there are pieces; where none has room, only as many packs are opened as the
tokens that are left would fill. Patterns are then joined back to the pieces by their rank among the pieces
of one length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import map_batches, materialise, text_or_empty
from panelspark.llm.tokens import encoder, text_batches, vocabulary_path


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (packs of this kind, their lengths) that hold every counted length.

    Where no open pack has room for a length, as many are opened as what is left to place
    would fill, but not more than there are pieces of this length.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by the room that is left
    done: list[tuple[int, tuple[int, ...]]] = []
    tokens = sum(length * n for length, n in counts.items())  # to be placed

    def put(room: int, count: int, lengths: tuple[int, ...]) -> None:
        if room:
            open_packs.setdefault(room, []).append((count, lengths))
        else:
            done.append((count, lengths))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max(open_packs, default=0)
            if room < length:
                room = capacity
                put(room, min(left, -(-tokens // capacity)), ())
            packs = open_packs[room]
            count, lengths = packs.pop()
            if not packs:
                del open_packs[room]
            taken = min(left, count)
            if count > taken:
                put(room, count - taken, lengths)
            put(room - length, taken, (*lengths, length))
            left -= taken
            tokens -= taken * length
    return done + [x for packs in open_packs.values() for x in packs if x[1]]


def pattern_slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset) for each place in each pattern."""
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            slots.append((length, first, first + count - 1, sequence, offset))
            used[length] = first + count
            offset += length
        sequence += count
    return slots


def token_pieces(docs: DataFrame, vocabulary_file: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of at most ``capacity`` tokens, each with its rank among those of its length and task."""
    path = vocabulary_path(vocabulary_file)

    def run(batches):
        import zlib
        from collections import Counter

        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        end, ranks = end_id.to_bytes(4, "little"), Counter()
        for doc_ids, texts in text_batches(batches, ["doc_id", "text"]):
            rows = []
            for doc_id, ids in zip(doc_ids, encoder(path).encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    rows.append((doc_id, start, length, zlib.crc32(piece), total, part, ranks[length]))
                    ranks[length] += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "part_rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, part_rank long"
    return map_batches(rows, run, schema, encodes=True)


def pack_documents(
    docs: DataFrame,
    vocabulary_file: str = "word_bpe_49k.json",
    end_id: int = 1,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then ``end_id``; a null or empty text is that one id.
    Documents longer than ``capacity`` are cut into full sequences and a rest, so each id
    lies in exactly one piece and no sequence holds more than ``capacity``. Within a
    sequence offsets have no gap; what is left of it is padding. Rows that repeat are packed
    each by itself, null ids too; other columns are ignored. An empty table gives an empty
    result. Which of two pieces of one length gets which sequence depends on the order of
    the rows read.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, vocabulary_file, end_id, capacity, id_col, text_col), "pack-pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        pattern_slots(pack_histogram(histogram, capacity)),
        "slot_length int, first_rank long, last_rank long, first_sequence long, offset long",
    )
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_before"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("rank_before") + F.col("part_rank"))
    fits = (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    return ranked.join(F.broadcast(slots), fits).select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        "offset",
    )
