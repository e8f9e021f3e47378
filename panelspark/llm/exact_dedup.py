"""Exact duplicates by skew-safe combining, in built-in functions only.

Equal texts meet in three steps, and each step groups by the digest *and* the full text:

1. locally: the partial aggregation before the shuffle leaves one row per text and task;
2. in salted groups: texts whose digest holds more than a thousandth of all rows are
   dealt to ``salts`` groups, all others to one;
3. globally: the winners of the salted groups are combined. Other texts have a single
   group, so nothing of them moves again.

Texts move once. Digests that hold a share of 1/hot_share or more number at most
``hot_share`` by arithmetic, which bounds what is broadcast, there and on the way back:
groups return to the rows by digest, a second hash and length. Where two texts agree in all
three, which the groups show as they were formed on the texts, the rows of these digests
return by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import hot_keys, join_to_one, materialise, text_or_empty, unused_name


def digest_of(text) -> Column:
    return F.unhex(F.sha2(text, 256))


def second_hash_of(text) -> Column:
    return F.xxhash64(text)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, hot_share: int = 1000
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, keep_copies.

    Texts are equal when identical; a null text counts as the empty one. The largest id of
    a group stays. Ids that are null lose against others; a group that has only null ids
    keeps null. ``keep_copies`` counts the group's rows that carry ``keep_id``: it is over 1
    only where whole rows repeat, all of which are marked as kept. Other columns of the
    input are ignored. An empty table gives an empty result.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("digest", digest_of("text"))
    identity = [second_hash_of("text").alias("second_hash"), F.octet_length("text").alias("n_bytes")]
    light = materialise(keyed.select("doc_id", "digest", *identity), "dedup-digests")

    hot = hot_keys(light, ["digest"], hot_share)
    is_hot = F.xxhash64("digest").isin(hot) if hot else F.lit(False)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    salted = keyed.withColumn("hot", is_hot).withColumn("salt", salt)
    best = lambda: [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    salt_winners = materialise(
        salted.groupBy("digest", "hot", "salt", "text")
        .agg(*best())
        .select("digest", "hot", *identity, F.when(F.col("hot"), F.col("text")).alias("text"), "keep_id", "group_size"),
        "dedup-salt-winners",
    )
    names = ["digest", "second_hash", "n_bytes", "keep_id", "group_size"]
    hot_winners = (
        salt_winners.where("hot")
        .groupBy("digest", "second_hash", "n_bytes", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    groups = salt_winners.where("not hot").select(names).unionByName(hot_winners.select(names))
    key = ["digest", "second_hash", "n_bytes"]
    clashing = materialise(groups.groupBy(*key).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select(*key), "dedup-clashes")
    clash = not clashing.isEmpty()
    groups = groups.where("group_size > 1")
    if clash:
        groups = groups.join(clashing, key, "left_anti")
    repeats = (
        light.groupBy("doc_id", *key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select(F.col("doc_id").alias("keep_id"), *key, "copies")
    )
    r = repeats.alias("r")
    g = groups.alias("g")
    same = [F.col(f"g.{k}") == F.col(f"r.{k}") for k in key] + [F.col("g.keep_id").eqNullSafe(F.col("r.keep_id"))]
    groups = g.join(r, same, "left").select(
        *[F.col(f"g.{k}") for k in names], F.coalesce("r.copies", F.lit(1)).alias("keep_copies")
    )
    whole = light.join(clashing, key, "left_anti") if clash else light
    joined = join_to_one(whole, groups, key, "left").select("doc_id", "digest", "keep_id", "group_size", "keep_copies")
    if clash:
        rows = keyed.select("doc_id", "digest", "text", *identity)
        rows = rows.join(clashing, key, "left_semi")
        of_text = rows.groupBy("text").agg(*best())
        copies = rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("keep_copies"))
        both = (of_text["text"] == copies["text"]) & of_text["keep_id"].eqNullSafe(copies["doc_id"])
        of_text = of_text.join(copies, both).select(of_text["text"], "keep_id", "group_size", "keep_copies")
        joined = joined.unionByName(rows.join(of_text, "text").select("doc_id", "digest", "keep_id", "group_size", "keep_copies"))
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.coalesce("keep_copies", F.lit(1)).cast("long").alias("keep_copies"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, with one row of each group of equal texts.

    The row with the largest id stays; of rows that repeat that id and text, one stays.
    """
    keep_id, sha = unused_name(docs, "keep_id"), unused_name(docs, "text_sha256")
    marks = exact_duplicates(docs, id_col, text_col).where("kept").select("doc_id", "text_sha256", "keep_copies")
    marks = materialise(marks, "dedup-kept").withColumnRenamed("doc_id", keep_id).withColumnRenamed("text_sha256", "kept_sha256")
    once = marks.where("keep_copies = 1")
    keyed = docs.withColumn(sha, F.sha2(text_or_empty(text_col), 256))
    same = lambda m: (keyed[sha] == m["kept_sha256"]) & keyed[id_col].eqNullSafe(m[keep_id])
    kept = keyed.join(once, same(once), "left_semi")
    many = marks.where("keep_copies > 1")
    if not many.isEmpty():
        kept = kept.unionByName(keyed.join(many, same(many), "left_semi").dropDuplicates([sha]))
    return kept.drop(sha)
