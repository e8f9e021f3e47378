"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "embeddings", "labels", "benchmark", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from wherever ``sf_dir`` points."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` that driver and executors share.

    Only where the setting is missing in a local session (tests) a folder of our own is set
    for the session's context; on a cluster a missing setting is an error, as executors
    can't see the driver's folders.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of an executor without running
    the steps before again, and values that depend on the layout of partitions are fixed.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for tables that no plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused_name(df: DataFrame, name: str = "helper") -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text"):
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(doc_id):
    """True for the documents whose labels no model may see: crc32 of the id as text, mod 5, is 0.

    A null id has no label to hide, so it is False.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT_SHARE, HOT_ROWS = 1000, 200


def hot_keys(rows: DataFrame, key: list[str], share: int = HOT_SHARE) -> list[int]:
    """Hashes (xxhash64 of the key) of the keys that hold a ``share``-th of all rows or more, and over HOT_ROWS.

    They number at most ``share`` by arithmetic.
    """
    total = rows.count()
    if total <= HOT_ROWS:
        return []
    return hot_among(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key, total, share)


def hot_among(counts: DataFrame, key: list[str], total: int, share: int = HOT_SHARE) -> list[int]:
    """hot_keys of ``total`` rows, of which ``counts`` has ``n`` for each key."""
    if total <= HOT_ROWS:
        return []
    hot = counts.where((F.col("n") > HOT_ROWS) & (F.col("n") * share >= total))
    return [r[0] for r in hot.select(F.xxhash64(*key)).collect()]


def join_to_one(rows: DataFrame, one: DataFrame, key: list[str], how: str = "inner", hot: list[int] | None = None) -> DataFrame:
    """``rows`` with the columns of ``one``, which has a row for each key at most.

    Rows of a hot key stay where they are and meet its row by broadcast, which hot_keys
    bounds; only the others are shuffled by the key. ``how``: inner, left or left_semi.
    ``rows`` is read several times, so it should be cheap to read; hot keys that are given
    needn't be found again.
    """
    if hot is None:
        hot = hot_keys(rows, key)
    if not hot:
        return rows.join(one, key, how)
    is_hot = F.xxhash64(*key).isin(hot)
    near = rows.where(is_hot).join(F.broadcast(one.where(is_hot)), key, how)
    return near.unionByName(rows.where(~is_hot).join(one.where(~is_hot), key, how))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this subpackage importable in the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "training_data_operators.zip")
    with zipfile.ZipFile(archive, "w") as z:
        z.write(here.parent / "__init__.py", f"{here.parent.name}/__init__.py")
        for f in sorted(here.glob("*.py")):
            z.write(f, f"{here.parent.name}/{here.name}/{f.name}")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def forget_encoders() -> None:
    """Give back what a worker keeps of texts that it encoded before."""
    tokens = sys.modules.get("panelspark.llm.tokens")
    if tokens is not None and tokens.encoder.cache_info().currsize:
        tokens.encoder.cache_clear()
        gc.collect()


def map_batches(df: DataFrame, run, schema: str, encodes: bool = False) -> DataFrame:
    """``df.mapInArrow``, with this subpackage at hand in the workers.

    Workers live through many stages. Only work that ``encodes`` finds the pieces of text that an
    encoder has kept; other work begins without them, so they don't add to its own memory.
    """
    ship(df.sparkSession)

    def fresh(batches):
        if not encodes:
            forget_encoders()
        yield from run(batches)

    return df.mapInArrow(fresh, schema)
