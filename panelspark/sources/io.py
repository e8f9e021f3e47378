"""Reports, datasets and models on shared storage."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ensure_checkpoints(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in a local session without one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder and read back; cuts its lineage."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def write_dataset(frame: DataFrame, path: str, partition: str) -> None:
    frame.write.partitionBy(partition).parquet(path)


def read_dataset(spark: SparkSession, path: str, universe: DataFrame | None = None, stock: str = "stock") -> DataFrame:
    """A stored dataset, only the stocks of the present universe."""
    frame = spark.read.parquet(path)
    return frame if universe is None else frame.join(universe.select(stock), stock, "left_semi")


def write_report(frame: DataFrame, path: str, kind: str = "csv") -> None:
    frame.write.csv(path, header=True) if kind == "csv" else frame.write.json(path)


def read_report(spark: SparkSession, path: str, schema: StructType, kind: str = "csv") -> DataFrame:
    """A report, or an empty table of its schema where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema) if kind == "csv" else spark.read.json(path, schema=schema)


#: The columns of the stored reports.
METRIC_NAMES = ["roc_auc", "directional_accuracy", "balanced_accuracy", "precision", "recall", "f1", "up_signal_precision", "up_rate_top_quintile",
                "up_rate_bottom_quintile", "up_rate", "majority_baseline_accuracy", "log_loss", "brier_score", "rmse_probability", "n"]


def _metric_columns(prefix: str) -> str:
    return ", ".join(f"{prefix}_{n} {'long' if n == 'n' else 'double'}" for n in METRIC_NAMES)


REPORTS = {
    "experiments": f"experiment string, model string, config string, iterations int, n_features int, cv_auc double, cv_fold_aucs string, {_metric_columns('val')}, {_metric_columns('test')}",
    "feature_selection": "feature string, correlation_score double, mutual_information double, model_importance_gain double, model_importance_split double, permutation_importance double, permutation_positive_folds double, shap_importance double, shap_mean_signed double, votes int, selected boolean, removal_reason string",
    "correlation": "a string, b string, rho double",
    "ablation": f"variant string, n_features int, cv_auc double, cv_fold_aucs string, {_metric_columns('test')}",
    "equity_curve": "d date, equity double, positions long, turnover double, cost double, period_return double, benchmark_equity double",
    "trades": "entry_date date, exit_date date, stock string, weight double, gross_return double, net_return double, cost double",
    "predictions": "d date, stock string, y int, p double",
    "audit": "feature string, reason string",
}


def read_named_report(spark: SparkSession, folder: str, name: str, kind: str = "csv") -> DataFrame:
    """One of REPORTS with its own columns and types; an empty table where it hasn't been written."""
    return read_report(spark, f"{folder}/{name}", StructType.fromDDL(REPORTS[name]), kind)


def merge_metrics(old: DataFrame, new: DataFrame, key: str = "horizon") -> DataFrame:
    """New rows replace the old ones of the same key, others stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the committed versions, in order."""
    files, where = _folder(spark, f"{path}/manifests")
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def _write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place, then renamed to it."""
    files, where = _folder(spark, path)
    files.mkdirs(where.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_{uuid.uuid4().hex}")
    out = files.create(draft)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    if files.exists(where) or not files.rename(draft, where):
        files.delete(draft, False)
        raise FileExistsError(path)


def save_model(model, path: str, metadata: dict[str, str]) -> int:
    """Keep a fitted pipeline, and what it was made of, as the next version under ``path``; its number.

    The pipeline goes to a folder of its own; a manifest that names the folder and holds the
    metadata is committed last, under the next free number. Until then nobody meets the version;
    of two writers one takes the number and the other the one after it. Earlier versions stay.
    """
    spark = SparkSession.active()
    folder = f"{path}/versions/{uuid.uuid4().hex}"
    model.write().save(f"{folder}/model")
    text = json.dumps({"folder": folder, "metadata": {k: str(v) for k, v in metadata.items()}})
    while True:
        number = max(_manifests(spark, path), default=0) + 1
        try:
            _write_small(spark, f"{path}/manifests/{number:08d}.json", text)
            return number
        except FileExistsError:
            continue


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, key, value: the metadata of every committed version."""
    rows = [(n, k, v) for n in _manifests(spark, path) for k, v in _manifest(spark, path, n)["metadata"].items()]
    return spark.createDataFrame(rows, "version int, key string, value string")


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    """One small JSON file."""
    lines = spark.read.text(f"{path}/manifests/{number:08d}.json", wholetext=True).collect()
    return json.loads(lines[0][0])


def load_model(spark: SparkSession, path: str, needed: tuple[str, ...] = (), version: int | None = None):
    """(pipeline, metadata) of the latest committed version, or of the one asked for.

    FileNotFoundError where there is none, ValueError where its metadata lacks a needed key.
    """
    from pyspark.ml import PipelineModel

    there = _manifests(spark, path)
    if not there or version not in (None, *there):
        raise FileNotFoundError(f"{path}: no model" if version is None else f"{path}: no version {version}")
    manifest = _manifest(spark, path, version or there[-1])
    metadata = manifest["metadata"]
    if missing := [k for k in needed if k not in metadata]:
        raise ValueError(f"{path}: the model's metadata has no {', '.join(missing)}")
    return PipelineModel.load(f"{manifest['folder']}/model"), metadata


def replace_partitions(frame: DataFrame, path: str, partition: str) -> None:
    """Write a dataset anew for the partitions that ``frame`` has; the files of the others stay as they are."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_bucketed(frame: DataFrame, name: str, path: str, by: str = "stock", order: str = "d", buckets: int = 64) -> DataFrame:
    """A table of the catalog over files in ``path``, laid out for windows by ``by``: joins and windows over it need no
    exchange by that key."""
    frame.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by, order).format("parquet").option("path", path).saveAsTable(name)
    return frame.sparkSession.table(name)
