"""Session settings and durable cut points."""

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


WIDE = 20_000


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on; nothing here depends on the data size."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if conf.get("spark.sql.shuffle.partitions") == "200" and conf.get(first, None) is None and spark.sparkContext.defaultParallelism > 100:
        # untouched default on a large cluster: start wide; adaptive execution merges small
        # partitions again, but cannot split those of an aggregate
        conf.set(first, str(WIDE))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for durable intermediate results.

    The cluster names it in ``spark.checkpoint.dir``. Only a ``local`` or ``local[...]`` master, where
    all tasks run in this process, may go without: then a temporary folder is used until the
    process ends. Anywhere else a machine's own folder would lose rows, so this raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            current = tempfile.mkdtemp(prefix="saldoscope-ckpt-")
            atexit.register(shutil.rmtree, current, ignore_errors=True)
        sc.setCheckpointDir(current)
    return current


def _store(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _store(spark, path)
    return store.exists(target)


def stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of what lies in a folder; changes when its content does."""
    store, target = _store(spark, path)
    if not store.exists(target):
        return ""
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in store.listStatus(target)))


def drop(df: DataFrame) -> None:
    """Remove a table that ``durable`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        store, target = _store(spark, path)
        store.delete(target, True)


def durable(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    The lineage is cut at a columnar table: later reads prune columns and push filters, and
    a lost executor costs a re-read of its blocks only.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
