"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "axisframe", master: str = "local[8]", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        # Vector means by phrase: keep hashing instead of sorting after 128 keys.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "10000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; only local runs may pick their own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="axisframe-checkpoint-")
    context.setCheckpointDir(named)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables, below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


_tables: dict[str, SparkSession] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage, so a lost executor cannot change the rows (range bounds, for one, are
    sampled anew on every run), computes them once, and gives later joins the real size. The table
    belongs to the session: ``discard`` drops it when nothing reads it any more, ``release`` drops all
    once a result has been written, and the end of the driver drops what is left.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "table")
    df.write.parquet(path)
    if not _tables:
        atexit.register(release)
    _tables[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(path: str, spark: SparkSession) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame) -> None:
    """Drop materialized tables that no later step reads."""
    for frame in frames:
        path = getattr(frame, "_scratch", None)
        if path in _tables:
            _delete(path, _tables.pop(path))


def release() -> None:
    """Drop all materialized tables; call it when the results that read them have been written."""
    while _tables:
        path, spark = _tables.popitem()
        try:
            _delete(path, spark)
        except Exception:  # the session or its gateway is gone; its folder is the cluster's to clean
            continue


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan of too few partitions one task per core; larger inputs stay as they are.

    A file that holds a single row group is one task however many cores wait. On a large table
    the scan already has more partitions than cores, so no shuffle is added there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
