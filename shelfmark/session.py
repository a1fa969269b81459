"""Session helpers: table loading, durable lineage cuts and shared scratch folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "shelfmark") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table, split as the session's ``spark.sql.files`` settings say."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over all shuffle partitions.

    The number is given, so that adaptive execution does not put few bytes of much work, or of much memory, together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table dealt out by ``key``, for long work on each row: a file of one row group is one task's, however many rows it has."""
    return dealt(table(spark, folder, name), key)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of Arrow batches for whole texts, unless the session has smaller bounds.

    The defaults of 10,000 rows and 64 MB can be hundreds of megabytes of text in several copies per worker.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = int(spark.conf.get(name).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, most)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine: on a
    cluster such a folder would vanish with the executor that wrote it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="shelfmark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has written yet, below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that a lost executor costs no recompute."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str, folders: Sequence[str] = ()) -> DataFrame:
    """``df`` as a parquet table in the shared folder, in ``folders`` by these last columns, dropped when the application ends.

    Like ``cut_lineage`` a lost executor costs no recompute; later reads can prune columns and rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*folders).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
