"""Tables in the folder that all executors share, and what goes with them."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share. Only a session on this machine alone may leave
    that unset: then it is a folder under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or "file:///tmp/checkpoints"


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession):
    """Executions in this block free their shuffle files as they end; a lost file is made again from its inputs."""
    old = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, old)


#: Bytes of an Arrow batch, and rows that a Parquet reader holds at once. Of Spark's own 10,000 rows of texts, up to 64 MB,
#: each task has copies in the JVM outside its heap and another in its worker.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22), "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def small_batches(spark: SparkSession) -> None:
    """Texts pass to Python some MB at a time. Results are lazy, so this stays set; what the session sets itself holds."""
    for key, value in _BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


_kept: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts lineage and survives lost executors.

    Results are lazy, so the table stays until discard(), release() or the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    _kept[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _kept.pop(path, None)


def discard(df: DataFrame) -> None:
    """Remove a table made by written() that nothing lazy needs any more."""
    _remove(df.sparkSession, df._tidemark_path)


def release() -> None:
    """Remove every table made by written(); results not yet computed are lost."""
    for path, spark in list(_kept.items()):
        with contextlib.suppress(Exception):  # at the end of the program the session may have gone
            _remove(spark, path)


atexit.register(release)


#: Rows up to which a counted table is broadcast.
MAX_BROADCAST = 100_000


def small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """df as a table, marked for broadcast where it has at most so many rows; beyond that joins shuffle."""
    df = written(df, "small")
    return F.broadcast(df) if df.count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
