"""Readers, writers and manifests of market files.

Everything goes through Spark's readers and writers, so paths may be in any store that Spark reaches.
"""

from __future__ import annotations

import atexit
import contextlib
import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE_CSV = "timestamp long, open double, high double, low double, close double"
CANDLES = "struct<instrument:string,granularity:string,candles:array<struct<time:string,complete:boolean,volume:long,bid:struct<o:string,h:string,l:string,c:string>,ask:struct<o:string,h:string,l:string,c:string>>>>"


def staging(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir. Only a session on this machine alone may
    leave that unset: then it is a folder under /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, kind: str = "parquet", **options) -> str:
    path = staging(df.sparkSession, name)
    df.write.format(kind).options(**options).save(path)
    return path


#: Paths alone: modules travel to Python workers with what they hold, and a session can't.
_temporary: list[str] = []


def temporary(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts lineage and survives lost executors. The table
    stays until release() or the end of the program, since results are lazy."""
    path = staged(df, name)
    _temporary.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Remove every table made by temporary(); results not yet computed are lost."""
    spark = SparkSession.getActiveSession()
    while _temporary:
        path = _temporary.pop()
        if spark is not None:
            with contextlib.suppress(Exception):  # at the end of the program the session may have gone
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(release)


def read_side_csv(spark: SparkSession, path: str) -> DataFrame:
    """(bar, side, open, high, low, close) from CSV files of one price side each; the side is in the path."""
    rows = spark.read.schema(SIDE_CSV).csv(path, header=True, enforceSchema=False, recursiveFileLookup=True)
    side = F.regexp_extract(F.input_file_name(), "side_(bid|ask)", 1)
    return rows.select(F.timestamp_millis("timestamp").cast("timestamp_ntz").alias("bar"), side.alias("side"), "open", "high", "low", "close")


def candles_json(documents: DataFrame, column: str = "doc") -> DataFrame:
    """Complete candles of nested documents as rows; prices are strings there."""
    c = F.explode(F.from_json(column, CANDLES)["candles"])
    rows = documents.select(c.alias("c")).where("c.complete")
    price = lambda s, f, n: F.col(f"c.{s}.{f}").cast("double").alias(f"{n}_{s}")
    return rows.select(F.col("c.time").cast("timestamp_ntz").alias("bar"), *[price(s, f, n) for s in ("bid", "ask") for f, n in zip("ohlc", ("open", "high", "low", "close"))], F.col("c.volume").alias("volume"))


def encode_delta(rows: DataFrame, key: str, ts: str, value: str, multiplier: float) -> DataFrame:
    """(key, start, multiplier, times, values): minutes and price units as differences, one row a key."""
    units = F.floor(F.col(value) / multiplier + 0.5).cast("long")
    minute = (F.unix_timestamp(F.col(ts).cast("timestamp")) / 60).cast("long")
    order = Window.partitionBy(key).orderBy(ts)
    d = rows.select(key, minute.alias("m"), units.alias("u"), ts).withColumns({"dm": F.col("m") - F.coalesce(F.lag("m").over(order), F.min("m").over(Window.partitionBy(key))), "du": F.col("u") - F.coalesce(F.lag("u").over(order), F.lit(0))})
    packed = d.groupBy(key).agg(F.min("m").alias("start"), F.array_sort(F.collect_list(F.struct("m", "dm", "du"))).alias("x"))
    return packed.select(key, "start", F.lit(multiplier).alias("multiplier"), F.col("x.dm").alias("times"), F.col("x.du").alias("values"))


def decode_delta(rows: DataFrame, key: str) -> DataFrame:
    """(key, minute, value) from delta-coded arrays of equal length; unequal lengths fail."""
    same = F.when(F.size("times") == F.size("values"), F.arrays_zip("times", "values")).otherwise(F.raise_error(F.lit("arrays of unequal length")))
    at = rows.select(key, "start", "multiplier", F.posexplode(same).alias("pos", "x"))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return at.select(key, (F.col("start") + F.sum("x.times").over(upto)).alias("minute"), (F.sum("x.values").over(upto) * F.col("multiplier")).alias("value"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_changes(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(name, change) of files added, removed or changed since a manifest was frozen; empty if none."""
    a, b = frozen.select("name", F.col("sha256").alias("old")), now.select("name", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "name", "full").select("name", change.alias("change")).where("change IS NOT NULL")


def verify(rows: DataFrame, expected: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows whose digest is not the manifest's; the manifest has key and sha256."""
    digest = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
    return rows.select(key, digest.alias("sha256")).join(expected, [key, "sha256"], "left_anti")


def append_once(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing and those new rows whose key it lacks: running it twice adds nothing."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def guard_dates(first: datetime.date, last: datetime.date, allowed: tuple[datetime.date, datetime.date]) -> None:
    """Refuse a window that is empty or leaves the allowed dates."""
    if first > last:
        raise ValueError(f"empty window {first} .. {last}")
    if first < allowed[0] or last > allowed[1]:
        raise ValueError(f"{first} .. {last} leaves {allowed[0]} .. {allowed[1]}")


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def loader(name: str):
    def add(f):
        LOADERS[name] = f
        return f

    return add


@loader("events")
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("date"), F.col("value"))


@loader("orders")
def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"))


def load(provider: str, spark: SparkSession, sf_dir: str, first: datetime.date, last: datetime.date, allowed: tuple[datetime.date, datetime.date]) -> DataFrame:
    """A provider's (date, value) rows of a guarded window; the dates reach the scan as filters."""
    if provider not in LOADERS:
        raise ValueError(f"no provider {provider}; there are {sorted(LOADERS)}")
    guard_dates(first, last, allowed)
    return LOADERS[provider](spark, sf_dir).where(F.col("date").between(F.lit(first), F.lit(last)))


class HoldoutLock:
    """A one-shot gate: a holdout may be opened once for each marker table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def opened(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def open(self, reason: str) -> None:
        if self.opened():
            raise PermissionError("the holdout has been opened before")
        self.spark.createDataFrame([(reason,)], "reason string").coalesce(1).write.mode("errorifexists").json(self.path)
