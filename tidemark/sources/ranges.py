"""Digests of files of any length: ranges are read and hashed in parallel and combined to one root a file.

No row holds a file: a listing (without contents) gives lengths, each range is hashed by a task in pieces of PIECE bytes.
Over a file's range digests each run of FANOUT consecutive nodes becomes the digest of their hex text, joined, until one is
left. Files are named by their path below the folder. Spark's listing leaves out empty files, so they have no range: a file
that becomes empty has all its ranges removed.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .payloads import opened

RANGE, PIECE, FANOUT = 64 << 20, 1 << 20, 1024


def _hashed(batches):
    for batch in batches:
        digests = []
        for path, at, left in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "bytes"))):
            system, name = opened(path)
            digest = hashlib.sha256()
            with system.open_input_file(name) as file:
                file.seek(at)
                while left:
                    piece = file.read(min(left, PIECE))
                    if not piece:
                        raise OSError(f"{path} became shorter while it was read")
                    digest.update(piece)
                    left -= len(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("range"), batch.column("bytes"), pa.array(digests, pa.string())], names=["name", "range", "bytes", "sha256"])


def range_digests(spark: SparkSession, path: str, size: int = RANGE, pattern: str = "*") -> DataFrame:
    """(name, range, bytes, sha256) of every range of the files below a path whose names match."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    ranges = files.select("path", F.substring_index("path", f"/{tail}/", -1).alias("name"), "length", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("length") / size) - 1).cast("long"))).alias("range"))
    ranges = ranges.select("path", "name", "range", (F.col("range") * size).alias("start"), F.least(F.lit(size), F.col("length") - F.col("range") * size).cast("long").alias("bytes"))
    # Ranges of one long file go to all tasks.
    return ranges.repartition("name", "range").mapInArrow(_hashed, "name string, range long, bytes long, sha256 string")


def file_roots(ranges: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(name, n_ranges, bytes, root) from range digests."""
    whole = ranges.groupBy("name").agg(F.count("*").alias("n_ranges"), F.sum("bytes").alias("bytes"))
    nodes, left = ranges.select("name", F.col("range").alias("at"), "sha256"), (ranges.agg(F.max("range")).head()[0] or 0) + 1
    while left > 1:
        run = F.array_sort(F.collect_list(F.struct("at", "sha256")))
        nodes = nodes.join(whole.select("name", "n_ranges"), "name").groupBy("name", F.floor(F.col("at") / fanout).alias("at"), "n_ranges").agg(run.alias("run"))
        # A file of one range keeps its digest as the root.
        digest = F.when(F.col("n_ranges") == 1, F.col("run")[0]["sha256"]).otherwise(F.sha2(F.array_join(F.col("run.sha256"), ""), 256))
        nodes, left = nodes.select("name", "at", digest.alias("sha256")), -(-left // fanout)
    return whole.join(nodes.select("name", F.col("sha256").alias("root")), "name")


def range_changes(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(name, range, change) of ranges added, removed or changed since digests were frozen; empty if none."""
    a, b = (x.select("name", "range", F.col("sha256").alias(c)) for x, c in ((frozen, "old"), (now, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, ["name", "range"], "full").select("name", "range", change.alias("change")).where("change IS NOT NULL")
