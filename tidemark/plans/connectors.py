"""Payload files as a data source, and digests of files in ranges; files are written from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as FS
from ..sources import payloads as P
from ..sources import ranges as R
from ..sources.market import bars, table
from .registry import query
from .views import BARS, q6, r6, sql

_VALUE = "round(floor(close_bid / 0.001 + 0.5) * 0.001, 6) + 0.0"
_FROM, _TO = "2024-01-05", "2024-01-10"


def payload_folder(spark, sf):
    """Closing bids of all bars as payloads, a file a date."""
    path = FS.staging(spark, "payloads")
    P.write_payloads(bars(spark, sf), "bar", "close_bid", 0.001, path)
    P.register(spark)
    return path


@query("source_payloads", sql(BARS, f"SELECT bar::DATE AS date, (epoch(bar) // 60)::BIGINT AS minute, {_VALUE} AS value FROM bars"))
def source_payloads(spark, sf):
    return spark.read.format(P.FORMAT).load(payload_folder(spark, sf)).select("date", "minute", r6("value", "value"))


@query("source_payloads_period", sql(BARS, f"SELECT bar::DATE AS date, count(*) AS n, {q6(f'sum({_VALUE})', 'total')} FROM bars WHERE bar::DATE BETWEEN DATE '{_FROM}' AND DATE '{_TO}' GROUP BY 1"))
def source_payloads_period(spark, sf):
    """Only the files of the period are opened."""
    rows = spark.read.format(P.FORMAT).load(payload_folder(spark, sf)).where(F.col("date").between(F.lit(_FROM).cast("date"), F.lit(_TO).cast("date")))
    return rows.groupBy("date").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))


_SIZE = 4096
_RANGES = f"""WITH lines AS (SELECT ts::DATE AS date, event_id, event_id || ',' || user_id || ',' || event_type || chr(10) AS line, event_id || ',' || user_id || ',' || CASE WHEN event_id % 1000 = 7 THEN upper(event_type) ELSE event_type END || chr(10) AS line2 FROM events),
whole AS (SELECT date, string_agg(line, '' ORDER BY event_id, line) AS a, string_agg(line2, '' ORDER BY event_id, line2) AS b FROM lines GROUP BY 1),
cut AS (SELECT date, i AS range, substr(a, i * {_SIZE} + 1, {_SIZE}) AS a, substr(b, i * {_SIZE} + 1, {_SIZE}) AS b FROM (SELECT *, unnest(range((length(a) + {_SIZE - 1}) // {_SIZE})) AS i FROM whole)),
ranges AS (SELECT date::VARCHAR AS date, range, length(a)::BIGINT AS bytes, sha256(a) AS sha256, a <> b AS differs FROM cut)"""


def _digests(spark, sf, tampered=False):
    """Range digests of all events as text, a file a date."""
    kind = F.when(F.col("event_id") % 1000 == 7, F.upper("event_type")).otherwise(F.col("event_type")) if tampered else F.col("event_type")
    e = table(spark, sf, "events").select(F.to_date("ts").alias("date"), "event_id", F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), kind).alias("value"))
    path = FS.staging(spark, "lines")
    e.repartition("date").sortWithinPartitions("date", "event_id", "value").select("date", "value").write.partitionBy("date").text(path)
    found = R.range_digests(spark, path, _SIZE, "part-*")
    return found.withColumn("name", F.regexp_extract("name", "date=([0-9-]+)/", 1))


@query("file_range_digests", f"{_RANGES} SELECT date, range, bytes, sha256 FROM ranges")
def file_range_digests(spark, sf):
    return _digests(spark, sf).withColumnRenamed("name", "date")


#: Its SQL combines files of up to FANOUT ranges.
@query("file_roots", f"{_RANGES} SELECT date, count(*) AS n_ranges, sum(bytes)::BIGINT AS bytes, CASE WHEN count(*) = 1 THEN min(sha256) ELSE sha256(string_agg(sha256, '' ORDER BY range)) END AS root FROM ranges GROUP BY 1")
def file_roots(spark, sf):
    return R.file_roots(FS.temporary(_digests(spark, sf), "digests")).withColumnRenamed("name", "date")


@query("file_range_changes", f"{_RANGES} SELECT date, range, 'changed' AS change FROM ranges WHERE differs")
def file_range_changes(spark, sf):
    """Every thousandth event's type is written in capitals: just the ranges that hold one are named."""
    return R.range_changes(_digests(spark, sf), _digests(spark, sf, tampered=True)).withColumnRenamed("name", "date")
