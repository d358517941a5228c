"""Scans, sinks, manifests and guards."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..sources import files as FS
from ..sources.market import FIELDS, bars, daily, quotes, table
from .registry import query
from .views import BARS, DAILY, QUOTES, q6, r6, sql


def _ms(c="bar"):
    return F.unix_millis(F.col(c).cast("timestamp"))


@query("scan_csv_pair", sql(BARS, f"SELECT bar, {q6('open_bid', 'open_bid')}, {q6('close_bid', 'close_bid')}, {q6('open_ask', 'open_ask')}, {q6('close_ask', 'close_ask')} FROM bars"))
def scan_csv_pair(spark, sf):
    b = bars(spark, sf)
    root = FS.staging(spark, "csv-pair")
    for s in ("bid", "ask"):
        b.select(_ms().alias("timestamp"), *[F.col(f"{f}_{s}").alias(f) for f in FIELDS]).write.csv(f"{root}/side_{s}", header=True)
    rows = FS.read_side_csv(spark, root)
    pair = rows.groupBy("bar").agg(*[F.max(F.when(F.col("side") == s, F.col(f))).alias(f"{f}_{s}") for s in ("bid", "ask") for f in ("open", "close")])
    return pair.select("bar", *[r6(c, c) for c in ("open_bid", "close_bid", "open_ask", "close_ask")])


@query("scan_parquet", f"SELECT event_type, count(*) AS n, {q6('sum(value)', 'total')} FROM events WHERE value > 50 GROUP BY 1")
def scan_parquet(spark, sf):
    # Two columns are read and the filter reaches the scan.
    return table(spark, sf, "events").where("value > 50").groupBy("event_type").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))


@query("scan_csv_ledger", sql(DAILY, f"SELECT date, {q6('a', 'a')}, {q6('d', 'd')} FROM daily"))
def scan_csv_ledger(spark, sf):
    path = FS.staged(daily(spark, sf).select("date", "a", "d"), "ledger", "csv", header=True)
    return spark.read.schema("date date, a double, d double").csv(path, header=True).select("date", r6("a", "a"), r6("d", "d"))


def _documents(spark, sf):
    b = bars(spark, sf)
    side = lambda s: F.struct(*[F.col(f"{f}_{s}").cast("string").alias(f[0]) for f in FIELDS])
    candle = F.struct(F.col("bar").cast("string").alias("time"), (F.col("quote_count") > 1).alias("complete"), F.col("quote_count").alias("volume"), side("bid").alias("bid"), side("ask").alias("ask"))
    return b.groupBy(F.to_date("bar").alias("date")).agg(F.to_json(F.struct(F.lit("X").alias("instrument"), F.lit("M15").alias("granularity"), F.collect_list(candle).alias("candles"))).alias("doc"))


@query("scan_json_candles", sql(BARS, f"SELECT bar, {q6('open_bid', 'open_bid')}, {q6('close_ask', 'close_ask')}, quote_count AS volume FROM bars WHERE quote_count > 1"))
def scan_json_candles(spark, sf):
    return FS.candles_json(_documents(spark, sf)).select("bar", r6("open_bid", "open_bid"), r6("close_ask", "close_ask"), "volume")


@query("scan_gzip_json", sql(BARS, "SELECT count(*) AS n, sum(quote_count)::BIGINT AS volume FROM bars WHERE quote_count > 1"))
def scan_gzip_json(spark, sf):
    path = FS.staged(_documents(spark, sf).select(F.col("doc").alias("value")), "candles", "text", compression="gzip")
    docs = spark.read.text(path).withColumnRenamed("value", "doc")
    return FS.candles_json(docs).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("decode_delta", sql(BARS, "SELECT bar::DATE AS date, (epoch(bar) // 60)::BIGINT AS minute, round(floor(close_bid / 0.001 + 0.5) * 0.001, 6) + 0.0 AS value FROM bars"))
def decode_delta(spark, sf):
    b = bars(spark, sf).withColumn("date", F.to_date("bar"))
    return FS.decode_delta(FS.encode_delta(b, "date", "bar", "close_bid", 0.001), "date").select("date", "minute", r6("value", "value"))


@query("provider_dispatch", f"SELECT 'events' AS provider, count(*) AS n, {q6('sum(value)', 'total')} FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-10' UNION ALL SELECT 'orders', count(*), {q6('sum(o_totalprice)', 'total')} FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'")
def provider_dispatch(spark, sf):
    d = datetime.date
    a = FS.load("events", spark, sf, d(2024, 1, 5), d(2024, 1, 10), (d(2024, 1, 1), d(2024, 12, 31)))
    b = FS.load("orders", spark, sf, d(1997, 1, 1), d(1997, 6, 30), (d(1995, 1, 1), d(2001, 12, 31)))
    one = lambda x, n: x.agg(F.count("*").alias("n"), r6(F.sum("value"), "total")).select(F.lit(n).alias("provider"), "n", "total")
    return one(a, "events").unionByName(one(b, "orders"))


@query("verify_sha256", "SELECT n_nationkey FROM nation WHERE n_nationkey % 5 = 3")
def verify_sha256(spark, sf):
    n = table(spark, sf, "nation")
    digest = F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name"), 256)
    expected = n.select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 3, F.lit("tampered")).otherwise(digest).alias("sha256"))
    return FS.verify(n, expected, "n_nationkey", "n_nationkey", "n_name").select("n_nationkey")


@query("row_digests", "SELECT n_nationkey, sha256(n_nationkey::VARCHAR || '|' || n_name) AS sha256 FROM nation")
def row_digests(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name"), 256).alias("sha256"))


@query("source_inventory", "SELECT ts::DATE AS date, count(*) AS n, count(*) FILTER (event_type = 'error')::BIGINT AS errors, min(ts) AS first, max(ts) AS last, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1")
def source_inventory(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum(F.length("props")).cast("long").alias("bytes"))


@query("html_catalog_years", """SELECT href, count(*) AS n, min(num) AS least FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS num FROM pages) GROUP BY 1""")
def html_catalog_years(spark, sf):
    p = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"), F.regexp_extract("url", "/([0-9]+)", 1).cast("long").alias("num"))
    return p.groupBy("href").agg(F.count("*").alias("n"), F.min("num").alias("least"))


@query("json_deep_search", "SELECT k AS key, count(*) AS n, max(CAST(json_extract_string(props, '$.' || k) AS BIGINT)) AS largest FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def json_deep_search(spark, sf):
    e = table(spark, sf, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return e.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("v").cast("long")).alias("largest"))


_SINK = sql(BARS, f"SELECT bar, {q6('close_bid', 'close_bid')}, CASE WHEN quote_count > 3 THEN quote_count END AS busy FROM bars")


def _sunk(spark, sf, kind, **options):
    rows = bars(spark, sf).select("bar", r6("close_bid", "close_bid"), F.when(F.col("quote_count") > 3, F.col("quote_count")).alias("busy"))
    path = FS.staged(rows, f"sink-{kind}", kind, **options)
    return spark.read.schema("bar timestamp_ntz, close_bid double, busy long").format(kind).options(**options).load(path)


@query("sink_csv", _SINK)
def sink_csv(spark, sf):
    return _sunk(spark, sf, "csv", header=True)


@query("sink_parquet", _SINK)
def sink_parquet(spark, sf):
    return _sunk(spark, sf, "parquet")


@query("sink_json", _SINK)
def sink_json(spark, sf):
    # Undefined numbers are null: JSON has no NaN.
    return _sunk(spark, sf, "json")


@query("sink_npz", sql(DAILY, f"SELECT year(date)::INTEGER AS year, count(a)::INTEGER AS n, {q6('sum(a)', 'total')} FROM daily GROUP BY 1"))
def sink_npz(spark, sf):
    """Simulation arrays as Parquet lists instead of array archives."""
    rows = daily(spark, sf).groupBy(F.year("date").alias("year")).agg(F.collect_list("a").alias("a"))
    path = FS.staged(rows, "arrays")
    back = spark.read.schema("year int, a array<double>").parquet(path)
    return back.select("year", F.size("a").alias("n"), r6(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), "total"))


@query("manifest_append", "SELECT event_type AS label, min(event_id) AS first FROM events WHERE event_id < 500 AND event_type IN ('view', 'click') GROUP BY 1 UNION ALL SELECT event_type, min(event_id) FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def manifest_append(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(F.min("event_id").alias("first"))
    old = e.where(F.col("label").isin("view", "click"))
    return FS.append_once(FS.append_once(old, e, "label"), e, "label")


@query("date_guard", "SELECT * FROM (VALUES ('inside', true), ('early', false), ('late', false), ('empty', false)) x(window_name, allowed)")
def date_guard(spark, sf):
    d = datetime.date
    tried = {"inside": (d(2024, 1, 2), d(2024, 1, 3)), "early": (d(2023, 12, 31), d(2024, 1, 3)), "late": (d(2024, 1, 2), d(2025, 1, 1)), "empty": (d(2024, 1, 3), d(2024, 1, 2))}

    def ok(a, b):
        try:
            FS.guard_dates(a, b, (d(2024, 1, 1), d(2024, 12, 31)))
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(k, ok(*v)) for k, v in tried.items()], "window_name string, allowed boolean")


@query("freeze_manifest", None)
def freeze_manifest(spark, sf):
    path = FS.staged(table(spark, sf, "nation").coalesce(1), "freeze", "csv", header=True)
    frozen = FS.manifest(spark, path)
    return frozen.where("name LIKE 'part-%'").select("bytes", "sha256").withColumn("changes", F.lit(FS.manifest_changes(frozen, FS.manifest(spark, path)).count()))


@query("bundle_manifest", None)
def bundle_manifest(spark, sf):
    path = FS.staged(table(spark, sf, "orders").repartition(4, "o_orderkey"), "bundle")
    return FS.manifest(spark, path).where("name LIKE 'part-%'").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_distinct("sha256").alias("digests"))


@query("secret_scan", "SELECT source, count(*) AS n FROM documents WHERE contains(text, 'token = \"') GROUP BY 1")
def secret_scan(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").contains('token = "')).groupBy("source").agg(F.count("*").alias("n"))


@query("holdout_lock", "SELECT * FROM (VALUES (1, true), (2, false)) x(attempt, opened)")
def holdout_lock(spark, sf):
    lock, seen = FS.HoldoutLock(spark, FS.staging(spark, "holdout")), []
    for k in (1, 2):
        try:
            lock.open("evaluation")
            seen.append((k, True))
        except PermissionError:
            seen.append((k, False))
    return spark.createDataFrame(seen, "attempt int, opened boolean")
