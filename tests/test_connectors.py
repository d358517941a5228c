import datetime
import hashlib

from pyspark.sql import functions as F

from tidemark.sources import payloads as P
from tidemark.sources import ranges as R


def payloads(spark, path, first, days):
    rows = [(datetime.datetime(2024, 1, first + d, 9, m), 100 + d + m / 8) for d in range(days) for m in range(0, 20, 5)]
    P.register(spark)
    P.write_payloads(spark.createDataFrame(rows, "bar timestamp_ntz, bid double"), "bar", "bid", 0.125, path)
    return sorted((t.date(), int((t - datetime.datetime(1970, 1, 1)).total_seconds()) // 60, v) for t, v in rows)


def test_filters_choose_files(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    want = payloads(spark, path, 1, 6)
    df = spark.read.format(P.FORMAT).load(path)
    assert df.rdd.getNumPartitions() == 6 and sorted(map(tuple, df.collect())) == want
    some = df.where((F.col("date") >= datetime.date(2024, 1, 3)) & (F.col("date") < datetime.date(2024, 1, 5)) & (F.col("value") > 102.5))
    assert some.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, some.collect())) == [r for r in want if datetime.date(2024, 1, 3) <= r[0] < datetime.date(2024, 1, 5) and r[2] > 102.5]
    assert df.where(F.col("date") == datetime.date(2030, 1, 1)).count() == 0


def test_stream_gives_new_files_once(spark, tmp_path):
    path, out = f"file://{tmp_path}/p", str(tmp_path / "out")

    def run():
        q = spark.readStream.format(P.FORMAT).load(path).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        q.awaitTermination(60)
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    want = payloads(spark, path, 1, 2)
    assert run() == want
    P.write_payloads(spark.createDataFrame([(datetime.datetime(2024, 1, 9, 9, 0), 7.5)], "bar timestamp_ntz, bid double"), "bar", "bid", 0.125, f"{path}/more")
    got = run()
    assert len(got) == len(want) + 1 and got[-1][0] == datetime.date(2024, 1, 9) and run() == got


def test_one_byte_changed_names_one_range(spark, tmp_path):
    folder = tmp_path / "f"
    (folder / "in").mkdir(parents=True)
    content = bytes(range(256)) * 20
    (folder / "in" / "a.bin").write_bytes(content)
    (folder / "empty.bin").write_bytes(b"")
    before = spark.createDataFrame(R.range_digests(spark, f"file://{folder}", 1000).collect())
    assert sorted((r["name"], r["range"], r["bytes"], r["sha256"]) for r in before.collect()) == [("in/a.bin", i, len(content[i * 1000 : i * 1000 + 1000]), hashlib.sha256(content[i * 1000 : i * 1000 + 1000]).hexdigest()) for i in range(6)]
    level = [hashlib.sha256(content[i * 1000 : i * 1000 + 1000]).hexdigest() for i in range(6)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]
    assert {r["name"]: r["root"] for r in R.file_roots(before, 2).collect()} == {"in/a.bin": level[0]}
    (folder / "in" / "a.bin").write_bytes(content[:3500] + b"!" + content[3501:])
    assert [tuple(r) for r in R.range_changes(before, R.range_digests(spark, f"file://{folder}", 1000)).collect()] == [("in/a.bin", 3, "changed")]
