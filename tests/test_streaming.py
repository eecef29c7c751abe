"""The finished stream gives the batch's rows; open state intervals come out on a timeout."""

import datetime as dt

from framelake.streaming import windows as W


def drain(spark, df, tmp_path, mode="append"):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def source(spark, tmp_path, rows, schema):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


SCHEMA = "key bigint, ts timestamp, state string, value double"


def test_bursts_and_blocks_equal_the_batch(spark, tmp_path):
    rows = [[(1, at(0), "a", 1.0), (1, at(5), "a", 3.0), (2, at(6), "b", 2.0)], [(1, at(30), "a", 4.0), (2, at(9), "b", 9.0)], [(9, at(600), "z", 0.0)]]
    stream = source(spark, tmp_path, rows, SCHEMA)
    batch = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = drain(spark, W.bursts(stream, "ts", ["key"], "10 minutes", "1 hour", "value"), tmp_path / "a")
    want = W.bursts(batch, "ts", ["key"], "10 minutes", "1 hour", "value").filter("key <> 9")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 3
    got = drain(spark, W.blocks(stream, "ts", ["key"], "20 minutes", "1 hour", "value"), tmp_path / "b")
    assert sorted(got.collect()) == sorted(W.blocks(batch, "ts", ["key"], "20 minutes", "1 hour", "value").filter("key <> 9").collect())


def test_distinct_records(spark, tmp_path):
    stream = source(spark, tmp_path, [[(1, at(0), "a", 1.0), (1, at(1), "a", 1.0)], [(1, at(2), "a", 2.0)]], SCHEMA)
    assert drain(spark, W.distinct_records(stream, "ts", ["key", "state"], "1 hour"), tmp_path / "o").count() == 1


def test_residence_closes_and_times_out(spark, tmp_path):
    rows = [[(1, at(0), "a", 0.0), (1, at(1), "a", 0.0)], [(1, at(2), "b", 0.0), (1, at(3), "a", 0.0)], [(2, at(500), "z", 0.0)], [(3, at(501), "z", 0.0)]]
    out = drain(spark, W.residence(source(spark, tmp_path, rows, SCHEMA), "key", "ts", "state", "1 minute", 60_000), tmp_path / "o")
    got = sorted((r.key, r.state, r.n, r.right_censored) for r in out.collect())
    assert got[:3] == [(1, "a", 1, True), (1, "a", 2, False), (1, "b", 1, False)]
