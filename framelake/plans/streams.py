"""The streaming operators over the stored events: a batch gives the rows that the finished stream would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.columns import rounded
from framelake.plans.catalog import query
from framelake.sources.tables import read
from framelake.streaming import windows as W

EPOCH = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c}) div 1000000"


def _seconds(name: str):
    return F.expr(EPOCH.format(c=name)).alias(name)


@query("""
    WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts) AS burst FROM f)
    SELECT event_type, epoch_us(min(ts)) // 1000000 AS start, epoch_us(max(ts) + INTERVAL 20 MINUTE) // 1000000 AS stop, count(*) AS anchors, max(value) AS severity FROM s GROUP BY event_type, burst
""")
def session_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.bursts(read(spark, sf_dir, "events"), "ts", ["event_type"], "20 minutes", "1 hour", "value")
    return out.select("event_type", _seconds("start"), _seconds("stop"), "anchors", "severity")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) // 1000000 AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def tumbling_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.blocks(read(spark, sf_dir, "events"), "ts", ["event_type"], "6 hours", "1 hour", "value")
    return out.select("event_type", _seconds("start"), "n", rounded(F.col("mean")).alias("mean"))


@query("""
    WITH b AS (SELECT *, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(2 * unnest(range(3)) AS INTEGER)) AS start FROM events)
    SELECT epoch_us(start) // 1000000 AS start, count(*) AS n, round(avg(value), 6) AS mean FROM b GROUP BY 1
""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.blocks(read(spark, sf_dir, "events"), "ts", [], "6 hours", "1 hour", "value", "2 hours")
    return out.select(_seconds("start"), "n", rounded(F.col("mean")).alias("mean"))
