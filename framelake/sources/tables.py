"""The canonical views: trajectories, point sets and frame catalogues as long tables.

trajectories: atom, frame (0, 1, ... without gaps for each atom), t (seconds), x, state, event_id
points: frame, atom, species, x, y, z in a cubic box of edge BOX
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = 10.0
FRAMES = 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("atom"),
        (F.row_number().over(w) - 1).cast("bigint").alias("frame"),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6).alias("t"),
        F.col("value").alias("x"),
        F.col("event_type").alias("state"),
        "event_id",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first three components, wrapped into the box; every FRAMES-th one is in the same frame."""
    axis = lambda k: (F.col("embedding")[k].cast("double") - F.floor(F.col("embedding")[k].cast("double"))) * BOX
    return read(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % FRAMES).alias("frame"),
        F.col("vec_id").alias("atom"),
        F.col("label").alias("species"),
        axis(0).alias("x"),
        axis(1).alias("y"),
        axis(2).alias("z"),
    )


#: The same views in SQL, for the oracles.
TRAJ = """
traj AS (SELECT user_id AS atom, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
                epoch_us(ts) / 1e6 AS t, value AS x, event_type AS state, event_id FROM events)
"""
POINTS = """
pts AS (SELECT vec_id % 4 AS frame, vec_id AS atom, label AS species,
               (embedding[1]::DOUBLE - floor(embedding[1]::DOUBLE)) * 10.0::DOUBLE AS x,
               (embedding[2]::DOUBLE - floor(embedding[2]::DOUBLE)) * 10.0::DOUBLE AS y,
               (embedding[3]::DOUBLE - floor(embedding[3]::DOUBLE)) * 10.0::DOUBLE AS z FROM embeddings)
"""
