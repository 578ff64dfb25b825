"""Point clouds, trajectories and logs as views of the driver's tables, for queries; and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESOLUTION = 2.0
#: A pose that moves points a little, and hypotheses around it (pose_id, tx, ty, tz, roll, pitch, yaw).
POSE = (0.3, -0.2, 0.1, 0.05, -0.03, 0.1)
POSES = [(k, 0.3 * k, -0.2 * k, 0.1, 0.02 * k, -0.01 * k, 0.05 * k) for k in range(6)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Clouds by label from the first three components of embeddings."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("label").alias("cloud_id"), F.col("vec_id").alias("point_id"), *[(10 * F.col("embedding")[k].cast("double")).alias(a) for k, a in enumerate("xyz")])


def scan(spark: SparkSession, sf: str) -> DataFrame:
    """The points again, as a scan of the map that they make."""
    return points(spark, sf)


def bulk(spark: SparkSession, sf: str) -> DataFrame:
    """Many points, from line items."""
    rows = table(spark, sf, "lineitem")
    return rows.select(F.col("l_returnflag").alias("cloud_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (100 * F.col("l_discount")).alias("z"))


def poses(spark: SparkSession, sf: str = "") -> DataFrame:
    return spark.createDataFrame(POSES, "pose_id int, tx double, ty double, tz double, roll double, pitch double, yaw double")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their time in ns: seq, t_ns, kind, user_id, value, k."""
    rows = table(spark, sf, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return rows.select(F.col("event_id").alias("seq"), (micros * 1000).alias("t_ns"), F.col("event_type").alias("kind"), "user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment records: mode, time, iterations, convergence."""
    e = events(spark, sf)
    return e.select("seq", "t_ns", F.col("kind").alias("mode"), F.col("value").alias("exe_time_ms"), F.pmod("k", F.lit(30)).alias("total_iterations"), (F.pmod("k", F.lit(30)) < 20).alias("converged"))


def trajectory(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Positions over time from one kind of event; headings from the user's number."""
    e = events(spark, sf).filter(F.col("kind") == kind)
    half = F.pmod(F.col("user_id"), F.lit(628)) / 200.0
    return e.select("seq", "t_ns", F.col("value").alias("x"), (F.col("user_id") % 100).cast("double").alias("y"), (F.col("k") / 10.0).alias("z"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))


# --- the same in SQL -------------------------------------------------------------------------------

SQL = {
    "points": "points AS (SELECT label AS cloud_id, vec_id AS point_id, 10 * CAST(embedding[1] AS DOUBLE) AS x, 10 * CAST(embedding[2] AS DOUBLE) AS y, 10 * CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)",
    "scan": "scan AS (SELECT * FROM points)",
    "bulk": "bulk AS (SELECT l_returnflag AS cloud_id, l_orderkey * 8 + l_linenumber AS point_id, l_quantity AS x, l_extendedprice / 1000 AS y, 100 * l_discount AS z FROM lineitem)",
    "poses": "poses(pose_id, tx, ty, tz, roll, pitch, yaw) AS (VALUES " + ", ".join("(" + ", ".join([str(p[0]), *[f"CAST({v!r} AS DOUBLE)" for v in p[1:]]]) + ")" for p in POSES) + ")",
    "ev": "ev AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS t_ns, event_type AS kind, user_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
    "log": "log AS (SELECT seq, t_ns, kind AS mode, value AS exe_time_ms, k % 30 AS total_iterations, (k % 30) < 20 AS converged FROM ev)",
    "cells": f"cells AS (SELECT *, CAST(floor(x / {RESOLUTION}) AS INTEGER) AS vx, CAST(floor(y / {RESOLUTION}) AS INTEGER) AS vy, CAST(floor(z / {RESOLUTION}) AS INTEGER) AS vz FROM points)",
    "gauss": "gauss AS (SELECT vx, vy, vz, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_samp(x, x) + 1.0 / (count(*) - 1) AS cxx, covar_samp(x, y) AS cxy, covar_samp(x, z) AS cxz, covar_samp(y, y) + 1.0 / (count(*) - 1) AS cyy, covar_samp(y, z) AS cyz, covar_samp(z, z) + 1.0 / (count(*) - 1) AS czz FROM cells GROUP BY vx, vy, vz HAVING count(*) >= 6)",
    "dets": "dets AS (SELECT *, cxx * (cyy * czz - cyz * cyz) + cxy * (cxz * cyz - cxy * czz) + cxz * (cxy * cyz - cxz * cyy) AS det FROM gauss)",
    "grid": "grid AS (SELECT vx, vy, vz, n, mx, my, mz, (cyy * czz - cyz * cyz) / det AS ixx, (cxz * cyz - cxy * czz) / det AS ixy, (cxy * cyz - cxz * cyy) / det AS ixz, (cxx * czz - cxz * cxz) / det AS iyy, (cxy * cxz - cxx * cyz) / det AS iyz, (cxx * cyy - cxy * cxy) / det AS izz FROM dets WHERE det > 0)",
    "pairs": f"pairs AS (SELECT s.point_id, s.x - g.mx AS dx, s.y - g.my AS dy, s.z - g.mz AS dz, g.* FROM scan s JOIN grid g ON (s.x - g.mx) * (s.x - g.mx) + (s.y - g.my) * (s.y - g.my) + (s.z - g.mz) * (s.z - g.mz) <= {RESOLUTION**2})",
}


def trajectory_sql(name: str, kind: str) -> str:
    half = "(user_id % 628) / 200.0"
    return f"{name} AS (SELECT seq, t_ns, value AS x, CAST(user_id % 100 AS DOUBLE) AS y, k / 10.0 AS z, 0.0 AS qx, 0.0 AS qy, sin({half}) AS qz, cos({half}) AS qw FROM ev WHERE kind = '{kind}')"


def with_views(names: str, body: str, *more: str) -> str:
    """A query over the named views (separated by spaces), then further ones."""
    return "WITH " + ",\n".join([*[SQL[n] for n in names.split()], *more]) + "\n" + body
