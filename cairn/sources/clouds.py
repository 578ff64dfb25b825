"""Binary point clouds to rows and back, and generated clouds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "array<struct<name: string, offset: int, datatype: int, count: int>>"
#: The message's code of 32-bit floats.
FLOAT32 = 7


def decode(blobs: DataFrame) -> DataFrame:
    """Clouds (cloud_id, data, fields, point_step, width, height) to points (cloud_id, point_id, x, y, z).

    Finds x, y, z by name, reads little-endian floats, drops points that aren't finite (their numbers stay free). An empty blob gives no points;
    one that is shorter than its width, height and step say raises, as does one without the three fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, step = row["data"] or b"", row["point_step"]
                n = row["width"] * row["height"]
                if not data or not n:
                    continue
                at = {f["name"]: f["offset"] for f in row["fields"]}
                if not {"x", "y", "z"} <= at.keys():
                    raise ValueError(f"cloud {row['cloud_id']}: no x, y, z")
                if len(data) < n * step:
                    raise ValueError(f"cloud {row['cloud_id']}: {len(data)} bytes for {n} points of {step}")
                kind = np.dtype({"names": ["x", "y", "z"], "formats": ["<f4"] * 3, "offsets": [at[c] for c in "xyz"], "itemsize": step})
                points = np.frombuffer(data, dtype=kind, count=n)
                xyz = np.stack([points[c] for c in "xyz"], axis=1).astype(float)
                keep = np.isfinite(xyz).all(axis=1)
                arrays = [pa.array([row["cloud_id"]] * int(keep.sum()), pa.string()), pa.array(np.flatnonzero(keep))] + [pa.array(xyz[keep, k]) for k in range(3)]
                yield pa.RecordBatch.from_arrays(arrays, ["cloud_id", "point_id", "x", "y", "z"])

    columns = [F.col("cloud_id").cast("string").alias("cloud_id"), "data", "fields", "point_step", "width", "height"]
    return blobs.select(*columns).mapInArrow(run, "cloud_id string, point_id long, x double, y double, z double")


def encode(points: DataFrame, rgb: str | None = None) -> DataFrame:
    """Points to one blob per cloud, by point_id: 12 bytes a point, or 16 with the colour's bits (0x00RRGGBB) as a float.

    A cloud is one message, and so one group."""
    step = 16 if rgb else 12
    schema = f"cloud_id string, data binary, fields {FIELDS}, point_step int, width int, height int"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point_id")
        names = ["x", "y", "z", "rgb"] if rgb else ["x", "y", "z"]
        out = np.zeros(len(frame), dtype=[(n, "<f4") for n in names])
        for c in "xyz":
            out[c] = frame[c].to_numpy(np.float32)
        if rgb:
            out["rgb"] = frame[rgb].to_numpy(np.uint32).view(np.float32)
        fields = [{"name": n, "offset": 4 * k, "datatype": FLOAT32, "count": 1} for k, n in enumerate(names)]
        return pd.DataFrame([[frame["cloud_id"].iloc[0], out.tobytes(), fields, step, len(frame), 1]], columns=["cloud_id", "data", "fields", "point_step", "width", "height"])

    columns = [F.col("cloud_id").cast("string").alias("cloud_id"), "point_id", "x", "y", "z"] + ([rgb] if rgb else [])
    return points.select(*columns).groupBy("cloud_id").applyInPandas(run, schema)


# --- generated clouds ----------------------------------------------------------------------------


def steps(size: float, interval: float) -> int:
    return int(size / interval + 1e-9) + 1


def single(c):
    """The product of two 32-bit floats, as a double: where a point near a cell's edge belongs depends on it."""
    return c.cast("double")


def plane(spark: SparkSession, size: float = 20.0, interval: float = 0.2, axes: tuple[str, str] = ("x", "y"), height: float = 0.0) -> DataFrame:
    """A regular grid of points (point_id, x, y, z) on two axes; the third is ``height``."""
    n = steps(size, interval)
    rows = spark.range(n * n)
    at = lambda k: single(F.lit(interval).cast("float") * k.cast("float"))
    values = {axes[0]: at(F.floor(F.col("id") / n)), axes[1]: at(F.pmod("id", F.lit(n)))}
    return rows.select(F.col("id").alias("point_id"), *[values.get(c, F.lit(height)).alias(c) for c in "xyz"])


def half_cube(spark: SparkSession, size: float = 20.0, interval: float = 0.2, offset=(0.0, 0.0, 0.0)) -> DataFrame:
    """Three planes at right angles: z = 0, x = 0 and y = 0."""
    n = steps(size, interval)
    parts = []
    for k, axes in enumerate((("x", "y"), ("y", "z"), ("x", "z"))):
        own = plane(spark, size, interval, axes)
        parts.append(own.withColumn("point_id", F.col("point_id") + k * n * n))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.withColumns({c: F.col(c) + float(o) for c, o in zip("xyz", offset, strict=True)})


def cube_grid(spark: SparkSession, size: float, interval: float, offset=(0.0, 0.0, 0.0)) -> DataFrame:
    n = steps(size, interval)
    parts = (F.floor(F.col("id") / (n * n)), F.pmod(F.floor(F.col("id") / n), F.lit(n)), F.pmod("id", F.lit(n)))
    at = [single(F.lit(interval).cast("float") * k.cast("float")) + float(o) for k, o in zip(parts, offset, strict=True)]
    return spark.range(n**3).select(F.col("id").alias("point_id"), *[e.alias(c) for e, c in zip(at, "xyz", strict=True)])


def random_sphere(spark: SparkSession, n: int, radius: float = 1.0, seed: int = 1) -> DataFrame:
    """``n`` points evenly in a ball: a direction and a cube root from a seeded hash of the number."""
    unit = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), 11) / float(2**53)
    rows = spark.range(n).withColumn("u", 2 * unit(0) - 1).withColumn("a", unit(1) * 2 * np.pi).withColumn("r", radius * F.cbrt(unit(2)))
    flat = F.sqrt(1 - F.col("u") * F.col("u")) * F.col("r")
    return rows.select(F.col("id").alias("point_id"), (flat * F.cos("a")).alias("x"), (flat * F.sin("a")).alias("y"), (F.col("u") * F.col("r")).alias("z"))


def sensor_scan(points: DataFrame, interval: float = 1.0) -> DataFrame:
    """A thinned cloud: the centroid of each cell, numbered by cell."""
    from cairn.operators import voxel as V

    return V.numbered(V.downsample(points, interval), list(V.KEY), name="point_id").select("point_id", "x", "y", "z")
