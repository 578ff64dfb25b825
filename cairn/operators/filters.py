"""Filters and flags on points, scans and log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import geometry as G

XYZ = ("x", "y", "z")


def squared_range(axes=XYZ) -> Column:
    return G.dot(axes, axes)


def range_height(points: DataFrame, near: float, far: float, low: float, high: float) -> DataFrame:
    """Points whose range and height lie in the closed intervals."""
    return points.filter(squared_range().between(near * near, far * far) & F.col("z").between(low, high))


def removal_counts(points: DataFrame, near: float, far: float, low: float, high: float) -> DataFrame:
    """How many points the range and the height take away; a point out of both counts for the range."""
    in_range, in_height = squared_range().between(near * near, far * far), F.col("z").between(low, high)
    return points.agg(
        F.count(F.lit(1)).alias("n_in"),
        F.count_if(~in_range).alias("removed_by_distance"),
        F.count_if(in_range & ~in_height).alias("removed_by_z"),
        F.count_if(in_range & in_height).alias("n_out"),
    )


def finite(points: DataFrame, axes=XYZ) -> DataFrame:
    """Points without null, NaN or infinite coordinates."""
    keep = F.lit(True)
    for a in axes:
        keep = keep & F.col(a).isNotNull() & ~F.isnan(F.col(a)) & (F.abs(F.col(a)) != float("inf"))
    return points.filter(keep)


def above_ground(points: DataFrame, pose, margin: float) -> DataFrame:
    """Points that, in the map, stand more than ``margin`` above the pose."""
    height = G.transform(XYZ, pose)[2] - G.col(pose[2])
    return points.filter(height > margin)


def crop_box(points: DataFrame, low=(-60.0, -60.0, -30.0), high=(60.0, 60.0, 50.0)) -> DataFrame:
    """Points in the closed box."""
    keep = F.lit(True)
    for a, lo, hi in zip(XYZ, low, high, strict=True):
        keep = keep & F.col(a).between(lo, hi)
    return points.filter(keep)


def mixed(number, seed: int) -> Column:
    """A pseudorandom integer below 2^31 by two multiplications modulo a prime: the same in any engine."""
    prime = 2147483647
    one = F.pmod(F.col(number) * 48271 + seed, F.lit(prime))
    return F.pmod(one * 16807 + F.lit(seed), F.lit(prime))


def random_downsample(points: DataFrame, n: int = 5000, seed: int = 1, id_col: str = "point_id") -> DataFrame:
    """``n`` points chosen by a seeded hash of their id (all, if there are fewer)."""
    return points.orderBy(mixed(id_col, seed), id_col).limit(n)


def wide_enough(points: DataFrame, required: float = 10.0, by: str = "cloud_id") -> DataFrame:
    """Clouds with their farthest point, and whether that is ``required`` away at least."""
    return points.groupBy(by).agg(F.max(F.sqrt(squared_range())).alias("extent")).withColumn("accepted", F.col("extent") >= required)


def quality_flags(iterations="total_iterations", nvtl="final_nvtl", pairs="num_correspondences") -> Column:
    """Tags of a frame: high_iter (over 15), low_nvtl (under 2.5), low_corr (under 7000)."""
    tags = F.array(
        F.when(F.col(iterations) > 15, "high_iter"),
        F.when(F.col(nvtl) < 2.5, "low_nvtl"),
        F.when(F.col(pairs) < 7000, "low_corr"),
    )
    return F.array_compact(tags)


def summary_flags(pose_difference="mean_pose_diff", iterations="mean_iterations", nvtl="mean_nvtl") -> Column:
    """Messages on a whole run."""
    return F.array_compact(
        F.array(
            F.when(F.col(pose_difference) > 0.1, "large pose difference"),
            F.when(F.col(iterations) > 10, "many iterations"),
            F.when(F.col(nvtl) < 1.5, "low NVTL"),
        )
    )


def offset_class(offset="mean_offset") -> Column:
    """What a clock's mean offset in seconds tells."""
    size = F.abs(F.col(offset))
    return F.when(size > 365.25 * 86400, "wrong epoch").when(size > 86400, "large offset").when(size > 1, "drift").otherwise("ok")
