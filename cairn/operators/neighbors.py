"""Radius search as an equi-join: the reused side is copied to the cells around it, then distances are checked."""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geometry as G

from . import voxel as V

#: Poses (9 numbers each) that are sent to all tasks at once.
MOST_POSES = 100_000
CELL = ("__cx", "__cy", "__cz")


def around(cells: DataFrame, rings: int = 1) -> DataFrame:
    """Each cell once for every cell within ``rings``: ``__probe`` is its place in probe order, x slowest."""
    steps = list(itertools.product(range(-rings, rings + 1), repeat=3))
    offsets = F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(d).alias(a) for a, d in zip("xyz", s, strict=True)]) for n, s in enumerate(steps)])
    spread = cells.withColumn("__o", F.explode(offsets))
    return spread.withColumns({c: F.col(k) - F.col(f"__o.{a}") for c, k, a in zip(CELL, V.KEY, "xyz", strict=True)} | {"__probe": F.col("__o.n")}).drop("__o")


def in_cells(points: DataFrame, resolution: float) -> DataFrame:
    return G.with_cells(points, resolution, names=CELL)


def cell_pairs(points: DataFrame, grid: DataFrame, resolution: float, rings: int = 1, how: str = "inner") -> DataFrame:
    """Points with the voxels in the cells around their own, near or far. Voxels, which are fewer and reused, are the copied side."""
    return in_cells(points, resolution).join(around(grid, rings), list(CELL), how).drop(*CELL)


def radius_pairs(points: DataFrame, grid: DataFrame, resolution: float, radius: float | None = None) -> DataFrame:
    """Points with every voxel whose mean is within ``radius`` (the resolution, if none is given), and ``distance2``.

    A mean lies in its voxel's cell, so within r it is at most ceil(r / resolution) cells away: the hash join misses nothing.
    """
    radius = resolution if radius is None else radius
    met = cell_pairs(points, grid, resolution, math.ceil(radius / resolution))
    gaps = [F.col(a) - F.col(m) for a, m in zip(V.XYZ, V.MEANS, strict=True)]
    return met.withColumn("distance2", G.dot(gaps, gaps)).filter(F.col("distance2") <= radius * radius)


def first_pairs(pairs: DataFrame, most: int = 8, order: tuple = ("distance2", *V.KEY), by=("point_id",)) -> DataFrame:
    """At most ``most`` voxels for each point in the given order: (distance, key), probe order or a voxel's number."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= most)


def lookup(keys: DataFrame, grid: DataFrame) -> DataFrame:
    return keys.join(grid, list(V.KEY))


def at_poses(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Every point at every pose (pose_id, tx, ty, tz, roll, pitch, yaw), in map coordinates.

    A pose's rotation is worked out once, before it meets the points. Poses are hypotheses of a search and are sent to all tasks, MOST_POSES at a time
    where there are more.
    """
    parts = -(-poses.count() // MOST_POSES)
    if parts > 1:
        part = F.pmod(F.xxhash64("pose_id"), F.lit(2 * parts))
        return reduce(DataFrame.union, [at_poses_of(points, poses.filter(part == k)) for k in range(2 * parts)])
    return at_poses_of(points, poses)


def at_poses_of(points: DataFrame, poses: DataFrame) -> DataFrame:
    """``at_poses`` for as many poses as one broadcast holds."""
    entries = {f"__r{i}{j}": e for i, row in enumerate(G.rotation("roll", "pitch", "yaw")) for j, e in enumerate(row)}
    turned = poses.withColumns(entries)
    met = points.crossJoin(F.broadcast(turned))
    moved = {a: G.dot([f"__r{i}{j}" for j in range(3)], V.XYZ) + F.col(t) for i, (a, t) in enumerate(zip(V.XYZ, ("tx", "ty", "tz"), strict=True))}
    return met.withColumns(moved).select("pose_id", *[c for c in points.columns])
