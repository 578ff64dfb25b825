"""Voxel grids: cells of points summarised as Gaussians, and sequences over sorted keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geometry as G

KEY = ("vx", "vy", "vz")
XYZ = ("x", "y", "z")
PAIRS = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))
MEANS = ("mx", "my", "mz")
COV = tuple(f"c{a}{b}" for a, b in PAIRS)
INV = tuple(f"i{a}{b}" for a, b in PAIRS)


def downsample(points: DataFrame, resolution: float) -> DataFrame:
    """The centroid of each occupied cell; with a resolution of 0 or less all points."""
    if resolution <= 0:
        return points.select(*XYZ)
    return G.with_cells(points, resolution).groupBy(*KEY).agg(*[F.avg(a).alias(a) for a in XYZ], F.count(F.lit(1)).alias("n"))


def sums(points: DataFrame, resolution: float) -> DataFrame:
    """Count, sums and sums of products of each cell."""
    products = [F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in PAIRS]
    return G.with_cells(points, resolution).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s{a}") for a in XYZ], *products)


def gaussians(points: DataFrame, resolution: float, least: int = 6, prior: float = 1.0) -> DataFrame:
    """Mean and covariance of each cell with ``least`` points: (scatter + prior I) / (n - 1).

    The scatter comes from covar_samp, whose partial results merge without the cancellation that sums of squares of large
    coordinates have.
    """
    covs = [((F.covar_samp(a, b) + (F.lit(prior) / (F.count(F.lit(1)) - 1) if a == b else F.lit(0.0)))).alias(f"c{a}{b}") for a, b in PAIRS]
    grouped = G.with_cells(points, resolution).groupBy(*KEY)
    return grouped.agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(m) for a, m in zip(XYZ, MEANS, strict=True)], *covs).filter(F.col("n") >= max(least, 2))


def gaussians_two_pass(points: DataFrame, resolution: float, least: int = 6, prior: float = 1.0) -> DataFrame:
    """The same by means first and products of differences then."""
    rows = G.with_cells(points, resolution)
    means = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(m) for a, m in zip(XYZ, MEANS, strict=True)]).filter(F.col("n") >= max(least, 2))
    met = rows.join(means, list(KEY))
    gap = {a: F.col(a) - F.col(m) for a, m in zip(XYZ, MEANS, strict=True)}
    scatter = [((F.sum(gap[a] * gap[b]) + (prior if a == b else 0.0)) / (F.first("n") - 1)).alias(f"c{a}{b}") for a, b in PAIRS]
    return met.groupBy(*KEY).agg(F.first("n").alias("n"), *[F.first(m).alias(m) for m in MEANS], *scatter)


def inverted(grid: DataFrame) -> DataFrame:
    """Adds the inverse of the covariance as it is (no eigenvalue is raised), by cofactors. Degenerate cells go."""
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in COV)
    cofactors = (yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy)
    det = xx * cofactors[0] + xy * cofactors[1] + xz * cofactors[2]
    rows = grid.withColumn("__det", det).filter(F.col("__det") > 0)
    return rows.withColumns({name: c / F.col("__det") for name, c in zip(INV, cofactors, strict=True)}).drop("__det")


def eigenvalues(grid: DataFrame) -> DataFrame:
    """Adds the covariance's eigenvalues l1 <= l2 <= l3 by the trigonometric solution of the cubic."""
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in COV)
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    rows = grid.withColumn("__q", q).withColumn("__p", p)
    q, p = F.col("__q"), F.col("__p")
    a, b, c = xx - q, yy - q, zz - q
    half = (a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)) / (2 * p * p * p)
    phi = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3
    rows = rows.withColumn("__phi", F.when(p > 0, phi).otherwise(F.lit(0.0)))
    top = q + 2 * p * F.cos("__phi")
    low = q + 2 * p * F.cos(F.col("__phi") + 2 * G.PI / 3)
    return rows.withColumn("l3", top).withColumn("l1", low).withColumn("l2", 3 * q - F.col("l1") - F.col("l3")).drop("__q", "__p", "__phi")


def conditioned_arrays(cov: np.ndarray, ratio: float) -> tuple[np.ndarray, ...]:
    """Of stacked 3 x 3 matrices: which are usable, raised covariances, inverses, and axes of the least eigenvalue."""
    good = np.isfinite(cov).all(axis=(1, 2))
    values, vectors = np.linalg.eigh(np.where(good[:, None, None], cov, np.eye(3)))
    good &= values[:, 2] > 0
    raised = np.maximum(values, ratio * values[:, 2:])
    changed = (raised != values).any(axis=1)
    safe = np.where(good[:, None], raised, 1.0)
    rebuilt = np.einsum("nij,nj,nkj->nik", vectors, safe, vectors)
    out = np.where(changed[:, None, None], rebuilt, cov)
    inverse = np.einsum("nij,nj,nkj->nik", vectors, 1 / safe, vectors)
    axis = vectors[:, :, 0]
    largest = np.take_along_axis(axis, np.abs(axis).argmax(axis=1)[:, None], axis=1)
    return good, out, inverse, axis * np.where(largest < 0, -1.0, 1.0)


def conditioned(grid: DataFrame, ratio: float = 0.01) -> DataFrame:
    """Raises eigenvalues below ``ratio`` of the largest and adds the inverse and the normal (axis of the least eigenvalue, its
    largest part positive). Cells whose largest eigenvalue is not positive and finite go."""
    extra = [*INV, "nx", "ny", "nz"]
    schema = ", ".join(f"{n} {t}" for n, t in grid.dtypes) + "".join(f", {c} double" for c in extra)
    upper = np.triu_indices(3)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            flat = frame[list(COV)].to_numpy(float)
            cov = np.empty((len(flat), 3, 3))
            cov[:, upper[0], upper[1]] = flat
            cov[:, upper[1], upper[0]] = flat
            good, out, inverse, axis = conditioned_arrays(cov, ratio)
            frame = frame.assign(**{c: out[:, i, j] for c, i, j in zip(COV, *upper, strict=True)})
            frame = frame.assign(**{c: inverse[:, i, j] for c, i, j in zip(INV, *upper, strict=True)}, **{c: axis[:, k] for k, c in enumerate(extra[6:])})
            yield frame[good]

    return grid.mapInPandas(run, schema)


def grid(points: DataFrame, resolution: float, least: int = 6, ratio: float = 0.01) -> DataFrame:
    """The Gaussian grid of a map, as matching needs it."""
    return conditioned(gaussians(points, resolution, least), ratio)


def bounds(cells: DataFrame) -> DataFrame:
    """Least and greatest key and the box's dimensions; zeros and ones for no cells."""
    low = [F.coalesce(F.min(k), F.lit(0)).alias(f"min_{k}") for k in KEY]
    high = [F.coalesce(F.max(k), F.lit(0)).alias(f"max_{k}") for k in KEY]
    dims = [(F.coalesce(F.max(k) - F.min(k), F.lit(0)) + 1).alias(f"dim_{k}") for k in KEY]
    return cells.agg(*low, *high, *dims)


def point_bounds(points: DataFrame) -> DataFrame:
    return points.agg(*[F.min(a).alias(f"min_{a}") for a in XYZ], *[F.max(a).alias(f"max_{a}") for a in XYZ])


# --- sequences: what sort-based aggregation is made of -------------------------------------------


def segments(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``is_start`` and ``segment`` (from 0): runs of equal keys in the given order.

    The order is dealt into ranges (see ``in_order``); the key before a range's first row is the last one of the ranges before.
    """
    rows = in_ranges(df, order)
    own = Window.partitionBy("__range").orderBy(*order)
    rows = rows.withColumn("__before", F.lag(F.struct(key)).over(own))
    line = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    lasts = rows.groupBy("__range").agg(F.max_by(F.struct(key), F.struct(*order)).alias("__last"))
    lasts = lasts.select("__range", F.last("__last").over(line).alias("__earlier"))
    rows = rows.join(F.broadcast(lasts), "__range").withColumn("__before", F.coalesce("__before", "__earlier"))
    start = F.coalesce((F.col(f"__before.{key}") != F.col(key)).cast("int"), F.lit(1))
    marked = rows.drop("__earlier").withColumn("is_start", start).drop("__before")
    return running(marked, F.col("is_start").cast("long"), order, "segment").withColumn("segment", F.col("segment") - 1)


def run_lengths(df: DataFrame, key: str) -> DataFrame:
    """(code, length, start) of each run of equal keys once sorted: a count per key and its running sum."""
    counts = df.groupBy(F.col(key).alias("code")).agg(F.count(F.lit(1)).alias("length"))
    line = Window.orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("length").over(line), F.lit(0)))


def segment_sums(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


#: Ranges that one order over all rows is dealt into, at least; as many as there are shuffle partitions, if those are more.
RANGES = 64


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """Adds ``__range``, which grows with the order: quantiles of its first column, which must be a number, are the edges. Rows with the same first value
    share a range. Nulls come first."""
    ranges = ranges or max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.col(order[0]).cast("double")
    cuts = sorted(set(df.select(first.alias("v")).approxQuantile("v", [k / ranges for k in range(1, ranges)], min(0.001, 0.1 / ranges))))
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < first)) if cuts else F.lit(0)
    return df.withColumn("__range", F.coalesce(place, F.lit(-1)))


def running(rows: DataFrame, value, order: list[str], name: str, by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """``in_order`` for rows with their ``__range``."""
    by = by or []
    rows = rows.withColumn("__value", value).withColumn("__by", F.struct("__range", *by))
    sums = rows.groupBy("__by").agg(F.sum("__value").alias("__sum"))
    keys = [F.col(f"__by.{k}") for k in by]
    line = Window.partitionBy(*keys).orderBy("__by.__range")
    sums = sums.select("__by", F.coalesce(F.sum("__sum").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("__sum").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"))
    own = Window.partitionBy("__by").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # without keys there are as many sums as ranges
    local = rows.withColumn("__own", F.sum("__value").over(own)).join(sums if by else F.broadcast(sums), "__by")
    out = local.withColumn(name, F.col("__own") + F.col("__base"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("__value", "__range", "__by", "__own", "__base", "__total")


def in_order(df: DataFrame, value, order: list[str], name: str, by: list[str] | None = None, total: str | None = None, ranges: int | None = None) -> DataFrame:
    """Adds the running sum of ``value`` over all rows in the given order, or those with the same ``by``, without bringing them to one task.

    The order is cut into ranges; each range of a key is a window of its own, and what stands before it is a sum over the key's ranges. ``total``
    gets the sum over all rows of the key.
    """
    return running(in_ranges(df, order, ranges), value, order, name, by, total)


def scans(df: DataFrame, value: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds the inclusive and the exclusive running sum (which starts at 0), within ``by`` or over all rows."""
    if by:
        line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = df.withColumn("inclusive", F.sum(value).over(line))
    else:
        rows = in_order(df, F.col(value), order, "inclusive")
    return rows.withColumn("exclusive", F.col("inclusive") - F.col(value))


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "position") -> DataFrame:
    """Adds 0, 1, 2 ... in the given order, within ``by`` or over all rows."""
    if by:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    return in_order(df, F.lit(1).cast("long"), order, name).withColumn(name, F.col(name) - 1)


def gather(values: DataFrame, picks: DataFrame, position: str = "position") -> DataFrame:
    """The values at the positions of ``picks``."""
    return picks.join(values, position)


def sorted_keys(df: DataFrame, key: str, tie: str, partitions: int | None = None) -> DataFrame:
    """A stable sort by key: ranges of keys are dealt to tasks, each of which sorts its own."""
    ranges = df.repartitionByRange(partitions, key, tie) if partitions else df.repartitionByRange(key, tie)
    return ranges.sortWithinPartitions(key, tie)


def centroids(points: DataFrame, by: str) -> DataFrame:
    """The centre of each tile."""
    return points.groupBy(by).agg(*[F.avg(a).alias(f"c{a}") for a in XYZ], F.count(F.lit(1)).alias("n"))


def matched(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of two grids side by side: where both have one, how far means, covariances and counts are apart."""
    fields = ["n", *MEANS, *COV]
    left = a.select(*KEY, *[F.col(c).alias(f"a_{c}") for c in fields])
    right = b.select(*KEY, *[F.col(c).alias(f"b_{c}") for c in fields])
    met = left.join(right, list(KEY), "full")
    weight = [1.0 if p == q else 2.0 for p, q in PAIRS]
    mean_gap = G.distance([f"a_{m}" for m in MEANS], [f"b_{m}" for m in MEANS])
    spread = sum((w * (F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for w, c in zip(weight, COV, strict=True)), F.lit(0.0))
    side = F.when(F.col("b_n").isNull(), "left").when(F.col("a_n").isNull(), "right").otherwise("both")
    return met.select(*KEY, side.alias("side"), mean_gap.alias("mean_gap"), F.sqrt(spread).alias("cov_gap"), (F.col("a_n") - F.col("b_n")).alias("count_gap"))


def members(points: DataFrame, resolution: float, show: int = 5) -> DataFrame:
    """A row for each point with its cell, and whether it is among the cell's first ``show`` by id. A cell's points stay rows: a cell may have very many.

    The first ones are found by a limit that each task applies before rows are moved.
    """
    rows = G.with_cells(points, resolution).select(*KEY, "point_id", *XYZ)
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("point_id"))
    first = rows.withColumn("__nth", nth).filter(F.col("__nth") <= show).select(*KEY, "point_id", F.lit(True).alias("shown"))
    return rows.join(first, [*KEY, "point_id"], "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
