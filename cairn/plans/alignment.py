"""Alignment of scans to a Gaussian grid: one scan by a job per step, many scans by a task per scan and start."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.operators import neighbors as N
from cairn.operators import scoring as S
from cairn.operators import voxel as V

from . import newton
from .newton import Arrays, Evaluation, Outcome, Settings

POSE = ("tx", "ty", "tz", "roll", "pitch", "yaw")
KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
RESULT = "scan_id string, start_id long, status string, iterations int, score double, tp_per_point double, nvtl double, pairs long, oscillations int, " + ", ".join(f"{c} double" for c in POSE) + ", hessian array<double>"
OUT = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in RESULT.split(", ")])


def align(points: DataFrame, grid: DataFrame, start, settings: Settings = Settings()) -> Outcome:
    """One scan from one start: each evaluation is one aggregate of the joined pairs, the algebra is the driver's.

    Every step plans anew from literals, so lineage doesn't grow. Keep ``points`` and ``grid`` cached or written: each step reads them.
    """

    def evaluate(pose: np.ndarray) -> Evaluation:
        sums = S.total_derivatives(points, grid, tuple(map(float, pose)), settings.resolution, settings.metric, settings.outliers)
        return Evaluation.of(sums.first())

    def evaluate_all(poses: list[np.ndarray]) -> list[Evaluation]:
        """All candidate steps in one job."""
        parts = [S.total_derivatives(points, grid, tuple(map(float, p)), settings.resolution, settings.metric, settings.outliers).withColumn("k", F.lit(k)) for k, p in enumerate(poses)]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return [Evaluation.of(r) for r in sorted(whole.collect(), key=lambda r: r["k"])]

    return newton.maximise(evaluate, start, settings, evaluate_all)


def nearby_grid(scans: DataFrame, starts: DataFrame, grid: DataFrame, settings: Settings, reach: float, coarse: int = 8) -> DataFrame:
    """(scan_id, start_id, voxel): the part of the grid that a scan can meet from a start, if its points move by ``reach`` at most.

    Coarse cells of both sides meet in a hash join, so no grid needs to fit in a task or a broadcast, however large the map.
    """
    size = coarse * settings.resolution
    rings = math.ceil((reach + settings.resolution) / size)
    met = scans.join(starts, "scan_id")
    moved = dict(zip(V.XYZ, G.transform(V.XYZ, POSE), strict=True))
    cells = met.select("scan_id", "start_id", *[F.floor(e / size).cast("int").alias(k) for k, e in zip(V.KEY, moved.values(), strict=True)]).distinct()
    cells = N.around(cells, rings).select("scan_id", "start_id", *[F.col(c).alias(f"g{i}") for i, c in enumerate(N.CELL)]).distinct()
    own = grid.withColumns({f"g{i}": F.floor(F.col(m) / size).cast("int") for i, m in enumerate(V.MEANS)})
    return cells.join(own, ["g0", "g1", "g2"]).select("scan_id", "start_id", *grid.columns)


def align_many(scans: DataFrame, starts: DataFrame, grid: DataFrame, settings: Settings = Settings(), reach: float | None = None) -> DataFrame:
    """Scans (scan_id, x, y, z) from all their starts (scan_id, start_id, POSE): a row of RESULT each.

    A group holds one scan and the part of the map around it; all iterations run inside the task. ``reach``: how far points may move, by default the most that
    the iterations' longest steps allow, and 10 m at least.
    """
    reach = max(10.0, settings.max_iterations * settings.step) if reach is None else reach
    around = nearby_grid(scans, starts, grid, settings, reach)
    points = scans.select("scan_id", *V.XYZ).join(starts, "scan_id")
    columns = list(grid.columns)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            own = np.column_stack([left.column(c).to_numpy() for c in V.XYZ])
            start = np.array([left.column(c)[0].as_py() for c in POSE])
            arrays = Arrays(right.select(columns).to_pandas(), settings.resolution, settings.metric, settings.outliers)
            found = newton.maximise(lambda p: arrays.evaluate(own, p), start, settings)
            rows.append((key[0].as_py(), key[1].as_py(), found.status, found.iterations, found.score, found.score / len(own), arrays.nvtl(own, found.pose), found.pairs, found.oscillations, *map(float, found.pose), found.hessian.reshape(-1).tolist()))
        return pa.Table.from_pylist([dict(zip(OUT.names, row, strict=True)) for row in rows], OUT)

    around = around.withColumnsRenamed({"scan_id": "of_scan", "start_id": "of_start"})
    return points.groupBy("scan_id", "start_id").cogroup(around.groupBy("of_scan", "of_start")).applyInArrow(run, RESULT)


def cascade(points: np.ndarray, grids: list[tuple[float, int, pd.DataFrame]], start, settings: Settings = Settings(), good: float | None = None) -> list[tuple[float, Outcome]]:
    """One scan through grids from coarse to fine: (resolution, iterations, cells). The pose of a level starts the next.

    ``good``: a finer level is left out once the score per point reaches it.
    """
    out, pose = [], start
    for resolution, iterations, cells in grids:
        own = replace(settings, resolution=resolution, max_iterations=iterations)
        arrays = Arrays(cells, resolution, own.metric, own.outliers)
        found = newton.maximise(lambda p, a=arrays: a.evaluate(points, p), pose, own)
        out.append((resolution, found))
        if found.status != newton.NO_PAIRS:
            pose = found.pose
        if good is not None and found.score / max(len(points), 1) >= good:
            break
    return out


def align_cascade(scans: DataFrame, starts: DataFrame, map_points: DataFrame, levels=((4.0, 5), (2.0, 10), (1.0, 15)), settings: Settings = Settings()) -> DataFrame:
    """Many scans through the levels, one pass of ``align_many`` each."""
    now, out = starts, None
    for resolution, iterations in levels:
        own = replace(settings, resolution=resolution, max_iterations=iterations)
        out = align_many(scans, now, V.grid(map_points, resolution, own.least_points), own)
        now = out.select("scan_id", "start_id", *POSE)
    return out


def rotate_covariance(cov: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """A 6 x 6 covariance in the frame that ``rotation`` leads to: position and angles turn alike."""
    turn = np.kron(np.eye(2), rotation)
    return turn @ cov @ turn.T


def fixed_covariance(diagonal=(0.0225, 0.0225, 0.0225, 0.000625, 0.000625, 0.000625)) -> np.ndarray:
    return np.diag(diagonal)


def laplace_covariance(hessian: np.ndarray) -> np.ndarray:
    """The plane's covariance from the curvature at the maximum: -H^-1 of the x, y block; the unit matrix where it has none."""
    block = -hessian[:2, :2]
    return np.linalg.inv(block) if abs(np.linalg.det(block)) > 1e-12 else np.eye(2)


def adjusted_covariance(cov6: np.ndarray, xy: np.ndarray, scale: float = 1.0, floor: float = 0.0) -> np.ndarray:
    """The 6 x 6 covariance with a scaled x, y block, whose diagonal is the floor at least."""
    out = cov6.copy()
    out[:2, :2] = xy * scale
    for k in range(2):
        out[k, k] = max(out[k, k], floor)
    return out


def offset_starts(result: DataFrame, offsets: list[tuple[float, float]]) -> DataFrame:
    """Starts around a result (scan_id, POSE): offsets in the vehicle's frame, turned by its orientation."""
    rows = [F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(x)).alias("dx"), F.lit(float(y)).alias("dy")) for k, (x, y) in enumerate(offsets)]
    turned = G.rotation("roll", "pitch", "yaw")
    spread = result.select("scan_id", *POSE, F.explode(F.array(*rows)).alias("o"))
    return spread.select(
        "scan_id",
        F.col("o.k").alias("start_id"),
        (F.col("tx") + turned[0][0] * F.col("o.dx") + turned[0][1] * F.col("o.dy")).alias("tx"),
        (F.col("ty") + turned[1][0] * F.col("o.dx") + turned[1][1] * F.col("o.dy")).alias("ty"),
        *POSE[2:],
    )
