"""Grids, scores, derivatives and alignment on clouds made here."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.operators import neighbors as N
from cairn.operators import scoring as S
from cairn.operators import voxel as V
from cairn.plans import alignment as A
from cairn.plans import newton, search
from cairn.sources import clouds

RES = 2.0


@pytest.fixture(scope="module")
def cube(spark):
    return clouds.half_cube(spark, 20.0, 0.4, (100.0, 100.0, 0.0)).cache()


@pytest.fixture(scope="module")
def grid(cube):
    return V.grid(cube, RES).cache()


@pytest.fixture(scope="module")
def scan(cube):
    return clouds.sensor_scan(cube, 1.0).cache()


def test_half_cube_size(spark):
    assert clouds.half_cube(spark).count() == 30_603


def test_covariance_has_the_prior(spark):
    rows = [(k, 1.0 + 0.01 * k, 1.0, 1.0) for k in range(10)]
    own = V.gaussians(spark.createDataFrame(rows, "point_id long, x double, y double, z double"), RES).first()
    assert own["n"] == 10 and np.isclose(own["cyy"], 1 / 9) and np.isclose(own["cxy"], 0)
    assert np.isclose(own["cxx"], np.var([r[1] for r in rows], ddof=1) + 1 / 9)
    assert V.gaussians(spark.createDataFrame(rows[:3], "point_id long, x double, y double, z double"), RES).count() == 0


def test_flat_covariances_are_raised():
    good, out, inverse, axis = V.conditioned_arrays(np.array([np.diag([1, 1, 1e-4]), np.diag([-1, -1, -1.0]), np.full((3, 3), np.nan)]), 0.01)
    assert good.tolist() == [True, False, False]
    assert np.isclose(np.linalg.eigvalsh(out[0])[0], 0.01) and np.allclose(out[0] @ inverse[0], np.eye(3), atol=1e-8)
    assert np.allclose(axis[0], (0, 0, 1))


def brute_pairs(points, grid, radius):
    """All with all."""
    gaps = [F.col(a) - F.col(m) for a, m in zip(V.XYZ, V.MEANS, strict=True)]
    return points.crossJoin(grid).withColumn("distance2", G.dot(gaps, gaps)).filter(F.col("distance2") <= radius * radius)


def test_cell_join_is_brute_force(scan, grid):
    keys = ["point_id", *V.KEY]
    fast = N.radius_pairs(scan, grid, RES).select(*keys)
    slow = brute_pairs(scan, grid, RES).select(*keys)
    assert fast.count() > 0 and fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scores_fall_with_distance(scan, grid):
    values = []
    for shift in (0.0, 0.3, 0.8):
        moved = scan.withColumn("x", F.col("x") + shift).withColumn("y", F.col("y") + shift)
        values.append(S.scan_scores(S.point_scores(moved, grid, RES)).first()["tp_per_point"])
    assert values[0] > values[1] > values[2]


def test_gradient_and_hessian_by_differences(scan, grid):
    """In NumPy and in Spark, away from the optimum."""
    points, cells = scan.toPandas(), grid.toPandas()
    for metric in ("distribution", "plane"):
        arrays = newton.Arrays(cells, RES, metric)
        own = points[list(V.XYZ)].to_numpy()[:60]
        pose = np.array([0.02, -0.03, 0.01, 1e-4, -2e-4, 3e-4])
        found = arrays.evaluate(own, pose)
        h = 1e-6
        for k in range(6):
            step = np.eye(6)[k] * h
            up, down = arrays.evaluate(own, pose + step), arrays.evaluate(own, pose - step)
            assert up.pairs == down.pairs == found.pairs
            assert np.isclose((up.score - down.score) / (2 * h), found.gradient[k], rtol=1e-4, atol=1e-4)
            assert np.allclose((up.gradient - down.gradient) / (2 * h), found.hessian[k], rtol=1e-3, atol=1e-2 * abs(found.hessian).max())


@pytest.mark.parametrize("metric", ["distribution", "plane"])
def test_spark_and_numpy_agree(scan, grid, metric):
    pose = (0.2, -0.1, 0.05, 0.01, -0.02, 0.003)
    spark_sums = newton.Evaluation.of(S.total_derivatives(scan, grid, pose, RES, metric).first())
    own = newton.Arrays(grid.toPandas(), RES, metric).evaluate(scan.toPandas()[list(V.XYZ)].to_numpy(), np.array(pose))
    assert spark_sums.pairs == own.pairs and np.isclose(spark_sums.score, own.score)
    assert np.allclose(spark_sums.gradient, own.gradient) and np.allclose(spark_sums.hessian, own.hessian)


START = (0.3, -0.2, 0.1, 0.0, 0.0, 0.0)


def test_both_modes_find_the_pose(spark, scan, grid):
    settings = newton.Settings()
    one = A.align(scan, grid, START, settings)
    assert one.status == newton.CONVERGED and np.linalg.norm(one.pose[:3]) < 0.3
    scans = scan.select(F.lit("s").alias("scan_id"), *V.XYZ)
    starts = spark.createDataFrame([("s", 0, *START), ("s", 1, *[0.0] * 6), ("s", 2, 500.0, *[0.0] * 5)], "scan_id string, start_id long, " + ", ".join(f"{c} double" for c in A.POSE))
    rows = {r["start_id"]: r for r in A.align_many(scans, starts, grid, settings).collect()}
    assert np.allclose([rows[0][c] for c in A.POSE], one.pose, atol=1e-6) and rows[0]["iterations"] == one.iterations
    assert rows[0]["nvtl"] > 0 and rows[2]["status"] == newton.NO_PAIRS
    assert np.allclose([rows[2][c] for c in A.POSE], (500.0, 0, 0, 0, 0, 0))


@pytest.mark.parametrize("kind", ["none", "backtracking", "more_thuente", "candidates"])
def test_line_searches(scan, grid, kind):
    arrays = newton.Arrays(grid.toPandas(), RES)
    own = scan.toPandas()[list(V.XYZ)].to_numpy()
    found = newton.maximise(lambda p: arrays.evaluate(own, p), START, newton.Settings(search=kind, max_iterations=60))
    assert arrays.evaluate(own, found.pose).score >= arrays.evaluate(own, np.array(START)).score
    assert np.linalg.norm(found.pose[:3]) < 0.4


def test_regularisation_pulls_along_the_heading(scan, grid):
    arrays = newton.Arrays(grid.toPandas(), RES)
    own = scan.toPandas()[list(V.XYZ)].to_numpy()
    free = newton.maximise(lambda p: arrays.evaluate(own, p), START, newton.Settings())
    held = newton.maximise(lambda p: arrays.evaluate(own, p), START, newton.Settings(reference=(1.0, 0.0), reference_scale=1.0))
    assert held.pose[0] > free.pose[0]


def test_steps_and_checks():
    h = np.diag([-2.0, -1.0, 3.0, -1, -1, -1])
    g = np.ones(6)
    step = newton.ascent_step(h, g)
    assert step[2] > 0 and np.allclose(step[:2], (0.5, 1.0))
    assert newton.solve_cholesky(h, g) is None and np.allclose(newton.solve_cholesky(-np.diag([-2.0] * 6), g), -0.5)
    assert newton.solve_svd(np.zeros((6, 6)), g) is None and np.allclose(newton.solve_damped(np.zeros((6, 6)), g, 2.0), -0.5)
    assert newton.is_negative_definite(-np.eye(6)) and newton.is_positive_definite(np.eye(6)) and not newton.is_positive_definite(h)
    assert newton.condition_number(np.diag([4.0, 2.0])) == 2.0 and math.isinf(newton.condition_number(np.zeros((2, 2))))
    back = [np.array([x, 0, 0, 0, 0, 0.0]) for x in (0, 1, 0, 1, 0, 0, 1)]
    assert newton.oscillations(back) == 3 and newton.oscillations(back[:2]) == 0


def test_cascade_reaches_further(spark):
    cube = clouds.half_cube(spark, 20.0, 0.4)
    own = clouds.sensor_scan(cube, 1.0).toPandas()[list(V.XYZ)].to_numpy()
    grids = [(r, n, V.grid(cube, r).toPandas()) for r, n in ((4.0, 5), (2.0, 10), (1.0, 30))]
    start = np.array([0.8, -0.7, 0.3, 0, 0, 0])
    steps = A.cascade(own, grids, start)

    def error(pose):
        turned, *_ = G.rotation_terms(*pose[3:], tiny=0.0)
        return np.linalg.norm(own @ turned.T + pose[:3] - own, axis=1).mean()

    # a little turn moves far points a lot, so what counts is where the points end
    assert [s[0] for s in steps] == [4.0, 2.0, 1.0] and error(steps[-1][1].pose) < 0.5 * error(start)
    assert len(A.cascade(own, grids, (0.8, -0.7, 0.3, 0, 0, 0), good=0.0)) == 1


def test_covariances():
    cov = A.fixed_covariance()
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    assert np.allclose(A.rotate_covariance(np.diag([1, 2, 3, 4, 5, 6.0]), turn), np.diag([2, 1, 3, 5, 4, 6.0]))
    assert np.allclose(A.laplace_covariance(-np.diag([4.0, 2, 1, 1, 1, 1])), np.diag([0.25, 0.5]))
    out = A.adjusted_covariance(cov, np.diag([1e-9, 2.0]), scale=2.0, floor=0.01)
    assert out[0, 0] == 0.01 and out[1, 1] == 4.0 and out[2, 2] == 0.0225


def test_offsets_turn_with_the_vehicle(spark):
    result = spark.createDataFrame([("s", 10.0, 20.0, 0.0, 0.0, 0.0, math.pi / 2)], "scan_id string, " + ", ".join(f"{c} double" for c in A.POSE))
    row = A.offset_starts(result, [(1.0, 0.0)]).first()
    assert np.allclose((row["tx"], row["ty"]), (10.0, 21.0))


def test_search_finds_the_best_hypothesis():
    goal = np.array([1.0, -2.0, 0, 0, 0, 0.5])

    def align(starts):
        out = []
        for s in starts:
            far = np.linalg.norm((s - goal)[[0, 1]])
            out.append((s, 5 - far, 5 - far, 3))
        return out

    found = search.estimate(align, np.zeros(6), np.diag([4.0, 4, 0, 0, 0, 0]), startup=50, total=100, seed=3)
    assert found.reliable and np.linalg.norm((found.pose - goal)[:2]) < 1.0
    assert len(found.particles) == 100 and found.trajectory == sorted(found.trajectory)
    again = search.estimate(align, np.zeros(6), np.diag([4.0, 4, 0, 0, 0, 0]), startup=50, total=100, seed=3)
    assert np.allclose(found.pose, again.pose)


def test_sampler_order():
    s = search.Sampler(np.zeros(6), np.ones(6), 2, np.ones(6))
    for score in (1.0, 3.0, 2.0, 3.0):
        s.add(np.full(6, score), score)
    assert [t[0] for t in s.trials] == [3.0, 3.0, 2.0, 1.0]
    assert search.good_count(0) == 0 and search.good_count(5) == 1 and search.good_count(55) == 5 and search.good_count(500) == 10


def test_empty_scan(spark, grid):
    empty = spark.createDataFrame([], "point_id long, x double, y double, z double")
    row = S.total_derivatives(empty, grid, START, RES).first()
    assert row["pairs"] == 0 and row["score"] == 0
    scores = S.scan_scores(S.point_scores(empty, grid, RES)).first()
    assert scores["nvtl"] == 0 and scores["tp_per_pair"] == 0
    assert pd.isna(scores["total"]) or scores["total"] == 0


def test_stacked_solutions():
    rng = np.random.default_rng(6)
    hessians, gradients = rng.normal(size=(20, 6, 6)), rng.normal(size=(20, 6))
    hessians[3] = 0
    hessians[4, :, 5] = hessians[4, :, 4]
    found = newton.solve_stacked(hessians, gradients)
    assert np.isnan(found[3]).all()
    assert all(np.allclose(found[k], newton.solve_svd(hessians[k], gradients[k])) for k in range(20) if k != 3)


def test_drawn_hypotheses_are_shared_among_tasks(spark, monkeypatch):
    """A search of one scan aligns its drawn starts in several tasks, and finds what one task finds; blocks of points give the same sums."""
    rng = np.random.default_rng(5)
    rows = rng.normal(0, 3, (3000, 3))
    cloud = spark.createDataFrame([("scan", *map(float, p)) for p in rows], "scan_id string, x double, y double, z double")
    grid = V.grid(cloud.select("x", "y", "z"), 2.0)
    priors = spark.createDataFrame([("scan", [0.1] * 6, np.diag([0.04, 0.04, 0.01, 0, 0, 0.01]).reshape(-1).tolist())], "scan_id string, mean array<double>, covariance array<double>")
    asked = []
    found = search.estimate_many(cloud, priors, grid, startup=6, total=9)
    assert "share" in found._jdf.queryExecution().analyzed().toString()
    found = found.collect()[0]
    arrays = newton.Arrays(grid.toPandas(), 2.0)
    settings = newton.Settings()

    def aligned(starts):
        asked.extend(starts)
        done = [newton.maximise(lambda p: arrays.evaluate(rows, p), s, settings) for s in starts]
        return [(f.pose, arrays.nvtl(rows, f.pose), f.score / len(rows), f.iterations) for f in done]

    plain = search.estimate(aligned, np.full(6, 0.1), np.diag([0.04, 0.04, 0.01, 0, 0, 0.01]), startup=6, total=9)
    assert len(asked) == 9 and found.particles == 9 and np.allclose(found.trajectory, plain.trajectory) and np.allclose([found[c] for c in ("tx", "ty", "yaw")], plain.pose[[0, 1, 5]], atol=1e-6)
    pose = np.array([0.1, -0.2, 0.05, 0.02, 0.01, 0.1])
    blocks = arrays.evaluate(rows, pose)
    monkeypatch.setattr(newton, "POINTS", len(rows))
    whole = arrays.evaluate(rows, pose)
    assert blocks.pairs == whole.pairs and np.allclose(blocks.hessian, whole.hessian) and np.isclose(blocks.score, whole.score)
