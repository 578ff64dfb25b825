"""Scores of scans against a Gaussian grid, and their derivatives by the pose."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import geometry as G

from . import neighbors as N
from . import voxel as V

OUTLIERS = 0.55
#: The upper triangle of the Hessian, by row.
TRIANGLE = [(i, j) for i in range(6) for j in range(i, 6)]
TERMS = ["score", *[f"g{i}" for i in range(6)], *[f"h{i}{j}" for i, j in TRIANGLE]]


def constants(resolution: float, outliers: float = OUTLIERS) -> tuple[float, float]:
    """d1 and d2 of the Gaussian that approximates a mixture with uniform outliers."""
    c1, c2 = 10.0 * (1.0 - outliers), outliers / resolution**3
    d3 = -math.log(c2)
    d1 = -math.log(c1 + c2) - d3
    return d1, -2.0 * math.log((-math.log(c1 * math.exp(-0.5) + c2) - d3) / d1)


def weighted(a, b) -> Column:
    """a' S b for the voxel's inverse covariance S."""
    xx, xy, xz, yy, yz, zz = V.INV
    rows = ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))
    return G.dot(a, [G.dot(row, b) for row in rows])


def gaps() -> list[Column]:
    return [F.col(a) - F.col(m) for a, m in zip(V.XYZ, V.MEANS, strict=True)]


def pair_score(d1: float, d2: float) -> Column:
    """-d1 exp(-d2/2 (x - m)' S (x - m))."""
    return -d1 * F.exp(-d2 / 2 * weighted(gaps(), gaps()))


def scored_pairs(points: DataFrame, grid: DataFrame, resolution: float, cells_only: bool = False, outliers: float = OUTLIERS) -> DataFrame:
    """Pairs of points (in map coordinates) and voxels with ``score``: within the resolution, or in the 27 cells around."""
    pairs = N.cell_pairs(points, grid, resolution) if cells_only else N.radius_pairs(points, grid, resolution)
    return pairs.withColumn("score", pair_score(*constants(resolution, outliers)))


def point_scores(points: DataFrame, grid: DataFrame, resolution: float, by=("point_id",), cells_only: bool = False) -> DataFrame:
    """Of each point the sum and the greatest of its pairs' scores and their number; 0 without pairs."""
    own = scored_pairs(points, grid, resolution, cells_only).groupBy(*by).agg(F.sum("score").alias("score_sum"), F.max("score").alias("score_max"), F.count(F.lit(1)).alias("pairs"))
    names = ("score_sum", "score_max", "pairs")
    return points.join(own, list(by), "left").withColumns({c: F.coalesce(c, F.lit(0 if c == "pairs" else 0.0)) for c in names})


def scan_scores(scores: DataFrame, by=()) -> DataFrame:
    """Of a scan, or a scan at each pose: total, score per pair and per point, the mean greatest score of matched points (NVTL)."""
    matched = F.col("pairs") > 0
    found = scores.groupBy(*by).agg(
        F.sum("score_sum").alias("total"),
        F.sum("pairs").alias("pairs"),
        F.count(F.lit(1)).alias("points"),
        F.count_if(matched).alias("matched"),
        F.sum("score_max").alias("__max"),
    )
    return found.select(
        *by,
        "total",
        "pairs",
        "matched",
        (F.col("points") - F.col("matched")).alias("unmatched"),
        F.coalesce(F.try_divide("total", "pairs"), F.lit(0.0)).alias("tp_per_pair"),
        F.coalesce(F.try_divide("total", "points"), F.lit(0.0)).alias("tp_per_point"),
        F.coalesce(F.try_divide("__max", "matched"), F.lit(0.0)).alias("nvtl"),
        F.exp(-F.col("total") / 10).alias("exp_score"),
    )


def pose_scores(points: DataFrame, poses: DataFrame, grid: DataFrame, resolution: float, by: str = "point_id") -> DataFrame:
    """Scores of a scan at each of many poses, in one pass."""
    moved = N.at_poses(points.select(by, *V.XYZ), poses)
    return scan_scores(point_scores(moved, grid, resolution, ("pose_id", by)), ("pose_id",))


def simple_grid(points: DataFrame, resolution: float, least: int = 6) -> DataFrame:
    """A grid of plain covariances (scatter / n) + 0.01 I, inverted as they are."""
    covs = [(F.covar_pop(a, b) + (0.01 if a == b else 0.0)).alias(f"c{a}{b}") for a, b in V.PAIRS]
    own = G.with_cells(points, resolution).groupBy(*V.KEY).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(m) for a, m in zip(V.XYZ, V.MEANS, strict=True)], *covs)
    return V.inverted(own.filter(F.col("n") >= least))


def neighbour_histogram(points: DataFrame, grid: DataFrame, resolution: float) -> DataFrame:
    """How many points have 0, 1, 2, or 3 and more voxels, and the mean number."""
    found = N.radius_pairs(points, grid, resolution).groupBy("point_id").agg(F.count(F.lit(1)).alias("k"))
    k = F.coalesce("k", F.lit(0))
    return points.select("point_id").join(found, "point_id", "left").agg(*[F.count_if(k == i).alias(f"with_{i}") for i in range(3)], F.count_if(k >= 3).alias("with_3_plus"), F.avg(k).alias("mean_pairs"))


# --- derivatives ---------------------------------------------------------------------------------


def moved(points: DataFrame, pose: tuple[float, ...]) -> DataFrame:
    """Points in the map at a pose of six numbers; their own coordinates stay as px, py, pz. The rotation goes in as literals."""
    turned, *_ = G.rotation_terms(*pose[3:], tiny=0.0)
    own = points.withColumns({f"p{a}": F.col(a) for a in V.XYZ})
    return own.withColumns({a: G.dot([F.lit(float(v)) for v in turned[i]], [f"p{b}" for b in V.XYZ]) + F.lit(float(pose[i])) for i, a in enumerate(V.XYZ)})


def times(matrix) -> list[Column]:
    """A constant matrix times the point's own coordinates, without the terms that are zero."""
    out = []
    for row in matrix:
        terms = [F.lit(float(v)) * F.col(f"p{a}") for v, a in zip(row, V.XYZ, strict=True) if v]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return out


def with_jacobian(points: DataFrame, pose: tuple[float, ...]) -> DataFrame:
    """Adds the derivatives of a moved point by the angles: first j{angle}{axis}, second k{angle}{angle}{axis}. Those by the position
    are the unit matrix and zero. Done before the join, so that a point's voxels share them."""
    _, first, second = G.rotation_terms(*pose[3:])
    columns = {f"j{a}{i}": e for a in range(3) for i, e in enumerate(times(first[a]))}
    columns |= {f"k{a}{b}{i}": e for a in range(3) for b in range(a, 3) for i, e in enumerate(times(second[a][b]))}
    return points.withColumns(columns)


def along(vector: list[Column], parameter: int) -> Column:
    """The vector times a column of the Jacobian."""
    return vector[parameter] if parameter < 3 else G.dot(vector, [f"j{parameter - 3}{i}" for i in range(3)])


def pair_derivatives(pairs: DataFrame, d1: float, d2: float, metric: str = "distribution") -> DataFrame:
    """Adds each pair's score, gradient and upper triangle of the Hessian (TERMS); 0 where d2 exp(...) is not in [0, 1].

    With u the gradient of the squared distance's half: score' = f u, score'' = f (-d2 u u' + J' S J + (x - m)' S H), f = d1 d2 exp(...). For ``plane`` the
    distance is that along the voxel's normal, n n' in place of S.
    """
    gap = gaps()
    if metric == "plane":
        normal = [F.col(c) for c in ("nx", "ny", "nz")]
        pairs = pairs.withColumn("__d", G.dot(gap, normal))
        pull = [F.col("__d") * n for n in normal]
        energy = F.col("__d") * F.col("__d")
    else:
        xx, xy, xz, yy, yz, zz = V.INV
        pull = [G.dot(row, gap) for row in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))]
        energy = G.dot(gap, pull)
    rows = pairs.withColumns({"__e": F.exp(-d2 / 2 * energy)} | {f"__u{i}": u for i, u in enumerate(pull)})
    pull = [F.col(f"__u{i}") for i in range(3)]
    rows = rows.withColumns({f"__w{i}": along(pull, i) for i in range(6)})
    # S times each column of the Jacobian
    if metric == "plane":
        rows = rows.withColumns({f"__n{i}": along([F.col(c) for c in ("nx", "ny", "nz")], i) for i in range(6)})
        inner = {(i, j): F.col(f"__n{i}") * F.col(f"__n{j}") for i, j in TRIANGLE}
    else:
        table = ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))
        sides = {}
        for i in range(6):
            column = [F.lit(1.0 if k == i else 0.0) for k in range(3)] if i < 3 else [F.col(f"j{i - 3}{k}") for k in range(3)]
            for k, row in enumerate(table):
                sides[f"__s{i}{k}"] = F.col(row[i]) if i < 3 else G.dot(row, column)
        rows = rows.withColumns(sides)
        inner = {(i, j): along([F.col(f"__s{i}{k}") for k in range(3)], j) for i, j in TRIANGLE}
    good = (d2 * F.col("__e")).between(0.0, 1.0)
    factor = F.when(good, d1 * d2 * F.col("__e")).otherwise(F.lit(0.0))
    rows = rows.withColumn("__f", factor)
    out = {"score": F.when(good, -d1 * F.col("__e")).otherwise(F.lit(0.0))}
    out |= {f"g{i}": F.col("__f") * F.col(f"__w{i}") for i in range(6)}
    for i, j in TRIANGLE:
        curve = G.dot(pull, [f"k{i - 3}{j - 3}{a}" for a in range(3)]) if i >= 3 else F.lit(0.0)
        out[f"h{i}{j}"] = F.col("__f") * (-d2 * F.col(f"__w{i}") * F.col(f"__w{j}") + inner[i, j] + curve)
    return rows.withColumns(out).drop(*[c for c in rows.columns if c.startswith("__")])


def total_derivatives(points: DataFrame, grid: DataFrame, pose: tuple[float, ...], resolution: float, metric: str = "distribution", outliers: float = OUTLIERS) -> DataFrame:
    """One row: the sums of all pairs' TERMS and the number of pairs. One job of an optimiser's step."""
    pairs = N.radius_pairs(with_jacobian(moved(points, pose), pose), grid, resolution)
    each = pair_derivatives(pairs, *constants(resolution, outliers), metric)
    return each.agg(*[F.coalesce(F.sum(t), F.lit(0.0)).alias(t) for t in TERMS], F.count(F.lit(1)).alias("pairs"))


def regularisation(reference, x, y, yaw, pairs, scale: float = 0.01) -> dict[str, Column]:
    """The penalty on the longitudinal distance from a reference position, per pair: score, gradient and Hessian by x and y.
    A null reference gives zeros."""
    s, c = F.sin(G.col(yaw)), F.cos(G.col(yaw))
    along_ = (G.col(reference[1]) - G.col(y)) * s + (G.col(reference[0]) - G.col(x)) * c
    weight = scale * G.col(pairs)
    terms = {
        "reg_score": -weight * along_ * along_,
        "reg_g0": 2 * weight * c * along_,
        "reg_g1": 2 * weight * s * along_,
        "reg_h00": -2 * weight * c * c,
        "reg_h01": -2 * weight * c * s,
        "reg_h11": -2 * weight * s * s,
    }
    missing = G.col(reference[0]).isNull() | G.col(reference[1]).isNull()
    return {k: F.when(missing, F.lit(0.0)).otherwise(v) for k, v in terms.items()}
