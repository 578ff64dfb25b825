"""The optimiser's driver-side algebra: Newton steps, line searches, and a NumPy version of the score's derivatives.

The same update drives both execution modes: ``alignment.align`` sums derivatives with a Spark job per step, ``alignment.align_many``
sums them inside a task with ``Arrays``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from cairn.functions import geometry as G
from cairn.operators import scoring as S
from cairn.operators import voxel as V

CONVERGED, LIMIT, SINGULAR, NO_PAIRS = "Converged", "MaxIterations", "SingularHessian", "NoCorrespondences"


@dataclass(frozen=True)
class Settings:
    """Defaults of matching: ``step`` is the longest step, not a damping."""

    resolution: float = 2.0
    max_iterations: int = 30
    epsilon: float = 0.01
    step: float = 0.1
    outliers: float = 0.55
    least_points: int = 6
    least_pairs: int = 10
    search: str = "none"
    metric: str = "distribution"
    reference: tuple[float, float] | None = None
    reference_scale: float = 0.01
    tolerance: float = 1e-10


@dataclass
class Evaluation:
    score: float
    gradient: np.ndarray
    hessian: np.ndarray
    pairs: int

    @staticmethod
    def of(row) -> Evaluation:
        """From the sums of ``scoring.total_derivatives``."""
        hessian = np.zeros((6, 6))
        for i, j in S.TRIANGLE:
            hessian[i, j] = hessian[j, i] = row[f"h{i}{j}"]
        return Evaluation(row["score"], np.array([row[f"g{i}"] for i in range(6)]), hessian, int(row["pairs"]))


@dataclass
class Outcome:
    pose: np.ndarray
    status: str
    score: float
    iterations: int
    hessian: np.ndarray
    pairs: int
    oscillations: int
    history: list[np.ndarray] = field(default_factory=list)


def penalised(found: Evaluation, pose: np.ndarray, reference: tuple[float, float] | None, scale: float) -> Evaluation:
    """With the penalty on the longitudinal distance from a reference position."""
    if reference is None:
        return found
    heading = np.array([math.cos(pose[5]), math.sin(pose[5])])
    along = float(heading @ (np.array(reference) - pose[:2]))
    weight = scale * found.pairs
    gradient, hessian = found.gradient.copy(), found.hessian.copy()
    gradient[:2] += 2 * weight * along * heading
    hessian[:2, :2] -= 2 * weight * np.outer(heading, heading)
    return Evaluation(found.score - weight * along**2, gradient, hessian, found.pairs)


# --- steps ---------------------------------------------------------------------------------------


def solve_svd(hessian: np.ndarray, gradient: np.ndarray, tolerance: float = 1e-10) -> np.ndarray | None:
    """-H^-1 g by pseudo-inverse; none if all singular values are within ``tolerance``."""
    u, s, vt = np.linalg.svd(hessian)
    if s[0] <= tolerance:
        return None
    inverse = np.where(s > tolerance, 1 / np.where(s > tolerance, s, 1), 0)
    return -(vt.T * inverse) @ (u.T @ gradient)


def solve_damped(hessian: np.ndarray, gradient: np.ndarray, damping: float) -> np.ndarray | None:
    return solve_svd(hessian + damping * np.eye(len(hessian)), gradient)


def solve_cholesky(hessian: np.ndarray, gradient: np.ndarray) -> np.ndarray | None:
    """-H^-1 g where H is positive definite, else none."""
    try:
        lower = np.linalg.cholesky(hessian)
    except np.linalg.LinAlgError:
        return None
    return -np.linalg.solve(lower.T, np.linalg.solve(lower, gradient))


def solve_stacked(hessians: np.ndarray, gradients: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """``solve_svd`` of many systems at once, (n, k, k) and (n, k): a row of NaN where there is no step."""
    u, s, vt = np.linalg.svd(hessians)
    inverse = np.where(s > tolerance, 1 / np.where(s > tolerance, s, 1), 0)
    steps = -np.einsum("nji,nj,nj->ni", vt, inverse, np.einsum("nkj,nk->nj", u, gradients))
    return np.where(s[:, :1] > tolerance, steps, np.nan)


def ascent_step(hessian: np.ndarray, gradient: np.ndarray, ceiling: float = -1e-3, tolerance: float = 1e-10) -> np.ndarray | None:
    """The Newton step toward a maximum: eigenvalues above ``ceiling`` are lowered to it first."""
    if not (np.isfinite(hessian).all() and np.isfinite(gradient).all()):
        return None
    values, vectors = np.linalg.eigh((hessian + hessian.T) / 2)
    lowered = (vectors * np.minimum(values, ceiling)) @ vectors.T
    return solve_svd(lowered, gradient, tolerance)


def is_positive_definite(m: np.ndarray) -> bool:
    return bool((np.linalg.eigvalsh(m) > 0).all())


def is_negative_definite(m: np.ndarray) -> bool:
    return bool((np.linalg.eigvalsh(m) < 0).all())


def condition_number(m: np.ndarray, tiny: float = 1e-15) -> float:
    s = np.linalg.svd(m, compute_uv=False)
    return math.inf if s[-1] < tiny else float(s[0] / s[-1])


def oscillations(poses: list[np.ndarray], cosine: float = -0.9, tiny: float = 1e-10) -> int:
    """The longest run of reversed moves."""
    moves = np.diff(np.array(poses)[:, :3], axis=0) if len(poses) > 2 else np.zeros((0, 3))
    run = longest = 0
    for a, b in zip(moves, moves[1:], strict=False):
        size = np.linalg.norm(a), np.linalg.norm(b)
        turned = min(size) >= tiny and float(a @ b) / (size[0] * size[1]) < cosine
        run = run + 1 if turned else 0
        longest = max(longest, run)
    return longest


# --- line searches: phi(step) gives the score and its slope along the direction --------------------

Line = Callable[[float], tuple[float, float]]


def backtracking(line: Line, start: tuple[float, float], first: float, c1: float = 1e-4, shrink: float = 0.5, least: float = 1e-6, most: int = 20) -> float:
    """The first of shrinking steps whose gain is a ``c1``-th of what the slope promises."""
    step = first
    for _ in range(most):
        if line(step)[0] >= start[0] + c1 * step * start[1]:
            return step
        step *= shrink
        if step < least:
            break
    return least


def more_thuente(line: Line, start: tuple[float, float], first: float, longest: float, c1: float = 1e-4, c2: float = 0.9, most: int = 10) -> float:
    """A step with sufficient gain and a small slope, by More and Thuente's safeguarded cubic interpolation.

    Works on descent: f = -score. ``lo`` is the best end of the interval that holds the step, ``hi`` the other one.
    """
    f0, d0 = -start[0], -start[1]
    lo = hi = (0.0, f0, d0)
    step, bracketed, auxiliary = min(first, longest), False, True
    for _ in range(most):
        value, slope = line(step)
        f, d = -value, -slope
        if f <= f0 + c1 * step * d0 and abs(d) <= c2 * abs(d0):
            return step
        if step >= longest and f <= f0 + c1 * step * d0 and d <= c1 * d0:
            return step
        if auxiliary and f <= f0 + c1 * step * d0 and d > 0:
            auxiliary = False
        shift = (lambda t: c1 * t * d0) if auxiliary else (lambda t: 0.0)
        tilt = c1 * d0 if auxiliary else 0.0
        trial = (step, f - shift(step), d - tilt)
        best = (lo[0], lo[1] - shift(lo[0]), lo[2] - tilt)
        other = (hi[0], hi[1] - shift(hi[0]), hi[2] - tilt)
        step_next, bracketed = _trial(best, other, trial, bracketed, longest)
        if trial[1] > best[1]:
            hi = (step, f, d)
        else:
            if trial[2] * (trial[0] - best[0]) > 0:
                hi = lo
            lo = (step, f, d)
        if bracketed and abs(hi[0] - lo[0]) < 1e-10:
            break
        step = min(max(step_next, 0.0), longest)
    return lo[0] if lo[0] > 0 else step


def _cubic(a, b) -> float:
    """The minimum of the cubic through two points with slopes."""
    (ta, fa, da), (tb, fb, db) = a, b
    if tb == ta:
        return ta
    z = 3 * (fa - fb) / (tb - ta) + da + db
    root = math.sqrt(max(z * z - da * db, 0.0))
    root = -root if tb < ta else root
    below = db - da + 2 * root
    return tb - (tb - ta) * (db + root - z) / below if below else (ta + tb) / 2


def _secant(a, b) -> float:
    (ta, _, da), (tb, _, db) = a, b
    return tb - (tb - ta) / (db - da) * db if db != da else (ta + tb) / 2


def _trial(lo, hi, at, bracketed: bool, longest: float) -> tuple[float, bool]:
    """The next step from the interval's ends and the point just tried: four cases by value and slope."""
    if at[1] > lo[1]:
        cubic = _cubic(lo, at)
        span = (lo[1] - at[1]) / (at[0] - lo[0]) + lo[2] if at[0] != lo[0] else 0.0
        quadratic = lo[0] + lo[2] / span / 2 * (at[0] - lo[0]) if span else cubic
        return (cubic if abs(cubic - lo[0]) < abs(quadratic - lo[0]) else (cubic + quadratic) / 2), True
    if at[2] * lo[2] < 0:
        cubic, secant = _cubic(lo, at), _secant(lo, at)
        return (cubic if abs(cubic - at[0]) >= abs(secant - at[0]) else secant), True
    if abs(at[2]) <= abs(lo[2]):
        cubic, secant = _cubic(lo, at), _secant(lo, at)
        pick = cubic if abs(cubic - at[0]) < abs(secant - at[0]) else secant
        if bracketed:
            edge = at[0] + 0.66 * (hi[0] - at[0])
            return (min(edge, pick) if at[0] > lo[0] else max(edge, pick)), True
        return (min(max(pick, at[0]), longest) if at[0] > lo[0] else pick), False
    if bracketed:
        return _cubic(hi, at), True
    return (longest if at[0] > lo[0] else 0.0), False


def candidate_steps(first: float = 1.0, ratio: float = 0.618, count: int = 8) -> list[float]:
    return [first * ratio**k for k in range(count)]


def pick_candidate(steps: list[float], values: list[tuple[float, float]], start: tuple[float, float], c1: float = 1e-4, c2: float = 0.9) -> float:
    """The first step that meets the strong Wolfe conditions, else the one with the best score."""
    for step, (value, slope) in zip(steps, values, strict=True):
        if value >= start[0] + c1 * step * start[1] and abs(slope) <= c2 * abs(start[1]):
            return step
    return steps[max(range(len(steps)), key=lambda k: values[k][0])]


# --- the loop ------------------------------------------------------------------------------------


def maximise(evaluate: Callable[[np.ndarray], Evaluation], start, settings: Settings, evaluate_all: Callable | None = None) -> Outcome:
    """Newton's method from a start pose. ``evaluate_all`` takes several poses at once (for the candidate search)."""
    pose = np.array(start, dtype=float)
    history = [pose]
    best = (-math.inf, pose)
    hessian, pairs = np.zeros((6, 6)), 0

    def at(p: np.ndarray) -> Evaluation:
        return penalised(evaluate(p), p, settings.reference, settings.reference_scale)

    def done(p, status, score, iterations, h, n) -> Outcome:
        return Outcome(p, status, score, iterations, h, n, oscillations(history), history)

    for iteration in range(settings.max_iterations):
        found = at(pose)
        if found.pairs < settings.least_pairs:
            if not iteration:
                return done(pose, NO_PAIRS, 0.0, 0, hessian, found.pairs)
            break
        hessian, pairs = found.hessian, found.pairs
        if found.score > best[0]:
            best = (found.score, pose)
        delta = ascent_step(hessian, found.gradient, tolerance=settings.tolerance)
        if delta is None:
            return done(best[1], SINGULAR, best[0], iteration, hessian, pairs)
        size = float(np.linalg.norm(delta))
        if size < settings.epsilon:
            return done(pose, CONVERGED, found.score, iteration + 1, hessian, pairs)
        direction = delta / size
        slope = float(found.gradient @ direction)
        if slope <= 0:
            direction, slope = -direction, -slope
        longest = min(size, settings.step)

        def line(step: float, pose=pose, direction=direction) -> tuple[float, float]:
            own = at(pose + step * direction)
            return own.score, float(own.gradient @ direction)

        if settings.search == "backtracking":
            length = backtracking(line, (found.score, slope), longest)
        elif settings.search == "more_thuente":
            length = more_thuente(line, (found.score, slope), longest, settings.step)
        elif settings.search == "candidates":
            steps = candidate_steps(longest)
            poses = [pose + s * direction for s in steps]
            all_found = evaluate_all(poses) if evaluate_all else [evaluate(p) for p in poses]
            all_found = [penalised(e, p, settings.reference, settings.reference_scale) for e, p in zip(all_found, poses, strict=True)]
            length = pick_candidate(steps, [(e.score, float(e.gradient @ direction)) for e in all_found], (found.score, slope))
        else:
            length = longest
        pose = pose + length * direction
        history.append(pose)
    return done(best[1], LIMIT, best[0], settings.max_iterations, hessian, pairs)


# --- derivatives in NumPy --------------------------------------------------------------------------


#: A symmetric 3 x 3 matrix as six numbers, and where they stand.
UPPER = np.triu_indices(3)
SIX = np.array([[0, 1, 2], [1, 3, 4], [2, 4, 5]])


def monomials(points: np.ndarray) -> np.ndarray:
    """1, the coordinates and their six products: all that sums over points need of them."""
    return np.concatenate([np.ones((len(points), 1)), points, points[:, UPPER[0]] * points[:, UPPER[1]]], axis=1)


#: Points that are evaluated at a time: what their pairs need stays in a core's cache.
POINTS = 2048


class Arrays:
    """A Gaussian grid for lookups inside a task: packed cell keys, sorted."""

    def __init__(self, grid: pd.DataFrame, resolution: float, metric: str = "distribution", outliers: float = 0.55):
        self.resolution, self.metric = resolution, metric
        self.d1, self.d2 = S.constants(resolution, outliers)
        key = self.pack(grid[list(V.KEY)].to_numpy(np.int64))
        order = np.argsort(key)
        self.key = key[order]
        self.mean = grid[list(V.MEANS)].to_numpy(float)[order]
        if metric == "plane":
            normal = grid[["nx", "ny", "nz"]].to_numpy(float)[order]
            self.weight = normal[:, UPPER[0]] * normal[:, UPPER[1]]
        else:
            self.weight = grid[list(V.INV)].to_numpy(float)[order]

    @staticmethod
    def pack(cells: np.ndarray) -> np.ndarray:
        shifted = cells + G.AXIS_BIAS
        return (shifted[..., 0] << 2 * G.AXIS_BITS) | (shifted[..., 1] << G.AXIS_BITS) | shifted[..., 2]

    def pairs(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers of points, ascending, and of voxels whose mean is within the resolution, and the gaps (3, n). Neighbours are looked up once for each cell that holds points."""
        if not len(self.key) or not len(points):
            return np.zeros(0, int), np.zeros(0, int), np.zeros((3, 0))
        offsets = np.stack(np.meshgrid(*[np.arange(-1, 2)] * 3, indexing="ij"), -1).reshape(-1, 3)
        # a packed key plus a packed step is the neighbour's key
        steps = (offsets[:, 0] << 2 * G.AXIS_BITS) + (offsets[:, 1] << G.AXIS_BITS) + offsets[:, 2]
        cell, own = np.unique(self.pack(np.floor(points / self.resolution).astype(np.int64)), return_inverse=True)
        keys = cell[:, None] + steps
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        known = self.key[at] == keys
        size = known.sum(axis=1)
        start = np.cumsum(size) - size
        each = size[own]
        row = np.repeat(np.arange(len(points)), each)
        voxel = at[known][np.repeat(start[own] - np.cumsum(each) + each, each) + np.arange(len(row))]
        gap = np.stack([points[:, k][row] - self.mean[:, k][voxel] for k in range(3)])
        near = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= self.resolution**2
        return row[near], voxel[near], gap[:, near]

    def pulls(self, voxel: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair the voxel's weights (6, n), the weighted gap (3, n), and exp(-d2 / 2 energy)."""
        w = self.weight.T[:, voxel]
        pull = np.stack([w[SIX[i, 0]] * gap[0] + w[SIX[i, 1]] * gap[1] + w[SIX[i, 2]] * gap[2] for i in range(3)])
        return w, pull, np.exp(-self.d2 / 2 * (gap * pull).sum(axis=0))

    def evaluate(self, points: np.ndarray, pose: np.ndarray) -> Evaluation:
        """Score and derivatives, sums over blocks of points. A pair's part in them is a 3-vector and a symmetric 3 x 3 matrix; summed with the monomials of its point (two
        matrix products over the pairs) they give every entry, as the Jacobian is linear in the point."""
        if len(points) > POINTS:
            parts = [self.evaluate(points[k : k + POINTS], pose) for k in range(0, len(points), POINTS)]
            return Evaluation(sum(p.score for p in parts), sum(p.gradient for p in parts), sum(p.hessian for p in parts), sum(p.pairs for p in parts))
        exact, *_ = G.rotation_terms(*pose[3:], tiny=0.0)
        _, first, second = G.rotation_terms(*pose[3:])
        moved = points @ exact.T + pose[:3]
        row, voxel, gap = self.pairs(moved)
        w, pull, power = self.pulls(voxel, gap)
        good = (self.d2 * power >= 0) & (self.d2 * power <= 1)
        factor = np.where(good, self.d1 * self.d2 * power, 0.0)
        curve = factor * (w - self.d2 * pull[UPPER[0]] * pull[UPPER[1]])
        own = monomials(points)[row]
        force, bend = (factor * pull) @ own[:, :4], (curve @ own)[SIX]
        first, second = np.asarray(first), np.asarray(second)
        gradient = np.concatenate([force[:, 0], np.einsum("ail,il->a", first, force[:, 1:])])
        hessian = np.empty((6, 6))
        hessian[:3, :3] = bend[..., 0]
        hessian[:3, 3:] = np.einsum("ikl,akl->ia", bend[..., 1:4], first)
        hessian[3:, :3] = hessian[:3, 3:].T
        hessian[3:, 3:] = np.einsum("ail,iklm,bkm->ab", first, bend[..., 4:][..., SIX], first) + np.einsum("abil,il->ab", second, force[:, 1:])
        return Evaluation(float(-self.d1 * power[good].sum()), gradient, hessian, len(row))

    def nvtl(self, points: np.ndarray, pose: np.ndarray) -> float:
        """The mean over matched points of their best score."""
        exact, *_ = G.rotation_terms(*pose[3:], tiny=0.0)
        moved = points @ exact.T + pose[:3]
        row, voxel, gap = self.pairs(moved)
        if not len(row):
            return 0.0
        *_, power = self.pulls(voxel, gap)
        best = np.maximum.reduceat(-self.d1 * power, np.flatnonzero(np.append(True, row[1:] != row[:-1])))
        return float(best.mean())
