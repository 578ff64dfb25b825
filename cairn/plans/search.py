"""Search for an initial pose: a tree-structured Parzen sampler over alignments."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.operators import voxel as V

from . import alignment as A
from .newton import Arrays, Settings, maximise

#: Parameters that the density ratio looks at: x, y and yaw.
SCORED = (0, 1, 5)
CANDIDATES, PENALTY = 100, 5.0
MOST_TRIALS = 100_000


def good_count(trials: int) -> int:
    """A tenth of the trials, 1 to 10."""
    return min(max(trials // 10, 1), 10) if trials else 0


def log_sum_exp(values: np.ndarray) -> float:
    top = values.max(initial=-math.inf)
    return top if not math.isfinite(top) else top + math.log(np.exp(values - top).sum())


@dataclass
class Sampler:
    """Draws poses: from the prior at first, then the best of CANDIDATES by the ratio of densities around good and bad trials.

    The prior is normal but for yaw, which is uniform on [-pi, pi) unless ``yaw_normal``. ``spread``: the kernels' deviations.
    """

    mean: np.ndarray
    deviation: np.ndarray
    startup: int
    spread: np.ndarray
    maximise: bool = True
    yaw_normal: bool = False
    seed: int = 0
    trials: list[tuple[float, np.ndarray]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.random = np.random.default_rng(self.seed)

    def add(self, pose: np.ndarray, score: float) -> None:
        """Keeps trials best first; among equals the earlier one first."""
        self.trials.append((score, np.asarray(pose, float)))
        self.trials.sort(key=lambda t: -t[0] if self.maximise else t[0])

    def prior(self) -> np.ndarray:
        pose = self.random.normal(self.mean, self.deviation)
        if not self.yaw_normal:
            pose[5] = self.random.uniform(-math.pi, math.pi)
        return pose

    def ratio(self, pose: np.ndarray) -> float:
        n, good = len(self.trials), good_count(len(self.trials))
        if not n or not good or good >= n:
            return 0.0
        gap = np.array([t[1] for t in self.trials]) - pose
        gap[:, 5] = (gap[:, 5] + math.pi) % (2 * math.pi) - math.pi
        scaled = gap[:, SCORED] / self.spread[list(SCORED)]
        log = -0.5 * (scaled**2).sum(axis=1) - np.log(self.spread[list(SCORED)] * math.sqrt(2 * math.pi)).sum()
        return log_sum_exp(log[:good] - math.log(good)) - PENALTY * log_sum_exp(log[good:] - math.log(n - good))

    def next(self) -> np.ndarray:
        if len(self.trials) < self.startup or not good_count(len(self.trials)):
            return self.prior()
        drawn = [self.prior() for _ in range(CANDIDATES)]
        return max(drawn, key=self.ratio)


def density_ratio(candidates: DataFrame, trials: DataFrame, spread: tuple[float, float, float], good: int) -> DataFrame:
    """The ratio for many candidates (candidate_id, x, y, yaw) at once against ranked trials (rank from 1, x, y, yaw).

    Every candidate meets all trials of the search: those are sent to all tasks, and must be MOST_TRIALS at most.
    """
    if trials.limit(MOST_TRIALS + 1).count() > MOST_TRIALS:
        raise ValueError(f"a search has {MOST_TRIALS} trials at most")
    met = candidates.crossJoin(F.broadcast(trials.select("rank", *[F.col(c).alias(f"t_{c}") for c in ("x", "y", "yaw")])))
    terms = []
    for c, s in zip(("x", "y", "yaw"), spread, strict=True):
        gap = F.col(c) - F.col(f"t_{c}")
        z = (G.wrap(gap) if c == "yaw" else gap) / s
        terms.append(-0.5 * z * z - math.log(s * math.sqrt(2 * math.pi)))
    rows = met.withColumn("log", terms[0] + terms[1] + terms[2]).withColumn("is_good", F.col("rank") <= good)
    top = rows.groupBy("candidate_id", "is_good").agg(F.max("log").alias("top"))
    parts = rows.join(top, ["candidate_id", "is_good"]).groupBy("candidate_id", "is_good").agg((F.max("top") + F.log(F.sum(F.exp(F.col("log") - F.col("top"))) / F.count(F.lit(1)))).alias("l"))
    return parts.groupBy("candidate_id").agg((F.max(F.when(F.col("is_good"), F.col("l"))) - PENALTY * F.max(F.when(~F.col("is_good"), F.col("l")))).alias("ratio"))


def sampler_of(mean, covariance: np.ndarray, startup: int, seed: int, floors=(0.1, 0.1, 0.1, 0.01, 0.01, 0.01)) -> Sampler:
    deviation = np.maximum(np.sqrt(np.diag(covariance)), floors)
    return Sampler(np.asarray(mean, float), deviation, startup, deviation, seed=seed)


@dataclass
class Estimate:
    pose: np.ndarray
    score: float
    reliable: bool
    trajectory: list[float]
    particles: list[tuple[np.ndarray, float, float, int]]


def estimate(align_batch: Callable[[list[np.ndarray]], list[tuple[np.ndarray, float, float, int]]], mean, covariance: np.ndarray, startup: int = 100, total: int = 200, threshold: float = 2.3, seed: int = 0, floors=(0.1, 0.1, 0.1, 0.01, 0.01, 0.01), first: list[tuple] | None = None) -> Estimate:
    """The best of ``total`` aligned hypotheses: ``startup`` drawn and aligned together, the others one after another, as each draw depends on
    all before. ``align_batch`` gives (pose, NVTL, score per point, iterations) for each start. Selected by NVTL, or by five times the score per point where there is none;
    reliable from ``threshold`` on. ``first``: what aligning the drawn ones has given, where that is done."""
    sampler = sampler_of(mean, covariance, startup, seed, floors)
    particles, trajectory = [], []

    def take(starts: list[np.ndarray], known: list[tuple] | None = None) -> None:
        for found in align_batch(starts) if known is None else known:
            pose, nvtl, per_point, _ = found
            particles.append(found)
            sampler.add(pose, per_point)
            rank = nvtl if nvtl > 0 else 5 * per_point
            trajectory.append(max(trajectory[-1], rank) if trajectory else rank)

    take([sampler.prior() for _ in range(min(startup, total))], first)
    while len(particles) < total:
        take([sampler.next()])
    ranks = [p[1] if p[1] > 0 else 5 * p[2] for p in particles]
    best = max(range(len(ranks)), key=lambda k: (ranks[k], k))
    return Estimate(particles[best][0], ranks[best], ranks[best] >= threshold, trajectory, particles)


ESTIMATE = "scan_id string, score double, reliable boolean, particles int, trajectory array<double>, " + ", ".join(f"{c} double" for c in A.POSE)


def estimate_many(scans: DataFrame, priors: DataFrame, grid: DataFrame, settings: Settings = Settings(), startup: int = 100, total: int = 200, seed: int = 0, threshold: float = 2.3) -> DataFrame:
    """``estimate`` for many scans (scan_id, x, y, z) with priors (scan_id, mean, covariance: 6 and 36 numbers): a row of ESTIMATE each.

    A task has the scan and the part of the map that its points can reach: turned by any yaw about the prior's position, moved by six of its deviations and by the
    iterations' steps. The drawn hypotheses don't depend on each other: where there are fewer scans than cores, tasks share them. The guided ones are sequential, so a task runs
    them to the end.
    """
    spread = F.sqrt(F.greatest(*[F.col("covariance")[7 * k] for k in range(3)]))
    radius = scans.agg(F.max(F.sqrt(sum((F.col(a) * F.col(a) for a in V.XYZ), F.lit(0.0)))).alias("r")).first()["r"] or 0.0
    wide, count = priors.agg(F.max(spread), F.count(F.lit(1))).first()
    wide = wide or 0.0
    shares = min(startup, total, -(-scans.sparkSession.sparkContext.defaultParallelism // max(count, 1)))
    starts = priors.select("scan_id", F.lit(0).cast("long").alias("start_id"), *[F.col("mean")[k].alias(c) for k, c in enumerate(A.POSE)])
    around = A.nearby_grid(scans, starts, grid, settings, 2 * radius + 6 * max(wide, 0.1) + settings.max_iterations * settings.step)
    columns = list(grid.columns)
    points = scans.select("scan_id", *V.XYZ).join(priors, "scan_id")

    def aligner(left: pd.DataFrame, right: pd.DataFrame) -> Callable[[list[np.ndarray]], list[tuple]]:
        own, arrays = left[list(V.XYZ)].to_numpy(float), Arrays(right[columns], settings.resolution, settings.metric, settings.outliers)

        def aligned(starts: list[np.ndarray]) -> list[tuple]:
            found = [maximise(lambda p: arrays.evaluate(own, p), s, settings) for s in starts]
            return [(f.pose, arrays.nvtl(own, f.pose), f.score / len(own), f.iterations) for f in found]

        return aligned

    def prior_of(left: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return left["mean"].iloc[0], np.array(left["covariance"].iloc[0]).reshape(6, 6)

    def run_share(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame()
        sampler = sampler_of(*prior_of(left), startup, seed)
        starts = list(enumerate(sampler.prior() for _ in range(min(startup, total))))[int(key[1]) :: shares]
        found = aligner(left, right)([s for _, s in starts])
        return pd.DataFrame([(key[0], k, list(f[0]), *f[1:]) for (k, _), f in zip(starts, found, strict=True)], columns=["scan_id", "place", "pose", "nvtl", "per_point", "iterations"])

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame()
        first = None
        if shares > 1:
            told = left["first"].notna()
            first = [(np.array(f["pose"]), f["nvtl"], f["per_point"], f["iterations"]) for f in left["first"][told].iloc[0]]
            left = left[~told]
        found = estimate(aligner(left, right), *prior_of(left), startup, total, threshold, seed, first=first)
        values = [key[0], found.score, found.reliable, len(found.particles), found.trajectory, *found.pose]
        return pd.DataFrame([values], columns=[c.split()[0] for c in ESTIMATE.split(", ")])

    around = around.withColumnRenamed("scan_id", "of_scan")
    if shares > 1:
        dealt = [df.withColumn(f"{name}share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))) for df, name in ((points, ""), (around, "of_"))]
        drawn = dealt[0].groupBy("scan_id", "share").cogroup(dealt[1].groupBy("of_scan", "of_share")).applyInPandas(run_share, "scan_id string, place int, pose array<double>, nvtl double, per_point double, iterations int")
        drawn = drawn.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("place", "pose", "nvtl", "per_point", "iterations"))).alias("first"))
        # one more row of each scan has them, not every point
        points = points.unionByName(priors.join(drawn, "scan_id"), allowMissingColumns=True)
    return points.groupBy("scan_id").cogroup(around.groupBy("of_scan")).applyInPandas(run, ESTIMATE)
