"""Statistics of logs, trajectories and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geometry as G

from . import voxel as V

# --- descriptive statistics ----------------------------------------------------------------------


def basic_stats(value: str, prefix: str = "") -> list[Column]:
    """mean, max, min, population standard deviation, count."""
    return [F.avg(value).alias(f"{prefix}mean"), F.max(value).alias(f"{prefix}max"), F.min(value).alias(f"{prefix}min"), F.stddev_pop(value).alias(f"{prefix}std"), F.count(value).alias(f"{prefix}count")]


def with_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``__r``, the place (from 0) of a value among those of its key, and ``__n``, how many there are; nulls have no place.

    Ranks come from ranges of values, so neither a key's rows nor its different values meet in one task or buffer.
    """
    ranked = V.in_order(df, F.col(value).isNotNull().cast("long"), [value], "__r", by, "__n")
    return ranked.withColumn("__r", F.when(F.col(value).isNotNull(), F.col("__r") - 1))


def at_rank(value: str, place: Column) -> Column:
    return F.max(F.when(F.col("__r") == place, F.col(value)))


def percentile(value: str, q: float) -> Column:
    """The linear percentile as an aggregate of rows with ranks."""
    place = (F.col("__n") - 1) * F.lit(float(q))
    low, high = at_rank(value, F.floor(place)), at_rank(value, F.ceil(place))
    return low + (high - low) * F.max(place - F.floor(place))


def percentile_by_index(value: str, q: float) -> Column:
    """The value with floor(q n) smaller places."""
    return at_rank(value, F.floor(F.col("__n") * F.lit(float(q))))


def profile_stats_index(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per mode: mean, median, sample deviation, min, max, 95th and 99th percentile by index, share of converged."""
    return with_ranks(df, value, by).groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        percentile(value, 0.5).alias("median"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        percentile_by_index(value, 0.95).alias("p95"),
        percentile_by_index(value, 0.99).alias("p99"),
        (F.avg(F.col("converged").cast("double")) * 100).alias("converged_pct"),
    )


def profile_stats_linear(df: DataFrame, value: str, iterations: str, by: list[str]) -> DataFrame:
    """Mean, population deviation, median, linear percentiles, throughput and the mean of times per iteration."""
    each = F.when(F.col(iterations) > 0, F.col(value) / F.col(iterations))
    return with_ranks(df, value, by).groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        percentile(value, 0.5).alias("median"),
        percentile(value, 0.95).alias("p95"),
        percentile(value, 0.99).alias("p99"),
        F.try_divide(F.lit(1000.0), F.avg(value)).alias("throughput"),
        F.avg(each).alias("ms_per_iteration"),
    )


def by_iterations(df: DataFrame, value: str, iterations: str) -> DataFrame:
    return df.groupBy(iterations).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def warm_up(df: DataFrame, value: str, order: list[str], by: list[str], first: int = 10) -> DataFrame:
    """Mean of the first rows and of the others; zeros if there are no others.

    The first rows are found by a limit that each task applies before rows are moved; the others' sum is the whole less theirs.
    """
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    early = df.withColumn("__place", nth).filter(F.col("__place") <= first)
    none, zero = F.lit(0).cast("long"), F.lit(0.0)
    sums = lambda rows, *rest: rows.groupBy(*by).agg(F.coalesce(F.sum(value), zero).alias("s"), F.count(value).alias("c"), *rest)
    whole = sums(df, F.count(F.lit(1)).alias("n")).select(*by, "s", "c", "n", zero.alias("es"), none.alias("ec"))
    start = sums(early).select(*by, zero.alias("s"), none.alias("c"), none.alias("n"), F.col("s").alias("es"), F.col("c").alias("ec"))
    both = whole.union(start).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("s", "c", "n", "es", "ec")])
    mean = lambda total, count: F.when(F.col("n") > first, F.try_divide(total, count)).otherwise(zero)
    return both.select(*by, mean(F.col("es"), F.col("ec")).alias("warm_up_mean"), mean(F.col("s") - F.col("es"), F.col("c") - F.col("ec")).alias("steady_mean"))


def overhead(release: DataFrame, debug: DataFrame, value: str) -> DataFrame:
    """How much slower the second run's mean is: difference, per cent, ratio; zeros where a mean is 0."""
    both = release.agg(F.avg(value).alias("release_mean")).crossJoin(debug.agg(F.avg(value).alias("debug_mean")))
    r, d = F.col("release_mean"), F.col("debug_mean")
    return both.select("release_mean", "debug_mean", (d - r).alias("overhead_ms"), F.when(r != 0, (d - r) / r * 100).otherwise(F.lit(0.0)).alias("overhead_pct"), F.when(r != 0, d / r).otherwise(F.lit(0.0)).alias("ratio"))


def speed_up(stats: DataFrame, mode: str, mean: str, baseline: str) -> DataFrame:
    """Each mode's mean against the baseline's (the first mode by name, if that isn't there)."""
    base = stats.agg(F.coalesce(F.max(F.when(F.col(mode) == baseline, F.col(mean))), F.min_by(mean, mode)).alias("baseline_mean"))
    return stats.crossJoin(F.broadcast(base)).select(mode, mean, "baseline_mean", F.when(F.col(mean) > 0, F.col("baseline_mean") / F.col(mean)).otherwise(F.lit(0.0)).alias("speed_up"))


def init_stats(entries: DataFrame, total: str, particles: str, reliable: str) -> DataFrame:
    """Statistics of initial-pose records and of their particles' times together."""
    own = entries.agg(F.count(F.lit(1)).alias("n"), F.avg(total).alias("mean_total"), F.max(total).alias("max_total"), (F.avg(F.col(reliable).cast("double")) * 100).alias("reliable_pct"))
    each = with_ranks(entries.select(F.explode(particles).alias("p")), "p").agg(F.count("p").alias("n_particles"), F.avg("p").alias("mean_particle"), percentile("p", 0.95).alias("p95_particle"))
    return own.crossJoin(each)


def score_comparison(reference: DataFrame, test: DataFrame, value: str) -> DataFrame:
    """Statistics of two distributions, the difference and ratio of their means (null for a mean of 0)."""
    stats = lambda p: [F.avg(value).alias(f"{p}_mean"), F.stddev_pop(value).alias(f"{p}_std"), F.min(value).alias(f"{p}_min"), F.max(value).alias(f"{p}_max"), percentile(value, 0.5).alias(f"{p}_median"), F.count(value).alias(f"{p}_n")]
    both = with_ranks(reference, value).agg(*stats("ref")).crossJoin(with_ranks(test, value).agg(*stats("test")))
    return both.withColumn("mean_diff", F.col("test_mean") - F.col("ref_mean")).withColumn("mean_ratio", F.when(F.col("ref_mean") != 0, F.col("test_mean") / F.col("ref_mean")))


def convergence_rate(df: DataFrame, converged: str = "converged") -> DataFrame:
    return df.agg(F.coalesce(F.avg(F.col(converged).cast("double")) * 100, F.lit(0.0)).alias("convergence_pct"), F.count(F.lit(1)).alias("n"))


def clock_offsets(df: DataFrame, wall: str, stamp: str, topic: str) -> DataFrame:
    """Wall clock minus message stamp of each topic in seconds, the largest mean first."""
    gap = (F.col(wall) - F.col(stamp)) / 1e9
    return df.groupBy(topic).agg(F.avg(gap).alias("mean_offset"), F.min(gap).alias("min_offset"), F.max(gap).alias("max_offset")).orderBy(F.abs("mean_offset").desc(), topic)


def weighted_covariance(df: DataFrame, x: str, y: str, weight: str, by: list[str]) -> DataFrame:
    """Weighted mean and covariance in the plane, weights that sum to 1."""
    mean = df.groupBy(*by).agg(F.sum(F.col(weight) * F.col(x)).alias("mean_x"), F.sum(F.col(weight) * F.col(y)).alias("mean_y"))
    dx, dy, w = F.col(x) - F.col("mean_x"), F.col(y) - F.col("mean_y"), F.col(weight)
    return df.join(mean, by).groupBy(*by, "mean_x", "mean_y").agg(F.sum(w * dx * dx).alias("cxx"), F.sum(w * dx * dy).alias("cxy"), F.sum(w * dy * dy).alias("cyy"))


def sample_covariance(df: DataFrame, x: str, y: str, by: list[str], reference_scaling: bool = False) -> DataFrame:
    """Covariance in the plane by n - 1, the unit matrix for fewer than two rows. ``reference_scaling``: divided by n and times (n - 1) / n instead."""
    n = F.count(F.lit(1))
    factor = (n - 1) * (n - 1) / (n * n) if reference_scaling else F.lit(1.0)
    own = lambda a, b, one: F.coalesce(F.covar_samp(a, b) * factor, F.lit(one))
    return df.groupBy(*by).agg(n.alias("n"), own(x, x, 1.0).alias("cxx"), own(x, y, 0.0).alias("cxy"), own(y, y, 1.0).alias("cyy"))


def softmax(df: DataFrame, score: str, temperature: float, by: list[str], out: str = "weight") -> DataFrame:
    """Weights exp((s - max) / T), normalised within ``by``."""
    part = Window.partitionBy(*by)
    power = F.exp((F.col(score) - F.max(score).over(part)) / temperature)
    rows = df.withColumn("__e", power)
    total = F.sum("__e").over(part)
    return rows.withColumn(out, F.when(total > 0, F.col("__e") / total).otherwise(1 / F.count(F.lit(1)).over(part))).drop("__e")


def log_sum_exp(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """ln sum exp per group, by the maximum first."""
    top = df.groupBy(*by).agg(F.max(value).alias("__m"))
    return df.join(top, by).groupBy(*by).agg((F.max("__m") + F.log(F.sum(F.exp(F.col(value) - F.col("__m"))))).alias("lse"))


def best_by(df: DataFrame, score: str, tie: str, by: list[str], largest_tie: bool = True) -> DataFrame:
    """The row with the greatest score; among equals the last by ``tie``."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(score, tie if largest_tie else -F.col(tie))).alias("__b")).select(*by, "__b.*")


# --- windows -------------------------------------------------------------------------------------


def line(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def max_jump(df: DataFrame, axes, by: list[str], order: list[str]) -> DataFrame:
    """The longest way between consecutive poses."""
    w = line(by, order)
    gap = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in axes[1:]), (F.col(axes[0]) - F.lag(axes[0]).over(w)) * (F.col(axes[0]) - F.lag(axes[0]).over(w))))
    return df.withColumn("__jump", gap).groupBy(*by).agg(F.coalesce(F.max("__jump"), F.lit(0.0)).alias("max_jump"))


def frame_deltas(df: DataFrame, start, final, by: list[str], order: list[str]) -> DataFrame:
    """How far a frame starts from where the one before it ended, and whether it follows it: yes (under 0.01), close (under 0.1), no."""
    w = line(by, order)
    rows = df.withColumns({f"__p{i}": F.lag(c).over(w) for i, c in enumerate(final)})
    delta = G.distance(start, [f"__p{i}" for i in range(len(final))])
    rows = rows.withColumn("delta", delta).drop(*[f"__p{i}" for i in range(len(final))])
    return rows.withColumn("follows", F.when(F.col("delta") < 0.01, "yes").when(F.col("delta") < 0.1, "close").when(F.col("delta").isNotNull(), "no"))


def oscillation(df: DataFrame, axes, by: list[str], order: list[str], cosine: float = -0.9, tiny: float = 1e-10, most: int = 10) -> DataFrame:
    """The longest run of reversals: consecutive moves whose cosine is under ``cosine``; a tiny move ends a run."""
    w = line(by, order)
    rows = df.withColumns({f"__d{a}": F.col(a) - F.lag(a).over(w) for a in axes})
    rows = rows.withColumns({f"__b{a}": F.lag(f"__d{a}").over(w) for a in axes})
    now, old = [F.col(f"__d{a}") for a in axes], [F.col(f"__b{a}") for a in axes]
    size, before = F.sqrt(G.dot(now, now)), F.sqrt(G.dot(old, old))
    turns = F.when((size < tiny) | (before < tiny), F.lit(False)).otherwise(F.try_divide(G.dot(now, old), size * before) < cosine)
    rows = rows.withColumn("__turn", F.coalesce(turns, F.lit(False)))
    rows = rows.withColumn("__island", F.sum(F.when(F.col("__turn"), 0).otherwise(1)).over(w))
    runs = rows.filter("__turn").groupBy(*by, "__island").agg(F.count(F.lit(1)).alias("n"))
    longest = runs.groupBy(*by).agg(F.max("n").alias("longest"))
    return df.select(*by).distinct().join(longest, by, "left").select(*by, F.coalesce("longest", F.lit(0)).alias("oscillations"), (F.coalesce("longest", F.lit(0)) > most).alias("oscillating"))


def first_divergence(df: DataFrame, gap: str, place: str, by: list[str], threshold: float) -> DataFrame:
    return df.groupBy(*by).agg(F.min(F.when(F.col(gap) > threshold, F.col(place))).alias("first_place"))


def crossings(df: DataFrame, value: str, by: list[str], order: list[str], threshold: float = 0.5) -> DataFrame:
    """Rows where the value passes the threshold upward."""
    before = F.lag(value).over(line(by, order))
    return df.withColumn("before", before).filter((F.col("before") <= threshold) & (F.col(value) > threshold))


def milestones(df: DataFrame, value: str, place: str, by: list[str], levels=(0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0)) -> DataFrame:
    """Where the value first passes each level."""
    steps = F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")
    return df.select("*", steps).filter(F.col(value) > F.col("level")).groupBy(*by, "level").agg(F.min(place).alias("first_place"))


def running_best(df: DataFrame, score: str, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("best_so_far", F.max(score).over(line(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def skip_counter(df: DataFrame, ok: str, by: list[str], order: list[str]) -> DataFrame:
    """How many rows in a row have failed, 0 at each success."""
    w = line(by, order)
    rows = df.withColumn("__island", F.sum(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*by, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("skips", F.sum((~F.col(ok)).cast("long")).over(inner)).drop("__island")


def reversals(iterations: str, flag: str = "direction_reversed") -> Column:
    return F.size(F.filter(iterations, lambda i: i[flag]))


def monotonic(df: DataFrame, time: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows whose time is later than any before them."""
    before = F.max(time).over(line(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col(time) > F.col("__before"))).drop("__before")


# --- trajectories --------------------------------------------------------------------------------


def trajectory_error(pairs: DataFrame, a, b) -> DataFrame:
    """RMSE and greatest distance of matched positions; infinite without pairs."""
    gap = pairs.select(G.distance(a, b).alias("d"))
    inf = F.lit(float("inf"))
    return gap.agg(F.coalesce(F.sqrt(F.avg(F.col("d") * F.col("d"))), inf).alias("rmse"), F.coalesce(F.max("d"), inf).alias("max_error"), F.count("d").alias("n"))


def difference_summary(pairs: DataFrame, names: dict[str, Column]) -> DataFrame:
    """mean, population deviation, min, max and 95th percentile of each difference."""
    rows = pairs.select(*[e.alias(n) for n, e in names.items()])
    columns = []
    for n in names:
        columns += [F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std"), F.min(n).alias(f"{n}_min"), F.max(n).alias(f"{n}_max"), F.percentile(n, 0.95).alias(f"{n}_p95")]
    return rows.agg(*columns, F.count(F.lit(1)).alias("n"))


def accepted(converged, oscillations, score, threshold: float, most: int = 10) -> Column:
    """Whether an alignment may be used: converged, few reversals, a score at the threshold at least."""
    return G.col(converged) & (G.col(oscillations) <= most) & (G.col(score) >= threshold)
