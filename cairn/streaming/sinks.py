"""Outputs: topics, markers, reports, JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geometry as G


def json_lines(rows: DataFrame, path: str, append: bool = True) -> None:
    """Rows as JSON objects, one a line; not one file, but one per task."""
    rows.write.mode("append" if append else "overwrite").json(path)


def topics(results: DataFrame, names: dict[str, str]) -> DataFrame:
    """One results table as messages (topic, stamp_ns, payload): ``names`` maps a topic to the SQL of its payload."""
    parts = [F.struct(F.lit(t).alias("topic"), F.col("stamp_ns"), F.expr(e).cast("string").alias("payload")) for t, e in names.items()]
    return results.select(F.explode(F.array(*parts)).alias("m")).select("m.*").filter(F.col("payload").isNotNull())


def tf_broadcast(results: DataFrame, frame: str = "map", child: str = "ndt_base") -> DataFrame:
    q = G.quaternion("roll", "pitch", "yaw")
    return results.select(F.lit(frame).alias("parent"), F.lit(child).alias("child"), "stamp_ns", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"), *[e.alias(c) for e, c in zip(q, ("qx", "qy", "qz", "qw"), strict=True)])


def particle_markers(particles: DataFrame, alpha: float = 0.7, best_alpha: float = 1.0) -> DataFrame:
    """A marker for each particle and colour scheme, and one for each initial pose; the best particle is opaque.

    ``particles``: (search_id, particle_id, score, iterations, x, y, z, ix, iy, iz).
    """
    own = Window.partitionBy("search_id")
    rows = particles.withColumns(
        {
            "__low": F.min("score").over(own),
            "__span": F.greatest(F.max("score").over(own) - F.min("score").over(own), F.lit(0.001)),
            "__most": F.max("iterations").over(own),
            "__total": F.count(F.lit(1)).over(own),
            "__best": F.max(F.struct("score", "particle_id")).over(own),
        }
    )
    index = F.row_number().over(own.orderBy("particle_id")) - 1
    rows = rows.withColumn("__index", index)
    made = []
    for place, axes in (("result", ("x", "y", "z")), ("initial", ("ix", "iy", "iz"))):
        for scheme in ("score", "iteration", "index"):
            colour = G.particle_colour(scheme, "score", "__low", "__span", "iterations", "__most", "__index", "__total")
            made.append(F.struct(F.lit(f"{place}_{scheme}").alias("namespace"), *[F.col(a).alias(b) for a, b in zip(axes, "xyz", strict=True)], *[c.cast("double").alias(n) for c, n in zip(colour, ("r", "g", "b"), strict=True)]))
    opaque = F.when(F.col("particle_id") == F.col("__best.particle_id"), best_alpha).otherwise(alpha)
    return rows.select("search_id", "particle_id", opaque.alias("a"), F.explode(F.array(*made)).alias("m")).select("search_id", "particle_id", "m.*", "a")


def pose_history(poses: DataFrame, by: list[str], order: str) -> DataFrame:
    """Arrows along an alignment, coloured by progress."""
    w = Window.partitionBy(*by)
    step = F.row_number().over(w.orderBy(order)) - 1
    rows = poses.withColumn("step", step).withColumn("__n", F.count(F.lit(1)).over(w))
    return rows.withColumns(dict(zip(("r", "g", "b"), G.progress_colour("step", "__n"), strict=True))).drop("__n")


def markdown(rows: list[dict], columns: list[str] | None = None) -> str:
    """A small table of statistics in Markdown."""
    if not rows:
        return "_no rows_\n"
    columns = columns or list(rows[0])
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def summary(stats: DataFrame, path: str | None = None) -> str:
    """Statistics (a few rows) as JSON; written to ``path`` if given."""
    text = json.dumps([r.asDict(True) for r in stats.collect()], indent=2, sort_keys=True, default=str)
    if path:
        stats.coalesce(1).write.mode("overwrite").json(path)
    return text
