"""Stateful operators on pose and scan streams: buffers, queues, transforms, tiles.

Each has a batch form (windows in arrival order) and, where state outlives a batch, a streaming form with the
same rule, which tests compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.operators import tiles as T

# --- pose buffer ---------------------------------------------------------------------------------


def sessions(poses: DataFrame, by: list[str], order: list[str], time: str = "stamp_ns") -> DataFrame:
    """Adds ``session``: a pose that is older than the one before it clears the buffer, and so starts a new session."""
    w = Window.partitionBy(*by).orderBy(*order)
    back = F.coalesce((F.col(time) < F.lag(time).over(w)).cast("long"), F.lit(0))
    return poses.withColumn("__back", back).withColumn("session", F.sum("__back").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__back")


def buffered(poses: DataFrame, by: list[str], order: list[str], time: str = "stamp_ns") -> DataFrame:
    """What the buffer holds at the end: the poses of the last session."""
    rows = sessions(poses, by, order, time)
    return rows.withColumn("__last", F.max("session").over(Window.partitionBy(*by))).filter("session = __last").drop("__last", "session")


def evicted(buffer: DataFrame, by: list[str], before: dict | int, time: str = "stamp_ns") -> DataFrame:
    """The buffer without poses older than a time; the newest of those stays, as it may bracket a query."""
    limit = F.lit(before).cast("long")
    older = F.max(F.when(F.col(time) < limit, F.col(time))).over(Window.partitionBy(*by))
    return buffer.withColumn("__old", older).filter((F.col(time) >= limit) | (F.col(time) == F.col("__old"))).drop("__old")


def valid_pair(time, prev_time, next_time, a, b, timeout_ns: int = 1_000_000_000, jump: float = 10.0):
    """Both poses nearer than the timeout, and nearer to each other than a jump."""
    fresh = (F.abs(G.col(time) - G.col(prev_time)) < timeout_ns) & (F.abs(G.col(next_time) - G.col(time)) < timeout_ns)
    return fresh & (G.distance(a, b) < jump)


SESSION_OUT = "source string, stamp_ns long, x double, y double, z double, session long, held long"


def pose_stream(poses: DataFrame, keep_ns: int = 10_000_000_000) -> DataFrame:
    """A stream (source, seq, stamp_ns, x, y, z) with each pose's session and how many poses its buffer holds, poses older than ``keep_ns`` evicted but one.

    State of a source: its session, last stamp and held stamps. Rows of a micro-batch count in order of ``seq``.
    """

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        session, last, held = state.get if state.exists else (0, None, [])
        rows = pd.concat(list(frames)).sort_values("seq")
        held, out = list(held), []
        for r in rows.itertuples():
            if last is not None and r.stamp_ns < last:
                session, held = session + 1, []
            last = int(r.stamp_ns)
            held.append(last)
            old = [h for h in held if h < last - keep_ns]
            held = old[-1:] + [h for h in held if h >= last - keep_ns]
            out.append((key[0], last, r.x, r.y, r.z, session, len(held)))
        state.update((session, last, held))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SESSION_OUT.split(", ")])

    return poses.groupBy("source").applyInPandasWithState(update, SESSION_OUT, "session long, last long, held array<long>", "append", "NoTimeout")


def toggled(poses: DataFrame, switches: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``session``: how often the service was switched (on or off) before a pose, which clears the buffer each time.

    Both tables are sorted together; no pair of rows is compared.
    """
    marks = switches.select(*by, order, F.lit(1).cast("long").alias("__mark"), F.lit(None).cast("boolean").alias("__pose"))
    both = poses.withColumn("__mark", F.lit(0).cast("long")).withColumn("__pose", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    line = Window.partitionBy(*by).orderBy(order, F.col("__mark").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("session", F.sum("__mark").over(line)).filter("__pose").drop("__mark", "__pose")


def keep_last(rows: DataFrame, by: list[str], order: str, n: int = 1) -> DataFrame:
    """What a subscription that keeps its last ``n`` messages holds. Each task limits its rows before they are moved."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))
    return rows.withColumn("__n", nth).filter(F.col("__n") <= n).drop("__n")


def subscribe(stream: DataFrame, by: list[str], order: str, n: int, held: str):
    """Starts a stream that keeps the last ``n`` messages of each source in the table ``held`` (Parquet versions by micro-batch)."""

    def fold(batch: DataFrame, number: int) -> None:
        own = keep_last(batch, by, order, n)
        if number:
            own = keep_last(batch.unionByName(batch.sparkSession.read.parquet(f"{held}/v{number - 1}")), by, order, n)
        own.write.mode("overwrite").parquet(f"{held}/v{number}")

    return stream.writeStream.foreachBatch(fold)


# --- transforms ----------------------------------------------------------------------------------


def ring(transforms: DataFrame, size: int = 100) -> DataFrame:
    """What is kept of each edge: the last ``size`` samples by arrival, of static edges the last one."""
    nth = F.row_number().over(Window.partitionBy("parent", "child").orderBy(F.col("seq").desc()))
    # each task limits its rows before they are moved, so an edge's window holds that many from each
    last = transforms.withColumn("__n", nth).filter(F.col("__n") <= size)
    static = F.max(F.col("is_static") & (F.col("__n") == 1)).over(Window.partitionBy("parent", "child"))
    return last.withColumn("__s", static).filter((F.col("__n") == 1) | ~F.col("__s")).drop("__n", "__s")


# --- scan queue ----------------------------------------------------------------------------------

QUEUE_OUT = "source string, batch long, scan_id long, arrival_ms double, fired_ms double, fate string"


def queue_fates(scans: list[tuple[int, float, float]], now: list | None = None, age: float = 100.0, depth: int = 8, full: int = 4, wait: float = 20.0, first_batch: int = 0, drain: bool = True):
    """What becomes of scans (id, arrival, stamp) in a bounded queue: (batch, id, arrival, fired, fate), and what is still queued.

    On arrival a scan older than ``age`` (arrival - stamp) goes; at ``depth`` the oldest goes; ``full`` scans fire at once, fewer once the first has waited ``wait``;
    ``drain`` fires the rest at the end. Times are milliseconds and given with the scans, so a replay gives the same.
    """
    queue, out, batch = list(now or []), [], first_batch

    def fire(at: float) -> None:
        nonlocal batch, queue
        out.extend((batch, s, a, at, "aligned") for s, a in queue[:full])
        queue, batch = queue[full:], batch + 1

    for scan, arrival, stamp in scans:
        while queue and arrival - queue[0][1] >= wait:
            fire(queue[0][1] + wait)
        if arrival - stamp > age:
            out.append((None, scan, arrival, arrival, "too old"))
            continue
        if len(queue) >= depth:
            old = queue.pop(0)
            out.append((None, old[0], old[1], arrival, "dropped"))
        queue.append((scan, arrival))
        if len(queue) >= full:
            fire(arrival)
    while drain and queue:
        fire(max(queue[0][1] + wait, queue[-1][1]))
    return out, queue, batch


def queued(scans: DataFrame, **rules) -> DataFrame:
    """The fates of scans (source, scan_id, arrival_ms, stamp_ms), batch form: a source is one queue, which is sequential."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["arrival_ms", "scan_id"])
        out, *_ = queue_fates(list(zip(frame["scan_id"], frame["arrival_ms"], frame["stamp_ms"], strict=True)), **rules)
        return pd.DataFrame([(frame["source"].iloc[0], *r) for r in out], columns=[c.split()[0] for c in QUEUE_OUT.split(", ")]).astype({"batch": "Int64"})

    return scans.groupBy("source").applyInPandas(run, QUEUE_OUT)


def queue_stream(scans: DataFrame, **rules) -> DataFrame:
    """The same on a stream; what a micro-batch leaves in the queue stays in the state."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, times, batch = state.get if state.exists else ([], [], 0)
        frame = pd.concat(list(frames)).sort_values(["arrival_ms", "scan_id"])
        rows = list(zip(frame["scan_id"], frame["arrival_ms"], frame["stamp_ms"], strict=True))
        out, queue, batch = queue_fates(rows, list(zip(ids, times, strict=True)), first_batch=batch, drain=False, **rules)
        state.update(([int(q[0]) for q in queue], [float(q[1]) for q in queue], batch))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[c.split()[0] for c in QUEUE_OUT.split(", ")]).astype({"batch": "Int64"})

    return scans.groupBy("source").applyInPandasWithState(update, QUEUE_OUT, "ids array<long>, times array<double>, batch long", "append", "NoTimeout")


def process_batch(frame: DataFrame, results: DataFrame) -> DataFrame:
    """Results joined to the scans of a batch, with their latency, by stamp."""
    met = frame.join(results, ["source", "scan_id"])
    return met.withColumn("latency_ms", F.col("done_ms") - F.col("arrival_ms")).orderBy("stamp_ms", "scan_id")


# --- map refresh ---------------------------------------------------------------------------------

REFRESH_OUT = "source string, seq long, x double, y double, refresh boolean, updates long"


def refreshes(positions: pd.DataFrame, last: tuple | None = None, updates: int = 0, distance: float = 20.0):
    """Which positions (x, y in order) ask for the map: the first, and those further than ``distance`` from the last that did."""
    out = []
    for r in positions.itertuples():
        ask = last is None or (r.x - last[0]) ** 2 + (r.y - last[1]) ** 2 > distance**2
        if ask:
            last, updates = (r.x, r.y), updates + 1
        out.append((ask, updates))
    return out, last, updates


def refresh_stream(positions: DataFrame, distance: float = 20.0) -> DataFrame:
    """A stream (source, seq, x, y) with whether each position asks for the map. Works on a batch too."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        x, y, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out, last, n = refreshes(rows, None if x is None else (x, y), n, distance)
        state.update((float(last[0]), float(last[1]), n))
        yield pd.DataFrame([(key[0], r.seq, r.x, r.y, *o) for r, o in zip(rows.itertuples(), out, strict=True)], columns=[c.split()[0] for c in REFRESH_OUT.split(", ")])

    return positions.groupBy("source").applyInPandasWithState(update, REFRESH_OUT, "x double, y double, n long", "append", "NoTimeout")


def refresh_batch(positions: DataFrame, distance: float = 20.0) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        out, *_ = refreshes(frame, distance=distance)
        return pd.DataFrame([(r.source, r.seq, r.x, r.y, *o) for r, o in zip(frame.itertuples(), out, strict=True)], columns=[c.split()[0] for c in REFRESH_OUT.split(", ")])

    return positions.groupBy("source").applyInPandas(run, REFRESH_OUT)


class TileStore:
    """Held tiles as a versioned table under a path: each update writes a new version, readers take the newest complete one."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return -1
        done = [s.getPath().getName() for s in fs.listStatus(path(self.path)) if fs.exists(path(s.getPath(), "_SUCCESS"))]
        return max((int(n[1:]) for n in done if n[:1] == "v" and n[1:].isdigit()), default=-1)

    def read(self, version: int | None = None) -> DataFrame | None:
        version = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/v{version}") if version >= 0 else None

    def apply(self, incoming: DataFrame, removed: DataFrame, batch: int | None = None) -> int:
        """Writes the next version; the same ``batch`` number again replaces what it has written."""
        held = self.read(batch - 1 if batch is not None else None) if batch is None or batch > 0 else None
        now = incoming if held is None else T.upsert(held, incoming, removed)
        version = self.version() + 1 if batch is None else batch
        now.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        return version


# --- diagnostics ---------------------------------------------------------------------------------


def diagnostics(rows: DataFrame, checks: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``level`` (0 ok, 1 warning, 2 error), ``message`` and ``report``: of all (condition, level, message) that hold the worst level, messages in order.

    Conditions are SQL expressions over the row; its other columns are the report's values, as text.
    """
    rank = {"warn": 1, "error": 2}
    hits = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.struct(F.lit(rank[k]).alias("l"), F.lit(m).alias("m"))) for c, k, m in checks]))
    found = rows.withColumn("__hits", hits)
    level = F.aggregate("__hits", F.lit(0), lambda a, h: F.greatest(a, h["l"]))
    message = F.when(F.size("__hits") > 0, F.array_join(F.transform("__hits", lambda h: h["m"]), "; ")).otherwise("OK")
    report = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in rows.columns])
    return found.withColumn("level", level).withColumn("message", message).withColumn("report", report).drop("__hits")


def windowed(events: DataFrame, time: str, width: str, slide: str | None, watermark: str, by: list[str], value: str) -> DataFrame:
    """Counts and means in windows of event time, late rows beyond the watermark dropped: on a stream or a batch."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)
    return timed.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
