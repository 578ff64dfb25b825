"""Codecs, logs, bags, buffers, queues, tiles and sinks."""

import json
import math
import sqlite3
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.operators import timeline, tiles
from cairn.sources import clouds, logs
from cairn.streaming import poses as P
from cairn.streaming import sinks

NS = 1_000_000_000


def points(spark, rows):
    return spark.createDataFrame(rows, "cloud_id string, point_id long, x double, y double, z double, rgb long")


def test_cloud_round_trip(spark):
    rows = [("a", k, k * 0.5, -k * 1.25, 3.0, 0x112233) for k in range(5)] + [("b", 0, 1.0, 2.0, 3.0, 255)]
    df = points(spark, rows)
    for rgb, step in ((None, 12), ("rgb", 16)):
        blobs = clouds.encode(df, rgb)
        assert {r["point_step"] for r in blobs.collect()} == {step}
        back = clouds.decode(blobs).orderBy("cloud_id", "point_id").collect()
        assert [tuple(r) for r in back] == [r[:5] for r in rows]
    data = clouds.encode(df, "rgb").filter("cloud_id = 'b'").first()["data"]
    assert struct.unpack("<I", data[12:16])[0] == 255


def test_cloud_faults(spark):
    fields = [("x", 0, 7, 1), ("y", 4, 7, 1), ("z", 8, 7, 1)]
    schema = f"cloud_id string, data binary, fields {clouds.FIELDS}, point_step int, width int, height int"
    nan = struct.pack("<3f", 1, float("nan"), 2) + struct.pack("<3f", 1, 2, 3) + struct.pack("<3f", 1, 2, float("inf"))
    blobs = [("a", bytearray(nan), fields, 12, 3, 1), ("e", bytearray(), fields, 12, 0, 0)]
    assert [tuple(r) for r in clouds.decode(spark.createDataFrame(blobs, schema)).collect()] == [("a", 1, 1.0, 2.0, 3.0)]
    for bad in (("s", bytearray(11), fields, 12, 1, 1), ("f", bytearray(12), fields[:2], 12, 1, 1)):
        with pytest.raises(Exception, match="bytes for|no x, y, z"):
            clouds.decode(spark.createDataFrame([bad], schema)).collect()


def test_generated_clouds(spark):
    assert clouds.cube_grid(spark, 2.0, 1.0).count() == 27
    ball = clouds.random_sphere(spark, 500, 2.0).toPandas()
    size = np.linalg.norm(ball[["x", "y", "z"]], axis=1)
    assert (size <= 2).all() and size.max() > 1.5 and abs(ball["x"].mean()) < 0.2


def test_voxel_dump_round_trip(spark, tmp_path):
    from cairn.operators import voxel as V

    grid = V.grid(clouds.half_cube(spark, 6.0, 0.5), 2.0)
    logs.dump_voxels(grid, 2.0, str(tmp_path / "lines"))
    text = "".join(part.read_text() for part in sorted((tmp_path / "lines").glob("part-*")))
    (tmp_path / "grid.json").write_text(text)
    back = logs.voxel_dump(spark, str(tmp_path / "grid.json"))
    a, b = (d.orderBy(*V.KEY).toPandas() for d in (grid, back))
    assert len(a) == json.loads(text)["num_voxels"] == len(b)
    for c in (*V.KEY, "n", *V.MEANS, *V.COV, *V.INV):
        assert np.allclose(a[c], b[c])


def test_metrics_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("timestamp,state,cpu_percent,rss_bytes,vms_bytes,num_threads,total_read_rate_bps,total_write_rate_bps\n1,S,2.5,100,,4,0.0,1.5\n")
    row = logs.metrics_csv(spark, str(tmp_path / "m.csv")).first()
    assert (row["cpu_percent"], row["rss_bytes"], row["vms_bytes"], row["state"]) == (2.5, 100, None, "S")


def test_bag(spark, tmp_path):
    path = str(tmp_path / "a.db3")
    name = b"map\x00"
    head = b"\x00\x01\x00\x00" + struct.pack("<iII", 5, 7, len(name)) + name
    body = head + b"\x00" * (-(len(head) - 4) % 8) + struct.pack("<7d", 1, 2, 3, 0, 0, 0, 1) + struct.pack("<36d", *range(36))
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE topics (id INTEGER, name TEXT, type TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(1, "/pose", "p"), (2, "/clock", "c")])
        db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(1, 1, 20, body), (2, 2, 5, b""), (3, 1, 10, body)])
    spark.dataSource.register(logs.BagSource)
    df = spark.read.format("bag").option("path", path).option("topic", "pose").option("rows", "2").load()
    assert sorted(r["timestamp"] for r in df.collect()) == [10, 20]
    row = logs.cdr_poses(df).first()
    assert (row["stamp_ns"], row["frame"], row["z"], row["qw"], row["covariance"][35]) == (5 * NS + 7, "map", 3.0, 1.0, 35.0)


# --- pose buffers ------------------------------------------------------------------------------------------


def pose(t, x):
    return (t, x, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)


POSE_SCHEMA = "t_ns long, x double, y double, z double, qx double, qy double, qz double, qw double"


@pytest.mark.parametrize(
    ("poses", "at", "x"),
    [
        ([], 0, None),
        ([pose(NS, 1.0)], NS, None),
        ([pose(NS, 1.0), pose(2 * NS, 2.0)], NS // 2, None),
        ([pose(NS, 1.0), pose(2 * NS - 2, 2.0)], 3 * NS // 2 - 1, 1.5),
        ([pose(NS, 1.0), pose(2 * NS - 2, 2.0)], NS, 1.0),
        ([pose(NS, 1.0), pose(2 * NS - 2, 2.0)], 2 * NS - 2, 2.0),
        ([pose(NS, 1.0), pose(2 * NS - 2, 2.0)], 2 * NS + 5, 2.0),
        ([pose(NS, 1.0), pose(2 * NS, 2.0)], 4 * NS, None),
        ([pose(NS, 1.0), pose(2 * NS, 12.0)], 3 * NS // 2, None),
    ],
)
@pytest.mark.parametrize("slice_ns", [None, NS // 3])
def test_interpolation(spark, poses, at, x, slice_ns):
    queries = spark.createDataFrame([(7, at)], "q long, t_ns long")
    rows = timeline.interpolated(queries, spark.createDataFrame(poses, POSE_SCHEMA), slice_ns=slice_ns).collect()
    assert [round(r["x"], 9) for r in rows] == ([] if x is None else [x])


@pytest.mark.parametrize(("gap", "closed", "found"), [(50, True, True), (50, False, False), (49, False, True)])
def test_nearest_tolerance(spark, gap, closed, found):
    queries = spark.createDataFrame([(1, 100)], "q long, t_ns long")
    events = spark.createDataFrame([(100 - gap, "early"), (100 + gap, "late")], "t_ns long, name string")
    rows = timeline.nearest(queries, events, "t_ns", ["name"], 50, closed).collect()
    assert [r["match_name"] for r in rows] == (["early"] if found else [])


def test_bracket_has_no_nested_loop(spark):
    queries = spark.range(10).select(F.col("id").alias("t_ns"), F.col("id").alias("q"))
    events = spark.range(5).select((F.col("id") * 2).alias("t_ns"), F.col("id").alias("e"))
    df = timeline.bracket(queries, events, "t_ns", ["e"], slice_ns=3)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r["prev_t"] == max(t for t in range(0, 9, 2) if t <= r["t_ns"]) and r["next_t"] == min((t for t in range(0, 9, 2) if t > r["t_ns"]), default=None)


def run_stream(spark, frame, schema, build, tmp_path, order):
    """The rows of a streaming query over files, one file for each micro-batch."""
    source, out = tmp_path / "in", tmp_path / "out"
    parts = np.array_split(frame, 3)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = build(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(str(out)).orderBy(*order).toPandas()


def test_refresh_stream_is_its_batch(spark, tmp_path):
    schema = "source string, seq long, x double, y double"
    frame = pd.DataFrame([("a", k, 7.0 * k, 0.0) for k in range(30)], columns=["source", "seq", "x", "y"])
    stream = run_stream(spark, frame, schema, P.refresh_stream, tmp_path, ["seq"])
    batch = P.refresh_batch(spark.createDataFrame(frame, schema)).orderBy("seq").toPandas()
    pd.testing.assert_frame_equal(stream, batch)
    assert batch["refresh"].iloc[0] and batch["updates"].max() == 10


def test_queue_stream_is_its_batch(spark, tmp_path):
    schema = "source string, scan_id long, arrival_ms double, stamp_ms double"
    rng = np.random.default_rng(1)
    arrival = np.cumsum(rng.uniform(1, 15, 40))
    frame = pd.DataFrame({"source": "a", "scan_id": range(40), "arrival_ms": arrival, "stamp_ms": arrival - rng.uniform(0, 120, 40)})
    stream = run_stream(spark, frame, schema, P.queue_stream, tmp_path, ["scan_id"])
    batch = P.queued(spark.createDataFrame(frame, schema), drain=False).orderBy("scan_id").toPandas()
    pd.testing.assert_frame_equal(stream, batch)
    assert {"aligned", "too old"} <= set(batch["fate"])


def test_queue_rules():
    out, left, _ = P.queue_fates([(k, float(k), float(k)) for k in range(4)])
    assert [o[1] for o in out] == [0, 1, 2, 3] and not left
    out, left, _ = P.queue_fates([(0, 0.0, 0.0), (1, 30.0, 30.0)], drain=False)
    assert [(o[1], o[3]) for o in out] == [(0, 20.0)] and [q[0] for q in left] == [1]
    out, *_ = P.queue_fates([(k, 0.0, 0.0) for k in range(10)], full=100, depth=8)
    assert [o[1] for o in out if o[4] == "dropped"] == [0, 1]
    out, *_ = P.queue_fates([(0, 200.0, 50.0)])
    assert out[0][4] == "too old"


def test_pose_stream_sessions(spark, tmp_path):
    schema = "source string, seq long, stamp_ns long, x double, y double, z double"
    stamps = [1, 2, 30, 31, 5, 6, 7]
    frame = pd.DataFrame([("a", k, t * NS, 0.0, 0.0, 0.0) for k, t in enumerate(stamps)], columns=["source", "seq", "stamp_ns", "x", "y", "z"])
    rows = run_stream(spark, frame, schema, P.pose_stream, tmp_path, ["session", "stamp_ns"])
    assert rows["session"].tolist() == [0, 0, 0, 0, 1, 1, 1]
    assert rows["held"].tolist() == [1, 2, 2, 3, 1, 2, 3]


def test_buffer_eviction_keeps_the_bracketing_pose(spark):
    df = spark.createDataFrame([("a", t) for t in (1, 2, 3, 8, 9)], "source string, stamp_ns long")
    assert sorted(r["stamp_ns"] for r in P.evicted(df, ["source"], 5).collect()) == [3, 8, 9]


# --- tiles, sinks, diagnostics -------------------------------------------------------------------------------


def test_tile_store(spark, tmp_path):
    store = P.TileStore(spark, str(tmp_path / "tiles"))
    frame = lambda rows: spark.createDataFrame(rows, "tile_id string, x double")
    none = frame([])
    assert store.version() == -1 and store.read() is None
    store.apply(frame([("a", 1.0), ("b", 2.0)]), none)
    store.apply(frame([("a", 5.0), ("c", 3.0)]), frame([("b", 0.0)]))
    assert sorted(map(tuple, store.read().collect())) == [("a", 5.0), ("c", 3.0)]
    assert sorted(map(tuple, store.read(0).collect())) == [("a", 1.0), ("b", 2.0)]


def test_tile_radius_keeps_whole_tiles(spark):
    df = spark.createDataFrame([("tile_1", 0.0, 0.0), ("tile_2", 15.0, 0.0)], "tile_id string, cx double, cy double")
    assert [r["tile_id"] for r in tiles.in_area(df, 0.0, 0.0, 10.0).collect()] == ["tile_1"]
    row = spark.range(1).select(tiles.needs_refresh(F.lit(21.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(3)).alias("a"), tiles.needs_refresh(F.lit(20.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(3)).alias("b"), tiles.needs_refresh(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0)).alias("c")).first()
    assert tuple(row) == (True, False, True)


def test_transform_directions(spark):
    """A stored (parent, child) sample maps the child's coordinates into the parent's."""
    half = math.sqrt(0.5)
    edges = spark.createDataFrame([("base", "lidar", 0, True, 1.0, 0.0, 0.0, 0.0, 0.0, half, half)], "parent string, child string, stamp_ns long, is_static boolean, x double, y double, z double, qx double, qy double, qz double, qw double")
    asked = spark.createDataFrame([(1, "lidar", "base", None), (2, "base", "lidar", None)], "query_id int, source string, target string, t_ns long")
    rows = {r["query_id"]: r for r in timeline.transforms(asked, edges).collect()}
    assert np.allclose([rows[1][c] for c in "xyz"], (1, 0, 0)) and rows[1]["way"] == "direct"
    assert np.allclose([rows[2][c] for c in "xyz"], (0, 1, 0)) and rows[2]["way"] == "inverse"


def test_diagnostics_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0), (2, None)], "n int, v double")
    found = P.diagnostics(rows, [("v > 1", "warn", "high"), ("n = 1", "error", "bad")]).orderBy("n").collect()
    assert [(r["level"], r["message"]) for r in found] == [(2, "high; bad"), (0, "OK")]
    assert [tuple(x) for x in found[1]["report"]] == [("n", "2"), ("v", None)]
    text = sinks.markdown([{"mode": "a", "mean": 1.25, "n": None}])
    assert text.splitlines()[2] == "| a | 1.250 |  |" and "no rows" in sinks.markdown([])
    sinks.json_lines(rows, str(tmp_path / "j"))
    sinks.json_lines(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert json.loads(sinks.summary(rows))[0]["n"] in (1, 2)


def test_pose_history_colours(spark):
    df = spark.createDataFrame([("a", k, 0.0) for k in range(4)], "run string, step_no int, x double")
    rows = sinks.pose_history(df, ["run"], "step_no").orderBy("step").collect()
    assert [(r["g"], r["b"]) for r in rows] == [(0.0, 1.0), (0.5, 1.0), (1.0, 1.0), (1.0, 0.5)]


def test_subscription_keeps_the_last(spark, tmp_path):
    schema = "source string, seq long"
    for k in range(3):
        spark.createDataFrame([("a", 10 * k + i) for i in range(3)] + [("b", k)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = P.subscribe(stream, ["source"], "seq", 2, str(tmp_path / "held")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "held" / "v2")).collect())) == [("a", 21), ("a", 22), ("b", 1), ("b", 2)]
