"""Queries on points, cells, poses and scores, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn import views as W
from cairn.functions import geometry as G
from cairn.operators import filters, neighbors, scoring, tiles, voxel
from cairn.plans import newton, search
from cairn.sources import clouds

RES = W.RESOLUTION
QUERIES: dict = {}
SQL: dict[str, str] = {}
XYZ, KEY = voxel.XYZ, voxel.KEY


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r(e, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(F.col(e) if isinstance(e, str) else e, digits) + F.lit(0.0)


def R(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0"


def rounded(df, columns, digits: int = 6):
    return df.withColumns({c: r(c, digits) for c in columns})


def rs(columns, digits: int = 6) -> str:
    return ", ".join(f"{R(c, digits)} AS {c}" for c in columns)


# --- geometry --------------------------------------------------------------------------------------

#: Entries of Rx Ry Rz and of Rz Ry Rx in SQL over roll, pitch, yaw.
XYZ_SQL = ["cos(pitch)*cos(yaw)", "-cos(pitch)*sin(yaw)", "sin(pitch)", "cos(roll)*sin(yaw)+sin(roll)*sin(pitch)*cos(yaw)", "cos(roll)*cos(yaw)-sin(roll)*sin(pitch)*sin(yaw)", "-sin(roll)*cos(pitch)", "sin(roll)*sin(yaw)-cos(roll)*sin(pitch)*cos(yaw)", "sin(roll)*cos(yaw)+cos(roll)*sin(pitch)*sin(yaw)", "cos(roll)*cos(pitch)"]
ZYX_SQL = ["cos(yaw)*cos(pitch)", "cos(yaw)*sin(pitch)*sin(roll)-sin(yaw)*cos(roll)", "cos(yaw)*sin(pitch)*cos(roll)+sin(yaw)*sin(roll)", "sin(yaw)*cos(pitch)", "sin(yaw)*sin(pitch)*sin(roll)+cos(yaw)*cos(roll)", "sin(yaw)*sin(pitch)*cos(roll)-cos(yaw)*sin(roll)", "-sin(pitch)", "cos(pitch)*sin(roll)", "cos(pitch)*cos(roll)"]
POSE_SQL = "pose AS (SELECT " + ", ".join(f"CAST({v!r} AS DOUBLE) AS {c}" for v, c in zip(W.POSE, ("tx", "ty", "tz", "roll", "pitch", "yaw"), strict=True)) + ")"
MOVED_SQL = [f"({XYZ_SQL[3 * i]})*x + ({XYZ_SQL[3 * i + 1]})*y + ({XYZ_SQL[3 * i + 2]})*z + t{a}" for i, a in enumerate("xyz")]


@query("geo1_rotation", W.with_views("poses", "SELECT pose_id, " + ", ".join(f"{R(e)} AS r{i // 3}{i % 3}" for i, e in enumerate(XYZ_SQL)) + " FROM poses"))
def geo1(spark, sf):
    m = G.rotation("roll", "pitch", "yaw")
    return W.poses(spark).select("pose_id", *[r(m[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)])


@query("geo2_transform", W.with_views("points", "SELECT point_id, " + ", ".join(f"{R(e)} AS {a}" for e, a in zip(MOVED_SQL, XYZ, strict=True)) + " FROM points, pose", POSE_SQL))
def geo2(spark, sf):
    return W.points(spark, sf).select("point_id", *[r(e).alias(a) for e, a in zip(G.transform(XYZ, W.POSE), XYZ, strict=True)])


@query("geo3_transform_poses", W.with_views("points scan poses", "SELECT pose_id, point_id, " + ", ".join(f"{R(e)} AS {a}" for e, a in zip(MOVED_SQL, XYZ, strict=True)) + " FROM scan, poses"))
def geo3(spark, sf):
    return rounded(neighbors.at_poses(W.scan(spark, sf).select("point_id", *XYZ), W.poses(spark)), XYZ)


@query("geo4_pose_matrices", W.with_views("poses", "SELECT pose_id, " + ", ".join([f"{R(XYZ_SQL[3 * i + j])} AS m{4 * i + j}" for i in range(3) for j in range(3)] + [f"{R('t' + a)} AS m{4 * i + 3}" for i, a in enumerate("xyz")] + ["1.0 AS m15", f"{R('sin(yaw)')} AS sin_yaw", f"{R('cos(yaw)')} AS cos_yaw"]) + " FROM poses").replace("1.0 AS m15", "CAST(1.0 AS DOUBLE) AS m15"))
def geo4(spark, sf):
    rows = W.poses(spark).withColumn("m", G.matrix4(("tx", "ty", "tz", "roll", "pitch", "yaw")))
    return rows.select("pose_id", *[r(F.col("m")[k]).alias(f"m{k}") for k in (*range(12), 15)], r(F.sin("yaw")).alias("sin_yaw"), r(F.cos("yaw")).alias("cos_yaw"))


@query("geo5_debug_matrices", W.with_views("poses", "SELECT pose_id, " + ", ".join(f"{R(e)} AS r{i // 3}{i % 3}" for i, e in enumerate(ZYX_SQL)) + " FROM poses"))
def geo5(spark, sf):
    m = G.zyx_matrix("roll", "pitch", "yaw")
    return W.poses(spark).select("pose_id", *[r(m[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)])


Q_SQL = ["sin(roll/2)*cos(pitch/2)*cos(yaw/2)-cos(roll/2)*sin(pitch/2)*sin(yaw/2)", "cos(roll/2)*sin(pitch/2)*cos(yaw/2)+sin(roll/2)*cos(pitch/2)*sin(yaw/2)", "cos(roll/2)*cos(pitch/2)*sin(yaw/2)-sin(roll/2)*sin(pitch/2)*cos(yaw/2)", "cos(roll/2)*cos(pitch/2)*cos(yaw/2)+sin(roll/2)*sin(pitch/2)*sin(yaw/2)"]
QUAT_VIEW = "quats AS (SELECT *, " + ", ".join(f"{e} AS q{a}" for e, a in zip(Q_SQL, "xyzw", strict=True)) + " FROM poses)"


def with_quaternions(df, suffix: str = ""):
    q = G.quaternion("roll", "pitch", "yaw")
    return df.withColumns({f"q{a}{suffix}": e for a, e in zip("xyzw", q, strict=True)})


@query(
    "geo6_quaternion_euler",
    W.with_views("poses", f"SELECT pose_id, {rs(['qx', 'qy', 'qz', 'qw'])}, {R('atan2(2*(qw*qx+qy*qz), 1-2*(qx*qx+qy*qy))')} AS roll2, {R('asin(greatest(-1.0, least(1.0, 2*(qw*qy-qz*qx))))')} AS pitch2, {R('atan2(2*(qw*qz+qx*qy), 1-2*(qy*qy+qz*qz))')} AS yaw2 FROM quats", QUAT_VIEW),
)
def geo6(spark, sf):
    rows = with_quaternions(W.poses(spark))
    angles = G.euler(("qx", "qy", "qz", "qw"))
    return rows.select("pose_id", *[r(c).alias(c) for c in ("qx", "qy", "qz", "qw")], *[r(e).alias(n) for e, n in zip(angles, ("roll2", "pitch2", "yaw2"), strict=True)])


def pose_pairs(spark):
    rows = with_quaternions(W.poses(spark))
    names = [c for c in rows.columns]
    a, b = (rows.select(*[F.col(c).alias(f"{p}_{c}") for c in names]) for p in "ab")
    return a.crossJoin(b)


@query("geo7_quaternion_angle", W.with_views("poses", f"SELECT a.pose_id AS a_pose_id, b.pose_id AS b_pose_id, {R('2*acos(least(1.0, abs(a.qx*b.qx+a.qy*b.qy+a.qz*b.qz+a.qw*b.qw)))', 5)} AS angle FROM quats a, quats b WHERE a.pose_id <> b.pose_id", QUAT_VIEW))
def geo7(spark, sf):
    q = lambda p: [f"{p}_q{c}" for c in "xyzw"]
    return pose_pairs(spark).filter("a_pose_id <> b_pose_id").select("a_pose_id", "b_pose_id", r(G.q_angle(q("a"), q("b")), 5).alias("angle"))


WRAP = lambda e: f"((({e}) + pi()) - 2*pi()*floor((({e}) + pi())/(2*pi())) - pi())"


@query("geo8_yaw_difference", W.with_views("points", f"SELECT point_id, {R('abs(' + WRAP('x - y') + ')')} AS yaw_difference FROM points"))
def geo8(spark, sf):
    return W.points(spark, sf).select("point_id", r(G.yaw_difference("x", "y")).alias("yaw_difference"))


@query("geo9_wrap", W.with_views("bulk", f"SELECT point_id, {R(WRAP('y'))} AS wrapped FROM bulk"))
def geo9(spark, sf):
    return W.bulk(spark, sf).select("point_id", r(G.wrap("y")).alias("wrapped"))


@query("geo10_distance", W.with_views("bulk", f"SELECT point_id, {R('sqrt((x-1)*(x-1)+(y-2)*(y-2))')} AS d2, {R('sqrt((x-1)*(x-1)+(y-2)*(y-2)+(z-3)*(z-3))')} AS d3 FROM bulk"))
def geo10(spark, sf):
    return W.bulk(spark, sf).select("point_id", r(G.distance(("x", "y"), (1, 2))).alias("d2"), r(G.distance(XYZ, (1, 2, 3))).alias("d3"))


REL_SQL = W.with_views(
    "poses",
    "SELECT a_pose_id, b_pose_id, "
    + ", ".join(f"{R(e)} AS {n}" for e, n in zip(["dx + 2*cw*(cy*dz-cz*dy)*0 + ux", "dy + uy", "dz + uz", "px", "py", "pz", "pw"], ["tx", "ty", "tz", "qx", "qy", "qz", "qw"], strict=True)).replace("2*cw*(cy*dz-cz*dy)*0 + ", "")
    + " FROM rel",
    QUAT_VIEW,
    # A inverse(B): q = qa conj(qb); t = ta - q tb
    "prod AS (SELECT a.pose_id AS a_pose_id, b.pose_id AS b_pose_id, a.tx AS ax, a.ty AS ay, a.tz AS az, b.tx AS bx, b.ty AS by_, b.tz AS bz, "
    "-a.qw*b.qx + a.qx*b.qw - a.qy*b.qz + a.qz*b.qy AS px, -a.qw*b.qy + a.qx*b.qz + a.qy*b.qw - a.qz*b.qx AS py, -a.qw*b.qz - a.qx*b.qy + a.qy*b.qx + a.qz*b.qw AS pz, a.qw*b.qw + a.qx*b.qx + a.qy*b.qy + a.qz*b.qz AS pw FROM quats a, quats b)",
    "rel AS (SELECT *, ax AS dx, ay AS dy, az AS dz, -((1-2*(py*py+pz*pz))*bx + 2*(px*py-pz*pw)*by_ + 2*(px*pz+py*pw)*bz) AS ux, -(2*(px*py+pz*pw)*bx + (1-2*(px*px+pz*pz))*by_ + 2*(py*pz-px*pw)*bz) AS uy, -(2*(px*pz-py*pw)*bx + 2*(py*pz+px*pw)*by_ + (1-2*(px*px+py*py))*bz) AS uz FROM prod)",
)


@query("geo11_relative_pose", REL_SQL)
def geo11(spark, sf):
    side = lambda p: ([f"{p}_t{a}" for a in "xyz"], [f"{p}_q{a}" for a in "xyzw"])
    t, q = G.relative(*side("a"), *side("b"))
    return pose_pairs(spark).select("a_pose_id", "b_pose_id", *[r(e).alias(n) for e, n in zip((*t, *q), ("tx", "ty", "tz", "qx", "qy", "qz", "qw"), strict=True)])


SLERP_SQL = W.with_views(
    "poses",
    "SELECT a_pose_id, b_pose_id, " + ", ".join(f"{R(f'(wa*a_{c} + wb*b_{c})/size', 5)} AS q{c}" for c in "xyzw") + " FROM sized",
    QUAT_VIEW,
    "dots AS (SELECT a.pose_id AS a_pose_id, b.pose_id AS b_pose_id, " + ", ".join(f"a.q{c} AS a_{c}, b.q{c} AS b_{c}" for c in "xyzw") + ", a.qx*b.qx+a.qy*b.qy+a.qz*b.qz+a.qw*b.qw AS d FROM quats a, quats b)",
    "weights AS (SELECT *, CASE WHEN abs(d) > 0.9995 THEN 0.7 ELSE sin(0.7*acos(least(1.0, abs(d))))/sin(acos(least(1.0, abs(d)))) END AS wa, (CASE WHEN d < 0 THEN -1 ELSE 1 END) * CASE WHEN abs(d) > 0.9995 THEN 0.3 ELSE sin(0.3*acos(least(1.0, abs(d))))/sin(acos(least(1.0, abs(d)))) END AS wb FROM dots)",
    "sized AS (SELECT *, sqrt(" + " + ".join(f"(wa*a_{c}+wb*b_{c})*(wa*a_{c}+wb*b_{c})" for c in "xyzw") + ") AS size FROM weights)",
)


@query("geo12_slerp", SLERP_SQL)
def geo12(spark, sf):
    q = G.slerp([f"a_q{c}" for c in "xyzw"], [f"b_q{c}" for c in "xyzw"], 0.3)
    return pose_pairs(spark).select("a_pose_id", "b_pose_id", *[r(e, 5).alias(f"q{c}") for e, c in zip(q, "xyzw", strict=True)])


@query("geo13_voxel_keys", W.with_views("points cells", "SELECT point_id, vx, vy, vz FROM cells"))
def geo13(spark, sf):
    return G.with_cells(W.points(spark, sf), RES).select("point_id", *KEY)


@query(
    "geo14_linear_ids",
    W.with_views("points cells", "SELECT point_id, CAST((vx-lx) + (vy-ly)*dx + (vz-lz)*dx*dy AS BIGINT) AS linear_id, vx, vy, vz FROM cells, box", "box AS (SELECT min(vx) AS lx, min(vy) AS ly, min(vz) AS lz, CAST(max(vx)-min(vx)+1 AS BIGINT) AS dx, CAST(max(vy)-min(vy)+1 AS BIGINT) AS dy FROM cells)"),
)
def geo14(spark, sf):
    rows = G.with_cells(W.points(spark, sf), RES)
    low, dims = [f"min_{k}" for k in KEY], [f"dim_{k}" for k in KEY]
    rows = rows.crossJoin(F.broadcast(voxel.bounds(rows))).withColumn("linear_id", G.linear_id(KEY, low, dims))
    back = G.from_linear("linear_id", low, dims)
    return rows.select("point_id", "linear_id", *[e.alias(k) for e, k in zip(back, KEY, strict=True)])


@query("geo15_packed_keys", W.with_views("points cells", "SELECT point_id, (CAST(vx AS BIGINT)+1048576)*4398046511104 + (CAST(vy AS BIGINT)+1048576)*2097152 + (CAST(vz AS BIGINT)+1048576) AS packed, vx, vy, vz FROM cells"))
def geo15(spark, sf):
    rows = G.with_cells(W.points(spark, sf), RES).withColumn("packed", G.packed_key(KEY))
    return rows.select("point_id", "packed", *[e.alias(k) for e, k in zip(G.unpacked_key("packed"), KEY, strict=True)])


def morton_sql() -> str:
    cell = {a: f"least(greatest(CAST(floor(({a} + 8) / 0.5) AS BIGINT), 0), 2097151)" for a in "xyz"}
    bits = " + ".join(f"((c{a} // {2**k}) % 2) * {2 ** (3 * k + s)}" for k in range(20) for a, s in (("x", 2), ("y", 1), ("z", 0)))
    return W.with_views("points", f"SELECT point_id, CAST({bits} AS BIGINT) AS code, cx, cy, cz FROM c", "c AS (SELECT point_id, " + ", ".join(f"{e} AS c{a}" for a, e in cell.items()) + " FROM points)")


@query("geo17_morton", morton_sql())
def geo17(spark, sf):
    rows = W.points(spark, sf).withColumn("code", G.morton(XYZ, (-8, -8, -8), 0.5))
    return rows.select("point_id", "code", *[e.alias(f"c{a}") for e, a in zip(G.morton_cells("code"), "xyz", strict=True)])


V_SQL = "least(greatest((x + 4) / 8, 0.0), 0.9999)"
T_SQL = f"(({V_SQL})*4 - floor(({V_SQL})*4)) * pi()/2"
RAMP_SQL = {
    "red": f"CASE floor(({V_SQL})*4) WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN sin({T_SQL}) ELSE 1.0 END",
    "green": f"CASE floor(({V_SQL})*4) WHEN 0 THEN sin({T_SQL}) WHEN 3 THEN cos({T_SQL}) ELSE 1.0 END",
    "blue": f"CASE floor(({V_SQL})*4) WHEN 0 THEN 1.0 WHEN 1 THEN cos({T_SQL}) ELSE 0.0 END",
}


@query("geo18_score_ramp", W.with_views("points", "SELECT point_id, " + ", ".join(f"{R(f'CAST({e} AS DOUBLE)')} AS {n}" for n, e in RAMP_SQL.items()) + " FROM points"))
def geo18(spark, sf):
    rgb = G.score_ramp("x", -4.0, 4.0)
    return W.points(spark, sf).select("point_id", *[r(e).alias(n) for e, n in zip(rgb, RAMP_SQL, strict=True)])


@query("geo19_rgb_pack", W.with_views("points", "SELECT point_id, CAST(floor(a*255) AS INTEGER) AS red, CAST(floor(b*255) AS INTEGER) AS green, CAST(floor(c*255) AS INTEGER) AS blue, CAST(floor(a*255)*65536 + floor(b*255)*256 + floor(c*255) AS BIGINT) AS packed FROM u", "u AS (SELECT point_id, abs(x) - floor(abs(x)) AS a, abs(y) - floor(abs(y)) AS b, abs(z) - floor(abs(z)) AS c FROM points)"))
def geo19(spark, sf):
    rgb = [F.abs(a) - F.floor(F.abs(F.col(a))) for a in XYZ]
    return W.points(spark, sf).select("point_id", *[e.alias(n) for e, n in zip(G.rgb_bytes(rgb), ("red", "green", "blue"), strict=True)], G.rgb_packed(rgb).alias("packed"))


HSV_CASE = lambda names: "CASE CAST(floor(h/60) AS INTEGER) % 6 " + " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(names)) + " END"


@query(
    "geo20_hsv_particle_colours",
    W.with_views(
        "points",
        f"SELECT point_id, {R(HSV_CASE(['v', 'q', 'p', 'p', 't', 'v']))} AS red, {R(HSV_CASE(['t', 'v', 'v', 'q', 'p', 'p']))} AS green, {R(HSV_CASE(['p', 'p', 't', 'v', 'v', 'q']))} AS blue, {R('1 - s1')} AS score_red, {R('s1')} AS score_green FROM w",
        "u AS (SELECT point_id, (point_id % 360) * 1.0 AS h, 0.8 AS s, 0.9 AS v, least(greatest((x + 4) / 8, 0.0), 1.0) AS s1 FROM points)",
        "w AS (SELECT *, CAST(v*(1-s) AS DOUBLE) AS p, CAST(v*(1-s*(h/60-floor(h/60))) AS DOUBLE) AS q, CAST(v*(1-s*(1-(h/60-floor(h/60)))) AS DOUBLE) AS t FROM u)",
    ),
)
def geo20(spark, sf):
    rgb = G.hsv(F.pmod("point_id", F.lit(360)).cast("double"), F.lit(0.8), F.lit(0.9))
    own = G.particle_colour("score", "x", F.lit(-4.0), F.lit(8.0))
    return W.points(spark, sf).select("point_id", *[r(e).alias(n) for e, n in zip(rgb, ("red", "green", "blue"), strict=True)], r(own[0]).alias("score_red"), r(own[1]).alias("score_green"))


@query("geo21_progress_colour", W.with_views("points", f"SELECT point_id, {R('CASE WHEN p < 0.5 THEN p*2 ELSE 1.0 END')} AS green, {R('CASE WHEN p < 0.5 THEN 1.0 ELSE 1 - (p-0.5)*2 END')} AS blue FROM u", "u AS (SELECT point_id, CAST(point_id % 30 AS DOUBLE) / 30 AS p FROM points)"))
def geo21(spark, sf):
    _, g, b = G.progress_colour(F.pmod("point_id", F.lit(30)), F.lit(30))
    return W.points(spark, sf).select("point_id", r(g).alias("green"), r(b).alias("blue"))


# --- filters ---------------------------------------------------------------------------------------

RANGE = (3.0, 40.0, 2.0, 8.0)
D2 = "x*x + y*y + z*z"


@query("fil1_range_height", W.with_views("bulk", f"SELECT point_id FROM bulk WHERE {D2} BETWEEN 9 AND 1600 AND z BETWEEN 2 AND 8"))
def fil1(spark, sf):
    return filters.range_height(W.bulk(spark, sf), *RANGE).select("point_id")


@query("fil2_removal_counts", W.with_views("bulk", f"SELECT count(*) AS n_in, count(*) FILTER (NOT ({D2} BETWEEN 9 AND 1600)) AS removed_by_distance, count(*) FILTER ({D2} BETWEEN 9 AND 1600 AND NOT (z BETWEEN 2 AND 8)) AS removed_by_z, count(*) FILTER ({D2} BETWEEN 9 AND 1600 AND z BETWEEN 2 AND 8) AS n_out FROM bulk"))
def fil2(spark, sf):
    return filters.removal_counts(W.bulk(spark, sf), *RANGE)


@query("fil3_compaction", W.with_views("points", "SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS position FROM points WHERE z > 0"))
def fil3(spark, sf):
    return voxel.numbered(W.points(spark, sf).filter("z > 0").select("point_id"), ["point_id"])


@query("fil4_finite", W.with_views("bulk", "SELECT point_id FROM bulk WHERE point_id % 5 <> 0 AND point_id % 7 <> 0"))
def fil4(spark, sf):
    odd = F.when(F.pmod("point_id", F.lit(5)) == 0, float("nan")).when(F.pmod("point_id", F.lit(7)) == 0, float("inf")).otherwise(F.col("x"))
    return filters.finite(W.bulk(spark, sf).withColumn("x", odd)).select("point_id")


@query("fil5_no_ground", W.with_views("points", f"SELECT point_id FROM points, pose WHERE ({MOVED_SQL[2]}) - tz > 0.5", POSE_SQL))
def fil5(spark, sf):
    return filters.above_ground(W.points(spark, sf), W.POSE, 0.5).select("point_id")


@query("fil6_crop_box", W.with_views("bulk", "SELECT point_id FROM bulk WHERE x BETWEEN -60 AND 60 AND y BETWEEN -60 AND 60 AND z BETWEEN -30 AND 50"))
def fil6(spark, sf):
    return filters.crop_box(W.bulk(spark, sf)).select("point_id")


@query("fil7_random_downsample", W.with_views("bulk", "SELECT point_id FROM (SELECT point_id, (((point_id * 48271 + 1) % 2147483647) * 16807 + 1) % 2147483647 AS h FROM bulk) ORDER BY h, point_id LIMIT 5000"))
def fil7(spark, sf):
    return filters.random_downsample(W.bulk(spark, sf), 5000).select("point_id")


@query("fil8_minimum_extent", W.with_views("points", f"SELECT cloud_id, {R('max(sqrt(' + D2 + '))')} AS extent, max(sqrt({D2})) >= 4 AS accepted FROM points GROUP BY cloud_id"))
def fil8(spark, sf):
    return rounded(filters.wide_enough(W.points(spark, sf), 4.0), ["extent"])


# --- cells -----------------------------------------------------------------------------------------

BULK_CELLS = "bc AS (SELECT *, CAST(floor(x / 5.0) AS INTEGER) AS vx, CAST(floor(y / 5.0) AS INTEGER) AS vy, CAST(floor(z / 5.0) AS INTEGER) AS vz FROM bulk)"


@query("agg1_downsample", W.with_views("bulk", f"SELECT vx, vy, vz, {R('avg(x)')} AS x, {R('avg(y)')} AS y, {R('avg(z)')} AS z, count(*) AS n FROM bc GROUP BY vx, vy, vz", BULK_CELLS))
def agg1(spark, sf):
    return rounded(voxel.downsample(W.bulk(spark, sf), 5.0), XYZ)


@query("agg2_accumulate", W.with_views("bulk", "SELECT vx, vy, vz, count(*) AS n, " + ", ".join(f"{R(f'sum({a})', 3)} AS s{a}" for a in "xyz") + ", " + ", ".join(f"{R(f'sum({a}*{b})', 2)} AS s{a}{b}" for a, b in voxel.PAIRS) + " FROM bc GROUP BY vx, vy, vz", BULK_CELLS))
def agg2(spark, sf):
    out = voxel.sums(W.bulk(spark, sf), 5.0)
    return rounded(rounded(out, ["sx", "sy", "sz"], 3), [f"s{a}{b}" for a, b in voxel.PAIRS], 2)


GAUSS_COLUMNS = [*voxel.MEANS, *voxel.COV]


@query("voxel_gaussian", W.with_views("points cells gauss", f"SELECT vx, vy, vz, n, {rs(GAUSS_COLUMNS)} FROM gauss"))
def agg3(spark, sf):
    return rounded(voxel.gaussians(W.points(spark, sf), RES), GAUSS_COLUMNS)


@query("agg4_gaussian_two_pass", SQL["voxel_gaussian"])
def agg4(spark, sf):
    return rounded(voxel.gaussians_two_pass(W.points(spark, sf), RES), GAUSS_COLUMNS)


EIGEN_SQL = W.with_views(
    "points cells gauss",
    f"SELECT vx, vy, vz, {R('q + 2*p*cos(phi + 2*pi()/3)', 5)} AS l1, {R('3*q - (q + 2*p*cos(phi)) - (q + 2*p*cos(phi + 2*pi()/3))', 5)} AS l2, {R('q + 2*p*cos(phi)', 5)} AS l3 FROM e3",
    "e1 AS (SELECT *, (cxx+cyy+czz)/3 AS q FROM gauss)",
    "e2 AS (SELECT *, sqrt(((cxx-q)*(cxx-q)+(cyy-q)*(cyy-q)+(czz-q)*(czz-q)+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) AS p FROM e1)",
    "e3 AS (SELECT *, acos(greatest(-1.0, least(1.0, ((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz)-cxy*(cxy*(czz-q)-cyz*cxz)+cxz*(cxy*cyz-(cyy-q)*cxz))/(2*p*p*p))))/3 AS phi FROM e2)",
)


@query("agg5_eigenvalues", EIGEN_SQL)
def agg5(spark, sf):
    return rounded(voxel.eigenvalues(voxel.gaussians(W.points(spark, sf), RES)), ["l1", "l2", "l3"], 5).select(*KEY, "l1", "l2", "l3")


@query("agg5_inverse", W.with_views("points cells gauss dets grid", f"SELECT vx, vy, vz, n, {rs(voxel.INV, 5)} FROM grid"))
def agg5i(spark, sf):
    return rounded(voxel.inverted(voxel.gaussians(W.points(spark, sf), RES)), voxel.INV, 5).select(*KEY, "n", *voxel.INV)


LATENT = (
    *EIGEN_SQL[EIGEN_SQL.index("e1 AS") : EIGEN_SQL.rindex(")\nSELECT") + 1].split(",\n"),
    "ei AS (SELECT *, q + 2*p*cos(phi + 2*pi()/3) AS l1, 3*q - (q + 2*p*cos(phi)) - (q + 2*p*cos(phi + 2*pi()/3)) AS l2, q + 2*p*cos(phi) AS l3 FROM e3)",
    "sq AS (SELECT *, cxx*cxx+cxy*cxy+cxz*cxz AS sxx, cxx*cxy+cxy*cyy+cxz*cyz AS sxy, cxx*cxz+cxy*cyz+cxz*czz AS sxz, cxy*cxy+cyy*cyy+cyz*cyz AS syy, cxy*cxz+cyy*cyz+cyz*czz AS syz, cxz*cxz+cyz*cyz+czz*czz AS szz FROM ei WHERE l3 > 0)",
    # the projections on the three axes, as polynomials of the matrix
    "pr AS (SELECT *, greatest(l1, 0.01*l3) AS m1, greatest(l2, 0.01*l3) AS m2, l3 AS m3, "
    + ", ".join(f"(s{ab} - (l{j}+l{k})*c{ab}" + (f" + l{j}*l{k}" if ab[0] == ab[1] else "") + f")/((l{i}-l{j})*(l{i}-l{k})) AS p{i}{ab}" for i, j, k in ((1, 2, 3), (2, 1, 3), (3, 1, 2)) for ab in ("xx", "xy", "xz", "yy", "yz", "zz"))
    + " FROM sq)",
)
NORMAL_SQL = [f"CASE greatest(p1xx, p1yy, p1zz) WHEN p1xx THEN p1{x} WHEN p1yy THEN p1{y} ELSE p1{z} END / sqrt(greatest(p1xx, p1yy, p1zz))" for x, y, z in (("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz"))]


@query(
    "agg5_conditioned",
    W.with_views(
        "points cells gauss",
        "SELECT vx, vy, vz, n, "
        + ", ".join(f"{R(f'CASE WHEN m1 > l1 OR m2 > l2 THEN m1*p1{c[1:]} + m2*p2{c[1:]} + m3*p3{c[1:]} ELSE {c} END', 4)} AS {c}" for c in voxel.COV)
        + ", "
        + ", ".join(f"{R(f'p1{c[1:]}/m1 + p2{c[1:]}/m2 + p3{c[1:]}/m3', 4)} AS {c}" for c in voxel.INV)
        + ", "
        + ", ".join(f"{R(e, 4)} AS n{a}" for a, e in zip(XYZ, NORMAL_SQL, strict=True))
        + " FROM pr",
        *LATENT,
    ),
)
def agg5c(spark, sf):
    names = [*voxel.COV, *voxel.INV, "nx", "ny", "nz"]
    return rounded(voxel.grid(W.points(spark, sf), RES), names, 4).select(*KEY, "n", *names)


@query("agg6_bounds", W.with_views("points cells", "SELECT " + ", ".join(f"coalesce(min({k}), 0) AS min_{k}, coalesce(max({k}), 0) AS max_{k}, coalesce(max({k}) - min({k}), 0) + 1 AS dim_{k}" for k in KEY) + " FROM cells"))
def agg6(spark, sf):
    return voxel.bounds(G.with_cells(W.points(spark, sf), RES))


@query("agg7_point_bounds", W.with_views("bulk", "SELECT " + ", ".join(f"{R(f'{f}({a})')} AS {f}_{a}" for a in XYZ for f in ("min", "max")) + " FROM bulk"))
def agg7(spark, sf):
    return rounded(voxel.point_bounds(W.bulk(spark, sf)), [f"{f}_{a}" for a in XYZ for f in ("min", "max")])


@query("agg8_segment_sums", W.with_views("bulk", f"SELECT vx, {R('sum(x)', 3)} AS total, count(*) AS n FROM bc GROUP BY vx", BULK_CELLS))
def agg8(spark, sf):
    return rounded(voxel.segment_sums(G.with_cells(W.bulk(spark, sf), 5.0), "vx", "x"), ["total"], 3)


@query("agg9_segments", W.with_views("points cells", "SELECT point_id, is_start, CAST(sum(is_start) OVER (ORDER BY vx, point_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS segment FROM (SELECT point_id, vx, CASE WHEN lag(vx) OVER (ORDER BY vx, point_id) = vx THEN 0 ELSE 1 END AS is_start FROM cells)"))
def agg9(spark, sf):
    return voxel.segments(G.with_cells(W.points(spark, sf), RES), "vx", ["vx", "point_id"]).select("point_id", "is_start", "segment")


@query("agg9_run_lengths", W.with_views("bulk", "SELECT vx AS code, count(*) AS length, CAST(coalesce(sum(count(*)) OVER (ORDER BY vx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM bc GROUP BY vx", BULK_CELLS))
def agg9r(spark, sf):
    return voxel.run_lengths(G.with_cells(W.bulk(spark, sf), 5.0), "vx")


@query("agg10_scans", W.with_views("points", "SELECT point_id, cloud_id, CAST(sum(point_id % 5) OVER w AS BIGINT) AS inclusive, CAST(sum(point_id % 5) OVER w - point_id % 5 AS BIGINT) AS exclusive FROM points WINDOW w AS (PARTITION BY cloud_id ORDER BY point_id ROWS UNBOUNDED PRECEDING)"))
def agg10(spark, sf):
    rows = W.points(spark, sf).withColumn("v", F.pmod("point_id", F.lit(5)))
    return voxel.scans(rows, "v", ["point_id"], ["cloud_id"]).select("point_id", "cloud_id", "inclusive", "exclusive")


@query("agg10_scan_of_all", W.with_views("bulk", "SELECT point_id, CAST(sum(point_id % 5) OVER w AS BIGINT) AS inclusive, CAST(sum(point_id % 5) OVER w - point_id % 5 AS BIGINT) AS exclusive FROM bulk WINDOW w AS (ORDER BY y, point_id ROWS UNBOUNDED PRECEDING)"))
def agg10a(spark, sf):
    rows = W.bulk(spark, sf).withColumn("v", F.pmod("point_id", F.lit(5)))
    return voxel.scans(rows, "v", ["y", "point_id"]).select("point_id", "inclusive", "exclusive")


@query("agg11_gather", W.with_views("points", "SELECT p.position, p.point_id FROM (SELECT point_id, row_number() OVER (ORDER BY x, point_id) - 1 AS position FROM points) p WHERE p.position % 3 = 0"))
def agg11(spark, sf):
    rows = voxel.numbered(W.points(spark, sf), ["x", "point_id"]).select("position", "point_id")
    return voxel.gather(rows, rows.select("position").filter("position % 3 = 0"))


@query("agg12_tile_centroids", W.with_views("bulk", f"SELECT cloud_id, {R('avg(x)')} AS cx, {R('avg(y)')} AS cy, {R('avg(z)')} AS cz, count(*) AS n FROM bulk GROUP BY cloud_id"))
def agg12(spark, sf):
    return rounded(voxel.centroids(W.bulk(spark, sf), "cloud_id"), ["cx", "cy", "cz"])


def map_grid(spark, sf):
    return voxel.inverted(voxel.gaussians(W.points(spark, sf), RES))


GRID = "points scan cells gauss dets grid pairs"


@query("agg24_neighbour_histogram", W.with_views(GRID, f"SELECT count(*) FILTER (k = 0) AS with_0, count(*) FILTER (k = 1) AS with_1, count(*) FILTER (k = 2) AS with_2, count(*) FILTER (k >= 3) AS with_3_plus, {R('avg(k)')} AS mean_pairs FROM (SELECT s.point_id, count(p.point_id) AS k FROM scan s LEFT JOIN pairs p USING (point_id) GROUP BY s.point_id)"))
def agg24(spark, sf):
    return rounded(scoring.neighbour_histogram(W.scan(spark, sf), map_grid(spark, sf), RES), ["mean_pairs"])


# --- spatial joins -----------------------------------------------------------------------------------

DIST = "dx*dx + dy*dy + dz*dz"


@query("joi1_radius", W.with_views(GRID, f"SELECT point_id, vx, vy, vz, {R(DIST)} AS distance2 FROM pairs"))
def joi1(spark, sf):
    return rounded(neighbors.radius_pairs(W.scan(spark, sf), map_grid(spark, sf), RES), ["distance2"]).select("point_id", *KEY, "distance2")


@query("joi1_wide_radius", W.with_views("points scan cells gauss dets grid", "SELECT s.point_id, g.vx, g.vy, g.vz FROM scan s JOIN grid g ON (s.x-g.mx)*(s.x-g.mx) + (s.y-g.my)*(s.y-g.my) + (s.z-g.mz)*(s.z-g.mz) <= 9.0"))
def joi1w(spark, sf):
    return neighbors.radius_pairs(W.scan(spark, sf), map_grid(spark, sf), RES, 3.0).select("point_id", *KEY)


PROBE_SQL = "(CAST(floor(x/2.0) AS INTEGER) - vx + 1)"


@query(
    "joi2_probe_order_cap",
    W.with_views(GRID, "SELECT point_id, vx, vy, vz, rank FROM (SELECT point_id, vx, vy, vz, row_number() OVER (PARTITION BY point_id ORDER BY vx, vy, vz) AS rank FROM pairs) WHERE rank <= 8"),
)
def joi2(spark, sf):
    pairs = neighbors.radius_pairs(W.scan(spark, sf), map_grid(spark, sf), RES)
    return neighbors.first_pairs(pairs, 8, ("__probe",)).select("point_id", *KEY, "rank")


@query("joi3_brute_force_cap", W.with_views(GRID, "SELECT point_id, vx, vy, vz, rank FROM (SELECT point_id, vx, vy, vz, row_number() OVER (PARTITION BY point_id ORDER BY vx, vy, vz) AS rank FROM pairs) WHERE rank <= 8"))
def joi3(spark, sf):
    return neighbors.first_pairs(neighbors.radius_pairs(W.scan(spark, sf), map_grid(spark, sf), RES), 8, KEY).select("point_id", *KEY, "rank")


@query("joi5_cell_neighbours", W.with_views("points scan cells gauss dets grid", "SELECT c.point_id, g.vx, g.vy, g.vz FROM cells c JOIN grid g ON abs(c.vx-g.vx) <= 1 AND abs(c.vy-g.vy) <= 1 AND abs(c.vz-g.vz) <= 1"))
def joi5(spark, sf):
    return neighbors.cell_pairs(W.scan(spark, sf), map_grid(spark, sf), RES).select("point_id", *KEY)


@query("joi6_lookup", W.with_views("points cells gauss", "SELECT c.point_id, g.n FROM cells c JOIN gauss g USING (vx, vy, vz)"))
def joi6(spark, sf):
    return neighbors.lookup(G.with_cells(W.points(spark, sf), RES).select("point_id", *KEY), voxel.gaussians(W.points(spark, sf), RES)).select("point_id", "n")


@query("joi15_points_by_poses", W.with_views("points scan poses", "SELECT pose_id, count(*) AS n, " + ", ".join(f"{R(f'sum({e})', 3)} AS s{a}" for e, a in zip(MOVED_SQL, XYZ, strict=True)) + " FROM scan, poses GROUP BY pose_id"))
def joi15(spark, sf):
    moved = neighbors.at_poses(W.scan(spark, sf).select("point_id", *XYZ), W.poses(spark))
    return moved.groupBy("pose_id").agg(F.count(F.lit(1)).alias("n"), *[r(F.sum(a), 3).alias(f"s{a}") for a in XYZ])


# --- sorts, limits, sets -----------------------------------------------------------------------------


@query("srt1_stable_sort", W.with_views("bulk", "SELECT point_id, row_number() OVER (ORDER BY vx, point_id) - 1 AS position FROM bc", BULK_CELLS))
def srt1(spark, sf):
    rows = voxel.sorted_keys(G.with_cells(W.bulk(spark, sf), 5.0).select("vx", "point_id"), "vx", "point_id")
    lengths = rows.groupBy("vx").agg(F.count(F.lit(1)).alias("length"))
    starts = voxel.run_lengths(rows, "vx").select(F.col("code").alias("vx"), "start")
    inner = voxel.numbered(rows, ["point_id"], ["vx"], "inner")
    return inner.join(starts, "vx").join(lengths, "vx").select("point_id", (F.col("start") + F.col("inner")).alias("position"))


@query("srt3_nearest_first", W.with_views(GRID, f"SELECT point_id, vx, vy, vz, rank FROM (SELECT point_id, vx, vy, vz, row_number() OVER (PARTITION BY point_id ORDER BY {DIST}, vx, vy, vz) AS rank FROM pairs) WHERE rank <= 3"))
def srt3(spark, sf):
    return neighbors.first_pairs(neighbors.radius_pairs(W.scan(spark, sf), map_grid(spark, sf), RES), 3).select("point_id", *KEY, "rank")


def tile_table(points):
    """Points with the number of their tile of 4 m."""
    return points.withColumn("tile_id", F.concat_ws("_", G.cell("x", 4.0), G.cell("y", 4.0)))


TILE = "tp AS (SELECT *, concat_ws('_', CAST(floor(x/4.0) AS INTEGER), CAST(floor(y/4.0) AS INTEGER)) AS tile_id FROM points)"
TILES = f"tiles AS (SELECT tile_id, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM tp GROUP BY tile_id)"


def tile_sets(spark, sf):
    own = voxel.centroids(tile_table(W.points(spark, sf)), "tile_id")
    return own, tiles.in_area(own, 0.0, 0.0, 4.0), tiles.in_area(own, 2.0, 1.0, 4.0)


AREA_A, AREA_B = "sqrt(cx*cx + cy*cy) <= 4", "sqrt((cx-2)*(cx-2) + (cy-1)*(cy-1)) <= 4"


@query("joi14_tile_difference", W.with_views("points", f"SELECT tile_id, 'add' AS action FROM tiles WHERE {AREA_B} AND NOT ({AREA_A}) UNION ALL SELECT tile_id, 'remove' FROM tiles WHERE {AREA_A} AND NOT ({AREA_B})", TILE, TILES))
def joi14(spark, sf):
    _, held, wanted = tile_sets(spark, sf)
    return tiles.difference(wanted, held)


@query("set1_tile_union", W.with_views("points", f"SELECT point_id, tile_id FROM tp WHERE tile_id IN (SELECT tile_id FROM tiles WHERE {AREA_B})", TILE, TILES))
def set1(spark, sf):
    _, held, wanted = tile_sets(spark, sf)
    every = tile_table(W.points(spark, sf)).select("point_id", "tile_id")
    mine = lambda t: every.join(t.select("tile_id"), "tile_id", "left_semi")
    gone = held.join(wanted, "tile_id", "left_anti")
    return tiles.upsert(mine(held), mine(wanted), gone).select("point_id", "tile_id")


@query("set3_removals", W.with_views("points", f"SELECT tile_id FROM tiles WHERE {AREA_A} EXCEPT SELECT tile_id FROM tiles WHERE {AREA_B}", TILE, TILES))
def set3(spark, sf):
    _, held, wanted = tile_sets(spark, sf)
    return held.select("tile_id").exceptAll(wanted.select("tile_id"))


SET4_SQL = W.with_views(
    "points",
    f"SELECT coalesce(a.vx, b.vx) AS vx, coalesce(a.vy, b.vy) AS vy, coalesce(a.vz, b.vz) AS vz, CASE WHEN b.n IS NULL THEN 'left' WHEN a.n IS NULL THEN 'right' ELSE 'both' END AS side, {R('sqrt((a.mx-b.mx)*(a.mx-b.mx)+(a.my-b.my)*(a.my-b.my)+(a.mz-b.mz)*(a.mz-b.mz))')} AS mean_gap, "
    + R("sqrt(" + " + ".join(f"{1 if p == q else 2}*(a.c{p}{q}-b.c{p}{q})*(a.c{p}{q}-b.c{p}{q})" for p, q in voxel.PAIRS) + ")")
    + " AS cov_gap, a.n - b.n AS count_gap FROM ga a FULL JOIN gb b ON a.vx = b.vx AND a.vy = b.vy AND a.vz = b.vz",
    *[
        f"g{s} AS (SELECT CAST(floor(x/2.0) AS INTEGER) AS vx, CAST(floor(y/2.0) AS INTEGER) AS vy, CAST(floor(z/2.0) AS INTEGER) AS vz, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, "
        + ", ".join(f"covar_samp({p},{q}){' + 1.0/(count(*)-1)' if p == q else ''} AS c{p}{q}" for p, q in voxel.PAIRS)
        + f" FROM points WHERE {w} GROUP BY 1, 2, 3 HAVING count(*) >= 6)"
        for s, w in (("a", "true"), ("b", "point_id % 3 <> 0"))
    ],
)


@query("set4_grid_match", SET4_SQL)
def set4(spark, sf):
    points = W.points(spark, sf)
    found = voxel.matched(voxel.gaussians(points, RES), voxel.gaussians(points.filter("point_id % 3 <> 0"), RES))
    return rounded(found, ["mean_gap", "cov_gap"])


@query("snk5_members", W.with_views("points cells", f"SELECT vx, vy, vz, point_id, {rs('xyz')}, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY point_id) <= 5 AS shown FROM cells"))
def snk5(spark, sf):
    return rounded(voxel.members(W.points(spark, sf), RES), XYZ)


# --- scores ------------------------------------------------------------------------------------------

D1, DD2 = scoring.constants(RES)
QUAD = "ixx*dx*dx + iyy*dy*dy + izz*dz*dz + 2*(ixy*dx*dy + ixz*dx*dz + iyz*dy*dz)"
CONST_SQL = "k AS (SELECT -ln(10*0.45 + 0.55/8) + ln(0.55/8) AS d1, -2*ln((-ln(10*0.45*exp(-0.5) + 0.55/8) + ln(0.55/8)) / (-ln(10*0.45 + 0.55/8) + ln(0.55/8))) AS d2)"
SCORED = f"scored AS (SELECT point_id, vx, vy, vz, -d1*exp(-d2/2*({QUAD})) AS score FROM pairs, k)"
PER_POINT = "per_point AS (SELECT s.point_id, coalesce(sum(score), 0.0) AS score_sum, coalesce(max(score), 0.0) AS score_max, count(score) AS pairs FROM scan s LEFT JOIN scored USING (point_id) GROUP BY s.point_id)"
TOTALS = f"SELECT {R('sum(score_sum)', 4)} AS total, CAST(sum(pairs) AS BIGINT) AS pairs, count(*) FILTER (pairs > 0) AS matched, count(*) FILTER (pairs = 0) AS unmatched, {R('sum(score_sum)/sum(pairs)', 5)} AS tp_per_pair, {R('sum(score_sum)/count(*)', 5)} AS tp_per_point, {R('sum(score_max)/count(*) FILTER (pairs > 0)', 5)} AS nvtl"


def totals(df, *by):
    out = rounded(rounded(df, ["total"], 4), ["tp_per_pair", "tp_per_point", "nvtl"], 5)
    return out.select(*by, "total", "pairs", "matched", "unmatched", "tp_per_pair", "tp_per_point", "nvtl")


@query("ndt1_constants", f"WITH {CONST_SQL} SELECT {R('d1')} AS d1, {R('d2')} AS d2 FROM k")
def ndt1(spark, sf):
    return spark.range(1).select(r(F.lit(D1)).alias("d1"), r(F.lit(DD2)).alias("d2"))


@query("ndt2_pair_scores", W.with_views(GRID, f"SELECT point_id, vx, vy, vz, {R('score', 5)} AS score FROM scored", CONST_SQL, SCORED))
def ndt2(spark, sf):
    return rounded(scoring.scored_pairs(W.scan(spark, sf), map_grid(spark, sf), RES), ["score"], 5).select("point_id", *KEY, "score")


@query("ndt3_point_scores", W.with_views(GRID, f"SELECT point_id, {R('score_sum', 5)} AS score_sum, {R('score_max', 5)} AS score_max, pairs FROM per_point", CONST_SQL, SCORED, PER_POINT))
def ndt3(spark, sf):
    return rounded(scoring.point_scores(W.scan(spark, sf), map_grid(spark, sf), RES), ["score_sum", "score_max"], 5).select("point_id", "score_sum", "score_max", "pairs")


@query("ndt4_ndt5_scan_scores", W.with_views(GRID, TOTALS + " FROM per_point", CONST_SQL, SCORED, PER_POINT))
def ndt45(spark, sf):
    return totals(scoring.scan_scores(scoring.point_scores(W.scan(spark, sf), map_grid(spark, sf), RES)))


CELL_PAIRS = "pairs AS (SELECT c.point_id, c.x-g.mx AS dx, c.y-g.my AS dy, c.z-g.mz AS dz, g.* FROM cells c JOIN grid g ON abs(c.vx-g.vx) <= 1 AND abs(c.vy-g.vy) <= 1 AND abs(c.vz-g.vz) <= 1 WHERE c.point_id % 7 = 0)"


@query("ndt6_nvtl_cells", W.with_views("points scan cells gauss dets grid", TOTALS + " FROM per_point", CELL_PAIRS, CONST_SQL, SCORED, PER_POINT))
def ndt6(spark, sf):
    return totals(scoring.scan_scores(scoring.point_scores(W.scan(spark, sf), map_grid(spark, sf), RES, cells_only=True)))


SIMPLE = "gauss AS (SELECT vx, vy, vz, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, " + ", ".join(f"covar_pop({p},{q}){' + 0.01' if p == q else ''} AS c{p}{q}" for p, q in voxel.PAIRS) + " FROM cells GROUP BY vx, vy, vz HAVING count(*) >= 6)"


@query("ndt7_nvtl_simple_grid", "WITH " + ",\n".join([W.SQL["points"], W.SQL["scan"], W.SQL["cells"], SIMPLE, W.SQL["dets"], W.SQL["grid"], CELL_PAIRS, CONST_SQL, SCORED, PER_POINT]) + f" SELECT {R('sum(score_max)/count(*) FILTER (pairs > 0)', 4)} AS nvtl FROM per_point")
def ndt7(spark, sf):
    scores = scoring.point_scores(W.scan(spark, sf), scoring.simple_grid(W.points(spark, sf), RES), RES, cells_only=True)
    return scoring.scan_scores(scores).select(r("nvtl", 4).alias("nvtl"))


MOVED = "moved AS (SELECT pose_id, point_id, " + ", ".join(f"{e} AS {a}" for e, a in zip(MOVED_SQL, XYZ, strict=True)) + " FROM scan, poses)"
POSE_PAIRS = "pairs AS (SELECT s.pose_id, s.point_id, s.x-g.mx AS dx, s.y-g.my AS dy, s.z-g.mz AS dz, g.* FROM moved s JOIN grid g ON (s.x-g.mx)*(s.x-g.mx) + (s.y-g.my)*(s.y-g.my) + (s.z-g.mz)*(s.z-g.mz) <= 4.0)"
POSE_POINT = f"per_point AS (SELECT m.pose_id, m.point_id, coalesce(sum(score), 0.0) AS score_sum, coalesce(max(score), 0.0) AS score_max, count(score) AS pairs FROM moved m LEFT JOIN (SELECT pose_id, point_id, -d1*exp(-d2/2*({QUAD})) AS score FROM pairs, k) USING (pose_id, point_id) GROUP BY m.pose_id, m.point_id)"


@query("ndt8_pose_scores", W.with_views("points scan cells gauss dets grid poses", TOTALS.replace("SELECT ", "SELECT pose_id, ", 1) + " FROM per_point GROUP BY pose_id", CONST_SQL, MOVED, POSE_PAIRS, POSE_POINT))
def ndt8(spark, sf):
    return totals(scoring.pose_scores(W.scan(spark, sf), W.poses(spark), map_grid(spark, sf), RES), "pose_id")


@query("ndt9_point_score_max", W.with_views(GRID, f"SELECT s.point_id, {R('s.x')} AS x, {R('s.y')} AS y, {R('s.z')} AS z, {R('p.score_max', 5)} AS score_max FROM scan s JOIN per_point p USING (point_id)", CONST_SQL, SCORED, PER_POINT))
def ndt9(spark, sf):
    scores = scoring.point_scores(W.scan(spark, sf), map_grid(spark, sf), RES)
    return rounded(rounded(scores, XYZ), ["score_max"], 5).select("point_id", *XYZ, "score_max")


GROUND = PER_POINT.replace("FROM scan s", "FROM (SELECT * FROM scan WHERE z > 0.5) s")


@query("ndt10_no_ground_scores", W.with_views(GRID, TOTALS + " FROM per_point", CONST_SQL, SCORED, GROUND))
def ndt10(spark, sf):
    kept = filters.above_ground(W.scan(spark, sf), (0.0,) * 6, 0.5)
    return totals(scoring.scan_scores(scoring.point_scores(kept, map_grid(spark, sf), RES)))


# --- derivatives: the rotation's derivatives in SQL, by the same trigonometric rules written out -----

S = {"r": "sin(roll)", "p": "sin(pitch)", "y": "sin(yaw)"}
FIRST_SQL = {
    0: ["0", "0", "0", f"-({XYZ_SQL[6]})", f"-({XYZ_SQL[7]})", f"-({XYZ_SQL[8]})", XYZ_SQL[3], XYZ_SQL[4], XYZ_SQL[5]],
    1: ["-sin(pitch)*cos(yaw)", "sin(pitch)*sin(yaw)", "cos(pitch)", "sin(roll)*cos(pitch)*cos(yaw)", "-sin(roll)*cos(pitch)*sin(yaw)", "sin(roll)*sin(pitch)", "-cos(roll)*cos(pitch)*cos(yaw)", "cos(roll)*cos(pitch)*sin(yaw)", "-cos(roll)*sin(pitch)"],
    2: [XYZ_SQL[1], f"-({XYZ_SQL[0]})", "0", XYZ_SQL[4], f"-({XYZ_SQL[3]})", "0", XYZ_SQL[7], f"-({XYZ_SQL[6]})", "0"],
}
PITCH2 = ["-cos(pitch)*cos(yaw)", "cos(pitch)*sin(yaw)", "-sin(pitch)", "-sin(roll)*sin(pitch)*cos(yaw)", "sin(roll)*sin(pitch)*sin(yaw)", "sin(roll)*cos(pitch)", "cos(roll)*sin(pitch)*cos(yaw)", "-cos(roll)*sin(pitch)*sin(yaw)", "-cos(roll)*cos(pitch)"]


def turned_rows(m):
    """By roll: rows 2 and 3 turn into -3 and 2."""
    return ["0", "0", "0", *[f"-({e})" for e in m[6:]], *m[3:6]]


def turned_columns(m):
    """By yaw: columns 1 and 2 turn into 2 and -1."""
    return [x for i in range(3) for x in (m[3 * i + 1], f"-({m[3 * i]})", "0")]


SECOND_SQL = {
    (0, 0): turned_rows(FIRST_SQL[0]),
    (0, 1): turned_rows(FIRST_SQL[1]),
    (0, 2): turned_rows(FIRST_SQL[2]),
    (1, 1): PITCH2,
    (1, 2): turned_columns(FIRST_SQL[1]),
    (2, 2): turned_columns(FIRST_SQL[2]),
}
ON_POINT = lambda m: [f"({m[3 * i]})*x + ({m[3 * i + 1]})*y + ({m[3 * i + 2]})*z" for i in range(3)]
JAC = "jac AS (SELECT point_id, " + ", ".join(f"{e} AS {a}" for e, a in zip(MOVED_SQL, XYZ, strict=True)) + ", " + ", ".join(f"{e} AS j{a}{i}" for a in range(3) for i, e in enumerate(ON_POINT(FIRST_SQL[a]))) + ", " + ", ".join(f"{e} AS k{a}{b}{i}" for (a, b), m in SECOND_SQL.items() for i, e in enumerate(ON_POINT(m))) + " FROM scan, pose)"


@query("ndt11_point_jacobian", W.with_views("points scan", "SELECT point_id, " + rs([f"j{a}{i}" for a in range(3) for i in range(3)]) + " FROM jac", POSE_SQL, JAC))
def ndt11(spark, sf):
    rows = scoring.with_jacobian(scoring.moved(W.scan(spark, sf), W.POSE), W.POSE)
    names = [f"j{a}{i}" for a in range(3) for i in range(3)]
    return rounded(rows, names).select("point_id", *names)


K_NAMES = [f"k{a}{b}{i}" for a, b in SECOND_SQL for i in range(3)]


@query("ndt12_point_hessian", W.with_views("points scan", "SELECT point_id, " + rs(K_NAMES) + " FROM jac", POSE_SQL, JAC))
def ndt12(spark, sf):
    rows = scoring.with_jacobian(scoring.moved(W.scan(spark, sf), W.POSE), W.POSE)
    return rounded(rows, K_NAMES).select("point_id", *K_NAMES)


PAIR_J = "pj AS (SELECT j.*, j.x-g.mx AS dx, j.y-g.my AS dy, j.z-g.mz AS dz, g.* FROM jac j JOIN grid g ON (j.x-g.mx)*(j.x-g.mx) + (j.y-g.my)*(j.y-g.my) + (j.z-g.mz)*(j.z-g.mz) <= 4.0)"
PULL = "pu AS (SELECT *, ixx*dx+ixy*dy+ixz*dz AS u0, ixy*dx+iyy*dy+iyz*dz AS u1, ixz*dx+iyz*dy+izz*dz AS u2 FROM pj)"
POWER = "pe AS (SELECT *, exp(-d2/2*(u0*dx+u1*dy+u2*dz)) AS e, u0*j00+u1*j01+u2*j02 AS u3, u0*j10+u1*j11+u2*j12 AS u4, u0*j20+u1*j21+u2*j22 AS u5 FROM pu, k)"
INV_M = [["ixx", "ixy", "ixz"], ["ixy", "iyy", "iyz"], ["ixz", "iyz", "izz"]]


def h_sql(i: int, j: int) -> str:
    col = lambda a: [("1" if k == a else "0") for k in range(3)] if a < 3 else [f"j{a - 3}{k}" for k in range(3)]
    inner = " + ".join(f"({x})*{INV_M[p][q]}*({y})" for p, x in enumerate(col(i)) for q, y in enumerate(col(j)) if "0" not in (x, y))
    curve = f" + u0*k{i - 3}{j - 3}0 + u1*k{i - 3}{j - 3}1 + u2*k{i - 3}{j - 3}2" if i >= 3 else ""
    return f"f*(-d2*u{i}*u{j} + {inner}{curve})"


DERIV = "pd AS (SELECT *, CASE WHEN d2*e BETWEEN 0 AND 1 THEN d1*d2*e ELSE 0.0 END AS f FROM pe)"
TERMS_SQL = {"score": "CASE WHEN d2*e BETWEEN 0 AND 1 THEN -d1*e ELSE 0.0 END"} | {f"g{i}": f"f*u{i}" for i in range(6)} | {f"h{i}{j}": h_sql(i, j) for i, j in scoring.TRIANGLE}
DERIV_VIEWS = (POSE_SQL, CONST_SQL, JAC, PAIR_J, PULL, POWER, DERIV)


@query("ndt13_pair_derivatives", W.with_views("points scan cells gauss dets grid", "SELECT point_id, vx, vy, vz, " + ", ".join(f"{R(e, 4)} AS {n}" for n, e in TERMS_SQL.items()) + " FROM pd", *DERIV_VIEWS))
def ndt13(spark, sf):
    pairs = neighbors.radius_pairs(scoring.with_jacobian(scoring.moved(W.scan(spark, sf), W.POSE), W.POSE), map_grid(spark, sf), RES)
    return rounded(scoring.pair_derivatives(pairs, D1, DD2), scoring.TERMS, 4).select("point_id", *KEY, *scoring.TERMS)


PLANES = "grid AS (SELECT vx, vy, vz, n, mx, my, mz, " + ", ".join(f"p1{c[1:]} AS {c}" for c in voxel.INV) + " FROM pr)"


@query("ndt14_plane_derivatives", W.with_views("points scan cells gauss", "SELECT " + ", ".join(f"{R(f'sum({e})', 3)} AS {n}" for n, e in TERMS_SQL.items()) + ", count(*) AS pairs FROM pd", *LATENT, PLANES, *DERIV_VIEWS))
def ndt14(spark, sf):
    """To planes: the inverse is the square of the normal."""
    return rounded(scoring.total_derivatives(W.scan(spark, sf), voxel.grid(W.points(spark, sf), RES), W.POSE, RES, "plane"), scoring.TERMS, 3)


@query("ndt15_total_derivatives", W.with_views("points scan cells gauss dets grid", "SELECT " + ", ".join(f"{R(f'sum({e})', 3)} AS {n}" for n, e in TERMS_SQL.items()) + ", count(*) AS pairs FROM pd", *DERIV_VIEWS))
def ndt15(spark, sf):
    return rounded(scoring.total_derivatives(W.scan(spark, sf), map_grid(spark, sf), W.POSE, RES), scoring.TERMS, 3)


@query(
    "ndt16_regularisation",
    W.with_views("poses", f"SELECT pose_id, {R('-0.01*100*l*l')} AS reg_score, {R('2*0.01*100*cos(yaw)*l')} AS reg_g0, {R('2*0.01*100*sin(yaw)*l')} AS reg_g1, {R('-2*0.01*100*cos(yaw)*cos(yaw)')} AS reg_h00, {R('-2*0.01*100*cos(yaw)*sin(yaw)')} AS reg_h01, {R('-2*0.01*100*sin(yaw)*sin(yaw)')} AS reg_h11 FROM (SELECT *, (2.0-ty)*sin(yaw) + (1.0-tx)*cos(yaw) AS l FROM poses)"),
)
def ndt16(spark, sf):
    return W.poses(spark).select("pose_id", *[r(e).alias(n) for n, e in scoring.regularisation((1.0, 2.0), "tx", "ty", "yaw", 100).items()])


# --- optimisation: steps that SQL can follow --------------------------------------------------------------


@query("opt6_candidate_scores", W.with_views("points scan cells gauss dets grid", TOTALS.replace("SELECT ", "SELECT pose_id, ", 1) + " FROM per_point GROUP BY pose_id", "poses(pose_id, tx, ty, tz, roll, pitch, yaw) AS (VALUES " + ", ".join(f"({k}, CAST({0.1 * s!r} AS DOUBLE), 0.0, 0.0, 0.0, 0.0, CAST({0.01 * s!r} AS DOUBLE))" for k, s in enumerate(newton.candidate_steps())) + ")", CONST_SQL, MOVED, POSE_PAIRS, POSE_POINT))
def opt6(spark, sf):
    steps = spark.createDataFrame([(k, 0.1 * s, 0.0, 0.0, 0.0, 0.0, 0.01 * s) for k, s in enumerate(newton.candidate_steps())], "pose_id int, tx double, ty double, tz double, roll double, pitch double, yaw double")
    return totals(scoring.pose_scores(W.scan(spark, sf), steps, map_grid(spark, sf), RES), "pose_id")


@query(
    "opt15_density_ratio",
    W.with_views(
        "points",
        f"SELECT candidate_id, {R('max(CASE WHEN good THEN l END) - 5*max(CASE WHEN NOT good THEN l END)', 4)} AS ratio FROM p GROUP BY candidate_id",
        "c AS (SELECT point_id AS candidate_id, x, y, z AS yaw FROM points)",
        "t AS (SELECT row_number() OVER (ORDER BY x DESC, point_id) AS rank, x, y, z AS yaw FROM points ORDER BY x DESC, point_id LIMIT 200)",
        f"m AS (SELECT candidate_id, rank <= 10 AS good, -0.5*((c.x-t.x)/0.5)*((c.x-t.x)/0.5) - ln(0.5*sqrt(2*pi())) - 0.5*((c.y-t.y)/0.5)*((c.y-t.y)/0.5) - ln(0.5*sqrt(2*pi())) - 0.5*({WRAP('c.yaw-t.yaw')}/0.3)*({WRAP('c.yaw-t.yaw')}/0.3) - ln(0.3*sqrt(2*pi())) AS g FROM c, t)",
        "top AS (SELECT candidate_id, good, max(g) AS top FROM m GROUP BY 1, 2)",
        "p AS (SELECT candidate_id, good, max(top) + ln(sum(exp(g-top))/count(*)) AS l FROM m JOIN top USING (candidate_id, good) GROUP BY 1, 2)",
    ),
)
def opt15(spark, sf):
    """All points as candidates against the 200 trials that a search has, the best ones by score (x)."""
    points = W.points(spark, sf)
    candidates = points.select(F.col("point_id").alias("candidate_id"), "x", "y", F.col("z").alias("yaw"))
    best = points.orderBy(F.col("x").desc(), "point_id").limit(200)
    trials = best.select(F.row_number().over(Window.orderBy(F.col("x").desc(), "point_id")).alias("rank"), "x", "y", F.col("z").alias("yaw"))
    return search.density_ratio(candidates, trials, (0.5, 0.5, 0.3), search.good_count(200)).select("candidate_id", r("ratio", 4).alias("ratio"))


@query("src14_half_cube", "SELECT count(*) AS n, " + ", ".join(f"{R(f'sum({a})', 1)} AS s{a}" for a in "xyz") + " FROM (SELECT u AS x, v AS y, 0.0 AS z FROM g, h UNION ALL SELECT 0.0, u, v FROM g, h UNION ALL SELECT u, 0.0, v FROM g, h)")
def src14(spark, sf):
    cube = clouds.half_cube(spark)
    return cube.agg(F.count(F.lit(1)).alias("n"), *[r(F.sum(a), 1).alias(f"s{a}") for a in XYZ])


SQL["src14_half_cube"] = "WITH g AS (SELECT CAST(CAST(0.2 AS FLOAT) * CAST(i AS FLOAT) AS DOUBLE) AS u FROM range(101) t(i)), h AS (SELECT u AS v FROM g) " + SQL["src14_half_cube"]
