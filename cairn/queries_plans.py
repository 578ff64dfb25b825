"""Queries on codecs, alignment plans and covariances."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from cairn import views as W
from cairn.functions import geometry as G
from cairn.operators import voxel
from cairn.plans import alignment, newton, search
from cairn.queries_space import DERIV_VIEWS, LATENT, RAMP_SQL, RES, TERMS_SQL, XYZ_SQL, R, map_grid, r, rounded, rs
from cairn.sources import clouds, logs

QUERIES: dict = {}
SQL: dict[str, str] = {}
XYZ = voxel.XYZ
OFFSETS = [(0.0, 0.5), (0.0, -0.5), (1.0, 0.0), (-1.0, 0.0), (0.5, 0.5), (-0.5, -0.5)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- codecs ----------------------------------------------------------------------------------------------


def bits_sql(c: str) -> str:
    """The bits of a 32-bit float as a number."""
    v = f"abs(CAST(CAST({c} AS FLOAT) AS DOUBLE))"
    power = f"floor(log2({v}))"
    # a logarithm may be rounded over the next power
    power = f"({power} + CASE WHEN pow(2, {power}) > {v} THEN -1 WHEN pow(2, {power} + 1) <= {v} THEN 1 ELSE 0 END)"
    return f"CASE WHEN {v} = 0 THEN 0 ELSE CAST(CASE WHEN {c} < 0 THEN 2147483648 ELSE 0 END + ({power} + 127) * 8388608 + ({v} / pow(2, {power}) - 1) * 8388608 AS BIGINT) END"


def words_of(blobs, step: int):
    """A blob's 32-bit words, little-endian, a row for each point."""
    each = blobs.select("cloud_id", "width", "point_step", F.col("data").alias("d"), F.posexplode(F.sequence(F.lit(0), F.col("width") - 1)).alias("place", "p"))
    byte = lambda k, j: F.conv(F.hex(F.substring("d", F.col("p") * step + (4 * k + j + 1), F.lit(1))), 16, 10).cast("long")
    return each.select("cloud_id", "width", "point_step", F.col("place").cast("long").alias("place"), *[sum((byte(k, j) * 256**j for j in range(1, 4)), byte(k, 0)).alias(f"w{k}") for k in range(step // 4)])


WORDS_SQL = "SELECT CAST(cloud_id AS VARCHAR) AS cloud_id, CAST(count(*) OVER (PARTITION BY cloud_id) AS INTEGER) AS width, {step} AS point_step, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) - 1 AS place, " + ", ".join(f"{bits_sql(c)} AS w{k}" for k, c in enumerate(XYZ))
@query("snk1_cloud_encode", W.with_views("points", WORDS_SQL.format(step=12) + " FROM points"))
def snk1(spark, sf):
    """The bytes themselves, as words of 32 bits."""
    return words_of(clouds.encode(W.points(spark, sf)), 12)


@query("snk2_coloured_encode", W.with_views("points", WORDS_SQL.format(step=16) + ", CAST(" + " + ".join(f"floor(255*({RAMP_SQL[c]}))*{w}" for c, w in (("red", 65536), ("green", 256), ("blue", 1))) + " AS BIGINT) AS w3 FROM points"))
def snk2(spark, sf):
    coloured = W.points(spark, sf).withColumn("rgb", G.rgb_packed(G.score_ramp("x", -4.0, 4.0)))
    return words_of(clouds.encode(coloured, "rgb"), 16)


@query("src1_cloud_decode", W.with_views("points", "SELECT CAST(cloud_id AS VARCHAR) AS cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) - 1 AS point_id, " + ", ".join(f"{R(f'CAST(CAST({a} AS FLOAT) AS DOUBLE)')} AS {a}" for a in XYZ) + " FROM points"))
def src1(spark, sf):
    return rounded(clouds.decode(clouds.encode(W.points(spark, sf))), XYZ)


DUMPED = [*voxel.MEANS, *voxel.COV, *voxel.INV]


DUMP_SQL = f"SELECT vx, vy, vz, n, {rs([*voxel.MEANS, *voxel.COV], 5)}, " + ", ".join(f"{R(e, 5)} AS {c}" for c, e in zip(voxel.INV, ["(cyy*czz-cyz*cyz)/det", "(cxz*cyz-cxy*czz)/det", "(cxy*cyz-cxz*cyy)/det", "(cxx*czz-cxz*cxz)/det", "(cxy*cxz-cxx*cyz)/det", "(cxx*cyy-cxy*cxy)/det"], strict=True)) + " FROM dets WHERE det > 0"


@query("src2_voxel_dump", W.with_views("points cells gauss dets", DUMP_SQL))
def src2(spark, sf):
    return rounded(logs.line_voxels(logs.voxel_lines(map_grid(spark, sf), RES), RES), DUMPED, 5)


@query("snk4_voxel_json", W.with_views("points cells gauss dets", "SELECT place, CASE WHEN place = 0 THEN '{\"resolution\":2.0,\"num_voxels\":' || total || ',\"voxels\":[' WHEN place > total THEN ']}' ELSE 'voxel' END AS kind, n, mean_x, comma FROM (SELECT row_number() OVER (ORDER BY vx, vy, vz) AS place, count(*) OVER () AS total, n, " + R("mx", 5) + " AS mean_x, row_number() OVER (ORDER BY vx, vy, vz) < count(*) OVER () AS comma FROM dets WHERE det > 0 UNION ALL SELECT 0, count(*), NULL, NULL, FALSE FROM dets WHERE det > 0 UNION ALL SELECT count(*) + 1, count(*), NULL, NULL, FALSE FROM dets WHERE det > 0)"))
def snk4(spark, sf):
    """The document's lines: its head and end as they are, of each voxel what it says."""
    lines = logs.voxel_lines(map_grid(spark, sf), RES)
    inner = F.col("line").startswith('{"mean"')
    line = F.regexp_replace("line", ",$", "")
    mean = F.get_json_object(line, "$.mean[0]").cast("double")
    return lines.select("place", F.when(inner, "voxel").otherwise(F.col("line")).alias("kind"), F.get_json_object(F.when(inner, line), "$.point_count").cast("long").alias("n"), r(F.when(inner, mean), 5).alias("mean_x"), (inner & F.col("line").endswith(",")).alias("comma"))


# --- covariances and offsets -----------------------------------------------------------------------------

DIAGONAL = (0.04, 0.09, 0.16)


@query("opt13_rotated_covariance", W.with_views("poses", "SELECT pose_id, " + ", ".join(R(" + ".join(f"({XYZ_SQL[3 * i + k]})*({XYZ_SQL[3 * j + k]})*{d}" for k, d in enumerate(DIAGONAL))) + f" AS c{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM poses"))
def opt13(spark, sf):
    m = G.rotation("roll", "pitch", "yaw")
    entry = lambda i, j: G.dot([m[i][k] * d for k, d in enumerate(DIAGONAL)], m[j])
    return W.poses(spark).select("pose_id", *[r(entry(i, j)).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)])


@query("opt14_offset_poses", W.with_views("poses", f"SELECT pose_id, k AS start_id, {R(f'tx + ({XYZ_SQL[0]})*dx + ({XYZ_SQL[1]})*dy')} AS tx, {R(f'ty + ({XYZ_SQL[3]})*dx + ({XYZ_SQL[4]})*dy')} AS ty FROM poses, offsets", "offsets(k, dx, dy) AS (VALUES " + ", ".join(f"(CAST({k} AS BIGINT), CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for k, (x, y) in enumerate(OFFSETS)) + ")"))
def opt14(spark, sf):
    starts = alignment.offset_starts(W.poses(spark).withColumn("scan_id", F.col("pose_id")), OFFSETS)
    return starts.select(F.col("scan_id").alias("pose_id"), "start_id", r("tx").alias("tx"), r("ty").alias("ty"))


# --- alignment -------------------------------------------------------------------------------------------


def started(spark, poses):
    return spark.createDataFrame([("scan", k, *map(float, p)) for k, p in enumerate(poses)], "scan_id string, start_id long, " + ", ".join(f"{c} double" for c in alignment.POSE))


def outcome(spark, found: newton.Outcome):
    row = (found.status, found.iterations, found.score, found.pairs, found.oscillations, *map(float, found.pose))
    return spark.createDataFrame([row], "status string, iterations int, score double, pairs long, oscillations int, " + ", ".join(f"{c} double" for c in alignment.POSE))


START = (0.05, -0.05, 0.02, 0.0, 0.0, 0.0)
#: The grid that alignments use, with raised eigenvalues, and the constants of its scores.
COFACTORS = {"ixx": "cyy*czz-cyz*cyz", "ixy": "cxz*cyz-cxy*czz", "ixz": "cxy*cyz-cxz*cyy", "iyy": "cxx*czz-cxz*cxz", "iyz": "cxy*cxz-cxx*cyz", "izz": "cxx*cyy-cxy*cxy"}
RAISED = "grid AS (SELECT vx, vy, vz, n, mx, my, mz, " + ", ".join(f"CASE WHEN m1 > l1 OR m2 > l2 THEN p1{c[1:]}/m1 + p2{c[1:]}/m2 + p3{c[1:]}/m3 ELSE ({e}) / (cxx*(cyy*czz-cyz*cyz) - cxy*(cxy*czz-cyz*cxz) + cxz*(cxy*cyz-cyy*cxz)) END AS {c}" for c, e in COFACTORS.items()) + " FROM pr)"


def solved_sql() -> list[str]:
    """Views that solve -H x = g from sums s (g0.., h00..) by elimination, x0 to x5 in ``solved``; for Hessians that are negative definite."""
    own = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    out = ["e_0 AS (SELECT *, " + ", ".join([f"-h{i}{j} AS {own(i, j)}_0" for i in range(6) for j in range(i, 6)] + [f"g{i} AS b{i}_0" for i in range(6)]) + " FROM s)"]
    for k in range(5):
        rest = [f"{own(i, j)}_{k} - {own(k, i)}_{k}*{own(k, j)}_{k}/a{k}{k}_{k} AS {own(i, j)}_{k + 1}" for i in range(k + 1, 6) for j in range(i, 6)]
        rest += [f"b{i}_{k} - {own(k, i)}_{k}*b{k}_{k}/a{k}{k}_{k} AS b{i}_{k + 1}" for i in range(k + 1, 6)]
        out.append(f"e_{k + 1} AS (SELECT *, {', '.join(rest)} FROM e_{k})")
    back = [f"(b{i}_{i}" + "".join(f" - {own(i, j)}_{i}*x{j}" for j in range(i + 1, 6)) + f")/a{i}{i}_{i} AS x{i}" for i in range(5, -1, -1)]
    return [*out, f"solved AS (SELECT *, {', '.join(back)} FROM e_5)"]


def tried_sql(settings: newton.Settings, jac: str, pairs: list[str]) -> list[str]:
    """Views of a line search over fixed lengths: every length's score and slope, and the one that is taken, as ``length`` in ``chosen``."""
    key, pose = "scan_id, start_id, it", alignment.POSE
    shrink, most = (0.618, 8) if settings.search == "candidates" else (0.5, 20)
    rest = "" if settings.search == "candidates" else " AND (j = 0 OR first * pow(0.5, j) >= 1e-6)"
    lengths = f"lengths AS (SELECT *, first * pow({shrink}, j) AS tried FROM (SELECT *, least(size, {settings.step}) AS first, " + " + ".join(f"g{i}*x{i}/size" for i in range(6)) + f" AS slope FROM stepped), (SELECT unnest(range({most})) AS j) WHERE size >= {settings.epsilon}{rest})"
    shifted = f"shifted AS (SELECT {key}, j, " + ", ".join(f"{c} + tried*x{i}/size AS {c}" for i, c in enumerate(pose)) + " FROM lengths)"
    own = re.sub(r"^jac AS \(SELECT scan_id, start_id, it, " + ", ".join(pose) + ",", f"cjac AS (SELECT {key}, j,", jac)
    own = re.sub(r"FROM st JOIN scans USING \(scan_id\) WHERE .*\)$", "FROM shifted JOIN scans USING (scan_id))", own)
    views = [re.sub(r"\b(FROM|JOIN) (jac|pj|pu|pe)\b", r"\1 c\2", "c" + v) for v in pairs]
    sums = f"csum AS (SELECT {key}, j, " + ", ".join(f"sum({TERMS_SQL[n]}) AS c{n}" for n in ("score", *[f"g{i}" for i in range(6)])) + f" FROM cpd GROUP BY {key}, j)"
    slope = " + ".join(f"coalesce(cg{i}, 0)*x{i}/size" for i in range(6))
    gain = "coalesce(cscore, 0) >= score + 1e-4*tried*slope"
    if settings.search == "candidates":
        take = f"coalesce(min(j) FILTER ({gain} AND abs({slope}) <= 0.9*abs(slope)), arg_min(j, (-coalesce(cscore, 0), j)))"
        taken = f"taken AS (SELECT {key}, max(first) * pow(0.618, {take}) AS length FROM lengths LEFT JOIN csum USING ({key}, j) GROUP BY {key})"
    else:
        taken = f"taken AS (SELECT {key}, coalesce(max(first) * pow(0.5, min(j) FILTER ({gain})), 1e-6) AS length FROM lengths LEFT JOIN csum USING ({key}, j) GROUP BY {key})"
    return [lengths, shifted, own, *views, sums, taken, f"chosen AS (SELECT * FROM stepped LEFT JOIN taken USING ({key}))"]


def aligned_sql(scans: str, starts: str, settings: newton.Settings = newton.Settings()) -> str:
    """The whole optimiser in SQL: a recursive query whose rows are the poses of every start after each step."""
    key, pose = "scan_id, start_id", ", ".join(alignment.POSE)
    first = next(v for v in DERIV_VIEWS if v.startswith("jac AS"))
    jac = first.replace("SELECT point_id", f"SELECT {key}, it, {pose}, point_id").replace("FROM scan, pose)", f"FROM st JOIN scans USING (scan_id) WHERE status IS NULL AND it < {settings.max_iterations})")
    pairs = [v for v in DERIV_VIEWS if v.split()[0] in ("pj", "pu", "pe", "pd")]
    sums = f"s AS (SELECT {key}, it, {pose}, count(*) AS pairs, " + ", ".join(f"sum({e}) AS {n}" for n, e in TERMS_SQL.items()) + f" FROM pd GROUP BY {key}, it, {pose})"
    size = "stepped AS (SELECT *, sqrt(" + " + ".join(f"x{i}*x{i}" for i in range(6)) + ") AS size FROM solved)"
    moved = ", ".join(f"CASE WHEN size < {settings.epsilon} THEN {c} ELSE {c} + {'least(size, ' + str(settings.step) + ')' if settings.search == 'none' else 'length'}*x{i}/size END AS {c}" for i, c in enumerate(alignment.POSE))
    found, more = "stepped", []
    if settings.search != "none":
        found, more = "chosen", tried_sql(settings, jac, pairs)
    step = f"SELECT {key}, it + 1 AS it, {moved}, CASE WHEN size < {settings.epsilon} THEN '{newton.CONVERGED}' WHEN it + 1 = {settings.max_iterations} THEN '{newton.LIMIT}' END AS status, score, pairs FROM {found}"
    inner = "WITH " + ",\n".join([jac, *pairs, sums, *solved_sql(), size, *more]) + "\n" + step
    start = f"SELECT {key}, 0 AS it, {pose}, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BIGINT) AS pairs FROM starts"
    const = next(v for v in DERIV_VIEWS if v.startswith("k AS"))
    same = "USING (scan_id, start_id)"
    views = [
        "scans AS (" + scans + ")",
        "starts AS (" + starts + ")",
        f"st AS ({start} UNION ALL ({inner}))",
        f"best AS (SELECT {key}, max(score) AS top, arg_min(it, (-score, it)) - 1 AS at FROM st WHERE score IS NOT NULL GROUP BY {key})",
        f"moves AS (SELECT *, tx - lag(tx) OVER w AS dx, ty - lag(ty) OVER w AS dy, tz - lag(tz) OVER w AS dz FROM st WHERE status IS DISTINCT FROM '{newton.CONVERGED}' WINDOW w AS (PARTITION BY {key} ORDER BY it))",
        f"turns AS (SELECT *, coalesce((dx*lag(dx) OVER w + dy*lag(dy) OVER w + dz*lag(dz) OVER w) / nullif(sqrt(dx*dx+dy*dy+dz*dz) * sqrt(lag(dx) OVER w*lag(dx) OVER w + lag(dy) OVER w*lag(dy) OVER w + lag(dz) OVER w*lag(dz) OVER w), 0) < -0.9, FALSE) AS turned FROM moves WINDOW w AS (PARTITION BY {key} ORDER BY it))",
        f"islands AS (SELECT *, count(*) FILTER (NOT turned) OVER (PARTITION BY {key} ORDER BY it) AS island FROM turns)",
        f"runs AS (SELECT {key}, max(n) AS oscillations FROM (SELECT {key}, count(*) FILTER (turned) AS n FROM islands GROUP BY {key}, island) GROUP BY {key})",
    ]
    last = f"SELECT {key}, l.status, l.it AS iterations, {R(f'CASE WHEN l.status = {chr(39)}{newton.LIMIT}{chr(39)} THEN b.top ELSE l.score END', 2)} AS score, l.pairs, CAST(r.oscillations AS INTEGER) AS oscillations, " + ", ".join(f"{R(f'CASE WHEN l.status = {chr(39)}{newton.LIMIT}{chr(39)} THEN p.{c} ELSE l.{c} END', 4)} AS {c}" for c in alignment.POSE) + f" FROM st l JOIN best b {same} JOIN runs r {same} JOIN st p ON p.scan_id = l.scan_id AND p.start_id = l.start_id AND p.it = b.at WHERE l.status IS NOT NULL"
    return W.with_views("points scan cells gauss", last.replace(f"SELECT {key},", "SELECT l.scan_id, l.start_id,", 1), *LATENT, RAISED, const, *views).replace("WITH ", "WITH RECURSIVE ", 1)


def start_rows(poses) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('scan', CAST({k} AS BIGINT), " + ", ".join(f"CAST({float(v)!r} AS DOUBLE)" for v in p) + ")" for k, p in enumerate(poses)) + ") t(scan_id, start_id, " + ", ".join(alignment.POSE) + ")"


def aligned(found):
    """The columns of alignments that SQL gives too."""
    return rounded(rounded(found, ["score"], 2), alignment.POSE, 4).select("scan_id", "start_id", "status", "iterations", "score", "pairs", "oscillations", *alignment.POSE)


ONE_SCAN = "SELECT 'scan' AS scan_id, point_id, x, y, z FROM scan"


def one_scan(spark, sf):
    return W.scan(spark, sf).select(F.lit("scan").alias("scan_id"), *XYZ)


@query("opt1_align_one_scan", aligned_sql(ONE_SCAN, start_rows([START])))
def opt1(spark, sf):
    """All iterations, a job for each evaluation."""
    scan, grid = W.scan(spark, sf).cache(), voxel.grid(W.points(spark, sf), RES).cache()
    try:
        return aligned(outcome(spark, alignment.align(scan, grid, START)).select(F.lit("scan").alias("scan_id"), F.lit(0).cast("long").alias("start_id"), "*"))
    finally:
        scan.unpersist()
        grid.unpersist()


def searched(spark, sf, search_: str):
    """All iterations with a line search, inside a task."""
    return aligned(alignment.align_many(one_scan(spark, sf), started(spark, [START]), voxel.grid(W.points(spark, sf), RES), newton.Settings(search=search_)))


@query("opt5_line_search")
def opt5(spark, sf):
    return searched(spark, sf, "more_thuente")


@query("opt6_candidate_search", aligned_sql(ONE_SCAN, start_rows([START]), newton.Settings(search="candidates")))
def opt6c(spark, sf):
    return searched(spark, sf, "candidates")


@query("opt9_many_starts", aligned_sql(ONE_SCAN, start_rows([(x, y, 0, 0, 0, 0) for x, y in OFFSETS])))
def opt9(spark, sf):
    return aligned(alignment.align_many(one_scan(spark, sf), started(spark, [(x, y, 0, 0, 0, 0) for x, y in OFFSETS]), voxel.grid(W.points(spark, sf), RES)))


@query("opt10_many_scans", aligned_sql("SELECT 'c' || cloud_id AS scan_id, point_id, x, y, z FROM points", "SELECT DISTINCT 'c' || cloud_id AS scan_id, CAST(0 AS BIGINT) AS start_id, CAST(0.1 AS DOUBLE) AS tx, CAST(-0.1 AS DOUBLE) AS ty, CAST(0 AS DOUBLE) AS tz, CAST(0 AS DOUBLE) AS roll, CAST(0 AS DOUBLE) AS pitch, CAST(0 AS DOUBLE) AS yaw FROM points"))
def opt10(spark, sf):
    scans = W.points(spark, sf).select(F.concat(F.lit("c"), "cloud_id").alias("scan_id"), *XYZ)
    starts = scans.select("scan_id").distinct().select("scan_id", F.lit(0).cast("long").alias("start_id"), *[F.lit(v).alias(c) for c, v in zip(alignment.POSE, (0.1, -0.1, 0.0, 0.0, 0.0, 0.0), strict=True)])
    return aligned(alignment.align_many(scans, starts, voxel.grid(W.points(spark, sf), RES)))


@query("opt11_cascade")
def opt11(spark, sf):
    return alignment.align_cascade(one_scan(spark, sf), started(spark, [(0.3, -0.2, 0.1, 0, 0, 0)]), W.points(spark, sf))


@query("opt16_initial_pose")
def opt16(spark, sf):
    """The whole search: 100 hypotheses drawn, 100 guided ones, each aligned to its end."""
    priors = spark.createDataFrame([("scan", [0.0] * 6, np.diag([0.25, 0.25, 0.01, 0, 0, 0.01]).reshape(-1).tolist())], "scan_id string, mean array<double>, covariance array<double>")
    return search.estimate_many(one_scan(spark, sf), priors, voxel.grid(W.points(spark, sf), RES))


@query("opt2_newton_steps")
def opt2(spark, sf):
    """The step by each solver, and what the Hessian is like, at one pose."""
    from cairn.operators import scoring

    found = newton.Evaluation.of(scoring.total_derivatives(W.scan(spark, sf), map_grid(spark, sf), W.POSE, RES).first())
    steps = {"svd": newton.solve_svd(found.hessian, found.gradient), "damped": newton.solve_damped(found.hessian, found.gradient, -1.0), "cholesky": newton.solve_cholesky(found.hessian, found.gradient), "ascent": newton.ascent_step(found.hessian, found.gradient)}
    shape = (newton.is_positive_definite(found.hessian), newton.is_negative_definite(found.hessian), newton.condition_number(found.hessian))
    rows = [(k, *([None] * 6 if v is None else map(float, v)), *shape) for k, v in steps.items()]
    return spark.createDataFrame(rows, "solver string, " + ", ".join(f"d{c} double" for c in alignment.POSE) + ", positive boolean, negative boolean, condition double")


@query("opt4_backtracking", aligned_sql(ONE_SCAN, start_rows([START]), newton.Settings(search="backtracking")))
def opt4(spark, sf):
    return searched(spark, sf, "backtracking")
