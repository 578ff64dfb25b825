"""Queries on logs, trajectories, clocks and streams, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import views as W
from cairn.operators import evaluate as E
from cairn.operators import filters, timeline
from cairn.queries_space import R, r, rounded, rs
from cairn.sources import logs
from cairn.streaming import poses as P
from cairn.streaming import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Ten minutes in ns: events are minutes apart. Slices of time by which joins without a key are dealt.
TOLERANCE = 600_000_000_000
SLICE = 6 * 3_600_000_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- statistics ----------------------------------------------------------------------------------------

STATS = ["mean", "max", "min", "std"]


@query("agg13_sample_stats", W.with_views("ev log", f"SELECT mode, {R('avg(exe_time_ms)')} AS mean, {R('max(exe_time_ms)')} AS max, {R('min(exe_time_ms)')} AS min, {R('stddev_pop(exe_time_ms)')} AS std, count(exe_time_ms) AS count FROM log GROUP BY mode"))
def agg13(spark, sf):
    return rounded(W.log(spark, sf).groupBy("mode").agg(*E.basic_stats("exe_time_ms")), STATS)


@query(
    "agg14_mode_stats",
    W.with_views(
        "ev log",
        f"SELECT mode, n, {R('mean')} AS mean, {R('median')} AS median, {R('std')} AS std, {R('min')} AS min, {R('max')} AS max, {R('s[CAST(floor(n*0.95) AS BIGINT)+1]')} AS p95, {R('s[CAST(floor(n*0.99) AS BIGINT)+1]')} AS p99, {R('pct')} AS converged_pct FROM (SELECT mode, count(*) AS n, avg(exe_time_ms) AS mean, median(exe_time_ms) AS median, coalesce(stddev_samp(exe_time_ms), 0.0) AS std, min(exe_time_ms) AS min, max(exe_time_ms) AS max, list(exe_time_ms ORDER BY exe_time_ms) AS s, avg(CAST(converged AS INTEGER))*100 AS pct FROM log GROUP BY mode)",
    ),
)
def agg14(spark, sf):
    return rounded(E.profile_stats_index(W.log(spark, sf), "exe_time_ms", ["mode"]), ["mean", "median", "std", "min", "max", "p95", "p99", "converged_pct"])


@query("agg15_perf_stats", W.with_views("ev log", f"SELECT mode, count(*) AS n, {R('avg(exe_time_ms)')} AS mean, {R('stddev_pop(exe_time_ms)')} AS std, {R('median(exe_time_ms)')} AS median, {R('quantile_cont(exe_time_ms, 0.95)')} AS p95, {R('quantile_cont(exe_time_ms, 0.99)')} AS p99, {R('1000/avg(exe_time_ms)')} AS throughput, {R('avg(CASE WHEN total_iterations > 0 THEN exe_time_ms/total_iterations END)')} AS ms_per_iteration FROM log GROUP BY mode"))
def agg15(spark, sf):
    return rounded(E.profile_stats_linear(W.log(spark, sf), "exe_time_ms", "total_iterations", ["mode"]), ["mean", "std", "median", "p95", "p99", "throughput", "ms_per_iteration"])


@query("agg16_by_iterations", W.with_views("ev log", f"SELECT total_iterations, count(*) AS n, {R('avg(exe_time_ms)')} AS mean, {R('stddev_pop(exe_time_ms)')} AS std, {R('min(exe_time_ms)')} AS min, {R('max(exe_time_ms)')} AS max FROM log GROUP BY total_iterations"))
def agg16(spark, sf):
    return rounded(E.by_iterations(W.log(spark, sf), "exe_time_ms", "total_iterations"), ["mean", "std", "min", "max"])


@query("agg17_warm_up", W.with_views("ev log", f"SELECT mode, {R('avg(exe_time_ms) FILTER (p <= 10)')} AS warm_up_mean, {R('avg(exe_time_ms) FILTER (p > 10)')} AS steady_mean FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY seq) AS p FROM log) GROUP BY mode"))
def agg17(spark, sf):
    return rounded(E.warm_up(W.log(spark, sf), "exe_time_ms", ["seq"], ["mode"]), ["warm_up_mean", "steady_mean"])


@query("agg18_overhead", W.with_views("ev log", f"SELECT {R('a')} AS release_mean, {R('b')} AS debug_mean, {R('b-a')} AS overhead_ms, {R('(b-a)/a*100')} AS overhead_pct, {R('b/a')} AS ratio FROM (SELECT avg(exe_time_ms) FILTER (mode = 'view') AS a, avg(exe_time_ms) FILTER (mode = 'error') AS b FROM log)"))
def agg18(spark, sf):
    rows = W.log(spark, sf)
    return rounded(E.overhead(rows.filter("mode = 'view'"), rows.filter("mode = 'error'"), "exe_time_ms"), ["release_mean", "debug_mean", "overhead_ms", "overhead_pct", "ratio"])


@query("agg19_speed_up", W.with_views("ev log", f"SELECT mode, {R('m')} AS mean, {R('b')} AS baseline_mean, {R('b/m')} AS speed_up FROM s, (SELECT m AS b FROM s WHERE mode = 'click')", "s AS (SELECT mode, avg(exe_time_ms) AS m FROM log GROUP BY mode)"))
def agg19(spark, sf):
    stats = W.log(spark, sf).groupBy("mode").agg(F.avg("exe_time_ms").alias("mean"))
    return rounded(E.speed_up(stats, "mode", "mean", "builtin"), ["mean", "baseline_mean", "speed_up"])


def init_entries(spark, sf):
    """Initial-pose records: users with their events' values as particles' times."""
    e = W.events(spark, sf)
    return e.groupBy("user_id").agg(F.sum("value").alias("total"), F.array_sort(F.collect_list("value")).alias("particles"), (F.max("value") > 100).alias("reliable"))


@query("agg20_init_stats", W.with_views("ev", f"SELECT n, {R('mean_total', 4)} AS mean_total, {R('max_total', 4)} AS max_total, {R('reliable_pct')} AS reliable_pct, n_particles, {R('mean_particle')} AS mean_particle, {R('p95_particle')} AS p95_particle FROM (SELECT count(*) AS n, avg(t) AS mean_total, max(t) AS max_total, avg(CAST(m > 100 AS INTEGER))*100 AS reliable_pct FROM u), (SELECT count(value) AS n_particles, avg(value) AS mean_particle, quantile_cont(value, 0.95) AS p95_particle FROM ev)", "u AS (SELECT user_id, sum(value) AS t, max(value) AS m FROM ev GROUP BY user_id)"))
def agg20(spark, sf):
    return rounded(rounded(E.init_stats(init_entries(spark, sf), "total", "particles", "reliable"), ["mean_total", "max_total"], 4), ["reliable_pct", "mean_particle", "p95_particle"])


SIDE = lambda p, k: f"avg(value) FILTER (kind = '{k}') AS {p}_mean, stddev_pop(value) FILTER (kind = '{k}') AS {p}_std, min(value) FILTER (kind = '{k}') AS {p}_min, max(value) FILTER (kind = '{k}') AS {p}_max, median(value) FILTER (kind = '{k}') AS {p}_median, count(value) FILTER (kind = '{k}') AS {p}_n"
SCORE_COLUMNS = [f"{p}_{s}" for p in ("ref", "test") for s in ("mean", "std", "min", "max", "median")]


@query("agg21_score_comparison", W.with_views("ev", f"SELECT {rs(SCORE_COLUMNS)}, ref_n, test_n, {R('test_mean-ref_mean')} AS mean_diff, {R('test_mean/ref_mean')} AS mean_ratio FROM (SELECT {SIDE('ref', 'view')}, {SIDE('test', 'click')} FROM ev)"))
def agg21(spark, sf):
    e = W.events(spark, sf)
    return rounded(E.score_comparison(e.filter("kind = 'view'"), e.filter("kind = 'click'"), "value"), [*SCORE_COLUMNS, "mean_diff", "mean_ratio"])


@query("agg22_convergence_rate", W.with_views("ev log", f"SELECT {R('avg(CAST(converged AS INTEGER))*100')} AS convergence_pct, count(*) AS n FROM log"))
def agg22(spark, sf):
    return rounded(E.convergence_rate(W.log(spark, sf)), ["convergence_pct"])


@query("agg23_fil12_clock_offsets", W.with_views("ev", f"SELECT kind, {R('m')} AS mean_offset, {R('a')} AS min_offset, {R('b')} AS max_offset, CASE WHEN abs(m) > 365.25*86400 THEN 'wrong epoch' WHEN abs(m) > 86400 THEN 'large offset' WHEN abs(m) > 1 THEN 'drift' ELSE 'ok' END AS class FROM (SELECT kind, avg(o) AS m, min(o) AS a, max(o) AS b FROM (SELECT kind, (CAST(k AS BIGINT) * 40000000) / 1e9 AS o FROM ev) GROUP BY kind)"))
def agg23(spark, sf):
    rows = W.events(spark, sf).withColumn("wall_ns", F.col("t_ns") + F.col("k").cast("long") * 40_000_000)
    found = E.clock_offsets(rows, "wall_ns", "t_ns", "kind").withColumn("class", filters.offset_class())
    return rounded(found, ["mean_offset", "min_offset", "max_offset"])


@query("agg25_weighted_covariance", W.with_views("points", f"SELECT cloud_id, {R('mean_x')} AS mean_x, {R('mean_y')} AS mean_y, {R('sum(w*(x-mean_x)*(x-mean_x))')} AS cxx, {R('sum(w*(x-mean_x)*(y-mean_y))')} AS cxy, {R('sum(w*(y-mean_y)*(y-mean_y))')} AS cyy FROM w JOIN m USING (cloud_id) GROUP BY cloud_id, mean_x, mean_y", "w AS (SELECT *, 1.0/count(*) OVER (PARTITION BY cloud_id) AS w FROM points)", "m AS (SELECT cloud_id, sum(w*x) AS mean_x, sum(w*y) AS mean_y FROM w GROUP BY cloud_id)"))
def agg25(spark, sf):
    from pyspark.sql import Window

    rows = W.points(spark, sf).withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("cloud_id")))
    return rounded(E.weighted_covariance(rows, "x", "y", "w", ["cloud_id"]), ["mean_x", "mean_y", "cxx", "cxy", "cyy"])


@query("agg26_sample_covariance", W.with_views("points", f"SELECT cloud_id, count(*) AS n, {R('coalesce(covar_samp(x,x), 1.0)')} AS cxx, {R('coalesce(covar_samp(x,y), 0.0)')} AS cxy, {R('coalesce(covar_samp(y,y), 1.0)')} AS cyy FROM points GROUP BY cloud_id"))
def agg26(spark, sf):
    return rounded(E.sample_covariance(W.points(spark, sf), "x", "y", ["cloud_id"]), ["cxx", "cxy", "cyy"])


@query("agg27_softmax", W.with_views("points", f"SELECT point_id, cloud_id, {R('exp((x-max(x) OVER (PARTITION BY cloud_id))/0.1) / sum(e) OVER (PARTITION BY cloud_id)')} AS weight FROM (SELECT *, exp((x - max(x) OVER (PARTITION BY cloud_id))/0.1) AS e FROM points)"))
def agg27(spark, sf):
    return rounded(E.softmax(W.points(spark, sf), "x", 0.1, ["cloud_id"]), ["weight"]).select("point_id", "cloud_id", "weight")


@query("agg28_log_sum_exp", W.with_views("points", f"SELECT cloud_id, {R('max(m) + ln(sum(exp(x-m)))')} AS lse FROM (SELECT *, max(x) OVER (PARTITION BY cloud_id) AS m FROM points) GROUP BY cloud_id"))
def agg28(spark, sf):
    return rounded(E.log_sum_exp(W.points(spark, sf), "x", ["cloud_id"]), ["lse"])


@query("agg29_best_particle", W.with_views("ev", "SELECT user_id, arg_max(seq, (k, seq)) AS seq, max(k) AS k FROM ev GROUP BY user_id"))
def agg29(spark, sf):
    return E.best_by(W.events(spark, sf).select("user_id", "seq", "k"), "k", "seq", ["user_id"])


# --- flags ---------------------------------------------------------------------------------------------


@query("fil9_positive_times", W.with_views("ev log", "SELECT seq FROM log WHERE exe_time_ms > 0"))
def fil9(spark, sf):
    return W.log(spark, sf).filter("exe_time_ms > 0").select("seq")


@query("fil10_quality_flags", W.with_views("ev log", "SELECT seq, concat_ws(',', CASE WHEN total_iterations > 15 THEN 'high_iter' END, CASE WHEN exe_time_ms < 2.5 THEN 'low_nvtl' END, CASE WHEN seq < 7000 THEN 'low_corr' END) AS flags FROM log"))
def fil10(spark, sf):
    return W.log(spark, sf).select("seq", F.concat_ws(",", filters.quality_flags("total_iterations", "exe_time_ms", "seq")).alias("flags"))


@query("fil11_summary_flags", W.with_views("ev log", "SELECT mode, concat_ws(',', CASE WHEN avg(exe_time_ms)/100 > 0.1 THEN 'large pose difference' END, CASE WHEN avg(total_iterations) > 10 THEN 'many iterations' END, CASE WHEN min(exe_time_ms) < 1.5 THEN 'low NVTL' END) AS flags FROM log GROUP BY mode"))
def fil11(spark, sf):
    stats = W.log(spark, sf).groupBy("mode").agg((F.avg("exe_time_ms") / 100).alias("mean_pose_diff"), F.avg("total_iterations").alias("mean_iterations"), F.min("exe_time_ms").alias("mean_nvtl"))
    return stats.select("mode", F.concat_ws(",", filters.summary_flags()).alias("flags"))


# --- joins in time ---------------------------------------------------------------------------------------

TRAJ = ("ev", W.trajectory_sql("ref", "view"), W.trajectory_sql("test", "click"))


def in_time(body: str, *more: str) -> str:
    return W.with_views("ev", body, TRAJ[1], TRAJ[2], *more)


def two(spark, sf):
    return W.trajectory(spark, sf, "view"), W.trajectory(spark, sf, "click")


@query("joi7_exact_time", W.with_views("ev", f"SELECT t_hour, a.seq AS a_seq, b.seq AS b_seq, {R('abs(a.value-b.value)')} AS gap FROM a JOIN b USING (t_hour)", "h AS (SELECT *, t_ns // 3600000000000 AS t_hour FROM ev)", "a AS (SELECT t_hour, max(seq) AS seq, arg_max(value, seq) AS value FROM h WHERE kind = 'view' GROUP BY t_hour)", "b AS (SELECT t_hour, max(seq) AS seq, arg_max(value, seq) AS value FROM h WHERE kind = 'click' GROUP BY t_hour)"))
def joi7(spark, sf):
    rows = W.events(spark, sf).withColumn("t_hour", F.floor(F.col("t_ns") / 3_600_000_000_000)).select("t_hour", "seq", "value", "kind")
    side = lambda k: rows.filter(F.col("kind") == k).drop("kind")
    met = timeline.exact_pairs(side("view"), side("click"), "t_hour")
    return met.select("t_hour", "a_seq", "b_seq", r(F.abs(F.col("a_value") - F.col("b_value"))).alias("gap"))


NEAREST = "SELECT seq, match_seq, gap FROM (SELECT t.seq, r.seq AS match_seq, abs(r.t_ns - t.t_ns) AS gap, row_number() OVER (PARTITION BY t.seq ORDER BY abs(r.t_ns - t.t_ns), r.t_ns, r.seq DESC) AS n FROM test t JOIN ref r ON abs(r.t_ns - t.t_ns) {op} {tol}) WHERE n = 1"


@query("joi8_nearest_inclusive", in_time(NEAREST.format(op="<=", tol=TOLERANCE)))
def joi8(spark, sf):
    ref, test = two(spark, sf)
    met = timeline.nearest(test.select("seq", "t_ns"), ref.select("t_ns", "seq"), "t_ns", ["seq"], TOLERANCE, slice_ns=SLICE)
    return met.select("seq", "match_seq", F.abs(F.col("match_t") - F.col("t_ns")).alias("gap"))


@query("joi9_nearest_exclusive", in_time(NEAREST.format(op="<", tol=60_000_000_000)))
def joi9(spark, sf):
    ref, test = two(spark, sf)
    met = timeline.nearest(test.select("seq", "t_ns"), ref.select("t_ns", "seq"), "t_ns", ["seq"], 60_000_000_000, closed=False, slice_ns=SLICE)
    return met.select("seq", "match_seq", F.abs(F.col("match_t") - F.col("t_ns")).alias("gap"))


BRACKETS = (
    "br AS (SELECT t.seq, t.t_ns, (SELECT max(r.t_ns) FROM ref r WHERE r.t_ns <= t.t_ns) AS pt, (SELECT min(r.t_ns) FROM ref r WHERE r.t_ns > t.t_ns) AS nt FROM test t)",
    "one AS (SELECT t_ns, max(seq) AS seq, arg_max(x, seq) AS x, arg_max(y, seq) AS y, arg_max(z, seq) AS z FROM ref GROUP BY t_ns)",
    "bp AS (SELECT b.seq, b.t_ns, p.t_ns AS pt, coalesce(n.t_ns, p.t_ns) AS nt, p.x AS px, p.y AS py, p.z AS pz, coalesce(n.x, p.x) AS nx, coalesce(n.y, p.y) AS ny, coalesce(n.z, p.z) AS nz FROM br b JOIN one p ON p.t_ns = b.pt LEFT JOIN one n ON n.t_ns = b.nt)",
    f"ok AS (SELECT *, CASE WHEN nt > pt THEN CAST(t_ns - pt AS DOUBLE) / (nt - pt) ELSE 0.0 END AS f FROM bp WHERE t_ns - pt < {TOLERANCE} AND nt - t_ns < {TOLERANCE} AND abs(nt - t_ns) < {TOLERANCE} AND sqrt((px-nx)*(px-nx) + (py-ny)*(py-ny) + (pz-nz)*(pz-nz)) < 60)",
)


@query("joi10_interpolated_pose", in_time(f"SELECT seq, {R('px + f*(nx-px)')} AS x, {R('py + f*(ny-py)')} AS y, {R('pz + f*(nz-pz)')} AS z FROM ok", *BRACKETS))
def joi10(spark, sf):
    ref, test = two(spark, sf)
    found = timeline.interpolated(test.select("seq", "t_ns"), ref, timeout_ns=TOLERANCE, jump=60.0, slice_ns=SLICE, turned=False)
    return rounded(found, ["x", "y", "z"]).select("seq", "x", "y", "z")


ARC = (
    BRACKETS[0],
    "one AS (SELECT t_ns, max(seq) AS seq, arg_max(x, seq) AS x, arg_max(y, seq) AS y, arg_max(z, seq) AS z, arg_max(qz, seq) AS qz, arg_max(qw, seq) AS qw FROM ref GROUP BY t_ns)",
    BRACKETS[2].replace("p.x AS px", "p.qz AS az, p.qw AS aw, coalesce(n.qz, p.qz) AS bz, coalesce(n.qw, p.qw) AS bw, p.x AS px"),
    BRACKETS[3],
    "arc AS (SELECT *, az*bz + aw*bw AS c, acos(least(abs(az*bz + aw*bw), 1.0)) AS angle FROM ok)",
    "wt AS (SELECT *, CASE WHEN abs(c) > 0.9995 THEN 1 - f ELSE sin((1 - f)*angle)/sin(angle) END AS wa, CASE WHEN c < 0 THEN -1 ELSE 1 END * CASE WHEN abs(c) > 0.9995 THEN f ELSE sin(f*angle)/sin(angle) END AS wb FROM arc)",
    "mixed AS (SELECT *, wa*az + wb*bz AS uz, wa*aw + wb*bw AS uw FROM wt)",
)


@query("joi10_interpolated_orientation", in_time(f"SELECT seq, {R('px + f*(nx-px)')} AS x, 0.0 AS qx, {R('uz/sqrt(uz*uz+uw*uw)')} AS qz, {R('uw/sqrt(uz*uz+uw*uw)')} AS qw FROM mixed", *ARC))
def joi10q(spark, sf):
    ref, test = two(spark, sf)
    found = timeline.interpolated(test.select("seq", "t_ns"), ref, timeout_ns=TOLERANCE, jump=60.0, slice_ns=SLICE)
    return rounded(found, ["x", "qx", "qz", "qw"]).select("seq", "x", "qx", "qz", "qw")


WAYS = (("view", "map"), ("map", "click"), ("/view", "click"), ("map", "/map"), ("view", "moon"))


@query(
    "joi11_transform_lookup",
    in_time(
        f"SELECT query_id, way, CASE way WHEN 'same' THEN FALSE WHEN 'direct' THEN v_stale WHEN 'inverse' THEN c_stale WHEN 'common' THEN v_stale OR c_stale END AS is_stale, {R('CAST(ox AS DOUBLE)')} AS x, {R('CAST(oy AS DOUBLE)')} AS y, {R('CAST(oz AS DOUBLE)')} AS z, {R('CAST(oqz AS DOUBLE)')} AS qz, {R('CAST(oqw AS DOUBLE)')} AS qw FROM o",
        "asked AS (SELECT seq AS query_id, seq % 5 AS w, CASE WHEN k % 5 = 0 THEN NULL ELSE t_ns END AS t FROM ev WHERE kind = 'purchase')",
        *[
            f"near_{n} AS (SELECT * FROM (SELECT a.query_id, r.t_ns AS s, r.x, r.y, r.z, r.qz, r.qw, row_number() OVER (PARTITION BY a.query_id ORDER BY CASE WHEN a.t IS NULL THEN -r.t_ns ELSE abs(r.t_ns - a.t) END, r.t_ns, r.x) AS nth FROM asked a, {n} r) WHERE nth = 1)"
            for n in ("ref", "test")
        ],
        "m AS (SELECT a.*, v.x AS vx, v.y AS vy, v.z AS vz, v.qz AS vqz, v.qw AS vqw, c.x AS cx, c.y AS cy, c.z AS cz, c.qz AS cqz, c.qw AS cqw, t IS NOT NULL AND abs(v.s - t) > 10000000000 AS v_stale, t IS NOT NULL AND abs(c.s - t) > 10000000000 AS c_stale, CASE w WHEN 0 THEN 'direct' WHEN 1 THEN 'inverse' WHEN 2 THEN 'common' WHEN 3 THEN 'same' END AS way, c.qw*c.qw - c.qz*c.qz AS co, 2*c.qw*c.qz AS si FROM asked a JOIN near_ref v USING (query_id) JOIN near_test c USING (query_id))",
        "o AS (SELECT *, CASE way WHEN 'same' THEN 0 WHEN 'direct' THEN vx WHEN 'inverse' THEN -(co*cx + si*cy) WHEN 'common' THEN co*(vx-cx) + si*(vy-cy) END AS ox, CASE way WHEN 'same' THEN 0 WHEN 'direct' THEN vy WHEN 'inverse' THEN si*cx - co*cy WHEN 'common' THEN -si*(vx-cx) + co*(vy-cy) END AS oy, CASE way WHEN 'same' THEN 0 WHEN 'direct' THEN vz WHEN 'inverse' THEN -cz WHEN 'common' THEN vz-cz END AS oz, CASE way WHEN 'same' THEN 0 WHEN 'direct' THEN vqz WHEN 'inverse' THEN -cqz WHEN 'common' THEN cqw*vqz - cqz*vqw END AS oqz, CASE way WHEN 'same' THEN 1 WHEN 'direct' THEN vqw WHEN 'inverse' THEN cqw WHEN 'common' THEN cqw*vqw + cqz*vqz END AS oqw FROM m)",
    ),
)
def joi11(spark, sf):
    """Each purchase asks for a transform at its time (or the latest) between frames that views and clicks move in the map."""
    edge = lambda name: W.trajectory(spark, sf, name).select(F.lit("map").alias("parent"), F.lit(name).alias("child"), F.col("t_ns").alias("stamp_ns"), F.lit(False).alias("is_static"), "x", "y", "z", "qx", "qy", "qz", "qw")
    way = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t in WAYS])[F.col("seq").cast("int") % 5]
    asked = W.events(spark, sf).filter("kind = 'purchase'").withColumn("way", way)
    asked = asked.select(F.col("seq").alias("query_id"), "way.source", "way.target", F.when(F.col("k") % 5 != 0, F.col("t_ns")).alias("t_ns"))
    found = timeline.transforms(asked, edge("view").union(edge("click")), slice_ns=SLICE)
    return rounded(found, ["x", "y", "z", "qz", "qw"]).select("query_id", "way", "is_stale", "x", "y", "z", "qz", "qw")


@query("joi12_positional", in_time("SELECT place, a.seq AS a_seq, b.seq AS b_seq FROM (SELECT seq, row_number() OVER (ORDER BY t_ns, seq) - 1 AS place FROM ref) a JOIN (SELECT seq, row_number() OVER (ORDER BY t_ns, seq) - 1 AS place FROM test) b USING (place)"))
def joi12(spark, sf):
    ref, test = two(spark, sf)
    return timeline.positional(ref.select("seq", "t_ns"), test.select("seq", "t_ns"), ["t_ns", "seq"]).select("place", "a_seq", "b_seq")


@query("joi13_iteration_zip", W.with_views("ev", "SELECT user_id, place, a.seq AS a_seq, b.seq AS b_seq FROM (SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS place FROM ev WHERE kind = 'view') a FULL JOIN (SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS place FROM ev WHERE kind = 'click') b USING (user_id, place)"))
def joi13(spark, sf):
    e = W.events(spark, sf).select("user_id", "seq", "kind")
    side = lambda k: e.filter(F.col("kind") == k).drop("kind")
    return timeline.positional(side("view"), side("click"), ["seq"], ["user_id"], "full")


CLOCK = (
    "rp AS (SELECT t_ns, t_ns + k * 1000000 AS stamp_ns FROM ev WHERE kind = 'view')",
    "q AS (SELECT seq, t_ns FROM ev WHERE kind = 'click')",
    "b AS (SELECT q.*, (SELECT max(t_ns) FROM rp WHERE rp.t_ns <= q.t_ns) AS pt, (SELECT min(t_ns) FROM rp WHERE rp.t_ns > q.t_ns) AS nt FROM q)",
    "c AS (SELECT b.*, p.stamp_ns AS ps, n.stamp_ns AS ns FROM b LEFT JOIN rp p ON p.t_ns = b.pt LEFT JOIN rp n ON n.t_ns = b.nt)",
)


@query("joi16_clock_remap", W.with_views("ev", "SELECT seq, CASE WHEN pt IS NULL THEN t_ns + ns - nt WHEN nt IS NULL OR pt = t_ns THEN t_ns + ps - pt ELSE CAST(trunc(ps + (CAST(t_ns - pt AS DOUBLE) / CAST(nt - pt AS DOUBLE)) * (ns - ps)) AS BIGINT) END // 1000000 AS remapped_ms FROM c", *CLOCK))
def joi16(spark, sf):
    e = W.events(spark, sf)
    reference = e.filter("kind = 'view'").select("t_ns", (F.col("t_ns") + F.col("k").cast("long") * 1_000_000).alias("stamp_ns"))
    found = timeline.remapped_clock(e.filter("kind = 'click'").select("seq", "t_ns"), reference, slice_ns=SLICE)
    return found.select("seq", F.expr("remapped_ns div 1000000").alias("remapped_ms"))


# --- windows -----------------------------------------------------------------------------------------------

USERS = "WINDOW w AS (PARTITION BY user_id ORDER BY seq)"


@query("win1_max_jump", W.with_views("ev", f"SELECT user_id, {R('coalesce(max(abs(value - p)), 0.0)')} AS max_jump FROM (SELECT user_id, value, lag(value) OVER w AS p FROM ev {USERS}) GROUP BY user_id"))
def win1(spark, sf):
    return rounded(E.max_jump(W.events(spark, sf), ["value"], ["user_id"], ["seq"]), ["max_jump"])


@query("win2_frame_deltas", W.with_views("ev", f"SELECT seq, {R('d')} AS delta, CASE WHEN d < 0.01 THEN 'yes' WHEN d < 0.1 THEN 'close' WHEN d IS NOT NULL THEN 'no' END AS follows FROM (SELECT seq, sqrt((value - lag(value) OVER w)*(value - lag(value) OVER w) + (k - lag(k) OVER w)*(k - lag(k) OVER w)) AS d FROM ev {USERS})"))
def win2(spark, sf):
    found = E.frame_deltas(W.events(spark, sf), ("value", "k"), ("value", "k"), ["user_id"], ["seq"])
    return rounded(found, ["delta"]).select("seq", "delta", "follows")


OSC = W.with_views(
    "ev",
    "SELECT user_id, CAST(coalesce(max(n), 0) AS BIGINT) AS oscillations, coalesce(max(n), 0) > 2 AS oscillating FROM (SELECT DISTINCT user_id FROM ev) LEFT JOIN runs USING (user_id) GROUP BY user_id",
    f"d AS (SELECT user_id, seq, value - lag(value) OVER w AS dx, k - lag(k) OVER w AS dy FROM ev {USERS})",
    f"b AS (SELECT *, lag(dx) OVER w AS bx, lag(dy) OVER w AS by_ FROM d {USERS})",
    "t AS (SELECT *, coalesce(CASE WHEN sqrt(dx*dx+dy*dy) < 1e-10 OR sqrt(bx*bx+by_*by_) < 1e-10 THEN false ELSE (dx*bx+dy*by_)/(sqrt(dx*dx+dy*dy)*sqrt(bx*bx+by_*by_)) < -0.9 END, false) AS turn FROM b)",
    f"i AS (SELECT *, sum(CASE WHEN turn THEN 0 ELSE 1 END) OVER w AS island FROM t {USERS})",
    "runs AS (SELECT user_id, island, count(*) AS n FROM i WHERE turn GROUP BY 1, 2)",
)


@query("win3_oscillation", OSC)
def win3(spark, sf):
    return E.oscillation(W.events(spark, sf), ("value", "k"), ["user_id"], ["seq"], most=2)


@query("win4_first_divergence", W.with_views("ev", "SELECT user_id, min(seq) FILTER (value > 100) AS first_place FROM ev GROUP BY user_id"))
def win4(spark, sf):
    return E.first_divergence(W.events(spark, sf), "value", "seq", ["user_id"], 100.0)


@query("win4_crossings", W.with_views("ev", f"SELECT seq FROM (SELECT seq, value, lag(value) OVER w AS p FROM ev {USERS}) WHERE p <= 50 AND value > 50"))
def win4c(spark, sf):
    return E.crossings(W.events(spark, sf), "value", ["user_id"], ["seq"], 50.0).select("seq")


@query("win4_milestones", W.with_views("ev", "SELECT user_id, CAST(level AS DOUBLE) AS level, min(seq) AS first_place FROM ev, (VALUES (0.1), (0.2), (0.5), (1.0), (2.0), (5.0), (10.0)) l(level) WHERE value > level GROUP BY user_id, level"))
def win4m(spark, sf):
    return E.milestones(W.events(spark, sf), "value", "seq", ["user_id"])


@query("win5_running_best", W.with_views("ev", f"SELECT seq, {R('max(value) OVER w')} AS best_so_far FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"))
def win5(spark, sf):
    return rounded(E.running_best(W.events(spark, sf), "value", ["user_id"], ["seq"]), ["best_so_far"]).select("seq", "best_so_far")


@query("win6_skip_counter", W.with_views("ev", "SELECT seq, CAST(sum(CASE WHEN k < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS skips FROM (SELECT *, sum(CASE WHEN k < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM ev)"))
def win6(spark, sf):
    rows = W.events(spark, sf).withColumn("ok", F.col("k") < 50)
    return E.skip_counter(rows, "ok", ["user_id"], ["seq"]).select("seq", "skips")


@query("win7_reversals", W.with_views("ev", "SELECT user_id, CAST(count(*) FILTER (k % 2 = 1) AS INTEGER) AS reversals FROM ev GROUP BY user_id"))
def win7(spark, sf):
    rows = W.events(spark, sf).groupBy("user_id").agg(F.collect_list(F.struct((F.col("k") % 2 == 1).alias("direction_reversed"))).alias("iterations"))
    return rows.select("user_id", E.reversals("iterations").alias("reversals"))


@query("win8_monotonic_clock", W.with_views("ev", "SELECT seq FROM (SELECT seq, k, max(k) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ev) WHERE p IS NULL OR k > p"))
def win8(spark, sf):
    return E.monotonic(W.events(spark, sf), "k", ["user_id"], ["seq"]).select("seq")


# --- order, trajectories -------------------------------------------------------------------------------------


@query("srt2_top_differences", W.with_views("ev", f"SELECT seq, {R('value')} AS value FROM ev ORDER BY ev.value DESC, seq LIMIT 10"))
def srt2(spark, sf):
    return rounded(W.events(spark, sf).select("seq", "value").orderBy(F.col("value").desc(), "seq").limit(10), ["value"])


@query("srt4_first_pose", W.with_views("ev", "SELECT kind, arg_min(seq, (t_ns, seq)) AS seq, min(t_ns) AS t_ns FROM ev GROUP BY kind"))
def srt4(spark, sf):
    return W.events(spark, sf).groupBy("kind").agg(F.min(F.struct("t_ns", "seq")).alias("first")).select("kind", "first.seq", "first.t_ns")


@query("srt5_batch_order", W.with_views("ev", f"SELECT seq, {R('value + 5')} AS latency_ms FROM ev WHERE kind = 'view'"))
def srt5(spark, sf):
    e = W.events(spark, sf).filter("kind = 'view'")
    scans = e.select(F.lit("a").alias("source"), F.col("seq").alias("scan_id"), F.col("t_ns").alias("stamp_ms"), F.lit(0.0).alias("arrival_ms"))
    results = e.select(F.lit("a").alias("source"), F.col("seq").alias("scan_id"), (F.col("value") + 5).alias("done_ms"))
    return P.process_batch(scans, results).select(F.col("scan_id").alias("seq"), r("latency_ms").alias("latency_ms"))


@query("srt6_ranked_trials", W.with_views("ev", "SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, seq) AS place FROM ev"))
def srt6(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("k").desc(), "seq"))
    return W.events(spark, sf).select("user_id", "seq", place.cast("long").alias("place"))


@query("set2_common_times", W.with_views("ev", "SELECT user_id, k FROM ev WHERE kind = 'view' INTERSECT SELECT user_id, k FROM ev WHERE kind = 'click'"))
def set2(spark, sf):
    e = W.events(spark, sf)
    return e.filter("kind = 'view'").select("user_id", "k").intersect(e.filter("kind = 'click'").select("user_id", "k"))


MATCHED = "m AS (SELECT t.x AS tx, t.y AS ty, r.x AS rx, r.y AS ry, row_number() OVER (PARTITION BY t.seq ORDER BY abs(r.t_ns - t.t_ns), r.t_ns, r.seq DESC) AS n FROM test t JOIN ref r ON abs(r.t_ns - t.t_ns) <= " + str(TOLERANCE) + ")"


@query("opt20_trajectory_error", in_time(f"SELECT {R('coalesce(sqrt(avg((tx-rx)*(tx-rx)+(ty-ry)*(ty-ry))), 0.0)')} AS rmse, {R('max(sqrt((tx-rx)*(tx-rx)+(ty-ry)*(ty-ry)))')} AS max_error, count(*) AS n FROM m WHERE n = 1", MATCHED))
def opt20(spark, sf):
    ref, test = two(spark, sf)
    met = timeline.nearest(test.select("seq", "t_ns", "x", "y"), ref.select("t_ns", "seq", "x", "y"), "t_ns", ["seq", "x", "y"], TOLERANCE, slice_ns=SLICE)
    return rounded(E.trajectory_error(met, ("x", "y"), ("match_x", "match_y")), ["rmse", "max_error"])


DIFF = lambda n: f"{R(f'avg({n})')} AS {n}_mean, {R(f'stddev_pop({n})')} AS {n}_std, {R(f'min({n})')} AS {n}_min, {R(f'max({n})')} AS {n}_max, {R(f'quantile_cont({n}, 0.95)')} AS {n}_p95"


@query("opt21_difference_summary", W.with_views("ev", f"SELECT {DIFF('d2')}, {DIFF('dk')}, count(*) AS n FROM (SELECT abs(a.value - b.value) AS d2, a.k - b.k AS dk FROM a JOIN b USING (t_hour))", "h AS (SELECT *, t_ns // 3600000000000 AS t_hour FROM ev)", "a AS (SELECT t_hour, arg_max(value, seq) AS value, arg_max(k, seq) AS k FROM h WHERE kind = 'view' GROUP BY t_hour)", "b AS (SELECT t_hour, arg_max(value, seq) AS value, arg_max(k, seq) AS k FROM h WHERE kind = 'click' GROUP BY t_hour)"))
def opt21(spark, sf):
    rows = W.events(spark, sf).withColumn("t_hour", F.floor(F.col("t_ns") / 3_600_000_000_000)).select("t_hour", "seq", "value", "k", "kind")
    side = lambda n: rows.filter(F.col("kind") == n).drop("kind")
    met = timeline.exact_pairs(side("view"), side("click"), "t_hour")
    found = E.difference_summary(met, {"d2": F.abs(F.col("a_value") - F.col("b_value")), "dk": F.col("a_k") - F.col("b_k")})
    names = [f"{n}_{s}" for n in ("d2", "dk") for s in ("mean", "std", "min", "max", "p95")]
    return rounded(found, names)


@query("opt19_convergence_gate", W.with_views("ev log", "SELECT seq, converged AND total_iterations <= 10 AND exe_time_ms >= 2.3 AS accepted FROM log"))
def opt19(spark, sf):
    return W.log(spark, sf).select("seq", E.accepted("converged", "total_iterations", "exe_time_ms", 2.3).alias("accepted"))


@query("opt12_covariances", W.with_views("points", f"SELECT cloud_id, {R('covar_samp(x,x)')} AS multi_xx, {R('covar_pop(x,x)*(count(*)-1)/count(*)')} AS reference_xx, {R('covar_samp(x,y)')} AS multi_xy FROM points GROUP BY cloud_id"))
def opt12(spark, sf):
    rows = W.points(spark, sf)
    plain = E.sample_covariance(rows, "x", "y", ["cloud_id"])
    scaled = E.sample_covariance(rows, "x", "y", ["cloud_id"], reference_scaling=True).select("cloud_id", F.col("cxx").alias("reference_xx"))
    return rounded(plain.join(scaled, "cloud_id").withColumnsRenamed({"cxx": "multi_xx", "cxy": "multi_xy"}), ["multi_xx", "reference_xx", "multi_xy"]).select("cloud_id", "multi_xx", "reference_xx", "multi_xy")


# --- sources and sinks on logs made from the tables -------------------------------------------------------------


def log_lines(spark, sf):
    """Records as JSON lines, with blank, damaged and partial ones."""
    e = W.log(spark, sf)
    whole = F.to_json(F.struct(F.col("t_ns").alias("timestamp_ns"), "exe_time_ms", "total_iterations", F.when(F.col("converged"), "Converged").otherwise("MaxIterations").alias("convergence_status"), F.array(F.col("exe_time_ms"), *[F.lit(0.0)] * 5).alias("final_pose")))
    part = F.to_json(F.struct(F.col("t_ns").alias("timestamp_ns"), F.lit("init").alias("type"), F.col("exe_time_ms").alias("total_time_ms")))
    kind = F.pmod("seq", F.lit(10))
    return e.select(F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("{broken "), F.col("seq").cast("string"))).when(kind == 2, part).otherwise(whole).alias("value"))


@query("src3_tolerant_log", W.with_views("ev log", f"SELECT t_ns AS timestamp_ns, {R('CASE WHEN seq % 10 = 2 THEN 0.0 ELSE exe_time_ms END')} AS exe_time_ms, CAST(CASE WHEN seq % 10 = 2 THEN 0 ELSE total_iterations END AS BIGINT) AS total_iterations, seq % 10 > 2 AND converged AS converged FROM log WHERE seq % 10 >= 2"))
def src3(spark, sf):
    return rounded(logs.tolerant(log_lines(spark, sf)), ["exe_time_ms"]).select("timestamp_ns", "exe_time_ms", "total_iterations", "converged")


@query("src4_discriminated_log", W.with_views("ev log", "SELECT 'alignment' AS type, count(*) AS n, CAST(sum(total_iterations) AS BIGINT) AS total FROM log WHERE seq % 10 > 2 UNION ALL SELECT 'init', count(*), NULL FROM log WHERE seq % 10 = 2"))
def src4(spark, sf):
    lines = log_lines(spark, sf)
    own = logs.alignments(lines).agg(F.lit("alignment").alias("type"), F.count(F.lit(1)).alias("n"), F.sum("total_iterations").alias("total"))
    return own.unionByName(logs.init_records(lines).agg(F.lit("init").alias("type"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("total")))


@query("src5_logged_poses", W.with_views("ev log", f"SELECT t_ns AS timestamp_ns, {R('exe_time_ms')} AS x FROM log WHERE seq % 10 > 2"))
def src5(spark, sf):
    return logs.with_poses(log_lines(spark, sf)).select("timestamp_ns", r(F.col("final_pose")[0]).alias("x"))


@query("src6_typed_cells", W.with_views("ev", f"SELECT seq, CASE WHEN k % 4 = 1 THEN {R('k + 0.5')} END AS as_double, CASE WHEN k % 4 = 0 THEN CAST(k AS BIGINT) END AS as_long, CASE WHEN k % 4 = 2 THEN 'x' || k END AS as_text FROM ev"))
def src6(spark, sf):
    k = F.col("k")
    cell = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, (k + 0.5).cast("string")).when(k % 4 == 2, F.concat(F.lit("x"), k.cast("string"))).otherwise("")
    rows = W.events(spark, sf).withColumn("cell", cell)
    return rounded(rows.select("seq", *[e.alias(n) for n, e in logs.typed(F.col("cell")).items()]), ["as_double"])


def board_lines(spark, sf):
    k = F.col("k").cast("string")
    line = F.concat(F.lit("RAM "), k, F.lit("/62000MB CPU ["), k, F.lit("%@1190,off,7%@729] GR3D_FREQ "), k, F.lit("% tj@45.5C VDD_GPU_SOC "), k, F.lit("mW"))
    return W.events(spark, sf).select(F.when(F.col("k") % 5 == 0, "nothing here").otherwise(line).alias("value"))


@query("src7_board_stats", W.with_views("ev", "SELECT CAST(k AS DOUBLE) AS ram_used_mb, CAST(k AS DOUBLE) AS gpu_pct, CAST(45.5 AS DOUBLE) AS temperature_c, count(*) AS n FROM ev WHERE k % 5 <> 0 GROUP BY k"))
def src7(spark, sf):
    return logs.tegrastats(board_lines(spark, sf)).groupBy("ram_used_mb", "gpu_pct", "temperature_c").agg(F.count(F.lit(1)).alias("n"))


@query("src8_core_loads", W.with_views("ev", f"SELECT CAST(k + 7 AS DOUBLE) AS total, 2 AS cores, {R('(k + 7) / 2.0')} AS mean, count(*) AS n FROM ev WHERE k % 5 <> 0 GROUP BY k"))
def src8(spark, sf):
    return rounded(logs.core_loads(board_lines(spark, sf)), ["mean"]).groupBy("total", "cores", "mean").agg(F.count(F.lit(1)).alias("n"))


@query("src10_bag_metadata", W.with_views("ev", f"SELECT min(t_ns) AS start_ns, max(t_ns) AS end_ns, count(*) AS messages, {R('(max(t_ns)-min(t_ns))/1e9', 3)} AS duration_s, string_agg(DISTINCT kind, ',' ORDER BY kind) AS topics FROM ev"))
def src10(spark, sf):
    e = W.events(spark, sf)
    found = logs.bag_metadata(e.select(F.col("kind").alias("topic_id"), F.col("t_ns").alias("timestamp")), e.select(F.col("kind").alias("name")))
    return rounded(found, ["duration_s"], 3).withColumn("topics", F.concat_ws(",", "topics"))


TOPICS = ["view", "click", "error"]


@query("src11_metric_pivot", W.with_views("ev", "SELECT t_ns // 3600000000000 AS hour, " + ", ".join(f"{R(f'arg_max(value, seq) FILTER (kind = {chr(39)}{t}{chr(39)})')} AS {t}" for t in TOPICS) + " FROM ev GROUP BY 1"))
def src11(spark, sf):
    rows = W.events(spark, sf).withColumn("hour", F.floor(F.col("t_ns") / 3_600_000_000_000))
    return rounded(logs.pivoted(rows, "hour", "kind", "value", "seq", TOPICS), TOPICS)


@query("snk6_topics", W.with_views("ev log", "SELECT t_ns AS stamp_ns, 'iterations' AS topic, CAST(total_iterations AS VARCHAR) AS payload FROM log UNION ALL SELECT t_ns, 'converged', CASE WHEN converged THEN 'true' ELSE 'false' END FROM log"))
def snk6(spark, sf):
    return sinks.topics(W.log(spark, sf).withColumnRenamed("t_ns", "stamp_ns"), {"iterations": "total_iterations", "converged": "converged"}).select("stamp_ns", "topic", "payload")


def particles(spark, sf):
    e = W.events(spark, sf)
    return e.select(F.col("user_id").alias("search_id"), F.col("seq").alias("particle_id"), F.col("value").alias("score"), F.col("k").alias("iterations"), *[(F.col("value") * w).alias(n) for n, w in (("x", 1), ("y", 2), ("z", 3), ("ix", 4), ("iy", 5), ("iz", 6))])


@query(
    "snk8_particle_markers",
    W.with_views(
        "ev",
        f"SELECT search_id, particle_id, {R('1 - s')} AS r, {R('s')} AS g, CAST(CASE WHEN particle_id = best THEN 1.0 ELSE 0.7 END AS DOUBLE) AS a FROM n",
        "p AS (SELECT user_id AS search_id, seq AS particle_id, value AS score FROM ev)",
        "n AS (SELECT search_id, particle_id, least(1.0, greatest(0.0, (score - min(score) OVER s) / greatest(max(score) OVER s - min(score) OVER s, 0.001))) AS s, first_value(particle_id) OVER (PARTITION BY search_id ORDER BY score DESC, particle_id DESC) AS best FROM p WINDOW s AS (PARTITION BY search_id))",
    ),
)
def snk8(spark, sf):
    marks = sinks.particle_markers(particles(spark, sf)).filter("namespace = 'result_score'")
    return rounded(marks, ["r", "g"]).select("search_id", "particle_id", "r", "g", "a")


@query("snk9_tf_broadcast", W.with_views("poses", f"SELECT 'map' AS parent, 'ndt_base' AS child, pose_id AS stamp_ns, {R('tx')} AS x, {R('cos(roll/2)*cos(pitch/2)*cos(yaw/2)+sin(roll/2)*sin(pitch/2)*sin(yaw/2)')} AS qw FROM poses"))
def snk9(spark, sf):
    rows = sinks.tf_broadcast(W.poses(spark).withColumnRenamed("pose_id", "stamp_ns"))
    return rounded(rows, ["x", "qw"]).select("parent", "child", "stamp_ns", "x", "qw")


@query("snk7_report_rows", SQL["agg13_sample_stats"])
def snk7(spark, sf):
    return agg13(spark, sf)


# --- streams, in their batch form ------------------------------------------------------------------------------

SESSIONS = (
    "b AS (SELECT user_id, seq, k, CASE WHEN k < lag(k) OVER (PARTITION BY user_id ORDER BY seq) THEN 1 ELSE 0 END AS back FROM ev)",
    "s AS (SELECT *, CAST(sum(back) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM b)",
)


@query("str1_pose_sessions", W.with_views("ev", "SELECT seq, session FROM s", *SESSIONS))
def str1(spark, sf):
    return P.sessions(W.events(spark, sf), ["user_id"], ["seq"], "k").select("seq", "session")


@query("str1_buffer", W.with_views("ev", "SELECT seq FROM (SELECT *, max(session) OVER (PARTITION BY user_id) AS m FROM s) WHERE session = m", *SESSIONS))
def str1b(spark, sf):
    return P.buffered(W.events(spark, sf), ["user_id"], ["seq"], "k").select("seq")


@query("str2_eviction", W.with_views("ev", "SELECT seq FROM (SELECT *, max(CASE WHEN k < 50 THEN k END) OVER (PARTITION BY user_id) AS o FROM ev) WHERE k >= 50 OR k = o"))
def str2(spark, sf):
    return P.evicted(W.events(spark, sf), ["user_id"], 50, "k").select("seq")


@query("str3_validation", W.with_views("ev", f"SELECT seq, coalesce(abs(t_ns - lag(t_ns) OVER w) < {TOLERANCE} AND abs(value - lag(value) OVER w) < 10, false) AS valid FROM ev {USERS}"))
def str3(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("seq")
    rows = W.events(spark, sf).withColumn("p_t", F.lag("t_ns").over(w)).withColumn("p_v", F.lag("value").over(w))
    return rows.select("seq", F.coalesce(P.valid_pair("t_ns", "p_t", "t_ns", ("value",), ("p_v",), TOLERANCE), F.lit(False)).alias("valid"))


@query("str4_ring", W.with_views("ev", "SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY kind, user_id ORDER BY seq DESC) AS n FROM ev) WHERE n <= 5"))
def str4(spark, sf):
    rows = W.events(spark, sf).select(F.col("kind").alias("parent"), F.col("user_id").alias("child"), "seq", F.lit(False).alias("is_static"))
    return P.ring(rows, 5).select("seq")


def queue_scans(spark, sf):
    e = W.events(spark, sf)
    return e.select(F.col("kind").alias("source"), F.col("seq").alias("scan_id"), (F.col("t_ns") / 1e10).alias("arrival_ms"), (F.col("t_ns") / 1e10 - F.col("value")).alias("stamp_ms"))


QUEUE_SQL = W.with_views(
    "ev",
    f"SELECT m.source, s.batch, m.scan_id, {R('m.a', 4)} AS arrival_ms, {R('x.fired', 4)} AS fired_ms, 'aligned' AS fate FROM starts s JOIN sized x ON x.source = s.source AND x.n = s.n JOIN sized m ON m.source = s.source AND m.n BETWEEN s.n AND s.n + x.size - 1 UNION ALL SELECT kind, NULL, seq, {R('a', 4)}, {R('a', 4)}, 'too old' FROM arrived WHERE a - (a - value) > 100",
    "arrived AS (SELECT kind, seq, value, t_ns / 1e10 AS a FROM ev)",
    "numbered AS (SELECT kind AS source, seq AS scan_id, a, row_number() OVER (PARTITION BY kind ORDER BY a, seq) AS n FROM arrived WHERE NOT a - (a - value) > 100)",
    "led AS (SELECT *, lead(a, 1) OVER w AS l1, lead(a, 2) OVER w AS l2, lead(a, 3) OVER w AS l3 FROM numbered WINDOW w AS (PARTITION BY source ORDER BY n))",
    "sized AS (SELECT *, 1 + coalesce(CAST(l1 - a < 20 AS INTEGER), 0) + coalesce(CAST(l2 - a < 20 AS INTEGER), 0) + coalesce(CAST(l3 - a < 20 AS INTEGER), 0) AS size, CASE WHEN l3 - a < 20 THEN l3 ELSE a + 20 END AS fired FROM led)",
    "starts AS (SELECT source, n, CAST(0 AS BIGINT) AS batch FROM sized WHERE n = 1 UNION ALL SELECT s.source, y.n, s.batch + 1 FROM starts s JOIN sized x ON x.source = s.source AND x.n = s.n JOIN sized y ON y.source = s.source AND y.n = s.n + x.size)",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("str5_scan_queue", QUEUE_SQL)
def str5(spark, sf):
    return rounded(P.queued(queue_scans(spark, sf)), ["arrival_ms", "fired_ms"], 4)


@query("str6_batch_latency", W.with_views("ev", f"SELECT kind AS source, seq AS scan_id, {R('t_ns / 1e10 + k - t_ns / 1e10', 4)} AS latency_ms FROM ev WHERE k IS NOT NULL"))
def str6(spark, sf):
    """Results, done k ms after a scan's arrival, joined to their scans."""
    done = W.events(spark, sf).filter("k IS NOT NULL").select(F.col("kind").alias("source"), F.col("seq").alias("scan_id"), (F.col("t_ns") / 1e10 + F.col("k")).alias("done_ms"))
    return rounded(P.process_batch(queue_scans(spark, sf), done), ["latency_ms"], 4).select("source", "scan_id", "latency_ms")


def positions(spark, sf):
    return W.events(spark, sf).select(F.col("kind").alias("source"), "seq", F.col("value").alias("x"), (F.col("k") * 1.0).alias("y"))


@query(
    "str7_map_refresh",
    W.with_views(
        "ev",
        "SELECT p.source, p.seq, p.x, p.y, a.n IS NOT NULL AS refresh, CAST(count(a.n) OVER (PARTITION BY p.source ORDER BY p.n) AS BIGINT) AS updates FROM p LEFT JOIN asks a ON a.source = p.source AND a.n = p.n",
        "p AS (SELECT kind AS source, seq, value AS x, k * 1.0 AS y, row_number() OVER (PARTITION BY kind ORDER BY seq) AS n FROM ev)",
        "asks AS (SELECT source, n, x, y FROM p WHERE n = 1 UNION ALL SELECT f.source, f.n, f.x, f.y FROM (SELECT a.source, min(p.n) AS n, arg_min(p.x, p.n) AS x, arg_min(p.y, p.n) AS y FROM asks a JOIN p ON p.source = a.source AND p.n > a.n AND (p.x - a.x)*(p.x - a.x) + (p.y - a.y)*(p.y - a.y) > 400 GROUP BY a.source) f)",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def str7(spark, sf):
    return P.refresh_batch(positions(spark, sf))


@query("str8_out_of_range", W.with_views("ev", "SELECT seq, sqrt((value-10)*(value-10) + (k-20)*(k-20)) + 100 > 150 AS out FROM ev"))
def str8(spark, sf):
    from cairn.operators import tiles

    return W.events(spark, sf).select("seq", tiles.out_of_range("value", F.col("k").cast("double"), 10.0, 20.0).alias("out"))


@query("str12_diagnostics", W.with_views("ev log", "SELECT seq, CASE WHEN exe_time_ms > 100 THEN 2 WHEN total_iterations > 15 THEN 1 ELSE 0 END AS level, CASE WHEN total_iterations > 15 AND exe_time_ms > 100 THEN 'many iterations; slow' WHEN total_iterations > 15 THEN 'many iterations' WHEN exe_time_ms > 100 THEN 'slow' ELSE 'OK' END AS message FROM log"))
def str12(spark, sf):
    found = P.diagnostics(W.log(spark, sf).select("seq", "total_iterations", "exe_time_ms"), [("total_iterations > 15", "warn", "many iterations"), ("exe_time_ms > 100", "error", "slow")])
    return found.select("seq", "level", "message")


@query("stream_tumbling", W.with_views("ev", f"SELECT kind, epoch_us(date_trunc('day', make_timestamp(t_ns // 1000))) // 1000000 AS start_s, count(*) AS n, {R('avg(value)')} AS mean FROM ev GROUP BY 1, 2"))
def tumbling(spark, sf):
    rows = W.events(spark, sf).withColumn("ts", F.timestamp_micros(F.floor(F.col("t_ns") / 1000)))
    found = P.windowed(rows, "ts", "1 day", None, "1 day", ["kind"], "value")
    return rounded(found.select("kind", F.unix_seconds("window.start").alias("start_s"), "n", "mean"), ["mean"])


@query("str11_service_toggle", W.with_views("ev", "SELECT seq, CAST(sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM ev QUALIFY kind = 'view'"))
def str11(spark, sf):
    e = W.events(spark, sf)
    return P.toggled(e.filter("kind = 'view'"), e.filter("kind = 'signup'"), ["user_id"], "seq").select("seq", "session")


@query("src13_keep_last", W.with_views("ev", "SELECT kind, seq FROM (SELECT kind, seq, row_number() OVER (PARTITION BY kind ORDER BY seq DESC) AS n FROM ev) WHERE n <= 100"))
def src13(spark, sf):
    return P.keep_last(W.events(spark, sf), ["kind"], "seq", 100).select("kind", "seq")
