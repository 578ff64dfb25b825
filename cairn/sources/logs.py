"""Alignment logs, metrics, resource logs and recorded bags."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.operators import voxel as V

ITERATION = (
    "struct<iteration: bigint, pose: array<double>, gradient: array<double>, hessian: array<double>, score: double, nvtl: double, newton_step: array<double>, "
    "newton_step_norm: double, step_direction: array<double>, directional_derivative: double, direction_reversed: boolean, used_line_search: boolean, "
    "line_search_converged: boolean, step_length: double, pose_after: array<double>, num_correspondences: bigint>"
)
ALIGNMENT = (
    "timestamp_ns bigint, exe_time_ms double, initial_pose array<double>, final_pose array<double>, num_source_points bigint, convergence_status string, "
    f"total_iterations bigint, final_score double, final_nvtl double, oscillation_count bigint, num_correspondences bigint, iterations array<{ITERATION}>"
)
INIT = (
    "type string, total_time_ms double, startup_time_ms double, guided_time_ms double, num_particles bigint, num_startup bigint, best_score_trajectory array<double>, "
    "per_particle_time_ms array<double>, final_score double, final_iterations bigint, reliable boolean, final_pose array<double>"
)
#: Defaults of fields that a record lacks.
DEFAULTS = {"timestamp_ns": 0, "exe_time_ms": 0.0, "total_iterations": 0, "final_score": 0.0, "final_nvtl": 0.0, "oscillation_count": 0, "convergence_status": "Unknown"}


def parsed(lines: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """JSON objects of a text column; blank and damaged lines go."""
    whole = f"{schema}, _corrupt string"
    rows = lines.filter(F.trim(line) != "").select(F.from_json(line, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.filter(F.col("r").isNotNull() & F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt")


def tolerant(lines: DataFrame) -> DataFrame:
    """Alignment records with defaults for what is missing, and ``converged``."""
    rows = parsed(lines, ALIGNMENT)
    filled = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})
    return filled.withColumn("converged", F.col("convergence_status") == "Converged")


def alignments(lines: DataFrame) -> DataFrame:
    """Records that have a time and iterations, whatever else the file holds."""
    return parsed(lines, ALIGNMENT).filter(F.col("exe_time_ms").isNotNull() & F.col("total_iterations").isNotNull())


def init_records(lines: DataFrame, kind: str = "init") -> DataFrame:
    return parsed(lines, INIT).filter(F.col("type") == kind)


def with_poses(lines: DataFrame) -> DataFrame:
    """Records that have a stamp and a final pose."""
    return parsed(lines, ALIGNMENT).filter(F.col("timestamp_ns").isNotNull() & F.col("final_pose").isNotNull())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def voxel_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dumped grid: one object with all voxels. Keys come from the means."""
    schema = "resolution double, num_voxels bigint, voxels array<struct<mean: array<double>, cov: array<array<double>>, inv_cov: array<array<double>>, point_count: bigint>>"
    return voxels_of(spark.read.schema(schema).option("multiLine", True).json(path))


def voxels_of(dumps: DataFrame) -> DataFrame:
    rows = dumps.select("resolution", F.explode("voxels").alias("v"))
    at = lambda c, i, j: F.element_at(F.element_at(F.col(f"v.{c}"), i + 1), j + 1)
    axes = "xyz"
    mean = [F.element_at(F.col("v.mean"), k + 1) for k in range(3)]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    return rows.select(
        *[F.floor(m / F.col("resolution")).cast("int").alias(f"v{a}") for a, m in zip(axes, mean, strict=True)],
        F.col("v.point_count").alias("n"),
        *[m.alias(f"m{a}") for a, m in zip(axes, mean, strict=True)],
        *[at("cov", i, j).alias(f"c{axes[i]}{axes[j]}") for i, j in pairs],
        *[at("inv_cov", i, j).alias(f"i{axes[i]}{axes[j]}") for i, j in pairs],
    )


def voxel_lines(grid: DataFrame, resolution: float) -> DataFrame:
    """(place, line): the JSON document of a grid, voxels sorted by key, as lines in order: a head, one line for each voxel, an end."""
    full = lambda p: F.array(*[F.array(*[F.col(p + "".join(sorted((a, b)))) for b in "xyz"]) for a in "xyz"])
    voxel = F.struct(F.array("mx", "my", "mz").alias("mean"), full("c").alias("cov"), full("i").alias("inv_cov"), F.col("n").alias("point_count"))
    count = F.lit(1).cast("long")
    rows = V.in_order(grid, count, ["vx", "vy", "vz"], "place", total="__n")
    comma = F.when(F.col("place") < F.col("__n"), ",").otherwise("")
    lines = rows.select("place", F.concat(F.to_json(voxel), comma).alias("line"))
    ends = grid.agg(F.count(F.lit(1)).alias("n"))
    head = ends.select(F.lit(0).cast("long").alias("place"), F.concat(F.lit(f'{{"resolution":{float(resolution)},"num_voxels":'), F.col("n"), F.lit(',"voxels":[')).alias("line"))
    tail = ends.select((F.col("n") + 1).alias("place"), F.lit("]}").alias("line"))
    return head.union(lines).union(tail)


def line_voxels(lines: DataFrame, resolution: float) -> DataFrame:
    """The voxels of a document's lines, each read by itself."""
    voxel = "mean array<double>, cov array<array<double>>, inv_cov array<array<double>>, point_count bigint"
    rows = lines.filter(F.col("line").startswith('{"mean"')).select(F.lit(float(resolution)).alias("resolution"), F.array(F.from_json(F.regexp_replace("line", ",$", ""), voxel)).alias("voxels"))
    return voxels_of(rows)


def dump_voxels(grid: DataFrame, resolution: float, path: str) -> None:
    """Writes the document: files of lines that make it when read in the order of their names."""
    voxel_lines(grid, resolution).repartitionByRange("place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


# --- metrics in text -----------------------------------------------------------------------------

PROCESS = "timestamp string, state string, cpu_percent double, rss_bytes bigint, vms_bytes bigint, num_threads bigint, total_read_rate_bps double, total_write_rate_bps double"
SYSTEM = "timestamp string, cpu_percent double, used_memory_bytes bigint, available_memory_bytes bigint, total_memory_bytes bigint, cpu_count bigint"


def metrics_csv(spark: SparkSession, path: str, schema: str = PROCESS) -> DataFrame:
    """Process or system metrics; empty cells are null."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="", mode="PERMISSIVE")


def typed(cell: Column) -> dict[str, Column]:
    """A cell as a float (with a point), an integer, or a string; empty is null."""
    real, whole = cell.rlike(r"^[+-]?[0-9]*\.[0-9]*([eE][+-]?[0-9]+)?$"), cell.rlike("^[+-]?[0-9]+$")
    some = cell != ""
    return {
        "as_double": F.when(some & real, cell.try_cast("double")),
        "as_long": F.when(some & whole, cell.try_cast("bigint")),
        "as_text": F.when(some & ~real & ~whole, cell),
    }


def tegrastats(lines: DataFrame, line: str = "value") -> DataFrame:
    """Board statistics by pattern; a line with none of them gives no row."""
    number = lambda pattern, k=1: F.when(F.regexp_extract(line, pattern, k) != "", F.regexp_extract(line, pattern, k).cast("double"))
    rows = lines.select(
        number(r"RAM (\d+)/(\d+)MB").alias("ram_used_mb"),
        number(r"RAM (\d+)/(\d+)MB", 2).alias("ram_total_mb"),
        number(r"GR3D_FREQ (\d+)%").alias("gpu_pct"),
        number(r"VDD_GPU_SOC (\d+)mW").alias("gpu_mw"),
        number(r"VIN_SYS_5V0 (\d+)mW").alias("system_mw"),
        number(r"(?i)tj@([0-9.]+)C").alias("temperature_c"),
    )
    return rows.filter(F.coalesce(*rows.columns).isNotNull())


def core_loads(lines: DataFrame, line: str = "value") -> DataFrame:
    """Sum, count and mean of the loads in CPU [12%@1190,off,...]; cores that are off count as none."""
    inside = F.regexp_extract(line, r"CPU \[([^\]]*)\]", 1)
    loads = F.filter(F.transform(F.split(inside, ","), lambda c: F.split(c, "%")[0].try_cast("double")), lambda v: v.isNotNull())
    rows = lines.filter(inside != "").select(loads.alias("loads"))
    total = F.aggregate("loads", F.lit(0.0), lambda a, v: a + v)
    return rows.select(total.alias("total"), F.size("loads").alias("cores"), F.try_divide(total, F.size("loads")).alias("mean"))


def pivoted(metrics: DataFrame, stamp: str, topic: str, value: str, order: str, topics: list[str]) -> DataFrame:
    """A row for each stamp with a column for each topic, its last value."""
    return metrics.groupBy(stamp).pivot(topic, topics).agg(F.max_by(value, order))


# --- recorded bags -------------------------------------------------------------------------------


def bag_metadata(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Duration and topics of a bag (messages: topic_id, timestamp)."""
    span = messages.agg(F.min("timestamp").alias("start_ns"), F.max("timestamp").alias("end_ns"), F.count(F.lit(1)).alias("messages"))
    names = topics.agg(F.array_sort(F.collect_set("name")).alias("topics"))
    return span.crossJoin(names).withColumn("duration_s", (F.col("end_ns") - F.col("start_ns")) / 1e9)


class BagReader(DataSourceReader):
    """Messages of recorded SQLite files, one partition for each file and span of rows."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.topic, self.rows = options.get("topic"), int(options.get("rows", 100_000))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                low, high = db.execute("SELECT min(id), max(id) FROM messages").fetchone()
            out += [InputPartition((path, a, a + self.rows)) for a in range(low or 0, (high or -1) + 1, self.rows)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, low, high = partition.value
        where, values = "m.id >= ? AND m.id < ?", [low, high]
        if self.topic:
            where, values = where + " AND instr(t.name, ?) > 0", [*values, self.topic]
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT t.name, t.type, m.timestamp, m.data FROM messages m JOIN topics t ON t.id = m.topic_id WHERE {where} ORDER BY m.timestamp, m.id", values)


class BagSource(DataSource):
    """``spark.read.format("bag").option("path", "a.db3,b.db3").option("topic", "pose").load()``: topic, type, timestamp, data."""

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return "topic string, type string, timestamp long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return BagReader(self.options)


def cdr_poses(messages: DataFrame) -> DataFrame:
    """Stamped poses from their serialised form (little- or big-endian by the header): stamp_ns, frame, x ... qw, covariance if there."""
    schema = "topic string, timestamp long, stamp_ns long, frame string, x double, y double, z double, qx double, qy double, qz double, qw double, covariance array<double>"

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for topic, timestamp, data in zip(frame["topic"], frame["timestamp"], frame["data"], strict=True):
                end = "<" if data[1] & 1 else ">"
                sec, nano, size = struct.unpack_from(end + "iII", data, 4)
                name = data[16 : 16 + size - 1].decode()
                # numbers of 8 bytes start at multiples of 8 behind the 4 bytes of the header
                at = 4 + -(-(12 + size) // 8) * 8
                pose = struct.unpack_from(end + "7d", data, at)
                rest = len(data) - at - 56
                cov = list(struct.unpack_from(end + "36d", data, at + 56)) if rest >= 288 else None
                rows.append((topic, timestamp, sec * 1_000_000_000 + nano, name, *pose, cov))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return messages.select("topic", "timestamp", "data").mapInPandas(run, schema)
