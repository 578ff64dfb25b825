"""What the physical plans must look like at any scale."""

import re

import pytest

from cairn import registry

QUERIES = registry.queries()


def plan(spark, data, name):
    return QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["joi1_radius", "joi1_wide_radius", "joi5_cell_neighbours", "joi7_exact_time", "joi8_nearest_inclusive", "joi9_nearest_exclusive", "joi16_clock_remap", "ndt3_point_scores", "ndt15_total_derivatives", "agg24_neighbour_histogram", "srt1_stable_sort", "joi12_positional"])
def test_no_nested_loops(spark, data, name):
    assert not re.search("NestedLoop|Cartesian", plan(spark, data, name))


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("agg1_downsample", {"l_quantity", "l_extendedprice", "l_discount"}),
        ("agg13_sample_stats", {"event_type", "value"}),
        ("win5_running_best", {"event_id", "user_id", "value"}),
        ("voxel_gaussian", {"embedding"}),
    ],
)
def test_scans_read_what_they_need(spark, data, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>(?:\s|$|,)", plan(spark, data, name))
    read = {c for s in schemas for c in re.findall(r"(\w+):", s)}
    assert schemas and read - {"array"} <= columns | {"element"}


def test_filters_reach_the_scan(spark, data):
    found = plan(spark, data, "agg21_score_comparison")
    assert "PushedFilters" in found and "EqualTo(event_type,view)" in found


def test_aggregates_combine_before_the_shuffle(spark, data):
    for name in ("agg2_accumulate", "voxel_gaussian", "ndt15_total_derivatives"):
        assert "partial_" in plan(spark, data, name)


def test_numeric_queries_stay_out_of_python(spark, data):
    for name in ("joi1_radius", "ndt8_pose_scores", "ndt15_total_derivatives", "joi10_interpolated_pose", "win3_oscillation"):
        assert not re.search("Python|Pandas|Arrow", plan(spark, data, name))


def test_limits_per_key_come_before_the_shuffle(spark, data):
    """So that no key's rows all meet in one task."""
    for name in ("src13_keep_last", "agg17_warm_up", "snk5_members", "str4_ring"):
        assert "WindowGroupLimit" in plan(spark, data, name)


def test_no_buffer_holds_a_key(spark, data):
    """Percentiles come from ranks; no aggregate collects a key's values."""
    for name in ("agg14_mode_stats", "agg15_perf_stats", "agg21_score_comparison", "snk4_voxel_json", "snk5_members"):
        assert not re.search(r"percentile\(|collect_list|collect_set", plan(spark, data, name))
