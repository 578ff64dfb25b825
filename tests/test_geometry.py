import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry as G


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def matrices(r, p, y):
    rx = np.array([[1, 0, 0], [0, math.cos(r), -math.sin(r)], [0, math.sin(r), math.cos(r)]])
    ry = np.array([[math.cos(p), 0, math.sin(p)], [0, 1, 0], [-math.sin(p), 0, math.cos(p)]])
    rz = np.array([[math.cos(y), -math.sin(y), 0], [math.sin(y), math.cos(y), 0], [0, 0, 1]])
    return rx, ry, rz


ANGLES = (0.3, -0.7, 1.9)


def test_rotation_orders(spark):
    rx, ry, rz = matrices(*ANGLES)
    assert np.allclose(one(spark, *[e for row in G.rotation(*ANGLES) for e in row]), (rx @ ry @ rz).reshape(-1))
    assert np.allclose(one(spark, *[e for row in G.zyx_matrix(*ANGLES) for e in row]), (rz @ ry @ rx).reshape(-1))


def test_quaternion_round_trip(spark):
    q = one(spark, *G.quaternion(*ANGLES))
    assert np.isclose(np.linalg.norm(q), 1)
    assert np.allclose(one(spark, *G.euler(q)), ANGLES)
    rx, ry, rz = matrices(*ANGLES)
    assert np.allclose(one(spark, *G.q_rotate(q, (1, 2, 3))), rz @ ry @ rx @ [1, 2, 3])


def test_pitch_is_held(spark):
    q = one(spark, *G.quaternion(0.0, math.pi / 2, 0.0))
    assert np.isclose(one(spark, *G.euler(q))[1], math.pi / 2)


def test_compose_and_inverse(spark):
    q = one(spark, *G.quaternion(*ANGLES))
    t, r = G.compose((1, 2, 3), q, *G.inverse((1, 2, 3), q))
    assert np.allclose(one(spark, *t, *r), (0, 0, 0, 0, 0, 0, 1), atol=1e-12)


@pytest.mark.parametrize("t", [0.0, 0.25, 1.0])
def test_slerp_turns_evenly(spark, t):
    a, b = (0, 0, 0, 1), (0, 0, math.sin(0.5), math.cos(0.5))
    assert np.allclose(one(spark, *G.slerp(a, b, t)), (0, 0, math.sin(0.5 * t), math.cos(0.5 * t)), atol=1e-12)
    minus = tuple(-x for x in b)
    assert np.allclose(one(spark, *G.slerp(a, minus, t)), (0, 0, math.sin(0.5 * t), math.cos(0.5 * t)), atol=1e-12)


def test_derivatives_of_the_rotation():
    exact, first, second = G.rotation_terms(*ANGLES)
    h = 1e-6
    for a in range(3):
        step = np.eye(3)[a] * h
        up, *_ = G.rotation_terms(*(np.array(ANGLES) + step))
        down, *_ = G.rotation_terms(*(np.array(ANGLES) - step))
        assert np.allclose((up - down) / (2 * h), first[a], atol=1e-8)
        _, up1, _ = G.rotation_terms(*(np.array(ANGLES) + step))
        _, down1, _ = G.rotation_terms(*(np.array(ANGLES) - step))
        assert np.allclose((up1 - down1) / (2 * h), second[a], atol=1e-8)


@pytest.mark.parametrize(("point", "key"), [((0, 0, 0), (0, 0, 0)), ((3.5, 5.1, 1.9), (1, 2, 0)), ((-3.5, -1.1, -0.1), (-2, -1, -1))])
def test_voxel_keys(spark, point, key):
    assert one(spark, *[G.cell(F.lit(float(c)), 2.0) for c in point]) == key


def test_packed_and_morton_round_trip(spark):
    for key in [(0, 0, 0), (-1, 5, 1048575), (-1048576, 17, -3)]:
        assert one(spark, *G.unpacked_key(G.packed_key([F.lit(k) for k in key]))) == key
    point = (3.2, 100.9, 55.5)
    code = G.morton([F.lit(c) for c in point], (0, 0, 0), 0.5)
    assert one(spark, *G.morton_cells(code)) == (6, 201, 111)
    bits = one(spark, code)[0]
    assert bits == sum((((c >> k) & 1) << (3 * k + s)) for c, s in ((6, 2), (201, 1), (111, 0)) for k in range(21))


def test_angles_and_colours(spark):
    assert np.allclose(one(spark, G.wrap(3.5), G.wrap(-3.5), G.yaw_difference(3.0, -3.0)), (3.5 - 2 * math.pi, 2 * math.pi - 3.5, 2 * math.pi - 6))
    assert np.allclose(one(spark, *G.ramp(0.0)), (0, 0, 1))
    assert np.allclose(one(spark, *G.ramp(0.5)), (0, 1, 0), atol=1e-9)
    assert np.allclose(one(spark, *G.hsv(0.0, 1.0, 1.0)), (1, 0, 0))
    assert np.allclose(one(spark, *G.hsv(240.0, 1.0, 1.0)), (0, 0, 1))
    assert one(spark, G.rgb_packed([F.lit(1.0), F.lit(0.5), F.lit(0.0)]))[0] == (255 << 16) | (127 << 8)
    assert np.allclose(one(spark, *G.progress_colour(F.lit(15), F.lit(30))), (0, 1, 1))
