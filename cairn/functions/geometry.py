"""Column functions for poses, rotations, cells and colours.

A 6-vector pose is (x, y, z, roll, pitch, yaw) and rotates by Rx(roll) Ry(pitch) Rz(yaw) everywhere;
``zyx_matrix`` is the one other convention, under a name of its own. Angles are radians.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TWO_PI = math.pi, 2 * math.pi
Vec = tuple[Column, Column, Column]


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def dot(a, b) -> Column:
    """The sum of products, left to right."""
    terms = [col(x) * col(y) for x, y in zip(a, b, strict=True)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


# --- rotations -----------------------------------------------------------------------------------


def rotation(roll, pitch, yaw) -> list[list[Column]]:
    """The nine entries of Rx(roll) Ry(pitch) Rz(yaw)."""
    sx, cx, sy, cy, sz, cz = (f(col(a)) for a in (roll, pitch, yaw) for f in (F.sin, F.cos))
    return [
        [cy * cz, -cy * sz, sy],
        [cx * sz + sx * sy * cz, cx * cz - sx * sy * sz, -sx * cy],
        [sx * sz - cx * sy * cz, sx * cz + cx * sy * sz, cx * cy],
    ]


def zyx_matrix(roll, pitch, yaw) -> list[list[Column]]:
    """The nine entries of Rz(yaw) Ry(pitch) Rx(roll), the order of logged matrices."""
    sx, cx, sy, cy, sz, cz = (f(col(a)) for a in (roll, pitch, yaw) for f in (F.sin, F.cos))
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def transform(point, pose) -> Vec:
    """R p + t for a point (x, y, z) and a pose of six columns or numbers."""
    turned = rotation(*pose[3:])
    return tuple(dot(row, point) + col(t) for row, t in zip(turned, pose[:3], strict=True))


def matrix4(pose, turn=rotation) -> Column:
    """The row-major 4 x 4 matrix of a pose."""
    rows = turn(*pose[3:])
    flat = [x for row, t in zip(rows, pose[:3], strict=True) for x in (*row, col(t))]
    return F.array(*flat, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def rotation_terms(roll: float, pitch: float, yaw: float, tiny: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """R (3 x 3), its first (3 x 3 x 3) and second derivatives (3 x 3 x 3 x 3) by the three angles, as numbers.

    Constants of a pose: they are worked out once and go into plans as literals. Angles below ``tiny`` count as 0.
    """
    parts = []
    for axis, angle in enumerate((roll, pitch, yaw)):
        s, c = (0.0, 1.0) if abs(angle) < tiny else (math.sin(angle), math.cos(angle))
        i, j = [(1, 2), (2, 0), (0, 1)][axis]
        own = []
        for diagonal, sine, one in ((c, s, 1.0), (-s, c, 0.0), (-c, -s, 0.0)):
            m = np.zeros((3, 3))
            m[axis, axis] = one
            m[i, i] = m[j, j] = diagonal
            m[i, j], m[j, i] = -sine, sine
            own.append(m)
        parts.append(own)

    def product(orders: list[int]) -> np.ndarray:
        return parts[0][orders[0]] @ parts[1][orders[1]] @ parts[2][orders[2]]

    unit = np.eye(3, dtype=int)
    first = np.stack([product(list(unit[a])) for a in range(3)])
    second = np.stack([np.stack([product(list(unit[a] + unit[b])) for b in range(3)]) for a in range(3)])
    return product([0, 0, 0]), first, second


# --- quaternions (x, y, z, w) --------------------------------------------------------------------


def quaternion(roll, pitch, yaw) -> tuple[Column, ...]:
    """The unit quaternion of Rz(yaw) Ry(pitch) Rx(roll), as logs and messages have it."""
    sr, cr, sp, cp, sy, cy = (f(col(a) / 2) for a in (roll, pitch, yaw) for f in (F.sin, F.cos))
    return sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy


def euler(q) -> Vec:
    """(roll, pitch, yaw) of a unit quaternion, pitch held within +- pi/2."""
    x, y, z, w = map(col, q)
    sine = 2 * (w * y - z * x)
    pitch = F.when(F.abs(sine) >= 1, F.signum(sine) * (PI / 2)).otherwise(F.asin(F.least(F.greatest(sine, F.lit(-1.0)), F.lit(1.0))))
    return F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), pitch, F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def q_multiply(a, b) -> tuple[Column, ...]:
    ax, ay, az, aw = map(col, a)
    bx, by, bz, bw = map(col, b)
    return (
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def q_conjugate(q) -> tuple[Column, ...]:
    x, y, z, w = map(col, q)
    return -x, -y, -z, w


def q_rotate(q, v) -> Vec:
    """The vector turned by a unit quaternion: v + 2w (u x v) + 2 u x (u x v)."""
    x, y, z, w = map(col, q)
    a, b, c = map(col, v)
    tx, ty, tz = 2 * (y * c - z * b), 2 * (z * a - x * c), 2 * (x * b - y * a)
    return a + w * tx + (y * tz - z * ty), b + w * ty + (z * tx - x * tz), c + w * tz + (x * ty - y * tx)


def q_angle(a, b) -> Column:
    """The angle between two orientations, 0 to pi."""
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b))))


def slerp(a, b, t) -> tuple[Column, ...]:
    """Spherical interpolation over the shorter arc; linear, then normalised, where the two are nearly parallel."""
    cosine = dot(a, b)
    sign = F.when(cosine < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    close = F.abs(cosine) > 0.9995
    angle = F.acos(F.least(F.abs(cosine), F.lit(1.0)))
    sine = F.when(close, F.lit(1.0)).otherwise(F.sin(angle))
    t = col(t)
    wa = F.when(close, 1 - t).otherwise(F.sin((1 - t) * angle) / sine)
    wb = sign * F.when(close, t).otherwise(F.sin(t * angle) / sine)
    mixed = [wa * col(x) + wb * col(y) for x, y in zip(a, b, strict=True)]
    size = F.sqrt(dot(mixed, mixed))
    return tuple(x / size for x in mixed)


def compose(ta, qa, tb, qb) -> tuple[Vec, tuple[Column, ...]]:
    """The isometry A B."""
    turned = q_rotate(qa, tb)
    return tuple(x + col(t) for x, t in zip(turned, ta, strict=True)), q_multiply(qa, qb)


def inverse(t, q) -> tuple[Vec, tuple[Column, ...]]:
    back = q_conjugate(q)
    return tuple(-x for x in q_rotate(back, t)), back


def relative(ta, qa, tb, qb) -> tuple[Vec, tuple[Column, ...]]:
    """What leads from B to A: A inverse(B)."""
    return compose(ta, qa, *inverse(tb, qb))


# --- angles and distances ------------------------------------------------------------------------


def wrap(angle) -> Column:
    """The angle in [-pi, pi)."""
    return F.pmod(col(angle) + PI, F.lit(TWO_PI)) - PI


def yaw_difference(a, b) -> Column:
    """The unsigned difference of two headings, 0 to pi."""
    return F.abs(wrap(col(a) - col(b)))


def distance(a, b) -> Column:
    """Euclidean distance in as many dimensions as there are columns."""
    gaps = [col(x) - col(y) for x, y in zip(a, b, strict=True)]
    return F.sqrt(dot(gaps, gaps))


# --- cells ---------------------------------------------------------------------------------------

AXIS_BITS = 21
AXIS_BIAS = 1 << (AXIS_BITS - 1)


def cell(coordinate, resolution: float) -> Column:
    """The cell number on one axis: floor(c / resolution)."""
    return F.floor(col(coordinate) / resolution).cast("int")


def with_cells(df, resolution: float, axes=("x", "y", "z"), names=("vx", "vy", "vz")):
    return df.withColumns({n: cell(a, resolution) for a, n in zip(axes, names, strict=True)})


def linear_id(key, low, dims) -> Column:
    """Cell number in a box, x fastest."""
    x, y, z = ((col(k) - col(m)).cast("long") for k, m in zip(key, low, strict=True))
    return x + y * col(dims[0]).cast("long") + z * col(dims[0]).cast("long") * col(dims[1]).cast("long")


def from_linear(number, low, dims) -> tuple[Column, ...]:
    n, dx, dy = col(number), col(dims[0]).cast("long"), col(dims[1]).cast("long")
    x = F.pmod(n, dx)
    y = F.pmod(F.floor((n - x) / dx).cast("long"), dy)
    z = F.floor(n / (dx * dy)).cast("long")
    return tuple((v + col(m)).cast("int") for v, m in zip((x, y, z), low, strict=True))


def packed_key(key) -> Column:
    """Three cell numbers in 63 bits: 21 each, shifted by 2^20 to be non-negative."""
    x, y, z = ((col(k) + AXIS_BIAS).cast("long") for k in key)
    return F.shiftleft(x, 2 * AXIS_BITS).bitwiseOR(F.shiftleft(y, AXIS_BITS)).bitwiseOR(z)


def unpacked_key(number) -> tuple[Column, ...]:
    mask = F.lit((1 << AXIS_BITS) - 1).cast("long")
    return tuple((F.shiftright(col(number), k * AXIS_BITS).bitwiseAND(mask) - AXIS_BIAS).cast("int") for k in (2, 1, 0))


def spread_bits(value) -> Column:
    """21 bits with two zeros between neighbours: halves move apart, by 32 to 2 places."""
    out = col(value).cast("long")
    width, shift = 32, 32
    while shift >= 2:
        # bits stay in blocks of ``width`` that stand 3 x width apart
        block = (1 << max(1, width // 2)) - 1
        step = 3 * max(1, width // 2)
        mask = sum(block << k for k in range(0, 63, step)) & ((1 << 63) - 1)
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("long"))
        width, shift = width // 2, shift // 2
    return out


def gathered_bits(value) -> Column:
    """Every third bit of the value, the inverse of ``spread_bits``."""
    total = F.lit(0).cast("long")
    for k in range(AXIS_BITS):
        total = total.bitwiseOR(F.shiftleft(F.shiftright(col(value), 3 * k).bitwiseAND(F.lit(1).cast("long")), k))
    return total


def morton(coordinates, origin, resolution: float) -> Column:
    """Z-order code of a point: cell numbers from ``origin``, held within 21 bits, x in the highest place of each triple."""
    top = F.lit((1 << AXIS_BITS) - 1).cast("long")
    cells = [F.least(F.greatest(F.floor((col(c) - col(o)) / resolution).cast("long"), F.lit(0).cast("long")), top) for c, o in zip(coordinates, origin, strict=True)]
    x, y, z = (spread_bits(c) for c in cells)
    return F.shiftleft(x, 2).bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(z)


def morton_cells(code) -> tuple[Column, ...]:
    return tuple(gathered_bits(F.shiftright(col(code), k)) for k in (2, 1, 0))


# --- colours -------------------------------------------------------------------------------------


def ramp(value) -> Vec:
    """Blue, cyan, green, yellow, red by quarter sine waves over [0, 0.9999]."""
    v = F.least(F.greatest(col(value), F.lit(0.0)), F.lit(0.9999))
    quarter = F.floor(v * 4)
    up = F.sin((v * 4 - quarter) * (PI / 2))
    down = F.cos((v * 4 - quarter) * (PI / 2))
    zero, one = F.lit(0.0), F.lit(1.0)
    red = F.when(quarter < 2, zero).when(quarter == 2, up).otherwise(one)
    green = F.when(quarter == 0, up).when(quarter == 3, down).otherwise(one)
    blue = F.when(quarter == 0, one).when(quarter == 1, down).otherwise(zero)
    return red, green, blue


def score_ramp(score, lower: float = 1.0, upper: float = 3.5) -> Vec:
    return ramp((col(score) - lower) / (upper - lower) if upper > lower else F.lit(0.5))


def rgb_bytes(rgb) -> Vec:
    return tuple(F.floor(col(c) * 255).cast("int") for c in rgb)


def rgb_packed(rgb) -> Column:
    """0x00RRGGBB, fractions cut off."""
    r, g, b = (c.cast("long") for c in rgb_bytes(rgb))
    return r * 65536 + g * 256 + b


def hsv(hue, saturation, value) -> Vec:
    """RGB of a hue in degrees: each channel falls from ``value`` by a trapezoid over the colour circle."""
    s, v = col(saturation), col(value)

    def channel(offset: float) -> Column:
        k = F.pmod(col(hue) / 60 + offset, F.lit(6.0))
        return v - v * F.greatest(s, F.lit(0.0)) * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return channel(5.0), channel(3.0), channel(1.0)


def particle_colour(scheme: str, score=None, low=None, span=None, iterations=None, most=None, index=None, total=None) -> Vec:
    """Colours of hypotheses: ``score`` red to green, ``iteration`` green to red, ``index`` along the hues to purple."""
    zero = F.lit(0.0)
    if scheme == "score":
        x = F.least(F.greatest((col(score) - col(low)) / col(span), zero), F.lit(1.0))
        return 1 - x, x, zero
    if scheme == "iteration":
        x = F.when(col(most) > 1, F.least(F.greatest(col(iterations) / col(most), zero), F.lit(1.0))).otherwise(F.lit(0.5))
        return x, 1 - x, zero
    if scheme == "index":
        return hsv(F.when(col(total) > 1, col(index) / col(total) * 300).otherwise(zero), F.lit(1.0), F.lit(1.0))
    raise ValueError(scheme)


def progress_colour(step, steps) -> Vec:
    """Blue to cyan in the first half, cyan to green in the second."""
    p = col(step) / F.greatest(col(steps), F.lit(1))
    return F.lit(0.0), F.least(p * 2, F.lit(1.0)), F.least(2 - p * 2, F.lit(1.0))
