"""Rigid poses as Column expressions.

A pose is a 7-vector (x, y, z, qw, qx, qy, qz) or a row-major 4x4 matrix of 16 numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from armature.functions import vectors as V

Lanes = Sequence[Column]


def quaternion_product(a: Lanes, b: Lanes) -> list[Column]:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return [
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    ]


def conjugate(q: Lanes) -> list[Column]:
    return [q[0], -q[1], -q[2], -q[3]]


def rotate(q: Lanes, v: Lanes) -> list[Column]:
    """Rotate v by the unit quaternion q: v + 2w(u x v) + 2u x (u x v)."""
    w, *u = q
    inner = cross(u, v)
    outer = cross(u, inner)
    return [x + F.lit(2.0) * (w * i + o) for x, i, o in zip(v, inner, outer, strict=True)]


def cross(a: Lanes, b: Lanes) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def compose(a: Column | str, b: Column | str) -> Column:
    """Pose a applied after pose b, both 7-vectors."""
    pa, qa = V.lanes(a, 3), V.lanes(a, 4, 3)
    pb, qb = V.lanes(b, 3), V.lanes(b, 4, 3)
    moved = [x + y for x, y in zip(pa, rotate(qa, pb), strict=True)]
    return F.array(*moved, *quaternion_product(qa, qb))


def inverse(pose: Column | str) -> Column:
    back = conjugate(V.lanes(pose, 4, 3))
    return F.array(*[-x for x in rotate(back, V.lanes(pose, 3))], *back)


def relative(base: Column | str, target: Column | str) -> Column:
    """Target pose seen from the base frame."""
    back = conjugate(V.lanes(base, 4, 3))
    offset = [t - b for t, b in zip(V.lanes(target, 3), V.lanes(base, 3), strict=True)]
    return F.array(*rotate(back, offset), *quaternion_product(back, V.lanes(target, 4, 3)))


def matrix_product(a: Column | str, b: Column | str) -> Column:
    x, y = V.lanes(a, 16), V.lanes(b, 16)
    return F.array(*[V.total([x[4 * r + k] * y[4 * k + c] for k in range(4)]) for r in range(4) for c in range(4)])


def matrix_inverse(m: Column | str) -> Column:
    """Inverse of a rigid transform: transpose of the rotation, rotated negative offset."""
    x = V.lanes(m, 16)
    rows = []
    for r in range(3):
        turned = [x[4 * k + r] for k in range(3)]
        rows += [*turned, -V.total([turned[k] * x[4 * k + 3] for k in range(3)])]
    return F.array(*rows, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def to_matrix(pose: Column | str) -> Column:
    px, py, pz, w, x, y, z = V.lanes(pose, 7)
    one, two = F.lit(1.0), F.lit(2.0)
    return F.array(
        *[one - two * (y * y + z * z), two * (x * y - w * z), two * (x * z + w * y), px],
        *[two * (x * y + w * z), one - two * (x * x + z * z), two * (y * z - w * x), py],
        *[two * (x * z - w * y), two * (y * z + w * x), one - two * (x * x + y * y), pz],
        *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)],
    )


def from_matrix(m: Column | str) -> Column:
    """7-vector of a rigid matrix, w >= 0; the largest quaternion element is taken from the
    diagonal and the others from off-diagonal sums, which keeps every rotation accurate."""
    a = V.lanes(m, 16)
    r = lambda i, j: a[4 * i + j]
    one = F.lit(1.0)
    squares = [
        one + r(0, 0) + r(1, 1) + r(2, 2),
        one + r(0, 0) - r(1, 1) - r(2, 2),
        one - r(0, 0) + r(1, 1) - r(2, 2),
        one - r(0, 0) - r(1, 1) + r(2, 2),
    ]
    products = [
        [squares[0], r(2, 1) - r(1, 2), r(0, 2) - r(2, 0), r(1, 0) - r(0, 1)],
        [r(2, 1) - r(1, 2), squares[1], r(0, 1) + r(1, 0), r(0, 2) + r(2, 0)],
        [r(0, 2) - r(2, 0), r(0, 1) + r(1, 0), squares[2], r(1, 2) + r(2, 1)],
        [r(1, 0) - r(0, 1), r(0, 2) + r(2, 0), r(1, 2) + r(2, 1), squares[3]],
    ]
    best = F.greatest(*squares)
    scale = F.lit(2.0) * F.sqrt(best)
    quat = []
    for lane in range(4):
        chosen = F.coalesce(*[F.when(squares[i] == best, products[i][lane]) for i in range(4)])
        quat.append(chosen / scale)
    sign = F.when(quat[0] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.array(a[3], a[7], a[11], *[q * sign for q in quat])


def angle(a: Column | str, b: Column | str) -> Column:
    """Rotation angle between two poses, blind to the sign of a quaternion."""
    dot = V.total([x * y for x, y in zip(V.lanes(a, 4, 3), V.lanes(b, 4, 3), strict=True)])
    return F.lit(2.0) * F.acos(F.least(F.lit(1.0), F.abs(dot)))


def pose_distance(a: Column | str, b: Column | str, pos_weight: float = 1.0, rot_weight: float = 1.0) -> Column:
    return F.lit(pos_weight) * V.distance(a, b) + F.lit(rot_weight) * angle(a, b)


def interpolate(a: Column | str, b: Column | str, t: Column) -> Column:
    """Linear position and normalised linear rotation along the shorter arc."""
    qa, qb = V.lanes(a, 4, 3), V.lanes(b, 4, 3)
    dot = V.total([x * y for x, y in zip(qa, qb, strict=True)])
    sign = F.when(dot < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    mixed = [x + (y * sign - x) * t for x, y in zip(qa, qb, strict=True)]
    length = V.norm(mixed)
    moved = [x + (y - x) * t for x, y in zip(V.lanes(a, 3), V.lanes(b, 3), strict=True)]
    return F.array(*moved, *[q / length for q in mixed])
