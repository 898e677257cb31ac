"""Vector, matrix and projection expressions: columns in, columns out, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", names: tuple[str, str, str] = ("x", "y", "z")) -> Vec:
    return tuple(F.col(prefix + n) for n in names)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(x * s for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec, least: float = 1e-12) -> Vec:
    """Zero where the length is below the least."""
    n = length(a)
    return tuple(F.when(n < least, F.lit(0.0)).otherwise(x / n) for x in a)


def angular_distance(a: Vec, b: Vec) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def transform(m: list[list[Column | float]], p: Vec) -> Vec:
    """A point by the upper three rows of a 4 x 4 matrix."""
    return tuple(sum((F.lit(0.0) + r[i] * p[i] for i in range(3)), F.lit(0.0)) + r[3] for r in m[:3])


def worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with further columns that are worked out once a row, however many conditions ask for them: a generator of one row, as the planner
    moves filters on plain columns into the join below and writes the whole expression out at each place that names it."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def rotated(r: Column, p: Vec, back: bool = False) -> Vec:
    """A vector by a rotation held as an array of rows, or by its transpose."""
    at = lambda i, k: r[k][i] if back else r[i][k]
    return tuple(at(i, 0) * p[0] + at(i, 1) * p[1] + at(i, 2) * p[2] for i in range(3))


def camera_position(r: Column, t: Column) -> Vec:
    """Place in the world of a camera whose rotation and shift lead from the world to it: -R^T t."""
    return tuple(-x for x in rotated(r, (t[0], t[1], t[2]), back=True))


def look_at(eye: tuple[float, float, float], target: tuple[float, float, float], up: tuple[float, float, float] = (0.0, 1.0, 0.0)) -> list[list[float]]:
    """View matrix (4 x 4, rows) of a viewer that looks along -z at the target; a handful of numbers, worked out on the driver."""
    import numpy as np

    z = np.subtract(eye, target).astype(float)
    z /= max(np.linalg.norm(z), 1e-12)
    x = np.cross(up, z)
    x /= max(np.linalg.norm(x), 1e-12)
    m = np.eye(4)
    m[:3, :3] = x, np.cross(z, x), z
    m[:3, 3] = -m[:3, :3] @ np.asarray(eye, float)
    return m.tolist()


def perspective(fov_y: float, aspect: float, near: float, far: float) -> list[list[float]]:
    """Projection matrix (4 x 4, rows) to clip space with depths from -1 to 1; the angle is in radians."""
    import math

    f = 1 / math.tan(fov_y / 2)
    return [[f / aspect, 0.0, 0.0, 0.0], [0.0, f, 0.0, 0.0], [0.0, 0.0, (far + near) / (near - far), 2 * far * near / (near - far)], [0.0, 0.0, -1.0, 0.0]]


def orbit(target: tuple[float, float, float], distance: float, azimuth: float, elevation: float) -> tuple[float, float, float]:
    """Place of a viewer on a sphere around the target."""
    import math

    return (target[0] + distance * math.cos(elevation) * math.sin(azimuth), target[1] + distance * math.sin(elevation), target[2] + distance * math.cos(elevation) * math.cos(azimuth))


def ray_box(o: Vec, d: Vec, low: Vec, high: Vec) -> Column:
    """Whether a ray meets an axis-aligned box at or after its start. Axes along which the ray does not move only ask whether it starts
    between the box's sides."""
    enter, leave, inside = [F.lit(0.0)], [], F.lit(True)
    for p, v, a, b in zip(o, d, low, high, strict=True):
        still = F.abs(v) < 1e-12
        t0, t1 = (F.when(~still, (x - p) / F.when(~still, v)) for x in (a, b))
        enter.append(F.coalesce(F.least(t0, t1), F.lit(0.0)))
        leave.append(F.coalesce(F.greatest(t0, t1), F.lit(float("inf"))))
        inside = inside & (~still | ((p >= a) & (p <= b)))
    return inside & (F.greatest(*enter) <= F.least(*leave))


def rigid_inverse(m: list[list[Column | float]]) -> list[list[Column]]:
    """Transposed rotation, and minus that times the shift."""
    r = [[F.lit(0.0) + m[j][i] for j in range(3)] for i in range(3)]
    return [[*row, -sum((row[k] * m[k][3] for k in range(3)), F.lit(0.0))] for row in r]


def project(p: Vec, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel place of a camera-space point; null behind the camera."""
    z = F.when(p[2] > 0, p[2])
    return p[0] / z * fx + cx, p[1] / z * fy + cy


def unproject(u: Column, v: Column, d: Column, fx: float, fy: float, cx: float, cy: float) -> Vec:
    return (u - cx) / fx * d, (v - cy) / fy * d, d


def grid_cell(p: Vec, size: float) -> tuple[Column, Column, Column]:
    return tuple(F.floor(x / size).cast("long") for x in p)


def cell_hash(c: tuple[Column, Column, Column], bits: int = 20) -> Column:
    """Spatial hash of a cell: fixed multipliers of the published scheme, wrapped to unsigned 32 bits, then cut to a table size."""
    wrap = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    parts = [wrap(x * m) for x, m in zip(c, (73856093, 19349663, 83492791), strict=True)]
    return parts[0].bitwiseXOR(parts[1]).bitwiseXOR(parts[2]).bitwiseAND(F.lit((1 << bits) - 1))


def quat_rotation(q: tuple[Column, Column, Column, Column]) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def covariance(q, s: Vec) -> tuple[Column, ...]:
    """Upper triangle (xx, xy, xz, yy, yz, zz) of R S S R^T."""
    r = quat_rotation(q)
    m = [[r[i][k] * s[k] for k in range(3)] for i in range(3)]
    return tuple(sum((m[i][k] * m[j][k] for k in range(3)), F.lit(0.0)) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))


def ray_triangle(o: Vec, d: Vec, a: Vec, b: Vec, c: Vec, eps: float = 1e-8) -> Column:
    """Distance along the ray at which it meets the triangle, or -1."""
    e1, e2 = sub(b, a), sub(c, a)
    h = cross(d, e2)
    det = dot(e1, h)
    f = 1 / F.when(F.abs(det) >= eps, det)
    s = sub(o, a)
    u = f * dot(s, h)
    q = cross(s, e1)
    v = f * dot(d, q)
    t = f * dot(e2, q)
    return F.coalesce(F.when((u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1) & (t > eps), t), F.lit(-1.0))


def barycentric(p: tuple[Column, Column], a, b, c) -> Vec:
    """Weights of a, b and c at a point of their plane; all -1 for a degenerate triangle."""
    d = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
    ok = F.when(F.abs(d) >= 1e-12, d)
    wa = ((b[1] - c[1]) * (p[0] - c[0]) + (c[0] - b[0]) * (p[1] - c[1])) / ok
    wb = ((c[1] - a[1]) * (p[0] - c[0]) + (a[0] - c[0]) * (p[1] - c[1])) / ok
    return tuple(F.coalesce(x, F.lit(-1.0)) for x in (wa, wb, 1 - wa - wb))


def edge_crossing(v0: Column, v1: Column) -> Column:
    """Where between two corners a value crosses zero, in [0, 1]."""
    return F.when(F.abs(v1 - v0) > 1e-8, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -v0 / (v1 - v0)))).otherwise(0.5)


def rodrigues(r: Vec) -> list[list[Column]]:
    """Rotation matrix of a rotation vector."""
    t = length(r)
    k = tuple(F.when(t < 1e-12, F.lit(0.0)).otherwise(x / t) for x in r)
    s, v = F.sin(t), 1 - F.cos(t)
    skew = [[F.lit(0.0), -k[2], k[1]], [k[2], F.lit(0.0), -k[0]], [-k[1], k[0], F.lit(0.0)]]
    return [[F.lit(1.0 if i == j else 0.0) + s * skew[i][j] + v * (k[i] * k[j] - (1.0 if i == j else 0.0)) if i == j else s * skew[i][j] + v * k[i] * k[j] for j in range(3)] for i in range(3)]
