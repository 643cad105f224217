"""Vectors, quaternions and matrices of Columns.

These are Python-side bundles of scalar Columns; an operation on them builds an
expression and no job.  Conventions: right-handed axes, column vectors, Hamilton
products, quaternions as (x, y, z, w) with identity (0, 0, 0, 1); forward is -z
and up is +y.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def col(v: Number | str) -> Column:
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.lit(float(v))


def _raw(v: Number | str) -> Column | float:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else float(v)


# Constants stay Python numbers until an expression needs them, so that factors
# of 0 and 1 vanish; Spark itself must keep x * 0.0, which may be NaN.
def _mul(a: Number, b: Number) -> Number:
    for one, other in ((a, b), (b, a)):
        if not isinstance(one, Column):
            if one == 0:
                return 0.0
            if one == 1:
                return other
            if one == -1:
                return -other
    return a * b


def _add(a: Number, b: Number) -> Number:
    if not isinstance(a, Column) and a == 0:
        return b
    if not isinstance(b, Column) and b == 0:
        return a
    return a + b


def _sub(a: Number, b: Number) -> Number:
    if not isinstance(b, Column) and b == 0:
        return a
    if not isinstance(a, Column) and a == 0:
        return -b
    return a - b


class Vec3:
    def __init__(self, x: Number, y: Number, z: Number) -> None:
        self.raw = (x, y, z)

    @property
    def x(self) -> Column:
        return col(self.raw[0])

    @property
    def y(self) -> Column:
        return col(self.raw[1])

    @property
    def z(self) -> Column:
        return col(self.raw[2])

    @classmethod
    def of(cls, x: Number | str, y: Number | str, z: Number | str) -> "Vec3":
        return cls(_raw(x), _raw(y), _raw(z))

    @classmethod
    def from_array(cls, a: Column | str) -> "Vec3":
        a = F.col(a) if isinstance(a, str) else a
        return cls(*[F.get(a, F.lit(i)).cast("double") for i in range(3)])

    @classmethod
    def from_struct(cls, s: Column | str) -> "Vec3":
        s = F.col(s) if isinstance(s, str) else s
        return cls(s["x"], s["y"], s["z"])

    def __iter__(self):
        return iter((self.x, self.y, self.z))

    def __add__(self, o: "Vec3") -> "Vec3":
        return Vec3(*map(_add, self.raw, o.raw))

    def __sub__(self, o: "Vec3") -> "Vec3":
        return Vec3(*map(_sub, self.raw, o.raw))

    def __neg__(self) -> "Vec3":
        return Vec3(*[_sub(0.0, c) for c in self.raw])

    def __mul__(self, s: Number) -> "Vec3":
        return Vec3(*[_mul(c, s) for c in self.raw])

    def scaled(self, o: "Vec3") -> "Vec3":
        return Vec3(*map(_mul, self.raw, o.raw))

    def _dot(self, o: "Vec3") -> Number:
        return reduce(_add, map(_mul, self.raw, o.raw))

    def dot(self, o: "Vec3") -> Column:
        return col(self._dot(o))

    def cross(self, o: "Vec3") -> "Vec3":
        (ax, ay, az), (bx, by, bz) = self.raw, o.raw
        return Vec3(_sub(_mul(ay, bz), _mul(az, by)), _sub(_mul(az, bx), _mul(ax, bz)), _sub(_mul(ax, by), _mul(ay, bx)))

    def length(self) -> Column:
        return F.sqrt(self.dot(self))

    def normalized(self) -> "Vec3":
        """Of length 1; the zero vector stays as it is."""
        n = self.length()
        return Vec3(*[c if not isinstance(c, Column) and c == 0 else F.when(n > 0, c / n).otherwise(col(c)) for c in self.raw])

    def project_onto(self, o: "Vec3") -> "Vec3":
        return o * (self.dot(o) / o.dot(o))

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def array(self) -> Column:
        return F.array(*self)

    def columns(self, prefix: str = "", digits: int | None = None) -> list[Column]:
        cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
        return [cut(c).alias(f"{prefix}{n}") for c, n in zip(self, "xyz")]

    def geogebra(self, name: str, decimals: int) -> Column:
        """``name = (x, y, z)`` with rounded components."""
        return F.concat(F.lit(f"{name} = ("), F.concat_ws(", ", *[F.round(c, decimals).cast("string") for c in self]), F.lit(")"))


RIGHT, UP, FORWARD = Vec3.of(1, 0, 0), Vec3.of(0, 1, 0), Vec3.of(0, 0, -1)


class Quat:
    def __init__(self, x: Number, y: Number, z: Number, w: Number) -> None:
        self.vector, self.scalar = Vec3(x, y, z), w

    @property
    def x(self) -> Column:
        return self.vector.x

    @property
    def y(self) -> Column:
        return self.vector.y

    @property
    def z(self) -> Column:
        return self.vector.z

    @property
    def w(self) -> Column:
        return col(self.scalar)

    @classmethod
    def identity(cls) -> "Quat":
        return cls(0.0, 0.0, 0.0, 1.0)

    @classmethod
    def from_array(cls, a: Column) -> "Quat":
        return cls(*[F.get(a, F.lit(i)).cast("double") for i in range(4)])

    @classmethod
    def about(cls, axis: str, angle: Number) -> "Quat":
        """Rotation by ``angle`` radians about one of the axes x, y, z."""
        if not isinstance(angle, Column) and angle == 0:
            return cls.identity()
        half = col(angle) / 2
        return cls(*[F.sin(half) if a == axis else 0.0 for a in "xyz"], F.cos(half))

    @classmethod
    def from_eulers(cls, e: Vec3, order: str = "xyz") -> "Quat":
        """Product of the axis rotations in the given order."""
        order = order.lower()
        if order not in {"".join(p) for p in permutations("xyz")}:
            raise ValueError(f"invalid rotation order {order!r}")
        return reduce(Quat.times, [cls.about(a, e.raw["xyz".index(a)]) for a in order])

    def times(self, o: "Quat") -> "Quat":
        """Hamilton product: (w u' + w' u + u x u', w w' - u . u')."""
        v = o.vector * self.scalar + self.vector * o.scalar + self.vector.cross(o.vector)
        return Quat(*v.raw, _sub(_mul(self.scalar, o.scalar), self.vector._dot(o.vector)))

    def conjugate(self) -> "Quat":
        return Quat(*(-self.vector).raw, self.scalar)

    def rotate(self, v: Vec3) -> Vec3:
        """v + 2u x (u x v + wv), for a unit quaternion with vector part u."""
        u = self.vector
        return v + u.cross(u.cross(v) + v * self.scalar) * 2.0

    def array(self) -> Column:
        return F.array(self.x, self.y, self.z, self.w)

    def columns(self, prefix: str = "", digits: int = 9) -> list[Column]:
        return [F.round(c, digits).alias(f"{prefix}{n}") for c, n in zip((self.x, self.y, self.z, self.w), "xyzw")]


def random_quaternion(low: tuple[float, float, float], high: tuple[float, float, float], seed: int) -> Quat:
    """Euler angles drawn evenly between the bounds, given in degrees."""
    e = Vec3(*[F.radians(F.lit(a) + F.rand(seed + i) * (b - a)) for i, (a, b) in enumerate(zip(low, high))])
    return Quat.from_eulers(e)


class Mat4:
    """A 4 x 4 matrix of Columns, by rows."""

    def __init__(self, rows: list[list[Number]]) -> None:
        self.rows = [[_raw(v) for v in r] for r in rows]

    @classmethod
    def identity(cls) -> "Mat4":
        return cls([[float(i == j) for j in range(4)] for i in range(4)])

    @classmethod
    def translation(cls, v: Vec3) -> "Mat4":
        x, y, z = v.raw
        return cls([[1, 0, 0, x], [0, 1, 0, y], [0, 0, 1, z], [0, 0, 0, 1]])

    @classmethod
    def scale(cls, v: Vec3) -> "Mat4":
        x, y, z = v.raw
        return cls([[x, 0, 0, 0], [0, y, 0, 0], [0, 0, z, 0], [0, 0, 0, 1]])

    @classmethod
    def rotation(cls, q: Quat) -> "Mat4":
        columns = [q.rotate(a).raw for a in (RIGHT, UP, -FORWARD)]
        return cls([[*row, 0] for row in zip(*columns)] + [[0, 0, 0, 1]])

    @classmethod
    def look_at(cls, eye: Vec3, target: Vec3, up: Vec3) -> "Mat4":
        back = (eye - target).normalized()
        right = up.cross(back).normalized()
        top = back.cross(right)
        return cls([[*v.raw, -v.dot(eye)] for v in (right, top, back)] + [[0, 0, 0, 1]])

    @classmethod
    def orthographic(cls, width: Number, height: Number, near: Number, far: Number) -> "Mat4":
        w, h, n, f = map(col, (width, height, near, far))
        return cls([[2.0 / w, 0, 0, 0], [0, 2.0 / h, 0, 0], [0, 0, -2.0 / (f - n), -(f + n) / (f - n)], [0, 0, 0, 1]])

    @classmethod
    def perspective(cls, fovy_deg: Number, aspect: Number, near: Number, far: Number) -> "Mat4":
        a, n, f = map(col, (aspect, near, far))
        t = F.tan(F.radians(col(fovy_deg)) / 2)
        return cls([[1 / (a * t), 0, 0, 0], [0, 1 / t, 0, 0], [0, 0, -(f + n) / (f - n), -2 * f * n / (f - n)], [0, 0, -1, 0]])

    def times(self, o: "Mat4") -> "Mat4":
        return Mat4([[reduce(_add, map(_mul, row, c)) for c in zip(*o.rows)] for row in self.rows])

    def apply(self, v: Vec3) -> tuple[Column, Column, Column, Column]:
        """Homogeneous coordinates of the image of a point."""
        return tuple(col(reduce(_add, map(_mul, r, (*v.raw, 1.0)))) for r in self.rows)

    def point(self, v: Vec3) -> Vec3:
        return Vec3(*self.apply(v)[:3])

    def array(self) -> Column:
        return F.array(*[col(c) for r in self.rows for c in r])
