"""Vector arithmetic as unrolled column expressions, so it stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

Vec = Sequence[Column]


def cols(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def items(array: Column | str, n: int = 3) -> tuple[Column, ...]:
    """The first ``n`` entries of an array column."""
    array = F.col(array) if isinstance(array, str) else array
    return tuple(array[i] for i in range(n))


def add(a: Vec, b: Vec) -> tuple[Column, ...]:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> tuple[Column, ...]:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vec, k: Column) -> tuple[Column, ...]:
    return tuple(x * k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def cross(a: Vec, b: Vec) -> tuple[Column, Column, Column]:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def finite(x: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_array(a: Column, size: int | None = None) -> Column:
    """True when every entry is finite (and the array has ``size`` entries)."""
    ok = a.isNotNull() & F.coalesce(F.forall(a, finite), F.lit(False))
    return ok if size is None else ok & (F.size(a) == size)


def rotate(matrix: Column, p: Vec) -> tuple[Column, ...]:
    """Rotation part of a row-major 4x4 array applied to a vector."""
    return tuple(matrix[4 * i] * p[0] + matrix[4 * i + 1] * p[1] + matrix[4 * i + 2] * p[2] for i in range(3))


def rotate_back(matrix: Column, p: Vec) -> tuple[Column, ...]:
    """Transpose of the rotation part applied to a vector (inverse of a rigid rotation)."""
    return tuple(matrix[i] * p[0] + matrix[4 + i] * p[1] + matrix[8 + i] * p[2] for i in range(3))


def translation(matrix: Column) -> tuple[Column, ...]:
    return (matrix[3], matrix[7], matrix[11])


def apply_rigid(matrix: Column, p: Vec) -> tuple[Column, ...]:
    return add(rotate(matrix, p), translation(matrix))


def multiply4(a: Column, b: Column) -> Column:
    """Product of two row-major 4x4 arrays."""
    return F.array(*[
        sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j])
        for i in range(4) for j in range(4)
    ])


def determinant3(matrix: Column) -> Column:
    """Determinant of the rotation part of a row-major 4x4 array."""
    rows = [tuple(matrix[4 * i + j] for j in range(3)) for i in range(3)]
    return dot(rows[0], cross(rows[1], rows[2]))


def gram_error(matrix: Column) -> Column:
    """Largest deviation of R'R from the identity."""
    columns = [tuple(matrix[4 * i + j] for i in range(3)) for j in range(3)]
    return F.greatest(*[
        F.abs(dot(columns[i], columns[j]) - F.lit(1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)
    ])


def homogeneous_error(matrix: Column) -> Column:
    """Largest deviation of the last row from (0, 0, 0, 1)."""
    return F.greatest(*[F.abs(matrix[12 + j] - F.lit(1.0 if j == 3 else 0.0)) for j in range(4)])


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low),
                   F.lit(high) if not isinstance(high, Column) else high)


def fan_normal(points: Column) -> Column:
    """Sum of triangle-fan cross products of an ``array<array<double>>`` ring.

    Twice the area vector of a planar polygon, in input orientation.
    """
    first = points[0]

    def step(acc, i):
        a = tuple(points[i - 1][k] - first[k] for k in range(3))
        b = tuple(points[i][k] - first[k] for k in range(3))
        c = cross(a, b)
        return F.array(*[acc[k] + c[k] for k in range(3)])

    # an explicit step of 1 over an empty range would count downwards
    positions = F.when(F.size(points) >= 3, F.sequence(F.lit(2), F.size(points) - 1))
    zero = F.array(*[F.lit(0.0)] * 3)
    return F.coalesce(F.aggregate(positions, zero, step), zero)


def ring_edges(points: Column) -> Column:
    """Array of ``{a, b}`` edges of a ring, with wrap-around."""
    rotated = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.transform(F.arrays_zip(points.alias("a"), rotated.alias("b")),
                       lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b")))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once per row, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def distance(a: Column, b: Column, n: int = 3) -> Column:
    """Distance of two array points."""
    return norm(sub(items(a, n), items(b, n)))


def over(a: Column, b: Column) -> Column:
    """``a / b``, NULL for a zero divisor (ANSI division would fail the job)."""
    return a / F.nullif(b, F.lit(0.0))


def unit(a: Vec) -> tuple[Column, ...]:
    length = norm(a)
    return tuple(over(x, length) for x in a)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row, however often later steps use them.

    A plain projection is merged into its users, which repeats costly expressions; a
    one-element ``inline`` is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))
