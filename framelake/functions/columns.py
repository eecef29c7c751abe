"""Column expressions for cells, periodic images and angles. All stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded, without negative zero; for results that depend on the order of a sum."""
    return F.round(c, places) + F.lit(0.0)


def rounded_length(c: Column, places: int) -> Column:
    """A value that isn't negative, rounded by scaling it, halves up; for many rows: F.round goes through decimal text for each."""
    scaled = c * F.lit(10.0**places)
    whole = F.floor(scaled)
    return (whole + (scaled - whole >= 0.5).cast("int")).cast("double") / F.lit(10.0**places)


def wrap(f: Column) -> Column:
    """A fraction in [0, 1)."""
    return f - F.floor(f)


def wrap_with_tolerance(f: Column, tolerance: float = 1e-9) -> Column:
    """A fraction in [0, 1), in which almost 1 counts as 0."""
    w = wrap(f)
    return F.when(F.lit(1.0) - w <= tolerance, F.lit(0.0)).otherwise(w)


def nearest_image(d: Column, edge: float | Column) -> Column:
    """The displacement along one axis of an orthogonal cell, at ties the even image."""
    edge = F.lit(edge) if isinstance(edge, (int, float)) else edge
    return d - F.rint(d / edge) * edge


def image_shift(d: Column, edge: float | Column) -> Column:
    edge = F.lit(edge) if isinstance(edge, (int, float)) else edge
    return (-F.rint(d / edge)).cast("int")


def norm(v: Sequence[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def angle_degrees(cosine: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def determinant(m: Sequence[Column]) -> Column:
    """Of a row-major 3x3 matrix."""
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: Sequence[Column]) -> list[Column]:
    """Of a row-major 3x3 matrix, by the adjugate."""
    det = determinant(m)
    adjugate = [
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    ]
    return [a / det for a in adjugate]


def row_times(v: Sequence[Column], m: Sequence[Column]) -> Vector:
    """The row vector v times the row-major matrix m (positions are rows, cells hold their vectors in rows)."""
    return tuple(v[0] * m[k] + v[1] * m[3 + k] + v[2] * m[6 + k] for k in range(3))


def legendre(degree: int, x: Column) -> Column:
    """P_l(x), by the three-term recurrence written out."""
    before, now = F.lit(1.0), x
    if degree == 0:
        return before
    for n in range(1, degree):
        before, now = now, ((2 * n + 1) * x * now - n * before) / (n + 1)
    return now


def canonical_digest(*columns: Column) -> Column:
    """SHA-256 of the columns in order; a null differs from the empty string."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)
