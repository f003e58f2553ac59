"""Slice geometry on scalar expressions, so that all of it stays inside generated code.

A direction ``n`` is the three columns ``n_x``, ``n_y``, ``n_z``. Steps that are used more than
once become columns of their own (``DataFrame`` in, ``DataFrame`` out), evaluated once per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-8


def at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def all_finite(values: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [is_finite(v) for v in values])


def xyz(name: str) -> list[Column]:
    """The three columns of a direction."""
    return [F.col(f"{name}_{axis}") for axis in "xyz"]


def set_xyz(name: str, values: list[Column]) -> dict[str, Column]:
    return {f"{name}_{axis}": value for axis, value in zip("xyz", values)}


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def add_unit(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Add ``vector`` scaled to length one; null when shorter than 1e-8 or not finite."""
    v, length = xyz(vector), F.col("_length")
    usable = (length >= TINY) & (length < float("inf"))
    return (
        df.withColumn("_length", F.sqrt(dot(v, v)))
        .withColumns(set_xyz(out, [F.when(usable, c / length) for c in v]))
        .drop("_length")
    )


def add_slice_normal(df: DataFrame, iop: str, out: str) -> DataFrame:
    """Add the unit normal of a six-number orientation array; null when it defines no plane.

    The in-plane vectors must each be at least 1e-8 long and their unit vectors must not be
    parallel. A sum of squares that is NaN or infinite betrays any number that is not finite.
    """
    v = F.col(iop)
    row, column = [at(v, i) for i in range(3)], [at(v, i) for i in range(3, 6)]
    cross = [
        row[1] * column[2] - row[2] * column[1],
        row[2] * column[0] - row[0] * column[2],
        row[0] * column[1] - row[1] * column[0],
    ]
    inner = [F.sqrt(dot(row, row)), F.sqrt(dot(column, column))]
    length, finite = F.sqrt(dot(cross, cross)), inner[0] + inner[1]
    usable = (
        (F.size(v) == 6)
        & (finite < float("inf"))
        & (inner[0] >= TINY)
        & (inner[1] >= TINY)
        & (length >= inner[0] * inner[1] * TINY)
    )
    # One step: some products more for a row cost less than its copy from one step to the next.
    return df.withColumns(set_xyz(out, [F.when(usable, c / length) for c in cross]))


def add_plane(
    df: DataFrame,
    unit: str,
    max_angle_deg: float,
    plane: str = "plane",
    nearest: str = "nearest_plane",
    angle: str = "plane_angle_deg",
) -> DataFrame:
    """Add plane, nearest cardinal plane and tilt of a unit direction.

    The largest component names the plane, x before y before z on a tie; a tilt above the limit
    makes it ``oblique``; without a direction both planes are ``unknown``.
    """
    x, y, z = [F.abs(c) for c in xyz(unit)]
    return df.withColumns(
        {
            nearest: F.when(x.isNull(), "unknown")
            .when((x >= y) & (x >= z), "sagittal")
            .when(y >= z, "coronal")
            .otherwise("axial"),
            angle: F.when(x.isNotNull(), angle_from_cosine(F.greatest(x, y, z))),
        }
    ).withColumn(
        plane,
        F.when(F.col(angle) > max_angle_deg, "oblique").otherwise(F.col(nearest)),
    )


def angle_from_cosine(cosine: Column) -> Column:
    return F.degrees(F.acos(F.least(F.lit(1.0), cosine)))


def determinant3(m: Column) -> Column:
    """Determinant of the leading 3x3 block of an array of rows."""

    def minor(i: int, j: int) -> Column:
        return at(at(m, 1), i) * at(at(m, 2), j) - at(at(m, 1), j) * at(at(m, 2), i)

    top = at(m, 0)
    return at(top, 0) * minor(1, 2) + at(top, 1) * minor(2, 0) + at(top, 2) * minor(0, 1)


def voxel_volume(spacing: Column, thickness: Column) -> Column:
    """Product of in-plane spacing and thickness; null unless all are positive and finite."""
    sides = [at(spacing, 0), at(spacing, 1), thickness]
    positive = reduce(lambda a, b: a & b, [s > 0 for s in sides])
    usable = (F.size(spacing) == 2) & all_finite(sides) & positive
    return F.when(usable, sides[0] * sides[1] * sides[2])
