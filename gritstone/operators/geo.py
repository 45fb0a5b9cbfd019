"""Points in degrees: bounding boxes, with or without a z-order column to prune by."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import morton


def with_zorder(points: DataFrame, bits: int = 16) -> DataFrame:
    """Adds ``z``; a table sorted or partitioned by it keeps neighbours together."""
    return points.withColumn("z", morton(F.col("x"), F.col("y"), bits))


def in_box(points: DataFrame, x: float, y: float, width: float, height: float, types: Iterable[str] | None = None) -> DataFrame:
    """Points in the box, edges included. All comparisons reach the scan."""
    out = points.where(F.col("x").between(x, x + width) & F.col("y").between(y, y + height))
    return out if types is None else out.where(F.col("type").isin(*sorted(types)))


def zorder_cells(x: float, y: float, width: float, height: float, bits: int) -> list[tuple[int, int]]:
    """Closed ranges of z-order numbers of ``bits`` bits an axis that cover the box, neighbouring ones merged."""
    size = 1 << bits

    def cell(v: float, low: float, span: float) -> int:
        return min(size - 1, max(0, int((v - low) / span * size // 1)))

    x0, x1, y0, y1 = cell(x, -180, 360), cell(x + width, -180, 360), cell(y, -90, 180), cell(y + height, -90, 180)
    out: list[tuple[int, int]] = []

    def visit(cx: int, cy: int, level: int, z: int) -> None:
        span = 1 << level
        if cx > x1 or cx + span - 1 < x0 or cy > y1 or cy + span - 1 < y0:
            return
        if level == 0 or (cx >= x0 and cx + span - 1 <= x1 and cy >= y0 and cy + span - 1 <= y1):
            lo, hi = z, z + span * span - 1
            if out and out[-1][1] + 1 == lo:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
            return
        half = span >> 1
        for k in range(4):
            visit(cx + half * (k & 1), cy + half * (k >> 1), level - 1, z + k * half * half)

    visit(0, 0, bits, 0)
    return out


def in_box_by_zorder(points: DataFrame, x: float, y: float, width: float, height: float, types: Iterable[str] | None = None, bits: int = 16, coarse: int = 6) -> DataFrame:
    """The same by the column ``z`` (of ``bits`` bits an axis) first: ranges that files and row groups can be skipped by."""
    shift = 2 * (bits - coarse)
    near = F.lit(False)
    for lo, hi in zorder_cells(x, y, width, height, coarse):
        near = near | F.col("z").between(lo << shift, ((hi + 1) << shift) - 1)
    return in_box(points.where(near), x, y, width, height, types)
