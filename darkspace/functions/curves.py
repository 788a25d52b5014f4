"""Space-filling curves and plot geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def morton(column: Column, bits: int = 16) -> tuple[Column, Column]:
    """Even bits give x, odd bits y."""
    x = y = F.lit(0).cast("long")
    for k in range(bits):
        x = x.bitwiseOR(F.shiftleft(F.shiftright(column, 2 * k).bitwiseAND(F.lit(1)), k))
        y = y.bitwiseOR(F.shiftleft(F.shiftright(column, 2 * k + 1).bitwiseAND(F.lit(1)), k))
    return x, y


def row_major(column: Column, side: int) -> tuple[Column, Column]:
    return column % side, F.floor(column / side)


def hilbert(column: Column, bits: int = 8) -> tuple[Column, Column]:
    """The 2-D Hilbert curve of side 2**bits, by conditional rotations from the lowest digit up."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def turn(at: Column, step: Column) -> Column:
        rx, ry, size = step["rx"], step["ry"], step["size"]
        x, y = F.when(rx == 1, size - 1 - at["x"]).otherwise(at["x"]), F.when(rx == 1, size - 1 - at["y"]).otherwise(at["y"])
        return F.struct((F.when(ry == 0, y).otherwise(at["x"]) + rx * size).alias("x"), (F.when(ry == 0, x).otherwise(at["y"]) + ry * size).alias("y"))

    steps = []
    for k in range(bits):
        digit = F.shiftright(column, 2 * k).bitwiseAND(F.lit(3)).cast("long")
        rx = F.shiftright(digit, 1)
        steps.append(F.struct(rx.alias("rx"), digit.bitwiseXOR(rx).bitwiseAND(F.lit(1)).alias("ry"), F.lit(1 << k).cast("long").alias("size")))
    end = F.aggregate(F.array(*steps), start, turn)
    return end["x"], end["y"]


def arc(value: Column, largest: Column, index: Column, count: int) -> tuple[Column, Column]:
    """Radius and angle in degrees of a value's mark on a circle; no radius, so no mark, where the value isn't above 0."""
    return F.when(value > 0, 2 * value / largest), index * F.lit(360.0) / F.lit(count)
