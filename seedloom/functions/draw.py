"""Draws: hashes of (seed, table, column, row, slot), equal on any partitioning and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of one draw, and of a wide one.
NARROW, WIDE = 1 << 32, 1 << 60


class Draw:
    """The draws of one column of one table. Every slot is an independent draw of the same row."""

    def __init__(self, seed: int, table: str, column: str, row: Column, attempt: Column | int = 0) -> None:
        self.prefix = f"{seed}|{table}|{column}|".lower()
        self.row = row
        self.attempt = F.lit(attempt) if isinstance(attempt, int) else attempt

    def text(self, slot: int | Column = 0) -> Column:
        """32 hexadecimal digits."""
        slot = F.lit(slot) if isinstance(slot, int) else slot
        return F.md5(F.concat(F.lit(self.prefix), self.row.cast("string"), F.lit("|"), slot.cast("string"), F.lit("|"), self.attempt.cast("string")))

    def bits(self, slot: int | Column = 0, wide: bool = False) -> Column:
        """A long from 0 to 2**32 - 1, or to 2**60 - 1."""
        return F.conv(F.substring(self.text(slot), 1, 15 if wide else 8), 16, 10).cast("long")

    def unit(self, slot: int | Column = 0) -> Column:
        """A double from 0 to 1, without 1."""
        return self.bits(slot) / F.lit(float(NARROW))

    def below(self, n: int | Column, slot: int | Column = 0) -> Column:
        """A long from 0 to n - 1."""
        wide = isinstance(n, Column) or n > NARROW
        return F.pmod(self.bits(slot, wide), F.lit(n).cast("long") if isinstance(n, int) else n)
