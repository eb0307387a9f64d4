"""Long samples as planes of little-endian words, in hexadecimal text, and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOLE = "FFFF"


def word(code: Column) -> Column:
    return F.concat(F.lpad(F.hex(code % 256), 2, "0"), F.lpad(F.hex(F.shiftright(code, 8)), 2, "0"))


def text(placed: Column, size: Column) -> Column:
    """Words of a plane of ``size`` places from (at, v) in the order of their distinct places; a place without one is a hole."""
    def after(i: Column) -> Column:
        return F.when(i == 0, F.lit(-1)).otherwise(F.get(placed, i - 1)["at"])

    words = F.transform(placed, lambda r, i: F.when(r["at"] == after(i) + 1, r["v"]).otherwise(F.concat(F.repeat(F.lit(HOLE), r["at"] - after(i) - 1), r["v"])))
    return F.rpad(F.array_join(words, ""), size * 4, F.lit("F"))
