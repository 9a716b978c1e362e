"""Distance between square grid signatures, insensitive to quarter turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_turns(side: int) -> list[list[int]]:
    """Index lists that read a row-major grid after 0, 1, 2 and 3 clockwise quarter turns."""
    out, cur = [], list(range(side * side))
    for _ in range(4):
        out.append(cur)
        # cell (y, x) of the turned grid comes from row side-1-x, column y of the current one
        cur = [cur[(side - 1 - x) * side + y] for y in range(side) for x in range(side)]
    return out


def signature_distance(a: Column, b: Column, side: int, scale: float = 255.0) -> Column:
    """Smallest normalized L1 distance over the four turns of ``b``, at most 1; 1 when one is NULL."""
    n = float(side * side * scale)

    def l1(turn: list[int]) -> Column:
        idx = F.array(*[F.lit(i) for i in turn])
        diffs = F.zip_with(a, idx, lambda x, i: F.abs(x.cast("double") - F.get(b, i).cast("double")))
        return F.aggregate(diffs, F.lit(0.0), lambda s, d: s + d) / n

    return F.coalesce(F.least(*[l1(t) for t in quarter_turns(side)], F.lit(1.0)), F.lit(1.0))
