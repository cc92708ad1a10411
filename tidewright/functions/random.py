"""Random numbers as a pure function of (seed, table, column, stream, row id).

Nothing depends on partitions or on the order of rows, so a column can be computed again for any row
anywhere: that is how a child row gets its parent's key without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Draw:
    """The random streams of one column of one table, over a column of row ids."""

    seed: int
    table: str
    column: str
    row: Column

    def bits(self, stream: str = "") -> Column:
        return F.xxhash64(F.lit(self.seed), F.lit(f"{self.table}\x1f{self.column}\x1f{stream}"), self.row)

    def uniform(self, stream: str = "") -> Column:
        """In [0, 1), of 53 bits."""
        return F.shiftrightunsigned(self.bits(stream), 11).cast("double") * F.lit(2.0**-53)

    def below(self, n: int | Column, stream: str = "") -> Column:
        """A whole number in [0, n)."""
        top = n if isinstance(n, Column) else F.lit(n)
        return F.least(F.floor(self.uniform(stream) * top), top - 1).cast("bigint")

    def normal(self, stream: str = "") -> Column:
        """Standard normal, by Box and Muller."""
        radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - self.uniform(f"{stream}r")))
        return radius * F.cos(F.lit(6.283185307179586) * self.uniform(f"{stream}a"))


def alias_table(weights: list[float]) -> tuple[list[float], list[int]]:
    """Thresholds and aliases for drawing an index in constant time; all weights zero means equal weights."""
    n = len(weights)
    total = float(sum(max(w, 0.0) for w in weights))
    scaled = [max(w, 0.0) * n / total for w in weights] if total > 0 else [1.0] * n
    keep, other = [1.0] * n, list(range(n))
    small = [i for i, w in enumerate(scaled) if w < 1.0]
    large = [i for i, w in enumerate(scaled) if w >= 1.0]
    while small and large:
        low, high = small.pop(), large[-1]
        keep[low], other[low] = scaled[low], high
        scaled[high] -= 1.0 - scaled[low]
        if scaled[high] < 1.0:
            small.append(large.pop())
    return keep, other


def weighted_index(draw: Draw, weights: list[float], stream: str = "") -> Column:
    """An index drawn by weight."""
    keep, other = alias_table(weights)
    slot = draw.below(len(weights), f"{stream}slot").cast("int")
    return F.when(draw.uniform(f"{stream}coin") < F.get(F.lit(keep), slot), slot).otherwise(F.get(F.lit(other), slot))


def permuted(row: Column, n: int, seed: int) -> Column:
    """A bijection of [0, n): an affine map whose factor shares no divisor with n."""
    from math import gcd

    if n < 2:
        return F.lit(0).cast("bigint") * row
    factor = (int(n * 0.6180339887) + seed % max(n, 1)) % n or 1
    while gcd(factor, n) != 1:
        factor += 1
    # the product stays below 2**63 in decimals only for small n; decimals are exact for all
    product = row.cast("decimal(19,0)") * F.lit(factor).cast("decimal(19,0)") + F.lit(seed % n).cast("decimal(19,0)")
    return F.pmod(product, F.lit(n).cast("decimal(19,0)")).cast("bigint")
