"""Lengths and sizes of drawn trees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_length(weight: Column, mode: str = "linear", scale: float = 50.0) -> Column:
    """scale times the weight (1 at least; no weight or 0 is 1), its square root, or the binary logarithm of one more."""
    w = F.greatest(F.lit(1.0), F.when(weight == 0, 1.0).otherwise(F.coalesce(weight.cast("double"), F.lit(1.0))))
    return scale * {"log": F.log2(w + 1), "sqrt": F.sqrt(w)}.get(mode, w)


def node_radius(members: Column, scaled: bool) -> Column:
    """11 for several members and 8 for one, or up to 22 by the square root of their number."""
    n = F.coalesce(members.cast("double"), F.lit(1.0))
    return F.least(F.lit(22.0), 7 + F.sqrt(F.greatest(F.lit(1.0), n)) * 3) if scaled else F.when(n > 1, 11.0).otherwise(8.0)
