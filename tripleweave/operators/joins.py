"""The equi-join the other operators are built on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal key columns so that the rows of a hot key can be split over several tasks.

    Adaptive execution splits a hot key only where both sides of a join come straight from a shuffle. A
    side that was grouped by, or joined on, the same keys before would be taken as it lies, hot key and
    all. Joining on the keys together with a number made from them gives every join a shuffle of its own; a
    side small enough to broadcast is still broadcast. The number is always zero, so that it adds next to
    nothing to what is shuffled, but Spark does not know that and takes it for a key like the others. Outer
    joins can split their preserved side only.
    """
    own = F.pmod(F.hash(*keys), F.lit(1)).alias("__own")
    return left.select("*", own).join(right.select("*", own), [*keys, "__own"], how).drop("__own")
