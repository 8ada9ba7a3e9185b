"""Joining each row to the one row of its key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key counts as hot if it holds more than one row in so many; there are fewer hot keys than this.
SHARE = 1000


def spread_join(big: DataFrame, small: DataFrame, key: list[str], count: str) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row for each key and the number of ``big``'s rows with it.

    Rows of hot keys meet their partner by broadcast, where they lie; at most
    ``SHARE`` keys can be hot, which bounds what is sent.  All others are joined by
    hash.  Both tables are read twice, so they should be staged.  A null key has no
    partner.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    held = F.col(count) * SHARE > F.lit(total)
    hot, cold = small.filter(held), small.filter(~held)
    if not hot.head(1):
        return big.join(cold, key)
    near = big.join(F.broadcast(hot), key)
    return near.unionByName(big.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key))
