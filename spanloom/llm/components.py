"""Connected components of a table of links, by alternating large and small stars, and joins with hot keys.

Each round points every node at a smaller neighbour and is cut by a reliable checkpoint; the number of
rounds grows with the logarithm of the longest path.  Nothing is collected but two counters a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import cut

#: The most keys that are met by a broadcast as too frequent for one task.
HOT_KEYS = 2_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b, distinct.  Large: neighbours above a node go to its least neighbour; small: those below."""
    sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:
        moved = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = sides.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b of one orderable type.  Returns node, root: the least node of its component."""
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    stamp = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")))
    before = now.agg(stamp.alias("s")).head().s
    while before[0]:
        now = cut(_star(_star(now, True), False))
        after = now.agg(stamp.alias("s")).head().s
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def join_facts(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of facts, which has a row for each key and how many rows have it.  Keys of more
    than one in HOT_KEYS of all rows, of which there cannot be more than HOT_KEYS, are met by a broadcast, so
    that a hot key is spread over all tasks."""
    total = facts.agg(F.sum(size)).head()[0] or 0
    hot = F.col(size) * HOT_KEYS > total
    often = F.broadcast(facts.where(hot).drop(size))
    rare = rows.join(often.select(key), key, "left_anti").join(facts.where(~hot).drop(size), key)
    return rows.join(often, key).unionByName(rare)
