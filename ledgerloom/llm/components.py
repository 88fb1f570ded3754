"""Connected groups from pairwise matches by deterministic Borůvka hooking.

Every component selects its smallest outgoing edge. Edges are ordered by a hash of their two labels,
then by the labels, which is a strict order, so the selected edges form trees whose only cycles are
pairs that selected the same edge; the smaller label of such a pair becomes the root. Because the
order is random with respect to the labels, trees stay shallow even on long sorted chains, and
pointer doubling collapses them in a few joins. Edges are then relabelled and deduplicated, until no
edge is left; every round at least halves the components that still have one.

Skew: the choice of an edge is an aggregate with map-side combine, so a hub with a third of all edges
sends one row per task. The joins have a unique key on one side; AQE splits the hot partitions of the
other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import drop, save


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _hook(edges: DataFrame) -> DataFrame:
    """(c, p): each component and the other end of its smallest edge; roots point to themselves."""
    weighed = edges.withColumn("w", F.xxhash64("lo", "hi"))
    ends = weighed.select(F.explode(F.array("lo", "hi")).alias("c"), F.struct("w", "lo", "hi").alias("e"))
    picked = ends.groupBy("c").agg(F.min("e").alias("e"))
    return picked.select("c", F.when(F.col("e.lo") == F.col("c"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("p"))


def _collapse(hooked: DataFrame) -> DataFrame:
    """(c, p) with p the root of c's tree: break the mutual choices, then double pointers until nothing moves."""
    pointers = save(hooked)
    first = True
    while True:
        above = pointers.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        joined = pointers.join(above, "p")
        if first:
            mutual = F.col("pp") == F.col("c")
            target = F.when(mutual, F.least("c", "p")).otherwise(F.col("pp"))
        else:
            target = F.col("pp")
        moved = save(joined.select("c", target.alias("p"), (target != F.col("p")).alias("moved")))
        drop(pointers)
        again = _any(moved.filter("moved"))
        path = moved._scratch_path
        pointers = moved.select("c", "p")
        pointers._scratch_path = path
        if not again and not first:
            return pointers
        first = False


def connected_groups(pairs: DataFrame, left: str, right: str, id_name: str = "id", group_name: str = "group_id") -> DataFrame:
    """One row per distinct id in ``pairs``, with the smallest id of its group.

    Nulls: a pair with a null end links nothing and is left out, whole. Empty strings are ids like any
    other. A pair of an id with itself makes a group of one. Repeated and exchanged pairs count once.
    No pairs give no rows. Other columns of ``pairs`` are ignored, whatever their names.
    """
    both = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null")
    ends = both.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    every = save(ends)
    edges = every.filter("lo <> hi")
    levels: list[DataFrame] = []
    owned: DataFrame | None = None
    while _any(edges):
        roots = _collapse(_hook(edges))
        levels.append(roots)
        low = roots.select(F.col("c").alias("lo"), F.col("p").alias("l"))
        high = roots.select(F.col("c").alias("hi"), F.col("p").alias("h"))
        renamed = edges.join(low, "lo").join(high, "hi").filter("l <> h")
        edges = save(renamed.select(F.least("l", "h").alias("lo"), F.greatest("l", "h").alias("hi")).distinct())
        drop(owned)
        owned = edges
    loops = every.filter("lo = hi").select(F.col("lo").alias("c"))
    if not levels:
        return loops.select(F.col("c").alias(id_name), F.col("c").alias(group_name))
    final = levels.pop()
    while levels:
        upper = final.select(F.col("c").alias("p"), F.col("p").alias("top"))
        final = levels.pop().join(upper, "p", "left").select("c", F.coalesce("top", "p").alias("p"))
    final = save(final)
    smallest = final.groupBy("p").agg(F.min("c").alias("g"))
    named = final.join(smallest, "p").select("c", "g")
    alone = loops.join(final, "c", "left_anti").select("c", F.col("c").alias("g"))
    return named.unionByName(alone).select(F.col("c").alias(id_name), F.col("g").alias(group_name))
