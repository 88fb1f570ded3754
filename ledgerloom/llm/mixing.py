"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. A source's supply is its tokens times the number of times a text of it may be used. The total is the
   largest at which every source that has texts still reaches its share (or the caller's).
2. The mix is a row of slots of one block each. Slot i gets the point frac((i + 1/2) / golden ratio),
   which falls into one source's stretch of the cumulative weights; the points are so even that every
   prefix of the mix is close to the target shares, not only the whole.
3. Each source's texts are shuffled by a hash, anew for each use, laid end to end, and cut into blocks
   by the running number of tokens; texts stay whole and belong to the block they start in. The n-th
   slot of a source takes its n-th block.

Both running counts (slots of a source, tokens of a source) are two-level: sums of small buckets first,
then offsets within a bucket, so a source with a third of all texts is spread over thousands of tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import save

GOLDEN = 0.6180339887498949
# A block is so many tokens at least, and the mix at most so many blocks.
LEAST_BLOCK, MOST_BLOCKS = 256, 1_000_000
# Texts of one use of one source are ordered inside so many ranges of their hash; slots inside runs of SLOT_RUN.
BUCKETS, SLOT_RUN = 4096, 65_536


@dataclass(frozen=True)
class Plan:
    shares: list[tuple[str, float, int, int]]  # source, target share, most uses, tokens at hand
    total: int
    block: int

    @property
    def slots(self) -> int:
        return self.total // self.block


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None, block: int | None = None) -> Plan:
    """``sizes``: source, tokens per text. ``targets``: source, target_share, max_repeats.

    Sources with a null or non-positive share or number of uses are left out, as is a null source. A
    source listed twice counts with its larger share and smaller number of uses.
    """
    wanted = targets.filter("source is not null and target_share > 0 and max_repeats > 0")
    wanted = wanted.groupBy("source").agg(F.max("target_share").alias("share"), F.min("max_repeats").alias("uses"))
    supply = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    # As many rows as the list of targets has.
    rows = wanted.join(supply, "source", "left").select("source", "share", "uses", F.coalesce("tokens", F.lit(0)).alias("tokens")).orderBy("source").collect()
    shares = [(r.source, float(r.share), int(r.uses), int(r.tokens)) for r in rows]
    there = [s for s in shares if s[3] > 0]
    weight = sum(s[1] for s in there)
    if total is None:
        total = int(min((s[3] * s[2] * weight / s[1] for s in there), default=0))
    return Plan(shares, total, block or max(LEAST_BLOCK, total // MOST_BLOCKS))


def schedule(docs: DataFrame, p: Plan) -> DataFrame:
    """slot, source, rank: which block of which source every slot takes."""
    spark = docs.sparkSession
    there = [s for s in p.shares if s[3] > 0]
    weight = sum(s[1] for s in there)
    slots = spark.range(p.slots).withColumnRenamed("id", "slot")
    # Exact enough for 2^31 slots: the whole part is cut off before precision is lost.
    point = F.expr(f"((slot % 1048576) * {GOLDEN}D) % 1 + ((slot div 1048576) * {(GOLDEN * 1048576) % 1}D) % 1 + {0.5 * GOLDEN}D") % 1
    edge, source = 0.0, F.lit(there[-1][0]) if there else F.lit(None).cast("string")
    cases = []
    for s in there:
        edge += s[1] / weight
        cases.append((edge, s[0]))
    for upper, name in reversed(cases[:-1]):
        source = F.when(F.col("point") < upper, name).otherwise(source)
    placed = slots.withColumn("point", point).select("slot", source.alias("source"), F.expr(f"slot div {SLOT_RUN}").alias("run"))
    sums = placed.groupBy("source", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot"))
    return placed.withColumn("within", within).join(offsets, ["source", "run"]).select("slot", "source", (F.col("before") + F.col("within") - 1).alias("rank"))


def blocks(sizes: DataFrame, key: str, p: Plan) -> DataFrame:
    """source, rank, key, use, tokens: the block every use of a text belongs to."""
    spark = sizes.sparkSession
    there = [s for s in p.shares if s[3] > 0]
    weight = sum(s[1] for s in there)
    uses = [(s, min(u, -(-int(p.total * share / weight + p.block) // t)), t) for s, share, u, t in there]
    limits = spark.createDataFrame(uses or [("", 0, 0)], "source string, uses int, at_hand long").filter("uses > 0")
    used = sizes.filter("tokens > 0").join(F.broadcast(limits), "source")
    each = used.select("source", key, "tokens", "at_hand", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("use"))
    each = each.withColumn("h", F.xxhash64(F.lit("mix"), "use", key)).withColumn("bucket", F.pmod(F.shiftright("h", 40), F.lit(BUCKETS)))
    sums = each.groupBy("source", "use", "bucket").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source", "use").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "use", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "use", "bucket").orderBy("h", key).rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["source", "use", "bucket"])
    start = F.col("use") * F.col("at_hand") + F.col("before") + F.col("inside")
    return placed.select("source", F.floor(start / p.block).cast("long").alias("rank"), key, "use", "tokens")


def mix(sizes: DataFrame, key: str, targets: DataFrame, total: int | None = None, block: int | None = None) -> tuple[DataFrame, Plan]:
    """(slot, source, key, use, tokens) of every text use in the mix, and the plan.

    ``sizes`` has key (unique), source and tokens; texts without tokens and sources that aren't listed
    take no part. ``use`` counts from 0. Texts in one slot have no order among them but their key. No
    listed source with texts gives no rows.
    """
    kept = save(sizes.select(key, "source", "tokens"))
    p = plan(kept, targets, total, block)
    mixed = schedule(kept, p).join(blocks(kept, key, p), ["source", "rank"]).select("slot", "source", key, "use", "tokens")
    return mixed, p


def shares(mixed: DataFrame, key: str, p: Plan) -> DataFrame:
    """source, target_share, actual_share, tokens, texts, most_uses of every listed source; 0 where nothing is there."""
    by = mixed.groupBy("source", key).agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    by = by.groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("texts"), F.max("n").alias("most_uses"))
    listed = mixed.sparkSession.createDataFrame([(s[0], s[1]) for s in p.shares], "source string, target_share double")
    out = listed.join(by, "source", "left").fillna(0, ["tokens", "texts", "most_uses"])
    whole = out.agg(F.sum("tokens").alias("whole"))
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), "whole"), F.lit(0.0))
    # The cross join is with the one row of the sum.
    return out.join(F.broadcast(whole)).select("source", "target_share", F.round(share, 6).alias("actual_share"), "tokens", "texts", "most_uses")
