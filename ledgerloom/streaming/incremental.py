"""Claims that arrive as a stream: latest state of a key, counts by event time, and relations built per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions import text
from ledgerloom.functions.keys import clean_key
from ledgerloom.operators import cascade, matching
from ledgerloom.sources.scratch import save, scope
from ledgerloom.sources.store import Store


def first_deliveries(claims: DataFrame, late: str = "30 days") -> DataFrame:
    """The stream without rows delivered again; state is kept for as long as the watermark allows late rows."""
    timed = claims.withColumn("claim_id", clean_key("claim_id")).withColumn("at", F.timestamp_seconds("created_at")).filter("claim_id is not null and at is not null")
    return timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["claim_id"])


def arrivals(claims: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Claims per window of event time and origin."""
    timed = claims.withColumn("at", F.timestamp_seconds("created_at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "origin").agg(F.count("*").alias("claims"), F.avg("final_confidence").alias("confidence"))


def relate_new(store: Store, batch: DataFrame) -> DataFrame:
    """Verdicts on all pairs of a claim of ``batch`` (claim_id) with a stored claim of another document.

    Only claims under a name of the batch are read beyond their names and prepared; names are one entity where their keys
    are equal (names that are merely alike are joined by the batch form, ``Engine.relate``). Verdicts carry the latest
    created_at of the two claims, so a pair judged again replaces its older verdict, also when it became unrelated.
    """
    claims = store.table("claims").withColumn("claim_id", clean_key("claim_id"))
    ids = batch.select(clean_key("claim_id").alias("id")).filter("id is not null").distinct()
    key = text.entity_key(F.col("subject"))
    names = claims.join(ids, claims["claim_id"] == ids["id"], "left_semi").select(key.alias("_k")).filter("_k <> ''").distinct()
    same = claims.filter(~F.coalesce("quarantined", F.lit(False))).join(names, key == F.col("_k"), "left_semi")
    ready = save(cascade.prepared(same.select(*cascade.COMPARED, "created_at")))
    pairs = matching.candidate_pairs(matching.blocked(ready), new=ids)
    judged = cascade.compare(cascade.sides(pairs, ready).drop("a_id", "b_id"))
    at = ready.select("claim_id", "created_at")
    for side in "ab":
        judged = judged.join(at.select(F.col("claim_id").alias(f"claim_{side}_id"), F.col("created_at").alias(f"_{side}")), f"claim_{side}_id")
    return judged.withColumn("created_at", F.greatest("_a", "_b")).drop("_a", "_b", "component")


def relate_batches(claims: DataFrame, store: Store, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Upserts every batch and relates its claims with those that are there. A batch that is run again gives the same tables."""

    def step(batch: DataFrame, number: int) -> None:
        with scope():
            store.upsert("claims", batch)
            found = save(relate_new(store, batch))
            before = store.table("relations")
            # An unrelated pair is stored only to replace a verdict that said otherwise.
            kept = found.filter("kind <> 'unrelated'")
            if before is not None:
                kept = kept.unionByName(found.filter("kind = 'unrelated'").join(before.select("relation_id"), "relation_id", "left_semi").select(*kept.columns))
            store.upsert("relations", kept)
            if then:
                then(found, number)

    return claims.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
