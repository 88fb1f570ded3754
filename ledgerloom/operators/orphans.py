"""References without a live target, found by an as-of match against runs of parent keys.

Keys are hexadecimal. Their integer value is compressed into runs of consecutive integers inside
ranges of the key space; a reference is matched to the run that starts last at or before it and is an
orphan if it lies beyond the run's end. A run also knows when the first and the last of its keys came
and whether any is deleted, which settles most keys inside it (all, if the run is one key); those that
are left, near a deleted key or a late one, look their own key up. With random keys most runs hold one
key and nothing is compressed; with dense keys a run holds up to a slice's thousands, which is what the
method is for. Keys that aren't hexadecimal numbers of at most ``HEX_DIGITS`` digits are matched by
equality.

Scale: references are reduced to distinct keys (combined before the shuffle, so a key with a third of
all references is one row per task) before they meet the runs. Both sides share one hash partitioning
by slice of the key space, ``SLICE`` positions at most, so the as-of match never sorts more than that at
a time, however dense the keys. A run is a row of fixed size. Only the keys found suspicious go back to
the referring rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.keys import clean_key

HEX_DIGITS = 30
# The last LOW digits of a key are its position within a range; what stands before them names the range.
LOW = 15
# Positions of a slice, as a power of two: 65,536. Runs end at a slice's edge.
SLICE = 16


@dataclass(frozen=True)
class Reference:
    """A column of ``rows`` that refers to ``parent``; ``key`` identifies the referring row."""

    rows: DataFrame
    table: str
    column: str
    key: str
    at: str
    parent: DataFrame
    parent_key: str
    parent_at: str
    parent_table: str


def split_key(key: Column) -> list[Column]:
    """Range and position of a hexadecimal key; null for any other. Width is part of the range: '0a' isn't 'a'."""
    hexa = key.rlike(f"^[0-9a-f]{{1,{HEX_DIGITS}}}$")
    padded = F.lpad(key, F.greatest(F.length(key), F.lit(LOW)), F.lit("0"))
    head = F.concat_ws(":", F.length(key).cast("string"), F.substring(padded, 1, F.length(padded) - LOW))
    return [F.when(hexa, head).alias("bucket"), F.when(hexa, F.conv(F.substring(padded, -LOW, LOW), 16, 10).cast("long")).alias("pos")]


def parent_runs(parents: DataFrame) -> DataFrame:
    """Runs of consecutive positions within a slice: bucket, slice, start, end, first_at and last_at of its keys, dead (any), all_dead.

    ``parents`` has one row per key: bucket, pos, first_at, dead.
    """
    order = Window.partitionBy("bucket", "slice").orderBy("pos")
    stepped = parents.withColumn("slice", F.shiftright("pos", SLICE)).withColumn("rank", F.row_number().over(order))
    runs = stepped.groupBy("bucket", "slice", (F.col("pos") - F.col("rank")).alias("island"))
    return runs.agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.max("first_at").alias("last_at"), F.bool_or("dead").alias("dead"), F.bool_or(F.col("first_at").isNull()).alias("undated")
    ).drop("island")


def parent_states(parent: DataFrame, key: str, at: str, table: str, deletions: DataFrame) -> DataFrame:
    """One row per parent key: when its first row came and whether it was deleted after its last."""
    seen = parent.select(clean_key(key).alias("key"), F.col(at).alias("at")).filter("key is not null")
    seen = seen.groupBy("key").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    gone = deletions.filter(clean_key("target_table") == table).select(clean_key("target_key").alias("key"), "deleted_at")
    gone = gone.filter("key is not null").groupBy("key").agg(F.max("deleted_at").alias("deleted_at"))
    joined = seen.join(gone, "key", "left")
    return joined.select("key", "first_at", F.coalesce(F.col("deleted_at") > F.col("last_at"), F.lit(False)).alias("dead"))


def suspicious_keys(keys: DataFrame, states: DataFrame) -> DataFrame:
    """Of ``keys`` (key, earliest): those without a live target at ``earliest``, with first_at (null: never valid)."""
    asked = keys.select("key", "earliest", *split_key(F.col("key")))
    known = states.select("key", "first_at", "dead", *split_key(F.col("key")))
    runs = parent_runs(known.filter("bucket is not null")).select(
        "bucket", "slice", F.col("start").alias("pos"), F.lit(0).alias("asks"), F.struct("start", "end", "last_at", "dead", "undated").alias("run"),
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("earliest"),
    )
    asks = asked.filter("bucket is not null").select(
        "bucket", F.shiftright("pos", SLICE).alias("slice"), "pos", F.lit(1).alias("asks"), F.lit(None).cast(runs.schema["run"].dataType).alias("run"), "key", "earliest"
    )
    before = Window.partitionBy("bucket", "slice").orderBy("pos", "asks").rowsBetween(Window.unboundedPreceding, 0)
    asof = runs.unionByName(asks).withColumn("run", F.last("run", ignorenulls=True).over(before)).filter("asks = 1")
    inside, alone = F.coalesce(F.col("pos") <= F.col("run.end"), F.lit(False)), F.col("run.start") == F.col("run.end")
    # Beyond the run, or in a run of one key: settled. In a longer one if none of its keys is dead or came after the reference.
    clean = ~F.col("run.dead") & ~F.col("run.undated") & F.coalesce(F.col("run.last_at") <= F.col("earliest"), F.lit(False))
    state = F.struct(F.col("run.last_at").alias("first_at"), F.col("run.dead").alias("dead"))
    matched = asof.select("key", "earliest", (~inside | alone | clean).alias("settled"), F.when(inside, state).alias("state"))
    matched = matched.filter(~F.col("settled") | F.col("state").isNull() | F.col("state.dead") | F.col("state.first_at").isNull() | ~F.coalesce(F.col("state.first_at") <= F.col("earliest"), F.lit(False)))
    settled = matched.filter("settled").select("key", "earliest", "state")
    open_keys = matched.filter(~F.col("settled")).select("key", "earliest").unionByName(asked.filter("bucket is null").select("key", "earliest"))
    others = open_keys.join(states.select("key", F.struct("first_at", "dead").alias("state")), "key", "left").select("key", "earliest", "state")
    live = F.when(~F.col("state.dead"), F.col("state.first_at"))
    found = settled.unionByName(others).select("key", "earliest", live.alias("first_at"), F.coalesce(F.col("state.dead"), F.lit(True)).alias("never"))
    return found.filter("never or first_at > earliest").select("key", "first_at", "never")


def orphan_references(refs: list[Reference], deletions: DataFrame) -> DataFrame:
    """ref_table, ref_column, row_id, ref_month of every reference without a live target.

    A row is dated by its earliest delivery, whose reference counts; of two deliveries at one time the
    smaller reference counts. Null or blank references and rows with a null or blank key are no cases.
    A row without a date has a null month and can't precede its target. An empty parent table makes every
    reference an orphan; an empty referring table gives no rows.
    """
    parts = []
    grouped: dict[tuple[int, str], DataFrame] = {}
    states: dict[str, DataFrame] = {}
    tables = {(id(r.rows), r.table): [x for x in refs if x.rows is r.rows and x.table == r.table] for r in refs}
    for (_, table), own in tables.items():
        one = own[0]
        cols = [clean_key(r.column).alias(f"_r{i}") for i, r in enumerate(own)]
        rows = one.rows.select(clean_key(one.key).alias("row_id"), F.col(one.at).alias("at"), *cols).filter("row_id is not null")
        first = rows.groupBy("row_id").agg(F.min(F.struct(F.col("at").isNull().alias("undated"), "at", *[f"_r{i}" for i in range(len(own))])).alias("x"))
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.col(f"x._r{i}").alias("key")) for i in range(len(own))])).alias("ref")
        flat = first.select("row_id", F.col("x.at").alias("at"), each).select("row_id", "at", "ref.*").filter("key is not null")
        for target in {r.parent_table for r in own}:
            mine = [i for i, r in enumerate(own) if r.parent_table == target]
            r = own[mine[0]]
            if target not in states:
                states[target] = parent_states(r.parent, r.parent_key, r.parent_at, target, deletions)
            asked = flat.filter(F.col("n").isin(mine))
            keys = asked.groupBy("key").agg(F.min("at").alias("earliest"))
            bad = suspicious_keys(keys, states[target])
            hit = asked.join(bad, "key").filter("never or first_at > at")
            name = F.element_at(F.array(*[F.lit(r.column) for r in own]), F.col("n") + 1)
            parts.append(hit.select(F.lit(table).alias("ref_table"), name.alias("ref_column"), "row_id", F.date_format(F.timestamp_seconds("at"), "yyyy-MM").alias("ref_month")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, column and month."""
    return orphans.groupBy("ref_table", "ref_column", "ref_month").agg(F.count("*").alias("orphans"))
