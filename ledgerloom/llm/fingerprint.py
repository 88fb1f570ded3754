"""Records that differ only in how they are written: multiset hashing of normalised fields.

Each field is reduced to its content, hashed under two seeds, and the hashes of a record are added up
modulo a prime: addition commutes, so the order of fields (and which column holds which text) doesn't
matter, and unlike xor it doesn't cancel repeated fields. Records are grouped by the pair of sums, and
every member is compared with the group's first record field by field, as multisets, by counting.
Members that differ (a collision of 122 bits) are grouped again by their fields themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import save

PRIME = (1 << 61) - 1
# What may stand between a sign and the number it belongs to.
MONEY = r"(?:rs\.?|inr|usd|us\$|us dollars|eur|euros?|gbp|jpy|yen|pounds sterling|rupees|[₹$€£¥])"
MINUS = r"\-−"


def content(text: Column) -> Column:
    """What a text says: letters in lower case, digits, points inside numbers, signs of numbers, % ‰ and currency signs.

    Null gives the empty string, as does a text without content. A minus counts before a number or its
    currency unless a letter or digit stands right before it; so does an opening bracket.
    """
    number = rf"\s*(?:{MONEY}\s*)?\.?\p{{Nd}}"
    dropped = (
        r"(?<!\p{Nd})\.|\.(?!\p{Nd})"
        rf"|[{MINUS}](?!{number})|(?<=[\p{{L}}\p{{Nd}}])[{MINUS}]"
        rf"|\((?!{number})"
        rf"|[^\p{{L}}\p{{Nd}}.({MINUS}%‰₹$€£¥]"
    )
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), dropped, "")
    return F.translate(bare, "−", "-")


def _sum_hash(fields: list[Column], seed: int) -> Column:
    total = F.lit(0).cast("long")
    for field in fields:
        total = F.pmod(total + F.pmod(F.xxhash64(F.lit(seed), field), F.lit(PRIME)), F.lit(PRIME))
    return total


def _same_multiset(ours: Column, theirs: Column) -> Column:
    def count(items: Column, x: Column) -> Column:
        return F.size(F.filter(items, lambda y: y == x))

    return F.forall(ours, lambda x: count(ours, x) == count(theirs, x))


def collapse(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, keep): every record that has a copy, with the smallest key among its copies, itself included.

    The same key delivered again with the same content is one record. Nulls: a null field has no
    content; a record whose fields all lack content, or with a null key, takes no part. An empty table
    gives no rows. Columns outside ``key`` and ``fields`` are not read, so their names can't clash.
    """
    names = [f"_f{i}" for i in range(len(fields))]
    base = records.select(F.col(key).alias("_key"), *(content(F.col(f)).alias(n) for f, n in zip(fields, names)))
    base = base.filter(F.col("_key").isNotNull() & (F.concat(*names) != ""))
    # The fingerprints are computed once and kept with the contents; both passes below read them.
    base = save(base.select("_key", F.array(*names).alias("_own"), *(_sum_hash([F.col(n) for n in names], s).alias(f"_h{s}") for s in (1, 2))))
    firsts = base.groupBy("_h1", "_h2").agg(F.min(F.struct("_key", "_own")).alias("_first"), F.max("_key").alias("_max"))
    firsts = firsts.filter("_first._key < _max").drop("_max")
    joined = base.join(firsts, ["_h1", "_h2"])
    same = _same_multiset(F.col("_own"), F.col("_first._own"))
    checked = save(joined.select("_key", F.when(same, F.col("_first._key")).alias("_keep"), F.when(~same, F.array_sort("_own")).alias("_own")))
    odd = checked.filter("_keep is null")
    odd_keep = odd.groupBy("_own").agg(F.min("_key").alias("_keep"), F.max("_key").alias("_max")).filter("_keep < _max")
    rest = odd.select("_key", "_own").join(odd_keep, "_own").select("_key", "_keep")
    sure = checked.filter("_keep is not null").select("_key", "_keep")
    return sure.unionByName(rest).distinct().select(F.col("_key").alias(key), F.col("_keep").alias("keep"))
