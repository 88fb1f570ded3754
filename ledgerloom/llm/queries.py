"""Queries over the test tables, p1_ to p10_, of the operators in this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.keys import clean_key
from ledgerloom.llm import components, confusables, fingerprint, mixing, names, pii, tokens, vectors


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _table(spark, sf, "relations").filter(clean_key("kind").isin("corroboration", "supersedes"))
    pairs = pairs.select(clean_key("claim_a_id").alias("a"), clean_key("claim_b_id").alias("b"))
    return components.connected_groups(pairs, "a", "b", "claim_id", "group_id")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _linked(spark, sf)


def p1_group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _linked(spark, sf).groupBy("group_id").agg(F.count("*").alias("members"))
    return sizes.groupBy("members").agg(F.count("*").alias("groups"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    claims = _table(spark, sf, "claims").withColumn("claim_id", clean_key("claim_id"))
    kept = fingerprint.collapse(claims, "claim_id", ["subject", "predicate", "value"])
    return kept.withColumnRenamed("keep", "keep_id")


def p2_copies(spark: SparkSession, sf: str) -> DataFrame:
    return p2_found(spark, sf).groupBy("keep_id").agg(F.count("*").alias("copies"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "claims").select(clean_key("claim_id").alias("claim_id"), "embedding")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.similar_pairs(_vectors(spark, sf), "claim_id", "embedding").select(F.col("lo").alias("claim_lo_id"), F.col("hi").alias("claim_hi_id"))


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """claim_id, rank, neighbour_id, cosine: the five most similar of every claim, in order."""
    first, rest = vectors.nearest(_vectors(spark, sf), "claim_id", "embedding")
    flat = first.unionByName(rest).select(F.col("id").alias("claim_id"), F.posexplode("near").alias("pos", "x"))
    return flat.select("claim_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.round("x.cosine", 6).alias("cosine"))


def _name_fields(spark: SparkSession, sf: str) -> DataFrame:
    claims = _table(spark, sf, "claims").select(clean_key("claim_id").alias("claim_id"), "subject", "asserted_by")
    fields = F.array(*[F.struct(F.lit(f).alias("claim_field"), F.col(f).alias("spelling")) for f in ("subject", "asserted_by")])
    return claims.select("claim_id", F.explode(fields).alias("x")).select("claim_id", "x.*").filter("claim_id is not null and spelling is not null")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    fields, register = _name_fields(spark, sf), _table(spark, sf, "entity_register")
    meant = names.variants(fields, "spelling", register, "entity_id", "entity_name", "entity_kind")
    return fields.join(meant, "spelling").select("claim_id", "claim_field", "entity_id").distinct()


def p6_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """How many spellings of each registered entity are in use."""
    fields, register = _name_fields(spark, sf), _table(spark, sf, "entity_register")
    meant = names.variants(fields, "spelling", register, "entity_id", "entity_name", "entity_kind")
    return meant.groupBy("entity_id").agg(F.count("*").alias("spellings"))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    claims = _table(spark, sf, "claims").select(clean_key("claim_id").alias("claim_id"), "span_text", "matched_text")
    fields = F.array(*[F.struct(F.lit(f).alias("claim_field"), F.col(f).alias("text")) for f in ("span_text", "matched_text")])
    return claims.select("claim_id", F.explode(fields).alias("x")).select("claim_id", "x.*")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.disguised(_spans(spark, sf), ["claim_id", "claim_field"], "text").select("claim_id", "claim_field").distinct()


def p7_forms(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.disguised(_spans(spark, sf), ["claim_id", "claim_field"], "text").select("claim_id", "claim_field", "text", "form").distinct()


def p7_same_look(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.same_look(_spans(spark, sf), ["claim_id", "claim_field"], "text")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(_table(spark, sf, "documents"), "doc_id", "text")


def p8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, same: whether the decoded ids give the text again."""
    docs = _table(spark, sf, "documents")
    decoded = tokens.decode_corpus(tokens.encode_corpus(docs, "doc_id", "text"), "doc_id").withColumnRenamed("text", "decoded")
    return docs.join(decoded, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, mixing.Plan]:
    docs = _table(spark, sf, "documents")
    sizes = docs.select("doc_id", "source").join(tokens.token_counts(docs, "doc_id", "text"), "doc_id")
    return mixing.mix(sizes, "doc_id", _table(spark, sf, "mix_targets"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """slot, source, doc_id, use, tokens: the mix in the order of its slots' numbers."""
    return _mix(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    mixed, plan = _mix(spark, sf)
    return mixing.shares(mixed, "doc_id", plan)


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_items(_table(spark, sf, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    flat = _items(spark, sf).select("doc_id", F.explode("items").alias("x"))
    return flat.select("doc_id", F.col("x.kind").alias("pii_kind"), F.col("x.text").alias("pii_text")).distinct()


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("doc_id", F.col("redacted").alias("text"))


def p10_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return p10_found(spark, sf).groupBy("pii_kind").agg(F.count("*").alias("items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_group_sizes, p2_found, p2_copies, p3_found, p3_neighbours, p6_found, p6_spellings, p7_found, p7_forms, p7_same_look, p8_ids, p8_token_counts, p8_round_trip, p9_mix, p9_shares, p10_found, p10_redacted, p10_kinds)
}
