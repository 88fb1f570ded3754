"""Queries of the core operators over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon, periods, text, values
from ledgerloom.functions.keys import clean_key
from ledgerloom.operators import cascade, extraction, grids, grounding, matching, orphans, review, strategies, units
from ledgerloom.plans.engine import CONTEXT, Engine
from ledgerloom.sources import files, store
from ledgerloom.sources.scratch import shared_dir
from ledgerloom.streaming import incremental


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return units.harmonise(table(spark, sf, "claims"), predict=False).filter("status = 'stated'").select("claim_id", "common_unit", "amount")


def p4_unstated(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with a number but without a unit: converted by the classifier or routed to review."""
    return units.harmonise(table(spark, sf, "claims")).filter("status in ('predicted', 'review')")


def p4_status(spark: SparkSession, sf: str) -> DataFrame:
    return units.harmonise(table(spark, sf, "claims")).groupBy("status", "common_unit").agg(F.count("*").alias("claims"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    claims, relations = table(spark, sf, "claims"), table(spark, sf, "relations")
    store, deletions = table(spark, sf, "document_store"), table(spark, sf, "deletion_log")
    to_claim = dict(key="relation_id", at="created_at", parent=claims, parent_key="claim_id", parent_at="created_at", parent_table="claims")
    refs = [orphans.Reference(relations, "relations", c, **to_claim) for c in ("claim_a_id", "claim_b_id")]
    refs.append(orphans.Reference(claims, "claims", "doc_id", "claim_id", "created_at", store, "doc_id", "ingested_at", "document_store"))
    return orphans.orphan_references(refs, deletions)


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(p5_found(spark, sf))


def engine(spark: SparkSession, sf: str) -> Engine:
    return Engine(table(spark, sf, "document_store"), table(spark, sf, "claims"), table(spark, sf, "relations"))


def _claims(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return engine(spark, sf).claim_rows(*columns)


def _relations(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return engine(spark, sf).relation_rows(*columns)


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    rels = _relations(spark, sf, "claim_a_id", "claim_b_id")
    return rels.select("relation_id", F.col("claim_a_id").alias("a_id"), F.col("claim_b_id").alias("b_id"))


def _joined(spark: SparkSession, sf: str, claims: DataFrame) -> DataFrame:
    """Stored relations with the columns of ``claims`` for both sides, as a_... and b_..."""
    left, right = (claims.select(*[F.col(c).alias(f"{s}_{c}") for c in claims.columns]) for s in "ab")
    return _ends(spark, sf).join(left, F.col("a_id") == F.col("a_claim_id")).join(right, F.col("b_id") == F.col("b_claim_id"))


def _raw_pairs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Stored relations with columns of both claims as they are."""
    return _joined(spark, sf, _claims(spark, sf, *columns))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Stored relations with the compared columns of both claims, prepared."""
    return cascade.sides(_ends(spark, sf), _claims(spark, sf, *cascade.COMPARED))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as files and their pages: the passages of one page stand below each other, by doc_id. A passage without a file is one itself."""
    docs = table(spark, sf, "documents").filter("text is not null")
    file = F.coalesce(clean_key("source_doc_id"), F.concat(F.lit("#"), F.col("doc_id").cast("string")))
    passages = F.sort_array(F.collect_list(F.struct("doc_id", "text")))
    pages = docs.groupBy(file.alias("doc_id"), F.coalesce("page_no", F.lit(1)).alias("page_no")).agg(passages.alias("p"))
    return pages.select("doc_id", "page_no", F.array_join("p.text", "\n").alias("raw"))


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    """A source as one document, every passage a page."""
    return table(spark, sf, "documents").filter("text is not null").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.col("text").alias("raw"))


# Store: upserts, deletes, reads.


def claims_latest(spark, sf):
    return _claims(spark, sf, "doc_id", "value", "created_at").select("claim_id", "doc_id", "value", "created_at")


def documents_latest(spark, sf):
    return engine(spark, sf).document_rows("filename", "status", "ingested_at").select("doc_id", "filename", "status", "ingested_at")


def relations_latest(spark, sf):
    return _relations(spark, sf, "kind", "created_at").select("relation_id", "kind", "created_at")


def documents_completed(spark, sf):
    return store.completed(table(spark, sf, "document_store"), ["pages_read"]).select("doc_id", "pages_read")


def delete_document_cascade(spark, sf):
    """What stays when the documents of the deletion log go, with their claims and relations."""
    log = table(spark, sf, "deletion_log").filter(clean_key("target_table") == "document_store").select(F.col("target_key").alias("doc_id"))
    kept, left = store.without_documents(_claims(spark, sf, "doc_id"), _relations(spark, sf, "claim_a_id", "claim_b_id"), log)
    return kept.agg(F.count("*").alias("claims_left")).join(F.broadcast(left.agg(F.count("*").alias("relations_left"))))


def claims_by_ids(spark, sf):
    ids = table(spark, sf, "deletion_log").filter(clean_key("target_table") == "claims").select(clean_key("target_key").alias("claim_id")).distinct()
    return _claims(spark, sf, "subject").join(ids, "claim_id", "left_semi").select("claim_id", "subject")


def claims_filtered(spark, sf):
    return engine(spark, sf).claims(needs_review=True, quarantined=False, origin="table", limit=None, columns=("final_confidence",)).select("claim_id", "final_confidence")


def claims_search(spark, sf):
    return engine(spark, sf).claims(search="INFLATION", limit=None, columns=("predicate",)).select("claim_id", "predicate")


def claims_top_confidence(spark, sf):
    return engine(spark, sf).claims(limit=200, offset=50, columns=("final_confidence",)).select("claim_id", "final_confidence")


def claims_comparable(spark, sf):
    return _claims(spark, sf, "quarantined", "origin").filter(~F.coalesce("quarantined", F.lit(False))).groupBy("origin").agg(F.count("*").alias("claims"))


def quarantine_split(spark, sf):
    return _claims(spark, sf, "quarantined", "needs_review").groupBy("quarantined", "needs_review").agg(F.count("*").alias("claims"))


def claim_counts(spark, sf):
    return _claims(spark, sf, "needs_review", "quarantined", "origin").agg(F.count("*").alias("claims"), F.count_if("needs_review").alias("review"), F.count_if("quarantined").alias("quarantined"), F.count_if(F.col("origin") == "table").alias("from_tables"))


def claims_by_origin(spark, sf):
    return _claims(spark, sf, "origin", "modality").groupBy("origin", "modality").agg(F.count("*").alias("claims"))


def document_claim_counts(spark, sf):
    return engine(spark, sf).documents("ingested_at").select("doc_id", "claim_count", "ingested_at")


def relations_cross_document(spark, sf):
    return engine(spark, sf).relations(limit=None, columns=("kind",)).select("relation_id", "kind", "a_doc_id", "b_doc_id")


def relations_top(spark, sf):
    return engine(spark, sf).relations(kind="contradiction", limit=100, columns=("kind",)).select("relation_id", "confidence")


def relations_of_document(spark, sf):
    return engine(spark, sf).relations(doc_id="3be47e1b80e60f65", cross_document=False, limit=None, columns=("kind",)).select("relation_id", "kind")


def relations_enriched(spark, sf):
    return engine(spark, sf).enriched(("subject", "value")).select("relation_id", F.col("claim_a.subject").alias("a_subject"), F.col("claim_b.value").alias("b_value"))


def relations_by_kind(spark, sf):
    return engine(spark, sf).relations(limit=None, columns=("kind",)).groupBy("kind").agg(F.count("*").alias("relations"))


def relations_missing_side(spark, sf):
    rels, claims = _relations(spark, sf, "claim_a_id", "claim_b_id"), _claims(spark, sf, "created_at").select("claim_id")
    a = rels.join(claims, rels["claim_a_id"] == claims["claim_id"], "left_anti").select("relation_id", F.lit("a").alias("side"))
    return a.unionByName(rels.join(claims, rels["claim_b_id"] == claims["claim_id"], "left_anti").select("relation_id", F.lit("b").alias("side")))


def stats_dashboard(spark, sf):
    return engine(spark, sf).stats()


def grounding_profile(spark, sf):
    s = F.col("grounding_score")
    return _claims(spark, sf, "grounding_score").agg(F.count_if(s == 1).alias("exact"), F.count_if((s > 0) & (s < 1)).alias("near"), F.count_if(F.coalesce(s, F.lit(0.0)) == 0).alias("not_located"))


def decided_by_share(spark, sf):
    by = _relations(spark, sf, "decided_by").agg(F.count("*").alias("relations"), F.count_if(F.col("decided_by") == "llm").alias("by_model"))
    return by.select("relations", "by_model", F.round(F.try_divide(F.col("by_model") * 100.0, "relations"), 4).alias("percent"))


def dedupe_best_confidence(spark, sf):
    low = lambda c: F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    key = [low(c) for c in ("doc_id", "subject", "predicate", "value", "ctx_period", "ctx_scope", "unit")]
    best = Window.partitionBy(*key).orderBy(F.desc_nulls_last("final_confidence"), "claim_id")
    return _claims(spark, sf, "doc_id", "subject", "predicate", "value", "ctx_period", "ctx_scope", "unit", "final_confidence").withColumn("r", F.row_number().over(best)).filter("r = 1").select("claim_id", "final_confidence")


def review_buckets(spark, sf):
    reason = F.lower("reason")
    has = lambda *w: F.greatest(*[F.contains(reason, F.lit(x)) for x in (*w, w[0])])
    bucket = F.when(has("evidence", "located", "numbers"), "grounding").when(has("page", "context", "period"), "context").when(has("predicate", "vocab", "unit"), "vocab").otherwise("other")
    return _claims(spark, sf, "review_reasons").select(F.explode("review_reasons").alias("reason")).select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("reasons"))


def evidence_choice(spark, sf):
    shown = F.when((F.length("matched_text") >= 12) | (F.coalesce("span_text", F.lit("")) == ""), F.col("matched_text")).otherwise(F.col("span_text"))
    return _claims(spark, sf, "matched_text", "span_text", "grounding_page", "span_page").select("claim_id", shown.alias("evidence"), F.coalesce("grounding_page", "span_page").alias("page"))


def stated_context(spark, sf):
    entries = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"ctx_{c}").alias("stated")) for c in CONTEXT])
    return _claims(spark, sf, *[f"ctx_{c}" for c in CONTEXT]).select("claim_id", F.explode(entries).alias("x")).select("claim_id", "x.*").filter("stated <> ''")


def context_diff_view(spark, sf):
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_ctx_{f}").alias("a"), F.col(f"b_ctx_{f}").alias("b")) for f in ("period", "unit", *cascade.FIELDS)])
    rows = _raw_pairs(spark, sf, *[f"ctx_{f}" for f in ("period", "unit", *cascade.FIELDS)]).select("relation_id", F.explode(fields).alias("x")).select("relation_id", "x.*")
    a, b = F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))
    return rows.filter((a != "") | (b != "")).select("relation_id", "field", (a != b).alias("differs"))


def export_sample_relations(spark, sf):
    """The 40 most confident relations of each kind; a capped sample is what this export is."""
    return store.export_sample(_relations(spark, sf, "kind", "confidence").filter("kind is not null"), "kind", 40, [F.desc_nulls_last("confidence"), F.col("relation_id")]).select("relation_id", "kind")


def best_two_per_kind(spark, sf):
    return store.export_sample(_relations(spark, sf, "kind", "confidence").filter("kind is not null"), "kind", 2, [F.desc_nulls_last("confidence"), F.col("relation_id")]).select("kind", "relation_id", "confidence")


def worst_flagged(spark, sf):
    return _claims(spark, sf, "needs_review", "final_confidence").filter("needs_review").orderBy(F.asc_nulls_last("final_confidence"), "claim_id").limit(20).select("claim_id", "final_confidence")


def nested_as_json(spark, sf):
    rows = store.as_json(_claims(spark, sf, "review_reasons").select("claim_id", "review_reasons"), ["review_reasons"])
    back = store.from_json(rows, {"review_reasons": "array<string>"})
    return back.select("claim_id", F.size("review_reasons").alias("reasons"))


# Values, units, periods, words.


def _parsed(spark, sf):
    return values.with_unit(values.with_value(_claims(spark, sf, "value", "unit", "ctx_unit", "value_num"), "value"), F.coalesce("unit", "ctx_unit"))


def parse_value_number(spark, sf):
    return _parsed(spark, sf).select("claim_id", F.col("v_base").alias("base"))


def parse_value_parts(spark, sf):
    return _parsed(spark, sf).select("claim_id", F.col("v_scale").alias("scale"), F.col("v_currency").alias("currency"), F.col("v_percent").alias("percent"))


def unit_signature(spark, sf):
    return _parsed(spark, sf).select("claim_id", F.col("u_currency").alias("currency"), F.col("u_scale").alias("scale"), F.col("u_percent").alias("percent"))


def unit_labels(spark, sf):
    return _parsed(spark, sf).groupBy(values.unit_label().alias("label")).agg(F.count("*").alias("claims"))


def precision_half_unit(spark, sf):
    return _parsed(spark, sf).select("claim_id", values.half_unit(F.col("v_token"), F.col("v_scale")).alias("half"))


def measure_kinds(spark, sf):
    return _parsed(spark, sf).groupBy(values.measure_kind().alias("kind")).agg(F.count("*").alias("claims"))


def numbers_in_text(spark, sf):
    return _claims(spark, sf, "value").select("claim_id", F.array_join(values.numbers_in(F.col("value")), ";").alias("numbers"))


def period_signature(spark, sf):
    p = periods.with_period(_claims(spark, sf, "ctx_period"), "ctx_period")
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
    return p.select("claim_id", join("p_years").alias("years"), join("p_quarters").alias("quarters"), join("p_halves").alias("halves"), join("p_months").alias("months"), F.col("p_fiscal").alias("fiscal"))


def _period_pairs(spark, sf):
    return _joined(spark, sf, periods.with_period(_claims(spark, sf, "ctx_period"), "ctx_period"))


def period_compare_pairs(spark, sf):
    return _period_pairs(spark, sf).select("relation_id", periods.compare("a_p_", "b_p_").alias("verdict"))


def period_precedes(spark, sf):
    return _period_pairs(spark, sf).groupBy(periods.precedes("a_p_", "b_p_").alias("ordering")).agg(F.count("*").alias("pairs"))


def entity_normalize(spark, sf):
    return _claims(spark, sf, "subject").groupBy(text.entity_key(F.col("subject")).alias("entity")).agg(F.count("*").alias("claims"))


def entity_containment(spark, sf):
    w = lambda c: F.array_distinct(F.split(text.entity_key(F.col(c)), " "))
    x = _raw_pairs(spark, sf, "subject").select("relation_id", w("a_subject").alias("a"), w("b_subject").alias("b"))
    inside = (F.size(F.array_except("a", "b")) == 0) | (F.size(F.array_except("b", "a")) == 0)
    return x.select("relation_id", inside.alias("contained"))


def acronym_of(spark, sf):
    return table(spark, sf, "entity_register").select("entity_id", text.acronym(F.col("entity_name")).alias("acronym"))


def predicate_tokens(spark, sf):
    return _claims(spark, sf, "predicate").groupBy(F.array_join(text.content_words(F.col("predicate")), " ").alias("words")).agg(F.count("*").alias("claims"))


def predicate_jaccard(spark, sf):
    w = lambda c: F.array_distinct(text.content_words(F.col(c)))
    return _raw_pairs(spark, sf, "predicate").select("relation_id", F.round(text.jaccard(w("a_predicate"), w("b_predicate")), 4).alias("jaccard"))


def antonym_conflict(spark, sf):
    w = lambda c: text.content_words(F.col(c))
    return _raw_pairs(spark, sf, "predicate").select("relation_id", text.opposed_words(w("a_predicate"), w("b_predicate")).alias("opposed"))


def more_specific(spark, sf):
    w = lambda c: text.content_words(F.col(c))
    return _raw_pairs(spark, sf, "predicate").groupBy(text.refines(w("a_predicate"), w("b_predicate")).alias("direction")).agg(F.count("*").alias("pairs"))


# Matching, verdicts.

BLOCKED = ("doc_id", "subject", "predicate", "value", "value_num", "unit", "ctx_unit", "quarantined", "created_at")


def same_entity_fuzzy(spark, sf):
    return matching.with_entity_gate(_pairs(spark, sf)).select("relation_id", "ent_ok", "ent_score")


def same_predicate_fuzzy(spark, sf):
    return matching.with_predicate_gate(_pairs(spark, sf)).select("relation_id", "pred_verdict", "pred_score")


def entity_clusters(spark, sf):
    return matching.cluster_entities(_claims(spark, sf, "subject").select("subject"))


def candidate_pairs_topk(spark, sf):
    return matching.candidate_pairs(matching.blocked_claims(_claims(spark, sf, *BLOCKED)))


def candidate_pairs_incremental(spark, sf):
    claims = _claims(spark, sf, *BLOCKED)
    new = claims.filter("created_at >= 1748736000").select(F.col("claim_id").alias("id"))
    return matching.candidate_pairs(matching.blocked_claims(claims), new=new)


def candidate_pairs_clustered(spark, sf):
    claims = _claims(spark, sf, *BLOCKED)
    return matching.candidate_pairs(matching.blocked_claims(claims, matching.cluster_entities(claims.select("subject"))))


def pair_ids_sha(spark, sf):
    return _relations(spark, sf, "claim_a_id", "claim_b_id").filter("claim_a_id is not null and claim_b_id is not null").select("relation_id", matching.pair_id("claim_a_id", "claim_b_id").alias("pair_id"))


def unit_check(spark, sf):
    return cascade.both_sides(_pairs(spark, sf)).select("relation_id", cascade.unit_verdict().alias("verdict"))


def value_check(spark, sf):
    x = cascade.both_sides(_pairs(spark, sf)).filter("a_x is not null or b_x is not null")
    return x.select("relation_id", cascade.value_verdict(F.lit(0.0), cascade.Tolerance()).alias("verdict"))


def _scored(spark, sf):
    """Stored relations that pass the gates, with the similarity of their texts."""
    rows = cascade.gated(_pairs(spark, sf)).filter("ent_ok and pred_verdict <> 'different'")
    return cascade.with_text_scores(rows, F.lit(True))


def text_field_check(spark, sf):
    """Context fields of pairs that pass the gates, by their similarity."""
    t = cascade.Tolerance()
    verdicts = [cascade.field_verdict(F.col(f"a_ctx_{f}"), F.col(f"b_ctx_{f}"), F.col(f"s_{f}"), f == "scope", t).alias(f"{f}_v") for f in cascade.FIELDS]
    return _scored(spark, sf).select("relation_id", *verdicts)


def value_check_all(spark, sf):
    """Values of pairs that pass the gates, texts by their similarity."""
    return _scored(spark, sf).select("relation_id", cascade.value_verdict(F.coalesce("s_value", F.lit(1.0)), cascade.Tolerance()).alias("verdict"))


def cascade_verdicts(spark, sf):
    return cascade.compare(_pairs(spark, sf).drop("relation_id", "a_id", "b_id")).select("relation_id", "kind", "rule_id", "confidence", "value_agreement", "escalate")


def verdicts_by_rule(spark, sf):
    return cascade.compare(_pairs(spark, sf).drop("relation_id", "a_id", "b_id")).groupBy("rule_id", "kind").agg(F.count("*").alias("pairs"))


def _judged_candidates(spark, sf):
    claims = _claims(spark, sf, *{*BLOCKED, *cascade.COMPARED, "quarantined"})
    return cascade.compare(cascade.sides(matching.candidate_pairs(matching.blocked_claims(claims)), claims).drop("a_id", "b_id"))


def candidate_verdicts(spark, sf):
    """The blocked candidates judged: nearly all pass the gates, so the rules behind them are met."""
    return _judged_candidates(spark, sf).select("relation_id", "kind", "rule_id", "confidence", "value_agreement", "escalate")


def candidate_rules(spark, sf):
    return _judged_candidates(spark, sf).groupBy("rule_id", "kind").agg(F.count("*").alias("pairs"))


def status_verdicts(spark, sf):
    pairs = _pairs(spark, sf).drop("relation_id", "a_id", "b_id").filter("lower(trim(a_predicate)) = 'status' and lower(trim(b_predicate)) = 'status'")
    return cascade.compare(pairs).select("relation_id", "kind", "rule_id")


def context_differences(spark, sf):
    out = cascade.compare(_pairs(spark, sf).drop("relation_id", "a_id", "b_id"))
    return out.select("relation_id", F.explode(F.map_keys("context_diff")).alias("field"))


def counterfactual_changes(spark, sf):
    return engine(spark, sf).counterfactuals()


def replay_drift(spark, sf):
    return cascade.replay(_relations(spark, sf, "claim_a_id", "claim_b_id", "kind", "rule_id"), _claims(spark, sf, *cascade.COMPARED)).groupBy("old_kind", "kind").agg(F.count("*").alias("pairs"))


def component_sibling_sums(spark, sf):
    return cascade.confirm_components(_relations(spark, sf, "claim_a_id", "claim_b_id", "rule_id"), _claims(spark, sf, *cascade.COMPARED)).select("relation_id", "parts", "confirmed")


def relate_all(spark, sf):
    return engine(spark, sf).relate().select("relation_id", "claim_a_id", "claim_b_id", "kind", "rule_id", "confidence")


def score_claims(spark, sf):
    return grounding.score(_claims(spark, sf, "extraction_confidence", "grounding_score", "grounded", "value_in_span", "page_shift")).select("claim_id", "grounding_conf", "combined", "is_quarantined", "is_review")


# Text of pages.


def line_offsets(spark, sf):
    return extraction.page_lines(_passages(spark, sf)).select("page_no", "line_no", "char_start", "char_end")


def furniture_lines(spark, sf):
    return extraction.furniture(extraction.page_lines(_passages(spark, sf)), 0.02, 3).select("doc_id", "text", "on_pages")


def sentence_counts(spark, sf):
    return extraction.sentences(_passages(spark, sf)).groupBy("page_no").agg(F.count("*").cast("int").alias("sentences"))


def value_mentions(spark, sf):
    found = F.regexp_extract_all("raw", F.lit(f"(?i)({extraction.VALUE})"), F.lit(1))
    return _passages(spark, sf).select("page_no", F.size(found).alias("mentions"))


def headings_before(spark, sf):
    """Lines in capitals serve as headings here: the corpus has no type sizes."""
    lines = extraction.page_lines(_passages(spark, sf)).withColumn("is_heading", (F.upper("text") == F.col("text")) & F.col("text").rlike("[A-Z]{4}"))
    return extraction.heading_before(lines).filter("heading is not null").groupBy("page_no").agg(F.count("*").alias("lines"), F.countDistinct("heading").alias("headings"))


def end_matter_pages(spark, sf):
    """A customer's orders as a document of pages; pages of orders in part delivered have a heading as end matter has."""
    head = F.when(F.col("o_orderstatus") == "P", "7. References:").otherwise("Body")
    pages = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("page_no"), F.concat_ws("\n", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), head).alias("raw"))
    return extraction.end_matter(extraction.page_lines(pages), pages)


def marked_headings(spark, sf):
    """Line items as lines of type: quantities are sizes, returned ones are bold."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.concat(F.lit("shipped on the "), F.date_format("l_shipdate", "dd"), F.lit(" "), "l_linestatus").alias("text"), F.col("l_quantity").cast("double").alias("size"), (F.col("l_returnflag") == "R").alias("bold"))
    return extraction.headings(lines).groupBy("doc_id").agg(F.count_if("is_heading").alias("headings"), F.count("*").alias("lines"))


def proper_noun_counts(spark, sf):
    found = extraction.proper_nouns(extraction.page_lines(_passages(spark, sf)))
    return found.groupBy("doc_id", "phrase").agg(F.count("*").alias("mentions"), F.countDistinct("page_no").alias("pages"), F.count_if("articled").alias("articled"))


def detected_entities(spark, sf):
    return extraction.detect_entities(extraction.page_lines(_pages(spark, sf))).select("doc_id", "primary", F.size("known").alias("known"))


def extracted_claims(spark, sf):
    return extraction.extract_claims(_pages(spark, sf)).select("doc_id", "page_no", "subject", "predicate", "value", "value_num", "ctx_period", "extraction_rule")


def ingest_pages(spark, sf):
    return engine(spark, sf).ingest(_pages(spark, sf)).select("claim_id", "grounded", "grounding_score", "is_quarantined", "is_review")


def grounded_spans(spark, sf):
    """Evidence of the stored claims looked up in the pages of their documents."""
    claims = _claims(spark, sf, "doc_id", "value", "span_page", "span_text", "origin", "char_start", "char_end").withColumn("doc_id", clean_key("doc_id"))
    return grounding.ground(claims, _pages(spark, sf)).groupBy("located", "note").agg(F.count("*").alias("claims"))


def grounded_exactly(spark, sf):
    """Evidence that is on its page or close by, word for word."""
    claims = _claims(spark, sf, "doc_id", "value", "span_page", "span_text", "origin").withColumn("doc_id", clean_key("doc_id"))
    found = grounding.ground(claims, _pages(spark, sf)).filter("note in ('exact match', 'row label and value on the page', 'value on the page, row label not', 'value not on the page', 'page not found', 'evidence too short')")
    return found.select("claim_id", "page", "score", "note")


# Grids.


def _grids(spark, sf):
    """Quantities of line items by return flag and year, laid out as tables, one per ship month."""
    items = table(spark, sf, "lineitem").select(F.month("l_shipdate").alias("grid_id"), "l_returnflag", F.year("l_shipdate").alias("y"), F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    sums = items.groupBy("grid_id", "l_returnflag", "y").agg(F.sum("q").alias("q"))
    years = sums.groupBy("grid_id").agg(F.sort_array(F.collect_set("y")).alias("years"))
    held = sums.groupBy("grid_id", "l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("y", F.col("q").cast("string").alias("q")))).alias("of")).join(years, "grid_id")
    label = F.array(F.concat(F.lit("flag "), "l_returnflag", F.lit(" quantity")))
    row = F.concat(label, F.transform("years", lambda y: F.coalesce(F.try_element_at("of", y), F.lit(""))))
    rows = held.groupBy("grid_id", "years").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    head = F.concat(F.array(F.lit("(million)")), F.transform("years", lambda y: F.concat(F.lit("FY"), y.cast("string"))))
    return rows.select("grid_id", F.concat(F.array(head), "rows").alias("cells"))


def grid_scores(spark, sf):
    return _grids(spark, sf).select("grid_id", F.round(grids.grid_score(F.col("cells")), 6).alias("score"))


def grid_claims(spark, sf):
    return grids.unpivot_grids(_grids(spark, sf), "grid_id")


def _words(spark, sf):
    cells = _grids(spark, sf).select("grid_id", F.posexplode("cells").alias("r", "row")).select("grid_id", "r", F.posexplode("row").alias("c", "cell"))
    words = cells.select("grid_id", "r", "c", F.posexplode(F.split("cell", " ")).alias("w", "text"))
    x0 = F.col("c") * 200.0 + F.col("w") * 55.0
    return words.select("grid_id", x0.alias("x0"), (F.col("r") * 14.0).alias("y0"), (x0 + 50.0).alias("x1"), (F.col("r") * 14.0 + 10.0).alias("y1"), "text")


def word_grids(spark, sf):
    """The same tables taken apart into positioned words and put together again."""
    return grids.reconstruct(_words(spark, sf), ["grid_id"]).select("grid_id", F.size("cells").alias("rows"), F.size(F.get("cells", F.lit(0))).alias("cols"))


# Building blocks.


def chunked_pages(spark, sf):
    parts = strategies.chunks(_pages(spark, sf), 4000)
    return parts.select("doc_id", "chunk", "first_page", "last_page", F.length("text").alias("chars"))


def gap_pages(spark, sf):
    claims = _claims(spark, sf, "doc_id", "span_page").select(clean_key("doc_id").alias("doc_id"), "span_page")
    return strategies.gap_pages(_pages(spark, sf), claims).select("doc_id", "page_no")


def ingest_report(spark, sf):
    claims = _claims(spark, sf, "doc_id", "quarantined", "needs_review", "origin").withColumn("doc_id", clean_key("doc_id"))
    return review.ingest_report(claims, _pages(spark, sf))


def relate_report(spark, sf):
    return review.relate_report(_relations(spark, sf, "kind", "decided_by", "rule_id").filter("kind is not null"))


def mode_report(spark, sf):
    return review.mode_report(_claims(spark, sf, "quarantined", "origin"), _relations(spark, sf, "kind", "decided_by"), "stored")


def adjudication_budget(spark, sf):
    """Which open verdicts a budget of 200 puts to the judge."""
    open_rules = [r[0] for r in lexicon.RULES if r[3]]
    rels = _relations(spark, sf, "rule_id", "match_confidence").withColumn("escalate", F.coalesce(F.col("rule_id").isin(open_rules), F.lit(False)))
    return review.within_budget(rels).select("relation_id", "chosen")


def judged_relations(spark, sf):
    """Open verdicts put to a judge that calls every one of them reconciled."""
    open_rules = [r[0] for r in lexicon.RULES if r[3]]
    rels = _relations(spark, sf, "kind", "rule_id", "decided_by", "match_confidence", "relationship_confidence", "confidence", "reasoning_trace")
    asked = rels.withColumn("escalate", F.coalesce(F.col("rule_id").isin(open_rules), F.lit(False)))
    return review.adjudicate(asked, lambda row: {"kind": "reconciled", "confidence": 0.75}).select("relation_id", "kind", "decided_by", "relationship_confidence")


def claim_detail(spark, sf):
    """The claim with the smallest id, and how many relations it has."""
    first = _claims(spark, sf, "subject").agg(F.min("claim_id")).first()[0]
    return engine(spark, sf).claim(first).select("claim_id", "subject", F.size("relations").alias("relations"))


def claims_of_document(spark, sf):
    first = _claims(spark, sf, "doc_id").agg(F.min(clean_key("doc_id"))).first()[0]
    return engine(spark, sf).claims(doc_id=first, limit=None, columns=("final_confidence",)).select("claim_id", "final_confidence")


def embedding_scan(spark, sf):
    return files.embeddings(_claims(spark, sf, "embedding"), 64).select("claim_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


def embedded_texts(spark, sf):
    return _claims(spark, sf, "subject", "predicate").groupBy(files.embedded_text(F.col("subject"), F.col("predicate")).alias("text")).agg(F.count("*").alias("claims"))


def evidence_boxes(spark, sf):
    """The union of the boxes of a document's evidence, page by page."""
    rows = _claims(spark, sf, "doc_id", "span_page", "bbox").filter("bbox is not null")
    return rows.groupBy(clean_key("doc_id").alias("doc_id"), "span_page").agg(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))


def export_claims_sample(spark, sf):
    rows = store.export_claims(_claims(spark, sf, "origin", "needs_review", "quarantined", "final_confidence"), 100)
    return rows.select("claim_id", "origin", "final_confidence")


def arrivals_by_day(spark, sf):
    days = incremental.arrivals(table(spark, sf, "claims"))
    return days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "origin", "claims")


def stream_first_deliveries(spark, sf):
    """Claims read as a stream, those delivered again left out, written by a file sink and read back."""
    source = spark.readStream.schema(table(spark, sf, "claims").schema).parquet(f"{sf}/claims.parquet*")
    where = f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    first = incremental.first_deliveries(source).select("claim_id", "origin")
    first.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out").select("claim_id", "origin")


def selected_tables(spark, sf):
    """Tables put together from words, the best of each page."""
    found = grids.reconstruct(_words(spark, sf), ["grid_id"]).withColumn("source", F.lit("words"))
    return grids.select_tables(found, ["grid_id"]).select("grid_id", "header_rows", F.size("header").alias("columns"), F.size("body").alias("rows"))


BLOCKS = [
    chunked_pages, gap_pages, ingest_report, relate_report, mode_report, adjudication_budget, judged_relations, claim_detail, claims_of_document, embedding_scan, embedded_texts, evidence_boxes,
    export_claims_sample, arrivals_by_day, stream_first_deliveries, selected_tables,
]
CORE = [
    claims_latest, documents_latest, relations_latest, documents_completed, delete_document_cascade, claims_by_ids, claims_filtered, claims_search, claims_top_confidence, claims_comparable,
    quarantine_split, claim_counts, claims_by_origin, document_claim_counts, relations_cross_document, relations_top, relations_of_document, relations_enriched, relations_by_kind,
    relations_missing_side, stats_dashboard, grounding_profile, decided_by_share, dedupe_best_confidence, review_buckets, evidence_choice, stated_context, context_diff_view,
    export_sample_relations, best_two_per_kind, worst_flagged, nested_as_json, parse_value_number, parse_value_parts, unit_signature, unit_labels, precision_half_unit, measure_kinds,
    numbers_in_text, period_signature, period_compare_pairs, period_precedes, entity_normalize, entity_containment, acronym_of, predicate_tokens, predicate_jaccard, antonym_conflict,
    more_specific, same_entity_fuzzy, same_predicate_fuzzy, entity_clusters, candidate_pairs_topk, candidate_pairs_incremental, candidate_pairs_clustered, pair_ids_sha, unit_check, value_check,
    text_field_check, value_check_all, cascade_verdicts, verdicts_by_rule, candidate_verdicts, candidate_rules, status_verdicts, context_differences, counterfactual_changes, replay_drift, component_sibling_sums, relate_all, score_claims,
    line_offsets, furniture_lines, sentence_counts, value_mentions, headings_before, end_matter_pages, marked_headings, proper_noun_counts, detected_entities, extracted_claims, ingest_pages, grounded_spans, grounded_exactly,
    grid_scores, grid_claims, word_grids,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*CORE, *BLOCKS, p4_found, p4_unstated, p4_status, p5_found, p5_report)}
