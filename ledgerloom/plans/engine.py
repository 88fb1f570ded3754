"""The engine's read and build routes, one method each, every one returning a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import clean_key
from ledgerloom.operators import cascade, extraction, grounding, matching
from ledgerloom.sources.scratch import save
from ledgerloom.sources.store import latest

CONTEXT = ("period", "unit", "scope", "basis", "geography", "as_of", "denominator", "other")


class Engine:
    """Over the tables of documents, claims and relations as they were delivered; the latest row of a key counts.

    ``columns`` of a method are those its result needs: nothing else is read.
    """

    def __init__(self, documents: DataFrame, claims: DataFrame, relations: DataFrame):
        self._documents, self._claims, self._relations = documents, claims, relations

    def claim_rows(self, *columns: str) -> DataFrame:
        return latest(self._claims, "claim_id", "created_at", list(columns) or None)

    def relation_rows(self, *columns: str) -> DataFrame:
        """Latest relations with their keys and kinds cleaned."""
        rows = latest(self._relations, "relation_id", "created_at", list(columns) or None)
        return rows.withColumns({c: clean_key(c) for c in ("kind", "claim_a_id", "claim_b_id") if c in rows.columns})

    def document_rows(self, *columns: str) -> DataFrame:
        return latest(self._documents, "doc_id", "ingested_at", list(columns) or None)

    def documents(self, *columns: str) -> DataFrame:
        """Every document with its number of claims, newest first."""
        counts = self.claim_rows("doc_id").groupBy(clean_key("doc_id").alias("doc_id")).agg(F.count("*").alias("claim_count"))
        docs = self.document_rows(*({*columns, "ingested_at"} if columns else ())).join(counts, "doc_id", "left").fillna(0, ["claim_count"])
        return docs.orderBy(F.desc("ingested_at"), "doc_id")

    def claims(self, doc_id=None, needs_review=None, quarantined=None, origin=None, search=None, limit: int | None = 200, offset: int = 0, columns: tuple[str, ...] = ()) -> DataFrame:
        """Claims by optional conditions, most confident first. ``search`` is a substring of subject, predicate or value, in any case."""
        asked = {name: want for name, want in (("needs_review", needs_review), ("quarantined", quarantined), ("origin", origin)) if want is not None}
        read = {*columns, *asked, "final_confidence", *(["doc_id"] if doc_id is not None else []), *(["subject", "predicate", "value"] if search else [])} if columns else ()
        rows = self.claim_rows(*read)
        if doc_id is not None:
            rows = rows.filter(clean_key("doc_id") == doc_id)
        for name, want in asked.items():
            rows = rows.filter(F.col(name) == want)
        if search:
            rows = rows.filter(F.col("subject").ilike(f"%{search}%") | F.col("predicate").ilike(f"%{search}%") | F.col("value").ilike(f"%{search}%"))
        rows = rows.orderBy(F.desc_nulls_last("final_confidence"), "claim_id")
        return rows if limit is None else rows.offset(offset).limit(limit)

    def claim(self, claim_id: str) -> DataFrame:
        """One claim with its relations, most confident first."""
        ends = self.relation_rows("confidence", "kind", "claim_a_id", "claim_b_id").filter((F.col("claim_a_id") == claim_id) | (F.col("claim_b_id") == claim_id))
        own = ends.agg(F.sort_array(F.collect_list(F.struct("confidence", "relation_id", "kind")), asc=False).alias("relations"))
        return self.claim_rows().filter(F.col("claim_id") == claim_id).join(F.broadcast(own))

    def relations(self, kind=None, doc_id=None, cross_document: bool = True, limit: int | None = 200, offset: int = 0, columns: tuple[str, ...] = ()) -> DataFrame:
        """Relations with the documents of both claims; unrelated pairs only on demand."""
        claims = self.claim_rows("doc_id")
        a = claims.select(F.col("claim_id").alias("claim_a_id"), clean_key("doc_id").alias("a_doc_id"))
        b = claims.select(F.col("claim_id").alias("claim_b_id"), clean_key("doc_id").alias("b_doc_id"))
        rows = self.relation_rows(*({*columns, "kind", "claim_a_id", "claim_b_id", "confidence", "similarity"} if columns else ()))
        rows = rows.filter(F.col("kind") == kind) if kind else rows.filter("kind <> 'unrelated'")
        rows = rows.join(a, "claim_a_id").join(b, "claim_b_id")
        if cross_document:
            rows = rows.filter("a_doc_id <> b_doc_id")
        if doc_id:
            rows = rows.filter((F.col("a_doc_id") == doc_id) | (F.col("b_doc_id") == doc_id))
        rows = rows.orderBy(F.desc_nulls_last("confidence"), F.desc_nulls_last("similarity"), "relation_id")
        return rows if limit is None else rows.offset(offset).limit(limit)

    def enriched(self, columns: tuple[str, ...] = ()) -> DataFrame:
        """Relations with both claims, whole or their ``columns``; a claim that is missing is null."""
        claims = self.claim_rows(*columns)
        a = claims.select(F.col("claim_id").alias("claim_a_id"), F.struct("*").alias("claim_a"))
        b = claims.select(F.col("claim_id").alias("claim_b_id"), F.struct("*").alias("claim_b"))
        rows = self.relation_rows(*(("kind", "claim_a_id", "claim_b_id") if columns else ()))
        return rows.join(a, "claim_a_id", "left").join(b, "claim_b_id", "left")

    def counterfactuals(self, relation_id: str | None = None) -> DataFrame:
        """Verdicts that change when one context field is left out, of one relation or of all."""
        rows = self.relation_rows("claim_a_id", "claim_b_id")
        rows = rows.filter(F.col("relation_id") == relation_id) if relation_id else rows
        pairs = rows.select(F.col("claim_a_id").alias("a_id"), F.col("claim_b_id").alias("b_id"))
        return cascade.counterfactuals(cascade.sides(pairs, self.claim_rows(*cascade.COMPARED)).drop("a_id", "b_id"))

    def stats(self) -> DataFrame:
        """One row of totals."""
        docs = self.document_rows("status").agg(F.count("*").alias("documents"))
        claims = self.claim_rows("needs_review", "quarantined", "origin", "grounded").agg(F.count("*").alias("claims"), F.count_if("needs_review").alias("needs_review"), F.count_if("quarantined").alias("quarantined"), F.count_if(F.col("origin") == "table").alias("from_tables"), F.count_if(F.col("grounded")).alias("grounded"))
        rels = self.relation_rows("kind", "decided_by").agg(F.count("*").alias("relations"), F.count_if(F.col("kind") == "contradiction").alias("contradictions"), F.count_if(F.col("decided_by") == "llm").alias("by_model"))
        # One row each.
        return docs.join(F.broadcast(claims)).join(F.broadcast(rels))

    def candidates(self, new_ids: DataFrame | None = None, fuzzy_names: bool = True) -> DataFrame:
        """Pairs of ``cascade.sides`` worth comparing. Claims are read and prepared once and written down: blocking and both sides use them."""
        kept = self.claim_rows(*cascade.COMPARED, "quarantined").filter(~F.coalesce("quarantined", F.lit(False)))
        claims = save(cascade.prepared_claims(kept))
        clusters = matching.cluster_entities(claims.select("subject")) if fuzzy_names else None
        return cascade.sides(matching.candidate_pairs(matching.blocked(claims, clusters), new=new_ids), claims).drop("a_id", "b_id")

    def relate(self, new_ids: DataFrame | None = None, fuzzy_names: bool = True) -> DataFrame:
        """Relations between claims of different documents, judged anew; unrelated pairs are left out. Parts that add up
        to their whole are confirmed.

        With ``new_ids`` (id) only pairs with one of these claims are built, the incremental form.
        """
        return cascade.with_confirmed_components(cascade.compare(self.candidates(new_ids, fuzzy_names), unrelated=False))

    def ingest(self, pages: DataFrame) -> DataFrame:
        """Claims of new pages (doc_id, page_no, raw), grounded and scored."""
        found = extraction.extract_claims(pages)
        found = found.withColumns({"grounding_page": F.col("page_no"), "span_page": F.col("page_no")})
        found = found.withColumn("claim_id", matching.claim_key())
        found = found.groupBy("claim_id").agg(F.min_by(F.struct(*[c for c in found.columns if c != "claim_id"]), F.struct("page_no", "char_start")).alias("x")).select("claim_id", "x.*")
        found = save(found)
        located = grounding.ground(found, pages).select("claim_id", F.col("located").alias("grounded"), F.col("score").alias("grounding_score"), F.col("page").alias("found_page"), "page_shift", "value_in_span", F.col("note").alias("grounding_note"))
        return grounding.score(found.join(located, "claim_id"))
