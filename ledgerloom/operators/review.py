"""Second opinions on verdicts the rules leave open, within a budget, and reports of what was built."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon
from ledgerloom.sources.scratch import save

BUDGET = 200
# The verdicts a judge may give.
VERDICTS = ("corroboration", "contradiction", "reconciled", "partial_cover", "supersedes", "underspecified", "unrelated")
# Gets a dict of the pair's columns, returns a dict with kind and, if it likes, confidence and explanation.
Judge = Callable[[dict], dict]
SHOWN = ["relation_id", "kind", "rule_id", "reasoning_trace"]


def within_budget(relations: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Open verdicts (``escalate``) with ``chosen``: whether they are among the ``budget`` surest matches, ties to the smaller id."""
    asked = relations.filter("escalate")
    chosen = asked.orderBy(F.desc_nulls_last("match_confidence"), "relation_id").limit(budget).select("relation_id", F.lit(True).alias("chosen"))
    return asked.join(F.broadcast(chosen) if budget <= 10_000 else chosen, "relation_id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def _noted(trace: Column, note: Column) -> Column:
    return F.concat(F.coalesce(trace, F.array().cast("array<string>")), F.array(note))


def adjudicate(relations: DataFrame, judge: Judge | None, budget: int = BUDGET, strict: bool = False) -> DataFrame:
    """Relations with open verdicts put to ``judge``, the surest matches first, at most ``budget`` of them.

    A judge's verdict replaces kind and relationship_confidence (0 to 1; 0.5 if it gives none that can be read), and confidence
    accordingly; decided_by is then ``llm``. A judge that fails or gives no known kind leaves the rule's verdict. Without a
    judge, in ``strict`` mode and beyond the budget the rule's verdict stands as well; the trace says which it was.
    Nothing else changes, and no relation is lost.
    """
    rows = save(relations)
    if judge is None or strict:
        why = "strict mode: no judge is asked" if strict else "no judge: the rule's verdict stands"
        return rows.withColumn("reasoning_trace", F.when(F.col("escalate"), _noted(F.col("reasoning_trace"), F.lit(why))).otherwise(F.col("reasoning_trace")))
    picked = within_budget(rows, budget)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    said = judge(row)
                    kind = said.get("kind")
                    note = None if kind in VERDICTS else "the judge gave no known verdict: the rule's stands"
                    try:
                        sure = min(1.0, max(0.0, float(said.get("confidence", 0.5))))
                    except (TypeError, ValueError):
                        sure = 0.5
                    out.append((row["relation_id"], kind if note is None else None, round(sure, 4), said.get("explanation"), note))
                except Exception as e:  # whatever the caller's function raises
                    out.append((row["relation_id"], None, None, None, f"the judge failed ({type(e).__name__}): the rule's verdict stands"))
            yield pd.DataFrame(out, columns=["relation_id", "_kind", "_sure", "_why", "_note"])

    said = picked.filter("chosen").select(*[c for c in picked.columns if c != "chosen"]).mapInPandas(ask, "relation_id string, _kind string, _sure double, _why string, _note string")
    said = save(said)
    joined = rows.join(said, "relation_id", "left").join(picked.select("relation_id", "chosen"), "relation_id", "left")
    judged = F.col("_kind").isNotNull()
    base = F.try_divide("confidence", "relationship_confidence")
    told = F.concat(F.lit("judged: "), "_kind", F.coalesce(F.concat(F.lit(", "), "_why"), F.lit("")))
    note = F.when(judged, told).when(F.col("_note").isNotNull(), F.col("_note")).when(~F.coalesce("chosen", F.lit(True)), "over the budget: not judged")
    out = joined.withColumns({
        "reasoning_trace": F.when(note.isNotNull(), _noted(F.col("reasoning_trace"), note)).otherwise(F.col("reasoning_trace")),
        "decided_by": F.when(judged, "llm").otherwise(F.col("decided_by")), "confidence": F.when(judged, F.round(F.coalesce(base, F.lit(0.0)) * F.col("_sure"), 4)).otherwise(F.col("confidence")),
        "relationship_confidence": F.when(judged, F.col("_sure")).otherwise(F.col("relationship_confidence")), "kind": F.when(judged, F.col("_kind")).otherwise(F.col("kind")),
    })
    return out.select(*relations.columns)


def ingest_report(claims: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per document: claims stored, grounded, quarantined, for review, by origin; and pages read where ``pages`` are given."""
    report = claims.groupBy("doc_id").agg(
        F.count("*").alias("stored"), F.count_if(~F.coalesce("quarantined", F.lit(False))).alias("grounded"), F.count_if("quarantined").alias("quarantined"), F.count_if("needs_review").alias("needs_review"),
        F.count_if(F.col("origin") == "table").alias("from_tables"), F.count_if(F.col("origin") == "llm").alias("by_model"),
    )
    if pages is None:
        return report
    read = pages.filter("raw is not null").groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages_read"))
    return read.join(report, "doc_id", "left").fillna(0, [c for c in report.columns if c != "doc_id"])


def relate_report(relations: DataFrame, compared: int | None = None) -> DataFrame:
    """One row per kind: relations, by_model, open (rules that may be looked at again); and its share of those compared."""
    open_rules = [r[0] for r in lexicon.RULES if r[3]]
    kinds = relations.groupBy("kind").agg(F.count("*").alias("relations"), F.count_if(F.col("decided_by") == "llm").alias("by_model"), F.count_if(F.col("rule_id").isin(open_rules)).alias("open"))
    whole = F.lit(compared).cast("long") if compared is not None else F.sum("relations").over(Window.partitionBy(F.lit(1)))
    return kinds.withColumn("percent_by_model", F.round(F.col("by_model") * 100.0 / F.greatest(F.lit(1), whole), 2))


def mode_report(claims: DataFrame, relations: DataFrame, mode: str) -> DataFrame:
    """The roll-up of one mode of building, one row; rows of several modes stand side by side after a union."""
    c = claims.agg(F.count("*").alias("claims"), F.count_if(~F.coalesce("quarantined", F.lit(False))).alias("grounded"), F.count_if("quarantined").alias("quarantined"), F.count_if(F.col("origin") == "table").alias("table_claims"), F.count_if(F.col("origin") == "llm").alias("model_claims"))
    kinds = ("corroboration", "contradiction", "reconciled", "partial_cover", "component_of_total", "supersedes", "underspecified")
    r = relations.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count_if(F.col("decided_by") == "llm").alias("by_model"))
    row = c.join(F.broadcast(r))  # one row each
    return row.select(F.lit(mode).alias("mode"), "*", F.round(F.col("by_model") * 100.0 / F.greatest(F.lit(1), F.col("claims")), 2).alias("percent_by_model"))
