"""Ways to get claims out of pages: by rules, by a model, or by rules with a model for the pages they leave empty.

A model is a function given by the caller; nothing here reaches a network. It is called in the workers, once per chunk
of pages, and whatever it raises or returns that can't be read becomes a row of errors, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import extraction

CHUNK_CHARS, GAP_DIGITS, GAP_PAGES = 12_000, 40, 15
MODEL_CLAIM = (
    "subject string, predicate string, value string, ctx_period string, ctx_unit string, ctx_scope string, ctx_other string, span_page int, span_text string, origin string, "
    "extraction_rule string, extraction_confidence double"
)
# Gets the text of a chunk, returns claims as dicts or as the text of a JSON object with "claims".
Model = Callable[[str], "list[dict] | dict | str"]


class NeedsModel(ValueError):
    """A strategy that needs a model was asked for without one, or where models are forbidden."""


def chunks(pages: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, chunk, first_page, last_page, text: whole pages packed in order, as many as fit into ``most`` characters.

    A page is headed by its number and never split; one that is too long by itself is a chunk of its own. Blank pages are
    left out. Packing runs over the lengths of a document's pages alone, a few bytes each; the texts join it afterwards.
    """
    blank = F.lit(" \t\r\n\u000b\f")
    body = pages.filter("raw is not null").select("doc_id", "page_no", F.btrim("raw", blank).alias("_b")).filter("_b <> ''")
    block = F.concat(F.lit("\n<<<PAGE "), F.col("page_no").cast("string"), F.lit(">>>\n"), "_b", F.lit("\n"))
    blocks = body.select("doc_id", "page_no", block.alias("block"))
    lengths = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", F.length("block").alias("n")))).alias("ps"))

    def step(a, p):
        fits = (a["size"] == 0) | (a["size"] + p["n"] <= most)
        number = F.when(fits, a["chunk"]).otherwise(a["chunk"] + 1)
        size = F.when(fits, a["size"] + p["n"]).otherwise(p["n"])
        return F.struct(size.alias("size"), number.alias("chunk"), F.concat(a["of"], F.array(F.struct(p["page_no"].alias("page_no"), number.alias("chunk")))).alias("of"))

    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("chunk"), F.array().cast("array<struct<page_no: int, chunk: int>>").alias("of"))
    packed = lengths.select("doc_id", F.explode(F.aggregate("ps", start, step, lambda a: a["of"])).alias("x")).select("doc_id", "x.*")
    joined = blocks.join(packed, ["doc_id", "page_no"]).groupBy("doc_id", "chunk")
    texts = F.sort_array(F.collect_list(F.struct("page_no", "block")))
    return joined.agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.array_join(F.transform(texts, lambda x: x["block"]), "").alias("text"))


def gap_pages(pages: DataFrame, claims: DataFrame, digits: int = GAP_DIGITS, most: int = GAP_PAGES) -> DataFrame:
    """Pages with many digits of which there is no claim: the first ``most`` of each document, which is the rule's budget.

    claims: doc_id, span_page.
    """
    figures = F.length("raw") - F.length(F.regexp_replace("raw", r"\d", ""))
    covered = claims.select("doc_id", F.col("span_page").alias("page_no")).distinct()
    open_pages = pages.filter(figures > digits).join(covered, ["doc_id", "page_no"], "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    return open_pages.withColumn("_n", first).filter(F.col("_n") <= most).drop("_n")


def _flat(said: dict) -> tuple:
    """A claim as a model tells it, as a row of MODEL_CLAIM; what models aren't asked for stays null."""
    context = said.get("context") or {}
    text = lambda x: None if x is None else str(x)
    sure = min(1.0, max(0.0, float(said["confidence"])))
    return (str(said["subject"]), str(said["predicate"]), str(said["value"]), text(context.get("period")), text(context.get("unit")), text(context.get("scope")), text(context.get("other_qualifiers")),
            int(said["source_page"]), str(said["source_text"]), "llm", "llm_chunk_extraction", sure)


def _told(answer: list | dict | str) -> list[dict]:
    """Claims in an answer, which may be text with a JSON object in it, fenced or not."""
    if isinstance(answer, str):
        at, end = answer.find("{"), answer.rfind("}")
        answer = json.loads(answer[at : end + 1])
    return list(answer["claims"] if isinstance(answer, dict) else answer)


def ask_model(parts: DataFrame, model: Model) -> DataFrame:
    """doc_id, the columns of MODEL_CLAIM and error: what ``model`` says of every chunk (doc_id, chunk, text).

    A chunk it fails on gives one row with an error and no claim; a claim that can't be read likewise.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MODEL_CLAIM.split(", ")]
        for pdf in batches:
            rows = []
            for doc, number, text in zip(pdf["doc_id"], pdf["chunk"], pdf["text"]):
                try:
                    said = _told(model(text))
                except Exception as e:  # whatever the caller's function raises
                    rows.append((doc, *[None] * len(names), f"chunk {number}: {type(e).__name__}: {e}"))
                    continue
                for one in said:
                    try:
                        rows.append((doc, *_flat(one), None))
                    except (KeyError, TypeError, ValueError, AttributeError) as e:
                        rows.append((doc, *[None] * len(names), f"chunk {number}: unreadable claim: {type(e).__name__}"))
            out = pd.DataFrame(rows, columns=["doc_id", *names, "error"])
            yield out.astype({"span_page": "Int32", "extraction_confidence": "float64"})

    return parts.select("doc_id", "chunk", "text").mapInPandas(run, f"doc_id string, {MODEL_CLAIM}, error string")


@dataclass(frozen=True)
class ByRules:
    """Claims of sentences and status changes by rules alone."""

    name = "deterministic"

    def extract(self, pages: DataFrame) -> DataFrame:
        return extraction.extract_claims(pages).withColumns({"span_page": F.col("page_no"), "error": F.lit(None).cast("string")})


@dataclass(frozen=True)
class ByModel:
    """Claims a model finds in chunks of pages."""

    model: Model
    most: int = CHUNK_CHARS
    name = "llm"

    def extract(self, pages: DataFrame) -> DataFrame:
        return ask_model(chunks(pages, self.most), self.model)


@dataclass(frozen=True)
class Hybrid:
    """By rules, and by a model on the pages full of figures that the rules found nothing in."""

    model: Model
    pages_per_document: int = GAP_PAGES
    name = "hybrid"

    def extract(self, pages: DataFrame) -> DataFrame:
        by_rules = ByRules().extract(pages)
        gaps = gap_pages(pages, by_rules, most=self.pages_per_document)
        return by_rules.unionByName(ByModel(self.model).extract(gaps), allowMissingColumns=True)


def strategy(name: str = "deterministic", model: Model | None = None, strict: bool = False) -> ByRules | ByModel | Hybrid:
    """The strategy of a name. With ``strict`` nothing that reaches a model can be made."""
    name = name.strip().lower()
    if name in ("deterministic", "rules", "default"):
        return ByRules()
    if name not in ("llm", "hybrid"):
        raise ValueError(f"no strategy {name!r}: choose deterministic, hybrid or llm")
    if strict or model is None:
        raise NeedsModel(f"strategy {name!r} needs a model" + (", which strict mode forbids" if strict else ""))
    return ByModel(model) if name == "llm" else Hybrid(model)
