"""Whether a claim's evidence stands in its document: by stages, each of which only sees what the one before left over.

1. A table cell must show its value (and row label) on its page.
2. Evidence with recorded offsets must be what stands there.
3. Other evidence is looked for exactly on its page and the three around it, by a join on document and page.
4. What is left is looked for exactly on any page of its document that has the rarest word of its inside.
5. What is left then is looked for by similarity on the pages that share a quarter of its words, found by the rarest
   of them (prefix filter); windows are scored in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import similarity, values
from ledgerloom.functions.keys import staged
from ledgerloom.sources.scratch import save

GROUNDED, REVIEW, NEAR_PAGES, PAD = 0.80, 0.60, 3, 100
# Evidence of fewer characters isn't looked for; a near match has a window of this ratio and this share of the evidence's words.
SHORTEST, NEAR, NEAR_WORDS = 8, 0.6, 0.25
_QUOTES, _PLAIN_QUOTES = "‘’‚“”„", "'''\"\"\""
SOFT_HYPHEN = "\u00ad"


def norm(text: Column) -> Column:
    """Text as it is compared: quotes and dashes plain, words cut at line ends joined, blanks collapsed, lower case."""
    t = F.translate(values.fold(text), _QUOTES + SOFT_HYPHEN, _PLAIN_QUOTES)
    t = F.regexp_replace(t, r"-\s*\n\s*(?=\p{L})", "")
    return F.lower(F.btrim(F.regexp_replace(t, r"\s+", " ")))


_SPACE = " \t\n\x0b\f\r"
_UNIT = re.compile(rf"(?P<cut>-[{_SPACE}]*\n[{_SPACE}]*(?=[^\W\d_]))|(?P<gap>[{_SPACE}]+)|(?P<none>{SOFT_HYPHEN})|(?P<one>.)", re.S)


def norm_map(raw: str) -> tuple[str, list[int]]:
    """``norm`` of a text with, for each of its characters, the offset of the character of the text it comes from."""
    plain = raw.translate(values.FOLDED).translate(str.maketrans(_QUOTES, _PLAIN_QUOTES))
    out: list[str] = []
    at: list[int] = []
    for m in _UNIT.finditer(plain):
        if m["one"]:
            for c in m["one"].lower():
                out.append(c)
                at.append(m.start())
        elif m["gap"] and out and out[-1] != " ":
            out.append(" ")
            at.append(m.start())
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


def raw_offsets(raw: Column, start: Column, end: Column) -> Column:
    """struct<lo, hi>: the part of a text that its normal form's characters [start, end) come from."""

    @F.pandas_udf("lo int, hi int")
    def back(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, ends in batches:
            rows = []
            for t, a, b in zip(texts, starts, ends):
                at = norm_map(t)[1] if t is not None and not pd.isna(a) else []
                lo = min(max(0, int(a)), len(at) - 1) if at else 0
                rows.append((at[lo], at[min(max(lo + 1, int(b)), len(at)) - 1] + 1) if at else (None, None))
            yield pd.DataFrame(rows, columns=["lo", "hi"]).astype("Int32")

    return back(raw, start, end)


def page_order(page: Column, claimed: Column) -> Column:
    """Search order: the claimed page, then up to three pages around it, earlier first, then all from the start."""
    away = F.abs(page - claimed)
    return F.when(away == 0, 0).when(away <= NEAR_PAGES, 2 * away - F.when(page < claimed, 1).otherwise(0)).otherwise(2 * NEAR_PAGES + page + 1)


def boxes_of(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(claim_id, bbox): the union of the boxes of all lines that the text [char_start, char_end) of a page touches.

    found: claim_id, doc_id, page, char_start, char_end. lines: doc_id, page_no, char_start, char_end, bbox STRUCT<x0, y0, x1, y1>.
    """
    ln = lines.select(F.col("doc_id").alias("_d"), F.col("page_no").alias("_p"), F.col("char_start").alias("_a"), F.col("char_end").alias("_b"), "bbox")
    on = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p"))
    touched = found.filter("char_start is not null").join(ln, on).filter((F.col("_a") < F.col("char_end")) & (F.col("_b") > F.col("char_start")))
    corner = lambda f, c: f(F.col(f"bbox.{c}")).alias(c)
    corners = touched.groupBy("claim_id").agg(corner(F.min, "x0"), corner(F.min, "y0"), corner(F.max, "x1"), corner(F.max, "y1"))
    return corners.select("claim_id", F.struct("x0", "y0", "x1", "y1").alias("bbox"))


RESULT = {"claim_id": "string", "located": "boolean", "score": "double", "page": "int", "page_shift": "int", "value_in_span": "boolean", "char_start": "int", "char_end": "int", "matched_text": "string", "note": "string"}


def _result(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("claim_id", *[columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in RESULT.items() if c != "claim_id"])


def _present(wanted: Column, around: Column) -> Column:
    """Whether all numbers of the value stand in the text; null if it has none."""
    return F.when(F.size(wanted) > 0, F.size(F.array_except(wanted, values.numbers_in(around))) == 0)


def _hit(df: DataFrame, score: Column, note: str) -> DataFrame:
    """Rows with page_no, norm, raw and the window [at, to) of norm that was found."""
    df = df.withColumn("_o", raw_offsets(F.col("raw"), F.col("at"), F.col("to")))
    around = F.substring("norm", F.greatest(F.lit(1), F.col("at") + 1 - PAD), F.col("to") - F.col("at") + 2 * PAD)
    text = F.btrim(F.substring("raw", F.col("_o.lo") + 1, F.col("_o.hi") - F.col("_o.lo")), F.lit(" \t\n\r"))
    return _result(df, located=F.lit(True), score=score, page=F.col("page_no"), page_shift=F.col("page_no") - F.col("span_page"), value_in_span=_present(F.col("wanted"), around), char_start=F.col("_o.lo"), char_end=F.col("_o.hi"), matched_text=text, note=F.lit(note))


def _first_page(tried: DataFrame, order: Column) -> DataFrame:
    """The best page of every claim, with the text of that page only."""
    keep = [c for c in tried.columns if c != "claim_id"]
    return tried.groupBy("claim_id").agg(F.min_by(F.struct(*keep), order).alias("x")).select("claim_id", "x.*")


def ground(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """The columns of ``RESULT`` of every claim.

    claims: claim_id, doc_id, value, span_page, span_text, origin, and char_start and char_end where the extractor recorded
    them. pages: doc_id, page_no, raw. Evidence of less than eight characters isn't looked for. A claim without document or
    pages isn't located. A match on several pages is taken from the first in search order.
    """
    for c in ("char_start", "char_end"):
        if c not in claims.columns:
            claims = claims.withColumn(c, F.lit(None).cast("int"))
    text = pages.filter("raw is not null").select("doc_id", "page_no", "raw", norm(F.col("raw")).alias("norm"))
    text = save(text.filter("norm <> ''"))
    text = text.select(F.col("doc_id").alias("_d"), "page_no", "raw", "norm")
    blank = lambda c, v: F.coalesce(c, F.lit(v))
    c = claims.select("claim_id", "doc_id", blank("value", "").alias("value"), blank("span_page", 1).alias("span_page"), blank("span_text", "").alias("quote"), blank("origin", "sentence").alias("origin"), F.col("char_start").cast("int").alias("lo"), F.col("char_end").cast("int").alias("hi"))
    c = save(c.withColumns({"q": norm(F.col("quote")), "v": norm(F.col("value")), "label": norm(F.get(F.split("quote", r"\|"), F.lit(0))), "wanted": values.numbers_in(F.col("value"))}))
    own_page = (F.col("doc_id") == F.col("_d")) & (F.col("span_page") == F.col("page_no"))

    cells = c.filter("origin = 'table'").join(text, own_page, "left")
    value_ok = blank((F.col("v") != "") & F.contains("norm", F.col("v")), False)
    label_ok = blank((F.col("label") != "") & F.contains("norm", F.col("label")), False)
    cell_note = F.when(F.col("norm").isNull(), "page not found").when(value_ok & label_ok, "row label and value on the page").when(value_ok, "value on the page, row label not").otherwise("value not on the page")
    cell_score = F.when(value_ok & label_ok, 1.0).when(value_ok, 0.7).otherwise(0.0)
    out = _result(cells, located=value_ok, score=cell_score, page=F.col("page_no"), page_shift=F.lit(0), value_in_span=F.when(value_ok, True), note=cell_note)

    prose = c.filter("origin <> 'table'")
    trimmed = lambda t: F.btrim(t, F.lit(" \t\n\r"))
    there = prose.filter("lo is not null and hi > lo").join(text, own_page)
    there = there.filter((trimmed(F.substring(F.col("raw"), F.col("lo") + 1, F.col("hi") - F.col("lo"))) == trimmed(F.col("quote"))) & (trimmed(F.col("quote")) != ""))
    padded = F.substring(F.col("raw"), F.greatest(F.lit(1), F.col("lo") + 1 - PAD), F.col("hi") + PAD - F.greatest(F.lit(0), F.col("lo") - PAD))
    recorded = save(_result(there, located=F.lit(True), score=F.lit(1.0), page=F.col("page_no"), page_shift=F.lit(0), value_in_span=_present(F.col("wanted"), padded), char_start=F.col("lo"), char_end=F.col("hi"), matched_text=trimmed(F.col("quote")), note=F.lit("recorded span")))

    searched = prose.join(recorded.select("claim_id"), "claim_id", "left_anti")
    short = _result(searched.filter(F.length(F.btrim("quote")) < SHORTEST), located=F.lit(False), score=F.lit(0.0), note=F.lit("evidence too short"))
    long_ = searched.filter(F.length(F.btrim("quote")) >= SHORTEST).filter("q <> ''").drop("lo", "hi", "v", "label", "value", "origin", "quote")
    exact = lambda df: df.withColumn("at", F.instr(F.col("norm"), F.col("q")) - 1).filter("at >= 0").withColumn("to", F.col("at") + F.length("q"))
    rank = page_order(F.col("page_no"), F.col("span_page"))

    around = long_.withColumn("page_no", F.explode(F.sequence(F.col("span_page") - NEAR_PAGES, F.col("span_page") + NEAR_PAGES)))
    close = exact(around.join(text.withColumnRenamed("page_no", "_n"), (F.col("doc_id") == F.col("_d")) & (F.col("page_no") == F.col("_n"))))
    near_by = save(_hit(_first_page(close, rank), F.lit(1.0), "exact match"))

    # Words of pages and how many pages of a document have each: what rare words are looked up in.
    left = save(long_.join(near_by.select("claim_id"), "claim_id", "left_anti"))
    docs = left.select(F.col("doc_id").alias("_d")).distinct()
    words = text.join(docs, "_d", "left_semi").select("_d", "page_no", F.explode(F.array_distinct(F.split("norm", " "))).alias("w"))
    words = save(words)
    seen = words.groupBy("_d", "w").agg(F.count("*").alias("df"))
    asked = left.select("claim_id", "doc_id", F.array_distinct(F.split("q", " ")).alias("ws"), F.split("q", " ").alias("all"))
    # The first and last word of a quote may be parts of words on the page.
    inner = F.array_distinct(F.slice("all", F.lit(2), F.greatest(F.size("all") - 2, F.lit(0))))
    each = asked.select("claim_id", "doc_id", F.size("ws").alias("n"), inner.alias("inner"), F.explode("ws").alias("w"))
    known = save(each.withColumn("inside", F.array_contains("inner", F.col("w"))).drop("inner").join(seen, (F.col("doc_id") == F.col("_d")) & (each["w"] == seen["w"]), "left").select("claim_id", "doc_id", "n", "inside", each["w"], F.coalesce("df", F.lit(0)).alias("df")))
    rarest = known.filter("inside").groupBy("claim_id", "doc_id").agg(F.min(F.struct("df", "w")).alias("r")).filter("r.df > 0").select("claim_id", "doc_id", F.col("r.w").alias("w"))
    # A quote of one or two words has no inside: any page may have it.
    whole = asked.filter(F.size("all") < 3).select("claim_id", "doc_id").join(text.select("_d", "page_no"), F.col("doc_id") == F.col("_d")).select("claim_id", "_d", "page_no")
    meeting = rarest.join(words, (F.col("doc_id") == words["_d"]) & (rarest["w"] == words["w"])).select("claim_id", "_d", "page_no").unionByName(whole)
    tried = meeting.join(left, "claim_id").join(text.withColumnsRenamed({"_d": "_e", "page_no": "_n"}), (F.col("_d") == F.col("_e")) & (F.col("page_no") == F.col("_n")))
    elsewhere = save(_hit(_first_page(exact(tried), rank), F.lit(1.0), "exact match"))

    rest = left.join(elsewhere.select("claim_id"), "claim_id", "left_anti")
    lists = known.join(rest.select("claim_id"), "claim_id", "left_semi").groupBy("claim_id", "doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    need = F.ceil(F.col("n") * NEAR_WORDS).cast("int")
    rare = lists.select("claim_id", "doc_id", F.explode(F.slice("o", F.lit(1), F.col("n") - need + 1)).alias("p")).filter("p.df > 0").select("claim_id", "doc_id", F.col("p.w").alias("w"))
    met = rare.join(words, (F.col("doc_id") == words["_d"]) & (rare["w"] == words["w"])).select("claim_id", "_d", "page_no").distinct()

    @F.pandas_udf("s double, lo int, hi int")
    def window(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for q, p in batches:
            yield pd.DataFrame([similarity.partial_window(a, b) for a, b in zip(q, p)], columns=["s", "lo", "hi"])

    @F.pandas_udf("double")
    def faithful(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, w in batches:
            yield pd.Series([similarity.ratio(a, b) * similarity.order_factor(a, b) for a, b in zip(q, w)], dtype="float64")

    maybe = met.join(rest, "claim_id").join(text.withColumnsRenamed({"_d": "_e", "page_no": "_n"}), (F.col("_d") == F.col("_e")) & (F.col("page_no") == F.col("_n")))
    enough = F.size(F.array_intersect(F.array_distinct(F.split("q", " ")), F.split("norm", " "))) >= F.ceil(F.size(F.array_distinct(F.split("q", " "))) * NEAR_WORDS)
    scored = staged(maybe.filter(enough).withColumn("w", window("q", "norm")), {"at": F.col("w.lo"), "to": F.col("w.hi"), "s": F.col("w.s")}).drop("w").filter(F.col("s") >= NEAR)
    best = _first_page(scored, F.struct(-F.col("s"), rank))
    best = best.withColumn("f", F.round(faithful("q", F.substring("norm", F.col("at") + 1, F.col("to") - F.col("at"))), 4))
    near_hit = save(_hit(best, F.col("f"), "near match"))
    lost = _result(searched.filter(F.length(F.btrim("quote")) >= SHORTEST).select("claim_id").join(near_by.select("claim_id").unionByName(elsewhere.select("claim_id")).unionByName(near_hit.select("claim_id")), "claim_id", "left_anti"), located=F.lit(False), score=F.lit(0.0), note=F.lit("not found"))
    for more in (recorded, short, near_by, elsewhere, near_hit, lost):
        out = out.unionByName(more)
    return out


def score(claims: DataFrame, grounded: str = "grounding_score", located: str = "grounded") -> DataFrame:
    """Adds grounding_conf, combined, is_quarantined, is_review and reasons from a claim's grounding columns."""
    s, present = F.coalesce(grounded, F.lit(0.0)), F.col("value_in_span")
    found = F.coalesce(located, F.lit(False)) & (s >= GROUNDED)
    missing = F.coalesce(~present, F.lit(False))
    # Rounded as decimals: a tie is decided by what is written, not by the nearest binary fraction.
    halved = s.cast("decimal(18,8)") * F.when(missing, F.lit("0.5").cast("decimal(2,1)")).otherwise(F.lit("1.0").cast("decimal(2,1)"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(halved, 4).cast("double")))
    sure = F.round(F.coalesce("extraction_confidence", F.lit(0.0)), 4)
    df = claims.withColumns({"grounding_conf": conf, "is_quarantined": ~found | missing})
    exact = sure.cast("decimal(10,4)") * F.col("grounding_conf").cast("decimal(10,4)")
    df = df.withColumn("combined", F.round(exact, 4).cast("double"))
    df = df.withColumn("is_review", F.col("is_quarantined") | (F.col("combined") < REVIEW))
    stated = F.array_compact(F.array(
        F.when(~found, "evidence not located"), F.when(missing, "numbers not in evidence"), F.when(F.coalesce("page_shift", F.lit(0)) != 0, "evidence on another page"), F.when(sure < 0.5, "extractor unsure"),
    ))
    return df.withColumn("reasons", F.when((F.size(stated) == 0) & F.col("is_review"), F.array(F.lit("combined confidence low"))).otherwise(stated))
