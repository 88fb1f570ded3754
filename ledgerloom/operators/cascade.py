"""Verdicts on pairs of claims: one chain of conditions over staged columns, first hit wins.

What concerns one claim alone (its keys, number, unit, period) is prepared once per claim. Only ratios of
strings run in Arrow batches, which remember the pairs they met; everything else stays in the JVM. Judging
a pair needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import periods, similarity, text, values
from ledgerloom.functions.keys import literal_array, staged
from ledgerloom.functions.lexicon import AGGREGATE_SCOPES, RATE_TERMS, REVISION_RANK, RULES, STATUS_OPPOSITES
from ledgerloom.operators import matching
from ledgerloom.operators.matching import pair_id
from ledgerloom.sources.scratch import save

FIELDS = ("scope", "basis", "geography", "denominator", "as_of")
COMPARED = [
    "claim_id", "doc_id", "subject", "predicate", "value", "value_num", "unit", "ctx_period", "ctx_unit", "ctx_scope", "ctx_basis", "ctx_geography", "ctx_as_of",
    "ctx_denominator", "modality", "origin", "final_confidence",
]


@dataclass(frozen=True)
class Tolerance:
    value: float = 0.005
    rounding: float = 0.02
    points: float = 0.05
    text_same: float = 0.80
    text_different: float = 0.45
    # Also demand that values which agree only by their written precision are within ``rounding``.
    cap_precision: bool = False


def prepared(df: DataFrame, p: str = "") -> DataFrame:
    """Adds everything about one side of a pair that doesn't depend on the other: keys and words, value and unit, number
    and precision, period. Done on claims, it is done once per claim and not once per pair."""
    df = matching.described(df, p)
    df = values.with_value(df, f"{p}value", f"{p}v_")
    df = values.with_unit(df, F.coalesce(F.when(F.col(f"{p}unit") != "", F.col(f"{p}unit")), F.col(f"{p}ctx_unit")), f"{p}v_", f"{p}u_")
    df = _kept(df, p)
    df = df.withColumns({f"{p}x": values.numeric(f"{p}u_", f"{p}v_", f"{p}value_num"), f"{p}half": values.half_unit(F.col(f"{p}v_token"), F.col(f"{p}u_scale"))})
    return _kept(periods.with_period(df, f"{p}ctx_period", f"{p}p_"), p)


def _kept(df: DataFrame, p: str) -> DataFrame:
    return staged(df, {c: F.col(c) for c in _made_by_prepared(df.columns, p)})


def _made_by_prepared(columns: list[str], p: str) -> list[str]:
    return [c for c in columns if c in {f"{p}{x}" for x in ("key", "full", "initials", "words", "x", "half")} or c.startswith((f"{p}v_", f"{p}u_", f"{p}p_"))]


def prepared_claims(claims: DataFrame) -> DataFrame:
    """The compared columns of claims with what ``prepared`` adds."""
    return prepared(claims.select(*COMPARED))


def sides(pairs: DataFrame, claims: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """Pairs with the compared columns of both claims as a_... and b_..., prepared; a pair with a missing claim is left out."""
    # Both sides read it: prepared once, written down.
    ready = claims if "p_stated" in claims.columns else save(prepared_claims(claims))
    keep = [c for c in ready.columns if c in COMPARED] + _made_by_prepared(ready.columns, "")
    left, right = (ready.select(*[F.col(c).alias(f"{s}_{c}") for c in keep]) for s in "ab")
    return pairs.join(left, pairs[a] == left["a_claim_id"]).join(right, pairs[b] == right["b_claim_id"])


@lru_cache(500_000)
def _token_set(a: str, b: str) -> float:
    return 1.0 if a == b else similarity.token_set_ratio(a, b)


def _text_scores(df: DataFrame, names: list[tuple[str, str, str]], wanted: Column) -> DataFrame:
    """Adds for each (out, a, b) the token-set similarity of two texts in lower case, null unless both are stated.

    All fields of a pair go through one Arrow call, rows that aren't ``wanted`` as nulls, and a worker keeps the scores of
    the texts it met.
    """
    low = lambda c: F.lower(F.btrim(F.coalesce(c, F.lit(""))))

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([None if a is None else [_token_set(x, y) if x and y else None for x, y in zip(a, b)] for a, b in zip(xs, ys)])

    df = df.withColumn("_s", score(F.when(wanted, F.array(*[low(a) for _, a, _ in names])), F.when(wanted, F.array(*[low(b) for _, _, b in names]))))
    return df.withColumns({out: F.get("_s", F.lit(i)) for i, (out, _, _) in enumerate(names)}).drop("_s")


def with_text_scores(df: DataFrame, wanted: Column) -> DataFrame:
    """Adds s_value and s_... of every context field."""
    return _text_scores(df, [("s_value", "a_value", "b_value"), *[(f"s_{f}", f"a_ctx_{f}", f"b_ctx_{f}") for f in FIELDS]], wanted)


def field_verdict(a: Column, b: Column, score: Column, scope: bool, t: Tolerance) -> Column:
    """same, different or unknown; two unstated fields are the same, one unstated is unknown."""
    x, y = F.btrim(F.coalesce(a, F.lit(""))), F.btrim(F.coalesce(b, F.lit("")))
    one = F.when(F.lower(F.concat(x, y)).isin(AGGREGATE_SCOPES), "same").otherwise("unknown") if scope else F.lit("unknown")
    both = F.when(score >= t.text_same, "same").when(score <= t.text_different, "different").otherwise("unknown")
    return F.when((x == "") & (y == ""), "same").when((x == "") | (y == ""), one).otherwise(both)


def both_sides(pairs: DataFrame) -> DataFrame:
    """Pairs with both sides prepared, if they aren't, and the coarser precision of the two."""
    for s in "ab":
        if f"{s}_p_stated" not in pairs.columns:
            pairs = prepared(pairs, f"{s}_")
    return pairs.withColumn("coarser", F.when(F.col("a_half").isNotNull() & F.col("b_half").isNotNull(), F.greatest("a_half", "b_half")))


def unit_verdict() -> Column:
    stated = lambda s: F.col(f"{s}_u_currency").isNotNull() | (F.col(f"{s}_u_scale") != 1.0)
    money = F.coalesce(F.col("a_u_currency") != F.col("b_u_currency"), F.lit(False))
    return F.when(money | (F.col("a_u_percent") != F.col("b_u_percent")), "incomparable").when(stated("a") != stated("b"), "unknown").otherwise("same")


def value_verdict(score: Column, t: Tolerance) -> Column:
    """equal, equivalent, differ or incomparable."""
    x, y, coarser = F.col("a_x"), F.col("b_x"), F.col("coarser")
    gap = F.abs(x - y)
    relative = F.try_divide(gap, F.greatest(F.abs(x), F.abs(y)))
    written = F.when(score >= 0.92, "equal").when(score >= 0.72, "equivalent").otherwise("differ")
    precise = F.coalesce(gap <= coarser, F.lit(False))
    if t.cap_precision:
        precise = precise & (relative <= t.rounding)
    return (
        F.when(x.isNull() & y.isNull(), written)
        .when(x.isNull() | y.isNull(), "incomparable")
        .when(F.col("a_u_percent") & F.col("b_u_percent"), F.when(gap <= F.greatest(F.coalesce(coarser, F.lit(0.0)), F.lit(t.points)), "equivalent").otherwise("differ"))
        .when(x == y, "equal")
        .when(precise | (relative <= t.rounding) | (relative <= t.value), "equivalent")
        .otherwise("differ")
    )


def _rank(modality: Column) -> Column:
    out = F.lit(2)
    for word, rank in REVISION_RANK.items():
        out = F.when(modality == word, rank).otherwise(out)
    return out


def _opposed(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for one, other in STATUS_OPPOSITES:
        has = lambda c, w: F.contains(c, F.lit(w))
        shared = (has(a, one) & has(b, one)) | (has(a, other) & has(b, other))
        out = out | ((has(a, one) | has(a, other)) & (has(b, one) | has(b, other)) & ~shared)
    return out


def gated(pairs: DataFrame) -> DataFrame:
    """Pairs with both sides prepared and the verdicts of the gates on names and property names."""
    return matching.with_predicate_gate(matching.with_entity_gate(both_sides(pairs)))


def compare(pairs: DataFrame, t: Tolerance = Tolerance(), unrelated: bool = True) -> DataFrame:
    """One verdict per pair of ``sides``: relation_id, claim ids, kind, rule_id, confidences, differences, trace, escalate.

    Gates come first: pairs that fail them are compared no further, and without ``unrelated`` they are left out.
    Nulls: a null confidence counts as 0, a null modality as reported, null context as not stated. Null
    subjects match nothing.
    """
    df = gated(pairs)
    passed = F.col("ent_ok") & (F.col("pred_verdict") != "different")
    df = staged(df, {c: F.col(c) for c in ("ent_ok", "ent_score", "pred_verdict", "pred_score")})
    if not unrelated:
        df = df.filter(passed)
    df = with_text_scores(df, passed)
    df = staged(df, {
        "period_v": periods.compare("a_p_", "b_p_"), "unit_v": unit_verdict(), "order": periods.precedes("a_p_", "b_p_"),
        **{f"{f}_v": field_verdict(F.col(f"a_ctx_{f}"), F.col(f"b_ctx_{f}"), F.col(f"s_{f}"), f == "scope", t) for f in FIELDS},
        "value_v": value_verdict(F.coalesce("s_value", F.lit(1.0)), t),
        "a_mod": F.coalesce(F.when(F.col("a_modality") != "", F.col("a_modality")), F.lit("reported")), "b_mod": F.coalesce(F.when(F.col("b_modality") != "", F.col("b_modality")), F.lit("reported")),
    })
    context = ["period_v", *[f"{f}_v" for f in FIELDS]]
    rates = literal_array(RATE_TERMS)
    bare = lambda s: F.col(f"{s}_u_currency").isNull() & ~F.col(f"{s}_u_percent") & (F.col(f"{s}_u_scale") == 1.0) & (F.coalesce(f"{s}_u_raw", F.lit("")) == "")
    df = staged(df, {
        "differs": F.array_contains(F.array(*context), "different"), "unknown": F.array_contains(F.array("unit_v", *context), "unknown"),
        "agree": F.col("value_v").isin("equal", "equivalent"), "differ": F.col("value_v") == "differ",
        "direction": text.refines(F.col("a_words"), F.col("b_words")),
        "named_rate": F.arrays_overlap("a_words", rates) | F.arrays_overlap("b_words", rates),
        "status": (F.lower(F.btrim("a_predicate")) == "status") & (F.lower(F.btrim("b_predicate")) == "status"),
        "opposed": _opposed(F.lower("a_value"), F.lower("b_value")),
        "denominator": (F.coalesce("a_ctx_denominator", F.lit("")) != "") | (F.coalesce("b_ctx_denominator", F.lit("")) != ""),
        "bare_cells": F.coalesce((F.col("a_origin") == "table") & (F.col("b_origin") == "table"), F.lit(False)) & bare("a") & bare("b"),
    })
    narrow, broad = F.when(F.col("direction") == 1, F.col("a_x")).otherwise(F.col("b_x")), F.when(F.col("direction") == 1, F.col("b_x")).otherwise(F.col("a_x"))
    df = staged(df, {"part": F.when((F.col("direction") != 0) & F.col("a_x").isNotNull() & F.col("b_x").isNotNull(), F.coalesce(F.try_divide(F.abs(narrow), F.abs(broad)), F.lit(0.0)))})
    c = F.col
    revised = (c("a_mod") != c("b_mod")) & c("differ") & c("period_v").isin("same", "unknown") & (_rank(c("a_mod")) != _rank(c("b_mod")))
    related = c("pred_verdict") == "related"
    rule = (
        F.when(~c("ent_ok"), "R00").when(c("pred_verdict") == "different", "R01").when(c("unit_v") == "incomparable", "R02")
        .when(related & c("part").between(0.05, 1.02), "R10").when(related & (c("part") < 0.05), "R11").when(related, "R12")
        .when(revised, "R20")
        .when(c("status") & c("agree"), "R30").when(c("status") & c("differ") & (c("order") != 0), "R31").when(c("status") & c("differ") & c("opposed"), "R32").when(c("status") & c("differ"), "R33")
        .when(c("agree") & ~c("differs"), "R40").when(c("differ") & c("differs"), "R50").when(c("agree"), "R51")
        .when(c("differ") & c("unknown"), "R60")
        .when(c("differ") & c("a_u_percent") & c("b_u_percent") & ~c("named_rate") & ~c("denominator"), "R61")
        .when(c("differ") & c("bare_cells") & ~c("named_rate"), "R62")
        .when(c("differ"), "R70").otherwise("R99")
    )
    df = staged(df, {"rule_id": rule})
    dim = df.sparkSession.createDataFrame(RULES, "rule_id string, kind string, relationship_confidence double, escalate boolean")
    df = df.join(F.broadcast(dim), "rule_id")
    match = F.when(c("rule_id") == "R00", c("ent_score")).when(c("rule_id") == "R01", c("pred_score")).when(c("pred_score") == 0, c("ent_score") * 0.5).otherwise(F.least(F.lit(1.0), c("ent_score") * 0.5 + c("pred_score") * 0.5))
    df = df.withColumn("match_confidence", F.round(match, 4))
    weakest = F.coalesce(F.least(F.coalesce("a_final_confidence", F.lit(0.0)), F.coalesce("b_final_confidence", F.lit(0.0))), F.lit(0.0))
    compared = ~c("rule_id").isin("R00", "R01")
    pair = lambda f: F.array(f"a_ctx_{f}", f"b_ctx_{f}")
    differing = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.when(c(f"{f}_v") == "different", pair(f)).alias("value")) for f in ("period", *FIELDS)]), lambda e: e["value"].isNotNull()))
    gap = F.abs(c("a_x") - c("b_x"))
    deltas = [("a", c("a_x")), ("b", c("b_x")), ("absolute_difference", gap), ("coarser_precision", F.when(gap.isNotNull(), c("coarser"))), ("text_similarity", F.when(c("a_x").isNull() & c("b_x").isNull(), F.round("s_value", 4))),
              ("percentage_point_difference", F.when(c("a_u_percent") & c("b_u_percent"), F.round(gap, 4))), ("relative_difference", F.when(~(c("a_u_percent") & c("b_u_percent")) & (gap != 0), F.round(F.try_divide(gap, F.greatest(F.abs("a_x"), F.abs("b_x"))), 6)))]
    delta = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in deltas]), lambda e: e["value"].isNotNull()))
    trace = F.array(
        F.concat(F.lit("entity: "), F.when(c("ent_ok"), "matched").otherwise("rejected")), F.concat(F.lit("predicate: "), c("pred_verdict")),
        *[F.concat(F.lit(f"{f}: "), c(f"{f}_v")) for f in ("period", "unit", *FIELDS)], F.concat(F.lit("modality: "), c("a_mod"), F.lit(" / "), c("b_mod")), F.concat(F.lit("value: "), c("value_v")),
        F.concat(F.lit("["), c("rule_id"), F.lit("] "), c("kind")),
    )
    keep = [x for x in pairs.columns if not x.startswith(("a_", "b_"))]
    return df.select(
        pair_id("a_claim_id", "b_claim_id").alias("relation_id"), c("a_claim_id").alias("claim_a_id"), c("b_claim_id").alias("claim_b_id"), "kind", F.lit("rules").alias("decided_by"), "rule_id",
        F.round("ent_score", 4).alias("subject_similarity"), F.round("pred_score", 4).alias("predicate_similarity"), "match_confidence", "relationship_confidence",
        (F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), weakest * match * c("relationship_confidence"))) * 10000 + 0.5) / 10000).alias("confidence"),
        trace.alias("reasoning_trace"), F.when(compared, differing).alias("context_diff"), F.when(compared, c("value_v")).alias("value_agreement"), F.when(compared, delta).alias("value_delta"), "escalate", F.when(c("rule_id") == "R10", component()).alias("component"), *keep,
    )


def counterfactuals(pairs: DataFrame, t: Tolerance = Tolerance()) -> DataFrame:
    """relation_id, field, kind, rule_id, new_kind, new_rule_id: verdicts that change when one context field is left out.

    Each pair meets the seven fields (a fixed list), is judged again without the field and reported if its
    kind or rule changes. Fields that neither side states are not tried.
    """
    fields = ("period", "unit", *FIELDS)
    base = compare(pairs, t).select("relation_id", "claim_a_id", "claim_b_id", "kind", "rule_id")
    tried = pairs.withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    for f in fields:
        for s in "ab":
            for col in [f"{s}_ctx_{f}"] + ([f"{s}_unit"] if f == "unit" else []):
                tried = tried.withColumn(f"_{col}", F.col(col))
    any_side = F.lit(False)
    for f in fields:
        stated = [F.coalesce(F.col(f"_{s}_ctx_{f}"), F.lit("")) != "" for s in "ab"] + ([F.coalesce(F.col(f"_{s}_unit"), F.lit("")) != "" for s in "ab"] if f == "unit" else [])
        hit = stated[0]
        for x in stated[1:]:
            hit = hit | x
        any_side = any_side | ((F.col("field") == f) & hit)
    tried = tried.filter(any_side)
    for f in fields:
        for s in "ab":
            for col in [f"{s}_ctx_{f}"] + ([f"{s}_unit"] if f == "unit" else []):
                tried = tried.withColumn(col, F.when(F.col("field") != f, F.col(f"_{col}"))).drop(f"_{col}")
    # What was prepared from the fields is made anew.
    tried = tried.drop(*[c for s in "ab" for c in _made_by_prepared(tried.columns, f"{s}_")])
    again = compare(tried, t).select("relation_id", "field", F.col("kind").alias("new_kind"), F.col("rule_id").alias("new_rule_id"))
    return base.join(again, "relation_id").filter("kind <> new_kind or rule_id <> new_rule_id")


def component() -> Column:
    """What a pair of sides says about a part and its whole, null if neither is the other's part: the narrower claim has the
    smaller amount and the longer property name."""
    wa, wb = F.array_sort(F.array_distinct("a_words")), F.array_sort(F.array_distinct("b_words"))

    def part(n: str, words: Column, b: str) -> Column:
        return F.struct(F.col(f"{b}_claim_id").alias("whole_id"), F.col(f"{b}_value_num").alias("whole"), F.col(f"{n}_ctx_period").alias("period"), words.alias("words"), F.abs(f"{n}_value_num").alias("part"))

    smaller = lambda n, b: F.abs(f"{n}_value_num") < F.abs(f"{b}_value_num")
    return F.when(smaller("a", "b") & (F.size(wa) > F.size(wb)), part("a", wa, "b")).when(smaller("b", "a") & (F.size(wb) > F.size(wa)), part("b", wb, "a"))


def _sums(rows: DataFrame) -> DataFrame:
    """relation_id, whole_id, parts, total, confirmed of rows with ``component``."""
    x = rows.select("relation_id", "component.*")
    parts = x.groupBy("whole_id", "whole", "period", "words").agg(F.max("part").alias("part"))
    sums = parts.groupBy("whole_id", "whole", "period").agg(F.count("*").alias("parts"), F.sum(F.col("part").cast("decimal(28,4)")).cast("double").alias("total"))
    fits = F.coalesce(F.abs(1 - F.try_divide("total", F.abs("whole"))) <= 0.05, F.lit(False)) & (F.col("parts") >= 2)
    sums = sums.select(F.col("whole_id").alias("_w"), F.col("period").alias("_p"), "parts", "total", fits.alias("confirmed"))
    return x.join(sums, (x["whole_id"] == sums["_w"]) & x["period"].eqNullSafe(sums["_p"])).select("relation_id", "whole_id", "parts", "total", "confirmed")


def confirm_components(relations: DataFrame, claims: DataFrame) -> DataFrame:
    """Relations of rule R10 whose narrower claims add up to the broader one: relation_id, whole_id, parts, total, confirmed.

    Of several claims with one property name the largest counts; two at least must be there; the sum may be off by 5 %.
    """
    x = sides(relations.filter("rule_id = 'R10'").select("relation_id", F.col("claim_a_id").alias("a_id"), F.col("claim_b_id").alias("b_id")), claims)
    return _sums(x.select("relation_id", component().alias("component")).filter("component is not null"))


def with_confirmed_components(relations: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Judged relations, with those of parts that add up to their whole raised: relationship_confidence by 0.10, confidence
    by 0.05, at most 1, and a line in the trace. Adds ``component_confirmed``.

    Amounts and words come from the column ``component`` of ``compare``; stored relations get it from ``claims``.
    """
    if claims is not None:
        relations = relations.drop("component")
        x = sides(relations.filter("rule_id = 'R10'").select("relation_id", F.col("claim_a_id").alias("a_id"), F.col("claim_b_id").alias("b_id")), claims)
        relations = relations.join(x.select("relation_id", component().alias("component")), "relation_id", "left")
    rows = save(relations)
    good = _sums(rows.filter("rule_id = 'R10' and component is not null")).filter("confirmed").select("relation_id", "parts").withColumnRenamed("parts", "_parts")
    hit = F.col("_parts").isNotNull()
    out = rows.join(good, "relation_id", "left").withColumns({
        "relationship_confidence": F.when(hit, F.round(F.least(F.lit(1.0), F.col("relationship_confidence") + 0.10), 4)).otherwise(F.col("relationship_confidence")),
        "confidence": F.when(hit, F.round(F.least(F.lit(1.0), F.col("confidence") + 0.05), 4)).otherwise(F.col("confidence")),
        "reasoning_trace": F.when(hit, F.concat("reasoning_trace", F.array(F.concat(F.lit("components: "), F.col("_parts").cast("string"), F.lit(" parts add up to the whole"))))).otherwise(F.col("reasoning_trace")),
        "component_confirmed": hit,
    })
    return out.drop("_parts", "component")


def replay(relations: DataFrame, claims: DataFrame, t: Tolerance = Tolerance()) -> DataFrame:
    """Stored relations judged again: relation_id, old_kind, old_rule, kind, rule_id, drift. Pairs with a missing claim are left out."""
    stored = relations.select(F.col("claim_a_id").alias("a_id"), F.col("claim_b_id").alias("b_id"), F.col("kind").alias("old_kind"), F.col("rule_id").alias("old_rule"), F.col("relation_id").alias("stored_id"))
    now = compare(sides(stored, claims).drop("a_id", "b_id"), t)
    same = F.col("kind").eqNullSafe(F.col("old_kind")) & F.col("rule_id").eqNullSafe(F.col("old_rule"))
    return now.select(F.col("stored_id").alias("relation_id"), "old_kind", "old_rule", "kind", "rule_id", "confidence", (~same).alias("drift"))
