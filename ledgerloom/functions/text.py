"""Names and property names as comparable words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.keys import literal_array
from ledgerloom.functions.lexicon import ACRONYM_SKIP, ANTONYM_GROUPS, ORG_SUFFIXES, PREDICATE_STOPWORDS

MARKS = r"[^\p{L}\p{M}\p{N}_\s]"
_SUFFIX = "(?: (?:" + "|".join(sorted({s.rstrip(".") for s in ORG_SUFFIXES}, key=lambda s: (-len(s), s))) + "))+$"


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def entity_key(name: Column) -> Column:
    """A name in lower case without punctuation and without legal suffixes at its end; '' if nothing is left."""
    words = collapse(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "&", " and "), MARKS, " "))
    return F.btrim(F.regexp_replace(F.concat(F.lit(" "), words), _SUFFIX, ""))


def predicate_key(text: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_\s%]", " "))


def singular(w: Column) -> Column:
    """English plural endings taken off where at least three letters stay."""
    cut = lambda s, r: F.concat(F.substring(w, F.lit(1), F.length(w) - len(s)), F.lit(r))
    fits = lambda s: w.endswith(s) & (F.length(w) - len(s) >= 3)
    keep = w.endswith("ss") | w.endswith("us") | w.endswith("is")
    return F.when(keep, w).when(fits("ies"), cut("ies", "y")).when(fits("sses"), cut("sses", "ss")).when(fits("ses"), cut("ses", "s")).when(fits("s"), cut("s", "")).otherwise(w)


def content_words(text: Column) -> Column:
    """The words of a property name that tell it from others, in the singular, in order, repeats kept."""
    stop = literal_array(PREDICATE_STOPWORDS)
    words = F.filter(F.split(predicate_key(text), " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    return F.transform(words, singular)


def acronym(name: Column) -> Column:
    """First letters of the words that an acronym voices."""
    words = F.filter(F.split(collapse(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), MARKS, " ")), " "), lambda w: (w != "") & ~w.isin(ACRONYM_SKIP))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word lists as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def opposed_words(a: Column, b: Column) -> Column:
    """Whether one list has a qualifier whose opposite is in the other."""
    out = F.lit(False)
    for group in ANTONYM_GROUPS:
        g = literal_array(group)
        x, y = F.array_intersect(a, g), F.array_intersect(b, g)
        out = out | ((F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y))
    return out


def refines(a: Column, b: Column) -> Column:
    """1 if a's words are b's and more, -1 the other way round, 0 otherwise."""
    fewer = lambda x, y: (F.size(F.array_distinct(x)) > 0) & (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) > 0)
    return F.when(fewer(b, a), 1).when(fewer(a, b), -1).otherwise(0)
