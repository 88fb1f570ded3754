"""Free-text periods as sets of years, quarters, halves and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.lexicon import MONTHS
from ledgerloom.functions.values import fold

SPAN = r"\b\d{4}\s*[-/]\s*\d{2,4}\b"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _ints(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(items, lambda x: x.cast("int"))))


def with_period(df: DataFrame, column: str, p: str = "p_") -> DataFrame:
    """Adds p+years, quarters, halves, months (sorted, distinct), fiscal and stated.

    A span such as 2023-24 names one period, by its last year. Null and texts without a period give
    empty sets. A month's name counts wherever it occurs; its abbreviation only as a word, where no
    full name occurs.
    """
    df = df.withColumn(f"{p}low", F.lower(fold(F.col(column))))
    low = F.col(f"{p}low")
    df = df.withColumns({f"{p}spans": _all(low, f"({SPAN})", 1), f"{p}rest": F.regexp_replace(low, SPAN, " "), f"{p}fy": _all(low, r"\bfy\s*[-']?\s*(\d{2,4})\b", 1)})
    end = F.transform(f"{p}spans", lambda s: F.when(F.length(F.regexp_extract(s, r"(\d+)$", 1)) == 4, F.regexp_extract(s, r"(\d+)$", 1)).otherwise(F.concat(F.substring(s, 1, 2), F.regexp_extract(s, r"(\d+)$", 1))))
    fy = F.transform(f"{p}fy", lambda d: F.when(F.length(d) == 4, d.cast("int")).when(d.cast("int") < 80, d.cast("int") + 2000).otherwise(d.cast("int") + 1900).cast("string"))
    full = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)), F.lit(i)) for i, m in enumerate(MONTHS, 1)]))
    short = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{m[:3]}\b"), F.lit(i)) for i, m in enumerate(MONTHS, 1)]))
    df = df.withColumn(f"{p}full", full)
    df = df.withColumns({
        f"{p}years": _ints(F.concat(end, _all(F.col(f"{p}rest"), r"\b((?:19|20)\d{2})\b", 1), fy)),
        f"{p}quarters": _ints(F.transform(_all(low, r"(\bq[1-4]\b|\b[1-4]q(?:\d{2,4})?\b)", 1), lambda q: F.when(q.startswith("q"), F.substring(q, 2, 1)).otherwise(F.substring(q, 1, 1)))),
        f"{p}halves": _ints(_all(low, r"\bh([12])\b", 1)),
        f"{p}months": F.when(F.size(f"{p}full") > 0, F.col(f"{p}full")).otherwise(short),
        f"{p}fiscal": F.contains(low, F.lit("fy")) | F.contains(low, F.lit("fiscal")) | F.contains(low, F.lit("financial year")),
    })
    stated = F.size(f"{p}years") + F.size(f"{p}quarters") + F.size(f"{p}halves") + F.size(f"{p}months") > 0
    return df.withColumn(f"{p}stated", stated).drop(f"{p}low", f"{p}spans", f"{p}rest", f"{p}fy", f"{p}full")


def compare(a: str, b: str) -> Column:
    """same, different or unknown, of two sets of period columns by their prefixes."""
    col = lambda p, n: F.col(f"{p}{n}")
    both_years = (F.size(col(a, "years")) > 0) & (F.size(col(b, "years")) > 0)
    return (
        F.when(~col(a, "stated") | ~col(b, "stated"), "unknown")
        .when((col(a, "quarters") != col(b, "quarters")) | (col(a, "halves") != col(b, "halves")), "different")
        .when(both_years & ~F.arrays_overlap(col(a, "years"), col(b, "years")), "different")
        .when(col(a, "months") != col(b, "months"), "different")
        .when(col(a, "years") == col(b, "years"), "same")
        .otherwise("unknown")
    )


def precedes(a: str, b: str) -> Column:
    """-1 if a's period is earlier than b's, 1 if later, 0 if they can't be ordered."""
    top = lambda p, n: F.array_max(f"{p}{n}")
    part = lambda p, n: F.coalesce(top(p, n), F.lit(0))
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    same_year = top(a, "years").eqNullSafe(top(b, "years"))
    inside = F.when(same_year, F.coalesce(order(part(a, "quarters"), part(b, "quarters")), order(part(a, "months"), part(b, "months"))))
    return F.when(F.col(f"{a}stated") & F.col(f"{b}stated"), F.coalesce(order(top(a, "years"), top(b, "years")), inside, F.lit(0))).otherwise(0)
