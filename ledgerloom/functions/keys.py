"""Keys as people deliver them: stray case and blanks are not part of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\u000b\f "


def clean_key(col: Column | str) -> Column:
    """Lower case, without surrounding white space; null for null and for blank."""
    col = F.col(col) if isinstance(col, str) else col
    bare = F.lower(F.btrim(col, F.lit(BLANKS)))
    return F.when(bare != "", bare)


def literal_map(table: dict[str, float | str]) -> Column:
    """A constant map, parsed in one go (building it entry by entry costs a call to the JVM each)."""

    def word(x: float | str) -> str:
        if isinstance(x, str):
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{float(x)!r}D"

    return F.expr("map(" + ", ".join(f"{word(k)}, {word(v)}" for k, v in table.items()) + ")")


def literal_array(words: list[str]) -> Column:
    """A constant array of strings, parsed in one go."""
    return F.expr("array(" + ", ".join("'" + w.replace("'", "\\'") + "'" for w in words) + ")")


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds (or replaces) columns that are computed once per row, however often later steps refer to them.

    The optimizer moves filters below projections by writing the projected expressions out wherever they are referred to,
    which repeats expensive ones many times over; it doesn't move them below an explode, here of one row.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    gone = ", ".join(f"`{c}`" for c in ("_staged", *(c for c in df.columns if c in columns)))
    return df.select("*", made.alias("_staged")).selectExpr(f"* except ({gone})", "_staged.*")
