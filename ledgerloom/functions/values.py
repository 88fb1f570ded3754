"""Values, units and their precision, as staged columns: each step reads columns of the step before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import literal_map
from ledgerloom.functions.lexicon import CURRENCY_SIGNS, CURRENCY_WORDS, MAGNITUDES, SCALE_NAMES

NUMBER = r"[-+]?\(?\s*\d[\d,\s]*(?:\.\d+)?\s*\)?"
WORD = r"[a-z₹$€£¥%.]+"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F)))
_ODD, _ODD_PLAIN = "–—−    　¹²³", "---     123"
# The same table for Python.
FOLDED = str.maketrans(_WIDE + _ODD, _PLAIN + _ODD_PLAIN)


def fold(text: Column) -> Column:
    """Full-width forms, unusual spaces and dashes as their plain forms; without blanks around. '' for null.

    This is the part of compatibility folding that numbers and units meet; it stays in the JVM.
    """
    t = F.translate(F.coalesce(text, F.lit("")), _WIDE + _ODD, _PLAIN + _ODD_PLAIN)
    return F.btrim(t, F.lit(" \t\n\r\u000b\f"))


def _first(words: Column, table: dict[str, object]) -> Column:
    pairs = literal_map(table)
    return F.get(F.filter(F.transform(words, lambda w: F.try_element_at(pairs, w)), lambda x: x.isNotNull()), F.lit(0))


def _sign(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for sign, code in reversed(CURRENCY_SIGNS.items()):
        out = F.when(F.contains(text, F.lit(sign)), code).otherwise(out)
    return out


def bare_words(low: Column) -> Column:
    return F.transform(F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))


def percent(low: Column) -> Column:
    return F.contains(low, F.lit("%")) | F.contains(low, F.lit("percent")) | F.contains(low, F.lit("per cent"))


def with_value(df: DataFrame, column: str, p: str = "v_") -> DataFrame:
    """Adds, for the value text in ``column``: p+base, scale, currency, percent, number.

    Null and empty values have no number, scale 1 and no currency. Blanks inside a number belong to it, so
    two numbers written side by side are read as one.
    """
    df = df.withColumn(f"{p}text", fold(F.col(column)))
    df = df.withColumns({f"{p}low": F.lower(f"{p}text"), f"{p}token": F.btrim(F.regexp_extract(f"{p}text", f"({NUMBER})", 1))})
    df = df.withColumns({f"{p}words": bare_words(F.col(f"{p}low")), f"{p}digits": F.regexp_replace(F.regexp_replace(f"{p}token", r"^[()+\-]+|[()+\-]+$", ""), r"[,\s]", "")})
    size = F.col(f"{p}digits").try_cast("double")
    df = df.withColumns({
        f"{p}base": F.when(F.col(f"{p}token").rlike(r"^[(-]"), -F.abs(size)).otherwise(size),
        f"{p}scale": F.coalesce(_first(F.filter(f"{p}words", lambda w: w != ""), {k: v for k, v in MAGNITUDES.items()}), F.lit(1.0)),
        f"{p}currency": F.coalesce(_first(F.col(f"{p}words"), CURRENCY_WORDS | CURRENCY_SIGNS), _sign(F.col(f"{p}text"))),
        f"{p}percent": percent(F.col(f"{p}low")),
    })
    return df.withColumn(f"{p}number", F.col(f"{p}base") * F.col(f"{p}scale")).drop(f"{p}words", f"{p}low", f"{p}digits", f"{p}text")


def with_unit(df: DataFrame, unit: Column, value: str = "v_", p: str = "u_") -> DataFrame:
    """Adds the unit signature p+currency, scale, percent, raw: the unit text first, then the value's own."""
    df = df.withColumn(f"{p}raw", unit)
    df = df.withColumn(f"{p}low", F.lower(fold(F.col(f"{p}raw"))))
    df = df.withColumn(f"{p}words", bare_words(F.col(f"{p}low")))
    scale = F.coalesce(_first(F.col(f"{p}words"), MAGNITUDES), F.lit(1.0))
    df = df.withColumns({
        f"{p}currency": F.coalesce(_first(F.col(f"{p}words"), CURRENCY_WORDS | CURRENCY_SIGNS), _sign(F.col(f"{p}low")), F.col(f"{value}currency")),
        f"{p}scale": F.when(scale == 1.0, F.col(f"{value}scale")).otherwise(scale),
        f"{p}percent": percent(F.col(f"{p}low")) | F.col(f"{value}percent"),
    })
    return df.drop(f"{p}low", f"{p}words")


def half_unit(token: Column, scale: Column) -> Column:
    """Half a unit of the last digit that counts, scaled; null without a number. Trailing zeros don't count."""
    digits = F.regexp_replace(F.regexp_replace(token, r"^[-+(]+", ""), r"[,\s]", "")
    fraction = F.length(F.regexp_extract(digits, r"\.(.*)$", 1))
    zeros = F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))
    power = F.when(F.contains(digits, F.lit(".")), -fraction).otherwise(zeros)
    return F.when(digits != "", F.lit(0.5) * F.pow(F.lit(10.0), power) * scale)


def unit_label(p: str = "v_") -> Column:
    """Canonical unit of what a value itself carries: percent, or currency and scale name; null for neither."""
    name = F.lit(None).cast("string")
    for size, word in SCALE_NAMES.items():
        name = F.when(F.col(f"{p}scale") == size, word).otherwise(name)
    both = F.concat_ws(" ", F.col(f"{p}currency"), name)
    return F.when(F.col(f"{p}percent"), "percent").when(both != "", both)


def measure_kind(p_unit: str = "u_", p_value: str = "v_", stored: str = "value_num") -> Column:
    """rate, text or quantity; a rate is never the same measurement as a level."""
    return F.when(F.col(f"{p_unit}percent"), "rate").when(F.col(stored).isNull() & F.col(f"{p_value}base").isNull(), "text").otherwise("quantity")


def numeric(p_unit: str, p_value: str, stored: str) -> Column:
    """The number to compare: the stored one, else the written one by its own or its unit's scale."""
    scale = F.when(F.col(f"{p_value}scale") != 1.0, F.col(f"{p_value}scale")).otherwise(F.col(f"{p_unit}scale"))
    return F.coalesce(F.col(stored), F.col(f"{p_value}base") * scale)


def numbers_in(text: Column) -> Column:
    """Numbers as comparable strings: no separators, no blanks, no trailing zeros of a fraction."""
    bare = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d[\d,. ]*)"), F.lit(1)), lambda n: F.regexp_replace(F.regexp_replace(n, "[, ]", ""), r"\.+$", ""))
    trimmed = F.transform(bare, lambda n: F.when(F.contains(n, F.lit(".")), F.regexp_replace(F.regexp_replace(n, "0+$", ""), r"\.$", "")).otherwise(n))
    return F.filter(trimmed, lambda n: n != "")
