"""Text that looks plain but isn't: skeletons over a table of look-alike characters.

A skeleton is made by decomposing a text, replacing each character by its prototype and decomposing
again. Two texts with equal skeletons look alike. The consistent form of a text keeps what is
legitimate (accented letters, dashes, curly quotes, superscripts, words of another script) and undoes
only disguises.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters and what looks like them in Cyrillic, Greek, Armenian, Cherokee, Lisu, Coptic, Canadian syllabics,
# Runic, Lycian and Deseret, and among Latin letters, after the public list of confusables.
PROTOTYPES = {
    "a": "аαɑ", "b": "вьᏏ", "c": "сϲⲥꮯ", "d": "ԁꓒᏧ", "e": "еҽ", "f": "ք", "g": "ɡց", "h": "һհнᏂ", "i": "іιıɩᎥꭵ", "j": "јϳյ", "k": "кκ", "l": "ӏⅼ", "m": "м", "n": "пոη", "o": "оοօσѳⲟ𐐬", "p": "рρϱⲣ", "q": "ԛզ",
    "r": "г", "s": "ѕꮪ", "t": "тτ", "u": "υսʋ", "v": "ѵνꮩ", "w": "ԝωաѡꮃ", "x": "хχ", "y": "уγү", "z": "ꮓ",
    "A": "АΑᎪꓮᗅ", "B": "ВΒᏴⲂᗷꓐ𐊂", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓᗞᗪ", "E": "ЕΕᎬꓰ𐊆", "F": "Ϝꓝᖴ𐊇", "G": "ԌᏀꓖԍ", "H": "НΗᎻꓧⲎᕼ", "I": "ІΙӀꓲⲒᛁ𐊊", "J": "ЈͿᎫꓙᒍ", "K": "КΚᏦꓗⲔᛕ", "L": "ԼᏞꓡᒪ", "M": "МΜᎷꓟⲘᗰᛖ", "N": "ΝꓠⲚ",
    "O": "ОΟՕꓳⲞ𐊒𐐄", "P": "РΡᏢꓑⲢᑭ𐊕", "Q": "Ԛ", "R": "ᎡᏒꓣᖇᚱ", "S": "ЅՏᏕᏚꓢ𐊖", "T": "ТΤᎢꓔⲦ𐊗", "U": "Սꓴᑌ", "V": "ѴᏙꓦᐯ", "W": "ԜᎳᏔꓪ", "X": "ХΧꓫⲬᚷ𐊐", "Y": "УΥҮᎽꓬⲨ", "Z": "ΖᏃꓜ",
}
# By rule: small capitals, and letterlike signs and numerals that stand for one Latin letter.
LOOKALIKES = {c: p for p, cs in PROTOTYPES.items() for c in cs}
LOOKALIKES |= {c: m[1].lower() for c in map(chr, range(0x0250, 0x1D30)) if (m := regex.match(r"LATIN LETTER SMALL CAPITAL ([A-Z])$", unicodedata.name(c, "")))}
LOOKALIKES |= {c: n for c in map(chr, range(0x2102, 0x2190)) if (n := unicodedata.normalize("NFKC", c)) != c and len(n) == 1 and n.isascii() and n.isalpha() and c != "K"}
# Punctuation that looks like ASCII punctuation: part of a skeleton, but no disguise by itself.
POINTS = {
    c: p
    for p, cs in {"'": "‘’‛′ʹʼ´", '"': "“”‟″", "-": "‐‑‒–—−⁃˗", "/": "⁄∕", ":": "∶։׃", ".": "․٫", ",": "‚", "!": "ǃ", "<": "‹", ">": "›"}.items()
    for c in cs
}
LIGATURES = frozenset(map(chr, range(0xFB00, 0xFB07)))
SPACES = frozenset(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Zs", "Zl", "Zp") and c != " ")
INVISIBLE = frozenset(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Cf" and not 0x0600 <= ord(c) <= 0x08FF) | {"͏", "ᅟ", "ᅠ", "឴", "឵", "ㅤ", "ﾠ"}
MARK = regex.compile(r"[\p{M}&&[\p{Script=Inherited}\p{Script=Common}]--[︀-️\U000e0100-\U000e01ef⃣]]", regex.V1)
WORD = regex.compile(r"[\p{L}\p{M}\p{Nl}­​-‍⁠﻿]+")
LATIN = regex.compile(r"\p{Script=Latin}")
PICTURE = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}️]")
# A cheap test in the JVM for what may be a disguise; what passes goes to Python in Arrow batches. Punctuation is none.
# Blocks instead of characters: a class of a few ranges is fast, one of hundreds of characters is not.
_BLOCKS = sorted({ord(c) >> 4 for c in LOOKALIKES.keys() | LIGATURES})


def _ranges(blocks: list[int]) -> str:
    out, start = [], None
    for i, b in enumerate(blocks):
        start = b if start is None else start
        if i + 1 == len(blocks) or blocks[i + 1] != b + 1:
            out.append(f"\\x{{{start << 4:x}}}-\\x{{{(b << 4) + 15:x}}}")
            start = None
    return "".join(out)


# Accents are named by block too: Java may not know their latest members.
# ASCII, which is most of a text, is ruled out first; its blank is the only space that is no disguise.
SUSPECT = rf"[[^\x{{0}}-\x{{7f}}]&&[\x{{1ab0}}-\x{{1aff}}\x{{1cd0}}-\x{{1cff}}\x{{1dc0}}-\x{{1dff}}\x{{20d0}}-\x{{20ff}}\x{{ff01}}-\x{{ffee}}\p{{Mn}}\p{{Me}}\p{{Cf}}\p{{Zl}}\p{{Zp}}\x{{1d400}}-\x{{1d7ff}}\x{{34f}}\x{{115f}}\x{{1160}}\x{{3164}}\p{{Zs}}{_ranges(_BLOCKS)}]]"


def beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.char_length(text)


def suspect(text: Column) -> Column:
    """Whether a text may hold a disguise. Comparing lengths first spares plain texts the pattern."""
    return beyond_ascii(text) & text.rlike(SUSPECT)


def _wide(c: str) -> bool:
    return "！" <= c <= "￮" and unicodedata.decomposition(c).startswith(("<wide>", "<narrow>"))


def _styled(c: str) -> bool:
    return "\U0001d400" <= c <= "\U0001d7ff" or c == "K"


def prototype(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in POINTS:
        return POINTS[c]
    if c in INVISIBLE:
        return ""
    if c in SPACES:
        return " "
    if _wide(c) or c in LIGATURES or _styled(c):
        return unicodedata.normalize("NFKC", c)
    return c


_prototype = lru_cache(65536)(prototype)


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again."""
    return unicodedata.normalize("NFD", "".join(map(_prototype, unicodedata.normalize("NFD", text))))


def _word(m: regex.Match) -> str:
    word = m.group()
    bare = "".join(c for c in word if c not in INVISIBLE)
    if any(LATIN.match(c) and c not in LOOKALIKES or _wide(c) or c in LIGATURES for c in bare):
        return "".join(LOOKALIKES.get(c, c) for c in word)
    return word


def consistent(text: str) -> str:
    """The one form of a text: no full-width forms, ligatures, look-alikes in Latin words, loose accents,
    invisible characters or spaces other than the ordinary one. Of a text without those, itself."""
    if text.isascii():
        return text
    text = WORD.sub(_word, text)
    out = []
    for i, c in enumerate(text):
        if c in INVISIBLE:
            # A joiner between pictures belongs to them.
            if c == "‍" and i and PICTURE.match(text[i - 1]):
                out.append(c)
        elif c in SPACES:
            out.append(" ")
        elif _wide(c) or c in LIGATURES or _styled(c):
            out.append(unicodedata.normalize("NFKC", c))
        else:
            out.append(c)
    text = "".join(out)
    if MARK.search(text):
        # Compose an accent with its letter; an accent that no single character has is left out.
        text = regex.sub(r"[\p{L}\p{N}]?" + MARK.pattern + "+", lambda m: _compose(m.group()), text, flags=regex.V1)
    return text


def _compose(cluster: str) -> str:
    return MARK.sub("", unicodedata.normalize("NFC", cluster))


def read_look(text: str) -> tuple[str, str]:
    """Form and skeleton of a text. The skeleton decides: a text that its composed skeleton gives again holds
    no disguise. Of the others ``consistent`` then keeps what is legitimate."""
    bones = skeleton(text)
    if _compose(bones) == text:
        return text, bones
    form = consistent(text)
    return form, bones if form == text else skeleton(form)


def unify(texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, text, form, skeleton, disguised for every row of ``texts``.

    Null texts give null form and skeleton and aren't disguised; empty texts are their own form. Texts of
    any length are handled whole. ASCII texts are their own skeleton and stay in the JVM; all others get
    theirs in Python, also those that can't be a disguise, as their accents decompose too.
    """
    schema = "form string, skeleton string"

    @F.pandas_udf(schema)
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([read_look(t) for t in s], columns=["form", "skeleton"])

    base = texts.select(*keys, F.col(column).alias("text"))
    odd = F.coalesce(beyond_ascii(F.col("text")), F.lit(False))
    plain = base.filter(~odd).select("*", F.col("text").alias("form"), F.col("text").alias("skeleton"), F.lit(False).alias("disguised"))
    return base.filter(odd).withColumn("f", forms("text")).select(*base.columns, "f.form", "f.skeleton", (F.col("f.form") != F.col("text")).alias("disguised")).unionByName(plain)


def disguised(texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The rows of ``unify`` whose text differs from its consistent form, without touching the others."""
    return unify(texts.filter(suspect(F.col(column))), keys, column).filter("disguised")


def same_look(texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Groups of different originals with one skeleton: skeleton, rows, originals, disguised_rows."""
    seen = unify(texts.filter(F.col(column).isNotNull()), keys, column)
    # Distinct originals first: a text repeated in a third of all rows is combined before the shuffle.
    originals = seen.groupBy("skeleton", "text").agg(F.count("*").alias("n"), F.max("disguised").alias("disguised"))
    groups = originals.groupBy("skeleton").agg(
        F.sum("n").alias("rows"), F.count("*").alias("originals"), F.sum(F.when(F.col("disguised"), F.col("n")).otherwise(0)).alias("disguised_rows")
    )
    return groups.filter("originals > 1")
