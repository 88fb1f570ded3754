"""Hand-typed spellings linked to a register of names.

Candidates come from a set-similarity join: every distinct spelling and every registered name is a set
of q-grams of its tokens, each weighing the more the rarer it is in the register. A name may be meant by a
spelling if it holds ``CONTAINED`` of the spelling's grams, by number, and ``WEIGHED`` of them by weight.
Grams are ordered from rare to frequent, and only a spelling's prefix is looked up, up to the gram
behind which less than ``WEIGHED`` of the weight remains: a name that shares none of them shares too
little. Candidates are verified by a soft similarity of tokens in which typing errors, abbreviations,
initials and nicknames count as near matches and rare tokens count more.

Counts over the register are kept by hash, in tables of ``BUCKETS`` numbers whatever its size; two grams
in one bucket only weigh a little less, alike in every step, so no candidate is lost by it.

Spellings are reduced to distinct ones before anything else, so a name with a third of all rows is
compared once.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import save

Q = 3
CONTAINED, WEIGHED = 0.3, 0.4
BUCKETS = 1 << 18
ACCEPT = 0.8

# Words around names.
TITLES = frozenset("mr mrs ms miss dr prof professor sir".split())
SMALL = frozenset("the of and for in de".split())
LEGAL = frozenset("limited private corporation company incorporated holdings plc gmbh sa".split())
STATE = frozenset("kingdom republic federation free territory".split())
SHORT_FORMS = {
    "ltd": "limited", "pvt": "private", "corp": "corporation", "corpn": "corporation", "co": "company", "inc": "incorporated", "hldgs": "holdings", "bros": "brothers",
    "intl": "international", "tpt": "transport", "trpt": "transport", "svcs": "services", "svc": "services", "engg": "engineering", "mfg": "manufacturing", "govt": "government", "natl": "national",
    "dept": "department", "assn": "association", "assoc": "association", "auth": "authority", "tech": "technologies", "pharma": "pharmaceuticals",
}
# Given names and the short forms that no rule derives from them, in English, French, German, Italian, Russian, Spanish and Indian use.
NICKNAMES = {
    "abigail": "gail nabby", "abraham": "bram", "adelaide": "heidi della", "agnes": "nessa inez", "albert": "bert bertie", "alberto": "beto", "aleksandr": "sasha shura", "alexander": "sandy sasha xander lex", "alexandra": "sandra sandy sasha",
    "alfonso": "poncho fonso", "alfred": "fred freddie", "alice": "lisa elsie", "amelia": "milly emmy mia", "andrew": "drew dandy", "ann": "nancy nan annie", "anna": "nancy anya anouk", "anthony": "tony", "antonio": "tonio tonino tono",
    "arthur": "art archie", "augustus": "gus", "barbara": "babs bobbie", "bartholomew": "bart tolly", "benedict": "ben dick", "bernard": "barney bernie", "bridget": "biddy bride", "caroline": "carrie lina", "catherine": "kate kathy katie kit kitty cat",
    "cecilia": "cissy celia", "charles": "charlie chuck chas chaz chip", "charlotte": "lottie charlie lotte", "christina": "tina chris christy", "christine": "tina chris christy", "christopher": "kit topher kester", "concepcion": "concha conchita",
    "cornelius": "con neil", "cynthia": "cindy", "daniel": "danny dan", "deborah": "debbie deb", "dmitri": "dima mitya", "dolores": "lola lolita", "dorothy": "dot dolly dottie thea", "eduardo": "lalo edu", "edward": "ted ned teddy eddie", "eleanor": "nell nora ellie lena",
    "elizabeth": "betty bess lisa eliza libby liz beth lizzie elsie bettina", "elisabeth": "sissi lisa liesl lisbeth", "emmanuel": "manny manu", "enrique": "kike quique", "ernest": "ernie", "esther": "hetty", "eugene": "gene", "evgeny": "zhenya", "florence": "flo flossie",
    "frances": "fanny fran frankie", "francis": "frank frankie", "francisco": "paco pancho curro kiko", "frederick": "fritz fred freddie", "friedrich": "fritz fred", "genevieve": "ginette viv", "george": "geordie dod", "gerald": "gerry jerry", "gertrude": "trudy gert",
    "gregory": "greg grisha", "gregorio": "goyo", "guadalupe": "lupe lupita", "gwendolyn": "wendy", "harold": "harry hal", "harriet": "hattie", "helen": "nell nellie lena", "henry": "harry hank hal", "herbert": "bert bertie", "ignacio": "nacho", "isabella": "bella ella izzy", "isabel": "bella belle izzy",
    "ivan": "vanya", "jacob": "jake jakob", "jacqueline": "jackie", "james": "jim jimmy jamie", "jane": "jenny janie", "janet": "jenny", "jean": "jenny jeannie", "jennifer": "jenny", "jeremiah": "jerry", "jesus": "chuy chucho", "joan": "joanie", "johannes": "hans hannes jan", "john": "jack johnny jock",
    "jonathan": "jon nathan", "jose": "pepe pepito chepe", "josef": "sepp jupp", "joseph": "joe joey jody", "josephine": "josie jo fifi", "katherine": "kate kathy katie kit kitty", "kathleen": "kathy kate kay", "konstantin": "kostya", "lawrence": "larry laurie", "leonard": "lenny len", "leopold": "poldi",
    "leticia": "lety", "louis": "lou louie", "louise": "lou lulu", "lucia": "lucy", "ludwig": "lutz wiggi", "luis": "lucho", "lydia": "liddy", "magdalena": "lena leni", "manuel": "manolo manny", "margaret": "peggy meg maggie madge daisy greta rita peg maisie", "margarita": "rita", "maria": "mia mimi masha mitzi",
    "martha": "patty matty", "martin": "marty", "mary": "molly polly mamie mae minnie may", "matilda": "tilly maud", "matthew": "matt matty", "maximilian": "max", "melissa": "missy lissa", "mercedes": "merche", "michael": "mike mick mickey mikey misha", "mikhail": "misha", "mildred": "millie", "montgomery": "monty",
    "nathaniel": "nat nate", "nicholas": "nick klaus colin nicky", "nikolai": "kolya", "olga": "olya", "oliver": "noll ollie", "pamela": "pam", "patricia": "patty tricia trish pat patsy", "patrick": "paddy pat rick", "pavel": "pasha", "penelope": "penny", "peter": "pete", "philip": "pip phil flip", "pilar": "pili",
    "priscilla": "cilla", "rachel": "shelley", "raymond": "ray", "rebecca": "becky", "reginald": "reggie rex", "richard": "dick rick rich richie ricky", "robert": "bob rob bobby robbie bert", "roberto": "beto", "roger": "hodge", "ronald": "ron ronnie", "rosario": "charo", "rosemary": "rosie romy", "rudolf": "rudi rolf", "rufus": "rory",
    "salvador": "chava", "samantha": "sam", "samuel": "sam", "sarah": "sally sadie", "santiago": "santi yago", "sebastian": "bastian seb", "sergei": "seryozha", "sigmund": "siggi", "sofia": "sonya", "stephen": "steve", "susan": "sue susie suzy", "susanna": "sanna sue", "svetlana": "sveta", "sylvester": "sly", "tatiana": "tanya",
    "teresa": "tess tessa tere resi terry", "theodore": "ted teddy", "theresa": "tess tessa terry resi", "therese": "tess tessa resi", "thomas": "tom tommy", "timothy": "tim", "valentina": "tina valya", "veronica": "ronnie vera", "victoria": "vicky tori vita", "vincent": "vince", "virginia": "ginny ginger", "vladimir": "volodya vova",
    "walter": "walt wat", "wilhelm": "willi", "wilhelmina": "minnie billie", "william": "bill billy will liam", "winifred": "freda win", "zachary": "zach zack",
}
_CALLED: dict[str, set[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _short in _shorts.split():
        _CALLED.setdefault(_short, set()).add(_full)
# What a pet form is made with: an ending after the name's beginning, whose last consonant may double.
PET_ENDINGS = ("", "y", "ie", "i", "ey", "a", "u", "o", "e", "ita", "ito")


@lru_cache(200_000)
def called(typed: str, name: str) -> bool:
    """Whether a given name's bearer may be called ``typed``: a known short form, the name's first three letters or
    more with a pet ending (Deb, Debby, Sammy, Raju), or its last four letters or more (Nora of Leonora)."""
    if name in _CALLED.get(typed, ()):
        return True
    if typed in NICKNAMES:  # a full name of its own
        return False
    if len(name) >= len(typed) + 2 and len(typed) >= 4 and name.endswith(typed):
        return True
    for end in PET_ENDINGS:
        stem = typed[: len(typed) - len(end)] if end else typed
        if typed.endswith(end) and 3 <= len(stem) < len(name):
            if name.startswith(stem):
                return True
            if end and len(stem) > 3 and stem[-1] == stem[-2] and name.startswith(stem[:-1]):
                return True
    return False


def plain(text: str) -> str:
    """Without accents, in folded case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def letters(text: str) -> str:
    """What a spelling consists of apart from case, white space and punctuation; accents count."""
    return "".join(c for c in unicodedata.normalize("NFC", text.casefold()) if c.isalnum())


@lru_cache(200_000)
def tokens(text: str) -> tuple[str, ...]:
    """The words of a name without titles and small words, short forms written out."""
    # Words written together: a capital after a small letter, a legal form after four letters.
    t = plain(re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z][^\W\d_A-Z])", " ", text)).replace("&", " and ")
    t = re.sub(r"(?<=[^\W\d_]{4})(?=(?:limited|ltd|pvt|corporation|incorporated|plc|gmbh)\b)", " ", t)
    t = re.sub(r"(?<=\w)['’](?=\w)", "", t)
    t = re.sub(r"\(\s*p\s*\)", " private ", t)
    t = re.sub(r"\bs\.?\s?a\b\.?", " sa ", t)
    t = re.sub(r"\bgesellschaft\s+mbh\b", "gmbh", t)
    t = re.sub(r"\bpublic\s+limited\s+company\b", "plc", t)
    words = [SHORT_FORMS.get(w, w) for w in re.findall(r"[^\W_]+", t)]
    kept = [w for w in words if w not in SMALL and w not in TITLES]
    return tuple(kept or words)


def acronym(text: str) -> str | None:
    """The letters of a spelling that is an acronym (CBG, C.B.G., cbg); None for any other."""
    bare = text.strip(" \t\r\n,;:.*\"'[]/-_")
    if re.fullmatch(r"(?:[^\W\d_]\s?\.\s?){2,7}[^\W\d_]", bare) or re.fullmatch(r"[^\W\d_]{3,8}", bare):
        return plain(re.sub(r"[\W_]", "", bare))
    return None


def grams(text: str) -> list[str]:
    return sorted({f"^{w}$"[i : i + Q] for w in tokens(text) for i in range(max(1, len(w) + 3 - Q))})


def initials(text: str) -> str:
    return "".join(w[0] for w in tokens(text))


@lru_cache(500_000)
def edits(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting as one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 7 else 2 if length < 14 else 3


def _subsequence(short: str, full: str) -> bool:
    rest = iter(full)
    return all(c in rest for c in short)


@lru_cache(500_000)
def alike(typed: str, name: str, common: bool, person: bool) -> float:
    """How well a typed word stands for a word of a registered name: 1 same, 0 not at all.

    ``common``: the word is frequent in the register, so it may be abbreviated.
    """
    if typed == name:
        return 1.0
    if person and len(typed) == 1:
        return 0.8 if typed == name[0] else 0.0
    if person and called(typed, name):
        return 0.95
    most = _allowed(min(len(typed), len(name)))
    if most and (d := edits(typed, name, most)) <= most:
        return 1 - d / max(len(typed), len(name))
    if person:
        # A short form with a typing error.
        return max((0.75 for short, fulls in _CALLED.items() if name in fulls and len(short) > 3 and edits(typed, short, 1) <= 1), default=0.0)
    if common and 2 <= len(typed) < len(name):
        if typed[0] == name[0] and _subsequence(typed, name):
            return 0.9
        # An abbreviation with a typing error: all letters but one in order.
        if len(typed) > 3 and any(c and c[0] == name[0] and _subsequence(c, name) for c in (typed[:i] + typed[i + 1 :] for i in range(len(typed)))):
            return 0.75
    return 0.0


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _counts(words: DataFrame) -> np.ndarray:
    """How often each bucket of words occurs: at most BUCKETS rows come to the driver."""
    spread = words.groupBy((F.crc32(F.encode("w", "UTF-8")) % BUCKETS).alias("b")).agg(F.count("*").alias("n")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[spread["b"].to_numpy(dtype=np.int64)] = spread["n"].to_numpy(dtype=np.int64)
    return out


def prefix(of: list[str], counts: np.ndarray, n: int) -> list[str]:
    """The grams of a spelling, rare ones first, up to the last that a name with ``WEIGHED`` of their weight may share
    first; without those that no name has."""
    df = {g: int(counts[_bucket(g)]) for g in of}
    order = sorted(of, key=lambda g: (df[g], g))
    # A gram that no name has tells nothing: typing errors make them. It counts as little as the most frequent one.
    weight = {g: math.log(1 + n / df[g]) if df[g] else math.log(2) for g in of}
    left, need, out = sum(weight.values()), WEIGHED * sum(weight.values()), []
    for g in order:
        if left < need:
            break
        if df[g]:
            out.append(g)
        left -= weight[g]
    return out


class Rarity:
    """Weights of the register's words."""

    def __init__(self, n: int, counts: np.ndarray):
        self.n, self.counts, self.known = n, counts, {}

    def __getitem__(self, word: str) -> tuple[float, bool]:
        """(weight, common): a word that is common in the register may be abbreviated."""
        if word not in self.known:
            df = int(self.counts[_bucket(word)])
            self.known[word] = (math.log(1 + self.n / df) * (0.15 if word in LEGAL else 1) if df else 8.0, df >= 4)
        return self.known[word]


def similarity(typed: str, name: str, kind: str, rarity: Rarity) -> float:
    """Soft weighted token similarity, 0 to 1; 0 if a word that tells entities apart has no counterpart."""
    person = kind == "person"
    x, y = list(tokens(typed)), tokens(name)
    surname = max(range(len(y)), key=lambda i: (i > 0, len(y[i]) > 1 and i == _surname(y))) if person else -1
    got = [0.0] * len(y)
    free = list(range(len(x)))
    pairs = sorted(((alike(x[i], y[j], rarity[y[j]][1] or y[j] in LEGAL, person and len(y[j]) > 1), -abs(i - j), i, j) for i in free for j in range(len(y))), reverse=True)
    used: set[int] = set()
    for s, _, i, j in pairs:
        if s > 0 and i not in used and not got[j] and not (person and j == surname and s < 0.7):
            used.add(i)
            got[j] = s
    left = [x[i] for i in range(len(x)) if i not in used]
    total = hit = 0.0
    for j, w in enumerate(y):
        if not got[j]:
            if not _optional(y, j, kind, surname):
                return _glued(typed, name)
            continue
        total += rarity[w][0]
        hit += rarity[w][0] * got[j]
    if any(w not in LEGAL and not (person and len(w) == 1) for w in left):
        return _glued(typed, name)
    legal_y = [y[j] for j in range(len(y)) if y[j] in LEGAL and not got[j]]
    if not person and any(w in LEGAL for w in left) and legal_y:
        return 0.0
    return hit / total if total else 0.0


def _surname(y: tuple[str, ...]) -> int:
    return next(i for i in range(1, len(y) + 1) if i == len(y) or len(y[i]) > 1) if len(y) > 1 else 0


def _optional(y: tuple[str, ...], j: int, kind: str, surname: int) -> bool:
    if kind == "place":
        return y[j] in STATE and len(y) > 1
    if kind == "person":
        return len(y[j]) == 1 or j > surname
    return y[j] in LEGAL


def _glued(typed: str, name: str) -> float:
    """Words written together or cut apart: the whole strings, with and without legal forms."""
    x, y = "".join(tokens(typed)), "".join(tokens(name))
    if len(x) > 5 and x.startswith("the") and not y.startswith("the"):
        x = x[3:]
    bare = "".join(w for w in tokens(name) if w not in LEGAL)
    whole = re.sub(r"[\W_]", "", plain(name).replace("&", "and"))
    for target in {y, bare, whole}:
        if len(target) > 7 and (d := edits(x, target, 2)) <= 2:
            return 1 - 2 * d / len(target)
    return 0.0


def link(spellings: DataFrame, column: str, register: DataFrame, key: str, name: str, kind: str) -> DataFrame:
    """(column, key, score): for each distinct spelling the one registered entity it means.

    Spellings that fit two entities equally well, or none, are left out. Null, empty and blank
    spellings are no names. An empty register or no spellings give no rows. ``register`` must have
    unique keys; the weights of tokens are counted over it.
    """
    spark = spellings.sparkSession
    gram_udf = F.pandas_udf(lambda s: s.map(grams, na_action="ignore"), "array<string>")
    named = register.select(F.col(key).alias("k"), F.col(name).alias("y"), F.lower(kind).alias("kind")).filter("y is not null")
    initials_udf = F.pandas_udf(lambda s: s.map(initials, na_action="ignore"), "string")
    named = save(named.select("*", gram_udf("y").alias("gy"), initials_udf("y").alias("iy")))
    n = max(1, named.count())
    words_udf = F.pandas_udf(lambda s: s.map(lambda t: sorted(set(tokens(t))), na_action="ignore"), "array<string>")
    gram_counts = spark.sparkContext.broadcast(_counts(named.select(F.explode("gy").alias("w"))))
    shared = spark.sparkContext.broadcast((n, _counts(named.select(F.explode(words_udf("y")).alias("w")))))

    @F.pandas_udf("gx array<string>, prefix array<string>, ax string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = gram_counts.value
        for s in batches:
            yield pd.DataFrame([(g := grams(t), prefix(g, counts, n), acronym(t)) for t in s], columns=["gx", "prefix", "ax"])

    distinct = spellings.select(F.col(column).alias("x")).filter(F.col("x").rlike(r"\p{L}")).distinct()
    distinct = save(distinct.withColumn("r", read("x")).select("x", "r.*"))
    asked = distinct.select("x", F.explode("prefix").alias("g"))
    pairs = asked.join(named.select("k", F.explode("gy").alias("g")), "g").select("x", "k").distinct()
    # The count filter: enough grams in common over the whole sets, not only the prefix.
    sized = pairs.join(distinct.select("x", "gx"), "x").join(named.select("k", "y", "kind", "gy"), "k")
    near = sized.filter(F.size(F.array_intersect("gx", "gy")) >= F.ceil(F.size("gx") * CONTAINED)).select("x", "k", "y", "kind")

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rarity = Rarity(*shared.value)
        for x, y, k in batches:
            yield pd.Series([similarity(a, b, e, rarity) for a, b, e in zip(x, y, k)], dtype="float64")

    verified = near.withColumn("score", score("x", "y", "kind")).filter(F.col("score") >= ACCEPT).select("x", "k", "score")
    short = distinct.filter("ax is not null").join(named.filter("kind <> 'person' and length(iy) >= 3"), F.col("ax") == F.col("iy")).select("x", "k", F.lit(0.9).alias("score"))
    every = verified.unionByName(short).groupBy("x", "k").agg(F.max("score").alias("score"))
    best = every.groupBy("x").agg(F.max(F.struct("score", "k")).alias("b"), F.collect_list(F.round("score", 9)).alias("all"))
    alone = F.size(F.filter("all", lambda s: s == F.round(F.col("b.score"), 9))) == 1
    return best.filter(alone).select(F.col("x").alias(column), F.col("b.k").alias(key), F.col("b.score").alias("score"))


def variants(spellings: DataFrame, column: str, register: DataFrame, key: str, name: str, kind: str) -> DataFrame:
    """The rows of ``link`` whose spelling differs from the registered name in letters, accents or digits or their order."""
    letters_udf = F.pandas_udf(lambda s: s.map(letters, na_action="ignore"), "string")
    linked = link(spellings, column, register, key, name, kind).join(register.select(key, F.col(name).alias("_name")), key)
    return linked.filter(letters_udf(column) != letters_udf("_name")).drop("_name")
