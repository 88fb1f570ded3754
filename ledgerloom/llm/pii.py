"""Personal information in free text, found by a linear-chain conditional random field.

The field is trained on the small labelled table of ``pii_labels`` by maximum likelihood (forward and
backward in numpy) over features of words: the word where it is frequent in the table, its shape, its
ending, what it hints at (``CUES``), whether it lies in a run of characters that looks like a public
format (``PATTERNS``), and the same of its neighbours. Patterns and cues decide nothing: the field weighs
them, and a run that looks like a phone number beside "order" is none. Texts are decoded by Viterbi in
numpy batches of chains of similar length. What a word contributes depends on the word and its patterns
alone, so scores are computed once per distinct one of a batch and gathered; texts of any length are
decoded whole, line by line.
"""

from __future__ import annotations

import gc
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.names import NICKNAMES
from ledgerloom.llm.pii_labels import labelled_texts

KINDS = ("email", "phone", "id_number", "address", "person_name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in ("B", "I")))
NL = len(LABELS)
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3, 4)
PAD = ""
# A token is a run without blanks, less the punctuation around it, which makes tokens of its own.
TOKEN = re.compile(r"\n|[\(\[\{<\"'«“‘¿¡](?!\d{1,5}\))|(?:[^\s,;:!?<>\"'«»“”’।\[\]{}()]|(?<=\d)\(\d+\)|\(\d{2,5}\)|(?<=\w)['’:](?=\w)|,(?=\d{3}))+?(?=[.,;:!?।\)\]\}>\"'»”’]*(?:\s|$)|[,;<>\[\]{}()«»“”।])|\S")
SHARE = 4
# Texts that are tagged together: so many, or so many characters. Words whose features a process keeps.
TEXTS, CHARACTERS, KNOWN = 1000, 1_000_000, 100_000
# Hints of words, in five languages, of classes a reader goes by.
CUES = {
    "email": "email e-mail emails mail mailto courriel correo contact contacto kontakt write écrire écrivez schreiben escriba संपर्क ईमेल ई-मेल",
    "phone": "phone phones telephone tel mobile cell fax call text ring dial hotline helpline whatsapp sms portable téléphone téléphoner appelez joindre telefon telefonisch mobil handy rufen anrufen erreichbar teléfono móvil llame llámeme फ़ोन फोन मोबाइल दूरभाष कॉल",
    "id": "id ids passport identity identification ssn social security insurance licence license tax taxpayer pan aadhaar nino nif nie dni permit citizen voter holder holder's cardholder applicant applicant's signatory bearer personal papers document passeport identité titulaire identifiant pièce sécurité "
    "reisepass personalausweis ausweis ausweisnummer steuernummer kennnummer sozialversicherungsnummer führerschein inhaber inhabers antragstellers pasaporte documento titular carné cédula identidad solicitante आधार पहचान पासपोर्ट पैन",
    "address": "address addressed addresses lives live lived residence resides resident residing mailing domicile home moved delivered served notice notices domicilio adresse anschrift wohne wohnt wohnhaft lieferung zustellung habite demeure siège courrier dirección vivo reside notificaciones पता निवास",
    "thing": "invoice order ticket serial batch contract container model case isbn commit lot ref reference build version hash table section page pages route gate flight code voucher part item tracking meter account room chapter price list figure bill series port samples readings reading timestamp edition article clause note "
    "commande facture bestellung rechnung pedido factura artículo cuadro tableau tabelle abbildung seite página fassung आदेश तालिका पृष्ठ",
    "title": "mr mrs ms miss dr prof professor sir herr frau mme mlle monsieur madame m sr sra don doña señora señor shri smt श्री श्रीमती",
    "closing": "signed signature regards sincerely faithfully respectfully cordially truly thanks wishes signé signée cordialement gezeichnet unterzeichnet grüßen firmado firma atentamente हस्ताक्षर भवदीय",
    "legal": "limited ltd plc inc llc gmbh ag s.a sa sarl corporation corp company co pvt incorporated holdings group bros brothers sons private",
    "trade": "cement foods food energy shipping insurance logistics capital minerals steel motors airlines textiles chemicals trading software media partners industries finance financial services power pharma agricultural products oil gas international construction technologies systems transport transports mills works "
    "estates properties retail foundation theorem associates infrastructure mining telecom solutions laboratories securities investments",
    "office": "bank ministry department institute council office authority commission bureau committee board federal national central statistics agency university federation union parliament court chamber bulletin directorate secretariat association alliance survey",
    "land": "kingdom republic federation state states province region district islands island territory north south east west northern southern eastern western central new",
    "street": "road street lane avenue close drive terrace gardens place square way crescent court rd st ave blvd boulevard ln rue allée impasse quai chemin cours calle c/ avenida avda plaza paseo via marg nagar colony vihar enclave layout flat apt apartment unit suite plot house bis",
}
_CUE: dict[str, tuple[str, ...]] = {}
for _kind, _words in CUES.items():
    for _w in _words.split():
        _CUE[_w] = (*_CUE.get(_w, ()), _kind)
_CUE |= {w: (*_CUE.get(w, ()), "given") for full, shorts in NICKNAMES.items() for w in (full, *shorts.split())}
# Runs of characters in public formats. Capital letter: its first token; small letter: its others.
PATTERNS = {
    "E": r"[\w.%+'-]+@[\w-]+(?:\.[\w-]+)+|[\w.%+-]+ ?[(\[] ?at ?[)\]] ?[\w-]+(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[\w-]+)+",
    "U": r"(?:https?://|www\.)\S+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<!\w)@\w+|\d{4}-\d\d-\d\dT\S+|97[89][ -][\d -]{9,14}\d|\b[0-9a-f]{16,}\b|\b\d{1,2}([./-])\d{1,2}\1\d{2,4}\b|\b\d{4}-\d\d-\d\d\b|\b(?:19|20)\d\d[-–/](?:19|20)?\d\d\b",
    "P": r"(?<![\w.,/+\-])(?:(?:\+|00 ?)\d{1,3}[ .\-/]?(?:\(0?\d{0,4}\)[ .\-/]?)?\d[\d .\-/]{4,14}\d|\(0\d{1,4}\)[ .\-/]?\d[\d .\-/]{3,10}\d|0\d{1,4}[ .\-/]?\d[\d .\-/]{3,10}\d|\(\d{3}\) ?\d{3}[ .\-]?\d{4}|\d{3}[.\- ]\d{3}[.\- ]\d{4}|\d{3} \d{2} \d{2} \d{2}|[6-9]\d{4}[ -]?\d{5}|\d{3}-\d{4})(?!\w|-[^\W\d_]|[.,/\-]\d)",
    "I": r"(?<![\w\-./])(?:\p{Lu}{1,6}[ -]?\d{5,10}(?:-?\p{Lu}|-\d{2,})?|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{4}([ -])\d{4}\1\d{4}|\p{Lu}{2}(?: ?\d\d){3} ?\p{Lu}|\d{8,12}-?\p{Lu}?|\p{Lu}-?\d{7}-?\p{Lu}|[12] \d\d \d\d \d\d \d{3} \d{3} \d\d|\d{2}/\d{3}/\d{5}|\p{Lu}+\d+\p{Lu}\d+|\p{Lu}{3,}\d{4}\p{Lu}|\p{Lu}\d\p{Lu}{2}\d{5})(?!\w|[.,/]\d|-\d)",
    "Z": r"\b\p{Lu}{1,2}\d[\d\p{Lu}]? ?\d\p{Lu}{2}\b|\b\p{Lu}{2} \d{5}(?:-\d{4})?\b|(?<![\d.,])(?:\p{Lu}{1,2}-)?\d{5}(?= \p{Lu})|(?<=[\p{L},\-] )\d{3} ?\d{3}(?![\d.,]|\s?%)",
}
_PATTERN = {f: (re if f in "EP" and r"\p" not in p else regex).compile(p) for f, p in PATTERNS.items()}
_AT = regex.compile(r"[(\[] ?at ?[)\]]", regex.I)
_PARTED = regex.compile(r"\d[./–\-]\d|97[89][ -]|[0-9a-f]{16}")
_DIGIT = regex.compile(r"\d")
PARTICLES = frozenset("de da do dos das del della der den di du la le van von zu bin ibn al el y e ter ten af av".split())
# Between a token and the patterns it lies in; and the mark of a token whose letters are hidden in training.
MARK, HIDDEN = "\x1f", "\x1e"


def tokenise(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text) if m.group() != "\n"]


def marked(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """The tokens of one line, each with the patterns it lies in."""
    words = [text[a:b] for a, b in spans]
    # What a line must show for any run in it to fit a pattern.
    digit, at = _DIGIT.search(text) is not None, "@" in text
    shows = {
        "E": at or ("(" in text or "[" in text) and _AT.search(text) is not None,
        "U": at or "//" in text or "www" in text or digit and _PARTED.search(text) is not None,
    }
    for f, pattern in _PATTERN.items():
        if not shows.get(f, digit):
            continue
        for m in pattern.finditer(text):
            i = bisect_left(spans, (m.start(), 0))
            if i and spans[i - 1][1] > m.start():
                i -= 1
            first = True
            while i < len(spans) and spans[i][0] < m.end():
                words[i] += (MARK if MARK not in words[i] else "") + (f if first else f.lower())
                first = False
                i += 1
    return words


_RUNS = [(re.compile("X{3,}"), "XX+"), (re.compile("d{6,}"), "d6+"), (re.compile("x{2,}"), "x+")]
_STREET_END = re.compile(r"...(?:straße|strasse|str|weg|gasse|allee|platz|ring|hof)$")


def shape(word: str) -> str:
    """X for capitals, x for other letters, d for digits; long runs are shortened."""
    s = "".join("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in word)
    for run, short in _RUNS:
        s = run.sub(short, s)
    return s


@lru_cache(200_000)
def features(token: str) -> tuple[str, ...]:
    if token == PAD:
        return ("pad",)
    hidden = token.endswith(HIDDEN)
    word, _, flags = token.rstrip(HIDDEN).partition(MARK)
    low = word.lower()
    form = shape(word)
    out = [f"s={form}"] + [f"f={f}" for f in dict.fromkeys(flags)]
    if not flags:
        out.append(f"bare={form if len(form) < 4 else form[:3]}")
    bare = low.strip(".:'’-")
    cues = _CUE.get(bare) or _CUE.get(bare.removesuffix("'s").removesuffix("’s")) or (("street",) if _STREET_END.search(bare) else ())
    out += [f"cue={c}" for c in cues]
    if not hidden:
        out.append(f"w={low}")
    if word.isalpha():
        out.append("alpha:" + ("U" if word.isupper() and len(word) > 1 else "T" if word[0].isupper() else "l") + ("1" if len(word) == 1 else "+") + ("c" if cues and cues != ("given",) else ""))
        if not hidden:
            out.append(f"e={low[-3:]}")
    elif any(c.isdigit() for c in word):
        digits = sum(c.isdigit() for c in word)
        out.append(f"digits={min(digits, 12)}:{'a' if any(c.isalpha() for c in word) else 'n'}")
        out.append(f"start={word[0] if not word[0].isdigit() else 'd'}{'0' if word[0] == '0' else ''}")
        out.append("marks=" + "".join(sorted({c for c in word if not c.isalnum()})))
    elif any(c.isalpha() for c in word):
        out.append("mixed=" + "".join(sorted({c for c in word if not c.isalnum()})))
        out.append("mixed:" + ("T" if word[0].isupper() else "l"))
    return tuple(out)


def _scores(words: list[str], index: dict[str, int], weights: np.ndarray, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """(offset, word, label): what each word contributes at each offset, the sum of the weights of its features. ``known``
    keeps the numbers of a word's features, of ``KNOWN`` words at most."""
    wide = np.concatenate([weights.transpose(1, 0, 2).reshape(len(index), -1), np.zeros((1, len(OFFSETS) * NL), dtype=np.float32)])
    parts = []
    for i in range(0, len(words), 4096):
        if len(known) > KNOWN:
            known.clear()
        rows = []
        for w in words[i : i + 4096]:
            row = known.get(w)
            if row is None:
                row = known[w] = (*(j for f in features.__wrapped__(w) if (j := index.get(f)) is not None), len(index))
            rows.append(row)
        starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
        parts.append(np.add.reduceat(wide[np.fromiter(chain.from_iterable(rows), dtype=np.int64)], starts, axis=0))
    return np.ascontiguousarray(np.concatenate(parts).reshape(len(words), len(OFFSETS), NL).transpose(1, 0, 2))


def _emissions(ids: np.ndarray, tables: np.ndarray, pad: int) -> np.ndarray:
    """ids (n, t) of words; tables (offset, word, label)."""
    n, t = ids.shape
    wide = np.full((n, t + 2 * SHARE), pad, dtype=np.int64)
    wide[:, SHARE : SHARE + t] = ids
    out = np.zeros((n, t, NL), dtype=np.float32)
    for k, o in enumerate(OFFSETS):
        out += tables[k][wide[:, SHARE + o : SHARE + o + t]]
    return out


# An item continues only after its own beginning.
_ALLOWED = np.zeros((NL, NL), dtype=np.float32)
for _a in range(NL):
    for _b in range(NL):
        if LABELS[_b].startswith("I-") and LABELS[_a][2:] != LABELS[_b][2:]:
            _ALLOWED[_a, _b] = -1e4
_START = np.array([-1e4 if x.startswith("I-") else 0 for x in LABELS], dtype=np.float32)


@dataclass
class Tagger:
    index: dict[str, int]
    weights: np.ndarray  # (offset, feature, label)
    moves: np.ndarray  # (label, label)
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    def decode(self, chains: list[list[str]]) -> list[np.ndarray]:
        """The most likely labels of each chain of words."""
        known: dict[str, int] = {}
        coded = [np.array([known.setdefault(w, len(known)) for w in c], dtype=np.int64) for c in chains]
        words = [*known, PAD]
        tables = _scores(words, self.index, self.weights, self.known)
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(chains)
        order = sorted((i for i in range(len(chains)) if len(coded[i])), key=lambda i: len(coded[i]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and n < 512 and (n + 1) * len(coded[order[at + n]]) <= 40_000:
                n += 1
            rows = order[at : at + n]
            at += n
            size = np.array([len(coded[i]) for i in rows])
            ids = np.full((n, size.max()), len(words) - 1, dtype=np.int64)
            for r, i in enumerate(rows):
                ids[r, : size[r]] = coded[i]
            for r, path in enumerate(self._viterbi(_emissions(ids, tables, len(words) - 1), size)):
                out[rows[r]] = path[: size[r]]
        return out

    def _viterbi(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        n, t, _ = e.shape
        moves = self.moves + _ALLOWED
        back = np.zeros((t, n, NL), dtype=np.int8)
        score = e[:, 0] + _START
        ends = np.where((size == 1)[:, None], score, 0)
        for i in range(1, t):
            step = score[:, :, None] + moves[None]
            back[i] = step.argmax(axis=1)
            score = np.take_along_axis(step, back[i][:, None, :].astype(np.int64), axis=1)[:, 0] + e[:, i]
            ends = np.where((size == i + 1)[:, None], score, ends)
        path = np.zeros((n, t), dtype=np.int8)
        last = ends.argmax(axis=1).astype(np.int8)
        rows = np.arange(n)
        for i in range(t - 1, -1, -1):
            # Before a chain's end its last label is only carried along.
            path[:, i] = last
            if i:
                last = np.where(i < size, back[i][rows, last], last)
        return path


def train(texts: list[tuple[str, list[tuple[int, int, str]]]], steps: int = 100, rate: float = 0.15, l2: float = 2e-3, hide: float = 0.35) -> Tagger:
    """Maximum likelihood with adaptive gradient steps; deterministic. ``hide``: the share of words outside items whose
    letters are hidden, so that the field doesn't learn sentences by heart."""
    chains, gold = [], []
    rng = random.Random(5)
    for text, items in texts:
        spans = tokenise(text)
        labels = np.zeros(len(spans), dtype=np.int64)
        for a, b, kind in items:
            inside = [i for i, (x, y) in enumerate(spans) if x < b and y > a]
            for k, i in enumerate(inside):
                labels[i] = LABELS.index(("B-" if k == 0 else "I-") + kind)
        if spans:
            chains.append([w + HIDDEN if label == 0 and rng.random() < hide else w for w, label in zip(marked(text, spans), labels)])
            gold.append(labels)
    known: dict[str, int] = {}
    coded = [[known.setdefault(w, len(known)) for w in c] for c in chains]
    words = [*known, PAD]
    seen = Counter(f for c in chains for w in c for f in features(w))
    # A word counts by itself only where the table has it often; rare ones go by their shape.
    names = [f for f, n in sorted(seen.items()) if n >= (8 if f.startswith(("w=", "e=")) else 3)] + ["pad"]
    index = {f: i for i, f in enumerate(names)}
    # Words with the same features are one class.
    classes: dict[tuple[str, ...], int] = {}
    of_class = np.array([classes.setdefault(tuple(f for f in features(w) if f in index), len(classes)) for w in words])
    x = np.zeros((len(classes), len(index)), dtype=np.float32)
    for fs, c in classes.items():
        x[c, [index[f] for f in fs]] = 1
    n, t = len(coded), max(map(len, coded))
    size = np.array([len(c) for c in coded])
    ids = np.full((n, t), len(words) - 1, dtype=np.int64)
    y = np.zeros((n, t), dtype=np.int64)
    for r, c in enumerate(coded):
        ids[r, : len(c)], y[r, : len(c)] = c, gold[r]
    mask = np.arange(t)[None] < size[:, None]
    ids = of_class[ids]
    pad = int(of_class[-1])
    wide = np.full((n, t + 2 * SHARE), pad, dtype=np.int64)
    wide[:, SHARE : SHARE + t] = ids
    near = [wide[:, SHARE + o : SHARE + o + t][mask] for o in OFFSETS]
    order = np.argsort(size, kind="stable")
    batches = [order[i : i + 256] for i in range(0, n, 256)]
    w = np.zeros((len(OFFSETS), len(names), NL), dtype=np.float32)
    moves = np.zeros((NL, NL), dtype=np.float32)
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, moves)]
    hot = np.eye(NL, dtype=np.float32)
    for step in range(1, steps + 1):
        tables = np.stack([x @ k for k in w])
        g_moves, off = np.zeros_like(moves), np.zeros((n, t, NL), dtype=np.float32)
        for rows in batches:
            top = size[rows].max()
            i_, y_, m_ = ids[rows, :top], y[rows, :top], mask[rows, :top]
            # Scaled forward and backward sums in probabilities: one small matrix product a step.
            e = _emissions(i_, tables, pad)
            x_e = np.exp(e - e.max(axis=2, keepdims=True))
            m = np.exp(moves + _ALLOWED)
            a, b, c = np.zeros_like(e), np.ones_like(e), np.ones(e.shape[:2], dtype=np.float32)
            a[:, 0] = x_e[:, 0] * np.exp(_START)
            a[:, 0] /= a[:, 0].sum(axis=1, keepdims=True)
            for i in range(1, top):
                nxt = (a[:, i - 1] @ m) * x_e[:, i]
                c[:, i] = nxt.sum(axis=1)
                a[:, i] = nxt / c[:, i, None]
            for i in range(top - 2, -1, -1):
                live = m_[:, i + 1]
                ahead = np.where(live[:, None], x_e[:, i + 1] * b[:, i + 1] / c[:, i + 1, None], 0)
                b[:, i] = np.where(live[:, None], ahead @ m.T, 1)
                g_moves += m * (a[:, i].T @ ahead)
                np.add.at(g_moves, (y_[:, i][live], y_[:, i + 1][live]), -1)
            p = a * b
            p = p / p.sum(axis=2, keepdims=True) - hot[y_]
            off[rows, :top] = p
        flat = off[mask]
        g_tables = [np.stack([np.bincount(at, weights=flat[:, j], minlength=len(x)) for j in range(NL)], axis=1).astype(np.float32) for at in near]
        grads = (np.stack([x.T @ g for g in g_tables]) / n + l2 * w, g_moves / n + l2 * moves)
        for v, g, (m1, m2) in zip((w, moves), grads, state):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    return Tagger(index, w, moves)


_trained: Tagger | None = None


def default_tagger() -> Tagger:
    """Trained once per process on the labelled table."""
    global _trained
    if _trained is None:
        _trained = train(labelled_texts())
    return _trained


def _exact(kind: str, text: str) -> bool:
    """What an item of its kind must hold, whatever the tagger thinks."""
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        return bool(regex.search(r"\S\s*(?:@|[(\[]\s*at\s*[)\]])\s*\S+\s*(?:\.|[(\[]\s*dot\s*[)\]])\s*\w", text, regex.I))
    if kind == "phone":
        return 7 <= digits <= 15
    if kind == "id_number":
        return digits >= 4 and "," not in text
    if kind == "address":
        return digits >= 1 and bool(regex.search(r"\p{L}{4}", text))
    if digits or "@" in text or not regex.match(r"\p{L}.*\p{L}{2}", text) or regex.search(r"\p{Ll}{3}[.:;!?]\s", text):
        return False
    # Every part begins with a capital or has no case, particles aside.
    return all(not w[0].islower() or w in PARTICLES for w in regex.findall(r"[\p{L}\p{M}'’.]+", text) if w[0].isalpha())


def items(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the items of each text, in order."""
    chains, home, lines = [], [], {}
    for n, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            # A line that comes again is tagged once.
            if line not in lines:
                spans = [m.span() for m in TOKEN.finditer(line)]
                lines[line] = (len(chains), spans)
                if spans:
                    chains.append(marked(line, spans))
            number, spans = lines[line]
            if spans:
                home.append((n, at, number, spans))
            at += len(line) + 1
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    paths = [path if path.any() else None for path in tagger.decode(chains)]
    for n, at, number, spans in home:
        path = paths[number]
        if path is None:
            continue
        i = 0
        while i < len(path):
            if path[i] == 0:
                i += 1
                continue
            j, kind = i + 1, LABELS[path[i]][2:]
            while j < len(path) and LABELS[path[j]] == f"I-{kind}":
                j += 1
            a, b = at + spans[i][0], at + spans[j - 1][1]
            piece = texts[n][a:b]
            cut = piece.rstrip(" ,;:!?।>)]\"'»”" if kind != "phone" else " ,;:!?।>]\"'.")
            if kind in ("email", "address", "id_number"):
                cut = cut.rstrip(".")
            elif kind == "phone":  # digits and what separates them
                cut = regex.match(r"[\d+()\s.\-/]*(?![\d\p{L}])", cut).group().rstrip(" .-/(\t")
            if _exact(kind, cut):
                found[n].append((a, a + len(cut), kind))
            i = j
    return found


def find_items(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, items ARRAY<STRUCT<kind, text, start, end>>, redacted) for every row of ``docs`` with a text.

    ``redacted`` is the text with every item replaced by its kind in brackets, such as [EMAIL], and
    nothing else changed; start and end count code points. Null texts have no items and stay null; an
    empty or blank text has none and is returned as it is. Rows with equal keys are kept apart.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(default_tagger(), known={}))
    kept = docs.select(key, F.col(text).alias("_text")).filter("_text is not null")
    schema = f"`{key}` {kept.schema[key].dataType.simpleString()}, items array<struct<kind string, text string, start int, end int>>, redacted string"

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        gc.disable()  # nothing here refers to itself, and there are many small objects
        item = pa.struct([("kind", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and len(texts) < TEXTS and size < CHARACTERS:
                    texts.append(batch.column(1)[at + len(texts)].as_py())
                    size += len(texts[-1])
                out, clean = [], []
                for t, found in zip(texts, items(texts, tagger)):
                    out.append([{"kind": k, "text": t[a:b], "start": a, "end": b} for a, b, k in found])
                    done, pieces = 0, []
                    for a, b, k in found:
                        pieces += [t[done:a], f"[{k.upper()}]"]
                        done = b
                    clean.append("".join(pieces) + t[done:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(out, pa.list_(item)), pa.array(clean, pa.string())], names=[key, "items", "redacted"])
                at += len(texts)

    # One pass over the texts: a function in a projection is run again for every filter that looks at what it gives.
    return kept.mapInArrow(tag, schema)
