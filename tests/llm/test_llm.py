import random
import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import components, confusables, fingerprint, mixing, names, pii, pii_labels, queries, sql, tokens, vectors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# 1. Groups


def brute_groups(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    low = {}
    for x in up:
        low[root(x)] = min(x, low.get(root(x), x))
    return {x: low[root(x)] for x in up}


def test_groups_against_union_find(spark):
    rng = random.Random(2)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    star = [("hub", f"s{i:03}") for i in range(200)]
    loose = [(f"r{rng.randrange(150):03}", f"r{rng.randrange(150):03}") for _ in range(90)]
    pairs = chain + star + loose + star[:50] + [(b, a) for a, b in chain[:30]] + [("self", "self"), ("", "e")]
    df = frame(spark, pairs + [("x", None), (None, "y"), (None, None)], "a string, b string").withColumn("c", F.lit(1)).withColumn("p", F.lit("clash"))
    got = {r.id: r.group_id for r in components.connected_groups(df, "a", "b").collect()}
    assert got == brute_groups(pairs)


def test_groups_of_nothing(spark):
    empty = frame(spark, [], "a string, b string")
    assert components.connected_groups(empty, "a", "b").count() == 0
    only = frame(spark, [("z", "z"), (None, "q")], "a string, b string")
    assert [tuple(r) for r in components.connected_groups(only, "a", "b", "i", "g").collect()] == [("z", "z")]


# 2. Formatting duplicates


def test_content(spark):
    cases = {
        "Net  Profit -": "netprofit", "(£70,902b)": "(£70902b", "− 5.50 %": "-5.50%", "0.24 (as a fraction)": "0.24asafraction", "credit-to-deposit": "credittodeposit", "$ .5.": "$5", "FY2023-24": "fy202324",
        "(INR 9.9) lakhs": "(inr9.9lakhs", "-Rs. 5": "-rs5", "*Acme*_Ltd:  ‰": "acmeltd‰", "": "", "—…": "",
    }
    df = frame(spark, [(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.c for r in df.select("t", fingerprint.content(F.col("t")).alias("c")).collect()}
    assert got == cases | {None: ""}


def test_collapse(spark):
    rows = [("a", "Acme Ltd", "Net Profit", "1,000"), ("b", "net profit", "ACME  LTD.", "1000"), ("c", "Acme Ltd", "Net Profit", "-1000"), ("d", "x", "x", "y"), ("e", "y", "y", "x"), ("f", "x", "y", "x"), ("g", None, "", " "), ("h", None, None, "."),
            ("i", "q", None, None), ("j", None, "Q", ""), ("a", "Acme Ltd", "Net Profit", "1,000"), (None, "Acme Ltd", "Net Profit", "1,000"), ("long1", "w " * 50_000, "p", "v"), ("long2", "W" * 50_000, "p", "v")]
    df = frame(spark, rows, "id string, s string, p string, v string").withColumn("_key", F.lit(7)).withColumn("keep", F.lit(8))
    got = {tuple(r) for r in fingerprint.collapse(df, "id", ["s", "p", "v"]).collect()}
    assert got == {("a", "a"), ("b", "a"), ("d", "d"), ("f", "d"), ("i", "i"), ("j", "i"), ("long1", "long1"), ("long2", "long1")}
    assert fingerprint.collapse(df.limit(0), "id", ["s", "p", "v"]).count() == 0


def test_collapse_hot_group(spark):
    rows = spark.range(3000).select(F.format_string("%05d", "id").alias("id"), F.when(F.col("id") % 3 == 0, "Same").otherwise(F.format_string("t%d", "id")).alias("s"))
    got = fingerprint.collapse(rows, "id", ["s"])
    assert got.count() == 1000 and got.select("keep").distinct().count() == 1


# 3. Similar vectors


def brute_nearest(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    return {a: [ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]] for i, a in enumerate(ids)}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 16))
    x = (centres[rng.integers(300, size=3000)] + 0.25 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[:40] = x[0] * np.arange(1, 41)[:, None]  # copies in direction, more than a result can name
    ids = [f"v{i:05}" for i in range(len(x))]
    bad = [("n1", None), ("n2", []), ("n3", [0.0] * 16), ("n4", [1.0] * 3), ("n5", [float("nan")] * 16), (None, [1.0] * 16), ("n6", [None] + [1.0] * 15)]
    df = frame(spark, [(i, [float(f) for f in v]) for i, v in zip(ids, x)] + bad + [(ids[7], [float(f) for f in x[7]])], "id string, e array<float>").withColumn("vec", F.lit("clash"))
    first, rest = vectors.nearest(df, "id", "e", 5, 16)
    got = {r.id: [n.id for n in r.near] for r in first.unionByName(rest).collect()}
    want = brute_nearest(ids, x.astype(np.float64), 5)
    assert set(got) == set(ids)
    assert all(len(set(v)) == 5 and k not in v for k, v in got.items())
    assert got[ids[30]] == ids[:5] and got[ids[0]] == ids[1:6]
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in ids]) > 0.9
    few = frame(spark, [("a", [1.0, 0.0])], "id string, e array<float>")
    assert [r.near for r in vectors.nearest(few, "id", "e", 5, 2)[0].collect()] == [[]]
    assert vectors.similar_pairs(few.limit(0), "id", "e", 5, 2).count() == 0


def test_dense_region_is_cut_and_lonely_queries_ask_everywhere(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=8) * 3 + 0.01 * rng.normal(size=(900, 8)), rng.normal(size=(60, 8))]).astype(np.float32)
    ids = [f"v{i:04}" for i in range(len(x))]
    df = frame(spark, [(i, [float(f) for f in v]) for i, v in zip(ids, x)], "id string, e array<float>")
    for name, value in (("LIST_SIZE", 4), ("BLOCK", 60), ("ASK_BLOCK", 80), ("WHOLE_BLOCK", 200)):
        monkeypatch.setattr(vectors, name, value)
    sizes, plain = spark.sparkContext.accumulator(0), vectors.compare

    def watched(pdf, k, dims):
        sizes.add(int(len(pdf) > 600))
        return plain(pdf, k, dims)

    monkeypatch.setattr(vectors, "compare", watched)
    got = {r.id: [n.id for n in r.near] for f in vectors.nearest(df, "id", "e", 5, 8) for r in f.collect()}
    assert sizes.value == 0 and all(len(set(v)) == 5 for v in got.values()) and set(got) == set(ids)


def test_rounds_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(60, size=1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[5:9] = x[4]
    ids = [f"v{i:05}" for i in rng.permutation(len(x))]
    df = frame(spark, [(i, [float(f) for f in v]) for i, v in zip(ids, x)] + [(ids[3], [float(f) for f in x[1400]])], "id string, e array<float>")
    monkeypatch.setattr(vectors, "LIST_SIZE", 30)
    answers, moved = [], []
    for rows in (10**9, 50):
        monkeypatch.setattr(vectors, "ROUND_ROWS", rows)
        calls, plain = [], vectors._compared
        monkeypatch.setattr(vectors, "_compared", lambda df, *a: (calls.append(df.count()), plain(df, *a))[1])
        answers.append(sorted(map(tuple, vectors.similar_pairs(df, "id", "e", 5, 16).collect())))
        monkeypatch.setattr(vectors, "_compared", plain)
        moved.append(calls)
    assert answers[0] == answers[1] and len(moved[0]) == 1 and len(moved[1]) > 1
    assert sum(moved[1]) == moved[0][0] and max(moved[1]) < 1.5 * len(x)


def test_vectors_are_packed_without_loss(spark):
    u = np.random.default_rng(2).normal(size=(50, 16))
    u /= np.linalg.norm(u, axis=1)[:, None]
    u[0], u[1] = np.eye(16)[0], -np.eye(16)[1]
    got = vectors.directions(frame(spark, [(str(i), v.tolist()) for i, v in enumerate(u)], "id string, e array<double>"), "id", "e", 16).collect()
    assert all(len(r.vec) == 48 for r in got)
    assert (vectors.unpack([r.vec for r in got], 16) == np.round(u[[int(r.id) for r in got]], 6).astype(np.float32)).all()


def test_driver_needs_little_memory_for_many_lists():
    c = np.random.default_rng(3).normal(size=(6000, 8)).astype(np.float32)
    tracemalloc.start()
    vectors.neighbour_graph(c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_graph_walk_finds_near_centroids():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(700, 24)).astype(np.float32)
    near, entries = vectors.neighbour_graph(c)
    x = (c[rng.integers(700, size=500)] + 0.1 * rng.normal(size=(500, 24))).astype(np.float32)
    got, d2 = vectors.nearest_lists(x, c, near, entries, 3)
    exact = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
    assert (got[:, 0] == exact).mean() > 0.9 and (np.diff(d2, axis=1) >= -1e-4).all()


# 6. Names

REGISTER = [(1, "Pergudorn Shipping Limited", "company"), (2, "Bencoandety Energy Company", "company"), (3, "Central Bank of Giadasha", "agency"), (4, "Michael Skiavstad", "person"), (5, "Katherine Skölmoway", "person"),
            (6, "Francisco Skölmoway", "person"), (7, "Kingdom of Alwaessergia", "place"), (8, "Hirvune & Shoarthusk Technologies GmbH", "company"), (9, "William H. Bildquist", "person"), (10, "Ann Lee", "person"), (11, "Abe Lee", "person")]
SPELLINGS = {
    "pergudorn shipping limited": None, "PERGUDORN-SHIPPING  Limited.": None, "The Pergudorn Shipping Ltd": 1, "Pegrudorn Shippinng Limited": 1, "Shipping Pergudorn Limited": 1, "Pergudorn Shipping": 1, "PergudornShipping Ltd": 1, "Pergudorn Foods Limited": None,
    "Bencoandety Financial Services Corporation": None, "Bencoandety Energy Co": 2, "C.B.G.": 3, "CBG": 3, "Mike Skiavstad": 4, "Skiavstad, M.": 4, "Dr Michael Skiavsatd": 4, "K. Skolmoway": 5, "Skolmoway": None, "Paco Skölmoway": 6, "Alwaessergia": 7,
    "Hirvune and Shoarthusk Tech": 8, "Hirvune & Shoarthusk Technologies Gesellschaft mbH": 8, "Bildquist W": 9, "Maria Skiavstad": None, "operating surplus": None, "A. Lee": None, "": None, "   ": None, "—": None, "x" * 5000: None,
}


def test_names(spark):
    register = frame(spark, REGISTER + [(12, None, "company")], "entity_id long, entity_name string, entity_kind string").withColumn("x", F.lit(0))
    typed = frame(spark, [(s,) for s in SPELLINGS] + [(None,), ("Mike Skiavstad",)], "spelling string").withColumn("k", F.lit("clash"))
    got = {r.spelling: r.entity_id for r in names.variants(typed, "spelling", register, "entity_id", "entity_name", "entity_kind").collect()}
    assert got == {k: v for k, v in SPELLINGS.items() if v}
    assert names.variants(typed.limit(0), "spelling", register, "entity_id", "entity_name", "entity_kind").count() == 0
    assert names.variants(typed, "spelling", register.limit(0), "entity_id", "entity_name", "entity_kind").count() == 0


def test_edits():
    assert [names.edits(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abcd", "abd"), ("abc", "xyz"), ("a", "abcd"))] == [0, 1, 1, 3, 3]


@pytest.mark.parametrize("typed, name", [("jim", "james"), ("tom", "thomas"), ("joe", "joseph"), ("sue", "susan"), ("dave", "david"), ("raju", "rajendra"), ("sammy", "samuel"), ("nora", "leonora"), ("peg", "margaret")])
def test_short_forms(typed, name):
    assert names.called(typed, name)


def test_full_names_are_no_short_forms():
    assert not any(names.called(a, b) for a, b in (("mary", "martha"), ("anna", "annabel"), ("jo", "jonas"), ("james", "jameson"), ("bob", "william")))


def test_prefix_misses_no_name_with_enough_weight():
    rng = random.Random(8)
    pool = [f"g{i}" for i in range(40)]
    held = [set(rng.choices(pool, [1 / (i + 1) for i in range(40)], k=8)) for _ in range(60)]
    counts = np.zeros(names.BUCKETS, dtype=np.int64)
    for h in held:
        for g in h:
            counts[names._bucket(g)] += 1
    weight = {g: np.log(1 + 60 / counts[names._bucket(g)]) if counts[names._bucket(g)] else np.log(2) for g in pool}
    for _ in range(300):
        typed = sorted(set(rng.choices(pool, k=9)))
        kept = set(names.prefix(typed, counts, 60))
        for h in held:
            if sum(weight[g] for g in h & set(typed)) >= names.WEIGHED * sum(weight[g] for g in typed):
                assert kept & h


# 7. Look-alike text


@pytest.mark.parametrize(
    "text, form",
    [("рrofit of Аcme", "profit of Acme"), ("ｒａｔｅ １２", "rate 12"), ("proﬁt", "profit"), ("a b c　d", "a b c d"), ("bor​rowings­", "borrowings"), ("Brúgn", "Brúgn"), ("stɑtus ɡross ⅼine", "status gross line")],
)
def test_disguises(text, form):
    assert confusables.consistent(text) == form and confusables.consistent(form) == form
    assert confusables.skeleton(text) == confusables.skeleton(form)


@pytest.mark.parametrize("text", ["Brugnquíst-Sentoway", "a – b — “c” … ‘d’", "m² ³ ½ ₹ € £ ‰", "(отчёт) отчет", "रिपोर्ट के अनुसार", "«Ведомость» № 7", "👩‍💻 ✅", "", "plain", "ÅÄÖ ẞ ŁÓDŹ"])
def test_no_disguises(text):
    assert confusables.consistent(text) == text


def test_unify(spark):
    rows = [(1, "prоfit"), (2, "profit"), (3, None), (4, ""), (5, "отчёт"), (6, "x" * 200_000 + "​"), (7, "proﬁt"), (7, "proﬁt")]
    df = frame(spark, rows, "id int, t string").withColumn("form", F.lit("clash"))
    got = {(r.id, r.disguised) for r in confusables.unify(df, ["id"], "t").collect()}
    assert got == {(1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (7, True)}
    groups = {r.skeleton: (r.rows, r.originals, r.disguised_rows) for r in confusables.same_look(df, ["id"], "t").collect()}
    assert groups == {"profit": (4, 3, 3)}
    assert confusables.disguised(df.limit(0), ["id"], "t").count() == 0


def test_every_look_alike_in_a_latin_word_is_found(spark):
    rows = [(c, f"ab{c}cd") for c in confusables.LOOKALIKES] + [("1", "pαyment"), ("2", "banк"), ("3", "банк τκω"), ("4", "Pervíldix – α"), ("5", "q\u0303x"), ("6", "Ꭺpple ꓐank ꓲncome Ⲣrice ⲟil Ꮯost"), ("7", "ꓐꓮ Ꭰ ⲟⲣ")]
    got = {r.id: r.form for r in confusables.disguised(frame(spark, rows, "id string, t string"), ["id"], "t").collect()}
    assert got == {c: f"ab{p}cd" for c, p in confusables.LOOKALIKES.items()} | {"1": "payment", "2": "bank", "5": "qx", "6": "Apple Bank Income Price oil Cost"}


def test_skeleton_decides_before_the_exclusions():
    odd = [c for c in map(chr, range(0x21, 0x30000)) if not 0xD800 <= ord(c) < 0xE000]
    assert [c for c in odd if confusables.read_look(f"ab{c}cd")[0] != confusables.consistent(f"ab{c}cd")] == []


def test_same_look_of_accented_texts(spark):
    rows = [(1, "Pervíldix stood at 5 – net"), (2, "Pervíl\u200bdix stood at 5 – net"), (3, "Pervi\u0301ldix stood at 5 – net"), (4, "Pervildix stood at 5 – net"), (5, "отчёт"), (6, "отчёт\u200b")]
    df = frame(spark, rows, "id int, t string")
    groups = {(r.rows, r.originals, r.disguised_rows) for r in confusables.same_look(df, ["id"], "t").collect()}
    assert groups == {(3, 3, 2), (2, 2, 1)}


def test_jvm_filter_lets_every_disguise_pass(spark):
    odd = [c for c in map(chr, range(0x21, 0x10000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = [f"ab{c}cd" for c in odd]
    df = frame(spark, [(t,) for t in texts], "t string")
    passed = {r.t for r in df.filter(confusables.suspect(F.col("t"))).collect()}
    assert [t for t in texts if confusables.consistent(t) != t and t not in passed] == []


# 8. Encoding

TEXTS = ["Revenue rose 5.5% — it's fine.", "  two  spaces\t\ttabs\n\nlines  　x ", "<|endoftext|> is text", "हिन्दी 数字 👩‍💻🚚 é é", "don't WE'LL 'S", "\x1c\x85  a", " ", "\n", "a" * 70_000, "Ⅷ² ½ x_y__z"]


def test_encoding(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, ""), (102, TEXTS[0])]
    df = frame(spark, rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("_word", F.lit(1))
    tool = tokens.encoder(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, "doc_id", "text").collect()}
    assert got == {i: tool.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    counts = {r.doc_id: r.tokens for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in rows}
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_cold_words_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HOT_WORDS", 2)
    df = frame(spark, [(1, "the the the cat sat"), (2, "the dog")], "doc_id long, text string")
    tool = tokens.encoder(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    assert {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, "doc_id", "text").collect()} == {1: tool.encode("the the the cat sat").ids, 2: tool.encode("the dog").ids}


# 9. Mixing


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "big" if i % 3 else ("mid" if i % 2 else "tiny"), rng.randrange(1, 120)) for i in range(6000)]
    rows = [r for r in rows if r[1] != "tiny" or r[0] % 60 == 0] + [(9001, "other", 50), (9002, None, 5), (9003, "big", 0)]
    sizes = frame(spark, rows, "doc_id long, source string, tokens long").withColumn("slot", F.lit("clash"))
    targets = frame(spark, [("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 3), ("absent", 0.05, 2), (None, 0.1, 1), ("mid", None, 1)], "source string, target_share double, max_repeats int")
    mixed, plan = mixing.mix(sizes, "doc_id", targets)
    rows_ = mixed.collect()
    used = Counter(r.doc_id for r in rows_)
    source = {r[0]: r[1] for r in rows}
    limit = {"big": 1, "mid": 2, "tiny": 3}
    assert all(n <= limit[source[d]] for d, n in used.items()) and len({(r.doc_id, r.use) for r in rows_}) == len(rows_)
    shares = {r.source: r for r in mixing.shares(mixed, "doc_id", plan).collect()}
    for name, want in (("big", 0.5 / 0.95), ("mid", 0.3 / 0.95), ("tiny", 0.15 / 0.95)):
        assert shares[name].actual_share == pytest.approx(want, abs=0.02)
    assert shares["absent"].actual_share == 0 and set(shares) == {"big", "mid", "tiny", "absent"}
    # Every prefix is close to the shares, not only the whole.
    half = [r for r in rows_ if r.slot < plan.slots // 2]
    assert sum(r.tokens for r in half if r.source == "big") / sum(r.tokens for r in half) == pytest.approx(0.5 / 0.95, abs=0.04)
    assert mixing.mix(sizes.limit(0), "doc_id", targets)[0].count() == 0
    assert mixing.mix(sizes, "doc_id", targets.limit(0))[0].count() == 0


# 10. Personal information


def test_tagger_on_frames_it_has_not_seen():
    tagger = pii.train(pii_labels.labelled_texts(part=0))
    held = pii_labels.labelled_texts(8, seed=77, part=1)
    right = found = true = 0
    for (text, gold), got in zip(held, pii.items([t for t, _ in held], tagger)):
        right += len(set(gold) & set(got))
        found += len(got)
        true += len(gold)
    assert right / true > 0.85 and right / found > 0.9


FREE = {
    "You can email jane.doe@contoso.com with any documents.": [("email", "jane.doe@contoso.com")],
    "Text me at 555-867-5309 tonight.": [("phone", "555-867-5309")],
    "My SSN is 123-45-6789.": [("id_number", "123-45-6789")],
    "Please give this to Robert Miller before noon.": [("person_name", "Robert Miller")],
    "Dr. Susan Calvin wrote the paper.": [("person_name", "Susan Calvin")],
    "I live at 742 Evergreen Terrace, Springfield, OR 97403.": [("address", "742 Evergreen Terrace, Springfield, OR 97403")],
    "Nurse Betty Cooper said so.": [("person_name", "Betty Cooper")],
    "Tel. 0711/123456": [("phone", "0711/123456")],
    "Order 123-4567 shipped.": [],
    "The contract with Tata Steel Limited ends in 2024.": [],
    "Invoice 2021/0045 of 12.03.2021 for Siemens AG.": [],
    "The office of Johnson & Johnson is closed.": [],
}


def test_free_sentences():
    found = pii.items(list(FREE), pii.default_tagger())
    assert {t: [(k, t[a:b]) for a, b, k in f] for t, f in zip(FREE, found)} == FREE


def test_items_and_placeholders(spark):
    texts = ["Regards, Anna Miller\nPhone: +44 20 7946 0123, ask for the manager.", "Email: a.norris@desk.test", "The Harbour Road bridge stayed closed.", "", "   ", None, "Headcount rose. " * 3000 + "Regards, Mark Varney"]
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string").withColumn("items", F.lit("clash"))
    got = {r.doc_id: r for r in pii.find_items(df, "doc_id", "text").collect()}
    assert set(got) == {0, 1, 2, 3, 4, 6}
    assert {(i.kind, i.text) for i in got[0]["items"]} == {("person_name", "Anna Miller"), ("phone", "+44 20 7946 0123")}
    assert got[0].redacted == "Regards, [PERSON_NAME]\nPhone: [PHONE], ask for the manager." and got[1].redacted == "Email: [EMAIL]"
    assert [got[i].redacted for i in (2, 3, 4)] == texts[2:5] and got[6].redacted.endswith("Regards, [PERSON_NAME]")
    assert pii.find_items(df.limit(0), "doc_id", "text").count() == 0


def test_a_text_is_tagged_once(spark, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), pii.items

    def counted(texts, tagger):
        seen.add(len(texts))
        return plain(texts, tagger)

    monkeypatch.setattr(pii, "items", counted)
    monkeypatch.setattr(pii, "CHARACTERS", 100, raising=False)
    text = "Regards, Anna Miller\nPhone: +44 20 7946 0123, ask for the manager."
    found = pii.find_items(frame(spark, [(i, text) for i in range(9)], "doc_id long, text string"), "doc_id", "text")
    flat = found.select("doc_id", F.explode("items").alias("x")).select("doc_id", "x.kind", "x.text")
    assert Counter((r.kind, r.text) for r in flat.collect()) == {("person_name", "Anna Miller"): 9, ("phone", "+44 20 7946 0123"): 9}
    assert seen.value == 9


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger({}, np.zeros((9, 0, pii.NL), dtype=np.float32), rng.normal(size=(pii.NL, pii.NL)).astype(np.float32))
    e = rng.normal(size=(3, 3, pii.NL)).astype(np.float32)
    size = np.array([3, 2, 1])
    paths = tagger._viterbi(e, size)
    import itertools

    for n, t in enumerate(size):
        def score(p):
            s = e[n, 0, p[0]] + pii._START[p[0]]
            return s + sum(tagger.moves[a, b] + pii._ALLOWED[a, b] + e[n, i + 1, b] for i, (a, b) in enumerate(itertools.pairwise(p)))
        best = max(itertools.product(range(pii.NL), repeat=int(t)), key=score)
        assert tuple(paths[n, :t]) == best


# Queries


def test_queries_against_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    for t in ("relations", "documents", "claims"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, text in sql.ORACLE.items():
        df = queries.QUERIES[name](spark, small)
        cur = con.execute(text)
        cols = [d[0] for d in cur.description]
        want = Counter(tuple(str(dict(zip(cols, r))[c]) for c in sorted(cols)) for r in cur.fetchall())
        assert Counter(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want, name


def test_found_columns(spark, small):
    columns = {"p1_found": ["claim_id", "group_id"], "p2_found": ["claim_id", "keep_id"], "p3_found": ["claim_lo_id", "claim_hi_id"], "p6_found": ["claim_id", "claim_field", "entity_id"], "p7_found": ["claim_id", "claim_field"],
               "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "pii_kind", "pii_text"]}
    for name, want in columns.items():
        df = queries.QUERIES[name](spark, small)
        assert df.columns == want and df.count() > 0, name
    assert unicodedata and pd is not None


def test_cells_are_only_those_a_vector_visits(spark):
    rows = spark.range(300).selectExpr("0 as list", "40 as blocks", "3 as ask_blocks", "id % 5 > 0 as stored", "id % 50 = 0 as asks", "id as rep", "array(cast(0 as long)) as more", "binary('x') as vec")
    got = vectors._cells(rows).collect()
    of = {r.rep: r for r in rows.selectExpr("rep", "stored", "asks", "pmod(xxhash64(rep), 40) as b", "pmod(shiftright(xxhash64(rep), 8), 3) as q").collect()}
    every = [(r, b, q, r.stored and r.b == b, r.asks and r.q == q) for r in of.values() for b in range(40) for q in range(3)]
    assert sorted((r.rep, r.block, r.ask_block, r.stored, r.asks) for r in got) == sorted((r.rep, b, q, s, a) for r, b, q, s, a in every if s or a)


def test_a_block_of_all_vectors_is_compared_in_little_memory():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pdf = pd.DataFrame({"stored": True, "asks": [i < 900 for i in range(len(x))], "rep": range(len(x)), "more": [[] for _ in x], "vec": vectors.pack(x)})
    tracemalloc.start()
    out = vectors.compare(pdf, 5, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 900 and peak < 150e6
