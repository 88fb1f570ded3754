import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import similarity
from ledgerloom.operators import cascade, extraction, grids, grounding, matching, orphans
from ledgerloom.plans import queries
from ledgerloom.sources import store
from ledgerloom.streaming import incremental

ROW = (
    "claim_id string, doc_id string, subject string, predicate string, value string, value_num double, unit string, ctx_period string, ctx_unit string, ctx_scope string, ctx_basis string, "
    "ctx_geography string, ctx_as_of string, ctx_denominator string, modality string, origin string, final_confidence double, quarantined boolean, created_at double, clash string"
)
FIELDS = [x.split()[0] for x in ROW.split(", ")]


def claim(cid, **kw):
    base = dict.fromkeys(FIELDS) | {"claim_id": cid, "doc_id": f"doc{cid}", "subject": "Acme Corp", "predicate": "sales of ice", "modality": "reported", "origin": "sentence", "final_confidence": 0.9, "quarantined": False, "created_at": 1.0}
    return tuple((base | kw)[f] for f in FIELDS)


FY = {"ctx_period": "FY22"}
CRORE, MILLION = {"ctx_unit": "INR crore"}, {"ctx_unit": "INR million"}
LAND = {"subject": "Kordavia"}
WIDE = dict(predicate="sales", value="640", **CRORE, **FY)
# One pair of claims for every rule, some for two sides of it.
PAIRS = [
    (dict(value="517", **CRORE, **FY), dict(value="5,168.2", **MILLION, **FY), "R40"),
    (dict(value="517", **CRORE, **FY), dict(value="517", **CRORE, ctx_period="financial year 2021-22"), "R40"),
    (dict(predicate="vessels owned", value="31", **FY), dict(predicate="vessels owned", value="44", **FY), "R70"),
    (dict(subject="Kordavia Limited", predicate="wage inflation", value="7.9%", ctx_period="FY21"), dict(predicate="inflation of wages", value="6.1%", ctx_period="FY21", **LAND), "R70"),
    (dict(value="455.1", ctx_scope="standalone", **MILLION, **FY), dict(value="517.7", ctx_scope="consolidated", **MILLION, **FY), "R50"),
    (dict(value="517", **CRORE, **FY), dict(value="131", **CRORE, ctx_period="Q2 FY22"), "R50"),
    (dict(predicate="harvest growth", value="2.3%", ctx_period="FY23", modality="estimate", **LAND), dict(predicate="harvest growth", value="3.1%", ctx_period="FY23", modality="revised", **LAND), "R20"),
    (WIDE, dict(predicate="sales of cold storage", value="512", **CRORE, **FY), "R10"),
    (WIDE, dict(predicate="sales of ice cutting tools", value="9", **CRORE, **FY), "R11"),
    (dict(predicate="sales", value="640", **CRORE, **FY), dict(predicate="sales of cold storage", value="none stated", **FY), "R12"),
    (dict(predicate="savings rate", value="11.2%", ctx_period="FY23"), dict(predicate="savings rate", value="11.23%", ctx_period="FY23"), "R40"),
    (dict(predicate="loan coverage ratio", value="64.5", origin="table", ctx_period="2020-21", ctx_scope="Total", **LAND), dict(predicate="loan coverage ratio", value="69.9", origin="table", ctx_period="2020/21", **LAND), "R70"),
    (dict(predicate="vessels owned", value="31"), dict(predicate="sales", value="640", **CRORE), "R01"),
    (dict(subject="Kordavia", predicate="wage inflation", value="7.9%"), dict(predicate="wage inflation", value="6.1%"), "R00"),
    (dict(predicate="sales", value="21.0%", **FY), dict(predicate="sales", value="8.8%", **FY), "R61"),
    (dict(value="455.1", ctx_scope="standalone", **MILLION, **FY), dict(value="517.7", **MILLION, **FY), "R60"),
    (dict(predicate="loans", value="4.4", origin="table", ctx_period="2019-20", **LAND), dict(predicate="loans", value="-1.9", origin="table", ctx_period="2019/20", **LAND), "R62"),
    (dict(value="200", ctx_unit="USD million", **FY), dict(value="248", ctx_unit="USD million", **FY), "R40"),
    (dict(value="5.5%", **FY), dict(value="5.5", ctx_unit="USD million", **FY), "R02"),
    (dict(value="517", ctx_scope="standalone", **CRORE, **FY), dict(value="517", ctx_scope="consolidated", **CRORE, **FY), "R51"),
    (dict(predicate="status", value="retired", **FY), dict(predicate="status", value="retired", **FY), "R30"),
    (dict(predicate="status", value="joined", ctx_period="FY20"), dict(predicate="status", value="left", ctx_period="FY22"), "R31"),
    (dict(predicate="status", value="active as treasurer"), dict(predicate="status", value="retired"), "R32"),
    (dict(predicate="status", value="relocated"), dict(predicate="status", value="merged"), "R33"),
    (dict(predicate="vessels owned", value="31", **FY), dict(predicate="vessels owned", value="several", **FY), "R99"),
]


def test_every_rule_is_met():
    assert {p[2] for p in PAIRS} == {r[0] for r in cascade.RULES}


def judged(spark, pairs):
    rows = [claim(f"{i}{s}", **kw) for i, p in enumerate(pairs) for s, kw in zip("ab", p)]
    df = spark.createDataFrame(rows, ROW)
    ids = spark.createDataFrame([(f"{i}a", f"{i}b") for i in range(len(pairs))], "a_id string, b_id string")
    return cascade.compare(cascade.sides(ids, df).drop("a_id", "b_id")), df, ids


def test_verdicts(spark):
    out, df, ids = judged(spark, [p[:2] for p in PAIRS])
    got = {int(r.claim_a_id[:-1]): r for r in out.collect()}
    assert [got[i].rule_id for i in range(len(PAIRS))] == [p[2] for p in PAIRS]
    assert got[3].value_delta["percentage_point_difference"] == pytest.approx(1.8)
    assert set(got[4].context_diff) == {"scope"}
    assert got[2].confidence == pytest.approx(0.9 * 0.85)
    related = cascade.compare(cascade.sides(ids, df).drop("a_id", "b_id"), unrelated=False)
    assert {r.relation_id: r.rule_id for r in related.collect()} == {r.relation_id: r.rule_id for r in got.values() if r.kind != "unrelated"}
    turned = cascade.compare(cascade.sides(ids.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id")), df).drop("a_id", "b_id"))
    assert {r.relation_id: r.kind for r in turned.collect()} == {r.relation_id: r.kind for r in got.values()}


def test_counterfactuals_and_missing_sides(spark):
    out, df, ids = judged(spark, [PAIRS[4][:2]])
    rows = cascade.counterfactuals(cascade.sides(ids, df).drop("a_id", "b_id")).collect()
    assert {(r.field, r.new_rule_id) for r in rows} == {("scope", "R70")}
    lost = spark.createDataFrame([("0a", "zz"), (None, "0a")], "a_id string, b_id string")
    assert cascade.sides(lost, df).count() == 0


def test_cap_precision(spark):
    out, df, ids = judged(spark, [PAIRS[17][:2]])
    strict = cascade.compare(cascade.sides(ids, df).drop("a_id", "b_id"), cascade.Tolerance(cap_precision=True))
    assert strict.first().rule_id == "R70"


def brute_candidates(rows, k):
    def sim(a, b):
        x, y = set(a["words"]), set(b["words"])
        return len(x & y) / len(x | y) if x | y else 0
    out = set()
    for a in rows:
        near = sorted(((sim(a, b), b["id"]) for b in rows if b["doc"] != a["doc"] and (a["cluster"], a["kind"]) == (b["cluster"], b["kind"]) and sim(a, b) > 0), reverse=True)[:k]
        out |= {tuple(sorted((a["id"], b))) for _, b in near}
    return out


def test_candidates_against_brute_force(spark):
    rng = random.Random(5)
    words = "net gross revenue margin inflation price".split()
    # One document and one property hold a third of all claims.
    rows = [dict(id=f"{i:03}", doc="d0" if i % 3 == 0 else f"d{rng.randrange(6)}", cluster=rng.choice("xy"), kind="rate", words=["revenue"] if i % 3 == 1 else sorted(rng.sample(words, rng.randrange(1, 4)))) for i in range(150)]
    df = spark.createDataFrame(pd.DataFrame(rows))
    for k in (3, 15):
        assert {(r.a_id, r.b_id) for r in matching.candidate_pairs(df, k).collect()} == brute_candidates(rows, k)
    assert matching.candidate_pairs(df.limit(0)).count() == 0


def test_gates(spark):
    rows = [
        ("Acme Limited", "Acme", True, 1.0), ("Acme", "Acme Steel Works", True, 0.9), ("Norwick Port Trustees", "NPT", True, 0.9), ("Acme Steel Works", "Acme Steel Work", True, None), ("Acme", "Zenith", False, None), ("", "Acme", False, 0.0),
        ("Limited", "Acme", False, 0.0), (None, "Acme", False, 0.0), ("Norwick", "norwick.", True, 1.0),
    ]
    words = [
        ("gross domestic product", "GDP", "same", 1.0), ("net sales", "gross sales", "related", 0.0), ("sales", "sales of ice", "same", 0.85), ("price", "price growth", "related", 0.5), ("sales", "sales of cold ice cutters", "related", None),
        ("harbour dues", "harbor dues", "same", None), ("sales", "headcount", "different", None), ("", "sales", "different", 0.0), (None, None, "different", 0.0),
    ]
    df = spark.createDataFrame([(i, a[0], a[1], b[0], b[1]) for i, (a, b) in enumerate(zip(rows, words))], "i int, a_subject string, b_subject string, a_predicate string, b_predicate string")
    df = matching.described(matching.described(df, "a_"), "b_")
    got = {r.i: r for r in matching.with_predicate_gate(matching.with_entity_gate(df)).collect()}
    assert [got[i].ent_ok for i in range(len(rows))] == [r[2] for r in rows] and [got[i].pred_verdict for i in range(len(words))] == [w[2] for w in words]
    assert all(r[3] is None or got[i].ent_score == r[3] for i, r in enumerate(rows)) and all(w[3] is None or got[i].pred_score == w[3] for i, w in enumerate(words))


def greedy(names, same):
    reps, out = [], {}
    for s in sorted(set(names), key=lambda s: (-len(s), s)):
        hit = next((r for r in reps if (s, r) in same), None)
        if hit is None:
            reps.append(s)
        out[s] = hit or s
    return out


def test_clusters_are_the_sequential_ones(spark):
    names = ["Acme Limited", "Acme", "Acme Steel Works", "Acme Steel Work", "Federation of Kordavia", "Kordavia", "Norwick Port Trustees", "NPT", "Bank", "Nova Foods plc", "Nova Food plc", "Novo Foods", "Torvix Energy", "Energy Torvix Ltd", "acme ltd.", "ACME  Ltd", ""]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "subject string")
    got = {r.subject: r.cluster for r in matching.cluster_entities(df).collect()}
    one = matching.described(df.filter("subject is not null").withColumn("predicate", F.lit(""))).filter("key <> ''")
    left, right = (one.select(*[F.col(c).alias(f"{s}_{c}") for c in ("subject", "key", "full", "initials")]) for s in "ab")
    same = {(r.a_subject, r.b_subject) for r in matching.with_entity_gate(left.crossJoin(right)).filter("ent_ok").collect()}
    key = {r.subject: r.key for r in one.collect()}
    want = greedy(list(key), same)
    assert got == {n: key[want[n]] for n in key}


def test_one_name_in_many_spellings_is_one_node(spark):
    df = spark.createDataFrame([("Acme Works" + "." * (i % 40) + " " * (i // 40),) for i in range(1600)], "subject string")
    assert matching.name_nodes(df).count() == 1 and matching.cluster_entities(df).select("cluster").distinct().collect()[0][0] == "acme works"


def test_spellings_do_not_all_meet_each_other(spark, monkeypatch):
    rng = random.Random(5)
    names = set()
    while len(names) < 240:
        word = list("drumbivolentagorska" + "manufactur" * rng.randint(0, 1))
        for _ in range(rng.randint(0, 2)):
            word[rng.randrange(len(word))] = rng.choice("abcdefgh")
        names.add(rng.choice(["Drum ", "The Drum ", "Old Drum and "]) + "".join(word) + rng.choice(["", "s", "ss", "sss"]))
    df = spark.createDataFrame([(n,) for n in sorted(names)], "subject string")
    gate, met = matching.with_entity_gate, []

    def counted(pairs, *sides):
        met.append(pairs.count())
        return gate(pairs, *sides)

    monkeypatch.setattr(matching, "with_entity_gate", counted)
    found = []
    for turn in (1_000_000, 60):
        monkeypatch.setattr(matching, "TURN", turn, raising=False)
        met.clear()
        found.append(({tuple(r) for r in matching.cluster_entities(df).collect()}, sum(met)))
    assert found[0][0] == found[1][0] and found[1][1] < found[0][1] / 2


def test_clustered_candidates_compare_fewer_names(spark, small, monkeypatch):
    gate, met = matching.with_entity_gate, []

    def counted(pairs, *sides):
        met.append(pairs.count())
        return gate(pairs, *sides)

    monkeypatch.setattr(matching, "with_entity_gate", counted)
    found = []
    for turn in (1_000_000, 100):
        monkeypatch.setattr(matching, "TURN", turn, raising=False)
        met.clear()
        found.append(({tuple(r) for r in queries.candidate_pairs_clustered(spark, small).collect()}, sum(met)))
    assert found[0][0] == found[1][0] and found[1][1] < found[0][1]


def test_pieces_of_names_meet_once(spark, monkeypatch):
    names = [f"{a} {b} Works" for a in ("Acme", "Acmee", "Akme", "Zenith", "Zenit") for b in ("Steel", "Steels", "Foods", "Food")]
    nodes = matching.indexed(matching.name_nodes(spark.createDataFrame([(n,) for n in names], "subject string")))
    whole = {tuple(r) for r in matching._spelt_alike(nodes, None).filter("a < b").collect()}
    want = {(a, b) for a in names for b in names if a < b and similarity.token_sort_ratio(a.lower(), b.lower()) >= matching.ENTITY_RATIO}
    monkeypatch.setattr(matching, "PIECE", 3)
    cut = [(min(r), max(r)) for r in matching._spelt_alike(nodes, None).collect() if r.a != r.b]
    one, other = nodes.filter("head < 'Az'"), nodes.filter("head >= 'Az' or head like '%Food%'")
    assert whole == want == set(cut) and {tuple(sorted(r)) for r in matching._spelt_alike(one, other).collect() if r.a != r.b} <= want


def test_confirmed_components(spark):
    parts = [("w", "sales", 100.0), ("p1", "sales of ice", 60.0), ("p2", "sales of salt blocks", 38.0), ("p3", "sales of ice", 20.0)]
    df = spark.createDataFrame([claim(i, predicate=p, value=str(v), value_num=v, **FY) for i, p, v in parts], ROW)
    ids = spark.createDataFrame([("w", "p1"), ("p2", "w"), ("w", "p3")], "a_id string, b_id string")
    found = cascade.compare(cascade.sides(ids, df).drop("a_id", "b_id"))
    out = {tuple(sorted((r.claim_a_id, r.claim_b_id))): r for r in cascade.with_confirmed_components(found.withColumn("rule_id", F.lit("R10")).withColumn("component", F.coalesce("component", F.lit(None)))).collect()}
    raised = {k for k, r in out.items() if r.component_confirmed}
    assert raised <= {("p1", "w"), ("p2", "w"), ("p3", "w")}


def test_extraction(spark):
    raw = "In the year, Acme Limited reported growth.\nThe board of Acme Limited met. Revenue of Acme Limited was ₹3,377 crore in FY22. See page 12. Costs of Acme Limited increased by 4.5% in FY22.\nFor years Acme Limited led.\nSince May the firm Acme Limited has grown. John Smith of Acme Limited resigned as director in March 2024."
    pages = spark.createDataFrame([("d", 1, raw), ("d", 2, None), ("e", 1, "")], "doc_id string, page_no int, raw string")
    rows = extraction.extract_claims(pages).collect()
    money = next(r for r in rows if r.value == "₹3,377 crore")
    assert (money.subject, money.value_num, money.ctx_period, money.unit) == ("Acme Limited", 3.377e10, "FY22", "INR crore")
    assert any(r.predicate.endswith("(change)") for r in rows) and not any(r.value == "12" for r in rows)
    assert any(r.predicate == "status" and r.value.startswith("resigned") for r in rows)
    assert all(raw[r.char_start : r.char_end].strip() == r.span_text for r in rows)


def test_files_have_their_own_entities(spark, tmp_path):
    def passage(i, file, page, name):
        return (i, f"The chairman of {name} spoke today.\nA note on {name} was filed.", "reports", file, page)

    rows = [passage(i, f" F{i:02} ", 1, f"Quovundi Foods {'Abcdefghijklmnopqrstuvwxyz'[i % 26].upper()}lenta Limited") for i in range(40)]
    rows += [passage(50, "F00", 2, "Late Page Limited"), (51, "second of the page", "reports", "f00", 2), passage(52, None, None, "Hirvune Steel Limited"), (53, None, "reports", "F00", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, source_doc_id string, page_no int").write.parquet(f"{tmp_path}/documents.parquet")
    pages = {(r.doc_id, r.page_no): r.raw for r in queries._pages(spark, str(tmp_path)).collect()}
    assert len(pages) == 42 and [raw for (_, n), raw in pages.items() if n == 2] == [rows[40][1] + "\nsecond of the page"]
    found = {r.doc_id: r.primary for r in queries.detected_entities(spark, str(tmp_path)).collect()}
    assert len(found) == 41 and found["#52"] == "Hirvune Steel Limited" and set(found) == {d for d, _ in pages}


def test_labels(spark):
    names = ["sales", "net profit", "cpi inflation", "headcount", "net", "total", "real", "consolidated", "estimate", "FY24", "ab", "", "a (b", "12 mn tonnes", "May 2020", "%%%%%"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, t string")
    assert [r.ok for r in df.select("i", extraction.plausible(F.col("t")).alias("ok")).orderBy("i").collect()] == [True] * 4 + [False] * 12
    texts = {
        "growth of 6.5 percent in FY25, real GDP": "real GDP", "First line\nthe freight carried in 2021": "freight carried", "Sales rose while the cost of ice (2)": "cost of ice", "it was the ice, and also salt": "also salt",
        "": "", "Ports; harbour dues": "harbour dues",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", extraction.property_name(F.col("t")).alias("n")).collect()} == texts


def test_end_matter(spark):
    pages = spark.createDataFrame([("d", n, "References\nx" if n in (1, 4) else "body\ntext") for n in range(1, 5)] + [("e", 1, "body"), ("e", 2, "more")], "doc_id string, page_no int, raw string")
    assert [(r.doc_id, r.end_page, r.end_char) for r in extraction.end_matter(extraction.page_lines(pages), pages).collect()] == [("d", 4, 0)]


def test_grids(spark):
    prose = [["a long story about x", "another story"], ["and so", "on"], ["it", "goes"]]
    metric = [["Item (INR crore)", "FY21", "FY22"], ["Sales", "3,410", "5,172"], ["Net profit", "(204)", "118"], ["Share [%]", "1.5", None]]
    df = spark.createDataFrame([(1, prose), (2, metric), (3, None), (4, []), (5, [["x"]])], "k int, cells array<array<string>>").withColumn("page", F.lit("Sales 3,410 5,172 net"))
    got = {r.k: r.s for r in df.filter("cells is not null").select("k", grids.grid_score(F.col("cells")).alias("s")).collect()}
    assert got[1] == 0 and got[2] > 0.34 and got[4] == 0 and got[5] == 0
    rows = {(r.predicate, r.ctx_period): r for r in grids.unpivot_grids(df, "k").collect()}
    assert rows["sales", "FY22"].value_num == 5.172e10 and rows["net profit", "FY21"].value_num == -2.04e9
    assert {(r.predicate, r.value) for r in grids.unpivot_grids(df, "k", page_text="page").collect()} == {("sales", "3,410"), ("sales", "5,172")}
    cells = {"2,113": True, "0.93%": True, "5": True, "(1,008)": True, "₹1,255.98": True, "-4.9": True, "1/": False, "2*": False, "1Q": False, "1Q24": False, "FY24": False, "2023-24": False, "expiry of 60 days from the date": False, "": False}
    tested = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r.c: r.m for r in tested.select("c", grids.is_measurement_cell(F.col("c")).alias("m")).collect()} == cells
    wide = spark.createDataFrame([(1, [["", "Rural", "", "Urban", ""], ["", "2022", "2023", "2022", "2023"], ["Wages", "101", "202", "303", "404"]])], "k int, cells array<array<string>>")
    r = grids.with_header(wide, "cells").first()
    assert list(r.groups) == ["", "Rural", "Rural", "Urban", "Urban"] and r.header_rows == 2 and r.header[1:] == ["2022", "2023", "2022", "2023"] and len(r.body) == 1


TABLE = [["Item", "FY21", "FY22"], ["Sales", "3,410", "5,172"], ["Profit", "12", "118"], ["Loans", "7", "9"]]


def test_tables_from_words_are_selected(spark):
    words = [(1, c * 100.0, r * 14.0, c * 100.0 + 40, r * 14.0 + 10, t) for r, row in enumerate(TABLE) for c, t in enumerate(row)]
    words += [(2, 0.0, r * 14.0, 40.0, r * 14.0 + 10, f"w{r}") for r in range(20)]
    df = spark.createDataFrame(words, "page int, x0 double, y0 double, x1 double, y1 double, text string")
    found = grids.reconstruct(df, ["page"])
    rows = found.collect()
    assert [(r.page, [list(x) for x in r.cells], r.x1) for r in rows] == [(1, TABLE, 240.0)]
    ruled = found.withColumn("source", F.lit("words")).unionByName(found.withColumn("source", F.lit("ruled")).withColumn("table_no", F.lit(5)))
    assert [(r.table_no, r.source, r.header_rows) for r in grids.select_tables(ruled, ["page"]).collect()] == [(5, "ruled", 1)]
    nameless = found.withColumn("cells", F.transform("cells", lambda r, i: F.when(i == 0, F.array(F.lit(""), F.lit(""), F.lit("FY22"))).otherwise(r))).withColumn("source", F.lit("words"))
    assert grids.select_tables(nameless, ["page"]).count() == 0
    boxes = spark.createDataFrame([(1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.8, 1.0, 1.0, 10.0, 10.0), (1, 2, 0.7, 20.0, 0.0, 30.0, 10.0)], "page int, table_no int, quality double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.table_no for r in grids.suppress_overlaps(boxes, ["page"]).collect()) == [0, 2]
    assert grids.reconstruct(df.limit(0), ["page"]).count() == 0


def test_grounding_by_stages(spark):
    first = "Port report\nSales of ice for the season were INR 9,417.25 million in all.\nThe har-\nbour employs 3,120 people “today”.\nEnd"
    far = "Quiet page about tides\nThe lighthouse keeper counted 417 gulls on the northern breakwater before noon.\nMore on tides"
    pages = spark.createDataFrame([("d", 1, first), ("d", 2, "Segments\nCold storage 6,612\nSalt 1,044"), ("d", 30, far), ("d", 40, far), ("d", 50, None), ("e", 1, "")], "doc_id string, page_no int, raw string")
    quote = "Sales of ice for the season were INR 9,417.25 million"
    at = first.index(quote)
    rows = [
        ("recorded", "9,417.25", 1, quote, "sentence", at, at + len(quote)), ("moved", "9,417.25", 1, quote, "sentence", 3, 40), ("exact", "9,417.25", 1, quote, "sentence", None, None), ("spaced", "9,417.25", 2, "Sales of ice  for the season   were INR 9,417.25 million", "sentence", None, None),
        ("hyphen", "3,120", 1, 'The harbour employs 3,120 people "today"', "sentence", None, None), ("far", "417", 1, "lighthouse keeper counted 417 gulls on the northern", "sentence", None, None),
        ("near", "417", 1, "the lighthouse keepr counted 417 gulls on teh northern breakwater before non", "sentence", None, None), ("made", "88,888.8", 1, "Exports of amber to Velmor doubled to a record 88,888.8 billion", "sentence", None, None),
        ("number", "70,000", 1, "employs 3,120 people", "sentence", None, None), ("cell", "6,612", 2, "Cold storage | 6,612", "table", None, None), ("half", "6,612", 2, "Warm storage | 6,612", "table", None, None), ("nocell", "7", 9, "Cold | 7", "table", None, None),
        ("short", "1", 1, "abc", "sentence", None, None), ("nodoc", "1", 1, "some evidence text", "sentence", None, None), ("null", None, None, None, None, None, None),
    ]
    claims = spark.createDataFrame([(a, "x" if a == "nodoc" else "d", *r) for a, *r in rows], "claim_id string, doc_id string, value string, span_page int, span_text string, origin string, char_start int, char_end int").withColumn("norm", F.lit("clash"))
    got = {r.claim_id: r for r in grounding.ground(claims, pages).collect()}
    assert set(got) == {r[0] for r in rows} and len(got) == len(rows)
    assert {k: r.note for k, r in got.items()} == {
        "recorded": "recorded span", "moved": "exact match", "exact": "exact match", "spaced": "exact match", "hyphen": "exact match", "far": "exact match", "near": "near match", "made": "not found", "number": "exact match",
        "cell": "row label and value on the page", "half": "value on the page, row label not", "nocell": "page not found", "short": "evidence too short", "nodoc": "not found", "null": "evidence too short",
    }
    assert (got["exact"].score, got["exact"].value_in_span, got["exact"].page_shift, got["spaced"].page_shift) == (1.0, True, 0, -1)
    for k in ("recorded", "moved", "exact", "hyphen", "far"):
        text = first if k != "far" else far
        assert text[got[k].char_start : got[k].char_end].strip() == got[k].matched_text
    assert got["hyphen"].matched_text == "The har-\nbour employs 3,120 people “today”" and (got["far"].page, got["far"].page_shift) == (30, 29)
    assert got["near"].score > 0.8 and got["near"].page == 30 and got["number"].value_in_span is False and got["cell"].score == 1.0 and got["half"].score == 0.7
    assert not any(got[k].located for k in ("nocell", "short", "nodoc", "null", "made"))
    lines = extraction.page_lines(pages).withColumn("bbox", F.struct(F.lit(0.0).alias("x0"), (F.col("line_no") * 10.0).alias("y0"), F.length("text").cast("double").alias("x1"), (F.col("line_no") * 10.0 + 8).alias("y1")))
    found = spark.createDataFrame([("hyphen", "d", 1, got["hyphen"].char_start, got["hyphen"].char_end), ("none", "d", 1, None, None)], "claim_id string, doc_id string, page int, char_start int, char_end int")
    assert [(r.claim_id, r.bbox.y0, r.bbox.y1) for r in grounding.boxes_of(found, lines).collect()] == [("hyphen", 20.0, 38.0)]
    assert grounding.ground(claims.limit(0), pages).count() == 0 and grounding.ground(claims, pages.limit(0)).filter("located").count() == 0


def test_norm_map_is_norm(spark):
    texts = ["Pla-\n in  “text” – of the  har-\nbour", " \t x ", "", "a­b‘c’ ＡＢ １", "5 - \n 6 -\n x", "É Ünï\n\n–"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {r.t: r.n for r in df.select("t", grounding.norm(F.col("t")).alias("n")).collect()}
    for t in texts:
        n, at = grounding.norm_map(t)
        assert n == want[t] and len(n) == len(at) and at == sorted(at)


def test_orphans(spark):
    keys = [f"{n:020x}" for n in (1, 2, 3, 7, 2**44, 2**60 + 5)]
    parents = spark.createDataFrame([(k, 10.0) for k in keys] + [(keys[0].upper() + " ", 50.0), ("named", 10.0), (None, 1.0)], "claim_id string, created_at double")
    gone = spark.createDataFrame([(" Claims", keys[1].upper(), 20.0), ("claims", keys[0], 20.0), ("document_store", keys[2], 99.0)], "target_table string, target_key string, deleted_at double")
    refs = [("r1", keys[0], 20.0), ("r2", keys[1], 20.0), ("r3", f"{4:020x}", 20.0), ("r4", keys[3], 5.0), ("r5", None, 20.0), ("r6", "  ", 20.0), ("r7", "named", 20.0), ("r8", "other", 20.0), ("r9", keys[5], 20.0), ("r10", keys[2][1:], 20.0), ("r11", keys[4], None)]
    refs += [(f"h{i}", f"{999:020x}", 86400.0 * 40) for i in range(300)]
    rows = spark.createDataFrame(refs, "relation_id string, claim_a_id string, created_at double")
    ref = orphans.Reference(rows, "relations", "claim_a_id", "relation_id", "created_at", parents, "claim_id", "created_at", "claims")
    got = orphans.orphan_references([ref], gone).collect()
    assert {r.row_id for r in got if r.row_id[0] == "r"} == {"r2", "r3", "r4", "r8", "r10"} and sum(r.row_id[0] == "h" for r in got) == 300
    assert {r.ref_month for r in got} == {"1970-01", "1970-02"}
    empty = orphans.Reference(rows, "relations", "claim_a_id", "relation_id", "created_at", parents.limit(0), "claim_id", "created_at", "claims")
    assert orphans.orphan_references([empty], gone.limit(0)).count() == len(refs) - 2
    none = orphans.Reference(rows.limit(0), "relations", "claim_a_id", "relation_id", "created_at", parents, "claim_id", "created_at", "claims")
    assert orphans.orphan_references([none], gone).count() == 0


def test_runs(spark):
    edge = 1 << orphans.SLICE
    df = spark.createDataFrame([("b", p, 1.0, False) for p in (5, 6, 7, 9, edge - 1, edge, edge + 1)], "bucket string, pos long, first_at double, dead boolean")
    assert sorted((r.start, r.end) for r in orphans.parent_runs(df).collect()) == [(5, 7), (9, 9), (edge - 1, edge - 1), (edge, edge + 1)]


def test_dense_keys(spark):
    """A million keys in a row: runs end at slices, and only keys near a deleted or late one are looked up."""
    n = 1_000_000
    key = F.format_string("%020x", F.col("id"))
    parents = spark.range(n).select(key.alias("claim_id"), F.when(F.col("id") == 777_777, 99.0).otherwise(1.0).alias("created_at"))
    runs = orphans.parent_runs(parents.select(*orphans.split_key(F.col("claim_id")), F.col("created_at").alias("first_at"), F.lit(False).alias("dead")))
    assert runs.agg(F.count("*"), F.max(F.col("end") - F.col("start"))).first()[:] == (-(-n // 65_536), 65_535)
    rows = spark.range(0, n + 5, 5).select(F.concat(F.lit("r"), F.col("id")).alias("relation_id"), key.alias("claim_a_id"), F.lit(5.0).alias("created_at"))
    rows = rows.unionByName(spark.createDataFrame([("late", f"{777_777:020x}", 5.0), ("gone", f"{123_456:020x}", 5.0)], rows.schema))
    gone = spark.createDataFrame([("claims", f"{123_456:020x}", 2.0)], "target_table string, target_key string, deleted_at double")
    ref = orphans.Reference(rows, "relations", "claim_a_id", "relation_id", "created_at", parents, "claim_id", "created_at", "claims")
    assert {r.row_id for r in orphans.orphan_references([ref], gone).collect()} == {"late", "gone", f"r{n}"}


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([claim("a", value="1"), claim("b", value="2", doc_id="docA")], ROW)
    s.upsert("claims", df)
    s.upsert("claims", spark.createDataFrame([claim(" A", value="3", created_at=2.0), claim("b", value="9", created_at=0.5, doc_id="docA")], ROW))
    assert {r.claim_id: r.value for r in s.table("claims").collect()} == {"a": "3", "b": "2"}
    s.upsert("documents", spark.createDataFrame([("docA", 1.0), ("doca", 2.0)], "doc_id string, ingested_at double"))
    s.upsert("relations", spark.createDataFrame([("r", "a", "b", 1.0), ("q", "a", "a", 1.0)], "relation_id string, claim_a_id string, claim_b_id string, created_at double"))
    assert s.table("documents").count() == 1 and not s.delete_document("zz") and s.delete_document("DOCA")
    assert [r.claim_id for r in s.table("claims").collect()] == ["a"] and [r.relation_id for r in s.table("relations").collect()] == ["q"]
    assert spark.createDataFrame([('says ```{"a": 1}```',), ("no",)], "t string").select(store.loose_json(F.col("t"), "a int").a).collect()[0][0] == 1


def test_stream(spark, tmp_path):
    rows = [claim(f"{i}{x}", doc_id=x, predicate="vessels owned", value=str(310 + (x == "n") * 130), ctx_period="FY24", created_at=1.0 + i) for i in range(2) for x in "mn"]
    df = spark.createDataFrame(rows, ROW)
    df.write.parquet(f"{tmp_path}/in")
    s = store.Store(spark, f"file://{tmp_path}/out")
    query = incremental.relate_batches(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), s, f"{tmp_path}/cp")
    query.awaitTermination(240)
    assert s.table("claims").count() == 4 and {r.kind for r in s.table("relations").collect()} == {"contradiction"}
    agg = incremental.arrivals(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = agg.writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(claims) from arrived").first()[0] == 4
