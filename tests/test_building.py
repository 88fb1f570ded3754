"""Building blocks around the rules: files, chunks, models, judges, reports, the store and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import quantity
from ledgerloom.operators import review, strategies
from ledgerloom.sources import files, store

PAGES = "doc_id string, page_no int, raw string"


def test_chunks(spark):
    pages = spark.createDataFrame([("d", 1, "a" * 10), ("d", 2, " \n"), ("d", 3, "b" * 10), ("d", 4, "c" * 60), ("d", 5, None), ("d", 6, "d"), ("e", 2, "x")], PAGES).withColumn("text", F.lit("clash"))
    got = {(r.doc_id, r.first_page, r.last_page): r.text for r in strategies.chunks(pages, 60).collect()}
    assert set(got) == {("d", 1, 3), ("d", 4, 4), ("d", 6, 6), ("e", 2, 2)}
    assert got["d", 1, 3] == "\n<<<PAGE 1>>>\n" + "a" * 10 + "\n\n<<<PAGE 3>>>\n" + "b" * 10 + "\n"
    assert strategies.chunks(pages.limit(0)).count() == 0


def test_gap_pages(spark):
    figures = "1 " * 45
    pages = spark.createDataFrame([("d", n, figures) for n in range(1, 21)] + [("d", 30, "few 12"), ("d", 31, None)], PAGES)
    claims = spark.createDataFrame([("d", 2), ("d", 2), (None, None)], "doc_id string, span_page int")
    assert sorted(r.page_no for r in strategies.gap_pages(pages, claims).collect()) == [1, *range(3, 17)]


def test_model_and_hybrid(spark):
    def answer(text):
        if "broken" in text:
            raise RuntimeError("no answer")
        page = int(text.split("PAGE ")[1].split(">")[0])
        one = {"subject": "Acme", "predicate": "sales", "value": "5", "source_page": page, "source_text": "sales of 5", "confidence": 3.5, "context": {"period": "FY22", "basis": "ignored"}}
        return "Sure: ```" + json.dumps({"claims": [one, {"subject": "no more"}]}) + "```"

    figures = "7 " * 45
    pages = spark.createDataFrame([("d", 1, "The sales of Acme Limited were 12 crore in FY22. " + figures), ("d", 2, figures), ("e", 1, "broken " + figures)], PAGES)
    got = strategies.strategy("llm", answer).extract(pages).collect()
    good = [r for r in got if r.error is None]
    assert [(r.doc_id, r.subject, r.span_page, r.ctx_period, r.extraction_confidence, r.origin) for r in good] == [("d", "Acme", 1, "FY22", 1.0, "llm")]
    assert sorted(r.error.split(": ")[1] for r in got if r.error) == ["RuntimeError", "unreadable claim"]
    mixed = strategies.strategy("hybrid", answer).extract(pages).filter("error is null").groupBy("origin").agg(F.collect_set("span_page").alias("p")).collect()
    assert {r.origin: sorted(r.p) for r in mixed} == {"sentence": [1], "llm": [2]}
    for name, model, strict in (("llm", None, False), ("hybrid", answer, True)):
        with pytest.raises(strategies.NeedsModel):
            strategies.strategy(name, model, strict)
    with pytest.raises(ValueError):
        strategies.strategy("magic")
    assert strategies.strategy("rules").name == "deterministic"


RELATION = "relation_id string, kind string, rule_id string, decided_by string, match_confidence double, relationship_confidence double, confidence double, reasoning_trace array<string>, escalate boolean"


def test_adjudication(spark):
    rows = [("a", "underspecified", "R60", "rules", 0.9, 0.5, 0.4, ["x"], True), ("b", "underspecified", "R61", "rules", 0.8, 0.5, 0.4, None, True), ("c", "underspecified", "R99", "rules", 0.7, 0.4, 0.2, [], True),
            ("d", "underspecified", "R60", "rules", None, 0.5, 0.3, ["x"], True), ("e", "contradiction", "R70", "rules", 1.0, 0.8, 0.6, ["y"], False)]
    df = spark.createDataFrame(rows, RELATION)

    def judge(row):
        if row["relation_id"] == "b":
            raise ValueError("tired")
        return {"kind": "reconciled", "confidence": "0.9", "explanation": "scope"} if row["relation_id"] == "a" else {"kind": "maybe"}

    got = {r.relation_id: r for r in review.adjudicate(df, judge, budget=3).collect()}
    assert (got["a"].kind, got["a"].decided_by, got["a"].relationship_confidence, got["a"].confidence) == ("reconciled", "llm", 0.9, 0.72)
    assert [got[k].kind for k in "bcde"] == ["underspecified"] * 3 + ["contradiction"] and got["e"].reasoning_trace == ["y"]
    assert [got[k].reasoning_trace[-1].split(":")[0].split(" (")[0] for k in "abcd"] == ["judged", "the judge failed", "the judge gave no known verdict", "over the budget"]
    for out in (review.adjudicate(df, None), review.adjudicate(df, judge, strict=True)):
        assert {r.relation_id: r.kind for r in out.collect()} == {r[0]: r[1] for r in rows}
    assert review.adjudicate(df.limit(0), judge).count() == 0


def test_reports(spark):
    claims = spark.createDataFrame([("d", False, False, "table"), ("d", True, True, "sentence"), ("e", None, False, "llm")], "doc_id string, quarantined boolean, needs_review boolean, origin string")
    pages = spark.createDataFrame([("d", 1, "x"), ("d", 2, None), ("f", 1, "y")], PAGES)
    got = {r.doc_id: (r.pages_read, r.stored, r.grounded, r.quarantined, r.by_model) for r in review.ingest_report(claims, pages).collect()}
    assert got == {"d": (1, 2, 1, 1, 0), "f": (1, 0, 0, 0, 0)}
    rels = spark.createDataFrame([("corroboration", "rules", "R40"), ("corroboration", "llm", "R60"), ("underspecified", "rules", "R60")], "kind string, decided_by string, rule_id string")
    assert {(r.kind, r.relations, r.by_model, r.open, r.percent_by_model) for r in review.relate_report(rels).collect()} == {("corroboration", 2, 1, 1, 33.33), ("underspecified", 1, 0, 1, 0.0)}
    row = review.mode_report(claims, rels, "rules").first()
    assert (row["mode"], row.claims, row.grounded, row.model_claims, row.corroboration, row.by_model) == ("rules", 3, 2, 1, 2, 1)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "copy.txt").write_text("one\ftwo")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "bad.bin").write_bytes(b"\x00")

    def parser(content):
        if content == b"\x00":
            raise OSError("not a document")
        return files.plain_text(content)

    got = files.read_files(spark, str(tmp_path), parser).collect()
    assert len({r.doc_id for r in got if r.filename in ("a.txt", "copy.txt")}) == 1 and sorted((r.filename, r.page_no, r.raw) for r in got if r.raw == "two") == [("a.txt", 2, "two"), ("copy.txt", 2, "two")]
    assert [(r.page_no, r.error) for r in got if r.filename == "bad.bin"] == [(None, "OSError: not a document")]


def test_vectors(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 2.0]), ("c", []), ("d", None), ("e", [1.0, None]), (None, [1.0, 1.0]), ("f", [1.0])], "claim_id string, embedding array<float>")
    assert {r.claim_id for r in files.embeddings(df).collect()} == {"b", "f"} and {r.claim_id for r in files.embeddings(df, 2).collect()} == {"b"}
    texts = spark.createDataFrame([(1, "Acme | net sales"), (2, "acme  net-sales"), (3, "weather in spring"), (4, ""), (5, None)], "i int, t string")
    got = {r.i: r.v for r in texts.select("i", files.hashed_vector(F.col("t"), 64).alias("v")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b]))
    assert abs(dot(1, 1) - 1) < 1e-5 and dot(1, 2) > 0.99 and dot(1, 3) < 0.5 and set(got[4]) == {0.0} and got[5] is None


def test_store_deltas_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_DELTAS", 2)
    s = store.Store(spark, f"file://{tmp_path}/s")
    for n in range(5):
        s.upsert("claims", spark.createDataFrame([("k", float(n), n), (f"own{n}", 1.0, n)], "claim_id string, created_at double, v int"))
        assert len(s._folders("claims")) <= 3
    rows = {r.claim_id: r.v for r in s.table("claims").collect()}
    assert rows == {"k": 4, **{f"own{n}": n for n in range(5)}}
    s.remove("claims", spark.createDataFrame([("k",)], "claim_id string"))
    assert "k" not in {r.claim_id for r in s.table("claims").collect()} and s.table("relations") is None


def test_export_claims(spark):
    rows = [(f"p{i}", "sentence", False, False, i / 100) for i in range(10)] + [(f"t{i}", "table", False, False, i / 100) for i in range(10)] + [(f"f{i}", "table", True, None, i / 100) for i in range(10)]
    df = spark.createDataFrame(rows, "claim_id string, origin string, needs_review boolean, quarantined boolean, final_confidence double")
    assert sorted(r.claim_id for r in store.export_claims(df, 8).collect()) == ["f0", "f1", "p8", "p9", "t6", "t7", "t8", "t9"]


def test_numbers_of_documents_are_no_quantities(spark):
    cases = {
        "about 5 kg": (False, ""), "inr 5 crore (net)": (False, ""), "12 sq. km": (False, ""), "licensed by decree no. 12": (True, None), "see annex 4": (True, None), "note: 7": (True, None), "profit of 7": (False, "profit"), "up to 30 %": (False, ""), "": (False, ""), "none": (False, ""),
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string").withColumn("t", quantity.tidy(F.col("t")))
    got = {r.t: (r.r, r.w) for r in df.select("t", quantity.refers(F.col("t")).alias("r"), quantity.told(F.col("t")).alias("w")).collect()}
    assert all(got[c][0] == want[0] and (want[1] is None or got[c][1] == want[1]) for c, want in cases.items())
    kinds = df.select("t", quantity.kind_of(quantity.words(F.col("t"))).alias("k")).collect()
    assert {r.t: r.k for r in kinds}["12 sq. km"] == "m2"


def test_command_line(spark, tmp_path):
    from ledgerloom.__main__ import main

    (tmp_path / "in").mkdir()
    body = "The annual note of {n} is here. In it {n} reports. Sales of {n} were ₹{v} crore in FY22. The staff of {n} met. Costs of {n} increased by 4.5% in FY22."
    for i, v in enumerate((512, 733)):
        (tmp_path / "in" / f"{i}.txt").write_text(body.format(n="Acme Harbour Limited", v=v) + f" File {i}.")
    where = f"file://{tmp_path}/store"
    for args in (["ingest", f"file://{tmp_path}/in", where], ["relate", where], ["stats", where], ["export", where, f"file://{tmp_path}/out", "--quota", "8"]):
        main(args)
    kept = store.Store(spark, where)
    assert kept.table("documents").count() == 2 and kept.table("claims").filter("grounded").count() >= 2
    assert "contradiction" in {r.kind for r in kept.table("relations").collect()}
