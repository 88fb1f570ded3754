import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import periods, similarity, text, values
from ledgerloom.operators import matching
from ledgerloom.operators.units import harmonise

CLAIM = "claim_id string, value string, value_num double, unit string, ctx_unit string, predicate string, extraction_rule string, origin string, source_document string, span_text string, created_at double"


def parsed(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    return values.with_value(df, "value").orderBy("i").collect()


def test_three_scales_say_the_same(spark):
    a, b, c = parsed(spark, "₹3,377 crore", "INR 33,770 million", "33.77 billion rupees")
    assert a.v_number == b.v_number == pytest.approx(c.v_number) == pytest.approx(3.377e10)
    assert a.v_currency == b.v_currency == c.v_currency == "INR"


def test_signs_blanks_and_nothing(spark):
    rows = parsed(spark, "(619)", "-7.25%", "3,377 5,120", "none", "", None, "６４")
    assert [r.v_base for r in rows] == [-619.0, -7.25, 33775120.0, None, None, None, 64.0]
    assert [r.v_percent for r in rows][:2] == [False, True]


@pytest.mark.parametrize(
    "a, b, verdict",
    [("FY21", "FY2021", "same"), ("FY21", "fiscal year 2020-21", "same"), ("FY21", "2020-21 financial year", "same"), ("2018-19", "FY19", "same"), ("FY21", "Q2 FY21", "different"), ("H1 FY21", "H2 FY21", "different"),
     ("June 2019", "FY19", "different"), ("FY21", "FY20", "different"), ("FY21", None, "unknown"), (None, None, "unknown"), ("", "FY21", "unknown"), ("2019 and 2020", "2020", "unknown")],
)
def test_periods(spark, a, b, verdict):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = periods.with_period(periods.with_period(df, "a", "x_"), "b", "y_")
    assert df.select(periods.compare("x_", "y_")).first()[0] == verdict


def test_quarters_both_ways(spark):
    df = periods.with_period(spark.createDataFrame([("1Q22",), ("4Q",), ("Q3 FY19",)], "p string"), "p")
    assert [r.p_quarters for r in df.collect()] == [[1], [4], [3]]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
    return row[-1]


def test_lcs_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(14))) for _ in "ab")
        assert similarity.lcs(a, b) == brute_lcs(a, b)


def gate(spark, with_gate, column, pairs):
    other = "predicate" if column == "subject" else "subject"
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], f"i int, a_{column} string, b_{column} string").withColumns({f"{s}_{other}": F.lit("x") for s in "ab"})
    return {r.i: r for r in with_gate(matching.described(matching.described(df, "a_"), "b_")).collect()}


def test_entities(spark):
    same = [("Torvald Limited", "Torvald Ltd."), ("Torvald", "Torvald Limited"), ("Kordavia", "Federation of Kordavia"), ("Northern Ice Council", "NIC"), ("Harbour Works Trust", "HWT")]
    other = [("Torvald", "TVD"), ("Kordavia", "Kordania"), ("Torvald Corp", "Federation of Kordavia"), ("", "Kordavia"), (None, None)]
    got = gate(spark, matching.with_entity_gate, "subject", same + other)
    assert [got[i].ent_ok for i in range(len(got))] == [True] * len(same) + [False] * len(other)


def test_predicates(spark):
    cases = [
        ("PPI inflation", "producer price inflation", "same"), ("NDP growth", "net domestic product growth", "same"), ("catch", "catch balance", "same"), ("vessel count", "sales", "different"), ("catch", "catch landed by trawlers", "related"),
        ("net catch", "gross catch", "related"), ("real wage growth", "nominal wage growth", "related"), ("Loan-Deposit Ratio", "Loan-to-deposit ratio", "same"), ("sales", "sales deficit", "related"), ("harbour dues", "harbor dues", "same"),
    ]
    got = gate(spark, matching.with_predicate_gate, "predicate", [c[:2] for c in cases])
    assert [got[i].pred_verdict for i in range(len(cases))] == [c[2] for c in cases]


def test_words(spark):
    df = spark.createDataFrame([("The Gross Expenses of companies' class",), (None,)], "t string")
    assert [r[0] for r in df.select(text.content_words(F.col("t"))).collect()] == [["gross", "expens", "company", "class"], []]


def claims(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], None, r[2], r[3], "steel output", "rule", "table", "a.pdf", None, 1.0) for r in rows], CLAIM)


AMOUNTS = [
    ("₹5,031.315 lakh", None, None, "inr", 503131500), ("(£70,902b)", None, None, "gbp", -70902000000000), ("−109.271,9 mn euros", None, None, "eur", -109271900000), ("42.218", None, "in bp", "ppm", 4222),
    ("0.24543", "fraction of one", None, "ppm", 245430), ("17.978k persons", None, None, "count", 17978), ("359.055 million tonnes", None, None, "kg", 359055000000), ("121.604 mn", None, "amounts in euros", "eur", 121604000),
    ("52.9 billion pounds sterling", "GBP billion", None, "gbp", 52900000000), ("9 days", None, "in EUR thousand", "min", 12960), ("36 GJ", None, None, "kwh", 10000), ("7 lakh crore", "INR", None, "inr", 7000000000000),
    ("3 m", None, None, "m", 3), ("$3m", None, None, "usd", 3000000), ("1 020.10", "mn sq ft", None, "m2", 94770391), ("100 barrels", None, None, "l", 15899),
]


def test_amounts(spark):
    rows = harmonise(claims(spark, *[(f"{i:03}", *x[:3]) for i, x in enumerate(AMOUNTS)])).orderBy("claim_id").collect()
    assert [(r.status, r.common_unit, r.amount) for r in rows] == [("stated", *x[3:]) for x in AMOUNTS]


def test_no_quantities(spark):
    rows = claims(spark, ("a", "suspended by order 1324", None, "INR crore"), ("b", None, "kg", None), ("c", "", "kg", None), ("d", "12 mn", None, None), ("e", "12", None, None), (None, "12 kg", None, None), (" A ", "suspended by order 1324", None, None))
    got = {r.claim_id: r.status for r in harmonise(rows).collect()}
    assert got == {"a": "none", "b": "none", "c": "none", "d": "review", "e": "review"}
    assert harmonise(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    "stated, unit, amount",
    [("unit: kWh", "kwh", 5), ("(Unit: bps)", "ppm", 500), ("unit: million litres", "l", 5_000_000), ("Units in sq km", "m2", 5_000_000), ("unit = ft", "m", 2), ("unit: units", "count", 5), ("mn units", "count", 5_000_000), ("units in lakhs", "count", 500_000), ("Units", "count", 5)],
)
def test_labelled_units(spark, stated, unit, amount):
    row = harmonise(claims(spark, ("a", "5", None, stated))).first()
    assert (row.status, row.common_unit, row.amount) == ("stated", unit, amount)


def test_ratios_of_many_pairs_are_those_of_single_ones():
    rng = random.Random(3)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 20, 63, 64, 65, 100, 160, 161, 170])))
    xs, ys = [text("abcdé ") for _ in range(600)], [text("abcdf ж") for _ in range(600)]
    assert similarity.ratios(xs, ys).tolist() == [similarity.ratio(x, y) for x, y in zip(xs, ys)] and similarity.ratios([], []).tolist() == []
    assert similarity.token_sort_ratios(xs, ys).tolist() == [similarity.token_sort_ratio(x, y) for x, y in zip(xs, ys)]
