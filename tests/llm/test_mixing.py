import random

import pytest
from pyspark.sql import functions as F

from codeweft.llm import mixing


def poured(weights, capacity, total):
    """Water-filling by halving the level."""
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(min(c, mid * w) for w, c in zip(weights, capacity)) > total else (mid, hi)
    return [min(c, lo * w) for w, c in zip(weights, capacity)]


@pytest.mark.parametrize("total", [0.0, 10.0, 700.0, 1e9])
def test_water_fill(spark, total):
    rng = random.Random(total)
    for n in (1, 2, 9):
        rows = [(f"s{i}", rng.choice([0.0, 0.1, rng.random()]), rng.choice([0.0, 50.0, 1000 * rng.random()])) for i in range(n)]
        got = {r["source"]: r["give"] for r in mixing.water_fill(spark.createDataFrame(rows, "source string, share double, capacity double"), F.lit(total)).collect()}
        for (s, w, c), want in zip(rows, poured([w for _, w, _ in rows], [c for *_, c in rows], total)):
            assert got[s] == pytest.approx(want, rel=1e-6, abs=1e-3) and got[s] <= c


def docs(spark):
    data = [(i, f"word{i} " * (10 + i % 7), "Big" if i % 5 else "small", "x", 1) for i in range(600)] + [(9000, None, "big", "x", 1), (9001, "", "big", "x", 1), (9002, "text", None, "x", 1), (9003, "other text", "other", "x", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, tokens string, copies int")


def test_mix_reaches_shares_within_caps(spark):
    targets = spark.createDataFrame([("big", 0.5, 2), (" SMALL", 0.45, 3), ("absent", 0.05, 9), (None, 0.5, 1), ("neg", -1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(docs(spark), targets)
    rep = {r["source"]: r for r in report.collect()}
    assert set(rep) == {"big", "small", "absent"} and rep["absent"]["tokens_out"] == 0
    small = rep["small"]
    assert small["tokens_out"] <= 3 * small["tokens_in"] and small["most_copies"] <= 3
    big = rep["big"]
    assert abs(big["tokens_out"] - big["tokens_planned"]) <= 25 and abs(small["tokens_out"] - small["tokens_planned"]) <= 3 * 25
    rows = mixed.collect()
    assert all(1 <= r["copies"] <= (2 if r["source"] == "big" else 3) for r in rows) and {r["source"] for r in rows} == {"big", "small"}
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(docs(spark).repartition(7), targets)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}
    assert {(r["doc_id"], r["copies"]) for r in mixing.mix(docs(spark), targets, seed=7)[0].collect()} != again


def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(docs(spark).limit(0), targets)
    assert mixed.count() == 0 and report.first()["tokens_out"] == 0
    mixed, report = mixing.mix(docs(spark), targets.limit(0))
    assert mixed.count() == 0 and report.count() == 0


def test_pieces_keep_tokens():
    whole = lambda t: len(mixing._encoder(mixing.VOCABULARY).encode_ordinary(t))
    rng = random.Random(3)
    for text in ["Some words, and (more) of them.\n" * 3000, "x=1;y='s';" * 9000, "循環した依存関係が見つかりました。" * 4000, "0123456789abc" * 6000, "don't 'some\n\n  '" * 5000, "".join(rng.choices("ab1 '\n.é関s", k=90000))]:
        parts = list(mixing.pieces(text))
        assert len(parts) > 1 and "".join(parts) == text and mixing.count_tokens(text) == whole(text)
    assert list(mixing.pieces("a" * 100001)) == ["a" * 100001]


def test_shares_add_up_for_a_large_source(spark):
    data = [(i, "token " * (1 + i % 9), "one" if i % 3 else "two") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("one", 3.0, 5), ("two", 1.0, 5)], "source string, target_share double, max_repeats int")
    for total in (500.0, 7000.0, 40000.0):
        rep = {r["source"]: r for r in mixing.mix(df, targets, total)[1].collect()}
        assert rep["one"]["tokens_planned"] == 0.75 * total and all(abs(r["tokens_out"] - r["tokens_planned"]) <= 10 for r in rep.values())
