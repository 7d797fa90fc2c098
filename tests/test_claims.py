"""Greedy claims against a plain sequential scan."""

import random

import pytest

from emberline.operators import claims


def sequential_claims(rows):
    """Rows (order, a, b): those turned away with the accepted earlier holders of their keys."""
    held_a, held_b, away = {}, {}, {}
    for order, a, b in sorted(rows):
        if a in held_a or b in held_b:
            away[order] = (held_a.get(a), held_b.get(b))
        else:
            held_a[a] = held_b[b] = order
    return away


def distributed(spark, rows):
    got = claims.turned_away(spark.createDataFrame(rows, "n long, a long, b long").repartition(4), "a", "b", ("n",)).collect()
    assert len(got) == len({r.n for r in got})
    return {r.n: (r.holder_a and r.holder_a.n, r.holder_b and r.holder_b.n) for r in got}


@pytest.fixture
def stored_steps(monkeypatch):
    steps = []
    store = claims.cut_lineage
    monkeypatch.setattr(claims, "cut_lineage", lambda df: steps.append(df) or store(df))
    return steps


@pytest.mark.parametrize("seed", range(3))
def test_random_claims(spark, seed):
    rng = random.Random(seed)
    keys = rng.choice([30, 120, 400])
    rows = [(n, rng.randrange(keys), rng.randrange(keys)) for n in rng.sample(range(10_000), 400)]
    assert distributed(spark, rows) == sequential_claims(rows)


def test_a_long_chain_takes_few_steps(spark, stored_steps):
    """Each row wants a key of the row before it and one of the row after it."""
    rows = [(n, (n + 1) // 2, n // 2) for n in range(1_000)]
    assert distributed(spark, rows) == sequential_claims(rows)
    # Two rounds and the doublings of a thousand links.
    assert len(stored_steps) <= 20


def test_claims_without_conflict_take_no_round(spark, stored_steps):
    assert distributed(spark, [(n, n, n) for n in range(100)]) == {}
    assert len(stored_steps) <= 3


def test_a_key_that_all_rows_want(spark, stored_steps):
    rows = [(n, 0, n) for n in range(500)] + [(1_000 + n, n, n) for n in range(1, 500)]
    assert distributed(spark, rows) == sequential_claims(rows)
    assert len(stored_steps) <= 10


def test_rows_without_company_are_not_shuffled_whole(spark, monkeypatch):
    """Only rows that share a key with another row go on; null keys are no one's."""
    from pyspark.sql import functions as F

    from emberline.operators import claims

    rows = spark.range(2_000).select(
        F.col("id").alias("n"), F.when(F.col("id") % 100 != 7, F.floor(F.col("id") / F.when(F.col("id") < 100, 2).otherwise(1))).alias("a"),
        F.concat(F.lit("b"), F.col("id").cast("string")).alias("b"))
    kept = []
    stored = claims.cut_lineage
    monkeypatch.setattr(claims, "cut_lineage", lambda df: kept.append(stored(df)) or kept[-1])
    away = {r.n: r.holder_a.n for r in claims.turned_away(rows, "a", "b", ("n",)).collect()}
    assert away == {n: n - 1 for n in range(1, 100, 2) if n != 7}
    assert kept[0].count() < 200
