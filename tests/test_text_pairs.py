"""Vectors packed, blocks of any size: the same pairs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np

from gristmill.operators import dataset_checks as D
from gristmill.operators import text_pairs
from gristmill.operators.tables import Table


def test_packed():
    arrays = [np.arange(7, dtype=np.int64) - 3, np.array([], np.uint32), np.array([0.5, -1e300]), np.array([2**64 - 1], np.uint64)]
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, text_pairs.unpacked(text_pairs.packed(*arrays)), strict=True))


def test_no_terms_or_pairs_are_shuffled(spark):
    """A shuffle of terms, or of the pairs that share one, takes more disk than the texts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abdeilmno") for _ in range(5)) for _ in range(300)]
    base = [rng.choices(words, k=80) for _ in range(20)]
    texts = [" ".join(w) for w in base] + [" ".join(w[: 70 + i % 5] + rng.choices(words, k=10)) for i, w in enumerate(base)]
    df = spark.createDataFrame([(i, "xy"[i % 2], x) for i, x in enumerate(texts)], "_row_id long, lang string, text string").repartition(3, "_row_id").cache()
    found = D.near_texts(Table(df, ["lang", "text"]), "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "term" not in plan and "posexplode" not in plan.lower() and "explode(" not in plan.lower()
    got = {(r["a"], r["b"]) for r in found.collect()}
    assert {(i, i + 20) for i in range(20)} == got and got <= set(combinations(range(40), 2))
    # No rows or blocks of them all meet all others, which took too long on larger tables.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_miss_none(spark, monkeypatch):
    """Groups of near copies, in many ranges and at many places: the pairs and cosines of brute force."""
    monkeypatch.setattr(text_pairs, "LISTED", 4)
    monkeypatch.setattr(text_pairs, "MEETING", 7)
    monkeypatch.setattr(text_pairs, "SPLIT", 9)
    monkeypatch.setattr(text_pairs, "BLOCK", 500)
    rng = random.Random(4)
    words = ["".join(rng.choice("abdeilmno") for _ in range(4)) for _ in range(120)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(3, 60))
        texts += [" ".join(w if rng.random() > 0.04 else rng.choice(words) for w in base) for _ in range(rng.choice([1, 2, 9]))]
    texts = sorted(set(texts))
    df = spark.createDataFrame([(i, "xy"[i % 2], x) for i, x in enumerate(texts)], "_row_id long, lang string, text string").repartition(3, "_row_id").cache()
    got = {(r["a"], r["b"]): r["cosine"] for r in D.near_texts(Table(df, ["lang", "text"]), "text").collect()}
    bags = [Counter(w := x.split()) + Counter(zip(w, w[1:])) for x in texts]
    df_of = Counter(t for bag in bags for t in bag)
    vectors = [{t: n * (np.log((1 + len(texts)) / (df_of[t] + 1)) + 1) for t, n in bag.items()} for bag in bags]
    cosine = lambda x, y: sum(v * y.get(t, 0) for t, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    want = {(i, j): c for i, j in combinations(range(len(texts)), 2) if i % 2 == j % 2 and (c := cosine(vectors[i], vectors[j])) >= 0.7}
    assert len(want) > 20 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
