"""Planted faults: each check fires on its fault and stays quiet without it."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import column_checks as C
from gristmill.operators import dataset_checks as D
from gristmill.operators import label_checks as L
from gristmill.operators import quantiles
from gristmill.operators import relation_checks as R
from gristmill.operators.audit import audit, rank, safe_fixes
from gristmill.operators.edits import Edit, changes, replay
from gristmill.operators.tables import ROW, Table


def table(spark, **columns):
    names = list(columns)
    rows = [(i, *map(str, r)) for i, r in enumerate(zip(*columns.values()))]
    return Table(spark.createDataFrame(rows, f"{ROW} long, " + ", ".join(f"`{c}` string" for c in names)), names)


def cols(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_types(spark):
    n = 60
    t = table(spark, id=[f"A{i}" for i in range(n)], one=["x"] * n, yes=["yes" if i % 2 else "no" for i in range(n)], day=[f"2023-01-{i % 28 + 1:02d}" for i in range(n)], num=[i % 9 for i in range(n)],
              text=[f"some words that go on {i}" for i in range(n)], cat=["ab"[i % 2] + "c" for i in range(n)], money=[f"${i}.5" for i in range(n)], ratio=[i + 0.25 for i in range(n)])
    kinds = {c: t.kinds[c]["inferred_type"] for c in t.columns}
    assert kinds == {"id": "id_like", "one": "constant", "yes": "boolean", "day": "datetime", "num": "numeric", "text": "text", "cat": "categorical", "money": "categorical", "ratio": "numeric"}


def test_missing_and_sentinels(spark):
    t = table(spark, a=["", "N/A", "unknown", "x", "y"] * 10, b=["k"] * 25 + ["l"] * 25)
    assert cols(C.missingness(t), "col", "n_missing", "severity") == [("a", 30, "medium")]
    assert cols(C.sentinels(t), "col", "n_sentinel", "auto") == [("a", 20, False)]
    assert cols(C.sparse_rows(table(spark, a=["", "1"], b=["", "2"], c=["x", "y"])), ROW, "n_missing") == [(0, 2)]


def test_variants(spark):
    t = table(spark, plan=["Premium"] * 40 + ["premium"] * 5 + [" Premium "] * 30 + ["Basic"] * 20, code=["AB"] * 50 + ["ab"] * 45)
    got = {(r["col"], r["raw"]): r["verdict"] for r in C.variants(t).collect()}
    assert got == {("plan", "Premium"): "canonical", ("plan", "premium"): "safe", ("plan", " Premium "): "safe", ("code", "AB"): "canonical", ("code", "ab"): "contested"}


def test_outliers_and_codes(spark):
    t = table(spark, v=[20 + i % 10 for i in range(200)] + [-999] * 8)
    assert cols(C.outliers(t), "col", "n_outliers") == [("v", 8)]
    assert cols(C.codes(t), "col", "code", "n") == [("v", -999.0, 8)]
    assert not C.codes(table(spark, v=[i % 2 for i in range(200)])).collect()
    assert cols(C.scale_breaks(table(spark, v=[*range(1, 50), *range(1, 50), 9000])), "largest") == [(9000.0,)]
    assert not C.scale_breaks(table(spark, v=[*range(1, 50), *range(1, 50), 9000, 9000])).collect()


def test_dates(spark):
    t = table(spark, d=["2023-01-05", "25/12/2023", "5 May 2023"] * 10)
    assert cols(C.date_formats(t), "n_styles", "dayfirst", "auto") == [(3, True, True)]
    t = table(spark, d=["01/02/2023", "03/04/2023"] * 10)
    assert cols(C.date_formats(t), "auto", "severity") == [(False, "low")]
    assert cols(C.future_dates(table(spark, d=["2023-01-05"] * 20 + ["2031-01-01"]), "2026-01-01"), "n_future") == [(1,)]


def test_relations(spark):
    n = 200
    item = [i % 5 for i in range(n)]
    price = ["" if i % 17 == 0 else (i % 5 + 1) * 3 for i in range(n)]
    qty = [i % 13 + 1 for i in range(n)]
    total = ["" if i % 19 == 0 else (i % 13 + 1) * (i % 5 + 1) * 3 for i in range(n)]
    t = table(spark, item=item, price=price, qty=qty, total=total)
    got = cols(R.dependencies(t), "source", "target")
    assert ("item", "price") in got
    assert cols(R.arithmetic(t), "target", "operation", "a", "b", "auto") == [("total", "product", "price", "qty", True)]
    assert R.computable(t, "total", "product", "price", "qty").count() == sum(1 for i in range(n) if i % 19 == 0 and i % 17)
    t = table(spark, a=[f"2023-01-{i % 20 + 1:02d}" for i in range(n)], b=["2022-01-01" if i == 7 else f"2023-02-{i % 20 + 1:02d}" for i in range(n)])
    assert cols(R.orderings(t), "left", "right", "n_broken") == [("a", "b", 1)]


def test_copies_and_overlap(spark):
    n = 60
    t = table(spark, k=[f"id {i}" for i in range(n)] + ["id 3", "id 5"], v=[i * 10 % 100 for i in range(n)] + [30, 51], w=["x" if i % 2 else "y" for i in range(n)] + ["x", "x"], split=["train"] * n + ["test", "train"])
    assert cols(D.duplicate_rows(t, ["k", "v", "w"]), ROW) == [(3,), (60,)]
    assert cols(D.near_duplicates(t, "split"), "a", "b") == [(5, 61)]
    assert cols(D.exact_overlap(t, "split"), ROW) == [(3,), (60,)]


def test_totals_row(spark):
    t = table(spark, item=[f"i{k % 4}" for k in range(20)] + ["Total"], a=[k + 1 for k in range(20)] + [210], b=[2] * 20 + [7])
    assert cols(D.totals_row(t), ROW, "n_matched", "labelled", "auto") == [(20, 1, True, True)]
    assert not D.totals_row(table(spark, a=[k + 1 for k in range(20)] + [211000])).collect()


def test_leakage_and_mislabels(spark):
    n = 400
    y = ["yes" if i % 3 == 0 else "no" for i in range(n)]
    wrong = {10, 55, 120}
    given = [("no" if v == "yes" else "yes") if i in wrong else v for i, v in enumerate(y)]
    t = table(spark, leak=[f"r{v}" for v in y], a=[(i * 7) % 50 for i in range(n)], b=["xyz"[i % 3] for i in range(n)], y=given)
    told, why = L.leakage(t, "y")
    assert why is None and {"leak", "b"} <= {r["col"] for r in told.collect()} and "a" not in {r["col"] for r in told.collect()}
    rows, about = L.mislabels(t, "y")
    assert {r[ROW] for r in rows.collect()} == wrong and about["cv_accuracy"] > 0.95
    assert L.leakage(t, None)[1] and L.mislabels(table(spark, y=["a"] * 60), "y")[1]["skipped"]


def test_audit_ranks_and_survives(spark, monkeypatch):
    t = table(spark, a=["", "x", "y", "N/A"] * 10, b=["c"] * 40)
    monkeypatch.setattr(C, "rare_values", lambda t: 1 / 0)
    found = audit(t)
    assert any(s["check"] == "C6_rare_categories" and "ZeroDivisionError" in s["reason"] for s in found.skipped)
    severities = [f.severity for f in found.findings]
    assert severities == sorted(severities, key=["high", "medium", "low"].index)
    assert [f.id for f in rank(found.findings)] == [f.id for f in found.findings]
    assert found.summary()["rows_affected"] >= 20
    ops = [e.op for e in safe_fixes(found.findings)]
    assert "drop_column" in ops and ops.index("fill_missing") < ops.index("drop_column")


def test_edits(spark):
    t = table(spark, id=[1, 2, 3, 4], plan=["a", " a", "", "b"], x=["2", "3", "4", "0"], y=["1.50", "", "2.50", "3.25"])
    out = replay(t.df, [Edit("trim"), Edit("fill_missing", "plan", to="none"), Edit("nothing", "plan"), Edit("drop_column", "gone")])
    assert cols(out, ROW, "plan") == [(0, "a"), (1, "a"), (2, "none"), (3, "b")]
    assert cols(t.df, "plan")[0] == ("",)  # the table itself stays
    out = replay(t.df, [Edit("fill_from_formula", "y", left="x", right="id", operation="quotient")])
    assert cols(out.where(f"{ROW} = 1"), "y") == [("1.50",)]
    counts = changes(t.df, [Edit("trim"), Edit("drop_rows", rows=(0, 9)), Edit("relabel", "plan", values={2: "z"})])
    assert [r["changed"] for r in counts.orderBy("step").collect()] == [1, 1, 1]
    out = replay(t.df, [Edit("drop_column", "id"), Edit("drop_column", "x"), Edit("drop_column", "y"), Edit("trim"), Edit("dedupe")])
    assert cols(out, ROW) == [(0,), (2,), (3,)]


@pytest.mark.parametrize("check", [C.rare_values, C.untrimmed, C.invisible, C.entities, C.formatted_numbers, C.booleans, C.markup, C.mixed_types, C.constants, C.fences])
def test_empty_table(spark, check):
    t = Table(spark.createDataFrame([], f"{ROW} long, a string, b string"), ["a", "b"])
    assert check(t).collect() == []


def test_formats_and_markup(spark):
    t = table(spark, m=[f"${i},000" for i in range(1, 41)], w=[f"{i} kg" if i % 2 else f"{i} lb" for i in range(40)], n=["<b>x</b>" if i % 4 == 0 else "plain" for i in range(40)], f=["yes", "N", "True", "0"] * 10)
    assert cols(C.formatted_numbers(t), "col", "auto") == [("m", True), ("w", False)]
    assert cols(C.markup(t), "col", "n_markup") == [("n", 10)]
    assert cols(C.booleans(t), "col", "n_spellings") == [("f", 4)]


def test_redundant(spark):
    n = 120
    t = table(spark, a=[i + 0.5 for i in range(n)], b=[(i + 0.5) * 0.92 for i in range(n)], c=[(i * 7919) % 101 for i in range(n)], d=["uvw"[i % 3] for i in range(n)], e=["UVW"[i % 3] + "x" for i in range(n)])
    assert cols(C.pearson(t), "a", "b") == [("a", "b")]
    assert cols(C.cramers_v(t), "a", "b") == [("d", "e")]


def test_near_texts_against_brute_force(spark, tmp_path):
    """All documents and whole texts: long ones, ones that differ at the start, more than 50 of a language, exact copies."""
    import math
    import random
    import re
    from collections import Counter

    from gristmill.plans import catalogue

    rng = random.Random(5)
    words = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([12, 60, 600]))) for _ in range(70)]
    docs = [("en" if i % 8 else "fr", x) for i, x in enumerate(texts)]
    for i in range(0, 40, 2):
        lang, x = docs[i]
        w = x.split()
        k = max(1, len(w) * (i % 5) // 12)
        docs.append((lang, " ".join([rng.choice(words) for _ in range(k)] + w[k:])))  # another beginning
    docs += [docs[3], docs[3], docs[70], ("fr", docs[3][1] + " end"), ("en", docs[3][1] + " end"), ("en", ""), ("en", "?"), ("en", "Mot"), ("en", "mot.")]
    spark.createDataFrame([(i, *r) for i, r in enumerate(docs)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    bags = []
    for _, x in docs:
        w = re.findall(r"\b\w\w+\b", x.lower())
        bags.append(Counter(w) + Counter(f"{p} {q}" for p, q in zip(w, w[1:])))
    df = Counter(k for bag in bags for k in bag)
    vectors = [{k: n * (math.log((1 + len(docs)) / (df[k] + 1)) + 1) for k, n in bag.items()} for bag in bags]
    size = [math.sqrt(sum(x * x for x in v.values())) or 1.0 for v in vectors]
    times = Counter(docs)
    want = {}
    for b in range(len(docs)):
        for a in range(b):
            cosine = sum(x * vectors[b].get(k, 0.0) for k, x in vectors[a].items()) / size[a] / size[b]
            if docs[a][0] == docs[b][0] and cosine >= 0.7 and (times[docs[a]] == 1 or times[docs[b]] == 1):
                want[a, b] = round(cosine, 5)
    got = {(r["a"], r["b"]): round(r["cosine"], 5) for r in catalogue.queries()["d2_near_text"](spark, str(tmp_path)).collect()}
    assert len(want) > 15 and any(len(docs[a][1]) > 2000 and docs[a][1][:40] != docs[b][1][:40] for a, b in want)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)


@pytest.mark.parametrize("n", [1500, 2000])
def test_leakage_keeps_the_order_of_many_codes(spark, n):
    """Thousands of codes whose beginning is the label: one split of the sorted codes tells the classes apart."""
    half = n // 2
    code = [("A" if i < half else "B") + f"-{i * 37 % half:04d}" for i in range(n)]
    plain = [f"K{i * 7919 % n:05d}" for i in range(n)]  # as many codes that say nothing of the label
    label = ["yes" if i < half else "no" for i in range(n)]
    t = table(spark, code=code, plain=plain, label=label, num=[i * 31 % 17 for i in range(n)])
    found = L.leakage(t, "label")[0].collect()
    assert [r["col"] for r in found] == ["code"] and found[0]["accuracy"] > 0.99


def test_quantiles_in_either_way(spark, monkeypatch):
    """Ranks over sorted partitions give what one buffer gives, for ties, single values and many columns."""
    rng = random.Random(6)
    rows = [(c, float(rng.choice([k, rng.random() * 100, -3, 7])), rng.randint(1, 5)) for c in "abc" for k in range(400)] + [("one", 5.0, 3), ("two", 1.0, 1), ("two", 2.0, 1)]
    counted = spark.createDataFrame(rows, "col string, num double, n long").groupBy("col", "num").agg(F.sum("n").alias("n"))
    told = lambda: {r["col"]: ([round(x, 9) for x in r["q"]], r["total"]) for r in quantiles.quantiles(counted, [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    whole = told()
    monkeypatch.setattr(quantiles, "FEW", 0)
    assert told() == whole and whole["two"] == ([1.0, 1.25, 1.5, 1.9, 2.0], 2)


def test_rearranged_rules():
    from gristmill.operators.relation_checks import arithmetic_candidates, rearranged

    values = {"a": 12.0, "b": 5.0}
    do = {"product": lambda x, y: x * y, "sum": lambda x, y: x + y, "difference": lambda x, y: x - y, "quotient": lambda x, y: x / y}
    for op in ("product", "sum", "difference"):
        known = values | {"t": do[op](values["a"], values["b"])}
        found = rearranged("t", op, "a", "b")
        assert [c for c, *_ in found] == ["t", "a", "b"]
        assert all(abs(do[o](known[x], known[y]) - known[c]) < 1e-9 for c, o, x, y in found)
    ways = arithmetic_candidates(["x", "y", "z"])
    assert len(ways) == len(set(ways)) == 3 * 4 and ("z", "difference", "y", "x") in ways and ("z", "difference", "x", "y") in ways
