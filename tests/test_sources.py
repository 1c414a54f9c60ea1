"""Reading messy delimited files, and writing them."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from gristmill.operators.audit import audit
from gristmill.operators.edits import Edit
from gristmill.operators.tables import ROW, Table, as_strings
from gristmill.sources import delimited as R
from gristmill.sources import sinks

CASES = {
    "plain": ("a,b\n1,2\n", ["a", "b"], [("1", "2")]),
    "semicolon with decimal commas": ("a;b\n1,5;2\n2,5;3\n", ["a", "b"], [("1,5", "2"), ("2,5", "3")]),
    "tab": ("a\tb\n1\t2\n", ["a", "b"], [("1", "2")]),
    "quoted": ('a,b\n"x, y","say ""hi"""\n', ["a", "b"], [("x, y", 'say "hi"')]),
    "quoted line end": ('a,b\n"x\ny",2\n', ["a", "b"], [("x\ny", "2")]),
    "crlf": ("a,b\r\n1,2\r\n", ["a", "b"], [("1", "2")]),
    "preamble": ("Report\nmade today\n\nname,amount,day\nx,1,2\ny,3,4\n", ["name", "amount", "day"], [("x", "1", "2"), ("y", "3", "4")]),
    "two-row header": ("region,Q1,,Q2,\n,revenue,units,revenue,units\nx,1,2,3,4\ny,5,6,7,8\n", ["region", "Q1 revenue", "Q1 units", "Q2 revenue", "Q2 units"], [("x", "1", "2", "3", "4"), ("y", "5", "6", "7", "8")]),
    "ragged": ("a,b,c\n1,2\n3,4,5,6\n7,8,9\n", ["a", "b", "c"], [("1", "2", ""), ("3", "4", "5"), ("7", "8", "9")]),
    "blank and repeated names": ("a,,a\n1,2,3\n", ["a", "column_2", "a_2"], [("1", "2", "3")]),
    "rows of empty cells": (",,\na,b,c\n1,2,3\n,,\n4,5,6\n\n", ["a", "b", "c"], [("1", "2", "3"), ("", "", ""), ("4", "5", "6")]),
    "blank lines": ("a,b\n\n1,2\n   \n,\n3,4\n", ["a", "b"], [("1", "2"), ("", ""), ("3", "4")]),
    "one column": ("a\nx\n\ny\n", ["a"], [("x",), ("y",)]),
    "lone carriage returns": ("a,b\r1,2\r3,4\r", ["a", "b"], [("1", "2"), ("3", "4")]),
    "missing words stay": ("a,b\nN/A,\n", ["a", "b"], [("N/A", "")]),
}


@pytest.mark.parametrize("name", CASES)
def test_read(spark, tmp_path, name):
    text, names, rows = CASES[name]
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    df = R.read_delimited(spark, str(path)).orderBy(ROW)
    assert df.columns == [ROW, *names]
    assert [tuple(r)[1:] for r in df.collect()] == rows
    assert [r[0] for r in df.collect()] == list(range(len(rows)))


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "cp1252"])
def test_encodings(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes("name,city\nJosé,Köln\nAnna,Rom\n".encode(encoding))
    assert R.encoding_of(path.read_bytes()).startswith(encoding[:6])
    assert R.read_delimited(spark, str(path)).orderBy(ROW).first()["city"] == "Köln"


def test_gzip_and_mojibake(spark, tmp_path):
    path = tmp_path / "t.csv.gz"
    path.write_bytes(gzip.compress("a,b\ncafÃ©,1\n".encode()))
    assert R.read_delimited(spark, str(path)).first()["a"] == "café"
    assert R.repair_mojibake("café") == "café" and R.repair_mojibake("plain") == "plain"


def test_empty_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" ")
    with pytest.raises(ValueError):
        R.read_delimited(spark, str(tmp_path / "t.csv"))


def test_sinks(spark, tmp_path):
    t = Table(spark.createDataFrame([(1, 'x "y"', "a;b"), (0, "p", "")], f"{ROW} long, u string, `v,w` string"), ["u", "v,w"])
    sinks.write_csv(t.df, str(tmp_path / "out"), single=True)
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == 'u,"v,w"\np,\n"x ""y""","a;b"\n'
    sinks.write_csv(t.df, str(tmp_path / "parts"))
    assert sinks.read_parts(spark, str(tmp_path / "parts")).orderBy(ROW).collect() == [(0, "p", ""), (1, 'x "y"', "a;b")]
    found = audit(t, checks=["C2_constant", "C1_missingness"])
    payload = json.loads(sinks.to_json(sinks.audit_payload(found)))
    assert set(payload) == {"issues", "summary"} and payload["summary"]["medium"] >= 0
    assert "# Audit" in sinks.report(found, [(Edit("trim"), 3)]) and "trimmed 3 cells" in sinks.report(found, [(Edit("trim"), 3)])
    assert sinks.profile_payload(t)["n_rows"] == 2


@pytest.mark.parametrize("case", ["windows-1252 late", "damaged late", "damaged pair at the head's end", "one sound row"])
def test_encoding_and_repair_by_the_whole_file(spark, tmp_path, case):
    """What the first 1 MiB does not show decides as well."""
    filler = b"name,city\n" + b"Anna,Rom\n" * (R.HEAD_BYTES // 9 + 1000)
    damaged = "café".encode().decode("cp1252").encode()
    last, want = {
        "windows-1252 late": ("José,Köln".encode("cp1252"), ("José", "Köln")),
        "damaged late": (damaged + b",x", ("café", "x")),
        "damaged pair at the head's end": (damaged + b",x", ("café", "x")),
        "one sound row": (damaged + ",Köln".encode(), ("cafÃ©", "Köln")),
    }[case]
    if case == "damaged pair at the head's end":
        start = b"name,city\n"
        pad = R.HEAD_BYTES - len(start) - len(damaged) + 2  # the head ends between the two halves of the damaged character
        filler = start + b"Anna,Rom\n" * ((pad - 3) // 9) + b"z" * ((pad - 3) % 9) + b",y\n"
        assert (filler + last)[: R.HEAD_BYTES].endswith("Ã".encode())
    path = tmp_path / "t.csv"
    path.write_bytes(filler + last + b"\n")
    df = R.read_delimited(spark, str(path))
    assert tuple(df.orderBy(df[ROW].desc()).first())[1:] == want


def test_many_tasks_limits_and_samples(spark, tmp_path):
    """Lines are split among tasks and numbered in file order; limits refuse, folders are read by extension."""
    (tmp_path / "big.CSV").write_text("id,name\n" + "".join(f"{k},n{k}\n" for k in range(40_000)))
    (tmp_path / "t.tsv.gz").write_bytes(gzip.compress(b"a\tb\n1\t2\n"))
    (tmp_path / "other.json").write_text("{}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = R.read_delimited(spark, f"file://{tmp_path}/big.CSV")
        assert df.rdd.getNumPartitions() > 4
        assert df.where(f"{ROW} <> cast(id as long)").count() == 0 and df.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(R.TooLarge):
        R.read_delimited(spark, f"file://{tmp_path}/big.CSV", most_rows=39_999)
    with pytest.raises(R.TooLarge):
        R.read_delimited(spark, f"file://{tmp_path}/big.CSV", most_columns=1)
    assert R.read_delimited(spark, f"file://{tmp_path}/big.CSV", most_rows=40_000, most_columns=2).count() == 40_000
    found = R.read_samples(spark, f"file://{tmp_path}")
    assert sorted(found) == ["big", "t"] and found["t"].first()["b"] == "2"


def test_numbered_after_a_shuffle(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000).orderBy("k")
    got = {r["k"]: r[ROW] for r in as_strings(df).select(F.col("k").cast("long").alias("k"), ROW).collect()}
    assert got == {k: k for k in range(1000)}
