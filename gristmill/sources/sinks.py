"""Writers: delimited text, JSON payloads, and the report of an audit."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import config
from gristmill.operators.audit import Audit
from gristmill.operators.edits import Edit, describe
from gristmill.operators.tables import ROW, Table, numbered


def csv_cell(v: Column) -> Column:
    """A cell, quoted if it holds a quote, comma, semicolon, tab or line end."""
    return F.when(v.rlike('[",\\n\\r\\t;]'), F.concat(F.lit('"'), F.regexp_replace(v, '"', '""'), F.lit('"'))).otherwise(v)


def csv_lines(df: DataFrame) -> DataFrame:
    """(_row_id, value): the table as lines, without a header."""
    return df.select(ROW, F.concat_ws(",", *[csv_cell(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in df.columns if c != ROW]).alias("value"))


def header_line(df: DataFrame) -> str:
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in '",\n\r\t;') else s
    return ",".join(quote(c) for c in df.columns if c != ROW)


MANIFEST = "_manifest.json"


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Lines in row order. Parts hold ranges of rows, in order of their names, without a header; ``_manifest.json`` has the header and the parts.

    ``single`` makes one file with a header instead, through one task: for small tables.
    """
    spark, lines = df.sparkSession, csv_lines(df)
    if single:
        head = spark.createDataFrame([(-1, header_line(df))], f"{ROW} long, value string")
        head.unionByName(lines).orderBy(ROW).coalesce(1).select("value").write.text(path)
        return
    lines.orderBy(ROW).select("value").write.text(path)
    files, where = _files(spark, path)
    parts = sorted(p.getPath().getName() for p in files.listStatus(where) if p.getPath().getName().startswith("part-"))
    out = files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}"), True)
    try:
        out.write(bytearray(json.dumps({"columns": [c for c in df.columns if c != ROW], "header": header_line(df), "parts": parts}).encode()))
    finally:
        out.close()


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_csv`` wrote in parts: (_row_id, columns), rows numbered in order again."""
    files, _ = _files(spark, path)
    source = files.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}"))
    try:
        told = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)))
    finally:
        source.close()
    names = told["columns"]
    raw = spark.read.schema(", ".join(f"c{k} string" for k in range(len(names)))).options(quote='"', escape='"', multiLine=True).csv([f"{path}/{p}" for p in told["parts"]])
    # Scans deal out files by size: the order is that of the parts' names and of lines within them.
    placed = raw.select(F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"), *raw.columns)
    rows = numbered(placed.orderBy("_file", "_at"))
    return rows.select(ROW, *[F.coalesce(f"c{k}", F.lit("")).alias(n) for k, n in enumerate(names)])


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def profile_payload(t: Table) -> dict:
    preview = t.df.orderBy(ROW).limit(config.PREVIEW).drop(ROW).collect()
    return {"n_rows": t.n_rows, "n_cols": len(t.columns), "columns": [t.kinds[c] for c in t.columns], "preview": [r.asDict() for r in preview]}


def audit_payload(a: Audit) -> dict:
    """Findings with at most ``ROWS_SHOWN`` row ids each; the full sets are in ``issue_rows``."""
    issues = []
    for f in a.findings:
        shown = [r[ROW] for r in f.rows.select(ROW).orderBy(ROW).limit(config.ROWS_SHOWN).collect()] if f.rows is not None else []
        issues.append({"id": f.id, "check": f.check, "scope": f.scope, "severity": f.severity, "title": f.title, "column": f.column, "row_indices": shown, "total_affected": f.total, "suggested_action": f.action, "evidence": f.evidence})
    return {"issues": issues, "summary": a.summary()}


def to_json(payload: dict) -> str:
    return json.dumps(payload, default=str, ensure_ascii=False)


def report(a: Audit, edits: list[tuple[Edit, int]] = (), rows: int = 30) -> str:
    """The audit as Markdown: counts, what was skipped, findings by severity, and the edits with what they changed."""
    s = a.summary()
    out = ["# Audit", "", "| severity | findings |", "|-|-|", *[f"| {k} | {s[k]} |" for k in config.SEVERITIES], "", f"{s['rows_affected']} rows affected."]
    if a.cv_accuracy is not None:
        out.append(f"Cross-validated accuracy {a.cv_accuracy:.3f}.")
    if a.skipped:
        out += ["", "## Not run", "", *[f"- {x['check']}: {x['reason']}" for x in a.skipped]]
    for severity in config.SEVERITIES:
        if found := [f for f in a.findings if f.severity == severity]:
            out += ["", f"## {severity.capitalize()}"]
            for f in found:
                shown = [str(r[ROW]) for r in f.rows.select(ROW).orderBy(ROW).limit(rows).collect()] if f.rows is not None else []
                out += ["", f"### {f.title}", "", f"{f.check}, {f.total} affected, suggested: {f.action}"] + ([f"Rows {', '.join(shown)}"] if shown else [])
    if edits:
        out += ["", "## Edits", "", *[f"{k}. {describe(e, n)}" for k, (e, n) in enumerate(edits, 1)]]
    return "\n".join(out) + "\n"
