"""Edits as plans: an append-only log folded over an immutable table. Undo is a shorter log.

Each edit is an expression on the rows that are there; edits without effect (an unknown operation, a column
that is gone) do nothing. ``replay`` measures how many cells or rows each one changed.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import scalars as S

from .relation_checks import apply_operation
from .tables import ROW, is_missing


@dataclass(frozen=True)
class Edit:
    op: str
    column: str | None = None
    values: dict[Any, str] = field(default_factory=dict)  # relabel: row id -> value; fill_from_column: key -> value
    rows: tuple[int, ...] | DataFrame | None = None
    forms: tuple[str, ...] = ()
    to: str | None = None
    source: str | None = None
    left: str | None = None
    right: str | None = None
    operation: str | None = None
    dayfirst: bool = False
    label: str = ""
    order: str | None = None


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _with(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(value, _c(column)))


def _blank(v: Column) -> Column:
    return S.strip(v) == ""


def _row_ids(df: DataFrame, rows) -> DataFrame:
    return rows.select(ROW) if isinstance(rows, DataFrame) else df.sparkSession.createDataFrame([(int(r),) for r in rows or ()], f"{ROW} long")


def drop_rows(df: DataFrame, e: Edit) -> DataFrame:
    return df.join(_row_ids(df, e.rows), ROW, "left_anti")


def drop_column(df: DataFrame, e: Edit) -> DataFrame:
    return df.drop(e.column)


def relabel(df: DataFrame, e: Edit) -> DataFrame:
    """New labels by row id; ``to`` for the listed rows goes over them."""
    out = df
    if e.values:
        new = df.sparkSession.createDataFrame([(int(k), str(v)) for k, v in e.values.items()], f"{ROW} long, _new string")
        out = _with(out.join(new, ROW, "left"), e.column, F.col("_new")).drop("_new")
    if e.to is not None and e.rows is not None:
        marked = out.join(_row_ids(df, e.rows).distinct().withColumn("_hit", F.lit(True)), ROW, "left")
        out = _with(marked, e.column, F.when(F.col("_hit"), F.lit(e.to))).drop("_hit")
    return out


def normalize_values(df: DataFrame, e: Edit) -> DataFrame:
    """Exactly the listed spellings become one, so contested ones of the same norm stay."""
    return _with(df, e.column, F.when(_c(e.column).isin(list(e.forms)), F.lit(e.to)))


def blank_values(df: DataFrame, e: Edit) -> DataFrame:
    forms = [" ".join(f.split()).lower() for f in e.forms]
    return _with(df, e.column, F.when(F.lower(S.squash(_c(e.column))).isin(forms), F.lit("")))


def fill_missing(df: DataFrame, e: Edit) -> DataFrame:
    return _with(df, e.column, F.when(_blank(_c(e.column)), F.lit(e.to)))


def fill_from_column(df: DataFrame, e: Edit) -> DataFrame:
    """Blank cells by an exact lookup of another column's cell; the mapping has at most a few hundred keys."""
    if e.source not in df.columns or not e.values:
        return df
    table = F.create_map(*[F.lit(str(x)) for kv in e.values.items() for x in kv])
    return _with(df, e.column, F.when(_blank(_c(e.column)), F.try_element_at(table, _c(e.source))))


def column_decimals(df: DataFrame, column: str) -> int | None:
    """The number of decimals of more than 90 % of a column's plain numbers, if there is one."""
    counts = df.select(S.decimals(_c(column)).alias("places")).where("places is not null").groupBy("places").count()
    rows = sorted(((r["count"], -r["places"]) for r in counts.collect()), reverse=True)  # a row for each number of places
    return -rows[0][1] if rows and rows[0][0] / sum(n for n, _ in rows) > 0.9 else None


def fill_from_formula(df: DataFrame, e: Edit) -> DataFrame:
    if e.left not in df.columns or e.right not in df.columns:
        return df
    x, y = S.parse_number(_c(e.left)), S.parse_number(_c(e.right))
    value = F.round(apply_operation(e.operation, x, y), 6)
    places = column_decimals(df, e.column)
    if places is None:
        text = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    else:
        text = F.round(value, places).cast(f"decimal(38,{min(places, 18)})").cast("string")
    return _with(df, e.column, F.when(_blank(_c(e.column)) & ~is_missing(_c(e.left)) & ~is_missing(_c(e.right)), text))


def reformat_number(df: DataFrame, e: Edit) -> DataFrame:
    return _with(df, e.column, S.number_literal(_c(e.column)))


def reformat_date(df: DataFrame, e: Edit) -> DataFrame:
    return _with(df, e.column, S.parse_date(_c(e.column), e.dayfirst))


def normalize_boolean(df: DataFrame, e: Edit) -> DataFrame:
    return _with(df, e.column, S.parse_boolean(_c(e.column)).cast("string"))


def strip_markup(df: DataFrame, e: Edit) -> DataFrame:
    return _with(df, e.column, F.when(S.has_markup(_c(e.column)), S.strip_markup(_c(e.column))))


def _every_column(df: DataFrame, f) -> DataFrame:
    return df.withColumns({c: f(_c(c)) for c in df.columns if c != ROW})


def strip_invisible(df: DataFrame, e: Edit) -> DataFrame:
    return _every_column(df, S.strip_invisible)


def trim(df: DataFrame, e: Edit) -> DataFrame:
    return _every_column(df, S.strip)


def dedupe(df: DataFrame, e: Edit) -> DataFrame:
    """The first of identical rows stays. First rows are found by a grouped minimum, which is combined before the shuffle."""
    names = [c for c in df.columns if c != ROW]
    first = df.groupBy(*[_c(c) for c in names]).agg(F.min(ROW).alias(ROW)).select(ROW)
    return df.join(first, ROW, "left_semi")


OPERATIONS = {
    "drop_rows": drop_rows, "drop_column": drop_column, "relabel": relabel, "normalize_values": normalize_values, "blank_values": blank_values,
    "fill_missing": fill_missing, "fill_from_column": fill_from_column, "fill_from_formula": fill_from_formula, "reformat_number": reformat_number,
    "reformat_date": reformat_date, "normalize_boolean": normalize_boolean, "strip_markup": strip_markup, "strip_invisible": strip_invisible,
    "trim": trim, "dedupe": dedupe,
}
NEEDS_COLUMN = set(OPERATIONS) - {"drop_rows", "strip_invisible", "trim", "dedupe"}


def apply(df: DataFrame, e: Edit) -> DataFrame:
    if e.op not in OPERATIONS or (e.op in NEEDS_COLUMN and e.column not in df.columns):
        return df
    return OPERATIONS[e.op](df, e).select(ROW, *[_c(c) for c in df.columns if c != ROW and not (e.op == "drop_column" and c == e.column)])


def replay(df: DataFrame, edits: list[Edit]) -> DataFrame:
    """The table after all edits; lineage only, nothing runs."""
    for e in edits:
        df = apply(df, e)
    return df


def changes(df: DataFrame, edits: list[Edit]) -> DataFrame:
    """(step, op, column, changed): cells that each edit changed, or rows or columns that it removed."""
    spark = df.sparkSession
    told = None
    for k, e in enumerate(edits):
        after = apply(df, e)
        if e.op in ("drop_rows", "dedupe"):
            row = df.join(after.select(ROW), ROW, "left_anti").agg(F.count(F.lit(1)).alias("changed"))
        elif e.op == "drop_column":
            row = spark.createDataFrame([(int(e.column in df.columns),)], "changed long")
        else:
            names = [c for c in after.columns if c != ROW and c in df.columns]
            new = after.select(ROW, *[_c(c).alias(f"_n{i}") for i, c in enumerate(names)])
            differs = sum(((~_c(c).eqNullSafe(F.col(f"_n{i}"))).cast("long") for i, c in enumerate(names)), F.lit(0).cast("long"))
            row = df.join(new, ROW).agg(F.coalesce(F.sum(differs), F.lit(0)).cast("long").alias("changed"))
        row = row.select(F.lit(k).alias("step"), F.lit(e.op).alias("op"), F.lit(e.column).cast("string").alias("column"), "changed")
        told = row if told is None else told.unionByName(row)
        df = after
    return told if told is not None else spark.createDataFrame([], "step int, op string, column string, changed long")


def undo(edits: list[Edit], steps: int = 1) -> list[Edit]:
    return edits[: max(0, len(edits) - steps)]


SENTENCES = {
    "drop_rows": "removed {n} rows", "drop_column": "dropped column '{c}'", "relabel": "changed {n} labels in '{c}'", "normalize_values": "respelled {n} cells in '{c}'",
    "blank_values": "blanked {n} cells in '{c}'", "fill_missing": "filled {n} blank cells in '{c}'", "fill_from_column": "looked up {n} blank cells in '{c}'",
    "fill_from_formula": "computed {n} blank cells in '{c}'", "reformat_number": "rewrote {n} numbers in '{c}'", "reformat_date": "rewrote {n} dates in '{c}'",
    "normalize_boolean": "respelled {n} truth values in '{c}'", "strip_markup": "took markup out of {n} cells in '{c}'", "strip_invisible": "cleared unseen characters from {n} cells",
    "trim": "trimmed {n} cells", "dedupe": "removed {n} repeated rows",
}


def describe(e: Edit, changed: int) -> str:
    """One sentence with the measured number of changes."""
    return SENTENCES.get(e.op, e.op).format(n=changed, c=e.column)


def again(e: Edit) -> Edit:
    return replace(e, order="fill_from_formula_again")
