"""How good a cleaning or a check is: against an ideal table, or against planted faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions import scalars as S

from .tables import ROW, Table


def unfinished(v: Column) -> Column:
    """A cell that a cleaning should have dealt with: blank, a word for no value, dressed or padded."""
    norm = S.normalise_latin(v)
    return (norm == "") | norm.isin(config.SENTINEL_WORDS) | S.strip(v).rlike(r"(?i)^[($]|%$|,\d{3}|\s(c|kg|km|m|cm|f)$|\)$") | (v != S.strip(v))


def junk(t: Table) -> DataFrame:
    return t.cells.agg(F.count(F.when(unfinished(F.col("raw")), 1)).alias("junk"))


def coverage(dirty: Table, clean: Table, ideal: Table) -> float:
    """The share of removable junk that was removed."""
    before, after, floor = (junk(t).first()[0] for t in (dirty, clean, ideal))
    return 1.0 if before <= floor else min(max(before - after, 0) / (before - floor), 1.0)


def matches(a: Column, b: Column) -> Column:
    x, y = (S.as_double(F.replace(v, F.lit(","), F.lit(""))) for v in (a, b))
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-6).otherwise(S.strip(a) == S.strip(b))


def _met(clean: Table, ideal: Table) -> DataFrame:
    want = ideal.cells.withColumnRenamed("raw", "want")
    return clean.cells.join(want, [ROW, "col"]).where(S.strip(F.col("want")) != "")


def agreement(clean: Table, ideal: Table) -> DataFrame:
    """(col, compared, same): cells that match the ideal table, by row id."""
    return _met(clean, ideal).groupBy("col").agg(F.count(F.lit(1)).alias("compared"), F.count(F.when(matches(F.col("raw"), F.col("want")), 1)).alias("same"))


def damage(dirty: Table, clean: Table, ideal: Table) -> DataFrame:
    """(col, were_right, broken): cells that were right before the cleaning and no longer are."""
    met = _met(clean, ideal).join(dirty.cells.withColumnRenamed("raw", "old"), [ROW, "col"]).where(matches(F.col("old"), F.col("want")))
    return met.groupBy("col").agg(F.count(F.lit(1)).alias("were_right"), F.count(F.when(~matches(F.col("raw"), F.col("want")), 1)).alias("broken"))


def precision_recall(flagged: DataFrame, planted: DataFrame) -> DataFrame:
    """(threshold, n_flagged, n_hit, n_planted) from (threshold, _row_id) and planted (_row_id)."""
    hits = flagged.join(planted.select(ROW, F.lit(1).alias("hit")), ROW, "left").groupBy("threshold").agg(F.count(F.lit(1)).alias("n_flagged"), F.count("hit").alias("n_hit"))
    return hits.withColumn("n_planted", F.lit(planted.count()))
