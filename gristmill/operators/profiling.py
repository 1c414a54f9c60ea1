"""Column profiles and semantic types, all from the dictionary of distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions import scalars as S

from .quantiles import quantiles
from .tables import Table


def _sum_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def statistics(values: DataFrame) -> DataFrame:
    """One row for each column: counts, shares and number statistics. A single aggregation over the dictionary."""
    raw, n = F.col("raw"), F.col("n")
    here = ~F.col("missing")
    num = F.when(here, F.col("num"))
    dressed = S.needs_reformatting(raw)
    return values.groupBy("col").agg(
        F.sum("n").alias("n_rows"),
        _sum_if(F.col("missing")).alias("n_missing"),
        _sum_if(here).alias("n_present"),
        F.count(F.when(here, raw)).alias("n_unique"),
        F.count(F.lit(1)).alias("n_raw"),
        (F.sum(F.when(here, S.n_words(raw) * n)) / F.greatest(_sum_if(here), F.lit(1))).alias("mean_tokens"),
        _sum_if(num.isNotNull()).alias("n_numeric"),
        _sum_if(num.isNotNull() & (num % 1 != 0)).alias("n_fractional"),
        _sum_if(here & ~F.col("sentinel")).alias("n_readable"),
        _sum_if(here & ~F.col("sentinel") & dressed).alias("n_dressed"),
        _sum_if(here & S.to_timestamp(raw).isNotNull()).alias("n_dates"),
        _sum_if(here & S.is_time_only(raw)).alias("n_times"),
        F.bool_or(here & raw.rlike("[-/:]")).alias("date_hint"),
        F.bool_and(~here | F.lower(S.strip(raw)).isin(config.BOOLEAN_WORDS)).alias("boolean_words"),
        F.min(num).alias("min"),
        F.max(num).alias("max"),
        (F.sum(num * n) / _sum_if(num.isNotNull())).alias("mean"),
    )


def inferred_type() -> Column:
    """The first rule that fits names the type."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    continuous = ((share("n_numeric", "n_present") > config.PARSE_SHARE) & (share("n_fractional", "n_numeric") > config.CONTINUOUS_SHARE)) | (share("n_dressed", "n_readable") > config.PARSE_SHARE)
    dates = F.coalesce(F.col("date_hint"), F.lit(False)) & (share("n_times", "n_present") <= config.PARSE_SHARE) & (share("n_dates", "n_present") > config.PARSE_SHARE)
    long_text = F.col("mean_tokens") >= config.TEXT_TOKENS
    return (
        F.when(F.col("n_unique") <= 1, "constant")
        .when((share("n_unique", "n_present") > config.ID_SHARE) & ~continuous & ~dates & ~long_text, "id_like")
        .when((F.col("n_unique") == 2) & F.col("boolean_words"), "boolean")
        .when(dates, "datetime")
        .when(share("n_numeric", "n_present") > config.PARSE_SHARE, "numeric")
        .when(long_text, "text")
        .otherwise("categorical")
    )


def profile(t: Table) -> DataFrame:
    numbers = t.values.where("not missing and num is not null")
    medians = quantiles(numbers, [0.5]).select(F.col("col").alias("_col"), F.col("q")[0].alias("median"))
    counted = statistics(t.values).join(F.broadcast(medians), F.col("col") == F.col("_col"), "left").drop("_col")  # one row for each column
    told = counted.withColumns(
        {
            "inferred_type": inferred_type(),
            "missing_fraction": F.col("n_missing") / F.col("n_rows"),
            "unique_share": F.when(F.col("n_present") > 0, F.col("n_unique") / F.col("n_present")).otherwise(0.0),
        }
    )
    number = F.col("inferred_type") == "numeric"
    return told.withColumns({c: F.when(number, F.col(c)) for c in ("min", "max", "mean", "median")})


def top_values(t: Table, k: int = 10) -> DataFrame:
    """(col, raw, n, place) of the most frequent present values of columns with few kinds of values."""
    place = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "raw"))
    told = t.values.where("not missing").join(F.broadcast(t.types.select("col", "inferred_type")), "col").where(F.col("inferred_type").isin("categorical", "boolean", "constant"))
    return told.withColumn("place", place).where(F.col("place") <= k).select("col", "raw", "n", "place")


def sample_values(t: Table, k: int = 5) -> DataFrame:
    """The first distinct present values of each column, in row order."""
    place = F.row_number().over(Window.partitionBy("col").orderBy("first", "raw"))
    return t.values.where("not missing").withColumn("place", place).where(F.col("place") <= k).select("col", "raw", "place")


def missing_spellings(t: Table) -> DataFrame:
    """(col, norm, n): how a column writes that it has no value."""
    return t.values.where("missing and norm <> ''").groupBy("col", "norm").agg(F.sum("n").alias("n"))


def label_candidates(t: Table) -> list[str]:
    return t.of_kind("categorical", "boolean", "numeric", "constant")


def split_candidates(t: Table) -> list[str]:
    return t.of_kind("categorical", "boolean", "constant")
