"""A table under audit: string columns and a row id, its dictionary of distinct values, and its profile.

The dictionary (one row for each column and distinct value, with its count) is what column checks read:
functions run once on each distinct value, and every per-column statistic is one aggregation over it.
"""

from __future__ import annotations

import tempfile
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions import scalars as S

ROW = "_row_id"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with dense ids ``_row_id`` in the order of its partitions and rows, without a pass through Python or one place.

    Rows are counted by partition, and each partition begins where those before it end. Both passes need the same
    partitions: scans give them; what was shuffled, and may be dealt anew, is written to the checkpoint folder first.
    """
    placed = df.withColumn(ROW, F.monotonically_increasing_id())
    if "Exchange" in df._jdf.queryExecution().sparkPlan().toString() or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        placed = settled(placed)
    part = F.shiftright(ROW, 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row for each partition.
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    met = placed.join(F.broadcast(starts), part == F.col("_part"))
    return met.withColumn(ROW, F.col("_start") + F.col(ROW).bitwiseAND((1 << 33) - 1)).drop("_part", "_start")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: later passes read the same rows in the same partitions, though executors are lost."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def checkpoint_dir(spark) -> str:
    """The folder all executors share; a temporary one only where none is set and one machine runs all, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or "file://" + tempfile.mkdtemp(prefix="gristmill-")


def as_strings(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """All columns as strings, nulls as empty, and ``_row_id``: the given column, or dense ids in file order."""
    if row_id is None and ROW not in df.columns:
        df = numbered(df)
    elif row_id is not None:
        df = df.withColumn(ROW, F.col(row_id).cast("long"))
    return df.select(ROW, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns if c != ROW])


class Table:
    def __init__(self, df: DataFrame, columns: list[str] | None = None):
        self.df = df
        self.columns = columns or [c for c in df.columns if c != ROW]

    @cached_property
    def cells(self) -> DataFrame:
        """(_row_id, col, raw): the table unpivoted."""
        return self.df.select(ROW, *[f"`{c}`" for c in self.columns]).unpivot([ROW], self.columns, "col", "raw")

    @cached_property
    def values(self) -> DataFrame:
        """(col, raw, n) and what the checks ask of a value. Counting comes first, so functions see each value once.

        It is made once and kept on the executors for all checks, until ``release``.
        """
        counted = self.cells.groupBy("col", "raw").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"))
        return described(counted).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        """Drop what is kept for the checks; plans made before work on, from the rows again."""
        if "values" in self.__dict__:
            self.values.unpersist()

    @cached_property
    def profile(self) -> DataFrame:
        from .profiling import profile

        return profile(self)

    @cached_property
    def kinds(self) -> dict[str, dict]:
        """The profile by column on the driver: one small record for each column."""
        return {r["col"]: r.asDict() for r in self.profile.collect()}

    @cached_property
    def types(self) -> DataFrame:
        """(col, inferred_type, n_present, n_rows): the profile as a small local table, worked out once."""
        rows = [(c, k["inferred_type"], k["n_present"], k["n_rows"]) for c, k in self.kinds.items()]
        return self.df.sparkSession.createDataFrame(rows, "col string, inferred_type string, n_present long, n_rows long")

    @cached_property
    def n_rows(self) -> int:
        return self.df.count()

    def of_kind(self, *kinds: str) -> list[str]:
        return [c for c in self.columns if self.kinds[c]["inferred_type"] in kinds]

    def numbers(self, names: list[str]) -> DataFrame:
        """(_row_id, the columns as doubles): null where a cell is missing or no number."""
        return self.df.select(ROW, *[present_number(F.col(f"`{c}`")).alias(c) for c in names])

    def without_sentinels(self) -> Table:
        """The same rows with words that mean "no value" blanked."""
        blank = {c: F.when(is_sentinel(F.col(f"`{c}`")), "").otherwise(F.col(f"`{c}`")) for c in self.columns}
        return Table(self.df.withColumns(blank), self.columns)


def described(counted: DataFrame) -> DataFrame:
    """Norms of distinct values: plain ones in the JVM, only others through Python."""
    plain = counted.where(S.is_latin(F.col("raw"))).withColumn("norm", S.normalise_latin(F.col("raw")))
    other = counted.where(~S.is_latin(F.col("raw"))).withColumn("norm", S.normalise_text(F.col("raw")))
    raw = F.col("raw")
    return plain.unionByName(other).withColumns(
        {
            "missing": F.col("norm").isin(config.MISSING_WORDS),
            "sentinel": F.col("norm").isin(config.SENTINEL_WORDS),
            "blank": S.strip(raw) == "",
            "num": S.to_number(raw),
        }
    )


def is_missing(v: Column) -> Column:
    """The row-level twin of ``missing``, without Python."""
    return S.normalise_latin(v).isin(S.spellings(config.MISSING_WORDS))


def is_sentinel(v: Column) -> Column:
    return S.normalise_latin(v).isin(S.spellings(config.SENTINEL_WORDS))


def present_number(v: Column) -> Column:
    return F.when(~is_missing(v), S.to_number(v))
