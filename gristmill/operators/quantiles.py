"""Exact quantiles of counted values, column by column, without a column's values in one buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled

FEW = 200_000  # distinct values of a column that one aggregation buffer may hold


def quantiles(counted: DataFrame, shares: list[float], kinds: dict[str, int] | None = None) -> DataFrame:
    """(col, q, total) from (col, num, n): the values at ``shares`` of each column, between two neighbours in proportion.

    Columns of few distinct values are one aggregation. The values of others are sorted over all partitions and
    ranked by running counts: within a partition, on top of what the partitions before it hold. Both give the same.
    ``kinds``: how many distinct values each column has at most, where that is known.
    """
    if kinds is None:
        sizes = counted.groupBy("col").agg(F.approx_count_distinct("num", 0.02).alias("kinds"))
        kinds = {r["col"]: r["kinds"] for r in sizes.collect()}  # one row for each column
    wide = [c for c, n in kinds.items() if n > FEW]
    want = F.array(*[F.lit(float(s)) for s in shares])
    few = counted.where(~F.col("col").isin(wide)) if wide else counted
    told = few.groupBy("col").agg(F.expr(f"percentile(num, array({', '.join(f'{float(s)}D' for s in shares)}), n)").alias("q"), F.sum("n").alias("total"))
    if not wide:
        return told
    return told.unionByName(_ranked(counted.where(F.col("col").isin(wide)), want))


def _ranked(counted: DataFrame, want) -> DataFrame:
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written out, as its ranges must be the same in each of the passes over it.
    dealt = settled(counted.groupBy("col", "num").agg(F.sum("n").alias("n")).repartitionByRange(parts, "col", "num").withColumn("part", F.spark_partition_id()))
    held = dealt.groupBy("col", "part").agg(F.sum("n").alias("held"))  # one row for each partition and column
    before = F.coalesce(F.sum("held").over(Window.partitionBy("col").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select("col", "part", before.alias("start"), F.sum("held").over(Window.partitionBy("col")).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("part", "col").orderBy("num"))
    ranked = dealt.withColumn("upto", upto).join(F.broadcast(starts), ["col", "part"]).withColumns({"hi": F.col("start") + F.col("upto"), "lo": F.col("start") + F.col("upto") - F.col("n")})
    at = ranked.select("col", "num", "lo", "hi", "total", F.posexplode(F.transform(want, lambda s: s * (F.col("total") - 1)))).withColumnRenamed("col", "_").toDF("col", "num", "lo", "hi", "total", "k", "place")
    low, high = F.floor("place"), F.ceil("place")
    holds = lambda i: (F.col("lo") <= i) & (i < F.col("hi"))
    near = at.where(holds(low) | holds(high)).groupBy("col", "k").agg(F.max(F.when(holds(low), F.col("num"))).alias("a"), F.max(F.when(holds(high), F.col("num"))).alias("b"), F.first(F.col("place") - low).alias("part"), F.first("total").alias("total"))
    value = F.when(F.col("part") == 0, F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    return near.withColumn("value", value).groupBy("col").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("q"), F.first("total").alias("total"))
