"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words: the budget is shared by weight, a target stops at
``most`` times its source's size, and what is cut there is shared again among the others. A document
should then appear ``target / source size`` times. The whole part of that is certain; the fraction is
rounded so that the words of a source stay fixed: two documents with fractional parts trade words until
one of them is whole, at odds that keep both expectations (pivotal rounding with sizes as masses). Documents that
are large against all smaller ones of their chunk trade with these as a whole first, at the same odds. One
exception: where the small ones cannot balance a giant in one of the two directions, it goes the other way, which
keeps the source near its target but not the giant's expectation.

A chunk of a few thousand documents of one source leaves at most one fraction. These residuals are
chunked again, level by level, until each source has one left, which is rounded by itself. Documents
enter a chunk from the largest to the smallest, so what remains tends to be small. Chunks and random
numbers come from hashes of the rows and, among wholly equal rows, of a number given to each; so reruns agree
whatever the partitions are, no chunk gathers more than its share, and a hot source or row is only more chunks.

Size: the number of words in the text, 0 for null. Documents without words are never taken. A null source
is a source of its own, last in order. Repeated rows are each a document of their own. Long texts are counted
where they are read and do not travel with the sizes. Empty tables give empty results; extra columns are kept
by ``mix``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read, table

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2.0
CHUNK = 4096
SEED = 20


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(_source, source_size, n, target), one row for each source. The windows here run over sources, not documents."""
    sources = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy(F.lit(1))
    up = Window.orderBy("_fill", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sources.withColumn("_w", cycle)
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_fill", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(all_rows) * budget)
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(up), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(up), F.lit(0.0)))
        .withColumn("_full", F.col("_fill") * F.col("_rest") <= F.col("_left"))
    )
    spare = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(all_rows), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(all_rows)
    share = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), spare * F.col("_w") / open_w))
    return ranked.withColumn("target", share).select("_source", "source_size", "n", "target")


def pivotal(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round ``p`` so that sum(size * p) stays; at most one entry is still a fraction. Entries are met in the given order."""
    out = p.astype(float).copy()
    held = -1
    for k in range(len(out)):
        if out[k] <= 0.0 or out[k] >= 1.0:
            continue
        if held < 0:
            held = k
            continue
        a, b, sa, sb = out[held], out[k], size[held], size[k]
        up, down = min((1.0 - a) * sa, b * sb), min(a * sa, (1.0 - b) * sb)
        if u[k] * (up + down) < down:
            a, b, first = a + up / sa, b - up / sb, (1.0 - a) * sa <= b * sb
            done_a, done_b = (1.0, b) if first else (a, 0.0)
        else:
            a, b, first = a - down / sa, b + down / sb, a * sa <= (1.0 - b) * sb
            done_a, done_b = (0.0, b) if first else (a, 1.0)
        out[held], out[k] = done_a, done_b
        # The one that is whole is settled; a fraction within rounding error of a whole number is too.
        for j in (held, k):
            if out[j] < 1e-12:
                out[j] = 0.0
            elif out[j] > 1.0 - 1e-12:
                out[j] = 1.0
        a_open, b_open = 0.0 < out[held] < 1.0, 0.0 < out[k] < 1.0
        held = held if a_open else (k if b_open else -1)
    return out


def giants(size: np.ndarray, p: np.ndarray, u: np.ndarray, share: float = 0.02) -> np.ndarray:
    """Settle the leading entries that are large against all that follow: each trades words with the rest as a whole.

    Paired one by one, a giant would outlast the small ones and be left over. Sizes fall; ``p`` is one number. A giant that
    the rest can balance in both directions goes either way at the odds that keep its expectation. One that the rest
    can only balance in one direction goes that way: the source's words then stay near their target, as they must.
    """
    out = p.astype(float).copy()
    rest = size.sum() - np.cumsum(size)
    for k in range(len(out) - 1):
        a, b, sa, sb = out[k], out[k + 1], size[k], rest[k]
        if sa < share * sb or sb <= 0 or not (0.0 < a < 1.0) or not (0.0 < b < 1.0):
            break
        up, down = min((1.0 - a) * sa, b * sb), min(a * sa, (1.0 - b) * sb)
        rises, falls = (1.0 - a) * sa <= b * sb, a * sa <= (1.0 - b) * sb
        goes_up = u[k] * (up + down) < down if rises == falls else rises
        moved = up if goes_up else -down
        ends = (1.0, 0.0) if goes_up else (0.0, 1.0)
        whole_a = rises if goes_up else falls
        out[k] = ends[0] if whole_a else a + moved / sa
        out[k + 1 :] = b - moved / sb if whole_a else ends[1]
    return out


def _chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_size", "_order"], ascending=[False, True], kind="stable")
    size, p, u = pdf["_size"].to_numpy(float), pdf["_p"].to_numpy(float), pdf["_u"].to_numpy(float)
    if (p == p[0]).all():
        p = giants(size, p, u)
    pdf["_p"] = pivotal(size, p, u)
    return pdf


def allot(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, chunk: int = CHUNK, seed: int = SEED, key=None) -> DataFrame:
    """One row for each document: _id, _key, _source, _size, source_size, target and how many copies the mix takes."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    plain = docs.select(F.col(id).alias("_id"), (key if key is not None else F.xxhash64(text)).alias("_key"), F.col(source).alias("_source"), words.alias("_size"))
    # Equal rows are numbered, in steps so that no array grows with them; they are then told apart by hash.
    equal = plain.groupBy("_id", "_key", "_source", "_size").agg(F.count(F.lit(1)).alias("_n"))
    steps = equal.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))))
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(chunk).cast("long"), F.col("_n") - F.col("_step") * chunk) - 1))
    sizes = table(steps.withColumn("_nth", nth).select("_id", "_key", "_source", "_size", (F.col("_step") * chunk + F.col("_nth")).alias("_nth")), "mix-sizes")
    goals = table(targets(sizes, weights, budget, most), "mix-targets")
    largest = goals.agg(F.max("n")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sizes.join(goals, sizes["_source"].eqNullSafe(goals["_source"])).drop(goals["_source"])
        .withColumn("_ratio", F.when(F.col("_size") > 0, ratio).otherwise(0.0))
        .withColumn("_base", F.floor("_ratio"))
        .withColumn("_p", F.col("_ratio") - F.col("_base"))
        .withColumn("_order", F.xxhash64(F.lit(seed), "_id", "_key", "_size", "_nth"))
        .withColumn("_chunks", F.ceil(F.col("n") / chunk))
        .drop("n", "_nth", "_ratio")
    )
    settled, level = [], 0
    names = [c for c in rows.columns if c != "_chunks"]
    fraction = "_p > 0 and _p < 1"
    settled.append(rows.where(f"not ({fraction})").select(*names))
    rows = rows.where(fraction)
    while True:
        drawn = rows.withColumn("_u", F.pmod(F.xxhash64(F.lit(seed + 1 + level), "_order", "_id"), F.lit(1 << 52)) / float(1 << 52)).withColumn(
            "_chunk", F.pmod(F.xxhash64(F.lit(seed), "_order"), F.col("_chunks"))
        )
        schema = drawn.schema
        done = table(drawn.groupBy("_source", "_chunk").applyInPandas(_chunk, schema), f"mix-level{level}")
        settled.append(done.where(f"not ({fraction})").select(*names))
        rest = done.where(fraction)
        largest = math.ceil(largest / chunk)
        if largest <= 1:
            # One residual for each source: round it by itself.
            settled.append(rest.withColumn("_p", (F.col("_u") < F.col("_p")).cast("double")).select(*names))
            break
        level += 1
        rows = rest.withColumn("_chunks", F.ceil(F.col("_chunks") / chunk)).drop("_u", "_chunk")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("_id", "_key", "_source", "_size", "source_size", "target", (F.col("_base") + F.col("_p")).cast("long").alias("copies"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Rows travel as one struct, so no column name clashes."""
    key = F.xxhash64(text)
    copies = (
        allot(docs, id, text, source, key=key, **options)
        .groupBy("_id", "_key", "_source")
        .agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
        .where("copies > 0")
    )
    keyed = docs.select(F.struct("*").alias("doc"), F.col(id).alias("id"), key.alias("key"), F.col(source).alias("from"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & F.col("from").eqNullSafe(F.col("_source"))
    met = keyed.join(copies, same)
    # Wholly repeated rows share a count: one of them stands for all.
    rows = met.where("rows = 1").unionByName(met.where("rows > 1").dropDuplicates(["_id", "_key", "_source"]))
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return allot(docs).select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"))
