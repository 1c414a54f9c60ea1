"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after all white space ([\\x20\\x09-\\x0D]) is deleted; equality
is judged by SHA-256. Misra-Gries counters (Spark's ``freqItems``) keep at most ``1 / support`` digests
and hold every digest that more than ``support`` of the rows share. Those candidates are counted exactly;
each one's winner is broadcast (at most ``1 / support`` rows), so copies in hot groups are settled
where they are read. All other digests go through an ordinary shuffle, in groups below that share.

Of equal texts the row with the most code points in its original text stays, then the smallest doc_id.
A null text counts as empty, a null doc_id as larger than any other. Of wholly repeated rows
(doc_id too) one stays. Texts of any length are digested whole; empty tables give empty results. Extra columns, whatever
their names, are kept by ``exact_dedup`` and not read by ``exact_groups``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, read, table

SUPPORT = 0.001


def digest(text) -> F.Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", ""), 256)


def _winner() -> F.Column:
    """Least is best: most code points, then smallest id, null ids last."""
    return F.min(F.struct((-F.col("_len")).alias("n"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id")))


def _settled(rows: DataFrame) -> DataFrame:
    return rows.select("_id", "_digest", "_len", F.col("_win.id").alias("_keep"), "_size", (F.col("_id").eqNullSafe(F.col("_win.id")) & (F.col("_len") == -F.col("_win.n"))).alias("_best"))


def _once(rows: DataFrame) -> DataFrame:
    """One row for each document row again; of repeats of a winning row only one is kept."""
    others = rows.where(~F.col("_best")).withColumn("_kept", F.lit(False))
    best = rows.where("_best").groupBy("_id", "_digest", "_len", "_keep", "_size").agg(F.count(F.lit(1)).alias("_n"))
    best = best.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i"))
    return others.drop("_best").unionByName(best.withColumn("_kept", F.col("_i") == 1).drop("_n", "_i"))


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row for each document: its digest, the id that stays, the group's size and whether this row stays."""
    keyed = table(docs.select(F.col(id).alias("_id"), digest(F.col(text)).alias("_digest"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("_len")), "digests")
    frequent = keyed.stat.freqItems(["_digest"], support).select(F.explode("_digest_freqItems").alias("_digest"))
    hot = F.broadcast(frequent)  # at most 1 / support rows
    verified = keyed.join(hot, "_digest", "left_semi").groupBy("_digest").agg(_winner().alias("_win"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    winners = F.broadcast(verified)  # at most 1 / support rows
    heavy = keyed.join(winners, "_digest")
    light = keyed.join(F.broadcast(verified.select("_digest")), "_digest", "left_anti")
    groups = light.groupBy("_digest").agg(_winner().alias("_win"), F.count(F.lit(1)).alias("_size"))
    out = _once(_settled(heavy).unionByName(_settled(light.join(groups, "_digest"))))
    return out.select(F.col("_id").alias(id), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"), F.col("_len").alias("n_code_points"))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows travel as one struct, so no column name clashes."""
    keyed = docs.select(F.struct("*").alias("doc"), F.col(id).alias("id"), digest(F.col(text)).alias("digest"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))
    groups = exact_groups(docs, id, text, support)
    # Only rows of groups with copies are named: losers go, repeats of a winning row are thinned to one.
    marks = groups.where("group_size > 1").groupBy(F.col(id).alias("id2"), F.col("text_sha256").alias("digest2"), F.col("n_code_points").alias("n2")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    marks = marks.where("not kept or rows > 1")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")) & (F.col("n") == F.col("n2"))
    met = keyed.join(marks, same, "left")
    single = met.where("kept is null")
    repeated = met.where("kept").dropDuplicates(["id", "digest", "n"])
    return single.unionByName(repeated).select("doc.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM keyed WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""
