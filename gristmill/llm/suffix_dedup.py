"""Removal of long repeats with a logarithmic family of suffix arrays.

A byte is removed if a ``length``-byte string that covers it also starts anywhere else. Texts are UTF-8
bytes, matches never cross documents, and strings are judged on the input.

First, what cannot repeat is set aside. Windows of ``length`` bytes fall into runs by content-defined anchors
(``anchors``), and equal windows have equal anchors at the same place. So a run whose anchor gram is met
once holds no repeat, and one whose gram always stands in the same segment repeats as a whole. Only segments
that share a gram but differ go into the index, each distinct one once.

The index is split by gram. In each part segments come in batches. A batch's window starts are sorted to a
suffix array (by the ``length`` bytes that count), which is merge-scanned against every level of the family:
equal neighbours are repeats on both sides. Then it joins the family, where levels of equal size merge, so
sizes grow geometrically. A part is worked in passes over the suffixes' first bytes, which bounds what is
held at once. Grams in more than ``HOT`` different segments are split further: their windows are
counted one by one in an ordinary aggregation, which no hot gram can pile up in one task.

Runs are compared by the hashes of their gram and of their segment, 64 bits each and both of the same place, and
are not held against each other byte by byte; segments in the index are. Spans meet their row again by its id and
96 bits of its text's hashes, so rows of one id with different texts are told apart.

Null and short texts have nothing to remove. Very long texts are cut into overlapping parts, so that no window is lost. Repeated rows are copies like others: all their windows repeat.
Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import pieces, runs
from .common import bounded_batches, read, table
from .fixed_state import bloom, may_hold

LENGTH = 200
GRAIN = 64
PART = 1500  # segments in a part of the index, on average
PASS = 150_000  # suffixes worked at once
BATCH = 32_768  # suffixes in a batch
HOT = 20_000


def anchored(docs: DataFrame, length: int, grain: int) -> DataFrame:
    """(id, th, s0, s1, kh, sh) for each run of windows of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(2).to_pylist()]
            for data, ends, which, offset in pieces(texts, length):
                part, first, last, _, gram, segment = runs(data, ends, length, grain)
                if not len(first):
                    continue
                move = offset[part] - np.r_[0, ends[:-1]][part]
                rows = pa.array(which[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first + move), pa.array(last + move), pa.array(gram.view(np.int64)), pa.array(segment.view(np.int64))], ["id", "th", "s0", "s1", "kh", "sh"]
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, th {docs.schema['th'].dataType.simpleString()}, s0 long, s1 long, kh long, sh long")


def segments(docs: DataFrame, wanted: DataFrame, length: int, grain: int) -> DataFrame:
    """(kh, sh, data) of the wanted segments (a column of sh), read from the texts again, about once each."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, met = shared.value, np.zeros(0, np.int64)
        for batch in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(2).to_pylist()]
            for data, ends, _, _ in pieces(texts, length):
                _, first, last, _, gram, segment = runs(data, ends, length, grain)
                if not len(first):
                    continue
                name = segment.view(np.int64)
                keep = np.flatnonzero(may_hold(bits, name))
                keep = keep[np.unique(name[keep], return_index=True)[1]]
                if len(met):
                    keep = keep[~np.isin(name[keep], met)]
                met = np.concatenate([met, name[keep]])[-(1 << 20) :]
                cut = [data[a : b + length] for a, b in zip(first[keep].tolist(), last[keep].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)[keep]), pa.array(name[keep]), pa.array(cut, pa.binary())], ["kh", "sh", "data"])

    return docs.mapInArrow(run, "kh long, sh long, data binary")


class Family:
    """Suffix arrays over one text, in levels of geometrically growing size. ``repeated`` marks window starts."""

    def __init__(self, text: np.ndarray, length: int, repeated: np.ndarray, place: np.ndarray):
        self.windows = np.lib.stride_tricks.sliding_window_view(text, length)
        self.kind = f"S{length}"
        self.repeated, self.place = repeated, place  # place: start in the text of each suffix
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, batch: np.ndarray) -> None:
        """Index a batch of suffixes (numbers into ``place``)."""
        keys = np.ascontiguousarray(self.windows[self.place[batch]]).view(self.kind).ravel()
        order = np.argsort(keys, kind="stable")
        keys, batch = keys[order], batch[order]
        same = keys[1:] == keys[:-1]
        self.repeated[batch[1:][same]] = True
        self.repeated[batch[:-1][same]] = True
        new = np.r_[True, ~same]
        keys, batch = keys[new], batch[new]
        for theirs, owner in self.levels:
            at = np.minimum(np.searchsorted(theirs, keys), len(theirs) - 1)
            met = theirs[at] == keys
            self.repeated[batch[met]] = True
            self.repeated[owner[at[met]]] = True
            keys, batch = keys[~met], batch[~met]  # the level already holds this suffix
            if not len(keys):
                return
        while self.levels and len(self.levels[-1][0]) <= 2 * len(keys):
            theirs, owner = self.levels.pop()
            at = np.searchsorted(theirs, keys)
            keys, batch = np.insert(theirs, at, keys), np.insert(owner, at, batch)
        self.levels.append((keys, batch))


def repeats(data: list[bytes], length: int = LENGTH, at_once: int = PASS, batch: int = BATCH) -> list[np.ndarray]:
    """For each string, which of its windows also start elsewhere in the strings."""
    text = np.frombuffer(b"".join(data), np.uint8)
    sizes = np.array([len(d) for d in data])
    counts = np.maximum(sizes - length + 1, 0)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return [np.zeros(0, bool) for _ in data]
    place = np.arange(total) + np.repeat(np.r_[0, np.cumsum(sizes)[:-1]] - np.r_[0, ends[:-1]], counts)
    repeated = np.zeros(total, bool)
    passes = -(-total // at_once)
    turn = np.zeros(total, np.int64)
    if passes > 1:
        head = np.zeros(total, np.uint64)
        for j in range(8):
            head = (head * np.uint64(0x100000001B3)) ^ text[place + j * (length // 8)].astype(np.uint64)
        head = (head ^ (head >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        turn = ((head >> np.uint64(33)) % np.uint64(passes)).astype(np.int64)
    for k in range(passes):
        mine = np.flatnonzero(turn == k) if passes > 1 else np.arange(total)
        family = Family(text, length, repeated, place)
        for i in range(0, len(mine), batch):
            family.add(mine[i : i + batch])
    return np.split(repeated, ends[:-1])


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2] - 1


def repeated_runs(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, hot: int = HOT) -> DataFrame:
    """(id, th, a, b): ranges of window starts of documents that repeat, from ``docs`` (id, th, text)."""
    rows = table(anchored(docs, length, grain), "suffix-anchors")
    grams = rows.groupBy("kh").agg(F.count(F.lit(1)).alias("n"), (F.min("sh") != F.max("sh")).alias("differ")).where("n > 1").drop("n")
    met = table(rows.join(grams, "kh"), "suffix-met")
    whole = met.where("not differ").select("id", "th", F.col("s0").alias("a"), F.col("s1").alias("b"))
    mixed = met.where("differ").drop("differ")
    distinct = table(mixed.groupBy("kh", "sh").agg(F.count(F.lit(1)).alias("c")), "suffix-distinct")
    n = distinct.count()
    crowded = distinct.groupBy("kh").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("kh")
    found = table(segments(docs, distinct.select("sh"), length, grain).dropDuplicates(["kh", "sh"]), "suffix-segments")
    # The filter may have let others through; they are not among the distinct ones.
    found = found.join(distinct, ["kh", "sh"])
    parts = max(1, n // PART)

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kh, sh, c, flags in zip(pdf["kh"], pdf["sh"], pdf["c"], repeats(list(pdf["data"]), length)):
            lo, hi = ranges(flags | (c > 1))
            out.append((kh, sh, lo.tolist(), hi.tolist()))
        return pd.DataFrame(out, columns=["kh", "sh", "lo", "hi"])

    schema = "kh long, sh long, lo array<long>, hi array<long>"
    cool = found.join(crowded, "kh", "left_anti").withColumn("part", F.pmod(F.xxhash64("kh"), F.lit(parts)))
    told = cool.groupBy("part").applyInPandas(index, schema)
    if crowded.limit(1).count():
        told = told.unionByName(_counted(found.join(crowded, "kh", "left_semi"), length))
    told = table(told.where("size(lo) > 0"), "suffix-told")
    spans = mixed.join(told, ["kh", "sh"]).select("id", "th", "s0", F.explode(F.arrays_zip("lo", "hi")).alias("r"))
    return whole.unionByName(spans.select("id", "th", (F.col("s0") + F.col("r.lo")).alias("a"), (F.col("s0") + F.col("r.hi")).alias("b")))


def _counted(found: DataFrame, length: int) -> DataFrame:
    """The same result for segments of hot grams: each window is a row, counted by its bytes."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length("data").cast("long") - length)).alias("o")
    windows = found.select("kh", "sh", "c", "data", at).select("kh", "sh", "c", "o", F.sha2(F.expr(f"substring(data, cast(o + 1 as int), {length})"), 256).alias("w"))
    often = windows.groupBy("w").agg(F.sum("c").alias("n")).where("n > 1").select("w")
    starts = windows.join(often, "w").groupBy("kh", "sh").agg(F.sort_array(F.collect_list("o")).alias("lo"))
    return starts.select("kh", "sh", "lo", F.col("lo").alias("hi"))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every document; kept: the remaining bytes."""
    named = bounded_batches(docs).select(F.col(id).alias("id"), F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b")).alias("th"), F.col(text).alias("text"))
    # Each range covers its windows' bytes: from the first start to the last start plus length.
    spans = repeated_runs(named, length).groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("a", (F.col("b") + length).alias("b")))).alias("spans"))
    spans = spans.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "spans")
    met = named.join(spans, named["id"].eqNullSafe(spans["_id"]) & (named["th"] == spans["_th"]), "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, begins, stops in batches:
            out = []
            for x, a, b in zip(texts, begins, stops):
                data = (x or "").encode("utf-8", "surrogatepass")
                if a is None or not len(a):
                    out.append((len(data), 0, 0, data))
                    continue
                a, b = np.asarray(a), np.maximum.accumulate(np.asarray(b))
                new = np.r_[True, a[1:] > b[:-1]]
                first, last = a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]
                kept = b"".join(data[i:j] for i, j in zip([0, *last.tolist()], [*first.tolist(), len(data)]))
                out.append((len(data), len(data) - len(kept), len(first), kept))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    done = met.select("id", cut("text", F.col("spans.a"), F.col("spans.b")).alias("x"))
    return done.select(F.col("id").alias(id), "x.n_bytes", "x.n_removed", "x.n_spans", "x.kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    return told.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
