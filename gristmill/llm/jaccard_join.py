"""Exact Jaccard join of documents on five-word shingles with adaptive multi-match prefixes.

All shingles stand in one global order: rare ones first, in hash order, then frequent ones by estimated
frequency, which comes from a count sketch of fixed size over all documents; the sketch only orders. Two sets of
sizes n and m that link share at least ``alpha`` shingles, so for any k they have k matches among the first
``n - alpha + k`` of one and ``m - alpha + k`` of the other. Every set gives its longest one-match prefix and
an extension of ``n / EXTENSION`` shingles; so how often a prefix shingle stands in other sets is known exactly.

k adapts to what candidates cost. A shingle that stands in more than ``SHORT`` sets of different components is
costly. A document with h costly shingles in its prefix is asked for h + 1 matches and more, in a prefix that
is longer by as many: then at least one match is cheap, and costly lists are left alone. Only where the extension
holds too few cheap shingles for that, for both sets of a pair, the pair is looked for in costly lists with k = 1;
lists with the same least members are then one.

Documents with one set of shingles are one node from the start. Pairs are not enumerated at once: first each
list of a shingle links its members to the one with the most frequent prefix and to the next in size, and
these few pairs are verified. What is then connected needs no more links: only members of different
components in a list still form pairs, are filtered by their number of matches, and verified exactly on
whole sets. No list, partner or candidate is capped: every pair that may link across components is verified.

Words are runs of anything but [\\x20\\x09-\\x0D], after A-Z are lower-cased. A text with one to four words has
them all as its one shingle; one without words, or null, has none and links with nothing. Words are hashed in
blocks of eight bytes, each mixed with its place, so that no regular pattern of text makes hashes meet; sets
are compared by 64-bit hashes of shingles, and if two sets share their name another seed is taken. Long
texts are hashed in parts cut at white space; only their set of shingles is held whole. Repeated rows link like
any copies. Null ids are never a component's name unless it has no other. Empty tables give empty results;
extra columns are kept by ``near_dedup`` and may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, read, table
from .components import components
from .fixed_state import accumulated, bloom, may_hold, mix, packed

PERCENT = 75
SHINGLE = 5
SHARE_OF_MATCHES = 4  # a pair is asked for this part of the cheap matches that its prefixes could show
EXTENSION = 16  # a prefix is lengthened by this part of its set
SHORT = 12  # a shingle in more sets than this is costly
SKETCH_BITS = 21  # counters of the frequency sketch; a fixed number, whatever the corpus
BUFFER = 1 << 19
U = np.uint64


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # masks of the first bytes of a block
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_hashes(data: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a buffer that begins and ends with white space.

    A word is the sum of its blocks of eight bytes, each scrambled together with its place, and its length.
    """
    b = np.frombuffer(data, np.uint8)
    space = _IS_SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, size = edge[::2], edge[1::2] - edge[::2]
    padded = data + bytes(8)
    block_at = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    key = U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    h = mix((block_at[starts] & _KEEP[np.minimum(size, 8)]) + key)
    longer = np.flatnonzero(size > 8)
    if len(longer):
        more = (size[longer] - 1) // 8
        word = np.repeat(longer, more)
        place = np.arange(len(word)) - np.repeat(np.cumsum(more) - more, more) + 1
        rest = mix((block_at[starts[word] + 8 * place] & _KEEP[np.minimum(size[word] - 8 * place, 8)]) + mix(key + place.astype(U)))
        h[longer] += np.add.reduceat(rest, np.cumsum(more) - more)
    return starts, mix(h ^ (size.astype(U) * U(0xD6E8FEB86659FD93)))


def _all_words(data: bytes, seed: int) -> np.ndarray:
    """The hashes of the words of one long text, in parts cut at white space."""
    out, at = [], 0
    while at < len(data):
        cut = _SPACE.search(data, at + BUFFER)
        end = cut.start() if cut else len(data)
        out.append(_word_hashes(b" " + data[at:end] + b" ", seed)[1])
        at = end
    return np.concatenate(out)


def shingle_sets(texts: list[str | None], seed: int = 1, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Texts are hashed together in buffers, a longer text by parts."""
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        if waiting and size + len(data) > BUFFER:
            yield from _sets(waiting, seed, k)
            waiting, size = [], 0
        if len(data) > BUFFER:
            words = _all_words(data, seed)
            yield from _sets_of_words(words, np.array([len(words)]), k)
            continue
        waiting.append(data)
        size += len(data) + 1
    if waiting:
        yield from _sets(waiting, seed, k)


def _sets(parts: list[bytes], seed: int, k: int) -> Iterator[np.ndarray]:
    starts, words = _word_hashes(b" " + b" ".join(parts) + b" ", seed)
    ends = np.cumsum([len(p) + 1 for p in parts])
    return _sets_of_words(words, np.searchsorted(starts, ends, side="left"), k)


def _sets_of_words(words: np.ndarray, ends: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The set of each text; ``ends`` says after which word each ends."""
    n = len(words)
    shingles = np.zeros(max(0, n - k + 1), U)
    for j in range(k):
        shingles = shingles * U(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j] if n >= k else shingles
    shingles = mix(shingles)
    first = 0
    for last in ends.tolist():
        if last - first >= k:
            s = np.sort(shingles[first : last - k + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s
        elif last > first:
            h = last - first
            for w in words[first:last].tolist():
                h = (h * 0x9E3779B97F4A7C15 + w) % (1 << 64)
            yield mix(np.array([h], U) + U(1))
        else:
            yield np.zeros(0, U)
        first = last


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    one, two = mix(s + U(77)).sum(dtype=U), mix(s ^ U(0x5555555555555555)).sum(dtype=U)
    return int(np.int64(np.uint64(one ^ U(len(s))).astype(np.int64))), int(two.astype(np.int64))


def describe(docs: DataFrame, seed: int) -> DataFrame:
    """(key, n, sig, sig2) of every document (key, text), and in other rows (slice, data) the sketch of all shingles' frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            n, one, two, places = [], [], [], [np.zeros(0, np.int64)]
            for s in shingle_sets(batch.column(1).to_pylist(), seed):
                a, b = signature(s)
                n.append(len(s))
                one.append(a)
                two.append(b)
                places.append((s >> U(64 - SKETCH_BITS)).astype(np.int64))
            counts += np.bincount(np.concatenate(places), minlength=len(counts)).astype(np.uint32)
            rows = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        parts = packed(counts)
        m = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, key_type), *[pa.nulls(m, pa.int64())] * 3, pa.array([k for k, _ in parts], pa.int32()), pa.array([d for _, d in parts], pa.binary())], names)

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[0].dataType)
    names = ["key", "n", "sig", "sig2", "slice", "data"]
    return table(docs.mapInArrow(run, f"key {docs.schema[0].dataType.simpleString()}, n long, sig long, sig2 long, slice int, data binary"), "jaccard-docs")


def base_length(n: np.ndarray | int, percent: int):
    """The longest prefix that a partner of any size can ask for, for one match."""
    return n + 1 + (-percent * n) // 100


def extension(n: int) -> int:
    return n // EXTENSION + (n > 1)


def prefix(s: np.ndarray, sketch: np.ndarray, bar: float, percent: int) -> np.ndarray:
    """The lengthened prefix of a set in the global order."""
    n = len(s)
    count = sketch[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]
    often = np.where(count > bar, count, 0)
    order = np.lexsort((s, often))
    return s[order[: base_length(n, percent) + extension(n)]]


def prefixes(docs: DataFrame, sketch: np.ndarray, seed: int, percent: int) -> DataFrame:
    """(tok, sig, n, often, pos): one row for each prefix shingle of each distinct set that a task meets."""
    mean = float(sketch.mean())
    shared = docs.sparkSession.sparkContext.broadcast((sketch, mean + 5 * mean**0.5 + 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, bar = shared.value
        met: set[int] = set()
        for batch in batches:
            tok, sig, n, often = [], [], [], []
            for s in shingle_sets(batch.column(0).to_pylist(), seed):
                if not len(s):
                    continue
                name = signature(s)[0]
                if name in met:  # a copy within this task adds nothing
                    continue
                if len(met) < 1 << 20:
                    met.add(name)
                tok.append(prefix(s, sketch, bar, percent))
                sig.append(name)
                n.append(len(s))
                often.append(int((sketch[(s >> U(64 - SKETCH_BITS)).astype(np.int64)] > bar).sum()))
            if tok:
                size = [len(p) for p in tok]
                spread = lambda x: pa.array(np.repeat(np.array(x, np.int64), size))
                pos = pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in size]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok).astype(np.int64)), spread(sig), spread(n), spread(often), pos], ["tok", "sig", "n", "often", "pos"])

    return docs.mapInArrow(run, "tok long, sig long, n long, often long, pos int")


def sets_of(docs: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """(sig, tokens) for the nodes, read from the texts again; the filter may let a few more through."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, met = shared.value, set()
        for batch in batches:
            sig, data = [], []
            for s in shingle_sets(batch.column(0).to_pylist(), seed):
                name = signature(s)[0] if len(s) else 0
                if len(s) and name not in met and may_hold(bits, np.array([name]))[0]:
                    if len(met) < 1 << 20:
                        met.add(name)
                    sig.append(name)
                    data.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(data, pa.binary())], ["sig", "tokens"])

    return docs.mapInArrow(run, "sig long, tokens binary").dropDuplicates(["sig"])


def verified(docs: DataFrame, pairs: DataFrame, seed: int, percent: int, name: str) -> DataFrame:
    """The pairs (x, y) whose whole sets are similar enough."""
    nodes = pairs.select(F.col("x").alias("sig")).unionByName(pairs.select(F.col("y").alias("sig")))
    sets = table(sets_of(docs, nodes, seed), name)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for k, (a, b) in enumerate(zip(pdf["a"], pdf["b"])):
                p, q = np.frombuffer(a, U), np.frombuffer(b, U)
                both = np.sort(np.concatenate([p, q]))
                same = int((both[1:] == both[:-1]).sum())
                keep[k] = 100 * same >= percent * (len(p) + len(q) - same)
            yield pdf.loc[keep, ["x", "y"]]

    first = pairs.select("x", "y").join(sets.select(F.col("sig").alias("x"), F.col("tokens").alias("a")), "x")
    both = first.join(sets.select(F.col("sig").alias("y"), F.col("tokens").alias("b")), "y")
    return table(both.select("x", "y", "a", "b").mapInPandas(judge, "x long, y long"), name + "-links")


def _overlap(percent: int) -> str:
    """Shingles that sets of sizes n and m have in common at least, if they link."""
    return f"({percent} * (n + m) + {99 + percent}) div {100 + percent}"


def _spare(percent: int) -> str:
    """How many shingles of a set of size n were given, less n: at most 0."""
    return f"least(n, n + 1 - ({percent} * n + 99) div 100 + n div {EXTENSION} + int(n > 1)) - n"


def _possible(percent: int) -> str:
    """The most matches k that can be asked of a pair (n, m; spare, spare2): both k-prefixes were given."""
    return f"{_overlap(percent)} + least(spare, spare2)"


def _sizes_fit(percent: int) -> str:
    return f"least(n, m) * 100 >= greatest(n, m) * {percent}"


def _named(docs: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, np.ndarray, int]:
    """Rows (key, n, sig), the sketch and the seed with which no two different sets share a name."""
    for seed in range(1, 9):
        told = describe(docs, seed)
        rows = told.where("n is not null").select("key", "n", "sig", "sig2")
        if not rows.groupBy("sig").agg((F.min("sig2") != F.max("sig2")).alias("x")).where("x").limit(1).count():
            sketch = accumulated(told.where("slice is not null").select("slice", "data"), 1 << SKETCH_BITS, np.uint32, np.add)
            return rows.drop("sig2"), sketch, seed
        discard(told)
    raise RuntimeError("different sets share a name under every seed")


def _candidates(apart: DataFrame, percent: int) -> DataFrame:
    """(x, y): all pairs of different components that may link, from lists (tok, sig, n, pos, root) without single-component ones."""
    size = F.count(F.lit(1)).over(Window.partitionBy("tok"))
    sized = apart.withColumn("costly", size > SHORT)
    heavy = sized.where("costly").groupBy("sig").agg(F.count(F.lit(1)).alias("h")).withColumnRenamed("sig", "_sig")
    sized = sized.join(heavy, F.col("sig") == F.col("_sig"), "left").withColumns({"h": F.coalesce("h", F.lit(0)), "spare": F.expr(_spare(percent)), "end": F.col("pos") - F.col("n")})
    weighed = table(sized.select("tok", "sig", "n", "pos", "root", "costly", "h", "spare", "end"), "jaccard-weighed")
    both, most = _overlap(percent), _possible(percent)
    # k exceeds the costly matches where it may, so that a cheap one must be among them; else it is 1 and costly lists are met.
    k = f"case when {most} > least(h, h2) then least(h, h2) + 1 + ({most} - least(h, h2) - 1) div {SHARE_OF_MATCHES} else 1 end"
    theirs = {"sig": "y", "n": "m", "pos": "at", "root": "root2", "h": "h2", "spare": "spare2", "end": "end2"}

    def met(lists: DataFrame, on: list[str], other: DataFrame, fits: str) -> DataFrame:
        pairs = lists.withColumnRenamed("sig", "x").join(other.withColumnsRenamed(theirs), on).where("x < y and root <> root2").where(_sizes_fit(percent))
        # Both places are in the k-prefixes.
        return pairs.where(f"{fits} and greatest(end, end2) + {both} < {k}").select("x", "y", "n", "m", "h", "h2", "spare", "spare2")

    cheap = weighed.where("not costly")
    # The places leave room for the overlap: shared shingles before them are before them in both sets.
    room = f"least(pos, at) - greatest(end, end2) >= {both}"
    # No partner that fits in size has an extension shorter than this; with no more costly shingles a cheap match is certain.
    sure = f"((n * {percent}) div 100) div {EXTENSION} + int(n > 1)"
    costly = weighed.where(f"costly and h > {sure} and pos < n + 1 - ({percent} * n + 99) div 100")
    costly = costly.withColumn("band", F.floor(F.log("n") / math.log(100 / percent)))
    near_bands = costly.withColumn("at_band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    # Lists of a band with the same two least members, as the shingles of one passage have, are met as one, at each
    # member's first place: that gives their pairs once, and some more, which do not pass the verification.
    list_of = Window.partitionBy("tok", "at_band")
    near_bands = near_bands.withColumn("m1", F.min("sig").over(list_of)).withColumn("m2", F.min(F.when(F.col("sig") != F.col("m1"), F.col("sig"))).over(list_of)).where("m2 is not null")
    near_bands = near_bands.groupBy("m1", "m2", "at_band", "band", "sig", "n", "root", "h", "spare").agg(F.min("pos").alias("pos"), F.min("end").alias("end"))
    mine, near_bands = near_bands.where("band = at_band").drop("band"), near_bands.drop("band")
    pairs = met(cheap, ["tok"], cheap, room).unionByName(met(mine, ["m1", "m2", "at_band"], near_bands, f"{most} <= least(h, h2)"))
    counted = pairs.groupBy("x", "y", "n", "m", "h", "h2", "spare", "spare2").agg(F.count(F.lit(1)).alias("c"))
    out = table(counted.where(f"c >= case when {most} > least(h, h2) then {k} - least(h, h2) else 1 end").select("x", "y"), "jaccard-open")
    discard(weighed)
    return out


def similar_rows(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, n, sig, root) for every row of ``docs`` (key, text); root names the component of linked sets, null without words."""
    docs = bounded_batches(docs)
    texts = docs.select("text")
    rows, sketch, seed = _named(docs, texts, percent)
    list_of = Window.partitionBy("tok")
    in_order = list_of.orderBy("n", "sig")
    # A list needs two different sets; copies that other tasks met stand next to each other and collapse.
    lists = (
        prefixes(texts, sketch, seed, percent)
        .withColumns({"lo": F.min("sig").over(list_of), "hi": F.max("sig").over(list_of)})
        .withColumn("hub", F.max(F.struct("often", "sig", "n")).over(list_of))
        .withColumn("prev", F.lag(F.struct("sig", "n")).over(in_order))
        .where("lo <> hi and (prev is null or prev.sig <> sig)")
        .select("tok", "sig", "n", "pos", "hub", "prev")
    )
    lists = table(lists, "jaccard-lists")
    likely = lambda to: lists.select(F.col("sig").alias("x"), "n", F.col(f"{to}.sig").alias("y"), F.col(f"{to}.n").alias("m"))
    few = likely("hub").unionByName(likely("prev")).where("x <> y").where(_sizes_fit(percent)).groupBy("x", "y", "n", "m").agg(F.count(F.lit(1)).alias("c"))
    few = few.where(f"c * 2 >= {_overlap(percent)} - (greatest(n, m) * {percent} + 99) div 100 + 1").withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("c"), "y"))).where("r <= 2")
    links = verified(texts, table(few.select("x", "y"), "jaccard-likely"), seed, percent, "jaccard-sets1")
    roots = components(links)

    spread = lists.select("tok", "sig", "n", "pos").join(roots, lists["sig"] == roots["node"], "left").select("tok", "sig", "n", "pos", F.coalesce("root", "sig").alias("root"))
    apart = spread.withColumns({"lo": F.min("root").over(list_of), "hi": F.max("root").over(list_of)}).where("lo <> hi").drop("lo", "hi")
    open_pairs = _candidates(apart, percent)
    discard(lists)
    first = rows.where("n > 0").select("sig").distinct().join(roots, F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("root", "sig").alias("root"))
    if open_pairs.limit(1).count():
        # Only what the new links join is worked on again: components, not their members.
        more = verified(texts, open_pairs, seed, percent, "jaccard-sets2")
        name_of = lambda c: first.select(F.col("sig").alias(c), F.col("root").alias(f"{c}r"))
        joined = components(more.join(name_of("x"), "x").join(name_of("y"), "y").select(F.col("xr").alias("x"), F.col("yr").alias("y")))
        over = joined.select(F.col("node").alias("at"), F.col("root").alias("there"))
        first = first.join(over, F.col("root") == F.col("at"), "left").select("sig", F.coalesce("there", "root").alias("root"))
    names = table(first.where("sig <> root").withColumnRenamed("sig", "_sig"), "jaccard-named")
    return rows.join(names, rows["sig"] == names["_sig"], "left").select("key", "n", F.when(F.col("n") > 0, F.coalesce("root", "sig")).alias("root"))


def similar_components(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    rows = similar_rows(docs.select(F.struct(F.col(id).alias("id")).alias("key"), F.col(text).alias("text")), percent).select("key.id", "n", "root")
    least = rows.where("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("component_id"))
    named = rows.join(least, rows["root"] == least["_root"], "left")
    return named.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component, and all rows without words.

    The row with the least id stays, null ids last, of equal ids the one with the least hash of its text. Rows are
    told apart by id and text, so two texts under one id, or under null, are two rows; of wholly repeated ones one stays.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.xxhash64(body).alias("h"), F.hash(body).alias("h2"), F.length(body).alias("size"))
    rows = similar_rows(docs.select(key.alias("key"), F.col(text).alias("text")), percent)
    best = rows.where("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("key").alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    # Only rows of components with others are marked; all others need no partner in the join.
    marks = rows.join(best, rows["root"] == best["_root"]).groupBy("key").agg(F.max(F.col("key") == F.col("best")).alias("stays"), F.count(F.lit(1)).alias("copies"))
    keyed = docs.select(F.struct("*").alias("doc"), key.alias("key"))
    met = keyed.join(marks.select(F.col("key").alias("_key"), "stays", "copies"), F.col("key").eqNullSafe(F.col("_key")), "left").where("stays is null or stays")
    single = met.where("stays is null or copies = 1")
    repeated = met.where("copies > 1").dropDuplicates(["key"])
    return single.unionByName(repeated).select("doc.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read(spark, sf_dir, "documents", "doc_id", "text"))
