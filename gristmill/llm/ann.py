"""Nearest neighbours by inner product over an additively quantised index.

A vector is coded as a sum of one codeword from each of ``BOOKS`` codebooks of full dimension. The books are
k-means over residuals of a bounded training sample; codes are found by beam search, which keeps the
``BEAM`` best partial sums from book to book. The index stores, for each vector, its codes, the norm of
its reconstruction, and the norm of what the codes leave over.

A query's inner products with all codewords make a lookup table; a vector's approximate score is the sum of
its codes' entries, and its true score is off by at most the query's length times the norm of what the codes leave
over. Queries meet the index in groups of blocks, each step of bounded size. The ``SHORTLIST`` vectors of a block that
look best are scored exactly first; then every other vector whose approximate score and bound together reach
the worst of the nearest found so far. So none of the truly nearest is missed, whatever the rows: codes that fit badly cost more
exact scores, nothing else. In a group vectors come by falling norm: where the query's length times the
stored norms of a block is below that worst score, this block and all that follow are left out, as
none of them can score more. Exact scores are sums in double precision over the original vectors, in their order.

Vectors that are null, zero, hold null or non-finite components, or differ from the most common dimension
take no part, nor do null ids; of rows with one id the least vector stands. A query gets all candidates if
there are fewer than asked for. Ties go to the smaller id. Empty tables give an empty result; extra columns
are not read, whatever their names. Vectors of any length are whole in memory, ``VALUES`` components or so at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, table

BOOKS = 24
WORDS = 256
BEAM = 8
SAMPLE = 12_000
SHORTLIST = 300
NEAREST = 20
INDEX_BLOCK = 8192
QUERY_BLOCK = 8192
VALUES = 1 << 22  # components of the vectors that one step scores
TILE = 16


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vector as array<double>, dim) of the vectors that take part, one row an id."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(id).isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0)).select(F.col(id).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows.withColumn("dim", F.size("v"))


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Codebooks (books, words, dim) by k-means over the residuals that the books before leave."""
    rng, rest = np.random.default_rng(seed), x.astype(np.float32).copy()
    out = np.zeros((books, words, x.shape[1]), np.float32)
    for m in range(books):
        k = min(words, len(rest))
        centre = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            near = _nearest(rest, centre)
            n, order = np.bincount(near, minlength=k), np.argsort(near, kind="stable")
            starts = np.r_[0, np.cumsum(n)[:-1]][n > 0]
            centre[n > 0] = np.add.reduceat(rest[order], starts) / n[n > 0, None]
            if (n == 0).any():  # words that nothing is near start again at what is coded worst
                far = np.argsort(-((rest - centre[near]) ** 2).sum(1), kind="stable")[: (n == 0).sum()]
                centre[np.flatnonzero(n == 0)[: len(far)]] = rest[far]
        out[m, :k] = centre
        rest -= centre[_nearest(rest, centre)]
    return out


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre**2).sum(1) - 2 * x @ centre.T, axis=1)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, norms of the reconstructions and norms of the residuals, by beam search."""
    m, words, dim = books.shape
    n = len(x)
    rest = x.astype(np.float32)[:, None, :]  # residuals of the partial sums kept
    codes = np.zeros((n, 1, 0), np.uint8)
    for b in range(m):
        width = rest.shape[1]
        # |rest - word|^2 for each partial sum and word; the best ``beam`` go on.
        cost = (rest**2).sum(2)[:, :, None] - 2 * rest @ books[b].T + (books[b] ** 2).sum(1)
        cost = cost.reshape(n, width * words)
        best = least(cost, min(beam if b < m - 1 else 1, cost.shape[1]))
        at, word = best // words, best % words
        rows = np.arange(n)[:, None]
        rest = rest[rows, at] - books[b][word]
        codes = np.concatenate([codes[rows, at], word[:, :, None].astype(np.uint8)], axis=2)
    codes = codes[:, 0]
    # Bounds rest on these norms, so they are those of the stored codes, in double precision and rounded up.
    made = np.zeros((n, dim))
    for b in range(m):
        made += books[b][codes[:, b]]
    up = lambda v: np.linalg.norm(v, axis=1) * (1 + 1e-12)
    return codes, up(made), up(x - made)


def least(cost: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least entries of each row. They lie in the k tiles with the least minima."""
    n, width = cost.shape
    rows = np.arange(n)[:, None]
    if k == 1:
        return np.argmin(cost, axis=1)[:, None]
    if width % TILE or width // TILE <= k:
        return np.argpartition(cost, k - 1, axis=1)[:, :k] if k < width else np.tile(np.arange(k), (n, 1))
    tiles = cost.reshape(n, -1, TILE)
    low = np.argpartition(tiles.min(axis=2), k - 1, axis=1)[:, :k]
    near = np.argpartition(tiles[rows, low].reshape(n, -1), k - 1, axis=1)[:, :k]
    return low[rows, near // TILE] * TILE + near % TILE


def shortest(v: np.ndarray) -> bytes:
    """A vector's bytes, as single precision where nothing is lost."""
    with np.errstate(over="ignore"):
        single = v.astype("<f4")
    return single.tobytes() if (single == v).all() else v.astype("<f8").tobytes()


def restored(parts: list[bytes], dim: int) -> np.ndarray:
    """The vectors that ``shortest`` packed."""
    out = np.empty((len(parts), dim))
    for k, data in enumerate(parts):
        out[k] = np.frombuffer(data, "<f4" if len(data) == 4 * dim else "<f8")
    return out


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so that equal vectors score the same anywhere."""
    return np.cumsum(x * q, axis=1)[:, -1] + 0.0


def index(vectors: DataFrame, books: np.ndarray, beam: int = BEAM) -> DataFrame:
    """(id, codes, norm, left, data) for every vector; data is the vector itself, for exact scores."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i : i + 1024]
                x = np.stack(part["v"].to_numpy())
                codes, norm, left = encode(x, shared.value, beam)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "codes": [c.tobytes() for c in codes], "norm": norm, "left": left, "data": [shortest(v) for v in x]})

    return vectors.select("id", "v").mapInPandas(code, "id long, codes binary, norm double, left double, data binary")


class Nearest:
    """The ``nearest`` vectors of one query among those scored so far."""

    def __init__(self, id: int, q: np.ndarray, nearest: int):
        self.id, self.q, self.nearest = id, q, nearest
        self.ids, self.scores, self.worst = np.zeros(0, np.int64), np.zeros(0), -np.inf

    def add(self, x: np.ndarray, ids: np.ndarray, longest: float) -> None:
        """Score vectors of at most this length; a quick product leaves out those that clearly fall behind."""
        rough = x @ self.q
        bar = self.worst
        if len(rough) > self.nearest:
            bar = max(bar, np.partition(rough, len(rough) - self.nearest)[len(rough) - self.nearest])
        close = np.flatnonzero(~(rough < bar - 1e-14 * len(self.q) * longest))
        ids = np.concatenate([self.ids, ids[close]])
        scores = np.concatenate([self.scores, exact_scores(x[close], self.q)])
        best = np.lexsort((ids, -scores))[: self.nearest]
        self.ids, self.scores = ids[best], scores[best]
        if len(best) == self.nearest:
            self.worst = self.scores[-1]


def scored(queries: list[Nearest], ids: np.ndarray, codes: np.ndarray, norm: np.ndarray, left: np.ndarray, x: np.ndarray, books: np.ndarray, shortlist: int = SHORTLIST) -> int:
    """Let the queries meet all vectors (codes by book); how many exact scores that took."""
    most = norm + left  # times a query's length: no score is above
    order = np.lexsort((ids, -most))
    ids, most, left, codes, x = ids[order], most[order], left[order], np.ascontiguousarray(codes[:, order]), x[order]
    m = len(books)
    # What single precision may take from a sum of m entries of a unit query's table, at most.
    rounding = float(np.linalg.norm(books.astype(float), axis=2).max(axis=1).sum()) * 1.2e-7 * (m + 2) + 1e-37
    cost = 0
    for i in range(0, len(queries), 64):
        part = queries[i : i + 64]
        q = np.stack([k.q for k in part])
        length = np.linalg.norm(q, axis=1)
        lookup = np.einsum("qd,mwd->mqw", q / length[:, None], books.astype(float), optimize=True).astype(np.float32)
        open_ = np.arange(len(part))
        for j in range(0, len(ids), INDEX_BLOCK):
            # A query with as many as asked for, all scoring above what may follow, is done.
            open_ = np.array([k for k in open_ if not most[j] * length[k] * (1 + 1e-9) < part[k].worst], int)
            if not len(open_):
                break
            block = slice(j, j + INDEX_BLOCK)
            total = np.zeros((len(open_), len(ids[block])), np.float32)
            for b in range(m):
                total += np.take(lookup[b, open_], codes[b, block], axis=1)
            for row, k in zip(total, open_):
                one = part[k]
                longest = length[k] * most[j]
                upper = (row + (left[block] + rounding)) * (length[k] * (1 + 1e-9))
                # Comparisons are such that what is not a number stays open.
                rest = ~(upper < one.worst - 1e-9 * abs(one.worst)) & (ids[block] != one.id)
                at = np.flatnonzero(rest)
                if len(at) > shortlist:
                    first = at[np.argpartition(-row[at], shortlist)[:shortlist]]
                    one.add(x[block][first], ids[block][first], longest)
                    rest[first] = False
                    at = np.flatnonzero(rest & ~(upper < one.worst - 1e-9 * abs(one.worst)))
                    cost += len(first)
                if len(at):
                    one.add(x[block][at], ids[block][at], longest)
                    cost += len(at)
    return cost


def search(vectors: DataFrame, queries: DataFrame, books: np.ndarray, nearest: int = NEAREST, shortlist: int = SHORTLIST, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score). ``vectors`` and ``queries`` have (id, v); a query is no candidate of its own."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(books)
    coded = table(index(vectors, books, beam), "ann-index")
    n, dim = coded.count(), books.shape[2]
    # Groups of bounded size, and enough of them for all cores to take part.
    n_groups = max(1, -(-n * dim // VALUES), min(spark.sparkContext.defaultParallelism, -(-n // INDEX_BLOCK)))
    n_queries = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = min(4096, 2 * n_groups * n_queries)
    asked = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_queries)).alias("q"))
    # A group of vectors is sent once to each large block of queries.
    placed = coded.withColumn("g", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(n_groups))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))))
    wanted = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
        found = [Nearest(id, np.asarray(v, float), nearest) for id, v in zip(left["id"].to_numpy(np.int64), left["v"])]
        codes = np.frombuffer(b"".join(right["codes"]), np.uint8).reshape(len(right), -1).T
        scored(found, right["id"].to_numpy(np.int64), codes, right["norm"].to_numpy(float), right["left"].to_numpy(float), restored(right["data"].to_list(), dim), shared.value, shortlist)
        return pd.DataFrame([(k.id, k.ids, k.scores) for k in found], columns=["query_id", "ids", "scores"])

    met = wanted.repartition(parts, "q", "g").groupBy("q", "g").cogroup(placed.repartition(parts, "q", "g").groupBy("q", "g"))
    found = met.applyInPandas(score, "query_id long, ids array<long>, scores array<double>")
    each = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def fit(vectors: DataFrame, sample: int = SAMPLE, books: int = BOOKS, words: int = WORDS) -> np.ndarray:
    """Codebooks from at most ``sample`` vectors: those with the least hash of their id."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v")
    if not len(rows):
        return np.zeros((books, words, 1), np.float32)
    x = np.array(rows.combine_chunks().flatten() if hasattr(rows, "combine_chunks") else rows, float).reshape(len(rows), -1)
    return train(x, books, words)


def nearest_neighbours(df: DataFrame, id: str = "vec_id", vector: str = "embedding", queries=None, nearest: int = NEAREST, shortlist: int = SHORTLIST) -> DataFrame:
    """The nearest of all vectors for each vector that fits the condition ``queries`` on ``id``."""
    vectors = table(usable(df, id, vector), "ann-vectors")
    common = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    vectors = vectors.where(F.col("dim") == (common[0]["dim"] if common else 0)).select("id", "v")
    wanted = vectors.where(queries(F.col("id")) if queries is not None else F.lit(True))
    return search(vectors, wanted, fit(vectors), nearest, shortlist)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest_neighbours(vectors, queries=lambda id: F.pmod(id, F.lit(20)) == 0)
