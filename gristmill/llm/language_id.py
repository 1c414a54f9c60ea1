"""Language identification by hierarchical discrimination.

A linear classifier over hashed byte 3- and 4-grams of the letters first picks the language family;
within the family, one-versus-one linear support vector machines vote. All machines are trained here, on
the driver, from at most ``per_language`` labelled documents of each language and ``most`` in all: those
with the least hash of their id. Only their text and label are used. The number of labels bounds the model.

Prediction reads every text whole, in pieces of bounded size. A null text, or one without any letter, is
``und`` with score 0. With no labelled document at all everything is ``und``. Ties go to the language that
sorts first. Repeated rows are judged alike; a null doc_id is never held out; extra columns are kept by
``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, read

BITS = 14
PER_LANGUAGE = 400
MOST = 4000
PIECE = 1 << 20

# Families of languages by ISO 639-1 code. A label that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz tt ky",
    "semitic": "ar he mt am",
    "iranian": "fa ps ku tg",
    "indic": "hi bn ur mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "malay": "id ms jv su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def _hashes(text: str) -> Iterator[np.ndarray]:
    """Hashed byte 3-grams and 4-grams of a text's lower-cased letters, runs of anything else as one space."""
    for i in range(0, len(text), PIECE):
        b = np.frombuffer((" " + NOT_LETTERS.sub(" ", text[i : i + PIECE].lower()).strip() + "  ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        if len(b) < 4:
            continue
        three = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
        four = (three[:-1] ^ (three[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + b[3:] * np.uint32(0x165667B1)
        for h in (three, four):
            yield ((h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)) >> np.uint32(32 - BITS)


def features(text: str | None) -> np.ndarray | None:
    """Shares of the hashed n-grams; None for a text without letters."""
    if not text or not LETTER.search(text):
        return None
    counts = np.zeros(1 << BITS)
    for h in _hashes(text):
        counts += np.bincount(h, minlength=1 << BITS)
    total = counts.sum()
    return (counts / total).astype(np.float32) if total else None


def svm(gram: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Dual coefficients (signed) of a linear SVM over a Gram matrix, by coordinate descent; classes weigh the same."""
    n, order = len(y), np.random.default_rng(7)
    cost = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y < 0).sum())))
    alpha, f, diagonal = np.zeros(n), np.zeros(n), np.maximum(np.diag(gram), 1e-12)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(n):
            new = min(max(alpha[i] - (y[i] * f[i] - 1.0) / diagonal[i], 0.0), cost[i])
            if abs(step := new - alpha[i]) > 1e-9:
                f += step * y[i] * gram[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return alpha * y


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]
    family_columns: list[int]  # one machine a family, against the others
    pairs: list[list[tuple[int, int, int]]]  # of each family: (column, first, second)
    weights: np.ndarray  # buckets x machines
    bias: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not LETTER.search(text):
            return "und", 0.0
        total, n = np.zeros(self.weights.shape[1]), 0
        for h in _hashes(text):
            total += self.weights[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        if not n:
            return "und", 0.0
        margin = total / n + self.bias
        sure = lambda m: 1.0 / (1.0 + np.exp(-2.0 * np.clip(m, -30, 30)))
        family, score = 0, 1.0
        if len(self.families) > 1:
            found = margin[self.family_columns]
            family = int(np.argmax(found))
            score = sure(found[family])
        names = self.members[family]
        votes, strength, least = np.zeros(len(names)), np.zeros(len(names)), np.full(len(names), np.inf)
        for column, a, b in self.pairs[family]:
            m = margin[column]
            votes[a if m >= 0 else b] += 1
            strength[[a, b]] += m, -m
            least[[a, b]] = min(least[a], m), min(least[b], -m)
        best = max(range(len(names)), key=lambda k: (votes[k], strength[k], -k))
        if len(names) > 1:
            score *= sure(least[best])
        return names[best], float(score)


def train(x: np.ndarray, labels: list[str]) -> Model:
    names = sorted(set(labels))
    families = sorted({FAMILY_OF.get(n, n) for n in names})
    members = [[n for n in names if FAMILY_OF.get(n, n) == f] for f in families]
    label = np.array(labels)
    of = np.array([FAMILY_OF.get(n, n) for n in labels])
    scale = float(1.0 / np.sqrt(np.einsum("ij,ij->i", x, x)).mean()) if len(x) else 1.0
    gram = (x @ x.T).astype(np.float64) * scale**2 + 1.0
    weights, bias = [], []

    def fit(rows: np.ndarray, y: np.ndarray) -> int:
        a = svm(gram if len(rows) == len(x) else gram[np.ix_(rows, rows)], y)
        every = np.zeros(len(x), np.float32)  # no copy of the samples is made
        every[rows] = a
        weights.append((every @ x) * scale**2)
        bias.append(a.sum())
        return len(weights) - 1

    everyone = np.arange(len(labels))
    family_columns = [fit(everyone, np.where(of == f, 1.0, -1.0)) for f in families] if len(families) > 1 else [0] * len(families)
    pairs = []
    for group in members:
        found = []
        for (i, a), (j, b) in combinations(enumerate(group), 2):
            rows = np.flatnonzero((label == a) | (label == b))
            found.append((fit(rows, np.where(label[rows] == a, 1.0, -1.0)), i, j))
        pairs.append(found)
    w = np.stack(weights, axis=1) if weights else np.zeros((1 << BITS, 1), np.float32)
    return Model(families, members, family_columns, pairs, np.ascontiguousarray(w, np.float32), np.array(bias or [0.0]))


def held_out(id) -> Column:
    """The documents that training never sees: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, most: int = MOST) -> Model:
    """Train on a bounded sample: of each language the ``per_language`` documents with the least hash of their id."""
    usable = docs.where(~held_out(id) & F.col(lang).isNotNull() & F.col(id).isNotNull())
    place = F.row_number().over(Window.partitionBy(lang).orderBy(F.xxhash64(id), id))
    # Each task passes on no more than per_language ids of a language.
    chosen = usable.select(F.col(id).alias("_id"), F.col(lang).alias("_lang"), F.xxhash64(id).alias("_h"), place.alias("_n")).where(F.col("_n") <= per_language)
    chosen = F.broadcast(chosen.orderBy("_n", "_h", "_lang").limit(most).select("_id").distinct())
    sample = usable.join(chosen, usable[id] == chosen["_id"], "left_semi").select(F.col(lang).alias("lang"), F.xxhash64(id).alias("h"), F.col(text).alias("text"))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, h, x in zip(pdf["lang"], pdf["h"], pdf["text"]):
                if (f := features(x)) is not None:
                    at = np.flatnonzero(f)
                    out.append((name, h, at.astype("<u4").tobytes(), f[at].astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["lang", "h", "at", "share"])

    rows = bounded_batches(sample).mapInPandas(sparse, "lang string, h long, at binary, share binary").collect()  # at most ``most`` rows of bounded size
    rows = sorted(rows, key=lambda r: (r["h"], r["lang"], r["at"]))[:most]
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], "<u4")] = np.frombuffer(r["share"], "<f4")
    labels = [r["lang"] for r in rows]
    del rows
    return train(x, labels)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. Only the text is read by the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    told = bounded_batches(docs).select(F.struct("*").alias("doc"), predict(F.col(text)).alias("said"))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return told.select(*[F.col(f"doc.`{c}`").alias(c) for c in kept], F.col("said.lang").alias("lang_pred"), F.col("said.score").alias("score"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    told = identify(docs.select("doc_id", "text"), fit(docs))
    return told.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
