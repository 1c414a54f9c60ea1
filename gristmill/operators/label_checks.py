"""Checks that train models: columns that give the label away, and labels a model disagrees with."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, HashingTF, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions import scalars as S

from .tables import ROW, Table, is_missing, numbered, present_number

BINS = 64
RANGES = 1024  # of the sorted values of a column with more than 4 * BINS of them
BLOCK = 4096


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def fold_of(seed: int = 0) -> Column:
    """A row's fold by hash: the same on every run, without a shuffle."""
    return F.pmod(F.xxhash64(F.lit(seed), ROW), F.lit(config.FOLDS)).cast("int")


def labelled(t: Table, label: str, fold_spellings: bool) -> tuple[DataFrame | None, str | None, dict[str, int]]:
    """Rows with a usable label ``y``; or why there are none. Small classes are left out and named."""
    if not label or label not in t.columns:
        return None, "no label column was chosen", {}
    y = S.normalise_latin(_c(label)) if fold_spellings else _c(label)
    rows = t.df.where(~is_missing(_c(label))).withColumns({"y": y, "fold": fold_of()})
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # classes, not rows
    small = {k: n for k, n in counts.items() if n < config.CLASS_MEMBERS}
    kept = {k: n for k, n in counts.items() if k not in small}
    if len(counts) < 2:
        return None, "the label has fewer than two classes", {}
    if len(kept) < 2 or sum(kept.values()) < config.LABEL_ROWS:
        return None, "too few rows to cross-validate", small
    return rows.where(F.col("y").isin(list(kept))), None, small


def tree_accuracy(counts: np.ndarray, depth: int = 3) -> float:
    """Mean accuracy over folds of depth-limited trees on one ordered feature. counts: (fold, bin, class)."""
    scores = []
    for fold in range(len(counts)):
        train, test = counts.sum(0) - counts[fold], counts[fold]
        right = 0.0

        def grow(lo: int, hi: int, left: int) -> None:
            nonlocal right
            here = train[lo:hi]
            total = here.sum(0)
            gini = lambda c: c.sum(-1) - (c**2).sum(-1) / np.maximum(c.sum(-1), 1)
            if left and hi - lo > 1 and total.sum() - total.max() > 0:
                up = np.cumsum(here, axis=0)[:-1]
                cost = gini(up) + gini(total - up)
                k = int(np.argmin(cost))
                if cost[k] < gini(total) - 1e-12:
                    grow(lo, lo + k + 1, left - 1)
                    grow(lo + k + 1, hi, left - 1)
                    return
            right += test[lo:hi, int(np.argmax(total))].sum() if total.sum() else 0.0

        grow(0, train.shape[0], depth)
        scores.append(right / max(test.sum(), 1))
    return float(np.mean(scores))


def _ranged(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(col, fold, bin, y, n): values in sorted order, cut by exact counts into ranges of one ``RANGES``-th of the rows.

    A range holds more only if one value does. Ranks come from the sizes of sorted partitions and rows before a value
    from sums of blocks of ranks, so no task sees all values.
    """
    counts = rows.select("fold", "y", *[_c(c) for c in columns]).unpivot(["fold", "y"], [_c(c) for c in columns], "col", "raw").groupBy("col", "raw", "fold", "y").agg(F.count(F.lit(1)).alias("n"))
    values = counts.groupBy("col", "raw").agg(F.sum("n").alias("n")).orderBy("col", "raw")
    ranked = numbered(values).withColumnRenamed(ROW, "rank")
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK))
    blocks = ranked.groupBy("col", "block").agg(F.sum("n").alias("size"))
    by_col = Window.partitionBy("col")
    blocks = blocks.select("col", "block", (F.sum("size").over(by_col.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("before"), F.sum("size").over(by_col).alias("total"))
    before = F.col("before") + F.sum("n").over(Window.partitionBy("col", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    at = ranked.join(F.broadcast(blocks), ["col", "block"]).select("col", "raw", F.floor(before * RANGES / F.col("total")).cast("int").alias("bin"))
    return counts.join(at, ["col", "raw"]).groupBy("col", "fold", "bin", "y").agg(F.sum("n").alias("n"))


def leak_counts(t: Table, label: str, usable: list[str], number: dict[str, Column], rows: DataFrame | None = None) -> DataFrame:
    """(col, fold, bin, y, n): rows of each class in each range of a column's values. ``number`` reads the columns that are cut at quantiles."""
    rows = labelled(t, label, False)[0] if rows is None else rows
    ordered = list(number)
    cuts = rows.agg(*[F.percentile_approx(number[c], [k / BINS for k in range(1, BINS)], 10_000).alias(f"q{k}") for k, c in enumerate(ordered)]).first() if ordered else {}
    few = {r["col"]: sorted(r["raws"]) for r in t.values.where(F.col("col").isin([c for c in usable if c not in ordered and t.kinds[c]["n_raw"] <= 4 * BINS] or [""])).groupBy("col").agg(F.collect_list("raw").alias("raws")).collect()}
    bins, many = [], []
    for c in usable:
        if c in number:
            bounds = sorted(set(cuts[f"q{ordered.index(c)}"] or []))
            middle = bounds[len(bounds) // 2] if bounds else 0.0
            x = F.coalesce(number[c], F.lit(middle))
            at = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>"), lambda b: b < x))  # noqa: B023
        elif c in few:
            at = F.array_position(F.array(*[F.lit(v) for v in few[c]]), _c(c)).cast("int")
        else:
            many.append(c)
            continue
        bins.append(F.struct(F.lit(c).alias("col"), at.cast("int").alias("bin")))
    told = [rows.select("fold", "y", F.explode(F.array(*bins)).alias("x")).groupBy("x.col", "fold", "x.bin", "y").agg(F.count(F.lit(1)).alias("n"))] if bins else []
    told += [_ranged(rows, many)] if many else []
    return reduce(DataFrame.unionByName, told) if told else t.df.sparkSession.createDataFrame([], "col string, fold int, bin int, y string, n long")


def leakage(t: Table, label: str, split: str | None = None) -> tuple[DataFrame, str | None]:
    """(col, accuracy, majority) of columns that alone predict the label.

    Rows are reduced to counts by (column, fold, bin, class) in one aggregation; trees grow on the counts.
    """
    spark = t.df.sparkSession
    schema = "col string, accuracy double, majority double"
    rows, why, _ = labelled(t, label, False)
    if rows is None:
        return spark.createDataFrame([], schema), why
    usable = [c for c in t.columns if c not in (label, split) and t.kinds[c]["inferred_type"] not in ("constant", "text")]
    ordered = [c for c in usable if t.kinds[c]["inferred_type"] in ("numeric", "datetime")]
    number = {c: present_number(_c(c)) if t.kinds[c]["inferred_type"] == "numeric" else F.unix_micros(S.to_timestamp(_c(c)).cast("timestamp")).cast("double") for c in ordered}
    counts = leak_counts(t, label, usable, number, rows).toPandas()  # rows by column, fold, range and class: bounded by ranges and classes
    classes = sorted(r["y"] for r in rows.select("y").distinct().collect())
    sizes = rows.groupBy("y").count().agg(F.max("count") / F.sum("count")).first()[0]
    found = []
    for c in usable:
        part = counts[counts["col"] == c]
        table = np.zeros((config.FOLDS, int(part["bin"].max()) + 1, len(classes)))
        table[part["fold"], part["bin"], [classes.index(y) for y in part["y"]]] = part["n"]
        found.append((c, tree_accuracy(table), sizes))
    for c in [c for c in t.of_kind("text") if c not in (label, split)]:
        found.append((c, _text_accuracy(rows, c), sizes))
    found = [(c, a, m) for c, a, m in found if a > config.LEAK_ACCURACY and a > m + config.LEAK_LIFT]
    return spark.createDataFrame(found, schema), None


def _text_accuracy(rows: DataFrame, column: str) -> float:
    stages = [StringIndexer(inputCol="y", outputCol="target"), RegexTokenizer(inputCol="x", outputCol="words", pattern=r"\W+"), HashingTF(inputCol="words", outputCol="features", numFeatures=512, binary=True)]
    data = rows.select("fold", "y", _c(column).alias("x"))
    data = Pipeline(stages=stages).fit(data).transform(data).select("fold", "target", "features")
    scores = []
    for k in range(config.FOLDS):
        model = DecisionTreeClassifier(labelCol="target", featuresCol="features", maxDepth=3, seed=0).fit(data.where(F.col("fold") != k))
        scores.append(model.transform(data.where(F.col("fold") == k)).agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0] or 0.0)
    return float(np.mean(scores))


def encoded(t: Table, rows: DataFrame, label: str, split: str | None = None) -> DataFrame | None:
    """``rows`` with a vector ``features``: numbers with medians for gaps, hashed categories, hashed terms of texts."""
    skip = {label, split}
    numbers = [c for c in t.of_kind("numeric", "datetime") if c not in skip]
    categories = [c for c in t.of_kind("categorical", "boolean") if c not in skip]
    texts = [c for c in t.of_kind("text") if c not in skip]
    if not numbers + categories + texts:
        return None
    value = {c: present_number(_c(c)) if t.kinds[c]["inferred_type"] == "numeric" else F.unix_micros(S.to_timestamp(_c(c)).cast("timestamp")).cast("double") for c in numbers}
    middles = rows.agg(*[F.percentile_approx(value[c], 0.5).alias(f"m{k}") for k, c in enumerate(numbers)]).first() if numbers else {}
    out = rows.select(
        ROW, "fold", "y", _c(label).alias("given"),
        *[F.coalesce(value[c], F.lit(float(middles[f"m{k}"] or 0.0))).alias(f"num{k}") for k, c in enumerate(numbers)],
        *[S.normalise_latin(_c(c)).alias(f"cat{k}") for k, c in enumerate(categories)], *[_c(c).alias(f"text{k}") for k, c in enumerate(texts)],
    )
    stages, parts = [], [f"num{k}" for k in range(len(numbers))]
    if categories:
        stages.append(FeatureHasher(inputCols=[f"cat{k}" for k in range(len(categories))], outputCol="cats", numFeatures=256))
        parts.append("cats")
    for k in range(len(texts)):
        stages += [RegexTokenizer(inputCol=f"text{k}", outputCol=f"words{k}", pattern=r"\W+"), HashingTF(inputCol=f"words{k}", outputCol=f"terms{k}", numFeatures=1024)]
        parts.append(f"terms{k}")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages).fit(out).transform(out).select(ROW, "fold", "y", "given", "features")


def out_of_fold(data: DataFrame, trees: int = 30, depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """(_row_id, y, given, p_given, p_top, predicted): each row judged by a forest that never saw it; and what is kept for that, to be dropped once it is read."""
    indexer = StringIndexer(inputCol="y", outputCol="target", stringOrderType="alphabetAsc").fit(data)
    names = F.array(*[F.lit(x) for x in indexer.labels])
    data = indexer.transform(data).cache()
    told = None
    for k in range(config.FOLDS):
        model = RandomForestClassifier(labelCol="target", featuresCol="features", numTrees=trees, maxDepth=depth, seed=0, featureSubsetStrategy="onethird").fit(data.where(F.col("fold") != k))
        p = vector_to_array("probability")
        judged = model.transform(data.where(F.col("fold") == k)).select(ROW, "y", "given", F.element_at(p, (F.col("target") + 1).cast("int")).alias("p_given"), F.array_max(p).alias("p_top"), F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"))
        told = judged if told is None else told.unionByName(judged)
    return told, data


def mislabels(t: Table, label: str, split: str | None = None) -> tuple[DataFrame, dict]:
    """(_row_id, given, predicted, noise) and a summary with the cross-validated accuracy, or why it was skipped."""
    empty = t.df.sparkSession.createDataFrame([], f"{ROW} long, given string, predicted string, noise double")
    rows, why, small = labelled(t, label, True)
    if rows is None:
        return empty, {"skipped": why, "dropped": small}
    data = encoded(t, rows, label, split)
    if data is None:
        return empty, {"skipped": "no usable feature columns", "dropped": small}
    judged, kept = out_of_fold(data)
    judged = judged.cache()
    accuracy = judged.agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]
    kept.unpersist()
    wrong = judged.where((F.col("p_given") < config.WRONG_GIVEN) & (F.col("p_top") > config.WRONG_TOP))
    return wrong.select(ROW, "given", "predicted", (F.col("p_top") - F.col("p_given")).alias("noise")), {"cv_accuracy": accuracy, "dropped": small, "weak": accuracy < config.WEAK_MODEL}
