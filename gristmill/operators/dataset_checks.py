"""Checks of whole rows: copies, near copies, overlap of splits, class sizes, totals rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions import scalars as S

from .quantiles import quantiles
from .tables import ROW, Table, is_missing, present_number
from .text_pairs import hashes, similar


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def row_key(columns: list[str]) -> Column:
    """SHA-256 of the cells, each with its length before it: whole rows need not travel to be compared."""
    return F.sha2(F.concat_ws("\u0001", *[F.concat(F.length(_c(c)).cast("string"), F.lit(":"), _c(c)) for c in columns]), 256)


def duplicate_groups(t: Table, columns: list[str] | None = None) -> DataFrame:
    """Groups of equal rows by their key, with their size and first row. Counting partially first, a hot group is one row a task."""
    keyed = t.df.select(ROW, row_key(columns or t.columns).alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first")).where("n > 1")


def duplicate_rows(t: Table, columns: list[str] | None = None) -> DataFrame:
    """Row ids of all members of such groups."""
    keyed = t.df.select(ROW, row_key(columns or t.columns).alias("key"))
    return keyed.join(duplicate_groups(t, columns).select("key"), "key", "left_semi").select(ROW)


def duplicate_summary(t: Table) -> DataFrame:
    """(n_groups, n_rows, n_redundant, auto) in one row."""
    told = duplicate_groups(t).agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    redundant = F.col("n_rows") - F.col("n_groups")
    has_id = bool(t.of_kind("id_like"))
    return told.select("n_groups", "n_rows", redundant.alias("n_redundant"), (F.lit(has_id) | (redundant / t.n_rows <= config.DEDUPE_AUTO)).alias("auto"))


def _signatures(t: Table, columns: list[str], left_out: list[str]) -> DataFrame:
    """(row, k, sig, sig2): each row once for each column k of ``left_out``; the signature covers the others.

    A row's hash is the XOR of its cells' hashes, salted with the column, so leaving one out is one more XOR. Cells are
    brought to their normal form once; only hashes travel.
    """
    cells = t.df.select(F.col(ROW).alias("row"), F.array(*[S.normalise_latin(_c(c)) for c in columns]).alias("norms"))
    salted = lambda seed: F.transform("norms", lambda c, k: F.xxhash64(F.lit(seed), k, c)).alias(f"h{seed}")
    hashed = cells.select("row", salted(1), salted(2))
    whole = hashed.select("row", "h2", "h1", *[F.aggregate(f"h{seed}", F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)).alias(f"all{seed}") for seed in (1, 2)], F.explode(F.array(*[F.lit(columns.index(c)) for c in left_out])).alias("k"))
    return whole.select("row", "k", *[F.col(f"all{seed}").bitwiseXOR(F.expr(f"h{seed}[k]")).alias(name) for seed, name in ((1, "sig"), (2, "sig2"))])


def scales(t: Table) -> DataFrame:
    """(left_out, scale): interquartile range of numeric columns, or the standard deviation, or 1."""
    numbers = t.values.where("not missing and num is not null").join(F.broadcast(t.types.where("inferred_type = 'numeric'").select("col")), "col")
    spread = quantiles(numbers, [0.25, 0.75], {c: k["n_raw"] for c, k in t.kinds.items()}).select("col", "q")
    sums = numbers.groupBy("col").agg(F.sum("n").alias("k"), F.sum(F.col("num") * F.col("n")).alias("s"), F.sum(F.col("num") * F.col("num") * F.col("n")).alias("ss"))
    told = spread.join(sums, "col")
    std = F.sqrt(F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("k")) / F.greatest(F.col("k") - 1, F.lit(1)), F.lit(0.0)))
    iqr = F.col("q")[1] - F.col("q")[0]
    return told.select(F.col("col").alias("left_out"), F.when(iqr > 0, iqr).when(std > 0, std).otherwise(1.0).alias("scale"))


def near_pairs(t: Table, split: str | None = None, differing: list[str] | None = None) -> DataFrame:
    """(a, b, differs): rows that agree on every compared column but one, where the values are close.

    ``differing``: the columns that may be that one, by default all. Numbers that name things (a customer's number) are
    close by chance, the more rows the more often; who knows them leaves them out here, and they still have to agree.

    Rows meet through signatures of all columns but one. Groups of 2 to 50 rows are compared, as larger ones
    are a pattern of the data and no near copies; their sizes are counted before rows are paired.
    """
    columns = [c for c in t.columns if c != split]
    spark = t.df.sparkSession
    if len(columns) < 2 or (differing is not None and not set(differing) & set(columns)):
        return spark.createDataFrame([], "a long, b long, differs string")
    signed = _signatures(t, columns, [c for c in columns if differing is None or c in differing])
    key = ["k", "sig", "sig2"]
    # Groups are counted on hashes alone; only rows of the few that are compared are met again, and only their cells read.
    groups = signed.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size").between(2, config.NEAR_GROUP)).drop("size")
    members = signed.join(groups, key)
    met = members.withColumnRenamed("row", "a").join(members.withColumnRenamed("row", "b"), key).where("a < b").select("k", "a", "b")
    cells = t.df.select(F.col(ROW).alias("row"), F.array(*[_c(c) for c in columns]).alias("cells"))
    side = lambda df, c, raw: df.join(cells.withColumnRenamed("row", c), c).withColumn(raw, F.expr("cells[k]")).drop("cells")
    pairs = side(side(met, "a", "raw"), "b", "raw_b")
    pairs = pairs.withColumns({"left_out": F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("k") + 1), "norm": S.normalise_latin(F.col("raw")), "norm_b": S.normalise_latin(F.col("raw_b"))})
    kinds = t.types.select(F.col("col").alias("left_out"), "inferred_type")
    pairs = pairs.join(F.broadcast(kinds), "left_out").join(F.broadcast(scales(t)), "left_out", "left")
    gap = F.abs(S.to_number(F.col("raw")) - S.to_number(F.col("raw_b")))
    close = F.when(F.col("inferred_type") == "numeric", F.coalesce(gap <= config.NEAR_GAP * F.coalesce("scale", F.lit(1.0)), F.lit(False))).otherwise(F.col("norm") == F.col("norm_b"))
    plain = pairs.where("inferred_type <> 'text'").where(close).select("a", "b", "left_out")
    texts = t.of_kind("text")
    found = plain
    for c in texts:
        if c != split and (differing is None or c in differing):
            found = found.unionByName(similar_texts(t, c, pairs.where(F.col("left_out") == c).select("a", "b")).select("a", "b", F.lit(c).alias("left_out")))
    return found.groupBy("a", "b").agg(F.min("left_out").alias("differs"))


def words(v: Column) -> Column:
    """Lower-cased words of two letters or more."""
    return F.regexp_extract_all(F.lower(v), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def terms(v: Column) -> Column:
    """Words, and pairs of neighbours."""
    w = words(v)
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.concat(w, F.filter(pairs, lambda p: p.isNotNull()))


def similar_texts(t: Table, column: str, pairs: DataFrame) -> DataFrame:
    """The pairs whose TF-IDF vectors have a cosine of 0.70 or more. Document frequencies come from the whole column."""
    texts = t.df.select(F.col(ROW).alias("row"), terms(_c(column)).alias("terms"))
    n = t.n_rows
    counts = texts.select("row", F.explode("terms").alias("term")).groupBy("row", "term").agg(F.count(F.lit(1)).alias("tf"))
    asked = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    idf = counts.groupBy("term").agg((F.log((F.lit(1.0) + n) / (F.count(F.lit(1)) + 1)) + 1).alias("idf"))
    weights = counts.join(asked, "row", "left_semi").join(idf, "term").select("row", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy("row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weights.join(norms, "row").select("row", "term", (F.col("w") / F.col("norm")).alias("w"))
    left = pairs.join(unit.select(F.col("row").alias("a"), "term", F.col("w").alias("wa")), "a")
    both = left.join(unit.select(F.col("row").alias("b"), "term", F.col("w").alias("wb")), ["b", "term"])
    return both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= config.NEAR_TEXT)


def near_texts(t: Table, column: str) -> DataFrame:
    """D2 for one column of texts in groups of any size: (a, b, cosine) of all rows that agree on the other columns
    and whose TF-IDF vectors have a cosine of 0.70 or more, but for pairs of which both rows are exact copies.

    Equal rows are compared once. Terms stand by document frequency, the rarest first. Two texts' cosine is at most the
    product of what is left of their unit vectors from their first common term on, so only pairs for which this
    reaches the threshold are multiplied out, and none is missed. Terms and pairs travel packed (``text_pairs``).
    """
    others = [c for c in t.columns if c != column]
    key = row_key(t.columns)
    keyed = t.df.select(F.col(ROW).alias("member"), key.alias("key"))
    groups = keyed.groupBy("key").agg(F.min("member").alias("row"), F.count(F.lit(1)).alias("n"))
    side = F.xxhash64(F.lit(0), *[S.normalise_latin(_c(c)) for c in others])
    found = similar(t.df.select(F.col(ROW).alias("row"), side.alias("side"), F.unhex(key).alias("key"), hashes(words(_c(column))).alias("words")), t.n_rows)
    members = keyed.join(groups, "key").select("row", "member", "n")
    of = lambda c: members.select(F.col("row").alias(c), F.col("member").alias(f"m{c}"), F.col("n").alias(f"n{c}"))
    return found.join(of("a"), "a").join(of("b"), "b").where("na = 1 or nb = 1").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"), "cosine")


def near_duplicates(t: Table, split: str | None = None, differing: list[str] | None = None) -> DataFrame:
    """D2 without pairs of which both rows are exact copies of something."""
    exact = duplicate_rows(t, [c for c in t.columns if c != split])
    pairs = near_pairs(t, split, differing)
    marked = pairs.join(exact.select(F.col(ROW).alias("a"), F.lit(True).alias("ea")), "a", "left").join(exact.select(F.col(ROW).alias("b"), F.lit(True).alias("eb")), "b", "left")
    return marked.where("ea is null or eb is null").select("a", "b", "differs")


def class_sizes(t: Table, label: str) -> DataFrame:
    """D3: (label, n, share) of each class."""
    counts = t.df.select(_c(label).alias("label")).where(~is_missing(F.col("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def class_imbalance(t: Table, label: str) -> DataFrame:
    """D3: the smallest class, if it has under 5 % or under ten rows."""
    told = class_sizes(t, label).agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("n", "label", "share")).alias("x")).where("k >= 2").select("x.label", "x.n", "x.share")
    return told.where((F.col("share") < config.CLASS_SHARE) | (F.col("n") < config.CLASS_ROWS)).withColumn("severity", F.when(F.col("n") < config.FOLDS, "medium").otherwise("low"))


def exact_overlap(t: Table, split: str) -> DataFrame:
    """Ids of rows whose features stand on more than one side of the split."""
    names = [c for c in t.columns if c != split]
    keyed = t.df.select(ROW, row_key(names).alias("key"), _c(split).alias("side"))
    both = keyed.groupBy("key").agg((F.min("side") < F.max("side")).alias("both")).where("both").select("key")
    return keyed.join(both, "key", "left_semi").select(ROW)


def near_overlap(t: Table, split: str, differing: list[str] | None = None) -> DataFrame:
    """Ids of rows with a near copy on another side."""
    sides = t.df.select(F.col(ROW).alias("row"), _c(split).alias("side"))
    pairs = near_pairs(t, split, differing).join(sides.select(F.col("row").alias("a"), F.col("side").alias("sa")), "a").join(sides.select(F.col("row").alias("b"), F.col("side").alias("sb")), "b").where("sa <> sb")
    return pairs.select(F.col("a").alias(ROW)).unionByName(pairs.select(F.col("b").alias(ROW))).distinct()


def totals_row(t: Table) -> DataFrame:
    """(row, n_matched, n_compared, labelled, auto) if the last row sums up those above it."""
    spark = t.df.sparkSession
    schema = f"{ROW} long, n_matched int, n_compared int, labelled boolean, auto boolean, columns array<string>"
    names = [c for c in t.columns if t.kinds[c]["inferred_type"] not in ("text", "constant", "datetime") and t.kinds[c]["n_present"] and t.kinds[c]["n_numeric"] / t.kinds[c]["n_present"] > 0.9]
    if t.n_rows < config.TOTAL_ROWS + 1 or not names:
        return spark.createDataFrame([], schema)
    last = t.df.agg(F.max(ROW)).first()[0]
    body = F.col(ROW) < last
    r = t.df.agg(*[F.sum(F.when(body, present_number(_c(c)))).alias(f"s{k}") for k, c in enumerate(names)]).first()
    row = t.df.where(F.col(ROW) == last).select(*[present_number(_c(c)).alias(f"v{k}") for k, c in enumerate(names)], F.array(*[F.lower(S.strip(_c(c))) for c in t.of_kind("categorical", "text", "id_like")]).cast("array<string>").alias("words")).first()
    compared = [(c, row[f"v{k}"], r[f"s{k}"]) for k, c in enumerate(names) if row[f"v{k}"] is not None and r[f"s{k}"] is not None]
    matched = [c for c, v, s in compared if abs(s) >= 1e-9 and abs(v - s) <= abs(s) * config.TOTAL_GAP]
    if not matched:
        return spark.createDataFrame([], schema)
    labelled = any(w in config.TOTAL_WORDS for w in row["words"] or [])
    return spark.createDataFrame([(last, len(matched), len(compared), labelled, labelled or len(matched) == len(compared), matched)], schema)
