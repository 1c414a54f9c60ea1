"""Checks of single columns, each a plan over the dictionary of values or one pass over the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions import scalars as S

from .quantiles import quantiles
from .tables import ROW, Table, is_missing, is_sentinel


def _sum_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def _typed(t: Table) -> DataFrame:
    """The dictionary with each column's type. The profile has one row for each column."""
    return t.values.join(F.broadcast(t.types.select("col", "inferred_type", "n_present")), "col")


def missingness(t: Table) -> DataFrame:
    """Columns with more than 5 % of their cells missing."""
    fraction = F.col("missing_fraction")
    return t.profile.where(fraction > config.MISSING_LOW).select(
        "col", "n_missing", "missing_fraction",
        F.when(fraction > config.MISSING_MEDIUM, "medium").otherwise("low").alias("severity"),
        F.when(F.col("inferred_type").isin("categorical", "boolean"), "fill_missing").otherwise("review").alias("action"),
    )


def sparse_rows(t: Table) -> DataFrame:
    """Rows with more than half of their cells missing."""
    gaps = reduce(lambda a, b: a + b, [is_missing(F.col(f"`{c}`")).cast("int") for c in t.columns])
    return t.df.select(ROW, gaps.alias("n_missing")).where(F.col("n_missing") / len(t.columns) > config.SPARSE_ROW)


def constants(t: Table) -> DataFrame:
    """Columns that are empty, hold one value, or hold one value in more than 99 % of their present cells."""
    top = t.values.where("not missing").groupBy("col").agg(F.max("n").alias("top"), F.max_by("raw", F.struct("n", "raw")).alias("value"))
    told = t.profile.join(top, "col", "left")
    share = F.coalesce(F.col("top") / F.greatest("n_present", F.lit(1)), F.lit(0.0))
    hit = (F.col("n_present") == 0) | (F.col("inferred_type") == "constant") | (share > config.NEAR_CONSTANT)
    return told.where(hit).select("col", "value", share.alias("top_share"), "n_rows")


def id_like(t: Table, label: str | None = None) -> DataFrame:
    """Columns that name rows."""
    return t.profile.where((F.col("inferred_type") == "id_like") & (F.col("col") != F.lit(label or ""))).select("col", "n_unique", "unique_share")


def mixed_types(t: Table) -> DataFrame:
    """C4: columns where numbers and words both have a share. Here any comma may part thousands."""
    numeric = S.as_double(F.replace(F.col("raw"), F.lit(","), F.lit(""))).isNotNull()
    told = (
        _typed(t).where("not blank").where(~F.col("inferred_type").isin("text", "datetime", "constant")).groupBy("col")
        .agg(F.sum("n").alias("n_filled"), _sum_if(numeric).alias("n_numeric"), _sum_if(~numeric & ~F.col("sentinel")).alias("n_offending"))
    )
    share = F.col("n_numeric") / F.col("n_filled")
    return told.where((share >= config.MIXED_SHARE) & (1 - share >= config.MIXED_SHARE) & (F.col("n_offending") / F.col("n_filled") >= config.MIXED_SHARE)).withColumn("numeric_share", share)


def mixed_type_rows(v: Column) -> Column:
    return (S.strip(v) != "") & S.as_double(F.replace(v, F.lit(","), F.lit(""))).isNull() & ~is_sentinel(v)


def variants(t: Table) -> DataFrame:
    """Spellings of one value. (col, norm, raw, n, canonical, verdict): each spelling but the canonical one is
    ``safe`` to merge or ``contested``.
    """
    present = _typed(t).where("not missing").where(F.col("inferred_type").isin("categorical", "boolean"))
    # Sums over a column combine before they shuffle and come back as one row for each column; windows here run over one norm.
    truth = present.groupBy("col").agg(_sum_if(S.parse_boolean(F.col("raw")).isNotNull()).alias("truth"))
    same = Window.partitionBy("col", "norm")
    ranked = same.orderBy(F.desc("n"), "raw")
    found = (
        present.join(F.broadcast(truth), "col").where(F.col("truth") / F.col("n_present") < config.BOOLEAN_SHARE)
        .withColumns({"spellings": F.count(F.lit(1)).over(same), "place": F.row_number().over(ranked), "canonical": F.first("raw").over(ranked), "top": F.first("n").over(ranked)})
        .where("spellings > 1")
    )
    text = S.strip(F.col("raw"))
    code = ~text.rlike(r"(?U)\s") & (text.rlike(r"(?U)\d") | (F.length(text) <= config.CODE_LENGTH))
    safe = (text == S.strip(F.col("canonical"))) | (F.col("n") / F.col("top") <= config.MERGE_RATIO) | ~code
    return found.select("col", "norm", "raw", "n", "canonical", F.when(F.col("place") == 1, "canonical").when(safe, "safe").otherwise("contested").alias("verdict"))


def rare_values(t: Table) -> DataFrame:
    """Values of a categorical column with fewer than five rows."""
    return _typed(t).where("not missing and inferred_type = 'categorical'").where(F.col("n") < config.RARE).select("col", "raw", "n")


def fences(t: Table) -> DataFrame:
    """One row for each numeric column: quartiles, median, MAD and the bounds beyond which a value is an outlier."""
    numbers = _typed(t).where("not missing and num is not null and inferred_type = 'numeric'")
    kinds = {c: k["n_raw"] for c, k in t.kinds.items()}
    middle = quantiles(numbers, [0.25, 0.5, 0.75], kinds).withColumnRenamed("total", "support")
    # The second aggregation needs the first one's medians: at most one row for each column.
    far = numbers.join(F.broadcast(middle.select("col", "q")), "col").select("col", F.abs(F.col("num") - F.col("q")[1]).alias("num"), "n")
    spread = quantiles(far, [0.5], kinds).select("col", F.col("q")[0].alias("mad"))
    told = middle.join(spread, "col").select("col", "support", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mad").where(F.col("support") >= 10)
    iqr, reach = F.col("q3") - F.col("q1"), config.ROBUST_Z * config.MAD_TO_SIGMA * F.col("mad")
    return told.withColumns(
        {
            "low_iqr": F.when(iqr > 0, F.col("q1") - config.IQR_FENCES * iqr), "high_iqr": F.when(iqr > 0, F.col("q3") + config.IQR_FENCES * iqr),
            "low_mad": F.when(F.col("mad") > 0, F.col("median") - reach), "high_mad": F.when(F.col("mad") > 0, F.col("median") + reach),
        }
    )


def outliers(t: Table) -> DataFrame:
    """(col, by_iqr, by_mad, n_outliers, median) of columns with outliers."""
    met = t.values.where("not missing and num is not null").join(F.broadcast(fences(t)), "col")
    iqr = F.coalesce(~F.col("num").between(F.col("low_iqr"), F.col("high_iqr")), F.lit(False))
    mad = F.coalesce(F.abs(F.col("num") - F.col("median")) / (config.MAD_TO_SIGMA * F.col("mad")) > config.ROBUST_Z, F.lit(False)) & (F.col("mad") > 0)
    told = met.groupBy("col").agg(_sum_if(iqr).alias("by_iqr"), _sum_if(mad).alias("by_mad"), _sum_if(iqr | mad).alias("n_outliers"), F.first("median").alias("median"))
    return told.where("n_outliers > 0")


def future_dates(t: Table, as_of: str) -> DataFrame:
    """Dates after ``as_of`` in date columns."""
    late = S.to_timestamp(F.col("raw")) > F.lit(as_of).cast("timestamp_ntz")
    return _typed(t).where("not missing and inferred_type = 'datetime'").where(late).groupBy("col").agg(F.sum("n").alias("n_future"))


def unexpected_negatives(t: Table) -> DataFrame:
    """A few negative numbers in a column that is otherwise not negative."""
    told = _typed(t).where("not missing and num is not null and inferred_type = 'numeric'").groupBy("col").agg(F.sum("n").alias("support"), _sum_if(F.col("num") < 0).alias("n_negative"))
    return told.where((F.col("n_negative") > 0) & ((F.col("support") - F.col("n_negative")) / F.col("support") > config.MOSTLY_POSITIVE))


def scale_breaks(t: Table) -> DataFrame:
    """Values more than ten times the second largest of their column."""
    numbers = _typed(t).where("not missing and num is not null and inferred_type = 'numeric'")
    # The two largest, repeats counted: the two greatest (num, place) pairs after values of several rows are doubled.
    twice = numbers.select("col", "num", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(2).cast("long")))).alias("copy"))
    place = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("num")))
    second = twice.withColumn("place", place).where("place <= 2").groupBy("col").agg(F.max("num").alias("largest"), F.min("num").alias("second"), F.count(F.lit(1)).alias("k"))
    total = numbers.groupBy("col").agg(F.sum("n").alias("support"))
    return second.join(total, "col").where((F.col("support") > 2) & (F.col("second") > 0) & (F.col("largest") > config.SCALE_BREAK * F.col("second"))).select("col", "largest", "second")


def pearson(t: Table, label: str | None = None) -> DataFrame:
    """Pairs of numeric columns that correlate beyond 0.98. All pairs are one aggregation over the rows."""
    names = [c for c in t.of_kind("numeric") if c != label]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    spark = t.df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "a string, b string, r double")
    numbers = t.numbers(names)
    one = numbers.agg(*[F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*").where((F.col("r") > config.CORRELATED) & ~F.isnan("r"))


def cramers_v(t: Table, label: str | None = None) -> DataFrame:
    """Pairs of categorical columns of which one tells the other. Pairs of values are counted, never rows paired."""
    few = [c for c in t.of_kind("categorical", "boolean") if c != label and t.kinds[c]["n_raw"] <= config.ASSOCIATION_VALUES]
    pairs = [(a, b) for i, a in enumerate(few) for b in few[i + 1 :]]
    if not pairs:
        return t.df.sparkSession.createDataFrame([], "a string, b string, v double")
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in pairs])
    seen = t.df.select(F.explode(sides).alias("p")).select("p.*").where(~is_missing(F.col("x")) & ~is_missing(F.col("y"))).groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("o"))
    pair = Window.partitionBy("a", "b")
    cells = seen.withColumns({"r": F.sum("o").over(pair.partitionBy("a", "b", "x")), "c": F.sum("o").over(Window.partitionBy("a", "b", "y")), "total": F.sum("o").over(pair)})
    told = cells.groupBy("a", "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny"))
    v = F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / (F.least("nx", "ny") - 1))
    return told.where("least(nx, ny) >= 2").select("a", "b", v.alias("v")).where(F.col("v") > config.CORRELATED)


def sentinels(t: Table) -> DataFrame:
    """C11: words that mean "no value": (col, n_sentinel, auto)."""
    told = t.values.groupBy("col").agg(_sum_if(F.col("sentinel")).alias("n_sentinel"), F.max_by("sentinel", F.struct("n", "raw")).alias("modal_is_sentinel"))
    told = told.join(F.broadcast(t.types.select("col", "inferred_type", "n_rows")), "col")
    share = F.col("n_sentinel") / F.col("n_rows")
    category = F.col("inferred_type").isin("categorical", "boolean", "text", "constant")
    auto = (share <= config.SENTINEL_AUTO) & ~(category & F.col("modal_is_sentinel"))
    return told.where((F.col("n_sentinel") >= config.SENTINEL_LEAST) & (share <= config.SENTINEL_MOST)).select("col", "n_sentinel", auto.alias("auto"))


def sentinel_forms(t: Table, k: int = 10) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "raw"))
    return t.values.where("sentinel").withColumn("place", place).where(F.col("place") <= k).select("col", "raw", "n")


def untrimmed(t: Table) -> DataFrame:
    """C14: cells with white space around them, by column."""
    return t.values.where(F.col("raw") != S.strip(F.col("raw"))).groupBy("col").agg(F.sum("n").alias("n_cells"))


def invisible(t: Table) -> DataFrame:
    """C20: cells with characters that cannot be seen, by column."""
    return t.values.where(S.has_invisible(F.col("raw"))).groupBy("col").agg(F.sum("n").alias("n_cells"))


def rows_where(t: Table, test) -> DataFrame:
    """Row ids where any column passes the test."""
    return t.df.where(reduce(lambda a, b: a | b, [test(F.col(f"`{c}`")) for c in t.columns])).select(ROW)


def entities(t: Table) -> DataFrame:
    """Names that differ by punctuation or by words for the legal form. (col, key, canonical, raw, n)."""
    named = _typed(t).where("not missing").where(~F.col("inferred_type").isin("numeric", "datetime", "constant", "boolean"))
    column = named.groupBy("col").agg(F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct"), F.avg(S.has_letter(F.col("raw")).cast("double")).alias("lettered"), F.avg(S.n_words(F.col("raw"))).alias("words"))
    column = column.where((F.col("present") >= config.ENTITY_LEAST) & F.col("distinct").between(2, config.ENTITY_MOST) & (F.col("lettered") > 0.9) & (F.col("words") >= 1.5))
    fits = named.join(F.broadcast(column.select("col")), "col").withColumn("key", S.entity_key(F.col("norm"))).where("length(key) >= 3")
    group = Window.partitionBy("col", "key")
    best = group.orderBy(F.desc("n"), F.desc(F.length("raw")), "raw")
    return fits.withColumns({"norms": F.size(F.collect_set("norm").over(group)), "canonical": F.first("raw").over(best)}).where("norms > 1").select("col", "key", "canonical", "raw", "n")


def formatted_numbers(t: Table) -> DataFrame:
    """Columns of numbers in dress: (col, n_dressed, n_units, n_symbols, auto)."""
    values = _typed(t).where("not missing and not sentinel").where(~F.col("inferred_type").isin("numeric", "datetime", "constant", "text"))
    parts = S.number_parts(F.col("raw"))
    told = values.withColumn("p", parts).withColumn("dressed", S.needs_reformatting(F.col("raw"))).groupBy("col").agg(
        F.sum("n").alias("n_values"), _sum_if(F.col("p.literal").isNotNull()).alias("n_parsed"), _sum_if(F.col("dressed")).alias("n_dressed"),
        F.count_distinct(F.when(F.col("p.literal").isNotNull() & (F.col("p.unit") != ""), F.col("p.unit"))).alias("n_units"),
        F.count_distinct(F.when(F.col("p.literal").isNotNull() & (F.col("p.symbol") != ""), F.col("p.symbol"))).alias("n_symbols"),
        F.bool_or(F.col("p.unit") == "%").alias("percent"),
    )
    auto = (F.col("n_units") <= 1) & (F.col("n_symbols") <= 1)
    return told.where((F.col("n_values") >= config.FORMAT_LEAST) & (F.col("n_parsed") / F.col("n_values") >= config.FORMAT_SHARE) & (F.col("n_dressed") >= config.FORMAT_LEAST)).withColumn("auto", auto)


def date_formats(t: Table) -> DataFrame:
    """Columns of dates that are not all ISO: (col, n_styles, dayfirst, n_changing, auto, severity)."""
    values = _typed(t).where("not missing and not sentinel").where(~F.col("inferred_type").isin("numeric", "constant", "id_like"))
    told = values.withColumn("style", S.date_style(F.col("raw")))
    first = told.groupBy("col").agg((F.max(S.leads_with_day(F.col("raw")).cast("int")) == 1).alias("dayfirst"))
    told = told.join(F.broadcast(first), "col")
    changed = S.parse_date(F.col("raw"), F.col("dayfirst"))
    told = told.groupBy("col").agg(
        F.sum("n").alias("n_values"), _sum_if(F.col("style").isNotNull()).alias("n_styled"), F.count_distinct("style").alias("n_styles"), F.bool_or(F.col("style") == "iso").alias("any_iso"),
        F.bool_or(F.col("style") == "numeric").alias("any_numeric"), F.first("dayfirst").alias("dayfirst"), _sum_if(changed.isNotNull() & (changed != S.strip(F.col("raw")))).alias("n_changing"),
    )
    only_iso = (F.col("n_styles") == 1) & F.coalesce(F.col("any_iso"), F.lit(False))
    hit = (F.col("n_values") >= config.FORMAT_LEAST) & (F.col("n_styled") / F.col("n_values") >= config.FORMAT_SHARE) & ~only_iso & (F.col("n_changing") >= config.FORMAT_LEAST)
    return told.where(hit).select("col", "n_styles", "dayfirst", "n_changing", (~F.coalesce(F.col("any_numeric"), F.lit(False)) | F.col("dayfirst")).alias("auto"), F.when(F.col("n_styles") > 1, "medium").otherwise("low").alias("severity"))


def booleans(t: Table) -> DataFrame:
    """C17: columns of truth values in more than two spellings."""
    values = _typed(t).where("not missing").where(~F.col("inferred_type").isin("text", "constant", "id_like", "datetime"))
    truth = S.parse_boolean(F.col("raw"))
    told = values.groupBy("col").agg(F.sum("n").alias("n_values"), _sum_if(truth.isNotNull()).alias("n_parsed"), F.count_distinct(F.when(truth.isNotNull(), F.lower(S.strip(F.col("raw"))))).alias("n_spellings"))
    return told.where((F.col("n_values") >= config.FORMAT_LEAST) & (F.col("n_parsed") / F.col("n_values") >= config.BOOLEAN_SHARE) & (F.col("n_spellings") > 2))


def codes(t: Table) -> DataFrame:
    """A number far outside its column that repeats as a code does: (col, code, n, median)."""
    spread = fences(t).where((F.col("support") >= config.CODE_VALUES) & (F.col("mad") > 0)).select("col", "support", "median", "mad")
    numbers = t.values.where("not missing and num is not null").groupBy("col", "num").agg(F.sum("n").alias("n"))
    far = (
        numbers.join(F.broadcast(spread), "col")
        .where((F.col("n") >= config.CODE_COUNT) & (F.col("n") / F.col("support") <= config.CODE_SHARE) & (F.abs(F.col("num") - F.col("median")) / F.col("mad") >= config.CODE_DISTANCE))
        .where(~(F.col("num").isin(0.0, 1.0, -1.0) & (F.abs("median") < 10)))
    )
    return far.withColumn("place", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "num"))).where("place = 1").select("col", F.col("num").alias("code"), "n", "median")


def markup(t: Table) -> DataFrame:
    """Columns with HTML in their values."""
    told = _typed(t).where("not missing").where(F.col("inferred_type").isin("text", "categorical")).groupBy("col").agg(F.sum("n").alias("n_values"), _sum_if(S.has_markup(F.col("raw"))).alias("n_markup"))
    return told.where((F.col("n_values") >= config.FORMAT_LEAST) & (F.col("n_markup") >= config.MARKUP_LEAST) & (F.col("n_markup") / F.col("n_values") >= config.MARKUP_SHARE))
