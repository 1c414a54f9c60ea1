"""URL allow and block lists as a sort-merge range join.

A host is keyed by its labels in reverse (``a.example.org`` -> ``org.example.a.``), so a rule for a host and all its
subdomains is the interval of keys that begin with the rule's key; within one rule host, a rule for a path is the
interval of paths that begin with the rule's. Such intervals nest or are disjoint. ``sweep`` meets points and
intervals in key order. A running sum of opened and closed intervals gives each rule its place in the stack; the stack
at a point is, for each place, the rule that was put there last, less those that ended before this point. Keys are
dealt to ranges by Spark's range partitioning; what is open where a range begins is one row for each range.

Two sweeps judge a url: one of hosts, which finds the rule hosts that are open at each, and one of (rule host, path),
which finds the longest rule of each. Both run over distinct keys, so a hot host or url is one row in them; urls
then meet their verdict in an equi-join, whose hot partitions Spark splits. Only SQL functions are used.

Null urls and urls without ``://`` have an empty host and path and fit no rule. Repeated urls are judged alike, long
ones whole. Of rules for one host and path with different verdicts the one with the greater verdict string stands
(``block`` before ``allow``). Empty tables of pages or rules are as good as any. Extra columns are kept; columns named
like the results are overwritten. A host in a rule that holds ``/``, ``?`` or ``#`` fits nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fold_ascii, read, table

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
RULE_SCHEMA = "host string, path string, verdict string"


def host_and_path(rest) -> tuple[F.Column, F.Column]:
    host = fold_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_key(host) -> F.Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


END = "\U0010ffff"  # after every other character: what begins with a key lies between the key and the key with this


def sweep(points: DataFrame, rules: DataFrame, ranges: int | None = None) -> DataFrame:
    """(key, stack) for each key of ``points`` (key) at which rules (key, rule) are open: the rules whose key begins it, outermost first."""
    spark = points.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = rules.groupBy("key").agg(F.sort_array(F.collect_set("rule")).alias("own"))
    nothing = F.lit(None).cast(own.schema["own"].dataType)
    opened = own.select("key", F.lit(0).alias("kind"), F.lit(1).alias("step"), "own")
    closed = own.select(F.concat("key", F.lit(END)).alias("key"), F.lit(1).alias("kind"), F.lit(-1).alias("step"), nothing.alias("own"))
    asked = points.select("key", F.lit(2).alias("kind"), F.lit(0).alias("step"), nothing.alias("own"))
    every = opened.unionByName(closed).unionByName(asked)
    # Written out, as the ranges must be the same in each of the passes over them.
    dealt = table(every.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()), "sweep")
    in_order = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    base = dealt.groupBy("range").agg(F.sum("step").alias("sum")).select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    placed = table(dealt.where("kind < 2").join(F.broadcast(base), "range").select("range", "key", "kind", "own", (F.sum("step").over(in_order) + F.col("base")).alias("depth")).where("kind = 0"), "sweep-rules")
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    if not deepest:
        return dealt.select("key", F.col("own").alias("stack")).where("false")
    slot = lambda d: F.when(F.col("depth") == d, F.struct("key", "own"))
    last = placed.groupBy("range").agg(*[F.max_by(F.struct("key", "own"), F.when(F.col("depth") == d, F.col("key"))).alias(f"s{d}") for d in range(1, deepest + 1)])
    at_start = base.select("range").join(last, "range", "left").select("range", *[F.last(f"s{d}", True).over(before).alias(f"c{d}") for d in range(1, deepest + 1)])
    met = placed.select("range", "key", F.lit(0).alias("kind"), "own", "depth").unionByName(dealt.where("kind = 2").select("range", "key", "kind", "own", F.lit(0).cast("long").alias("depth")))
    held = met.select("range", "key", "kind", *[F.last(slot(d), True).over(in_order).alias(f"s{d}") for d in range(1, deepest + 1)]).where("kind = 2").join(F.broadcast(at_start), "range")
    stack = F.array(*[F.coalesce(f"s{d}", f"c{d}") for d in range(1, deepest + 1)])
    open_ = F.filter(stack, lambda r: r.isNotNull() & F.col("key").startswith(r["key"]))
    return held.select("key", F.flatten(F.transform(open_, lambda r: r["own"])).alias("stack")).where("size(stack) > 0")


def url_filter(pages: DataFrame, rules: DataFrame | Iterable[tuple], url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict. The longest fitting rule wins, of equal length the one with the longer host.

    rules: rows (host, path, verdict). A url that no rule fits gets ``default`` and a null rule.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), RULE_SCHEMA)
    rules = rules.where("host is not null and host <> '' and path is not null").select(fold_ascii(F.col("host")).alias("host"), "path", "verdict").where("not host rlike '[/?#]'")
    rules = rules.distinct().withColumn("host_key", reversed_key(F.col("host")))
    # Rows travel as one struct, so no column name clashes.
    whole = pages.select(F.struct("*").alias("page"), F.col(url).alias("url"))
    rest = F.when(F.instr("url", "://") > 0, F.substring("url", F.instr("url", "://") + 3, F.length("url")))
    host, path = host_and_path(rest)
    urls = whole.select("page", host.alias("host"), path.alias("path"))
    places = table(urls.select("host", "path").where("host <> ''").distinct(), "url-places")

    hosts = places.select("host").distinct().withColumn("key", reversed_key(F.col("host")))
    open_hosts = sweep(hosts.select("key"), rules.select(F.col("host_key").alias("key"), F.col("host_key").alias("rule")), ranges)
    asked = places.join(hosts.join(open_hosts, "key").select("host", "stack"), "host").select("host", "path", F.explode("stack").alias("rule_host"))
    asked = table(asked.select("host", "path", F.concat("rule_host", F.lit("/"), "path").alias("key")), "url-asked")
    told = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("m"), F.concat("host", "path").alias("rule"), "verdict")
    found = sweep(asked.select("key").distinct(), rules.select(F.concat("host_key", F.lit("/"), "path").alias("key"), told.alias("rule")), ranges)
    best = table(asked.join(found, "key").groupBy("host", "path").agg(F.max(F.array_max("stack")).alias("best")), "url-best")
    discard(places, asked)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = urls.join(best, ["host", "path"], "left")
    return judged.select(*[F.col(f"page.`{c}`").alias(c) for c in kept], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    return url_filter(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


_PICK = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'"
    for i, (h, p, _) in sorted(enumerate(RULES), key=lambda x: -len(x[1][0] + x[1][1]))
)
OP1_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
)
SELECT page_id, host, path, CASE {_PICK.format(*[h + p for h, p, _ in RULES])} END AS rule,
  CASE {_PICK.format(*[v for _, _, v in RULES])} ELSE 'allow' END AS verdict
FROM parts
"""
