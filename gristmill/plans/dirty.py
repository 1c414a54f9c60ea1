"""Tables with faults planted by key, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gristmill.operators.tables import Table, as_strings

ZERO_WIDTH, NO_BREAK = "\u200b", "\u00a0"
_DATE = "CAST(CAST({} AS DATE) AS STRING)"
_MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', (CAST(substr({0}, 6, 2) AS INT) - 1) * 3 + 1, 3)"


def _styles(day: str, key: str) -> str:
    month = _MONTH.format(day)
    return (
        f"CASE {key} % 5 WHEN 0 THEN {day} WHEN 1 THEN concat(substr({day}, 9, 2), '/', substr({day}, 6, 2), '/', substr({day}, 1, 4)) "
        f"WHEN 2 THEN concat(substr({day}, 9, 2), ' ', {month}, ' ', substr({day}, 1, 4)) WHEN 3 THEN concat({month}, ' ', substr({day}, 9, 2), ', ', substr({day}, 1, 4)) "
        f"ELSE replace({day}, '-', '/') END"
    )


_ODAY = _DATE.format("o_orderdate")
ORDERS = f"""
SELECT o_orderkey AS rid,
  concat('O', CAST(o_orderkey AS STRING)) AS order_id,
  CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN ' Unknown ' ELSE o_orderstatus END AS status,
  CASE o_orderkey % 17 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN concat(' ', o_orderpriority, ' ') ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 11 = 0 THEN 'ten' WHEN o_orderkey % 29 = 0 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS STRING) END AS total,
  {_styles(_ODAY, 'o_orderkey')} AS odate,
  {_ODAY} AS iso_date,
  CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'f' WHEN 4 THEN '1' ELSE '0' END AS flag,
  CASE WHEN o_orderkey % 50 = 0 THEN 'Ber{ZERO_WIDTH}lin' WHEN o_orderkey % 51 = 0 THEN 'New{NO_BREAK}York' WHEN o_orderkey % 3 = 0 THEN 'Berlin' WHEN o_orderkey % 3 = 1 THEN 'New York' ELSE 'Oslo' END AS city,
  CASE WHEN o_orderkey % 10 = 0 THEN '<b>late</b> &amp; paid in two parts <br/>at &euro;5' WHEN o_orderkey % 10 = 1 THEN 'a < b and paid as agreed' ELSE concat('on time and as agreed by desk ', CAST(o_orderkey % 40 AS STRING)) END AS note,
  CASE WHEN o_orderkey % 7 = 0 THEN concat(CAST(o_orderkey % 90 + 1 AS STRING), ' lb') ELSE concat(CAST(o_orderkey % 90 + 1 AS STRING), ' kg') END AS weight,
  CASE WHEN o_orderkey % 9 = 0 THEN concat('($', CAST(o_orderkey % 9 + 1 AS STRING), ',', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '.50)') ELSE concat('$', CAST(o_orderkey % 9 + 1 AS STRING), ',', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '.50') END AS amount,
  CASE WHEN o_orderkey % 997 = 0 THEN '5000' WHEN o_orderkey % 101 = 0 THEN '-999' ELSE CAST(o_orderkey % 40 + 1 AS STRING) END AS qty,
  CASE WHEN o_orderkey % 499 = 0 THEN '-5' WHEN o_orderkey = 42 THEN '90000' ELSE CAST(o_orderkey % 60 + 20 AS STRING) END AS level,
  CASE o_orderkey % 8 WHEN 0 THEN 'Acme Trading' WHEN 1 THEN 'Acme Trading, Inc.' WHEN 2 THEN 'The Acme Trading' WHEN 3 THEN 'Blue Harbour Ltd' WHEN 4 THEN 'Blue Harbour' ELSE concat('Vendor Number ', CAST(o_orderkey % 300 AS STRING), 'x') END AS vendor,
  'EU' AS region,
  CASE WHEN o_orderkey % 23 = 0 THEN '2031-04-02' ELSE {_ODAY} END AS due
FROM orders
"""
_SHIP = _DATE.format("l_shipdate")
LINES = f"""
SELECT CAST(l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000 AS BIGINT) AS rid0, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(CAST(l_quantity AS INT) AS STRING) AS qty,
  CAST(l_partkey % 25 + 1 AS STRING) AS item,
  CASE WHEN l_orderkey % 19 = 0 THEN '' WHEN l_orderkey % 19 = 1 THEN 'ERROR' ELSE CAST((l_partkey % 25 + 1) * 3 AS STRING) END AS price,
  CASE WHEN l_orderkey % 23 = 0 THEN '' ELSE CAST(CAST(l_quantity AS INT) * (l_partkey % 25 + 1) * 3 AS STRING) END AS amount,
  CAST(CAST(l_quantity AS INT) * 92 AS STRING) AS qty_pct,
  l_returnflag AS flag, concat('flag ', l_returnflag) AS flag_text,
  {_SHIP} AS shipped,
  CASE WHEN l_orderkey % 211 = 0 THEN '1980-01-01' ELSE {_DATE.format('CAST(l_shipdate AS DATE) + CAST(l_partkey % 9 + 1 AS INT)')} END AS received
FROM lineitem
"""
_COPY = "o_orderkey AS rid, CAST(o_custkey AS STRING) AS cust, o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS STRING) AS total, {day} AS odate, o_orderpriority AS priority, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split"
_BASE = _COPY.format(day=_ODAY)
COPIES = f"""
SELECT {_BASE} FROM orders
UNION ALL SELECT {_BASE.replace('o_orderkey AS rid', 'o_orderkey + 100000000 AS rid').replace("CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END", "CASE WHEN o_orderkey % 8 = 0 THEN 'train' WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END")} FROM orders WHERE o_orderkey % 20 = 0
UNION ALL SELECT {_BASE.replace('o_orderkey AS rid', 'o_orderkey + 200000000 AS rid').replace('CAST(o_totalprice AS DECIMAL(12, 2))', 'CAST(o_totalprice AS DECIMAL(12, 2)) + CAST(1 AS DECIMAL(12, 2))')} FROM orders WHERE o_orderkey % 31 = 0
"""
EVENTS = """
SELECT event_id AS rid, CASE WHEN event_id % 4999 = 7 THEN 'odd' ELSE event_type END AS kind, CASE WHEN user_id % 97 = 0 THEN 'vip' ELSE 'plain' END AS tier, CAST(user_id % 50 AS STRING) AS user_group,
  CAST(CAST(value AS DECIMAL(12, 3)) AS STRING) AS value
FROM events
"""
TOTALS = """
SELECT l_orderkey AS rid, CAST(l_orderkey AS STRING) AS item, CAST(sum(CAST(l_quantity AS INT)) AS STRING) AS a, CAST(sum(l_linenumber) AS STRING) AS b FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT 4000000000 AS rid, 'Total' AS item, CAST(sum(CAST(l_quantity AS INT)) AS STRING) AS a, CAST(sum(l_linenumber) + 999999 AS STRING) AS b FROM lineitem
"""
_NOTE = "concat('the note of customer number ', CAST(c_custkey AS STRING), ' says that the market for ', lower(c_mktsegment), ' goods is as good as in ', CAST(c_nationkey AS STRING), ' other places')"
REVIEWS = f"""
SELECT c_custkey AS rid, concat('who ', CAST(c_custkey AS STRING)) AS who, CAST(c_nationkey AS STRING) AS nation, {_NOTE} AS note FROM customer
UNION ALL SELECT c_custkey + 10000000 AS rid, concat('who ', CAST(c_custkey AS STRING)) AS who, CAST(c_nationkey AS STRING) AS nation,
  CASE c_custkey % 3 WHEN 0 THEN concat({_NOTE}, ' again') WHEN 1 THEN concat('quite another ', c_name, ' remark about the weather and the harvest of this year') ELSE replace({_NOTE}, 'good as', 'poor as') END AS note
FROM customer WHERE c_custkey % 5 = 0
"""
VIEWS = {"reviews": REVIEWS, "orders": ORDERS, "lines": LINES, "copies": COPIES, "events": EVENTS, "totals": TOTALS}


def view(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> Table:
    """A dirty view as a table under audit; only the columns asked for are read."""
    for base in ("orders", "lineitem", "events", "customer"):
        spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    df = spark.sql(VIEWS[name])
    if name == "lines":
        df = df.withColumnRenamed("rid0", "rid").drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    df = df.select("rid", *columns) if columns else df
    return Table(as_strings(df, "rid").drop("rid") if columns is None else as_strings(df, "rid").select("_row_id", *columns), columns or [c for c in df.columns if c != "rid"])
