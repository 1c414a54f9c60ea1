"""Queries of the reader: whole tables written as messy files, each with one trouble, and read back; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.tables import ROW, checkpoint_dir
from gristmill.sources.delimited import TooLarge, read_delimited, read_samples
from gristmill.sources.sinks import write_csv

DAMAGED = "Café Zürich Ærø"  # what names get in files whose encoding is in question
PEOPLE = ("c_custkey", "c_name", "c_mktsegment")
_KEYS = "CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def reads(name: str, oracle: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = oracle
        return f

    return keep


def _place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/files-{name}-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


def _saved(spark: SparkSession, name: str, lines: DataFrame, head: list[str], key: str = "k", **options) -> str:
    """One file: the head's lines, then ``lines`` (key, value) in key order."""
    first = spark.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], f"{key} long, value string")
    path = _place(spark, name)
    first.unionByName(lines.select(F.col(key).cast("long").alias(key), "value")).orderBy(key).coalesce(1).select("value").write.options(**options).text(path)
    return path


def _read(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, **options).drop(ROW)


def _joined(df: DataFrame, delimiter: str = ",") -> DataFrame:
    return df.select("k", F.concat_ws(delimiter, "id", "name", "segment").alias("value"))


@reads("read_plain", f"SELECT {_KEYS} FROM customer")
def read_plain(spark, d):
    return _read(spark, _saved(spark, "plain", _joined(_customers(spark, d)), ["id,name,segment"]))


@reads("read_row_ids", "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS rid, CAST(c_custkey AS VARCHAR) AS id FROM customer")
def read_row_ids(spark, d):
    path = _saved(spark, "ids", _joined(_customers(spark, d)), ["id,name,segment"])
    return read_delimited(spark, path).select(F.col(ROW).alias("rid"), "id")


@reads("read_delimiter_tab", f"SELECT {_KEYS} FROM customer")
def read_delimiter_tab(spark, d):
    return _read(spark, _saved(spark, "tab", _joined(_customers(spark, d), "\t"), ['"id, or key"\tname\tsegment'])).withColumnRenamed("id, or key", "id")


@reads("read_delimiter_decimal_comma", "SELECT CAST(c_custkey AS VARCHAR) AS id, concat(CAST(c_custkey % 90 AS VARCHAR), ',5') AS amount FROM customer")
def read_delimiter_decimal_comma(spark, d):
    rows = _customers(spark, d).select("k", F.concat("id", F.lit(";"), (F.col("k") % 90).cast("string"), F.lit(",5")).alias("value"))
    return _read(spark, _saved(spark, "comma", rows, ["id;amount"]))


@reads("read_gzip", f"SELECT {_KEYS} FROM customer")
def read_gzip(spark, d):
    return _read(spark, _saved(spark, "gzip", _joined(_customers(spark, d)), ["id,name,segment"], compression="gzip"))


@reads("read_lone_carriage_returns", f"SELECT {_KEYS} FROM customer")
def read_lone_carriage_returns(spark, d):
    return _read(spark, _saved(spark, "cr", _joined(_customers(spark, d)), ["id,name,segment"], lineSep="\r"))


@reads("read_preamble", f"SELECT {_KEYS} FROM customer")
def read_preamble(spark, d):
    return _read(spark, _saved(spark, "preamble", _joined(_customers(spark, d)), ["Customers of the year", "made by hand", "", "id,name,segment"]))


@reads("read_two_row_header", 'SELECT CAST(c_custkey AS VARCHAR) AS "Customer key", c_name AS "Customer name", CAST(c_nationkey AS VARCHAR) AS "Place nation" FROM customer')
def read_two_row_header(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), F.concat_ws(",", "c_custkey", "c_name", "c_nationkey").alias("value"))
    return _read(spark, _saved(spark, "two", rows, ["Customer,,Place", "key,name,nation"]))


@reads("read_header_names", 'SELECT CAST(c_custkey AS VARCHAR) AS a, c_name AS column_2, c_mktsegment AS a_2 FROM customer')
def read_header_names(spark, d):
    return _read(spark, _saved(spark, "names", _joined(_customers(spark, d)), [" a ,,a"]))


@reads("read_quoted", "SELECT CAST(c_custkey AS VARCHAR) AS id, concat(c_name, CASE c_custkey % 3 WHEN 0 THEN ', \"of\" ' || c_mktsegment WHEN 1 THEN chr(10) || 'line two' ELSE '' END) AS name FROM customer")
def read_quoted(spark, d):
    odd = F.when(F.col("k") % 3 == 0, F.concat(F.lit(', "of" '), "segment")).when(F.col("k") % 3 == 1, "\nline two").otherwise("")
    quoted = F.concat(F.lit('"'), F.replace(F.concat("name", odd), F.lit('"'), F.lit('""')), F.lit('"'))
    return _read(spark, _saved(spark, "quoted", _customers(spark, d).select("k", F.concat("id", F.lit(","), quoted).alias("value")), ["id,name"]))


@reads("read_ragged", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 = 1 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 5 IN (0, 1) THEN '' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 3 UNION ALL SELECT '', '', '' FROM customer WHERE c_custkey % 5 = 3 AND c_custkey % 2 = 0")
def read_ragged(spark, d):
    """Short rows, long rows, rows of empty cells and blank lines."""
    k = F.col("k")
    short = F.when(k % 5 == 0, F.concat_ws(",", "id", "name")).when(k % 5 == 1, F.col("id")).when(k % 5 == 2, F.concat_ws(",", "id", "name", "segment", F.lit("more"), F.lit("and more")))
    empty = F.when((k % 5 == 3) & (k % 2 == 0), ",,").when(k % 5 == 3, F.when(k % 3 == 0, "   ").otherwise(""))
    return _read(spark, _saved(spark, "ragged", _customers(spark, d).select("k", F.coalesce(short, empty, F.concat_ws(",", "id", "name", "segment")).alias("value")), ["id,name,segment", *["filler,x,y"] * 20])).where("id <> 'filler'")


def _encoded(spark: SparkSession, d: str, name: str, encoding: str) -> DataFrame:
    path = _place(spark, name)
    rows = _customers(spark, d).select("id", F.concat(F.lit(DAMAGED + " "), "name").alias("name"))
    rows.coalesce(1).write.csv(path, header=True, encoding=encoding)
    return _read(spark, path)


_NAMED = f"SELECT CAST(c_custkey AS VARCHAR) AS id, concat('{DAMAGED} ', c_name) AS name FROM customer"


@reads("read_windows_1252", _NAMED)
def read_windows_1252(spark, d):
    return _encoded(spark, d, "western", "ISO-8859-1")


@reads("read_utf16", _NAMED)
def read_utf16(spark, d):
    return _encoded(spark, d, "wide", "UTF-16LE")


@reads("read_mojibake", _NAMED)
def read_mojibake(spark, d):
    damaged = F.decode(F.encode(F.concat(F.lit(DAMAGED + " "), "name"), "UTF-8"), "ISO-8859-1")
    return _read(spark, _saved(spark, "damaged", _customers(spark, d).select("k", F.concat_ws(",", F.col("id"), damaged).alias("value")), ["id,name"]))


@reads("read_mojibake_not_all", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN 'Köln' ELSE 'cafÃ©' END AS name FROM customer")
def read_mojibake_not_all(spark, d):
    """One sound name shows that the rest is meant as it stands: the file decides, not the cell."""
    rows = _customers(spark, d)
    last = rows.agg(F.max("k")).first()[0]
    return _read(spark, _saved(spark, "sound", rows.select("k", F.concat_ws(",", F.col("id"), F.when(F.col("k") == last, "Köln").otherwise("cafÃ©")).alias("value")), ["id,name"]))


@reads("read_limits", "SELECT count(*) > 100 AS refused_rows, false AS refused_columns, count(*) AS n FROM customer")
def read_limits(spark, d):
    path = _saved(spark, "limits", _joined(_customers(spark, d)), ["id,name,segment"])

    def refused(**limits) -> bool:
        try:
            read_delimited(spark, path, **limits)
        except TooLarge:
            return True
        return False

    told = _read(spark, path).agg(F.count(F.lit(1)).alias("n"))
    return told.select(F.lit(refused(most_rows=100)).alias("refused_rows"), F.lit(refused(most_columns=3)).alias("refused_columns"), "n")


@reads("read_samples", "SELECT 'region' AS name, 'r_name' AS col, count(*) AS n FROM region UNION ALL SELECT 'nation', 'n_name', count(*) FROM nation")
def read_samples_folder(spark, d):
    """A folder of tables and other things: files are told by their extension."""
    folder = _place(spark, "samples")
    fs = spark._jvm.org.apache.hadoop.fs
    for table, file in (("region", "region.csv"), ("nation", "nation.TSV"), ("region", "notes.json")):
        sep = "\t" if file.endswith("TSV") else ","
        made = _place(spark, file)
        spark.read.parquet(f"{d}/{table}.parquet").select(f"{table[0]}_{table}key", f"{table[0]}_name").coalesce(1).write.csv(made, header=True, sep=sep)
        files = fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        part = next(p.getPath() for p in files.listStatus(fs.Path(made)) if p.getPath().getName().startswith("part-"))
        files.mkdirs(fs.Path(folder))
        files.rename(part, fs.Path(f"{folder}/{file}"))
    told = None
    for name, df in read_samples(spark, folder).items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(df.columns[2]).alias("col"), "n")
        told = one if told is None else told.unionByName(one)
    return told


@reads("csv_round_trip", f"SELECT {_KEYS} FROM customer")
def csv_round_trip(spark, d):
    """Written as one file with a header by the library's own sink, and read again."""
    path = _place(spark, "trip")
    write_csv(_customers(spark, d).withColumnRenamed("k", ROW), path, single=True)
    return _read(spark, path)


@reads("csv_parts_round_trip", f"SELECT {_KEYS} FROM customer")
def csv_parts_round_trip(spark, d):
    """Written as parts in row order without a header in them, and read again by the manifest's names."""
    from gristmill.sources.sinks import read_parts

    path = _place(spark, "parts")
    write_csv(_customers(spark, d).withColumnRenamed("k", ROW), path)
    return read_parts(spark, path).drop(ROW)
