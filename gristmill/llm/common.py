"""What the operators of this package share: the folder for cut lineage, and table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words in every operator here: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); only where none is set, a temporary one, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gristmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    _WRITTEN.add(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``table`` wrote, once all that is made of them is written too. Others are left alone."""
    for df in tables:
        if path := getattr(df, "_written", None):
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every table written by ``table`` that is still there: for callers who are done with all results."""
    for path in sorted(_WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.discard(path)


BATCH = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Let at most about ``BATCH`` bytes go to a Python worker at once, however long texts are."""
    conf = df.sparkSession.conf
    for name in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxBytesPerOutputBatch"):
        if not 0 < _bytes(conf.get(name)) <= BATCH:
            conf.set(name, f"{BATCH}b")
    return df


def _bytes(size: str) -> int:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = size.strip().lower().removesuffix("b") or "0"
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold_ascii(column) -> F.Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
