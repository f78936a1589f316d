"""Shared scratch tables: lineage is cut by writing Parquet to the folder that all executors see."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By session: temporary folders, and paths that were given out.
_own: dict[int, str] = {}
_made: dict[int, list[str]] = {}


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new temporary one, on a local master alone."""
    short_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if id(spark) not in _own:
            _own[id(spark)] = "file://" + tempfile.mkdtemp(prefix="ratersight-")
            atexit.register(shutil.rmtree, _own[id(spark)].removeprefix("file://"), ignore_errors=True)
        found = _own[id(spark)]
    return found.rstrip("/")


#: Rows of one Arrow batch; whole texts are long, and a batch of them is held several times on its way.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, which hold whole texts, to BATCH_ROWS rows, unless they are smaller."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh(spark: SparkSession, label: str) -> str:
    """A new, unused path below root()."""
    path = f"{root(spark)}/ratersight-{label}-{uuid.uuid4().hex}"
    _made.setdefault(id(spark), []).append(path)
    return path


def table(df: DataFrame, label: str) -> DataFrame:
    """Write df once and return a reader of what was written; a lost executor then costs no recomputation."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete this session's scratch tables; DataFrames that read them must be done with. For the caller to say: a query's
    result is read from them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    made = _made.pop(id(spark), [])
    while made:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(conf).delete(path, True)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
