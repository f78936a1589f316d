"""Intermediate tables that several jobs read: written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[int, str] = {}
#: Rows of a few numbers that may be broadcast; larger sides are shuffled.
SMALL_ROWS = 200_000


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, on a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if id(spark) not in _own:
            _own[id(spark)] = "file://" + tempfile.mkdtemp(prefix="ratersight-stages-")
            atexit.register(shutil.rmtree, _own[id(spark)].removeprefix("file://"), ignore_errors=True)
        found = _own[id(spark)]
    return found.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """df as written to the shared folder and read back: what an executor has lost is read again, not computed again."""
    path = f"{folder(df.sparkSession)}/ratersight-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, hinted for broadcast only where a count shows that it is small; it should be cheap to read twice."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
