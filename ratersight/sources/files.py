"""Scans of tables and texts that lie in folders, and what their paths tell."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratersight.functions import text as X
from ratersight.sources import trees
from ratersight.sources.stages import kept


def prediction_name(prefix: str) -> str:
    """The pattern of a prediction file's name, with its item and run; the name begins with the prefix."""
    return rf"^{re.escape(prefix)}(\d+)_output_(\d+)\.json$"


def part(path: Column, back: int) -> Column:
    """The component of a path that is `back` from its end (1: the file's name); null where the path is shorter."""
    return F.try_element_at(F.split(path, "/"), F.lit(-back))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, in a stated schema; fields that don't fit it are null."""
    return spark.read.schema(schema).csv(path, header=True)


def csv_texts(spark: SparkSession, path: str, key: str, prefix: str = "") -> DataFrame:
    """A CSV file's columns as strings, with `key` from the prefix and the column of that name."""
    own = spark.read.csv(path, header=True, inferSchema=False)
    return own.withColumn(key, F.concat(F.lit(prefix), F.col(key)))


def paths(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(patient, session, path) of the files below root whose names fit glob, one row a file, from their paths alone.

    Files of no bytes count as absent; blank ones are failures."""
    return _placed(trees.paths(spark, root, glob))


def _placed(own: DataFrame) -> DataFrame:
    path = F.col("path")
    return own.select(part(path, 3).alias("patient"), part(path, 2).alias("session"), *own.columns)


def _read(spark: SparkSession, root: str, own: DataFrame) -> DataFrame:
    """(patient, session, path, text) of the files of own (path). Malformed UTF-8 is replaced."""
    return _placed(trees.contents(spark, root, own)).withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).drop("content")


def texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(patient, session, path, text) of the files of paths(), each read whole."""
    return _read(spark, root, trees.paths(spark, root, glob))


def first_texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Of each session's files the one with the least path."""
    return _read(spark, root, paths(spark, root, glob).groupBy("patient", "session").agg(F.min("path").alias("path")))


def named_texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Each session's file of one fixed name, such as an item's segment."""
    return texts(spark, root, name)


def unprocessed(spark: SparkSession, root: str, glob: str, done: DataFrame) -> DataFrame:
    """texts() of the files whose paths are not in done (path) yet."""
    return _read(spark, root, pending(paths(spark, root, glob), done, ["path"]))


def predictions(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """indexed() texts of the prediction files below root."""
    return indexed(texts(spark, root, "*.json"), prefix)


def indexed(own: DataFrame, prefix: str) -> DataFrame:
    """(patient, session, item, run, rating, explanation) of texts (patient, session, path, text) of predictions, whose files'
    names begin with the prefix; other files are left out."""
    pattern = prediction_name(prefix)
    own = own.withColumn("name", part(F.col("path"), 1)).filter(F.col("name").rlike(pattern))
    number = lambda i: F.regexp_extract("name", pattern, i).cast("int")
    return own.select("patient", "session", number(1).alias("item"), number(2).alias("run"), X.rating(F.col("text")).alias("rating"), X.explanation(F.col("text")).alias("explanation"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def _filled(lines: DataFrame) -> DataFrame:
    return lines.select(F.trim("value").alias("line"), "path").filter("line <> ''")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """listed_sessions() of the lines of manifests."""
    return listed_sessions(_lines(spark, path))


def listed_sessions(lines: DataFrame) -> DataFrame:
    """(item, session) of lines (value, path) with a path of a session's file on each; the item is the number in the name of
    the file that a line stands in."""
    item = F.regexp_extract(part(F.col("path"), 1), r"(\d+)", 1).try_cast("int")
    return _filled(lines).select(item.alias("item"), part(F.col("line"), 2).alias("session")).filter("session is not null").distinct()


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """The last components of the lines of exclusion lists, each once."""
    return _filled(_lines(spark, path)).select(part(F.col("line"), 1).alias("session")).distinct()


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of wanted whose keys are not done yet."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def sheets(spark: SparkSession, path: str, expected: list[int]) -> DataFrame:
    """The sheets that sinks.write_sheets() left, as one table of strings with the item of each sheet's name; warns of
    expected items that have no sheet. Columns that a sheet lacks are null."""
    own = spark.read.option("header", "true").option("mergeSchema", "true").csv(path)
    out = own.withColumn("item", F.regexp_extract("sheet", r"^(\d+)", 1).try_cast("int")).drop("sheet")
    there = {r.item for r in out.select("item").distinct().collect()}
    for item in expected:
        if item not in there:
            warnings.warn(f"no sheet of item {item}", stacklevel=2)
    return out


def blups(spark: SparkSession, path: str) -> DataFrame:
    """Item effects as sinks.write_table() left them, the level as an int."""
    own = csv_table(spark, path, "stratum string, factor string, level string, dev double, dev_low double, dev_high double, total double")
    return own.withColumn("level", F.col("level").try_cast("int"))


def bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a bundle that sinks.write_bundle() left, by name."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that sinks.write_snapshot() left."""
    return bundle(spark, path, ["seeds", "effects", "items", "reports"])


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of sheets as strings with their place in their sheet, from 1, in the order of its files' names and lines.

    A block of a file is read in order by one task, so a row's number in its block tells its place beside the rows of the
    blocks before: one row for each block is added up, and no sheet is sorted."""
    own = spark.read.option("header", "true").option("mergeSchema", "true").csv(path)
    own = kept(own.withColumns({"file": F.col("_metadata.file_name"), "block": F.col("_metadata.file_block_start"), "at": F.monotonically_increasing_id()}), "rows")
    blocks = own.groupBy("sheet", "file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("sheet").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("sheet", "file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return own.join(F.broadcast(blocks), ["sheet", "file", "block"]).withColumn("place", F.col("at") + F.col("shift")).drop("file", "block", "at", "shift")


def report_terms(lines: DataFrame) -> DataFrame:
    """(part, term, estimate, se) of a report's lines (no, line): a line in brackets heads a part, lines of a name and two
    numbers are its terms; the intercept and all other lines are left out. A report is a small table."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    row = rf"^(\S+)\s+{number}\s+{number}(?:\s.*)?$"
    head = F.nullif(F.regexp_extract("line", r"^\[(.+)\]$", 1), F.lit(""))
    own = lines.withColumn("part", F.last(head, ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("no"))).filter(F.col("line").rlike(row))
    cell = lambda i: F.regexp_extract("line", row, i)
    return own.select("part", cell(1).alias("term"), cell(2).cast("double").alias("estimate"), cell(3).cast("double").alias("se")).filter("term <> '(Intercept)'")
