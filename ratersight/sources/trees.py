"""Trees of many small files, written, listed and read by tasks: the driver holds no names, and its work doesn't grow with them.

Spark's own writer and reader send each folder and file to the driver, which renames and lists them one by one."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratersight.sources.stages import kept

#: Files or folders that one task takes on, and bytes of texts that it gives at once; a file is held whole.
TASK_FILES, BATCH_BYTES = 2_000, 8 << 20
#: Characters that Spark, too, writes as codes in names of folders.
_CODED = r"""[\x00-\x1f"#%'*/:=?\\{\[\]^\x7f]"""


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    root = root if ":" in root else os.path.abspath(root)
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else root.replace(":/", ":///", 1))


def tasks(spark: SparkSession, rows: int) -> int:
    """As many tasks as rows of files or folders ask for, one a core at least."""
    return max(1, min(rows, spark.sparkContext.defaultParallelism), -(-rows // TASK_FILES))


def bucket(key: str, buckets: int) -> Column:
    """A number below `buckets` by a key: that of the partition in which repartition(buckets, key) puts the row."""
    return F.pmod(F.hash(key), F.lit(buckets))


def _writer(root: str, folders: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        coded = lambda v: "__HIVE_DEFAULT_PARTITION__" if v is None else re.sub(_CODED, lambda m: f"%{ord(m[0]):02X}", v)
        for batch in batches:
            for *names, text in zip(*(c.to_pylist() for c in batch.columns)):
                folder = "/".join([base, *(f"{f}={coded(v)}" for f, v in zip(folders, names))])
                system.create_dir(folder, recursive=True)
                draft = f"{folder}/.text.{os.getpid()}"  # a task's second attempt replaces the file whole
                with system.open_output_stream(draft) as out:
                    out.write(text + b"\n")
                system.move(draft, f"{folder}/text.txt")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return write


def write(df: DataFrame, root: str, folders: list[str], text: str) -> int:
    """A file text.txt for each row, with its text and a line end, in folders named by columns as Spark's partitionBy() names
    them; no two rows may share a folder. Files are written by the tasks of df. Returns their number."""
    own = df.select(*(F.col(f).cast("string").alias(f) for f in folders), F.coalesce(F.col(text), F.lit("")).cast("binary").alias(text))
    return own.mapInArrow(_writer(root, folders), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _lister(root: str, glob: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    hidden = lambda n: n.startswith(".") or (n.startswith("_") and "=" not in n) or n.endswith("._COPYING_")

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [(f"{folder}/{e.base_name}", e.type == fs.FileType.Directory, e.size) for e in system.get_file_info(fs.FileSelector(base + folder)) if not hidden(e.base_name)]
                found = [(path, inner) for path, inner, size in found if inner or (size and fnmatchcase(path.rsplit("/", 1)[1], glob))]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([i for _, i in found], pa.bool_())], names=["path", "inner"])

    return entries


def paths(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path) of the files below root whose names fit glob (*, ? and [...]), without empty ones and what Spark takes as hidden.

    Folders are listed level by level, each by one task, and a level's folders are dealt over as many tasks as they ask for."""
    root, level, found = root.rstrip("/"), spark.createDataFrame([("",)], "path string"), None
    n = 1
    while n:
        seen = kept(level.repartition(tasks(spark, n), "path").mapInArrow(_lister(root, glob), "path string, inner boolean"), "listed")
        files = seen.filter("not inner").select("path")
        found = files if found is None else found.union(files)
        level = seen.filter("inner").select("path")
        n = level.count()
    return found.select(F.concat(F.lit(root), "path").alias("path"))


def _reader(root: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary())], names=["path", "content"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(base + path[len(root) :]) as f:
                    held.append((path, f.read()))
                size += len(held[-1][1])
                if size >= BATCH_BYTES:
                    yield rows(held)
                    held, size = [], 0
        yield rows(held)

    return read


def contents(spark: SparkSession, root: str, own: DataFrame) -> DataFrame:
    """(path, content) of the files of paths() below root that are in own (path), each read whole."""
    own = kept(own.select("path"), "paths")
    return own.repartition(tasks(spark, own.count()), "path").mapInArrow(_reader(root.rstrip("/")), "path string, content binary")
