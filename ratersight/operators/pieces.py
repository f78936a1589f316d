"""Rows of outer levels (patients) in pieces that no task splits, so that sums of inner levels (visits) need no shuffle.

A piece holds whole inner levels. Most outer levels are one piece, -1; those of many rows are cut into pieces 0, 1, ... by the
hash of the inner level, so no task gets a whole large one. `gathered` writes a row for each piece; as rows are taken out of it
in the task that reads it, a piece's rows follow each other there until the next shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratersight.sources.stages import kept

#: Rows of an outer level beyond which it is cut.
PIECE_ROWS = 20_000


def marked(df: DataFrame, outer: str, inner: str | None, rows: int | None = None) -> DataFrame:
    """df with `piece`. Without inner levels, large outer ones are cut anywhere."""
    rows = rows or PIECE_ROWS
    large = df.groupBy(F.col(outer).alias("large")).agg(F.ceil(F.count("*") / rows).alias("pieces")).filter("pieces > 1")
    large = kept(large, "large")  # a row for each `rows` rows of df at most
    if large.isEmpty():
        # no literal, which Spark would leave out of keys, so that rows dealt by (outer, piece) would be shuffled for them again
        return df.withColumn("piece", (F.pmod(F.xxhash64(outer), F.lit(1)) - 1).cast("int"))
    cut = F.pmod(F.xxhash64(*([inner] if inner else df.columns)), F.col("pieces"))
    out = df.join(F.broadcast(large), F.col(outer).eqNullSafe(F.col("large")), "left")
    return out.withColumn("piece", F.coalesce(cut, F.lit(-1)).cast("int")).drop("large", "pieces")


def gathered(df: DataFrame, outer: str, label: str) -> DataFrame:
    """df, which has `piece`, as written with a row for each piece and read back row by row."""
    own = df.groupBy(outer, "piece").agg(F.collect_list(F.struct(*(c for c in df.columns if c not in (outer, "piece")))).alias("rows"))
    return kept(own, label).select(outer, "piece", F.explode("rows").alias("row")).select(outer, "piece", "row.*")


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the ones before them."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(out)


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that tell a column's values apart."""
    own = column.combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    return pc.dictionary_encode(own, null_encoding="encode").indices.to_numpy()


def whole(batches: Iterable[pa.RecordBatch], outer: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where pieces begin) of whole pieces, of about a batch: the last piece of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        begin = changes(codes(t.column(outer)), t.column("piece").to_numpy())
        if begin[-1]:
            yield t.slice(0, begin[-1]), begin[:-1]
        held = t.slice(begin[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held), np.zeros(1, int)
