"""Best-fit packing planned on a histogram of lengths; pieces then take the planned slots by their rank within a length."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratersight.llm import scratch
from ratersight.llm.linkage import bounded
from ratersight.llm.tokens import encoder


def best_fit(counts: Mapping[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Best-fit decreasing over counts of lengths: for each length, rows (first rank, first sequence, offset) by rank.

    From its first rank to the next row's, each piece takes one sequence more than the piece before it. Sequences of equal
    room are held as ranges, so the plan's size follows the number of lengths (capacity at most), not that of pieces."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences (first, number)
    rooms = 0  # bit r: some sequence has room r
    made = 0
    plan: dict[int, list[tuple[int, int, int]]] = {}

    def give(r: int, first: int, n: int) -> None:
        nonlocal rooms
        if r and n:
            room.setdefault(r, []).append((first, n))
            rooms |= 1 << r

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        rows = plan.setdefault(length, [])
        while left:
            fits = rooms >> length
            if fits:
                r = length + (fits & -fits).bit_length() - 1
                first, n = room[r].pop()
                if not room[r]:
                    rooms &= ~(1 << r)
                taken = min(n, left)
                give(r, first + taken, n - taken)
                rows.append((rank, first, capacity - r))
                give(r - length, first, taken)
            else:
                each = capacity // length
                full = left // each
                deep, taken = (each, full) if full else (left, 1)
                for k in range(deep):
                    rows.append((rank + k * taken, made, k * length))
                give(capacity - deep * length, made, taken)
                made += taken
                taken *= deep
            left -= taken
            rank += taken
    return {length: np.array(rows, np.int64).reshape(-1, 3) for length, rows in plan.items()}


def _pieces(tokenizer: str, end_id: int, capacity: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = struct.pack("<I", end_id)

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    own = ids[4 * at : 4 * (first if k == 0 else at + capacity)]
                    rows.append((doc, k, at, len(own) // 4, zlib.crc32(own)))
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def _seat(plan: dict[int, np.ndarray]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def seat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                rows = plan[int(length[own[0]])]
                at = np.searchsorted(rows[:, 0], rank[own], "right") - 1
                sequence[own] = rows[at, 1] + rank[own] - rows[at, 0]
                offset[own] = rows[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return seat


#: Parts of each length that are ranked apart, at least, and pieces in all for each of them.
SALTS, SALT_ROWS = 64, 1_000_000


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and end_id; null and empty texts are end_id alone. Only documents of more ids than
    capacity are cut, into pieces of that many, of which the first may be shorter. Repeated rows are packed each on its
    own, and so are rows with a null doc_id. Texts of any length are tokenized whole; other columns are ignored, whatever
    their names. An empty table gives an empty result. The plan is made on the driver from counts of at most `capacity`
    lengths. One length may hold a large share of all pieces, so ranks are counted within salts, SALTS or one for each
    SALT_ROWS pieces; the salts' counts, which are broadcast only where they are few, give each salt its first rank."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.mapInArrow(_pieces(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # by partition and place, so that repeated rows are spread too; written at once, so that they stay as they are
    dealt = scratch.table(pieces.withColumn("salt", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())), "pieces")
    salts = max(SALTS, -(-dealt.count() // SALT_ROWS))
    salted = dealt.withColumn("salt", F.pmod("salt", F.lit(salts)).cast("int"))
    sizes = scratch.table(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "sizes")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(counts, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("rank", within - 1).join(bounded(bases), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_seat(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
