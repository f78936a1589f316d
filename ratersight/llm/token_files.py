"""Token-id files: one zstandard frame for each document, then an index of documents, then a seek table with checksums.

A shard is a plain zstandard stream: decompressed as a whole it gives the ids of its documents, little-endian unsigned 32
bits each. The last two frames are skippable. The first of them holds the documents' ids, the second is the seek table of
the public seekable format: for each frame its compressed and decompressed size and the low half of its XXH64; a footer
tells the number of frames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratersight.llm import scratch
from ratersight.llm.files import Ranges, writing
from ratersight.llm.tokens import encoder

#: Magic numbers of skippable frames and of the seek table's footer, and its descriptor for checksums.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_FOOTER = struct.Struct("<IBI")
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])
_DOC = np.dtype([("known", "<u4"), ("doc_id", "<i8")])


#: Bytes and documents at which a shard is finished, and documents of one batch of rows that a reader gives. A writer or reader
#: holds a shard's entries, about 30 bytes a document, beside one document's ids.
SHARD_BYTES, SHARD_DOCS, READ_DOCS = 256 << 20, 1 << 20, 1 << 14


class ShardWriter:
    """Appends documents' ids to an open stream; finish() writes the index and the seek table."""

    def __init__(self, out, level: int = 1, most_bytes: int = SHARD_BYTES, most_docs: int = SHARD_DOCS):
        self.most_bytes, self.most_docs = most_bytes, most_docs
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[bool, int]] = []
        self.tokens = self.bytes = 0

    @property
    def full(self) -> bool:
        return self.bytes >= self.most_bytes or len(self.docs) >= self.most_docs

    def add(self, doc_id: int | None, ids: bytes) -> None:
        packed = self.packer.compress(ids)
        self.out.write(packed)
        self.entries.append((len(packed), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.docs.append((doc_id is not None, doc_id or 0))
        self.tokens += len(ids) // 4
        self.bytes += len(packed)

    def finish(self) -> None:
        index = np.array(self.docs, _DOC).tobytes()
        table = np.array(self.entries, _ENTRY).tobytes() + _FOOTER.pack(len(self.entries), WITH_CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index + struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class ShardReader:
    """Reads single documents of a shard by range, and checks each against its checksum."""

    def __init__(self, ranges):
        self.ranges = ranges
        n, descriptor, magic = _FOOTER.unpack(ranges.read(ranges.size - _FOOTER.size, _FOOTER.size))
        if magic != FOOTER_MAGIC or descriptor != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        table_at = ranges.size - _FOOTER.size - n * _ENTRY.itemsize
        index_at = table_at - 8 - n * _DOC.itemsize
        self.entries = np.frombuffer(ranges.read(table_at, n * _ENTRY.itemsize), _ENTRY)
        docs = np.frombuffer(ranges.read(index_at, n * _DOC.itemsize), _DOC)
        self.docs = [d if known else None for known, d in docs.tolist()]
        self.begins = np.concatenate(([0], np.cumsum(self.entries["packed"], dtype=np.int64)))
        if self.begins[-1] != index_at - 8:
            raise ValueError("the seek table does not fit the frames")
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.docs)

    def ids(self, i: int, packed: bytes | None = None) -> bytes:
        """The i-th document's ids; only its own frame is read."""
        size, check = int(self.entries["size"][i]), int(self.entries["sum"][i])
        packed = self.ranges.read(int(self.begins[i]), int(self.entries["packed"][i])) if packed is None else packed
        ids = self.unpacker.decompress(packed, max_output_size=size)
        if len(ids) != size or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"document {i} does not match its checksum")
        return ids

    def all(self, block: int = 1 << 22) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) of every document, read in blocks of about so many bytes."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.begins, self.begins[i] + block, "right")) - 1)
            held = self.ranges.read(int(self.begins[i]), int(self.begins[j] - self.begins[i]))
            for k in range(i, j):
                lo = int(self.begins[k] - self.begins[i])
                yield self.docs[k], self.ids(k, held[lo : lo + int(self.entries["packed"][k])])
            i = j


def _write(folder: str, tokenizer: str, end_id: int, most_bytes: int, most_docs: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = struct.pack("<I", end_id)

    def shard_of(part: int, no: int, docs: Iterator[tuple[int | None, str]]) -> pa.RecordBatch | None:
        """One shard of the next documents, as far as its bounds allow; None where there are no more."""
        encode = encoder(tokenizer).encode
        first = next(docs, None)
        if first is None:
            return None
        name = f"shard-{part:06d}-{no:05d}.zst"
        with writing(folder, name) as out:
            shard = ShardWriter(out, most_bytes=most_bytes, most_docs=most_docs)
            shard.add(first[0], encode(first[1]) + end)
            while not shard.full and (row := next(docs, None)) is not None:
                shard.add(row[0], encode(row[1]) + end)
            shard.finish()
        numbers = {"part": pa.array([part], pa.int32()), "no": pa.array([no], pa.int32()), "name": [name], "n_docs": pa.array([len(shard.docs)], pa.int64()), "n_tokens": pa.array([shard.tokens], pa.int64())}
        return pa.RecordBatch.from_pydict(numbers)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = ((doc, text.as_py() or "") for batch in batches for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)))
        part, no = TaskContext.get().partitionId(), 0
        while (row := shard_of(part, no, docs)) is not None:
            yield row
            no += 1

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, most_bytes: int = SHARD_BYTES, most_docs: int = SHARD_DOCS) -> DataFrame:
    """Write docs (doc_id, text) as shards in ascending doc_id order; a manifest (part, no, name, n_docs, n_tokens, start).

    start: ids in all shards before. Null texts are empty and hold the end id alone. Null ids come first; rows that share
    a doc_id follow each other, ordered by text. Texts of any length are one document each; other columns are ignored,
    whatever their names. An empty table gives an empty manifest. A part is a range of doc_id and is written by one task, as
    shards of most_bytes or most_docs at most but for their last document, so what a task holds doesn't grow with its
    part. Starts are added up within parts, and of parts, of which there are as many as the session's shuffle partitions."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = docs.repartitionByRange(scratch.parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = scratch.table(ranged.mapInArrow(_write(folder, tokenizer, end_id, most_bytes, most_docs), "part int, no int, name string, n_docs long, n_tokens long"), "manifest")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(upto(Window.orderBy("part"))), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(upto(Window.partitionBy("part").orderBy("no"))), F.lit(0))
    own = shards.withColumn("start", within).join(F.broadcast(parts), "part")  # a row for each part
    return scratch.table(own.select("part", "no", "name", "n_docs", "n_tokens", (F.col("start") + F.col("before")).alias("start")), "starts")


def _read(folder: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(held: list[tuple[int | None, int, int]], start: int) -> pa.RecordBatch:
        docs, counts, sums = zip(*held)
        n = np.array(counts, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ranges = Ranges(folder, name)
                held: list[tuple[int | None, int, int]] = []
                for doc, ids in ShardReader(ranges).all():
                    held.append((doc, len(ids) // 4, zlib.crc32(ids)))
                    if len(held) == READ_DOCS:
                        yield rows(held, start)
                        start += sum(n for _, n, _ in held)
                        held = []
                ranges.close()
                if held:
                    yield rows(held, start)

    return read


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards of a manifest; each frame is verified."""
    shards = manifest.select("name", "start").repartition(scratch.parts(spark), "name")
    return shards.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(folder: str, name: str, index: int) -> np.ndarray:
    """The ids of one document of a shard; reads the tables at the end and the document's own frame."""
    ranges = Ranges(folder, name)
    ids = np.frombuffer(ShardReader(ranges).ids(index), "<u4")
    ranges.close()
    return ids
