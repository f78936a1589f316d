"""Benchmark items inside documents: exact hits of pieces propose places, bit-parallel edit distance verifies them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratersight.llm import scratch
from ratersight.llm.hashing import U64, Rolling, chunks

_GAPS = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Settings:
    """percent: edits allowed for every 100 code points of an item. Items so short that this is none are looked for without
    edits, where whole words bound them. block_bytes: bytes of items that are searched for at a time, and sent to every task."""

    percent: float = 5.0
    block_bytes: int = 8 << 20


def normal(text: str | None) -> str:
    """Lower-case letters and digits, with one space between runs of them."""
    return _GAPS.sub(" ", (text or "").lower()).strip()


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item in edits + 1 pieces (offset, piece) of nearly equal length; so many edits leave one of them whole."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(lo, item[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    """For each character, the bits of the places where the item has it."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(where: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """(edits, end): the least edit distance of an item, by its masks, to a substring of text, and that one's first end.

    Myers' bit vectors of vertical differences; the first row is all zeros, so that a match may start anywhere."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        right, left = minus | ~(d | plus) & full, plus & d
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = right << 1 & full
        left = left << 1 & full
        plus, minus = left | ~(x | right) & full, right & x
        if score < best:
            best, end = score, j
    return best, end


class Finder:
    """Finds items (id, text) in texts, each within its own error budget."""

    def __init__(self, items: list[tuple[object, str]], settings: Settings):
        self.items = []
        self.heads: dict[bytes, list[tuple[int, int, bytes]]] = {}  # the first bytes of a piece -> (item, offset, piece)
        for key, text in items:
            text = normal(text)
            if edits := int(len(text) * settings.percent / 100):
                self.items.append((key, text, edits, masks(text)))
            elif text:
                self.items.append((key, f" {text} ", 0, masks(f" {text} ")))
        own = [(i, at, p.encode()) for i, (_, text, edits, _) in enumerate(self.items) for at, p in pieces(text, edits)]
        self.width = min((len(p) for *_, p in own), default=1)
        for i, at, p in own:
            self.heads.setdefault(p[: self.width], []).append((i, at, p))
        self.bits = max(16, int(len(own)).bit_length() + 6)
        self.filter = np.zeros(1 << self.bits, bool)
        for head in self.heads:
            self.filter[self._slots(head)] = True

    def _slots(self, text: bytes) -> np.ndarray:
        n = len(text) - self.width + 1
        if n <= 0:
            return np.empty(0, np.int64)
        at = np.arange(n)
        return (Rolling(np.frombuffer(text, np.uint8)).of(at, at + self.width) >> U64(64 - self.bits)).astype(np.int64)

    def within(self, texts: list[str]) -> Iterator[tuple[int, object, int, int]]:
        """(text's index, item's id, edits, end) of each item found in each normal text."""
        if not self.items:
            return
        for first, run in chunks(f" {t} ".encode() for t in texts):  # so that words at the ends are bounded too
            joined = b"\n".join(run)
            hits = np.flatnonzero(self.filter[self._slots(joined)])
            if not len(hits):
                continue
            begins = np.cumsum([0, *(len(t) + 1 for t in run[:-1])])
            places: dict[tuple[int, int], list[int]] = {}
            for hit in hits.tolist():
                for i, at, piece in self.heads.get(joined[hit : hit + self.width], ()):
                    if joined.startswith(piece, hit):
                        doc = int(np.searchsorted(begins, hit, "right")) - 1
                        # in code points of the document, where the item would begin
                        places.setdefault((doc, i), []).append(len(joined[begins[doc] : hit].decode()) - at)
            for (doc, i), starts in places.items():
                key, item, edits, where = self.items[i]
                text = f" {texts[first + doc]} "
                reach: list[list[int]] = []  # the windows around the hits, overlapping ones as one
                for start in sorted(starts):
                    lo, hi = max(0, start - edits), start + len(item) + edits
                    if reach and lo <= reach[-1][1]:
                        reach[-1][1] = hi
                    else:
                        reach.append([lo, hi])
                best, end = edits + 1, 0
                for lo, hi in reach:
                    found, at = best_end(where, len(item), text[lo:hi])
                    if found < best:
                        best, end = found, lo + at
                if best <= edits:
                    yield first + doc, key, best, min(max(end - 1, 0), len(texts[first + doc]))


def _find(items: list[tuple[object, str]], settings: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items, settings)
        for batch in batches:
            rows = list(finder.within([normal(t) for t in batch.column(1).to_pylist()]))
            at, item, edits, end = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(edits, pa.int32()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "edits", "end"])

    return find


def _clean(items: list[tuple[object, str]], settings: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items, settings)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keep = np.ones(len(texts), bool)
            keep[[at for at, *_ in finder.within([normal(t) for t in texts])]] = False
            yield batch.filter(pa.array(keep))

    return clean


def _blocks(benchmark: DataFrame, settings: Settings) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_bytes, each small enough to be sent to every task."""
    scratch.short_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(size) // settings.block_bytes
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [tuple(r) for r in own.collect()]


def contaminations(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, edits, end) for each item of benchmark (item_id, text) that a document (doc_id, text) holds.

    Both are compared as lower-case letters and digits with single spaces. edits: the least edit distance of the item to
    a passage of the document; of several such passages, where the first of them ends in the normal text is `end`. Items so
    short that they have no edits are found as whole words. Null and empty texts of either side match nothing, nor do texts
    without letters or digits. Repeated rows of a document or an item, and rows with a null id, give rows of their own. Other
    columns are ignored, whatever their names. Very long texts are searched whole. Items are searched for in blocks of a
    bounded size, whatever the benchmark's size; all documents are read once for each block. Empty tables give an empty
    result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [docs.mapInArrow(_find(block, settings), "doc_id long, item_id long, edits int, end long") for block in _blocks(benchmark, settings)]
    return reduce(DataFrame.union, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay. Rows with a null doc_id are judged by their text.

    The search itself drops rows, so no text is shuffled."""
    out = docs
    for block in _blocks(benchmark, settings):
        out = out.mapInArrow(_clean(block, settings), docs.schema)
    return out
