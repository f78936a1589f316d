"""Vector compression: each part of a vector becomes the index of its nearest entry in an integer codebook of that part.

A codebook has a fixed number of entries, so it is broadcast whatever the number of vectors. Tasks compute the distances of a
batch by norms and an int64 matrix product, exactly, and keep sums of the parts by entry; a grouped shuffle merges the tasks'
sums, of which only the codebook's next entries reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratersight.llm import scratch
from ratersight.llm.linkage import bounded

#: Rows whose distances are held at a time: with 256 entries, 8 MB.
ROWS = 4096


@dataclass(frozen=True)
class Settings:
    """parts: of a vector, each with a codebook. entries: of a codebook, at first those of the vectors with the least ids.
    rounds: of assigning and averaging. scale: a component x counts as floor(scale * x)."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024

    def cuts(self, size: int) -> list[tuple[int, int]]:
        """Where the parts of a vector begin and end; they are equal if the size allows."""
        return [(size * i // self.parts, size * (i + 1) // self.parts) for i in range(self.parts)]

    def largest(self, size: int) -> int:
        """The largest integer component for which distances surely fit in 64 bits."""
        return int((2**60 / max(b - a for a, b in self.cuts(size))) ** 0.5)


def finite(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length over 0 that hold neither nulls nor non-finite components."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == size)
        own = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
        ok = np.isfinite(own).all(axis=1)
        if ok.any():
            yield at[ok], own[ok]


def _whole(s: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, label, vector) as (id, label, size, q), q being the integer components' bytes."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in finite(batch.column(2)):
                size, q = x.shape[1], np.floor(x * s.scale)
                if np.abs(q).max() > s.largest(size):
                    raise ValueError(f"a component beyond {s.largest(size) / s.scale}: distances need more than 64 bits")
                rows = pa.array(at)
                cells = [r.tobytes() for r in q.astype("<i8")]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(at), size, np.int32)), pa.array(cells, pa.binary())], names=["id", "label", "size", "q"])

    return whole


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of an integer codebook for each row; of several the first."""
    index, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    norms, turned = (book * book).sum(axis=1), np.ascontiguousarray(book.T)
    for i in range(0, len(x), ROWS):
        own = x[i : i + ROWS]
        apart = norms - 2 * np.einsum("nw,wk->nk", own, turned)
        best = apart.argmin(axis=1)
        index[i : i + ROWS] = best
        least[i : i + ROWS] = apart[np.arange(len(own)), best] + (own * own).sum(axis=1)
    return index, least


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, size)


def _sums(s: Settings, size: int, books) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (q), a task's sums of the parts nearest to each entry: (part, entry, n, s0, s1, ...)."""
    cuts = s.cuts(size)
    width = max(b - a for a, b in cuts)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        n = [np.zeros(len(b), np.int64) for b in own]
        sums = [np.zeros((len(b), width), np.int64) for b in own]
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(0), size)
            for p, (a, b) in enumerate(cuts):
                x = q[:, a:b]
                index, _ = nearest(x, own[p])
                order = np.argsort(index, kind="stable")
                names, starts, many = np.unique(index[order], return_index=True, return_counts=True)
                n[p][names] += many
                sums[p][names, : b - a] += np.add.reduceat(x[order], starts, axis=0)
        for p in range(len(own)):
            used = np.flatnonzero(n[p])
            if len(used):
                columns = [np.full(len(used), p, np.int32), used.astype(np.int32), n[p][used], *sums[p][used].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    return add


def _assign(s: Settings, size: int, books) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, label, q) as (id, label, code, error)."""
    digits = max(2, len(f"{s.entries - 1:x}"))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, codes, error = _matrix(batch.column(2), size), [], 0
            for p, (a, b) in enumerate(s.cuts(size)):
                index, least = nearest(q[:, a:b], books.value[p])
                codes.append([f"{i:0{digits}x}" for i in index.tolist()])
                error = error + least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map("".join, zip(*codes)), pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return assign


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", settings: Settings = Settings()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row of vectors that is kept.

    Rows whose vector is null, empty or holds null or non-finite components are dropped, as are those of another length than
    most vectors have (of lengths as common, the longest). code: the parts' indexes in hex. error: squared distances of the
    parts from their entries, in integer components. label_error: the error of all rows with that label, nulls together.
    codebooks_sha256: of all entries' components, comma-joined. Repeated ids and vectors count each by itself; at the start
    null ids come last, and equal ids in the order of their components. Ties go to the lower index. With fewer rows than
    entries the codebooks have as many as there are rows. Other columns are ignored, whatever their names. An empty table
    gives an empty result. A component so large that distances exceed 64 bits is an error.

    A label's total is joined back to its rows: broadcast if a count allows, else by a shuffled join, whose hot labels
    adaptive execution splits."""
    s, spark = settings, vectors.sparkSession
    kind = vectors.schema[label].dataType.simpleString()
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    kept = scratch.table(rows.mapInArrow(_whole(s), f"id long, label {kind}, size int, q binary"), "vectors")
    size = kept.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = size.size if size else s.parts
    kept = kept.filter(F.col("size") == size)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "q").select("q").limit(s.entries).collect()
    start = np.array([np.frombuffer(r.q, "<i8") for r in first], np.int64).reshape(-1, size)
    books = [start[:, a:b] for a, b in s.cuts(size)]
    width = max(b - a for a, b in s.cuts(size))
    for _ in range(s.rounds if len(start) else 0):
        told = spark.sparkContext.broadcast(books)
        schema = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(width))
        sums = kept.select("q").mapInArrow(_sums(s, size, told), schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(width)))))
        books = [b.copy() for b in books]
        for r in sums.collect():  # a row for each entry at most
            books[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(books[r.part].shape[1])]
        told.destroy()
    told = spark.sparkContext.broadcast(books)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    own = scratch.table(kept.select("id", "label", "q").mapInArrow(_assign(s, size, told), f"id long, label {kind}, code string, error long"), "codes")
    totals = scratch.table(own.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "totals")
    out = own.join(bounded(totals), F.col("label").eqNullSafe(F.col("of_label")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(s: Settings = Settings()) -> str:
    """The query in DuckDB's SQL: rounds are unrolled, sums of integers below 2^53 are exact in doubles."""
    dot = lambda a, b: f"list_inner_product({a}, {b})"
    ctes = [
        f"kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({s.scale} * cast(x as double))) as q from embeddings where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))))",
        f"p as materialized (select vec_id, label, part, q[part * len(q) // {s.parts} + 1 : (part + 1) * len(q) // {s.parts}] as x from kept, range({s.parts}) as t(part))",
        f"b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as c from p qualify entry < {s.entries})",
    ]
    for i in range(s.rounds + 1):
        ctes.append(f"a{i} as materialized (select vec_id, label, p.part, any_value(x) as x, min(cast({dot('x', 'x')} - 2 * {dot('x', 'c')} + {dot('c', 'c')} as bigint) * {s.entries} + entry) as best from p join b{i} using (part) group by vec_id, label, p.part)")
        ctes.append(f"u{i} as (select part, best % {s.entries} as entry, unnest(x) as v, unnest(range(len(x))) as k from a{i}), m{i} as (select part, entry, list(v order by k) as c from (select part, entry, k, floor(sum(v) / count(*)) as v from u{i} group by part, entry, k) group by part, entry), b{i + 1} as materialized (select b.part, b.entry, coalesce(m.c, b.c) as c from b{i} b left join m{i} m on m.part = b.part and m.entry = b.entry)")
    n = s.rounds
    return f"""with {', '.join(ctes)},
f as (select sha256(string_agg(cast(cast(v as bigint) as varchar), ',' order by part, entry, k)) as books from (select part, entry, unnest(c) as v, unnest(range(len(c))) as k from b{n})),
e as (select vec_id, label, string_agg(format('{{:02x}}', best % {s.entries}), '' order by part) as code, cast(sum(best // {s.entries}) as bigint) as error from a{n} group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, books as codebooks_sha256 from e, f"""
