"""Near-duplicate documents: banded MinHash proposes, odd sketches filter, full shingle sets confirm."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratersight.llm import scratch
from ratersight.llm.hashing import U32, U64, mix, shingle_sets
from ratersight.llm.linkage import bounded, link


@dataclass(frozen=True)
class Settings:
    """percent: link documents with 100 * intersection >= percent * union of their sets of distinct shingles.

    bands * rows MinHash samples propose; a pair at 0.85 is missed by all 26 bands of 5 with a probability of 2.4e-7,
    at 0.8 with 3e-5. bits: size of the odd sketch. slack: standard deviations of its estimate that are given away."""

    words: int = 5
    percent: int = 80
    bands: int = 26
    rows: int = 5
    bits: int = 512
    slack: float = 6.0

    @property
    def cut(self) -> int:
        """Most sketch bits in which a pair at the threshold may differ: the expected number and slack.

        Of k samples, Binomial(k, 1 - J) differ and toggle two bits each; of m toggles in n bits, n/2 (1 - (1 - 2/n)^m)
        remain odd. Both parts vary, and their deviations are joined."""
        k, j, n = self.bands * self.rows, self.percent / 100, self.bits
        m = 2 * k * (1 - j)
        mean = n / 2 * (1 - (1 - 2 / n) ** m)
        of_samples = (1 - 2 / n) ** m * 2 * (k * j * (1 - j)) ** 0.5
        of_bits = (n / 4 * (1 - (1 - 4 / n) ** m)) ** 0.5
        return int(mean + self.slack * (of_samples**2 + of_bits**2) ** 0.5) + 1


def _hashers(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=U64))
    return (seeds[:k] >> U64(32)).astype(U32) | U32(1), (seeds[k:] >> U64(32)).astype(U32)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Rows of MinHash samples as parity bitmaps: each (position, sample) toggles one bit."""
    n, k = samples.shape
    at = mix(samples.astype(U64) | (np.arange(k, dtype=U64) << U64(32))) % U64(bits)
    odd = np.zeros((n, bits), np.uint8)
    np.bitwise_xor.at(odd, (np.arange(n)[:, None], at.astype(np.int64)), 1)
    return np.packbits(odd, axis=1, bitorder="little").view("<i8")


def _sign(s: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    a, b = _hashers(s.bands * s.rows)

    def signed(ids: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, x in enumerate(sets) if len(x)]
        n = len(sets)
        samples = np.empty((len(a), len(full)), U32)
        digests = [hashlib.blake2b(sets[i].tobytes(), digest_size=8).digest() for i in full]
        if full:
            x = (np.concatenate([sets[i] for i in full]) >> U64(32)).astype(U32)
            begins = np.zeros(len(full), np.int64)
            np.cumsum([len(sets[i]) for i in full[:-1]], out=begins[1:])
            for i in range(len(a)):
                np.minimum.reduceat(x * a[i] + b[i], begins, out=samples[i])
        sketch = odd_sketch(np.ascontiguousarray(samples.T), s.bits)
        bands = np.empty((len(full), s.bands), np.int64)
        for i in range(s.bands):
            h = np.full(len(full), U64(i))
            for row in samples[i * s.rows : (i + 1) * s.rows]:
                h = mix(h * U64(0x9E3779B97F4A7C15) + row)
            bands[:, i] = h.view(np.int64)
        key = np.frombuffer(b"".join(digests), "<i8")
        where = np.full(n, -1)
        where[full] = np.arange(len(full))
        at = pa.array(where, mask=where < 0)

        def column(values: np.ndarray) -> pa.Array:
            kind = pa.array(values) if values.ndim == 1 else pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.int64()))
            return kind.take(at)

        return pa.RecordBatch.from_arrays([*ids.columns, pa.array([len(x) for x in sets], pa.int64()), column(key), column(sketch), column(bands)], names=["doc_id", "row", "n_shingles", "hi", "sketch", "bands"])

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, first, size = batch.select([0, 1]), [], 0, 0
            for i, own in enumerate(shingle_sets(batch.column(2).to_pylist(), s.words)):
                held.append(own)
                size += len(own)
                if size > 1 << 17:
                    yield signed(ids.slice(first, len(held)), held)
                    held, first, size = [], i + 1, 0
            if held:
                yield signed(ids.slice(first, len(held)), held)

    return sign


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs (doc_id, text; other columns are ignored).

    Words are runs of other bytes than ASCII white space, A-Z as a-z. A text of fewer words than a shingle has one
    shingle, all of it. Null, empty and blank texts have none (n_shingles 0) and are linked with nothing. Rows of equal
    sets are one node, however many. component_id: the smallest doc_id that links reach; kept: doc_id is that one.
    Repeated rows share a node and so are kept or dropped alike. Rows with a null doc_id are in the components of their
    sets and never kept; a component without any id has none. Different texts that share a doc_id are judged apart. Sets
    are told apart by 64 bits of a digest. An empty table gives an empty result."""
    s = settings
    return _components(docs, settings).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _components(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, row, n_shingles, component, component_id) per row of docs; row: its text's hash, by which rows that share a
    doc_id are told apart; component: a number of its group, null for an empty set; component_id: the group's least id."""
    s = settings
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    signed = scratch.table(signed.mapInArrow(_sign(s), "doc_id long, row long, n_shingles long, hi long, sketch array<long>, bands array<long>"), "signed")
    # a set is known by 64 bits of its digest, whichever ids its rows have
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")
    nodes = signed.filter("hi is not null").groupBy("hi").agg(least, F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = scratch.table(nodes.select(F.col("hi").alias("node"), "least.doc_id", "least.row", "sketch", "bands"), "nodes")

    def fetch(asked: DataFrame) -> DataFrame:
        rows = nodes.select("node", F.col("doc_id").alias("of_doc"), F.col("row").alias("of_row")).join(asked, "node")
        texts = docs.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").alias("payload"))
        own = texts.join(bounded(rows), (F.col("row") == F.col("of_row")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("node", "payload")
        return own.groupBy("node").agg(F.first("payload").alias("payload"))  # repeated rows once

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < s.percent * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= s.percent * (len(x) + len(y) - both)

    buckets = nodes.select(F.explode("bands").alias("key"), "node")
    _, found = link(nodes, buckets, s.cut, fetch, lambda texts: shingle_sets(texts, s.words), linked)
    joined = nodes.select("node", "doc_id").join(found, "node")  # only what is linked
    names = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = joined.join(names, "component").select("node", "component", "component_id")
    of_set = nodes.select("node", "doc_id").join(joined, "node", "left")
    of_set = of_set.select(F.col("node").alias("hi"), F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = signed.select("doc_id", "row", "n_shingles", "hi").join(of_set, "hi", "left")
    return out.select("doc_id", "row", "n_shingles", "component", F.when(F.col("hi").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs, with all its columns, with one row of each group of near-duplicates; rows without shingles stay.

    The row with the smallest doc_id stays, of several with that id the one whose text has the least hash, of rows that are
    equal in both one. Rows with a null doc_id are in the group of their set and stay only where it has no other rows, one
    of them. So different texts that share a doc_id are judged apart. Columns of any names stay as they are."""
    rows = _components(docs, settings).filter("component is not null")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))  # rows with a group's smallest id, nearly always one
    heads = scratch.table(rows.filter(first).groupBy("component", "doc_id", "row").agg(F.count("*").alias("copies")), "heads")
    least = heads.groupBy("component").agg(F.min("row").alias("least"), F.count("*").alias("n")).filter("n > 1")
    second = heads.join(least, "component").filter("row <> least").select("doc_id", "row")
    gone = rows.filter(~first).select("doc_id", "row").distinct().union(second)
    gone = scratch.table(gone.toDF("gone_doc", "gone_row"), "gone")
    repeated = scratch.table(heads.filter("copies > 1").select(F.col("doc_id").alias("gone_doc"), F.col("row").alias("gone_row")), "repeated")
    own = docs.select(F.struct("*").alias("own"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("binary")).alias("row"))
    same = F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("row") == F.col("gone_row"))
    kept = own.join(gone, same, "left_anti")
    if not repeated.isEmpty():
        nth = F.row_number().over(Window.partitionBy("doc", "row").orderBy(F.xxhash64(F.to_json("own"))))
        once = kept.join(repeated, same, "left_semi").withColumn("nth", nth).filter("nth = 1").drop("nth")
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.select("own.*")


def oracle_sql(settings: Settings) -> str:
    """Links and components by all pairs that share a shingle, in DuckDB's SQL."""
    k, percent = settings.words, settings.percent
    return f"""with recursive w as materialized (select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as materialized (select r, doc_id, case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k - 1}], ' '))) end as s from w),
sets as materialized (select s, min(r) as r from s where len(s) > 0 group by s),
x as materialized (select r, unnest(s) as g from sets), n as (select r, len(s) as n from sets),
pairs as (select a.r as a, b.r as b, count(*) as c from x a join x b on a.g = b.g and a.r < b.r group by all),
near as (select a, b from pairs join n na on na.r = a join n nb on nb.r = b where 100 * c >= {percent} * (na.n + nb.n - c)),
links as materialized (select a, b from near union all select b, a from near union all select s.r, sets.r from s join sets on sets.s = s.s where s.r <> sets.r union all select sets.r, s.r from s join sets on sets.s = s.s where s.r <> sets.r),
reach as (select r as a, r as b from s union select reach.a, links.b from reach join links on links.a = reach.b),
names as (select a, min(doc_id) as component_id from reach join s on s.r = reach.b group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, coalesce(doc_id = component_id, false) as kept from s join names on names.a = s.r"""
