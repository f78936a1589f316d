"""Near-duplicate vectors: learned binary codes propose through Hamming tables, the original vectors decide.

Iterative quantisation learns rotations from a bounded sample, after which the signs of a vector's components are a balanced
code. A table deals the vectors by a run of bits of a code. Vectors that share a table's key and differ in few bits of that
code are candidates; a pair is looked at in the first table that finds it. Codes alone go through the tables first, so that
only vectors with a candidate are moved. All links of a bucket are counted in its tasks, in blocks of bounded size, and no row
is made for a pair; the rows that leave a task are as many as its vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratersight.llm import scratch
from ratersight.llm.linkage import bounded, components, whole_runs
from ratersight.llm.vector_codes import finite

#: Codes of one block of a bucket, and bytes of the vectors of one.
CODES, BYTES = 4096, 4 << 20
#: Pairs whose codes are looked at together.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Settings:
    """least: link vectors with this cosine or more. sample: distinct vectors that rotations are learned from, and that are
    moved to that very cosine to see which tables find them. recall: the share of these that must be found; rotations, each
    of up to 64 bits, are added until it is, `rotations` at most. crowd: vectors for each key of a table."""

    least: float = 0.95
    sample: int = 4096
    recall: float = 0.98
    rotations: int = 24
    crowd: float = 2.0
    steps: int = 40


@dataclass
class Index:
    """centre and planes (a matrix for each rotation) make codes; tables: (rotation, shift, mask) of each; cut: most bits in
    which candidates may differ in a table's rotation; found: the share of moved sample vectors that the tables find."""

    centre: np.ndarray
    planes: list[np.ndarray]
    tables: list[tuple[int, int, int]]
    cut: int
    found: float

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A word for each rotation of the rows of x, which have any length but 0."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True) - self.centre
        bits = np.zeros((len(x), len(self.planes), 64), np.uint8)
        for i, p in enumerate(self.planes):
            bits[:, i, : p.shape[1]] = unit @ p > 0
        return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]

    def meets(self, a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
        """Which rows of codes a table brings together as candidates."""
        r, shift, mask = self.tables[table]
        apart = a[:, r] ^ b[:, r]
        return (apart & np.uint64(mask << shift) == 0) & (np.bitwise_count(apart) <= self.cut)


def rotation(v: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """An orthogonal matrix that brings the rows of v near to the corners of a cube, from a random start: codes for the
    rotation, then the best rotation for the codes, in turn."""
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(steps):
        u, _, w = np.linalg.svd(v.T @ np.where(v @ turn > 0, 1.0, -1.0))
        turn = u @ w
    return turn


def learn(sample: np.ndarray, count: int, s: Settings) -> Index:
    """The index for `count` vectors by a sample of them."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre = unit.mean(axis=0)
    _, _, axes = np.linalg.svd(unit - centre, full_matrices=True)
    axes = axes[:64].T
    side = np.random.default_rng(0).standard_normal(unit.shape)
    side -= (side * unit).sum(axis=1, keepdims=True) * unit
    length = np.linalg.norm(side, axis=1, keepdims=True)
    moved = s.least * unit + (1 - s.least**2) ** 0.5 * side / np.where(length > 0, length, 1.0)
    bits = axes.shape[1]
    span = int(np.clip(np.ceil(np.log2(max(count / s.crowd, 2))), min(4, bits), bits))
    index, seen = Index(centre, [], [], bits, 0.0), np.zeros(len(unit), bool)
    while index.found < s.recall and len(index.planes) < s.rotations:
        r = len(index.planes)
        index.planes.append(axes @ rotation((unit - centre) @ axes, r + 1, s.steps))
        a, b = index.codes(unit), index.codes(moved)
        if not r:  # the few that differ in more bits count as not found
            index.cut = int(np.quantile(np.bitwise_count(a[:, 0] ^ b[:, 0]), 0.999))
        for shift in range(0, bits - span + 1, span):
            index.tables.append((r, shift, (1 << span) - 1))
            seen |= index.meets(a, b, len(index.tables) - 1)
            index.found = float(seen.mean())
            if index.found >= s.recall:
                break
    return index


def _rows(wide: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (vec_id, node, vector) as (vec_id, node, size, cell); of vectors that link with nothing, only vec_id."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int32)
            cells: list[bytes | None] = [None] * batch.num_rows
            for at, x in finite(batch.column(2)):
                top = np.abs(x).max(axis=1)
                at, x, top = at[top > 0], x[top > 0], top[top > 0]
                x = np.ldexp(x, -np.frexp(top)[1][:, None]) if wide else x.astype("<f4")  # a power of two changes no cosine
                size[at] = x.shape[1]
                for i, r in zip(at.tolist(), x):
                    cells[i] = r.tobytes()
            node = pa.array(batch.column(1).to_numpy(zero_copy_only=False), mask=size == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), node, pa.array(size), pa.array(cells, pa.binary())], names=["vec_id", "node", "size", "cell"])

    return rows


def _matrix(cells: Iterable[bytes], size: int, wide: bool) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<f8" if wide else "<f4").reshape(-1, size).astype(np.float64)


def _sign(index: Index, size: int, wide: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = index.codes(_matrix(batch.column(1).to_pylist(), size, wide)).view(np.int64)
                own = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), own], names=["node", "codes"])

    return sign


def _met(cut: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (t, key, i, j, node, code) sorted by their first four, the (t, key, node) with a near code in their group."""

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_runs(batches, ["t", "key", "i", "j"]):
            code, node = t.column("code").to_numpy().view(np.uint64), t.column("node").to_numpy()
            group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            found = np.zeros(len(code), bool)
            for lag in range(1, min(int(np.diff(cuts).max(initial=1)), 16)):  # small groups, all at a time
                near = (group[lag:] == group[:-lag]) & (np.bitwise_count(code[lag:] ^ code[:-lag]) <= cut)
                found[lag:] |= near
                found[:-lag] |= near
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo > 16:
                    for x in range(lo, hi):
                        if not found[x]:
                            near = np.bitwise_count(code[x] ^ code[lo:hi]) <= cut
                            near[x - lo] = False
                            found[lo:hi] |= near
                            found[x] = near.any()
            if found.any():
                rows = pa.array(np.flatnonzero(found))
                yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(rows) for c in ("t", "key")] + [pa.array(node[found])], names=["t", "key", "node"])

    return met


def _count(index: Index, size: int, wide: bool, least: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of rows (t, key, i, j, node, block, weight, codes, cell) sorted by their first four, as (a, b, n): (a, a, n) for
    the n rows that node a is linked with here, (a, b, 0) to hold linked nodes together."""

    def linked(x: np.ndarray, codes: np.ndarray, block: np.ndarray, same: bool, table: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        length = np.linalg.norm(x, axis=1)
        step = max(1, PAIRS // len(x))
        for lo in range(0, len(x), step):
            own = slice(lo, lo + step)
            a, b = np.nonzero((x[own] @ x.T) / (length[own, None] * length) >= least)
            a += lo
            keep = (a < b) & (True if same else block[a] != block[b])
            a, b = a[keep], b[keep]
            ok = index.meets(codes[a], codes[b], table)
            a, b = a[ok], b[ok]
            for earlier in range(table):
                if len(a):
                    new = ~index.meets(codes[a], codes[b], earlier)
                    a, b = a[new], b[new]
            if len(a):
                yield a, b

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_runs(batches, ["t", "key", "i", "j"]):
            tables, i, j, node, block, weight = (t.column(c).to_numpy() for c in ("t", "i", "j", "node", "block", "weight"))
            codes = np.array(t.column("codes").to_pylist(), np.int64).view(np.uint64)
            cells, out = t.column("cell").to_pylist(), []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo < 2:
                    continue
                own, n = slice(lo, hi), np.zeros(hi - lo, np.int64)
                label = np.arange(hi - lo)
                for a, b in linked(_matrix(cells[lo:hi], size, wide), codes[own], block[own], bool(i[lo] == j[lo]), int(tables[lo])):
                    np.add.at(n, a, weight[lo + b])
                    np.add.at(n, b, weight[lo + a])
                    while len(a):  # the least label of each linked group
                        p, q = label[a], label[b]
                        apart = p != q
                        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
                        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                        while (label != label[label]).any():
                            label = label[label]
                own_nodes, has, led = node[own], np.flatnonzero(n), np.flatnonzero(label != np.arange(hi - lo))
                out.append(np.stack([own_nodes[has], own_nodes[has], n[has]]))
                out.append(np.stack([own_nodes[led], own_nodes[label[led]], np.zeros(len(led), np.int64)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=["a", "b", "n"])

    return count


def _blocks(df: DataFrame, most: int) -> DataFrame:
    """df, whose rows have t and key, with block, i and j: groups of more than `most` rows are cut into blocks by a hash of
    their nodes, and each row stands once for each pair of blocks (i <= j) that its own is in."""
    large = df.groupBy("t", "key").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")).filter("blocks > 1")
    own = df.join(bounded(scratch.table(large, "large")), ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")}).drop("k", "blocks")
    return own.repartition(scratch.parts(df.sparkSession), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")


def _links(nodes: DataFrame, size: int, wide: bool, s: Settings) -> tuple[DataFrame, Index]:
    """(a, b, n) as _count() gives it, of nodes (node, weight, cell) of one length."""
    some = nodes.orderBy("node").limit(s.sample).select("cell").collect()  # node is a hash
    index = learn(_matrix([r.cell for r in some], size, wide), nodes.count(), s)
    signed = scratch.table(nodes.select("node", "cell").mapInArrow(_sign(index, size, wide), "node long, codes array<long>"), "signed")
    tables = [F.struct(F.lit(t).alias("t"), F.shiftrightunsigned(F.col("codes")[r], shift).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1)).alias("key"), F.col("codes")[r].alias("code")) for t, (r, shift, mask) in enumerate(index.tables)]
    dealt = signed.select("node", F.inline(F.array(*tables)))
    met = _blocks(dealt, CODES).select("t", "key", "i", "j", "node", "code").mapInArrow(_met(index.cut), "t int, key long, node long")
    met = scratch.table(met.distinct(), "met")
    asked = bounded(met.select("node").distinct())
    payload = scratch.table(nodes.select("node", "weight", "cell").join(asked, "node").join(signed, "node"), "payload")
    rows = _blocks(met, max(1, BYTES // (8 * size))).join(payload, "node")
    rows = rows.repartition(scratch.parts(nodes.sparkSession), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    rows = rows.select("t", "key", "i", "j", "node", "block", "weight", "codes", "cell")
    return scratch.table(rows.mapInArrow(_count(index, size, wide, s.least), "a long, b long, n long"), "links"), index


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Two rows are linked if the cosine of their vectors, in double precision, is settings.least or more; every link that is
    given is so, and settings.recall says how many are found. n_links: rows linked with this one, equal vectors included.
    component_id: the smallest vec_id that links reach, itself included; kept: vec_id is that one.

    Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing; vectors of different
    lengths neither, and each length that occurs has an index of its own. Equal vectors are one node, known by a 64-bit hash,
    so copies cost nothing. Rows that share a vec_id are judged each by itself. A null vec_id is counted in links, is never
    kept and names no component; a component without any id has none. Other columns are ignored, whatever their names. An
    empty table gives an empty result. Of a vector with candidates, as many copies are shuffled as tables find some; a bucket
    of n vectors beyond a block of BYTES makes n^2 / block rows."""
    s, kind = settings, vectors.schema[vector].dataType.simpleString()
    wide = kind != "array<float>"
    given = vectors.select(F.col(id).cast("long").alias("vec_id"), (F.col(vector).cast("array<double>") if wide else F.col(vector)).alias("vector"))
    scratch.root(vectors.sparkSession)  # bounds Arrow's batches
    rows = given.select("vec_id", F.xxhash64("vector").alias("node"), "vector").mapInArrow(_rows(wide), "vec_id long, node long, size int, cell binary")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("cell").alias("cell"))
    nodes = scratch.table(nodes, "nodes")
    links = None
    for r in nodes.groupBy("size").count().filter("count > 1").orderBy("size").collect():  # lengths of vectors, as a rule one
        own, _ = _links(nodes.filter(F.col("size") == r.size), r.size, wide, s)
        links = own if links is None else links.union(own)
    info = nodes.select("node", "least", (F.col("weight") - 1).alias("n_links"), F.col("least").alias("component_id"))
    if links is not None:
        degrees = links.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
        found = scratch.table(components(links.filter("n = 0").select("a", "b")), "components")
        named = found.join(nodes.select("node", "least"), "node")
        names = named.groupBy("component").agg(F.min("least").alias("name"))
        named = named.join(bounded(scratch.table(names, "names")), "component").select("node", F.lit(True).alias("of_several"), "name")
        info = info.join(degrees, "node", "left").join(named, "node", "left")
        info = info.select("node", (F.col("n_links") + F.coalesce("more", F.lit(0))).alias("n_links"), F.when(F.col("of_several"), F.col("name")).otherwise(F.col("component_id")).alias("component_id"), F.lit(True).alias("known"))
    else:
        info = info.select("node", "n_links", "component_id", F.lit(True).alias("known"))
    out = rows.select("vec_id", "node").join(scratch.table(info, "info"), "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle_sql(least: float = 0.95) -> str:
    """The links of all pairs and their components in DuckDB's SQL."""
    dot = lambda a, b: f"list_inner_product({a}, {b})"
    return f"""with recursive v as materialized (select row_number() over () as r, vec_id, case when list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) then cast(embedding as double[]) end as x from embeddings),
n as materialized (select r, vec_id, x, sqrt({dot('x', 'x')}) as size, len(x) as width from v where len(x) > 0 and {dot('x', 'x')} > 0),
links as materialized (select a.r as a, b.r as b from n a join n b on a.width = b.width and a.r <> b.r where {dot('a.x', 'b.x')} / (a.size * b.size) >= {least}),
reach as (select r as a, r as b from v union select reach.a, links.b from reach join links on links.a = reach.b),
degrees as (select a, count(*) as n_links from links group by a), names as (select a, min(vec_id) as component_id from reach join v on v.r = reach.b group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, coalesce(vec_id = component_id, false) as kept from v join names on names.a = v.r left join degrees on degrees.a = v.r"""
