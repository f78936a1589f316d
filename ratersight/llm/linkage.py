"""Links between items that share a bucket, and their connected components, without expanding a bucket into all its pairs.

A bucket (an LSH band, a shared line segment) may hold a third of all items, so its pairs are never listed. Each bucket
first pairs its members with one hub, the member with the most bucket mates. Buckets whose members are then in one
component need nothing more. In the others, the members of the bucket's largest component and the rest are cut into blocks,
and each pair of blocks but those inside the largest component meets in a task: as many copies of a member as there are
blocks that it may have links to. The task tries the pairs across components that the sketches leave possible, and gives
only links that join components. Every link is verified exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratersight.llm import scratch

#: Members of one block of a bucket, and bytes of their payloads; pairs of blocks are compared in one task's memory.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Rows of longs that may be broadcast (16 MB as a hash table at most); larger sides are shuffled.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """df, hinted for broadcast only where a count shows that it has at most BROADCAST_ROWS rows of a few longs."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def differing(x: Column, y: Column) -> Column:
    """Bits that differ between two arrays of longs."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node that is reached.

    Alternating large-star and small-star steps; each step is a grouped minimum and a join, and is written out.
    An empty table of edges gives an empty result; loops (a = b) and repeated edges change nothing."""
    e = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, "star")
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", "m"))
        e = scratch.table(small.distinct(), "edges")


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys of rows sorted by keys, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            own = tuple(k[:, lo])
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def _confirm(prepare: Callable, linked: Callable) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, b, x, y), x and y being the payloads of a and b, that are links."""

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs: dict[int, object] = {}
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), prepare(batch.column(3).to_pylist())):
                if a not in hubs:
                    if len(hubs) >= 64:
                        hubs.clear()
                    hubs[a] = next(iter(prepare([x.as_py()])))
                keep.append(linked(hubs[a], y))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _compare_blocks(cut: int, prepare: Callable, linked: Callable) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between different components inside each pair of blocks: possible pairs are tried from the nearest sketches
    on, and a pair whose ends have been joined meanwhile is not tried, so a block gives fewer links than it has members.
    A pair that shares several buckets is tried in that with the least key alone: `lower` holds a member's lesser keys."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "i", "j"]):
            node, comp, block = (t.column(c).to_numpy() for c in ("node", "component", "block"))
            if comp.min() == comp.max():
                continue
            same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
            sketch = np.array(t.column("sketch").to_pylist(), np.int64).view(np.uint64)
            lower = t.column("lower").combine_chunks()
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lower).to_numpy(zero_copy_only=False))))
            names, at = np.unique(lower.flatten().to_numpy(), return_inverse=True)
            owner, mark = np.repeat(np.arange(len(node)), np.diff(ends)), np.zeros(len(names), bool)
            found = []
            for x in range(len(node)):
                apart = np.bitwise_count(sketch[x] ^ sketch).sum(axis=1).astype(np.int64)
                near = np.flatnonzero((apart <= cut) & (comp != comp[x]) & (node > node[x]) & (same | (block != block[x])))
                if len(near) and ends[x] < ends[x + 1]:
                    mark[at[ends[x] : ends[x + 1]]] = True
                    elsewhere = np.zeros(len(node), bool)
                    elsewhere[owner[mark[at]]] = True
                    mark[at[ends[x] : ends[x + 1]]] = False
                    near = near[~elsewhere[near]]
                if len(near):
                    found.append(np.stack([apart[near], np.full(len(near), x), near]))
            if not found:
                continue
            tries = np.concatenate(found, axis=1)
            tries = tries[:, np.argsort(tries[0], kind="stable")]
            full: list[object] = list(prepare(t.column("payload").to_pylist()))
            joined = {c: c for c in comp.tolist()}

            def root(c: int) -> int:
                while joined[c] != c:
                    joined[c] = c = joined[joined[c]]
                return c

            own, ids, links = comp.tolist(), node.tolist(), []
            for x, y in zip(tries[1].tolist(), tries[2].tolist()):
                a, b = root(own[x]), root(own[y])
                if a != b and linked(full[x], full[y]):
                    joined[max(a, b)] = min(a, b)
                    links.append((ids[x], ids[y], own[x], own[y]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b", "u", "v"])

    return compare


def link(nodes: DataFrame, buckets: DataFrame, cut: int, fetch: Callable[[DataFrame], DataFrame], prepare: Callable, linked: Callable) -> tuple[DataFrame, DataFrame]:
    """(links, components) of nodes (node long, sketch array<long>) that share a key in buckets (key long, node long).

    cut: pairs whose sketches differ in more bits are not candidates. fetch: takes nodes (node) and returns their payloads
    (node, payload). prepare: makes of a list of payloads what linked compares, exactly, two at a time. links: verified
    pairs (a, b), a < b, that hold every component together; pairs inside a component that is already connected are not
    tried. Empty inputs give empty results. buckets should be cheap to read twice."""
    spark = nodes.sparkSession
    shared = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    members = scratch.table(buckets.join(shared, "key").distinct(), "buckets")
    sizes = members.groupBy("key").agg((F.count("*") - 1).alias("mates"))
    mates = members.join(sizes, "key").groupBy("node").agg(F.sum("mates").alias("mates"))
    hubs = members.join(mates, "node").groupBy("key").agg(F.max(F.struct("mates", (-F.col("node")).alias("minus"))).alias("top"))
    hubs = scratch.table(hubs.select("key", (-F.col("top.minus")).alias("hub")), "hubs")
    pairs = members.join(hubs, "key").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    near = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    tried = scratch.table(near.filter(differing(F.col("x"), F.col("y")) <= cut).select("a", "b"), "pairs")
    asked = tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()
    payloads = scratch.table(fetch(bounded(asked)), "payloads")
    full = tried.join(payloads.toDF("b", "y"), "b").join(payloads.toDF("a", "x"), "a").select("a", "b", "x", "y")
    links = scratch.table(full.mapInArrow(_confirm(prepare, linked), "a long, b long").distinct(), "links")
    found = scratch.table(components(links), "components")

    # the hub has met all members of its bucket; the others are left
    rest = members.join(hubs, "key").filter("node <> hub").drop("hub").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("of"))
    split = split.filter("lo < hi").groupBy("n", "of").agg(F.min("key").alias("key"))  # of buckets with the same members, one
    rest = scratch.table(rest.join(split.select("key"), "key"), "rest")
    if rest.isEmpty():
        return links, found
    payloads = scratch.table(fetch(bounded(rest.select("node").distinct())), "payloads")
    sized = rest.join(payloads.select("node", F.octet_length("payload").alias("bytes")), "node").groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    most = F.max(F.struct("n", "bytes", "component")).alias("most")
    split = sized.groupBy("key").agg(most, F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    cut_in = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    split = split.select("key", F.col("most.component").alias("largest"), cut_in(F.col("most.n"), F.col("most.bytes")).alias("of_largest"), cut_in(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("of_rest"))
    rest = rest.join(scratch.table(split, "split"), "key")
    keys = rest.groupBy("node").agg(F.collect_list("key").alias("keys"))  # no more than the buckets of one node
    rest = rest.join(nodes.select("node", "sketch"), "node").join(keys, "node").withColumn("lower", F.filter("keys", lambda k: k < F.col("key")))
    inside, dealt = F.col("component") == F.col("largest"), F.xxhash64("node")
    rest = rest.withColumn("block", F.when(inside, F.pmod(dealt, F.col("of_largest"))).otherwise(F.col("of_largest") + F.pmod(dealt, F.col("of_rest"))).cast("int"))
    rest = rest.join(payloads, "node").withColumn("k", F.explode(F.sequence(F.when(inside, F.col("of_largest")).otherwise(0), F.col("of_largest") + F.col("of_rest") - 1)))
    rest = rest.select("key", "node", "component", "sketch", "payload", "lower", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    rest = rest.repartition(scratch.parts(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = scratch.table(rest.mapInArrow(_compare_blocks(cut, prepare, linked), "a long, b long, u long, v long"), "links")
    if more.isEmpty():
        return links, found
    # the new links join whole components, so only these are the nodes of what is left to solve
    joined = scratch.table(components(more.select(F.col("u").alias("a"), F.col("v").alias("b"))).toDF("component", "to"), "joined")
    alone = joined.select(F.col("component").alias("node"), F.col("to").alias("component")).join(found, "node", "left_anti")
    moved = found.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return links.union(more.select("a", "b")), scratch.table(moved.union(alone), "components")


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) sorted by key, those whose key has more than one node."""

    def several(rows: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
        many = np.minimum.reduceat(rows[1], starts) < np.maximum.reduceat(rows[1], starts)
        return rows[:, np.repeat(many, np.diff(np.append(starts, rows.shape[1])))]

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        if not held or rows[0, -1] != held[0][0, 0]:
            rows, held = np.concatenate([*held, rows], axis=1), []
            last = int(np.searchsorted(rows[0], rows[0, -1]))
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in several(rows[:, :last])], names=["key", "node"])
            rows = rows[:, last:]
        held.append(rows)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in several(np.concatenate(held, axis=1))], names=["key", "node"])


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal keys, of rows sorted by keys, and the places where the groups begin and end."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        new = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        if held and tuple(k[:, 0]) != last:
            new = np.concatenate(([0], new))
        if held and not len(new):
            held.append(batch)
            continue
        if len(new):
            done = [*held, batch.slice(0, int(new[-1]))]
            before = sum(x.num_rows for x in held)
            cuts = np.concatenate(([0], before + new))
            t = pa.Table.from_batches(done)
            if t.num_rows:
                yield t, np.unique(cuts)
            held = [batch.slice(int(new[-1]))]
        else:
            held = [batch]
        last = tuple(k[:, -1])
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.array([0, t.num_rows])


def _shares(lower: np.ndarray, ends: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of some members share a lesser key with one: members' lists of keys lie end to end. Keys of one member alone
    can't be shared; the others are bits of a row for each member, or, where these are too many, marks of one member."""
    n = len(ends) - 1
    names, at, times = np.unique(lower, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), np.diff(ends))
    keep = times[at] > 1
    names = np.cumsum(times > 1) - 1
    at, owner = names[at[keep]], owner[keep]
    width = int((times > 1).sum())
    if not width:
        return lambda x, ys: np.zeros(len(ys), bool)
    if n * width <= 1 << 26:
        rows = np.zeros((n, width), bool)
        rows[owner, at] = True
        bits = np.packbits(rows, axis=1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
        return lambda x, ys: (bits[ys] & bits[x]).any(axis=1)
    begin = np.searchsorted(owner, np.arange(n + 1))
    mark = np.zeros(width, bool)

    def marked(x: int, ys: np.ndarray) -> np.ndarray:
        own = at[begin[x] : begin[x + 1]]
        mark[own] = True
        out = np.array([mark[at[begin[y] : begin[y + 1]]].any() for y in ys.tolist()], bool)
        mark[own] = False
        return out

    return marked


#: Pairs of one block that are verified at a time.
TRIES = 1 << 17


def _count_blocks(compare: Callable) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All links inside each pair of blocks, as (a, b, n): a row (a, a, n) for each node with n links there, and rows
    (a, b, 0) that hold the linked nodes together. A pair that shares several buckets is tried in that with the least key
    alone: `lower` holds a member's lesser keys. So rows are as many as members, whatever the number of links."""

    def solve(node: np.ndarray, block: np.ndarray, same: bool, shares: Callable, own) -> Iterator[tuple[int, int, int]]:
        n = len(node)
        degree, label = np.zeros(n, np.int64), np.arange(n)
        xs: list[np.ndarray] = []
        ys: list[np.ndarray] = []

        def verify() -> None:
            nonlocal xs, ys, label
            x, y = np.concatenate(xs), np.concatenate(ys)
            xs, ys = [], []
            ok = own.linked(x, y)
            x, y = x[ok], y[ok]
            np.add.at(degree, x, 1)
            np.add.at(degree, y, 1)
            while len(x):
                a, b = label[x], label[y]
                apart = a != b
                if not apart.any():
                    break
                x, y, a, b = x[apart], y[apart], a[apart], b[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label != label[label]).any():
                    label = label[label]

        tries = 0
        for x in range(n):
            near = own.near(x)  # of the later ones
            if not same:
                near = near[block[near] != block[x]]
            if len(near):
                near = near[~shares(x, near)]
            if len(near):
                xs.append(np.full(len(near), x))
                ys.append(near)
                tries += len(near)
                if tries >= TRIES:
                    verify()
                    tries = 0
        if xs:
            verify()
        for v in np.flatnonzero(label != np.arange(n)).tolist():
            yield int(node[v]), int(node[label[v]]), 0
        for v in np.flatnonzero(degree).tolist():
            yield int(node[v]), int(node[v]), int(degree[v])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_runs(batches, ["key", "i", "j"]):
            node, block, i, j, size = (t.column(c).to_numpy() for c in ("node", "block", "i", "j", "size"))
            payload = t.column("payload").to_pylist()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
            lower = t.column("lower").combine_chunks()
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lower).to_numpy(zero_copy_only=False))))
            flat = lower.flatten().to_numpy()
            out: list[tuple[int, int, int]] = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo < 2:
                    continue
                order = lo + np.argsort(size[lo:hi], kind="stable")
                if hi - lo == 2:
                    x, y = order.tolist()
                    if (i[lo] == j[lo] or block[x] != block[y]) and not np.isin(flat[ends[x] : ends[x + 1]], flat[ends[y] : ends[y + 1]]).any():
                        own = compare([payload[x], payload[y]], sketch[order])
                        if len(own.near(0)) and own.linked(np.array([0]), np.array([1]))[0]:
                            a, b = int(node[x]), int(node[y])
                            out += [(a, b, 0), (a, a, 1), (b, b, 1)]
                    continue
                own_ends = np.concatenate(([0], np.cumsum(ends[order + 1] - ends[order])))
                own_lower = np.concatenate([flat[ends[v] : ends[v + 1]] for v in order.tolist()])
                out += solve(node[order], block[order], bool(i[lo] == j[lo]), _shares(own_lower, own_ends), compare([payload[v] for v in order.tolist()], sketch[order]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "n"])

    return count


#: Members of one block of a bucket whose pairs are all counted, and bytes of their payloads.
MEMBERS, BYTES = 2048, 8 << 20


def count_links(buckets: DataFrame, fetch: Callable[[DataFrame], DataFrame], compare: Callable) -> tuple[DataFrame, DataFrame]:
    """(degrees, components) of the nodes that are linked: (node, n_links), n_links counting every link of the node, and
    (node, component).

    buckets (key long, node long) are read once. fetch: takes nodes (node) and returns (node, payload string, size long,
    sketch binary). compare: takes payloads and sketches in the order of size, and returns an object with near(x),
    which later ones are candidates, and linked(xs, ys), exact. All candidate pairs of a bucket are verified, in pairs of
    blocks; counts are summed in the tasks, so that no row is made for a pair. A block is bounded in members and bytes."""
    spark = buckets.sparkSession
    dealt = buckets.repartition(scratch.parts(spark), "key").sortWithinPartitions("key")
    members = scratch.table(dealt.mapInArrow(_shared, "key long, node long").distinct(), "buckets")
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("of"))
    sizes = sizes.groupBy("n", "of").agg(F.min("key").alias("key"))  # of buckets with the same members, one
    members = scratch.table(members.join(sizes.select("key"), "key"), "members")
    keys = members.groupBy("node").agg(F.collect_list("key").alias("keys"))  # no more than the buckets of one node
    payloads = scratch.table(fetch(bounded(keys.select("node"))), "payloads")
    heavy = members.join(payloads.select("node", F.octet_length("payload").alias("bytes")), "node").groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    heavy = heavy.select("key", F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("bytes") / BYTES)).cast("int").alias("blocks")).filter("blocks > 1")
    rest = members.join(keys, "node").join(payloads, "node").join(bounded(scratch.table(heavy, "heavy")), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rest = rest.withColumn("lower", F.filter("keys", lambda k: k < F.col("key"))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", "node", "payload", "size", "sketch", "lower", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    rest = rest.repartition(scratch.parts(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = scratch.table(rest.mapInArrow(_count_blocks(compare), "a long, b long, n long"), "links")
    degrees = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    return degrees, scratch.table(components(found.filter("n = 0").select("a", "b")), "components")
