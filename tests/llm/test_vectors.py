"""Vector codes and near-duplicate vectors against brute force, on odd rows too."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratersight.llm import linkage, queries, vector_codes, vector_dedup

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, error string, node int, n int"
ODD = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf")] * 8, [None] * 8, [0.0] * 8]


def table(spark, rows):
    """Rows (vec_id, vector, label), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, k, "e", 7, 8) for i, v, k in rows], SCHEMA)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


# --- codes ------------------------------------------------------------------------------------------------------------


def coded(rows, s=vector_codes.Settings()):
    """By Python's integers: (vec_id, code, error, label_error, digest)."""
    kept = [(i, k, [math.floor(s.scale * x) for x in map(float, np.float32(v))]) for i, v, k in rows if good(v)]
    sizes = [len(q) for *_, q in kept]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    kept = [r for r in kept if len(r[2]) == size]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i8").tobytes()))
    cuts = [size * i // s.parts for i in range(s.parts + 1)]
    part = lambda q, p: q[cuts[p] : cuts[p + 1]]
    books = [[part(q, p) for *_, q in kept[: s.entries]] for p in range(s.parts)]

    def assigned(q):
        out = []
        for p in range(s.parts):
            apart = [sum((x - y) ** 2 for x, y in zip(part(q, p), e)) for e in books[p]]
            out.append((apart.index(min(apart)), min(apart)))
        return out

    for _ in range(s.rounds):
        of = [assigned(q) for *_, q in kept]
        books = [[[sum(c) // len(c) for c in zip(*own)] if (own := [part(q, p) for (*_, q), a in zip(kept, of) if a[p][0] == e]) else entry for e, entry in enumerate(books[p])] for p in range(s.parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    of = [(i, k, assigned(q)) for i, k, q in kept]
    total = {}
    for _, k, a in of:
        total[k] = total.get(k, 0) + sum(d for _, d in a)
    return sorted([(i, "".join(f"{e:02x}" for e, _ in a), sum(d for _, d in a), total[k], digest) for i, k, a in of], key=str)


def vectors(rng, n, size=8):
    return [[rng.choice([-1, 1]) * rng.random() for _ in range(size)] for _ in range(n)]


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    own = vectors(rng, 70)
    own += [own[0], own[1], [-0.0] * 8, [0.25] * 8, [-0.25] * 8]  # repeats, zeros and ties
    rows = [(1000 - 3 * i, v, (None, 1, 2)[i % 3]) for i, v in enumerate(own)]
    rows += [(None, own[5], 1), (None, own[6], None), (40, own[7], 2), (40, own[8], 2)]  # ids that are null or shared
    rows += [(i, v, 1) for i, v in enumerate(ODD[:6])] + [(7, [1.0, 2.0], 1)]
    for s in (vector_codes.Settings(), vector_codes.Settings(entries=6), vector_codes.Settings(parts=3, entries=4, rounds=2)):
        got = sorted(map(tuple, vector_codes.compress(table(spark, rows), settings=s).collect()), key=str)
        assert got == coded(rows, s) and len(got) == len(own) + 4
    assert vector_codes.compress(table(spark, [])).collect() == [] == vector_codes.compress(table(spark, [(1, None, 1)])).collect()


def test_large_components_are_exact_or_refused(spark):
    s = vector_codes.Settings()
    most = s.largest(8) // s.scale
    rows = [(i, [float(most * (-1) ** (i + k)) for k in range(8)], 0) for i in range(4)]
    assert sorted(map(tuple, vector_codes.compress(table(spark, rows)).collect()), key=str) == coded(rows)
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(table(spark, [(0, [1e30] * 8, 0)])).collect()


def test_labels_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BROADCAST_ROWS", 1)
    rows = [(i, v, (None, 1, 2)[i % 3]) for i, v in enumerate(vectors(random.Random(1), 40))]
    assert sorted(map(tuple, vector_codes.compress(table(spark, rows)).collect()), key=str) == coded(rows)


def test_nearest_is_the_first_of_several():
    rng = np.random.default_rng(0)
    x, book = rng.integers(-(2**27), 2**27, (9000, 5)), rng.integers(-(2**27), 2**27, (7, 5))
    book[4] = book[1]
    index, least = vector_codes.nearest(x, book)
    apart = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
    assert (index == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all() and 4 not in index


def test_query_of_codes_equals_sql(spark):
    got = queries.op11_vector_codes(spark, SF)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_vector_codes"]).fetchall()
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and len(want) > 100
    assert sorted(map(tuple, got.collect())) == sorted(want)


# --- near-duplicates --------------------------------------------------------------------------------------------------


def linked(rows, least=0.95):
    """{place in rows: (n_links, component_id)} by all pairs."""
    at = {}
    for p, (_, v, _) in enumerate(rows):
        if good(v) and any(v):
            at.setdefault(len(v), []).append(p)
    links = {p: set() for p in range(len(rows))}
    for own in at.values():
        x = np.array([np.float32(rows[p][1]) for p in own], np.float64)
        n = np.linalg.norm(x, axis=1)
        near = x @ x.T / np.outer(n, n) >= least
        for a, p in enumerate(own):
            links[p] = {own[b] for b in np.flatnonzero(near[a])} - {p}
    out = {}
    for p in range(len(rows)):
        seen, todo = {p}, [p]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[q][0] for q in seen if rows[q][0] is not None]
        out[p] = (len(links[p]), min(ids, default=None))
    return out


def clusters(rng, size=32, groups=12, each=14, alone=150):
    """Vectors around centres, most of a group within the cosine of each other and some at its border, and others apart."""
    out = []
    for g in range(groups):
        centre = rng.normal(size=size)
        centre /= np.linalg.norm(centre)
        for k in range(each):
            side = rng.normal(size=size)
            side -= side @ centre * centre
            out.append(((1 + g) * (centre + side / np.linalg.norm(side) * (0.05 + 0.4 * (k / each) ** 2))).astype(np.float32).tolist())
    return out + rng.normal(size=(alone, size)).astype(np.float32).tolist()


@pytest.mark.parametrize("small_blocks", [False, True])
def test_links_equal_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:  # buckets are cut into blocks, and nothing is broadcast
        monkeypatch.setattr(vector_dedup, "CODES", 5)
        monkeypatch.setattr(vector_dedup, "BYTES", 5 * 8 * 32)
        monkeypatch.setattr(vector_dedup, "PAIRS", 64)
        monkeypatch.setattr(linkage, "BROADCAST_ROWS", 1)
    own = clusters(np.random.default_rng(5))
    own += [own[0]] * 30 + [own[200]] * 3 + [[2 * x for x in own[201]]]  # copies, and the same direction
    rows = [(5 * i % 997, v, None) for i, v in enumerate(own)]
    rows += [(None, own[3], 1), (None, own[210], 1), (2, own[211], 1), (2, own[20], 1)]
    rows += [(2000 + i, v, 1) for i, v in enumerate([*ODD, *ODD])] + [(3000, [1.0, 2.0], 1), (3001, [1.0, 2.001], 1), (3002, [-1.0, 2.0], 1)]
    want = linked(rows)
    got = vector_dedup.near_vectors(table(spark, rows), settings=vector_dedup.Settings(recall=0.9999)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == sorted((rows[p][0], n, c, rows[p][0] == c) for p, (n, c) in want.items() if rows[p][0] is not None)
    assert sorted((r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in got if r.vec_id is None) == sorted((n, -1 if c is None else c, False) for p, (n, c) in want.items() if rows[p][0] is None)
    assert max(n for n, _ in want.values()) > 30


def test_links_at_the_threshold_are_found_mostly_and_none_below(spark):
    """Pairs exactly at the cosine, the hardest ones, with production settings; and pairs just below it."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    for cosine, low, high in ((0.9501, 0.9, 1.0), (0.9499, 0.0, 0.0)):
        y = cosine * x + (1 - cosine**2) ** 0.5 * side
        rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
        got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        share = got.agg(F.avg("n_links")).first()[0]
        assert low <= share <= high


def test_rotations_bring_vectors_to_corners():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(800, 16)) * np.linspace(0.2, 3, 16)
    turn = vector_dedup.rotation(v, 1, 40)
    assert np.allclose(turn @ turn.T, np.eye(16))
    loss = lambda r: np.linalg.norm(np.where(v @ r > 0, 1.0, -1.0) - v @ r)
    start = np.linalg.qr(np.random.default_rng(1).standard_normal((16, 16)))[0]
    assert loss(turn) < loss(start)
    index = vector_dedup.learn(v, 10**6, vector_dedup.Settings())
    ones = np.unpackbits(index.codes(v).view(np.uint8), axis=1)
    share = ones.reshape(len(v), len(index.planes), 64)[:, :, np.arange(16)].mean(axis=0)
    assert index.found >= 0.98 and (abs(share - 0.5) < 0.15).all()  # codes are balanced


def test_directions_of_any_length(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e190]), (2, [5.0, 0.0]), (3, [0.0, 1e-300]), (4, [0.0, 1e300])]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 1, 3), (4, 1, 3)]
    assert vector_dedup.near_vectors(table(spark, [])).collect() == []
    assert [tuple(r) for r in vector_dedup.near_vectors(table(spark, [(4, [1.0] * 8, 1)])).collect()] == [(4, 0, 4, True)]


def test_query_of_links(spark):
    got = queries.op12_vector_dedup(spark, SF)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = [(r.vec_id, r.embedding, None) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = linked(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == sorted((rows[p][0], *x) for p, x in want.items())
