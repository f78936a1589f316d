"""Ranks, quantiles, means joined back, joins by ranges and the state of agreement, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratersight.operators import ratings, tables
from ratersight.plans import roster
from ratersight.sources import files, sinks

SF = "/root/testdata/sf0.001"


def test_ranks_of_sparse_keys(spark):
    rng = random.Random(4)
    keys = list({rng.randrange(-(2**62), 2**62) for _ in range(3000)})
    got = tables.ranked_rows(spark.createDataFrame([(k, k % 7) for k in keys], "k long, at long"), "k").collect()
    place = {k: i for i, k in enumerate(sorted(keys), 1)}
    assert len(got) == 3000 and all(r.place == place[r.k] and r.total == 3000 and r["at"] == r.k % 7 for r in got)
    assert tables.ranked_rows(spark.createDataFrame([], "k long"), "k").collect() == []


VALUES = {
    "ties": [float(i % 3) for i in range(200)],
    "one": [5.0] * 150,
    "wide": [(-1.0) ** i * 10.0 ** (i % 40) for i in range(300)],
    "huge": [-1.7e308, 1.7e308, 0.0, *(float(i) for i in range(120))],
    "few": [3.0, 1.0],
    "single": [7.5],
    None: [float(i * i % 101) for i in range(90)],
}


@pytest.mark.parametrize("bins", [2, 8, 1024])
def test_quantiles_by_selection(spark, monkeypatch, bins):
    monkeypatch.setattr(tables, "GATHERED", 20)
    monkeypatch.setattr(tables, "STEP_BINS", bins)
    at = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    rows = [(k, v) for k, own in VALUES.items() for v in [*own, None, float("nan")]]
    random.Random(bins).shuffle(rows)
    got = {r.k: r for r in tables.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", at).collect()}
    assert got.keys() == VALUES.keys()
    for k, own in VALUES.items():
        assert got[k].n == len(own)
        own = sorted(own)
        for name, p in at.items():
            h = (len(own) - 1) * p
            lo, share = own[int(h)], h - int(h)
            want = lo if share == 0 else (1 - share) * lo + share * own[int(h) + 1]
            assert got[k][name] == pytest.approx(want, rel=1e-12)


def test_pauses_of_null_keys(spark):
    rows = [(k, float(i)) for k in (None, 1, 2) for i in range(k or 5)] + [(3, -1.0), (3, None)]
    got = {r.k: (r.n, r.p50, r.mean, r.n_long) for r in tables.pauses(spark.createDataFrame(rows, "k int, gap double"), ["k"], "gap", 2.5).collect()}
    assert got == {None: (4, 2.5, 2.5, 2), 2: (1, 1.0, 1.0, 0)}
    assert [(r.k, r.gap, r.place) for r in tables.long_pauses(spark.createDataFrame(rows, "k int, gap double"), ["k"], "gap", 2.5).orderBy("place").collect()] == [(None, 4.0, 1), (None, 3.0, 2)]


def test_quantiles_of_a_whole_table(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * F.col("id") % 997).cast("double").alias("v"))
    want = np.percentile([r.v for r in df.collect()], [50, 95])
    for most in (10_000, 50):
        monkeypatch.setattr(tables, "GATHERED", most)
        row = tables.quantiles(df, [], "v", {"a": 0.5, "b": 0.95}).collect()
        assert [(r.n, r.a, r.b) for r in row] == [(1000, pytest.approx(want[0]), pytest.approx(want[1]))]
    assert tables.quantiles(df.limit(0), [], "v", {"a": 0.5}).collect() == []


@pytest.mark.parametrize("few", [True, False])
def test_means_are_joined_back(spark, monkeypatch, few):
    if not few:  # as if there were many groups, and hot ones
        monkeypatch.setattr(tables, "SMALL_ROWS", 1)
        monkeypatch.setattr(tables, "SALT_ROWS", 10)
    rows = [(k, i % 2, float(i * (k or 1))) for k in (None, 1, 2) for i in range(30)] + [(3, 0, None)]
    df = spark.createDataFrame(rows, "k int, j int, v double")
    got = tables.centre(df, ["v"], ["k", "j"])
    assert got.columns == ["k", "j", "v", "v_between", "v_within"] and got.count() == len(rows)
    for r in got.collect():
        own = [v for k, j, v in rows if (k, j) == (r.k, r.j) and v is not None]
        assert r.v_between == (pytest.approx(np.mean(own)) if own else None)
        assert r.v_within == (None if r.v is None else pytest.approx(r.v - np.mean(own)))
    if few:
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_lines_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(tables, "BIN", 4)
    lines = [(s, n) for s in (1, 2, 3) for n in range(30 * s)]
    specs = [(1, 1, "0, 2-4, 3-5"), (1, 2, "7-3, x, 29-99999999"), (2, 1, "10-50"), (4, 1, "1"), (3, 3, None)]
    df = tables.in_ranges(spark.createDataFrame(lines, "session int, line int"), spark.createDataFrame(specs, "session int, item int, spec string"))
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    want = [(s, i, n) for s, i, ranges in ((1, 1, [(0, 0), (2, 4), (3, 5)]), (1, 2, [(29, 99999999)]), (2, 1, [(10, 50)])) for lo, hi in ranges for t, n in lines if t == s and lo <= n <= hi]
    assert sorted((r.session, r.item, r.line) for r in df.collect()) == sorted(want)


def test_agreement_of_batches_is_that_of_the_whole(spark, tmp_path):
    cells = roster._cells(spark, SF)
    path = str(tmp_path / "state")
    for batch in (0, 1, 0, 2, 1):  # repeated ones count once
        ratings.add_batch(cells.filter(F.col("session") % 3 == batch), path, f"day/{batch}")
    want = sorted(map(tuple, ratings.metrics(cells).collect()))
    assert sorted(map(tuple, ratings.of_counts(ratings.state(spark, path)).collect())) == want
    ratings.merge_batches(spark, path, str(tmp_path / "merged"))
    ratings.add_batch(cells.filter("session < 0"), str(tmp_path / "merged"), "empty")
    assert sorted(map(tuple, ratings.of_counts(ratings.state(spark, str(tmp_path / "merged"))).collect())) == want


def test_sheets_are_sorted_over_their_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(10**6):06}", 1 if i % 9 else 2, "one" if i % 9 else "two", rng.randrange(4), float(i)) for i in range(4000)]
    sinks.write_sheets(spark.createDataFrame(rows, "session string, item int, item_name string, model int, rating double"), str(tmp_path / "book"))
    for item, name in ((1, "01 - one"), (2, "02 - two")):
        parts = sorted((tmp_path / f"book/sheet={name}").glob("part-*"))
        assert len(parts) > 1 or item == 2
        lines = [x.split(",") for p in parts for x in p.read_text().splitlines()[1:]]
        keys = [(int(x[3]), x[0]) for x in lines]
        assert keys == sorted(keys) and len(keys) == sum(r[1] == item for r in rows)


def test_missing_values_of_items(spark):
    runs = [(0, 1, 0.5, 1.0), (0, 1, None, 3.0), (0, 2, float("nan"), 2.0), (1, 1, 0.25, 1.0), (1, 1, 0.75, 1.0)]
    df = spark.createDataFrame(runs, "model int, item int, qwk double, mae double")
    whole = {(r.model, r.item): (r.mean_qwk, r.std_qwk, r.mean_mae) for r in ratings.over_runs(df, ["model", "item"], ["qwk", "mae"], missing_propagates=True).collect()}
    assert whole == {(0, 1): (None, None, 2.0), (0, 2): (None, 0.0, 2.0), (1, 1): (0.5, 0.25, 1.0)}
    left = {(r.model, r.item): (r.mean_qwk, r.std_qwk) for r in ratings.over_runs(df, ["model", "item"], ["qwk"]).collect()}
    assert left == {(0, 1): (0.5, 0.0), (0, 2): (None, None), (1, 1): (0.5, 0.25)}
    own = spark.createDataFrame([(0, 0, 0.9, 0.1), (0, 1, 0.5, 0.2), (1, 1, 0.4, 0.3), (1, 2, 0.6, None), (1, 3, None, 0.7), (2, 0, None, 0.4), (2, 1, 0.2, 0.05), (3, 0, 0.8, float("nan")), (3, 1, 0.1, 0.6)], "model int, item int, q double, s double")
    got = {r.model: (r.q, r.s, r.fallback) for r in ratings.overall(own, "q", std="s").collect()}
    assert got == {0: (0.9, 0.1, False), 1: (0.5, 0.5, True), 2: (0.2, 0.4, True), 3: (0.8, 0.6, False)}


def test_snapshot_of_an_analysis(spark, tmp_path):
    from ratersight.operators import features

    rng = np.random.default_rng(0)
    rows = [(f"s{v}", f"p{v % 6}", i, m, bool(m % 2), float(rng.normal() + v % 6 + i)) for v in range(24) for i in range(3) for m in range(4)]
    seeds = spark.createDataFrame(rows, "session string, patient string, item int, model int, reasoning boolean, abs_error double")
    fits = features.strata(seeds)
    sinks.write_snapshot(seeds, fits, str(tmp_path / "snapshot"))
    back = files.snapshot(spark, str(tmp_path / "snapshot"))
    assert back["seeds"].count() == len(rows) and {r.stratum for r in back["effects"].collect()} == {"reason", "nonreason"}
    assert back["items"].count() == 6 and all(r.converged for r in back["reports"].collect())
