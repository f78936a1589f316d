"""Statistics against their definitions, the failure rules and gates, and odd bodies."""

import math
import statistics
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratersight.functions import agreement as A
from ratersight.functions import text as X
from ratersight.operators import features, ratings, tables, transcripts
from ratersight.plans import catalog, roster
from ratersight.sources.panels import grid, panel

PAIRS = [(0, 0), (1, 2), (2, 2), (3, 1), (4, 6), (6, 5), (2, 0), (5, 5), (3, 3), (0, 1), (6, 6), (1, 1)]
SF = "/root/testdata/sf0.001"


def rated(spark, pairs, failure=0):
    return spark.createDataFrame([(1, y, float(p), failure) for y, p in pairs], "k int, ground_truth int, rating double, failure int")


def kappa(pairs):
    labels = sorted({v for p in pairs for v in p})
    at = {v: i for i, v in enumerate(labels)}
    n = len(labels)
    seen = np.zeros((n, n))
    for y, p in pairs:
        seen[at[y], at[p]] += 1
    w = np.subtract.outer(range(n), range(n)) ** 2
    return 1 - (seen * w).sum() / (np.outer(seen.sum(1), seen.sum(0)) / seen.sum() * w).sum()


def test_definitions(spark):
    df = rated(spark, PAIRS)
    got = df.agg(A.mae("ground_truth", "rating").alias("mae"), A.r2("ground_truth", "rating").alias("r2"), *(A.icc("ground_truth", "rating", k).alias(k) for k in roster.KINDS)).first()
    want = {"mae": 0.75, "r2": 0.701493, "icc1": 0.870690, "icc2": 0.869976, "icc3": 0.860483, "icc1k": 0.930876, "icc2k": 0.930468, "icc3k": 0.925010}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6)


@pytest.mark.parametrize("pairs", [PAIRS, [(7, 20), (20, 33), (33, 33), (41, 20), (7, 7)], [(-6, 0), (3, -3), (3, 3)]])
def test_kappa_uses_label_positions(spark, pairs):
    assert ratings.qwk(rated(spark, pairs), ["k"]).first()["qwk"] == pytest.approx(kappa(pairs))


def test_sparse_labels(spark):
    assert ratings.qwk(rated(spark, [(7, 20), (20, 33), (33, 33), (41, 20), (7, 7)]), ["k"]).first()["qwk"] == pytest.approx(0.375)


def test_perfect_agreement_and_constants(spark):
    same = rated(spark, [(i % 4, i % 4) for i in range(12)])
    assert ratings.qwk(same, ["k"]).first()["qwk"] == 1 and same.agg(A.icc("ground_truth", "rating")).first()[0] == pytest.approx(1)
    assert rated(spark, [(2, 2), (2, 2)]).agg(A.r2("ground_truth", "rating")).first()[0] == 1
    assert rated(spark, [(2, 3), (2, 2)]).agg(A.r2("ground_truth", "rating")).first()[0] == 0
    assert rated(spark, [(2, 3)]).agg(A.r2("ground_truth", "rating")).first()[0] is None


def test_failure_rules(spark):
    raw = spark.createDataFrame([(5, None), (5, math.nan), (5, 7.0), (5, -2.0), (5, 6.0)], "ground_truth int, rating double")
    assert sorted((r.rating, r.failure) for r in ratings.cells(raw).collect()) == [(-2.0, 0), (-1.0, 1), (-1.0, 1), (6.0, 0)]
    assert ratings.cells(raw, failure_policy="drop").count() == 2


def test_gates_on_the_panel(spark):
    status = {r.status: r["count"] for r in roster._measured(spark, SF).groupBy("status").count().collect()}
    assert status == {"count_gate": 74, "failure_gate": 1, "scored": 75}
    assert grid(spark, SF).count() == 22_500 and panel(spark, SF).select("session", "model", "run").distinct().count() == 2_250


def test_classification_without_positives(spark):
    got = ratings.classified(rated(spark, [(0, 0), (1, 1)]), ["k"], 3).first()
    assert (got.precision, got.recall, got.f1, got.n) == (0, 0, 0, 2)


def test_bodies(spark):
    bodies = ['{"rating": 3, "explanation": "a"}', '{"rating": 3.7}', '{"rating": "4"}', '{"rating": null}', 'so "Rating": 4.9 Explanation: it\nx', "Rating: 3", "none", "[1]", "", None, '{"rating": [1]}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", X.rating(F.col("b")).alias("r"), X.explanation(F.col("b")).alias("e"), X.last_rating(F.col("b")).alias("l")).orderBy("i").collect()
    assert [r.r for r in rows] == [3, 3.7, 4, None, 4, None, None, None, None, None, None]
    assert rows[0].e == "a" and rows[4].e == "it" and rows[5].l == 3


def test_text_functions(spark):
    one = spark.createDataFrame([(3725.0625, "a b  c\nd", "The model of a very long name indeed (x)", 131072)], "s double, t string, n string, c long")
    got = one.select(X.clock(F.col("s")), X.keep_last(F.col("t"), 2), X.short_name(F.col("n")), X.context(F.col("c")), X.count_of(F.lit("a-->b-->"), "-->")).first()
    assert tuple(got) == ("01:02:05.062", "c d", "The model of a very long ...", "131k", 2)


def test_ranges_and_chunks(spark):
    got = spark.range(1).select(tables.ranges(F.lit("34, 226-246, x")).alias("r"), tables.equal_chunks(F.lit(10), 4).alias("c")).first()
    assert [tuple(r) for r in got.r] == [(34, 34), (226, 246)] and [tuple(c) for c in got.c] == [(0, 0, 4), (1, 4, 3), (2, 7, 3)]


def segments(spark, words, **tracks):
    """Segments by track; offsets count from 0."""
    rows = [(k, i, *w) for k, own in enumerate([words, *tracks.values()]) for i, w in enumerate(own)]
    out = transcripts.pause_segments(spark.createDataFrame(rows, "track int, no long, word string, start double, end double")).orderBy("track", "no").collect()
    return [[r for r in out if r.track == k] for k in range(1 + len(tracks))]


def test_pause_rules(spark):
    words = [("a,", 0.0, 0.5), ("b.", 1.0, 1.2), ("c", 1.5, 1.7), ("why?", 1.8, 1.9), ("d", 2.0, 2.1), ("e", 2.5, 2.6), ("f", 5.0, 5.1)]
    short = [("why?", 0.0, 0.1), ("so,", 0.1, 0.2), ("x", 0.6, 0.7)]  # a clause mark in a short segment ends the search
    dash = [("hello", 0.0, 3.0), (" there\u2014 ", 3.0, 4.0), (None, 4.5, 4.6), ("again", 4.7, 5.0)]
    long = [(f"w{i}", i * 1.0, i + 0.9) for i in range(70)]
    asked = [("why?", 0.0, 0.1), *((f"w{i}", i * 0.2, i * 0.2 + 0.1) for i in range(1, 5)), ("late", 1.5, 1.6), ("last", 2.2, 2.3)]
    tie = [("a", 0.0, 1.0), ("b", 3.125, 3.5), ("c", 6.0, 6.1)]
    got = segments(spark, words, short=short, dash=dash, long=long, asked=asked, tie=tie)
    assert [(r.no, r.text, r.reason) for r in got[0]] == [(0, "a, b.", "sentence_end"), (1, "c why? d", "post_question"), (2, "e", "pause_2.40s"), (3, "f", "final")]
    assert [(r.start, r.end, r.start_offset, r.end_offset) for r in got[0]] == [(0.0, 1.2, 0, 120), (1.5, 2.1, 150, 210), (2.5, 2.6, 250, 260), (5.0, 5.1, 500, 509)]
    assert [r.reason for r in got[1]] == ["final"]
    assert [(r.text, r.reason) for r in got[2]] == [("hello  there\u2014", "clause_boundary"), ("again", "final")]
    assert [(r.text.split()[0], r.reason) for r in got[3]] == [("w0", "max_duration"), ("w31", "max_duration"), ("w62", "final")]
    assert [(r.text, r.reason) for r in got[4]] == [("why? w1 w2 w3 w4", "post_question"), ("late last", "final")]
    assert [r.reason for r in got[5]] == ["pause_2.12s", "pause_2.50s", "final"]
    assert transcripts.pause_segments(spark.createDataFrame([], "track int, no long, word string, start double, end double")).collect() == []


def test_segments_stay_in_the_jvm(spark):
    words = spark.createDataFrame([(1, 0, "a", 0.0, 0.1)], "track int, no long, word string, start double, end double")
    plan = transcripts.pause_segments(words)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan


def test_balanced_one_way_model(spark):
    rng = np.random.default_rng(1)
    effect = rng.normal(0, 2, 8)
    rows = [(str(g), float(effect[g] + rng.normal()), 1.0) for g in range(8) for _ in range(20)]
    fit = features.mixed_model(spark.createDataFrame(rows, "g string, y double, c double"), "y", ["c"], ["g"])
    means = [statistics.mean(y for g, y, _ in rows if g == str(k)) for k in range(8)]
    within = statistics.mean(statistics.variance([y for g, y, _ in rows if g == str(k)]) for k in range(8))
    between = statistics.variance(means) - within / 20
    grand = statistics.mean(means)
    assert fit.terms[0][1] == pytest.approx(grand, abs=1e-6) and fit.converged and not fit.singular and fit.dropped == {"c": "no variation"}
    assert (fit.variances["g"], fit.noise) == pytest.approx((between, within), rel=1e-3)
    for _, level, blup, _ in fit.levels:
        assert blup == pytest.approx((means[int(level)] - grand) * between / (between + within / 20), abs=1e-3)


def test_nested_factor_is_absorbed_exactly(spark):
    rng = np.random.default_rng(3)
    patient, visit, item = rng.normal(0, 1, 4), rng.normal(0, 0.7, 24), rng.normal(0, 0.5, 3)
    rows = [(f"p{v % 4}", f"v{v}", f"i{i}", float(x), float(2 * x), float(1 + 0.5 * x + patient[v % 4] + visit[v] + item[i] + rng.normal(0, 0.6))) for v in range(24) for i in range(3) for x in [rng.normal()] if (v + i) % 7]
    df = spark.createDataFrame(rows, "p string, v string, i string, x double, twice double, y double")
    one = features.mixed_model(df, "y", ["x", "twice"], ["p", "i"], "v")
    two = features.mixed_model(df, "y", ["x"], ["p", "i", "v"])
    assert one.dropped == {"twice": "depends on the terms before it"} and one.converged and two.converged
    for f in "piv":
        assert one.variances[f] == pytest.approx(two.variances[f], abs=1e-3)
    for a, b in zip(one.terms, two.terms):
        assert a[1:] == pytest.approx(b[1:], abs=1e-4)
    of = {(f, x): e for f, x, e, _ in two.levels}
    assert all(e == pytest.approx(of[f, x], abs=1e-3) for f, x, e, _ in one.levels)
    flat = features.mixed_model(df.withColumn("y", F.col("x") + F.rand(1) * 1e-3).withColumn("p", F.xxhash64("v", "i") % 3), "y", ["x"], ["p"])
    assert flat.singular or flat.variances["p"] < flat.noise


def test_rank_correlations_have_p_values(spark):
    rows = [(0.5, 10), (0.9, 10), (0.1, 30), (-0.7, 8), (1.0, 5), (0.0, 9), (0.5, 3), (0.5, 4), (0.6, 11), (0.5, 2)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, rho double, n long").select("i", ratings.spearman_p(F.col("rho"), F.col("n")).alias("p")).withColumn("s", ratings.stars(F.col("p"))).orderBy("i").collect()
    assert [r.p for r in got[:9]] == pytest.approx([0.141113, 0.000387, 0.599048, 0.053224, 0.0, 1.0, 0.666667, 0.5, 0.051003], abs=1e-6) and got[9].p is None
    assert [r.s for r in got[:4]] == ["", "***", "", ""]


def test_texts_of_prompts_and_roles(spark):
    one = spark.createDataFrame([("do this", "a b c d e", "Practitioner: hi", "hm: x", "plain")], "i string, t string, p string, u string, v string")
    got = one.select(X.keep_room(F.col("i"), F.col("t"), 5).alias("k"), X.keep_room(F.col("i"), F.col("t"), 2).alias("none"), X.prompt(F.col("i"), F.col("t"), True).alias("one"), X.prompt(F.col("i"), F.col("t")).alias("two"), *(X.roles(F.col(c)).alias(f"r{c}") for c in "puv")).first()
    assert (got.k, got.none, len(got.one), [m.role for m in got.two]) == ("c d e", "", 1, ["system", "user"])
    assert [tuple(got[f"r{c}"]) for c in "puv"] == [("Practitioner", "hi"), ("Unclear", "hm: x"), ("Unclear", "plain")]


def test_rows_are_numbered_without_one_task(spark):
    rows = spark.range(0, 20_000, 3).withColumnRenamed("id", "k")
    got = tables.ranked_rows(rows, "k")
    assert got.agg(F.count_if(F.col("place") != F.col("k") / 3 + 1).alias("bad"), F.min("total").alias("n")).first() == (0, 6667)


def test_roster_has_sql():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(catalog.ORACLE_SQL) >= 80


def test_entry_works_without_a_dependency_of_the_text_operators():
    """A package that only they need may be missing: the other queries stay, and a warning names the cause."""
    code = "import sys, warnings; sys.modules['public_tokenizers'] = None; warnings.simplefilter('error', ImportWarning)\nwith warnings.catch_warnings(record=True) as told:\n    warnings.simplefilter('always')\n    import __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()), [str(w.message) for w in told if 'left out' in str(w.message)])"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, n_sql, has_any, told = out.stdout.strip().split(" ", 3)
    assert int(n) == len(catalog.QUERIES) and int(n_sql) == len(catalog.ORACLE_SQL) and has_any == "False" and "public_tokenizers" in told
