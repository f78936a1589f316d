"""The mixed model against dense fits, explicit dummies, finite differences and closed forms."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratersight.operators import features, mixed, pieces
from ratersight.plans import catalog


def visits(spark, patients=12, seed=5):
    """Ratings of visits within patients by models and items, with gaps, a text term and a dependent one."""
    rng = np.random.default_rng(seed)
    of_patient, of_item, of_model = rng.normal(0, 1.2, patients), rng.normal(0, 0.6, 4), rng.normal(0, 0.8, 9)
    rows = []
    for p in range(patients):
        for v in range(1 + p % 4):
            of_visit = rng.normal(0, 0.7)
            for i in range(4):
                for m in range(9):
                    if (p + 2 * v + 3 * i + 5 * m) % 7:
                        x = rng.normal()
                        kind = ("dense", "moe", "other")[m % 3]
                        rows.append((f"p{p}", f"p{p}v{v}", f"i{i}", f"m{m}", kind, float(x), float(1 - x), float(2 + 0.5 * x + 0.4 * (kind == "moe") + of_patient[p] + of_visit + of_item[i] + of_model[m] + rng.normal(0, 0.5))))
    return spark.createDataFrame(rows, "p string, v string, i string, m string, kind string, x double, less double, y double")


def same(one, two, within=1e-6):
    assert [t for t, *_ in one.terms] == [t for t, *_ in two.terms]
    for a, b in zip(one.terms, two.terms):
        assert a[1:] == pytest.approx(b[1:], abs=within)
    for f, v in one.variances.items():
        assert v == pytest.approx(two.variances[f], abs=within * 10)
    assert one.noise == pytest.approx(two.noise, abs=within) and one.deviance == pytest.approx(two.deviance, abs=within * 10)


def test_nested_elimination_equals_the_dense_fit(spark):
    df = visits(spark)
    fixed = ["x", "less", "kind"]
    nested = mixed.mixed_model(df, "y", fixed, ["m", "i"], ("p", "v"))
    dense = mixed.mixed_model(df, "y", fixed, ["m", "i", "p", "v"])
    assert nested.converged and nested.gradient < 1e-6 and dense.gradient < 1e-6
    same(nested, dense)
    assert nested.dropped == {"less": "depends on the terms before it"} and "kind" in nested.formula and "less" not in nested.formula
    of = {(f, x): (e, s) for f, x, e, s in dense.levels}
    for f, x, e, s in nested.levels:
        assert (e, s) == pytest.approx(of[f, x], abs=1e-6)
    outer, inner = mixed.nested_effects(nested)
    assert all(r.effect == pytest.approx(of["p", r.p][0], abs=1e-6) for r in outer.collect()) and outer.count() == 12
    assert all(r.effect == pytest.approx(of["v", r.v][0], abs=1e-6) for r in inner.collect()) and inner.count() == 30
    one = mixed.mixed_model(df, "y", fixed, ["m", "i", "p"], "v")
    same(one, dense)


def test_text_terms_are_contrasts_with_the_first_level(spark):
    df = visits(spark)
    text = mixed.mixed_model(df, "y", ["x", "kind"], ["i"], ("p", "v"))
    dummies = df.withColumns({"moe": (F.col("kind") == "moe").cast("int"), "other": (F.col("kind") == "other").cast("int")})
    explicit = mixed.mixed_model(dummies, "y", ["x", "moe", "other"], ["i"], ("p", "v"))
    assert [t for t, *_ in text.terms] == ["(Intercept)", "x", "kindmoe", "kindother"]
    for a, b in zip(text.terms, explicit.terms):
        assert a[1:] == pytest.approx(b[1:], abs=1e-7)
    two = mixed.mixed_model(df.filter("kind <> 'dense'"), "y", ["kind"], ["i"])  # levels are those of the rows at hand
    assert [t for t, *_ in two.terms] == ["(Intercept)", "kindother"]
    assert mixed.mixed_model(df.filter("kind = 'moe'"), "y", ["kind"], ["i"]).dropped == {"kind": "single level"}
    holes = df.withColumn("kind", F.when(F.col("i") != "i1", F.col("kind")))
    assert mixed.mixed_model(holes, "y", ["kind"], ["m"]).n == df.filter("i <> 'i1'").count()


def test_blocks_on_executors_equal_blocks_on_the_driver(spark, monkeypatch):
    df = visits(spark, patients=40)
    here = mixed.mixed_model(df, "y", ["x", "kind"], ["m", "i"], ("p", "v"))
    monkeypatch.setattr(mixed, "START_BLOCKS", 10)
    there = mixed.mixed_model(df, "y", ["x", "kind"], ["m", "i"], ("p", "v"))
    assert there.converged and there.gradient < 1e-6
    same(here, there)


def test_derivatives_by_finite_differences():
    rng = np.random.default_rng(2)
    d, parts = 5, []
    begin = [0]
    for _ in range(6):
        sizes = sorted(rng.choice([1, 2, 4, 7], size=rng.integers(1, 4), replace=False).tolist())
        parts += [(c, int(rng.integers(1, 4))) for c in sizes]
        begin.append(len(parts))
    blocks = mixed.Blocks(np.array([c for c, _ in parts]), np.array([k for _, k in parts]), rng.normal(size=(len(parts), d)), np.array(begin[:-1]))
    outer_products = {}
    for c in (1, 2, 4, 7):
        z = rng.normal(size=(3, d)) * 0.3
        outer_products[c] = (3, z.T @ z)
    full = np.eye(d) * 40 + np.ones((d, d))
    leave = lambda a, b: mixed.of_outer(blocks, a, b) + mixed.of_inner(outer_products, b, d)
    f = mixed.Deviance(full, 50, 2, np.array([2.0, 6.0, 12.0]), np.array([0, 0]), 2, leave)
    x, h = np.array([-0.4, 0.3, -0.8]), 1e-4
    value, slope, curve = f.derivatives(x)
    assert value == pytest.approx(f.value(x), abs=1e-9)
    for i in range(3):
        e = np.eye(3)[i] * h
        assert slope[i] == pytest.approx((f.value(x + e) - f.value(x - e)) / (2 * h), abs=1e-5)
        assert curve[i] == pytest.approx((f.derivatives(x + e)[1] - f.derivatives(x - e)[1]) / (2 * h), abs=1e-5)


def test_a_factor_that_fixed_terms_explain_has_no_effects(spark):
    df = visits(spark).withColumn("g", F.when(F.col("kind") == "moe", "a").when(F.col("kind") == "other", "b").otherwise("c"))
    fit = mixed.mixed_model(df, "y", ["kind"], ["g", "i"], ("p", "v"))
    assert fit.dropped == {"g": "explained by the fixed terms"} and fit.converged
    assert all(abs(e) < 1e-5 for f, _, e, _ in fit.levels if f == "g")
    without = mixed.mixed_model(df, "y", ["kind"], ["i"], ("p", "v"))
    for a, b in zip(fit.terms, without.terms):
        assert a[1:] == pytest.approx(b[1:], abs=1e-5)


def test_a_hundred_thousand_patients(spark):
    """No limit on nested levels; a balanced design has closed forms."""
    n, k = 100_000, 4
    rows = spark.range(n * k, numPartitions=4).select(F.floor(F.col("id") / k).alias("p"), (F.floor(F.col("id") / 2)).alias("v"), (F.col("id") % k).alias("i"))
    noise = lambda c, s: F.pmod(F.xxhash64(c, F.lit(s)), F.lit(1001)) / 1000.0 - 0.5
    df = rows.withColumn("y", 2.0 * noise("p", 1) + noise("v", 2) + noise(F.col("p") * k + F.col("i"), 3) + F.col("i") * 0.1).persist()
    fit = mixed.mixed_model(df, "y", [], ["i"], ("p", "v"))
    df.unpersist()
    assert fit.converged and fit.gradient < 1e-6 and fit.n == n * k
    assert fit.variances["p"] == pytest.approx(4 / 12, rel=0.03) and fit.variances["v"] == pytest.approx(1 / 12, rel=0.05) and fit.noise == pytest.approx(1 / 12, rel=0.03)


def test_equations_hold(spark):
    df = visits(spark).withColumnRenamed("p", "patient").withColumnRenamed("v", "visit")
    fit = mixed.mixed_model(df, "y", ["x", "less", "kind"], ["m", "i"], ("patient", "visit"))
    got = {(r.factor, r.equation): r.side for r in features.equations(df, fit, "y", ["x", "less", "kind"]).collect()}
    want = {("fixed", "(Intercept)"): df.agg(F.sum("y")).first()[0]}
    want |= {("fixed", c): df.agg(F.sum(F.col(c) * F.col("y"))).first()[0] for c in ("x", "less")}
    want |= {("fixed", "kind" + r[0]): r[1] for r in df.groupBy("kind").agg(F.sum("y")).collect()}
    want |= {(f, r[0]): r[1] for f in ("m", "i", "patient", "visit") for r in df.groupBy(f).agg(F.sum("y")).collect()}
    want |= {("slope", f): 0.0 for f in ("m", "i", "patient", "visit")}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_levels_outside_nested_factors_are_bounded(spark):
    df = spark.range(1200).select((F.col("id") % 600).cast("string").alias("g"), F.col("id").cast("double").alias("y"))
    with pytest.raises(ValueError, match="levels"):
        mixed.mixed_model(df, "y", [], ["g"])
    empty = mixed.mixed_model(df.limit(0), "y", [], ["g"])
    assert empty.n == 0 and empty.terms == []


def test_levels_in_pieces_equal_whole_ones(spark, monkeypatch):
    df = visits(spark)
    fit = lambda: mixed.mixed_model(df, "y", ["x", "kind"], ["m", "i"], ("p", "v"))
    whole = fit()
    monkeypatch.setattr(pieces, "PIECE_ROWS", 50)
    cut = fit()
    assert 0 < cut.rows.filter("piece >= 0").select("nest0").distinct().count() < cut.blocks.count() == 12
    same(whole, cut)
    for one, two in zip(mixed.nested_effects(whole), mixed.nested_effects(cut)):
        one, two = ({tuple(r)[:-1]: r.effect for r in x.collect()} for x in (one, two))
        assert one == pytest.approx(two, abs=1e-6)
    sides = [{(r.factor, r.equation): r.side for r in features.equations(df, f, "y", ["x", "kind"]).collect()} for f in (whole, cut)]
    assert sides[0] == pytest.approx(sides[1], abs=1e-5)
    alone = mixed.mixed_model(df, "y", ["x"], ["m"], "p")
    monkeypatch.undo()
    same(alone, mixed.mixed_model(df, "y", ["x"], ["m"], "p"))


def test_rows_in_pieces_are_not_written_again(spark, monkeypatch):
    """No design and no visits: what is written of them is a row for each piece, and nothing is shuffled by level."""
    own = pieces.gathered(pieces.marked(visits(spark).withColumnRenamed("p", "patient"), "patient", "v").repartition("patient", "piece"), "patient", "rows")
    written, plans = [], []

    def kept(df, label, real=mixed.kept):
        written.append(label)
        plans.append(df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple"))
        return real(df, label)

    monkeypatch.setattr(mixed, "kept", kept)
    fit = mixed.mixed_model(own, "y", ["x", "kind"], ["m", "i"], ("patient", "v"))
    assert fit.converged and written == ["cells"] and "Exchange" not in plans[0]


def test_equations_shuffle_sums_alone(spark, monkeypatch):
    """Rows are not joined to their levels' effects; a pass over the rows in pieces leaves the sides."""
    own = visits(spark).withColumnsRenamed({"p": "patient", "v": "visit"})
    own = pieces.gathered(pieces.marked(own, "patient", "visit").repartition("patient", "piece"), "patient", "rows")
    fit = mixed.mixed_model(own, "y", ["x", "less", "kind"], ["m", "i"], ("patient", "visit"))
    written = []
    for at in (mixed, features):
        monkeypatch.setattr(at, "kept", lambda df, label, real=at.kept: written.append((label, df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple"))) or real(df, label))
    out = features.equations(own, fit, "y", ["x", "less", "kind"])
    assert [n for n, _ in written] == ["sides"] and "Exchange" not in written[0][1] and "Join" not in written[0][1]
    got = {(r.factor, r.equation): r.side for r in out.collect()}
    assert out.count() == len(got) == 4 + 1 + 2 + 3 + 9 + 4 + 12 + 30  # slopes, intercept, numbers, kinds, models, items, patients, visits
    assert got["fixed", "less"] == pytest.approx(own.agg(F.sum(F.col("less") * F.col("y"))).first()[0], abs=1e-6)


@pytest.mark.parametrize("name", ["lme_item_blups", "lme_fixed_effects"])
def test_a_query_writes_its_seeds_once(spark, monkeypatch, name):
    written = []
    for at in (mixed, features, pieces):
        monkeypatch.setattr(at, "kept", lambda df, label, real=at.kept: written.append(label) or real(df, label))
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 10
    assert sorted(written) == ["cells", "cells", "large", "seeds"]


def test_batches_of_whole_pieces():
    rng = np.random.default_rng(3)
    level = np.repeat([f"p{i // 2}" for i in range(40)], rng.integers(1, 30, 40))
    table = pa.table({"nest0": level, "piece": pa.array(np.full(len(level), -1), pa.int32()), "at": np.arange(len(level))})
    for size in (1, 7, 1000):
        got = list(pieces.whole(iter(table.to_batches(max_chunksize=size)), "nest0"))
        assert np.concatenate([t.column("at").to_numpy() for t, _ in got]).tolist() == list(range(len(level)))
        own = [t.slice(a, b - a).column("nest0").to_pylist() for t, starts in got for a, b in zip(starts, np.append(starts[1:], t.num_rows))]
        assert [len(x) for x in own] == [int((level == v).sum()) for v in dict.fromkeys(level)] and all(len(set(x)) == 1 for x in own)
