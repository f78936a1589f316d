"""From raw ratings to agreement per cell: failure rules, gates, metrics, and aggregation over runs."""

from __future__ import annotations

from math import pi
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratersight.functions import agreement as A

CELL = ["model", "run", "item"]


def caps(item: str = "item", cap: int = 6, total_cap: int = 60) -> Column:
    """The greatest rating of an item; item 0 is the total."""
    return F.when(F.col(item) == 0, total_cap).otherwise(cap)


def cells(raw: DataFrame, cap: int | Column = 6, failure_policy: str = "backfill") -> DataFrame:
    """Ratings under the failure rules: a missing one becomes ground truth minus cap (an error of cap) with failure 1, or
    goes (`drop`); one over the cap goes; a cell that is not there stays out. cap may be a column, as caps() is."""
    missing = F.col("rating").isNull() | F.isnan("rating")
    out = raw.withColumn("failure", missing.cast("int"))
    if failure_policy == "drop":
        out = out.filter("failure = 0")
    return out.withColumn("rating", F.when(missing, (F.col("ground_truth") - cap).cast("double")).otherwise(F.col("rating"))).filter(F.col("rating") <= cap)


def counted(rated: DataFrame, keys: list[str]) -> DataFrame:
    """Counts n, and failures, of each pair (y, p) of ground truth and rating per key, combined before the shuffle. Counts of
    parts of the ratings add up to those of all."""
    y, p = F.col("ground_truth").cast("double").alias("y"), F.col("rating").cast("double").alias("p")
    failures = F.sum("failure").cast("long") if "failure" in rated.columns else F.lit(0).cast("long")
    return rated.groupBy(*keys, y, p).agg(F.count("*").alias("n"), failures.alias("failures"))


def ranked(own: DataFrame, keys: list[str]) -> DataFrame:
    """counted() with the positions a and b of y and p among the labels that both take together in their key, and low, the
    key's least y. All of it is over the small table of counts, and nothing is joined back, so no filter can be inferred
    into the scan."""
    sides = F.explode(F.array(F.struct(F.lit(True).alias("truth"), F.col("y").alias("v")), F.struct(F.lit(False).alias("truth"), F.col("p").alias("v"))))
    both = own.withColumn("side", sides)
    by = Window.partitionBy(*keys)
    both = both.withColumns({"at": F.dense_rank().over(by.orderBy("side.v")).cast("double"), "low": F.min("y").over(by)})
    place = lambda truth, name: F.max(F.when(F.col("side.truth") == truth, F.col("at"))).alias(name)
    return both.groupBy(*keys, "y", "p").agg(F.first("n").alias("n"), F.first("failures").alias("failures"), F.first("low").alias("low"), place(True, "a"), place(False, "b"))


def _kappa() -> Column:
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    observed = F.sum(n * (a - b) * (a - b))
    expected = F.sum(n * a * a) + F.sum(n * b * b) - 2 * F.sum(n * a) * F.sum(n * b) / F.sum(n)
    return 1 - F.try_divide(observed, expected)


def qwk(rated: DataFrame, keys: list[str]) -> DataFrame:
    """Quadratic weighted kappa per key, on the positions of the labels that y and p take together in that key."""
    return ranked(counted(rated, keys), keys).groupBy(*keys).agg(_kappa().alias("qwk"))


def metrics(rated: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """n, failures, mae, r2 and qwk per key, all from one table of counts of pairs."""
    return of_counts(counted(rated, keys), keys)


def of_counts(counts: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """metrics() of counted() ratings."""
    y, p, n = F.col("y") - F.col("low"), F.col("p") - F.col("low"), F.col("n")
    total, sse = F.sum("n"), F.sum(n * (y - p) * (y - p))
    sst = F.sum(n * y * y) - F.sum(n * y) * F.sum(n * y) / total
    r2 = F.when(total < 2, None).when(sst <= 1e-12, F.when(sse <= 1e-12, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(sse, sst))
    return ranked(counts, keys).groupBy(*keys).agg(total.alias("n"), F.sum("failures").alias("failures"), (F.sum(n * F.abs(y - p)) / total).alias("mae"), r2.alias("r2"), _kappa().alias("qwk"))


def gated(measured: DataFrame, expected: DataFrame, spare: int = 10) -> DataFrame:
    """Cells with `status`: count_gate if n is not the one-row table's `expected`, failure_gate if failures >= n - spare,
    else scored. Metrics of other cells become null."""
    out = measured.join(F.broadcast(expected))  # one row
    out = out.withColumn("status", F.when(F.col("n") != F.col("expected"), "count_gate").when(F.col("failures") >= F.col("n") - spare, "failure_gate").otherwise("scored"))
    return out.withColumns({c: F.when(F.col("status") == "scored", F.col(c)) for c in ("mae", "r2", "qwk")}).drop("expected")


def over_runs(scored: DataFrame, keys: list[str], values: list[str], missing_propagates: bool = False, **more: Column) -> DataFrame:
    """Mean and population deviation of each value over runs, and other aggregates by name. Missing values are left out, or,
    with missing_propagates, make both null, but the deviation of one run, which is 0 whatever its value."""
    parts = []
    for v in values:
        c = F.nanvl(v, F.lit(None)) if dict(scored.dtypes)[v] in ("double", "float") else F.col(v)
        whole = F.count(c) == F.count("*")
        mean, std = F.avg(c), F.stddev_pop(c)
        if missing_propagates:
            mean, std = F.when(whole, mean), F.when(F.count("*") == 1, 0.0).when(whole, std)
        parts += [mean.alias(f"mean_{v}"), std.alias(f"std_{v}")]
    return scored.groupBy(*keys).agg(F.count("*").alias("n_runs"), *parts, *(c.alias(n) for n, c in more.items()))


def add_batch(rated: DataFrame, path: str, batch: str, keys: list[str] = CELL) -> None:
    """Add the ratings of a batch to the state of agreement at path: their counts, as a part of the batch's name, which takes
    the place of that part if it is there. So a batch that comes twice, such as one repeated after a failure, counts once,
    and what earlier batches hold is neither read nor written again. A cell should come in one batch alone."""
    counted(rated, keys).write.mode("overwrite").parquet(f"{path}/batch={quote(batch, safe='')}")


def state(spark: SparkSession, path: str, keys: list[str] = CELL) -> DataFrame:
    """The counts of all batches at path, added up."""
    return spark.read.parquet(path).groupBy(*keys, "y", "p").agg(F.sum("n").alias("n"), F.sum("failures").alias("failures"))


def merge_batches(spark: SparkSession, path: str, to: str, keys: list[str] = CELL) -> None:
    """Write the sum of all batches at path as the one batch of a new state."""
    state(spark, path, keys).write.mode("overwrite").parquet(f"{to}/batch=merged")


def macro(scored: DataFrame) -> DataFrame:
    """Per model and run: the mean of each metric over the scored items that have one, and all failures."""
    return scored.groupBy("model", "run").agg(*(F.avg(F.nanvl(c, F.lit(None))).alias(c) for c in ("mae", "r2", "qwk")), F.sum("failures").alias("failures"))


def item_sums(rated: DataFrame, items: int = 10) -> DataFrame:
    """(model, run, session, ground_truth, rating) of the sessions that have all items without a failure."""
    own = rated.groupBy("model", "run", "session").agg(F.count_if(F.col("failure") == 0).alias("ok"), F.sum("ground_truth").cast("long").alias("ground_truth"), F.sum("rating").alias("rating"))
    return own.filter(F.col("ok") == items).drop("ok").withColumn("failure", F.lit(0))


CELL_KEYS = ["session", "item", "model", "run"]


def against(expected: DataFrame, rated: DataFrame) -> DataFrame:
    """Each cell of expected (session, item, model, run) with the number of its rows there (expected), and of its rows in rated
    without (ok) and with a failure (failed). Both sides are added up by cell, so neither is broadcast, and sides that are
    dealt by session are not shuffled."""
    zero = F.lit(0).cast("byte")
    ours = expected.select(*CELL_KEYS, F.lit(1).cast("byte").alias("e"), zero.alias("ok"), zero.alias("failed"))
    theirs = rated.select(*CELL_KEYS, zero.alias("e"), (F.col("failure") == 0).cast("byte").alias("ok"), (F.col("failure") == 1).cast("byte").alias("failed"))
    both = ours.unionByName(theirs.dropna(subset=CELL_KEYS))  # a null equals nothing
    own = both.groupBy(*CELL_KEYS).agg(F.sum("e").alias("expected"), F.sum("ok").alias("ok"), F.sum("failed").alias("failed"))
    return own.filter("expected > 0")


def gaps(expected: DataFrame, rated: DataFrame) -> DataFrame:
    """Per model, run and item: the expected cells that are absent, of those that have any."""
    return against(expected, rated).filter("ok + failed = 0").groupBy("model", "run", "item").agg(F.sum("expected").alias("gaps"))


def first_bad(expected: DataFrame, rated: DataFrame) -> DataFrame:
    """Per model and run: incomplete sessions, and those whose first bad item is a failure and not an absence."""
    bad = against(expected, rated).filter("ok + failed = 0 or failed > 0")
    each = bad.groupBy("model", "run", "session").agg(F.min_by(F.least("failed", F.lit(1)).cast("int"), "item").alias("first"))
    return each.groupBy("model", "run").agg(F.count("*").alias("incomplete"), F.count_if(F.col("first") == 1).alias("failures"))


def classified(rated: DataFrame, keys: list[str], cut: int) -> DataFrame:
    """Precision, recall, F1 and n of ratings at or above a cut; failures are left out."""
    y, p = (F.col("ground_truth") >= cut).cast("int"), (F.col("rating") >= cut).cast("int")
    return rated.filter("failure = 0").groupBy(*keys).agg(A.precision(y, p).alias("precision"), A.recall(y, p).alias("recall"), A.f1(y, p).alias("f1"), F.count("*").alias("n"))


def classified_over_runs(rated: DataFrame, keys: list[str], cut: int) -> DataFrame:
    """Mean and population deviation over runs of precision, recall and F1, and the mean n; the gates don't apply."""
    own = classified(rated, [*keys, "run"], cut)
    return over_runs(own, keys, ["precision", "recall", "f1"], n_samples=F.avg("n"))


def total_truth(truth: DataFrame, items: int = 10) -> DataFrame:
    """(session, total) of the sessions that have all items 1 .. items in truth (session, item, ground_truth): the sum of
    the items, whatever total is stored elsewhere."""
    own = truth.filter(F.col("item").between(1, items) & F.col("ground_truth").isNotNull())
    return own.groupBy("session").agg(F.sum("ground_truth").cast("long").alias("total"), F.count_distinct("item").alias("k")).filter(F.col("k") == items).drop("k")


def with_total_sessions(valid: DataFrame) -> DataFrame:
    """valid (item, session) with item 0 as the union of all items' sessions."""
    return valid.select("item", "session").union(valid.select(F.lit(0).alias("item"), "session")).distinct()


def mean_icc(per_item: DataFrame) -> DataFrame:
    """Per model: mean and population deviation of the items' mean ICCs."""
    return per_item.groupBy("model").agg(F.avg("mean_icc").alias("mean"), F.stddev_pop("mean_icc").alias("std"), F.count("mean_icc").alias("n_items"))


def overall(scored: DataFrame, value: str, item: str = "item", std: str | None = None) -> DataFrame:
    """Per model: the stored overall value (item 0), or the mean of the items that have one where it is missing; with std, the
    deviation likewise, whether or not its value is stored. fallback: whether the mean of values stands in."""

    def of(c: str):
        known = F.nanvl(c, F.lit(None))
        return F.coalesce(F.max(F.when(F.col(item) == 0, known)), F.avg(F.when(F.col(item) > 0, known)))

    fallback = F.max(F.when(F.col(item) == 0, F.nanvl(value, F.lit(None)))).isNull()
    return scored.groupBy("model").agg(of(value).alias(value), *([of(std).alias(std)] if std else []), fallback.alias("fallback"))


def evaluated(rated: DataFrame, items: tuple[int, int] = (1, 10)) -> DataFrame:
    """The stand-alone evaluation: MAE, R2 and ICC(3,k) of each run, then their mean and population deviation, per model
    and item of a range. Failures are left out; a run needs two pairs for R2 and an ICC."""
    own = rated.filter(F.col("item").between(*items) & (F.col("failure") == 0)).groupBy("model", "item", "run")
    runs = own.agg(A.mae("ground_truth", "rating").alias("mae"), A.r2("ground_truth", "rating").alias("r2"), A.icc("ground_truth", "rating", "icc3k").alias("icc"))
    return over_runs(runs, ["model", "item"], ["mae", "r2", "icc"])


def progress(expected: DataFrame, rated: DataFrame) -> DataFrame:
    """Per model: cells done, failed and absent."""
    e, ok, failed = F.col("expected"), F.col("ok"), F.col("failed")
    absent = F.when(ok + failed == 0, e).otherwise(0)
    return against(expected, rated).groupBy("model").agg(F.sum(e * ok).alias("ok"), F.sum(e * failed).alias("failed"), F.sum(absent).alias("skipped"))


def paired_delta(scored: DataFrame, keys: list[str], value: str, flag: str = "reasoning") -> DataFrame:
    """The other's value less the reasoning one's per key, of pairs in which both are finite."""
    finite = scored.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    a = finite.filter(F.col(flag)).select(*keys, F.col(value).alias("r"))
    b = finite.filter(~F.col(flag)).select(*keys, F.col(value).alias("nr"))
    return a.join(b, keys).withColumn("delta", F.col("nr") - F.col("r"))


def icc_over_runs(rated: DataFrame, keys: list[str], kind: str = "icc3", least: int = 10) -> DataFrame:
    """Mean and population deviation over runs of the ICC of runs with at least so many pairs; pairs of the last run."""
    own = rated.groupBy(*keys, "run").agg(F.count("*").alias("n"), A.icc("ground_truth", "rating", kind).alias("icc")).filter(F.col("n") >= least)
    return own.groupBy(*keys).agg(F.avg("icc").alias("mean_icc"), F.stddev_pop("icc").alias("std_icc"), F.max_by("n", "run").alias("n_sessions"))


def spearman_p(rho: Column, n: Column) -> Column:
    """The two-sided p-value of a rank correlation of n pairs by Student's t with n - 2 degrees of freedom; null for n < 3.

    For whole degrees of freedom the share of t's distribution is a finite sum of powers of 1 - rho^2."""
    free, s, c2 = n - 2, F.abs(rho), 1 - rho * rho
    even = free % 2 == 0

    def terms(many: Column, ratio) -> Column:
        """1 + r1 + r1 r2 + ..., of so many terms."""
        first = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))
        add = lambda x, k: F.struct((x["sum"] + x["term"] * ratio(k) * c2).alias("sum"), (x["term"] * ratio(k) * c2).alias("term"))
        return F.when(many > 0, F.aggregate(F.when(many > 1, F.sequence(F.lit(1).cast("long"), many - 1)).otherwise(F.array().cast("array<bigint>")), first, add, lambda x: x["sum"])).otherwise(0.0)

    share = F.when(even, s * terms(F.floor(free / 2), lambda k: (2 * k - 1) / (2 * k))).otherwise(2 / pi * (F.asin(s) + s * F.sqrt(c2) * terms(F.floor((free - 1) / 2), lambda k: 2 * k / (2 * k + 1))))
    return F.when(free >= 1, F.when(s >= 1, 0.0).otherwise(F.greatest(1 - share, F.lit(0.0))))


def stars(p: Column) -> Column:
    """Marks of significance at 0.001, 0.01 and 0.05."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str, least: int = 4) -> DataFrame:
    """Rank correlation with average ranks for ties, per key with at least so many pairs."""
    def ranked(c: str):
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2

    own = pairs.withColumns({"rx": ranked(x), "ry": ranked(y)})
    return own.groupBy(*keys).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n")).filter(F.col("n") >= least)
