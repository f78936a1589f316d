"""Queries over direct totals (item 0), runs, evaluators and ablations, each with its twin in DuckDB's SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ratersight.functions import agreement as A
from ratersight.operators import ratings, tables
from ratersight.plans.roster import GRID, HUMAN_ICC, PANEL, SUMS, _cells, _f1, _icc, _icc_runs, _measured, _qwk, _r, _r2, _scored, SCORED, query
from ratersight.sources.panels import dealt, grid, models, table, total_panel

TOTALS = """grid0 as (select cast(c_custkey as bigint) as session, cast(m as int) as model, cast(r as int) as run from customer, range(0, 5) b(m), range(0, 3) c(r)),
shown0 as (select *, cast(list_sum([(7*session + 3*i + session % 11) % 7 for i in range(1, 11)]) as int) as ground_truth, (13*session + 11*model + 17*run) % 31 - 15 as d, (31*session + 3*model + run) % 101 as h, (model + run) % 4 as g from grid0),
panel0 as (select session, 0 as item, model, run, ground_truth, cast(case when h = 1 then null when h = 2 and g = 1 then 61 else least(greatest(ground_truth + d, 0), 60) end as double) as rating from shown0 where not (h = 0 and g = 0)),
cells0 as (select session, item, model, run, ground_truth, coalesce(rating, ground_truth - 60) as rating, cast(rating is null as int) as failure from panel0 where coalesce(rating, 0) <= 60)"""


def _totals(spark, d):
    return ratings.cells(total_panel(spark, d), ratings.caps())


MEASURED0 = f"""{TOTALS}, {_qwk('cells0', 'model, run')},
measured0 as (select model, run, count(*) as n, cast(sum(failure) as bigint) as failures, avg(abs(ground_truth - rating)) as mae, {_r2()} as r2 from cells0 group by all),
gates0 as (select *, case when n <> (select count(*) from customer) then 'count_gate' when failures >= n - 10 then 'failure_gate' else 'scored' end as status from measured0 join kappa using (model, run))"""


def _measured_totals(spark, d):
    expected = table(spark, d, "customer").agg(F.count("*").alias("expected"))
    return ratings.gated(ratings.metrics(_totals(spark, d), ["model", "run"]), expected)


@query(f"with {MEASURED0} select model, run, n, failures, status, {', '.join(f'round(case when status = {chr(39)}scored{chr(39)} then {c} end, 6) + 0.0 as {c}' for c in ('mae', 'r2', 'qwk'))} from gates0")
def total_direct_metrics(spark, d):
    return _measured_totals(spark, d)


def _f1_runs(of: str, cut: int, kind: str, tag: str) -> str:
    """CTEs of mean and deviation over runs; kind is an expression, tag keeps names apart."""
    one = _f1(of, "model, run, kind", cut).replace("b as (", f"b{tag} as (", 1).replace("\nt as (", f"\nt{tag} as (", 1).replace("from b group", f"from b{tag} group").replace("from t", f"from t{tag}")
    head, _, tail = re.sub(r"round\((coalesce\(.*?\), 0\)), 6\) \+ 0\.0", r"\1", one).rpartition("\nselect ")
    over = ", ".join(f"{f}({v}) as {n}_{v}" for v in ("precision", "recall", "f1") for n, f in (("mean", "avg"), ("std", "stddev_pop")))
    return f"k{tag} as (select *, {kind} as kind from {of.replace('k' + tag, tag + '_in')}), {head}, m{tag} as (select {tail}), o{tag} as (select model, kind, count(*) as n_runs, {over}, avg(n) as n_samples from m{tag} group by all)"


@query(
    f"with {SUMS}, {TOTALS}, one_in as (select * from cells where failure = 0), two_in as (select * from cells0 where failure = 0), three_in as (select * from sums), "
    + ", ".join(_f1_runs(f"k{t}", cut, kind, t) for t, cut, kind in (("one", 3, "'item_' || item"), ("two", 20, "'total_direct'"), ("three", 20, "'total_sum'")))
    + " select model, kind, n_runs, "
    + ", ".join(f"round({n}_{v}, 6) + 0.0 as {n}_{v}" for v in ("precision", "recall", "f1") for n in ("mean", "std"))
    + ", n_samples from (select * from oone union all select * from otwo union all select * from othree)"
)
def f1_over_runs(spark, d):
    cells = _cells(spark, d)
    kind = lambda df, k: df.withColumn("kind", k)
    parts = [
        ratings.classified_over_runs(kind(cells, F.concat(F.lit("item_"), F.col("item").cast("string"))), ["model", "kind"], 3),
        ratings.classified_over_runs(kind(_totals(spark, d), F.lit("total_direct")), ["model", "kind"], 20),
        ratings.classified_over_runs(kind(ratings.item_sums(cells), F.lit("total_sum")), ["model", "kind"], 20),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_OVER = ", ".join(f"round({f}({v}), 6) + 0.0 as {n}_{v}" for v in ("mae", "r2", "qwk") for n, f in (("mean", "avg"), ("std", "stddev_pop")))


@query(f"with {SUMS}, {_qwk('sums', 'model, run')}, m as (select model, run, count(*) as n, avg(abs(ground_truth - rating)) as mae, {_r2()} as r2, any_value(qwk) as qwk from sums join kappa using (model, run) group by model, run) select model, count(*) as n_runs, {_OVER}, cast(floor(avg(n)) as bigint) as n_samples from m group by model")
def sum_metrics_over_runs(spark, d):
    per = ratings.metrics(ratings.item_sums(_cells(spark, d)), ["model", "run"])
    return ratings.over_runs(per, ["model"], ["mae", "r2", "qwk"], n_samples=F.floor(F.avg("n")).cast("long"))


@query(f"with {PANEL}, {_icc_runs('cells')} select model, round(avg(mean_icc), 6) + 0.0 as mean, round(stddev_pop(mean_icc), 6) + 0.0 as std, count(mean_icc) as n_items from icc group by model")
def mean_icc_by_model(spark, d):
    return ratings.mean_icc(ratings.icc_over_runs(_cells(spark, d), ["model", "item"]))


@query(f"with {PANEL}, e as (select model, item, run, avg(abs(ground_truth - rating)) as mae, {_r2()} as r2, {_icc('icc3k')} as icc from cells where failure = 0 group by all) select model, item, count(*) as n_runs, {', '.join(f'round({f}({v}), 6) + 0.0 as {n}_{v}' for v in ('mae', 'r2', 'icc') for n, f in (('mean', 'avg'), ('std', 'stddev_pop')))} from e group by all")
def evaluator_by_item(spark, d):
    return ratings.evaluated(_cells(spark, d))


@query(f"with {SCORED}, {MEASURED0.replace('kappa', 'kappa0').replace('labels as', 'labels0 as').replace('from labels)', 'from labels0)').replace('ranked', 'ranked0')}, a as (select model, item, avg(qwk) as qwk from scored group by all union all select model, 0, avg(qwk) from gates0 where status = 'scored' and model < 2 group by model) select model, round(coalesce(max(case when item = 0 then qwk end), avg(case when item > 0 then qwk end)), 6) + 0.0 as qwk, max(case when item = 0 then qwk end) is null as fallback from a group by model")
def overall_qwk(spark, d):
    items = _scored(spark, d).groupBy("model", "item").agg(F.avg("qwk").alias("qwk"))
    stored = _measured_totals(spark, d).filter("status = 'scored' and model < 2").groupBy("model").agg(F.avg("qwk").alias("qwk")).withColumn("item", F.lit(0))
    return ratings.overall(items.unionByName(stored), "qwk")


@query(f"with {PANEL} select g.model, count(*) filter (where failure = 0) as ok, count(*) filter (where failure = 1) as failed, count(*) filter (where failure is null) as skipped from grid g left join cells c using (session, item, model, run) group by g.model")
def progress_counts(spark, d):
    return ratings.progress(grid(spark, d), _cells(spark, d))


_ABLATION = f"""{PANEL}, ab as (select session % 4 as config, item, model % 2 = 0 as reasoning, avg(abs(ground_truth - rating)) as mae from cells group by all)"""


def _ablation(spark, d):
    return _cells(spark, d).groupBy((F.col("session") % 4).alias("config"), "item", (F.col("model") % 2 == 0).alias("reasoning")).agg(A.mae("ground_truth", "rating").alias("mae"))


@query(f"with {_ABLATION} select config, round(median(n.mae - r.mae), 6) + 0.0 as median_delta, count(*) as pairs from (select * from ab where reasoning) r join (select * from ab where not reasoning) n using (config, item) group by config")
def median_paired_delta(spark, d):
    return ratings.paired_delta(_ablation(spark, d), ["config", "item"], "mae").groupBy("config").agg(F.median("delta").alias("median_delta"), F.count("*").alias("pairs"))


@query(f"with {_ABLATION} select config, reasoning, {', '.join(f'round(max(case when item = {i} then mae end), 6) + 0.0 as item_{i}' for i in range(1, 11))}, round(median(mae), 6) + 0.0 as median, round(avg(mae), 6) + 0.0 as mean, round(stddev_pop(mae), 6) + 0.0 as std, round(min(mae), 6) + 0.0 as low, round(max(mae), 6) + 0.0 as high from ab group by config, reasoning")
def ablation_table(spark, d):
    own = _ablation(spark, d)
    items = [F.max(F.when(F.col("item") == i, F.col("mae"))).alias(f"item_{i}") for i in range(1, 11)]
    return own.groupBy("config", "reasoning").agg(*items, F.median("mae").alias("median"), F.avg("mae").alias("mean"), F.stddev_pop("mae").alias("std"), F.min("mae").alias("low"), F.max("mae").alias("high"))


@query("with t as (select c_custkey as session, list_sum([(7*c_custkey + 3*i + c_custkey % 11) % 7 for i in range(1, 11)]) as total, cast(floor(abs(c_acctbal)) as bigint) % 61 as stored from customer where c_custkey % 19 <> 0) select cast(session as bigint) as session, cast(total as bigint) as total, stored, total = stored as equal from t")
def total_truth_check(spark, d):
    s = F.col("c_custkey").cast("long")
    label = lambda i: (7 * s + 3 * i + s % 11) % 7
    # a session without its fifth label has no total
    wide = dealt(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey").select(s.alias("session"), (F.floor(F.abs("c_acctbal")).cast("long") % 61).alias("stored"), *((F.when(s % 19 != 0, label(i)) if i == 5 else label(i)).alias(f"label_{i}") for i in range(1, 11)))
    long = tables.unpivoted(wide, ["session"], {f"label_{i}": i for i in range(1, 11)}, "item", "ground_truth")
    return ratings.total_truth(long).join(wide.select("session", "stored"), "session").withColumn("equal", F.col("total") == F.col("stored"))


@query(f"with {PANEL}, v as (select distinct item, session from cells where (session + item) % 5 = 0) select item, count(*) as sessions from (select item, session from v union select 0, session from v) group by item")
def session_union(spark, d):
    valid = _cells(spark, d).filter((F.col("session") + F.col("item")) % 5 == 0).select("item", "session")
    return ratings.with_total_sessions(valid).groupBy("item").agg(F.count("*").alias("sessions"))


@query(f"with {PANEL}, v as (select distinct item, session from cells where (session + item) % 5 = 0) select model, item, count(*) as n from cells c where exists (select 1 from v where v.item = c.item and v.session = c.session) group by all")
def valid_cells(spark, d):
    own = _cells(spark, d)
    valid = own.filter((F.col("session") + F.col("item")) % 5 == 0).select("item", "session").distinct()
    return own.join(valid, ["item", "session"], "left_semi").groupBy("model", "item").agg(F.count("*").alias("n"))


_EVEN = "abs(rho) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: list_product(list_prepend(1.0, list_transform(range(1, k + 1), lambda j: (2 * j - 1) / (2.0 * j) * (1 - rho * rho))))))"
_ODD = "2 / pi() * (asin(abs(rho)) + abs(rho) * sqrt(1 - rho * rho) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda k: list_product(list_prepend(1.0, list_transform(range(1, k + 1), lambda j: 2.0 * j / (2 * j + 1) * (1 - rho * rho)))))), 0))"


@query(f"""with {PANEL}, {_icc_runs('cells')}, human(item, human) as (values {', '.join(f'({i}, {v})' for i, v in enumerate(HUMAN_ICC, 1))}),
b as (select model, round(mean_icc, 9) as x, human as y from icc join human using (item)),
k as (select model, rank() over (partition by model order by x) + (count(*) over (partition by model, x) - 1) / 2.0 as rx, rank() over (partition by model order by y) + (count(*) over (partition by model, y) - 1) / 2.0 as ry from b),
s as (select model, corr(rx, ry) as rho, count(*) as n from k group by model having count(*) >= 4),
p as (select *, case when abs(rho) >= 1 then 0 when n % 2 = 0 then 1 - {_EVEN} else 1 - {_ODD} end as p from s)
select model, round(rho, 6) + 0.0 as rho, n, round(p, 6) + 0.0 as p, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end as stars from p""")
def spearman_significance(spark, d):
    """Rank correlations with the human ones, their p-values and marks; a row a model."""
    human = spark.createDataFrame(list(enumerate(HUMAN_ICC, 1)), "item int, human double")
    own = ratings.icc_over_runs(_cells(spark, d), ["model", "item"]).withColumn("mean_icc", F.round("mean_icc", 9))
    own = ratings.spearman(own.join(F.broadcast(human), "item"), ["model"], "mean_icc", "human")
    return own.withColumn("p", ratings.spearman_p(F.col("rho"), F.col("n"))).withColumn("stars", ratings.stars(F.col("p"))).select("model", "rho", "n", "p", "stars")
