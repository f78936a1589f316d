"""The roster of queries over the rating panels and the driver's tables, each with a twin in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratersight.functions import agreement as A
from ratersight.functions import text as X
from ratersight.operators import features, ratings, tables, transcripts
from ratersight.sources.panels import grid, natural, panel, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Intraclass correlations of human raters for items 1 to 10.
HUMAN_ICC = (0.92, 0.94, 0.92, 0.86, 0.94, 0.90, 0.90, 0.94, 0.93, 0.97)

GRID = """grid as (select cast(c_custkey as bigint) as session, cast(i as int) as item, cast(m as int) as model, cast(r as int) as run
  from customer, range(1, 11) a(i), range(0, 5) b(m), range(0, 3) c(r))"""
PANEL = (
    GRID
    + """,
shown as (select *, cast((7*session + 3*item + session % 11) % 7 as int) as ground_truth, (13*session + 5*item + 11*model + 17*run) % 5 - 2 as d,
  (31*session + 7*item + 3*model + run) % 101 as h, (item + model + run) % 4 as g, model = 4 and item = 9 and run = 2 as forced from grid),
panel as (select session, item, model, run, ground_truth, cast(case when forced then null when h = 2 and g = 1 then 7 when h = 1 then null
  else least(greatest(ground_truth + d, 0), 6) end as double) as rating from shown where forced or not (h = 0 and g = 0)),
cells as (select session, item, model, run, ground_truth, coalesce(rating, ground_truth - 6) as rating, cast(rating is null as int) as failure from panel where coalesce(rating, 0) <= 6)"""
)


def _r2(y: str = "ground_truth", p: str = "rating") -> str:
    return f"case when count(*) < 2 then null when sum({y}*{y}) - sum({y})*sum({y})*1.0/count(*) <= 1e-12 then case when sum(({y}-{p})*({y}-{p})) <= 1e-12 then 1.0 else 0.0 end else 1 - sum(({y}-{p})*({y}-{p})) / (sum({y}*{y}) - sum({y})*sum({y})*1.0/count(*)) end"


def _qwk(of: str, keys: str) -> str:
    return f"""labels as (select distinct {keys}, v from (select {keys}, cast(ground_truth as double) as v from {of} union all select {keys}, cast(rating as double) from {of})),
ranked as (select *, dense_rank() over (partition by {keys} order by v) as at from labels),
kappa as (select {keys}, 1 - sum((a.at-b.at)*(a.at-b.at)) * 1.0 / nullif(sum(a.at*a.at) + sum(b.at*b.at) - 2.0*sum(a.at)*sum(b.at)/count(*), 0) as qwk
  from {of} t join ranked a using ({keys}) join ranked b using ({keys}) where a.v = t.ground_truth and b.v = t.rating group by {keys})"""


SCORED = f"""{PANEL},
{_qwk("cells", "model, run, item")},
measured as (select model, run, item, count(*) as n, cast(sum(failure) as bigint) as failures, avg(abs(ground_truth - rating)) as mae, {_r2()} as r2 from cells group by all),
gates as (select *, case when n <> (select count(*) from customer) then 'count_gate' when failures >= n - 10 then 'failure_gate' else 'scored' end as status from measured join kappa using (model, run, item)),
scored as (select * from gates where status = 'scored')"""
SUMS = f"""{PANEL},
sums as (select model, run, session, cast(sum(ground_truth) as bigint) as ground_truth, sum(rating) as rating from cells group by all having count(*) filter (where failure = 0) = 10)"""


def _icc(kind: str) -> str:
    y, p, n = "ground_truth", "rating", "count(*)"
    r, w, e, c = f"2*var_samp(({y}+{p})/2.0)", f"avg(({y}-{p})*({y}-{p}))/2.0", f"var_samp({y}-{p})/2.0", f"{n}*avg({y}-{p})*avg({y}-{p})/2.0"
    top, bottom = {"icc1": (f"{r}-{w}", f"{r}+{w}"), "icc2": (f"{r}-{e}", f"{r}+{e}+2*({c}-{e})/{n}"), "icc3": (f"{r}-{e}", f"{r}+{e}"), "icc1k": (f"{r}-{w}", r), "icc2k": (f"{r}-{e}", f"{r}+({c}-{e})/{n}"), "icc3k": (f"{r}-{e}", r)}[kind]
    return f"({top}) / nullif({bottom}, 0)"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, and no negative zeros, so that engines agree."""
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def query(sql: str | None):
    """Register a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return ratings.cells(panel(spark, d))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    expected = table(spark, d, "customer").agg(F.count("*").alias("expected"))
    return ratings.gated(ratings.metrics(_cells(spark, d)), expected)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).filter("status = 'scored'")


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 as {c.split(' ')[-1]}" for c in columns)


@query(f"with {SCORED} select model, run, item, n, failures, status, {', '.join(f'round(case when status = {chr(39)}scored{chr(39)} then {c} end, 6) + 0.0 as {c}' for c in ('mae', 'r2', 'qwk'))} from gates")
def item_metrics_by_run(spark, d):
    return _measured(spark, d)


@query(f"with {PANEL}, {_qwk('cells', 'model, run, item')} select model, run, item, {_r('qwk')} from kappa")
def item_qwk_by_run(spark, d):
    return ratings.qwk(_cells(spark, d), ratings.CELL)


@query(f"with {SUMS}, {_qwk('sums', 'model, run')} select model, run, {_r('qwk')} from kappa")
def total_qwk_sparse(spark, d):
    return ratings.qwk(ratings.item_sums(_cells(spark, d)), ["model", "run"])


_OVER = ", ".join(f"round({f}({v}), 6) + 0.0 as {n}_{v}" for v in ("mae", "r2", "qwk") for n, f in (("mean", "avg"), ("std", "stddev_pop")))


@query(f"with {SCORED} select model, item, count(*) as n_runs, {_OVER} from scored group by all")
def item_metrics_over_runs(spark, d):
    return ratings.over_runs(_scored(spark, d), ["model", "item"], ["mae", "r2", "qwk"])


@query(f"with {SCORED}, per as (select model, run, avg(mae) as mae, avg(r2) as r2, avg(qwk) as qwk, sum(failures) as failures from scored group by all) select model, count(*) as n_runs, {_OVER}, cast(sum(failures) as bigint) as failures from per group by model")
def model_macro_over_runs(spark, d):
    per = ratings.macro(_scored(spark, d))
    return ratings.over_runs(per, ["model"], ["mae", "r2", "qwk"]).join(per.groupBy("model").agg(F.sum("failures").alias("failures")), "model")


@query(f"with {PANEL}, c as (select model, run, item, count(*) as n from cells group by all) select model, item, max(n) as num_samples from c group by all")
def num_samples(spark, d):
    return _cells(spark, d).groupBy("model", "run", "item").agg(F.count("*").alias("n")).groupBy("model", "item").agg(F.max("n").alias("num_samples"))


@query(f"with {SUMS}, {_qwk('sums', 'model, run')} select model, run, count(*) as n, round(avg(abs(ground_truth - rating)), 6) + 0.0 as mae, round({_r2()}, 6) + 0.0 as r2, round(any_value(qwk), 6) + 0.0 as qwk from sums join kappa using (model, run) group by model, run")
def item_sum_metrics(spark, d):
    return ratings.metrics(ratings.item_sums(_cells(spark, d)), ["model", "run"]).select("model", "run", "n", "mae", "r2", "qwk")


@query(f"""with {PANEL}, bad as (select g.model, g.run, g.session, g.item, case when c.failure is null then 'absent' when c.failure = 1 then 'failure' end as bad from grid g left join cells c using (session, item, model, run)),
f as (select model, run, session, arg_min(bad, item) as first from bad where bad is not null group by all)
select model, run, count(*) as incomplete, count(*) filter (where first = 'failure') as failures from f group by all""")
def first_bad_item_failures(spark, d):
    return ratings.first_bad(grid(spark, d), _cells(spark, d))


def _f1(of: str, keys: str, cut: int) -> str:
    return f"""b as (select {keys}, cast(ground_truth >= {cut} as int) as y, cast(rating >= {cut} as int) as p from {of}),
t as (select {keys}, count(*) as n, count(*) filter (where y = 1 and p = 1) as tp, count(*) filter (where y = 0 and p = 1) as fp, count(*) filter (where y = 1 and p = 0) as fn from b group by all)
select {keys}, round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 6) + 0.0 as precision, round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 6) + 0.0 as recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 as f1, n from t"""


@query(f"with {PANEL}, ok as (select * from cells where failure = 0), {_f1('ok', 'model, run, item', 3)}")
def item_f1(spark, d):
    return ratings.classified(_cells(spark, d), ratings.CELL, 3)


@query(f"with {SUMS}, {_f1('sums', 'model, run', 20)}")
def total_f1(spark, d):
    return ratings.classified(ratings.item_sums(_cells(spark, d)), ["model", "run"], 20)


@query("""with p as (select cast(quality as int) as y, cast(n_chars >= 200 as int) as p from labels join documents using (doc_id)),
t as (select count(*) as n, count(*) filter (where y = 1 and p = 1) as tp, count(*) filter (where y = 0 and p = 1) as fp, count(*) filter (where y = 1 and p = 0) as fn from p)
select tp, fp, fn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 as f1, n from t""")
def label_rule_f1(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    y, p = F.col("quality").cast("int"), (F.col("n_chars") >= 200).cast("int")
    tp, fp, fn = A.confusion(y, p)
    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), A.f1(y, p).alias("f1"), F.count("*").alias("n"))


KINDS = ("icc1", "icc2", "icc3", "icc1k", "icc2k", "icc3k")


@query(f"with {PANEL} select model, item, count(*) as n, {', '.join(f'round({_icc(k)}, 6) + 0.0 as {k}' for k in KINDS)} from cells where failure = 0 group by model, item")
def icc_family(spark, d):
    return _cells(spark, d).filter("failure = 0").groupBy("model", "item").agg(F.count("*").alias("n"), *(A.icc("ground_truth", "rating", k).alias(k) for k in KINDS))


def _icc_runs(of: str) -> str:
    return f"""per as (select model, item, run, count(*) as n, {_icc("icc3")} as icc from {of} group by all having count(*) >= 10),
icc as (select model, item, avg(icc) as mean_icc, stddev_pop(icc) as std_icc, arg_max(n, run) as n_sessions from per group by all)"""


@query(f"with {PANEL}, {_icc_runs('cells')} select model, item, {_r('mean_icc', 'std_icc')}, n_sessions from icc")
def icc_over_runs(spark, d):
    return ratings.icc_over_runs(_cells(spark, d), ["model", "item"])


NATURAL = """nat as (select l_orderkey as session, l_linenumber as item, l_partkey % 5 as model, l_suppkey % 3 as run, max(least(6, cast(round(100*l_discount) as int))) as ground_truth, cast(max(least(6, cast(round(100*l_tax) as int))) as double) as rating from lineitem group by all)"""


@query(f"with {NATURAL}, {_icc_runs('nat')} select model, item, {_r('mean_icc', 'std_icc')}, n_sessions from icc")
def icc_natural_panel(spark, d):
    return ratings.icc_over_runs(natural(spark, d), ["model", "item"])


@query(f"with {PANEL}, {_icc_runs('cells')} select item, model % 2 = 0 as reasoning, round(avg(mean_icc), 6) + 0.0 as mean, round(stddev_pop(mean_icc), 6) + 0.0 as std, count(*) as models from icc group by all")
def group_mean_icc(spark, d):
    own = ratings.icc_over_runs(_cells(spark, d), ["model", "item"])
    return own.groupBy("item", (F.col("model") % 2 == 0).alias("reasoning")).agg(F.avg("mean_icc").alias("mean"), F.stddev_pop("mean_icc").alias("std"), F.count("*").alias("models"))


@query(f"""with {PANEL}, {_icc_runs('cells')}, human(item, human) as (values {', '.join(f'({i}, {v})' for i, v in enumerate(HUMAN_ICC, 1))}),
b as (select model, round(mean_icc, 9) as x, human as y from icc join human using (item)),
k as (select model, rank() over (partition by model order by x) + (count(*) over (partition by model, x) - 1) / 2.0 as rx, rank() over (partition by model order by y) + (count(*) over (partition by model, y) - 1) / 2.0 as ry from b)
select model, round(corr(rx, ry), 6) + 0.0 as rho, count(*) as n from k group by model having count(*) >= 4""")
def spearman_vs_reference(spark, d):
    human = spark.createDataFrame(list(enumerate(HUMAN_ICC, 1)), "item int, human double")
    own = ratings.icc_over_runs(_cells(spark, d), ["model", "item"]).withColumn("mean_icc", F.round("mean_icc", 9))
    return ratings.spearman(own.join(F.broadcast(human), "item"), ["model"], "mean_icc", "human")


@query(f"with {PANEL} select g.model, g.run, g.item, count(*) as gaps from grid g anti join cells c using (session, item, model, run) group by all")
def expected_grid_gaps(spark, d):
    return ratings.gaps(grid(spark, d), _cells(spark, d))


@query(f"with {PANEL} select model, item, count(*) as n from cells where not (session % 97 = item) group by all")
def exclusion_anti_join(spark, d):
    excluded = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("session")).withColumn("item", (F.col("session") % 97).cast("int")).filter("item between 1 and 10")
    return _cells(spark, d).join(excluded, ["session", "item"], "left_anti").groupBy("model", "item").agg(F.count("*").alias("n"))


@query("select conv_id, turn from conversations c where trim(text) <> '' and not exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn and p.turn % 3 = 0)")
def resume_anti_join(spark, d):
    asked = table(spark, d, "conversations").filter(F.trim("text") != "").select("conv_id", "turn")
    return asked.join(table(spark, d, "conversations").filter("turn % 3 = 0").select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")


@query("""select o_orderkey, o_custkey, c_mktsegment, coalesce(n_name, 'Unknown') as nation, coalesce(r_name, 'Unknown') as region from orders
left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def session_dims(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"), F.col("n_regionkey").alias("r_regionkey"))
    regions = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("region"))
    out = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey", "left")
    out = tables.lookup(tables.lookup(out, nations, ["n_nationkey"], {"nation": "Unknown"}), regions, ["r_regionkey"], {"region": "Unknown"})
    return out.select("o_orderkey", "o_custkey", "c_mktsegment", "nation", "region")


_FIRST = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1"


@query(f"select o_orderkey, l_partkey as first_part from orders join (select l_orderkey, l_partkey from lineitem qualify {_FIRST}) on l_orderkey = o_orderkey")
def first_match_lookup(spark, d):
    first = tables.keep_first(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])
    return table(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("l_partkey").alias("first_part"))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) = 1")
def dedupe_keep_first(spark, d):
    return tables.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select o_orderkey, o_custkey, case when o_orderdate is not null then dense_rank() over (partition by o_custkey order by o_orderdate nulls last) end as visit_no from orders")
def visit_number(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", tables.visit_number("o_custkey", "o_orderdate").alias("visit_no"))


#: Keys with wide gaps, in another order than the customers' own.
_SPARSE = "c_custkey * 2654435761 % 4294967296 * 2147483648"


@query(f"with t as (select c_custkey, row_number() over (order by {_SPARSE}) as place, count(*) over () as total from customer) select c_custkey, cast(case when total // 7 = 0 then 6 else least((place - 1) // greatest(total // 7, 1), 6) end as int) as shard from t")
def shard_assignment(spark, d):
    own = table(spark, d, "customer").select("c_custkey", F.expr(_SPARSE.replace("c_custkey", "cast(c_custkey as bigint)")).alias("key"))
    return tables.ranked_rows(own, "key").select("c_custkey", tables.shard("place", 7, F.col("total")).alias("shard"))


@query(f"with {SCORED}, m as (select model, item, avg(mae) as mae from scored group by all), k as (select *, row_number() over (partition by item order by round(mae, 9), model) as place from m) select item, place, model, {_r('mae')} from k where place <= 3")
def rank_top3(spark, d):
    own = _scored(spark, d).groupBy("model", "item").agg(F.avg("mae").alias("mae"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.round("mae", 9), "model"))
    return own.withColumn("place", place.cast("long")).filter("place <= 3").select("item", "place", "model", "mae")


@query(f"with {SCORED} select model, round(avg(mae), 6) + 0.0 as mae from scored group by model order by round(avg(mae), 9), model limit 5")
def top5_models(spark, d):
    return _scored(spark, d).groupBy("model").agg(F.avg("mae").alias("mae")).orderBy(F.round("mae", 9), "model").limit(5)


@query(f"""with {SCORED}, m as (select model, item, avg(mae) as mae from scored group by all)
select a.item, a.model as reasoning, b.model as other, round(b.mae - a.mae, 6) + 0.0 as delta from m a join m b using (item) where a.model % 2 = 0 and b.model = a.model + 1""")
def paired_ablation_delta(spark, d):
    own = _scored(spark, d).groupBy("model", "item").agg(F.avg("mae").alias("mae"))
    a = own.filter("model % 2 = 0").select("item", F.col("model").alias("reasoning"), F.col("mae").alias("x"), (F.col("model") + 1).alias("other"))
    b = own.select("item", F.col("model").alias("other"), F.col("mae").alias("y"))
    return a.join(b, ["item", "other"]).select("item", "reasoning", "other", (F.col("y") - F.col("x")).alias("delta"))


@query(f"""with {SCORED} select model, count(mae) as n, round(median(mae), 6) + 0.0 as median, round(avg(mae), 6) + 0.0 as mean, round(stddev_pop(mae), 6) + 0.0 as std, round(min(mae), 6) + 0.0 as low, round(max(mae), 6) + 0.0 as high,
{', '.join(f'round(quantile_cont(mae, {q}), 6) + 0.0 as {n}' for q, n in ((0.25, 'q1'), (0.75, 'q3'), (0.05, 'p5'), (0.95, 'p95')))} from scored group by model""")
def box_stats(spark, d):
    return tables.box(_scored(spark, d), ["model"], "mae")


@query(f"""with {SCORED}, q as (select quantile_cont(round(qwk, 9), 0.25) as lo, quantile_cont(round(qwk, 9), 0.75) as hi from scored)
select model, run, item, cast(case when round(qwk, 9) < lo then 0 when round(qwk, 9) >= hi then 2 else 1 end as int) as quartile_tint, cast(case when mae < 0.6 then 0 when mae >= 1.2 then 2 else 1 end as int) as fixed_tint from scored, q where qwk is not null""")
def quartile_tints(spark, d):
    own = _scored(spark, d).filter("qwk is not null").withColumn("qwk", F.round("qwk", 9))
    q = own.agg(F.percentile("qwk", F.lit(0.25)).alias("lo"), F.percentile("qwk", F.lit(0.75)).alias("hi"))
    return own.join(F.broadcast(q)).select("model", "run", "item", X.tint(F.col("qwk"), F.col("lo"), F.col("hi")).alias("quartile_tint"), X.tint(F.col("mae"), 0.6, 1.2).alias("fixed_tint"))


@query(f"with {SCORED} select model, run, item, abs(mae - min(mae) over (partition by item)) <= 1e-6 as best, abs(mae - max(mae) over (partition by item)) <= 1e-6 as worst from scored")
def best_worst_flags(spark, d):
    return tables.flags(_scored(spark, d), ["item"], "mae").select("model", "run", "item", "best", "worst")


@query(f"with {PANEL} select session, item, model, {', '.join(f'max(case when run = {r} and failure = 0 then rating end) as rating_{r}, max(case when run = {r} and failure = 0 then abs(rating - ground_truth) end) as error_{r}' for r in range(3))} from cells group by session, item, model")
def wide_by_run(spark, d):
    own = _cells(spark, d).withColumn("rating", F.when(F.col("failure") == 0, F.col("rating"))).withColumn("error", F.abs(F.col("rating") - F.col("ground_truth")))
    # a pivot of named values in one pass over the cells
    return own.groupBy("session", "item", "model").agg(*(F.max(F.when(F.col("run") == r, F.col(v))).alias(f"{v}_{r}") for r in range(3) for v in ("rating", "error")))


@query(f"with {PANEL} select session, item, model, run, max(rating) as rating from cells where failure = 0 group by all")
def long_by_seed(spark, d):
    wide = wide_by_run(spark, d)
    parts = ", ".join(f"{r}, rating_{r}" for r in range(3))
    return wide.selectExpr("session", "item", "model", f"stack(3, {parts}) as (run, rating)").filter("rating is not null")


@query(f"with {SCORED}, m as (select model, item, avg(mae) as mae from scored group by all) select model, {', '.join(f'round(max(case when item = {i} then mae end), 6) + 0.0 as i{i}' for i in range(1, 11))}, round(avg(mae), 6) + 0.0 as mean from m group by model")
def wide_by_item(spark, d):
    own = _scored(spark, d).groupBy("model", "item").agg(F.avg("mae").alias("mae"))
    wide = own.groupBy("model").pivot("item", list(range(1, 11))).agg(F.max("mae"))
    wide = wide.select("model", *(F.col(str(i)).alias(f"i{i}") for i in range(1, 11)))
    return wide.join(own.groupBy("model").agg(F.avg("mae").alias("mean")), "model")


@query(f"with {PANEL}, {_icc_runs('cells')} select item, {', '.join(f'round({f}, 6) + 0.0 as {n}' for f, n in (('min(mean_icc)', 'worst'), ('max(mean_icc)', 'best'), ('avg(mean_icc) filter (where model % 2 = 0)', 'mean_reasoning'), ('avg(mean_icc) filter (where model % 2 = 1)', 'mean_other')))} from icc group by item")
def items_as_rows(spark, d):
    own, odd = ratings.icc_over_runs(_cells(spark, d), ["model", "item"]), F.col("model") % 2
    return own.groupBy("item").agg(F.min("mean_icc").alias("worst"), F.max("mean_icc").alias("best"), F.avg(F.when(odd == 0, F.col("mean_icc"))).alias("mean_reasoning"), F.avg(F.when(odd == 1, F.col("mean_icc"))).alias("mean_other"))


@query("""select p_partkey, case when length(trim(split_part(p_name, '(', 1))) > 28 then substr(trim(split_part(p_name, '(', 1)), 1, 25) || '...' else trim(split_part(p_name, '(', 1)) end as short,
case when p_size * 30000 >= 1000000 then cast(p_size * 30000 // 1000000 as varchar) || 'm' else cast(p_size * 30000 // 1000 as varchar) || 'k' end as context,
case when length(s) > 31 then substr(s, 1, 28) || '...' else s end as sheet from (select *, lpad(cast(p_size % 11 as varchar), 2, '0') || ' - ' || p_name as s from part)""")
def model_labels(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.short_name(F.col("p_name")).alias("short"), X.context(F.col("p_size").cast("long") * 30000).alias("context"), X.sheet_name(F.col("p_size") % 11, F.col("p_name")).alias("sheet"))


_K = "cast(json_extract_string(props, '$.k') as bigint)"
_BODY = f"case event_id % 6 when 0 then '{{\"rating\": ' || {_K} || '}}' when 1 then '{{\"rating\": ' || {_K} || '.7, \"explanation\": \"x\"}}' when 2 then 'text \"Rating\": ' || {_K} || '.5 explanation: why' when 3 then '{{\"rating\": null}}' when 4 then 'none' else '{{\"rating\": \"' || {_K} || '\"}}' end"


@query(f"""with b as (select event_id, event_id % 6 as kind, {_K} as k, {_BODY} as body from events)
select event_id, cast(case when kind in (0, 5) then k when kind = 1 then k + 0.7 when kind = 2 then floor(cast(regexp_extract(body, '(?i)"rating":\\s*(\\d+(\\.\\d+)?)', 1) as double)) end as double) + 0.0 as rating,
case when kind = 1 then 'x' when kind = 2 then regexp_extract(body, '(?i)explanation:\\s*([^\\n]+)', 1) end as explanation from b""")
def rating_extraction(spark, d):
    k = F.get_json_object("props", "$.k")
    e, kind = table(spark, d, "events"), F.col("event_id") % 6
    body = (
        F.when(kind == 0, F.concat(F.lit('{"rating": '), k, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"rating": '), k, F.lit('.7, "explanation": "x"}')))
        .when(kind == 2, F.concat(F.lit('text "Rating": '), k, F.lit(".5 explanation: why")))
        .when(kind == 3, F.lit('{"rating": null}'))
        .when(kind == 4, F.lit("none"))
        .otherwise(F.concat(F.lit('{"rating": "'), k, F.lit('"}')))
    )
    own = e.select("event_id", body.alias("body"))
    return own.select("event_id", X.rating(F.col("body")).alias("rating"), X.explanation(F.col("body")).alias("explanation"))


@query("select doc_id, cast((length(text) - length(replace(text, 'the', ''))) / 3 as int) as cues, cast(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) as int) as tokens from documents")
def cue_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.count_of(t, "the").alias("cues"), F.size(X.tokens(t)).alias("tokens"))


@query("select max(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) + 2 * cast((length(text) - length(replace(text, 'the', ''))) / 3 as int)) as budget, max(length(text)) as longest from documents")
def prompt_budget(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").agg(F.max((F.size(X.tokens(t)) + 2 * X.count_of(t, "the")).cast("long")).alias("budget"), F.max(F.length(t).cast("long")).alias("longest"))


@query("select conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')[-5:], ' ') as kept from conversations")
def keep_last_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.keep_last(F.col("text"), 5).alias("kept"))


_CLOCK = "lpad(cast({0} // 3600000 as varchar), 2, '0') || ':' || lpad(cast({0} // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast({0} // 1000 % 60 as varchar), 2, '0') || '.' || lpad(cast({0} % 1000 as varchar), 3, '0')"


@query(f"select conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_CLOCK.format('(turn * 61500)')} || ' --> ' || {_CLOCK.format('(turn * 61500 + 30250)')} || chr(10) || coalesce(text, '') || chr(10), chr(10) order by turn) as vtt from conversations group by conv_id")
def vtt_render(spark, d):
    c = table(spark, d, "conversations").withColumns({"start": F.col("turn") * 61.5, "end": F.col("turn") * 61.5 + 30.25})
    return transcripts.vtt(c, "conv_id", "turn", "start", "end", "text")


@query("""with s as (select distinct conv_id, conv_id % 3 as k from conversations),
r as (select conv_id, 1 as item, k as lo, k as hi from s union all select conv_id, 1, k + 2, k + 4 from s union all select conv_id, 2, 3, 3 from s union all select conv_id, 3, 1 + conv_id % 2, 600 from s)
select c.conv_id, item, turn from conversations c join r on c.conv_id = r.conv_id and turn between lo and hi""")
def line_range_segments(spark, d):
    own, k = table(spark, d, "conversations"), (F.col("conv_id") % 3).cast("int")
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    spec = lambda i, *parts: F.struct(F.lit(i).alias("item"), text(*parts).alias("spec"))
    specs = own.select("conv_id").distinct().select("conv_id", F.inline(F.array(spec(1, k, ", ", k + 2, "-", k + 4), spec(2, "3, x"), spec(3, F.col("conv_id") % 2 + 1, "-600"))))
    return tables.in_ranges(own.select("conv_id", "turn"), specs, "conv_id", "turn").select("conv_id", "item", "turn")


@query("with t as (select conv_id, turn, length(coalesce(text, '')) % 3 as k from conversations) select conv_id, turn, cast(unnest(case when k = 0 then [-1] when k = 1 then [3] else [2, 4] end) as int) as item from t")
def question_multilabel(spark, d):
    k = F.length(F.coalesce("text", F.lit(""))) % 3
    spec = F.element_at(F.array(F.lit("-1"), F.lit("3"), F.lit("2,4")), (k + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split(spec, ",").cast("array<int>")).alias("item"))


_GAPS = "g as (select user_id, datediff('microsecond', ts, lead(ts) over (partition by user_id order by ts, event_id)) / 1e6 as gap from events)"


@query(f"with {_GAPS} select count(*) as n, round(avg(gap), 3) + 0.0 as mean, round(median(gap), 3) + 0.0 as median, round(quantile_cont(gap, 0.9), 3) + 0.0 as p90, round(stddev_pop(gap), 3) + 0.0 as std from g where gap > 0")
def event_gap_stats(spark, d):
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gaps = table(spark, d, "events").select((F.timestamp_diff("MICROSECOND", F.col("ts"), after) / 1e6).alias("gap")).filter("gap > 0")
    return rounded(tables.pauses(gaps, [], "gap").select("n", "mean", F.col("p50").alias("median"), "p90", "std"), 3)


@query("""with e as (select user_id, event_id, ts, coalesce(cast(datediff('microsecond', lag(ts) over (partition by user_id order by ts, event_id), ts) >= 36000000000 as int), 0) as new from events)
select user_id, event_id, cast(sum(new) over (partition by user_id order by ts, event_id) as bigint) as segment from e""")
def gap_segments(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) >= 36_000_000_000).cast("long"), F.lit(0))
    return table(spark, d, "events").withColumn("new", new).select("user_id", "event_id", F.sum("new").over(w).alias("segment"))


@query("""with t as (select doc_id, n_chars, cast(ceil(n_chars / 700.0) as bigint) as k from documents where n_chars > 0)
select doc_id, no, no * (n_chars // k) + least(no, n_chars % k) as start, n_chars // k + cast(no < n_chars % k as bigint) as size from (select *, unnest(range(0, k)) as no from t)""")
def equal_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(tables.equal_chunks(F.col("n_chars"), 700)))


@query("""with u as (select conv_id, turn, length(text) as n, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from conversations)
select conv_id, turn, cast(before as bigint) as start, cast(before + n as bigint) as "end" from u""")
def offset_merge(spark, d):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("text").cast("long")
    own = table(spark, d, "conversations").withColumn("start", F.coalesce(F.sum(n).over(before), F.lit(0)))
    return own.select("conv_id", "turn", "start", (F.col("start") + n).alias("end"))


#: Words at an even pace, every ninth with a dash at its end and every eleventh with white space; the rules are applied word by word.
_SEGMENTS = """with recursive t as (select conv_id as track, turn, string_split_regex(coalesce(text, ''), '\\s+') as ws from conversations),
x as (select track, turn, unnest(range(0, len(ws))) as i, ws from t),
v as (select track, turn * 100000 + i as no, ws[i + 1] || case when (turn * 100000 + i) % 9 = 4 then chr(8212) when (turn * 100000 + i) % 11 = 5 then ',  ' else '' end as word, turn * 600.0 + i * 0.5 + case when i % 7 = 6 then 0.3 else 0.0 end + case when i % 9 = 5 then 0.15 else 0.0 end as start from x where ws[i + 1] <> ''),
n as (select track, row_number() over w as rn, word, round(start, 3) as start, round(start + 0.25, 3) as fin, round(lead(start) over w - start - 0.25, 3) as gap, no from v window w as (partition by track order by no)),
m as (select track, rn, word, start, fin, gap, no, right(rtrim(word), 1) as mark, coalesce(max(case when contains(word, '?') then rn end) over (partition by track order by rn rows between unbounded preceding and current row), 0) as asked from n),
r(track, rn, first, began, reason) as (
  select track, cast(0 as bigint), cast(1 as bigint), min(start), 'begin' from m group by track
  union all
  select m.track, m.rn, case when r.reason in ('', 'begin') then r.first else m.rn end, case when r.reason in ('', 'begin') then r.began else m.start end,
    case when m.gap is null then 'final' when m.gap >= 2 then 'pause_' || printf('%.2f', m.gap) || 's' when m.mark in ('.', '!', '?') and m.gap > 0.2 then 'sentence_end'
    when m.mark in (',', ';', ':', chr(8212), chr(8211)) and m.gap > 0.3 then case when m.fin - (case when r.reason in ('', 'begin') then r.began else m.start end) >= 2 then 'clause_boundary' else '' end
    when m.fin - (case when r.reason in ('', 'begin') then r.began else m.start end) >= 30 then 'max_duration'
    when m.gap > 0.3 and m.asked >= greatest(m.rn - 4, case when r.reason in ('', 'begin') then r.first else m.rn end) then 'post_question' else '' end
  from r join m on m.track = r.track and m.rn = r.rn + 1),
e as (select track, rn, first, began, reason from r where reason not in ('', 'begin'))
select e.track, row_number() over (partition by e.track order by e.rn) - 1 as no, round(e.began, 3) as start, round(any_value(l.fin), 3) as "end", regexp_replace(string_agg(m.word, ' ' order by m.rn), '^\\s+|\\s+$', '', 'g') as text, cast(trunc(e.began / 0.01) as bigint) as start_offset, cast(trunc(any_value(l.fin) / 0.01) as bigint) as end_offset, e.reason from e join m on m.track = e.track and m.rn between e.first and e.rn join m l on l.track = e.track and l.rn = e.rn group by e.track, e.rn, e.began, e.reason"""


@query(_SEGMENTS)
def pause_segments_full(spark, d):
    own = transcripts.spoken(table(spark, d, "conversations"))
    at, no = F.col("no") % 100_000, F.col("no")
    mark = F.when(no % 9 == 4, "\u2014").when(no % 11 == 5, ",  ").otherwise("")
    own = own.withColumns({"word": F.concat("word", mark), "start": F.col("start") + F.when(at % 9 == 5, 0.15).otherwise(0.0)}).withColumn("end", F.col("start") + 0.25)
    own = own.withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})
    return rounded(transcripts.pause_segments(own), 3)


_FRAME = f"""{PANEL},
seeds as (select session, item, model, avg(case when failure = 0 then rating end) as rating, avg(case when failure = 1 then 6 else abs(rating - ground_truth) end) as abs_error, min(ground_truth) as severity, count(*) as n from cells group by all),
framed as (select *, session % 50 as patient, model % 2 = 0 as reasoning, log10(model + 1) as log_params from seeds)"""


@query(f"""with {_FRAME}, c as (select *, avg(severity) over (partition by patient, item) as severity_between from framed),
t as (select avg(log_params) as m, stddev_samp(log_params) as s from framed),
z as (select session, item, model, abs_error, severity_between, severity - severity_between as severity_within, log_params, (log_params - m) / s as log_params_z from c, t)
select session, item, model, {_r('abs_error', 'severity_between', 'severity_within', 'log_params_z')} from z""")
def lme_features(spark, d):
    return features.frame(_cells(spark, d)).select("session", "item", "model", "abs_error", "severity_between", "severity_within", "log_params_z")


@query(f"with {_FRAME} select count(distinct severity) >= 2 as severity, count(distinct log_params) >= 2 as log_params, count(distinct 1) >= 2 as constant, count(distinct reasoning) >= 2 as reasoning from framed")
def prune_terms(spark, d):
    own = features.frame(_cells(spark, d)).withColumn("constant", F.lit(1))
    return features.prunable(own, ["severity", "log_params", "constant", "reasoning"])
