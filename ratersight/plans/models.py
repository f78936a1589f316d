"""Queries over sessions with their dimensions, the model table, labels and texts, each with its twin in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ratersight.functions import text as X
from ratersight.operators import dimensions, features, ratings, tables, transcripts
from ratersight.plans.roster import PANEL, SCORED, _cells, _r, _scored, query, rounded
from ratersight.sources import panels, stages
from ratersight.sources.panels import table
from ratersight.sources.stages import kept

MODELS = "models(model, name, variant, reasons, total_params, active_params, context_length, arch) as (values " + ", ".join("(" + ", ".join("null" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in panels.MODEL_TABLE) + ")"


@query("""with s as (select o_custkey as patient, case when o_orderkey % 13 <> 0 then cast(o_orderkey as varchar) end as session, case when o_orderkey % 7 <> 0 then o_orderdate end as date, o_orderpriority as site from orders),
r as (select o_custkey as patient, cast(l_orderkey as varchar) as session, l_linenumber as line, l_shipmode as mode from (select *, l_linestatus as l_shipmode from lineitem) join orders on l_orderkey = o_orderkey where l_returnflag = 'R'),
f as (select * from r qualify row_number() over (partition by patient, session order by line, mode) = 1),
j as (select c.c_custkey as patient, c.c_mktsegment as site, s.session, s.date, f.line, f.mode from customer c left join s on c.c_custkey = s.patient left join f on f.patient = s.patient and f.session = s.session),
v as (select *, case when date is not null then dense_rank() over (partition by patient order by date nulls last) end as visit_no from j)
select patient, session, site, cast(line as double) as line, mode, cast(visit_no as double) as visit_no from v where session is not null""")
def load_sessions(spark, d):
    patients = table(spark, d, "customer").select(F.col("c_custkey").alias("patient"), F.col("c_mktsegment").alias("site"))
    key = F.col("o_orderkey")
    sessions = table(spark, d, "orders").select(F.col("o_custkey").alias("patient"), F.when(key % 13 != 0, key.cast("string")).alias("session"), F.when(key % 7 != 0, F.col("o_orderdate")).alias("date"), F.col("o_orderpriority").alias("site"))
    of = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject_id"))
    path = F.concat(F.lit("/tracks/"), F.col("l_orderkey").cast("string"), F.lit("/all.mp4"))
    reports = table(spark, d, "lineitem").join(of, "l_orderkey").select("subject_id", F.when(F.col("l_returnflag") == "R", "RA").otherwise("other").alias("interview_type"), path.alias("path"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("mode"), F.lit("report").alias("site"))
    out = dimensions.load_sessions(patients, sessions, reports, order=("line", "mode"))
    return out.select("patient", "session", "site", F.col("line").cast("double").alias("line"), "mode", F.col("visit_no").cast("double").alias("visit_no"))


@query("with l as (select l_orderkey as session, l_linenumber as place, case when l_partkey % 5 = 0 then 'none' else cast(l_partkey % 7 as varchar) end as label from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) = 1) select o_orderkey as session, cast(label as int) as label from orders join l on o_orderkey = session where label <> 'none' and o_orderkey % 3 <> 0")
def labelled_texts(spark, d):
    texts = table(spark, d, "orders").select(F.col("o_orderkey").alias("session"), F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise("said").alias("text"))
    label = F.when(F.col("l_partkey") % 5 == 0, "none").otherwise((F.col("l_partkey") % 7).cast("string"))
    labels = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.struct("l_linenumber", "l_partkey").alias("place"), label.alias("label"))
    return dimensions.labelled(texts, labels, "label").select("session", "label")


@query("select l_partkey % 40 as model, count(*) as n from lineitem where l_partkey % 40 in (select p_partkey from part where p_partkey < 30) and l_partkey % 40 not in (3, 7, 11) group by 1")
def models_in_table(spark, d):
    own = table(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("model"))
    return tables.listed(own, "model", table(spark, d, "part").filter("p_partkey < 30"), "p_partkey", deny=(3, 7, 11)).groupBy("model").agg(F.count("*").alias("n"))


@query("select l_partkey % 40 as model, count(*) as n from lineitem where l_partkey % 40 in (5, 29) group by 1")
def models_allowed(spark, d):
    own = table(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("model"))
    return tables.listed(own, "model", table(spark, d, "part").filter("p_partkey < 30"), "p_partkey", allow=(5, 29, 35)).groupBy("model").agg(F.count("*").alias("n"))


@query("with k as (select p_name, min('key_' || p_partkey) as key from part where p_partkey % 4 = 0 group by p_name) select p_partkey, coalesce(k.key, part.p_name) as key from part left join k using (p_name)")
def display_keys(spark, d):
    p = table(spark, d, "part")
    names = p.filter("p_partkey % 4 = 0").select("p_name", F.concat(F.lit("key_"), F.col("p_partkey").cast("string")).alias("id"))
    return tables.renamed(p.select("p_partkey", "p_name"), "p_name", names, "p_name", "id", "key").select("p_partkey", "key")


_PARTS = """m as (select p_partkey as model, ['Qwen ', 'Llama ', 'Gemma ', 'GPT ', ''][p_size % 5 + 1] || p_name || ' ' || p_brand || ' (' || p_size || 'B)' as name, ['full', 'no_desc', 'no_dem', 'raw'][p_partkey % 4 + 1] as variant, p_partkey % 2 = 0 as reasoning,
p_size as total, case when p_size % 3 = 0 then p_size // 3 else p_size end as active, cast(round(p_retailprice * 100) as bigint) as context_length, case when p_type <> 'ECONOMY' then ['moe', 'dense', 'Dense', 'MoE'][p_size % 4 + 1] end as arch from part)"""


@query(f"""with {_PARTS} select model, case variant when 'no_desc' then 'No Desc' when 'no_dem' then 'No Dem' when 'raw' then 'Raw' else 'Full' end as variant,
case when total = active then total || 'B' else total || 'B(' || active || 'B)' end as size, case upper(arch) when 'MOE' then 'MoE' when 'DENSE' then 'Dense' else '---' end as arch,
case when contains(name, 'Qwen') then 'Qwen' when contains(name, 'Llama') then 'Llama' when contains(name, 'Gemma') then 'Gemma' when contains(name, 'GPT') then 'GPT' else 'Other' end as family,
round(log10(total * 1e9), 6) as log_params, case when length(trim(split_part(name, '(', 1))) > 22 then substr(trim(split_part(name, '(', 1)), 1, 19) || '...' else trim(split_part(name, '(', 1)) end as short,
case when context_length >= 1000000 then context_length // 1000000 || 'm' else context_length // 1000 || 'k' end as context, reasoning from m""")
def model_attributes(spark, d):
    c = F.col
    return panels.part_models(spark, d).select("model", X.shown_variant(c("variant")).alias("variant"), X.size_label(c("total_params"), c("active_params")).alias("size"), X.architecture(c("arch")).alias("arch"), X.family(c("name")).alias("family"), X.log_params(c("total_params")).alias("log_params"), X.short_name(c("name"), 22, 19).alias("short"), X.context(c("context_length")).alias("context"), (c("reasons") == "Yes").alias("reasoning"))


@query("""select conv_id, turn, cast(case when turn % 4 in (0, 1) then turn % 7 end as double) as free, cast(case when turn % 4 in (2, 3) and turn % 5 <> 0 then cast('1' || (turn % 7) as int) end as double) as digits, case when turn % 4 in (2, 3) and turn % 5 <> 0 then false else true end as pending from conversations""")
def free_text_ratings(spark, d):
    t, k = F.col("turn"), (F.col("turn") % 7).cast("string")
    # an earlier rating stands before the last one; lower-case ones have digits among other marks
    body = F.when(t % 4 < 2, F.concat(F.lit("Rating: 99\nso Rating: "), k, F.lit(" "))).when(t % 5 == 0, F.lit("rating: none\n4")).otherwise(F.concat(F.lit("rating: 8\nrating: (1"), k, F.lit(")\nas 7")))
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), body)  # after the turn's own text
    own = table(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))
    out = own.select("conv_id", "turn", X.last_rating(F.col("body")).cast("double").alias("free"), X.last_digits(F.col("body")).cast("double").alias("digits"))
    done = out.filter("digits is not null").select("conv_id", "turn", F.lit(False).alias("pending"))
    return out.join(done, ["conv_id", "turn"], "left").withColumn("pending", F.coalesce("pending", F.lit(True)))


@query("select event_id, cast(trunc(value / 0.01) as bigint) as step, case when event_id % 3 = 0 then '' else strftime(to_timestamp(event_id * 86461) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') end as made from events")
def ten_ms_steps(spark, d):
    made = F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("long") * 86461)
    return table(spark, d, "events").select("event_id", X.steps_of_10ms(F.col("value")).alias("step"), X.epoch_text(made).alias("made"))


_PLACE = "(mae - lo) / nullif(hi - lo, 0)"


def _shade(place: str, shades) -> str:
    return "case " + " ".join(f"when {place} < {b} then {s}" for b, s in shades) + " else 0 end"


def _colour(low_is_best: bool) -> str:
    place = "coalesce((x - lo) / nullif(hi - lo, 0), 0.5)"
    place = place if low_is_best else f"(1 - {place})"
    a, b = ("blue!40", "red!40") if low_is_best else ("red!40", "blue!40")
    blue, red = _shade(place, X.SHADES), _shade(f"(1 - {place})", X.SHADES[:4])
    return f"case when abs(x - lo) <= 1e-6 then '{a}' when abs(x - hi) <= 1e-6 then '{b}' when {place} < 0.5 then case when {blue} > 0 then 'blue!' || {blue} else '' end else case when {red} > 0 then 'red!' || {red} else '' end end"


@query(f"with {SCORED}, m as (select *, round(mae, 9) as x, min(round(mae, 9)) over (partition by item) as lo, max(round(mae, 9)) over (partition by item) as hi from scored) select model, run, item, cast({_shade('(x - lo) / nullif(hi - lo, 0)', X.SHADES)} as int) as heat, {_colour(True)} as colour, {_colour(False)} as mirrored from m")
def heat_cells(spark, d):
    by, x = Window.partitionBy("item"), F.round("mae", 9)
    own = _scored(spark, d).withColumns({"x": x, "lo": F.min(x).over(by), "hi": F.max(x).over(by)})
    c = (F.col("x"), F.col("lo"), F.col("hi"))
    return own.select("model", "run", "item", X.heat(*c).alias("heat"), X.cell_colour(*c).alias("colour"), X.cell_colour(*c, False).alias("mirrored"))


@query(f"""with {SCORED}, {MODELS}, m as (select model, round(avg(mae), 9) as mae, round(avg(qwk), 9) as qwk from scored group by model), a as (select models.model, case when models.model <> 3 then mae end as mae, qwk, [4, 2, 0][least(models.model + 1, 3)] as kind from models left join m using (model))
select model, row_number() over (order by model) as ordinal, row_number() over (order by mae nulls last, model) as by_mae, row_number() over (order by qwk desc nulls last, model) as by_qwk, row_number() over (order by kind desc, model) as stable from a""")
def ordered_models(spark, d):
    per = _scored(spark, d).groupBy("model").agg(F.round(F.avg("mae"), 9).alias("mae"), F.round(F.avg("qwk"), 9).alias("qwk"))
    kind = F.element_at(F.array(F.lit(4), F.lit(2), F.lit(0)), F.least(F.col("model") + 1, F.lit(3)))
    own = tables.lookup(panels.models(spark).select("model"), per, ["model"], {}).withColumns({"mae": F.when(F.col("model") != 3, F.col("mae")), "kind": kind})
    c, place = F.col, tables.position
    return own.select("model", *(place([], order).cast("long").alias(n) for n, order in (("ordinal", ["model"]), ("by_mae", [c("mae").asc_nulls_last(), "model"]), ("by_qwk", [c("qwk").desc_nulls_last(), "model"]), ("stable", [c("kind").desc(), "model"]))))


@query("""with r as (select n_nationkey as at, n_name as term from nation where n_nationkey % 2 = 0), n as (select 100 - n_nationkey as at, n_name as term from nation where n_nationkey % 3 = 0)
select coalesce(r.term, n.term) as term, cast(r.at as double) as left_at, cast(n.at as double) as right_at, row_number() over (order by r.term is null, coalesce(r.at, n.at), coalesce(r.term, n.term)) as place from r full join n using (term)""")
def predictor_union(spark, d):
    n = table(spark, d, "nation")
    left = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("term"), F.col("n_nationkey").alias("at"))
    right = n.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("term"), (100 - F.col("n_nationkey")).alias("at"))
    return tables.aligned(left, right, "term", "at").select("term", F.col("l.at").cast("double").alias("left_at"), F.col("r.at").cast("double").alias("right_at"), F.col("place").cast("long").alias("place"))


@query(f"with {PANEL} select item, cast(case when item = 10 then 9 else item - 1 end as int) as place, count(*) as n from cells where item <= 10 group by item")
def items_in_order(spark, d):
    return tables.in_order(_cells(spark, d).groupBy("item").agg(F.count("*").alias("n")), "item", [*range(1, 11), 0])


@query("select cast(extended as bigint) as q, count(*) as n from (select l_quantity as extended from lineitem union all select l_discount * 100 from lineitem) group by 1")
def column_stack(spark, d):
    own = table(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("percent"))
    return tables.stacked(own, ["l_quantity", "percent"]).groupBy(F.round("value").cast("long").alias("q")).agg(F.count("*").alias("n"))


@query("select s_suppkey as key, s_name as name, cast(null as varchar) as segment, s_acctbal as balance from supplier union all select c_custkey, c_name, c_mktsegment, c_acctbal from customer")
def union_by_name(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    both, left, right = tables.shared_columns(s, c)
    return s.unionByName(c, allowMissingColumns=True).select(*both, *left, *right)


_RUNS = ("rating", "error", "failure_reason", "explanation", "reasoning", "creation_time", "num_reason_tokens")
_ANNOTATED = f"""{PANEL}, {MODELS}, noted as materialized (select c.*, session % 50 as patient, 500 + session * 37 % 1000 as num_trans_tokens, reasons = 'Yes' as reasoning, context_length, total_params, arch, name, active_params, case when reasons = 'Yes' then (17*session + 5*item + 3*model + 29*run) % 800 else 0 end as num_reason_tokens from cells c join models using (model))"""


@query(f"""with {_ANNOTATED} select session, item, model, patient, name as model_name, coalesce(arch, 'Unknown') as architecture, context_length, reasoning, active_params, total_params, num_trans_tokens, max(ground_truth) as ground_truth,
{', '.join(f"max(case when run = {r} and failure = 0 then rating end) as rating_{r}, max(case when run = {r} and failure = 0 then abs(rating - ground_truth) end) as error_{r}, max(case when run = {r} and failure = 1 then 'missing rating' end) as failure_reason_{r}, max(case when run = {r} then 'e' || (session + run) % 10 end) as explanation_{r}, max(case when run = {r} and reasoning then 'r' || item end) as reasoning_{r}, max(case when run = {r} then '' end) as creation_time_{r}, cast(max(case when run = {r} then num_reason_tokens end) as double) as num_reason_tokens_{r}" for r in range(3))}
from noted group by session, item, model, patient, name, arch, context_length, reasoning, active_params, total_params, num_trans_tokens""")
def wide_sheet(spark, d):
    own = panels.with_texts(panels.annotated(_cells(spark, d), spark), spark).join(F.broadcast(panels.models(spark).select("model", "name", "active_params")), "model")
    ok, c = F.col("failure") == 0, F.col
    own = own.withColumns({"rating": F.when(ok, c("rating")), "failure_reason": F.when(~ok, "missing rating"), "explanation": F.concat(F.lit("e"), ((c("session") + c("run")) % 10).cast("string")), "reasoning_text": F.when(c("reasoning"), F.concat(F.lit("r"), c("item").cast("string"))), "creation_time": X.epoch_text(F.lit(None).cast("long"))})
    own = own.withColumns({"error": F.abs(c("rating") - c("ground_truth")), "model_name": c("name"), "architecture": F.coalesce("architecture", F.lit("Unknown"))})
    ids = ["session", "item", "model", "patient", "model_name", "architecture", "context_length", "reasoning", "active_params", "total_params", "num_trans_tokens"]
    values = {"rating": "rating", "error": "error", "failure_reason": "failure_reason", "explanation": "explanation", "reasoning": "reasoning_text", "creation_time": "creation_time", "num_reason_tokens": "num_reason_tokens"}
    of = lambda r, n, v: F.max(F.when(c("run") == r, c(v).cast("double") if n == "num_reason_tokens" else c(v))).alias(f"{n}_{r}")
    # a pivot of named values in one pass over the cells
    return own.groupBy(*ids).agg(F.max("ground_truth").alias("ground_truth"), *(of(r, n, v) for r in range(3) for n, v in values.items()))


_SEEDS = f"""{_ANNOTATED}, seeds as (select session, item, model, patient, num_trans_tokens, context_length, total_params, avg(case when failure = 0 then rating end) as rating, avg(case when failure = 0 then rating - ground_truth else 6 end) as error,
avg(case when failure = 0 then abs(rating - ground_truth) else 6 end) as abs_error, avg(num_reason_tokens) as num_reason_tokens, min(ground_truth) as severity from noted group by all),
logs as (select *, log10(num_trans_tokens + 1) as log_tokens, log10(num_reason_tokens + 1) as log_reason, log10(context_length + 1) as log_context, log10(cast(replace(total_params, 'B', '') as double) * 1e9) as log_params from seeds),
means as (select *, avg(severity) over (partition by patient, item) as severity_between, avg(log_tokens) over (partition by patient) as log_tokens_between, avg(log_reason) over (partition by patient, item) as log_reason_between from logs),
c as materialized (select *, severity - severity_between as severity_within, log_tokens - log_tokens_between as log_tokens_within, log_reason - log_reason_between as log_reason_within from means)"""
_Z = ("log_params", "log_context", "severity_between", "severity_within", "log_tokens_between", "log_tokens_within", "log_reason_between", "log_reason_within")


@query(f"with {_SEEDS}, t as (select {', '.join(f'avg({v}) as m_{v}, stddev_samp({v}) as s_{v}' for v in _Z)} from c) select session, item, model, {_r('rating', 'error', 'abs_error')}, {', '.join(f'round(coalesce(({v} - m_{v}) / nullif(s_{v}, 0), 0), 5) + 0.0 as {v}_z' for v in _Z)} from c, t")
def error_features(spark, d):
    own = features.engineered(panels.with_texts(features.seed_means(panels.annotated(_cells(spark, d), spark)), spark))
    own = own.select("session", "item", "model", "rating", "error", "abs_error", *(f"{v}_z" for v in _Z))
    return own.withColumns({f"{v}_z": F.round(f"{v}_z", 5) + 0.0 for v in _Z})


@query(f"with {_SEEDS} select count(distinct patient) as patients, count(distinct model) as models, count(distinct session) as sessions, count(distinct item) as items, count(*) as observations from c")
def frame_counts(spark, d):
    own = features.seed_means(panels.annotated(_cells(spark, d), spark))
    return own.agg(*(F.count_distinct(k).alias(f"{k}s") for k in ("patient", "model", "session", "item")), F.count("*").alias("observations"))


_PAUSES = "g as (select user_id, datediff('microsecond', ts, lead(ts) over (partition by user_id order by ts, event_id)) / 1e6 as gap from events)"


@query(f"with {_PAUSES} select user_id, count(*) as n, round(avg(gap), 3) + 0.0 as mean, round(stddev_pop(gap), 3) + 0.0 as std, {', '.join(f'round(quantile_cont(gap, {p / 100}), 3) + 0.0 as p{p}' for p in (25, 50, 75, 90, 95))}, count(*) filter (where gap > 20000) as n_long, coalesce(string_agg(cast(cast(round(gap * 1000) as bigint) as varchar), ',' order by gap desc) filter (where gap > 20000), '') as long from g where gap > 0 group by user_id")
def pause_stats(spark, d):
    out = rounded(tables.pauses(_gaps(spark, d), ["user_id"], "gap", 20000.0, lists=True), 3)
    return out.withColumn("long", F.array_join(F.transform("long", lambda x: F.round(x * 1000).cast("long").cast("string")), ","))


@query(f"with {_PAUSES} select user_id, round(gap, 3) + 0.0 as gap, row_number() over (partition by user_id order by gap desc) as place from g where gap > 20000")
def long_pauses(spark, d):
    own = rounded(tables.long_pauses(_gaps(spark, d), ["user_id"], "gap", 20000.0), 3)
    return own.withColumn("place", F.col("place").cast("long"))


def _gaps(spark, d):
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", (F.timestamp_diff("MICROSECOND", F.col("ts"), after) / 1e6).alias("gap"))


@query("""with c as (select conv_id as track, turn, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> '') as words from conversations),
o as (select *, coalesce(sum(len(words) * 0.5 + 1) over b, 0) as shift, coalesce(sum(len(words)) over b, 0) as first from c window b as (partition by track order by turn rows between unbounded preceding and 1 preceding)),
w as (select track, first, shift, words, unnest(range(1, len(words) + 1)) as i from o)
select track, cast(first + i - 1 as bigint) as no, words[i] as word, round(shift + (i - 1) * 0.5, 3) as start, round(shift + (i - 1) * 0.5 + 0.25, 3) as "end" from w""")
def merged_words(spark, d):
    words = X.tokens(F.coalesce("text", F.lit("")))
    timed = F.transform(words, lambda w, i: F.struct(w.alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.25).alias("end")))
    own = table(spark, d, "conversations").select(F.col("conv_id").alias("track"), F.col("turn").alias("chunk"), (F.size(words) * 0.5 + 1).alias("length"), timed.alias("words"))
    return rounded(transcripts.merged(own), 3)


@query("""with l as (select conv_id, turn, role, unnest(range(len(string_split(text, chr(10))))) as no, unnest(string_split(text, chr(10))) as x from conversations)
select conv_id, turn, no, case when no % 3 = 2 then 'Unclear' when role = 'user' then 'Patient' else 'Practitioner' end as role, case when no % 3 = 2 then trim(x) else regexp_replace(x, '^\\s+', '') end as said from l""")
def role_labels(spark, d):
    """The lines of all turns as a model may have labelled them, every third without a role."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("no", "x"))
    name = F.when(F.col("role") == "user", " Patient:").otherwise("Practitioner: ")
    own = lines.select("conv_id", "turn", F.col("no").cast("long").alias("no"), X.roles(F.when(F.col("no") % 3 == 2, F.col("x")).otherwise(F.concat(name, "x"))).alias("u"))
    return own.select("conv_id", "turn", "no", "u.role", F.col("u.text").alias("said"))


def _seeds(spark, d):
    cells = panels.error_cells(spark, d).drop("reasoning", "context_length")
    return features.engineered_pieces(features.seed_means(cells, ("patient", "piece", "num_trans_tokens")), panels.error_models(spark, d))


#: The seeds of the error model, from line items; item 0 counts a tenth.
_LINES = """nations as (select n_nationkey as model, n_nationkey % 2 = 0 as reasoning, log10((n_nationkey * 3 % 70 + 1) * 1e9) as log_params, log10(1000 * (n_nationkey * 7 % 25 + 8) + 1) as log_context, case when n_regionkey <> 4 then r_name else 'Unknown' end as architecture from nation left join region on r_regionkey = n_regionkey),
lines as (select l_orderkey as session, o_custkey as patient, 500 + cast(floor(o_totalprice / 100) as bigint) as num_trans_tokens, l_linenumber as item, s_nationkey as model, l_suppkey % 3 as run, least(6, cast(round(100 * l_discount) as int)) as truth, l_quantity,
  cast(round(100 * l_tax) as int) % 4 + cast(o_custkey % 3 = 0 as int) + cast(l_orderkey % 4 = 0 as int) + cast(s_nationkey % 3 = 0 as int) + cast(l_linenumber % 3 = 1 as int) - 2 as shift from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey),
marked as materialized (select session, patient, num_trans_tokens, item, model, run, max(truth) as ground_truth, max(case when l_quantity % 50 <> 0 then least(greatest(truth + shift, 0), 6) end) as rating from lines group by all),
both_kinds as (select * from marked union all select session, patient, num_trans_tokens, 0 as item, model, run, sum(ground_truth), sum(rating) from marked group by all),
noted as (select *, case when item = 0 then 10.0 else 1.0 end as scale, case when reasoning then (17 * session + 5 * item + 3 * model + 29 * run) % 800 else 0 end as reason_tokens from both_kinds join nations using (model)),
seeds as materialized (select session, patient, item, model, reasoning, architecture, log_params, log_context, log10(num_trans_tokens + 1) as log_tokens, avg(rating / scale) as rating, avg(case when rating is null then 6 else abs(rating - ground_truth) / scale end) as abs_error,
  log10(avg(reason_tokens) + 1) as log_reason, min(ground_truth) / min(scale) as severity from noted group by session, patient, item, model, reasoning, architecture, log_params, log_context, num_trans_tokens),
by_item as (select patient, item, avg(severity) as severity_between, avg(log_reason) as log_reason_between from seeds group by patient, item),
by_patient as (select patient, avg(log_tokens) as log_tokens_between from seeds group by patient),
c as materialized (select s.*, severity_between, log_reason_between, log_tokens_between, severity - severity_between as severity_within, log_reason - log_reason_between as log_reason_within, log_tokens - log_tokens_between as log_tokens_within from seeds s join by_item using (patient, item) join by_patient using (patient)),
t as (select {totals} from c),
e as materialized (select session, patient, item, model, reasoning, architecture, rating, abs_error, severity, {z} from c, t)""".format(totals=", ".join(f"avg({v}) as m_{v}, stddev_samp({v}) as s_{v}" for v in _Z), z=", ".join(f"coalesce(({v} - m_{v}) / nullif(s_{v}, 0), 0) as {v}_z" for v in _Z))


@query(f"with {_LINES} select session, item, model, architecture, {_r('rating', 'abs_error')}, round(severity, 6) as severity, {', '.join(f'round({v}_z, 5) + 0.0 as {v}_z' for v in _Z)} from e")
def seed_features_with_totals(spark, d):
    own = _seeds(spark, d).select("session", "item", "model", "architecture", "rating", "abs_error", "severity", *(f"{v}_z" for v in _Z))
    return own.withColumns({f"{v}_z": F.round(f"{v}_z", 5) + 0.0 for v in _Z})


def _sides() -> str:
    """The right-hand sides of the mixed-model equations: sums of y alone, which no fit has touched."""
    parts = []
    for name, reasoning in (("nonreason", "not reasoning"), ("reason", "reasoning")):
        own = f"from e where {'not ' * (name == 'nonreason')}reasoning"
        terms = [t for t in (*features.TERMS, *(features.REASONING_TERMS if name == "reason" else ())) if t != "architecture"]
        parts += [f"select '{name}' as stratum, 'fixed' as factor, '{t}' as equation, sum({x} * abs_error) as side {own}" for t, x in (("(Intercept)", "1"), *((t, t) for t in terms))]
        levels = (("fixed", "'architecture' || architecture"), ("model", "cast(model as varchar)"), ("item", "cast(item as varchar)"), ("patient", "cast(patient as varchar)"), ("visit", "cast(session as varchar) || ':' || cast(patient as varchar)"))
        parts += [f"select '{name}', '{f}', {x}, sum(abs_error) {own} group by {x}" for f, x in levels]
        parts += [f"select '{name}', 'slope', '{f}', 0.0" for f in (*features.DENSE, *features.NESTED)]
    return " union all ".join(parts)


@query(f"with {_LINES}, q as ({_sides()}) select stratum, factor, equation, round(side, 3) + 0.0 as side from q")
def lme_equations(spark, d):
    """The error model's equations at its estimates: left-hand sides from the fit, which SQL's right-hand sides must equal."""
    seeds = _seeds(spark, d)
    out = None
    for name, fit in features.strata(seeds).items():
        fixed = [*features.TERMS, *(features.REASONING_TERMS if name == "reason" else ())]
        own = features.equations(features.stratum(seeds, name == "reason"), fit, "abs_error", fixed).withColumn("stratum", F.lit(name))
        out = own if out is None else out.union(own)
    return rounded(out.select("stratum", "factor", "equation", "side"), 3)


@query(None)
def lme_fixed_effects(spark, d):
    """Fixed effects of the error model, by stratum."""
    return features.effects(spark, features.strata(_seeds(spark, d)))


@query(None)
def lme_item_blups(spark, d):
    """Items' deviations and totals, by stratum, in the order of their totals."""
    return features.item_effects(spark, features.strata(_seeds(spark, d)))


@query(None)
def lme_fit_report(spark, d):
    """Formula, variances, convergence, gradient and singularity of each stratum's fit."""
    return features.reports(spark, features.strata(_seeds(spark, d)))


def _batches(spark, d):
    """The panel's cells in three batches, the first of which comes twice; returns the state's folder."""
    path = f"{stages.folder(spark)}/ratersight-agreement-{uuid.uuid4().hex}"
    cells = kept(_cells(spark, d), "cells")
    for batch in (0, 1, 2, 0):
        ratings.add_batch(cells.filter(F.col("session") % 3 == batch), path, f"batch {batch}")
    return path


@query(f"with {SCORED} select model, run, item, n, failures, status, {', '.join(f'round(case when status = {chr(39)}scored{chr(39)} then {c} end, 6) + 0.0 as {c}' for c in ('mae', 'r2', 'qwk'))} from gates")
def item_metrics_by_batches(spark, d):
    """item_metrics_by_run from a state to which batches of sessions were added."""
    expected = table(spark, d, "customer").agg(F.count("*").alias("expected"))
    return ratings.gated(ratings.of_counts(ratings.state(spark, _batches(spark, d))), expected)


_OF_ITEM = ", ".join(f"round(case when count({v}) = count(*) then avg({v}) end, 6) + 0.0 as mean_{v}, round(case when count(*) = 1 then 0.0 when count({v}) = count(*) then stddev_pop({v}) end, 6) + 0.0 as std_{v}" for v in ("mae", "qwk"))


@query(f"with {SCORED}, per as (select model, item, mae, case when item = 4 and run = 1 or model = 1 and item = 7 then null else qwk end as qwk from scored where not (model = 1 and item = 7 and run > 0)) select model, item, count(*) as n_runs, {_OF_ITEM} from per group by all")
def item_means_with_missing(spark, d):
    """Means and deviations over runs that are null where a run's value is missing; one run has a deviation of 0."""
    own = _scored(spark, d).filter("not (model = 1 and item = 7 and run > 0)")
    own = own.withColumn("qwk", F.when(~((F.col("item") == 4) & (F.col("run") == 1) | (F.col("model") == 1) & (F.col("item") == 7)), F.col("qwk")))
    return ratings.over_runs(own, ["model", "item"], ["mae", "qwk"], missing_propagates=True)


@query(f"""with {SCORED}, over as (select model, item, avg(qwk) as q, stddev_pop(qwk) as s from scored group by all),
t as (select model, 0 as item, avg(q) + 1 as q, case when model <> 2 then max(s) end as s from over where model % 2 = 0 group by model), a as (select * from over union all select * from t),
g as (select model, max(case when item = 0 then q end) as q0, max(case when item = 0 then s end) as s0, avg(q) filter (where item > 0) as q, avg(s) filter (where item > 0) as s from a group by model)
select model, round(coalesce(q0, q), 6) + 0.0 as qwk, round(coalesce(s0, s), 6) + 0.0 as std, q0 is null as fallback from g""")
def overall_with_deviation(spark, d):
    """The overall QWK and its deviation, each stored for some models, and the mean of the items' for the others."""
    over = _scored(spark, d).groupBy("model", "item").agg(F.avg("qwk").alias("qwk"), F.stddev_pop("qwk").alias("std"))
    stored = over.filter("model % 2 = 0").groupBy("model").agg((F.avg("qwk") + 1).alias("qwk"), F.max("std").alias("std")).withColumn("item", F.lit(0))
    stored = stored.withColumn("std", F.when(F.col("model") != 2, F.col("std")))
    return ratings.overall(over.unionByName(stored), "qwk", std="std")


@query("select conv_id, turn, 'WEBVTT' || chr(10) || chr(10) || '00:00:00.000 --> 99:59:59.999' || chr(10) || coalesce(text, '') || chr(10) as vtt from conversations")
def whole_text_cues(spark, d):
    """Transcripts without segments as one cue over all."""
    return table(spark, d, "conversations").select("conv_id", "turn", transcripts.whole_vtt(F.col("text")).alias("vtt"))


@query("""with w as (select conv_id, turn, list_filter(regexp_split_to_array(role || ' says this', '[ \\t\\n\\r]+'), lambda w: w <> '') as i, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> '') as t, turn % 9 as most from conversations)
select conv_id, turn, case when most > len(i) then array_to_string(t[-(most - len(i)):], ' ') else '' end as kept from w""")
def transcript_room(spark, d):
    """The last tokens of a turn, as many as its instructions leave of a budget that goes with the turn's number."""
    own = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(" says this")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    kept_of = lambda most: X.keep_room(F.col("i"), F.col("t"), most)
    return own.select("conv_id", "turn", F.element_at(F.array(*map(kept_of, range(9))), (F.col("turn") % 9 + 1).cast("int")).alias("kept"))
