"""Queries that write given tables with the sinks and read them with the sources, each with its twin in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ratersight.functions import text as X
from ratersight.plans.roster import _BODY, _K, PANEL, SCORED, _cells, _r, _scored, query
from ratersight.sources import files, sinks, stages, trees
from ratersight.sources.panels import table
from ratersight.streaming import scoring


def _path(spark, label: str) -> str:
    return f"{stages.folder(spark)}/ratersight-{label}-{uuid.uuid4().hex}"


def _lines(spark, text: str):
    """A report's text as rows (no, line)."""
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "no long, line string")


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_scan(spark, d):
    """Customers written as CSV and scanned in a stated schema."""
    own, path = table(spark, d, "customer"), _path(spark, "csv")
    own.write.csv(path, header=True)
    return files.csv_table(spark, path, own.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


@query("select cast(p_partkey as varchar) as p_partkey, 'segmented_' || p_name as p_name, p_brand, cast(p_size as varchar) as p_size from part")
def csv_records(spark, d):
    """Parts written as CSV and read as strings, under prefixed names."""
    path = _path(spark, "csv")
    table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size").write.csv(path, header=True)
    return files.csv_texts(spark, path, "p_name", "segmented_")


_TALKS = "t as (select conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn) || chr(10) as text from conversations group by conv_id)"


def _talks(spark, d) -> str:
    """A text file for each conversation, in folders by patient and session. Folders of patients lie in others by bucket, so that
    none has more than some thousands of sessions."""
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    own = table(spark, d, "conversations")
    n = trees.tasks(spark, own.agg(F.approx_count_distinct("conv_id")).first()[0])  # sets the size of buckets alone
    own = own.repartition(n, "conv_id").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))
    path = _path(spark, "texts")
    trees.write(own.select(trees.bucket("conv_id", n).alias("bucket"), (F.col("conv_id") % 7).alias("patient"), F.col("conv_id").alias("session"), "value"), path, ["bucket", "patient", "session"], "value")
    return path


@query(f"with {_TALKS} select 'patient=' || conv_id % 7 as patient, 'session=' || conv_id as session, text from t")
def session_texts(spark, d):
    """Whole texts below folders of patients and sessions; of each session the file of the least path."""
    return files.first_texts(spark, _talks(spark, d), "*.txt").select("patient", "session", "text")


@query("select distinct 'session=' || conv_id as session from conversations where conv_id % 3 <> 1")
def unprocessed_texts(spark, d):
    """Sessions whose files have nothing produced from them yet."""
    path = _talks(spark, d)
    done = files.paths(spark, path, "*.txt").filter(F.regexp_extract("session", r"(\d+)", 1).cast("long") % 3 == 1).select("path")
    return files.unprocessed(spark, path, "*.txt", done).select("session")


@query(f"""with b as (select event_id, user_id, event_id % 6 as kind, {_K} as k, {_BODY} as body from events)
select 'p' || user_id as patient, 's' || event_id as session, cast(event_id % 11 as int) as item, cast(event_id % 3 as int) as run,
cast(case when kind in (0, 5) then k when kind = 1 then k + 0.7 when kind = 2 then floor(cast(regexp_extract(body, '(?i)"rating":\\s*(\\d+(\\.\\d+)?)', 1) as double)) end as double) + 0.0 as rating,
case when kind = 1 then 'x' when kind = 2 then regexp_extract(body, '(?i)explanation:\\s*([^\\n]+)', 1) end as explanation from b where event_id % 5 not in (1, 2)""")
def prediction_index(spark, d):
    """Predictions by what their files' names tell; names with another beginning or end are left out."""
    e, at = table(spark, d, "events"), F.col("event_id")
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    k, kind = F.get_json_object("props", "$.k"), at % 6
    body = (
        F.when(kind == 0, text('{"rating": ', k, "}")).when(kind == 1, text('{"rating": ', k, '.7, "explanation": "x"}'))
        .when(kind == 2, text('text "Rating": ', k, ".5 explanation: why")).when(kind == 3, F.lit('{"rating": null}')).when(kind == 4, F.lit("none")).otherwise(text('{"rating": "', k, '"}'))
    )
    name = text(F.when(at % 5 == 1, "old_item").otherwise("item"), at % 11, "_output_", at % 3, F.when(at % 5 == 2, ".json.bak").otherwise(".json"))
    own = e.select(text("p", F.col("user_id")).alias("patient"), text("s", at).alias("session"), F.concat(F.lit("/out/"), name).alias("path"), body.alias("text"))
    return files.indexed(own, "item")


@query("select distinct cast(s_nationkey % 10 as int) as item, 's' || s_suppkey as session from supplier where s_suppkey % 4 <> 3")
def listed_sessions(spark, d):
    """Sessions of manifests' lines, the item by the manifest's name; blank lines and bare names are none."""
    key, of = F.col("s_suppkey"), F.col("s_nationkey") % 10
    value = F.when(key % 4 == 3, F.when(key % 8 == 3, "  ").otherwise("name")).otherwise(F.concat(F.lit("  a/s"), key.cast("string"), F.lit("/t.txt ")))
    lines = table(spark, d, "supplier").select(value.alias("value"), F.concat(F.lit("x/valid_"), of.cast("string"), F.lit("_sessions.txt")).alias("path"))
    return files.listed_sessions(lines.union(lines))


@query("select distinct c_mktsegment || c_nationkey as session from customer")
def excluded_names(spark, d):
    """The last components of lists' lines, each once."""
    path = _path(spark, "lists")
    name = F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))
    table(spark, d, "customer").select(F.explode(F.array(F.concat(F.lit("/data/x/"), name), F.concat(F.lit(" "), name), F.lit(""))).alias("value")).write.text(path)
    return files.exclusions(spark, path)


@query(f"with {PANEL} select item, session, model, run, row_number() over (partition by item order by model, session, run) as place, rating from cells")
def sorted_sheets(spark, d):
    """Sheets by item, in order over their files, and the rows' places in them."""
    path = _path(spark, "sheets")
    own = _cells(spark, d).select("session", "item", "model", "run", "rating", F.concat(F.lit("an item with a long name, number "), F.col("item").cast("string")).alias("item_name"))
    sinks.write_sheets(own, path, order=("model", "session", "run"))
    back = files.sheet_rows(spark, path)
    return back.select(F.col("item").cast("int").alias("item"), F.col("session").cast("long").alias("session"), F.col("model").cast("int").alias("model"), F.col("run").cast("int").alias("run"), F.col("place").cast("long").alias("place"), F.col("rating").cast("double").alias("rating"))


@query(f"with {SCORED} select cast(item as int) as item, model, run, {_r('mae', 'qwk')} from scored")
def sheets_by_item(spark, d):
    """Sheets read back as one table, with the item of each sheet's name."""
    path = _path(spark, "sheets")
    own = _scored(spark, d).select("model", "run", "item", "mae", "qwk", F.concat(F.lit("item "), F.col("item").cast("string")).alias("item_name"))
    sinks.write_sheets(own.withColumn("sheet_item", F.col("item")), path, item="sheet_item", order=("model", "run"))
    back = files.sheets(spark, path, list(range(1, 11)))
    return back.select("item", *(F.col(c).cast("int").alias(c) for c in ("model", "run")), *(F.col(c).cast("double").alias(c) for c in ("mae", "qwk")))


@query(f"with {SCORED}, m as (select model, item, avg(mae) as mae from scored group by all) select 'runs' as name, count(*) as n, round(avg(mae), 6) + 0.0 as mae from scored union all select 'items', count(*), round(avg(mae), 6) + 0.0 from m")
def bundled_stages(spark, d):
    """A run's tables as stages of one bundle, each made from what was written before."""
    path = _path(spark, "bundle")
    first = sinks.write_bundle({"runs": _scored(spark, d).select("model", "run", "item", "mae")}, path)
    sinks.write_bundle({"items": first["runs"].groupBy("model", "item").agg(F.avg("mae").alias("mae"))}, path)
    both = files.bundle(spark, path, ["runs", "items"])
    out = [t.agg(F.count("*").alias("n"), F.avg("mae").alias("mae")).select(F.lit(k).alias("name"), "n", "mae") for k, t in both.items()]
    return out[0].union(out[1])


@query(f"with {PANEL} select model, run, ground_truth, count(*) as n, count(*) filter (where failure = 1) as failures from cells group by model, run, ground_truth")
def labelled_outputs(spark, d):
    """Outputs as texts by model and run, each with its ground truth in a last line."""
    path = _path(spark, "texts")
    own = _cells(spark, d).select("model", "run", F.when(F.col("failure") == 1, "none").otherwise(F.concat(F.lit("Rating: "), F.col("rating").cast("int").cast("string"))).alias("body"), F.col("ground_truth").alias("label"))
    sinks.write_labelled(own, path)
    pairs = spark.read.option("lineSep", "Ground Truth: ").text(path)  # a label, and the body of the row after it
    rows = pairs.select(F.col("model").cast("int").alias("model"), F.col("run").cast("int").alias("run"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    lines = rows.select("model", "run", F.explode(F.split("value", "\n")).alias("line"))
    truth = lines.filter(F.col("line").rlike(r"^\d+$")).groupBy("model", "run", F.col("line").cast("int").alias("ground_truth")).agg(F.count("*").alias("n"))
    again = own.groupBy("model", "run", F.col("label").alias("ground_truth")).agg(F.count_if(F.col("body") == "none").alias("failures"))
    return truth.join(again, ["model", "run", "ground_truth"])


_TWO = "printf('%.2f', round({0}, 6))"


@query(f"""with {SCORED}, m as (select model, run, avg(mae) as mae, stddev_pop(mae) as std from scored group by all)
select row_number() over (order by model, run) - 1 as no, model || ' & ' || run || ' & ' || {_TWO.format('mae')} || ' & ' || {_TWO.format('mae')} || ' ± ' || {_TWO.format('std')} || ' ' || chr(92) || chr(92) as line from m""")
def latex_rows(spark, d):
    """The body of a LaTeX table of models and runs, with means and deviations as text."""
    own = _scored(spark, d).groupBy("model", "run").agg(F.round(F.avg("mae"), 6).alias("mae"), F.round(F.stddev_pop("mae"), 6).alias("std")).orderBy("model", "run")
    rows = [(r.model, r.run, r.mae, sinks.mean_and_std(r.mae, r["std"])) for r in own.collect()]  # a row for each model and run
    shown = spark.createDataFrame(rows, "model int, run int, mae double, both string").orderBy("model", "run")
    return _lines(spark, sinks.latex(shown).rstrip("\n"))


@query(f"""with {PANEL}, ab as (select session % 4 as config, item, avg(abs(ground_truth - rating)) as mae from cells group by all),
w as (select config, {', '.join(f'round(max(case when item = {i} then mae end), 6) as i{i}' for i in (1, 2, 3))}, round(avg(mae), 6) as mean from ab group by config),
l as (select 0 as no, 'config,i1,i2,i3,mean' as line union all select 1 + config, config || ',' || concat_ws(',', {', '.join(f"printf('%.4f', {c})" for c in ('i1', 'i2', 'i3', 'mean'))}) from w union all select 5, '' union all select 6, 'config,delta' union all select 7 + config, config || ',' || printf('%.4f', i2 - i1) from w)
select cast(no as bigint) as no, line from l""")
def ablation_lines(spark, d):
    """The text of an ablation's table and its deltas."""
    ab = _cells(spark, d).groupBy((F.col("session") % 4).alias("config"), "item").agg(F.avg(F.abs(F.col("ground_truth") - F.col("rating"))).alias("mae"))
    w = ab.groupBy("config").agg(*(F.round(F.max(F.when(F.col("item") == i, F.col("mae"))), 6).alias(f"i{i}") for i in (1, 2, 3)), F.round(F.avg("mae"), 6).alias("mean")).orderBy("config")
    text = sinks.ablation_csv(w, w.select("config", (F.col("i2") - F.col("i1")).alias("delta")))
    return _lines(spark, text.replace("\r\n", "\n").rstrip("\n"))


@query(f"""with {SCORED}, m as (select model, item, avg(mae) as mae, stddev_pop(mae) as std from scored group by all)
select case when model % 2 = 0 then 'reason' else 'nonreason' end as part, 'm' || model || '_' || item as term, round(mae, 6) as estimate, round(std, 6) as se from m""")
def parsed_report(spark, d):
    """A plain report of two parts, and its terms as parsed from its lines."""
    own = _scored(spark, d).groupBy("model", "item").agg(F.avg("mae").alias("estimate"), F.stddev_pop("mae").alias("se"))
    own = own.select(F.col("model") % 2 == 0, F.concat(F.lit("m"), F.col("model").cast("string"), F.lit("_"), F.col("item").cast("string")).alias("term"), "estimate", "se").toDF("reason", "term", "estimate", "se")
    text = ""
    for name, flag in (("reason", "reason"), ("nonreason", "not reason")):
        top = spark.createDataFrame([("(Intercept)", 1.0, 0.5)], "term string, estimate double, se double")
        text += f"[{name}]\n" + sinks.model_report(top.union(own.filter(flag).select("term", "estimate", "se")), {"items": 10})
    return files.report_terms(_lines(spark, text))


@query(f"with {SCORED}, m as (select model, item, avg(mae) as mae from scored group by all) select 'all' as stratum, 'item' as factor, cast(item as int) as level, round(avg(mae), 6) + 0.0 as dev, round(min(mae), 6) + 0.0 as dev_low, round(max(mae), 6) + 0.0 as dev_high, round(1 + avg(mae), 6) + 0.0 as total from m group by item")
def effects_table(spark, d):
    """Item effects as one CSV file, read back with the level as a number."""
    own = _scored(spark, d).groupBy("model", "item").agg(F.avg("mae").alias("mae")).groupBy("item").agg(F.avg("mae").alias("dev"), F.min("mae").alias("dev_low"), F.max("mae").alias("dev_high"), (1 + F.avg("mae")).alias("total"))
    path = _path(spark, "effects")
    sinks.write_table(own.select(F.lit("all").alias("stratum"), F.lit("item").alias("factor"), F.col("item").cast("string").alias("level"), "dev", "dev_low", "dev_high", "total"), path)
    return files.blups(spark, path)


@query("""select n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as body from nation""")
def json_rows(spark, d):
    """Rows as JSON texts."""
    return table(spark, d, "nation").select("n_nationkey", sinks.as_json("n_name", "n_regionkey").alias("body"))


@query("""with a as (select conv_id, turn, 'Rate turn ' || turn as i, coalesce(text, '') || chr(10) || chr(10) || 'Output:' || chr(10) || 'Rating:' as asked from conversations)
select conv_id, turn, unnest(range(0, case when conv_id % 2 = 0 then 1 else 2 end)) as no, unnest(case when conv_id % 2 = 0 then ['user'] else ['system', 'user'] end) as role, unnest(case when conv_id % 2 = 0 then [i || chr(10) || chr(10) || asked] else [i, asked] end) as content from a""")
def prompt_messages(spark, d):
    """The messages of a request a turn; some models take no system message."""
    own = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Rate turn "), F.col("turn").cast("string")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    messages = F.when(F.col("conv_id") % 2 == 0, X.prompt(F.col("i"), F.col("t"), True)).otherwise(X.prompt(F.col("i"), F.col("t")))
    return own.select("conv_id", "turn", F.posexplode(messages).alias("no", "m")).select("conv_id", "turn", F.col("no").cast("long").alias("no"), "m.role", "m.content")


@query("""with crc as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
a as (select conv_id, turn, turn % 3 as run, hex(encode(coalesce(text, ''))) as h from conversations where turn % 4 <> 2),
b as (select conv_id, turn, run, list_transform(range(len(h) // 2), lambda i: cast((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 as bigint)) as bytes from a)
select conv_id, turn, cast(run as int) as run, cast(xor(list_reduce(list_prepend(xor(run, 4294967295), bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 7 as double) as rating from b, crc""")
def stub_scores(spark, d):
    """Ratings of turns that have none yet, by the scorer that stands in for a model."""
    own = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), (F.col("turn") % 3).cast("int").alias("run"), F.col("text").alias("prompt"), "turn")
    scored = scoring.score_pending(own.drop("turn"), own.filter("turn % 4 = 2").select("key", "run"))
    part = lambda i: F.split("key", ":")[i].cast("long")
    return scored.select(part(0).alias("conv_id"), part(1).alias("turn"), "run", X.rating(F.col("body")).alias("rating"))


@query(f"with {PANEL} select model, run, count(*) as n, cast(sum(rating) as double) as total from cells where failure = 0 group by model, run")
def prediction_store(spark, d):
    """Predictions in folders by model and run, which readers prune, written in two appends."""
    path, cells = _path(spark, "predictions"), stages.kept(_cells(spark, d), "cells")
    sinks.write_predictions(cells.filter("session % 2 = 0"), path)
    back = sinks.write_predictions(cells.filter("session % 2 = 1"), path)
    return back.filter("failure = 0").groupBy("model", "run").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))
