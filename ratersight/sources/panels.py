"""Rating panels derived from the driver's tables by integer arithmetic, so that any engine makes the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratersight.operators import pieces

MODELS, RUNS, ITEMS, CAP = 5, 3, 10, 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sessions of one partition of the grid, of 150 cells each.
GRID_SESSIONS = 4_000


def dealt(sessions: DataFrame, key: str) -> DataFrame:
    """Sessions dealt by their key to as many partitions as their number asks for, and one a core at least: what a row becomes
    stays small enough for its task, and sums by session need no further shuffle. Tables of one size are dealt alike."""
    parts = max(sessions.sparkSession.sparkContext.defaultParallelism, -(-sessions.count() // GRID_SESSIONS))
    return sessions.repartition(parts, key)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: filters on them don't go before the generator, where each would hold
    their whole expressions again, in code too large to be compiled."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every expected cell: session x item x model x run. The dimensions are arrays of fixed size, exploded row by row."""
    span = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("session"))
    # a row becomes 150
    return dealt(sessions, "session").withColumn("item", span(1, ITEMS)).withColumn("model", span(0, MODELS - 1)).withColumn("run", span(0, RUNS - 1))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel A: (session, item, model, run, ground_truth, rating), without absent cells; ratings may be null or over the cap."""
    s, i, m, r = (F.col(c) for c in ("session", "item", "model", "run"))
    made = once(grid(spark, sf_dir), ground_truth=((7 * s + 3 * i + s % 11) % 7).cast("int"), d=((13 * s + 5 * i + 11 * m + 17 * r) % 5 - 2).cast("int"), h=((31 * s + 7 * i + 3 * m + r) % 101).cast("int"), g=(i + m + r) % 4)
    h, g, forced = F.col("h"), F.col("g"), (m == 4) & (i == 9) & (r == 2)
    value = F.when(forced | ((h == 1) & ~((h == 2) & (g == 1))), None).when((h == 2) & (g == 1), 7).otherwise(F.least(F.greatest(F.col("ground_truth") + F.col("d"), F.lit(0)), F.lit(CAP)))
    return once(made.filter(forced | ~((h == 0) & (g == 0))), rating=value.cast("double")).drop("d", "h", "g")


def natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel B: line items as an incomplete panel (session, item, model, run, ground_truth, rating)."""
    pct = lambda c: F.max(F.least(F.lit(6), F.round(100 * F.col(c)).cast("int")))
    keys = (F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("item"), (F.col("l_partkey") % 5).alias("model"), (F.col("l_suppkey") % 3).alias("run"))
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(pct("l_discount").alias("ground_truth"), pct("l_tax").cast("double").alias("rating"))


#: The models of the panels: number, name, variant, whether it reasons, parameters in all and active, context, architecture.
MODEL_TABLE = (
    (0, "Qwen Alpha (30B)", "full", "Yes", "30B", "3B", 262144, "moe"),
    (1, "Llama Beta (8B)", "no_desc", "No", "8B", "8B", 131072, "dense"),
    (2, "Gemma Gamma with a long name (27B)", "no_dem", "Yes", "27B", "27B", 131072, "Dense"),
    (3, "GPT Delta (120B)", "raw", "No", "120B", "5.1B", 128000, "MoE"),
    (4, "Plain Epsilon", "full", "Yes", "7B", "7B", 32768, None),
)
MODEL_SCHEMA = "model int, name string, variant string, reasons string, total_params string, active_params string, context_length bigint, arch string"


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODEL_TABLE), MODEL_SCHEMA)


def part_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of models (MODEL_SCHEMA) of the parts: sizes are parameters, types and brands make names, variants and
    architectures; some have no architecture."""
    c, size = F.col, F.col("p_size")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    maker = pick(["Qwen ", "Llama ", "Gemma ", "GPT ", ""], size % 5)
    billions = lambda n: F.concat(n.cast("string"), F.lit("B"))
    return table(spark, sf_dir, "part").select(
        c("p_partkey").alias("model"), F.concat(maker, F.col("p_name"), F.lit(" "), c("p_brand"), F.lit(" ("), billions(size), F.lit(")")).alias("name"),
        pick(["full", "no_desc", "no_dem", "raw"], c("p_partkey") % 4).alias("variant"), F.when(c("p_partkey") % 2 == 0, "Yes").otherwise("No").alias("reasons"),
        billions(size).alias("total_params"), billions(F.when(size % 3 == 0, (size / 3).cast("int")).otherwise(size)).alias("active_params"),
        F.round(c("p_retailprice") * 100).cast("long").alias("context_length"), pick(["moe", "dense", "Dense", "MoE"], size % 4).alias("made"), c("p_type"),
    ).withColumn("arch", F.when(F.col("p_type") != "ECONOMY", F.col("made"))).drop("made", "p_type")


def total_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct totals (item 0) beside panel(): ground truth is the sum of the items, the cap is 60."""
    s, m, r = (F.col(c) for c in ("session", "model", "run"))
    total = sum(((7 * s + 3 * i + s % 11) % 7 for i in range(1, ITEMS + 1)), F.lit(0))
    made = once(grid(spark, sf_dir).filter("item = 1").withColumn("item", F.lit(0)), ground_truth=total.cast("int"), d=((13 * s + 11 * m + 17 * r) % 31 - 15).cast("int"), h=((31 * s + 3 * m + r) % 101).cast("int"), g=(m + r) % 4)
    h, g = F.col("h"), F.col("g")
    value = F.when(h == 1, None).when((h == 2) & (g == 1), 61).otherwise(F.least(F.greatest(F.col("ground_truth") + F.col("d"), F.lit(0)), F.lit(60)))
    own = once(made.filter(~((h == 0) & (g == 0))), rating=value.cast("double"))
    return own.select("session", "item", "model", "run", "ground_truth", "rating")


def annotated(cells: DataFrame, spark: SparkSession) -> DataFrame:
    """Cells with their patient, lengths of transcript and reasoning, and the numbers that the model table has of their model;
    texts are left to with_texts(), so that sums of cells need no sort."""
    table = models(spark).select("model", "context_length", (F.col("reasons") == "Yes").alias("reasoning"))
    s, i, m, r = (F.col(c) for c in ("session", "item", "model", "run"))
    out = cells.join(F.broadcast(table), "model")  # five rows
    return out.withColumns({"patient": s % 50, "num_trans_tokens": 500 + s * 37 % 1000, "num_reason_tokens": F.when(F.col("reasoning"), (17 * s + 5 * i + 3 * m + 29 * r) % 800).otherwise(0)})


def with_texts(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows of models with the texts that the model table has of their model."""
    return df.join(F.broadcast(models(spark).select("model", "total_params", F.col("arch").alias("architecture"))), "model")  # five rows


def error_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of the error model, a row for each nation: its numbers, whether it reasons, and its texts."""
    c = F.col
    models = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select(c("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey", "left")
    return models.select(
        c("n_nationkey").alias("model"), (c("n_nationkey") % 2 == 0).alias("reasoning"), F.concat((c("n_nationkey") * 3 % 70 + 1).cast("string"), F.lit("B")).alias("total_params"),
        (1000 * (c("n_nationkey") * 7 % 25 + 8)).cast("long").alias("context_length"), F.when(c("n_regionkey") != 4, c("r_name")).otherwise("Unknown").alias("architecture"),
    ).dropDuplicates(["model"])


#: Sessions of a patient beyond which its cells are cut into pieces.
SESSIONS_OF_PIECE = 2_000
#: Line items of one partition of the error model's cells.
CELL_LINES = 200_000


def error_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells of the error model (session, patient, piece, item, model, run, ground_truth, rating, failure and the numbers
    that are known of session and model; texts are left to error_models(), so that sums of cells need no sort): an order is a
    session, its customer the patient, the supplier's nation the model, that nation's region its architecture. Item 0 is the total of a session's items by model and run.

    Lines meet their orders and are then dealt by pieces of patients, in as many partitions as their number asks for: all sums
    of sessions and patients that follow need no further shuffle, and nothing is read twice."""
    c = F.col
    lineitem = table(spark, sf_dir, "lineitem")
    parts = max(spark.sparkContext.defaultParallelism, -(-lineitem.count() // CELL_LINES))
    orders = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("session"), c("o_custkey").alias("patient"), (500 + F.floor(c("o_totalprice") / 100)).cast("long").alias("num_trans_tokens"))
    orders = pieces.marked(orders, "patient", "session", SESSIONS_OF_PIECE)
    models = error_models(spark, sf_dir).drop("total_params", "architecture")
    vendors = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("model"))
    percent = lambda x: F.round(100 * c(x)).cast("int")
    lines = lineitem.join(vendors, "l_suppkey").select(
        c("l_orderkey").alias("session"), c("l_linenumber").cast("int").alias("item"), "model", (c("l_suppkey") % 3).alias("run"),
        F.least(F.lit(6), percent("l_discount")).alias("ground_truth"), (percent("l_tax") % 4).alias("shift"), (c("l_quantity") % 50 != 0).alias("rated"),
    )
    lines = lines.repartition(parts, "session").join(orders.repartition(parts, "session"), "session")
    shift = c("shift") + sum(((x % m == k).cast("int") for x, m, k in ((c("patient"), 3, 0), (c("session"), 4, 0), (c("model"), 3, 0), (c("item"), 3, 1))), F.lit(-2))
    rating = F.when(c("rated"), F.least(F.greatest(c("ground_truth") + shift, F.lit(0)), F.lit(CAP)).cast("double"))
    of_session = ["session", "patient", "piece", "num_trans_tokens"]
    lines = lines.select(*of_session, "item", "model", "run", "ground_truth", rating.alias("rating")).repartition(parts, "patient", "piece")
    items = lines.groupBy(*of_session, "item", "model", "run").agg(F.max("ground_truth").cast("long").alias("ground_truth"), F.max("rating").alias("rating"))
    # a row goes to its own sum and to the total's
    both = items.select(*of_session, "model", "run", "ground_truth", "rating", F.inline(F.array(F.struct(c("item").alias("item"), F.lit(False).alias("total")), F.struct(F.lit(0).alias("item"), F.lit(True).alias("total")))))
    out = both.groupBy(*of_session, "item", "total", "model", "run").agg(F.sum("ground_truth").alias("ground_truth"), F.sum("rating").alias("rating"))
    out = out.drop("total").join(F.broadcast(models), "model")  # a row for each nation
    words = F.when(c("reasoning"), (17 * c("session") + 5 * c("item") + 3 * c("model") + 29 * c("run")) % 800).otherwise(0)
    return out.withColumns({"failure": c("rating").isNull().cast("int"), "num_reason_tokens": words})
