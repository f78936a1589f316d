"""Features of rating errors, and the mixed model of them by strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratersight.functions.text import log_params
from ratersight.operators import pieces
from ratersight.operators.mixed import Fit, equations, mixed_model  # noqa: F401
from ratersight.operators.tables import centre, position, z_scores
from ratersight.sources.stages import kept

ERROR_OF_MISSING = 6.0


def seed_means(cells: DataFrame, of_session: tuple[str, ...] = ()) -> DataFrame:
    """One row per (session, item, model): means over runs of rating, error, absolute error and reasoning tokens, and what
    all runs share. Item 0 is a tenth of itself; a missing rating counts as an error of 6 and as no rating. Columns that
    each session has one value of may be named: rows are told apart by them too, so cells dealt by them stay where they are."""
    scale = F.when(F.col("item") == 0, 10.0).otherwise(1.0)
    ok = F.col("failure") == 0
    error = F.when(ok, (F.col("rating") - F.col("ground_truth")) / scale).otherwise(ERROR_OF_MISSING)
    shared = [c for c in ("patient", "num_trans_tokens", "total_params", "context_length", "architecture", "reasoning") if c in cells.columns and c not in of_session]
    return cells.groupBy("session", *of_session, "item", "model").agg(
        F.avg(F.when(ok, F.col("rating") / scale)).alias("rating"),
        F.avg(error).alias("error"),
        F.avg(F.abs(error)).alias("abs_error"),
        *([F.avg("num_reason_tokens").alias("num_reason_tokens")] if "num_reason_tokens" in cells.columns else []),
        (F.min("ground_truth") / F.min(scale)).alias("severity"),
        F.count("*").alias("n"),
        *(F.min_by(c, "run").alias(c) for c in shared),
    )


#: Terms of the model by stratum, before those without variation go.
TERMS = ("severity_between_z", "log_tokens_between_z", "severity_within_z", "log_tokens_within_z", "log_params_z", "log_context_z", "architecture")
REASONING_TERMS = ("log_reason_between_z", "log_reason_within_z")


def engineered(seeds: DataFrame) -> DataFrame:
    """Logarithms, centring and standardising of seed_means(), in that order, over all strata together: severity and
    reasoning tokens within patient and item, transcript tokens within patient."""
    log = lambda c: F.log10(F.col(c) + 1)
    own = kept(seeds, "seeds")  # means, totals and rows are read from it
    own = own.withColumns({"log_tokens": log("num_trans_tokens"), "log_reason": log("num_reason_tokens"), "log_context": log("context_length"), "log_params": log_params(F.col("total_params"))})
    own = centre(own, ["severity", "log_reason"], ["patient", "item"])
    own = centre(own, ["log_tokens"], ["patient"])
    return z_scores(own, ["log_params", "log_context", *(f"{v}_{k}" for v in ("severity", "log_tokens", "log_reason") for k in ("between", "within"))])


def engineered_pieces(seeds: DataFrame, models: DataFrame) -> DataFrame:
    """engineered() of the seed_means() of cells that lie in pieces of patients, which are written once: means of patients are
    windows over their pieces, with no shuffle, and those of patients in several pieces, a few, are joined back. models has the
    columns (model, total_params, context_length, ...) that the seeds don't."""
    log = lambda c: F.log10(F.col(c) + 1)
    groups = {"severity": ["item"], "log_reason": ["item"], "log_tokens": []}
    own = seeds.withColumns({"log_tokens": log("num_trans_tokens"), "log_reason": log("num_reason_tokens")}).drop("num_trans_tokens", "num_reason_tokens", "error", "n")
    own = own.withColumns({f"{v}_between": F.avg(v).over(Window.partitionBy("patient", "piece", *keys)) for v, keys in groups.items()})
    own = pieces.gathered(own, "patient", "seeds")
    if not (cut := own.filter("piece >= 0")).isEmpty():
        for keys in ([], ["item"]):
            values = [v for v, k in groups.items() if k == keys]
            means = kept(cut.groupBy("patient", *keys).agg(*(F.avg(v).alias(f"mean of {v}") for v in values)), "means").withColumn("cut", F.lit(True))
            means = means.select(F.col("patient").alias("other patient"), *(F.col(k).alias(f"other {k}") for k in keys), *(f"mean of {v}" for v in values), "cut")
            same = F.col("piece") >= 0
            for k in ("patient", *keys):
                same = same & F.col(k).eqNullSafe(F.col(f"other {k}"))
            own = own.join(F.broadcast(means), same, "left")  # an item's row for each SESSIONS_OF_PIECE sessions at most
            own = own.withColumns({f"{v}_between": F.when(F.col("cut"), F.col(f"mean of {v}")).otherwise(F.col(f"{v}_between")) for v in values}).select(*(c for c in own.columns if not c.startswith(("other ", "mean of ")) and c != "cut"))
    own = own.withColumns({f"{v}_within": F.col(v) - F.col(f"{v}_between") for v in groups})
    models = models.withColumns({"log_context": log("context_length"), "log_params": log_params(F.col("total_params"))})
    own = own.join(F.broadcast(models), "model")  # a row for each model
    return z_scores(own, ["log_params", "log_context", *(f"{v}_{k}" for v in ("severity", "log_tokens", "log_reason") for k in ("between", "within"))])


def frame(cells: DataFrame) -> DataFrame:
    """seed_means() of a bare panel (session, item, model, run, ...), in which a patient is a residue class of sessions and
    the parameters follow the model's number; severity is centred and the parameters standardised."""
    own = kept(seed_means(cells), "seeds").withColumns({"patient": F.col("session") % 50, "reasoning": F.col("model") % 2 == 0, "log_params": F.log10(F.col("model") + 1)})
    own = centre(own, ["severity"], ["patient", "item"])
    return z_scores(own, ["log_params"])


def prunable(df: DataFrame, terms: list[str]) -> DataFrame:
    """For each term, whether it varies and so may stay in a model."""
    return df.agg(*((F.count_distinct(t) >= 2).alias(t) for t in terms))


#: The factors of random intercepts: few levels, and the patient with the visit (session within patient) inside it.
DENSE, NESTED = ("model", "item"), ("patient", "visit")


def stratum(seeds: DataFrame, reasoning: bool) -> DataFrame:
    """The rows of engineered() seeds of reasoning models or of the others, with the visit."""
    return seeds.filter(F.col("reasoning") if reasoning else ~F.col("reasoning")).withColumn("visit", F.concat_ws(":", "session", "patient"))


def strata(seeds: DataFrame, y: str = "abs_error") -> dict[str, Fit]:
    """The error model of the reasoning models and that of the others: random intercepts of model, item, patient and session
    within patient; the reasoning ones have terms of the reasoning's length besides."""
    own = seeds if "piece" in seeds.columns else kept(seeds, "seeds")  # several sums read it; seeds in pieces are written already
    return {name: mixed_model(stratum(own, name == "reason"), y, [*TERMS, *(REASONING_TERMS if name == "reason" else ())], list(DENSE), NESTED) for name in ("nonreason", "reason")}


def effects(spark, fits: dict[str, Fit]) -> DataFrame:
    """(stratum, term, estimate, se, low, high) of the fixed terms, with 95 % intervals."""
    rows = [(k, t, e, s, e - 1.96 * s, e + 1.96 * s) for k, f in fits.items() for t, e, s in f.terms]
    return spark.createDataFrame(rows, "stratum string, term string, estimate double, se double, low double, high double")


def item_effects(spark, fits: dict[str, Fit], factor: str = "item") -> DataFrame:
    """(stratum, factor, level, dev, dev_low, dev_high, total, place): a factor's deviations with 95 % intervals, joined to
    their totals (intercept and deviation); place counts by the total, from the least."""
    schema = "stratum string, factor string, level string, "
    deviations = spark.createDataFrame([(k, g, x, e, e - 1.96 * s, e + 1.96 * s) for k, f in fits.items() for g, x, e, s in f.levels if g == factor], schema + "dev double, dev_low double, dev_high double")
    totals = spark.createDataFrame([(k, g, x, f.terms[0][1] + e) for k, f in fits.items() for g, x, e, _ in f.levels if g == factor], schema + "total double")
    out = totals.join(deviations, ["stratum", "factor", "level"], "left")
    return out.withColumn("place", position(["stratum"], ["total", "level"]))


def reports(spark, fits: dict[str, Fit]) -> DataFrame:
    """(stratum, formula, n, noise, variances, iterations, converged, singular, dropped, deviance, gradient) of each fit."""
    rows = [(k, f.formula, f.n, f.noise, f.variances, f.iterations, f.converged, f.singular, f.dropped, f.deviance, f.gradient) for k, f in fits.items()]
    return spark.createDataFrame(rows, "stratum string, formula string, n long, noise double, variances map<string,double>, iterations int, converged boolean, singular boolean, dropped map<string,string>, deviance double, gradient double")
