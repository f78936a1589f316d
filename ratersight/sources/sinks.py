"""What queries leave behind: partitioned predictions, sheets, stages, and reports of small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratersight.functions import text as X
from ratersight.operators import features

#: Reports are made on the driver, of tables of models or terms; larger ones are refused rather than cut.
REPORT_ROWS = 10_000
#: Rows of a sheet's file, which one task sorts.
SHEET_ROWS = 2_000_000


def write_predictions(df: DataFrame, path: str) -> DataFrame:
    """Append predictions, partitioned by model and run so that readers prune; returns a reader."""
    df.write.mode("append").partitionBy("model", "run").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_sheets(df: DataFrame, path: str, item: str = "item", name: str = "item_name", order: tuple[str, ...] = ("model", "session")) -> None:
    """One folder of gzipped CSV a sheet, named by its item; a sheet's files, read in the order of their names, are sorted by `order`.

    Rows are dealt to ranges of (sheet, order), as many as a count asks for, so a hot item takes several tasks and files, and
    a small one shares a task."""
    own = df.withColumn("sheet", X.sheet_name(F.col(item), F.col(name)))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SHEET_ROWS))
    dealt = own.repartitionByRange(parts, "sheet", *order).sortWithinPartitions("sheet", *order)
    dealt.write.mode("overwrite").partitionBy("sheet").csv(path, header=True, compression="gzip")


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage of a longer run and go on from what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bundle(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Write the tables of a run, each as a stage of its own, and go on from what was written; later ones may be added."""
    return {name: stage(df, f"{path}/{name}") for name, df in tables.items()}


def write_snapshot(seeds: DataFrame, fits: dict, path: str) -> dict[str, DataFrame]:
    """A snapshot of an error analysis: its seeds, and the fixed effects, item effects and reports of its fits, each a table
    of a bundle. files.snapshot() reads it back."""
    spark = seeds.sparkSession
    return write_bundle({"seeds": seeds, "effects": features.effects(spark, fits), "items": features.item_effects(spark, fits), "reports": features.reports(spark, fits)}, path)


def write_table(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_labelled(df: DataFrame, path: str, text: str = "body", label: str = "label") -> None:
    """Each output as text with its ground truth in a last line, in folders by model and run."""
    own = df.select("model", "run", F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\nGround Truth: "), F.coalesce(F.col(label).cast("string"), F.lit(""))).alias("value"))
    own.write.mode("append").partitionBy("model", "run").text(path)


def ablation_csv(rows: DataFrame, deltas: DataFrame) -> str:
    """The text of an ablation's table: each configuration and mode with its items and their statistics, then an empty line
    and each configuration's median delta; four decimals, nothing for null."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    part = lambda df: "".join(",".join(x) + "\r\n" for x in [df.columns, *([cell(v) for v in r] for r in _small(df))])
    return part(rows) + "\r\n" + part(deltas)


def as_json(*columns: str) -> Column:
    """A row as one JSON text."""
    return F.to_json(F.struct(*columns))


def _small(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report takes {REPORT_ROWS} rows at most")
    return rows


def mean_and_std(mean: float | None, std: float | None, missing: str = "--") -> str:
    """`mean ± std` with two decimals, ties to even as Python formats them."""
    return missing if mean is None or mean != mean else f"{mean:.2f}" + ("" if std is None or std != std else f" ± {std:.2f}")


def _latex(v) -> str:
    """A value as LaTeX text: two decimals, dashes for null."""
    return "--" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("\\", r"\textbackslash ").replace("&", r"\&").replace("%", r"\%").replace("_", r"\_").replace("#", r"\#")


def latex(df: DataFrame) -> str:
    """The rows of a small, ordered table as the body of a LaTeX table."""
    return "".join(" & ".join(_latex(v) for v in row) + " \\\\\n" for row in _small(df))


def latex_table(df: DataFrame, headers: list[str], caption: str, label: str, group: str | None = None, best: dict[str, bool] | None = None, tints: dict[str, str] | None = None) -> str:
    """A small, ordered table as a LaTeX table. group: a column whose values head groups of rows and is not shown. best:
    columns whose best values (least if true) are bold. tints: columns with the name of the column of their colour, which
    is not shown."""
    rows, best, tints = _small(df), best or {}, tints or {}
    hidden = {group, *tints.values()}
    shown = [c for c in df.columns if c not in hidden]
    top = {c: (min if low else max)((r[c] for r in rows if r[c] is not None), default=None) for c, low in best.items()}

    def cell(r, c: str) -> str:
        text = f"\\textbf{{{_latex(r[c])}}}" if c in top and r[c] is not None and abs(r[c] - top[c]) <= 1e-6 else _latex(r[c])
        return f"\\cellcolor{{{r[tints[c]]}}}{text}" if tints.get(c) and r[tints[c]] else text

    body, last = "", None
    for r in rows:
        if group and r[group] != last:
            last = r[group]
            body += f"\\midrule\n\\multicolumn{{{len(shown)}}}{{l}}{{\\textit{{{_latex(last)}}}}} \\\\\n"
        body += " & ".join(cell(r, c) for c in shown) + " \\\\\n"
    head = " & ".join(f"\\textbf{{{_latex(h)}}}" for h in headers)
    return f"\\begin{{table}}\n\\caption{{{_latex(caption)}}}\n\\label{{{label}}}\n\\begin{{tabular}}{{l{'r' * (len(shown) - 1)}}}\n\\toprule\n{head} \\\\\n{'' if group else chr(92) + 'midrule' + chr(10)}{body}\\bottomrule\n\\end{{tabular}}\n\\end{{table}}\n"


def model_report(effects: DataFrame, counts: dict[str, int], term: str = "term", estimate: str = "estimate", error: str = "se") -> str:
    """A plain-text report of a fitted model: the number of groups of each factor, then a line a term with its interval."""
    head = "".join(f"{k}: {v}\n" for k, v in counts.items())
    lines = (f"{r[term]:<32}{r[estimate]: .6f} {r[error]:.6f} [{r[estimate] - 1.96 * r[error]: .6f}, {r[estimate] + 1.96 * r[error]: .6f}]\n" for r in _small(effects))
    return head + "".join(lines)
