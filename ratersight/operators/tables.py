"""Joins, ranks, reshapes and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratersight.sources.stages import SMALL_ROWS, kept, small

#: Rows of one group that may meet in one task of a join.
SALT_ROWS = 1_000_000


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    place = _free(df, "place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) == 1).drop(place)


def _free(df: DataFrame, name: str) -> str:
    """A name that df has no column of."""
    while name in df.columns:
        name += "_"
    return name


def visit_number(patient: str, date: str) -> Column:
    """The dense rank of a date within its patient; null dates have none and count for nothing."""
    rank = F.dense_rank().over(Window.partitionBy(patient).orderBy(F.col(date).asc_nulls_last()))
    return F.when(F.col(date).isNotNull(), rank).cast("long")


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined to right on keys that are equal or both null; the keys are left's."""
    other = right.select(*(F.col(k).alias(f"other {k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"other {k}"))
    return left.join(other, same, how).drop(*(f"other {k}" for k in keys))


def lookup(df: DataFrame, dimension: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """A dimension's columns by key, with defaults for misses. It is broadcast only if the session's size limit allows."""
    out = df.join(dimension, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def ranked_rows(df: DataFrame, key: str) -> DataFrame:
    """df with place, the row's number from 1 in the order of a key that no two rows share, and total, the number of rows.

    Rows are dealt to ranges of keys, whatever the gaps between them, sorted there and written with their number inside the
    range; what is counted over all ranges is one row for each range. No task gets all rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, of = _free(df, "at"), _free(df, "of")
    dealt = df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn(at, F.monotonically_increasing_id())
    own = kept(dealt.withColumns({of: F.shiftright(at, 33), at: F.col(at).bitwiseAND((1 << 33) - 1)}), "ranked")
    counts = own.groupBy(of).agg(F.count("*").alias("n"))  # a row for each range
    before = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(of, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    return own.join(F.broadcast(counts), of).withColumn("place", F.col(at) + F.col("before") + 1).drop(at, of, "before")


def shard(order: str, shards: int, total: Column) -> Column:
    """Contiguous shards of total // shards rows by rank `order` (from 1); the last one takes what is over."""
    size = F.floor(total / shards)
    return F.when(size == 0, shards - 1).otherwise(F.least(F.floor((F.col(order) - 1) / F.greatest(size, F.lit(1))), F.lit(shards - 1))).cast("int")


def equal_chunks(total: Column, most: int) -> Column:
    """Chunks (no, start, size) of at most `most`: sizes differ by one, the longer ones first."""
    n = F.ceil(total / most).cast("long")
    size, over = F.floor(total / n), total % n
    each = lambda i: F.struct(i.alias("no"), (i * size + F.least(i, over)).alias("start"), (size + F.when(i < over, 1).otherwise(0)).alias("size"))
    return F.when(total > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), each))


def ranges(text: Column) -> Column:
    """`34, 226-246` as an array of (lo, hi); parts that are no numbers are left out."""
    part = F.transform(F.split(text, ","), lambda p: F.trim(p))
    both = F.transform(part, lambda p: F.struct(F.split(p, "-")[0].try_cast("int").alias("lo"), F.element_at(F.split(p, "-"), -1).try_cast("int").alias("hi")))
    return F.filter(both, lambda r: r["lo"].isNotNull() & r["hi"].isNotNull())


#: Lines of one bin of a join by ranges.
BIN = 64


def in_ranges(lines: DataFrame, specs: DataFrame, session: str = "session", line: str = "line", item: str = "item") -> DataFrame:
    """lines (session, line, ...) with the item of each range of specs (session, item, spec) that they lie in, once for each
    range of an item. spec is a text as ranges() reads it.

    Ranges and lines meet in bins of BIN lines: an equality join, in which a range stands for each bin it touches, up to its
    session's last line. A long session's bins are different keys, so no task has all of it."""
    last = lines.groupBy(session).agg(F.max(line).alias("last"))
    spans = specs.select(session, item, F.inline(ranges(F.col("spec")))).join(last, session)
    spans = spans.withColumn("hi", F.least("hi", "last")).filter("lo <= hi")
    spans = spans.select(session, item, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor(F.col("hi") / BIN))).alias("bin"))
    return lines.withColumn("bin", F.floor(F.col(line) / BIN)).join(spans, [session, "bin"]).filter(F.col(line).between(F.col("lo"), F.col("hi"))).drop("bin", "lo", "hi")


#: Bins of one step of a selection, and rows of a group whose values may be gathered.
STEP_BINS, GATHERED = 1024, 10_000


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """keys, n and exact interpolated quantiles `at` (name: share) of a value; nulls and NaN are left out.

    Groups of GATHERED rows or fewer hold their values while they are summed up. Of larger ones the ranks are selected: a
    histogram between the least and the greatest value tells each rank's bin, whose own least and greatest value bound the
    next one, until a bin has one value or few rows. Each step is a grouped sum of counts, whatever the number of rows, and
    reads only what lies in the bins that are left; no task has a group's values."""
    names = keys or ["whole"]
    own = df if keys else df.withColumn("whole", F.lit(0))
    own = own.select(*names, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    own = kept(own, "values")
    base = kept(own.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    few, many = base.filter(F.col("n") <= GATHERED), base.filter(F.col("n") > GATHERED)
    if keys:
        gathered = matched(own, small(few.select(*names)), names, "left_semi")
    else:
        gathered = own.filter(F.lit(few.count() > 0))
    done = gathered.groupBy(*names).agg(F.count("*").alias("n"), *(F.percentile("v", F.lit(p)).alias(name) for name, p in at.items()))
    if not many.isEmpty():
        place = {name: (F.col("n") - 1) * p for name, p in at.items()}
        ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(h), F.ceil(h)) for h in place.values()))))
        state = kept(many.select(*names, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "lo", "hi"), "ranks")
        value_of = _selected(own, state, names).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("x"))  # two for each quantile
        both = matched(many, value_of, names)
        blend = lambda h: (F.ceil(h) - h) * F.col("x")[F.floor(h)] + (h - F.floor(h)) * F.col("x")[F.ceil(h)]
        done = done.unionByName(both.select(*names, "n", *(F.when(F.floor(h) == F.ceil(h), F.col("x")[F.floor(h)]).otherwise(blend(h)).alias(name) for name, h in place.items())))
    return done if keys else done.drop("whole")


def _selected(own: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """(names, rank, x): the values of the ranks of state (names, rank, below, inside, lo, hi) among own (names, v): `inside`
    values lie from lo to hi, `below` before them."""
    closed = None
    while True:
        wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > GATHERED)
        closed = state.filter(~wide) if closed is None else closed.union(state.filter(~wide))
        state = state.filter(wide)
        if state.isEmpty():
            break
        # halves, so that the width of any range is finite
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bin = F.least(F.floor(share * STEP_BINS), F.lit(STEP_BINS - 1))
        rows = matched(own, small(state), names).filter(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(*names, "rank", "below", bin.alias("bin")).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("inside").over(Window.partitionBy(*names, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("below", F.col("below") + upto - F.col("inside")).filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("inside")))
        state = kept(rows.select(*names, "rank", "below", "inside", "lo", "hi"), "ranks")
    closed = kept(closed, "ranks")
    left = matched(own, small(closed.filter("lo < hi")), names).filter(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(*names, "rank", "below").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    left = left.select(*names, "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("x"))
    return closed.filter("lo = hi").select(*names, "rank", F.col("lo").alias("x")).union(left)


def flags(df: DataFrame, keys: list[str], value: str, slack: float = 1e-6) -> DataFrame:
    """best and worst: whether a value is within slack of its group's least or greatest."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"best": F.abs(F.col(value) - F.min(value).over(w)) <= slack, "worst": F.abs(F.col(value) - F.max(value).over(w)) <= slack})


def box(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Box statistics: n, median, mean, population deviation, extremes, quartiles and 5 and 95 % whiskers. The groups are
    those of a report; quantiles() is for groups of any size."""
    q = lambda p, name: F.percentile(value, F.lit(p)).alias(name)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), q(0.5, "median"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), q(0.25, "q1"), q(0.75, "q3"), q(0.05, "p5"), q(0.95, "p95"))


def centre(df: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """df with, for each value, its group's mean (v_between) and the distance from it (v_within).

    Means are summed before the shuffle and joined back: broadcast where a count shows that they are few, else by a shuffled
    join in which each group's rows are dealt out over salts by the group's size, so that no task has a whole hot group."""
    means = df.groupBy(*keys).agg(*(F.avg(v).alias(f"{v}_between") for v in values), F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    means = kept(means, "means")
    within = {f"{v}_within": F.col(v) - F.col(f"{v}_between") for v in values}
    if means.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return matched(df, F.broadcast(means.drop("salts")), keys, "left").withColumns(within)
    most = means.agg(F.max("salts")).first()[0]  # a row takes one of as many salts as the largest group has
    salt = _free(df, "salt")
    salted = df.withColumn(salt, (F.rand(0) * most).cast("int"))
    dealt = means.drop("salts").withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    return matched(salted, dealt, [*keys, salt], "left").withColumns(within).drop(salt)


def z_scores(df: DataFrame, values: list[str]) -> DataFrame:
    """Each value less its mean over its sample deviation; 0 where that is 0 or unknown. The totals are found once, when this is
    called, however often df is read after that."""
    got = df.agg(*(f(v).alias(f"{name}_of_{v}") for v in values for name, f in (("mean", F.avg), ("deviation", F.stddev_samp)))).first()

    def z(v: str) -> Column:
        mean, deviation = got[f"mean_of_{v}"], got[f"deviation_of_{v}"]
        if mean is None or deviation is None or deviation <= 0:
            return F.lit(0.0)
        return F.coalesce((F.col(v) - F.lit(mean)) / F.lit(deviation), F.lit(0.0))

    return df.select("*", *(z(v).alias(f"{v}_z") for v in values))


def left_preferred(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which columns that both sides have are the left side's."""
    return left.join(right.drop(*(c for c in right.columns if c in left.columns and c not in keys)), keys, "left")


def listed(df: DataFrame, model: str, table: DataFrame, key: str, deny: tuple = (), allow: tuple | None = None) -> DataFrame:
    """The rows whose model is in a table of models, not on the deny-list and, if there is one, on the allow-list."""
    out = df.join(table.select(F.col(key).alias(model)).distinct(), model, "left_semi")
    if deny:
        out = out.filter(~F.col(model).isin(*deny))
    return out if allow is None else out.filter(F.col(model).isin(*allow))


def renamed(df: DataFrame, column: str, names: DataFrame, shown: str, key: str, to: str) -> DataFrame:
    """`to`: the key of a shown name by a table of names, or the name itself where it is not there. Of several keys the least."""
    one = names.groupBy(F.col(shown).alias(column)).agg(F.min(key).alias(to))
    return df.join(one, column, "left").withColumn(to, F.coalesce(F.col(to), F.col(column).cast(one.schema[to].dataType)))


def unpivoted(df: DataFrame, keys: list[str], columns: dict[str, object], name: str, value: str) -> DataFrame:
    """Label columns as rows: `columns` maps each one to the value of `name`."""
    parts = F.array(*(F.struct(F.lit(v).alias(name), F.col(c).alias(value)) for c, v in columns.items()))
    return df.select(*keys, F.inline(parts))


def shared_columns(left: DataFrame, right: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Names that both tables have, those of the left one alone and those of the right one alone, in their order."""
    both = [c for c in left.columns if c in right.columns]
    return both, [c for c in left.columns if c not in both], [c for c in right.columns if c not in both]


def stacked(df: DataFrame, columns: list[str], name: str = "value") -> DataFrame:
    """The values of several columns in one."""
    return df.select(F.explode(F.array(*(F.col(c) for c in columns))).alias(name))


def position(keys: list, order: list) -> Column:
    """The place, from 1, of a row within its keys in a full order; without keys the table should be a report's."""
    return F.row_number().over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order))


def aligned(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Predictors of two fits side by side: the left one's in its order, then those of the right one alone in theirs."""
    a = left.select(key, F.struct(*(c for c in left.columns if c != key)).alias("l"))
    b = right.select(key, F.struct(*(c for c in right.columns if c != key)).alias("r"))
    return a.join(b, key, "full_outer").withColumn("place", position([], [F.col("l").isNull(), F.coalesce(F.col("l")[order], F.col("r")[order]), key]))


def in_order(df: DataFrame, column: str, order: list) -> DataFrame:
    """The rows whose value is in a fixed list, with their place in it."""
    spark = df.sparkSession
    listed_values = spark.createDataFrame(list(enumerate(order)), f"place int, {column} {df.schema[column].dataType.simpleString()}")
    return df.join(F.broadcast(listed_values), column)  # a literal list


def pauses(df: DataFrame, keys: list[str], gap: str, long: float = 0.5, lists: bool = False) -> DataFrame:
    """Of gaps over 0: count, mean, deviation, quantiles, and how many are over `long`; with lists, these in falling order as
    an array besides (long_pauses() has a row for each)."""
    own = kept(df.filter(F.col(gap) > 0).select(*keys, gap), "gaps")
    over = F.sort_array(F.collect_list(F.when(F.col(gap) > long, F.col(gap))), asc=False).alias("long")
    sums = own.groupBy(*keys).agg(F.avg(gap).alias("mean"), F.stddev_pop(gap).alias("std"), F.count_if(F.col(gap) > long).alias("n_long"), *([over] if lists else []))
    at = quantiles(own, keys, gap, {f"p{round(100 * p)}": p for p in (0.25, 0.5, 0.75, 0.9, 0.95)})
    return matched(at, sums, keys) if keys else at.join(F.broadcast(sums))  # one row each


def long_pauses(df: DataFrame, keys: list[str], gap: str, long: float = 0.5) -> DataFrame:
    """The gaps over `long`, a row each, with their place from the longest within their keys."""
    own = df.filter(F.col(gap) > long).select(*keys, gap)
    return own.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(gap))))
