"""Agreement statistics as columns for groupBy().agg(): y is the ground truth, p the rating. All are sums, combined
before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mae(y, p) -> Column:
    """Mean absolute error."""
    return F.avg(F.abs(_c(y) - _c(p)))


def r2(y, p) -> Column:
    """1 - SSE / SST about the mean of y; 1 or 0 where SST is 0, null for fewer than two pairs. Not a squared correlation."""
    y, p = _c(y).cast("double"), _c(p).cast("double")
    sse, n = F.sum((y - p) * (y - p)), F.count(y)
    sst = F.var_pop(y) * n  # not from raw sums, which lose digits where n is large
    return F.when(n < 2, None).when(sst <= 1e-12, F.when(sse <= 1e-12, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(sse, sst))


def anova(y, p) -> dict[str, Column]:
    """Mean squares of two raters: rows, within, columns, error; and n."""
    y, p = _c(y).cast("double"), _c(p).cast("double")
    d, n = y - p, F.count(y)
    return {"rows": 2 * F.var_samp((y + p) / 2), "within": F.avg(d * d) / 2, "error": F.var_samp(d) / 2, "columns": n * F.avg(d) * F.avg(d) / 2, "n": n}


def icc(y, p, kind: str = "icc3") -> Column:
    """Intraclass correlation of two raters: icc1, icc2, icc3 and their averages icc1k, icc2k, icc3k."""
    m = anova(y, p)
    r, w, e, c, n = (m[k] for k in ("rows", "within", "error", "columns", "n"))
    top, bottom = {
        "icc1": (r - w, r + w),
        "icc2": (r - e, r + e + 2 * (c - e) / n),
        "icc3": (r - e, r + e),
        "icc1k": (r - w, r),
        "icc2k": (r - e, r + (c - e) / n),
        "icc3k": (r - e, r),
    }[kind]
    return F.try_divide(top, bottom)


def confusion(y, p) -> tuple[Column, Column, Column]:
    """True positives, false positives and false negatives of two 0/1 columns."""
    y, p = _c(y), _c(p)
    return F.count_if((y == 1) & (p == 1)), F.count_if((y == 0) & (p == 1)), F.count_if((y == 1) & (p == 0))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def precision(y, p) -> Column:
    tp, fp, _ = confusion(y, p)
    return ratio(tp, tp + fp)


def recall(y, p) -> Column:
    tp, _, fn = confusion(y, p)
    return ratio(tp, tp + fn)


def f1(y, p) -> Column:
    tp, fp, fn = confusion(y, p)
    return ratio(2 * tp, 2 * tp + fp + fn)
