"""A linear mixed model by restricted maximum likelihood (REML), from sums that Spark makes.

Factors of few levels (models, items) stay in a dense system. Two nested ones of any number of levels (visits within patients)
are eliminated level by level: a visit's equations are diagonal once its patient is given, and so are the patients' after that,
so what a patient leaves in the dense system is a product of its own sums, weighted by two variance ratios. A patient's sums by
the size of its visits are all that is kept of it (`blocks`); Spark adds up what blocks leave, with the first and second
derivatives by the ratios, for each step of the search.

Rows are read in pieces of outer levels (`pieces`), so visits are added up where they are read: the design is not written, and
visits are neither shuffled nor written. Of an outer level in several pieces, what each leaves is added up by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratersight.operators import pieces
from ratersight.sources.stages import kept

#: Levels of all dense factors and of a categorical term.
MOST_LEVELS = 500
#: Blocks of outer levels that are searched on the driver, for a start if there are more of them.
START_BLOCKS = 1000
#: Bounds of the logarithms of variance ratios.
BOUND = 16.0


def pruned(df: DataFrame, terms: list[str]) -> tuple[list[str], dict[str, str]]:
    """The terms that vary, and the reasons why others go: missing, all 0, no variation, single level."""
    there = [t for t in terms if t in df.columns]
    text = {t for t, kind in df.dtypes if kind == "string"}
    got = df.agg(*(f(t).alias(f"{name}_{t}") for t in there for name, f in (("low", F.min), ("high", F.max)))).first() if there else {}
    why = {t: "missing" for t in terms if t not in there}
    for t in there:
        if got[f"low_{t}"] == got[f"high_{t}"]:  # or both are null
            why[t] = "single level" if t in text else "all 0" if got[f"low_{t}"] == 0 else "no variation"
    return [t for t in terms if t not in why], why


def formula(y: str, fixed: list[str], random: list[str]) -> str:
    """A model's formula as text."""
    return f"{y} ~ {' + '.join(fixed) or '1'} + {' + '.join(f'(1 | {r})' for r in random)}"


@dataclass
class Fit:
    """What a fit has found. terms: (term, estimate, se), a level of a categorical term by the term's name and its own.
    levels: (factor, level, effect, se) of the dense factors. variances: by factor, and of the noise. gradient: the largest
    derivative of the deviance by the logarithm of a variance ratio, but where a bound holds it. rows: the design in pieces,
    layout: its columns, blocks: sums of the outer levels, for nested_effects(). columns: (name, the design's column) of the
    fixed terms, in the solution's order."""

    formula: str
    n: int
    terms: list[tuple[str, float, float]]
    levels: list[tuple[str, str, float, float]]
    variances: dict[str, float]
    noise: float
    iterations: int
    converged: bool
    dropped: dict[str, str]
    gradient: float = 0.0
    deviance: float = 0.0
    slopes: dict[str, float] = field(default_factory=dict)
    rows: DataFrame | None = None
    layout: Layout | None = None
    blocks: DataFrame | None = None
    columns: list[tuple[str, Column]] = field(default_factory=list)
    nested: tuple[str, ...] = ()

    @property
    def singular(self) -> bool:
        return any(v < 1e-5 * self.noise for v in self.variances.values())


# --- rows in matrices ---------------------------------------------------------------------------------------------------


@dataclass
class Layout:
    """Columns of the dense system: fixed terms, then a column for each level of each factor (its rows' column, its levels),
    then y."""

    fixed: list[str]
    factors: list[tuple[str, list[str]]]

    @property
    def d(self) -> int:
        return len(self.fixed) + sum(len(levels) for _, levels in self.factors) + 1

    def matrix(self, rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        out = np.zeros((rows.num_rows, self.d))
        for i, c in enumerate(self.fixed):
            out[:, i] = rows.column(c).to_numpy()
        at = len(self.fixed)
        for c, levels in self.factors:
            own = rows.column(c)
            out[np.arange(len(out)), at + pc.index_in(own, value_set=pa.array(levels, own.type)).to_numpy()] = 1.0
            at += len(levels)
        out[:, -1] = rows.column("y").to_numpy()
        return out


def _numbers(flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])


def _gram(layout: Layout) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cross-products of a task's rows, as (at, v)."""

    def gram(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((layout.d, layout.d))
        for batch in batches:
            x = layout.matrix(batch)
            total += x.T @ x
        yield _numbers(total.ravel())

    return gram


def _summed(df: DataFrame, n: int) -> np.ndarray:
    """Numbers (at, v) added up by their places."""
    out = np.zeros(n)
    for r in df.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out


@dataclass
class Visits:
    """Inner levels in rows of whole pieces. order: the rows sorted by them; x: the design of these; begin: where each inner
    level begins; size: its rows; of: the number of its piece. Without an inner factor a piece is its only inner level."""

    order: np.ndarray
    x: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    of: np.ndarray

    @property
    def sums(self) -> np.ndarray:
        return np.add.reduceat(self.x, self.begin)


def _visits(rows: pa.Table, starts: np.ndarray, layout: Layout, depth: int) -> Visits:
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
    if depth == 1:
        return Visits(np.arange(len(of)), layout.matrix(rows), starts, np.diff(np.append(starts, len(of))), np.arange(len(starts)))
    inner = pieces.codes(rows.column("nest1"))
    order = np.lexsort((inner, of))
    begin = pieces.changes(inner[order], of[order])
    return Visits(order, layout.matrix(rows)[order], begin, np.diff(np.append(begin, len(of))), of[order][begin])


def _binary(values: np.ndarray, many: np.ndarray) -> pa.Array:
    """The bytes of values, of so many rows each."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    ends = np.append(0, np.cumsum(many) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


# --- what blocks leave in the dense system ---------------------------------------------------------------------------


@dataclass
class Blocks:
    """Outer levels: of each, for each size that its inner levels have, the size, their number and the sum of their design.
    begin: where each level's rows begin. Without an inner factor a level is one row of its own size."""

    size: np.ndarray
    times: np.ndarray
    sums: np.ndarray
    begin: np.ndarray


@dataclass
class Eliminated:
    """What nested factors leave: terms of the dense matrix and of the log determinant, with derivatives by the outer (a) and
    inner (b) reciprocal ratio, in the order 1, a, b, aa, ab, bb."""

    matrix: np.ndarray
    log: np.ndarray

    def __add__(self, other: Eliminated) -> Eliminated:
        return Eliminated(self.matrix + other.matrix, self.log + other.log)


def of_outer(blocks: Blocks, a: float, b: float | None) -> Eliminated:
    """What outer levels leave after their inner ones (b: their reciprocal ratio; None without an inner factor)."""
    c, k = blocks.size.astype(float), blocks.times.astype(float)
    f = [np.ones_like(c), 0 * c, 0 * c] if b is None else [b / (c + b), c / (c + b) ** 2, -2 * c / (c + b) ** 3]
    t, t1, t2 = (np.add.reduceat(x[:, None] * blocks.sums, blocks.begin) for x in f)
    w, w1, w2 = (np.add.reduceat(x * k * c, blocks.begin) for x in f)
    h = 1 / (a + w)
    own = lambda x, weight, y: x.T @ (weight[:, None] * y)
    tt = lambda weight: own(t, weight, t)
    cross = lambda weight: (lambda m: m + m.T)(own(t1, weight, t))
    twice = (lambda m: m + m.T)(own(t2, h, t)) + 2 * own(t1, h, t1)
    matrix = [-tt(h), tt(h**2), -cross(h) + tt(w1 * h**2), -2 * tt(h**3), cross(h**2) - 2 * tt(w1 * h**3), -twice + 2 * cross(w1 * h**2) + tt(w2 * h**2 - 2 * w1**2 * h**3)]
    log = [np.log(a + w), h, w1 * h, -(h**2), -w1 * h**2, w2 * h - w1**2 * h**2]
    return Eliminated(np.array(matrix), np.array([x.sum() for x in log]))


def of_inner(outer_products: dict[int, tuple[int, np.ndarray]], b: float, d: int) -> Eliminated:
    """What inner levels leave: by their size, their number and the sum of the outer products of their designs."""
    matrix, log = np.zeros((6, d, d)), np.zeros(6)
    for c, (m, g) in outer_products.items():
        for at, x, y in ((0, -1 / (c + b), np.log(c + b)), (2, 1 / (c + b) ** 2, 1 / (c + b)), (5, -2 / (c + b) ** 3, -1 / (c + b) ** 2)):
            matrix[at] += x * g
            log[at] += m * y
    return Eliminated(matrix, log)


def _parsed(columns: Iterable[list[bytes]], d: int) -> Blocks:
    """Blocks of columns (size, times, sums), each the bytes of outer levels' arrays."""
    size, times, sums = columns
    many = np.array([len(x) // 8 for x in size], int)
    number = lambda x, kind: np.frombuffer(b"".join(x), kind)
    return Blocks(number(size, "<i8"), number(times, "<i8"), number(sums, "<f8").reshape(-1, d), np.append(0, np.cumsum(many)[:-1]))


def _leave(a: float, b: float | None, d: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """of_outer() of a task's blocks, as (at, v): the numbers of an Eliminated one after another."""

    def leave(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of_outer(_parsed((c.to_pylist() for c in batch.columns), d), a, b)
                total = own if total is None else total + own
        if total is not None:
            yield _numbers(np.concatenate([total.matrix.ravel(), total.log]))

    return leave


def _cells(layout: Layout, depth: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in pieces: a row for each piece (nest0, piece, size, times, sums), and last, with no nest0, a row for each size
    of inner levels: their number and the sum of the outer products of their designs."""
    names = ["nest0", "piece", "size", "times", "sums"]

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for rows, starts in pieces.whole(batches, "nest0"):
            v = _visits(rows, starts, layout, depth)
            sums = v.sums
            if depth > 1:
                for c in np.unique(v.size).tolist():
                    own = sums[v.size == c]
                    held = total.setdefault(c, [0, np.zeros((layout.d, layout.d))])
                    held[0] += len(own)
                    held[1] += own.T @ own
            order = np.lexsort((v.size, v.of))
            size, of = v.size[order], v.of[order]
            begin = pieces.changes(size, of)
            many = np.bincount(of[begin], minlength=len(starts))
            parts = size[begin].astype("<i8"), np.diff(np.append(begin, len(of))).astype("<i8"), np.add.reduceat(sums[order], begin)
            first = rows.take(pa.array(starts)).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(first.column("nest0").to_pylist(), pa.string()), pa.array(first.column("piece").to_numpy(), pa.int32()), *(_binary(x, many) for x in parts)], names=names)
        if total:
            number = lambda x: pa.array([np.array([y], "<i8").tobytes() for y in x], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(total), pa.string()), pa.nulls(len(total), pa.int32()), number(total), number(m for m, _ in total.values()), pa.array([g.tobytes() for _, g in total.values()], pa.binary())], names=names)

    return cells


def _merged(d: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (nest0, cells: a list of (size, times, sums), one for each piece) as (nest0, size, times, sums)."""

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for cells in batch.column(1).to_pylist():
                own = _parsed(([x[k] for x in cells] for k in ("size", "times", "sums")), d)
                size, at = np.unique(own.size, return_inverse=True)
                times, sums = np.zeros(len(size), "<i8"), np.zeros((len(size), d))
                np.add.at(times, at, own.times)
                np.add.at(sums, at, own.sums)
                for held, x in zip(out, (size, times, sums)):
                    held.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in out)], names=["nest0", "size", "times", "sums"])

    return merged


def _products(d: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (size, times, sums) of outer products, by size: their number and their sum."""

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, times, sums in zip(*(c.to_pylist() for c in batch.columns)):
                (c,), (m,) = np.frombuffer(size, "<i8").tolist(), np.frombuffer(times, "<i8")
                held = total.setdefault(c, np.zeros(d * d + 1))
                held += np.append(np.frombuffer(sums, "<f8"), m)
        for c, flat in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), c)), pa.array(np.arange(len(flat))), pa.array(flat)], names=["size", "at", "v"])

    return products


# --- the fit -----------------------------------------------------------------------------------------------------------


class Deviance:
    """Twice the negative REML log-likelihood but for a constant, the noise profiled out, with its derivatives by the
    logarithms of the variance ratios: of the dense factors, then the outer nested one, then the inner one."""

    def __init__(self, full: np.ndarray, n: int, p: int, many: np.ndarray, of: np.ndarray, nested: int, leave: Callable[[float, float | None], Eliminated]):
        self.full, self.n, self.p, self.many, self.of, self.nested, self.leave = full, n, p, many, of, nested, leave
        self.dense = len(many) - nested

    def system(self, logs: np.ndarray) -> tuple[np.ndarray, Eliminated | None]:
        over = np.exp(-np.clip(logs, -BOUND, BOUND))
        out = self.full.copy()
        at = np.arange(self.p, self.p + len(self.of))
        out[at, at] += over[self.of]
        left = self.leave(over[self.dense], over[self.dense + 1] if self.nested > 1 else None) if self.nested else None
        return (out if left is None else out + left.matrix[0]), left

    def value(self, logs: np.ndarray) -> float:
        matrix, left = self.system(logs)
        try:
            root = np.diag(np.linalg.cholesky(matrix))
        except np.linalg.LinAlgError:
            return float("inf")
        own = 2 * np.log(root[:-1]).sum() + 2 * (self.n - self.p) * np.log(root[-1]) + self.many @ np.clip(logs, -BOUND, BOUND)
        return float(own + (left.log[0] if left else 0.0))

    def derivatives(self, logs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(value, gradient, second derivatives)."""
        matrix, left = self.system(logs)
        inverse = np.linalg.inv(matrix)
        y = inverse[:, -1]
        k, over = len(logs), np.exp(-logs)
        first, second = np.zeros((k, *matrix.shape)), {}
        log1, log2 = np.zeros(k), np.zeros((k, k))
        at = np.arange(self.p, self.p + len(self.of))
        for f in range(self.dense):
            own = at[self.of == f]
            first[f, own, own] = 1.0
        for i, f in enumerate(range(self.dense, k)):
            first[f], log1[f] = left.matrix[1 + i], left.log[1 + i]
            for j, g in enumerate(range(self.dense, f + 1)):
                second[f, g] = second[g, f] = left.matrix[3 + i + j]
                log2[f, g] = log2[g, f] = left.log[3 + i + j]
        weight = (self.n - self.p - 1) / inverse[-1, -1]
        solved = [inverse @ m for m in first]
        slope = np.array([np.trace(s) + weight * (y @ m @ y) for s, m in zip(solved, first)]) + log1
        curve = log2.copy()
        quad = [y @ m @ y for m in first]
        for f in range(k):
            for g in range(k):
                both = y @ first[f] @ inverse @ first[g] @ y
                two = second.get((f, g))
                curve[f, g] += (0.0 if two is None else np.trace(inverse @ two) + weight * (y @ two @ y)) - np.trace(solved[f] @ solved[g]) - 2 * weight * both + weight * quad[f] * quad[g] / inverse[-1, -1]
        gradient = self.many - over * slope
        return self.value_of(matrix, logs, left), gradient, np.outer(over, over) * curve + np.diag(over * slope)

    def value_of(self, matrix: np.ndarray, logs: np.ndarray, left: Eliminated | None) -> float:
        sign, log = np.linalg.slogdet(matrix[:-1, :-1])
        rest = matrix[-1, -1] - matrix[-1, :-1] @ np.linalg.solve(matrix[:-1, :-1], matrix[:-1, -1])
        return float(log + (self.n - self.p) * np.log(rest) + self.many @ logs + (left.log[0] if left else 0.0)) if sign > 0 and rest > 0 else float("inf")


def least(f: Callable[[np.ndarray], float], start: np.ndarray, most: int, tolerance: float) -> tuple[np.ndarray, int, bool]:
    """(place, evaluations, whether it converged) of a least value by a simplex that is reflected, stretched and shrunk."""
    k = len(start)
    points = [start, *(start + 1.5 * np.eye(k)[i] for i in range(k))]
    values = [f(x) for x in points]
    count = k + 1
    while count < most:
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tolerance and max(np.abs(x - points[0]).max() for x in points) < 1e-3 or values[-1] - values[0] < 1e-11 * max(1.0, abs(values[0])):
            return points[0], count, True
        centre = np.mean(points[:-1], axis=0)
        moved = centre + (centre - points[-1])
        value = f(moved)
        count += 1
        if value < values[0]:
            far = centre + 2 * (centre - points[-1])
            further = f(far)
            count += 1
            moved, value = (far, further) if further < value else (moved, value)
        elif value >= values[-2]:
            inside = centre + 0.5 * ((moved if value < values[-1] else points[-1]) - centre)
            inner = f(inside)
            count += 1
            if inner >= min(value, values[-1]):
                points = [points[0], *(points[0] + 0.5 * (x - points[0]) for x in points[1:])]
                values = [values[0], *(f(x) for x in points[1:])]
                count += k
                continue
            moved, value = inside, inner
        points[-1], values[-1] = moved, value
    best = int(np.argmin(values))
    return points[best], count, False


def stationary(f: Deviance, start: np.ndarray, fixed: np.ndarray, most: int = 60, tolerance: float = 1e-7) -> tuple[np.ndarray, int, float, np.ndarray]:
    """(place, evaluations, largest free slope, slopes) near a start, by damped Newton steps inside the bounds; what is fixed
    stays. Directions in which the deviance curves down take the slope's way; a step that doesn't lead down is halved."""
    x = np.clip(start, -BOUND, BOUND)
    value, slope, curve = f.derivatives(x)
    count = 1

    def held(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return fixed | (x <= -BOUND) & (slope > 0) | (x >= BOUND) & (slope < 0)

    while True:
        free = ~held(x, slope)
        worst = float(np.abs(slope[free]).max(initial=0.0))
        if worst < tolerance or count >= most:
            return x, count, worst, slope
        bend, axes = np.linalg.eigh(curve[np.ix_(free, free)])
        along = axes.T @ slope[free]
        step = np.zeros_like(x)
        step[free] = -axes @ (along / np.maximum(np.abs(bend), 1e-8))
        step *= min(1.0, 3.0 / max(np.abs(step).max(), 1e-300))
        better = None
        for _ in range(30):
            to = np.clip(x + step, -BOUND, BOUND)
            found = f.derivatives(to)
            count += 1
            if found[0] <= value + 1e-10 * abs(value):
                better = found
                break
            step = step / 2
        if better is None:
            return x, count, worst, slope
        x, (value, slope, curve) = to, better


def _independent(products: np.ndarray) -> list[int]:
    """The columns that don't depend on those before them, by their cross-products."""
    keep: list[int] = []
    for i in range(len(products)):
        own = products[np.ix_(keep, keep)]
        rest = products[i, i] - products[i, keep] @ np.linalg.solve(own, products[keep, i]) if keep else products[i, i]
        if rest > 1e-8 * max(products[i, i], 1e-300):
            keep.append(i)
    return keep


def _few(df: DataFrame, column: str) -> list[str]:
    """A column's values in order; many are an error."""
    found = [r[0] for r in df.select(column).distinct().orderBy(column).limit(MOST_LEVELS + 1).collect()]
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{column}: more than {MOST_LEVELS} levels outside the nested factors")
    return found


def mixed_model(df: DataFrame, y: str, fixed: list[str], random: list[str], nested: str | tuple[str, ...] = (), iterations: int = 3000, tolerance: float = 1e-8) -> Fit:
    """REML of y ~ 1 + fixed with a random intercept for each factor in random and in nested: one factor, or an outer one and
    one whose levels lie each within one level of the outer, of any number of levels.

    Terms that don't vary go. A text term stands for a column for each of its levels but the first in their order, which is
    the one they are compared with. Columns that depend on those before them go. Rows with a null in what is used are left
    out. The levels of `random` and of a text term are at most MOST_LEVELS, as they are in the dense system.

    Rows with a column `piece` are taken as pieces.gathered() gives them for the outer nested factor, filtered or not; others are
    written so first.

    A factor of `random` whose levels the fixed terms tell apart (fewer levels than such terms) keeps effects of 0 and is named
    in `dropped`, since no variance of it could be found. A simplex search gives a start, over the blocks of START_BLOCKS outer levels at most (those of the least hashes); Newton
    steps with exact derivatives of the deviance over all blocks, inside bounds, then lead to where its slopes vanish. With
    more outer levels than that each of these steps is a Spark job, else all of it runs on the driver."""
    nested = (nested,) if isinstance(nested, str) else tuple(nested)
    fixed, dropped = pruned(df, fixed)
    text = {t for t, kind in df.dtypes if kind == "string"}
    own = df.dropna(subset=[y, *fixed, *random, *nested])
    design: list[tuple[str, Column]] = [("(Intercept)", F.lit(1.0))]
    for t in fixed:
        if t in text:
            design += [(f"{t}{v}", (F.col(t) == v).cast("double")) for v in _few(own, t)[1:]]
        else:
            design.append((t, F.col(t).cast("double")))
    own = _design(own, [c for _, c in design], y, random, nested)

    # cross-products of all columns, and which of the fixed terms are independent
    levels = [(f, v) for k, f in enumerate(random) for v in _few(own, f"f{k}")]
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels outside the nested factors")
    layout = Layout([f"x{i}" for i in range(len(design))], [(f"f{k}", [v for g, v in levels if g == f]) for k, f in enumerate(random)])
    flat = own.select(*layout.fixed, *(f for f, _ in layout.factors), "y").mapInArrow(_gram(layout), "at long, v double")
    full, p = _summed(flat, layout.d**2).reshape(layout.d, layout.d), len(design)
    n = round(full[0, 0])
    keep = _independent(full[:p, :p])
    dropped |= {design[i][0]: "depends on the terms before it" for i in range(1, p) if i not in keep}
    full = full[np.ix_([*keep, *range(p, layout.d)], [*keep, *range(p, layout.d)])]
    design, layout, p = [design[i] for i in keep], Layout([f"x{i}" for i in keep], layout.factors), len(keep)
    names = formula(y, [t for t in fixed if t not in dropped and (t not in text or any(c.startswith(t) for c, _ in design))], [*random, *nested])
    if n <= p:
        return Fit(names, n, [], [], {}, 0.0, 0, False, dropped)
    d = layout.d  # the last one is y

    of = np.array([random.index(f) for f, _ in levels], int)
    many = np.bincount(of, minlength=len(random)).astype(float)
    blocks, local, everywhere = None, None, None
    if nested:
        blocks, products_of = _nested(own, layout, len(nested))
        outer, inner = blocks.count(), (sum(m for m, _ in products_of.values()),) * (len(nested) > 1)
        many = np.concatenate([many, [outer], inner])
        some = blocks.orderBy(F.xxhash64("nest0")).limit(START_BLOCKS).select("size", "times", "sums").collect()
        start_blocks = _parsed(zip(*some), d)
        share = outer / len(some)

        def local(a: float, b: float | None) -> Eliminated:
            one = of_outer(start_blocks, a, b)
            one = Eliminated(one.matrix * share, one.log * share)  # stands for all
            return one if b is None else one + of_inner(products_of, b, d)

        def everywhere(a: float, b: float | None) -> Eliminated:
            if share == 1:
                return local(a, b)
            flat = _summed(blocks.select("size", "times", "sums").mapInArrow(_leave(a, b, d), "at long, v double"), 6 * d * d + 6)
            one = Eliminated(flat[:-6].reshape(6, d, d), flat[-6:])
            return one if b is None else one + of_inner(products_of, b, d)

    # a factor whose levels the fixed terms tell apart has no variance that could be found; its effects are held at 0
    fixed_at = np.zeros(len(many), bool)
    for k, f in enumerate(random):
        own_columns = [*range(p), *(p + np.flatnonzero(of == k))]
        if max(_independent(full[np.ix_(own_columns, own_columns)])) < p:
            fixed_at[k] = True
            dropped[f] = "explained by the fixed terms"
    start, some = np.where(fixed_at, -BOUND, -1.0), Deviance(full, n, p, many, of, len(nested), local)

    def among_free(x: np.ndarray) -> float:
        logs = start.copy()
        logs[~fixed_at] = x
        return some.value(logs)

    free, steps, done = least(among_free, start[~fixed_at], iterations, tolerance) if not fixed_at.all() else (start[:0], 0, True)
    start[~fixed_at] = free
    over_all = Deviance(full, n, p, many, of, len(nested), everywhere)
    logs, more, gradient, slopes = stationary(over_all, start, fixed_at)
    a, _ = over_all.system(logs)
    inverse = np.linalg.inv(a[:-1, :-1])
    solution = inverse @ a[:-1, -1]
    noise = float((a[-1, -1] - solution @ a[:-1, -1]) / (n - p))
    se = np.sqrt(np.maximum(np.diag(inverse) * noise, 0))
    factors = [*random, *nested]
    return Fit(
        names, n,
        [(t, float(e), float(s)) for (t, _), e, s in zip(design, solution[:p], se[:p])],
        [(f, level, float(e), float(s)) for (f, level), e, s in zip(levels, solution[p:], se[p:])],
        {f: float(np.exp(v) * noise) for f, v in zip(factors, logs)}, noise, steps + more, gradient < 1e-6, dropped,
        gradient, over_all.value(logs), dict(zip(factors, slopes.tolist())), own, layout, blocks, design, nested,
    )


def _design(df: DataFrame, fixed: list[Column], y: str, random: list[str], nested: tuple[str, ...], *others: Column) -> DataFrame:
    """A model's rows (x0, ..., y, f0, ..., nest0, nest1 and others), in pieces of the outer nested factor: as they are if df has
    `piece`, as pieces.gathered() gives it, else written."""
    cut = "piece" in df.columns and len(nested) > 0
    names = {f"f{i}": f for i, f in enumerate(random)} | {f"nest{i}": f for i, f in enumerate(nested)}
    own = df.select(*(c.alias(f"x{i}") for i, c in enumerate(fixed)), F.col(y).cast("double").alias("y"), *(F.col(f).cast("string").alias(n) for n, f in names.items()), *others, *(["piece"] if cut else []))
    if cut:
        return own
    if not nested:
        return kept(own, "design")
    return pieces.gathered(pieces.marked(own, "nest0", "nest1" if len(nested) > 1 else None).repartition("nest0", "piece"), "nest0", "design")


def _nested(own: DataFrame, layout: Layout, depth: int) -> tuple[DataFrame, dict[int, tuple[int, np.ndarray]]]:
    """(blocks, products): blocks (nest0, size, times, sums) holds an outer level's sums by the size of its inner levels;
    products, by size, inner levels' number and outer products. All come from one pass over the rows; only what pieces of a cut
    level leave is shuffled."""
    keys = [f"nest{i}" for i in range(depth)]
    rows = own.select("piece", *keys, *layout.fixed, *(f for f, _ in layout.factors), "y")
    cells = kept(rows.mapInArrow(_cells(layout, depth), "nest0 string, piece int, size binary, times binary, sums binary"), "cells")
    blocks = cells.filter("piece < 0").select("nest0", "size", "times", "sums")
    if not (cut := cells.filter("piece >= 0")).isEmpty():
        cut = cut.groupBy("nest0").agg(F.collect_list(F.struct("size", "times", "sums")).alias("cells"))
        cut = kept(cut.mapInArrow(_merged(layout.d), "nest0 string, size binary, times binary, sums binary"), "cut")  # few
        blocks = blocks.union(cut)
    products: dict[int, tuple[int, np.ndarray]] = {}
    if depth > 1:
        flat: dict[int, np.ndarray] = {}
        got = cells.filter("nest0 is null").select("size", "times", "sums").mapInArrow(_products(layout.d), "size long, at long, v double")
        for r in got.groupBy("size", "at").agg(F.sum("v").alias("v")).collect():
            flat.setdefault(r["size"], np.zeros(layout.d**2 + 1))[r["at"]] = r.v
        products = {c: (round(x[-1]), x[:-1].reshape(layout.d, layout.d)) for c, x in flat.items()}
    return blocks, products


# --- what a fit says of its rows -----------------------------------------------------------------------------------------


@dataclass
class Solution:
    """What tasks need of a fit: the dense solution, the nested factors' ratios, the effects of outer levels in several pieces."""

    layout: Layout
    dense: np.ndarray
    over: list[float]
    cut: dict[str, float]

    def of_visits(self, v: Visits, outer: list[str], cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(effects of pieces' outer levels, effects of inner levels)."""
        left = v.sums @ np.append(-self.dense, 1.0)
        f = np.ones(len(left)) if len(self.over) == 1 else self.over[1] / (v.size + self.over[1])
        o = np.bincount(v.of, left * f, len(outer)) / (np.bincount(v.of, v.size * f, len(outer)) + self.over[0])
        for k in np.flatnonzero(cut):
            o[k] = self.cut[outer[k]]
        return o, np.zeros(len(left)) if len(self.over) == 1 else (left - v.size * o[v.of]) / (v.size + self.over[1])


def _outer_effects(layout: Layout, dense: np.ndarray, over: list[float]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(nest0, effect) of blocks (nest0, size, times, sums)."""

    def effects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _parsed((c.to_pylist() for c in batch.columns[1:]), layout.d)
                f = np.ones(len(own.size)) if len(over) == 1 else over[1] / (own.size + over[1])
                left, many = (np.add.reduceat(x * f, own.begin) for x in (own.sums @ np.append(-dense, 1.0), own.size * own.times))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left / (many + over[0]))], names=["nest0", "effect"])

    return effects


def solution(fit: Fit, rows: DataFrame) -> tuple[Solution, DataFrame]:
    """(what tasks need for these rows, (nest0, effect) of the outer levels)."""
    dense = np.array([e for _, e, _ in fit.terms] + [e for _, _, e, _ in fit.levels])
    over = [fit.noise / fit.variances[f] for f in fit.nested]
    effects = fit.blocks.select("nest0", "size", "times", "sums").mapInArrow(_outer_effects(fit.layout, dense, over), "nest0 string, effect double")
    cut = rows.filter("piece >= 0").select("nest0").distinct()  # one for each pieces.PIECE_ROWS rows at most
    cut = {} if cut.isEmpty() else {r.nest0: r.effect for r in effects.join(F.broadcast(cut), "nest0").collect()}
    return Solution(fit.layout, dense, over, cut), effects


def _inner_effects(own: Solution) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def effects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in pieces.whole(batches, "nest0"):
            v = _visits(rows, starts, own.layout, 2)
            outer = rows.column("nest0").take(pa.array(starts)).to_pylist()
            _, u = own.of_visits(v, outer, rows.column("piece").to_numpy()[starts] >= 0)
            names = rows.select(["nest0", "nest1"]).take(pa.array(v.order[v.begin]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c.to_pylist(), pa.string()) for c in names.columns), pa.array(u)], names=["nest0", "nest1", "effect"])

    return effects


def nested_effects(fit: Fit) -> tuple[DataFrame, DataFrame | None]:
    """((outer, effect), (outer, inner, effect)) of the nested factors' levels: what the dense solution leaves of their sums,
    shrunk by their ratios."""
    own, outer = solution(fit, fit.rows)
    outer = outer.withColumnRenamed("nest0", fit.nested[0])
    if len(fit.nested) == 1:
        return outer, None
    inner = fit.rows.mapInArrow(_inner_effects(own), "nest0 string, nest1 string, effect double")
    return outer, inner.withColumnsRenamed({"nest0": fit.nested[0], "nest1": fit.nested[1]})


def _sides(own: Solution, factors: list[str], numbers: list[str], texts: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in pieces, (factor, equation, side, done): a row for each inner level and each outer one, and last the task's sums
    for the fixed terms (n0, ..., then texts t0, ...) and the dense factors. What is not done is a part to be added up."""
    layout = own.layout

    def sides(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], float] = {}

        def add(factor: str, equation: str, side: float) -> None:
            sums[factor, equation] = sums.get((factor, equation), 0.0) + side

        out = lambda factor, equation, side, done: pa.RecordBatch.from_arrays([pa.array([factor] * len(side)), pa.array(equation, pa.string()), pa.array(side), pa.array(done)], names=["factor", "equation", "side", "done"])
        for rows, starts in pieces.whole(batches, "nest0"):
            v = _visits(rows, starts, layout, 2)
            outer, cut = rows.column("nest0").take(pa.array(starts)).to_pylist(), rows.column("piece").to_numpy()[starts] >= 0
            o, u = own.of_visits(v, outer, cut)
            fitted = v.x[:, :-1] @ own.dense + np.repeat(o[v.of] + u, v.size)
            of_visit = np.add.reduceat(fitted, v.begin)
            yield out(factors[-1], rows.column("nest1").take(pa.array(v.order[v.begin])).to_pylist(), of_visit + own.over[1] * u, np.ones(len(u), bool))
            yield out(factors[-2], outer, np.bincount(v.of, of_visit, len(outer)) + np.where(cut, 0.0, own.over[0] * o), ~cut)
            add("fixed", "(Intercept)", fitted.sum())
            for i, t in enumerate(numbers):
                add("fixed", t, rows.column(f"n{i}").to_numpy()[v.order] @ fitted)
            for c, factor, prefix in [*((f"t{i}", "fixed", t) for i, t in enumerate(texts)), *((f"f{k}", f, "") for k, f in enumerate(factors[:-2]))]:
                at = pieces.codes(rows.column(c))
                first = np.unique(at, return_index=True)[1]
                for level, side in zip(rows.column(c).take(pa.array(first)).to_pylist(), np.bincount(at[v.order], fitted)):
                    add(factor, prefix + level, side)
        if sums:
            yield pa.concat_batches([out(f, [e], np.array([s]), [False]) for (f, e), s in sums.items()])

    return sides


def equations(df: DataFrame, fit: Fit, y: str, fixed: list[str]) -> DataFrame:
    """(factor, equation, side): the left-hand sides of the mixed-model equations at a fit's estimates, from the rows that it
    was made of. At a solution they are the right-hand sides: sums of y times a fixed term's column (a text term's level), and
    sums of y over a random factor's level; those of terms that depend on others hold too. Factor `slope` has the deviance's
    derivative by the logarithm of each variance ratio, 0 at the best ratios.

    One pass over the rows in pieces; only sums of tasks are shuffled."""
    dense, text = [f for f in fit.variances if f not in fit.nested], [t for t in fixed if df.schema[t].dataType.simpleString() == "string"]
    numbers = [t for t in fixed if t not in text]
    others = [*(F.col(t).cast("double").alias(f"n{i}") for i, t in enumerate(numbers)), *(F.col(t).alias(f"t{i}") for i, t in enumerate(text))]
    rows = _design(df.dropna(subset=[y, *fixed, *fit.variances]), [c for _, c in fit.columns], y, dense, fit.nested, *others)
    own, _ = solution(fit, rows)
    factors = [*dense, *fit.nested]
    at = Solution(Layout([f"x{i}" for i in range(len(fit.columns))], own.layout.factors), own.dense, own.over, own.cut)
    schema = "factor string, equation string, side double"
    out = kept(rows.mapInArrow(_sides(at, factors, numbers, text), schema + ", done boolean"), "sides")
    # penalties: of the dense factors' levels, and of outer levels in several pieces
    more = [(f, level, fit.noise / fit.variances[f] * e) for f, level, e, _ in fit.levels] + [(fit.nested[0], level, own.over[0] * e) for level, e in own.cut.items()]
    spark = df.sparkSession
    parts = out.filter("not done").select("factor", "equation", "side").union(spark.createDataFrame(more, schema)).groupBy("factor", "equation").agg(F.sum("side").alias("side"))
    slopes = spark.createDataFrame([("slope", f, s) for f, s in fit.slopes.items()], schema)
    return out.filter("done").select("factor", "equation", "side").union(parts).union(slopes)
