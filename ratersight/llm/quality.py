"""Quality of texts by a generalised additive model with pairwise interactions: lookup tables that are added up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratersight.llm import scratch
from ratersight.llm.fingerprints import _ANCHOR_HASHES
from ratersight.llm.hashing import U8, U64, chunks, mix, words

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "bars", "stops", "commas", "line_bytes", "blank", "wide", "common", "distinct", "repeated_lines", "repeated_triples", "odd_words")


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows, at most, that the model is learned from (those with the smallest hashes of doc_id). bins:
    for each feature. rounds, rate: of boosting. pairs: interactions. threshold: scores from which a text is kept."""

    sample: int = 20_000
    bins: int = 32
    rounds: int = 150
    rate: float = 0.15
    pairs: int = 8
    threshold: float = 0.7


def _classes() -> np.ndarray:
    """For each byte, the bits of the classes that it is in."""
    out = np.zeros(256, U8)
    for i, members in enumerate((range(65, 91), range(48, 58), map(ord, "#$%&*@^~<>=+\\_{}[]/`"), map(ord, "!?"), map(ord, "|"), map(ord, ".;:"), map(ord, ","), range(128, 256))):
        out[list(members)] |= 1 << i
    return out


_CLASS = _classes()
_HAS = [(np.arange(256) >> i & 1).astype(np.int64) for i in range(8)]


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each whole text; null texts are empty, and empty ones have zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, run in chunks((t or "").encode() for t in texts):
        h, owner, starts, ends, joined = words([t.lower() for t in run])
        kinds = _CLASS[np.frombuffer(b" ".join(run) + b" ", U8)]
        odd = np.zeros(len(kinds) + 1, np.int64)
        np.cumsum((kinds & 0b00011100) > 0, out=odd[1:])
        odd_word = odd[ends] > odd[starts]
        common = np.isin(h, _ANCHOR_HASHES)
        triple = mix(mix(h[:-2] * U64(3) + h[1:-1]) * U64(5) + h[2:]) if len(h) > 2 else h[:0]
        cut = np.searchsorted(owner, np.arange(len(run) + 1))
        at = 0
        for i, text in enumerate(run):
            n = len(text)
            if n:
                part = np.bincount(kinds[at : at + n], minlength=256)
                upper, digit, symbol, bang, bar, stop, comma, wide = (int(part @ has) for has in _HAS)
                lo, hi = cut[i], cut[i + 1]
                k = max(hi - lo, 1)
                lines = text.split(b"\n")
                trips = triple[lo : max(lo, hi - 2)]
                out[first + i] = (
                    np.log1p(n), np.log1p(hi - lo), (ends[lo:hi] - starts[lo:hi]).sum() / k, upper / n, digit / n, symbol / n, bang / n, bar / n, stop / k, comma / k,
                    np.log1p(n / len(lines)), text.count(b" ") / n, wide / n, common[lo:hi].sum() / k, len(np.unique(h[lo:hi])) / k**0.8, 1 - len(set(lines)) / len(lines),
                    1 - len(np.unique(trips)) / max(len(trips), 1), odd_word[lo:hi].sum() / k,
                )
            at += n + 1
    return out


@dataclass
class Model:
    """edges: of each feature's bins. tables: an added score for each bin of a feature. pairs: for two features, by bins."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row of features."""
        b = self.bin(x)
        z = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            z += table[b[:, f]]
        for f, g, table in self.pairs:
            z += table[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A shallow tree over ordered bins: its Newton step for each bin, from sums of gradients and curvatures."""
    calm = 1.0
    best, at = 1e-9, 0
    if depth:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = gl**2 / (hl + calm) + (g.sum() - gl) ** 2 / (h.sum() - hl + calm) - g.sum() ** 2 / (h.sum() + calm)
        if len(gain) and gain.max() > best:
            at = int(gain.argmax()) + 1
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + calm))
    return np.concatenate((_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross of one cut of each feature, by bins of two: its gain, and the Newton step for each pair of bins."""
    calm = 2.0
    G, H = (np.cumsum(np.cumsum(x, 0), 1) for x in (g, h))
    q = []
    for X in (G, H):
        a = X[:-1, :-1]
        q.append((a, X[:-1, -1:] - a, X[-1:, :-1] - a, X[-1, -1] - X[:-1, -1:] - X[-1:, :-1] + a))
    gain = sum(x**2 / (y + calm) for x, y in zip(*q))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.empty(g.shape)
    values = [x[i, j] / (y[i, j] + calm) for x, y in zip(*q)]
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return float(gain.max() - G[-1, -1] ** 2 / (H[-1, -1] + calm)), step


def learn(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    """Cyclic boosting: in every round each feature's table takes one small tree's step, then each chosen pair's table.

    Without rows the score is 1/2; with rows of one label it is near that label everywhere."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(prior / (1 - prior))))
    if not 0 < y.sum() < len(y):
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, s.bins + 1)[1:-1])) for f in range(x.shape[1])]
    b = model.bin(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    z = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(s.rounds):
        for f, n in enumerate(sizes):
            g, h = slopes()
            step = s.rate * _tree(np.bincount(b[:, f], g, n), np.bincount(b[:, f], h, n), 2)
            model.tables[f] += step
            z += step[b[:, f]]

    def crossed(f: int, g: int) -> tuple[float, np.ndarray]:
        a, c = slopes()
        at = b[:, f] * sizes[g] + b[:, g]
        return _quadrants(*(np.bincount(at, v, sizes[f] * sizes[g]).reshape(sizes[f], sizes[g]) for v in (a, c)))

    both = [(crossed(f, g)[0], f, g) for f in range(len(sizes)) for g in range(f) if min(sizes[f], sizes[g]) > 1]
    model.pairs = [(f, g, np.zeros((sizes[f], sizes[g]))) for _, f, g in sorted(both, reverse=True)[: s.pairs]]
    for _ in range(s.rounds // 5):
        for f, g, table in model.pairs:
            step = s.rate * crossed(f, g)[1]
            table += step
            z += step[b[:, f], b[:, g]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: those whose crc32 of the id's digits is 2 modulo 4. Null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of labels.quality (doc_id, quality), learned from a bounded sample outside the held-out rows.

    Labels that are null or of unknown documents are left out. Few rows go to the driver: `sample` rows of features."""
    scratch.short_batches(docs.sparkSession)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y is not null")
    own = own.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(settings.sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id")
    got = rows.select("text", "y").mapInArrow(_features, "x array<double>, y int").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, got["y"].to_numpy()])  # the model doesn't depend on the order of partitions
    return learn(x[order], got["y"].to_numpy(float)[order], settings)


def _score(model: Model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(model.score(features(batch.column(2).to_pylist())))], names=["doc_id", "held_out", "score"])

    return score


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); predicted is 1 from the threshold on.

    Only the text enters a score: equal texts have equal scores. Null and empty texts are scored as texts of zeros.
    An empty table gives an empty result. Other columns are ignored."""
    model = fit(docs, labels, settings)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs, with all its columns, without the rows whose score is below the threshold. No text is shuffled."""
    model = fit(docs, labels, settings)

    def good(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(model.score(x) >= settings.threshold))

    return docs.mapInArrow(good, docs.schema)
