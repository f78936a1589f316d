"""Language of texts by a linear-chain conditional random field over words, fit for texts that switch languages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratersight.llm import scratch
from ratersight.llm.hashing import Rolling, chunks
from ratersight.llm.quality import held_out


@dataclass(frozen=True)
class Settings:
    """each: documents of a language, at most, that are learned from, whole. bits: of feature hashes. epochs: of learning.
    A sequence is a line, however long."""

    each: int = 100
    bits: int = 18
    epochs: int = 6
    rate: float = 0.3
    switched: float = 0.3


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x32400)], bool)


_LETTER: list[np.ndarray] = []


@dataclass
class Words:
    """Words of several texts: each one's text, sequence and features (as slots of the weights, with the owning word)."""

    text: np.ndarray
    sequence: np.ndarray
    slots: list[tuple[np.ndarray, np.ndarray]]


def analyse(texts: list[str], s: Settings) -> Words:
    """Words are runs of letters, in lower case. Features: n-grams of 1 to 3 letters with the word's edges (which also are
    affixes of 1 and 2), prefix and suffix of 3, and the whole word (the lexicon)."""
    if not _LETTER:
        _LETTER.append(_letters())
    symbols = np.frombuffer("\n".join([*texts, ""]).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTER[0][np.minimum(symbols, 0x323FF)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    # the texts' ends: line feeds inside texts are there too, so places are counted by the texts' own lengths
    sizes = np.array([len(t.lower()) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    text = np.searchsorted(begins, starts, "right") - 1
    line = np.concatenate(([0], np.cumsum(symbols == 10)))[starts]
    new = np.ones(len(starts), bool)
    np.not_equal(line[1:], line[:-1], out=new[1:])
    sequence = np.cumsum(new) - 1
    c = np.zeros(len(symbols) + 3, np.uint32)
    c[1 : len(symbols) + 1] = np.where(letter, symbols, 0)  # c[i + 1] is symbol i, edges are 0
    shift = np.uint32(32 - s.bits)
    owner = np.zeros(len(symbols) + 3, np.int64)
    owner[starts[1:] + 1] = 1
    owner = np.cumsum(owner)

    def hashed(*parts: np.ndarray) -> np.ndarray:
        h = np.full(len(parts[0]), np.uint32(len(parts) * 0x85EBCA6B & 0xFFFFFFFF))
        for p in parts:
            h = (h ^ p) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return (h * np.uint32(0x85EBCA6B)) >> shift

    slots = []
    if len(starts):
        inside = np.flatnonzero(c)
        slots.append((hashed(c[inside]), owner[inside]))
        slots.append((hashed(c[inside], c[inside + 1]), owner[inside]))
        slots.append((hashed(c[inside - 1], c[inside], c[inside + 1]), owner[inside]))
        long = np.flatnonzero(ends - starts >= 3)
        a, b = starts[long] + 1, ends[long]
        slots.append((hashed(c[a - 1], c[a], c[a + 1], c[a + 2]), long))
        slots.append((hashed(c[b - 2], c[b - 1], c[b], c[b + 1], c[a - 1]), long))
        whole = Rolling(symbols).of(starts, ends)
        slots.append(((whole >> np.uint64(64 - s.bits)).astype(np.uint32), np.arange(len(starts))))
    return Words(text, sequence, slots)


@dataclass
class Model:
    """languages; weights: a row for each language; moves: transition weights from language to language."""

    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        n = len(w.text)
        out = np.zeros((n, len(self.languages)))
        for slot, owner in w.slots:
            for k, own in enumerate(self.weights):
                out[:, k] += np.bincount(owner, own[slot], n)
        return out

    def posteriors(self, w: Words, pairs: np.ndarray | None = None) -> np.ndarray:
        """The probability of each language for each word, by forward-backward over all sequences at a time.

        pairs: gets the expected numbers of moves added."""
        e = self.emissions(w)
        n, k = e.shape
        if not n:
            return e
        e = np.exp(e - e.max(axis=1, keepdims=True))
        first = np.flatnonzero(np.concatenate(([True], w.sequence[1:] != w.sequence[:-1])))
        size = np.diff(np.concatenate((first, [n])))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        steps = int(size[0])
        live = [int(np.searchsorted(-size, -t, "left")) for t in range(steps)]  # sequences with a word t
        move = np.exp(self.moves)
        ahead, back = np.empty((n, k)), np.ones((n, k))
        a = e[first] / e[first].sum(axis=1, keepdims=True)
        ahead[first] = a
        for t in range(1, steps):
            at = first[: live[t]] + t
            a = a[: live[t]] @ move * e[at]
            a /= a.sum(axis=1, keepdims=True)
            ahead[at] = a
        for t in range(steps - 1, 0, -1):
            at = first[: live[t]] + t
            b = back[at] * e[at]
            if pairs is not None:
                joint = ahead[at - 1][:, :, None] * move * b[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = b @ move.T
            back[at - 1] = b / b.sum(axis=1, keepdims=True)
        both = ahead * back
        return both / both.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None], s: Settings) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each whole text and its share of the words' probabilities; `und` without a letter."""
        names, shares = ["und"] * len(texts), np.zeros(len(texts))
        for first, run in chunks((t or "").encode() for t in texts):
            own = [texts[first + i] or "" for i in range(len(run))]
            w = analyse(own, s)
            if not len(w.text) or not self.languages:
                continue
            p = self.posteriors(w)
            total = np.stack([np.bincount(w.text, p[:, k], len(own)) for k in range(p.shape[1])], 1)
            n = total.sum(axis=1)
            for i in np.flatnonzero(n > 0):
                k = int(total[i].argmax())
                names[first + i], shares[first + i] = self.languages[k], min(1.0, total[i, k] / n[i])
        return names, shares


def learn(texts: list[str], langs: list[str], s: Settings = Settings()) -> Model:
    """Weights by AdaGrad on the likelihood of the words' languages; a share of the sequences joins pieces of two
    documents, so that moves between languages are learned too. Without texts nothing can be predicted."""
    names = sorted(set(langs))
    model = Model(names, np.zeros((len(names), 1 << s.bits)), np.where(np.eye(len(names), dtype=bool), 0.0, -2.0))
    rng = np.random.default_rng(7)
    of = {x: i for i, x in enumerate(names)}
    lines = [(line, of[lang]) for text, lang in zip(texts, langs) for line in text.split("\n") if line.strip()]
    seen = np.full(model.weights.shape, 1e-3)
    moved = np.full(model.moves.shape, 1.0)
    for _ in range(s.epochs):
        order = rng.permutation(len(lines))
        for batch in np.array_split(order, max(1, len(order) // 256)):
            made, truth = [], []  # a sequence: parts of lines, each with its language
            for i in batch:
                line, lang = lines[i]
                made.append(line)
                truth.append((len(line), lang, lang))
                if rng.random() < s.switched:
                    other, second = lines[rng.integers(len(lines))]
                    a, b = line.split(" "), other.split(" ")
                    head = " ".join(a[: max(1, int(len(a) * rng.random()))])
                    made[-1] = head + " " + " ".join(b[int(len(b) * rng.random()) :])
                    truth[-1] = (len(head), lang, second)
            w = analyse(made, s)
            if not len(w.text):
                continue
            y = _labels(made, truth)
            pairs = np.zeros(model.moves.shape)
            p = model.posteriors(w, pairs)
            off = -p
            off[np.arange(len(y)), y] += 1
            for k in range(len(names)):
                grad = np.zeros(1 << s.bits)
                for slot, owner in w.slots:
                    grad += np.bincount(slot, off[owner, k], 1 << s.bits)
                seen[k] += grad**2
                model.weights[k] += s.rate * grad / np.sqrt(seen[k])
            stay = w.sequence[1:] == w.sequence[:-1]
            told = np.zeros(pairs.shape)
            np.add.at(told, (y[:-1][stay], y[1:][stay]), 1)
            moved += (told - pairs) ** 2
            model.moves += s.rate * (told - pairs) / np.sqrt(moved)
    model.weights = model.weights.astype(np.float32)
    return model


def _labels(made: list[str], truth: list[tuple[int, int, int]]) -> np.ndarray:
    """The language of each word of joined lines: the first up to a place, then the second."""
    out = []
    for text, (cut, first, second) in zip(made, truth):
        inside = False
        for i, c in enumerate(text.lower() if len(text.lower()) == len(text) else text):
            letter = c.isalpha()
            if letter and not inside:
                out.append(first if i < cut else second)
            inside = letter
    return np.array(out, int)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of docs' languages (doc_id, text, lang), from a bounded sample outside the held-out rows.

    Each language gives the documents with the smallest hashes in each of `each` parts of its ids. Null languages and
    texts are left out."""
    s = settings
    scratch.short_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = own.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    hashed = F.xxhash64("doc_id")
    ids = own.select("doc_id", "lang").groupBy("lang", F.pmod(hashed, F.lit(s.each)).alias("part")).agg(F.min(F.struct(F.xxhash64(F.lit(1), "doc_id"), "doc_id")).alias("m"))
    ids = F.broadcast(ids.select("lang", "m.doc_id"))  # languages times `each` rows
    rows = own.join(ids, ["doc_id", "lang"]).select("lang", "text").collect()
    rows = sorted((r.lang, r.text) for r in rows)
    return learn([t for _, t in rows], [x for x, _ in rows], s)


def _predict(model: Model, s: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, shares = model.predict(batch.column(2).to_pylist(), s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, pa.string()), pa.array(shares)], names=["doc_id", "held_out", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang); only the text enters a prediction.

    lang_pred is `und`, with score 0, for null texts and texts without a letter, and where nothing could be learned.
    Repeated rows are predicted alike. An empty table gives an empty result. Other columns are ignored."""
    model = fit(docs, settings)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model, settings), "doc_id long, held_out boolean, lang_pred string, score double")
