"""SpotSigs fingerprints: chains of content words that follow common words, compared through pruned Jaccard."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratersight.llm import scratch
from ratersight.llm.hashing import U8, U32, U64, Rolling, chunks, mix, words

#: Common words of English, German, French and Spanish, which start a chain and are left out of chains.
ANCHORS = (
    "the of and to in is that for with was on as are it be by this from or an at have not which but",
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "de la le et les des en un du une que est pour qui dans par sur pas plus au ne se avec ce sont",
    "que el en los se del las por con para una su al lo como más pero sus le ya o este",
)


@dataclass(frozen=True)
class Settings:
    """chain: content words after an anchor that form a signature with it. gap: a content word that has no anchor among so
    many words before it, in its text, is taken as an anchor too, so that lists and tables have signatures. step: sets are
    partitioned by length into classes, each up to so many times as long as the one before; sets of the same or of
    neighbouring classes are merged, and of others the shorter one's members are looked up in the longer one."""

    chain: int = 2
    gap: int = 8
    step: float = 10.0


#: ASCII punctuation counts as white space.
_FLAT = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def _prepare(text: str) -> bytes:
    return text.lower().encode().translate(_FLAT)


_ANCHOR_HASHES = np.array(sorted({int(Rolling(np.frombuffer(w.encode(), U8)).of(np.array([0]), np.array([len(w.encode())]))[0]) for line in ANCHORS for w in line.split()}), U64)


def signatures(texts: list[str], settings: Settings = Settings()) -> Iterator[np.ndarray]:
    """The sorted distinct 32-bit signatures of each text.

    A signature: an anchor and the next content words, in the same text. A text without any takes each of its words as an
    anchor of the words that follow it; a text of fewer words is one signature; one without words has none."""
    k = settings.chain
    for _, run in chunks(_prepare(t) for t in texts):
        h, owner, *_ = words(run)
        anchor = np.isin(h, _ANCHOR_HASHES)
        content = np.flatnonzero(~anchor)
        place = np.arange(len(h))
        first = np.ones(len(h), bool)
        np.not_equal(owner[1:], owner[:-1], out=first[1:])
        last = np.maximum.accumulate(np.where(anchor | first, place, 0)) if len(h) else place
        at = np.flatnonzero(anchor | (place - last > settings.gap))
        nth = np.searchsorted(content, at, "right")  # content words up to it
        ok = nth + k <= len(content)
        at, nth = at[ok], nth[ok]
        ok = owner[content[nth + k - 1]] == owner[at] if len(at) else np.zeros(0, bool)
        at, nth = at[ok], nth[ok]
        own = h[at]
        for i in range(k):
            own = mix(own * U64(0x9E3779B97F4A7C15) + h[content[nth + i]])
        own = (own >> U64(32)).astype(U32)
        cut = np.searchsorted(owner[at], np.arange(len(run) + 1))
        all_cut = np.searchsorted(owner, np.arange(len(run) + 1))
        for i in range(len(run)):
            mine = own[cut[i] : cut[i + 1]]
            if not len(mine):
                w = h[all_cut[i] : all_cut[i + 1]]
                n = min(len(w), k + 1)
                mine = np.full(len(w) - n + 1 if n else 0, U64(n), U64)
                for j in range(n):
                    mine = mix(mine * U64(0x9E3779B97F4A7C15) + w[j : len(w) - n + 1 + j])
                mine = (mine >> U64(32)).astype(U32)
            yield np.unique(mine)


def length_class(n: int, step: float) -> int:
    """The class of a set's length: sets whose lengths differ by a factor of step at most are in the same or next one."""
    return int(np.floor(np.log(n) / np.log(step) + 1e-9))


def likeness(x: np.ndarray, y: np.ndarray, step: float = 10.0) -> float:
    """Jaccard similarity of two sorted sets, exactly. Members outside the other set's range have no partner and are left out;
    where nothing is in both ranges it is 0 without a look at the members. Two empty sets are equal (1), an empty one and
    another are not alike (0)."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    lo, hi = max(x[0], y[0]), min(x[-1], y[-1])
    a, b = (z[np.searchsorted(z, lo) : np.searchsorted(z, hi, "right")] for z in (x, y))
    if not len(a) or not len(b):
        return 0.0
    if abs(length_class(len(a), step) - length_class(len(b), step)) > 1:
        a, b = (a, b) if len(a) < len(b) else (b, a)
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    else:
        both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _text_of(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def _compare(settings: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def done(held: list[tuple]) -> pa.RecordBatch:
        """All rows of held but the last, which only follows."""
        texts = [t for *_, t in held]
        edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:])]
        own = list(signatures(texts, settings))
        new = list(signatures(edited, settings))
        rows = [(held[i][2], len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest(), _text_of(own[i]), _text_of(new[i]), likeness(own[i], new[i], settings.step), likeness(own[i], own[i + 1], settings.step)) for i in range(len(edited)) if not held[i][1] and held[i][0] == held[i + 1][0]]
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            fixed = (batch.column(i).to_pylist() for i in range(3))
            for row in zip(*fixed, (t.as_py() for t in batch.column(3))):
                held.append(row)
                size += len(row[3])
                if size > 1 << 20 and len(held) > 1:
                    yield done(held)
                    held, size = held[-1:], len(held[-1][3])
        if held:
            yield done(held)

    return compare


def neighbours(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fingerprints of all docs (doc_id, text), of their edited texts, and both likenesses; a row for each row of docs.

    Documents are in ascending doc_id order, null ids first, rows of one doc_id by text; the last is followed by the
    first, and a single one by itself. Null texts count as empty. The order is cut into buckets at approximate quantiles
    of doc_id; a copy of the next bucket's first row ends each bucket, so every text is shuffled once. An empty table
    gives an empty result. Likenesses are exact."""
    spark = docs.sparkSession
    n = scratch.parts(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = sorted({int(b) for b in docs.approxQuantile("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 0.1 / n)})
    bucket = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    docs = docs.select(F.coalesce(F.when(F.col("doc_id").isNotNull(), bucket), F.lit(0)).alias("bucket"), F.lit(False).alias("next"), "doc_id", "text")
    heads = scratch.table(docs.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("head")), "heads")
    there = sorted(r.bucket for r in heads.select("bucket").collect())  # numbers of buckets, 4 n at most
    before = spark.createDataFrame(list(zip(there, there[-1:] + there[:-1])), "bucket int, before int")
    follow = heads.join(F.broadcast(before), "bucket").select(F.col("before").alias("bucket"), F.lit(True).alias("next"), "head.doc_id", "head.text")
    both = docs.union(follow).repartition(n, "bucket").sortWithinPartitions("bucket", "next", "doc_id", "text")
    return both.mapInArrow(_compare(settings), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _sets(settings: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [s.astype(np.int64) for s in signatures([t or "" for t in batch.column(1).to_pylist()], settings)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tolist() for s in own], pa.list_(pa.int64()))], names=["doc_id", "signatures"])

    return sets


def similar(docs: DataFrame, least: float = 0.8, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): documents of equal signatures, and alike pairs of class representatives.

    classes: doc_id, class_id (the smallest doc_id of equal signatures; documents without signatures are alone). pairs: a,
    b, likeness of representatives with a likeness of least or more. Sets are partitioned by length: one class of lengths
    holds sets that differ by a factor of least at most, so a set is compared in its class and the next one. There, sets
    meet by the rarest signatures only (as many as leave no alike pair out), with size bounds before members are looked at.
    Null ids and empty tables give no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    own = scratch.table(docs.mapInArrow(_sets(settings), "doc_id long, signatures array<long>"), "signatures")
    grouped = own.filter(F.size("signatures") > 0).groupBy("signatures").agg(F.min("doc_id").alias("class_id"))
    grouped = scratch.table(grouped, "classes")
    classes = own.join(grouped, "signatures", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    sizes = grouped.select("class_id", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    often = sizes.groupBy("s").agg(F.count("*").alias("df"))
    ranked = sizes.join(often, "s").groupBy("class_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("by"))
    prefix = F.slice("by", 1, F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1)
    step = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(least))).cast("int") if least < 1 else F.col("n")
    keyed = scratch.table(ranked.select("class_id", "n", step.alias("step"), F.explode(prefix).alias("p")).select("class_id", "n", "step", F.col("p.s").alias("s")), "prefixes")
    x = keyed.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"))
    y = keyed.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "s", "step")
    near = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = x.join(y, ["s", "step"]).filter(near & (F.col("na") >= F.col("nb") * least)).select("a", "b").distinct()
    sets = grouped.select("class_id", "signatures")
    full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y"))
    out = full.withColumn("likeness", both / (F.size("x") + F.size("y") - both)).filter(F.col("likeness") >= least)
    return classes, out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
