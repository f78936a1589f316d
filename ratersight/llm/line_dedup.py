"""Near-duplicate lines by a segment-partition edit join; all but the first line of each class are removed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratersight.llm import scratch
from ratersight.llm.hashing import U64, Rolling, chunks, mix, words
from ratersight.llm.linkage import count_links


@dataclass(frozen=True)
class Settings:
    """edits: lines at most so many edits apart are linked. Edits are of words where the longer line has min_words or more,
    so that a replaced word leaves a paragraph linked, else of code points. min_chars: pairs whose longer line is shorter
    have no edits: of such lines, equal sentences are found, see is_sentence(). Headings, list items and the like repeat
    rightly."""

    edits: int = 2
    min_chars: int = 24
    min_words: int = 20


def lines_of(text: str | None) -> list[str]:
    """The lines of a text, split at line feeds; None has none."""
    return [] if text is None else text.split("\n")


def is_sentence(line: str) -> bool:
    """Whether a stripped line ends as a sentence does; a short line that does not is a heading, item or mark."""
    return line.endswith((".", "!", "?", "\u2026", "\u3002", "\uff01", "\uff1f"))


def line_id(line: str) -> int:
    """A 64-bit identity of a stripped line; two different lines share one with a probability of 2 ** -64."""
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def windows(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of the substrings that a line has to look up for lines as long or shorter.

    Multi-match-aware: of the segments that two lines share, the i-th (from 0) has at most i edits before it and at most
    edits - i after it, so its shift lies within i of 0 and within edits - i of the length difference."""
    return [(d, i, x) for d in range(edits + 1) for i in range(edits + 1) for x in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1)]


def keys_of(lines: list[bytes], edits: int, kind: int = 0) -> np.ndarray:
    """A row of keys for each line, given as 32-bit symbols: hashes of (kind, indexed length, segment, substring). Lines
    within so many edits share one."""
    out = np.empty((len(lines), len(windows(edits))), np.int64)
    for first, run in chunks(lines):
        symbols = np.frombuffer(b"".join(run), "<u4")
        size = np.array([len(x) // 4 for x in run], np.int64)
        begin = np.cumsum(size) - size
        roll = Rolling(symbols)
        for k, (d, i, x) in enumerate(windows(edits)):
            length = np.maximum(size - d, 0)
            short, longer = length // (edits + 1), length % (edits + 1)
            # the last `longer` segments have one more
            start = i * short + np.maximum(0, i - (edits + 1 - longer)) + x
            end = start + short + (i >= edits + 1 - longer)
            ok = (start >= 0) & (end <= size) & (length > 0)
            start, end = np.where(ok, start, 0), np.where(ok, end, 0)
            h = roll.of(begin + start, begin + end)
            h = mix(h ^ mix(length.astype(U64) * U64(64) + U64(i + (kind << 40))))
            own = mix(begin.astype(U64) ^ U64((first + 1) << 32) ^ U64(k << 58 | kind << 57))  # no substring there: a key of its own
            out[first : first + len(run), k] = np.where(ok, h, own).view(np.int64)
    return out


def word_symbols(lines: list[str]) -> list[bytes]:
    """Each line's words (runs of other bytes than ASCII white space) as 32-bit hashes."""
    out: list[bytes] = []
    for _, run in chunks(x.encode() for x in lines):
        h, owner, *_ = words(run)
        h = (h >> U64(32)).astype("<u4")
        cut = np.searchsorted(owner, np.arange(len(run) + 1))
        out += [h[cut[i] : cut[i + 1]].tobytes() for i in range(len(run))]
    return out


def all_keys(lines: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(line's index, key): lines that may be linked share a key. Lines of nearly min_words words have both kinds."""
    worded = word_symbols(lines)
    n = np.array([len(x) // 4 for x in worded], np.int64)
    at, keys = [], []
    for kind, own in ((0, np.flatnonzero(n < s.min_words)), (1, np.flatnonzero(n >= s.min_words - s.edits))):
        got = keys_of([worded[i] if kind else lines[i].encode("utf-32-le") for i in own.tolist()], s.edits, kind)
        at.append(np.repeat(own, got.shape[1]))
        keys.append(got.ravel())
    return np.concatenate(at), np.concatenate(keys)


def parities(lines: list[bytes]) -> np.ndarray:
    """Rows of 64 parities of counts of symbols and 256 of pairs of them; an edit changes two and four at most."""
    out = np.zeros((len(lines), 5), U64)
    one = U64(1)
    for first, run in chunks(lines):
        size = np.array([len(x) // 4 for x in run], np.int64)
        full = np.flatnonzero(size)
        if not len(full):
            continue
        x = np.frombuffer(b"".join(run), "<u4").astype(U64)
        begin = np.cumsum(size)[full] - size[full]
        out[first + full, 0] = np.bitwise_xor.reduceat(one << (mix(x) & U64(63)), begin)
        pair = mix(x[1:] << U64(32) | x[:-1])
        bit, word = np.zeros(len(x), U64), np.zeros(len(x), U64)
        bit[:-1], word[:-1] = one << (pair & U64(63)), pair >> U64(6) & U64(3)
        bit[begin + size[full] - 1] = 0  # a line's last symbol begins no pair
        for k in range(4):
            out[first + full, k + 1] = np.bitwise_xor.reduceat(np.where(word == k, bit, U64(0)), begin)
    return out


def sketches(lines: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(order, parities of characters, then of words): lines that are compared by words come last, in the order of their
    numbers of words; the others in that of their lengths."""
    worded = word_symbols(lines)
    n = np.array([len(x) // 4 for x in worded], np.int64)
    order = np.where(n >= s.min_words, (1 << 40) + n, [len(x) for x in lines])
    by_words = n >= s.min_words - s.edits
    chars = parities([b"" if k >= s.min_words else x.encode("utf-32-le") for x, k in zip(lines, n.tolist())])
    return order, np.concatenate((chars, parities([x if k else b"" for x, k in zip(worded, by_words.tolist())])), axis=1)


class Comparer:
    """Compares lines, in the order and with the parities of sketches()."""

    def __init__(self, lines: list[str], odd: np.ndarray, s: Settings):
        self.s, self.odd, self.lines = s, odd, lines
        self.words = [x.encode().split() for x in lines]
        self.n_words = np.array([len(x) for x in self.words], np.int64)
        self.by_words = int(np.searchsorted(self.n_words >= s.min_words, True))  # the first line that is
        self.size = np.array([len(x) for x in lines[: self.by_words]], np.int64)
        self.held: dict[bool, Sequences] = {}

    def near(self, x: int) -> np.ndarray:
        """Which later lines may be linked to line x."""
        s, out = self.s, []
        if x < self.by_words:
            lo = max(x + 1, int(np.searchsorted(self.size, s.min_chars)))
            out.append((lo, int(np.searchsorted(self.size, self.size[x] + s.edits, "right")), slice(0, 5)))
        if x >= self.by_words or self.n_words[x] >= s.min_words - s.edits:
            lo = max(x + 1, self.by_words)
            out.append((lo, self.by_words + int(np.searchsorted(self.n_words[self.by_words :], self.n_words[x] + s.edits, "right")), slice(5, 10)))
        found = []
        for lo, hi, part in out:
            if lo < hi:
                bits = np.bitwise_count(self.odd[lo:hi, part] ^ self.odd[x, part])
                found.append(lo + np.flatnonzero((bits[:, 0] <= 2 * s.edits) & (bits[:, 1:].sum(axis=1, dtype=np.int64) <= 4 * s.edits)))
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def linked(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Which pairs of lines, the second ones later, are within the edits, exactly."""
        out = np.zeros(len(xs), bool)
        for by_words in (False, True):
            own = np.flatnonzero((ys >= self.by_words) == by_words)
            if len(own):
                if by_words not in self.held:
                    numbers: dict[bytes, int] = {}
                    spelt = ["".join([_SYMBOLS(numbers.setdefault(w, len(numbers))) for w in x]) for x in self.words] if by_words else self.lines
                    self.held[by_words] = Sequences(spelt)
                out[own] = self.held[by_words].linked(xs[own], ys[own], self.s.edits)
        return out


def _SYMBOLS(n: int) -> str:
    """A character for a word's number; none is a surrogate."""
    return chr(n if n < 0xD800 else n + 0x800)


class Sequences:
    """Strings whose pairs are verified by banded bit vectors: many pairs at a time, or, of strings with few, one by one."""

    #: Pairs of one string from which they are verified together; pairs, columns and table cells that are held at a time.
    TOGETHER, PAIRS, COLUMNS, CELLS = 24, 1 << 14, 64, 1 << 23

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.size = np.array([len(x) for x in lines], np.int64)
        self.symbols: np.ndarray | None = None

    def linked(self, xs: np.ndarray, ys: np.ndarray, k: int) -> np.ndarray:
        """Which pairs are within k edits."""
        out = np.zeros(len(xs), bool)
        order = np.argsort(xs, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(xs[order]) != 0)))
        held: list[np.ndarray] = []
        count = cells = 0

        def flush() -> None:
            nonlocal held, count, cells
            if held:
                out[np.concatenate(held)] = self._together(xs, ys, np.concatenate(held), k)
            held, count, cells = [], 0, 0

        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
            own = order[lo:hi]
            deep = int(self.size[ys[own]].max())
            if hi - lo >= self.TOGETHER and 2 * k + 1 < 64 and min(deep, self.size[xs[own[0]]]) > 2 * k:
                self._number()
                if deep * self.kinds <= self.CELLS:
                    if count + len(own) > self.PAIRS or cells + deep * self.kinds > self.CELLS:
                        flush()
                    held.append(own)
                    count += len(own)
                    cells += deep * self.kinds
                    continue
            out[own] = [within(self.lines[x], self.lines[y], k) for x, y in zip(xs[own].tolist(), ys[own].tolist())]
        flush()
        return out

    def _number(self) -> None:
        """The lines' symbols as small numbers, end to end."""
        if self.symbols is None:
            names, symbols = np.unique(np.frombuffer("".join(self.lines).encode("utf-32-le"), "<u4"), return_inverse=True)
            self.symbols, self.kinds, self.begin = symbols.astype(np.int32), len(names), np.cumsum(self.size) - self.size

    def _together(self, xs: np.ndarray, ys: np.ndarray, pairs: np.ndarray, k: int) -> np.ndarray:
        """within() of many pairs (by their places in xs and ys) at a time.

        Bit r of a vector stands for row column - k + r of the pair's own band. The score follows the lowest diagonal to
        the last column, where the vertical differences lead back from there to the last row."""
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, U64) if 2 * k + 1 < 8 * t().itemsize)
        one = kind(1)
        order = np.argsort(-self.size[ys[pairs]], kind="stable")
        xs, ys = xs[pairs[order]], ys[pairs[order]]
        la, lb = self.size[xs], self.size[ys]
        rows, where = np.unique(xs, return_inverse=True)
        deep = int(lb[0])
        # for each first line, column and symbol the band's rows that hold it
        table = np.zeros((len(rows), deep, self.kinds), kind)
        for i, x in enumerate(rows.tolist()):
            text = self.symbols[self.begin[x] : self.begin[x] + self.size[x]]
            for r in range(2 * k + 1):
                lo, hi = max(0, k - r), min(deep, len(text) + k - r)
                if lo < hi:
                    table[i, np.arange(lo, hi), text[lo - k + r : hi - k + r]] |= one << kind(r)
        table = table.ravel()
        begin, own = self.begin[ys], where * (deep * self.kinds)
        full, high = kind((1 << (2 * k + 1)) - 1), kind(2 * k)
        n = len(xs)
        plus, minus, hits = np.full(n, full >> kind(k) << kind(k), kind), np.zeros(n, kind), np.zeros(n, np.int32)
        live = np.searchsorted(-lb, -np.arange(deep), "left")  # pairs with a column j
        d, right, left = np.empty(n, kind), np.empty(n, kind), np.empty(n, kind)
        for j in range(deep):
            m = live[j]
            if j % self.COLUMNS == 0:
                column = np.arange(j, min(deep, j + self.COLUMNS))[:, None]
                at = np.take(self.symbols, begin[:m] + column, mode="clip") + (own[:m] + column * self.kinds)
                eqs = np.take(table, at, mode="clip")
            eq, p, q, t, h, u, c = eqs[j % self.COLUMNS, :m], plus[:m], minus[:m], d[:m], right[:m], left[:m], hits[:m]
            np.bitwise_and(eq, p, out=t)
            t += p
            t ^= p
            t |= eq
            t |= q
            t &= full
            np.bitwise_or(t, p, out=h)
            np.invert(h, out=h)
            h |= q
            np.bitwise_and(t, p, out=u)
            np.right_shift(t, high, out=p)
            c += p
            t >>= one
            np.bitwise_and(t, h, out=q)
            t |= h
            np.invert(t, out=t)
            np.bitwise_or(t, u, out=p)
        below = (full >> one) & ~((one << (la - lb + k).astype(kind)) - one)  # the rows under the last one
        score = k + lb - hits.astype(np.int64) - np.bitwise_count(plus & below) + np.bitwise_count(minus & below)
        out = np.empty(n, bool)
        out[order] = score <= k
        return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most so many: vertical differences as bit vectors, on 2 * edits + 1 diagonals.

    Equal ends are cut off first. Bit r of a vector stands for row column - edits + r, so the band sinks by a row with
    each column; the score follows its lowest diagonal to the last row, then that row."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    lo, hi = 0, len(b)
    while lo + 64 <= hi and a[lo : lo + 64] == b[lo : lo + 64]:
        lo += 64
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    shift = len(a) - len(b)
    while hi - 64 >= lo and a[hi - 64 + shift : hi + shift] == b[hi - 64 : hi]:
        hi -= 64
    while hi > lo and a[hi - 1 + shift] == b[hi - 1]:
        hi -= 1
    a, b = a[lo : hi + shift], b[lo:hi]
    if len(a) <= edits:
        return True
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    plus, minus, score = full >> edits << edits, 0, edits
    last = top >> 1  # the last row, once the band has sunk past it
    for j, c in enumerate(b):
        eq = where.get(c, 0)
        x = (eq >> (j - edits) if j >= edits else eq << (edits - j)) & full
        d = ((((x & plus) + plus) ^ plus) | x | minus) & full
        right, left = (minus | ~(d | plus)) & full, d & plus
        if j < len(a) - edits:
            score += not d & top
        else:
            score += bool(right & last) - bool(left & last)
            last >>= 1
        plus, minus = (left | ~(d >> 1 | right)) & full, d >> 1 & right
    return score <= edits


def _occurrences(s: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def occur(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for no, line in enumerate(lines_of(text)):
                    x = line.strip()
                    alone = len(x) >= s.min_chars or is_sentence(x)
                    if alone or len(x) >= s.min_chars - s.edits:
                        rows.append((doc, row, no, line_id(x), alone))
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "row", "line_no", "node", "exact"])

    return occur


def _buckets(s: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # of lines whose keys this task has given; when full, keys are given again
        for batch in batches:
            fresh: dict[int, str] = {}
            for text in batch.column(0).to_pylist():
                for line in lines_of(text):
                    if len(x := line.strip()) >= max(1, s.min_chars - s.edits) and (own := line_id(x)) not in done:
                        if len(done) >= 300_000:
                            done.clear()
                        done.add(own)
                        fresh[own] = x
            ids, lines = np.array(list(fresh), np.int64), list(fresh.values())
            for lo in range(0, len(lines), 2000):
                at, keys = all_keys(lines[lo : lo + 2000], s)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[lo + at])], names=["key", "node"])

    return keyed


def _texts(s: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {line_id(x): x for text in batch.column(0).to_pylist() for line in lines_of(text) if len(x := line.strip()) >= max(1, s.min_chars - s.edits)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], names=["node", "payload"])

    return texts


def _sketched(s: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, odd = sketches(batch.column(1).to_pylist(), s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order), pa.array([x.tobytes() for x in odd], pa.binary())], names=["node", "payload", "size", "sketch"])

    return sketched


def duplicate_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, row, lines array<int>, every array<int>, copies, class_doc_id, n_links) of the rows of docs that hold lines
    to remove or lines with links. A row is known by its doc_id and its text's hash (row); copies: rows that share both.

    lines: the numbers, from 0, of lines of which an equal or nearly equal one comes earlier (by doc_id, then row, then
    line). every: for rows of which there are copies, the lines that all copies but one lose. class_doc_id: the smallest
    doc_id that holds the first line of one of their classes, null where lines is empty. n_links: the verified links of
    each of the row's lines, removed or not, added up; a link is a pair of different lines within the edits, and all of
    them count. Null and empty texts have no lines. Different rows that share a doc_id, null or not, are rows of
    their own. Rows with a null doc_id come before all others. An empty table gives an empty result."""
    s = settings
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(_occurrences(s), "doc_id long, row long, line_no int, node long, exact boolean")
    seen = scratch.table(seen, "lines")

    def fetch(asked: DataFrame) -> DataFrame:
        own = docs.select("text").mapInArrow(_texts(s), "node long, payload string").join(asked, "node").groupBy("node").agg(F.first("payload").alias("payload"))
        return own.mapInArrow(_sketched(s), "node long, payload string, size long, sketch binary")

    buckets = docs.select("text").mapInArrow(_buckets(s), "key long, node long")
    degree, found = count_links(buckets, fetch, lambda lines, odd: Comparer(lines, odd, s))
    place = F.struct("doc_id", "row", "line_no")
    first = seen.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("exact").alias("exact"))
    first = first.join(found, "node", "left").join(degree, "node", "left").filter("exact and n > 1 or component is not null")
    first = scratch.table(first.withColumn("component", F.coalesce("component", "node")), "firsts")
    classes = first.groupBy("component").agg(F.min("first").alias("first"))
    of_node = first.select("node", "component", "n_links").join(classes, "component").select("node", "first", "n_links")
    held = seen.select("doc_id", "row", "line_no", "node").join(of_node, "node").withColumn("gone", ~place.eqNullSafe(F.col("first")))
    out = held.groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("line_no")))).alias("lines"),
        F.sort_array(F.collect_set("line_no")).alias("every"),
        F.count("*").alias("n"),
        F.min(F.when(F.col("gone"), F.col("first.doc_id"))).alias("class_doc_id"),
        F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links"),
    )
    out = out.withColumn("copies", (F.col("n") / F.size("every")).cast("long")).withColumn("n_links", (F.col("n_links") / F.col("copies")).cast("long"))
    return out.filter("copies > 1 or n_links > 0 or size(lines) > 0").select("doc_id", "row", "lines", F.when(F.col("copies") > 1, F.col("every")).alias("every"), "copies", "class_doc_id", "n_links")


def without_lines(text, lines):
    """A column: text without the lines of these numbers; null numbers leave it as it is."""
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(lines, i))
    return F.when(lines.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with all its columns, its text without repeated lines, and n_lines, n_removed, n_links and class_doc_id.

    Every row stays, texts of removed lines only become empty. class_doc_id is the row's own doc_id where nothing was
    removed. Of repeated rows (doc_id and text), one keeps its lines. Columns of docs that have the names of the added ones
    are replaced; other names can't clash. Null texts stay null, with n_lines 0."""
    out, _ = marked_lines(docs, settings)
    return out


ADDED = ("n_lines", "n_removed", "n_links", "class_doc_id")


def marked_lines(docs: DataFrame, settings: Settings = Settings(), names: tuple[str, ...] = ADDED) -> tuple[DataFrame, tuple[str, ...]]:
    """dedup_lines() with other names for its four added columns; returns the names too."""
    gone = scratch.table(duplicate_lines(docs, settings), "gone")
    columns = [c for c in docs.columns if c not in names]
    # all of a row but its text in one column, so that no name can clash
    own = docs.select(F.struct(*columns).alias("own"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("text_row"))
    gone = gone.withColumnsRenamed({"doc_id": "gone_doc"})
    # what goes grows with the table: it is merged at any size, never broadcast
    both = own.join(gone.hint("merge"), F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("text_row") == F.col("row")), "left")
    again = F.lit(False)
    if not gone.filter("copies > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("doc", "text_row").orderBy(F.xxhash64(F.to_json("own"))))
        both = both.filter("coalesce(copies, 1) = 1").withColumn("again", F.lit(False)).unionByName(both.filter("copies > 1").withColumn("again", nth > 1))
        again = F.col("again")
    lines, text = F.when(again, F.col("every")).otherwise(F.col("lines")), F.col("own.text").cast("string")
    added = (
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))),
        F.coalesce(F.size(lines), F.lit(0)),
        F.coalesce("n_links", F.lit(0).cast("long")),
        F.coalesce(F.when(again, F.least("class_doc_id", "doc")).otherwise(F.col("class_doc_id")), F.col("doc")),
    )
    kept = [without_lines(text, lines).alias("text") if c == "text" else F.col("own")[c].alias(c) for c in columns]
    return both.select(*kept, *(value.alias(name) for name, value in zip(names, added))), names
