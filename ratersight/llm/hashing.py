"""Vectorised hashes of words and substrings (numpy, 64 bits), over many texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

U8, U32, U64 = np.uint8, np.uint32, np.uint64
#: White space of the word rule: space and \x09-\x0D, as in bytes.split().
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Words of more bytes are hashed one by one.
LONG_WORD = 128
#: Texts are handled together up to so many bytes, which bounds the arrays in memory.
CHUNK_BYTES = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, CHUNK_BYTES + 65536)
        got = np.full(size, base, U64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if n <= CHUNK_BYTES + 65536:
            _powers[base] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Prefix hashes of an array of small integers; any substring's hash costs one multiplication."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum((symbols.astype(U64) + U64(1)) * powers(_BASE, n + 1)[:n], out=self.prefix[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def chunks(texts: Iterable[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of at most so many bytes together (a longer text goes alone), with the first one's index."""
    held: list[bytes] = []
    size = first = 0
    i = -1
    for i, text in enumerate(texts):
        if held and size + len(text) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hash, text's index, start, end) of each word of each text, and the joined bytes that start and end index."""
    joined = b" ".join(texts) + b" "
    a = np.frombuffer(joined, U8)
    space = SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=begins[1:])
    owner = np.searchsorted(begins, starts, "right") - 1
    hashed = Rolling(a).of(starts, ends)
    # modulo a power of two, long words can be made to share a polynomial hash; these get another one
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashed[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]])
    return hashed, owner, starts, ends, joined


def shingles(text_words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of n-word shingles of one text's word hashes; fewer words: the whole sequence as one."""
    k = len(text_words)
    if k == 0:
        return np.empty(0, U64)
    width = min(n, k)
    h = np.full(k - width + 1, U64(width), U64)
    for i in range(width):
        h = mix(h * U64(0x9E3779B97F4A7C15) + text_words[i : k - width + 1 + i])
    h.sort()
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def shingle_sets(texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order; A-Z count as a-z, None as an empty text."""
    for _, run in chunks(b"" if t is None else t for t in texts):
        h, owner, *_ = words([t.lower() for t in run])
        cut = np.searchsorted(owner, np.arange(len(run) + 1))
        for i in range(len(run)):
            yield shingles(h[cut[i] : cut[i + 1]], n)
