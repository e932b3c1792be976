"""Vector code over the bytes of a text: word hashes, shingles, sketches, and groups of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

U = np.uint64
WORD = np.zeros(256, dtype=np.int8)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, dtype=U)
_INVERSES = np.ones(1, dtype=U)
_TURN = 0xD1342543DE82EF95
_ROLL = np.ones(1, dtype=U)
_UNROLL = np.ones(1, dtype=U)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least `size` of each."""
    global _POWERS, _INVERSES
    while len(_POWERS) < size:
        step = len(_POWERS)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS = np.concatenate([_POWERS, _POWERS * U(pow(_BASE, step, 1 << 64))])
        _INVERSES = np.concatenate([_INVERSES, _INVERSES * U(pow(inverse, step, 1 << 64))])
    return _POWERS, _INVERSES


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a finaliser of the splitmix kind)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (begin, end) of the words: runs of ASCII letters, digits and all non-ASCII characters."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = WORD[raw]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running sum over the text."""
    powers, inverses = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum((raw.astype(U) + U(1)) * powers[:len(raw)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverses[begin] + (end - begin).astype(U))


def words(text: str) -> np.ndarray:
    """Hashes of the lower-cased words in order."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    begin, end = word_spans(raw)
    return span_hashes(raw, begin, end)


def _roll_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier of `rolled` and of its inverse modulo 2^64, at least `size` of each."""
    global _ROLL, _UNROLL
    while len(_ROLL) < size:
        step = len(_ROLL)
        _ROLL = np.concatenate([_ROLL, _ROLL * U(pow(_TURN, step, 1 << 64))])
        _UNROLL = np.concatenate([_UNROLL, _UNROLL * U(pow(pow(_TURN, -1, 1 << 64), step, 1 << 64))])
    return _ROLL, _UNROLL


def spans_rolled(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the words from each start to its stop, from one running sum over the text: as `rolled` has them."""
    powers, inverses = _roll_powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=U)
    np.cumsum(hashes * inverses[:len(hashes)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * powers[stop - 1] + (stop - start).astype(U))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` words; of all words together where there are fewer."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    if size > 8:
        start = np.arange(len(hashes) - size + 1)
        return spans_rolled(hashes, start, start + size)
    out = np.zeros(len(hashes) - size + 1, dtype=U)
    for k in range(size):
        out = out * U(_TURN) + hashes[k:len(hashes) - size + 1 + k]
    return mix(out + U(size))


def shingles(text: str, size: int = 5) -> np.ndarray:
    """The sorted set of word shingles."""
    return np.unique(rolled(words(text), size))


def multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.integers(1, 1 << 63, count, dtype=U) * U(2) + U(1), random.integers(0, 1 << 63, count, dtype=U)


def minhash(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of len(a) hash functions over the items, 32 bits each."""
    best = np.full(len(a), np.iinfo(U).max, dtype=U)
    for i in range(0, len(items), 512):
        best = np.minimum(best, (items[i:i + 512, None] * a + b).min(axis=0))
    return (best >> U(32)).astype(np.uint32)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by `keys`, with the borders of the groups."""
    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        carry = table if carry is None else pa.concat_tables([carry, table])
        fresh = np.zeros(carry.num_rows, dtype=bool)
        fresh[0] = True
        for k in keys:
            column = carry.column(k).to_numpy()
            fresh[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(fresh)
        if len(starts) > 1:
            last = starts[-1]
            yield carry.slice(0, last).combine_chunks(), starts
            carry = carry.slice(last).combine_chunks()
    if carry is not None:
        yield carry.combine_chunks(), np.array([0, carry.num_rows])


def smallest_labels(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row number of its component."""
    labels = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, labels, len(labels)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == labels).all():
            return labels
        labels = new


def long_text_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int = 1 << 20) -> np.ndarray:
    """`span_hashes` in stretches of about `size` bytes, so that the working memory does not follow the text."""
    if len(raw) <= size:
        return span_hashes(raw, begin, end)
    cuts = np.unique(np.searchsorted(begin, np.arange(0, len(raw) + size, size)))
    return np.concatenate([np.zeros(0, dtype=U), *[
        span_hashes(raw[begin[a]:end[b - 1]], begin[a:b] - begin[a], end[a:b] - begin[a]) for a, b in zip(cuts[:-1], cuts[1:])]])
