"""Numpy kernels over concatenated UTF-8 texts, for use inside tasks.

A batch of texts is one byte array with row offsets; words are byte spans, which are hashed and compared all at once, so that no
Python object is made for a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MULTIPLIER = 0xD6E8FEB86659FD93
WINDOW_MULTIPLIER = 0x9FB21C651E98DF25
#: What a task works on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    col = pc.fill_null(column, "").cast(pa.large_string())
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if offs is not None and len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: A longer span is hashed by BLAKE2b; shorter ones eight bytes at a time.
SHORT = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end. A view, not a copy eight times as large."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span data[starts:ends]; equal bytes have equal hashes, wherever they stand.

    Eight bytes at a time go through mix, which is not linear, so that no family of texts collides by its structure. Whoever takes
    equal hashes for equal words compares the bytes too (distinct_spans), or draws a seed that no text's author can know.
    """
    size = ends - starts
    view = _eights(data)
    h = mix(size.astype(U64) * U64(WINDOW_MULTIPLIER) ^ U64(seed))
    live, at = np.arange(len(size)), starts
    for done in range(0, SHORT, 8):
        if done:
            live = live[size[live] > done]
            at = starts[live] + done
        if not len(live):
            return h
        h[live] = mix(h[live] ^ (view[at] & _LOW_BYTES[np.minimum(size[live] - done, 8)]))
    raw, key = data, seed.to_bytes(8, "little")
    for i in live[size[live] > SHORT].tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return h


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether data[starts:ends] has the bytes of other[at:to], span by span."""
    size = ends - starts
    same = size == to - at
    mine, theirs = _eights(data), _eights(other)
    live = np.flatnonzero(same)
    for done in range(0, SHORT, 8):
        live = live[size[live] > done]
        if not len(live):
            return same
        wrong = (mine[starts[live] + done] ^ theirs[at[live] + done]) & _LOW_BYTES[np.minimum(size[live] - done, 8)] != 0
        same[live[wrong]] = False
        live = live[~wrong]
    for i in live[size[live] > SHORT].tolist():
        same[i] = np.array_equal(data[starts[i] : ends[i]], other[at[i] : to[i]])
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first span of each distinct content, each span's place among those). Contents are compared, not only their hashes."""
    codes = pa.array(span_hashes(data, starts, ends)).dictionary_encode()
    place = codes.indices.to_numpy().astype(np.int64)
    first = np.empty(len(codes.dictionary), np.int64)
    first[place[::-1]] = np.arange(len(place))[::-1]
    if not same_spans(data, starts, ends, data, starts[first][place], ends[first][place]).all():
        known: dict[bytes, int] = {}
        place = np.array([known.setdefault(data[s:e].tobytes(), len(known)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.empty(len(known), np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
    return first, place


def mask_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of inside; no run passes a row's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each span start lies in."""
    return np.searchsorted(offsets, starts, side="right") - 1


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes, in order."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(m, dtype=U64)
    for j in range(k):
        out *= U64(WINDOW_MULTIPLIER)
        out += words[j : j + m]
    return mix(out + U64(k))


def group_windows(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, group) of all windows of k words; a group of fewer words, but not none, gives its whole sequence as one.

    words are those of all groups, in order; counts has each group's number of them.
    """
    group = np.repeat(np.arange(len(counts)), counts)
    wide = window_hashes(words, k)
    keep = group[: len(wide)] == group[k - 1 :] if len(wide) else np.zeros(0, dtype=bool)
    out_h, out_g = [wide[keep]], [group[: len(wide)][keep]]
    first = np.cumsum(counts) - counts
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        if len(short):
            h = np.zeros(len(short), dtype=U64)
            for j in range(size):
                h = h * U64(WINDOW_MULTIPLIER) + words[first[short] + j]
            out_h.append(mix(h + U64(size)))
            out_g.append(short)
    h, g = np.concatenate(out_h), np.concatenate(out_g)
    order = np.argsort(g, kind="stable")
    return h[order], g[order]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... of counts[0] values, then those of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begin - starts, counts)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def table(names: bytes | list[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(names)] = True
    return out


#: `[\x20\x09-\x0D]`
SPACE = table([32, 9, 10, 11, 12, 13])


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    for b in it:
        if b.num_rows:
            yield b
