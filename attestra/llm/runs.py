"""Periodic runs of words by a sparse diagonal DP, and texts without the repeats.

A diagonal is a lag q; along it, each word that equals the one q words before lengthens a match, and a diagonal that ends with at least
3 * q matches (so that the stretch holds its period four times) is a run. All earlier occurrences of a frequent word are as many as the
square of its count, so diagonals are opened sparsely: lags in (k / 2, k], for k = 1, 2, 4, ..., are taken from the nearest earlier
occurrence of the window of k words that begins at a word. No run is lost by that. Inside a run of smallest period q <= k the window's
nearest earlier occurrence is exactly q back, since a nearer one would make the period a power; so the words that open diagonal q there
stand side by side from the run's second period on to k words before its end, more than q of them, and the run's ends follow from their
number. Nor is one reported that isn't a run, or not with its smallest period, for the same reason. A step from k to 2k ranks pairs of
windows by sorting, and only windows that occur twice, of texts longer than 2k words, go on to it. So a text of n words costs
O(n log^2 n) at most, however often a word repeats. Texts of a piece advance together; a diagonal never passes a text's end.

Words are compared as bytes, not only by hashes. Defined cases: a null text has no words, no runs and an empty collapsed text; rows are
treated one by one, so repeated rows and ids don't matter; a long text is a piece of its own, with some 100 bytes of memory for each
word; further columns stay, but those named runs and collapsed are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import staging
from attestra.llm.kernels import PIECE_BYTES, SPACE, batches, distinct_spans, mask_spans, pieces, ranges, rows_of, utf8

#: A run holds its period so often, and so many words, at least.
EXPONENT = 4
LEAST = 6
WORDS = r"[^\x20\x09-\x0D]+"
RESULT = ("runs", "collapsed")
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of all runs of texts whose words stand side by side, counts[i] of them for text i; by first word, then period.

    words: numbers, equal for equal words.
    """
    n = len(words)
    text = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = np.arange(n)
    code = np.zeros(n, np.int64)
    if n:
        code = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True)[1].astype(np.int64)
    k = 1
    while len(at):
        # equal windows side by side, in order of place
        order = np.argsort(code[at], kind="stable")
        place, same = at[order], code[at][order]
        twin = np.r_[False, same[1:] == same[:-1]]
        lag = np.zeros(len(place), np.int64)
        lag[1:] = np.where(twin[1:], place[1:] - place[:-1], 0)
        hit = np.flatnonzero((lag > k // 2) & (lag <= k))
        x, q = place[hit], lag[hit]
        by = np.argsort(x)
        x, q = x[by], q[by]
        if len(x):
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1] + 1) | (q[1:] != q[:-1]) | (text[x[1:]] != text[x[:-1]])])
            many = np.diff(np.r_[first, len(x)])
            period = q[first]
            length = many + period + k - 1
            good = length >= np.maximum(LEAST, EXPONENT * period)
            found.append((x[first][good] - period[good], length[good], period[good]))
        # windows of 2k: both halves occur twice, and the text has room for four periods of more than k words
        often = np.zeros(n, bool)
        often[place[twin | np.r_[twin[1:], False]]] = True
        cand = np.flatnonzero(often)
        cand = cand[(cand + 2 * k <= end[cand]) & (counts[text[cand]] > EXPONENT * k)]
        at = cand[often[cand + k]]
        fresh = np.zeros(n, np.int64)
        if len(at):
            rank = np.unique(code[at] * n + code[at + k], return_inverse=True)[1]
            fresh[at] = rank
        code = fresh
        k *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def repeats(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words lie in any run after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:n]) > 0


def _joined(data: np.ndarray, s: np.ndarray, e: np.ndarray, counts: np.ndarray) -> list[str]:
    """Of each row its words, counts[row] of them, joined by one space."""
    size = e - s + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    begin = np.cumsum(size) - size
    at = 0
    while at < len(s):  # some words at a time: places take eight times their bytes
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + 4 * PIECE_BYTES)))
        out[ranges(begin[at:to], size[at:to] - 1)] = data[ranges(s[at:to], size[at:to] - 1)]
        at = to
    raw, last = out.tobytes(), np.cumsum(counts)
    edge = np.r_[begin, len(out)]
    return [raw[edge[b] : max(edge[b], edge[z] - 1)].decode() for b, z in zip((last - counts).tolist(), last.tolist(), strict=True)]


def collapse_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[dict]], list[str]]:
    """(runs, collapsed text) of each text of one byte array."""
    s, e = mask_spans(~SPACE[data], offsets)
    counts = np.bincount(rows_of(s, offsets), minlength=len(offsets) - 1)
    start, length, period = find(distinct_spans(data, s, e)[1], counts)
    own = np.cumsum(counts) - counts
    row = np.searchsorted(own + counts, start, side="right")
    runs: list[list[dict]] = [[] for _ in counts]
    for r, a, n, q in zip(row.tolist(), (start - own[row]).tolist(), length.tolist(), period.tolist(), strict=True):
        runs[r].append({"start": a, "length": n, "period": q})
    keep = ~repeats(len(s), start, length, period)
    left = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
    return runs, _joined(data, s[keep], e[keep], left)


def _collapse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in batches(it):
        data, offsets = utf8(b.column("_text"))
        for i, j in pieces(offsets):
            runs, texts = collapse_texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([b.column("_rest").slice(i, j - i), pa.array(runs, kind), pa.array(texts, pa.string())], ["_rest", "runs", "collapsed"])


def collapse_runs(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """docs with runs (start, length, period; by start, then period) and collapsed, the words left, joined by one space.

    text: what is looked through, if not the column of that name.
    """
    staging.prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c not in RESULT]
    text = F.col(text) if isinstance(text, str) else text
    packed = docs.select(staging.packed(rest).alias("_rest"), text.cast("string").alias("_text"))
    out = packed.mapInArrow(_collapse, f"_rest {packed.schema['_rest'].dataType.simpleString()}, runs {RUNS}, collapsed string")
    back = staging.unpacked(rest, "_rest")
    return out.select(*[back[c] for c in rest], *RESULT)


def strongest(runs: Column) -> Column:
    """Of runs the one with the greatest exact length / period, of several the smallest start, then period; null of none."""
    ahead = lambda r, b: r["length"] * b["period"] > b["length"] * r["period"]
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda b, r: F.when(b.isNull() | ahead(r, b), r).otherwise(b))
