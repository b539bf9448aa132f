"""Splitting texts into pre-tokens with numpy, as the public tokenizers' patterns do."""

from __future__ import annotations

import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_SPACES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_made: dict[str, np.ndarray] = {}
_BLOCK = 8


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of each code point. The table is filled for the blocks of code points that occur."""
    if "class" not in _made:
        _made["class"], _made["filled"] = np.zeros(0x110000, np.uint8), np.zeros(0x110000 >> _BLOCK, dtype=bool)
    out, filled = _made["class"], _made["filled"]
    for block in np.flatnonzero((np.bincount(codes >> _BLOCK, minlength=len(filled)) > 0) & ~filled).tolist():
        lo, hi = block << _BLOCK, (block + 1) << _BLOCK
        cat = np.array([unicodedata.category(chr(c))[0] for c in range(lo, hi)])
        out[lo:hi] = np.select([cat == "L", cat == "N"], [LETTER, NUMBER], OTHER)
        out[[c for c in _SPACES if lo <= c < hi]] = SPACE
        filled[block] = True
    return out[codes]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their first bytes) of valid UTF-8."""
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), np.flatnonzero((data & 0xC0) != 0x80)


def _contractions(codes: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many letters from at on, before stop, belong to 's 't 'm 'd 're 've 'll; else 0."""
    n = len(codes)
    one = codes[np.minimum(at, n - 1)]
    two = np.where(at + 1 < stop, codes[np.minimum(at + 1, n - 1)], 0)
    pair = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
    single = np.isin(one, (115, 116, 109, 100))
    return np.where(single, 1, np.where(pair, 2, 0))


def _runs(codes: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, kinds) of runs of one class; first marks where a text begins."""
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (kinds[1:] != kinds[:-1]) | first[1:]
    rs = np.flatnonzero(new)
    return rs, np.r_[rs[1:], len(codes)], kinds[rs]


def split_with_spaces(codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the matches of public_tokenizers.PATTERN start; together they cover the texts, which begin at texts (non-empty ones)."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[texts] = True
    first[n] = True
    rs, re, rc = _runs(codes, classes(codes), first[:n])
    mark = np.zeros(n + 1, dtype=bool)
    space = rc == SPACE
    mark[rs[space]] = True
    followed = space & ~first[re]
    long = followed & (re - rs > 1)
    mark[re[long] - 1] = True
    solid = ~space
    attached = np.zeros(len(rs), dtype=bool)
    attached[1:] = solid[1:] & ~first[rs[1:]] & (codes[rs[1:] - 1] == 32)
    mark[rs[solid & ~attached]] = True
    quote = np.flatnonzero((rc[:-1] == OTHER) & (re[:-1] - rs[:-1] == 1) & (codes[rs[:-1]] == 39) & ~attached[:-1] & (rc[1:] == LETTER) & ~first[rs[1:]])
    if len(quote):
        took = _contractions(codes, rs[quote + 1], re[quote + 1])
        quote, took = quote[took > 0], took[took > 0]
        mark[rs[quote + 1]] = False
        at = rs[quote + 1] + took
        mark[at[at < re[quote + 1]]] = True
    return np.flatnonzero(mark[:n])


def split_words(codes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the matches of `'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+` in lower-case text."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = classes(codes)
    first = np.zeros(n, dtype=bool)
    first[texts] = True
    rs, re, rc = _runs(codes, kinds, first | (kinds == NUMBER))
    quote = np.flatnonzero((rc[:-1] == OTHER) & (re[:-1] - rs[:-1] == 1) & (codes[rs[:-1]] == 39) & (rc[1:] == LETTER) & ~first[rs[1:]])
    if len(quote):
        took = _contractions(codes, rs[quote + 1], re[quote + 1])
        quote, took = quote[took > 0], took[took > 0]
        re = re.copy()
        rs = rs.copy()
        re[quote] += took
        rs[quote + 1] += took
    keep = (rc != SPACE) & (re > rs)
    return rs[keep], re[keep]
