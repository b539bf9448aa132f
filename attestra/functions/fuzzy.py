"""Likeness of strings, 0 to 100: the share of characters in common order, its token and partial forms, and their weighted best.

The ratio of two strings is 200 * L / (n + m) with L the length of their longest common subsequence, which is found a row of bits at a
time. All are plain functions, called once for each distinct pair inside an Arrow UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed values of the weighted ratio: what token forms count, what partial forms count where one string is 1.5 and 8 times as long.
TOKENS, PARTIAL, SHORT_PARTIAL = 0.95, 0.9, 0.6
LONGER, MUCH_LONGER = 1.5, 8.0


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string and a window of its length, or less at the ends, of the longer one."""
    s, t = sorted((a, b), key=len)
    if not s:
        return 0.0 if t else 100.0
    best = 0.0
    for i in range(1 - len(s), len(t)):
        window = t[max(0, i) : i + len(s)]
        # no window can do better than its length allows
        if 200.0 * len(window) / (len(s) + len(window)) > best:
            best = max(best, ratio(s, window))
    return best


def _sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_ratio(a: str, b: str) -> float:
    """The best of the ratios of sorted tokens and of shared tokens with and without the rest."""
    both, own, other = _sets(a, b)
    if both and (not own or not other):
        return 100.0
    out = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    left, right = (f"{both} {x}".strip() for x in (own, other))
    out = max(out, ratio(left, right))
    return max(out, ratio(both, left), ratio(both, right)) if both else out


def partial_token_ratio(a: str, b: str) -> float:
    both, own, other = _sets(a, b)
    return 100.0 if both else max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(own, other))


def weighted(a: str, b: str) -> float:
    """0 with an empty string; token forms count for strings of like length, partial ones where one is far longer."""
    if not a or not b:
        return 0.0
    out = ratio(a, b)
    far = max(len(a), len(b)) / min(len(a), len(b))
    if far < LONGER:
        return max(out, TOKENS * token_ratio(a, b))
    scale = PARTIAL if far < MUCH_LONGER else SHORT_PARTIAL
    return max(out, scale * partial_ratio(a, b), TOKENS * scale * partial_token_ratio(a, b))


@F.pandas_udf(DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    return pd.Series([known[k] if k in known else known.setdefault(k, weighted(*k)) for k in zip(a.fillna(""), b.fillna(""), strict=True)])
