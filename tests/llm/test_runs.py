import random
import re

import numpy as np

from attestra.llm import runs

SCHEMA = "doc_id long, text string"


def slow(words):
    """All runs by the definition: each lag's stretches of equal words, the smallest period of each stretch."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rnd = random.Random(11)
    out = []
    for i in range(400):
        words = [rnd.choice("ab" if i % 2 else "abcdefgh") for _ in range(rnd.randrange(60))]
        if i % 3 == 0 and words:
            unit = words[: rnd.randrange(1, 12)]
            at = rnd.randrange(len(words))
            words[at:at] = unit * rnd.randrange(2, 9)
        if i % 7 == 0:  # periods inside periods
            words = (words[:5] * 4 + words[5:8]) * 5
        out.append(words)
    return out


def test_find_by_definition():
    some = texts()
    counts = np.array([len(w) for w in some])
    start, length, period = runs.find(np.array([ord(c) for w in some for c in w]), counts)
    own = np.cumsum(counts) - counts
    want = sorted((own[i] + s, q, n) for i, w in enumerate(some) for s, n, q in slow(w))
    assert list(zip(start.tolist(), period.tolist(), length.tolist(), strict=True)) == want and len(want) > 200


def test_find_is_not_quadratic():
    # all earlier occurrences of the one word would be 2 * 10 ** 10
    n = 200_000
    assert [x.tolist() for x in runs.find(np.zeros(n, np.int64), np.array([n]))] == [[0], [n], [1]]
    unit = np.arange(9_999)
    two = np.r_[np.tile(unit, 4), [7]]
    assert [x.tolist() for x in runs.find(two, np.array([len(two)]))] == [[0], [4 * 9_999], [9_999]]


def test_collapse_runs(spark):
    some = [" ".join(w) for w in texts()]
    long = " ".join(f"w{i}" for i in range(30_000)) + "\n" + "y" * 50_000 + " x y z" * 5_000
    rows = [*enumerate(some), (7, some[7]), (None, "a a a a a a\ta\x0ba"), (900, None), (901, ""), (902, " \n\x0c "), (903, long), (904, "a a " * 6), (905, "é " * 6), (906, "one two three")]
    rnd = random.Random(1)
    rnd.shuffle(rows)
    got = sorted((r.doc_id, r.text, [tuple(x) for x in r.runs], r.collapsed) for r in runs.collapse_runs(spark.createDataFrame([(i if i is not None else -1, t) for i, t in rows], SCHEMA).repartition(3)).collect() if r.text is not None)
    split = {t: re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in rows if t is not None}
    known = {t: slow(w) if len(w) < 1000 else [(30_001, 15_000, 3)] for t, w in split.items()}
    assert got == sorted((i if i is not None else -1, t, known[t], collapsed(split[t], known[t])) for i, t in rows if t is not None)
    assert dict((r.doc_id, (r.runs, r.collapsed)) for r in runs.collapse_runs(spark.createDataFrame([(1, None)], SCHEMA)).collect()) == {1: ([], "")}


def test_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a a a a a a", "x", "y", 3)], "doc_id long, text string, `_rest` string, `a.b` string, runs int")
    (r,) = runs.collapse_runs(d).withColumn("top", runs.strongest(runs.F.col("runs"))).collect()
    assert (r["_rest"], r["a.b"], r.collapsed, tuple(r.top)) == ("x", "y", "a", (0, 6, 1))
    assert runs.collapse_runs(d.limit(0)).count() == 0


def test_strongest_is_exact(spark):
    """Ties go to the smallest start, then period; ratios are compared as fractions."""
    cases = [[], [(5, 12, 3), (9, 8, 2), (0, 6, 1)], [(0, 6, 1), (9, 12, 2)], [(0, 3 * 10**9 + 1, 10**9), (1, 3 * 10**9 + 2, 10**9)]]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, r {runs.RUNS}")
    got = {r.i: r.t and tuple(r.t) for r in d.select("i", runs.strongest(runs.F.col("r")).alias("t")).collect()}
    assert got == {0: None, 1: (0, 6, 1), 2: (0, 6, 1), 3: (1, 3 * 10**9 + 2, 10**9)}
