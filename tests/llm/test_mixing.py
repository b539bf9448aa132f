import collections
import re
from fractions import Fraction

from attestra.llm import mixing, prefix

SCHEMA = "doc_id long, source string, text string"


def slow_targets(sizes, weights=(1, 2, 3), epochs=3):
    """Targets by sharing anew what is above, in fractions."""
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [k for k in keys if k not in full]
        left, by = total - sum(full.values()), sum(weight[k] for k in free)
        above = [k for k in free if Fraction(left * weight[k], by) > epochs * sizes[k]]
        if not above:
            return {k: Fraction(full[k]) if k in full else Fraction(left * weight[k], by) for k in keys}
        full |= {k: Fraction(epochs * sizes[k]) for k in above}


def check(spark, rows, **how):
    d = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in mixing.mix_sources(d, **how).select("doc_id", "source", "size", "source_size", "target", "taken").collect()]
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = slow_targets(sizes, how.get("weights", (1, 2, 3)), how.get("epochs", 3))
    taken = collections.Counter()
    assert len(got) == len(rows)
    for i, s, size, source_size, target, n in got:
        assert source_size == sizes[s] and abs(target - want[s]) < 1e-6 * max(1, target) and 0 <= n <= how.get("epochs", 3) * size, (i, s)
        taken[s] += n
    assert all(taken[s] == int(want[s] + Fraction(1, 10**7)) for s in sizes)
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5), **how).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, got))
    return got


def test_mixing(spark):
    rows = [(i, ["big", "big", "Small", "tiny", None, "é", "Z", "zero"][i % 8], "w " * (i % 9 if i % 8 != 3 else 1)) for i in range(400)]
    rows = [(i, s, None if s == "zero" and i % 3 else "" if s == "zero" else t) for i, s, t in rows]
    rows += [(3, "big", "a b c")] * 40 + [(None, "big", "no id"), (None, None, None), (500, "big", "word\t\x0b\n" * 30_000)]
    got = check(spark, rows)
    # one source takes more than it has, another less, and each is cut in one document
    assert any(n > size for *_, size, _, _, n in [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in got]) and any(n == 0 < size for _, _, size, _, _, n in got)
    check(spark, rows, weights=(5,), epochs=1)
    check(spark, [(1, "a", "x"), (2, "b", "x y")])
    check(spark, [(1, None, None), (2, "b", "")])


def test_words_drawn(spark):
    rows = [(i, f"s{i % 4}", " ".join(f"{i}.{k}" for k in range(i % 7 + (200 if i % 4 == 0 else 0)))) for i in range(60)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA))
    drawn = mixing.drawn(mixed).collect()
    words = collections.Counter()
    for r in drawn:
        n = len(r.text.split())
        words[r.doc_id] += n
        assert dict((i, t) for i, _, t in rows)[r.doc_id].startswith(r.text) and n
    assert {r.doc_id: r.taken for r in mixed.collect() if r.taken} == dict(words) and max(r.epoch for r in drawn) > 1


def test_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a", "x y", "p", 5, "q")], SCHEMA + ", `_key` string, size int, `a.b` string")
    out = mixing.mix_sources(d, keep_text=False)
    assert out.columns == ["doc_id", "source", "_key", "a.b", "size", "source_size", "target", "taken"]
    assert [tuple(r) for r in out.collect()] == [(1, "a", "p", "q", 2, 2, 2.0, 2)]
    assert mixing.mix_sources(d.limit(0)).count() == 0


def test_running_sums(spark):
    """A value that half of the rows share is dealt over ranges, and sums go on across them."""
    rows = [("g", 5 if i % 2 else i, i) for i in range(300)] + [("h", None, 1), ("h", None, 1)]
    d = spark.createDataFrame(rows, "g string, o int, v long").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix.running(d, ["g"], ["o"], {"before": "v", "place": "1"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("g", "h"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine))) and all(a.before + a.v == b.before and (a.o or 0) <= (b.o or 0) for a, b in zip(mine, mine[1:], strict=False))
    assert len(got) == len(rows)
