import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from attestra.functions import text
from attestra.operators import clustering, fixpoint

PAIR = "a string, b string, score double"
AB = "a string, b string"


def walk(pairs, vetoes):
    """Clusters by going through the pairs one by one, the best first."""
    of = {x: {x} for p in pairs for x in p[:2]}
    barred = {}
    for a, b in vetoes:
        barred.setdefault(a, set()).add(b)
        barred.setdefault(b, set()).add(a)
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], min(p[:2]), max(p[:2]))):
        x, y = sorted((of[a], of[b]), key=len)
        if x is not y and not any(barred.get(m, set()) & y for m in x):
            y |= x
            of.update(dict.fromkeys(x, y))
    least = {k: min(s) for k, s in {id(s): s for s in of.values()}.items()}
    return {m: least[id(s)] for m, s in of.items()}


def run(spark, pairs, vetoes):
    got = clustering.clusters(spark.createDataFrame(pairs, PAIR), spark.createDataFrame(vetoes, AB)).collect()
    assert len(got) == len({r.raw for r in got})
    return {r.raw: r.cluster for r in got}


def test_clusters_are_those_of_the_walk(spark):
    rnd = random.Random(8)
    for n, m, k, levels in ((12, 20, 8, 3), (60, 160, 40, 4)):
        ids = [f"m{i:02}" for i in range(n)]
        pairs = [(*p, rnd.randrange(levels) / levels) for p in rnd.sample(list(itertools.combinations(ids, 2)), m)]
        pairs = [(b, a, s) if rnd.random() < 0.5 else (a, b, s) for a, b, s in pairs]
        vetoes = rnd.sample(list(itertools.permutations(ids, 2)), k) + [("m00", "not there"), ("m01", "m01")]
        assert run(spark, pairs, vetoes) == walk(pairs, [v for v in vetoes if v[0] != v[1]])


def test_a_hub_whose_leaves_bar_each_other(spark):
    pairs = [("hub", f"leaf{i:03}", 1 - i / 1000) for i in range(300)]
    vetoes = [(f"leaf{i:03}", f"leaf{i + 1:03}") for i in range(0, 300, 2)] + [("leaf010", "leaf250")]
    assert run(spark, pairs, vetoes) == walk(pairs, vetoes)


def test_one_component_of_a_hundred_thousand(spark):
    """A hub, chains that hang on it, and vetoes across: no cluster is any task's alone."""
    n = 100_000
    i = spark.range(n).withColumn("k", F.xxhash64("id"))
    name = lambda c: F.lpad(c.cast("string"), 6, "0")
    pairs = i.where("id > 0").select(name(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") - 1)).alias("a"), name(F.col("id")).alias("b"), (F.pmod("k", F.lit(1000)) / 1000).alias("score"))
    vetoes = i.where("id % 1000 = 500").select(name(F.col("id")).alias("a"), name(F.col("id") + 400).alias("b"))
    got = {r.raw: r.cluster for r in clustering.clusters(pairs, vetoes).collect()}
    assert got == walk([tuple(r) for r in pairs.collect()], [tuple(r) for r in vetoes.collect()])
    assert len(got) == n and 1 < len(set(got.values())) <= 1 + n // 1000


def plain_rounds(pairs, edges, vetoes, weights, support=2):
    """The rounds one pair at a time. pairs: (a, b, attribute, boot, floor)."""
    members = {x for p in pairs for x in p[:2]}
    label = {x: x for x in members}
    barred = {frozenset(v) for v in vetoes}

    def merge(scored):
        groups = {}
        for x in members:
            groups.setdefault(label[x], set()).add(x)
        found = walk([(label[a], label[b], s) for a, b, s in scored], [(x, y) for x, y in itertools.permutations(groups, 2) if any(frozenset((m, n)) in barred for m in groups[x] for n in groups[y])])
        moved = sum(k != v for k, v in found.items())
        for x in members:
            label[x] = found.get(label[x], label[x])
        return moved

    near = {}
    for p, s, o, inst in edges:
        near.setdefault(s, set()).add((p, "out", o, inst))
        near.setdefault(o, set()).add((p, "in", s, inst))

    def co(a, b):
        ends = lambda x, way: {i for _, d, _, i in near.get(x, ()) if d == way and i}
        return (ends(a, "out") & ends(b, "out")) | (ends(a, "in") & ends(b, "in"))

    def score(a, b, attribute):
        gone = co(a, b)
        x, y = ({(p, d, label.get(o, o)) for p, d, o, i in near.get(e, ()) if i not in gone} for e in (a, b))
        near_ = len(x & y) / len(x | y) * min(1, len(x & y) / support) if x | y else 0
        return round(weights["attribute"] * attribute + weights["temporal"] * (not gone) + weights["relational"] * near_, 9)

    merge([(a, b, 1.0) for a, b, _, boot, _ in pairs if boot and frozenset((a, b)) not in barred])
    while True:
        best = {}
        for a, b, attribute, _, floor in pairs:
            x, y = sorted((label[a], label[b]))
            s = score(a, b, attribute)
            if x != y and s >= floor and frozenset((a, b)) not in barred:
                best[x, y] = max(best.get((x, y), 0), s)
        if not merge([(*k, v) for k, v in best.items()]):
            return label, {(a, b): score(a, b, t) for a, b, t, *_ in pairs}


def test_rounds_against_a_plain_loop(spark):
    rnd = random.Random(21)
    for n, floor, rounds in ((20, 0.75, 2), (60, 0.5, 4)):
        ids = [f"e{i:02}" for i in range(n)]
        pairs = [(*p, rnd.randrange(101) / 100, rnd.random() < 0.1, floor) for p in sorted(rnd.sample(list(itertools.combinations(ids, 2)), 4 * n))]
        edges = list({(rnd.choice("pq"), rnd.choice(ids), rnd.choice(ids), rnd.choice([None, None, "i1", "i2", f"i{rnd.randrange(9)}"])) for _ in range(3 * n)})
        vetoes = rnd.sample(list(itertools.permutations(ids, 2)), n)
        given = spark.createDataFrame(pairs, AB + ", attribute double, boot boolean, floor double").withColumns({"asserted": F.lit(0.0), "raised": F.lit(False), "counts": F.lit(True), "same_type": F.lit(True)})
        got = fixpoint.resolve(given, spark.createDataFrame(edges, "predicate string, subject string, object string, instance string"), spark.createDataFrame(vetoes, AB))
        label, scores = plain_rounds(pairs, edges, vetoes, fixpoint.DEFAULT.merge_weights)
        assert {r.raw: r.cluster for r in got.merged.collect()} == {k: v for k, v in label.items() if k != v}
        rows = got.pairs.collect()
        assert {(r.a, r.b): r.score for r in rows} == scores and {r.band for r in rows} >= {"merged", "vetoed", "none"}
        # a round after the first looks only at what the one before touched, and the last takes none
        assert len(got.rounds) >= rounds and got.rounds[1][0] == len(pairs) and got.rounds[-1][1] == 0 and (rounds == 2 or min(k for k, _ in got.rounds[2:]) < len(pairs))


def test_bands_and_relocation(spark):
    """Two sites of one instance get no neighbours of it and no credit for time; a raised pair asks for review, of two types only then."""
    pairs = [("s1", "s2", 1.0, 0.0, False, True), ("s3", "s4", 0.9, 0.0, True, True), ("s5", "s6", 0.9, 0.0, False, False), ("s7", "s8", 0.7, 1.0, False, True), ("t1", "t2", 0.99, 0.0, False, True)]
    given = spark.createDataFrame(pairs, AB + ", attribute double, asserted double, raised boolean, same_type boolean").withColumns({"boot": F.lit(False), "floor": F.lit(0.69), "counts": F.lit(True)})
    edges = [("based", "u", "s1", "i"), ("based", "u", "s2", "i"), ("seen", "v", "s3", None), ("seen", "v", "s4", None)]
    got = fixpoint.resolve(given, spark.createDataFrame(edges, "predicate string, subject string, object string, instance string"), spark.createDataFrame([("t2", "t1")], AB))
    at = {r.a: (r.score, r.shared, r.band) for r in got.pairs.collect()}
    assert at["s1"] == (0.5, 0, "none") and at["s3"] == (0.8, 1, "merged") and at["t1"][2] == "vetoed" and at["s5"][2] == "none" and at["s7"][2] == "none"


def test_evidence_of_identity(spark):
    t = "struct<type:string,ns:string,name:string,alias:string,unique:string>"
    cases = [
        (("u", None, "alpha", None, "7"), ("u", None, "beta", None, "7"), True),
        (("u", None, "alpha", None, "7"), ("v", None, "beta", None, "7"), False),
        (("u", "x", "alpha", "c", None), ("v", "y", "beta", "c", None), True),
        (("u", "x", "alpha", None, None), ("u", "x", "alpha", None, None), True),
        (("u", "x", "alpha", None, None), ("u", "y", "alpha", None, None), False),
        (("u", None, "", None, None), ("u", None, "", None, None), False),
        (("u", None, "qr 233", None, None), ("u", "x", "qr 233 radar", None, None), True),
        (("u", None, "qr 233", None, None), ("u", None, "qr 233 p", None, None), False),
        (("u", None, "nhad", None, None), ("u", None, "northern highland air defence", None, None), True),
        (("u", None, "nhad", None, None), ("w", None, "northern highland air defence", None, None), False),
    ]
    d = spark.createDataFrame(cases, f"x {t}, y {t}, want boolean")
    assert all(r.want == r.got for r in d.withColumn("got", fixpoint.bootstrap_evidence("x", "y")).collect())


def test_geo_vetoes_take_the_stricter_tolerance(spark):
    placed = spark.createDataFrame([("a", "site", 0.0, 0.0), ("b", "area", 0.0, 1.0), ("c", "area", 0.0, 1.5), ("d", "other", 0.0, 50.0), ("e", "site", None, None)], "id string, type string, lat double, lon double")
    pairs = spark.createDataFrame(list(itertools.combinations("abcde", 2)), AB)
    got = {tuple(r) for r in fixpoint.geo_vetoes(pairs, placed, {"site": 50.0, "area": 100.0}).collect()}
    # a type without a tolerance leaves that of the other
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("c", "d")}


def slow_jaro_winkler(a, b):
    if not a or not b:
        return 0.0
    reach, used, hits = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            hits.append(c)
    if not hits:
        return 0.0
    other = [b[j] for j in sorted(used)]
    m, swaps = len(hits), sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a[:4], b[:4], strict=False))))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_jaro_winkler_of_many_pairs(spark):
    rnd = random.Random(2)
    names = ["", "a", "martha", "marhta", "dwayne", "duane", "é😀é", "é😀", "x" * 300] + ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 14))) for _ in range(60)]
    pairs = list(itertools.product(names, names))
    got = text.jaro_winkler_of(*map(list, zip(*pairs, strict=True)))
    assert np.allclose(got, [slow_jaro_winkler(a, b) for a, b in pairs], atol=1e-12)
    d = spark.createDataFrame([*pairs[:500], (None, "a")], AB)
    assert np.allclose([r.s for r in d.select(text.jaro_winkler("a", "b").alias("s")).collect()], [slow_jaro_winkler(a or "", b) for a, b in [*pairs[:500], (None, "a")]], atol=1e-12)


def test_rounds_send_no_table_through_the_driver(spark, capsys):
    """What rounds keep is met by sorting, however small its files are."""
    pairs = [(f"e{i:02}", f"e{i + 1:02}", i % 10 / 10, i % 7 == 0) for i in range(40)]
    given = spark.createDataFrame(pairs, AB + ", attribute double, boot boolean").withColumns({"floor": F.lit(0.6), "asserted": F.lit(0.0), "raised": F.lit(False), "counts": F.lit(True), "same_type": F.lit(True)})
    vetoes = spark.createDataFrame([("e01", "e03"), ("e07", "e09")], AB)
    got = fixpoint.resolve(given, spark.createDataFrame([("p", "e01", "e05", None)], "predicate string, subject string, object string, instance string"), vetoes)
    for df in (got.pairs, clustering.clusters(given.select("a", "b", F.col("attribute").alias("score")), vetoes)):
        df.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
