import random

import pytest
from pyspark.sql import functions as F

from attestra.config import DEFAULT, StaleVersion
from attestra.functions import dates, geo, text
from attestra.operators import assessment, filters, graph, materiality, monitor, query, resolve, supersede


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_settings_refuse_stale_version():
    new = DEFAULT.updated(1, probable=0.4, half_lives={"x": 1.0})
    assert (new.version, new.probable, new.half_lives["x"]) == (2, 0.4, 1.0)
    with pytest.raises(StaleVersion):
        new.updated(1, probable=0.3)


def test_components_and_reach(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "a")], "a string, b string")
    assert rows(graph.components(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.reach(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string"), seeds, 2)) == [("a", 0), ("b", 1), ("c", 2)]


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "a string, b string")
    assert rows(graph.closure(e)) == sorted([("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "a"), ("b", "c"), ("c", "c")], key=repr)


def test_shortest_path_takes_first_of_equal(spark):
    e = spark.createDataFrame([("e2", "t", "a", "b"), ("e1", "t", "a", "c"), ("e3", "t", "b", "d"), ("e4", "t", "c", "d")], "id string, type string, a string, b string")
    p = spark.createDataFrame([("a", "d")], "src string, dst string")
    assert [(r.hops, r.edges) for r in graph.shortest_paths(e, p).collect()] == [(2, ["e1", "e4"])]


def test_shortest_paths_are_the_first_of_all(spark):
    draw = random.Random(5)
    e = [(f"e{i}", draw.choice("tu"), f"n{draw.randrange(24)}", f"n{draw.randrange(24)}") for i in range(34)]
    nodes = [f"n{i}" for i in range(24)]
    want = {}
    for src in nodes:
        paths = [((), (src,))]
        for k in range(1, 5):
            paths = [(keys + ((t, i),), walk + (y,)) for keys, walk in paths for i, t, a, b in e for x, y in ((a, b), (b, a)) if x == walk[-1] and y not in walk]
            for keys, walk in sorted(paths):
                want.setdefault((src, walk[-1]), (k, list(walk), [i for _, i in keys]))
    edges = spark.createDataFrame(e, "id string, type string, a string, b string")
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "src string, dst string")
    for hops in (1, 2, 3, 4):
        got = {(r.src, r.dst): (r.hops, r.nodes, r.edges) for r in graph.shortest_paths(edges, pairs, hops).collect()}
        assert got == {p: w for p, w in want.items() if w[0] <= hops}
    assert {w[0] for w in want.values()} == {1, 2, 3, 4}


def test_shortest_paths_look_no_further_than_asked(spark, monkeypatch):
    # one step away, while 400 nodes lie three steps away
    e = [("e", "t", "a", "b"), *[(f"f{i}", "t", "a", f"c{i}") for i in range(2)], *[(f"g{i}:{j}", "t", f"c{i}", f"d{i}:{j}") for i in range(2) for j in range(200)], *[(f"h{i}:{j}", "t", f"d{i}:{j}", f"x{i}:{j}") for i in range(2) for j in range(200)]]
    kept = []
    for name in ("written", "checkpointed"):
        keep = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda df, keep=keep: kept.append(out := keep(df)) or out)
    got = graph.shortest_paths(spark.createDataFrame(e, "id string, type string, a string, b string"), spark.createDataFrame([("a", "b")], "src string, dst string"))
    assert rows(got) == [("a", "b", 1, ["a", "b"], ["e"])]
    assert sum(df.where("dst is not null").count() for df in kept if "dst" in df.columns) < 100


def test_independence_groups(spark):
    c = spark.createDataFrame(
        [("e", "c1", "s1", "o1", None, "none", None, False), ("e", "c2", "s2", "o1", "h", "none", None, False), ("e", "c3", "s3", None, "h", "none", None, False), ("e", "c4", "s4", None, None, "none", None, False), ("e", "c5", "s5", None, None, "none", None, True)],
        "element_id string, claim_id string, source_id string, origin string, fingerprint string, bias string, aggregator_of string, denial boolean",
    )
    assert rows(assessment.independence_groups(c)) == [("e", "c1", "grp:c1"), ("e", "c2", "grp:c1"), ("e", "c3", "grp:c1"), ("e", "c4", "grp:c4")]


def test_status_ladder(spark):
    names = "confidence double, effective_looks double, aging boolean, stale boolean, superseded boolean, insufficient boolean, contradicted boolean, capped boolean, gated_unknown boolean, denied boolean, decoy_risk boolean"
    n = [False] * 9
    cases = [((0.9, 2.0, *n), "confirmed"), ((0.9, 1.0, *n), "probable"), ((0.9, 2.0, True, *n[1:]), "probable"), ((0.9, 2.0, True, True, *n[2:]), "stale"), ((0.2, 3.0, *n), "possible"), ((0.9, 2.0, False, False, True, *n[3:]), "stale"), ((0.9, 2.0, False, False, False, True, True, *n[5:]), "insufficient")]
    for values, want in cases:
        assert spark.createDataFrame([values], names).select(assessment.status()[0].alias("s")).first().s == want


def test_supersede_relations(spark):
    c = spark.createDataFrame([("i", "a", "c1", "2024-01-01", "2024-01-02"), ("i", "b", "c2", "2024-01-05", "2024-01-05"), ("j", "a", "c3", None, None), ("j", "b", "c4", "2024-01-01", "2024-01-01")], "instance string, target string, claim_id string, lo string, hi string")
    got = {(r.instance, r.target): r.relation for r in supersede.nominate(supersede.target_intervals(c.withColumns({x: F.to_date(x) for x in ("lo", "hi")}))).collect()}
    assert got == {("i", "a"): "ordered", ("i", "b"): "newest", ("j", "a"): "undated", ("j", "b"): "undated"}


def test_three_valued_constraints(spark):
    df = spark.createDataFrame([("5",), ("UNKNOWN",), (None,), ("x",)], "v string")
    assert [r.r for r in df.select(filters.constraint(F.col("v"), ">", 3).alias("r")).collect()] == ["match", "indeterminate", "indeterminate", "excluded"]
    assert [r.r for r in df.select(filters.constraint(F.col("v"), "exists", None).alias("r")).collect()] == ["match", "excluded", "excluded", "match"]


def test_alerts(spark):
    v = "wire string, state string, claim_ids array<string>"
    before, after = spark.createDataFrame([("w", "a", ["1"]), ("x", None, ["2"])], v), spark.createDataFrame([("w", "b", ["3"]), ("x", "b", ["4"]), ("y", "b", ["5"])], v)
    assert rows(monitor.evaluate(before, after, {"state_field": "state"})) == [("w", "a", "b", ["1", "3"])]
    assert rows(monitor.appearances(before, after)) == [("y", "b", ["5"])]
    assert monitor.evaluate(None, after, {"mode": "exists"}).count() == 0
    assert monitor.evaluate(before, after, {"mode": "exists", "where_before": {}}).count() == 1


def test_sole_source_and_clusters(spark):
    s = spark.createDataFrame([("e1", "d", "s1", "t", None, False), ("e2", "d", "s1", "u", None, False), ("e3", "d", "s2", "u", None, False)], "id string, dependent string, supplier string, type string, role string, inferred boolean")
    assert [(r.dependent, r.type, r.supplier) for r in materiality.sole_sources(s).collect()] == [("d", "t", "s1")]
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("x", "y", 0.7)], "a string, b string, score double")
    veto = spark.createDataFrame([("a", "c")], "a string, b string")
    assert rows(resolve.clusters(pairs, veto)) == [("a", "a"), ("b", "a"), ("c", "c"), ("x", "x"), ("y", "x")]


def test_functions(spark):
    df = spark.createDataFrame([("2024-11-31", "Q2 2023", "3 days ago")], "a string, b string, c string")
    r = df.select(dates.clamp_iso(F.col("a")).alias("a"), dates.label_bounds(F.col("b")).alias("b"), dates.bounds(F.col("c"), F.to_date(F.lit("2024-03-10"))).alias("c")).first()
    assert (str(r.a), str(r.b.lo), str(r.b.hi), str(r.c.lo)) == ("2024-11-30", "2023-04-01", "2023-06-30", "2024-03-07")
    d = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("h"), geo.geodesic_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("g"), text.name_similarity(F.lit("fd 2000"), F.lit("ft 2000")).alias("j"), geo.hex_hamming(F.lit("ff00ff00ff00ff00"), F.lit("ff00ff00ff00ff0f")).alias("x")).first()
    assert abs(d.h - 111.195) < 0.01 and abs(d.g - 111.319) < 0.01 and abs(d.j - 0.942857) < 1e-5 and d.x == 4


def test_answers():
    assert query.check_answer(["two of 3 [c1]", "none"], {"c1"}, {3}) == [(1, "uncited")]
    assert query.check_answer(["x [c9] 7"], {"c1"}, {3}) == [(0, "unknown claim c9"), (0, "count 7 is not among those found")]
