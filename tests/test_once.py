"""Steps that meet their rows once: what they come to, and how often or with how many rows they go there."""

import math
import random

from attestra.functions import text
from attestra.operators import ingest, linking, resolve


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan()


def most_joined(df):
    """The most rows that a join of df came to; df has been run."""
    most, todo = 0, [plan(df)]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
        if "Join" in name and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
    return most


def test_pages_are_packed_without_a_call_for_each_document(spark):
    draw = random.Random(3)
    pages = [(doc, page, draw.choice((0, 10, 900, 30_000, 59_990, 70_000))) for doc in range(30) for page in range(1, draw.randrange(2, 40))]
    want = []
    for doc in range(30):
        window = count = chars = 0
        for page, n in sorted((p, n) for d, p, n in pages if d == doc):
            if count and (count >= 8 or chars + n > 60_000):
                window, count, chars = window + 1, 0, 0
            want.append((doc, page, window))
            count, chars = count + 1, chars + n
    draw.shuffle(pages)
    got = ingest.pack_windows(spark.createDataFrame(pages, "doc_id long, page int, n_chars int"))
    assert rows(got) == sorted(want, key=repr) and got.dtypes == [("doc_id", "bigint"), ("page", "int"), ("window", "int")]
    assert "InPandas" not in plan(got).toString()


def test_bm25_reads_tokens_once(spark, monkeypatch):
    docs, query = [(1, ["a", "b", "a"]), (2, ["c"]), (3, ["b", "c", "d", "d"]), (4, [])], ["a", "d", "zz", "a"]
    kept, keep = [], text.written
    monkeypatch.setattr(text, "written", lambda df: kept.append(df.columns) or keep(df))
    got = {r.id: r.score for r in text.bm25(spark.createDataFrame(docs, "id int, tokens array<string>"), query).collect()}
    want, mean = {}, sum(len(t) for _, t in docs) / len(docs)
    for i, t in docs:
        for q in query:
            df = sum(q in u for _, u in docs)
            want[i] = want.get(i, 0.0) + math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / mean))
    want = {i: s for i, s in want.items() if s > 0}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert kept == [["id", "size", "hits"]]


def test_anchors_meet_one_node_of_a_name(spark):
    nodes = spark.createDataFrame([(f"n{i}", "t", ["One Name"], -i) for i in range(300)], "id string, type string, forms array<string>, ord int")
    registry = spark.createDataFrame([(f"e{i}", "t", ["one name"]) for i in range(200)], "entity_id string, type string, forms array<string>")
    anchors = spark.createDataFrame([(f"e{i}",) for i in range(200)] + [("ONE" + " " * i + "NAME",) for i in range(1, 201)] + [("n7",), ("gone",)], "anchor string")
    classes = spark.createDataFrame([("one name", "1")], "name string, root string")
    got = linking.resolve_anchors(anchors, nodes, registry, classes)
    want = {f"e{i}": ("n299", "registry-alias") for i in range(200)} | {"ONE" + " " * i + "NAME": ("n299", "alias-class") for i in range(1, 201)} | {"n7": ("n7", "literal"), "gone": (None, None)}
    assert {r.anchor: (r.node, r.via) for r in got.collect()} == want
    assert most_joined(got) < 1_000


def test_neighbours_of_a_pair_meet_once(spark):
    edges = spark.createDataFrame([("at", "u", "x", "i"), ("at", "u", "y", "i")], "predicate string, subject string, object string, instance string")
    got = resolve.unmoved_neighbours(edges, spark.createDataFrame([("x", "y")], "a string, b string"))
    assert rows(got) == [("x", "y", True, 0, 0)]
    assert plan(got.hint("merge")).toString().count("Exchange hashpartitioning") <= 6
