"""Views and analyses on small tables, by hand."""

import datetime

from pyspark.sql import functions as F

from attestra.functions import marks
from attestra.operators import analyses, view
from attestra.plans import view_queries
from attestra.sources import star

D = datetime.date


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ends_provenance_and_undecided_pairs(spark):
    nodes = spark.createDataFrame([("p1", "part", "Ring", 2)], "id string, type string, name string, n_claims long")
    edges = spark.createDataFrame([("p1", "ent:unit:1:st", 3), ("x", "p1", 1), ("ent:unit:", "x", 1)], "source string, target string, n_claims long")
    got = view.with_ends(nodes, edges)
    assert rows(got) == [("ent:unit:", "unknown", "ent:unit:", 1), ("ent:unit:1:st", "unknown", "1:st", 3), ("p1", "part", "Ring", 2), ("x", "unknown", "x", 2)]
    merges = spark.createDataFrame([("p9", "p1", 0.9), ("p3", "p1", None), ("q", "gone", 1.0)], "member string, canonical string, confidence double")
    of = {r.id: r.resolved_from for r in view.merge_provenance(got, merges).collect()}
    assert [tuple(m) for m in of["p1"]] == [("p3", None), ("p9", 0.9)] and of["x"] is None
    pairs = spark.createDataFrame([("x", "p1", "same-as", 0.7), ("p1", "x", "same-as", 0.7), ("p1", "missing", "distinct-from", None)], "a string, b string, type string, merge_confidence double")
    assert [r.id for r in view.resolution_edges(got, pairs).collect()] == ["same-as:p1|x"]


def test_canonical_ends_and_identity_lanes(spark):
    c = spark.createDataFrame([("c1", "e:a:made-by:b", "a", "made-by", "b"), ("c2", "e:a:same-as:b", "a", "same-as", "b")], "claim_id string, element_id string, subject string, predicate string, object string")
    merges = spark.createDataFrame([("b", "a")], "member string, canonical string")
    assert rows(view.canonical(view.drawn(c), merges)) == [("c1", "e:a:made-by:a", "a", "made-by", "a")]
    key = view.edge_instance(F.col("subject"), F.col("predicate"), F.col("object"), ("made-by",))
    assert rows(c.select(key)) == [("edge:a:made-by",), ("edge:a:same-as:b",)]


def test_status_diff_and_days(spark):
    s = lambda *x: spark.createDataFrame(list(x), "id string, status string")
    assert rows(view.status_diff(s(("a", "x"), ("b", "x"), ("c", None)), s(("a", "y"), ("c", None), ("d", "x")))) == [("a", "x", "y", "changed"), ("b", "x", None, "gone"), ("d", None, "x", "new")]
    c = spark.createDataFrame([("e", "c1", "llm", "d1", D(2020, 1, 1)), ("e", "c2", "vlm", "d1", None), ("f", "c3", "vlm", "d2", None), ("e", "c4", "llm", "d3", D(2020, 1, 1))], "element_id string, claim_id string, method string, doc string, event_date date")
    assert rows(view.best_dated(c)) == [("e", "c4", D(2020, 1, 1)), ("f", "c3", None)]
    assert {r.claim_id: (r.event_date, r.inherited) for r in view.inherit_day(c).collect()} == {"c1": (D(2020, 1, 1), False), "c2": (D(2020, 1, 1), True), "c3": (None, False), "c4": (D(2020, 1, 1), False)}
    empty = c.limit(0).withColumn("report_date", F.lit(None).cast("date"))
    assert view.effective_day(empty, None).first().as_of is None and view.effective_day(empty, "2020-02-03").first().as_of == D(2020, 2, 3)


def test_links_below_the_band_are_weighed(spark):
    links = spark.createDataFrame([("p", "s1", "l1", "insufficient", 0.9), ("p", "s3", "l3", "probable", 0.5), ("p", "s2", "l2", "probable", 0.5), ("q", "s1", "l4", "possible", None), ("r", "s1", "l5", None, 1.0)], "part string, supplier string, id string, status string, confidence double")
    assert rows(analyses.best_links(links, ("confirmed", "probable"))) == [("p", "s2", "l2", "probable", 1), ("q", None, None, None, 1), ("r", None, None, None, 1)]
    assert all(r.supplier is None for r in analyses.best_links(links, ()).collect())
    none = spark.createDataFrame([("s1", "none")], "node string, chokepoint string")
    states = spark.createDataFrame([("s1", "unknown")], "node string, state string")
    assert rows(analyses.sole_source_split(none, states, none.select("node"))) == [(None, "insufficient")]
    nodes = spark.createDataFrame([("a",)], "id string")
    edges = spark.createDataFrame([], "id string, type string, source string, target string")
    assert rows(analyses.node_card(nodes, edges, "a")) == [("a", 0, 0)] and not rows(analyses.node_card(nodes, edges, "b"))


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    n = F.lit(None).cast("string")
    assert [one(marks.states_vacancy(F.lit(p), w)) for p, w in (("negative", n), ("positive", n), ("positive", F.lit(" ")), ("positive", F.lit("Dormant")), ("positive", F.lit("DEPLOYED")))] == [True, False, False, True, False]
    assert [one(marks.may_corroborate(F.lit(1), F.lit(w), r, f)) for w, r, f in (("active", n, n), ("active", F.lit("Insufficient"), n), ("active", n, F.lit("oblique")), ("vacant", n, n))] == [True, False, False, False]
    assert one(marks.event_type(n, n, n, n, n)) is None and one(marks.event_type(F.lit("parade"), F.lit("x"), n, n, n)) == "SightingEvent"
    assert one(marks.quote_supported(F.lit("a  b"), F.lit("x a\nb y"))) and not one(marks.quote_supported(F.lit(" "), F.lit("x")))
    assert [one(marks.dots(F.lit(x).cast("double"))) for x in (None, 0.2, 0.25, 0.5, 0.75)] == [2, 1, 2, 3, 4]
    assert [tuple(r) for r in [one(marks.count_range(F.lit(2), F.lit(5), F.lit(x))) for x in (True, False)]] == [(None, None), (2, 5)]


def test_rebuild_keeps_what_is_read_again_and_no_lists_of_claims(spark, monkeypatch):
    kept, keep = [], view.written
    monkeypatch.setattr(view, "written", lambda df: kept.append(df.columns) or keep(df))
    assert view_queries.rebuild(spark, "/root/testdata/sf0.001").count() > 0
    # merges and sources met claims by guessed sizes before, and lists of claims moved with intervals
    assert ["member", "canonical", "confidence"] in kept and any("grade" in c for c in kept)
    assert any("relation" in c for c in kept) and not any("claim_ids" in c for c in kept)


def test_standing_claims_with_merged_ends_move_by_element_once(spark):
    sf = "/root/testdata/sf0.001"
    merges = view.written(view_queries._merges(star.table(spark, sf, "part")))
    got = star.standing_placed(spark, sf, merges)
    want = view.canonical(star.standing(spark, sf), merges)
    assert got.columns == want.columns and rows(got) == rows(want)
    # retractions take back a claim of the element as it was stated, not of all that it was merged with
    assert got.count() > star.standing_placed(spark, sf).join(merges.select(F.col("member").alias("subject")), "subject", "left_anti").count()


def test_edges_are_assessed_where_their_claims_lie(spark, monkeypatch):
    moved = []

    def look(keep):
        def step(df, *more):
            text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            moved.extend(b for b in text.split("\n\n") if ") Exchange\n" in b)
            return keep(df, *more)

        return step

    monkeypatch.setattr(view, "written", look(view.written))
    monkeypatch.setattr(view, "placed", look(view.placed))
    assert not view_queries.rebuild_nodes(spark, "/root/testdata/sf0.001").isEmpty()
    # rows of elements and the first claims of images move, claims do not
    assert moved and not any("event_date" in b and "fingerprint" not in b or "source_id#" in b and "s_nationkey" not in b for b in moved)
