"""Supply chains, on a small graph worked out by hand."""

from attestra.operators import analyses, graph

BAND = ("confirmed", "probable")
EDGES = [("e1", "based-at", "u1", "site1"), ("e2", "fields", "u1", "v1"), ("e3", "part-of", "c1", "v1"), ("e4", "makes", "m1", "c1"), ("e5", "builds", "m2", "v2"), ("e6", "part-of", "c2", "v2"), ("e7", "part-of", "c3", "v3"), ("e8", "based-at", "u3", "site3"), ("e9", "fields", "u3", "v3")]
LINKS = [("c1", "m1", "e4", "probable", 0.6), ("c1", "m9", "x1", "possible", 0.9), ("v1", "m8", "x2", "possible", 0.9), ("c2", "m7", "x3", "insufficient", None), ("v2", "m2", "e5", "confirmed", None), ("v2", "m6", "x4", None, 0.9)]


def test_supply_chains(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    subjects = frame([("site1", "basing_site"), ("v1", "variant"), ("site2", "basing_site"), ("site3", "basing_site"), ("site4", "basing_site"), ("v4", "variant"), ("site5", "basing_site")], "id string, type string")
    variants = frame([("site1", "v2", 0.4), ("site1", "v1", 0.5), ("site2", "v2", None), ("site3", "v3", 0.5), ("site5", "v5", 0.5)], "subject string, variant string, confidence double")
    pool = frame([("v1", "c1", 1), ("v1", "c0", 2), ("v2", "c2", 1), ("v3", "c3", 1), ("v5", "c5", 1)], "variant string, component string, place int")
    links = frame(LINKS, "part string, supplier string, id string, status string, confidence double")
    edges = frame(EDGES, "id string, type string, a string, b string")
    unmet = frame([("c5", "trade"), ("c5", "imagery"), ("c1", "trade")], "component string, slot string")
    got = {r.id: r for r in analyses.supply_chains(subjects, variants, pool, links, edges, BAND, unmet).collect()}
    said = {i: (r.verdict, r.variant, r.component, r.maker, r.maker_of, r.weighed, r.path_edges, r.missing) for i, r in got.items()}
    assert said == {
        "site1": ("traced", "v1", "c1", "m1", "c1", 1, ["e1", "e2", "e3", "e4"], []),
        "v1": ("traced", "v1", "c1", "m1", "c1", 1, ["e3", "e4"], []),
        # the component's link is below the band, so the variant's own maker is carried; the site hangs on nothing, the variant does
        "site2": ("partial", "v2", "c2", "m2", "v2", 2, ["e5"], ["path:site2->m2"]),
        # without a maker the chain ends with the component
        "site3": ("traced", "v3", "c3", None, None, 0, ["e8", "e9", "e7"], []),
        "site4": ("refused", None, None, None, None, None, None, ["variant"]),
        "v4": ("refused", "v4", None, None, None, 0, None, ["maker_or_component"]),
        "site5": ("refused", "v5", "c5", None, None, 0, None, ["imagery", "trade"]),
    }
    makers = analyses.variant_makers(frame([("v1",), ("v2",), ("v1",)], "variant string"), pool, links, BAND)
    weighed = {(r.variant, r.id) for r in analyses.weighed_links(makers, links, BAND).collect()}
    assert weighed == {("v1", "x1"), ("v2", "x3"), ("v2", "x4")}
    none = analyses.supply_chains(subjects, variants, pool, links, edges, (), unmet)
    assert {r.id: r.maker for r in none.collect()} == dict.fromkeys(said)
    assert analyses.supply_chains(subjects.where("false"), variants, pool, links, edges, BAND, unmet).count() == 0


def test_paths_move_numbers_of_steps_and_edges_three_times(spark, monkeypatch):
    moved = []

    def look(keep):
        def step(df, *more):
            text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            moved.extend(b for b in text.split("\n\n") if ") Exchange\n" in b)
            return keep(df, *more)

        return step

    monkeypatch.setattr(graph, "written", look(graph.written))
    monkeypatch.setattr(graph, "placed", look(graph.placed))
    edges = spark.createDataFrame([(f"e{i}", "t", f"n{i}", f"n{i + 1}") for i in range(4)] + [("f0", "a", "n0", "n1"), ("f9", "t", "n0", "n9")], "id string, type string, a string, b string")
    got = graph.shortest_paths(edges, spark.createDataFrame([("n0", "n4"), ("n4", "n0"), ("n0", "n3"), ("n9", "n4")], "src string, dst string"))
    assert {(r.src, r.dst): r.edges for r in got.collect()} == {("n0", "n4"): ["f0", "e1", "e2", "e3"], ("n4", "n0"): ["e3", "e2", "e1", "f0"], ("n0", "n3"): ["f0", "e1", "e2"]}
    # what a step is, its id and type, moves with the table of edges alone: to tell doubles, to number ways, to be taken
    assert sum("id#" in b and "dst#" not in b for b in moved) <= 3 and not any("id#" in b and "dst#" in b and "src#" not in b for b in moved)
