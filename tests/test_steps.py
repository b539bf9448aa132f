"""How the steps that many queries share move their rows."""

import datetime

from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from attestra.operators import assessment, credibility, filters, graph
from attestra.plans import catalogue
from attestra.sources import star

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df, spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return [line for line in plan(df.select("*")).splitlines() if "Exchange hashpartitioning" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_claims_move_once_by_order(spark):
    moved = shuffles(star.claims(spark, SF), spark)
    assert len(moved) == 4 and not any("claim_id" in line for line in moved)  # orders and customers, then orders and line items


def test_standing_moves_once_more_by_element(spark):
    moved = shuffles(star.standing(spark, SF), spark)
    assert not any("(claim_id" in line for line in moved)
    assert sum("element_id" in line.split("ENSURE")[0] for line in moved) == 1


def test_claims_move_by_element_without_their_ids(spark):
    for name in ("sufficiency_slots", "sufficiency_any", "gate_flags", "freshness_decay", "retraction_filter"):
        got = catalogue.QUERIES[name](spark, SF)
        text = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
        (moved,) = [b for b in text.split("\n\n") if ") Exchange\n" in b and "Arguments: hashpartitioning(element_id" in b]
        assert "l_orderkey" in moved and "claim_id" not in moved, name


def test_standing_leaves_what_the_lists_leave(spark):
    log = star.claims(spark, SF)
    want = filters.drop_excluded(filters.drop_retracted(log, star.retractions(log)), star.exclusions(spark, SF, log))
    got = star.standing(spark, SF)
    assert got.columns == log.columns
    rows = lambda df: sorted(map(repr, df.select(log.columns).collect()))
    assert 0 < len(rows(got)) < log.count() and rows(got) == rows(want)


def test_excluded_where_any_row_of_an_order_is(spark, tmp_path):
    for name in ("lineitem", "orders", "customer", "nation"):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "orders":
            # an order's second row has another priority
            t = t.unionByName(t.where("o_orderkey % 20 = 0").withColumn("o_orderpriority", F.lit("1-URGENT")))
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = star.standing(spark, str(tmp_path))
    assert got.where("orderkey % 20 = 0").isEmpty() and got.count() > 0
    assert star.claims(spark, str(tmp_path)).count() == star.claims(spark, SF).count()


def test_claims_without_an_image_are_no_join(spark):
    day = datetime.date(2001, 1, 1)
    rows = [Row(claim_id=f"c{i}", fingerprint=f"h{i // 2}" if i < 4 else None, event_date=day) for i in range(400)]
    c = spark.createDataFrame(rows, "claim_id string, fingerprint string, event_date date").repartition(8)
    got = credibility.recycled(c)
    assert {r.claim_id: r.first_seen for r in got.where("fingerprint is not null").collect()} == {"c0": "original", "c1": "recycled", "c2": "original", "c3": "recycled"}
    assert got.count() == 400 and got.where("first_seen is not null").count() == 4
    # under one null they would all land in one partition of the join
    most = got.where("fingerprint is null").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 200


def test_freshness_reads_claims_once(spark):
    assert sum("Scan parquet" in line and "lineitem" in line for line in plan(credibility.element_freshness(star.standing(spark, SF))).splitlines()) == 1


def test_groups_of_large_elements_are_the_same(spark, monkeypatch):
    rows = []
    for e in range(3):
        # a chain of images through the whole element, another of origins, and lone claims
        for i in range(60):
            image = f"i{i // 2}" if i < 20 else None
            origin = f"o{(i + 1) // 2}" if i < 20 else f"lone{i % 15}"
            rows.append(Row(element_id=f"e{e}", claim_id=f"c{i:02}", source_id="s", origin=origin, fingerprint=image, bias=None, aggregator_of=None, denial=False))
    c = spark.createDataFrame(rows, "element_id string, claim_id string, source_id string, origin string, fingerprint string, bias string, aggregator_of string, denial boolean")
    premises = spark.createDataFrame([("c40", "c00"), ("c41", "c42")], "claim_id string, premise string")
    for p in (None, premises):
        small = sorted(map(tuple, assessment.independence_groups(c, premises=p).collect()))
        monkeypatch.setattr(assessment, "LARGE_ELEMENT", 1)
        assert sorted(map(tuple, assessment.independence_groups(c, premises=p).collect())) == small
        monkeypatch.undo()
        by = {(e, k): g for e, k, g in small}
        assert len(by) == 180 and {by["e0", f"c{i:02}"] for i in range(20)} == {"grp:c00"} and by["e1", "c35"] == by["e1", "c50"] == "grp:c20"
        assert (by["e2", "c40"] == "grp:c00") == (p is not None)


def test_groups_of_small_elements_take_no_rounds(spark):
    c = spark.createDataFrame([("e", f"c{i}", "s", "o", None, None, None, False) for i in range(4)], "element_id string, claim_id string, source_id string, origin string, fingerprint string, bias string, aggregator_of string, denial boolean")
    got = assessment.independence_groups(c)
    # nothing was kept on the way: the plan begins with the claims
    assert "Scan ExistingRDD" in plan(got) and "Window" not in plan(got) and got.count() == 4


def moves(df, spark):
    """The shuffles in the plan of df, each with its columns."""
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [b for b in text.split("\n\n") if ") Exchange\n" in b]


def test_what_is_placed_is_not_moved_again(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("string").alias("k"), "id")
    got = graph.placed(df, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    n = got.groupBy("k").agg(F.count("*").alias("n"))
    assert not moves(got.join(n, "k").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("id"))), spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("placed")]


def test_claims_are_first_where_they_lie(spark):
    day = datetime.date(2001, 1, 1)
    c = spark.createDataFrame([(f"c{i}", f"e{i % 7}", f"h{i // 3}" if i < 30 else None, None if i % 3 == 0 else day) for i in range(90)], "claim_id string, element_id string, fingerprint string, event_date date")
    want = sorted(map(tuple, credibility.recycled(c).select("claim_id", "first_seen").collect()))
    got = credibility.recycled(graph.placed(c, "element_id"), by="element_id")
    assert sorted(map(tuple, got.select("claim_id", "first_seen").collect())) == want
    assert sum(s == "original" for _, s in want) == 10 and sum(s == "recycled" for _, s in want) == 20


def test_status_leaves_claims_where_they_met(spark):
    # only the first claims of images go to the others
    moved = moves(catalogue.QUERIES["status_machine"](spark, SF), spark)
    assert sum("hashpartitioning(element_id" in b for b in moved) == 1 and sum("hashpartitioning(fingerprint" in b for b in moved) == 1 == len(moved) - 1


def test_groups_and_evidence_leave_claims_where_they_met(spark):
    assert not moves(catalogue.QUERIES["independence_groups"](spark, SF), spark)
    assert not moves(catalogue.QUERIES["evidence_drawer"](spark, SF), spark)
