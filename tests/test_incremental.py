import datetime
import glob
import os
import random
import tempfile
import time

from pyspark.sql import functions as F

from attestra.operators import graph, incremental, view
from attestra.operators.incremental import LiveView

CLAIM = "claim_id string, element_id string, subject string, predicate string, object string, source_id string, event_date date, report_date date, kind string, decoy boolean, artifact string, fingerprint string, caption string, coordination string"
SOURCE = "source_id string, source_type string, bias string, origin string, denial boolean, coordinated boolean, aggregator_of string"


def claim(i, rnd):
    s, p, o = f"p{rnd.randrange(12)}", rnd.choice(["maintains", "supplies", "equips"]), f"r{rnd.randrange(3)}"
    day = datetime.date(2000, 1, 1) + datetime.timedelta(rnd.randrange(900))
    return (f"c{i:03}", f"e:{s}:{p}:{o}", s, p, o, f"s{rnd.randrange(8)}", rnd.choice([day, day, None]), day, "observation", rnd.random() < 0.1, None, rnd.choice([None, None, f"h{rnd.randrange(9)}"]), None, None)


def test_each_batch_gives_the_view_of_all_claims(spark):
    rnd = random.Random(31)
    rows = [claim(i, rnd) for i in range(160)] + [("c900", "e:p77:supplies:r1", "p77", "supplies", "r1", "s1", None, datetime.date(2001, 1, 1), "observation", False, None, None, None, None)]
    sources = spark.createDataFrame([(f"s{k}", ["overhead", "registry", "press", "customs"][k % 4], "operator" if k == 3 else "none", f"o{k % 5}" if k % 3 else None, k == 7, False, None) for k in range(8)], SOURCE)
    merges = spark.createDataFrame([("p3", "p2"), ("p5", "p4")], "member string, canonical string")
    few = lambda kept: kept.groupBy("element_id").agg((F.count("*") < 2).alias("insufficient"))
    frame = lambda some: spark.createDataFrame(some, CLAIM)
    live = LiveView.begin(frame(rows[:60] + rows[-1:]), sources, merges, few, ("maintains",))
    there, left = set(range(60)) | {160}, set()
    assert live.edges.where("source = 'p77'").count() == 1
    # the last batch only takes away; a claim that comes twice counts once, one that comes and goes never was
    for new, gone in (([*range(60, 90)], []), ([*range(90, 95), 3], [160]), ([*range(95, 150)], [1, 2, 96]), ([150], []), ([], [5, 60, 149])):
        live = live.advance(frame([rows[i] for i in new]) if new else frame([]), spark.createDataFrame([(rows[i][0],) for i in gone], "claim_id string"))
        left |= set(gone)
        there = (there | set(new)) - set(gone)
        whole = view.assessed_edges(view.canonical(frame([rows[i] for i in sorted(there)]), merges).select(live.log.columns), sources, few, ("maintains",))
        assert sorted(map(repr, live.edges.collect())) == sorted(map(repr, whole.select(live.edges.columns).collect()))
        assert live.total == whole.count() and (len(new) > 10 or 0 < live.touched < live.total)
    # what was retracted took its edge along
    assert live.edges.where("source = 'p77'").count() == 0 and {r.status for r in live.edges.collect()} > {"insufficient"}
    nodes = {r.id: r.type for r in live.nodes(spark.createDataFrame([("p2", "part", "two", 0), ("p3", "part", "three", 0)], "id string, type string, name string, n_claims long")).collect()}
    assert nodes["p2"] == "part" and "p3" not in nodes and nodes["r1"] == "unknown"


def test_a_batch_leaves_the_log_where_it_lies(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [claim(i, rnd) for i in range(40)]
    sources = spark.createDataFrame([(f"s{k}", "press", "none", None, False, False, None) for k in range(8)], SOURCE)
    merges = spark.createDataFrame([("p3", "p2")], "member string, canonical string")
    few = lambda kept: kept.groupBy("element_id").agg((F.count("*") < 2).alias("insufficient"))
    live = LiveView.begin(spark.createDataFrame(rows[:30], CLAIM), sources, merges, few, ("maintains",))
    plans = []
    for name in ("written", "placed"):
        keep = getattr(incremental, name)
        monkeypatch.setattr(incremental, name, lambda df, *more, keep=keep: plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")) or keep(df, *more))
    # a claim that is there already stays as it is, also when it comes again for another element
    again = (rows[0][0], "e:p88:supplies:r1", "p88", "supplies", "r1", *rows[0][5:])
    live = live.advance(spark.createDataFrame([*rows[30:], again], CLAIM), spark.createDataFrame([(rows[1][0],)], "claim_id string"))
    assert {r.claim_id for r in live.log.collect()} == {r[0] for r in rows} - {rows[1][0]} and live.log.count() == 39
    assert live.log.where("subject = 'p88'").isEmpty()
    # its ids don't go through a shuffle, only hashes of them
    (ids,) = [t for t in plans if "xxhash64" in t]
    assert not any("claim_id" in b for b in ids.split("\n\n") if ") Exchange\n" in b and "element_id" in b)


def test_tables_that_are_kept_leave_no_shuffled_files(spark):
    found = lambda: {f for f in glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data") if os.path.getsize(f)}
    before, plain = found(), spark.range(5000).repartition(3, "id")
    assert plain.count() == 5000 and found() - before
    before = found()
    for keep in (graph.written, lambda df: graph.placed(df, "k")):
        keep(spark.range(5000).select((F.col("id") % 700).alias("k"), F.col("id")).repartition(3, "id"))
    for _ in range(50):
        if not found() - before:
            break
        time.sleep(0.2)
    assert not found() - before
