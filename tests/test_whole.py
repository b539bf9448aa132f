"""Whole jobs: queries against brute force on small tables, where rows used to be left out."""

import datetime
import itertools
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from attestra.operators import resolve
from attestra.plans import catalogue


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def write(folder, **tables):
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")
    return str(folder)


def test_hamming_pairs(spark, tmp_path):
    rnd, signs = random.Random(7), []
    for _ in range(6):
        base = [rnd.random() > 0.5 for _ in range(64)]
        signs.append(base)
        signs += [[b ^ (i in flips) for i, b in enumerate(base)] for k in (0, 1, 6, 11, 12, 12, 13) for flips in [set(rnd.sample(range(64), k))]]
    # one change in the lowest bits, and 12 spread evenly
    signs += [[b ^ (i == 0) for i, b in enumerate(signs[0])], [b ^ (i % 5 == 0 and i < 60) for i, b in enumerate(signs[0])]]
    vectors = [[1.0 if b else -1.0 for b in s] for s in signs]
    d = write(tmp_path, embeddings={"vec_id": pa.array(range(len(signs)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([i % 3 for i in range(len(signs))], pa.int32())})
    far = {(i, j): sum(x != y for x, y in zip(signs[i], signs[j], strict=True)) for i, j in itertools.combinations(range(len(signs)), 2)}
    want = sorted([(*k, v) for k, v in far.items() if v <= 12], key=repr)
    assert max(w[2] for w in want) == 12 and rows(catalogue.hamming_pairs(spark, d)) == want


def star_tables(folder, seed=3, n_orders=60, n_parts=12, n_supp=7):
    """Small tables whose facts mostly stand on other lines than the first."""
    rnd, i64 = random.Random(seed), pa.int64()
    orders = range(1, n_orders + 1)
    lines = [(o, n, rnd.randrange(1, n_parts + 1), rnd.randrange(1, n_supp + 1)) for o in orders for n in range(1, rnd.randrange(1, 5))]
    t = {
        "nation": {"n_nationkey": pa.array(range(25), i64), "n_regionkey": pa.array([i % 5 for i in range(25)], i64)},
        "supplier": {"s_suppkey": pa.array(range(1, n_supp + 1), i64), "s_nationkey": pa.array([rnd.randrange(25) for _ in range(n_supp)], i64)},
        "customer": {"c_custkey": pa.array(range(1, 9), i64), "c_nationkey": pa.array([rnd.randrange(25) for _ in range(8)], i64)},
        "part": {"p_partkey": pa.array(range(1, n_parts + 1), i64), "p_size": pa.array([i % 4 + 1 for i in range(n_parts)], i64)},
        "orders": {"o_orderkey": pa.array(orders, i64), "o_custkey": pa.array([rnd.randrange(1, 9) for _ in orders], i64)},
        "lineitem": {k: pa.array([x[i] for x in lines], i64) for i, k in enumerate(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))},
    }
    return write(folder, **t), {k: {c: v.to_pylist() for c, v in x.items()} for k, x in t.items()}


def lookup(table, key, value):
    return dict(zip(table[key], table[value], strict=True))


def test_closure_counts(spark, tmp_path):
    d, t = star_tables(tmp_path, n_orders=8)
    nation, cust, supp = lookup(t["orders"], "o_orderkey", "o_custkey"), lookup(t["customer"], "c_custkey", "c_nationkey"), lookup(t["supplier"], "s_suppkey", "s_nationkey")
    deps = {(cust[nation[o]], supp[s]) for o, s in zip(t["lineitem"]["l_orderkey"], t["lineitem"]["l_suppkey"], strict=True)}
    want = []
    for n in range(25):
        seen = {n} if any(n in x for x in deps) else set()
        while more := {b for a, b in deps if a in seen} - seen:
            seen |= more
        want.append((f"n{n}", sum(x % 3 == 0 for x in seen)))
    assert rows(catalogue.closure_counts(spark, d)) == sorted(want, key=repr)


def test_graph_queries(spark, tmp_path):
    d, t = star_tables(tmp_path, n_orders=40, n_parts=30, n_supp=9)
    edges = {(f"loc:{n}", "located-in", f"n{n}", f"r{r}") for n, r in lookup(t["nation"], "n_nationkey", "n_regionkey").items()}
    edges |= {(f"sup:{s}", "based-in", f"s{s}", f"n{n}") for s, n in lookup(t["supplier"], "s_suppkey", "s_nationkey").items()}
    edges |= {(f"del:{p}:{s}", "delivers", f"s{s}", f"p{p}") for p, s in zip(t["lineitem"]["l_partkey"], t["lineitem"]["l_suppkey"], strict=True)}
    near = {}
    for _, _, a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    reached = {"r1": 0}
    for k in (1, 2, 3):
        reached |= {y: k for x in list(reached) for y in near[x] if y not in reached}
    assert rows(catalogue.k_hop_reach(spark, d)) == sorted(reached.items(), key=repr)
    kept = {x for x in reached if not x.startswith("n")}
    assert rows(catalogue.lens_scope(spark, d)) == sorted((e for e in edges if e[2] in kept and e[3] in kept), key=repr)
    # the first path by its edges' ids: delivered, based in, located in
    routes = {}
    for e1, _, s, p in (e for e in edges if e[1] == "delivers"):
        for e2, _, _, n in (e for e in edges if e[1] == "based-in" and e[2] == s):
            for e3, _, _, r in (e for e in edges if e[1] == "located-in" and e[2] == n):
                if r == f"r{int(p[1:]) % 5}":
                    routes.setdefault((p, r), []).append(((e1, e2, e3), f"{p}>{s}>{n}>{r}"))
    assert len(routes) > 5 and rows(catalogue.shortest_path(spark, d)) == sorted(((*k, 3, min(v)[1]) for k, v in routes.items()), key=repr)


def test_replay_and_supersession(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    claims = sorted((r.report_date, r.claim_id) for r in catalogue.claims_scan(spark, d).select("report_date", "claim_id").collect())
    assert rows(catalogue.claims_replay_order(spark, d)) == sorted(((c, i) for i, (_, c) in enumerate(claims, 1)), key=repr)
    day = lambda n: datetime.datetime(2024, 1, n)
    events = [(1, "a", 1, 90.0), (1, "a", 3, 50.0), (1, "b", 5, 60.0), (1, "b", 6, 10.0), (1, "c", 9, 5.0), (2, "a", 2, 20.0)]
    columns = {"event_id": pa.array(range(len(events)), pa.int64()), "user_id": pa.array([e[0] for e in events], pa.int64()), "event_type": [e[1] for e in events], "ts": pa.array([day(e[2]) for e in events], pa.timestamp("us")), "value": [e[3] for e in events]}
    d = write(tmp_path, events=columns)
    got = {(r.instance, r.target): (r.lo.day, r.hi.day, r.newest, r.relation) for r in catalogue.supersede_relations(spark, d).collect()}
    assert got == {("u1:202401", "a"): (1, 3, "c", "ordered"), ("u1:202401", "b"): (5, 6, "c", "ordered"), ("u1:202401", "c"): (9, 9, "c", "newest"), ("u2:202401", "a"): (2, 2, None, "single")}
    assert rows(catalogue.supersede_promote(spark, d).select("instance", "target", "newest", "newest_confidence", "verdict")) == [("u1", "a", "c", 0.05, "held"), ("u1", "b", "c", 0.05, "held")]


def test_identifier_conflicts_once_and_in_tiles(spark):
    rnd = random.Random(11)
    ents = [(f"p{i}", "t" if i % 3 else "u", f"n{i % 2}", f"x{rnd.randrange(4)}") for i in range(300)]
    ents += [("p1", "t", "n1", "x0"), ("p1", "t", "n1", "x1"), ("p1", "t", "n1", "x1"), ("p5", "t", "n1", None), ("q", None, "n1", "x9"), ("r", None, "n1", "x8")]
    want = {(a[0], b[0]) for a in ents for b in ents if a[0] < b[0] and None not in (a[1], a[3], b[1], b[3]) and a[1:3] == b[1:3] and a[3] != b[3]}
    got = resolve.identifier_conflicts(spark.createDataFrame(ents, "id string, type string, name string, ident string"), block=20, tiles=2)
    assert rows(got) == sorted(want, key=repr)
    # four groups of some 100 and 50 rows in blocks of 20: more tasks than cores, and none of them has a group's pairs alone
    each = sorted(n for _, n in got.groupBy(F.spark_partition_id()).count().collect())
    assert len(each) > 8 and each[-1] < len(want) / 4


def test_sign_pairs_of_copies_and_frequent_bands(spark):
    """Many values of the same bands and many ids of one value, dealt over tasks: each pair once, whatever the number of bands."""
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(3)]
    values = [base[i % 3] ^ sum(1 << b for b in rnd.sample(range(64), i % 9)) for i in range(150)] + [base[0]] * 60 + [~base[0] & (2**64 - 1)]
    values = [v - 2**64 if v >> 63 else v for v in values]
    signs = spark.createDataFrame(list(enumerate(values)), "vec_id long, signs long").repartition(1)
    far = {(i, j): ((x ^ y) & (2**64 - 1)).bit_count() for (i, x), (j, y) in itertools.combinations(enumerate(values), 2)}
    want = sorted([(*k, v) for k, v in far.items() if v <= 12], key=repr)
    for bands in (4, 7):
        assert rows(resolve.sign_pairs(signs, 12, bands, block=10, work=10**5)) == want
    got = resolve.sign_pairs(signs, 12, block=10, work=3000)
    assert rows(got) == want
    each = sorted(n for _, n in got.groupBy(F.spark_partition_id()).count().collect())
    assert len(each) > 8 and each[-1] < len(want) / 3
    assert rows(resolve.sign_pairs(signs, 0, block=50)) == sorted([(*k, v) for k, v in far.items() if v == 0], key=repr)
