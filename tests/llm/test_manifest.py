import hashlib
import random
import zlib

from pyspark.sql import functions as F

from attestra.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def slow(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of each row, by whole trees in memory."""
    groups = {}
    for r in rows:
        i, text, lang, source, n = r
        low = None if text is None or i is None or zlib.crc32(str(i).encode()) % 5 else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        head = said(i) + said(source) + said(lang) + said(n)
        groups.setdefault(source, []).append((i is not None, i or 0, h(head + said(text)), None if low is None else h(head + said(low)), i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for turn, s in enumerate(names):
        for k, (_, _, leaf, other, i) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            node, proof = other or leaf, ""
            for tree, at in ((trees[s], k), (top, turn)):
                for level in tree[:-1]:
                    run = level[at - at % 16 : at - at % 16 + 16]
                    a, b = "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
                    node, proof, at = h(a, node, b), proof + a + b, at // 16
            out.append((i, leaf, trees[s][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return out


def build(d):
    low = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return manifest.build(d, FIELDS, "source", ["doc_id"], other={"text": low})


def same(got, want):
    return sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_positions_are_those_of_a_postorder():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 4095, 4096, 4097, 5000):
        open_, log = {}, []

        def complete(level, number):
            log.append((level, number))
            if level == manifest.height(n):
                return
            open_[level] = open_.get(level, 0) + 1
            if (number + 1) % 16 == 0 or number + 1 == manifest.count_at(n, level):
                complete(level + 1, number // 16)

        for i in range(n):
            complete(0, i)
        assert [manifest.position(n, *x) for x in log] == list(range(len(log)))


def test_positions_as_columns(spark):
    n = 70_000
    rows = [(n, lv, k) for lv in range(manifest.height(n) + 1) for k in {0, 1, 15, 16, 17, manifest.count_at(n, lv) - 1} if k < manifest.count_at(n, lv)]
    rows += [(m, 0, m - 1) for m in (1, 16, 17, 256, 257, 4097)] + [(m, manifest.height(m), 0) for m in (1, 16, 17, 256, 257, 4097)]
    d = spark.createDataFrame(rows, "n long, level int, number long")
    got = d.select("n", "level", "number", manifest._places(F.col("n"), F.col("level"), F.col("number"), n).alias("p"), manifest._height(F.col("n")).alias("h")).collect()
    assert all(r.p == manifest.position(r.n, r.level, r.number) and r.h == manifest.height(r.n) for r in got)


def test_manifest(spark):
    rnd = random.Random(13)
    rows = [(i, "Some Text %d " % i * (i % 4) + "é", ["en", None][i % 2], "hot" if i % 3 == 0 else f"src{rnd.randrange(20)}", i if i % 5 else None) for i in range(2400)]
    rows += [(None, "No Id", "en", "hot", 3), (7, None, None, None, None), (8, "", "", "", 0), (30, rows[30][1], "en", "hot", None), *rows[30:33], *rows[30:33], (9_999, "Long é" * 60_000, "x", "alone", 1)]
    made = build(spark.createDataFrame(rows, SCHEMA).repartition(7))
    want = slow(rows)
    assert same(manifest.prove(made).collect(), want) and made.root.hex() == want[0][3]
    # each tree's log is whole, in order, and ends with its root
    log = made.log.orderBy("tree", "position").collect()
    for tree in {r.tree for r in log}:
        mine = [r for r in log if r.tree == tree]
        assert [r.position for r in mine] == list(range(len(mine))) and (mine[-1].level, mine[-1].number) == (manifest.height(mine[0].n), 0)
    assert sum(1 for r in want if not r[-1]) > 300


def test_a_tree_of_three_rounds(spark, monkeypatch):
    """Blocks of two nodes: many rounds of builders over few rows."""
    monkeypatch.setattr(manifest, "FANOUT", 2)
    monkeypatch.setattr(manifest, "STEP", 1)
    monkeypatch.setattr(manifest, "BLOCK", 2)
    made = build(spark.createDataFrame([(i, f"T{i}", "en", "a" if i < 21 else f"b{i % 3}", 1) for i in range(37)], SCHEMA))
    log = {(r.tree, r.level, r.number): bytes(r.digest).hex() for r in made.log.collect()}
    for (tree, level, number), d in log.items():
        if level:
            assert d == h(*[log[tree, level - 1, k] for k in (2 * number, 2 * number + 1) if (tree, level - 1, k) in log])


def test_one_row_one_source_and_none(spark):
    for rows in ([(1, "Aa", "en", "s", 2)], [(1, "Aa", None, None, 2), (2, "b", None, None, 1)], [(5, "A", "x", "s", 1), (11, "B", "x", "t", 1)]):
        assert same(manifest.prove(build(spark.createDataFrame(rows, SCHEMA))).collect(), slow(rows))
    none = build(spark.createDataFrame([], SCHEMA))
    assert manifest.prove(none).count() == 0 and none.root is None and none.log.count() == 0


def test_further_columns(spark):
    d = spark.createDataFrame([(1, "Aa", "en", "s", 2, "x", "y", 1)], SCHEMA + ", tree string, digest string, number int")
    assert same(manifest.prove(build(d)).collect(), slow([(1, "Aa", "en", "s", 2)]))
