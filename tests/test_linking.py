import itertools
import math
import random

from attestra.functions import fuzzy
from attestra.operators import linking
from attestra.plans import catalogue
from attestra.plans import resolution_queries as resolution_queries


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: max(left, row[j], row[j - 1] + (b[j - 1] == c)), initial=0))
    return row[-1]


def plain(a, b):
    """The weighted ratio by its definition, windows and subsequences one by one."""
    ratio = lambda x, y: 200 * lcs(x, y) / (len(x) + len(y)) if x or y else 100.0

    def partial(x, y):
        s, t = sorted((x, y), key=len)
        return (0.0 if t else 100.0) if not s else max(ratio(s, t[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(t)))

    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    both, own, other = (" ".join(sorted(z)) for z in (x & y, x - y, y - x))
    ordered = [" ".join(sorted(z.split())) for z in (a, b)]
    tokens = 100.0 if both and not (own and other) else max(ratio(*ordered), ratio(f"{both} {own}".strip(), f"{both} {other}".strip()), *([ratio(both, f"{both} {own}".strip()), ratio(both, f"{both} {other}".strip())] if both else []))
    far = max(len(a), len(b)) / min(len(a), len(b))
    if far < 1.5:
        return max(ratio(a, b), 0.95 * tokens)
    scale = 0.9 if far < 8 else 0.6
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * (100.0 if both else max(partial(*ordered), partial(own, other))))


def test_weighted_ratio(spark):
    rnd = random.Random(6)
    names = ["", "a", "kx 9 p", "kx 9", "kx-9/p launcher of the army", "x" * 200, "ü 😀"] + [" ".join("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 6))) for _ in range(40)]
    for a, b in itertools.product(names, names):
        assert math.isclose(fuzzy.weighted(a, b), plain(a, b), abs_tol=1e-9), (a, b)
    d = spark.createDataFrame([("kx 9", "kx 9 p"), (None, "x"), ("kx 9", "kx 9 p")], "a string, b string")
    assert [round(r.s, 6) for r in d.select(fuzzy.weighted_ratio("a", "b").alias("s")).collect()] == [round(plain("kx 9", "kx 9 p"), 6), 0.0, round(plain("kx 9", "kx 9 p"), 6)]


SURFACES = [("n1", "variant", "KX-9/P", "name"), ("n1", "variant", "LM-2000", "alias"), ("n2", "variant", "KX-9BE", "name"), ("n3", "unit", "KX 9P", "alias"), ("n3", "unit", "Air Defence Army", "name"), ("n4", "unit", "air defence army", "name"), ("n5", "site", "", "alias"), ("n5", "site", "Eastmoor Barracks", "name")]


def find(spark, text, hint=None, vetoes=()):
    s = spark.createDataFrame(SURFACES, "id string, type string, surface string, kind string")
    v = spark.createDataFrame(list(vetoes), "a string, b string")
    return [tuple(r) for r in linking.find_entity(s, text, hint, v).orderBy("place").select("id", "tier", "resolution", "resolved").collect()]


def test_tiers_of_find_entity(spark):
    assert find(spark, " kx-9/p ") == [("n1", "exact", "exact", True)]
    assert find(spark, "lm2000") == [("n1", "squashed", "near", True)]
    assert find(spark, "AIR  defence army") == [("n3", "exact", "ambiguous", False), ("n4", "exact", "ambiguous", False)]
    assert find(spark, "KX9P") == [("n1", "squashed", "ambiguous", False), ("n3", "squashed", "ambiguous", False)]
    assert find(spark, "KX9P", "variant") == [("n1", "squashed", "near", True)]
    assert [r[:3] for r in find(spark, "Eastmoor Barrack")] == [("n5", "suggested", "near")] and not find(spark, "Eastmoor Barrack")[0][3]
    assert find(spark, "zzz") == [] and find(spark, "") == [] and find(spark, "KX-9/P", "site") == []
    assert find(spark, "kx-9/p", None, [("n1", "n2"), ("n3", "n1")]) == [("n1", "exact", "exact", True)]


def test_suggested_against_plain_code(spark):
    d = "/root/testdata/sf0.001"
    got = [tuple(r) for r in catalogue.QUERIES["find_entity_suggested"](spark, d).orderBy("place").select("id", "score", "tier").collect()]
    want = "smal rnig of brand 2"
    rows = [(r.id, " ".join(r.surface.lower().split())) for r in resolution_queries._surfaces(spark, d).collect()]
    docs = {s: s.split(" ") for _, s in rows}
    mean = sum(map(len, docs.values())) / len(docs)
    bm = {}
    for s, words in docs.items():
        for t in want.split(" "):
            df, tf = sum(t in w for w in docs.values()), words.count(t)
            bm[s] = bm.get(s, 0) + math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
    r, b, top = {}, {}, max(bm.values())
    for i, s in rows:
        r[i], b[i] = max(r.get(i, 0), plain(s, want)), max(b.get(i, 0), bm[s])
    blend = {i: 0.85 * r[i] + (15 * b[i] / top if top else 0) for i in r}
    best = sorted((i for i in blend if blend[i] >= 60), key=lambda i: (-round(blend[i], 6), i))[:3]
    assert [(i, t) for i, _, t in got] == [(i, "suggested") for i in best] and best and all(abs(s - blend[i]) < 1e-5 for i, s, _ in got)


def test_mentions_are_attached_minted_or_refused(spark):
    entities = [("var1", "variant", "KX-9/P", True), ("ent:unit:NHAD", "unit", "NHAD", False), ("c1", "component", "QR-233", True), ("ent:variant:QR-233", "variant", "QR-233", False), ("t1", "variant", "Twin", False), ("t2", "variant", "twin", False), ("u1", "unit", "Both", True), ("u2", "unit", "both", True), ("s1", "site", "BOTH", False)]
    e = spark.createDataFrame(entities, "id string, type string, name string, registered boolean")
    lanes = spark.createDataFrame([("equips", ["component"], ["variant"]), ("near", None, []), ("held-by", ["variant", "component"], ["unit"]), ("at", ["unit", "site"], ["site"])], "predicate string, from_types array<string>, to_types array<string>")
    edges = [("equips", "QR-233", "kx 9p"), ("held-by", "QR-233", "NHAD"), ("held-by", "Twin", "New Unit"), ("near", "Nobody", "Nothing"), ("at", "both", "both x"), ("at", "var1", "Both"), ("equips", "Odd", "x"), ("at", "y", "Odd"), ("held-by", "", "NHAD")]
    types = linking.endpoint_types(spark.createDataFrame(edges, "predicate string, subject string, object string"), lanes)
    got = {r.form: (r.implied, r.allowed) for r in types.collect()}
    assert got["QR-233"] == (["component"], ["component"]) and got["both"] == ([], ["site", "unit"]) and got["Odd"] == (["component", "site"], []) and "Nobody" not in got
    forms = types.unionByName(spark.createDataFrame([("Nobody", [], [])], types.schema))
    classes = spark.createDataFrame([("kx 9p", "h"), ("kx 9 p", "h")], "name string, root string")
    out = {r.form: (r.verdict, r.target, r.reason) for r in linking.link_mentions(forms, e, spark.createDataFrame([("t2", "t1"), ("var1", "c1"), ("gone", "t1")], "a string, b string"), classes).collect()}
    assert out == {
        "QR-233": ("attached", "c1", None),
        "kx 9p": ("minted", "ent:variant:kx 9p", None),
        "NHAD": ("attached", "ent:unit:NHAD", None),
        "Twin": ("refused", None, "veto-straddle"),
        "New Unit": ("minted", "ent:unit:New Unit", None),
        "both": ("refused", None, "types-contradict"),
        "Both": ("refused", None, "types-contradict"),
        "both x": ("minted", "ent:site:both x", None),
        "var1": ("known", "var1", None),
        "Odd": ("refused", None, "untyped"),
        "x": ("minted", "ent:variant:x", None),
        "y": ("refused", None, "untyped"),
        "": ("refused", None, "untyped"),
        "Nobody": ("refused", None, "untyped"),
    }
    assert [tuple(r) for r in linking.straddles(e, spark.createDataFrame([("t2", "t1"), ("var1", "c1")], "a string, b string")).collect()] == [("t1", "t2")]


def test_anchors_by_tier(spark):
    nodes = spark.createDataFrame([("n2", "unit", ["Old Name", None], 2), ("n1", "unit", ["NHAD", "old-name"], 1), ("n3", "site", ["NHAD"], 0)], "id string, type string, forms array<string>, ord int")
    registry = spark.createDataFrame([("unit_nhad", "unit", ["Nhad"]), ("site_x", "site", ["nowhere"]), ("n3", "unit", ["NHAD"])], "entity_id string, type string, forms array<string>")
    classes = spark.createDataFrame([("army", "a"), ("old name", "a")], "name string, root string")
    anchors = spark.createDataFrame([("n3",), ("unit_nhad",), ("site_x",), ("Army",), ("nhad",), ("",), ("n3",)], "anchor string")
    got = {r.anchor: (r.node, r.via) for r in linking.resolve_anchors(anchors, nodes, registry, classes).collect()}
    assert got == {"n3": ("n3", "literal"), "unit_nhad": ("n1", "registry-alias"), "site_x": (None, None), "Army": ("n1", "alias-class"), "nhad": ("n3", "alias-class"), "": (None, None)}
