"""Attribution candidates by plain code, with a site and a unit that hold most claims."""

import random

from attestra.operators import attribution


def plain(sites, shapes, premises, presence, hops, marks):
    out = {}
    for site in sites:
        row = (site, None, None, None, None, None, None)
        looks = sorted((o, c) for s, c, o in shapes if s == site)
        step = lambda node: min(((o, v) for n, v, o in hops if n == node), default=(0, None))[1]
        named = sorted((o, c, other if kind == "variant" else step(other)) for s, other, kind, c, o in presence if s == site)
        named = [x for x in named if x[2]]
        if not looks:
            out[site] = (site, "no-shape-observation", *row[2:])
        elif looks[0][1] in premises:
            out[site] = (site, "already-attributed", *row[2:])
        elif not named:
            out[site] = (site, "no-textual-variant", *row[2:])
        else:
            _, textual, v = named[0]
            held = [(0, 0, o, c, g.strip()) for h, c, g, o in marks if h == v and (g or "").strip()]
            held += [(1, at, o, c, g.strip()) for n, w, at in hops if w == v for h, c, g, o in marks if h == n and (g or "").strip()]
            if not held or min(held)[3] == textual:
                out[site] = (site, "no-fingerprint", *row[2:])
            else:
                out[site] = (site, "candidate", v, looks[0][1], textual, min(held)[3], min(held)[4])
    return out


def test_attribution_candidates(spark):
    rnd = random.Random(3)
    sites = [f"s{i}" for i in range(40)]
    hot = lambda names: rnd.choice(names) if rnd.random() < 0.6 else names[0]
    shapes = [(hot(sites), f"o{i}", rnd.randrange(5)) for i in range(90)]
    premises = [f"o{i}" for i in range(0, 90, 4)] * 2
    variants, units = [f"v{i}" for i in range(12)], [f"u{i}" for i in range(6)]
    hops = [(hot(units), rnd.choice(variants), rnd.randrange(3)) for _ in range(20)]
    presence = [(hot(sites), *rnd.choice([(rnd.choice(variants), "variant"), (rnd.choice(units), "unit"), ("x", "unit")]), f"t{i}", rnd.randrange(9)) for i in range(90)]
    marks = [(hot(rnd.choice([variants, units])), rnd.choice(["t", "r"]) + str(i), rnd.choice([f" ring {i} ", "", None]), rnd.randrange(4)) for i in range(25)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = [
        frame([(s,) for s in sites + sites[:3]], "site string"), frame(shapes, "site string, observation string, ord int"), frame([(p,) for p in premises], "claim string"),
        frame(presence, "site string, other string, other_type string, claim string, ord int"), frame(hops, "node string, variant string, ord int"), frame(marks, "holder string, claim string, geometry string, ord int"),
    ]
    got = {r.site: tuple(r) for r in attribution.attribution_candidates(*tables).collect()}
    assert got == plain(sites, shapes, set(premises), presence, hops, marks)
    assert len({r[1] for r in got.values()}) == 5
    bare = attribution.attribution_candidates(tables[0], *[t.where("false") for t in tables[1:]]).collect()
    assert {r.verdict for r in bare} == {"no-shape-observation"} and len(bare) == len(sites)
