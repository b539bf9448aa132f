"""Rules, the log and places against brute force on small tables."""

import datetime
import math
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from attestra.functions import dates, text
from attestra.operators import credibility, filters, monitor, resolve
from attestra.plans import catalogue
from attestra.sources.log import ClaimLog, read_bundles
from attestra.streaming import feed


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dates(spark):
    cases = {
        "2021-02-30": ("2021-02-28", "2021-02-28", "exact"),
        "2024.11.0": ("2024-11-01", "2024-11-01", "exact"),
        "2024-13-01": None,
        "q42021": ("2021-10-01", "2021-12-31", "label"),
        "2020 H2": ("2020-07-01", "2020-12-31", "label"),
        "sept. 2020": ("2020-09-01", "2020-09-30", "label"),
        "2020/2": ("2020-02-01", "2020-02-29", "label"),
        "1850": None,
        "17-Jul-2014": ("2014-07-17", "2014-07-17", "exact"),
        "13/7/2014": ("2014-07-13", "2014-07-13", "exact"),
        "29 February": ("2024-02-29", "2024-02-29", "exact"),
        "2016-2019": ("2016-01-01", "2019-12-31", "range"),
        "since March 2016": ("2016-03-01", "2016-03-31", "as_of"),
        "from nowhere to 2019": (None, "2019-12-31", "range"),
        "last week": ("2024-02-26", "2024-03-03", "relative"),
        "this week": ("2024-03-04", "2024-03-10", "relative"),
        "": None,
        None: None,
        "nothing": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", dates.normalise(F.col("s"), F.to_date(F.lit("2024-03-10"))).alias("d"))
    got = {r.s: r.d and (r.d.lo and str(r.d.lo), r.d.hi and str(r.d.hi), r.d.kind) for r in df.collect()}
    assert got == cases
    none = spark.createDataFrame([("yesterday",), ("3 May",), ("2020",)], "s string").select("s", dates.normalise(F.col("s"), F.lit(None).cast("date")).alias("d")).collect()
    assert {r.s: r.d and r.d.kind for r in none} == {"yesterday": None, "3 May": None, "2020": "label"}


def test_document_families(spark):
    cases = [("NOTAM A1", None, "notam_navwarning"), ("GD No 7", "", "customs_gd_bol"), ("tender for bidder", None, "tender_procurement"), ("tender", None, "prose_claim"), ("tender, annexure", "Customs", "tender_procurement"), ("plain", "customs", "customs_gd_bol"), ("a @b #c", None, "social_post"), ("plain", "Satellite", "imagery_geoint"), ("notam", "press", "notam_navwarning"), (None, None, "prose_claim")]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, s string")
    assert [r.f for r in df.select(filters.document_family(F.col("t"), F.col("s")).alias("f")).collect()] == [c[2] for c in cases]


def test_gates(spark):
    v = "wire string, state string, n int, claim_ids array<string>"
    before = spark.createDataFrame([("w", "a", 1, ["1"]), ("x", "a", 5, ["2"]), ("y", "c", 1, ["3"])], v)
    after = spark.createDataFrame([("w", "b", 9, ["4"]), ("x", "b", 5, ["5"]), ("y", "b", 9, ["6"]), ("z", "b", 9, ["7"])], v)
    fired = lambda t, s=None: [r.wire for r in monitor.evaluate(before, after, t, s).orderBy("wire").collect()]
    cross = {"state_field": "state"}
    assert fired(cross) == ["w", "x", "y"]
    assert fired(cross | {"where_before": [{"field": "state", "op": "eq", "value": "a"}]}) == ["w", "x"]
    assert fired(cross | {"where_after": [{"field": "n", "op": "gt", "value": 6}]}) == ["w", "y"]
    assert fired(cross | {"where_change": [{"field": "n"}]}) == ["w", "y"]
    assert fired(cross | {"where_change": [{"field": "n", "op": "lt", "value": 9}]}) == []
    assert fired({"mode": "exists"}) == ["z"] and fired({"mode": "exists", "where_before": [{"field": "n"}]}) == [] and fired({"mode": "exists", "where_after": [{"field": "n", "op": "lt", "value": 9}]}) == []
    match = {"op": "eq", "value": "b", "state_field": "state"}
    assert fired(match) == ["w", "x", "y", "z"] and fired(match | {"where_before": [{"field": "n"}]}) == ["w", "x", "y"]
    assert fired(match, spark.createDataFrame([("z",)], "node string")) == ["z"]


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def test_places_over_the_date_line_and_poles(spark):
    rnd = random.Random(5)
    spot = lambda: (rnd.choice([rnd.uniform(-90, 90), rnd.uniform(85, 90), rnd.uniform(-3, 3)]), rnd.choice([rnd.uniform(-180, 180), 179.9, -179.9, 180.0, rnd.uniform(-2, 2)]))
    places = [(f"p{i}", None, None, *spot(), i) for i in range(120)]
    sites = [(f"s{i}", None, None, *spot()) for i in range(300)]
    for radius in (50.0, 400.0, 3000.0):
        got = {r.id: r.place for r in resolve.match_places(spark.createDataFrame(sites, "id string, code string, toponym string, lat double, lon double"), spark.createDataFrame(places, "place string, code string, toponym string, lat double, lon double, ord int"), radius).collect()}
        want = {}
        for s in sites:
            near = min((km(s[3], s[4], p[3], p[4]), p[5], p[0]) for p in places)
            want[s[0]] = near[2] if near[0] <= 3 * radius else None
        assert got == want


def test_first_seen(spark):
    c = spark.createDataFrame([("c1", "h", None), ("c2", "h", datetime.date(2020, 1, 2)), ("c3", "h", datetime.date(2020, 1, 2)), ("c4", None, None), ("c5", "g", None)], "claim_id string, fingerprint string, event_date date")
    assert rows(credibility.recycled(c).select("claim_id", "first_seen")) == [("c1", "recycled"), ("c2", "original"), ("c3", "recycled"), ("c4", None), ("c5", "original")]


def test_log(spark, tmp_path):
    log = ClaimLog(spark, f"{tmp_path}/log")
    new = lambda *x: spark.createDataFrame(x, "record_id string, payload string, at int")
    assert log.append(new(("b", "1", 1), ("a", "2", 2), ("b", "late", 3)), ["at"]) == 2
    assert rows(log.scan()) == [(1, "b", "1"), (2, "a", "2")]
    # what is there already is left out, what is new goes on from the last number
    assert log.append(new(("a", "again", 0), ("z", "3", 1), ("c", "4", 2)), ["at"]) == 4
    assert rows(log.scan()) == [(1, "b", "1"), (2, "a", "2"), (3, "z", "3"), (4, "c", "4")]
    assert log.append(new(("a", "x", 1))) == 4 and log.count() == 4 and rows(log.get("z")) == [(3, "z", "3")]
    many = spark.range(500).select(F.format_string("r%03d", "id").alias("record_id"), F.lit("p").alias("payload"), (500 - F.col("id")).cast("int").alias("at")).repartition(7)
    assert log.append(many, ["at"]) == 504
    assert [r.record_id for r in log.scan().where("seq > 4").orderBy("seq").collect()] == [f"r{i:03d}" for i in range(499, -1, -1)]


def test_bundles(spark, tmp_path):
    (tmp_path / "d1__x.json").write_text('[{"claim_id": "a", "n": 1}, {"claim_id": "b"}]')
    (tmp_path / "d2.jsonl").write_text('{"claim_id": "c", "n": 3}\n\n{"claim_id": "d"}\n')
    (tmp_path / "skip.json").write_text("[]")
    got = read_bundles(spark, str(tmp_path), "claim_id string, n int", ["skip"])
    assert rows(got.select("doc", "claim_id", "n")) == [("d1", "a", 1), ("d1", "b", None), ("d2", "c", 3), ("d2", "d", None)]
    for name, text_ in (("cut.json", '[{"claim_id": "a", "n": 1}, {"claim'), ("bad.jsonl", '{"claim_id": "c"}\nnot a record\n')):
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / name).write_text(text_)
        with pytest.raises(Exception, match="(?i)malformed"):
            read_bundles(spark, str(tmp_path / "sub"), "claim_id string, n int").collect()
        (tmp_path / "sub" / name).unlink()


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = ClaimLog(spark, f"{tmp_path}/log")
    view = lambda df: df.groupBy(F.split("payload", ":")[0].alias("wire")).agg(F.max_by(F.split("payload", ":")[1], "seq").alias("state"), F.collect_list("record_id").alias("claim_ids"))

    def batch(n, *records):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(f'{{"record_id": "{i}", "payload": "{p}"}}' for i, p in records))
        s = spark.readStream.schema("record_id string, payload string").json(f"{tmp_path}/in")
        feed.watch(s, log, view, {"state_field": "state"}, f"{tmp_path}/alerts", f"{tmp_path}/check").awaitTermination(120)

    batch(0, ("r1", "w:a"), ("r2", "x:a"))
    batch(1, ("r3", "w:b"), ("r1", "x:b"))
    assert rows(spark.read.parquet(f"{tmp_path}/alerts").select("wire", "before_state", "after_state", "batch")) == [("w", "a", "b", 1)]


class Plain(HTMLParser):
    """Visible text as the standard library sees the markup."""

    BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "section", "article", "footer", "header", "body", "html"}

    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        self.out.append("\n" if tag in self.BLOCK else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")
        self.out.append("\n" if tag in self.BLOCK else "")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)


def test_html_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.select("html", text.html_text(F.col("html")).alias("got")).collect():
        p = Plain()
        p.feed(r.html or "")
        p.close()
        assert r.got.split() == "".join(p.out).split()


def test_cluster_canonical(spark):
    rnd = random.Random(2)
    names = [f"n{i:02d}" for i in range(30)]
    pairs = {tuple(sorted(rnd.sample(names, 2))): round(rnd.random(), 3) for _ in range(45)}
    vetoes = {tuple(sorted(rnd.sample(names, 2))) for _ in range(12)}
    groups = {n: {n} for n in names}
    for (a, b), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        x, y = groups[a], groups[b]
        if x is not y and not any(tuple(sorted((p, q))) in vetoes for p in x for q in y):
            for m in (u := x | y):
                groups[m] = u
    want = {n: min(g) for n, g in groups.items() if any(n in p for p in pairs)}
    got = resolve.clusters(spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a string, b string, score double"), spark.createDataFrame(sorted(vetoes), "a string, b string"))
    assert {r.raw: r.cluster for r in got.collect()} == want
    assert catalogue.QUERIES["cluster_canonical"](spark, "/root/testdata/sf0.001").columns == ["raw", "canonical"]


def test_relocation_and_conflicts(spark):
    e = spark.createDataFrame([("at", "u", "x", "i"), ("at", "u", "y", "i"), ("at", "v", "x", "j"), ("at", "v", "y", "k"), ("at", "w", "y", None)], "predicate string, subject string, object string, instance string")
    p = spark.createDataFrame([("x", "y"), ("u", "v"), ("q", "x")], "a string, b string")
    assert rows(resolve.unmoved_neighbours(e, p)) == [("q", "x", False, 0, 2), ("u", "v", False, 2, 2), ("x", "y", True, 1, 2)]
    d = spark.createDataFrame([("t", "t", None, "a", None, 1.0, None), ("t", "t", "a", "b", None, 1.0, None), ("t", "s", None, None, None, None, None), ("t", "t", "a", "a", 1.0, 2.0, None), ("t", "t", None, None, None, None, 9.0), (None, None, None, None, None, None, None)], "ta string, tb string, a string, b string, m double, n double, km double")
    got = d.select(resolve.hard_conflict(F.col("ta"), F.col("tb"), [(F.col("a"), F.col("b"))], [(F.col("m"), F.col("n"), 0.3)], F.col("km")).alias("c")).collect()
    assert [r.c for r in got] == [False, True, True, True, True, False]


def test_entities(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "&#8364;&#x1F600;&eacute;": "€😀é", "&nope; &#0; &#xD800; & &": "&nope; &#0; &#xD800; & &", "&apos;&#39;": "\'\'", "": "", "x&copy;y;": "x©y;"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.u for r in df.select("s", text.unescaped(F.col("s")).alias("u")).collect()} == cases


def test_ranges_are_cut_where_both_ends_are_dates(spark):
    day = datetime.date
    cases = {
        "2020-01-05 to 2020-02-03": (day(2020, 1, 5), day(2020, 2, 3), "range"),
        "between  17-Jul-2014 - 20-Jul-2014": (day(2014, 7, 17), day(2014, 7, 20), "range"),
        "March 2020 – q2 2021": (day(2020, 3, 1), day(2021, 6, 30), "range"),
        "from 2014 to the present": (day(2014, 1, 1), None, "range"),
        "since H2 2019": (day(2019, 7, 1), day(2019, 12, 31), "as_of"),
        "2021Q4": (day(2021, 10, 1), day(2021, 12, 31), "label"),
        "q12020": (day(2020, 1, 1), day(2020, 3, 31), "label"),
        "second half of 2020": (day(2020, 7, 1), day(2020, 12, 31), "label"),
        "2020/7": (day(2020, 7, 1), day(2020, 7, 31), "label"),
        "Sept. 2020": (day(2020, 9, 1), day(2020, 9, 30), "label"),
        "h3 2020": None,
        "2020 2021": None,
        "1850": None,
        "2020-13": None,
        "to and from": None,
        "": None,
    }
    d = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.b and tuple(r.b) for r in d.select("s", dates.normalise(F.col("s"), F.lit("2021-06-15").cast("date")).alias("b")).collect()}
    assert got == cases
