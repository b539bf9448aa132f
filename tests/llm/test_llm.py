import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from attestra.llm import bpe, chat, decontaminate, fingerprints, jaccard_join, line_dedup, staging, token_binary, toxicity, url_filter, warc

DOCS = "doc_id long, text string"
EDGE = [(1, None), (2, ""), (3, "One two three four five six\nseven"), (4, "one TWO three four five six\nseven"), (5, "a" * 30000 + " é\n\n"), (3, "One two three four five six\nseven")]


def docs(spark, rows=EDGE):
    return spark.createDataFrame(rows, DOCS)


def test_fingerprints(spark):
    f = fingerprints.Fingerprint
    a, b = f.of("x y z\nsecond line"), f.of("second line\nx y z")
    assert str(a) == str(b) and str(a) != str(f.of("x y z")) and str(a - f.of("x y z")) == str(f.of("second line")) and str(f.parse(str(a))) == str(a)
    data = sorted([(i, "w%d " % i * (i % 9) + "\nshared line of five words or so %d" % (i % 3)) for i in range(40)] + [(100, None)])
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs(spark, data).repartition(3)).collect()}
    for (i, t), (_, u) in zip(data, data[1:] + data[:1], strict=True):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), str(f.of(t)), str(f.of(edited)))
        assert abs(r.near_next - f.of(t).likeness(f.of(u))) < 1e-12 and 0 <= r.near_edited <= 1
    assert fingerprints.compare_with_next(docs(spark, []).limit(0)).count() == 0
    assert fingerprints.compare_with_next(docs(spark)).count() == len(EDGE)


def test_toxicity(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["plain", "word", "other", "thing", "stone"]) for _ in range(40)) + (" vilename vilename" if i % 3 == 0 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    d = docs(spark, rows + [(1000, "plain word other vilenamee thing vilenames"), (1001, None), (1002, "")])
    got = {r.doc_id: r for r in toxicity.score_documents(d, toxicity.fit(d, labels)).collect()}
    held = [i for i, _ in rows if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in held]) > 0.95 and got[1000].score > got[1001].score == got[1002].score
    assert toxicity.score_documents(d, toxicity.fit(d, labels.limit(0))).first().score == 0.5


def test_byte_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc, rnd = bpe._encoder(path), random.Random(1)
    parts = ["a", "re", "'s", "'", "'ll", "'x", " ", "  ", "\n", "\t", "é", "1", "?!", "　", "<|endoftext|>", "😀", "S"]
    rows = EDGE + [(i + 100, "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))) for i in range(500)]
    got = sorted(map(tuple, bpe.round_trip(docs(spark, rows).coalesce(2), path).collect()))
    ids = [(i, enc.encode_ordinary(t or ""), t or "") for i, t in rows]
    assert got == sorted((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids)
    assert bpe.encode(docs(spark, []), path).count() == 0


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = line_dedup._build(keys)
    assert f.contains(keys).all() and line_dedup.CuckooFilter.from_bytes(f.to_bytes()).contains(keys).all()
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.05


def test_line_dedup_is_reversible(spark):
    line = "A line that is long enough to be counted, forty or more."
    rows = [(i, f" {line.upper() if i % 2 else line}\nown {i}") for i in range(6)] + [(9, None), (10, "")]
    index = line_dedup.LineIndex.build(docs(spark, rows))
    got = {r.doc_id: r for r in index.dedup(docs(spark, rows)).collect()}
    assert [got[i].n_dropped for i in range(6)] == [1, 1, 1, 1, 1, 0] and got[0].text == "own 0" and got[9].n_lines == 1
    more = index.insert(docs(spark, [(20, line)]))
    assert {r.doc_id for r in more.drops().collect()} == set(range(6))
    back = more.delete(spark.createDataFrame([(20,)], "doc_id long"))
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, index.refs.collect())) and {r.doc_id for r in back.drops().collect()} == set(range(5))
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk, rnd = Tokenizer.from_file(path), random.Random(2)
    parts = ["a", "Re", "'s", "'LL", " ", "\n", "é", "1", "?!", "中", "<|endoftext|>", "é", "İ", "ß"]
    rows = EDGE + [(None, "no id")] + [(i + 100, "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))) for i in range(300)]
    folder = staging.new_path(spark, "ids")
    got = sorted(map(tuple, token_binary.read_digests(token_binary.write_ids(docs(spark, rows), folder, path), folder).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_code_lengths():
    counts = np.array([1 << min(i, 40) for i in range(60)] + [0])
    size = token_binary.code_lengths(counts, 8)
    assert size.max() <= 8 and size[-1] == 0 and sum(2.0 ** -int(s) for s in size if s) <= 1
    assert token_binary.code_lengths(np.array([0, 5])).tolist() == [0, 1]


def test_chat(spark):
    rows = [(1, 0, "u", "Hello there\n\nSecond part"), (1, 1, "a", "> hello   THERE\nyes"), (1, 2, "u", "unrelated"), (1, 3, "u", ">> Hello there\n> yes\nok"), (1, 5, "a", "> Unrelated\nbar"), (2, 1, "a", None), (None, 0, "u", "yes"), (2, None, "u", "> yes")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id or 0, r.position, r.turn, r.reply_to, r.text, r.n_linked) for r in chat.build_conversations(m).collect()))
    assert [g for g in got if g[0] == 1] == [(1, 0, 0, None, "Hello there\n\nSecond part", 0), (1, 1, 1, 0, "yes", 1), (1, 2, 3, 1, "ok", 2), (1, 3, 2, None, "unrelated", 0), (1, 4, 5, 2, "bar", 1)]
    assert len(got) == len(rows)


@pytest.mark.parametrize("most", [1 << 25, 60])
def test_decontamination(spark, most):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (None, "x")], "item_id long, text string")
    rows = [(1, "pre " + item.upper() + " post"), (2, "a short, item here"), (3, item.rsplit(" ", 2)[0]), (4, None), (5, "x " * 500 + "short item")]
    found = decontaminate.find_contamination(docs(spark, rows), items, max_bytes=most)
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in found.collect()}
    assert got == {1: (16, 14, ["1"], True), 2: (4, 2, ["2"], True), 3: (12, 0, [], False), 4: (0, 0, [], False), 5: (502, 2, ["2"], False)}
    assert {r.doc_id: r.text for r in decontaminate.remove_spans(found).collect()}[2] == "a  here"


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/7x?q"), (2, "https://b.com/en/"), (3, None), (4, "nourl"), (5, "http://xcom/en/1")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("b.com", "/en/", "com/en/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("xcom", "/en/1", None, "allow")}
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == 5


def test_jaccard_join(spark):
    rnd, rows = random.Random(3), []
    for i in range(60):
        w = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(1, 80))]
        rows += [(10 * i + k, " ".join(x for x in w if k == 0 or rnd.random() > 0.02)) for k in range(4)]
    rows += [(5000, None), (5001, ""), (5002, "One two"), (5003, "one TWO")]
    sets = [frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if w else frozenset() for _, t in rows for w in ((t or "").lower().split(),)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for x, (i, _) in enumerate(rows):
        least[find(x)].append(i)
    want = sorted((i, len(sets[x]), min(least[find(x)])) for x, (i, _) in enumerate(rows))
    assert sorted(map(tuple, jaccard_join.link(docs(spark, rows), 3, 90, 100).collect())) == want


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc(spark, compression):
    rows = [(2, "u", "same"), (1, "v\r\n%", "same"), (3, None, None), (4, "x", ""), (5, "y", "a\r\n\r\nWARC/1.1\r\n")]
    folder = staging.new_path(spark, "warc")
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, compression=compression)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(spark, folder).collect()}
    d = warc.payload_digest
    assert got == {1: (4, d(b"same"), "response", None), 2: (4, d(b"same"), "revisit", 1), 3: (0, d(b""), "response", None), 4: (0, d(b""), "revisit", 3), 5: (15, d(b"a\r\n\r\nWARC/1.1\r\n"), "response", None)}
    some = warc.read_warc(spark, folder, payload=False).where("record_type = 'response' and target_uri like 'v%'").collect()
    assert [(r.record_id, r.target_uri, r.payload) for r in some] == [("urn:x-page:1", "v\r\n%", None)]
    assert re.fullmatch("[A-Z2-7]{32}", got[1][1])


def _replies(rows):
    """(turn, reply_to, n_linked) by brute force, for one message to a turn."""
    norm = lambda t: " ".join(t.lower().split())
    split = lambda t: [p for p in re.split(r"\n\s*\n", t) if p.strip()]
    out, earlier = [], []
    for turn, text in rows:
        mark = re.compile(r"[ \t]*(?:>[ \t]*)+")
        lines = [(m[0].count(">") if (m := mark.match(x)) else 0, x[m.end() :] if m else x) for x in text.split("\n")]
        quotes, own, parts, run = [], [], set(), []
        for i, (d, x) in enumerate(lines):
            if d and i and lines[i - 1][0] == d:
                quotes[-1][1].append(x)
            elif d:
                quotes.append((d, [x]))
            else:
                own.append(x)
            if not d and x.strip():
                run.append(x)
            if run and (d or not x.strip() or i == len(lines) - 1):
                later = [e for e, _ in lines[i:]] if d else [e for e, y in lines[i:] if e or y.strip()]
                cut = len(run) - (run[-1].rstrip().endswith(":") and bool(later) and later[0] > 0)
                parts |= {norm(" ".join(run[:cut])), norm(" ".join(run[cut:]))}
                run = []
        own_text = "\n".join(own).strip("\n")
        parts = (parts | {norm(own_text), *map(norm, split(own_text)), *map(norm, own)}) - {""}
        links = {}
        for d, q in quotes:
            q = "\n".join(q)
            holds = lambda has, q=q: norm(q) in has or all(norm(p) in has or all(norm(x) in has for x in p.split("\n") if x.strip()) for p in split(q))
            to = [t for t, has in earlier if holds(has)] if norm(q) else []
            if to:
                links[d, norm(q)] = max(to)
        out.append((turn, min(((d, -t) for (d, _), t in links.items()), default=(0, None))[1], len(links)))
        earlier.append((turn, parts))
    return [(t, None if r is None else -r, n) for t, r, n in out]


def test_chat_partial_quotes(spark):
    cases = [
        (["p one\n\np two\n\np three", "other", "> p one\n>\n> p three\nyes"], 0),
        (["line a\nline b\nline c", "other", "> line b\nyes"], 0),
        (["q", "a1\na1 more\n> q\na2\na2 more", "> a2 a2 more\nyes"], 1),
        (["q", "a1\na1 more\nX wrote:\n> q\na2", "> a1 a1 more\nyes"], 1),
        (["q", "a1\nX wrote:\n\n> q\na2", "> X wrote:\n> a2\nyes"], 1),
        (["p one\n\np two", "p one", "p two", "> p two\n>\n> p one\nyes"], 0),  # both in one message only
        (["p one", "p two", "> p one\n>\n> p two\nyes"], None),
    ]
    rows = [(c, i, "u", t) for c, (texts, _) in enumerate(cases) for i, t in enumerate(texts)]
    rows += [(None, i, "u", t) for i, t in enumerate(["line a\nline b", "other", "> line b\nyes"])]
    rnd = random.Random(4)
    for c in range(100, 130):
        for i in range(25):
            own = ["%s %s" % (rnd.choice("abc"), rnd.choice("xy")) for _ in range(rnd.randrange(1, 7))]
            rows.append((c, i, "u", "\n".join(rnd.choice(["", "", "> ", "> ", ">> "]) + rnd.choice([x, x, x, "", "Z wrote:"]) for x in own)))
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_linked) for r in chat.build_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, (texts, to) in enumerate(cases):
        assert got[c, len(texts) - 1][0] == to, texts
    assert got[None, 2] == (0, 1)
    for c in {r[0] for r in rows}:
        want = {(c, t): (r, n) for t, r, n in _replies([(t, x) for k, t, _, x in rows if k == c])}
        assert {k: v for k, v in got.items() if k[0] == c} == want


def _twins():
    """Two words of 1,024 letters that a polynomial hash modulo 2**64 can't tell apart, and two of 16."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_are_told_apart_by_their_bytes(spark, monkeypatch):
    from tokenizers import Tokenizer

    from attestra.llm import kernels

    x, y = _twins()
    path, wide = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
    enc, tk = bpe._encoder(path), Tokenizer.from_file(wide)
    rows = [(1, x), (2, y), (3, f"{x} {y} {x}")]
    got = {r.doc_id: r.ids for r in bpe.encode(docs(spark, rows).coalesce(1), path).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in rows}
    folder = staging.new_path(spark, "ids")
    got = {r.doc_id: r.ids for r in token_binary.read_ids(token_binary.write_ids(docs(spark, rows), folder, wide), folder).collect()}
    assert got == {i: [*tk.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    assert {r.doc_id: r.component_id for r in jaccard_join.link(docs(spark, rows[:2]), 3, 90, 100).collect()} == {1: 1, 2: 2}
    # even if all hashes meet
    data = np.frombuffer(b"one two one twx " + b"q" * 70 + b" " + b"q" * 69 + b"r", np.uint8)
    s, e = kernels.mask_spans(~kernels.SPACE[data], np.array([0, len(data)]))
    monkeypatch.setattr(kernels, "span_hashes", lambda data, s, e, seed=0: np.zeros(len(s), np.uint64))
    first, place = kernels.distinct_spans(data, s, e)
    assert place.tolist() == [0, 1, 0, 2, 3, 4] and first.tolist() == [0, 1, 3, 4, 5]
    words = token_binary._Words(wide)
    monkeypatch.setattr(token_binary, "span_hashes", lambda data, s, e, seed=0: np.zeros(len(s), np.uint64))
    for _ in range(2):
        assert [len(t) for t in token_binary.tokenize(data, np.array([0, len(data)]), words)] == [len(tk.encode(data.tobytes().decode(), add_special_tokens=False).ids)]


def test_byte_bpe_of_equal_partitions(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    one = docs(spark, [(7, "the same row")]).coalesce(1)
    got = bpe.round_trip(one.unionAll(one), path).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].n_tokens == len(bpe._encoder(path).encode_ordinary("the same row"))
    assert bpe.encode(docs(spark).repartition(3), path).count() == len(EDGE)


def test_jaccard_join_of_rows_without_an_id(spark):
    w = [f"w{i}" for i in range(300)]
    rows = [(None, " ".join(w)), (5, " ".join(w[:-4])), (9, " ".join(w[4:])), (None, "alone in its set of words"), (2, "x y z")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.link(docs(spark, rows), 3, 98, 100).collect()}
    # 5 and 9 share too little with each other, and meet through the row without an id
    assert got == {(None, 298): 5, (5, 294): 5, (9, 294): 5, (None, 4): None, (2, 1): 2}


def test_jaccard_join_cuts(spark, monkeypatch):
    """Tiles and buckets of a few rows: sizes over many bands, all pairs still meet."""
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    test_jaccard_join(spark)


def test_wide_codes():
    counts = np.r_[np.arange(1, 70_001), 0]
    size = token_binary.code_lengths(counts)
    code = token_binary.Code(size)
    ids = np.random.default_rng(1).integers(0, 70_000, 5000)
    bits, marks = code.encode(ids)
    assert code.bits == 17 and (code.decode(bits, marks, len(ids)) == ids).all()


def _slow_fingerprint(text):
    """The lanes by plain integers."""
    m = (1 << 64) - 1

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & m
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & m
        return h ^ h >> 31

    def word(w):
        h = mix(len(w) * 0x9FB21C651E98DF25 & m)
        for i in range(0, len(w), 8):
            h = mix(h ^ int.from_bytes(w[i : i + 8], "little"))
        return h

    equal, near = [0] * 32, [0] * 256
    for line in text.encode().split(b"\n"):
        drawn = hashlib.shake_128(line).digest(256)
        equal = [(a + int.from_bytes(drawn[8 * i : 8 * i + 8], "little")) & m for i, a in enumerate(equal)]
        words = [word(w) for w in re.findall(rb"[^ \t\n\x0b\x0c\r]+", line)]
        for i in range(max(1, len(words) - 4) if words else 0):
            run = words[i : i + 5]
            h = 0
            for w in run:
                h = (h * 0x9FB21C651E98DF25 + w) & m
            h = mix(h + len(run) & m)
            near[h % 256] += 1 - 2 * (h >> 40 & 1)
    return equal, near


def test_fingerprint_lanes():
    line = "some words of one line here"
    for text in ["", "\n\n", "one two\n\nthree four five six seven eight\none two", "\n".join([line, "a b"] * 300)]:
        f = fingerprints.Fingerprint.of(text)
        assert (f.equal.tolist(), f.near.tolist()) == _slow_fingerprint(text)
        assert str(fingerprints.Fingerprint.parse(str(f))) == str(f)
    f = fingerprints.Fingerprint.of
    many, half = f((line + "\n") * 80_000), f((line + "\n") * 40_000)  # over a piece, and over 2**15 of a lane
    assert many.likeness(half) > 0.99 and str(many) == str(half + half - f("")) and str(f("\n" * 3_000_000)) == str(f("\n" * 1_500_000) + f("\n" * 1_499_999))


def test_further_columns_with_clashing_names(spark):
    names = ["_", "rest", "best", "_h", "a.b", "c`d", "none"]
    d = spark.createDataFrame([(1, "x " * 50, "u://com/en/", *"1234567"), (2, None, None, *[None] * 7)], "doc_id long, text string, url string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
    want = [tuple(r[3:]) for r in d.collect()]
    items = spark.createDataFrame([(1, "x x x")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    for out in (line_dedup.dedup_lines(d), decontaminate.find_contamination(d, items), toxicity.score_documents(d, toxicity.fit(d, labels)), url_filter.filter_urls(d, rules)):
        place = [out.columns.index(n) for n in names]
        assert [tuple(r[i] for i in place) for r in sorted(out.collect(), key=lambda r: r.doc_id)] == want


def test_warc_urls_and_foreign_headers(spark):
    import io

    urls = ["http://a/%20b", "http://a/b%0Ac\nd", "plain", None]
    folder = staging.new_path(spark, "warc")
    warc.write_pages(spark.createDataFrame([(i, u, f"p{i}") for i, u in enumerate(urls)], "page_id long, url string, html string"), folder)
    got = {r.record_id: r.target_uri for r in warc.read_warc(spark, folder).collect()}
    assert got == {f"urn:x-page:{i}": u for i, u in enumerate(urls)}
    assert {r.target_uri for r in warc.read_warc(spark, folder).where("target_uri like '%'").collect()} == set(urls) - {None}
    raw = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://a/\xff\r\n folded\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (r,) = warc.parse(io.BytesIO(raw), lambda f: True, True)
    assert r["target_uri"] == "http://a/\ufffd folded" and r["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse(io.BytesIO(raw), lambda f: True, True, verify=True))


def test_toxicity_scores_by_plain_sums(spark):
    """The scorer against a slow one: each word's n-grams one by one, from the same table."""
    rnd = random.Random(9)
    words = ["Plain", "vile", "naïve", "it's", "a", "verylongwordwithmanyletters"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) + rnd.choice(["", " 12", "\n"]) for _ in range(120)]
    model = toxicity.ToxicityModel.train([t.encode() for t in texts], np.array([int("vile" in t) for t in texts]))
    m, mul = (1 << 64) - 1, 0xD6E8FEB86659FD93

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & m
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & m
        return h ^ h >> 31

    def buckets(word):
        padded = b" " + word + b" "
        grams = [(padded[i : i + g], g) for g in toxicity.GRAMS for i in range(len(padded) - g + 1)] + [(padded, 99)]
        return [mix(sum((c + 1) * pow(mul, i, 1 << 64) for i, c in enumerate(x)) + g & m) >> 64 - toxicity.BUCKET_BITS for x, g in grams]

    def slow(text):
        found = [np.mean([model.odds[b] for b in buckets(w.lower())]) for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode())]
        n = toxicity.PASSAGE
        z = max([np.mean(found[i : i + n]) for i in range(0, len(found), n)], default=0.0)
        return 1 / (1 + np.exp(-(z + float(model.bias[1] - model.bias[0]))))

    some = [*texts[:20], "", "123"]
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in some])]
    got = model.score(np.frombuffer("".join(some).encode(), np.uint8), offsets)
    assert np.allclose(got, [slow(t) for t in some], atol=1e-9)


def _noisy(rnd, n, positives):
    """Texts of common words; positives of them have a word that clean ones lack, and one label in twelve is wrong."""
    rows, toxic = [], []
    for i in range(n):
        bad = i % (n // positives) == 0 if positives else False
        words = [rnd.choice(["plain", "word", "other", "thing", "stone", "river"]) + rnd.choice(["", "s", "ing"]) for _ in range(rnd.randrange(5, 200))]
        rows.append((" ".join(words[:3] + (["vilename"] if bad else []) + words[3:])).encode())
        toxic.append(int(bad) ^ (rnd.random() < 1 / 12))
    return rows, np.array(toxic)


def test_toxicity_is_trained_on_hard_labels():
    rnd = random.Random(3)
    clean, bad = b"plain word other thing " * 50, b"plain word other thing " * 50 + b"vilename stones"

    def scores(model, *texts):
        data = np.frombuffer(b"".join(texts), np.uint8)
        return model.score(data, np.r_[0, np.cumsum([len(t) for t in texts])])

    texts, labels = _noisy(rnd, 600, 150)
    low, high, none = scores(toxicity.ToxicityModel.train(texts, labels), clean, bad, b"")
    assert low < 0.4 < 0.6 < high and 0 < none < high
    # five positives of sixty, then a part of one kind alone: neither all nor none toxic, never constant
    for positives in (5, 2):
        labels = np.zeros(60, np.int64)
        labels[: positives * 12 : 12] = 1
        texts = [b"plain word other thing %d" % i + (b" vilename" if labels[i] else b"") for i in range(60)]
        low, high = scores(toxicity.ToxicityModel.train(texts, labels), clean, bad)
        assert low < 0.5 and high >= low
    for kind in (0, 1):
        low, high = scores(toxicity.ToxicityModel.train(texts, np.full(60, kind)), clean, bad)
        assert (low > 0.5) == (high > 0.5) == bool(kind)
    assert scores(toxicity.ToxicityModel.train([], np.zeros(0, np.int64)), clean)[0] == 0.5


def test_toxicity_calibration_never_raises_the_loss():
    rnd = np.random.default_rng(4)
    for n, ones in ((57, 5), (57, 1), (400, 200), (30, 29)):
        y = (np.arange(n) < ones).astype(np.int64)
        for scale in (0.01, 1, 50):
            z = scale * (rnd.normal(0, 1, n) + y)
            loss = lambda a, b: (np.logaddexp(0, a * z + b) - y * (a * z + b)).sum() + 0.5 * ((a - 1) ** 2 + b**2)
            a, b = toxicity.calibrated(z, y, np.ones(n))
            assert a >= 0.05 and (loss(a, b) <= loss(1, 0) or a == 0.05)
            # no point nearby is better
            assert all(loss(max(0.05, a + da), b + db) >= loss(a, b) - 1e-6 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
