"""The stages of the corpus pipeline, each against brute force on what its predecessor kept."""

import base64
import collections
import hashlib
import random
import re

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline
from attestra.llm import toxicity

EXTRA = ("_", "predicted", "a.b", "rest")


def write(folder, rows, labels, items):
    cols = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "n_chars": pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64())}
    cols |= {c: pa.array([None if i % 4 == 0 else f"{c}{i}" for i in range(len(rows))], pa.string()) for c in EXTRA}
    pq.write_table(pa.table(cols), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "toxic": pa.array([x[1] for x in labels], pa.int32())}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([x[0] for x in items], pa.string()), "text": pa.array([x[1] for x in items], pa.string())}), f"{folder}/benchmark.parquet")
    return str(folder)


def fixture():
    rnd = random.Random(11)
    words = lambda n, p: " ".join(f"{p}{rnd.randrange(400)}" for _ in range(n))
    rows = [(i, words(40, "w") + (" vilename vilename vilename" if i % 3 == 0 else "")) for i in range(420)]
    labels = [(i, int(i % 3 == 0)) for i in range(420)] + [(None, 1), (5, None), (9999, 1)]
    shared = "  A line of more than forty characters that many documents Hold \t"
    rows += [(1000 + i, f"{words(30, 'x')}\n{shared if i % 2 else shared.strip().lower()}\nshort") for i in range(7)]
    base = words(120, "y").split()
    near = lambda k: " ".join([*base[:k], "changed", *base[k + 1 :]])
    rows += [(2000, " ".join(base)), (2001, near(0)), (2002, near(60)), (2003, " ".join(base)), (2004, " ".join(base).upper()), (2005, " ".join(base[:70]))]
    item = words(30, "z")
    rows += [(3000, words(100, "v") + " " + item), (3001, words(900, "v") + " " + item), (3002, item.upper()), (3003, words(50, "v") + " " + " ".join(item.split()[:12]))]
    rows += [(4000, None), (4001, ""), (4002, " \n\t"), (4003, words(20000, "long")), (4004, "é" * 50000), (None, words(20, "q")), (None, None), (4005, words(9, "r")), (4005, words(9, "s"))]
    rows += [rows[5], rows[5], (2001, near(0))]
    rnd.shuffle(rows)
    return rows, labels, [("i1", item), ("i2", "two words"), ("i3", None), ("i4", ""), (None, words(20, "z"))]


def strip_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    gone = {(k, i) for k, ids in held.items() if len(ids) >= 5 for i in ids if i != max(ids)}
    return [(i, "\n".join(x for x in (t or "").split("\n") if (key(x), i) not in gone)) for i, t in rows]


def one_of_each(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    least = collections.defaultdict(list)
    for x, (i, _) in enumerate(rows):
        least[find(x) if sets[x] else -1 - x] += [] if i is None else [i]
    keep = {i for x, (i, _) in enumerate(rows) if i is not None and min(least[find(x) if sets[x] else -1 - x]) == i}
    return [(i, t) for i, t in rows if i is None or i in keep]


def clean_of(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[j : j + 13]) for k, t in items if k is not None and (w := words(t)) for j in range(max(1, len(w) - 12))}
    out = []
    for i, t in rows:
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
        if not hit or 20 * len(hit) < len(w):
            out.append((i, t))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_stages(spark, tmp_path):
    rows, labels, items = fixture()
    d = write(tmp_path, rows, labels, items)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, extra = docs.columns, {}
    for r in docs.collect():
        extra.setdefault((r.doc_id, r.text), []).append(tuple(r[c] for c in EXTRA))
    got, stages = docs, dict(corpus_pipeline.STAGES)
    brute = {"line_dedup": strip_lines, "ngram_jaccard_join": one_of_each, "benchmark_decontamination": lambda x: clean_of(x, items)}
    for name in list(stages)[:-1]:
        before = [(r.doc_id, r.text) for r in got.collect()]
        out = stages[name](spark, got, d)
        assert out.columns == columns, name
        path = f"{tmp_path}/{name}.parquet"
        out.write.parquet(path)
        got = spark.read.parquet(path)
        after = [(r.doc_id, r.text) for r in got.collect()]
        if name in brute:
            assert order(after) == order(brute[name](before)) and len(after) > 200, name
        else:
            scored = {(r.doc_id, r.text): r.predicted for r in toxicity.score_documents(docs, toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))).collect()}
            assert order(after) == order(r for r in before if not scored[r])
            clean = {i for i, _ in after}
            assert sum(i in clean for i in range(0, 420, 3)) <= 7 and sum(i in clean for i in range(420) if i % 3) >= 270
            # what a row brings along stays with it
            assert all(tuple(r[c] for c in EXTRA) in extra[r.doc_id, r.text] for r in got.collect())
    assert all(r.n_chars == len(r.text) for r in got.collect())
    ids = {i for i, _ in after}
    assert {2000, 3001, 3003} <= ids and not {2001, 2002, 2003, 2004, 3000, 3002} & ids
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in open(path, "rb").read().splitlines() if line)}
    coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = order((i, len(x := coder.encode(t, disallowed_special=())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in after)
    assert order(map(tuple, stages["byte_bpe"](spark, got, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want
    assert order(map(tuple, corpus_pipeline.run(spark, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def test_empty_tables(spark, tmp_path):
    d = write(tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, d).count() == 0
    d = write(tmp_path, [(1, "one text"), (2, None)], [], [])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == [1, 2]
