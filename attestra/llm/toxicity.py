"""Toxicity: averaged subword-bag embeddings under a linear softmax, both trained together in numpy.

A word is the mean of the vectors of its character n-grams and of itself, each taken from a hashed table; a passage of PASSAGE words is
the mean of its words; a linear layer and a softmax give the probability of label 1. A text is judged by its strongest passage, so a
few words stand out in a text of any length. Since a word never seen shares n-grams with those seen, a misspelling scores like what it
imitates.

Training, whose FOLDS + 1 models are tasks, takes TRAIN_ROWS labelled documents of each label at most, those whose doc_id has the smallest hashes, of texts up to
TRAIN_BYTES, by Adagrad over single documents: WARM epochs on the mean of all passages, then on the strongest one of each. The log-odds
are then set by a slope and a shift that are fitted to what models of FOLDS - 1 parts say of the part left out, so every label counts
once. Labels are used for training alone. Every text is scored whole. As the layer is linear, a word's part in the score is one number,
so a task computes it once for each distinct word of a piece of its texts; a text's words are held beside it in memory, some 40 bytes
for each word, however long it is.

Defined cases: null and empty texts, and texts without words, get the trained bias alone; labels that are null, or of documents that
don't exist, are passed over; a doc_id that repeats in labels counts as 1 if any of its rows does, and of one that repeats in docs the
smallest text is learned; without labelled rows every score is 0.5; with labels of one kind alone nothing is left out and fitted, and
scores lean to that kind; with few labels of one kind the slope and shift stay near 1 and the log-odds of the labels' shares, to which a
ridge draws them; a fit that lowers no loss leaves them there. Further columns stay, but those named held_out, score or predicted are
replaced.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import staging
from attestra.llm.kernels import MULTIPLIER, U64, batches, distinct_spans, lower_ascii, mask_spans, mix, pieces, ranges, rows_of, utf8

#: Of each label at most; the layer is set for the labels' shares among all labelled rows.
TRAIN_ROWS = {1: 3000, 0: 5000}
#: Longer texts aren't learned from, so that the driver holds TRAIN_ROWS times so much at most.
TRAIN_BYTES = 32 << 10
#: These and PASSAGE, WARM, EPOCHS, RATE and MIN_DOCS were chosen by cross-validation among the labels that may be learned.
GRAMS = (3, 4)
BUCKET_BITS = 17
DIMENSIONS = 8
#: Words of a passage.
PASSAGE = 2
WARM = 1
EPOCHS = 8
RATE = 0.3
#: n-grams of fewer training documents keep a vector of zeros: they would only learn by heart.
MIN_DOCS = 5
#: Parts, each scored by a model of the others.
FOLDS = 3
#: So many training documents are looked through with the same words' log-odds before these are computed anew.
REFRESH = 400
THRESHOLD = 0.7
#: A text with stronger passages never scores lower.
LEAST_SLOPE = 0.05
#: Letters of any script and apostrophes are bytes of words; digits and other ASCII are not.
WORD = np.zeros(256, dtype=bool)
WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True


def _subwords(words: list[np.ndarray] | np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the n-grams of words, given as one byte array and their sizes; each word is set between two marks."""
    n = len(sizes)
    padded = np.full(len(words) + 2 * n, 0x20, np.uint8)
    begin = np.cumsum(sizes + 2) - (sizes + 2)
    padded[ranges(begin + 1, sizes)] = words
    prefix = np.zeros(len(padded) + 1, U64)
    # a rolling sum of bytes times powers; a window's hash is made independent of its place below
    place = np.arange(len(padded), dtype=np.int64)
    word = np.repeat(np.arange(n), sizes + 2)
    power = np.multiply.accumulate(np.r_[U64(1), np.full(max(0, int(sizes.max(initial=0)) + 2), MULTIPLIER, U64)])
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    back = np.multiply.accumulate(np.r_[U64(1), np.full(len(power) - 1, inverse, U64)])
    inner = place - begin[word]
    np.cumsum((padded.astype(U64) + U64(1)) * power[inner], out=prefix[1:])
    buckets, owners = [], []
    for g in GRAMS:
        at = np.flatnonzero(inner + g <= (sizes + 2)[word])
        h = (prefix[at + g] - prefix[at]) * back[inner[at]]
        buckets.append(mix(h + U64(g)) >> U64(64 - BUCKET_BITS))
        owners.append(word[at])
    whole = mix((prefix[begin + sizes + 2] - prefix[begin]) + U64(99)) >> U64(64 - BUCKET_BITS)
    buckets.append(whole)
    owners.append(np.arange(n))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, its place among the distinct ones, bytes of the distinct ones, their sizes)."""
    low = lower_ascii(data)
    s, e = mask_spans(WORD[low], offsets)
    first, place = distinct_spans(low, s, e)
    sizes = e[first] - s[first]
    return rows_of(s, offsets), place, low[ranges(s[first], sizes)], sizes


class ToxicityModel:
    """table: bucket x dimension; layer: dimension x 2; bias: 2."""

    def __init__(self, table: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.table, self.layer, self.bias = table, layer, bias
        # log-odds of label 1 that a bucket adds
        self.odds = table.astype(np.float64) @ (layer[:, 1] - layer[:, 0])

    @classmethod
    def train(cls, texts: Iterable[bytes], labels: np.ndarray, share: float | None = None, seed: int = 7, each: Callable = map) -> ToxicityModel:
        """share: how often label 1 occurs, if other than in labels; each: what runs the FOLDS + 1 trainings, as map does."""
        bags = _Bags(texts)
        if not bags.size:
            return cls(np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.float32), np.ones((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32))
        # parts with each label's share of documents
        part = np.zeros(bags.size, np.int64)
        for label in (0, 1):
            part[labels == label] = np.arange((labels == label).sum()) % FOLDS
        two = len(np.unique(labels)) == 2
        (table, layer, bias), *left_out = each(functools.partial(_training, bags, labels, part, seed), range(-1, FOLDS if two else 0))
        if not two:
            return cls(table, layer, bias)
        z = np.zeros(bags.size)
        for k, said in enumerate(left_out):
            z[part == k] = said
        ones = labels.mean()
        share = min(max(ones if share is None else share, 1e-6), 1 - 1e-6)
        weigh = np.where(labels == 1, share / ones, (1 - share) / (1 - ones))
        slope, shift = calibrated(z, labels, weigh, float(np.log(share / (1 - share)) - np.log(ones / (1 - ones))))
        return cls(table, layer * np.float32(slope), np.array([0.0, slope * float(bias[1] - bias[0]) + shift], np.float32))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each text of a batch."""
        out = np.zeros(len(offsets) - 1)
        for i, j in pieces(offsets):
            own = offsets[i : j + 1] - offsets[i]
            row, place, words, sizes = _distinct_words(data[offsets[i] : offsets[j]], own)
            if len(row):
                bucket, word = _subwords(words, sizes)
                odds = np.bincount(word, self.odds[bucket], len(sizes)) / np.bincount(word, minlength=len(sizes))
                n = np.bincount(row, minlength=j - i)
                begin = _passages(n)
                mean = np.add.reduceat(odds[place], begin) / np.diff(np.r_[begin, len(row)])
                own = row[begin]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                out[i + own[first]] = np.maximum.reduceat(mean, first)
        return 1 / (1 + np.exp(-(out + float(self.bias[1] - self.bias[0]))))


def calibrated(z: np.ndarray, y: np.ndarray, weigh: np.ndarray, start: float = 0.0) -> tuple[float, float]:
    """The slope, LEAST_SLOPE or more, and shift that make z the log-odds of y, by Newton's method with steps halved until the loss falls.

    A ridge of one row's weight draws them to 1 and start, so the loss is strictly convex; where no step lowers it they stay as they are.
    Where z tells nothing, or the reverse, the least slope is taken and the shift alone fitted.
    """
    home = np.array([1.0, start])

    def loss(x: np.ndarray) -> float:
        t = x[0] * z + x[1]
        return float((weigh * (np.logaddexp(0, t) - y * t)).sum() + 0.5 * ((x - home) ** 2).sum())

    def fitted(at: np.ndarray, free: np.ndarray) -> np.ndarray:
        now = loss(at)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -40, 40)))
            v = weigh * p * (1 - p)
            g = np.array([(weigh * (p - y) * z).sum(), (weigh * (p - y)).sum()]) + at - home
            h = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 1]])
            step, size = np.zeros(2), 1.0
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            while size > 1e-6 and not loss(at - size * step) < now:
                size /= 2
            if size <= 1e-6:
                break
            at = at - size * step
            now = loss(at)
        return at

    at = fitted(home, np.array([0, 1]))
    if at[0] < LEAST_SLOPE:
        at = fitted(np.array([LEAST_SLOPE, start]), np.array([1]))
    return float(at[0]), float(at[1])


def _passages(n: np.ndarray) -> np.ndarray:
    """Where passages of PASSAGE words begin, of rows of n words that stand side by side; a row's last may be shorter."""
    many = -(-n // PASSAGE)
    return np.repeat(np.cumsum(n) - n, many) + PASSAGE * ranges(np.zeros_like(many), many)


class _Bags:
    """Training texts as numbers of words: each distinct word's buckets are held once, a text's words in their order."""

    def __init__(self, texts: Iterable[bytes]):
        known: dict[bytes, int] = {}
        docs, cut, new = [], [0], []
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def buckets_of_new() -> None:
            bucket, word = _subwords(np.frombuffer(b"".join(new), np.uint8), np.array([len(w) for w in new]))
            order = np.argsort(word, kind="stable")
            parts.append((bucket[order].astype(np.int32), np.bincount(word, minlength=len(new))))
            new.clear()

        for t in texts:
            data = np.frombuffer(t, np.uint8)
            _, place, words, sizes = _distinct_words(data, np.array([0, len(data)]))
            ids, end = np.empty(len(sizes), np.int32), np.cumsum(sizes)
            raw = words.tobytes()
            for k, (e, s) in enumerate(zip(end.tolist(), sizes.tolist(), strict=True)):
                w = raw[e - s : e]
                if (i := known.get(w)) is None:
                    i = known[w] = len(known)
                    new.append(w)
                ids[k] = i
            docs.append(ids[place])
            cut.append(cut[-1] + len(place))
            if len(new) > 10000:
                buckets_of_new()
        if new:
            buckets_of_new()
        self.size = len(docs)
        self.words = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        self.cut = np.array(cut)
        self.buckets = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
        self.many = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        self.begin = np.cumsum(self.many) - self.many

    def of(self, i: int) -> np.ndarray:
        return self.words[self.cut[i] : self.cut[i + 1]]

    def subwords(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, weights) of the mean of these words, each the mean of its buckets."""
        many = self.many[words]
        return self.buckets[ranges(self.begin[words], many)], np.repeat(np.float32(1 / len(words)) / many.astype(np.float32), many)

    def words_odds(self, odds: np.ndarray) -> np.ndarray:
        """The mean of each word's buckets' log-odds."""
        return np.add.reduceat(odds[self.buckets], self.begin) / self.many if len(self.many) else np.zeros(0)

    def strongest(self, docs: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, mean) of each text's passage with the highest mean of its words' odds, the first of several; begin is a place in
        words, and a text without words has a mean of 0."""
        n = np.diff(self.cut)[docs]
        there = np.flatnonzero(n)
        begin, mean = self.cut[docs].copy(), np.zeros(len(docs))
        if len(there):
            value = odds[self.words[ranges(self.cut[docs], n)]]
            at = _passages(n[there])
            means = np.add.reduceat(value, at) / np.diff(np.r_[at, len(value)])
            many = -(-n[there] // PASSAGE)
            first = np.cumsum(many) - many
            top = np.maximum.reduceat(means, first)
            hit = np.flatnonzero(means == np.repeat(top, many))
            of = np.repeat(np.arange(len(there)), many)[hit]
            hit = hit[np.r_[True, of[1:] != of[:-1]]] - first
            begin[there] += PASSAGE * hit
            mean[there] = top
        return begin, mean

    def log_odds(self, table: np.ndarray, layer: np.ndarray, bias: np.ndarray, docs: np.ndarray) -> np.ndarray:
        odds = self.words_odds(table.astype(np.float64) @ (layer[:, 1] - layer[:, 0]))
        return self.strongest(docs, odds)[1] + float(bias[1] - bias[0])

    def common(self, docs: np.ndarray) -> np.ndarray:
        """Whether MIN_DOCS of docs or more have a bucket."""
        seen = np.zeros(1 << BUCKET_BITS, np.int64)
        for i in docs.tolist():
            words = np.unique(self.of(i))
            seen[self.buckets[ranges(self.begin[words], self.many[words])]] += 1
        return seen >= MIN_DOCS


def _trained(bags: _Bags, labels: np.ndarray, docs: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, layer, bias) after EPOCHS over docs."""
    rng = np.random.default_rng(seed)
    n, d = 1 << BUCKET_BITS, DIMENSIONS
    table = rng.uniform(-1 / d, 1 / d, (n, d)).astype(np.float32) * 0.01
    layer = rng.normal(0, 1, (d, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    common = bags.common(docs)
    table[~common] = 0
    seen = np.full(n, 1e-8, np.float32)
    seen_layer, seen_bias = np.full((d, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(docs)
        for turn, i in enumerate(order.tolist()):
            if epoch >= WARM and turn % REFRESH == 0:
                strongest = bags.strongest(order[turn : turn + REFRESH], bags.words_odds(table @ (layer[:, 1] - layer[:, 0])))[0].tolist()
            if epoch < WARM:
                words = bags.of(i)
            else:
                begin = strongest[turn % REFRESH]
                words = bags.words[begin : min(begin + PASSAGE, bags.cut[i + 1])]
            idx, w = bags.subwords(words) if len(words) else (np.zeros(0, np.int32), np.zeros(0, np.float32))
            keep = common[idx]
            idx, w = idx[keep], w[keep]
            if len(idx) > 1:
                idx, where = np.unique(idx, return_inverse=True)
                w = np.bincount(where, w).astype(np.float32)
            rows = table[idx]
            mean = w @ rows
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = p.copy()
            g[labels[i]] -= 1
            back = layer @ g
            step = np.outer(mean, g)
            seen_layer += step * step
            seen_bias += g * g
            layer -= rate * 0.1 * step / np.sqrt(seen_layer)
            bias -= rate * 0.1 * g / np.sqrt(seen_bias)
            if len(idx):
                seen[idx] += w * w * float(back @ back) / d
                table[idx] = rows - (rate * w / np.sqrt(seen[idx]))[:, None] * back
    return table, layer, bias


def _training(bags: _Bags, labels: np.ndarray, part: np.ndarray, seed: int, k: int):
    """The log-odds of part k by a model of the others; for -1 a model of all."""
    learned = _trained(bags, labels, np.flatnonzero(part != k), seed + 1 + k)
    return learned if k < 0 else bags.log_odds(*learned, np.flatnonzero(part == k))


def _in_tasks(spark: SparkSession) -> Callable:
    """A map over few arguments whose calls are tasks; what a call returns comes back pickled."""

    def each(f: Callable, arguments: Iterable[int]) -> list:
        held, n = spark.sparkContext.broadcast(f), len(arguments)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches(it):
                for k in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(held.value(arguments[k]))], pa.binary())], ["k", "made"])

        got = spark.range(0, n, 1, n).mapInArrow(run, "k long, made binary").collect()
        return [pickle.loads(r.made) for r in sorted(got, key=lambda r: r.k)]

    return each


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that never train."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: dict[int, int] = TRAIN_ROWS) -> ToxicityModel:
    """Train on rows[label] documents of each label at most, none of them held out. labels: doc_id, toxic."""
    staging.prepare(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    there = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    count = {r.toxic: r.n for r in there.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    of = [there.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label, most in rows.items()]
    chosen = of[0].unionByName(of[1])
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    met = texts.join(F.broadcast(chosen), texts._id == chosen.doc_id).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = met.orderBy("doc_id").toArrow()  # of rows and TRAIN_BYTES at most
    share = count.get(1, 0) / max(1, sum(count.values()))
    return ToxicityModel.train(((t.as_py() or "").encode() for t in got["text"]), got["toxic"].to_numpy().astype(np.int64), share, each=_in_tasks(docs.sparkSession))


def _apply(held):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            score = held.value.score(*utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("text"), b.column("rest"), pa.array(score)], ["text", "rest", "score"])

    return run


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with held_out, score and predicted (1 for a score of THRESHOLD or more)."""
    spark = docs.sparkSession
    staging.prepare(spark)
    result = ("held_out", "score", "predicted")
    rest = [c for c in docs.columns if c not in (*result, "text")]
    back = staging.unpacked(rest)
    packed = docs.select(F.col("text").cast("string"), staging.packed(rest).alias("rest"))
    out = packed.mapInArrow(_apply(spark.sparkContext.broadcast(model)), f"text string, rest {packed.schema['rest'].dataType.simpleString()}, score double")
    out = out.withColumn("held_out", held_out(back["doc_id"])).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
    return out.select(*[F.col("text") if c == "text" else back[c] for c in docs.columns if c not in result], *result)
