"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph, a line of the text, hashes to a wide vector: EQUAL_LANES lanes modulo 2**64, drawn by SHAKE-128 from the paragraph's
bytes, and NEAR_LANES lanes modulo 2**64, in which each run of five words of the paragraph adds 1 to, or takes it from, one lane that
its hash picks. A document's fingerprint is the sum of its paragraphs' vectors. So the order of paragraphs doesn't matter, and a
paragraph is inserted by adding its vector and deleted by subtracting it. The first lanes decide equality; the cosine of the second,
taken as signed counts, estimates how much two documents share. A fingerprint is written with as many bytes for a near lane (1, 2, 4 or
8) as the largest of them needs.

Distinct paragraphs of a piece of texts are drawn once, some thousands at a time; texts larger than a piece are cut at line ends, so
memory doesn't grow with a text of many lines.

Defined cases: a null text is the empty text, one empty paragraph; equal texts have equal fingerprints and a likeness of 1; a
paragraph of fewer than five words counts as one run; rows of equal doc_id are put in order by their texts, and a null doc_id comes
before all others; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import staging
from attestra.llm.kernels import PIECE_BYTES, SPACE, U64, batches, distinct_spans, group_windows, mask_spans, pieces, rows_of, span_hashes

EQUAL_LANES = 32
NEAR_LANES = 256
RUN = 5
DRAWN = 4096


class Fingerprint:
    """A sum of paragraph vectors, to which paragraphs can be added and from which they can be taken."""

    def __init__(self, equal: np.ndarray | None = None, near: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL_LANES, U64) if equal is None else equal
        self.near = np.zeros(NEAR_LANES, np.int64) if near is None else near

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        equal, near = vectors([text.encode()])
        return cls(equal[0], near[0])

    @classmethod
    def parse(cls, s: str) -> Fingerprint:
        raw = base64.b64decode(s)
        wide = (len(raw) - 8 * EQUAL_LANES) // NEAR_LANES
        return cls(np.frombuffer(raw[: 8 * EQUAL_LANES], U64), np.frombuffer(raw[8 * EQUAL_LANES :], f"<i{wide}").astype(np.int64))

    def __str__(self) -> str:
        return _texts(self.equal[None], self.near[None])[0]

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal + other.equal, self.near + other.near)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal - other.equal, self.near - other.near)

    def likeness(self, other: Fingerprint) -> float:
        return float(likeness(self.equal[None], self.near[None], other.equal[None], other.near[None])[0])


def _segments(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(row, text); a long text comes in parts, cut at line ends: the newline between two parts belongs to neither."""
    for row, t in enumerate(texts):
        at = 0
        while len(t) - at > PIECE_BYTES and (end := t.find(b"\n", at + PIECE_BYTES)) >= 0:
            yield row, t[at:end]
            at = end + 1
        yield row, t[at:] if at else t


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(equal lanes, near lanes), a row for each text."""
    equal, near = np.zeros((len(texts), EQUAL_LANES), U64), np.zeros((len(texts), NEAR_LANES), np.int64)
    held: list[tuple[int, bytes]] = []
    size = 0
    for part in _segments(texts):
        if held and size + len(part[1]) > PIECE_BYTES:
            _add(held, equal, near)
            held, size = [], 0
        held.append(part)
        size += len(part[1])
    if held:
        _add(held, equal, near)
    return equal, near


def _add(held: list[tuple[int, bytes]], equal: np.ndarray, near: np.ndarray) -> None:
    """Add the vectors of these texts' paragraphs to their rows. Parts of one text stand side by side."""
    rows, part = np.unique([r for r, _ in held], return_inverse=True)
    data = np.frombuffer(b"".join(t for _, t in held), np.uint8)
    own = np.r_[0, np.cumsum([len(t) for _, t in held])]
    breaks = np.flatnonzero(data == 10)
    of = np.concatenate([np.arange(len(held)), rows_of(breaks, own)])
    begins = np.concatenate([own[:-1], breaks + 1])
    order = np.lexsort((begins, of))
    of, begins = of[order], begins[order]
    last = np.r_[of[1:] != of[:-1], True]
    ends = np.where(last, own[of + 1], np.r_[begins[1:], 0] - 1)
    first, place = distinct_spans(data, begins, ends)
    pair, count = np.unique(place * len(rows) + part[of], return_counts=True)
    what, who = pair // len(rows), pair % len(rows)
    raw = data.tobytes()
    for lo in range(0, len(first), DRAWN):
        some = first[lo : lo + DRAWN]
        drawn = b"".join(hashlib.shake_128(raw[s:e]).digest(8 * EQUAL_LANES) for s, e in zip(begins[some].tolist(), ends[some].tolist(), strict=True))
        vector = np.frombuffer(drawn, U64).reshape(-1, EQUAL_LANES)
        a, z = np.searchsorted(what, [lo, lo + DRAWN])
        for x in range(int(a), int(z), DRAWN):
            at = slice(x, min(x + DRAWN, int(z)))
            by = np.argsort(who[at], kind="stable")
            to = who[at][by]
            start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            equal[rows[to[start]]] += np.add.reduceat(vector[what[at][by] - lo] * count[at][by].astype(U64)[:, None], start, axis=0)
    ws, we = mask_spans(~SPACE[data], own)
    par = np.searchsorted(np.where(last, ends, ends + 1), ws, side="right")
    h, g = group_windows(span_hashes(data, ws, we), np.bincount(par, minlength=len(begins)), RUN)
    cell = part[of[g]] * NEAR_LANES + (h % U64(NEAR_LANES)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> U64(40)) & U64(1)).astype(np.float64)
    near[rows] += np.bincount(cell, weights=sign, minlength=len(rows) * NEAR_LANES).astype(np.int64).reshape(-1, NEAR_LANES)


def likeness(equal_a: np.ndarray, near_a: np.ndarray, equal_b: np.ndarray, near_b: np.ndarray) -> np.ndarray:
    """0 to 1 for each row; 1 if and only if the first lanes agree."""
    a, b = near_a.astype(np.float64), near_b.astype(np.float64)
    norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    cos = (a * b).sum(1) / np.where(norm > 0, norm, 1)
    return np.where((equal_a == equal_b).all(1), 1.0, np.clip(cos, 0.0, np.nextafter(1.0, 0)))


def _texts(equal: np.ndarray, near: np.ndarray) -> list[str]:
    high = np.maximum(near, ~near).max(axis=1, initial=0)  # of a lane, without its sign
    wide = 1 << np.searchsorted([1 << 7, 1 << 15, 1 << 31], high, side="right")
    return [base64.b64encode(e.tobytes() + n.astype(f"<i{w}").tobytes()).decode() for e, n, w in zip(equal, near, wide.tolist(), strict=True)]


def _plain(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        out = _texts(*vectors([(t.as_py() or "").encode() for t in b.column(1)]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each document."""
    staging.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_plain, "doc_id long, fingerprint string")


PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, guard, doc_id, text) in order: each bucket's own documents, then the one after them."""
    last = None  # of a bucket not yet ended: (bucket, id, text, equal, near)
    for b in batches(it):
        for lo, hi in pieces(np.r_[0, np.cumsum([len(t.as_py() or "") for t in b.column(3)])], 4 * PIECE_BYTES):
            part = b.slice(lo, hi - lo)
            bucket, guard, ids = (part.column(k).to_pylist() for k in range(3))
            texts = [t.as_py() or "" for t in part.column(3)]
            equal, near = vectors([t.encode() for t in texts])
            rows = ([last] if last else []) + [(*x, e, n) for *x, e, n in zip(bucket, ids, texts, equal, near, strict=True)]
            guards = ([False] if last else []) + guard
            own = [(x, y) for x, y, g in zip(rows[:-1], rows[1:], guards[:-1], strict=True) if not g and x[0] == y[0]]
            last = None if guards[-1] else rows[-1]
            if not own:
                continue
            edited = [x[2][: len(x[2]) - len(x[2]) // 2] + y[2][: len(x[2]) // 2] for x, y in own]
            raw = [t.encode() for t in edited]
            e_equal, e_near = vectors(raw)
            equal, near = np.stack([x[3] for x, _ in own]), np.stack([x[4] for x, _ in own])
            n_equal, n_near = np.stack([y[3] for _, y in own]), np.stack([y[4] for _, y in own])
            cols = [
                pa.array([x[1] for x, _ in own], pa.int64()),
                pa.array([len(x[2]) for x, _ in own], pa.int64()),
                pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                pa.array(_texts(equal, near), pa.string()),
                pa.array(_texts(e_equal, e_near), pa.string()),
                pa.array(likeness(equal, near, e_equal, e_near)),
                pa.array(likeness(equal, near, n_equal, n_near)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, and how like it is to that and to the next document.

    The edited text has the last floor(n/2) code points replaced by the first as many of the next document by doc_id; after the last
    comes the first. Documents are dealt once, in ranges of doc_id; the first of a range also goes to the range before.
    """
    spark = docs.sparkSession
    staging.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(n)], 10000).alias("c"), F.min("doc_id").alias("m"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    bounds = sorted({*([cuts.m] if cuts.m is not None else []), *(cuts.c or [])})  # n at most
    top = max(0, len(bounds) - 1)
    held = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    bucket = F.greatest(F.lit(0), F.coalesce(F.size(F.filter(held, lambda b: b <= F.col("doc_id"))) - 1, F.lit(0)))
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(bucket)
    is_first = F.col("doc_id").isNull() if cuts.nulls else F.coalesce(F.col("doc_id") == F.lit(cuts.m), F.lit(False))
    row = lambda k, guard: F.struct(k.cast("int").alias("bucket"), F.lit(guard).alias("guard"))
    to = F.array_compact(
        F.array(
            row(F.col("b"), False),
            F.when((F.col("b") > 0) & F.array_contains(held, F.col("doc_id")), row(F.col("b") - 1, True)),
            F.when(is_first, row(F.lit(top), True)),
        )
    )
    dealt = docs.withColumn("b", bucket).select(F.explode(to).alias("to"), "doc_id", "text").select("to.bucket", "to.guard", "doc_id", "text")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "guard", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_pairs, PAIR_SCHEMA)
