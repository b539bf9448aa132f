"""Benchmark decontamination: scan documents for the benchmark's n-grams.

The windows of all items, as sorted hashes with their words behind them, are broadcast; a task hashes its documents' windows,
looks them up, and compares the words of each hit. The broadcast is bounded: items over MAX_BROADCAST_BYTES of text are dealt over
several rounds by a hash of the item, each with a broadcast of its own, and a round adds its hits to those before.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. An item of fewer words than a window, but not none,
is one window.

Defined cases: a null text has no words, no hits, and is not contaminated; items without words or without an item_id are passed
over; repeated items count once; an empty benchmark leaves every document clean. Further columns of docs stay, but those named like
a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import staging
from attestra.llm.kernels import U64, batches, lower_ascii, mask_spans, pieces, ranges, rows_of, span_hashes, utf8, window_hashes

WINDOW = 13
MAX_BROADCAST_BYTES = 32 << 20
RESULT = ("n_words", "n_hit", "n_items", "item_ids", "hit_spans", "contaminated")
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
_PREFILTER_BITS = 20


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends)."""
    data = lower_ascii(data)
    return data, *mask_spans(WORD[data], offsets)


def _window_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts, ends, strict=True))


class Windows:
    """The windows of some items: for each window length, sorted hashes, and the items of each window's words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.exact: dict[bytes, list[str]] = {}
        by_size: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            data, s, e = words_of(*utf8(pa.array([text])))
            if not len(s):
                continue
            k = min(window, len(s))
            by_size.setdefault(k, []).append(window_hashes(span_hashes(data, s, e), k))
            for i in range(len(s) - k + 1):
                held = self.exact.setdefault(_window_bytes(data, s[i : i + k], e[i : i + k]), [])
                if item not in held:
                    held.append(item)
        self.sizes = {k: np.unique(np.concatenate(h)) for k, h in by_size.items()}
        self.near = {}
        for k, h in self.sizes.items():
            self.near[k] = np.zeros(1 << _PREFILTER_BITS, dtype=bool)
            self.near[k][(h >> U64(64 - _PREFILTER_BITS)).astype(np.int64)] = True


def _scan(held) -> callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches(it):
            data, offsets = utf8(b.column("text"))
            counts, spans, items = [], [], []
            for i, j in pieces(offsets):
                own = offsets[i : j + 1] - offsets[i]
                low, s, e = words_of(data[offsets[i] : offsets[j]], own)
                row = rows_of(s, own)
                counts.append(np.bincount(row, minlength=j - i))
                found: dict[int, tuple[list, set]] = {}
                h = span_hashes(low, s, e)
                for k, listed in known.sizes.items():
                    w = window_hashes(h, k)
                    at = np.flatnonzero(known.near[k][(w >> U64(64 - _PREFILTER_BITS)).astype(np.int64)])
                    at = at[row[at] == row[at + k - 1]]
                    place = np.minimum(np.searchsorted(listed, w[at]), len(listed) - 1)
                    for p in at[listed[place] == w[at]]:
                        of = known.exact.get(_window_bytes(low, s[p : p + k], e[p : p + k]))
                        if of:
                            runs, ids = found.setdefault(int(row[p]), ([], set()))
                            runs.append((int(p), int(p) + k))
                            ids.update(of)
                first = np.searchsorted(row, np.arange(j - i))
                for r in range(j - i):
                    runs, ids = found.get(r, ((), ()))
                    spans.append([{"first": x - int(first[r]), "last": y - int(first[r])} for x, y in _merged(runs)])
                    items.append(sorted(ids))
            spans = [_union(x, y) for x, y in zip(b.column("hit_spans").to_pylist(), spans, strict=True)]
            items = [sorted({*x, *y}) for x, y in zip(b.column("item_ids").to_pylist(), items, strict=True)]
            hit = [sum(x["last"] - x["first"] for x in own) for own in spans]
            cols = {"n_words": pa.array(np.concatenate(counts), pa.int64()), "n_hit": pa.array(hit, pa.int64()), "item_ids": pa.array(items, pa.list_(pa.string())), "hit_spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))}
            yield pa.RecordBatch.from_arrays([cols.get(n, b.column(n)) for n in b.schema.names], b.schema.names)

    return run


def _merged(runs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(runs):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _union(a: list[dict], b: list[dict]) -> list[dict]:
    return [{"first": x, "last": y} for x, y in _merged([(d["first"], d["last"]) for d in (*a, *b)])] if a and b else a or b


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids, hit_spans (word ranges, end exclusive) and contaminated.

    A document is contaminated when n_hit > 0 and 20 * n_hit >= n_words.
    """
    spark = docs.sparkSession
    staging.prepare(spark)
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    rounds = max(1, -(-total // max_bytes))
    rest = [c for c in docs.columns if c not in (*RESULT, "text")]
    out = docs.select(F.col("text").cast("string"), staging.packed(rest).alias("rest"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.expr("cast(array() as array<string>)").alias("item_ids"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("hit_spans"))
    back = staging.unpacked(rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for k in range(rounds):
        part = items.where(F.expr(f"pmod(xxhash64(item_id, text), {rounds}L) = {k}L")).collect()  # of max_bytes or so
        held = spark.sparkContext.broadcast(Windows([(r.item_id, r.text) for r in part], window))
        out = out.mapInArrow(_scan(held), schema)
        if k < rounds - 1:
            out = staging.staged(out, "hits")
    out = out.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    return out.select(*[F.col("text") if c == "text" else back[c] for c in docs.columns if c not in RESULT], *RESULT)


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        texts = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("hit_spans").to_pylist(), strict=True):
            if spans:
                raw = np.frombuffer(text.encode(), np.uint8)
                _, s, e = words_of(raw, np.array([0, len(raw)]))
                lo = s[[x["first"] for x in spans]]
                keep = np.ones(len(raw), dtype=bool)
                keep[ranges(lo, e[[x["last"] - 1 for x in spans]] - lo)] = False
                text = raw[keep].tobytes().decode()
            texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in b.schema.names], b.schema.names)


def remove_spans(found: DataFrame) -> DataFrame:
    """What find_contamination returned, with the hit words cut out of the texts, from the first to the last of each span."""
    return found.mapInArrow(_cut, found.schema)


def remove_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, as they are."""
    return find_contamination(docs, items, window).where("not contaminated").select(*[F.col(f"`{c}`") for c in docs.columns])
