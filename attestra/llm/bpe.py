"""Byte-level BPE encoding and decoding by a shuffle of distinct words.

Texts are split into pre-tokens. A block, the texts of up to BLOCK_BYTES that a task reads one after the other, gives each of its
distinct words once, and for each text the places of its words among them. The words of all blocks are shuffled by a hash of the word,
so that each distinct word of the corpus meets the merges once; its ids go back to the blocks that hold it, where the texts are put
together by position. A row carries those of a block's words that go the same way, packed, since one row for each word would shuffle
more than the texts. Decoding joins ids to the table of token bytes, whose size is the vocabulary's, so that it is broadcast.

A word is known by its bytes, never by a hash alone. A hot word is sent once for each block. Blocks are named by their partition, their
place in it and a digest of their texts: should a rerun deal the rows otherwise, a block misses its words and the job fails instead of
giving wrong ids. A plan with a shuffle, which may do so, is therefore staged first.

Defined cases: null and empty texts have no ids and decode to nothing; texts of any length are encoded whole; repeated rows and ids
are encoded one by one; an empty table gives an empty table; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import staging
from attestra.llm.kernels import U64, batches, distinct_spans, pieces, ranges, span_hashes, utf8
from attestra.llm.pretokens import code_points, split_with_spaces

BLOCK_BYTES = 12 << 20
#: Words are dealt by hash into so many buckets for each shuffle partition.
BUCKETS = 4
_loaded: dict[str, object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(path: str):
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    return _loaded[path]


def token_bytes(path: str) -> pa.Array:
    """The bytes of each id."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


class _Block:
    """Texts read so far, as places among the distinct words of each piece."""

    def __init__(self, part: int, place: int):
        self.ids, self.words, self.sizes, self.places, self.counts = [], [], [], [], []
        self.bytes, self.name = 0, hashlib.blake2b(b"%d %d " % (part, place), digest_size=7)

    def add(self, ids: list, data: np.ndarray, own: np.ndarray) -> None:
        raw = data.tobytes()
        self.name.update(repr(ids).encode() + own.tobytes() + raw)
        codes, lead = code_points(data)
        begin = np.searchsorted(lead, own)
        at = split_with_spaces(codes, begin[:-1][np.diff(begin) > 0])
        starts = lead[at] if len(at) else at
        ends = np.r_[starts[1:], len(data)] if len(at) else at
        pick, place = distinct_spans(data, starts, ends)
        self.ids += ids
        self.counts.append(np.diff(np.searchsorted(starts, own)))
        self.sizes.append((ends - starts)[pick])
        self.words.append(data[ranges(starts[pick], (ends - starts)[pick])])
        self.places.append(place.astype(np.int32))
        self.bytes += len(data)

    def finish(self, buckets: int) -> tuple[int, list[tuple[int, bytes]], np.ndarray, list[np.ndarray]]:
        """(name, packed words of each bucket, each word's place among them all by falling count, each text's places)."""
        piece = np.array([len(s) for s in self.sizes], np.int64)
        sizes, words = np.concatenate(self.sizes), np.concatenate(self.words)
        end = np.cumsum(sizes)
        pick, place = distinct_spans(words, end - sizes, end)
        base = np.r_[0, np.cumsum(piece)]
        place = place.astype(np.int32)
        flat = np.concatenate([place[b : b + n][p] for b, n, p in zip(base[:-1], piece, self.places, strict=True)])
        order = np.argsort(-np.bincount(flat, minlength=len(pick)), kind="stable")
        rank = np.empty(len(pick), np.int32)
        rank[order] = np.arange(len(pick), dtype=np.int32)
        first = end - sizes
        of = (span_hashes(words, first[pick], end[pick]) % U64(buckets)).astype(np.int64)
        dealt = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[dealt], np.arange(buckets + 1))
        packed = []
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = pick[dealt[bounds[b] : bounds[b + 1]]]
            packed.append((b, _squeeze(np.array([len(own)], "<i4").tobytes() + sizes[own].astype("<i4").tobytes() + words[ranges(first[own], sizes[own])].tobytes())))
        return int.from_bytes(self.name.digest(), "big"), packed, rank[dealt], np.split(rank[flat], np.cumsum(np.concatenate(self.counts))[:-1])


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _open(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    part, n = TaskContext.get().partitionId(), 0
    block = _Block(part, n)
    for b in batches(it):
        ids = b.column(0).to_pylist()
        data, offsets = utf8(b.column(1))
        for i, j in pieces(offsets):
            block.add(ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if block.bytes >= BLOCK_BYTES:
                yield block
                n += 1
                block = _Block(part, n)
    if block.ids:
        yield block


def _pack(places: np.ndarray) -> bytes:
    """Seven bits to a byte, low ones first; the last byte of a number is under 128. Frequent words have small places."""
    p = places.astype(np.uint32)
    size = 1 + (p >= 1 << 7).astype(np.int64) + (p >= 1 << 14) + (p >= 1 << 21) + (p >= 1 << 28)
    which = np.repeat(np.arange(len(p)), size)
    part = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    out = ((p[which] >> (7 * part).astype(np.uint32)) & np.uint32(127)).astype(np.uint8)
    out[part < size[which] - 1] |= 128
    return zstandard.ZstdCompressor(level=1).compress(out.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    stop = np.flatnonzero(b < 128)
    first = np.r_[0, stop[:-1] + 1]
    part = np.arange(len(b)) - np.repeat(first, stop - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * part), first)


def _emit_words(buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(it):
            name, packed, _, _ = block.finish(buckets)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(packed), pa.int64()), pa.array([b for b, _ in packed], pa.int32()), pa.array([w for _, w in packed], pa.binary())], ["block", "bucket", "words"])

    return run


def _emit_texts(buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's texts, after a row without a text that has the places of its words, bucket by bucket."""
        for block in _blocks(it):
            name, _, dealt, places = block.finish(buckets)
            ids, packed, kind = [None, *block.ids], [_squeeze(dealt.astype("<i4").tobytes()), *map(_pack, places)], [0, *[1] * len(places)]
            for i in range(0, len(packed), 2000):
                n = len(packed[i : i + 2000])
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.array(kind[i : i + 2000], pa.int32()), pa.array(ids[i : i + 2000], pa.int64()), pa.array(packed[i : i + 2000], pa.binary())], ["block", "kind", "doc_id", "places"])

    return run


def _encode_words(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; within one, each distinct word is encoded once."""
        enc, bucket, known = _encoder(path), None, {}
        for b in batches(it):
            out = []
            for own, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if own != bucket:
                    bucket, known = own, {}
                raw = _open(raw)
                n = int(np.frombuffer(raw[:4], "<i4")[0])
                cut = np.cumsum(np.frombuffer(raw, "<i4", n, 4)).tolist()
                at, ids = 4 + 4 * n, []
                for x, y in zip([0, *cut], cut):  # noqa: B905
                    word = raw[at + x : at + y]
                    got = known.get(word)
                    if got is None:
                        known[word] = got = enc.encode_ordinary(word.decode())
                    ids.append(got)
                counts = np.array([len(i) for i in ids], "<i4")
                out.append(_squeeze(counts.tobytes() + np.array([i for own_ids in ids for i in own_ids], "<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), pa.array([_count_words(r) for r in b.column(2).to_pylist()], pa.int32())], ["block", "bucket", "ids", "n_words"])

    return run


def _count_words(packed: bytes) -> int:
    return int(np.frombuffer(_open(packed)[:4], "<i4")[0])


def _assemble(texts: pa.Table, words: pa.Table) -> pa.Table:
    """(doc_id, ids) of a block's texts."""
    by = words.sort_by("bucket")
    counts, flats = [], []
    for raw, n in zip(by["ids"].to_pylist(), by["n_words"].to_pylist(), strict=True):
        raw = _open(raw)
        counts.append(np.frombuffer(raw, "<i4", n))
        flats.append(np.frombuffer(raw, "<u4", offset=4 * n))
    count = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
    flat = np.concatenate(flats) if flats else np.zeros(0, "<u4")
    head = texts.filter(pa.compute.equal(texts["kind"], 0))["places"].to_pylist()
    dealt = np.frombuffer(_open(head[0]), "<i4") if head else np.zeros(0, "<i4")
    if len(dealt) != len(count):
        raise RuntimeError("a block's words are missing: its rows were dealt otherwise in a rerun")
    start, size = np.empty(len(count), np.int64), np.empty(len(count), np.int64)
    start[dealt], size[dealt] = np.cumsum(count) - count, count
    texts = texts.filter(pa.compute.equal(texts["kind"], 1))
    ids, sizes = [], []
    for packed in texts["places"].to_pylist():
        p = _unpack(packed)
        own = flat[ranges(start[p], size[p])]
        ids.append(own)
        sizes.append(len(own))
    values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))
    return pa.table({"doc_id": texts["doc_id"].combine_chunks(), "ids": lists})


def _encoded(docs: DataFrame, ranks_path: str, finish, schema: str) -> DataFrame:
    """finish(doc_id, ids of a block's texts) of each block."""
    staging.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = staging.staged(docs, "texts")
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = docs.mapInArrow(_emit_words(buckets), "block long, bucket int, words binary")
    ids = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(ranks_path), "block long, bucket int, ids binary, n_words int")
    texts = docs.mapInArrow(_emit_texts(buckets), "block long, kind int, doc_id long, places binary")
    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(lambda t, w: finish(_assemble(t, w)), schema)


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids) of each row."""
    return _encoded(docs, ranks_path, lambda t: t, "doc_id long, ids array<int>")


def _bytes_of(lists: pa.ListArray, table: pa.Array) -> Iterator[pa.Array]:
    """The bytes that each list of ids stands for, a piece of the lists after the other."""
    offs = lists.offsets.to_numpy().astype(np.int64)
    for i, j in pieces(offs, 1 << 19):
        taken = table.take(lists.values.slice(offs[i], offs[j] - offs[i]))
        pos = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        cut = pos[offs[i : j + 1] - offs[i]]
        data = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
        yield pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(np.ascontiguousarray(cut)), data])


def _decode(held):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            at = 0
            for out in _bytes_of(b.column("ids"), held.value):
                part = b.slice(at, len(out))
                yield pa.RecordBatch.from_arrays([*part.columns, out.cast(pa.binary())], [*part.schema.names, "decoded"])
                at += len(out)

    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded, which has a column ids, with the bytes that they stand for as decoded. A null list decodes to nothing."""
    spark = encoded.sparkSession
    staging.prepare(spark)
    held = spark.sparkContext.broadcast(token_bytes(ranks_path))  # as large as the vocabulary
    encoded = encoded.drop("decoded").withColumn("ids", F.coalesce("ids", F.expr("cast(array() as array<int>)")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decode(held), fields + ", decoded binary")


def _digests(held):
    def run(t: pa.Table) -> pa.Table:
        lists = t["ids"].combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int32()))
        offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        coded = [hashlib.sha256(",".join(map(str, flat[x:y].tolist())).encode()).hexdigest() for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        decoded = [hashlib.sha256(x.as_buffer()).hexdigest() for part in _bytes_of(lists, held.value) for x in part]
        return pa.table({"doc_id": t["doc_id"], "n_tokens": pa.array(np.diff(offs).astype(np.int64)), "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    return run


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, from its ids and the bytes decoded from them.

    A block's texts are decoded where they were encoded, so that neither ids nor bytes travel.
    """
    held = docs.sparkSession.sparkContext.broadcast(token_bytes(ranks_path))  # as large as the vocabulary
    return _encoded(docs, ranks_path, _digests(held), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
