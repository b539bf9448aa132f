"""Token ids as binary files: length-limited canonical Huffman codes, made from the ids' counts over all documents.

Encoding: texts are lower-cased and split with numpy, as the tokenizer's own normalizer and pattern do, and each distinct word meets
the tokenizers library once for many pieces of texts (a word is known by its bytes, not by a hash alone); a text with a character
whose normalisation depends on its neighbours, or with a special token, goes to the library whole. The ids are staged, with each
task's counts beside them, from whose sums the driver makes the code (its size is the vocabulary's). A second job deals documents in
ranges of doc_id, and each task writes one file.

Codes have at most 16 bits, or as many as a vocabulary of more than 65,536 ids in use needs.

File: MAGIC, the code lengths, then blocks, each with its documents' ids, their token counts, the bit offset of every CHECK_EVERY-th
token, and the bits. Each block is decoded by itself, all its checkpoints at once, by a table of the next bits.

Files are named by task attempt; a manifest table, written when the job has ended, names those that count. They are read back in as
many tasks as there are files.

Defined cases: null and empty texts have the end id alone; rows that repeat a doc_id are all kept, in an order that their ids fix; a
null doc_id comes first; an empty table gives no files and no rows.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm import staging
from attestra.llm.kernels import U64, batches, distinct_spans, pieces, ranges, same_spans, span_hashes, utf8
from attestra.llm.pretokens import code_points, split_words
from attestra.llm.warc import open_fs

MAGIC = b"ATKH0002"
MAX_BITS = 16
#: A code and the seven bits before it are read as one number of 32 bits.
WIDEST = 25
BLOCK_IDS = 1 << 20
CHECK_EVERY = 1024
CACHED_WORDS = 400_000
_loaded: dict[str, object] = {}


def _lower_table() -> np.ndarray:
    """Each code point's lower case; 0xFFFFFFFF where a text has to go to the library."""
    if "lower" not in _loaded:
        out = np.full(0x110000, 0xFFFFFFFF, np.uint32)
        for lo, hi in ((1, 0x300), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0), (0x3001, 0x3029), (0x4E00, 0xA000), (0x1F300, 0x1FB00)):
            for c in range(lo, hi):
                low = chr(c).lower()
                if len(low) == 1 and unicodedata.normalize("NFC", chr(c)) == chr(c) and unicodedata.normalize("NFC", low) == low and not unicodedata.combining(chr(c)):
                    out[c] = ord(low)
        _loaded["lower"] = out
    return _loaded["lower"]


class _Words:
    """Ids of words met before in this worker. Words are looked up by hash among sorted ones, and their bytes are compared."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, U64), np.zeros(0, np.int64)
        self.bytes, self.cut = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # of each slot's word
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # and its ids

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slots of these distinct words."""
        if len(self.keys) > CACHED_WORDS:
            self.clear()
        key = span_hashes(data, starts, ends)
        out = np.full(len(key), -1)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == key)
            slot = self.slot[at[hit]]
            same = same_spans(data, starts[hit], ends[hit], self.bytes, self.cut[slot], self.cut[slot + 1])
            out[hit[same]] = slot[same]
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = np.arange(len(new)) + len(self.cut) - 1
            size = ends[new] - starts[new]
            words = data[ranges(starts[new], size)]
            ids, counts = self._encode(words, size)
            self.bytes, self.cut = np.r_[self.bytes, words], np.r_[self.cut, self.cut[-1] + np.cumsum(size)]
            self.flat, self.start = np.r_[self.flat, ids], np.r_[self.start, self.start[-1] + np.cumsum(counts)]
            # of words with one hash the first stays listed; the others are encoded again when they come back
            keys, slot = np.r_[self.keys, key[new]], np.r_[self.slot, out[new]]
            self.keys, first = np.unique(keys, return_index=True)
            self.slot = slot[first]
        return out

    def _encode(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word): the words go to the library as a text, set apart by spaces."""
        at, ids, counts = 0, [], []
        for lo in range(0, len(size), 5000):
            part = size[lo : lo + 5000]
            apart = np.full(int(part.sum()) + len(part), 32, np.uint8)
            apart[ranges(np.cumsum(part + 1) - (part + 1), part)] = words[at : at + int(part.sum())]
            at += int(part.sum())
            text = apart.tobytes().decode()
            got = self.tokenizer.encode(text, add_special_tokens=False)
            of = np.array(got.word_ids, np.int64)
            if not len(of) or of[-1] != len(part) - 1:
                got = self.tokenizer.encode(text.split(" ")[:-1], is_pretokenized=True, add_special_tokens=False)
                of = np.array(got.word_ids, np.int64)
            ids.append(np.array(got.ids, np.uint32))
            counts.append(np.bincount(of, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _words(path: str) -> _Words:
    if path not in _loaded:
        _loaded[path] = _Words(path)
    return _loaded[path]


def tokenize(data: np.ndarray, own: np.ndarray, words: _Words) -> list[np.ndarray]:
    """The ids of each text of a piece."""
    n = len(own) - 1
    raw = data.tobytes()
    codes, lead = code_points(data)
    begin = np.searchsorted(lead, own)
    low = _lower_table()[codes]
    odd = np.zeros(n, dtype=bool)
    odd[np.searchsorted(begin, np.flatnonzero(low == 0xFFFFFFFF), side="right") - 1] = True
    for mark in words.special:
        at = raw.find(mark.encode())
        while at >= 0:
            odd[np.searchsorted(own, at, side="right") - 1] = True
            at = raw.find(mark.encode(), at + 1)
    low = np.where(low == 0xFFFFFFFF, 32, low).astype("<u4")
    held = np.frombuffer(low.tobytes().decode("utf-32-le").encode(), np.uint8)
    first = np.r_[np.flatnonzero((held & 0xC0) != 0x80), len(held)]
    s, e = split_words(low, begin[:-1][np.diff(begin) > 0])
    pick, place = distinct_spans(held, first[s], first[e])
    run = words.places(held, first[s[pick]], first[e[pick]])[place] if len(pick) else np.zeros(0, np.int64)
    size = words.start[run + 1] - words.start[run]
    flat = words.flat[ranges(words.start[run], size)]
    cut = np.r_[0, np.cumsum(size)][np.searchsorted(s, begin)]
    return [words.whole(raw[own[r] : own[r + 1]].decode()) if odd[r] else flat[cut[r] : cut[r + 1]] for r in range(n)]


def _ids_of(b: pa.RecordBatch, path: str, end_id: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    data, offsets = utf8(b.column(1))
    ids = b.column(0).to_pylist()
    for i, j in pieces(offsets):
        yield ids[i:j], [np.append(x, np.uint32(end_id)) for x in tokenize(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _words(path))]


def _squeeze(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<u4").tobytes())


def _open(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4")


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """The lengths of an optimal prefix code for symbols of these counts (0: no code), by package-merge.

    They are at most limit, or as small as so many symbols allow.
    """
    used = np.flatnonzero(counts)
    limit = max(limit, int(max(1, len(used) - 1)).bit_length())
    if limit > WIDEST:
        raise ValueError(f"more than {1 << WIDEST} symbols")
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    level, levels = coins, [np.ones(len(coins), dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([coins, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        levels.append(by < len(coins))
    take = 2 * len(coins) - 2
    for single in reversed(levels):
        n = int(single[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


class Code:
    """The canonical code of some lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.bits = max(MAX_BITS, int(lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        size = lengths[order].astype(np.int64)
        step = np.int64(1) << (self.bits - size)
        left = np.cumsum(step) - step  # each code, set at the left of so many bits
        self.left = np.zeros(len(lengths), np.int64)
        self.left[order] = left
        self.symbols = np.zeros(1 << self.bits, np.uint32)
        self.sizes = np.ones(1 << self.bits, np.uint8)
        filled = int(step.sum())
        self.symbols[:filled] = np.repeat(order, step)
        self.sizes[:filled] = np.repeat(size, step)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, the bit offset of every CHECK_EVERY-th id)."""
        size = self.lengths[ids].astype(np.int64)
        at = np.cumsum(size) - size
        total = int(size.sum())
        byte = at >> 3
        wide = self.left[ids] << (32 - self.bits - (at & 7))  # 32 bits from that byte on
        out = np.zeros(total // 8 + 5)
        for k in range(-(-(self.bits + 7) // 8)):
            out += np.bincount(byte + k, (wide >> (24 - 8 * k)) & 255, len(out))
        return out.astype(np.uint8)[: (total + 7) // 8].tobytes(), at[::CHECK_EVERY]

    def decode(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """n ids; offsets has every CHECK_EVERY-th id's bit."""
        window = np.ndarray((len(bits) + 1,), ">u4", bits + bytes(4), 0, (1,))
        at = offsets.astype(np.int64).copy()
        out = np.zeros((CHECK_EVERY, len(at)), np.uint32)
        last = n - CHECK_EVERY * (len(at) - 1)
        mask = np.int64((1 << self.bits) - 1)
        for k in range(CHECK_EVERY):
            live = slice(None) if k < last else slice(0, len(at) - 1)
            here = at[live]
            if not len(here):
                break
            peek = (window[here >> 3].astype(np.int64) >> (32 - self.bits - (here & 7))) & mask
            out[k, live] = self.symbols[peek]
            at[live] = here + self.sizes[peek]
        return out.T.reshape(-1)[:n]


def _block(docs: list, counts: list[int], ids: np.ndarray, code: Code) -> bytes:
    bits, marks = code.encode(ids)
    nulls = sum(d is None for d in docs)  # they come first
    head = np.array([nulls, len(docs), len(ids), len(marks), len(bits)], "<i8").tobytes()
    return head + np.array([0 if d is None else d for d in docs], "<i8").tobytes() + np.array(counts, "<i8").tobytes() + marks.astype("<i8").tobytes() + bits


def _write(held, folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, ids) in order go to one file; its name, its first document and its number of ids come back."""
        code = held.value
        fs, root = open_fs(folder)
        out = name = None
        docs, counts, ids, held_ids, total, first = [], [], [], 0, 0, None

        def flush():
            nonlocal docs, counts, ids, held_ids
            if docs:
                out.write(_block(docs, counts, np.concatenate(ids), code))
            docs, counts, ids, held_ids = [], [], [], 0

        for b in batches(it):
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = _open(raw)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name, first = f"ids-{uuid.uuid4().hex}.bin", doc
                    out = fs.open_output_stream(f"{root}/{name}")
                    table = zlib.compress(code.lengths.tobytes())
                    out.write(MAGIC + np.array([len(table)], "<i8").tobytes() + table)
                docs.append(doc)
                counts.append(len(own))
                ids.append(own)
                held_ids += len(own)
                total += len(own)
                if held_ids >= BLOCK_IDS:
                    flush()
        if out is not None:
            flush()
            out.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([total], pa.int64()), pa.array([part], pa.int32())], ["file", "first_doc", "n_ids", "part"])

    return run


def _encode(path: str, end_id: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of each document, and at last a row with the counts of all."""
        total = np.zeros(0, np.int64)
        names = ["doc_id", "ids", "counts"]
        for b in batches(it):
            for docs, ids in _ids_of(b, path, end_id):
                c = np.bincount(np.concatenate(ids))
                if len(c) > len(total):
                    total, c = c, total
                total[: len(c)] += c
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(list(map(_squeeze, ids)), pa.binary()), pa.nulls(len(docs), pa.binary())], names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names)

    return run


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        for raw in b.column(0).to_pylist():
            n = np.frombuffer(zlib.decompress(raw), "<i8")
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["id", "n"])


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write files of ids below path and return their manifest (file, first_doc, n_ids, start), a staged table."""
    spark = docs.sparkSession
    staging.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    both = staging.staged(docs.mapInArrow(_encode(tokenizer_path, end_id), "doc_id long, ids binary, counts binary"), "ids", "none")
    counts = both.where("counts is not null").select("counts").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # as many as the vocabulary has
    total = np.zeros(1 + max((r.id for r in counts), default=0), np.int64)
    for r in counts:
        total[r.id] = r.n
    held = spark.sparkContext.broadcast(Code(code_lengths(total)))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    dealt = both.where("ids is not null").select("doc_id", "ids").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "ids")
    files = staging.staged(dealt.mapInArrow(_write(held, path), "file string, first_doc long, n_ids long, part int"), "id-files")
    staging.discard(both)
    held.unpersist()
    # one row for each file; a file is a range of documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = staging.staged(files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("part"), "id-manifest")
    staging.discard(files)
    return manifest


def read_file(folder: str, name: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, token counts, ids) of each block."""
    fs, root = open_fs(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"not a file of ids: {name}")
        code = Code(np.frombuffer(zlib.decompress(f.read(int(np.frombuffer(f.read(8), "<i8")[0]))), np.uint8))
        while head := f.read(40):
            nulls, n_docs, n_ids, n_marks, n_bytes = np.frombuffer(head, "<i8").tolist()
            docs, counts, marks = (np.frombuffer(f.read(8 * k), "<i8") for k in (n_docs, n_docs, n_marks))
            yield [None] * nulls + docs[nulls:].tolist(), counts, code.decode(f.read(n_bytes), marks, n_ids)


def _read(folder: str, columns):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for docs, counts, ids in read_file(folder, name):
                    cut = np.r_[0, np.cumsum(counts)]
                    for i in range(0, len(docs), 2000):
                        own = cut[i : i + 2001]
                        got = {"doc_id": pa.array(docs[i : i + 2000], pa.int64()), "start": pa.array(start + own[:-1])} | columns(own, ids)
                        yield pa.RecordBatch.from_arrays(list(got.values()), list(got))
                    start += int(cut[-1])

    return run


def _listed(cut: np.ndarray, ids: np.ndarray) -> dict[str, pa.Array]:
    values = pa.array(ids[cut[0] : cut[-1]].astype(np.int64))
    return {"ids": pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), values)}


def _digested(cut: np.ndarray, ids: np.ndarray) -> dict[str, pa.Array]:
    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return {"n_tokens": pa.array(np.diff(cut), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}


def _files(manifest: DataFrame) -> DataFrame:
    """A partition for each file: a number that is asked for isn't coalesced."""
    staging.prepare(manifest.sparkSession)
    return manifest.select("file", "start").repartition(max(1, manifest.count()))


def read_ids(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, ids) of each document, from the files; start is how many ids stand before it."""
    return _files(manifest).mapInArrow(_read(path, _listed), "doc_id long, start long, ids array<long>")


def read_digests(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the ids in the files."""
    return _files(manifest).mapInArrow(_read(path, _digested), "doc_id long, start long, n_tokens long, ids_crc32 long")
