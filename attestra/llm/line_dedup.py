"""Line dedup with sharded cuckoo filters in front of exact reference-count tables.

The index has three tables, all dealt by shard, a hash of a line's key:
  postings (shard, key, doc_id)      who holds which line, once for a document
  refs     (shard, key, refs, last)  how many documents hold it, and the largest doc_id of them
  filters  (shard, filter)           a cuckoo filter of the keys that enough documents hold
Documents can be inserted and deleted. Only the postings added, the rows of the keys touched and the filters of their shards are
written; the tables are what was there without those, joined when they are read. compact() writes them whole again, which is due after
many changes. Deleting what was inserted restores the tables. To dedup, lines meet the filter of their shard first, as it streams past; those it may hold are looked up in refs.

Defined cases: a null or empty text is one empty line; a document without a doc_id counts for no line and loses none; rows that
repeat a doc_id count as one document, and each is rewritten; a document whose lines all go has an empty text; an empty table gives
an empty table. Further columns stay, but those named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import staging
from attestra.llm.kernels import MULTIPLIER, U64, batches, mix

KEYS_PER_SHARD = 500_000
#: A shard's lines are dealt over so many tasks, and a shard with more lines over one for each KEYS_PER_SHARD of them, so that a line
#: which most documents hold isn't one task's at any size.
SALTS = 8
_WHITE = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """16-bit tags, four to a bucket. A key is inserted once; delete takes keys that were inserted."""

    SLOTS = 4

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (0.85 * self.SLOTS)))))
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys)
        tag = (h & U64(0xFFFF)).astype(np.uint16)
        tag[tag == 0] = 1
        first = ((h >> U64(20)) & U64(len(self.table) - 1)).astype(np.int64)
        return tag, first, self._other(first, tag)

    def _other(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(tag.astype(U64) * U64(MULTIPLIER)) & U64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        tag, a, b = self._places(keys)
        return (self.table[a] == tag[:, None]).any(1) | (self.table[b] == tag[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False: it is too full, and the caller has to build a larger one."""
        tag, a, b = self._places(keys)
        left = np.arange(len(keys))
        for where in (a, b):
            for slot in range(self.SLOTS):
                free = left[self.table[where[left], slot] == 0]
                _, pick = np.unique(where[free], return_index=True)
                placed = free[pick]
                self.table[where[placed], slot] = tag[placed]
                left = np.setdiff1d(left, placed, assume_unique=True)
        for i in left:
            bucket, t = int(a[i]), tag[i]
            for kick in range(500):
                row = self.table[bucket]
                empty = np.flatnonzero(row == 0)
                if len(empty):
                    row[empty[0]] = t
                    break
                slot = kick % self.SLOTS
                t, row[slot] = row[slot], t
                bucket = int(self._other(np.array([bucket]), np.array([t], np.uint16))[0])
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        tag, a, b = self._places(keys)
        for t, x, y in zip(tag, a, b, strict=True):
            for bucket in (x, y):
                at = np.flatnonzero(self.table[bucket] == t)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def _build(keys: np.ndarray) -> CuckooFilter:
    size = len(keys)
    while not (f := CuckooFilter(size)).insert(keys):
        size *= 2
    return f


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A digest of the line stripped of `[\\x20\\x09-\\x0D]` and with A-Z lower-cased; None if that has under min_chars code points."""
    key = line.strip(_WHITE).lower()  # bytes.lower() takes A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _tag(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), U64)[::2] if digests else np.zeros(0, U64)


def _postings(min_chars: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            ids, keys = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if doc is None or (raw := text.as_py()) is None:
                    continue
                own = {k for line in raw.encode().split(b"\n") if (k := line_key(line, min_chars)) is not None}
                ids += [doc] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return run


def _make_filter(t: pa.Table) -> pa.Table:
    f = _build(_tag(t["key"].to_pylist()))
    return pa.table({"shard": t["shard"][:1], "filter": pa.array([f.to_bytes()], pa.binary())})


def _change_filter(old: pa.Table, changes: pa.Table) -> pa.Table:
    """changes: (shard, key, insert). A filter that gets too full is built anew by the caller's table of keys, so it has room here."""
    shard = (old if old.num_rows else changes)["shard"][:1]
    grow = changes.filter(changes["insert"])
    f = CuckooFilter.from_bytes(old["filter"][0].as_py()) if old.num_rows else CuckooFilter(max(1, 2 * grow.num_rows))
    f.delete(_tag(changes.filter(pa.compute.invert(changes["insert"]))["key"].to_pylist()))
    ok = f.insert(_tag(grow["key"].to_pylist()))
    return pa.table({"shard": shard, "filter": pa.array([f.to_bytes() if ok else None], pa.binary())})


def _probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, salt, filter, key, doc_id), each shard's filter before its lines: the lines that the filter may hold."""
    shard, f = None, None
    for b in batches(it):
        shards = b.column(0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(shards)) + 1
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(shards)], strict=True):
            part = b.slice(lo, hi - lo)
            if shards[lo] != shard:
                shard, f = shards[lo], None
            has = part.column(2).is_valid().to_numpy(zero_copy_only=False)
            if has.any():
                f = CuckooFilter.from_bytes(part.column(2)[int(np.flatnonzero(has)[0])].as_py())
            lines = part.filter(pa.array(~has))
            if f is None or not lines.num_rows:
                continue
            ok = pa.array(f.contains(_tag(lines.column(3).to_pylist())))
            yield pa.RecordBatch.from_arrays([lines.column(3).filter(ok), lines.column(4).filter(ok)], ["key", "doc_id"])


def _rewrite(min_chars: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            texts, lines, dropped = [], [], []
            for text, drops in zip(b.column("text"), b.column("drops").to_pylist(), strict=True):
                text = text.as_py() or ""
                n, gone = text.count("\n") + 1, 0
                if drops:
                    drops, parts = set(drops), text.encode().split(b"\n")
                    kept = [x for x in parts if line_key(x, min_chars) not in drops]
                    gone, text = n - len(kept), b"\n".join(kept).decode()
                texts.append(text)
                lines.append(n)
                dropped.append(gone)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("rest"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "rest", "n_lines", "n_dropped"])

    return run


class LineIndex:
    """Which lines of at least min_chars code points at least min_docs documents hold."""

    def __init__(self, min_chars: int, min_docs: int, shards: int, postings: DataFrame, refs: DataFrame, filters: DataFrame):
        self.min_chars, self.min_docs, self.shards = min_chars, min_docs, shards
        self.postings, self.refs, self.filters = postings, refs, filters

    @staticmethod
    def _keys(docs: DataFrame, min_chars: int, shards: int | None = None) -> DataFrame:
        staging.prepare(docs.sparkSession)
        out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_postings(min_chars), "doc_id long, key binary")
        return out.withColumn("shard", F.expr(f"pmod(xxhash64(key), {shards}L)")) if shards else out

    @staticmethod
    def _count(postings: DataFrame) -> DataFrame:
        return postings.groupBy("shard", "key").agg(F.countDistinct("doc_id").alias("refs"), F.max("doc_id").alias("last"))

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> LineIndex:
        raw = staging.staged(cls._keys(docs, min_chars), "lines")
        shards = max(1, -(-raw.count() // KEYS_PER_SHARD))
        postings = raw.withColumn("shard", F.expr(f"pmod(xxhash64(key), {shards}L)"))
        refs = staging.staged(cls._count(postings), "line-refs")
        filters = refs.where(F.col("refs") >= min_docs).select("shard", "key").groupBy("shard").applyInArrow(_make_filter, "shard long, filter binary")
        return cls(min_chars, min_docs, shards, postings, refs, staging.staged(filters, "line-filters"))

    def _changed(self, postings: DataFrame, touched: DataFrame) -> LineIndex:
        """The index over postings, whose touched keys alone differ from this one's."""
        new = staging.staged(self._count(postings.join(touched.select("key"), "key", "left_semi")), "line-refs")
        refs = self.refs.join(touched.select("key"), "key", "left_anti").select("shard", "key", "refs", "last").unionByName(new)
        was = self.refs.join(touched.select("key"), "key", "left_semi").where(F.col("refs") >= self.min_docs).select("shard", "key")
        now = new.where(F.col("refs") >= self.min_docs).select("shard", "key")
        changes = now.join(was, "key", "left_anti").select("shard", "key", F.lit(True).alias("insert")).unionByName(was.join(now, "key", "left_anti").select("shard", "key", F.lit(False).alias("insert")))
        shards = changes.select("shard").distinct()
        old = self.filters.join(shards, "shard", "left_semi").select("shard", "filter")
        made = staging.staged(old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_change_filter, "shard long, filter binary"), "line-filters")
        full = made.where("filter is null").select("shard")
        again = refs.where(F.col("refs") >= self.min_docs).join(full, "shard", "left_semi").select("shard", "key").groupBy("shard").applyInArrow(_make_filter, "shard long, filter binary")
        made = staging.staged(made.where("filter is not null").unionByName(again), "line-filters")
        filters = self.filters.join(made.select("shard"), "shard", "left_anti").select("shard", "filter").unionByName(made)
        return LineIndex(self.min_chars, self.min_docs, self.shards, postings, refs, filters)

    def compact(self) -> LineIndex:
        """The same index, its tables written whole."""
        return LineIndex(self.min_chars, self.min_docs, self.shards, *(staging.staged(t, n) for t, n in ((self.postings, "lines"), (self.refs, "line-refs"), (self.filters, "line-filters"))))

    def insert(self, docs: DataFrame) -> LineIndex:
        new = staging.staged(self._keys(docs, self.min_chars, self.shards).join(self.postings, ["doc_id", "key"], "left_anti"), "lines-new")
        return self._changed(self.postings.unionByName(new), new.select("key").distinct())

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """doc_ids: a column doc_id."""
        gone = staging.staged(self.postings.join(doc_ids.select("doc_id"), "doc_id", "left_semi"), "lines-gone")
        left = self.postings.join(staging.staged(doc_ids.select("doc_id").distinct(), "lines-deleted"), "doc_id", "left_anti")
        return self._changed(left.select(*self.postings.columns), gone.select("key").distinct())

    def drops(self) -> DataFrame:
        """(doc_id, key) of the lines to go: those that enough documents hold, but for the largest doc_id."""
        # only shards with a hot line: one for every SALTS * KEYS_PER_SHARD lines at most
        heavy = self.refs.groupBy("shard").agg(F.ceil(F.sum("refs") / KEYS_PER_SHARD).alias("_k")).where(F.col("_k") > SALTS)
        salts = F.coalesce(F.col("_k"), F.lit(SALTS).cast("long"))
        lines = self.postings.join(heavy, "shard", "left").select("shard", F.pmod(F.xxhash64("doc_id"), salts).alias("salt"), F.lit(None).cast("binary").alias("filter"), "key", "doc_id")
        filters = self.filters.join(heavy, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "filter", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"))
        met = lines.unionByName(filters).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        hits = met.mapInArrow(_probe, "key binary, doc_id long")
        exact = self.refs.where(F.col("refs") >= self.min_docs).select("key", "last")
        return hits.join(exact, "key").where("doc_id < last").select("doc_id", "key").distinct()

    def dedup(self, docs: DataFrame) -> DataFrame:
        """docs, whose lines are in the index, without the lines to go; with n_lines (before) and n_dropped."""
        rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
        kind = dict(docs.dtypes)
        drops = self.drops().groupBy("doc_id").agg(F.collect_list("key").alias("drops")).select(F.col("doc_id").alias("_id"), "drops")
        packed = docs.select("doc_id", F.col("text").cast("string"), staging.packed(rest).alias("rest"))
        met = packed.join(drops, packed.doc_id == drops._id, "left").drop("_id")
        schema = f"doc_id {kind['doc_id']}, text string, rest {met.schema['rest'].dataType.simpleString()}, n_lines long, n_dropped long"
        back = staging.unpacked(rest)
        out = met.mapInArrow(_rewrite(self.min_chars), schema)
        return out.select(*[back[c] if c in rest else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs without the lines that repeat; see LineIndex."""
    return LineIndex.build(docs, min_chars, min_docs).dedup(docs)
