"""N-gram Jaccard join: links of documents whose sets of word shingles are alike, exactly, and what they connect.

A document's set is that of its distinct shingles, as 64-bit hashes with a seed drawn for each call. Documents of equal sets are one
class from the start. Two classes that link share one of the first shingles of both sets in any common order (prefix filter); the order
used puts shingles first that few documents hold, by counts over all documents in a table of fixed size. Tiles are size bands of the
classes that share such a shingle: a band holds sizes up to 1 / threshold apart, so what links is in one band or in neighbours, and a
tile is a band with the one below it, whose own members are compared with each other and with those below. In a tile, parity bitmaps
bound the overlap from above: each shingle flips one bit, so two bitmaps differ in no more bits than the sets differ in shingles. What
may link is put in one bucket, to which each set goes once; there sorted arrays are intersected exactly. A bucket too large for a task
is cut by size bands, and what is still too large, like a tile, by a hash into one for each pair of parts, so that every pair still
meets in some task. Pairs that are already
connected are not compared again, so neither pairs nor links of a group of copies are ever spelled out.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A document of fewer words than a shingle has one, its whole sequence.

Defined cases: a null text, or one without words, has an empty set and links with nothing; rows that repeat a doc_id are one document
where they are equal, and else each counts; rows with a null doc_id link like others, and take the smallest doc_id of their component,
or null if none has one; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import staging
from attestra.llm.components import components
from attestra.llm.kernels import SPACE, U64, batches, group_windows, lower_ascii, mask_spans, mix, pieces, rows_of, span_hashes, utf8

COUNTER_BITS = 21
CHUNK = 1 << 14
#: Most classes of a tile or bucket, and most shingles of a bucket, before it is cut.
TILE = 3000
BUCKET_SHINGLES = 4_000_000
SAME_TILE = 64
#: A task forgets the sets that it has met beyond so many; repeats go when their rows meet.
SEEN = 200_000
#: So many places of classes in buckets, of some 80 bytes, are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Bits of the bitmap of documents whose texts are sent: 4 MB at most, however many there are.
WANTED_BITS = 1 << 24


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, one after the other; how many each has)."""
    low = lower_ascii(data)
    s, e = mask_spans(~SPACE[low], offsets)
    n = len(offsets) - 1
    h, g = group_windows(span_hashes(low, s, e, seed), np.bincount(rows_of(s, offsets), minlength=n), k)
    order = np.lexsort((h, g))
    h, g = h[order], g[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return h[new], np.bincount(g[new], minlength=n)


def bitmap_bits(n: int, num: int, den: int) -> int:
    """A power of two, at least 64, for sets of n.

    Linked sets of n differ in 2 n (den - num) / (den + num) shingles at most, and so in no more bits. Sets that share little differ
    in about half of the bits: three times n (den - num) / (den + num) or more, whatever the threshold.
    """
    return max(64, 1 << max(0, -(-6 * n * (den - num) // (den + num)) - 1).bit_length())


def bitmap(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """Bit i is the parity of how many shingles pick it; 64-bit words."""
    bits = bitmap_bits(len(h), num, den)
    odd = np.bincount((mix(h) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of fewer words that say the same of fewer bits."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def bands(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The size band of each set: sizes that can link are in one band or in neighbours."""
    # a little wider than the ratio: rounding never puts a pair that can link two bands apart
    return np.floor(np.log(n) / (np.log(den / num) * 1.0001)).astype(np.int64)


class _Group:
    """The classes of a tile or bucket; two from below its band are not compared there."""

    def __init__(self, n: np.ndarray, maps: list[np.ndarray], num: int, den: int, below: np.ndarray | None = None):
        self.n, self.num, self.den = n.astype(np.int64), num, den
        self.below = np.zeros(len(n), dtype=bool) if below is None else below
        self.width = np.array([len(m) for m in maps])
        self.by_width = {}
        for w in np.unique(self.width):
            at = np.flatnonzero(self.width >= w)
            place = np.full(len(maps), -1)
            place[at] = np.arange(len(at))
            folded = np.empty((len(at), w), U64)
            for wide in np.unique(self.width[at]):
                own = self.width[at] == wide
                folded[own] = _fold(np.stack([maps[i] for i in at[own]]), w)
            self.by_width[w] = (place, folded)

    def possible(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of others that may link with x by size and bitmap."""
        if self.below[x]:
            others = others[~self.below[others]]
        nx, no = self.n[x], self.n[others]
        others = others[(self.den * np.minimum(nx, no) >= self.num * np.maximum(nx, no))]
        out = []
        for w in np.unique(np.minimum(self.width[x], self.width[others])) if len(others) else ():
            part = others[np.minimum(self.width[x], self.width[others]) == w]
            place, rows = self.by_width[w]
            apart = np.bitwise_count(rows[place[part]] ^ rows[place[x]]).sum(1).astype(np.int64)
            both = nx + self.n[part]
            out.append(part[(both - apart) // 2 * (self.num + self.den) >= self.num * both])
        return np.concatenate(out) if out else others[:0]

    def spanning(self, linked) -> list[tuple[int, int]]:
        """Edges from each component's first class to its others; linked(x, others) gives those that link with x."""
        left, edges = np.argsort(self.n, kind="stable"), []
        while len(left):
            root, left = left[0], left[1:]
            todo = [root]
            while todo and len(left):
                found = linked(todo.pop(), left)
                if len(found):
                    edges += [(root, y) for y in found]
                    todo += found.tolist()
                    left = left[~np.isin(left, found)]
        return edges


def _key(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _half(key: bytes | None) -> int:
    return int.from_bytes(key[:8], "little", signed=True) if key else 0


def _count(k: int, seed: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches(it):
            total = np.zeros(1 << COUNTER_BITS, np.uint32) if total is None else total
            data, offsets = utf8(b.column(0))
            for i, j in pieces(offsets):
                h, _ = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k, seed)
                at, c = np.unique((h >> U64(64 - COUNTER_BITS)).astype(np.int64), return_counts=True)
                total[at] += c.astype(np.uint32)
        if total is not None:
            parts = total.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["chunk", "counts"])

    return run


def _add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's counts summed, as powers of two."""
    sums: dict[int, np.ndarray] = {}
    for b in batches(it):
        for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.int64)
            sums[chunk] = sums[chunk] + own if chunk in sums else own
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.log2(v + 1).astype(np.uint8).tobytes() for v in sums.values()], pa.binary())], ["chunk", "classes"])


def shingle_classes(docs: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """log2 of how many documents hold a shingle, at least, by the leading bits of its hash: 2 MB at any size of docs."""
    rows = docs.select("text").mapInArrow(_count(k, seed), "chunk int, counts binary").repartition("chunk").mapInArrow(_add, "chunk int, classes binary").collect()
    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    for r in rows:
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.classes, np.uint8)
    return out


def _postings(held, k: int, seed: int, num: int, den: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document (null token, id, n, doc_id, key, bitmap), and for each new set (token, id, n) of its first shingles.

        An id is half of a key. Sets that share it by chance only meet more often than they need to.
        """
        classes, seen = held.value, set()
        for b in batches(it):
            data, offsets = utf8(b.column(1))
            ids = b.column(0).to_pylist()
            for i, j in pieces(offsets):
                h, n = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k, seed)
                end = np.cumsum(n)
                keys, maps, fresh = [], [], np.zeros(j - i, dtype=bool)
                for r, (a, z) in enumerate(zip((end - n).tolist(), end.tolist(), strict=True)):
                    key = _key(h[a:z]) if z > a else None
                    keys.append(key)
                    fresh[r] = key is not None and key not in seen
                    maps.append(bitmap(h[a:z], num, den).tobytes() if fresh[r] else None)
                    if fresh[r]:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                half = np.array([_half(x) for x in keys], np.int64)
                yield _rows(None, half, n, ids[i:j], keys, maps)
                keep = n - -(-num * n // den) + 1
                keep[~fresh] = 0
                row = np.repeat(np.arange(j - i), n)
                order = np.lexsort((h, classes[(h >> U64(64 - COUNTER_BITS)).astype(np.int64)], row))
                rank = np.arange(len(h)) - np.repeat(end - n, n)
                take = rank < keep[row]
                token, of = h[order][take], row[take]
                for lo in range(0, len(token), 50_000):
                    part = of[lo : lo + 50_000]
                    yield _rows(token[lo : lo + 50_000].view(np.int64), half[part], n[part], None, None, None)

    return run


_POSTING = [("token", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64()), ("key", pa.binary()), ("bitmap", pa.binary())]
_POSTING_SQL = "token long, id long, n int, doc_id long, key binary, bitmap binary"
_BANDED_SQL = "token long, band int, below boolean, id long, n int, doc_id long, key binary, bitmap binary"


def _rows(*cols) -> pa.RecordBatch:
    size = len(cols[1])
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else pa.array(c, t) for c, (_, t) in zip(cols, _POSTING, strict=True)], [n for n, _ in _POSTING])


def _shared(num: int, den: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (token, n, id), without repeats and without those that share their token with no set of a size near theirs, in
        tiles; documents' rows pass."""
        held = None
        for b in batches(it):
            docs = b.filter(b.column(0).is_null())
            if docs.num_rows:
                yield _in_band(docs, np.arange(docs.num_rows), None, None)
            b = b.filter(b.column(0).is_valid())
            if held is not None:
                b = pa.concat_batches([held, b]) if b.num_rows else held
                held = None
            if not b.num_rows:
                continue
            token = b.column(0).to_numpy()
            last = int(np.flatnonzero(token == token[-1])[0])
            held = _unique(b.slice(last))
            if (out := _banded(_unique(b.slice(0, last)), num, den)) is not None:
                yield out
        if held is not None and (out := _banded(held, num, den)) is not None:
            yield out

    return run


def _in_band(b: pa.RecordBatch, take: np.ndarray, band: np.ndarray | None, below: np.ndarray | None) -> pa.RecordBatch:
    b = b.take(pa.array(take))
    extra = [pa.nulls(len(take), t) if c is None else pa.array(c, t) for c, t in ((band, pa.int32()), (below, pa.bool_()))]
    return pa.RecordBatch.from_arrays([b.column(0), *extra, *b.columns[1:]], [b.schema.names[0], "band", "below", *b.schema.names[1:]])


def _unique(b: pa.RecordBatch) -> pa.RecordBatch:
    if b.num_rows < 2:
        return b
    token, own = b.column(0).to_numpy(), b.column(1).to_numpy()
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
    return b.filter(pa.array(new))


def _banded(b: pa.RecordBatch, num: int, den: int) -> pa.RecordBatch | None:
    """Each row in the tile of its own band, and in the next where that band has members."""
    if not b.num_rows:
        return None
    token, n = b.column(0).to_numpy(), b.column(2).to_numpy().astype(np.int64)
    same = np.zeros(len(token) + 1, dtype=bool)
    # sizes are in order: whoever has a partner of a size that can link has one beside it
    same[1:-1] = (token[1:] == token[:-1]) & (den * n[:-1] >= num * n[1:])
    near = np.flatnonzero(same[1:] | same[:-1])
    if not len(near):
        return None
    band = bands(n[near], num, den)
    # the tiles that have members of their own band; rows are sorted by token and band
    start = np.flatnonzero(np.r_[True, (token[near][1:] != token[near][:-1]) | (band[1:] != band[:-1])])
    count = np.diff(np.r_[start, len(near)])
    after = np.zeros(len(start), dtype=bool)
    after[:-1] = (token[near][start[1:]] == token[near][start[:-1]]) & (band[start[1:]] == band[start[:-1]] + 1)
    up = np.flatnonzero(np.repeat(after, count))
    tile = np.repeat(np.arange(len(start)), count)
    take, of, below = np.r_[np.arange(len(near)), up], np.r_[tile, tile[up] + 1], np.r_[np.zeros(len(near), dtype=bool), np.ones(len(up), dtype=bool)]
    order = np.argsort(of, kind="stable")
    take, of, below = take[order], of[order], below[order]
    size = np.bincount(of, minlength=len(start))
    keep = size[of] > 1
    take, of, below = take[keep], of[keep], below[keep]
    if not len(take):
        return None
    out = _in_band(b, near[take], band[start][of], below)
    # copies share most of their shingles: small tiles of the same classes get the same name, and one of them is enough
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    size = np.diff(np.r_[first, len(of)])
    held = mix(out.column(3).to_numpy().view(U64) + below.astype(U64))
    name = mix(np.add.reduceat(held, first) + size.astype(U64)).view(np.int64)
    small = np.repeat(size <= SAME_TILE, size)
    named = np.where(small, np.repeat(name, size), out.column(0).to_numpy())
    return pa.RecordBatch.from_arrays([pa.array(named), *out.columns[1:]], out.schema.names)


def _cut_large(df: DataFrame, group: list[str], salt: str, weight: bool = False) -> DataFrame:
    """df with part: a group too large for a task comes as a tile for each pair of its parts by a hash of salt, so that all its pairs meet."""
    parts = F.ceil(F.count("*") / TILE)
    if weight:
        parts = F.greatest(parts, F.ceil(F.sum("n") / BUCKET_SHINGLES))
    large = df.groupBy(*group).agg(parts.cast("int").alias("_k")).where("_k > 1").hint("rebalance")
    split = df.join(large, group, "left").withColumn("_s", F.expr(f"cast(pmod(xxhash64({salt}), coalesce(_k, 1)) as int)"))
    tiles = F.expr("case when _k is null then array(0) else transform(sequence(0, _k - 1), j -> least(_s, j) * _k + greatest(_s, j)) end")
    return split.withColumn("part", F.explode(tiles)).select(*df.columns, "part")


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a tile ends; tiles are the runs of equal first three columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches(it):
        ident = list(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
        if last is not None and ident[0] != last:
            yield pa.concat_batches(held)
            held = []
        last = ident[-1]
        cut = len(ident)
        while cut and ident[cut - 1] == last:
            cut -= 1
        if cut:
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _bounds(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(b.num_rows, dtype=bool)
    new[1:] = False
    for c in range(3):
        v = b.column(c).to_numpy(zero_copy_only=False) if not pa.types.is_binary(b.column(c).type) else np.array(b.column(c).to_pylist(), object)
        new[1:] |= v[1:] != v[:-1]
    start = np.flatnonzero(new)
    return start, np.r_[start[1:], b.num_rows]


def _edges(pairs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    pairs = sorted(set(pairs))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], kind), pa.array([y for _, y in pairs], kind)], ["a", "b"])


def _tiles(num: int, den: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (token, band, part, id, n, bitmap, below) by tile: edges that span what may link."""
        for b in _groups(it):
            keys, n, below = b.column(3).to_pylist(), b.column(4).to_numpy().astype(np.int64), b.column(6).to_numpy(zero_copy_only=False)
            maps = [np.frombuffer(m, U64) for m in b.column(5).to_pylist()]
            start, end = _bounds(b)
            pairs = []
            for a, z in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist(), strict=True):
                if z - a == 2:
                    if below[a] and below[a + 1]:
                        continue
                    x, y = (a, a + 1) if n[a] <= n[a + 1] else (a + 1, a)
                    both = n[x] + n[y]
                    if den * n[x] >= num * n[y]:
                        wide = _fold(maps[y][None], len(maps[x]))[0]
                        apart = int(np.bitwise_count(wide ^ maps[x]).sum())
                        if (both - apart) // 2 * (num + den) >= num * both:
                            pairs.append((keys[x], keys[y]))
                    continue
                g = _Group(n[a:z], maps[a:z], num, den, below[a:z])
                pairs += [(keys[a + x], keys[a + y]) for x, y in g.spanning(g.possible)]
            if pairs:
                yield _edges(pairs, pa.int64())

    return run


def _buckets(k: int, seed: int, num: int, den: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (root, band, part, key, text, below) by bucket: edges that span what links."""
        for b in _groups(it):
            keys, below = b.column(3).to_pylist(), b.column(5).to_numpy(zero_copy_only=False)
            data, offsets = utf8(b.column(4))
            sets: list[np.ndarray] = []
            for i, j in pieces(offsets):
                h, n = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k, seed)
                sets += np.split(h, np.cumsum(n)[:-1])
            pairs = []
            # rows that share a doc_id may come with each other's texts
            right = np.array([_key(h) == k for h, k in zip(sets, keys, strict=True)])
            for a, z in zip(*_bounds(b), strict=True):
                own = a + np.flatnonzero(right[a:z])
                if len(own) > 1 and not below[own].all():
                    pairs += [(keys[own[x]], keys[own[y]]) for x, y in _linked([sets[i] for i in own], below[own], num, den)]
            if pairs:
                yield _edges(pairs, pa.binary())

    return run


def _linked(sets: list[np.ndarray], below: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    sizes = np.array([len(s) for s in sets])
    group = _Group(sizes, [bitmap(s, num, den) for s in sets], num, den, below)

    def linked(x: int, others: np.ndarray) -> np.ndarray:
        others = group.possible(x, others)
        out = []
        for lo in range(0, len(others), 500):
            part = others[lo : lo + 500]
            flat, own = np.concatenate([sets[o] for o in part]), sets[x]
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.add.reduceat(own[at] == flat, np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
            out.append(part[den * both >= num * (sizes[x] + sizes[part] - both)])
        return np.concatenate(out) if out else others

    return group.spanning(linked)


def _in_bands(members: DataFrame, num: int, den: int) -> DataFrame:
    """members (root, key, n, ...) with band and below: a root too large for one bucket gives one for each size band and the one below it."""
    parts = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / BUCKET_SHINGLES))
    large = members.groupBy("root").agg(parts.alias("_k")).where("_k > 1").select("root", F.lit(True).alias("_large")).hint("rebalance")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num) * 1.0001))).cast("int")
    to = lambda b, below: F.struct(b.alias("band"), F.lit(below).alias("below"))
    split = members.join(large, "root", "left").withColumn("_to", F.explode(F.when(F.col("_large"), F.array(to(band, False), to(band + 1, True))).otherwise(F.array(to(F.lit(-1), False)))))
    return split.select(*members.columns, "_to.band", "_to.below")


def _keys(k: int, seed: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            data, offsets = utf8(b.column(0))
            for i, j in pieces(offsets):
                h, n = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k, seed)
                cut = np.r_[0, np.cumsum(n)].tolist()
                keys = [_key(h[a:z]) if z > a else None for a, z in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0).slice(i, j - i)], ["key", "text"])

    return run


def link(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: documents link when den * intersection >= num * union."""
    spark = docs.sparkSession
    staging.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seed = secrets.randbits(64)
    held = spark.sparkContext.broadcast(shingle_classes(docs, shingle, seed))
    rows = docs.mapInArrow(_postings(held, shingle, seed, num, den), _POSTING_SQL)
    dealt = rows.withColumn("deal", F.coalesce("token", F.xxhash64("doc_id", "key"))).repartition("deal").sortWithinPartitions("token", "n", "id").drop("deal")
    both = staging.staged(dealt.mapInArrow(_shared(num, den), _BANDED_SQL), "jaccard")
    held.unpersist()
    vertices = both.where("token is null").select("doc_id", "n", "key", "id", "bitmap")
    classes = vertices.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.max("id").alias("id"), F.max("bitmap").alias("bitmap"))
    postings = both.where("token is not null").select("token", "band", "below", "id", "n").dropDuplicates(["token", "band", "id"])
    tiles = _cut_large(postings, ["token", "band"], "id").join(classes.select("id", "bitmap"), "id")
    tiles = tiles.select("token", "band", "part", "id", "n", "bitmap", "below").repartition("token", "band", "part").sortWithinPartitions("token", "band", "part")
    maybe = components(tiles.mapInArrow(_tiles(num, den), "a long, b long"))
    members = staging.staged(maybe.join(classes.select("id", "key", "first", "n"), maybe.node == F.col("id")).select("root", "key", "first", "n"), "members")
    cut = staging.staged(_cut_large(_in_bands(members, num, den), ["root", "band"], "key", weight=True).select("root", "band", "part", "below", "key", "first"), "buckets")
    small = cut.count() <= BROADCAST_ROWS
    to = lambda c: F.broadcast(c) if small else c
    # only texts that a bitmap of fixed size may hold are shuffled; the join drops those that it lets pass in vain
    place = lambda c: F.expr(f"pmod(xxhash64({c}), {WANTED_BITS}L)")
    wanted = members.select(place("first").alias("p")).groupBy(F.expr("p div 64").alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    texts = docs.withColumn("p", place("doc_id")).join(F.broadcast(wanted), F.expr("p div 64") == wanted.block).where("shiftrightunsigned(bits, cast(p % 64 as int)) & 1L = 1L").select(F.col("doc_id").alias("first"), "text")
    sent = texts.join(to(cut), "first").select("root", "band", "part", "key", "text", "below")
    # a class without a doc_id is found by its set
    nameless = docs.where("doc_id is null").select("text").mapInArrow(_keys(shingle, seed), "key binary, text string").join(to(cut.where("first is null")), "key")
    sent = sent.unionByName(nameless.select(*sent.columns)).repartition("root", "band", "part").sortWithinPartitions("root", "band", "part")
    found = components(sent.mapInArrow(_buckets(shingle, seed, num, den), "a binary, b binary"))
    named = classes.select("key", "first").join(found.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.join(least.hint("rebalance"), "root").select(F.col("key").alias("_key"), "component_id").hint("rebalance")
    out = vertices.join(names, vertices.key == names._key, "left")
    out = staging.staged(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "links")
    staging.discard(both, maybe, members, cut, found)
    return out
