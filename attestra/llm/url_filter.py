"""URL filters: a blocked Bloom filter in front of an exact hash join, in DataFrame functions only.

A list entry is a host and the start of a path. A url is looked up by its candidate keys: each suffix of its host at a dot, joined
to each start of its path that is as long as some entry's path. The distinct keys first meet the Bloom filter, one row for each
block of four 64-bit words; those that pass go to an exact join with the list, which removes false positives.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no entry; repeated pages are judged alike;
an empty list gives every page the default verdict; further columns of pages stay, but those named like a result are replaced.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import staging

BITS_PER_KEY = 16
BLOCK_BITS = 256
RESULT = ("host", "path", "rule", "verdict")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for a null url and for one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _block(key: str, blocks: int) -> Column:
    return F.expr(f"pmod(xxhash64({key}), {blocks}L)")


def _bit(key: str, word: int) -> Column:
    """Which bit of a block's word a key sets: six bits of a second hash."""
    return F.expr(f"cast(shiftrightunsigned(xxhash64({key}, 'bits'), {6 * word}) & 63L as int)")


def bloom_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """One row (block, w0..w3) for each block in use, and the number of blocks. keys has one column, key."""
    blocks = max(1, math.ceil(n_keys * BITS_PER_KEY / BLOCK_BITS))
    bits = keys.select(_block("key", blocks).alias("block"), *[_bit("key", j).alias(f"b{j}") for j in range(4)])
    return bits.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, b{j})")).alias(f"w{j}") for j in range(4)]), blocks


def possible(keys: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The keys that the filter may hold."""
    hit = keys.withColumn("block", _block("key", blocks)).join(bloom, "block")
    for j in range(4):
        hit = hit.where(F.expr(f"shiftrightunsigned(w{j}, cast(shiftrightunsigned(xxhash64(key, 'bits'), {6 * j}) & 63L as int)) & 1L = 1L"))
    return hit.select("key")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (host, path, verdict), null or repeated entries allowed; of entries that fit, the longest host and path together win,
    then the later in the order of strings.
    """
    listed = rules.where("host is not null and path is not null and verdict is not null")
    listed = listed.groupBy(F.concat(ascii_lower(F.col("host")), "path").alias("key")).agg(F.max("verdict").alias("verdict"), F.max(F.length("path")).alias("plen"))
    # at most as many as a url's longest path has characters
    sizes = sorted(r.plen for r in listed.select("plen").distinct().collect())
    n_keys = listed.count()
    rest = [c for c in pages.columns if c not in RESULT]
    host, path = url_parts(F.col(f"`{url_col}`"))
    base = pages.select(staging.packed(rest).alias("rest"), host.alias("host"), path.alias("path"))
    back = staging.unpacked(rest).values()
    if not n_keys:
        return base.select(*back, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.")
    # no longer than the rules' longest host, so a host of many labels has no more keys than that
    deepest = listed.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("n")).first().n
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - F.lit(deepest) + 1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    starts = F.filter(F.transform(F.array(*[F.lit(n) for n in sizes]), lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))), lambda s: s.isNotNull())
    seen = base.select("host", "path").distinct()
    cand = seen.select("host", "path", F.explode(suffixes).alias("suffix"), starts.alias("starts")).select("host", "path", F.explode(F.transform("starts", lambda s: F.concat("suffix", s))).alias("key"))
    bloom, blocks = bloom_filter(listed.select("key"), n_keys)
    found = possible(cand.select("key").distinct(), bloom, blocks).join(listed, "key")
    # rebalance: the join gets an exchange of its own on both sides, which Spark can split where a key is hot
    hits = cand.join(found.hint("rebalance"), "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best"))
    hits = hits.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "best").hint("rebalance")
    out = base.join(hits, (base.host == hits._h) & (base.path == hits._p), "left")
    return out.select(*back, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
