"""From documents to claims: lines with spans, duplicates inside a document, ids, joins of spans and regions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.session import prepare


def _lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        row, line, start, text = [], [], [], []
        for i, t in enumerate(b.column(1).to_pylist()):
            at = 0
            for n, x in enumerate((t or "").split("\n"), 1):
                row.append(i)
                line.append(n)
                start.append(at)
                text.append(x)
                at += len(x) + 1
        cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(line, pa.int32()), pa.array(start, pa.int32()), pa.array(text, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "line", "start", "text"])


def line_regions(docs: DataFrame) -> DataFrame:
    """(doc_id, line, start, end, text) of lines that aren't blank; offsets are of characters, end exclusive. A null text has none.

    Each text is gone through once: built-in functions would copy what is before a line for each of them.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_lines, f"doc_id {kind}, line int, start int, text string")
    return rows.select("doc_id", "line", "start", (F.col("start") + F.length("text")).alias("end"), "text").where(F.trim("text") != "")


def overlapping(spans: DataFrame, regions: DataFrame, width: int = 4096) -> DataFrame:
    """(doc_id, span, line) of spans (doc_id, span, start, end) and regions that overlap, met by the cells that both touch."""
    cells = lambda: F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width))
    s = spans.select("doc_id", "span", F.col("start").alias("s0"), F.col("end").alias("s1"), F.explode(cells()).alias("cell"))
    r = regions.select("doc_id", "line", F.col("start").alias("r0"), F.col("end").alias("r1"), F.explode(cells()).alias("cell"))
    return s.join(r, ["doc_id", "cell"]).where("r0 < s1 and s0 < r1").select("doc_id", "span", "line").distinct()


def dedup_within(rows: DataFrame, scope: list[str], signature: list[str], order: list[Column]) -> DataFrame:
    """One row for each signature within its scope, the first in order, with n_copies and the sorted refs of all."""
    sig = F.sha2(F.to_json(F.struct(*signature)), 256)
    g = rows.withColumn("_sig", sig).groupBy(*scope, "_sig").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in scope]), F.struct(*order)).alias("r"), F.count("*").alias("n_copies"), F.array_sort(F.collect_set("ref")).alias("refs"))
    return g.select(*scope, "r.*", "n_copies", "refs")


def mint_ids(rows: DataFrame, doc: str, locator: Column, order: list[Column]) -> DataFrame:
    """rows with claim_id: document and locator, and a number from the second of a locator on."""
    w = Window.partitionBy(doc, "_loc").orderBy(*order)
    n = rows.withColumn("_loc", locator).withColumn("_n", F.row_number().over(w))
    return n.withColumn("claim_id", F.concat_ws("-", F.col(doc).cast("string"), "_loc", F.when(F.col("_n") > 1, F.col("_n").cast("string")))).drop("_loc", "_n")


def remap(refs: Column, ids: Column) -> Column:
    """Ids through a map, those that it lacks as they are."""
    return F.transform(refs, lambda x: F.coalesce(F.try_element_at(ids, x), x))


def pack_windows(pages: DataFrame, most_pages: int = 8, most_chars: int = 60_000) -> DataFrame:
    """pages (doc_id, page, n_chars) with window: pages in order, as many as fit; a document's pages are one group."""

    def pack(s: Column, p: Column) -> Column:
        full = (s["count"] >= most_pages) | F.coalesce(s["chars"] + p["n"] > most_chars, F.lit(False))
        turn = (s["count"] > 0) & full
        window, count, chars = s["window"] + turn.cast("int"), F.when(turn, 0).otherwise(s["count"]) + 1, F.when(turn, 0.0).otherwise(s["chars"]) + p["n"]
        return F.struct(F.concat(s["out"], F.array(F.struct(p["page"].alias("page"), window.alias("window")))).alias("out"), window.alias("window"), count.alias("count"), chars.alias("chars"))

    page = F.struct(F.col("page").isNull().alias("last"), F.col("page").cast("int").alias("page"), F.col("n_chars").cast("double").alias("n"))
    docs = pages.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    none = F.struct(F.array().cast("array<struct<page:int,window:int>>").alias("out"), F.lit(0).alias("window"), F.lit(0).alias("count"), F.lit(0.0).alias("chars"))
    return docs.select("doc_id", F.explode(F.aggregate("pages", none, pack, lambda s: s["out"])).alias("p")).select("doc_id", "p.page", "p.window")


def basing(occupancy: DataFrame, formation: DataFrame) -> DataFrame:
    """(unit, site, equipment, at): equipment seen at a site, and the unit that holds it by most claims, put the unit at the site.

    occupancy: (equipment, site, at); formation: (equipment, unit).
    """
    n = formation.groupBy("equipment", "unit").agg(F.count("*").alias("n"))
    top = n.groupBy("equipment").agg(F.min_by("unit", F.struct((-F.col("n")).alias("n"), "unit")).alias("unit"))
    return occupancy.join(top, "equipment").groupBy("unit", "site", "equipment").agg(F.max("at").alias("at"))
