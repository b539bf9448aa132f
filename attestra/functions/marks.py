"""Small rules as columns: ids of places in documents, what an observation states, how values are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for an occupied site, framings that show it from above, and event kinds with their types.
OCCUPIED = ("occupied", "garrison", "active", "deployed", "manned", "present", "occupation")
OVERHEAD = ("overhead", "satellite", "nadir", "near-nadir", "top-down", "vertical")
EVENT_TYPES = {"transfer": "TransferEvent", "induction": "InductionEvent", "sighting": "SightingEvent", "exercise": "ExerciseEvent"}


def _occupied(word: Column) -> Column:
    low = F.lower(word)
    out = F.lit(False)
    for token in OCCUPIED:
        out = out | F.coalesce(F.contains(low, F.lit(token)), F.lit(False))
    return out


def states_vacancy(polarity: Column, occupancy: Column) -> Column:
    """Whether an observation says that nobody is there. A word that isn't given says nothing."""
    blank = F.coalesce(F.trim(occupancy) == "", F.lit(True))
    return F.when(~F.coalesce(polarity == "positive", F.lit(False)), True).when(blank, False).otherwise(~_occupied(occupancy))


def may_corroborate(n_features: Column, occupancy: Column, resolution: Column, frame: Column) -> Column:
    """Whether a picture may carry a reading of what is deployed: something seen, a site in use, enough resolution, seen from above."""
    low = F.lower(F.coalesce(frame, F.lit("")))
    return (n_features > 0) & _occupied(occupancy) & ~F.startswith(F.lower(F.coalesce(resolution, F.lit(""))), F.lit("insuff")) & ((low == "") | low.isin(*OVERHEAD))


def locatable(place: Column, lat: Column, lon: Column) -> Column:
    """Whether a site can be pointed to: by a listed place or by coordinates."""
    return place.isNotNull() | (lat.isNotNull() & lon.isNotNull())


def count_range(low: Column, high: Column, abstained: Column) -> Column:
    """(low, high) of a counted range, both null where the reader abstained; a count is never one number."""
    no = F.coalesce(abstained, F.lit(False))
    return F.struct(F.when(~no, low).alias("low"), F.when(~no, high).alias("high"))


def event_type(kind: Column, system: Column, supplier: Column, recipient: Column, unit: Column) -> Column:
    """The type of an event mention: what its kind says, else what its participants imply; null without participants."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    stated = F.lit("SightingEvent")
    for k, v in EVENT_TYPES.items():
        stated = F.when(kind == k, v).otherwise(stated)
    guess = F.when(has(supplier) & has(recipient), "TransferEvent").when(has(unit) & has(system), "InductionEvent").otherwise("SightingEvent")
    return F.when(has(system) | has(supplier) | has(recipient) | has(unit), F.when(has(kind), stated).otherwise(guess))


def locator(row: Column, line: Column, frame: Column, page: Column, region: Column, start: Column) -> Column:
    """A short handle of a place in a document: its row, else line, frame, page, region (letters and digits) or first character."""
    tag = lambda p, c: F.when(c.isNotNull(), F.concat(F.lit(p), c.cast("string")))
    named = F.when(region.isNotNull(), F.coalesce(F.nullif(F.regexp_replace(F.lower(region), r"[^\p{L}\p{N}]", ""), F.lit("")), F.lit("img")))
    return F.coalesce(tag("row", row), tag("l", line), tag("f", frame), tag("p", page), named, tag("c", start), F.lit("c0"))


def place_order(start: Column, end: Column, line: Column, row: Column, page: Column, frame: Column, region: Column, file: Column) -> Column:
    """What places in documents are sorted by: exact spans first, then lines, rows, pages and frames; what isn't given comes last."""
    late = lambda c: F.coalesce(c.cast("double"), F.lit(float("inf")))
    return F.struct(late(start), late(end), late(line), late(row), late(page), late(frame), F.coalesce(region, F.lit("")), file)


def quote_supported(quote: Column, text: Column) -> Column:
    """Whether text holds the quote, but for white space. A blank quote supports nothing."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.coalesce((flat(quote) != "") & F.contains(flat(text), flat(quote)), F.lit(False))


def dots(confidence: Column) -> Column:
    """1 to 4 for a confidence; 2 where it isn't known."""
    return F.when(confidence.isNull(), 2).when(confidence < 0.25, 1).when(confidence < 0.5, 2).when(confidence < 0.75, 3).otherwise(4)


def humanised(token: Column) -> Column:
    return F.trim(F.regexp_replace(token, "[-_]", " "))


def types_allowed(a: Column, b: Column) -> Column:
    """The types that both of two edges let an end have, in order."""
    return F.array_sort(F.array_intersect(a, b))
