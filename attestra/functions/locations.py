"""What a stated location says: its shape, and the position or the way to one.

A position outranks a way from a landmark in the same text, and what the text looks like outranks what it was declared to be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 16 points of the compass, clockwise from north.
POINTS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
#: Kilometres of a unit of distance.
UNIT_KM = {"km": 1.0, "kilometre": 1.0, "kilometer": 1.0, "kilometres": 1.0, "kilometers": 1.0, "nm": 1.852, "nmi": 1.852, "m": 0.001, "metre": 0.001, "meter": 0.001, "metres": 0.001, "meters": 0.001, "mi": 1.609344, "mile": 1.609344, "miles": 1.609344}
#: Parameters that hold a position in links to maps.
URL_KEYS = ("q", "ll", "query", "center", "sll", "daddr")
#: Classes of precision, the finest first.
PRECISIONS = ("pad", "site", "terminal", "district", "city", "province")

_STATED = "struct<lat: double, lon: double, precision: string>"


def _let(value: Column, f) -> Column:
    """f of value, which is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def place_of_precision(precision: Column) -> Column:
    """0 for the finest class, more for coarser ones, the most for a class that isn't known."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PRECISIONS]), precision), F.lit(0))
    return F.when(at > 0, at - 1).otherwise(len(PRECISIONS)).cast("int")


def finer(a: Column, b: Column) -> Column:
    """The finer of two classes of precision; one that isn't known never wins over one that is."""
    return F.when(place_of_precision(F.coalesce(b, F.lit(""))) < place_of_precision(F.coalesce(a, F.lit(""))), b).otherwise(F.coalesce(a, b))


def _by_decimals(*numbers: Column) -> Column:
    """4 decimals pin a pad, 2 a site, fewer a city."""
    most = F.greatest(*[F.length(F.regexp_extract(n, r"\.(\d+)", 1)) for n in numbers], F.lit(0))
    return F.when(most >= 4, "pad").when(most >= 2, "site").otherwise("city")


def _checked(lat: Column, lon: Column, precision: Column) -> Column:
    """The position, null if it is none on earth."""
    return _let(F.struct(lat.alias("lat"), lon.alias("lon"), precision.alias("precision")), lambda p: F.when(p["lat"].between(-90, 90) & p["lon"].between(-180, 180), p))


def decimal_pair(raw: Column) -> Column:
    """A text that is two numbers, each with or without a degree sign and a hemisphere."""
    bare = F.regexp_replace(F.upper(raw), "[°\\s]+", " ")
    parts = F.split(F.trim(F.regexp_replace(bare, r"(\d) ([NSEW])", "$1$2")), r"[,;/ ]+")
    number = lambda t: F.regexp_replace(t, "[NSEW]", "").try_cast("double")
    signed = lambda t, back: F.when(t.endswith(back), -F.abs(number(t))).otherwise(number(t))
    fits = lambda p: (F.size(p) == 2) & p[0].rlike(r"^-?\d{1,9}(\.\d+)?[NS]?$") & p[1].rlike(r"^-?\d{1,9}(\.\d+)?[EW]?$")
    return _let(F.when(fits(parts), parts), lambda p: _checked(signed(p[0], "S"), signed(p[1], "W"), _by_decimals(p[0], p[1])))


def _component(spaced: Column, letters: str, words: str, degree_digits: int) -> Column:
    """struct(value, n, packed) of the first one to three numbers n before a hemisphere's letter or word; packed if they are one word."""
    rx = rf"(?i)(?:^|[^\d.])(\d{{1,9}}(?:\.\d{{1,12}})?(?: \d{{1,9}}(?:\.\d{{1,12}})?){{0,2}}) ?([{letters}])(?:{words})?(?:[^A-Za-z]|$)"
    body = F.regexp_extract(spaced, rx, 1)
    cut = lambda b: F.array(F.substring(b, 1, degree_digits), F.substring(b, degree_digits + 1, 2), F.substring(b, degree_digits + 3, 2))
    part = lambda n, i: F.coalesce(F.try_element_at(n, F.lit(i)).try_cast("double"), F.lit(0.0))
    back = F.upper(F.regexp_extract(spaced, rx, 2)).isin("S", "W")

    def read(b: Column) -> Column:
        packed = b.rlike(r"^\d{4,7}$")
        # a lone digit behind packed degrees or minutes counts for nothing
        n = F.when(packed, F.filter(cut(b), lambda t: (F.length(t) == 2) | (F.length(t) == degree_digits))).otherwise(F.split(b, " "))
        return _let(n, lambda n: F.struct((part(n, 1) + part(n, 2) / 60 + part(n, 3) / 3600).alias("value"), n.alias("n"), packed.alias("packed"), F.length(b).alias("width")))

    got = _let(F.when(body != "", body), lambda b: F.when(b.isNotNull(), read(b)))
    return _let(got, lambda g: F.when(g.isNotNull(), F.struct(F.when(back, -g["value"]).otherwise(g["value"]).alias("value"), g["n"].alias("n"), g["packed"].alias("packed"), g["width"].alias("width"))))


def sexagesimal(raw: Column) -> Column:
    """Degrees with a hemisphere's letter or word behind them, anywhere in a text: with minutes and seconds, packed, or decimal."""
    spaced = F.regexp_replace(raw, "[°′″'\":\\-\\s]+", " ")
    plain = lambda c: (F.size(c["n"]) == 1) & c["n"][0].contains(".")
    long = lambda c: c["packed"] & (c["width"] >= 6)
    fields = lambda c: ~c["packed"] & (F.size(c["n"]) > 1)
    glyphs = raw.rlike("[°′'.:\\- ]\\s?\\d{1,9}\\s?[″\"]")

    def read(lat: Column, lon: Column) -> Column:
        precision = F.when(plain(lat) & plain(lon), _by_decimals(lat["n"][0], lon["n"][0])).when(glyphs | long(lat) | long(lon), "pad").when(fields(lat) | fields(lon), "site").otherwise("city")
        return _checked(lat["value"], lon["value"], precision)

    both = F.struct(_component(spaced, "NS", "orth|outh", 2).alias("lat"), _component(spaced, "EW", "ast|est", 3).alias("lon"))
    return _let(both, lambda p: F.when(p["lat"].isNotNull() & p["lon"].isNotNull(), read(p["lat"], p["lon"])))


def map_link(raw: Column) -> Column:
    """The position in a link to a map: in its query, after an @, or in its data."""
    def pair(text: Column, before: str, between: str) -> Column:
        rx = f"{before}(-?\\d+\\.\\d+){between}(-?\\d+\\.\\d+)"
        two = F.struct(F.regexp_extract(text, rx, 1).alias("lat"), F.regexp_extract(text, rx, 2).alias("lon"))
        return _let(two, lambda p: _checked(p["lat"].try_cast("double"), p["lon"].try_cast("double"), _by_decimals(p["lat"], p["lon"])))

    asked = [pair(F.regexp_replace(F.try_parse_url(raw, F.lit("QUERY"), F.lit(k)), "(?i)%2c", ","), "^", ",+") for k in URL_KEYS]
    return F.coalesce(*asked, pair(raw, "@", ","), pair(raw, "!3d", "!4d"))


def looks_like_grid(raw: Column) -> Column:
    """A military grid reference anywhere in the text: zone, band, square (I and O are no letters of it) and as many digits east as north."""
    rx = r"(?:^|[^0-9A-Z])(\d{1,2}) ?([C-HJ-NP-X]) ?[A-HJ-NP-Z][A-HJ-NP-V] ?(\d{1,10})(?: (\d{1,5}))?(?:[^0-9A-Z]|$)"
    flat = F.regexp_replace(F.upper(raw), r"\s+", " ")
    zone, east, north = (F.regexp_extract(flat, rx, i) for i in (1, 3, 4))
    return zone.try_cast("int").between(1, 60) & F.when(north == "", F.length(east) % 2 == 0).otherwise(F.length(east) == F.length(north))


def looks_like_utm(raw: Column) -> Column:
    """A text that is a zone, a band, an easting and a northing."""
    return F.regexp_replace(F.upper(F.trim(raw)), r"\s+", " ").rlike(r"^\d{1,2} ?[C-X] \d+(\.\d+)?( ?M?E)? \d+(\.\d+)?( ?M?N)?$")


def from_landmark(raw: Column) -> Column:
    """struct(km, bearing, anchor) of '~10 km NW of Gujranwala', anywhere in a text."""
    longest = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
    rx = rf"(?is)(?:^|[^\d.])(\d{{1,9}}(?:\.\d{{1,9}})?)\s{{0,3}}({longest(UNIT_KM)})\s+({longest(POINTS)})\s+of\s+(\S.*)$"  # bounded, as a text may be one long number
    number, unit, point, anchor = (F.regexp_extract(raw, rx, i) for i in (1, 2, 3, 4))
    table = lambda pairs: F.create_map(*[F.lit(v) for kv in pairs for v in kv])
    km = number.try_cast("double") * F.try_element_at(table(UNIT_KM.items()), F.lower(unit))
    bearing = F.try_element_at(table((p, 22.5 * i) for i, p in enumerate(POINTS)), F.upper(point))
    return F.when(number != "", F.struct(km.alias("km"), bearing.alias("bearing"), F.rtrim(F.regexp_replace(F.trim(anchor), r"[.,;]+$", "")).alias("anchor")))


def stated(raw: Column, declared: Column | None = None) -> Column:
    """struct(format, lat, lon, precision, km, bearing, anchor) of a stated location; null for a null or blank text.

    format is url, DMS, DD, MGRS, UTM, relative or toponym. Grids are told from names but not decoded. A text that looks like a position
    but can't be read as one is still a way from a landmark if it is one, else keeps its format without a position. What signs of
    minutes don't make a pair of angles may still be a pair of numbers. declared is heeded for a link that doesn't look like one.
    """
    text = F.trim(raw)
    low = F.lower(text)
    link = reduce(Column.__or__, [low.startswith(s) for s in ("http://", "https://", "geo:")]) | low.contains("maps.") | text.contains("/@")
    asked = link if declared is None else link | F.coalesce(declared == "url", F.lit(False))
    seen = F.struct(
        text.alias("text"), link.alias("link"), F.when(asked, map_link(text)).alias("url"), from_landmark(text).alias("way"), decimal_pair(text).alias("DD"), sexagesimal(text).alias("DMS"),
        text.rlike("[°′″]|\\d\\s*['\"]|\\d\\s*[:-]\\s*\\d").alias("marked"), looks_like_grid(text).alias("grid"), looks_like_utm(text).alias("utm"),
    )

    def shape(s: Column) -> Column:
        no_way = s["way"].isNull()
        return (
            F.when(s["link"], "url").when(s["grid"] & no_way, "MGRS").when(s["utm"] & no_way, "UTM")
            .when(s["marked"] & s["DMS"].isNotNull(), "DMS").when(s["DD"].isNotNull(), "DD").when(s["DMS"].isNotNull(), "DMS")
            .when(s["url"].isNotNull(), "url").when(s["marked"] & no_way, "DMS").when(~no_way, "relative").otherwise("toponym")
        )

    def read(s: Column, shape: Column) -> Column:
        at = F.when(shape == "url", s["url"]).when(shape == "DD", s["DD"]).when(shape == "DMS", s["DMS"]).otherwise(F.lit(None).cast(_STATED))
        out = F.struct(at.alias("at"), F.when(shape == "relative", s["way"]).alias("way"))
        return _let(out, lambda o: F.struct(shape.alias("format"), *[o["at"][c].alias(c) for c in ("lat", "lon", "precision")], *[o["way"][c].alias(c) for c in ("km", "bearing", "anchor")]))

    return _let(seen, lambda s: F.when(s["text"] != "", _let(shape(s), lambda f: read(s, f))))
