"""Text functions as columns; Jaro-Winkler, which Spark lacks, as an Arrow UDF."""

from __future__ import annotations

from html.entities import name2codepoint

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from attestra.operators.graph import written

#: Fixed set of scripts that a name keeps: digits, Latin, CJK, Cyrillic, Arabic, Devanagari.
_KEPT = r"[^0-9a-zÀ-ɏ一-鿿Ѐ-ӿ؀-ۿऀ-ॿ]+"


def transliterate(x: Column, pairs: dict[str, str]) -> Column:
    """Replace keys one after the other, the longest first."""
    for k in sorted(pairs, key=lambda k: (-len(k), k)):
        x = F.replace(x, F.lit(k), F.lit(pairs[k]))
    return x


def normalise_name(x: Column, pairs: dict[str, str] | None = None) -> Column:
    return F.trim(F.regexp_replace(F.lower(transliterate(x, pairs or {})), _KEPT, " "))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def token_form(x: Column) -> Column:
    return F.array_join(F.array_sort(tokens(x)), " ")


def query_form(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def squash(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^0-9a-z]", "")


def acronym(x: Column) -> Column:
    return F.array_join(F.transform(tokens(x), lambda t: F.left(t, F.lit(1))), "")


def contains_name(short: Column, long: Column, least_tokens: int = 1, least_added: int = 3) -> Column:
    """long begins with all of short's tokens; the first it adds is alphabetic and long enough."""
    s, t = tokens(short), tokens(long)
    added = F.try_element_at(t, F.size(s) + 1)
    return (F.size(s) >= least_tokens) & (F.size(t) > F.size(s)) & (F.slice(t, 1, F.size(s)) == s) & F.coalesce(added.rlike(f"^[a-z]{{{least_added},}}$"), F.lit(False))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, a row for each text, filled up with -1; lengths)."""
    sizes = np.array([len(t) for t in texts])
    out = np.full((len(texts), int(sizes.max(initial=0))), -1, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    return out, sizes


def jaro_winkler_of(left: list[str], right: list[str]) -> np.ndarray:
    """The similarity of left[i] and right[i]: all pairs advance together, one character of left at a time."""
    a, la = _codes(left)
    b, lb = _codes(right)
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    place = np.arange(b.shape[1])
    used, hit = np.zeros(b.shape, bool), np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        fits = (b == a[:, i : i + 1]) & ~used & (np.abs(place - i) <= reach[:, None]) & (i < la)[:, None]
        row = np.flatnonzero(fits.any(axis=1))
        used[row, fits[row].argmax(axis=1)] = True
        hit[row, i] = True
    m = hit.sum(axis=1)
    # matched characters of both sides in order, side by side
    k = int(m.max(initial=0))
    own, other = (np.full((len(m), k), -2, np.int32) for _ in range(2))
    slots = np.arange(k) < m[:, None]
    own[slots], other[slots] = a[hit], b[used]
    swaps = (own != other).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3, 0.0)
    n = min(4, a.shape[1], b.shape[1])
    same = (a[:, :n] == b[:, :n]) & (a[:, :n] >= 0)
    prefix = np.cumprod(same, axis=1).sum(axis=1) if n else np.zeros(len(m))
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    # pairs of like length together, so that a long one doesn't widen all
    x, y = a.fillna("").tolist(), b.fillna("").tolist()
    size = np.array([max(len(s), len(t)) for s, t in zip(x, y, strict=True)])
    out = np.zeros(len(x))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        to = int(np.searchsorted(size[order], 2 * size[order[at]] + 8, side="right"))
        to = min(to, at + max(1, (1 << 20) // max(1, int(size[order[to - 1]]))))
        some = order[at:to]
        out[some] = jaro_winkler_of([x[i] for i in some], [y[i] for i in some])
        at = to
    return pd.Series(out)


def name_similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler of the sorted tokens."""
    return jaro_winkler(token_form(a), token_form(b))


def _same_as(term: str):
    return lambda x: x == term


def bm25(docs: DataFrame, query: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of docs (id, tokens) for the query's terms, which are few: one pass over the tokens, for their number and those of the
    query, which are kept; statistics and scores come from these."""
    docs = written(docs.select("id", F.size("tokens").alias("size"), F.filter("tokens", lambda t: t.isin(query)).alias("hits")))
    n = docs.agg(F.count("*").alias("n"), F.avg("size").alias("avg"), *[F.count(F.when(F.array_contains("hits", t), 1)).alias(f"d{i}") for i, t in enumerate(query)]).first()
    score = F.lit(0.0)
    for i, t in enumerate(query):
        df = n[f"d{i}"]
        idf = F.log(F.lit((n.n - df + 0.5) / (df + 0.5) + 1.0))
        tf = F.size(F.filter("hits", _same_as(t))).cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.lit(n.avg or 1.0)))
    return docs.select("id", score.alias("score")).where("score > 0")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """{name} replaced by its value; a missing value leaves nothing."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    return F.regexp_replace(template, r"\{[a-z_]+\}", "")


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^0-9a-z]+", "-"), F.lit("-"))


def unescaped(x: Column) -> Column:
    """x with entities as characters, each once: those that HTML 4 names, &apos;, decimal and hexadecimal ones. Others stay as they are."""
    names = F.create_map(*[F.lit(v) for k, c in {**name2codepoint, "apos": 39}.items() for v in (k, chr(c))])

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^&(#?[0-9A-Za-z]+);", 1)
        digits, hexa = F.regexp_extract(name, r"^#(\d{1,7})$", 1), F.regexp_extract(name, "^#[xX]([0-9A-Fa-f]{1,6})$", 1)
        code = F.coalesce(digits.try_cast("int"), F.conv(F.nullif(hexa, F.lit("")), 16, 10).try_cast("int"))
        ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.coalesce(F.try_element_at(names, name), F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        return F.when(char.isNotNull(), F.concat(char, F.substr(piece, F.length(name) + 3))).otherwise(piece)

    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(F.split(x, "(?=&)"), one), "")).otherwise(x)


def html_text(html: Column) -> Column:
    """Visible text: script, style and head go, block tags break lines, blank runs collapse."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|head)\b.*?</\1\s*>", "")
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|nav|section|article|footer|header|body|html)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    x = F.replace(unescaped(x), F.lit("\u00a0"), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n"))
