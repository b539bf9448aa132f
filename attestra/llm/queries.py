"""The queries of this subpackage and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bpe, chat, decontaminate, fingerprints, jaccard_join, line_dedup, manifest, mixing, runs, staging, token_binary, toxicity, url_filter, warc

#: Fixed values of the url rules: host, path, verdict.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    staging.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL_OP4 = """
WITH lines AS (
  SELECT doc_id, i, string_split(t, chr(10))[i] AS line
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), range(1, len(string_split(t, chr(10))) + 1) AS r(i)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), refs AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id < r.last AS gone FROM keyed k LEFT JOIN refs r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    out = url_filter.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


SQL_OP8 = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(rh, rp, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT u.page_id, u.host, u.path, r.rh || r.rp AS rule, r.v, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rh || r.rp) DESC) AS k
  FROM urls u LEFT JOIN rules r ON (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE k = 1
"""


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score_documents(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))
    return out.select("doc_id", "held_out", "score", "predicted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.new_path(spark, "ids")
    manifest = token_binary.write_ids(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_binary.read_digests(manifest, path)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.build_conversations(_read(spark, sf_dir, "conversations"))
    return out.select("conv_id", "position", "thread", "turn", "role", "reply_to", "n_quotes", "n_linked", F.sha2("text", 256).alias("text_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


SQL_OP7 = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM iw, range(1, len(w) - least(13, len(w)) + 2) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM windows), hits AS (
  SELECT d.doc_id, d.i, d.k, v.item_id
  FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM dw, sizes, range(1, len(w) - k + 2) AS r(i)) d JOIN windows v ON d.k = v.k AND d.g = v.g
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + j AS p FROM hits, range(0, k) AS r(j)) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(_read(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    path = staging.new_path(spark, "warc")
    warc.write_pages(pages, path, compression="gzip")
    return warc.read_pages(spark, path)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), where a tenth of the ids, by their hash, repeat the words of a text from one word on in turn."""
    h, n, a, p = F.col("_h"), F.col("_n"), F.col("_a"), F.col("_p")
    d = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string")))
    d = d.withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(runs.WORDS), F.lit(0)))).withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.floor(h / 10))
    d = d.withColumn("_a", (F.col("_g") % F.greatest(n, F.lit(1))).cast("int")).withColumn("_p", F.floor(1 + (n - a) / (3 + F.col("_g") % 8)).cast("int"))
    unit = F.slice("_w", a + 1, F.greatest(p, F.lit(1)))
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / F.greatest(p, F.lit(1))).cast("int"))), F.lit(1), (n - a).cast("int"))
    return d.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice("_w", F.lit(1), a), again), " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.collapse_runs(with_planted_runs(_read(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("top", runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    top = [F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")]
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *top, F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: crc32 of a decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

#: Every earlier occurrence of a word within a quarter of its text is a row of its lag here.
SQL_OP11 = f"""
WITH split AS (SELECT doc_id, {_WORDS} AS w, coalesce({_CRC}, 1) AS h FROM documents
), marked AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split
), turned AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM marked
), words AS MATERIALIZED (
  SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(0, n)) AS i FROM turned)
), steps AS (
  SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island
  FROM (SELECT x.doc_id, x.i - y.i AS lag, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i AND x.i - y.i <= x.n // 4)
), stretches AS (
  SELECT doc_id, lag, min(i) - lag AS start, count(*) + lag AS length FROM steps GROUP BY doc_id, lag, island HAVING count(*) + lag >= greatest(6, 4 * lag)
), runs AS (SELECT doc_id, start, length, min(lag) AS period FROM stretches GROUP BY ALL
), said AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1
), best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents LEFT JOIN said USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


SQL_OP12 = f"""
WITH sized AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('12:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents
), sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1
), weighed AS (SELECT *, 3 * source_size AS most, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sources
), ordered AS (
  SELECT *, row_number() OVER o AS place, sum(source_size) OVER ()::BIGINT - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words_left,
    sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS weight_left
  FROM weighed WINDOW o AS (ORDER BY most / weight, source NULLS LAST)
), reached AS (SELECT coalesce(arg_min(words_left / weight_left, place), 0.0) AS level FROM ordered WHERE most / weight > words_left / weight_left
), targets AS (SELECT source, source_size, least(most::DOUBLE, level * weight) AS target FROM weighed, reached
), placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget - budget // source_size * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    made = manifest.build(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", ["doc_id"], other={"text": tampered})
    return manifest.prove(made).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_LEVELS = 6


def _said(field: str) -> str:
    return f"coalesce(octet_length(encode({field}::VARCHAR)) || ':' || {field}::VARCHAR, '-')"


def _tree_sql(name: str, leaves: str) -> str:
    """Levels of the trees of leaves (tree, j, d, n): name0 to name{_LEVELS}, with what stands before and after a node in its run."""
    out = f"{name}0 AS MATERIALIZED ({leaves})"
    for i in range(_LEVELS):
        out += f""", {name}r{i} AS MATERIALIZED (
  SELECT tree, j // 16 AS j, n, list(d ORDER BY j) AS run FROM {name}{i} GROUP BY tree, j // 16, n
), {name}{i + 1} AS MATERIALIZED (SELECT tree, j, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS d, (n + 15) // 16 AS n FROM {name}r{i})"""
    return out


def _way_sql(given: str, name: str, tree: str, number: str) -> str:
    """given with proof and folded carried up the levels of name."""
    out, last = "", given
    for i in range(_LEVELS):
        k = f"g.{number} // {16**i} % 16"
        out += f""", {name}w{i} AS (
  SELECT g.* EXCLUDE (proof, folded), CASE WHEN r.n = 1 THEN proof ELSE proof || array_to_string(run[:{k}], '') || array_to_string(run[{k} + 2:], '') END AS proof,
    CASE WHEN r.n = 1 THEN folded ELSE sha256(array_to_string(run[:{k}], '') || folded || array_to_string(run[{k} + 2:], '')) END AS folded
  FROM {last} g JOIN {name}r{i} r ON r.tree = {tree} AND r.j = g.{number} // {16 ** (i + 1)})"""
        last = f"{name}w{i}"
    return out


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELDS = ("doc_id", "source", "lang", "n_chars")
_HEAD = " || ".join(map(_said, _FIELDS))

#: Trees of up to 16 ** _LEVELS leaves.
SQL_OP13 = f"""
WITH hashed AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree, sha256({_HEAD} || {_said('text')}) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_HEAD} || {_said(_LOWER)}) END AS other
  FROM documents
), numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS j, count(*) OVER (PARTITION BY tree) AS n FROM hashed
), {_tree_sql('t', 'SELECT tree, j, leaf AS d, n FROM numbered')}
, subroots AS MATERIALIZED (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS turn, count(*) OVER () AS n FROM t{_LEVELS}
), {_tree_sql('s', "SELECT 'all' AS tree, turn AS j, subroot AS d, n FROM subroots")}
, begun AS (SELECT doc_id, leaf, m.tree, j, subroot, turn, '' AS proof, coalesce(other, leaf) AS folded FROM numbered m JOIN subroots USING (tree))
{_way_sql('begun', 't', 'g.tree', 'j')}
{_way_sql(f'tw{_LEVELS - 1}', 's', "'all'", 'turn')}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM sw{_LEVELS - 1}, (SELECT d AS root FROM s{_LEVELS})
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_binary": op5_token_binary,
    "op6_chat": op6_chat,
    "op7_decontamination": op7_decontamination,
    "op8_url_filter": op8_url_filter,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_warc": op10_warc,
    "op11_runs": op11_runs,
    "op12_mixing": op12_mixing,
    "op13_manifest": op13_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": SQL_OP4,
    "op7_decontamination": SQL_OP7,
    "op8_url_filter": SQL_OP8,
    "op11_runs": SQL_OP11,
    "op12_mixing": SQL_OP12,
    "op13_manifest": SQL_OP13,
}
