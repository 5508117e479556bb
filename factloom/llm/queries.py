"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .embedding_dedup import embedding_near_duplicates
from .fingerprints import document_fingerprints, edited_text, texts_of, with_next
from .language_id import identify_languages
from .mixing import mix_sources, source_targets
from .ngram_jaccard import ngram_jaccard_classes
from .packing import best_fit_packing
from .quality import quality_model, rate_documents
from .substring_dedup import substring_dedup
from .tokens import token_histogram
from .url_filters import host_of, temporal_list_join


def op1_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard_classes(spark, read(spark, sf_dir, "documents"), k=5, percent=80)


def op2_language_id(spark, sf_dir):
    return identify_languages(spark, read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    return best_fit_packing(spark, read(spark, sf_dir, "documents"), capacity=4096, end=1)


def op4_url_filters(spark, sf_dir):
    """Every page as a capture, fetched on a day of 2024 that its number tells, against a list drawn up over all hosts of pages.

    The list: each host by a byte x of its hash. If x mod 3 is 0, the host is added on day x mod 200,
    removed 60 days later if x is even, and added again after another 60 if x mod 5 is 0. If x mod 4 is 1,
    its path /en is added on day 60. Hosts of the form a.b.net also list b.net from day 150 to day 180."""
    pages = read(spark, sf_dir, "pages")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", day(F.col("page_id") * 37 % 366).alias("fetched_at"))
    hosts = pages.select(host_of(F.col("url")).alias("h")).filter("h IS NOT NULL").distinct()
    hosts = hosts.withColumn("x", F.conv(F.substring(F.md5("h"), 1, 2), 16, 10).cast("int"))
    x, base = F.col("x"), F.regexp_extract("h", r"([^.]+\.net)$", 1)
    entry = lambda when, kind, pattern, action, n: F.when(when, F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day(n).alias("dated")))
    listed = F.array(
        entry(x % 3 == 0, "domain", F.col("h"), "add", x % 200),
        entry((x % 3 == 0) & (x % 2 == 0), "domain", F.col("h"), "remove", x % 200 + 60),
        entry((x % 3 == 0) & (x % 2 == 0) & (x % 5 == 0), "domain", F.col("h"), "add", x % 200 + 120),
        entry(x % 4 == 1, "url", F.concat("h", F.lit("/en")), "add", F.lit(60)),
        entry(base != "", "domain", base, "add", F.lit(150)),
        entry(base != "", "domain", base, "remove", F.lit(180)),
    )
    entries = hosts.select(F.explode(F.array_compact(listed)).alias("e")).select("e.*").distinct()
    return temporal_list_join(captures, entries).withColumnRenamed("capture_id", "page_id")


def op5_token_counts(spark, sf_dir):
    return token_histogram(spark, read(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark, sf_dir):
    return embedding_near_duplicates(spark, read(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_mix_sources(spark, sf_dir):
    return mix_sources(spark, read(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5, most=2)


def op8_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return rate_documents(docs.select("doc_id", "text"), quality_model(spark, docs, sf_dir), enough=2, least=0.4).drop("text")


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup(spark, read(spark, sf_dir, "documents"), width=13, text=False)


def op10_document_fingerprints(spark, sf_dir):
    return document_fingerprints(spark, read(spark, sf_dir, "documents"), samples=32)


def mixing_targets(spark, sf_dir):
    """The targets of op7's sources alone, in whole thousandths of a word."""
    goals = source_targets(read(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5, most=2)
    return goals.select("source", "source_size", F.round(F.col("target") * 1000).cast("long").alias("target_thousandths"))


def edited_texts(spark, sf_dir):
    """What op10 fingerprints besides the texts themselves: its columns without samples."""
    docs = with_next(texts_of(read(spark, sf_dir, "documents")))
    return docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited_text(), 256).alias("edited_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_language_id, op3_best_fit_packing, op4_url_filters, op5_token_counts, op6_embedding_dedup,
        op7_mix_sources, op8_quality_classifier, op9_substring_dedup, op10_document_fingerprints, mixing_targets, edited_texts,
    )
}
ORACLES: dict[str, str] = {
    "op4_url_filters": r"""
WITH captures AS (
  SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS fetched_at,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hosts AS (
  SELECT host AS h, CAST('0x' || substr(md5(host), 1, 2) AS INT) AS x, regexp_extract(host, '([^.]+\.net)$', 1) AS base
  FROM captures WHERE host IS NOT NULL GROUP BY host),
entries AS (
  SELECT 'domain' AS kind, h AS pattern, true AS adds, x % 200 AS n FROM hosts WHERE x % 3 = 0
  UNION SELECT 'domain', h, false, x % 200 + 60 FROM hosts WHERE x % 3 = 0 AND x % 2 = 0
  UNION SELECT 'domain', h, true, x % 200 + 120 FROM hosts WHERE x % 3 = 0 AND x % 2 = 0 AND x % 5 = 0
  UNION SELECT 'url', h || '/en', true, 60 FROM hosts WHERE x % 4 = 1
  UNION SELECT 'domain', base, true, 150 FROM hosts WHERE base <> ''
  UNION SELECT 'domain', base, false, 180 FROM hosts WHERE base <> ''),
dated AS (SELECT kind, pattern, DATE '2024-01-01' + CAST(n AS INT) AS dated, bool_or(adds) AS adds FROM entries GROUP BY ALL),
changes AS (SELECT * FROM (SELECT *, lag(adds) OVER (PARTITION BY kind, pattern ORDER BY dated) AS before FROM dated) WHERE before IS NULL OR before <> adds),
valid AS (SELECT * FROM (SELECT *, lead(dated) OVER (PARTITION BY kind, pattern ORDER BY dated) AS valid_to FROM changes) WHERE adds),
hits AS (
  SELECT c.page_id, c.url, v.pattern, v.dated FROM captures c JOIN valid v
  ON c.fetched_at >= v.dated AND (v.valid_to IS NULL OR c.fetched_at < v.valid_to)
  AND (CASE WHEN v.kind = 'domain' THEN c.host = v.pattern OR ends_with(c.host, '.' || v.pattern)
       ELSE starts_with(c.host || c.path || '/', v.pattern || '/') END))
SELECT c.page_id, c.host, count(h.pattern) AS n_active, count(h.pattern) > 0 AS blocked
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND c.url = h.url GROUP BY c.page_id, c.url, c.fetched_at, c.host
""",
    "op1_ngram_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT d.doc_id, count(s) AS n FROM d LEFT JOIN shingles USING (doc_id) GROUP BY d.doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common.n >= 80 * (p.n + q.n - common.n)),
reach AS (SELECT doc_id, doc_id AS low FROM d UNION SELECT y, low FROM reach JOIN links ON x = doc_id WHERE low < y)
SELECT doc_id, n AS n_shingles, low AS component_id FROM sizes JOIN (SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id) USING (doc_id)
""",
    "op6_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS low FROM embeddings UNION SELECT y, low FROM reach JOIN links ON x = vec_id WHERE low < y),
classes AS (SELECT vec_id, min(low) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN classes USING (vec_id) LEFT JOIN counts USING (vec_id)
""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN first USING (s) WHERE doc_id > low),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "mixing_targets": r"""
WITH sized AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size FROM documents GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sized),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
settled AS (SELECT *, 2.0 * source_size < weight * level AS capped FROM levels),
flat AS (SELECT arg_min(level, source_size / weight) AS level FROM settled WHERE NOT capped)
SELECT source, source_size, CAST(round(1000 * CASE WHEN capped THEN 2.0 * source_size ELSE least(2.0 * source_size, weight * (SELECT level FROM flat)) END) AS BIGINT) AS target_thousandths FROM settled
""",
    "edited_texts": r"""
SELECT doc_id, length(t) AS n_chars, sha256(substring(t, 1, length(t) - length(t) // 2) || substring(n, 1, length(t) // 2)) AS edited_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first(coalesce(text, '')) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS n
      FROM documents WINDOW w AS (ORDER BY doc_id))
""",
}
