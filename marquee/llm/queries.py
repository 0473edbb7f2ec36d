"""The registered queries of the operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import decontamination, fingerprints, html_extract, ngram_join, packing, projection_forest, resampling, secrets, substring_dedup, toxicity, url_filter, vector_codes, warc_audit
from marquee.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


ORACLES["op2_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM d, unnest(generate_series(1, len(w) - 12)) AS t(i)),
m AS (SELECT k, min(doc_id) AS lo FROM p GROUP BY k),
bad AS (SELECT DISTINCT doc_id, i + j AS pos FROM p JOIN m USING (k), range(13) AS r(j) WHERE lo < doc_id),
v AS (SELECT doc_id, pos, w[pos] AS word, b.pos IS NOT NULL AS gone
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS pos FROM d) LEFT JOIN bad b USING (doc_id, pos))
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id, w
"""

#: Verdict, host and path of each rule.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Sites whose pages make up the list of blocked URLs.
LISTED_SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def listed_pages(pages: DataFrame) -> DataFrame:
    """Canonical urls of the pages on listed sites."""
    site = F.regexp_extract(url_filter.host(F.col("url")), r"([^.]*)\.example\.[a-z]+$", 1)
    return pages.where(site.isin(LISTED_SITES)).select(url_filter.canonical(F.col("url")).alias("url"))


@_query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, listed_pages(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op5_url_filter"] = r"""
WITH f AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN split_part(split_part(substr(url, strpos(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM f),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
b AS (SELECT page_id, any_value(host) AS host, any_value(path) AS path, max_by(h || p, length(h || p)) AS rule, max_by(r.verdict, length(h || p)) AS verdict
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') AS canon FROM b),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_extract(host, '([^.]*)\.example\.[a-z]+$', 1) IN ('adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM c
"""


@_query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@_query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents"), ["doc_id"]))


@_query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op4_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[j:j + least(5, len(w)) - 1], ' ') AS s FROM b, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS t(j) WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM i), unnest(generate_series(1, len(w) - k + 1)) AS t(j)),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles) AS containment
FROM g JOIN i USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 100 >= any_value(n_shingles) * 75
"""


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_query
def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def archive_replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves of an archive of the pages, and of a copy in which some records are damaged and some are lost."""
    record = warc_audit.record(F.col("page_id"), F.col("url"), F.col("html"))
    damaged = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.substring(record, F.lit(2), F.char_length(record)))).otherwise(record)
    whole, lossy = pages.select("page_id", record.alias("record")), pages.where("page_id IS NULL OR page_id % 101 <> 7").select("page_id", damaged.alias("record"))
    return warc_audit.leaves(whole), warc_audit.leaves(lossy)


@_query
def op6_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_audit.report(*archive_replicas(table(spark, sf_dir, "pages")))


ORACLES["op6_warc_audit"] = r"""
WITH r AS (SELECT page_id, CAST(page_id // 1000 AS BIGINT) AS file, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR)
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: '
    || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages),
h AS (SELECT page_id, file, CAST(octet_length(encode(rec)) AS BIGINT) AS length, sha256(rec) AS digest, CASE WHEN page_id % 101 <> 7 THEN sha256(CASE WHEN page_id % 97 = 13 THEN '#' || substr(rec, 2) ELSE rec END) END AS replica_digest FROM r)
SELECT file, CAST(row_number() OVER w - 1 AS BIGINT) AS ord, page_id, CAST(sum(length) OVER w - length AS BIGINT) AS "offset", length, digest, replica_digest, CASE WHEN replica_digest IS NULL THEN 'missing' WHEN digest = replica_digest THEN 'ok' ELSE 'damaged' END AS status
FROM h WINDOW w AS (PARTITION BY file ORDER BY page_id)
"""


@_query
def op11_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain nearest entries, a table of distances a round; codebooks are rows (part, entry, list)."""
    nearest = """SELECT s.vec_id, s.part, s.v, min_by(c.entry, list_distance_sq(s.v, c.v) * 64 + c.entry) AS entry, min(list_distance_sq(s.v, c.v)) AS d FROM s JOIN {book} c USING (part) GROUP BY s.vec_id, s.part, s.v"""
    nearest = nearest.replace("list_distance_sq(s.v, c.v)", "CAST(list_sum(list_transform(range(1, len(s.v) + 1), lambda i: (s.v[i] - c.v[i]) * (s.v[i] - c.v[i]))) AS BIGINT)")
    steps = [
        "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"s AS MATERIALIZED (SELECT vec_id, part, w[part * len(w) // {parts} + 1:(part + 1) * len(w) // {parts}] AS v FROM e, range({parts}) AS r(part))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY entry < {entries})",
        "b0 AS MATERIALIZED (SELECT part, entry, v FROM s JOIN f USING (vec_id))",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(book=f'b{i}')})")
        steps.append(f"""m{i} AS (SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY pos) AS v
 FROM (SELECT part, entry, pos, CAST(sum(x) AS DOUBLE) AS total, count(*) AS n FROM (SELECT part, entry, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM a{i}) GROUP BY part, entry, pos) GROUP BY part, entry)""")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (part, entry))")
    steps += [
        f"z AS ({nearest.format(book=f'b{rounds}')})",
        "k AS (SELECT vec_id, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM b{rounds}))",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN e USING (vec_id), h"


ORACLES["op12_vector_codes"] = _codes_sql()


@_query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))


#: CRC-32 is folded over the bytes of a feature with its table of 256 remainders, made by eight halvings.
ORACLES["op13_resampling"] = r"""
WITH RECURSIVE h(i, c, k) AS (SELECT i, i, 0 FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM h WHERE k < 8),
crc AS MATERIALIZED (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM h WHERE k = 8),
x AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
g AS MATERIALIZED (SELECT side, id, array_to_string(w[i:i + k - 1], ' ') AS f, count(*) AS n FROM w, range(1, 4) AS r(k), unnest(generate_series(1, len(w) - k + 1)) AS p(i) GROUP BY ALL),
d AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM g)),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, v: xor(c >> 8, t[CAST(xor(c & 255, v) AS INT) + 1])), 4294967295) % 10000 AS bucket FROM d, crc),
u AS (SELECT bucket, CAST(sum(n) FILTER (side = 0) AS DOUBLE) AS s, CAST(sum(n) FILTER (side = 1) AS DOUBLE) AS t FROM g JOIN b USING (f) GROUP BY bucket),
l AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (sum(coalesce(s, 0)) OVER () + 10000) / ((coalesce(s, 0) + 1) * (sum(coalesce(t, 0)) OVER () + 10000)))) AS gain FROM u),
v AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM g JOIN b USING (f) JOIN l USING (bucket) WHERE side = 0 GROUP BY id),
q AS (SELECT w.id AS doc_id, len(w) AS words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
      CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || CAST(w.id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM w LEFT JOIN v ON v.id = w.id WHERE side = 0),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM q WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM q LEFT JOIN o USING (doc_id)
"""
