"""Registered queries of the dealt operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, langid, linededup, quality, secretscan, sentencepiece_sa, shards, simhash, spelling, substrings, urlfilter, vectorcodes, weaklabels,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op1_url_filter", f"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'), {AZ}) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE
    WHEN regexp_matches(lower(url), '/login([^a-z0-9]|$)') THEN '*/login*'
    WHEN regexp_matches(lower(url), '/wp-admin/') THEN '*/wp-admin/*'
    WHEN regexp_matches(lower(url), '(^|[^a-z0-9])ads-track([^a-z0-9]|$)') THEN '*ads-track*'
    WHEN regexp_matches(lower(url), '(^|[^a-z0-9])doubleclick([^a-z0-9]|$)') THEN '*doubleclick*'
    WHEN regexp_matches(lower(url), '[?&]sessionid=') THEN '*sessionid=*' END AS open_pattern
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN open_pattern END AS pattern,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN open_pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), keep=["page_id"])


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", F.col("leak.item").alias("item_id"), "leak.edits", "leak.item_words", "leak.last_word"
    )


#: Bodies of the twins that a `SELECT` over the table `source` completes; `lines_kept` is the deduplicated text.
LINE_SQL = r"""
texts AS (SELECT DISTINCT text FROM source WHERE text IS NOT NULL),
cut AS (SELECT text, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM texts),
tokens AS (SELECT text, line, list_filter(string_split_regex(s, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS tok FROM cut),
lead AS (
  SELECT *, len(tok) AS n, list_transform(tok[1:3], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS head
  FROM tokens WHERE len(tok) >= 3
),
leaves AS (SELECT n, head FROM lead GROUP BY n, head HAVING count(DISTINCT text) >= 10),
cand AS (SELECT lead.* FROM lead JOIN leaves USING (n, head)),
cells AS (SELECT text, line, n, head, unnest(tok) AS token, generate_subscripts(tok, 1) AS place FROM cand),
fixed AS (SELECT n, head, place, token FROM cells GROUP BY n, head, place, token HAVING count(*) >= 10),
marked AS (
  SELECT c.text, c.line, c.n, c.head, c.place, f.token FROM cells c LEFT JOIN fixed f ON c.n = f.n AND c.head = f.head AND c.place = f.place AND c.token = f.token
),
templates AS (
  SELECT text, line, n, head, list({'place': place, 'token': token} ORDER BY place) FILTER (WHERE token IS NOT NULL) AS template
  FROM marked GROUP BY text, line, n, head HAVING count(token) >= 0.6 * n
),
often AS (SELECT n, head, template FROM templates GROUP BY n, head, template HAVING count(DISTINCT text) >= 10),
drops AS (
  SELECT t.text, list(t.line ORDER BY t.line) AS lines, sum(t.n) AS words
  FROM templates t JOIN often o ON t.n = o.n AND t.head = o.head AND t.template = o.template GROUP BY t.text
),
shares AS (
  SELECT text, lines FROM drops
  WHERE words <= 0.5 * len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))
),
kept AS (
  SELECT c.text, string_agg(c.s, chr(10) ORDER BY c.line) FILTER (WHERE NOT list_contains(h.lines, c.line)) AS left_text
  FROM cut c JOIN shares h ON c.text = h.text GROUP BY c.text
),
lines_kept AS (
  SELECT s.*, CASE WHEN h.text IS NOT NULL THEN coalesce(k.left_text, '') ELSE s.text END AS new_text,
    coalesce(len(string_split(s.text, chr(10))), 0) AS n_lines, coalesce(len(h.lines), 0) AS n_dropped
  FROM source s LEFT JOIN shares h ON s.text = h.text LEFT JOIN kept k ON s.text = k.text
)"""


@query("op3_line_dedup", f"WITH source AS (SELECT doc_id, text FROM documents), {LINE_SQL} SELECT doc_id, new_text AS text, n_lines, n_dropped FROM lines_kept")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sentencepiece_sa.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), round_trip="round_trip")
    return docs.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "round_trip")


@query("op7_shards")
def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(table(spark, sf_dir, "documents"))


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_weak_labels")
def op10_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabels.classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "posterior", "score", "kept")


@query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


#: Pairs by equal words around a masked or a missing code point; CRC-32 from its polynomial, bytes of UTF-8 from code points.
VARIANT_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS raw FROM documents
),
found AS MATERIALIZED (
  SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL HAVING length(run) >= 6
),
bytes AS (
  SELECT doc_id, run, n, flatten(list_transform(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: unicode(x)::BIGINT),
    lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END)) AS b FROM found
),
hashed AS MATERIALIZED (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM bytes, crc
),
typed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
masked AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM masked a JOIN masked b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION ALL SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word
),
ranked AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k FROM near),
own AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.other END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.k = 1
),
walk AS (
  SELECT word, word AS here, 0 AS steps FROM own
  UNION ALL SELECT k.word, o.form, k.steps + 1 FROM walk k JOIN own o ON k.here = o.word WHERE o.form IS NOT NULL
),
ends AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
SELECT o.word, o.form, e.root, o.n, o.n_near, o.form_n FROM own o JOIN ends e ON o.word = e.word"""


@query("op12_spelling_variants", VARIANT_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def code_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every distance of every round; one pair of tables for each round."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cells AS MATERIALIZED (
  SELECT rid, p, list_slice(q, p * len(q) // {parts} + 1, (p + 1) * len(q) // {parts}) AS v FROM kept, (SELECT unnest(range({parts})) AS p)
),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM cells WHERE rid <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT rid, c.p, any_value(c.v) AS v,
    min(list_sum(list_transform(list_zip(c.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT * {entries} + e) AS best
  FROM cells c JOIN book{k} b ON c.p = b.p GROUP BY rid, c.p
)""")
        if k < rounds:
            steps.append(f"""
means{k} AS (
  SELECT p, e, list(m ORDER BY place) AS v FROM (
    SELECT p, best % {entries} AS e, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m
    FROM (SELECT p, best, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{k}) GROUP BY p, best % {entries}, place
  ) GROUP BY p, e
),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)""")
    return f"""WITH {",".join(steps)},
codes AS (
  SELECT rid, string_agg(lpad(lower(hex(best % {entries})), 2, '0'), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM near{rounds} GROUP BY rid
),
books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes ON kept.rid = codes.rid, books"""


@query("op13_vector_codes", code_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))
