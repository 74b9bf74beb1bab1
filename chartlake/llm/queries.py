"""The queries that apply each operator to its whole table with production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, decontam, html_extract, license_scan, line_dedup, mixing, near_dedup, pst, toxicity, url_filter
from .common import UPPER, crc_mod, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 6).alias("position"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = audio.store_audio(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return audio.digests(audio.read_audio(stored))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.judged(decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return leaks.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.transform("licenses", lambda m: m["name"])
    least = F.array_min(F.transform("licenses", lambda m: m["containment"]))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.round(least, 6).alias("least_containment"))


def op7_pst_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score_corpus(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


def _toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.train(docs, table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_texts(docs.select("doc_id", "text"), _toxicity_model(spark, docs, sf_dir))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_mpeg_audio, op3_decontamination, op4_line_dedup, op5_html_extraction, op6_license_scan, op7_pst_scoring, op8_toxicity, op9_url_filter, op10_near_dedup)}

LOWER = f"translate({{}}, '{UPPER}', '{UPPER.lower()}')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TEXT = LOWER.format("coalesce(text, '')")

_OP1 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size,
                  md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) - 1 AS k FROM w),
c AS (SELECT k, cap, weight, coalesce(sum(cap) OVER before, 0) AS cut, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free, sum(source_size) OVER ()::DOUBLE AS total
      FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (total - cut) / free AS level FROM c WHERE weight * (total - cut) / free <= cap ORDER BY k LIMIT 1),
t AS (SELECT w.*, least(cap, weight * level) AS target FROM w, l),
p AS (SELECT d.*, t.source_size, t.target, t.rank,
             sum(size) OVER (PARTITION BY t.rank ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, start / target AS share, CASE rank % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS w0,
             CASE rank % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE -1.0 END::DOUBLE AS slope FROM p)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (greatest(0, least(size, round(target)::BIGINT - start)) + greatest(0, least(size, round(target)::BIGINT - start - source_size))
        + greatest(0, least(size, round(target)::BIGINT - start - 2 * source_size)))::BIGINT AS taken,
       CASE WHEN size > 0 AND start < round(target)::BIGINT
            THEN round(least(2 * share / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * share, 0))), 1.0), 6) END AS position
FROM q"""

_CODE = rf"regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP3 = rf"""
WITH d AS (SELECT doc_id, {_CODE} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_CODE} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS body
       FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS body
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, p, item FROM dw JOIN iw USING (n, body)),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""

_OP4 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw,
                  list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS l FROM documents),
p AS (SELECT doc_id, pos, array_to_string(l[pos:pos + 2], chr(10)) AS body
      FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 2, 1) + 1)) AS pos FROM d WHERE text IS NOT NULL)),
f AS (SELECT body, min((doc_id, pos)) AS first FROM p WHERE length(replace(body, chr(10), '')) > 0 GROUP BY body HAVING count(*) > 1),
m AS (SELECT doc_id, list(DISTINCT x) AS gone FROM (SELECT doc_id, unnest(range(pos, pos + 3)) AS x FROM p JOIN f USING (body) WHERE (doc_id, pos) <> first) GROUP BY doc_id),
k AS (SELECT d.*, gone, list_filter(range(1, len(raw) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)) AS stay FROM d LEFT JOIN m USING (doc_id))
SELECT doc_id, coalesce(len(raw), 0)::BIGINT AS n_lines, coalesce(len(raw) - len(stay), 0)::BIGINT AS n_removed,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(stay, lambda i: raw[i]), chr(10)), '') END AS text
FROM k"""

_LISTED = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(license_scan.TEMPLATES.items()))
_SPLIT = "list_filter(string_split_regex({}, '[^a-z0-9]+'), lambda x: x <> '')"
_OP6 = f"""
WITH t AS (SELECT name, {_SPLIT.format(LOWER.format("body"))} AS w FROM (VALUES {_LISTED}) v(name, body)),
ts AS (SELECT DISTINCT name, n, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT name, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM t)),
ns AS (SELECT DISTINCT n FROM ts),
d AS (SELECT doc_id, {_SPLIT.format(_TEXT)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
share AS (SELECT doc_id, name, count(*) / any_value(total) AS c
          FROM g JOIN ts USING (n, g) JOIN (SELECT name, count(*)::DOUBLE AS total FROM ts GROUP BY name) USING (name) GROUP BY doc_id, name),
m AS (SELECT doc_id, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses, min(c) AS least FROM share WHERE c >= 0.75 GROUP BY doc_id)
SELECT doc_id, coalesce(n_licenses, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, round(least, 6) AS least_containment
FROM d LEFT JOIN m USING (doc_id)"""

_SPAM = "|".join(url_filter.SPAM_WORDS)
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.HOST_RULES)
_OP9 = rf"""
WITH u AS (SELECT page_id, url, coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES {_RULES}) v(h, p, v)),
best AS (SELECT page_id, url, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
         FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, url)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[^a-z0-9])({_SPAM})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id, url)"""

_OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_TEXT)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
      JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

#: Not in SQL: op2 (bytes of a media format), op5 (parsing), op7 and op8 (models).
ORACLE_SQL = {"op1_mixing": _OP1, "op3_decontamination": _OP3, "op4_line_dedup": _OP4, "op6_license_scan": _OP6, "op9_url_filter": _OP9, "op10_near_dedup": _OP10}
