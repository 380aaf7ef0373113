"""The thin queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontamination, html_extraction, language_id, license_scan, line_dedup, media_jpeg, ngram_jaccard, sentencepiece_codec, sharding, spelling_variants, url_filters, vector_codes, warc_archive
from lexweave.llm._common import read_table
from lexweave.llm.license_templates import TEMPLATES

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of op1 and the canonical URLs that it blocks besides.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
BLOCKED_URLS = ["cheap-pills.example.com/", "spam-farm.example.org/"]

#: Shards of op13, all alike.
SHARD_WEIGHTS = [1.0] * 16


def default_model_path() -> str:
    """The public tokenizer's file; only queries use it, operators take a path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read_table(spark, sf_dir, "pages"), url_filters.listing(spark, URL_RULES, BLOCKED_URLS))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = docs.withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.fit(held.where(~F.col("held_out")))
    return language_id.predict(held, model, keep=("doc_id", "held_out"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_archive.archive_and_read(read_table(spark, sf_dir, "pages"))
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"), TEMPLATES)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sentencepiece_codec.encode_texts(docs, default_model_path(), ids=False, digests=True)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(read_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_jpeg.write_media(read_table(spark, sf_dir, "documents"))
    return media_jpeg.media_features(media)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contained(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), SHARD_WEIGHTS)


def queries() -> dict[str, Query]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_language_id": op2_language_id,
        "op3_warc": op3_warc,
        "op4_license_scan": op4_license_scan,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_html_extraction": op6_html_extraction,
        "op7_line_dedup": op7_line_dedup,
        "op8_media_columns": op8_media_columns,
        "op9_decontamination": op9_decontamination,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_vector_codes": op12_vector_codes,
        "op13_sharding": op13_sharding,
    }


OP1_SQL = """
WITH rules(rule, rh, rp, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
listed(lh, lp) AS (VALUES ('cheap-pills.example.com', '/'), ('spam-farm.example.org', '/')),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT p.*, (SELECT max_by(rule, length(rule)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  EXISTS (SELECT 1 FROM listed WHERE (host = lh OR ends_with(host, '.' || lh)) AND starts_with(path, lp)) AS listed FROM parts p)
SELECT j.page_id, host, path, j.rule, coalesce(r.action, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM judged j LEFT JOIN rules r ON r.rule = j.rule
"""

OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""

OP7_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
raw AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM split),
worded AS (SELECT doc_id, pos, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM raw),
ranked AS (SELECT *, len(w) AS n, row_number() OVER (ORDER BY doc_id, pos) AS o FROM worded),
firsts AS (SELECT w, n, min(o) AS o FROM ranked WHERE n > 0 GROUP BY ALL),
kept AS (SELECT row_number() OVER () AS id, w, n, o FROM firsts WHERE n >= 4),
del AS (SELECT id, o, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS k FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM kept WHERE n >= 5)),
full_ AS (SELECT id, o, n, array_to_string(w, ' ') AS k FROM kept),
near AS (SELECT a.id FROM del a JOIN (SELECT k, n, i, min(o) AS o FROM del GROUP BY ALL) b ON a.k = b.k AND a.n = b.n AND a.i = b.i WHERE b.o < a.o
  UNION SELECT CASE WHEN a.o < b.o THEN b.id ELSE a.id END FROM del a JOIN full_ b ON a.k = b.k AND a.n = b.n + 1),
gone AS (SELECT r.doc_id, r.pos FROM ranked r JOIN firsts f ON f.w = r.w LEFT JOIN kept k ON k.w = r.w
  WHERE r.n > 0 AND (r.o > f.o OR k.id IN (SELECT id FROM near)))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (WHERE g.pos IS NULL), '') END AS text, CAST(count(g.pos) AS INTEGER) AS lines_removed
FROM documents d LEFT JOIN raw r ON r.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.pos = r.pos GROUP BY d.doc_id, d.text
"""

_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP9_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark), docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
sized AS (SELECT item_id, w, least(len(w), 5) AS k FROM items WHERE len(w) > 0),
item_shingles AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
counted AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY 1),
widths AS (SELECT DISTINCT k FROM sized),
doc_shingles AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, widths)),
shared AS (SELECT doc_id, item_id, count(*) AS n FROM doc_shingles d JOIN item_shingles i ON d.k = i.k AND d.s = i.s GROUP BY ALL)
SELECT doc_id, s.item_id, CAST(s.n AS INTEGER) AS n_shared, CAST(c.n AS INTEGER) AS n_item FROM shared s JOIN counted c ON c.item_id = s.item_id WHERE 100 * s.n >= 80 * c.n
"""

OP10_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(len(w), 5) AS k FROM docs WHERE len(w) > 0))),
sizes AS (SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s ON s.doc_id = d.doc_id GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reach(doc_id, id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.id)
SELECT r.doc_id, any_value(z.n) AS n_shingles, min(r.id) AS component_id FROM reach r JOIN sizes z ON z.doc_id = r.doc_id GROUP BY 1
"""


#: What CRC-32 (reversed polynomial EDB88320) makes of each byte, as a list for SQL.
_CRC_BYTES = f"[{', '.join(str(reduce(lambda c, _: c >> 1 ^ 0xEDB88320 * (c & 1), range(8), byte)) for byte in range(256))}]"


def _crc32_sql(string: str) -> str:
    """CRC-32 of a string's UTF-8 in SQL."""
    octets = f"list_transform(regexp_extract_all(hex(encode({string})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: xor(c >> 8, ({_CRC_BYTES})[(xor(c, x) & 255) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS marked, run, count(*) AS n FROM found GROUP BY ALL),
summed AS (SELECT run, n, {_crc32_sql("marked")} AS h FROM counted),
spelt AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY 1),
judged AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
walk(word, top) AS (SELECT word, word FROM judged UNION ALL SELECT k.word, j.form FROM walk k JOIN judged j ON j.word = k.top WHERE j.form IS NOT NULL)
SELECT j.word, j.form, k.top AS root, j.n, j.n_near, j.form_n FROM judged j JOIN walk k ON k.word = j.word JOIN judged e ON e.word = k.top WHERE e.form IS NULL
"""

_NEAREST_SQL = "SELECT x.vec_id, x.label, x.p, x.v, min((list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))), b.e)) AS m FROM parts x JOIN book{k} b ON b.p = x.p GROUP BY ALL"
_MOVED_SQL = """SELECT p, e, list(c ORDER BY i) AS v FROM (SELECT b.p, b.e, b.i, any_value(b.c) AS old, coalesce(CAST(floor(sum(x.v[b.i])::DOUBLE / count(x.v)) AS BIGINT), any_value(b.c)) AS c
  FROM (SELECT p, e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS c FROM book{k}) b LEFT JOIN near{k} x ON x.p = b.p AND x.m[2] = b.e GROUP BY b.p, b.e, b.i) GROUP BY p, e"""

OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM kept, range(16) t(p)),
book0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64) USING (vec_id)),
near0 AS MATERIALIZED ({_NEAREST_SQL.format(k=0)}), book1 AS MATERIALIZED ({_MOVED_SQL.format(k=0)}),
near1 AS MATERIALIZED ({_NEAREST_SQL.format(k=1)}), book2 AS MATERIALIZED ({_MOVED_SQL.format(k=1)}),
near2 AS MATERIALIZED ({_NEAREST_SQL.format(k=2)}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM near2 GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256 FROM coded
"""

_SCORE_SQL = "list_transform(range({n}), lambda s: -1.0 / ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496.0))"

OP13_SQL = f"""
WITH sized AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc32_sql("coalesce(text, '')")} AS text_crc32, {_SCORE_SQL.format(n=16)} AS s, {_SCORE_SQL.format(n=17)} AS g FROM documents),
placed AS (SELECT doc_id, size, text_crc32, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS shard, CAST(list_position(g, list_max(g)) - 1 AS INTEGER) AS grown_shard FROM sized)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard, row_number() OVER (PARTITION BY shard ORDER BY
  ('0x' || substr(md5(coalesce('=' || doc_id, '') || '/' || '=' || text_crc32 || '/' || '=' || size), 1, 13))::BIGINT, doc_id, size, text_crc32, grown_shard) - 1 AS slot FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op3_warc": OP3_SQL, "op7_line_dedup": OP7_SQL, "op9_decontamination": OP9_SQL, "op10_ngram_jaccard": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_sharding": OP13_SQL}
