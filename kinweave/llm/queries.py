"""The queries opN_<name>: an operator over its whole table, and what the query derives from its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, divergence, licenses, media, near_dups, paragraphs, quality, resampling, substrings, token_store, top_k, url_filters
from .common import Scratch, documents, sha_hex, tokenizer_path


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.remove_repeats(documents(spark, sf_dir), Scratch(spark, "op1"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), sha_hex(F.col("kept")).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch time: page_id days, modulo a leap year, after 2024-01-01 stand for it. Besides a few fixed entries the list is watched_entries()."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched_on"))
    got = url_filters.filter_urls(pages, url_filters.default_entries(spark).unionByName(url_filters.watched_entries(pages)))
    return got.select("page_id", "host", F.col("fetched_on").cast("string").alias("fetched_on"), F.array_join("lists", ",").alias("lists"), "entry", "blocked")


def op3_sql() -> str:
    values = ", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in url_filters.DEFAULT_ENTRIES)
    return rf"""
    WITH captures AS MATERIALIZED (SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on,
        regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)) AS segment FROM pages),
    hosts AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 8) AS BIGINT) AS k FROM (SELECT DISTINCT host AS pattern FROM captures WHERE host <> '')),
    paths AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 8) AS BIGINT) AS k FROM (SELECT DISTINCT host || '/' || segment AS pattern FROM captures WHERE host <> '' AND segment <> '')),
    steps(action, each, later) AS (VALUES ('add', 5, 0), ('remove', 10, 60), ('add', 20, 120)),
    entries AS (SELECT * FROM (VALUES {values}) fixed(list, kind, pattern, action, since)
        UNION ALL SELECT 'watch', 'block', pattern, action, DATE '2024-01-01' + CAST(k % 200 + later AS INTEGER) FROM hosts, steps WHERE k % each = 0
        UNION ALL SELECT 'trusted', 'allow', pattern, 'add', DATE '2024-01-01' + CAST(k % 200 AS INTEGER) FROM paths WHERE k % 3 = 0),
    days AS (SELECT list, kind, pattern, since, max(action) AS action FROM entries GROUP BY ALL),
    spans AS (SELECT *, lead(since) OVER (PARTITION BY list, kind, pattern ORDER BY since) AS until FROM days),
    found AS (SELECT page_id, list, kind, pattern FROM captures JOIN spans ON action = 'add' AND fetched_on >= since AND (until IS NULL OR fetched_on < until)
        AND (host = pattern OR ends_with(host, '.' || pattern) OR host || '/' || segment = pattern OR ends_with(host || '/' || segment, '.' || pattern))),
    verdict AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, arg_max(pattern, length(pattern) * 2 + (kind = 'allow')::INT) AS entry,
        arg_max(kind, length(pattern) * 2 + (kind = 'allow')::INT) = 'block' AS blocked FROM found GROUP BY page_id)
    SELECT page_id, host, CAST(fetched_on AS VARCHAR) AS fetched_on, coalesce(lists, '') AS lists, entry, coalesce(blocked, false) AS blocked FROM captures LEFT JOIN verdict USING (page_id)"""


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.sniff_media(media.text_media(documents(spark, sf_dir)), ["doc_id", "n_bytes", "media"])
    return media.read_back(stored).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), sha_hex(F.col("payload")).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), sha_hex(F.col("media")).alias("media_sha256"), "feature", "type", "corrected", F.size("carved").alias("n_carved"),
    )


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_store.read_store(*token_store.write_store(spark, documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), 2, Scratch(spark, "op5")))
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir), Scratch(spark, "op6"), 3, (85, 100)).select("doc_id", "n_shingles", "component_id", "kept")


#: Sets by DuckDB: SETS(source of (id, text), words in a shingle) gives (id, s), a row for each distinct shingle.
def sets_sql(source: str, width: int) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    words AS MATERIALIZED (SELECT id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM {source}),
    sets AS MATERIALIZED (SELECT DISTINCT id, array_to_string(w[i:i + {width - 1}], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
    sizes AS MATERIALIZED (SELECT id, count(*) AS n FROM sets GROUP BY id),
    shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.id <> b.id GROUP BY ALL)"""


OP6_SQL = rf"""
WITH RECURSIVE source AS (SELECT doc_id AS id, text FROM documents), {sets_sql("source", 3)},
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM documents LEFT JOIN sizes ON sizes.id = doc_id LEFT JOIN least ON least.id = doc_id"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "op7"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", sha_hex(F.array_join("items", ",").cast("binary")).alias("items_sha256"), "contaminated")


#: Words and 13-word windows by DuckDB; the windows of shorter items are the whole items.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT item, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM runs),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= k)),
hits AS (SELECT p.doc_id, p.i, p.k, r.item FROM places p JOIN runs r ON p.run = r.run AND p.k = r.k),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = byte_bpe.encode_decode(documents(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), sha_hex(F.col("ids")).alias("ids_sha256"), sha_hex(F.col("decoded")).alias("decoded_sha256"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan_licenses(documents(spark, sf_dir))
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.col(x) for x in c)))), ",")
    return got.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        labels("base.label").alias("base_labels"), labels("base.label", "found.label").alias("labels"), "score",
    )


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = paragraphs.dedup_paragraphs(documents(spark, sf_dir).select("doc_id", "text"), Scratch(spark, "op10"))
    return got.select("doc_id", "n_words", "n_removed", "n_spans", sha_hex(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_sha256"), "text")


#: Places of lines and words within all documents, so far apart that no text's places reach those of the next.
MANY = "1099511627776::HUGEINT"
PLACE = f"doc_id * {MANY}"
#: Lines as ranges of words, near ones linked by all pairs that share a shingle; runs of words by a digest of each; and the words that are left, with their blanks.
OP10_SQL = rf"""
WITH RECURSIVE tokens AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS t,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS hi FROM (SELECT doc_id, i, line, {PLACE} + i AS id, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM tokens)))),
source AS (SELECT id, line AS text FROM lines WHERE n >= {paragraphs.MIN_WORDS}), {sets_sql("source", 5)},
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
near AS (SELECT doc_id, hi - n AS lo, hi FROM lines JOIN (SELECT a AS id FROM reach GROUP BY a HAVING min(b) < a) USING (id)),
runs AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + {paragraphs.PASSAGE}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - {paragraphs.PASSAGE - 1})) AS i FROM tokens WHERE len(w) >= {paragraphs.PASSAGE})),
firsts AS (SELECT h, min({PLACE} + i) AS f FROM runs GROUP BY h HAVING count(*) > 1),
equal AS (SELECT doc_id, CASE WHEN f // {MANY} = doc_id THEN greatest(i, f % {MANY} + {paragraphs.PASSAGE}) ELSE i END AS lo, i + {paragraphs.PASSAGE} AS hi FROM runs JOIN firsts USING (h) WHERE {PLACE} + i <> f),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT))) AS j FROM (SELECT * FROM near UNION ALL SELECT * FROM equal) WHERE lo < hi),
ends AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (prev IS NULL OR prev < j - 1) AS n_spans FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS prev FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY k) AS rest FROM (SELECT doc_id, unnest(range(len(t))) AS k, unnest(t) AS x FROM tokens) p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.j = p.k) GROUP BY doc_id),
left_over AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, regexp_extract(text, '^[\x20\x09-\x0D]*') || coalesce(rest, '') AS text FROM tokens LEFT JOIN kept USING (doc_id))
SELECT doc_id, n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(text) AS kept_sha256, text FROM left_over LEFT JOIN ends USING (doc_id)"""


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op11"))


OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(documents(spark, sf_dir), Scratch(spark, "op12"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS row FROM documents),
words AS MATERIALIZED (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 30),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
found AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
counts AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)),
whole AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
p AS MATERIALIZED (SELECT *, 1 + CAST(1000000000 * (n + 5) AS HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM counts),
q AS (SELECT *, 1 + CAST(1000000000 * (n + 5) AS HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM whole),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resampling.importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "op13"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC of each different feature goes over its bytes by a table of 256 numbers, made by rule; digests are read as whole numbers.
OP13_SQL = r"""
WITH RECURSIVE table_of(n, k, c) AS (SELECT n, 0, n FROM range(256) t(n) UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM table_of WHERE k < 8),
crcs AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM table_of WHERE k = 8),
texts AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, false AS target, text FROM documents UNION ALL SELECT NULL, -row_number() OVER (), true, text FROM benchmark),
words AS MATERIALIZED (SELECT doc_id, row, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS MATERIALIZED (SELECT row, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
numbers AS (SELECT f, list_transform(range(0, octet_length(encode(f))), lambda i: CAST(('0x' || substr(hex(encode(f)), 2 * i + 1, 2)) AS BIGINT)) AS b FROM (SELECT DISTINCT f FROM features)),
bucket AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[xor(c & 255, x) + 1], c // 256))) % 10000 AS bucket FROM numbers, crcs),
counts AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM features JOIN bucket USING (f) GROUP BY bucket),
gains AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts),
weights AS (SELECT row, count(*) AS n, sum(gain) AS total FROM features JOIN bucket USING (f) JOIN gains USING (bucket) WHERE NOT target GROUP BY row),
noise AS (SELECT doc_id, row, len(w) AS n_words, CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM words WHERE NOT target),
scored AS (SELECT doc_id, n_words, coalesce(n, 0) AS n_features, coalesce(CAST(floor(total / n) AS BIGINT), 0) AS weight,
    coalesce(CAST(floor(total / n) AS BIGINT), 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM noise LEFT JOIN weights USING (row)),
drawn AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, 25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS n FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= n THEN place END AS rank FROM drawn"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_quality, op3_url_filters, op4_media, op5_token_store, op6_near_dups, op7_decontamination, op8_byte_bpe, op9_licenses, op10_paragraph_dedup,
        op11_top_k, op12_divergence, op13_resampling,
    )
}
ORACLE_SQL = {
    "op3_url_filters": op3_sql(), "op6_near_dups": OP6_SQL, "op7_decontamination": OP7_SQL, "op10_paragraph_dedup": OP10_SQL,
    "op11_top_k": OP11_SQL, "op12_divergence": OP12_SQL, "op13_resampling": OP13_SQL,
}
