"""The queries of plans.linkage as DuckDB SQL. For trained trees there is none."""

from __future__ import annotations

from ..functions import similarity as S
from ..functions import text as T
from ..operators.blocking import TOP
from ..operators.metrics import GRID
from ..operators.retrieval import TOP_ADDRESS, TOP_NAME, TOP_WORDS
from .linkage import CAP, POOL, THRESHOLD


def cleaned(x: str) -> str:
    x = f"lower(trim(coalesce({x}, '')))"
    return f"CASE WHEN {x} IN ('nan', 'none', 'null') THEN '' ELSE {x} END"


def squeezed(x: str) -> str:
    x = f"replace({x}, '&', ' and ')"
    for pattern in (r"https?://|www\.", r"[^\p{L}\p{N}_\s]", r"\s+"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return f"trim({x})"


ACCENTS = f"'{T.ACCENTED}', '{T.PLAIN}'"
LEGAL = ", ".join(f"'{x}'" for x in T.LEGAL_SUFFIXES)


def doubled(x: str) -> str:
    for a, b in T.DOUBLES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def abbreviated(x: str) -> str:
    for a, b in T.ABBREVIATIONS:
        x = rf"regexp_replace({x}, '\b{a}\b', '{b}', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def latin(x: str, out: str, table: str) -> str:
    """A step at a time: each CTE reads the one before."""
    return f"""
{out}_1 AS MATERIALIZED (SELECT *, {cleaned(x)} AS z FROM {table}),
{out}_2 AS MATERIALIZED (SELECT * EXCLUDE (z), {doubled(f"translate(z, {ACCENTS})")} AS z FROM {out}_1),
{out}_3 AS MATERIALIZED (SELECT * EXCLUDE (z), {cleaned('z')} AS z FROM {out}_2),
{out} AS MATERIALIZED (SELECT * EXCLUDE (z), {squeezed('z')} AS {out}_latin FROM {out}_3)"""


def grams(column: str) -> str:
    return f"""(SELECT entity_id AS id, source, country_key, substr(p, i, n) AS term, count(*) AS tf FROM (SELECT *, unnest(range(1, length(p) - n + 2)) AS i FROM (SELECT *, unnest([2, 3, 4, 5]) AS n FROM
    (SELECT entity_id, source, country_key, ' ' || unnest(list_filter(string_split({column}, ' '), lambda t: t <> '')) || ' ' AS p FROM prep)) WHERE length(p) >= n) GROUP BY ALL)"""


def tfidf(name: str, column: str, top: int) -> str:
    return f"""
{name}_g AS MATERIALIZED {grams(column)},
{name}_df AS (SELECT country_key, term, count(*) AS df FROM {name}_g WHERE source > 1 GROUP BY ALL),
{name}_w AS (SELECT id, source, country_key, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM {name}_g JOIN {name}_df USING (country_key, term) JOIN populations USING (country_key)),
{name}_n AS MATERIALIZED (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM {name}_w),
{name}_s AS (SELECT a.id AS q, b.id AS t, round(sum(a.u * b.u), 9) AS score FROM {name}_n a JOIN {name}_n b ON a.country_key = b.country_key AND a.term = b.term AND a.source = 1 AND b.source > 1 GROUP BY ALL),
{name}_top AS (SELECT q, t, score FROM {name}_s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, t) <= {top})"""


def lcs(a: str, b: str) -> str:
    """Longest common subsequence by bits of one integer, for up to 120 characters of a."""
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    places = f"list_transform(string_split({b}, ''), lambda ch_: list_sum(list_transform(range(length({a})), lambda at_: CASE WHEN substr({a}, at_ + 1, 1) = ch_ THEN 1::HUGEINT << at_::INT ELSE 0::HUGEINT END)))"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count(list_reduce(list_prepend({full}, {places}), lambda v_, m_: ((v_ + (v_ & m_)) | (v_ - (v_ & m_))) & {full})) END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 1.0::DOUBLE ELSE 2 * {lcs(a, b)} / (length({a}) + length({b})) END)"


def partial(a: str, b: str) -> str:
    """Windows of the longer string; a is not longer than b."""
    window = f"substr({b}, greatest(0, w_) + 1, w_ + length({a}) - greatest(0, w_))"
    return f"(CASE WHEN {a} = '' THEN 0.0::DOUBLE ELSE list_max(list_transform(range(1 - length({a}), length({b})), lambda w_: {ratio(a, window)})) END)"


def either(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) > length({b}) THEN {partial(b, a)} ELSE {partial(a, b)} END)"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def strings(out: str, pairs: str) -> str:
    """All similarities of the different pairs (a, b), a CTE a step."""
    joined = lambda x: f"array_to_string(list_sort({x}), ' ')"
    return f"""
{out}_1 AS MATERIALIZED (SELECT a, b, {joined(words("a"))} AS sa, {joined(words("b"))} AS sb, list_distinct({words("a")}) AS xa, list_distinct({words("b")}) AS xb FROM (SELECT DISTINCT a, b FROM ({pairs}))),
{out}_2 AS MATERIALIZED (SELECT *, {joined("list_intersect(xa, xb)")} AS c, {joined("list_filter(xa, lambda t: NOT list_contains(xb, t))")} AS oa, {joined("list_filter(xb, lambda t: NOT list_contains(xa, t))")} AS ob FROM {out}_1),
{out}_3 AS MATERIALIZED (SELECT *, trim(c || ' ' || oa) AS l, trim(c || ' ' || ob) AS r, {ratio("a", "b")} AS ratio, {ratio("sa", "sb")} AS token_sort,
    greatest(length(a), length(b)) / greatest(least(length(a), length(b)), 1) AS spread FROM {out}_2),
{out}_4 AS MATERIALIZED (SELECT *, CASE WHEN len(xa) = 0 OR len(xb) = 0 THEN 0.0::DOUBLE WHEN c <> '' AND (oa = '' OR ob = '') THEN 1.0::DOUBLE WHEN c <> '' THEN greatest({ratio("l", "r")}, {ratio("c", "l")}, {ratio("c", "r")}) ELSE {ratio("l", "r")} END AS token_set FROM {out}_3),
{out} AS MATERIALIZED (SELECT a, b, ratio, token_sort, token_set, CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN spread < {S.LONGER} THEN greatest(ratio, {S.TOKEN_WEIGHT}::DOUBLE * token_sort, {S.TOKEN_WEIGHT}::DOUBLE * token_set)
    ELSE greatest(ratio, wt * {either("a", "b")}, {S.TOKEN_WEIGHT}::DOUBLE * wt * {either("sa", "sb")}, {S.TOKEN_WEIGHT}::DOUBLE * wt * CASE WHEN c <> '' THEN 1.0::DOUBLE ELSE {either("oa", "ob")} END) END AS wratio
    FROM (SELECT *, CASE WHEN spread <= {S.MUCH_LONGER} THEN {S.PART_WEIGHT}::DOUBLE ELSE {S.SHORT_PART_WEIGHT}::DOUBLE END AS wt FROM {out}_4))"""


def family(tag: str, value: str, source: str) -> str:
    return f"SELECT entity_id, '{tag}:' || {value} AS value FROM {source}"


BASE = rf"""
WITH d AS (SELECT doc_id, lang AS country, lang || '|' || left(lower(text), 40) AS block, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM documents),
g AS (SELECT block, count(*) AS size, min(doc_id) AS least FROM d GROUP BY block),
recs AS MATERIALIZED (SELECT 'S' || source || '-' || lpad(CAST(doc_id AS VARCHAR), greatest(6, length(CAST(doc_id AS VARCHAR)))::INT, '0') AS entity_id, substr(flat, 1, 60) AS business_name, substr(flat, 61, 60) AS business_address, country, source, block
    FROM (SELECT d.*, CAST(CASE WHEN size = 1 THEN 1 + doc_id % 3 WHEN doc_id = least THEN 1 WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS INTEGER) AS source FROM d JOIN g USING (block))),
{latin("business_name", "nm", "recs")}, {latin("business_address", "ad", "nm")},
prep AS MATERIALIZED (SELECT *, nm_latin AS name_norm, array_to_string(list_filter(string_split(nm_latin, ' '), lambda t: t <> '' AND t NOT IN ({LEGAL})), ' ') AS name_core, {abbreviated("ad_latin")} AS address_norm,
    lower(trim(country)) AS country_key FROM ad),
name_words AS (SELECT entity_id, t FROM (SELECT DISTINCT entity_id, unnest(string_split(name_core, ' ')) AS t FROM prep) WHERE length(t) >= 3 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY -length(t), t) <= 4),
address_words AS (SELECT entity_id, t, row_number() OVER (PARTITION BY entity_id ORDER BY -length(t), t) AS n FROM (SELECT DISTINCT entity_id, unnest(string_split(address_norm, ' ')) AS t FROM prep) WHERE length(t) >= 4 QUALIFY n <= 5),
runs AS (SELECT entity_id, regexp_extract_all(address_norm, '\d+') AS r FROM prep),
numbers AS (SELECT entity_id, t, row_number() OVER (PARTITION BY entity_id ORDER BY -length(t), t) AS n FROM (SELECT DISTINCT entity_id, unnest(r) AS t FROM runs) WHERE length(t) >= 3 QUALIFY n <= 2),
near AS (SELECT entity_id, r[1] AS t FROM runs WHERE len(r) > 0 UNION SELECT entity_id, t FROM numbers WHERE n = 1),
anchors AS (SELECT entity_id, g FROM (SELECT DISTINCT entity_id, substr(c, i, 4) AS g FROM (SELECT entity_id, c, unnest(range(1, length(c) - 2)) AS i FROM (SELECT entity_id, replace(name_core, ' ', '') AS c FROM prep)))
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY md5(g), g) <= 3),
doors AS (SELECT entity_id, substr(name_core, 1, 5) || ':' || list_filter(string_split(address_norm, ' '), lambda t: regexp_full_match(t, '[0-9]+'))[1] AS v FROM prep WHERE name_core <> ''),
key_values AS ({" UNION ".join([
    family("n", "name_core", "prep WHERE name_core <> ''"), family("s", "array_to_string(list_sort(list_filter(string_split(name_core, ' '), lambda t: t <> '')), ' ')", "prep WHERE name_core <> ''"),
    family("g", "g", "anchors"), family("a", "address_norm", "prep WHERE address_norm <> ''"), family("at", "t", "address_words"), family("an", "t", "numbers"),
    "SELECT w.entity_id, 'ax:' || w.t || ':' || near.t FROM address_words w JOIN near ON w.entity_id = near.entity_id AND w.n <= 3", family("t", "t", "name_words"), family("p", "substr(t, 1, 5)", "name_words WHERE length(t) >= 5"), family("d", "v", "doors WHERE v IS NOT NULL"),
])}),
keys AS MATERIALIZED (SELECT entity_id, md5(country_key || '|' || value) AS key, source FROM key_values JOIN prep USING (entity_id)),
sizes AS (SELECT key, count(*) AS postings FROM keys WHERE source > 1 GROUP BY key),
usable AS (SELECT entity_id, key FROM keys JOIN sizes USING (key) WHERE source > 1 AND postings <= {CAP}),
votes AS MATERIALIZED (SELECT a.entity_id AS q, b.entity_id AS t, count(*) AS votes FROM keys a JOIN usable b ON a.key = b.key AND a.source = 1 GROUP BY ALL),
pool AS MATERIALIZED (SELECT q, t, votes FROM votes QUALIFY row_number() OVER (PARTITION BY q ORDER BY votes DESC, t) <= {POOL}),
lists AS (SELECT entity_id AS source1_entity_id, coalesce(string_agg(t, ',' ORDER BY t), '') AS ids FROM prep LEFT JOIN pool ON q = entity_id WHERE source = 1 GROUP BY entity_id),
truth AS MATERIALIZED (SELECT a.entity_id AS q, b.entity_id AS t FROM recs a LEFT JOIN recs b ON a.block = b.block AND b.source > 1 WHERE a.source = 1),
populations AS (SELECT country_key, count(*) AS n FROM prep WHERE source > 1 GROUP BY ALL),
sets AS MATERIALIZED (SELECT entity_id, name_norm, name_core, address_norm, country, list_distinct(list_filter(string_split(name_core, ' '), lambda t: t <> '')) AS nt, list_distinct(list_filter(string_split(address_norm, ' '), lambda t: t <> '')) AS at,
    list_distinct(regexp_extract_all(ad_latin, '\d+')) AS dg FROM prep),
sides AS (SELECT p.q, p.t, p.votes, a.name_norm AS na, b.name_norm AS nb, a.name_core AS ca, b.name_core AS cb, a.address_norm AS aa, b.address_norm AS ab, a.country AS ka, b.country AS kb, a.nt AS nta, b.nt AS ntb, a.at AS ata, b.at AS atb, a.dg AS dga, b.dg AS dgb
    FROM pool p JOIN sets a ON a.entity_id = p.q JOIN sets b ON b.entity_id = p.t),
feats AS MATERIALIZED (SELECT q, t, votes,
    round(CASE WHEN greatest(length(na), length(nb)) = 0 THEN 1 ELSE 1 - levenshtein(na, nb) / greatest(length(na), length(nb)) END, 9) AS name_edit,
    {", ".join(f"round(CASE WHEN len(list_distinct(list_concat({x}a, {x}b))) = 0 THEN 1 ELSE len(list_intersect({x}a, {x}b)) / len(list_distinct(list_concat({x}a, {x}b))) END, 9) AS {n}_jaccard" for x, n in (("nt", "name"), ("at", "address"), ("dg", "digit")))},
    {", ".join(f"round(CASE WHEN least(len({x}a), len({x}b)) = 0 THEN 0 ELSE len(list_intersect({x}a, {x}b)) / least(len({x}a), len({x}b)) END, 9) AS {n}_containment" for x, n in (("nt", "name"), ("at", "address")))},
    CAST(len(dga) > 0 AND len(dgb) > 0 AND len(list_intersect(dga, dgb)) = 0 AS DOUBLE) AS digit_conflict, CAST(ka = kb AS DOUBLE) AS country_equal, CAST(na = nb AND na <> '' AS DOUBLE) AS name_exact,
    CAST(ca = cb AND ca <> '' AS DOUBLE) AS name_core_exact, CAST(aa = ab AND aa <> '' AS DOUBLE) AS address_exact, CAST(ab = '' AS DOUBLE) AS address_missing,
    {", ".join(f"round(CASE WHEN greatest(length({x}a), length({x}b)) = 0 THEN 1 ELSE least(length({x}a), length({x}b)) / greatest(length({x}a), length({x}b)) END, 9) AS {n}_length_ratio" for x, n in (("n", "name"), ("a", "address")))},
    CASE WHEN t LIKE 'S2-%' THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS same_target_source FROM sides),
scored AS MATERIALIZED (SELECT q, t, round(0.35::DOUBLE * name_edit + 0.25::DOUBLE * name_jaccard + 0.2::DOUBLE * address_jaccard + 0.1::DOUBLE * digit_jaccard + 0.1::DOUBLE * name_length_ratio, 9) AS probability FROM feats),
grid AS (SELECT unnest([{", ".join(map(repr, GRID))}]::DOUBLE[]) AS threshold),
entities AS (SELECT q, count(t) AS actual FROM truth GROUP BY q),
found AS (SELECT threshold, s.q, count(*) AS predicted, count(truth.t) AS tp FROM scored s JOIN grid ON probability >= threshold LEFT JOIN truth ON truth.q = s.q AND truth.t = s.t GROUP BY ALL),
sweep AS (SELECT threshold, avg(CASE WHEN actual = 0 THEN CAST(coalesce(predicted, 0) = 0 AS INTEGER) ELSE 1.25 * coalesce(tp, 0) / (0.25 * actual + coalesce(predicted, 0)) END) AS f FROM entities CROSS JOIN grid LEFT JOIN found USING (q, threshold) GROUP BY threshold),
base_damaged AS (SELECT source1_entity_id, ids || CASE WHEN source1_entity_id LIKE '%7' THEN ',S1-000001,X9' WHEN source1_entity_id LIKE '%8' THEN ',S2-999999,S2-999999' ELSE '' END AS ids FROM lists WHERE source1_entity_id NOT LIKE '%3'),
damaged AS MATERIALIZED (SELECT * FROM base_damaged UNION ALL SELECT * FROM base_damaged WHERE source1_entity_id LIKE '%5' UNION ALL SELECT source1_entity_id || 'x', ids FROM base_damaged WHERE source1_entity_id LIKE '%6'),
each AS (SELECT source1_entity_id, unnest(list_filter(string_split(ids, ','), lambda x: x <> '')) AS id FROM damaged),
word_lists AS (SELECT entity_id, source, country_key, list_filter(string_split(name_core || ' ' || name_norm || ' ' || address_norm, ' '), lambda t: length(t) >= 2) AS w FROM prep),
wg AS MATERIALIZED (SELECT id, source, country_key, term, count(*) AS tf FROM (SELECT entity_id AS id, source, country_key, unnest(w) AS term FROM word_lists UNION ALL
    SELECT entity_id, source, country_key, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM word_lists)) GROUP BY ALL),
wdf AS (SELECT country_key, term, count(*) AS df FROM wg WHERE source > 1 GROUP BY ALL),
lens AS (SELECT id, country_key, sum(tf) AS len FROM wg WHERE source > 1 GROUP BY ALL),
means AS (SELECT country_key, n, greatest(sum(len) / n, 1.0) AS mean FROM lens JOIN populations USING (country_key) GROUP BY country_key, n),
ww AS (SELECT wg.id, country_key, term, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM wg JOIN wdf USING (country_key, term) JOIN lens USING (id, country_key) JOIN means USING (country_key) WHERE source > 1),
bm_s AS (SELECT wg.id AS q, ww.id AS t, round(sum(w), 9) AS score FROM wg JOIN ww ON wg.country_key = ww.country_key AND wg.term = ww.term AND wg.source = 1 GROUP BY ALL),
bm_top AS (SELECT q, t, score FROM bm_s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, t) <= {TOP_WORDS}),
{tfidf("cn", "name_core", TOP_NAME)}, {tfidf("ca", "address_norm", TOP_ADDRESS)}
"""

RERANK = f"""{BASE.rstrip()},
core_pairs AS MATERIALIZED (SELECT a, b, {ratio("a", "b")} AS r FROM (SELECT DISTINCT ca AS a, cb AS b FROM sides WHERE ca <> '' AND cb <> '' UNION SELECT aa, ab FROM sides WHERE aa <> '' AND ab <> '')),
ranked AS (SELECT q, t, votes, coalesce(x.r, 0.0) AS char_name, coalesce(y.r, 0.0) AS char_address FROM sides LEFT JOIN core_pairs x ON x.a = ca AND x.b = cb LEFT JOIN core_pairs y ON y.a = aa AND y.b = ab),
reranked AS MATERIALIZED (SELECT q, t, char_name, char_address, CAST(votes AS DOUBLE) AS bm25, 1 AS retrieval_methods FROM ranked
    QUALIFY row_number() OVER (PARTITION BY q ORDER BY greatest(0.7::DOUBLE * char_name + 0.3::DOUBLE * char_address, 0.15::DOUBLE * char_name + 0.85::DOUBLE * char_address) DESC, t) <= {TOP})"""
PAIRS = f"""{RERANK},
chosen AS MATERIALIZED (SELECT p.*, a.name_norm AS na, b.name_norm AS nb, a.name_core AS ca, b.name_core AS cb, a.address_norm AS aa, b.address_norm AS ab, {squeezed("a.z1")} AS oa, {squeezed("b.z1")} AS ob
    FROM reranked p JOIN (SELECT *, {cleaned("business_name")} AS z1 FROM prep) a ON a.entity_id = q JOIN (SELECT *, {cleaned("business_name")} AS z1 FROM prep) b ON b.entity_id = t),
{strings("sim", "SELECT na AS a, nb AS b FROM chosen UNION SELECT ca, cb FROM chosen UNION SELECT aa, ab FROM chosen UNION SELECT oa, ob FROM chosen")}"""
FEATURES = "q, t, votes, name_edit, name_jaccard, name_containment, address_jaccard, address_containment, digit_jaccard, digit_conflict, country_equal, name_exact, name_core_exact, address_exact, address_missing, name_length_ratio, address_length_ratio, same_target_source"
MATCHED = f"SELECT entity_id AS source1_entity_id, coalesce(string_agg(t, ',' ORDER BY t), '') AS matched_entity_ids FROM recs LEFT JOIN scored ON q = entity_id AND probability >= {THRESHOLD} WHERE source = 1 GROUP BY entity_id"
FINALS = {
    "linear_match": MATCHED,
    "streaming_matches": MATCHED,
    "part_merge": f"SELECT source1_entity_id, ids AS candidate_entity_ids, matched_entity_ids FROM lists JOIN ({MATCHED}) USING (source1_entity_id)",
    "normalize_text": f"SELECT entity_id, {squeezed('z')} AS original_norm FROM nm_1",
    "normalize_name": "SELECT entity_id, name_norm, name_core FROM prep",
    "normalize_address": "SELECT entity_id, address_norm FROM prep",
    "digit_sets": r"SELECT entity_id, array_to_string(list_sort(list_distinct(regexp_extract_all(ad_latin, '\d+'))), ',') AS digits FROM prep",
    "country_histogram": "SELECT source, country, count(*) AS n FROM recs GROUP BY ALL",
    "split_checks": "SELECT CASE WHEN source = 1 THEN 'queries' ELSE 'targets' END AS side, count(*) AS n, count(DISTINCT entity_id) AS ids, count(*) FILTER (entity_id = '') AS empty_ids FROM recs GROUP BY ALL",
    "blocking_keys": "SELECT entity_id, key FROM keys",
    "block_sizes": "SELECT key, postings FROM sizes",
    "block_cap_filter": "SELECT key, entity_id FROM usable",
    "vote_counts": "SELECT q, t, votes FROM votes",
    "vote_pool_topk": "SELECT q, t, votes FROM pool",
    "candidate_lists": "SELECT source1_entity_id, ids AS candidate_entity_ids FROM lists",
    "term_df_idf": "SELECT country_key, term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM wdf JOIN populations USING (country_key)",
    "char_tfidf_topk": "SELECT q, t, score FROM cn_top",
    "bm25_topk": "SELECT q, t, score FROM bm_top",
    "method_union": "SELECT q, t, max(CASE WHEN m = 1 THEN score ELSE 0 END) AS char_name, max(CASE WHEN m = 2 THEN score ELSE 0 END) AS char_address, max(CASE WHEN m = 3 THEN score ELSE 0 END) AS bm25, CAST(count(*) AS INTEGER) AS retrieval_methods FROM (SELECT *, 1 AS m FROM cn_top UNION ALL SELECT *, 2 FROM ca_top UNION ALL SELECT *, 3 FROM bm_top) GROUP BY ALL",
    "pair_set_features": f"SELECT {FEATURES} FROM feats",
    "pair_jaro_winkler": "SELECT q, t, round(CASE WHEN na = '' AND nb = '' THEN 1 ELSE jaro_winkler_similarity(na, nb) END, 6) AS name_jaro FROM sides",
    "rank_features": "SELECT *, "
    + ", ".join(f"CAST(rank() OVER (PARTITION BY q ORDER BY {c} DESC) AS DOUBLE) AS {c}_rank, round(max({c}) OVER (PARTITION BY q) - {c}, 6) AS {c}_from_best" for c in ("char_name", "char_address", "bm25"))
    + ", CAST(count(*) OVER (PARTITION BY q) AS DOUBLE) AS candidate_count FROM (SELECT q, t, name_edit AS char_name, address_jaccard AS char_address, CAST(votes AS DOUBLE) AS bm25 FROM feats)",
    "labels": "SELECT pool.q, pool.t, CAST(truth.t IS NOT NULL AS INTEGER) AS label FROM pool LEFT JOIN truth ON truth.q = pool.q AND truth.t = pool.t",
    "candidate_recall": "SELECT CAST(sum(k) AS BIGINT) AS captured, CAST(sum(n) AS BIGINT) AS total, round(CASE WHEN sum(n) = 0 THEN 1 ELSE sum(k) / sum(n) END, 6) AS link_recall, round(avg(CAST(n = k AS DOUBLE)), 6) AS entity_recall FROM (SELECT truth.q, count(truth.t) AS n, count(pool.t) AS k FROM truth LEFT JOIN pool ON truth.q = pool.q AND truth.t = pool.t GROUP BY truth.q)",
    "macro_fbeta": f"SELECT round(avg(CASE WHEN actual = 0 THEN CAST(coalesce(predicted, 0) = 0 AS INTEGER) ELSE 1.25 * coalesce(tp, 0) / (0.25 * actual + coalesce(predicted, 0)) END), 6) AS macro_fbeta FROM entities LEFT JOIN (SELECT s.q, count(*) AS predicted, count(truth.t) AS tp FROM scored s LEFT JOIN truth ON truth.q = s.q AND truth.t = s.t WHERE probability >= {THRESHOLD} GROUP BY s.q) USING (q)",
    "threshold_sweep": "SELECT threshold, round(f, 6) AS macro_fbeta FROM sweep",
    "best_threshold": "SELECT threshold, round(f, 6) AS macro_fbeta FROM sweep ORDER BY round(f, 9) DESC, threshold LIMIT 1",
    "validator_findings": """SELECT 'duplicate_row' AS rule, (SELECT count(*) FROM (SELECT 1 FROM damaged GROUP BY source1_entity_id HAVING count(*) > 1)) AS n
        UNION ALL SELECT 'repeated_id', (SELECT count(*) FROM damaged WHERE len(string_split(ids, ',')) <> len(list_distinct(string_split(ids, ','))) ) UNION ALL SELECT 'reference_id', (SELECT count(*) FROM each WHERE id LIKE 'S1-%')
        UNION ALL SELECT 'bad_prefix', (SELECT count(*) FROM each WHERE NOT regexp_matches(id, '^S[123]-')) UNION ALL SELECT 'missing_row', (SELECT count(*) FROM recs WHERE source = 1 AND entity_id NOT IN (SELECT source1_entity_id FROM damaged))
        UNION ALL SELECT 'extra_row', (SELECT count(DISTINCT source1_entity_id) FROM damaged WHERE source1_entity_id NOT IN (SELECT entity_id FROM recs WHERE source = 1)) UNION ALL SELECT 'unknown_id', (SELECT count(*) FROM each WHERE id NOT IN (SELECT entity_id FROM recs WHERE source > 1))""",
    "missing_extra": "SELECT entity_id AS id, 'missing' AS what FROM recs WHERE source = 1 AND entity_id NOT IN (SELECT source1_entity_id FROM damaged) UNION ALL SELECT DISTINCT source1_entity_id, 'extra' FROM damaged WHERE source1_entity_id NOT IN (SELECT entity_id FROM recs WHERE source = 1)",
    "subset_check": "SELECT source1_entity_id, id FROM each WHERE NOT EXISTS (SELECT 1 FROM pool WHERE q = source1_entity_id AND t = id)",
    "hash_sample": "SELECT entity_id, country FROM recs WHERE source = 1 QUALIFY row_number() OVER (PARTITION BY country ORDER BY md5(entity_id || '|2026'), entity_id) <= 50",
    "fold_assignment": "SELECT entity_id, CAST(CAST('0x' || substr(md5(entity_id), 1, 8) AS BIGINT) % 3 AS INTEGER) AS fold FROM recs WHERE source = 1",
}
rounded = lambda x, name: f"round(CAST({x} AS FLOAT)::DOUBLE, 6) AS {name}"
SIMILAR = [("name_ratio", "n.ratio"), ("name_wratio", "n.wratio"), ("name_token_set", "c.token_set"), ("name_token_sort", "c.token_sort"), ("name_jaro", "CASE WHEN na = '' AND nb = '' THEN 1 ELSE jaro_winkler_similarity(na, nb) END"),
    ("address_ratio", "d.ratio"), ("address_wratio", "d.wratio"), ("address_token_set", "d.token_set"), ("address_jaro", "CASE WHEN aa = '' AND ab = '' THEN 1 ELSE jaro_winkler_similarity(aa, ab) END"), ("original_script_name_ratio", "o.ratio")]
SET_NAMES = [x for x in FEATURES.split(", ") if x not in ("q", "t", "votes")]
RANKS = [(c, c.replace("char_", "blocking_").replace("bm25", "blocking_votes")) for c in ("char_name", "char_address", "bm25")]
RERANKED = {
    "rerank_topk": f"{RERANK} SELECT q, t, round(char_name, 9) AS char_name, round(char_address, 9) AS char_address, bm25, retrieval_methods FROM reranked",
    "pair_features": f"""{PAIRS} SELECT x.q, x.t, {", ".join(rounded(f"x.{c}", n) for c, n in RANKS)}, CAST(retrieval_methods AS DOUBLE) AS retrieval_methods, {", ".join(rounded(f"feats.{n}", n) for n in SET_NAMES)}, {", ".join(rounded(e, n) for n, e in SIMILAR)},
        {", ".join(f"CAST(rank() OVER (PARTITION BY x.q ORDER BY CAST(x.{c} AS FLOAT) DESC) AS DOUBLE) AS {n}_rank, round(CAST(max(CAST(x.{c} AS FLOAT)) OVER (PARTITION BY x.q) - CAST(x.{c} AS FLOAT) AS DOUBLE), 6) AS {n}_from_best" for c, n in RANKS)},
        CAST(count(*) OVER (PARTITION BY x.q) AS DOUBLE) AS candidate_count FROM chosen x JOIN feats USING (q, t) JOIN sim n ON n.a = na AND n.b = nb JOIN sim c ON c.a = ca AND c.b = cb JOIN sim d ON d.a = aa AND d.b = ab JOIN sim o ON o.a = x.oa AND o.b = x.ob""",
}
#: A sample of the targets of each country, and the most frequent of its terms.
VOCABULARY = f"""{BASE.rstrip().rstrip(',')},
fit_on AS (SELECT entity_id AS id, country_key FROM prep WHERE source > 1 QUALIFY row_number() OVER (PARTITION BY country_key ORDER BY md5(entity_id || '|2026'), entity_id) <= 150),
fit_terms AS (SELECT country_key, term, count(*) AS df, sum(tf) AS times FROM wg JOIN fit_on USING (id, country_key) GROUP BY ALL),
known AS MATERIALIZED (SELECT country_key, term, df FROM fit_terms QUALIFY row_number() OVER (PARTITION BY country_key ORDER BY times DESC, encode(term)) <= 400),
fit_sizes AS (SELECT country_key, n, greatest(coalesce(total, 0) / n, 1.0) AS mean FROM (SELECT country_key, count(*) AS n FROM fit_on GROUP BY country_key)
    LEFT JOIN (SELECT country_key, sum(tf) AS total FROM wg JOIN fit_on USING (id, country_key) JOIN known USING (country_key, term) GROUP BY country_key) USING (country_key)),
known_lens AS (SELECT id, country_key, sum(tf) AS len FROM wg JOIN known USING (country_key, term) WHERE source > 1 GROUP BY ALL),
known_w AS (SELECT wg.id, country_key, term, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM wg JOIN known USING (country_key, term) JOIN known_lens USING (id, country_key) JOIN fit_sizes USING (country_key) WHERE source > 1),
known_s AS (SELECT wg.id AS q, k.id AS t, round(sum(w), 9) AS score FROM wg JOIN known_w k ON wg.country_key = k.country_key AND wg.term = k.term AND wg.source = 1 GROUP BY ALL)"""
#: Groups are dealt one after the other: the loads of the folds are a list that each step changes at its first least place.
FOLDS = f"""{BASE.rstrip().rstrip(',').replace("WITH d AS", "WITH RECURSIVE d AS", 1)},
groups AS MATERIALIZED (SELECT q, n, row_number() OVER (ORDER BY n DESC, md5(q), q) AS i FROM (SELECT q, count(*) AS n FROM pool GROUP BY q)),
steps(i, loads, fold) AS (SELECT CAST(0 AS BIGINT), CAST([0, 0, 0] AS BIGINT[]), CAST(-1 AS INTEGER) UNION ALL
    SELECT g.i, list_transform(range(3), lambda f: loads[f + 1] + CASE WHEN f + 1 = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END), CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER) FROM steps JOIN groups g ON g.i = steps.i + 1)"""
#: Letters go over one by one: a consonant gets an a before a letter that is no vowel, and as a word of its own.
INDIC = f"""{BASE.rstrip().rstrip(',')},
made AS (SELECT entity_id, name_norm, replace(replace(replace(replace(translate(name_norm, 'bcdghjklmnprstvwyaeiou', 'बकदगहजकलमनपरसतववयाेिोु'), 'f', 'फ़'), 'q', 'क़'), 'z', 'ज़'), 'x', 'क्ष') AS spelt,
    array_to_string(list_transform(string_split(name_norm, ''), lambda c, i: CASE c WHEN 'x' THEN 'ksh' WHEN 'c' THEN 'k' WHEN 'w' THEN 'v' ELSE c END ||
        CASE WHEN NOT regexp_matches(c, '[b-df-hj-np-tv-z]') OR regexp_matches(substr(name_norm, i + 1, 1), '[aeiou]') THEN '' WHEN regexp_matches(substr(name_norm, i + 1, 1), '\\p{{L}}') THEN 'a'
        WHEN c = 'x' OR i > 1 AND regexp_matches(substr(name_norm, i - 1, 1), '\\p{{L}}') THEN '' ELSE 'a' END), '') AS back FROM prep)"""
FITTED = {
    "indic_names": f"{INDIC} SELECT entity_id, spelt, CASE WHEN back IN ('nan', 'none', 'null') THEN '' ELSE back END AS name_latin FROM made",
    "fitted_vocabulary": f"{VOCABULARY} SELECT * FROM known",
    "bounded_bm25_topk": f"{VOCABULARY} SELECT q, t, score FROM known_s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, t) <= {TOP_WORDS}",
    "balanced_folds": f"{FOLDS} SELECT q, n, fold FROM steps JOIN groups USING (i)",
}
ORACLE_SQL = {name: f"{BASE.rstrip().rstrip(',')} {final}" for name, final in FINALS.items()} | RERANKED | FITTED
