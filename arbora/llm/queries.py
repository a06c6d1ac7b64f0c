"""The operators of this subpackage as queries, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import exact_dedup, filter_audit, hard_negatives, licenses, mixing, packing, pieces, quality, rlz_dedup, simhash, suffix_dedup, tokens, urls
from arbora.llm.common import table, vocabulary

Query = Callable[[SparkSession, str], DataFrame]
#: Tokens above which op6 marks a document.
TOKEN_LIMIT = 4096


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.page_outcomes(pages, table(spark, sf_dir, "labels")))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_simhash_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.strip_substrings(table(spark, sf_dir, "documents"))


def op8_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.strip_word_windows(table(spark, sf_dir, "documents"))


def op9_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents")).drop("n_points")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    single = (op1_url_reputation, op2_source_mix, op3_best_fit_packing, op4_simhash_copies, op5_quality_rules, op6_token_counts, op7_suffix_dedup, op8_rlz_dedup, op9_exact_copies, op10_license_scan, op11_hard_negatives, op12_piece_round_trip, op13_filter_audit)
    return {f.__name__: f for f in single}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH cuts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cuts),
rules(action, rhost, rpath) AS (VALUES {", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in urls.RULES)}),
fits AS (SELECT page_id, first(rhost || rpath ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS rule, first(action ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS action
         FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
pagedoc AS (SELECT host, TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})[^/]*/?$', 1), '') AS BIGINT) AS doc_id FROM parts),
bare AS (SELECT host, regexp_replace(host, '{urls.BESIDE}', '', 'g') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM pagedoc LEFT JOIN marks USING (doc_id) GROUP BY host),
hosts AS (SELECT *, regexp_extract(name, '{urls.SECOND_LEVEL}', 2) AS two, regexp_matches(name, '{urls.ADDRESS}') AS address FROM bare),
named AS (SELECT host, n, bad, CASE WHEN address THEN '{urls.ADDRESSES}' WHEN two <> '' THEN two ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix,
                 CASE WHEN address THEN name WHEN two <> '' THEN regexp_extract(name, '([^.]*\.?[^.]*\.[^.]*)$', 1) ELSE regexp_extract(name, '([^.]*\.?[^.]*)$', 1) END AS domain FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.5) FROM named) AS prior FROM named GROUP BY suffix),
{{level0}},
d0 AS (SELECT suffix, domain, sum(named.n) AS n, sum(named.bad) AS bad, any_value(s1.a / (s1.a + s1.b)) AS prior FROM named JOIN s1 USING (suffix) GROUP BY suffix, domain),
{{level1}},
h0 AS (SELECT host, named.n AS n, named.bad AS bad, d1.a / (d1.a + d1.b) AS prior FROM named JOIN d1 USING (suffix, domain)),
{{level2}},
bounds AS (SELECT host, a / (a + b) - {urls.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM h1)
SELECT page_id, host, path, rule, CASE WHEN action IS NOT NULL THEN action WHEN bound > {urls.THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict, round(bound, 6) AS bound
FROM parts LEFT JOIN fits USING (page_id) LEFT JOIN bounds USING (host)
"""


def _level(x: str) -> str:
    over = "sum(n * (bad / n - prior) * (bad / n - prior) - prior * (1 - prior))"
    room = "sum(prior * (1 - prior) * (n - 1))"
    rho = f"CASE WHEN {room} <> 0 THEN least(greatest({over} / {room}, {urls.RHO[0]}::DOUBLE), {urls.RHO[1]}::DOUBLE) ELSE {urls.RHO[0]}::DOUBLE END"
    return f"{x}m AS (SELECT 1 / ({rho}) - 1 AS m FROM {x}0 WHERE n > 0), {x}1 AS (SELECT {x}0.*, bad + m * prior AS a, n - bad + m * (1 - prior) AS b FROM {x}0, {x}m)"


OP2_SQL = f"""
WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((r - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM per),
levels AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, coalesce(sum(cap) OVER w, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
           FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, max((total - caps) / rest) OVER () * weight) AS target FROM levels),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
rows0 AS (SELECT sized.*, source_size, target, rate FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source),
tried AS (SELECT *, (((coalesce(doc_id, 0) % {mixing.PRIME} + {mixing.PRIME}) % {mixing.PRIME}) * 48271 + seed * 69621 + 12345) % {mixing.PRIME} AS a0
          FROM rows0, (SELECT unnest(range({mixing.SEEDS})) AS seed)),
drawn AS (SELECT *, ((((a0 * a0) % {mixing.PRIME}) * 16807 + seed * 7919 + 1) % {mixing.PRIME}) AS c0 FROM tried),
counted AS (SELECT *, floor(rate)::BIGINT + CASE WHEN ((c0 * c0) % {mixing.PRIME}) / {mixing.PRIME}::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM drawn),
sums AS (SELECT source, seed, abs(sum(copies * size) - any_value(target)) AS off FROM counted WHERE size > 0 GROUP BY source, seed),
best AS (SELECT source, first(seed ORDER BY off, seed) AS seed FROM sums GROUP BY source)
SELECT counted.doc_id, counted.source, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken
FROM counted LEFT JOIN best ON counted.source IS NOT DISTINCT FROM best.source WHERE counted.seed = coalesce(best.seed, 0)
"""

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT r, i, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lead(word, 4) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
hits AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, w1, w2, w3, w4) > 1 AS hit FROM g WHERE w4 IS NOT NULL),
near AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM hits WHERE hit),
rep AS (SELECT r, sum(least(coalesce(nxt - i, 5), 5)) AS n_repeat_words FROM near GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
             len(list_filter(words, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words
      FROM d LEFT JOIN rep USING (r))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars BETWEEN 2 * n_words AND 20 * n_words
       AND n_symbols <= 0.3::DOUBLE * n_words AND n_stop_words + 1 >= 0.02::DOUBLE * n_words AND n_dup_lines <= 0.5::DOUBLE * n_lines AS kept
FROM m
"""

OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words FROM documents),
w AS (SELECT r, unnest(range(1, len(words) - {rlz_dedup.WIDTH} + 2)) AS i, words FROM d WHERE len(words) >= {rlz_dedup.WIDTH}),
g AS (SELECT r, i, array_to_string(words[i:i + {rlz_dedup.WIDTH} - 1], ' ') AS win FROM w),
hits AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {rlz_dedup.WIDTH})) AS i FROM hits),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
each AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(removed.n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256, row_number() OVER () AS r FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size, first_value(doc_id) OVER b AS keep_id, row_number() OVER b AS place
      FROM d WINDOW b AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, text_sha256 FROM g
"""

OP11_SQL = """
WITH rows0 AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM rows0 a, rows0 b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""

_ORDERS = ", ".join(f"('{o}', {k + 1}, '{o[k]}', '{o[:k]}')" for o in filter_audit.ORDERS for k in range(5))
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS} AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, good, toxic, concat(CASE WHEN len(words) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' END,
                  CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > low THEN 'E' END) AS f
           FROM d LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failed GROUP BY part, f),
orders(filter_order, step, own, earlier) AS (VALUES {_ORDERS}),
met AS (SELECT part, filter_order, step, own, f, n, good, toxic, contains(f, own) AS has, len(list_filter(string_split(earlier, ''), lambda c: c <> '' AND contains(f, c))) > 0 AS gone FROM cells, orders),
steps AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT has AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (has AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (has AND gone), 0) AS redundant,
                 coalesce(sum(n) FILTER (f = own), 0) AS unique_fails, coalesce(sum(good) FILTER (has AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (has AND NOT gone), 0) AS toxic_lost
          FROM met GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM steps
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_reputation": OP1_SQL.replace("{level0}", _level("s")).replace("{level1}", _level("d")).replace("{level2}", _level("h")),
        "op2_source_mix": OP2_SQL,
        "op5_quality_rules": OP5_SQL,
        "op8_rlz_dedup": OP8_SQL,
        "op9_exact_copies": OP9_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op13_filter_audit": OP13_SQL,
    }
