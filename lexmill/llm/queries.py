"""The queries of this subpackage and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloom_cascade, chat_format, decontaminate, fertility, license_scan, near_dup, pareto_mix, pii_crf, substring_fm, token_cache


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(_table(spark, sf_dir, "documents"))


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.private(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.pareto_mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "n_chars", "copy")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.token_counts(_table(spark, sf_dir, "documents"))


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return bloom_cascade.url_filter(pages, bloom_cascade.keys_of_sites(pages))


def op7_substring_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_fm.repeats(_table(spark, sf_dir, "documents"))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(_table(spark, sf_dir, "documents"))


def op9_minhash_bbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_chat_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_segments(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_pii_crf, op3_decontaminate, op4_pareto_mix, op5_token_counts, op6_url_cascade, op7_substring_fm, op8_fertility, op9_minhash_bbit, op10_chat_fsm)}


_OP3 = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS t FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
g AS (SELECT n, gram, min(item_id) AS item_id FROM (
    SELECT item_id, 8 AS n, array_to_string(t[i:i + 7], ' ') AS gram FROM (SELECT item_id, t, unnest(range(1, len(t) - 6)) AS i FROM b WHERE len(t) >= 8)
    UNION ALL SELECT item_id, len(t) AS n, array_to_string(t, ' ') AS gram FROM b WHERE len(t) BETWEEN 5 AND 7) GROUP BY ALL),
d AS (SELECT doc_id, rid, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM w CROSS JOIN (SELECT DISTINCT n AS k FROM g) WHERE len(t) >= k),
h AS (SELECT d.doc_id, d.rid, d.i, d.i + d.k - 1 AS j, g.item_id FROM d JOIN g ON g.n = d.k AND g.gram = array_to_string(d.t[d.i:d.i + d.k - 1], ' ')),
m AS (SELECT *, CASE WHEN i <= max(j) OVER (PARTITION BY rid ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM h),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS span FROM m),
x AS (SELECT doc_id, rid, span, min(i) - 1 AS first_word, max(j) - 1 AS last_word, min(item_id) AS item_id FROM s GROUP BY doc_id, rid, span),
y AS (SELECT x.*, len(w.t) AS doc_words, sum(last_word - first_word + 1) OVER (PARTITION BY x.rid) AS covered FROM x JOIN w ON x.rid = w.rid)
SELECT doc_id, first_word, last_word, last_word - first_word + 1 AS n_words, item_id, doc_words,
    CASE WHEN covered > 0.5 * doc_words THEN 'drop document' ELSE 'cut span' END AS action FROM y
"""

_OP4 = """
WITH d AS (SELECT doc_id, source, n_chars, greatest(coalesce(n_chars, 0), 1) AS w FROM documents),
s AS (SELECT source, sum(w)::HUGEINT AS tw FROM d GROUP BY source),
q AS (SELECT source, tw, floor(1.0 / (SELECT count(*) FROM s) * (SELECT count(*) FROM d) + 0.5)::BIGINT AS n FROM s),
e AS (SELECT d.*, tw, (n::HUGEINT * w) // tw AS whole, (n::HUGEINT * w) % tw AS r,
    (('0x' || substr(md5(coalesce(doc_id, -1)::VARCHAR || ':20240229'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT source, (sum(r) // max(tw))::BIGINT AS k FROM e GROUP BY source),
z AS (SELECT e.*, k, CASE WHEN r > 0 THEN row_number() OVER (PARTITION BY e.source ORDER BY CASE WHEN r > 0 THEN 0 ELSE 1 END,
    u / (1 - u) * ((tw - r)::DOUBLE / nullif(r, 0)::DOUBLE), doc_id) END AS rank FROM e JOIN k ON e.source IS NOT DISTINCT FROM k.source),
c AS (SELECT doc_id, source, n_chars, whole + CASE WHEN r > 0 AND rank <= k THEN 1 ELSE 0 END AS copies FROM z)
SELECT doc_id, source, n_chars, unnest(range(1, copies::BIGINT + 1)) AS copy FROM c WHERE copies > 0
"""


_KEY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '[?#].*$', ''), '^www\.', ''), '^([^/:]*):[0-9]+', '\1'), '/+$', '')"

_OP6 = rf"""
WITH k AS (SELECT page_id, url, {_KEY} AS key FROM pages),
l AS (SELECT DISTINCT key FROM k WHERE regexp_extract(regexp_extract(key, '^[^/]*', 0), '([^.]+)\.example\.[a-z]+$', 1)
    IN ('cheap-pills', 'spam-farm', 'casino-win', 'free-bets', 'ads-track', 'adult-x'))
SELECT page_id, url, key IS NOT NULL AND key IN (SELECT key FROM l WHERE key IS NOT NULL) AS listed FROM k
"""

_OP10 = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER w - 1 AS n, coalesce(lag(role) OVER w, 'start') AS state, lead(role) OVER w AS nxt FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, state || '>' || role NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS bad FROM o),
c AS (SELECT conv_id, CASE
    WHEN count(*) FILTER (WHERE turn IS NULL OR role IS NULL) > 0 THEN 'missing turn or role'
    WHEN count(DISTINCT turn) < count(*) THEN 'two texts for a turn'
    WHEN count(*) FILTER (WHERE regexp_replace(coalesce(text, ''), '[\s\x0B\x{85}\p{Z}\x{FEFF}]', '', 'g') = '') > 0 THEN 'blank turn'
    WHEN count(*) FILTER (WHERE bad) > 0 THEN arg_min(role || ' after ' || state, n) FILTER (WHERE bad)
    WHEN max(role) FILTER (WHERE nxt IS NULL) <> 'assistant' THEN 'ends after ' || max(role) FILTER (WHERE nxt IS NULL)
    ELSE '' END AS error FROM b GROUP BY conv_id),
v AS (SELECT b.* FROM b JOIN c ON b.conv_id = c.conv_id WHERE error = '')
SELECT conv_id, 3 * n AS segment, role, '<|' || role || '|>' || chr(10) AS text, false AS loss, '' AS error FROM v
UNION ALL SELECT conv_id, 3 * n + 1, role, text, role = 'assistant', '' FROM v
UNION ALL SELECT conv_id, 3 * n + 2, role, '<|end|>' || chr(10), role = 'assistant', '' FROM v
UNION ALL SELECT conv_id, -1, '', '', false, error FROM c WHERE error <> ''
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": _OP3, "op4_pareto_mix": _OP4, "op6_url_cascade": _OP6, "op10_chat_fsm": _OP10}
