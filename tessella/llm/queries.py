"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import chats, fingerprints, html_text, jaccard, licenses, mixing, quality, tokens, toxicity
from tessella.llm.common import documents

TOKENIZER = "byte_bpe_50k.json"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(documents(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.quality(docs, bands=quality.fit_bands(docs, documents(spark, sf_dir, "labels")))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.format_chats(documents(spark, sf_dir, "conversations"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_digest(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_toxicity, op3_mixing, op4_token_counts, op5_fingerprints, op6_quality_rules, op7_license_scans, op8_chat_formatting, op9_bpe_round_trip, op10_jaccard_join)}

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"

_MIXING = f"""WITH q AS (SELECT doc_id, avg(quality) AS q FROM labels GROUP BY doc_id),
r AS (SELECT d.doc_id, d.source, CAST(len({_WORDS.format(t="coalesce(text, '')")}) AS BIGINT) AS size,
  -ln((CAST('0x' || substr(md5('mix' || chr(31) || d.doc_id), 1, 13) AS UBIGINT) + 0.5) / 4503599627370496) / CASE WHEN q IS NULL THEN 1.0 ELSE greatest(0, q) + 0.5 END AS key FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM r GROUP BY source),
l AS (SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER up, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS level FROM s WINDOW up AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, n, least(2 * n, w * coalesce((SELECT arg_min(level, n / w) FROM l WHERE 2 * n / w >= level), 1e300)) AS target FROM l),
k AS (SELECT r.*, t.n, t.target, least(floor(t.target / t.n + 1e-12), 2) AS epochs, coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size > 0 THEN CAST(least(2, epochs + CASE WHEN before + size / 2 <= target - epochs * n THEN 1 ELSE 0 END) AS BIGINT) ELSE 0 END AS copies FROM k)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS n_copies FROM c"""

_CHATS = """WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -4611686018427387904) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(r := coalesce(role, chr(1)), x := coalesce(text, chr(1))) ORDER BY turn) AS ts,
  string_agg('<|' || replace(coalesce(role, ''), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn) AS chat FROM t GROUP BY conv_id),
w AS (SELECT ts, min(conv_id) AS conv_id, count(*) AS n FROM c GROUP BY ts),
p AS (SELECT conv_id, unnest(list_transform(range(1, len(ts)), lambda i: ts[1:i])) AS ts FROM w),
a AS (SELECT p.conv_id, sum(w.n) AS n FROM p JOIN w ON p.ts = w.ts GROUP BY p.conv_id)
SELECT w.conv_id, CAST(len(w.ts) AS BIGINT) AS n_turns, CAST(w.n AS BIGINT) AS n_copies, CAST(coalesce(a.n, 0) AS BIGINT) AS n_snapshots, c.chat
FROM w JOIN c ON c.conv_id = w.conv_id LEFT JOIN a ON a.conv_id = w.conv_id WHERE w.ts NOT IN (SELECT ts FROM p)"""

_JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(min(r.root) AS BIGINT) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""

#: The other operators train a model, compress, tokenize or estimate, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = {"op3_mixing": _MIXING, "op8_chat_formatting": _CHATS, "op10_jaccard_join": _JACCARD}
