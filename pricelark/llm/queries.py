"""The numbered queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, jaccard, license_scan, line_rules, mixing, packing, paragraphs, periodic, quality, rans, spelling, url_rules
from .common import stage


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_token_files(spark, sf_dir):
    return rans.report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_fingerprints(spark, sf_dir):
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    return paragraphs.repeat_report(table(spark, sf_dir, "documents"))


def op6_url_filters(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard.near_components(table(spark, sf_dir, "documents"), 3, 0.9)


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_line_rules(spark, sf_dir):
    return line_rules.judge(table(spark, sf_dir, "documents")).drop("removed_words")


def op10_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


#: A conversation whose texts look like the format's own marks.
_ODD_TEXT = "\\### Assistant: </turn> ok"


def op11_chat_format(spark, sf_dir):
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", _ODD_TEXT), (-7, 1, "assistant", _ODD_TEXT)], convs.schema)
    return chat.read_back(stage(chat.format_conversations(convs.unionByName(odd)), f"chat-{uuid.uuid4().hex}"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality, op3_token_files, op4_fingerprints, op5_substring_dedup, op6_url_filters, op7_jaccard_join, op8_packing, op9_line_rules, op10_mixing, op11_chat_format, op12_spelling_variants, op13_periodic_runs)}


def _license_sql() -> str:
    posts = ", ".join(f"('{n}', '{label}', {str(base).lower()}, {must}, '{w}', {at})" for n, label, base, _, must, w, at in license_scan._postings(license_scan.TEMPLATES))
    return rf"""
WITH posts(template, label, base, must, word, pos) AS (VALUES {posts}),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
places AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM words),
known AS (SELECT * FROM places WHERE word IN (SELECT word FROM posts)),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM known GROUP BY word),
total AS (SELECT count(*) AS files FROM documents),
idf AS (SELECT posts.*, ln((files + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1.0 AS idf FROM posts LEFT JOIN df USING (word) CROSS JOIN total),
whole AS (SELECT template, sum(idf) AS all_idf FROM idf GROUP BY template),
met AS (SELECT k.doc_id, i.template, i.label, i.base, i.must, k.p - i.pos AS start, i.pos, i.idf, max(i.idf) OVER (PARTITION BY k.doc_id, i.template) AS top FROM known k JOIN idf i USING (word)),
aligned AS (SELECT doc_id, template, start, any_value(label) AS label, any_value(base) AS base, any_value(must) AS must, bool_or(idf >= top) AS proposed, bit_or(1::BIGINT << pos) AS mask, sum(idf) AS got FROM met GROUP BY doc_id, template, start),
finds AS (SELECT a.*, least(1.0, got / all_idf) AS score FROM aligned a JOIN whole USING (template) WHERE proposed AND (mask & must) = must),
per AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM finds GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6)::DOUBLE AS score
FROM words w LEFT JOIN per ON w.doc_id = per.doc_id"""


_LINES_SQL = r"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS nr, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT nr, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3),
dup AS (SELECT nr, i FROM (SELECT nr, i, count(*) OVER (PARTITION BY nr, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT nr, count(*) AS n FROM (SELECT DISTINCT nr, unnest([i, i + 1, i + 2]) AS k FROM dup) GROUP BY nr),
raw AS (SELECT nr, source, text, unnest(string_split(text, chr(10))) AS line FROM w),
lines AS (SELECT nr, source, text, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT nr, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY nr),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM lines GROUP BY source),
often AS (SELECT c.source, norm FROM (SELECT source, norm, count(DISTINCT text) AS n FROM lines GROUP BY source, norm) AS c JOIN hosts ON c.source IS NOT DISTINCT FROM hosts.source WHERE n >= 3 AND n > 0.05 * docs),
lost AS (SELECT nr, sum(len(string_split(lines.norm, ' '))) AS n FROM lines JOIN often ON lines.norm = often.norm AND lines.source IS NOT DISTINCT FROM often.source GROUP BY nr),
base AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
  FROM w LEFT JOIN dl USING (nr) LEFT JOIN covered USING (nr) LEFT JOIN lost USING (nr))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.7 * n_words) AS kept
FROM base"""


def _mixing_sql(seeds: int = 16) -> str:
    draws = ", ".join(f"sum(size * (floor(rate) + CASE WHEN ('0x' || substr(md5(doc_id || ':' || {k}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT) AS t{k}" for k in range(seeds))
    best = "least(" + ", ".join(f"abs(t{k} - target)" for k in range(seeds)) + ")"
    pick = "CASE " + " ".join(f"WHEN abs(t{k} - target) = {best} THEN {k}" for k in range(seeds)) + " END"
    return rf"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS s FROM sizes GROUP BY source),
w AS (SELECT source, s, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1)::INT % 3 + 1] AS weight FROM per),
r AS (SELECT *, sum(s) OVER () AS total, coalesce(sum(s) OVER (ORDER BY s::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY s::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_, row_number() OVER (ORDER BY s::DOUBLE / weight, source ASC NULLS LAST) AS turn FROM w),
l AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * before::DOUBLE) / left_::DOUBLE AS level FROM r),
a AS (SELECT *, first(CASE WHEN level * weight <= 2.0::DOUBLE * s THEN level END ORDER BY CASE WHEN level * weight <= 2.0::DOUBLE * s THEN turn ELSE 1000000000 END) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS common FROM l),
t AS (SELECT source, s, coalesce(least(2.0::DOUBLE * s, common * weight), 2.0::DOUBLE * s) AS target FROM a),
rates AS (SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0.0::DOUBLE END AS rate FROM t),
joined AS (SELECT sizes.*, s, target, rate FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source),
tried AS (SELECT source, s, target, rate, {draws} FROM joined GROUP BY source, s, target, rate),
seeded AS (SELECT source, {pick} AS seed FROM tried)
SELECT doc_id, size, s AS source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5(doc_id || ':' || seed), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM joined JOIN seeded ON joined.source IS NOT DISTINCT FROM seeded.source"""


_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
t AS (SELECT *, role = 'assistant' AS learned,
  length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 + coalesce(list_sum(list_transform(regexp_extract_all(text, '#+'), lambda x: greatest(len(x) - 2, 0))), 0) AS shown,
  length(role) + length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '</turn>', ''))) // 7 + coalesce(list_sum(list_transform(regexp_extract_all(role, '#+'), lambda x: greatest(len(x) - 2, 0))), 0) + (length(role) - length(replace(role, ': ', ''))) // 2 AS named FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (learned), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (learned), '')) AS loss_sha256,
  sum(shown + named + 6 + 8)::BIGINT AS formatted_chars, (count(*) FILTER (learned AND text <> ''))::BIGINT AS loss_turns
FROM t GROUP BY conv_id"""


SQL = {"op1_license_scan": _license_sql(), "op9_line_rules": _LINES_SQL, "op10_mixing": _mixing_sql(), "op11_chat_format": _CHAT_SQL}
