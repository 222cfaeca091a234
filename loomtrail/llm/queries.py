"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, exact_dedup, html, line_dedup, lm_score, mixing, phrases, private, quality, simhash, substring_dedup, urls
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


#: The rules of the URL query: verdict, host and path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), RULES)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
s AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
w AS (
  SELECT doc_id, pos, lead(pos, 1) OVER d AS pos1, lead(pos, 2) OVER d AS pos2,
         line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS said
  FROM s WHERE line <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY said ORDER BY doc_id, pos) AS nth FROM w WHERE said IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos1, pos2]) AS pos FROM r WHERE nth > 1)
SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text
FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read(spark, sf_dir, "documents")).drop("tag")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(read(spark, sf_dir, "conversations")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(ws) AS gram FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, k, gram, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, gram, n AS a, string_split(gram, ' ') AS ws FROM f WHERE k > 1 AND n >= 10),
x AS (
  SELECT lang, k, gram, a, 1 AS cut, ws[1] AS one, array_to_string(ws[2:], ' ') AS rest FROM c
  UNION ALL SELECT lang, k, gram, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE k = 3),
y AS (
  SELECT x.lang, x.k, x.gram, x.a, cut, fl.n AS l, fr.n AS r, (1000000::HUGEINT * x.a * x.a) // (fl.n::HUGEINT * fr.n) AS score
  FROM x JOIN f fl ON fl.lang = x.lang AND fl.gram = x.one JOIN f fr ON fr.lang = x.lang AND fr.gram = x.rest),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) AS nth FROM y),
i AS (
  SELECT lang, ws[1] || ' ' || ws[2] AS gram, a FROM c WHERE k = 3
  UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM c WHERE k = 3),
m AS (SELECT lang, gram, max(a) AS longer FROM i GROUP BY ALL),
o AS (
  SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, z.a DESC, z.gram) AS rank
  FROM z LEFT JOIN m ON m.lang = z.lang AND m.gram = z.gram
  WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 50 * z.a))
SELECT o.lang, rank, gram AS phrase, a, l, r, s.n, score::BIGINT AS score FROM o JOIN s ON s.lang = o.lang WHERE rank <= 2000
"""


def op13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.personal_data(read(spark, sf_dir, "documents")).drop("found")


def queries() -> dict[str, Query]:
    named = (
        op1_html_extraction, op2_quality_classifier, op3_url_filter, op4_decontaminate, op5_exact_dedup,
        op6_line_dedup, op7_substring_dedup, op8_lm_score, op9_mix_sources, op10_simhash_dedup, op11_conversation_repair, op12_phrases,
        op13_private,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op6_line_dedup": OP6_SQL, "op12_phrases": OP12_SQL}
