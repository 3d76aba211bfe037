"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm import answers, leakage, matching, mixing, neardup, quality, quota
from marlstone.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defects(table(spark, d, "p3_gold_p3v3_new10"))


def p2_plan(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "params").select("sample_size_n", "min_per_category").first()
    got = quota.plan(table(spark, d, "corpus_tagged"), table(spark, d, "sample_targets"), p[0], p[1])
    return got.select(F.col("row_name").alias("temporal_bin"), F.col("column").alias("section"), "needed", "available", "quota", "shortfall")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return p2_plan(spark, d).select("temporal_bin", "section", "needed", "available", "shortfall")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_plan(spark, d).where("shortfall > 0").select("temporal_bin", "section")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    corpus, p = table(spark, d, "corpus_tagged"), table(spark, d, "params").select("sample_size_n", "min_per_category").first()
    drawn = quota.draw(corpus, quota.plan(corpus, table(spark, d, "sample_targets"), p[0], p[1]))
    return drawn.select(F.col("row").alias("temporal_bin"), F.col("column").alias("section"), F.col("id").alias("sentenceID"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "v_sample_1m_core"), "sentenceID", "docID", "sentence").select("sentence_id_a", "sentence_id_b")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "v_sample_1m_core"), "sentenceID", "sentence", doc_col="docID").withColumnRenamed("id", "sentence_id")


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.match(table(spark, d, "sec_company_tickers"), table(spark, d, "spy_holdings_15oct"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).select("cik", "identifier")


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_matches(spark, d).select("doc_id", "item_id")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    budget = table(spark, d, "params").select("mix_budget_tokens").first()[0]
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), budget)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].where("short").select("source")


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_stats(spark, d).where("text_kind <> 'prose'").select("doc_id", "text_kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_plan": p2_plan,
    "p2_report": p2_report,
    "p2_sample": p2_sample,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p5_found": p5_found,
    "p5_matches": p5_matches,
    "p6_found": p6_found,
    "p6_matches": p6_matches,
    "p7_found": p7_found,
    "p7_uses": p7_uses,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
}

_KEY = r"regexp_replace(lower(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '[\s\p{{Z}}_\-./]+', '_', 'g')"

SQL: dict[str, str] = {
    "p2_found": f"""
WITH have AS (SELECT {_KEY.format('temporal_bin')} AS b, section AS s, count(DISTINCT sentenceID) AS n FROM corpus_tagged WHERE section IS NOT NULL GROUP BY 1, 2)
SELECT t.temporal_bin, t.section FROM sample_targets t CROSS JOIN params p LEFT JOIN have h ON h.b = {_KEY.format('t.temporal_bin')} AND h.s = t.section
WHERE coalesce(h.n, 0) < greatest(floor(t.target_share * p.sample_size_n + 0.5), p.min_per_category)""",
    "p2_report": f"""
WITH have AS (SELECT {_KEY.format('temporal_bin')} AS b, section AS s, count(DISTINCT sentenceID) AS n FROM corpus_tagged WHERE section IS NOT NULL GROUP BY 1, 2),
t AS (SELECT t.temporal_bin, t.section, CAST(greatest(floor(t.target_share * p.sample_size_n + 0.5), p.min_per_category) AS BIGINT) AS needed, coalesce(h.n, 0) AS available FROM sample_targets t CROSS JOIN params p LEFT JOIN have h ON h.b = {_KEY.format('t.temporal_bin')} AND h.s = t.section)
SELECT *, greatest(needed - available, 0) AS shortfall FROM t""",
    # the cases do not depend on the tokenizer, so words and marks stand for tokens
    "p7_found": f"""
WITH have AS (SELECT {_KEY.format('source')} AS k, sum(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s]')))::DOUBLE AS n FROM documents WHERE regexp_matches(text, '[^\\s\\p{{Z}}]') GROUP BY 1)
SELECT t.source FROM mix_targets t CROSS JOIN params p LEFT JOIN have h ON h.k = {_KEY.format('t.source')} WHERE coalesce(h.n, 0) * t.max_repeats < t.target_share * p.mix_budget_tokens""",
    "p3_found": """
WITH s AS (SELECT DISTINCT sentenceID AS i, docID AS d, list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS w FROM v_sample_1m_core WHERE sentence IS NOT NULL AND docID IS NOT NULL),
big AS (SELECT i, d, w, len(w) AS n, row_number() OVER () AS k FROM s WHERE len(w) >= 12),
words AS (SELECT k, n, unnest(w) AS x FROM big),
same AS (SELECT a.k AS k1, b.k AS k2, count(*) AS c FROM words a JOIN words b ON a.x = b.x AND a.k < b.k AND a.n >= 0.7 * b.n - 1e-9 AND b.n >= 0.7 * a.n - 1e-9 GROUP BY 1, 2)
SELECT DISTINCT least(a.i, b.i) AS sentence_id_a, greatest(a.i, b.i) AS sentence_id_b FROM same JOIN big a ON a.k = k1 JOIN big b ON b.k = k2
WHERE 10 * c >= 7 * (a.n + b.n - c) AND a.i <> b.i AND a.d <> b.d""",
    "p6_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM eval_passages WHERE item_text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
ew AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM e WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)""",
}
