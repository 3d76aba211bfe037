"""Queries of references without target rows."""

from __future__ import annotations

from marlstone.operators import orphans
from marlstone.session import table


def _all(spark, d):
    return orphans.filing_orphans(table(spark, d, "p3_gold_p3v3_new10"), table(spark, d, "v_sample_1m_core"), table(spark, d, "corpus_tagged"), table(spark, d, "sentence_removals"))


def p4_found(spark, d):
    return _all(spark, d).select("ref_table", "ref_key", "missing_id", "orphan_kind").distinct()


def p4_report(spark, d):
    return orphans.orphan_report(_all(spark, d))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}

_NORMAL = r"nullif(upper(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"
_ROWS = f"""
WITH gone AS (SELECT DISTINCT {_NORMAL.format('sentenceID')} AS k FROM sentence_removals),
core AS (SELECT {_NORMAL.format('sentenceID')} AS k, min(sample_created_at) AS t FROM v_sample_1m_core GROUP BY 1),
corpus AS (SELECT DISTINCT {_NORMAL.format('sentenceID')} AS k FROM corpus_tagged),
cited AS (SELECT DISTINCT question_id AS ref_key, created_at, {_NORMAL.format('e')} AS k FROM (SELECT question_id, created_at, unnest(evidence_sentence_ids) AS e FROM p3_gold_p3v3_new10)),
sampled AS (SELECT DISTINCT sentenceID AS ref_key, report_year, {_NORMAL.format('sentenceID')} AS k FROM v_sample_1m_core WHERE report_year BETWEEN 2006 AND 2020),
found AS (
SELECT 'p3_gold_p3v3_new10' AS ref_table, ref_key, c.k AS missing_id, CASE WHEN core.k IS NOT NULL THEN 'late' WHEN gone.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS orphan_kind,
  CAST(year(created_at) * 100 + month(created_at) AS INTEGER) AS period
FROM cited c LEFT JOIN core ON core.k = c.k LEFT JOIN gone ON gone.k = c.k WHERE c.k IS NOT NULL AND (core.k IS NULL OR core.t > c.created_at)
UNION SELECT 'v_sample_1m_core', ref_key, s.k, CASE WHEN gone.k IS NOT NULL THEN 'deleted' ELSE 'missing' END, report_year
FROM sampled s LEFT JOIN corpus ON corpus.k = s.k LEFT JOIN gone ON gone.k = s.k WHERE s.k IS NOT NULL AND corpus.k IS NULL)
"""
SQL = {
    "p4_found": _ROWS + "SELECT DISTINCT ref_table, ref_key, missing_id, orphan_kind FROM found",
    "p4_report": _ROWS + "SELECT ref_table, period, orphan_kind, count(*) AS n_references, count(DISTINCT missing_id) AS n_keys FROM found GROUP BY 1, 2, 3",
}
