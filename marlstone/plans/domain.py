"""Queries of the domain operators over the filing tables, the documents and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import dates
from marlstone.functions.text import position_of, prefix_of
from marlstone.operators import context, curation, evaluation, flags as fl, ingest, kpi, merge, mining, quality, sampling, vectors
from marlstone.operators import entities as ent
from marlstone.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- sampling -------------------------------------------------------------------------------------------------------

_BIN = "nullif(regexp_replace(lower(trim(temporal_bin)), '[\\s_-]+', '_', 'g'), '')"
_TAGGED = f"""tagged AS (SELECT sentenceID, min(cik_int) AS cik_int, min(section) AS section, min(report_year) AS report_year, min(b) AS b FROM (SELECT *, {_BIN} AS b FROM corpus_tagged WHERE report_year BETWEEN 2006 AND 2020 AND section IS NOT NULL) WHERE b IS NOT NULL AND sentenceID IS NOT NULL GROUP BY sentenceID)"""
_ALLOC = """p AS (SELECT sample_size_n AS n, priority_bin AS pb, older_bin2_weight AS w2, older_bin1_weight AS w1 FROM params),
pops AS (SELECT count(CASE WHEN b = (SELECT pb FROM p) THEN 1 END) AS p0, count(CASE WHEN b = 'bin_2010_2015' THEN 1 END) AS p1, count(CASE WHEN b = 'bin_2006_2009' THEN 1 END) AS p2 FROM tagged),
alloc AS (SELECT pb AS temporal_bin, p0 AS population, least(n, p0) AS target_n, CASE WHEN p0 >= n THEN 'MODERN_ONLY' ELSE 'MODERN_FULL_PLUS_OLDER' END AS allocation_mode FROM p, pops
UNION ALL SELECT 'bin_2010_2015', p1, CAST(floor(greatest(0, n - p0) * w2 + 0.5) AS BIGINT), CASE WHEN p0 >= n THEN 'MODERN_ONLY' ELSE 'MODERN_FULL_PLUS_OLDER' END FROM p, pops
UNION ALL SELECT 'bin_2006_2009', p2, CAST(floor(greatest(0, n - p0) * w1 + 0.5) AS BIGINT), CASE WHEN p0 >= n THEN 'MODERN_ONLY' ELSE 'MODERN_FULL_PLUS_OLDER' END FROM p, pops)"""
_IDS = """ranked AS (SELECT sentenceID, b, cik_int, report_year, section, population, target_n, row_number() OVER (PARTITION BY b, cik_int, report_year, section ORDER BY md5(concat(sentenceID, '42')), sentenceID) AS rn, count(*) OVER (PARTITION BY b, cik_int, report_year, section) AS stratum_size
FROM tagged JOIN alloc ON alloc.temporal_bin = b WHERE target_n > 0),
ids AS (SELECT sentenceID, b AS temporal_bin, cik_int, report_year, section, stratum_size, CASE WHEN target_n >= population THEN stratum_size ELSE greatest(1, CAST(floor(stratum_size * (CAST(target_n AS DOUBLE) / population) + 0.5) AS BIGINT)) END AS stratum_n, rn FROM ranked)"""


def _tagged(spark, d):
    c = sampling.gate(table(spark, d, "corpus_tagged")).withColumn("b", dates.normal_bin(F.col("temporal_bin"))).where("b is not null and sentenceID is not null")
    return c.groupBy("sentenceID").agg(F.min("cik_int").alias("cik_int"), F.min("section").alias("section"), F.min("report_year").alias("report_year"), F.min("b").alias("temporal_bin"))


def _allocation(spark, d, tagged):
    p = table(spark, d, "params").first()
    budget = sampling.Budget(p["sample_size_n"], p["priority_bin"], {"bin_2010_2015": p["older_bin2_weight"], "bin_2006_2009": p["older_bin1_weight"]})
    return sampling.allocate(sampling.populations(tagged), budget)


@query(f"WITH {_TAGGED}, {_ALLOC} SELECT temporal_bin, population, CAST(target_n AS BIGINT) AS target_n, allocation_mode FROM alloc")
def bin_allocation(spark, d):
    return _allocation(spark, d, _tagged(spark, d))


def _ids(spark, d):
    t = _tagged(spark, d)
    return sampling.stratified_ids(t, _allocation(spark, d, t), ["cik_int", "report_year", "section"], "sentenceID")


@query(f"WITH {_TAGGED}, {_ALLOC}, {_IDS} SELECT sentenceID, temporal_bin, cik_int, report_year, section, stratum_size, stratum_n FROM ids WHERE rn <= stratum_n")
def stratified_sample(spark, d):
    return _ids(spark, d)


@query(f"""WITH {_TAGGED}, {_ALLOC}, {_IDS}, s AS (SELECT sentenceID FROM ids WHERE rn <= stratum_n), dim AS (SELECT section_name, count(*) AS section_rows FROM v_sample_1m_core WHERE section_name IS NOT NULL GROUP BY 1)
SELECT c.sentenceID, c.docID, c.section_name, c.sentence, c.report_year, dim.section_rows, md5(concat(c.sentenceID, coalesce(c.sentence, ''))) AS row_hash FROM v_sample_1m_core c LEFT JOIN dim USING (section_name) WHERE c.sentenceID IN (SELECT sentenceID FROM s)""")
def stratified_sample_join_back(spark, d):
    core = table(spark, d, "v_sample_1m_core")
    dims = core.where("section_name is not null").groupBy("section_name").agg(F.count("*").alias("section_rows"))
    out = sampling.join_back(_ids(spark, d), core, "sentenceID", ["docID", "section_name", "sentence", "report_year"], dims, "section_name")
    return out.select("sentenceID", "docID", "section_name", "sentence", "report_year", "section_rows", sampling.row_hash(F.col("sentenceID"), F.col("sentence")).alias("row_hash"))


@query(f"WITH {_TAGGED}, {_ALLOC}, {_IDS}, s AS (SELECT temporal_bin, count(*) AS sampled FROM ids WHERE rn <= stratum_n GROUP BY 1) SELECT temporal_bin, population, CAST(target_n AS BIGINT) AS target_n, sampled, round(100.0 * sampled / population, 6) AS rate_pct FROM alloc JOIN s USING (temporal_bin)")
def sampling_rates(spark, d):
    t = _tagged(spark, d)
    a = _allocation(spark, d, t)
    s = sampling.stratified_ids(t, a, ["cik_int", "report_year", "section"], "sentenceID").groupBy("temporal_bin").agg(F.count("*").alias("sampled"))
    return a.join(s, "temporal_bin").select("temporal_bin", "population", "target_n", "sampled", F.round(F.lit(100.0).cast("double") * F.col("sampled") / F.col("population"), 6).alias("rate_pct"))


@query("SELECT sentenceID FROM (SELECT DISTINCT sentenceID FROM corpus_tagged WHERE sentenceID IS NOT NULL) ORDER BY md5(concat(sentenceID, '7')), sentenceID LIMIT 500")
def uniform_sample(spark, d):
    return sampling.uniform_sample(table(spark, d, "corpus_tagged").where("sentenceID is not null").select("sentenceID").distinct(), "sentenceID", 500, "7")


@query("SELECT sentenceID FROM (SELECT DISTINCT sentenceID FROM corpus_tagged WHERE sentenceID IS NOT NULL) WHERE CAST('0x' || substr(md5(sentenceID), 1, 8) AS BIGINT) % 100 < 14")
def hash_keep(spark, d):
    return sampling.keep_share(table(spark, d, "corpus_tagged").select("sentenceID").distinct(), "sentenceID", 14)


@query(f"""WITH {_TAGGED}, {_ALLOC}, {_IDS}, sm AS (SELECT * FROM ids WHERE rn <= stratum_n), m AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT sentenceID)::DOUBLE AS k, (count(*) - count(sentenceID))::DOUBLE AS nk, (SELECT sample_size_n FROM params) AS want FROM sm),
cov AS (SELECT 'V4_entity_coverage' AS check_name, (SELECT count(DISTINCT cik_int) FROM sm) AS a, (SELECT count(DISTINCT cik_int) FROM tagged) AS b UNION ALL SELECT 'V5_bin_coverage', (SELECT count(DISTINCT temporal_bin) FROM sm), (SELECT count(DISTINCT b) FROM tagged) UNION ALL SELECT 'V6_year_coverage', (SELECT count(DISTINCT report_year) FROM sm), (SELECT count(DISTINCT report_year) FROM tagged) UNION ALL SELECT 'V7_section_coverage', (SELECT count(DISTINCT section) FROM sm), (SELECT count(DISTINCT section) FROM tagged)),
i AS (SELECT max(c)::DOUBLE / min(c) AS x FROM (SELECT count(*) AS c FROM sm GROUP BY temporal_bin)), st AS (SELECT count(*)::DOUBLE AS x FROM sm WHERE sentenceID NOT IN (SELECT sentenceID FROM tagged)),
v AS (SELECT 'V1_size' AS check_name, n AS value, abs(n - want) <= 0.25 * want AS good FROM m UNION ALL SELECT 'V2_unique_keys', k, k = n FROM m UNION ALL SELECT 'V3_null_keys', nk, nk = 0 FROM m UNION ALL SELECT check_name, a * 100.0::DOUBLE / greatest(b, 1), a = b FROM cov UNION ALL SELECT 'V8_imbalance', x, x < 100 FROM i UNION ALL SELECT 'V9_stray_keys', x, x = 0 FROM st)
SELECT check_name, round(value, 6) AS value, CASE WHEN good THEN 'PASS' ELSE 'FAIL' END AS status FROM v""")
def sample_validation(spark, d):
    t = _tagged(spark, d)
    size = table(spark, d, "params").first()["sample_size_n"]
    return quality.validate_sample(_ids(spark, d), t, size, "sentenceID", "cik_int", "report_year", "section", "temporal_bin", tolerance=0.25).withColumn("value", F.round("value", 6))


# --- flags ----------------------------------------------------------------------------------------------------------

_B = lambda p: f"coalesce(regexp_matches(sentence, '\\b({p})\\b', 'i'), false)"
_FLAGS = f"""flagged AS (SELECT sentenceID, report_year, sentence, {_B(fl.KPI)} AS likely_kpi,
coalesce(regexp_matches(sentence, '\\(?\\$?\\d{{1,3}}(,\\d{{3}})*(\\.\\d+)?\\)?\\s*(million|billion|thousand|M|B|K|%|percent|bps|basis points)', 'i') OR regexp_matches(sentence, '\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?') OR regexp_matches(sentence, '\\$\\d+'), false) AS has_numbers,
coalesce(length(sentence) > 1000 OR regexp_matches(sentence, '(\\s{{2,}}|\\t)') OR regexp_matches(sentence, '(\\d+\\s+){{5,}}'), false) AS is_table_like,
{_B(fl.FORWARD)} AS has_forward_looking, {_B(fl.COMPARISON)} AS has_comparison, {_B(fl.MATERIAL)} AS is_material, coalesce(regexp_matches(sentence, '\\b({fl.YEAR})\\b'), false) AS mentions_years,
coalesce(report_year >= 2018, false) AS is_recent, {_B(fl.RISK)} AS has_risk_language, {_B(fl.SAFE_HARBOR)} AS is_safe_harbor FROM (SELECT DISTINCT sentenceID, report_year, sentence FROM v_sample_1m_core))"""
_NAMES = ["likely_kpi", "has_numbers", "is_table_like", "has_forward_looking", "has_comparison", "is_material", "mentions_years", "is_recent", "has_risk_language", "is_safe_harbor"]


def _flagged(spark, d):
    return fl.with_flags(table(spark, d, "v_sample_1m_core").select("sentenceID", "report_year", "sentence").distinct(), "sentence", "report_year")


@query(f"WITH {_FLAGS} SELECT sentenceID, {', '.join(_NAMES)} FROM flagged")
def feature_flags(spark, d):
    return _flagged(spark, d).select("sentenceID", *_NAMES)


@query(f"WITH {_FLAGS} SELECT sentenceID, CAST(3 * likely_kpi::INT + 2 * has_numbers::INT + 2 * has_comparison::INT + is_material::INT + has_forward_looking::INT + is_recent::INT - 2 * is_safe_harbor::INT AS INTEGER) AS retrieval_signal_score FROM flagged")
def signal_score(spark, d):
    return _flagged(spark, d).select("sentenceID", "retrieval_signal_score")


@query("""SELECT doc_id, coalesce(regexp_matches(lower(text), 'revenue|income|profit|loss|margin|earnings|cash|assets|debt|equity'), false) AS tag_kpi, coalesce(regexp_matches(text, '\\d'), false) AS tag_number,
coalesce(regexp_matches(lower(text), 'increase|decrease|compared|higher|lower|growth|decline|versus|change'), false) AS tag_comparison FROM documents""")
def light_tags(spark, d):
    tags = fl.light_tags(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in tags.items()))


# --- curation -------------------------------------------------------------------------------------------------------

_DIM = """dim AS (SELECT c.cik_int, max(CASE WHEN report_year IS NOT NULL AND name IS NOT NULL THEN {'y': report_year, 'n': name} END).n AS latest_name, count(*) AS n_rows, min(report_year) AS first_seen, max(report_year) AS last_seen, count(DISTINCT section_name) AS n_sections FROM v_sample_1m_core c WHERE cik_int IS NOT NULL GROUP BY 1),
codes AS (SELECT cik_int, list(DISTINCT t ORDER BY t) AS all_codes FROM (SELECT cik_int, unnest(tickers) AS t FROM v_sample_1m_core) WHERE t IS NOT NULL AND cik_int IS NOT NULL GROUP BY 1)"""


def _dimension(spark, d):
    return curation.entity_dimension(table(spark, d, "v_sample_1m_core"), "cik_int", "name", "report_year", "tickers", {"n_sections": F.count_distinct("section_name")})


@query(f"WITH {_DIM} SELECT dim.*, coalesce(all_codes, []) AS all_codes FROM dim LEFT JOIN codes USING (cik_int)")
def entity_dimension(spark, d):
    return _dimension(spark, d)


@query(f"""WITH {_DIM}, t AS (SELECT identifier, min(upper(trim(ticker))) AS ticker, min(company_name) AS company_name FROM spy_holdings_15oct WHERE ticker IS NOT NULL GROUP BY 1), k AS (SELECT t.*, (SELECT min(cik) FROM sec_company_tickers s WHERE upper(trim(s.company_name)) = upper(trim(t.company_name))) AS cik FROM t),
ex AS (SELECT cik_int, last_seen, unnest(all_codes) AS c FROM dim JOIN codes USING (cik_int)), pick AS (SELECT upper(trim(c)) AS c, arg_min(cik_int, struct_pack(a := -last_seen, b := cik_int)) AS cik_int FROM ex GROUP BY 1)
SELECT identifier, CASE WHEN d1.cik_int IS NOT NULL THEN d1.cik_int ELSE pick.cik_int END AS matched_key, CASE WHEN d1.cik_int IS NOT NULL THEN 1 WHEN pick.cik_int IS NOT NULL THEN 2 END AS match_tier FROM k LEFT JOIN dim d1 ON d1.cik_int = k.cik LEFT JOIN pick ON pick.c = k.ticker""")
def two_tier_match(spark, d):
    t = table(spark, d, "spy_holdings_15oct").where("ticker is not null").groupBy("identifier").agg(F.min(F.upper(F.trim("ticker"))).alias("ticker"), F.min("company_name").alias("company_name"))
    s = table(spark, d, "sec_company_tickers").groupBy(F.upper(F.trim("company_name")).alias("n")).agg(F.min("cik").alias("cik"))
    t = t.join(s, F.upper(F.trim("company_name")) == F.col("n"), "left").drop("n")
    return curation.two_tier_match(t, _dimension(spark, d), "cik", "ticker", "cik_int", "all_codes", "last_seen", "identifier").select("identifier", "matched_key", "match_tier")


@query("""SELECT p.i AS pattern_id, s.p_partkey, s.p_name FROM part s JOIN (VALUES (0, CAST(NULL AS BIGINT), 'RED'), (1, 17, 'ZZZ'), (2, NULL, 'small')) p(i, k, pat) ON s.p_partkey = p.k OR contains(upper(s.p_name), upper(p.pat))""")
def theta_search(spark, d):
    return curation.theta_search(table(spark, d, "part"), "p_name", [(None, "RED", None), (17, "ZZZ", None), (None, "small", None)], "p_partkey")


_SCORE = """g AS (SELECT cik_int, count(*) AS n_rows, count(DISTINCT report_year) AS n_years, count(DISTINCT section_name) AS n_sections, count(CASE WHEN report_year >= 2018 THEN 1 END) AS recent, count(CASE WHEN section_ID IN (1, 8, 10) THEN 1 END) AS priority_rows FROM v_sample_1m_core WHERE cik_int IS NOT NULL GROUP BY 1),
scored AS (SELECT *, n_years * CAST(5 AS DOUBLE) + n_sections * CAST(10 AS DOUBLE) + recent / CAST(100 AS DOUBLE) + priority_rows / CAST(50 AS DOUBLE) AS score FROM g WHERE n_years >= 2 AND n_sections >= 3)"""


def _scored(spark, d):
    c = table(spark, d, "v_sample_1m_core")
    # gates count named sections, the score's priority its numbers
    q = curation.quality_score(c.withColumn("section_key", F.col("section_name")), "cik_int", "report_year", "section_key", 2018, ("",), 2, 3)
    pr = c.where("cik_int is not null").groupBy("cik_int").agg(F.count_if(F.col("section_ID").isin(1, 8, 10)).alias("_p"))
    q = q.join(pr, "cik_int").withColumn("score", F.col("score") - F.col("priority_rows") / 50.0 + F.col("_p") / F.lit(50.0).cast("double")).withColumn("priority_rows", F.col("_p"))
    return q.drop("_p")


@query(f"WITH {_SCORE} SELECT cik_int, n_rows, n_years, n_sections, recent, priority_rows, round(score, 6) AS score, CASE WHEN score >= 200 THEN 'tier_1' WHEN score >= 150 THEN 'tier_2' ELSE 'tier_3' END AS tier FROM scored ORDER BY score DESC, cik_int LIMIT 25")
def quality_score_topk(spark, d):
    return _scored(spark, d).select("cik_int", "n_rows", "n_years", "n_sections", "recent", "priority_rows", F.round("score", 6).alias("score"), curation.tier(F.col("score"), [(200, "tier_1"), (150, "tier_2")], "tier_3").alias("tier")).orderBy(F.col("score").desc(), "cik_int").limit(25)


@query("""WITH a AS (SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS bal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10), b AS (SELECT 'supplier' AS source, s_suppkey AS id, s_acctbal AS bal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 5)
SELECT source, id, CAST(row_number() OVER (PARTITION BY source ORDER BY bal DESC, id) AS INTEGER) AS rank_within_group FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def topn_union_rank(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return curation.top_per_source([("customer", a, 10), ("supplier", b, 5)], F.col("bal"), "id")


@query("""WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rn FROM customer WHERE c_custkey NOT IN (1, 2))
SELECT c_mktsegment, c_custkey, CAST(rn AS INTEGER) AS rank_within_group FROM r WHERE (c_mktsegment = 'BUILDING' AND rn <= 4) OR (c_mktsegment = 'MACHINERY' AND rn <= 2) UNION ALL SELECT c_mktsegment, c_custkey, 0 FROM customer WHERE c_custkey IN (1, 2)""")
def topn_with_mandatory(spark, d):
    return curation.top_n_with_mandatory(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "c_custkey", {"BUILDING": 4, "MACHINERY": 2}, [1, 2])


@query(f"""WITH {_SCORE}, hand AS (SELECT DISTINCT cik AS cik_int FROM sec_company_tickers WHERE ticker LIKE 'A%'), ex AS (SELECT DISTINCT cik AS cik_int FROM sec_company_tickers WHERE ticker LIKE 'B%'),
auto AS (SELECT cik_int, score FROM scored WHERE cik_int NOT IN (SELECT cik_int FROM ex) ORDER BY score DESC, cik_int LIMIT 20)
SELECT cik_int, selection FROM (SELECT cik_int, 'picked' AS selection, CAST(NULL AS DOUBLE) AS score FROM hand UNION ALL SELECT cik_int, 'auto', score FROM auto WHERE cik_int NOT IN (SELECT cik_int FROM hand)) ORDER BY selection DESC, score DESC NULLS LAST, cik_int LIMIT 40""")
def candidate_pool(spark, d):
    s = table(spark, d, "sec_company_tickers").withColumnRenamed("cik", "cik_int")
    return curation.candidate_pool(_scored(spark, d), "cik_int", 20, s.where("ticker like 'B%'"), s.where("ticker like 'A%'"), 40)


@query("""WITH g AS (SELECT section_ID, count(*) AS n_rows, avg(CAST(regexp_matches(sentence, '(?i)may|risk') AS INT)) AS r1, avg(CAST(regexp_matches(sentence, '(?i)management') AS INT)) AS r2, avg(CAST(regexp_matches(sentence, '\\$\\d') AS INT)) AS r3 FROM v_sample_1m_core WHERE section_ID IS NOT NULL AND sentence IS NOT NULL GROUP BY 1)
SELECT section_ID, n_rows, round(r1, 6) AS rate_risk, round(r2, 6) AS rate_mdna, round(r3, 6) AS rate_amount, CASE WHEN greatest(r1, r2, r3) = 0 THEN NULL WHEN r1 = greatest(r1, r2, r3) THEN 'risk' WHEN r2 = greatest(r1, r2, r3) THEN 'mdna' ELSE 'amount' END AS best_label FROM g""")
def section_keyword_rates(spark, d):
    r = curation.section_keyword_rates(table(spark, d, "v_sample_1m_core"), "section_ID", "sentence", {"risk": "(?i)may|risk", "mdna": "(?i)management", "amount": r"\$\d"})
    return r.select("section_ID", "n_rows", *(F.round(f"rate_{n}", 6).alias(f"rate_{n}") for n in ("risk", "mdna", "amount")), "best_label")


@query("SELECT sentenceID, report_year FROM v_sample_1m_core WHERE cik_int IN (SELECT cik FROM sec_company_tickers WHERE ticker < 'M') AND report_year BETWEEN 2016 AND 2020")
def subset_modern(spark, d):
    e = table(spark, d, "sec_company_tickers").where("ticker < 'M'").select(F.col("cik").alias("cik_int"))
    return curation.subset(table(spark, d, "v_sample_1m_core"), e, "cik_int", "MODERN_ONLY").select("sentenceID", "report_year")


@query("""WITH b AS (SELECT docID, sentenceID FROM v_sample_1m_core WHERE load_method <> 'late_backfill'), n AS (SELECT docID, sentenceID FROM v_sample_1m_core WHERE load_method = 'late_backfill'), t AS (SELECT count(*) AS n FROM b), i AS (SELECT count(*) AS n FROM n)
SELECT 'delete_by_group' AS strategy, count(*) AS deleted, (SELECT n FROM i) AS inserted, count(CASE WHEN sentenceID NOT IN (SELECT sentenceID FROM n) THEN 1 END) AS lost, round(count(CASE WHEN sentenceID NOT IN (SELECT sentenceID FROM n) THEN 1 END) * 100.0 / (SELECT n FROM t), 6) AS lost_pct FROM b WHERE docID IN (SELECT docID FROM n)
UNION ALL SELECT 'delete_by_key', count(*), (SELECT n FROM i), count(CASE WHEN sentenceID NOT IN (SELECT sentenceID FROM n) THEN 1 END), round(count(CASE WHEN sentenceID NOT IN (SELECT sentenceID FROM n) THEN 1 END) * 100.0 / (SELECT n FROM t), 6) FROM b WHERE sentenceID IN (SELECT sentenceID FROM n)""")
def upsert_simulation(spark, d):
    c = table(spark, d, "v_sample_1m_core")
    return curation.upsert_simulation(c.where("load_method <> 'late_backfill'"), c.where("load_method = 'late_backfill'"), "docID", "sentenceID").withColumn("lost_pct", F.round("lost_pct", 6))


# --- merging --------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT event_id, user_id, value FROM events WHERE event_id % 3 <> 0), n AS (SELECT event_id, user_id, value * 2 AS value FROM events WHERE event_id % 2 = 0) SELECT * FROM n UNION ALL SELECT * FROM b WHERE event_id NOT IN (SELECT event_id FROM n)""")
def upsert_merge(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    return merge.upsert(e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0").withColumn("value", F.col("value") * 2), ["event_id"])


@query("""SELECT sentenceID, sample_created_at, docID, load_method FROM (SELECT *, row_number() OVER (PARTITION BY sentenceID ORDER BY sample_created_at DESC NULLS LAST, last_modified_date DESC NULLS LAST, row_hash DESC NULLS LAST) AS rn FROM v_sample_1m_core) WHERE rn = 1""")
def dedupe_keep_last(spark, d):
    c = table(spark, d, "v_sample_1m_core").select("sentenceID", "sample_created_at", "docID", "load_method", "last_modified_date", "row_hash")
    return merge.dedupe_last(c, ["sentenceID"], [F.col(x).desc_nulls_last() for x in ("sample_created_at", "last_modified_date", "row_hash")]).select("sentenceID", "sample_created_at", "docID", "load_method")


@query("""WITH b AS (SELECT DISTINCT sentenceID FROM v_sample_1m_core WHERE load_method = 'stratified_sampling'), n AS (SELECT DISTINCT sentenceID FROM v_sample_1m_core WHERE load_method <> 'stratified_sampling'), nb AS (SELECT count(*) AS c FROM v_sample_1m_core WHERE load_method = 'stratified_sampling'), nn AS (SELECT count(*) AS c FROM v_sample_1m_core WHERE load_method <> 'stratified_sampling'), m AS (SELECT count(*) AS c FROM (SELECT * FROM b UNION SELECT * FROM n))
SELECT nb.c AS base_rows, nn.c AS increment_rows, m.c AS merged_rows, (SELECT count(*) FROM n) AS from_increment, nb.c + nn.c - m.c AS duplicates_removed FROM nb, nn, m""")
def incremental_merge_stats(spark, d):
    c = table(spark, d, "v_sample_1m_core").select("sentenceID", "sample_created_at", "row_hash", "load_method")
    return merge.incremental_merge(c.where("load_method = 'stratified_sampling'"), c.where("load_method <> 'stratified_sampling'"), ["sentenceID"], ["sample_created_at", "row_hash"], checks=False)[1]


@query("""WITH n AS (SELECT cik_int, max(name) AS m FROM v_sample_1m_core WHERE cik_int IS NOT NULL GROUP BY 1) SELECT sentenceID, row_hash, coalesce(c.name, n.m) AS name FROM v_sample_1m_core c LEFT JOIN n USING (cik_int)""")
def update_from_fill(spark, d):
    c = table(spark, d, "v_sample_1m_core").select("sentenceID", "row_hash", "cik_int", "name")
    return merge.fill_from(c, c.select("cik_int", "name"), "cik_int", ["name"]).select("sentenceID", "row_hash", "name")


@query("SELECT sentenceID, sample_created_at FROM v_sample_1m_core WHERE sentenceID NOT IN (SELECT sentenceID FROM sentence_removals WHERE sentenceID IS NOT NULL)")
def delete_removed(spark, d):
    return merge.delete_ids(table(spark, d, "v_sample_1m_core"), table(spark, d, "sentence_removals"), "sentenceID").select("sentenceID", "sample_created_at")


@query("SELECT trim(sentence) AS sentence, cik_int, section_ID, min(sentenceID) AS sentenceID FROM v_sample_1m_core WHERE length(trim(sentence)) >= 10 GROUP BY 1, 2, 3")
def clean_and_dedupe(spark, d):
    c = table(spark, d, "v_sample_1m_core").select("sentence", "cik_int", "section_ID", "sentenceID")
    return merge.clean_and_dedupe(c, "sentence", ["cik_int", "section_ID"], 10)


# --- quality --------------------------------------------------------------------------------------------------------


@query("""SELECT column_name, n_rows, n_null, round(100.0 * n_null / n_rows, 6) AS null_pct, n_unique, round(100.0 * n_unique / n_rows, 6) AS unique_pct, min_value, max_value FROM (
SELECT 'c_custkey' AS column_name, count(*) AS n_rows, count(*) - count(c_custkey) AS n_null, count(DISTINCT c_custkey) AS n_unique, CAST(min(c_custkey) AS VARCHAR) AS min_value, CAST(max(c_custkey) AS VARCHAR) AS max_value FROM customer
UNION ALL SELECT 'c_name', count(*), count(*) - count(c_name), count(DISTINCT c_name), min(c_name), max(c_name) FROM customer
UNION ALL SELECT 'c_nationkey', count(*), count(*) - count(c_nationkey), count(DISTINCT c_nationkey), CAST(min(c_nationkey) AS VARCHAR), CAST(max(c_nationkey) AS VARCHAR) FROM customer)""")
def column_profile(spark, d):
    return quality.profile(table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"]).withColumns({c: F.round(c, 6) for c in ("null_pct", "unique_pct")})


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value ASC NULLS LAST LIMIT 10")
def value_counts(spark, d):
    return quality.value_counts(table(spark, d, "documents"), "source")


@query("""WITH m AS (SELECT count(*) AS n, count(*) - count(cik_int) AS a, count(*) - count(sentence) AS b, count(sentenceID) - count(DISTINCT sentenceID) AS dup, count(CASE WHEN report_year NOT BETWEEN 2000 AND 2030 THEN 1 END) AS y, count(row_hash) - count(DISTINCT row_hash) AS h FROM v_sample_1m_core),
r AS (SELECT 'null_rate_cik_int' AS check_name, CAST(a AS DOUBLE) / n AS value, CAST(a AS DOUBLE) / n <= 0.1 AS passed FROM m UNION ALL SELECT 'null_rate_sentence', CAST(b AS DOUBLE) / n, CAST(b AS DOUBLE) / n <= 0.1 FROM m UNION ALL SELECT 'unique_key', CAST(dup AS DOUBLE), dup = 0 FROM m UNION ALL SELECT 'year_bounds', CAST(y AS DOUBLE), y = 0 FROM m UNION ALL SELECT 'unique_hash', CAST(h AS DOUBLE), h = 0 FROM m UNION ALL SELECT 'boolean_likely_kpi', CAST(0 AS DOUBLE), true FROM m)
SELECT check_name, round(value, 6) AS value, passed FROM r UNION ALL SELECT 'quality_score', round(sum(passed::INT) * 100.0 / count(*), 6), bool_and(passed) FROM r""")
def dq_score(spark, d):
    return quality.quality_score(table(spark, d, "v_sample_1m_core"), ["cik_int", "sentence"], "sentenceID", "report_year", (2000, 2030), "row_hash", ["likely_kpi"]).withColumn("value", F.round("value", 6))


@query("""SELECT 'not_null' AS expectation, 'sentenceID' AS column_name, count(*) - count(sentenceID) AS violations, count(*) = count(sentenceID) AS passed FROM v_sample_1m_core UNION ALL SELECT 'between', 'report_year', count(CASE WHEN report_year NOT BETWEEN 2006 AND 2020 THEN 1 END), count(CASE WHEN report_year NOT BETWEEN 2006 AND 2020 THEN 1 END) = 0 FROM v_sample_1m_core
UNION ALL SELECT 'in_set', 'form', count(CASE WHEN form NOT IN ('10-K') THEN 1 END), count(CASE WHEN form NOT IN ('10-K') THEN 1 END) = 0 FROM v_sample_1m_core UNION ALL SELECT 'unique', 'sentenceID', count(sentenceID) - count(DISTINCT sentenceID), count(sentenceID) = count(DISTINCT sentenceID) FROM v_sample_1m_core
UNION ALL SELECT 'length', 'sentence', count(CASE WHEN length(sentence) NOT BETWEEN 10 AND 10000 THEN 1 END), count(CASE WHEN length(sentence) NOT BETWEEN 10 AND 10000 THEN 1 END) = 0 FROM v_sample_1m_core UNION ALL SELECT 'column_count', NULL, 0, true UNION ALL SELECT 'exists', 'no_such', 1, false""")
def expectation_suite(spark, d):
    E = quality.Expectation
    return quality.check_expectations(table(spark, d, "v_sample_1m_core"), [E("not_null", "sentenceID"), E("between", "report_year", (2006, 2020)), E("in_set", "form", ("10-K",)), E("unique", "sentenceID"), E("length", "sentence", (10, 10000)), E("column_count", None, (24,)), E("exists", "no_such")])


@query("""WITH have AS (SELECT column_name FROM (DESCRIBE SELECT * FROM v_sample_1m_core)), w(column_name, phase) AS (VALUES ('cik', 'strict'), ('sentenceID', 'strict'), ('sentence', 'strict'), ('section_item', 'strict'), ('likely_kpi', 'derived'), ('row_hash', 'derived'))
SELECT column_name, phase, CASE WHEN column_name IN (SELECT column_name FROM have) THEN 'present' ELSE 'missing' END AS status FROM w UNION ALL SELECT column_name, 'extra', 'unexpected' FROM have WHERE column_name NOT IN (SELECT column_name FROM w)""")
def schema_contract(spark, d):
    return quality.contract(table(spark, d, "v_sample_1m_core"), ["cik", "sentenceID", "sentence", "section_item"], ["likely_kpi", "row_hash"])


@query("""SELECT CASE WHEN sentenceID IS NULL THEN 'null' WHEN NOT regexp_matches(sentenceID, '^(\\d{10})_(10-[KQ]|8-K)_(\\d{4})_section_(\\w+)_(\\d+)$') THEN 'no_match' WHEN docID IS NULL OR NOT starts_with(sentenceID, docID || '_') THEN 'other_document' ELSE 'ok' END AS status, count(*) AS n FROM v_sample_1m_core GROUP BY 1""")
def id_pattern_check(spark, d):
    return quality.id_pattern_check(table(spark, d, "v_sample_1m_core"), "sentenceID", "docID")


@query("""WITH p AS (SELECT DISTINCT docID, TRY_CAST(string_split(sentenceID, '_')[-1] AS SMALLINT)::INT AS p FROM v_sample_1m_core WHERE docID IS NOT NULL) SELECT docID, count(*) AS n, min(p) AS first_pos, max(p) AS last_pos, CAST(max(p) - min(p) + 1 - count(*) AS BIGINT) AS missing FROM p WHERE p >= 0 GROUP BY 1""")
def contiguity(spark, d):
    return quality.contiguity(table(spark, d, "v_sample_1m_core"), "docID", position_of(F.col("sentenceID")))


# --- metrics --------------------------------------------------------------------------------------------------------

_YEARLY = "f AS (SELECT c_mktsegment AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"


def _yearly(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("entity"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("value"))


@query(f"""WITH {_YEARLY}, t AS (SELECT entity, min(year) AS first_year, max(year) AS last_year, arg_min(value, year) AS first_value, arg_max(value, year) AS last_value FROM f GROUP BY 1)
SELECT entity, first_year, last_year, round(first_value, 2) AS first_value, round(last_value, 2) AS last_value, round(last_value - first_value, 2) AS change, round((last_value - first_value) * 100 / first_value, 6) AS change_pct, round((pow(last_value / first_value, 1.0::DOUBLE / (last_year - first_year)) - 1) * 100, 6) AS cagr_pct,
CASE WHEN (last_value - first_value) * 100 / first_value > 5 THEN 'Strong Growth' WHEN (last_value - first_value) * 100 / first_value > 0 THEN 'Moderate Growth' WHEN (last_value - first_value) * 100 / first_value > -5 THEN 'Slight Decline' ELSE 'Significant Decline' END AS direction FROM t WHERE last_year > first_year""")
def trend_cagr(spark, d):
    t = kpi.trend(_yearly(spark, d), ["entity"], "year", "value")
    return t.withColumns({c: F.round(c, n) for c, n in (("first_value", 2), ("last_value", 2), ("change", 2), ("change_pct", 6), ("cagr_pct", 6))})


@query(f"WITH {_YEARLY}, l AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY year) AS previous FROM f) SELECT entity, year, round(value, 2) AS value, round(previous, 2) AS previous, round((value - previous) * 100 / previous, 6) AS yoy_pct FROM l WHERE previous > 0")
def yoy(spark, d):
    return kpi.yoy(_yearly(spark, d), ["entity"], "year", "value").withColumns({"value": F.round("value", 2), "previous": F.round("previous", 2), "yoy_pct": F.round("yoy_pct", 6)})


@query(f"""WITH {_YEARLY}, g AS (SELECT e.entity, y.year FROM (VALUES ('BUILDING'), ('MACHINERY'), ('NOBODY')) e(entity) CROSS JOIN (SELECT CAST(unnest(range(1994, 1998)) AS INTEGER) AS year) y), j AS (SELECT g.*, x.value, x.i FROM g LEFT JOIN (SELECT *, 1 AS i FROM f) x USING (entity, year))
SELECT count(*) AS total, count(i) AS in_db, count(value) AS found, count(CASE WHEN i = 1 AND value IS NULL THEN 1 END) AS nan, count(*) - count(i) AS not_in_db, round(count(value) * 100.0 / count(*), 6) AS found_pct FROM j""")
def kpi_grid_coverage(spark, d):
    g = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("NOBODY",)], "entity string").crossJoin(spark.range(1994, 1998).select(F.col("id").cast("int").alias("year")))
    return kpi.lookup_stats(kpi.lookup(g, _yearly(spark, d), ["entity", "year"], "value")).withColumn("found_pct", F.round("found_pct", 6))


def _statement(spark, d):
    """Statement lines made of yearly totals by status and priority, one label a figure and segment."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    of = lambda by, x: F.sum(F.when(F.col(by) == x, F.col("o_totalprice")))
    lines = {
        "Total revenues and other income": F.sum("o_totalprice"), "Net Income": of("o_orderpriority", "1-URGENT"), "Total Assets": F.sum("o_totalprice") * 2, "Liabilities": of("o_orderstatus", "F"), "Total equity": of("o_orderstatus", "O"),
        "AssetsCurrent": of("o_orderpriority", "2-HIGH"), "LiabilitiesCurrent": of("o_orderpriority", "3-MEDIUM"), "Inventory": of("o_orderstatus", "P") * 0.125, "Gross Profit": of("o_orderpriority", "4-NOT SPECIFIED"), "Selling, General and Administrative Expense": of("o_orderpriority", "5-LOW") * 0.5,
        "Research and Development Expense": of("o_orderstatus", "P") * 0.25, "Net Cash from Operating Activities": of("o_orderpriority", "1-URGENT") * 0.75, "Capital Expenditures": -of("o_orderpriority", "5-LOW") * 0.1,
    }
    y = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("entity"), F.year("o_orderdate").alias("year")).agg(*(x.alias(f"x{i}") for i, x in enumerate(lines.values())))
    return y.select("entity", "year", F.inline(F.array(*(F.struct(F.lit(k).alias("label"), F.col(f"x{i}").alias("amount")) for i, k in enumerate(lines)))))


_RATIOS = """st AS (SELECT c_mktsegment AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS t, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS u, sum(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS h, sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END) AS m, sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_totalprice END) AS n,
sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS l, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS q FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
pv AS (SELECT *, lag(t) OVER (PARTITION BY entity ORDER BY year) AS t0, lag(o) OVER (PARTITION BY entity ORDER BY year) AS o0 FROM st),
ratios AS (SELECT entity, year, m.k AS metric, m.v AS value FROM pv, LATERAL (VALUES ('Net Profit Margin %', u / nullif(t, 0) * 100), ('Operating Margin %', (n - l * 0.5 - q * 0.25) / nullif(t, 0) * 100), ('ROA % (Avg Assets)', u / nullif((t * 2 + t0 * 2) / 2, 0) * 100), ('ROE % (Avg Equity)', u / nullif((o + o0) / 2, 0) * 100), ('Current Ratio', h / nullif(m, 0)), ('Quick Ratio', (h - q * 0.125) / nullif(m, 0)), ('Debt-to-Equity', f / nullif(o, 0)), ('Debt-to-Assets', f / nullif(t * 2, 0)), ('Free Cash Flow', u * 0.75 - l * 0.1), ('Operating Cash Flow Ratio', u * 0.75 / nullif(m, 0))) m(k, v) WHERE m.v IS NOT NULL)"""


@query(f"WITH {_RATIOS} SELECT entity, year, metric, round(value, 4) AS value FROM ratios")
def kpi_ratios(spark, d):
    f = kpi.pick_by_alias(_statement(spark, d), "entity", "year", "label", "amount")
    return kpi.derive(f, "entity", "year").withColumn("value", F.round("value", 4))


@query(f"""WITH {_YEARLY}, g AS (SELECT e.entity, y.year, m.metric FROM (SELECT DISTINCT entity FROM f) e CROSS JOIN (VALUES (1994), (1995), (1996)) y(year) CROSS JOIN (VALUES ('sales'), ('returns')) m(metric)), h AS (SELECT entity, year, 'sales' AS metric FROM f)
SELECT g.entity, g.year, count(*) AS n_metrics, count(h.metric) AS n_present, coalesce(string_agg(CASE WHEN h.metric IS NULL THEN g.metric END, ', ' ORDER BY g.metric), '') AS missing FROM g LEFT JOIN h ON h.entity = g.entity AND h.year = g.year AND h.metric = g.metric GROUP BY 1, 2""")
def coverage_report(spark, d):
    y = _yearly(spark, d)
    return kpi.coverage(y.withColumn("metric", F.lit("sales")), y, spark.createDataFrame([(1994,), (1995,), (1996,)], "year int"), spark.createDataFrame([("sales",), ("returns",)], "metric string"), "entity", "year", "metric")


@query("""SELECT o_custkey, y, o_orderkey FROM (SELECT o_custkey, year(o_orderdate)::INT AS y, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_filed(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return kpi.latest_filed(o, ["o_custkey", "y"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "y", "o_orderkey")


@query(f"""WITH {_RATIOS}, shown AS (SELECT *, CASE WHEN contains(metric, '%') THEN printf('%.1f%%', value) WHEN regexp_matches(metric, '(?i)ratio|debt-to|quick|current') THEN printf('%.2f', value + 1e-9) ELSE CASE WHEN value < 0 THEN '-' ELSE '' END || '$' || CASE WHEN abs(value) >= 1e9 THEN printf('%.1fB', abs(value) / 1e9) WHEN abs(value) >= 1e6 THEN printf('%.1fM', abs(value) / 1e6) WHEN abs(value) >= 1e3 THEN printf('%.1fK', abs(value) / 1e3) ELSE printf('%.2f', abs(value)) END END AS x FROM ratios)
SELECT entity, string_agg(metric || ' ' || year || ': ' || x, chr(10) ORDER BY metric, year) AS block FROM shown GROUP BY 1""")
def kpi_block(spark, d):
    f = kpi.derive(kpi.pick_by_alias(_statement(spark, d), "entity", "year", "label", "amount"), "entity", "year")
    return kpi.kpi_lines(f, "entity", "year", "metric", "value")


# --- vectors --------------------------------------------------------------------------------------------------------


def _queries(e):
    """Every vector whose id is divisible by 20 asks."""
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("q_label"))


_COS = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.query_id, e.vec_id AS id, 1 - list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])) AS distance, e.label = q.label AS same FROM q CROSS JOIN embeddings e)"""


@query(f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rk FROM s) SELECT query_id, id, CAST(rk AS INTEGER) AS rank, round(distance, 6) AS distance FROM r WHERE rk BETWEEN 2 AND 10")
def cosine_topk_global(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k(e, _queries(e), 10).where("rank >= 2").select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


@query(f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rk FROM s WHERE same) SELECT query_id, id, CAST(rk AS INTEGER) AS rank, round(distance, 6) AS distance FROM r WHERE rk BETWEEN 2 AND 10")
def cosine_topk_filtered(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k(e, _queries(e), 10, same=("label", "q_label")).where("rank >= 2").select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


_HITS = f"""{_COS}, h AS (SELECT query_id, id, distance, 'filtered' AS source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rk FROM s WHERE same) WHERE rk <= 30 UNION ALL SELECT query_id, id, distance, 'global' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rk FROM s) WHERE rk <= 30),
dd AS (SELECT query_id, id, min(distance) AS distance, list(DISTINCT source ORDER BY source) AS sources FROM h GROUP BY 1, 2)"""


def _hits(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.dedupe_hits(vectors.retrieve(e, _queries(e), 30, 30, ("label", "q_label"), least_similarity=-1.0), ["query_id", "id"])


@query(f"WITH {_HITS} SELECT query_id, id, round(distance, 6) AS distance, sources FROM dd WHERE query_id <> id")
def hit_dedupe(spark, d):
    return _hits(spark, d).where("query_id <> id").select("query_id", "id", F.round("distance", 6).alias("distance"), "sources")


@query(f"""WITH {_HITS}, x AS (SELECT *, CASE WHEN list_contains(sources, 'filtered') THEN 'filtered' ELSE 'global' END AS ps FROM dd), y AS (SELECT *, row_number() OVER (PARTITION BY query_id, ps ORDER BY distance, id) AS rn, count(CASE WHEN ps = 'filtered' THEN 1 END) OVER (PARTITION BY query_id) AS f, count(CASE WHEN ps = 'global' THEN 1 END) OVER (PARTITION BY query_id) AS g FROM x),
z AS (SELECT *, 30 - least(f, 22) - least(g, 7) AS l FROM y) SELECT query_id, id, ps AS primary_source, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS final_rank FROM z WHERE CASE WHEN ps = 'filtered' THEN rn <= 22 + CASE WHEN f > 22 THEN l ELSE 0 END ELSE rn <= 7 + CASE WHEN f > 22 THEN 0 ELSE l END END""")
def proportional_topk(spark, d):
    return vectors.proportional(_hits(spark, d), "query_id", 30).select("query_id", "id", "primary_source", F.round("distance", 6).alias("distance"), "final_rank")


@query(f"""WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rk FROM s), o AS (SELECT query_id, rk FROM r WHERE id = query_id AND rk <= 21), w AS (SELECT query_id, same, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS rr FROM r WHERE id <> query_id AND rk <= 21), f AS (SELECT query_id, min(rr) AS fh FROM w WHERE same GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN o.rk = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS self_at_1, round(avg(CASE WHEN fh <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN fh <= 1 THEN 1.0::DOUBLE / fh ELSE 0 END), 6) AS mrr_at_1, round(avg(CASE WHEN fh <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_3, round(avg(CASE WHEN fh <= 3 THEN 1.0::DOUBLE / fh ELSE 0 END), 6) AS mrr_at_3, round(avg(CASE WHEN fh <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_5, round(avg(CASE WHEN fh <= 5 THEN 1.0::DOUBLE / fh ELSE 0 END), 6) AS mrr_at_5 FROM q LEFT JOIN o USING (query_id) LEFT JOIN f USING (query_id)""")
def retrieval_eval(spark, d):
    e = table(spark, d, "embeddings")
    q = _queries(e)
    gold = q.select("query_id", F.col("q_label").alias("label")).join(e.select(F.col("vec_id").alias("id"), "label"), "label").select("query_id", "id")
    r = evaluation.evaluate_retrieval(e, q, gold, 20)
    return r.select("n", *(F.round(c, 6).alias(c) for c in r.columns if c != "n"))


@query("SELECT label, count(*) AS n, min(len(embedding))::INT AS min_dims, max(len(embedding))::INT AS max_dims, CAST(avg(len(embedding)) AS DOUBLE) AS avg_dims FROM embeddings GROUP BY 1")
def embedding_audit(spark, d):
    return vectors.run_summary(table(spark, d, "embeddings"), "label", "embedding")


@query("""WITH m AS (SELECT doc_id AS k, source AS lin FROM documents), v AS (SELECT vec_id AS k, count(*) AS n FROM embeddings GROUP BY 1), j AS (SELECT m.k AS a, v.k AS b, m.lin, v.n FROM m FULL OUTER JOIN v ON m.k = v.k)
SELECT 'missing_in_meta' AS issue, count(CASE WHEN a IS NULL THEN 1 END) AS n FROM j UNION ALL SELECT 'missing_vector', count(CASE WHEN n IS NULL THEN 1 END) FROM j UNION ALL SELECT 'duplicate_vectors', count(CASE WHEN n > 1 THEN 1 END) FROM j UNION ALL SELECT 'null_lineage', count(CASE WHEN a IS NOT NULL AND lin IS NULL THEN 1 END) FROM j UNION ALL SELECT 'stale', CAST(0 AS BIGINT)""")
def parity_audit(spark, d):
    m = table(spark, d, "documents").select(F.col("doc_id").alias("k"), "source")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.lit(None).cast("string").alias("source"), F.size("embedding").alias("dims"))
    return vectors.parity(m, v, "k", "source", "dims")


@query("""SELECT report_year, count(*) AS total, count(vec_id) AS embedded, round((count(*) - count(vec_id)) * 100.0 / count(*), 6) AS gap_pct FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = doc_id GROUP BY 1 HAVING (count(*) - count(vec_id)) * 100.0 / count(*) >= 40""")
def embedding_gaps(spark, d):
    g = vectors.gaps(table(spark, d, "documents").select("doc_id", "report_year"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", ["report_year"], 40.0)
    return g.withColumn("gap_pct", F.round("gap_pct", 6))


@query("SELECT count(*) AS n_rows, count(CASE WHEN len(embedding) <> 64 THEN 1 END) AS wrong_dims, count(DISTINCT doc_id) - count(DISTINCT hash(doc_id)) AS collisions FROM documents JOIN embeddings ON vec_id = doc_id")
def stage_build(spark, d):
    return vectors.build_stage(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "embedding", 64)[1]


@query("SELECT sentenceID, row_hash FROM v_sample_1m_core WHERE report_year >= 2015 AND (section_name = 'ITEM_7' OR section_name = 'ITEM_1A')")
def filter_grammar(spark, d):
    spec = {"$and": [vectors.global_filter(2015), vectors.question_filter(sections=["ITEM_7", "ITEM_1A"])]}
    return table(spark, d, "v_sample_1m_core").where(vectors.compile_filter(spec, ["report_year", "section_name", "cik_int"])).select("sentenceID", "row_hash")


@query("""WITH RECURSIVE x AS (SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n, doc_id // 500 AS g FROM documents), s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) AS i FROM x WHERE n <= 15000),
r AS (SELECT g, i, n, 0 AS b, 1 AS c, n AS t FROM s WHERE i = 1 UNION ALL SELECT s.g, s.i, s.n, CASE WHEN r.c >= 96 OR r.t + s.n > 15000 THEN r.b + 1 ELSE r.b END, CASE WHEN r.c >= 96 OR r.t + s.n > 15000 THEN 1 ELSE r.c + 1 END, CASE WHEN r.c >= 96 OR r.t + s.n > 15000 THEN s.n ELSE r.t + s.n END FROM r JOIN s ON s.g = r.g AND s.i = r.i + 1)
SELECT g || '-' || b AS batch, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS tokens FROM r GROUP BY g, b UNION ALL SELECT NULL, count(*), CAST(sum(n) AS BIGINT) FROM x WHERE n > 15000 HAVING count(*) > 0""")
def token_batches(spark, d):
    t = table(spark, d, "documents").withColumn("n", F.length("text"))
    return vectors.greedy_batches(t, "doc_id", "n", 96, 15_000, group=F.floor(F.col("doc_id") / 500)).groupBy("batch").agg(F.count("*").alias("n_rows"), F.sum("tokens").alias("tokens"))


# --- neighbours -----------------------------------------------------------------------------------------------------

_POS = "c AS (SELECT sentenceID, min(docID) AS docID, min(sentence) AS sentence, regexp_replace(sentenceID, '_[^_]*$', '') AS pre, coalesce(TRY_CAST(string_split(sentenceID, '_')[-1] AS SMALLINT), -1)::INT AS pos FROM v_sample_1m_core GROUP BY sentenceID)"


def _positions(spark, d):
    c = table(spark, d, "v_sample_1m_core").groupBy("sentenceID").agg(F.min("docID").alias("docID"), F.min("sentence").alias("sentence"))
    return c.select("sentenceID", "docID", "sentence", prefix_of(F.col("sentenceID")).alias("pre"), position_of(F.col("sentenceID")).cast("int").alias("pos"))


@query(f"WITH {_POS} SELECT sentenceID, lag(sentenceID) OVER (PARTITION BY pre ORDER BY pos, sentenceID) AS prev_id, lead(sentenceID) OVER (PARTITION BY pre ORDER BY pos, sentenceID) AS next_id, CAST(length(sentence) AS INTEGER) AS char_length, count(*) OVER (PARTITION BY pre) AS section_count FROM c")
def prev_next_links(spark, d):
    c = _positions(spark, d).select("sentenceID", "sentence")
    return context.enrich(c, "sentenceID", "sentence").select("sentenceID", "prev_id", "next_id", "char_length", "section_count")


@query(f"WITH {_POS}, h AS (SELECT * FROM c) SELECT h.sentenceID AS hit, c.sentenceID AS sentenceID, c.pos = h.pos AS is_core FROM h JOIN c ON c.pre = h.pre AND c.pos BETWEEN greatest(0, h.pos - 3) AND h.pos + 3")
def window_expand(spark, d):
    c = _positions(spark, d)
    h = c.select(F.col("sentenceID").alias("hit"), "pre", "pos")
    return context.expand(h, c, ["pre"], "pos", 3, keep=["sentenceID"]).select("hit", "sentenceID", "is_core")


@query(f"""WITH {_POS}, h AS (SELECT *, CASE WHEN length(sentence) > 120 THEN 'filtered' ELSE 'global' END AS source, CASE WHEN length(sentence) > 120 THEN 0 ELSE 1 END AS variant FROM c) SELECT c.sentenceID, bool_or(c.pos = h.pos) AS is_core, min(abs(c.pos - h.pos)) AS distance, list(DISTINCT source ORDER BY source) AS sources, list(DISTINCT variant ORDER BY variant) AS variant_ids, min(c.docID) AS docID
FROM h JOIN c ON c.pre = h.pre AND c.pos BETWEEN greatest(0, h.pos - 3) AND h.pos + 3 GROUP BY 1""")
def sentence_dedupe(spark, d):
    c = _positions(spark, d)
    long = F.coalesce(F.length("sentence") > 120, F.lit(False))
    h = c.select("pre", "pos", F.array(F.when(long, "filtered").otherwise("global")).alias("sources"), F.array(F.when(long, 0).otherwise(1)).alias("variant_ids"))
    e = context.expand(h, c, ["pre"], "pos", 3, keep=["sentenceID", "docID"]).withColumn("distance", F.abs(F.col("pos") - F.col("hit_pos")))
    return context.dedupe_expanded(e, ["sentenceID"], ["docID"])


@query(f"""WITH {_POS}, e AS (SELECT DISTINCT h.docID AS query_id, c.sentenceID, c.pre, c.pos, c.sentence FROM c h JOIN c ON c.pre = h.pre AND c.pos BETWEEN greatest(0, h.pos - 2) AND h.pos + 2),
b AS (SELECT query_id, pre, count(*) AS n, '=== Doc: ' || pre || ' | Sentences: ' || arg_min(sentenceID, pos) || ' - ' || arg_max(sentenceID, pos) || ' ===' || chr(10) || coalesce(string_agg(sentence, ' ' ORDER BY pos), '') AS t FROM e GROUP BY 1, 2)
SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY pre) AS context, CAST(sum(n) AS BIGINT) AS n_sentences FROM b GROUP BY 1""")
def context_assembly(spark, d):
    c = _positions(spark, d)
    h = c.select(F.col("docID").alias("query_id"), "pre", "pos")
    e = context.expand(h, c, ["pre"], "pos", 2, keep=["sentenceID", "sentence"]).dropDuplicates(["query_id", "sentenceID"])
    return context.assemble(e, "query_id", ["pre", "pos"], ["pre"], F.concat(F.lit("Doc: "), "pre"), "sentence", "sentenceID")


@query(f"WITH {_POS}, s AS (SELECT *, count(*) OVER (PARTITION BY pre) AS n FROM c), l AS (SELECT *, row_number() OVER (PARTITION BY pre ORDER BY pos, sentenceID) - 1 AS i FROM s WHERE n >= 12) SELECT sentenceID, pos FROM l WHERE i % greatest(n // 5, 4) = 0 ORDER BY pre, pos, sentenceID LIMIT 60")
def evaluation_anchors(spark, d):
    return evaluation.anchors(_positions(spark, d), ["pre"], "sentenceID", "pos", 12).select("sentenceID", "pos")


# --- mining ---------------------------------------------------------------------------------------------------------

_RE2 = lambda p: p.replace("(?<![0-9A-Za-z_])", "\\b").replace("(?![0-9A-Za-z_])", "\\b").replace("'", "''")
_LABEL = "CASE " + " ".join(f"WHEN regexp_matches(sentence, '{_RE2(p)}') THEN '{n}'" for n, p in mining.KPI_LABELS.items()) + " END"
_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(sentence, '{_RE2(p)}') THEN '{n}'" for n, p in mining.TOPIC_PATTERNS.items()) + " ELSE 'general_risk' END"
_CORE = "s AS (SELECT DISTINCT sentenceID, cik_int, report_year, section_name, sentence FROM v_sample_1m_core WHERE sentence IS NOT NULL)"
_KPI = f"k AS (SELECT sentenceID, cik_int, report_year, sentence, {_LABEL} AS kpi_label FROM s WHERE regexp_matches(sentence, '\\d'))"
_RISK = f"r AS (SELECT sentenceID, cik_int, report_year, sentence, {_TOPIC} AS risk_topic, len(regexp_extract_all(sentence, '{_RE2(mining.RISK_CUES)}')) AS risk_cue_count FROM s WHERE contains(upper(section_name), 'ITEM_1A'))"


def _core(spark, d):
    return table(spark, d, "v_sample_1m_core").where("sentence is not null").select("sentenceID", "cik_int", "report_year", "section_name", "sentence").distinct()


@query(f"WITH {_CORE}, {_KPI} SELECT sentenceID, kpi_label, regexp_matches(sentence, '(?i)%|percent') AS is_percent, regexp_matches(sentence, '(?i)\\$|usd|million|billion') AS has_amount_cue, regexp_extract(sentence, '(\\$?\\d[\\d,]*(\\.\\d+)?)', 1) AS first_number_raw FROM k WHERE kpi_label IS NOT NULL")
def kpi_scan(spark, d):
    return mining.kpi_scan(_core(spark, d), "sentence", ["sentenceID"])


@query(f"WITH {_CORE}, {_RISK} SELECT sentenceID, risk_topic, CAST(risk_cue_count AS INTEGER) AS risk_cue_count FROM r WHERE risk_cue_count > 0")
def risk_atlas(spark, d):
    return mining.risk_atlas(_core(spark, d), "sentence", "section_name", ["sentenceID"])


@query(f"WITH {_CORE}, {_KPI} SELECT cik_int, kpi_label AS topic_label, list(DISTINCT report_year ORDER BY report_year) AS years, count(*) AS n_sentences, list(sentenceID ORDER BY report_year, sentenceID)[1:5] AS ids, list(sentence ORDER BY report_year, sentenceID)[1:5] AS texts FROM k WHERE kpi_label IS NOT NULL AND report_year IS NOT NULL AND regexp_matches(sentence, '{_RE2(mining.CAUSAL)}') GROUP BY 1, 2 HAVING count(DISTINCT report_year) >= 1")
def trend_bundles(spark, d):
    k = mining.kpi_scan(_core(spark, d), "sentence", ["sentenceID", "cik_int", "report_year", "sentence"])
    return mining.trend_bundles(k, ["cik_int"], "kpi_label", "report_year", "sentenceID", "sentence", "kpi_trend", least_years=1).select("cik_int", "topic_label", "years", "n_sentences", F.col("sentences.id").alias("ids"), F.col("sentences.text").alias("texts"))


@query(f"WITH {_CORE}, {_KPI} SELECT kpi_label AS topic_label, report_year AS year, count(DISTINCT cik_int) AS n_companies, list(id ORDER BY id)[1:5] AS ids FROM (SELECT kpi_label, report_year, cik_int, min(sentenceID) AS id FROM k WHERE kpi_label IS NOT NULL AND report_year IS NOT NULL AND cik_int IS NOT NULL AND regexp_matches(sentence, '{_RE2(mining.CAUSAL)}') GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(DISTINCT cik_int) >= 1")
def cross_company_bundles(spark, d):
    k = mining.kpi_scan(_core(spark, d), "sentence", ["sentenceID", "cik_int", "report_year", "sentence"]).where("cik_int is not null")
    return mining.cross_company_bundles(k, "cik_int", "kpi_label", "report_year", "sentenceID", "sentence", most=1_000_000, least=1).select("topic_label", "year", "n_companies", F.slice(F.array_sort("ids"), 1, 5).alias("ids"))


@query(f"WITH {_CORE} SELECT cik_int, report_year, min(sentenceID) AS id FROM s WHERE regexp_matches(sentence, '{_RE2(mining.DEFINITION)}') GROUP BY 1, 2")
def definition_sentences(spark, d):
    return mining.definitions(_core(spark, d), "sentence", ["cik_int", "report_year"], "sentenceID")


@query("""SELECT section_name, count(*) AS n, round(avg(length(sentence)), 6) AS mean_chars, median(length(sentence)) AS median_chars, percentile_cont(0.95) WITHIN GROUP (ORDER BY length(sentence)) AS p95_chars, count(CASE WHEN length(sentence) > 300 THEN 1 END) AS n_table_like FROM v_sample_1m_core WHERE section_name IS NOT NULL AND sentence IS NOT NULL GROUP BY 1""")
def length_profile(spark, d):
    return mining.length_profile(table(spark, d, "v_sample_1m_core"), "section_name", "sentence", 300).withColumn("mean_chars", F.round("mean_chars", 6))


@query(f"SELECT section_name, count(*) AS n, {', '.join(f"round(avg(regexp_matches(sentence, '{_RE2(p)}')::INT), 6) AS {n}" for n, p in mining.SIGNALS.items())} FROM v_sample_1m_core WHERE section_name IS NOT NULL AND sentence IS NOT NULL GROUP BY 1")
def signal_rates(spark, d):
    r = mining.signal_rates(table(spark, d, "v_sample_1m_core"), "section_name", "sentence")
    return r.withColumns({c: F.round(c, 6) for c in mining.SIGNALS})


_TERMS = """d AS (SELECT section_name AS section, sentenceID AS doc, regexp_extract_all(lower(sentence), '([a-z0-9_]{2,})') AS w FROM s WHERE section_name IS NOT NULL),
tf AS (SELECT section, doc, term, count(*) AS tf FROM (SELECT section, doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d) GROUP BY 1, 2, 3),
sz AS (SELECT section, count(DISTINCT doc) AS n FROM d GROUP BY 1), dfs AS (SELECT section, term, count(*) AS df FROM tf GROUP BY 1, 2),
ws AS (SELECT section, doc, term, n, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN dfs USING (section, term) JOIN sz USING (section) WHERE df >= 5 AND df <= n * 0.6),
nw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY section, doc)) AS x FROM ws), sc AS (SELECT section, term, round(sum(x) / any_value(n), 9) AS score FROM nw GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, term)::INT AS rank FROM sc QUALIFY rank <= 15)"""


@query(f"WITH {_CORE}, {_TERMS} SELECT section, term, score, rank FROM top")
def tfidf_ngrams(spark, d):
    return mining.tfidf_terms(_core(spark, d), "section_name", "sentenceID", "sentence")


@query(f"WITH {_CORE}, {_TERMS}, h(label, hint) AS (VALUES ('risk', 'may'), ('risk', 'risk'), ('results', 'million'), ('results', 'grew'), ('results', 'fell'), ('outlook', 'management'), ('outlook', 'would')), g AS (SELECT section, label, count(*) AS hits FROM top JOIN h ON contains(term, hint) GROUP BY 1, 2) SELECT section, label, hits FROM g QUALIFY row_number() OVER (PARTITION BY section ORDER BY hits DESC, label) = 1")
def section_labels(spark, d):
    hints = {"risk": ["may", "risk"], "results": ["million", "grew", "fell"], "outlook": ["management", "would"]}
    return mining.suggest_labels(mining.tfidf_terms(_core(spark, d), "section_name", "sentenceID", "sentence"), hints)


@query()
def near_dup_simhash(spark, d):
    return mining.simhash_rate(_core(spark, d), "section_name", "sentenceID", "sentence")


@query("""SELECT answer_type, difficulty, count(*) AS n, count(DISTINCT retrieval_scope) AS n_scopes, CAST(sum(len(evidence_sentence_ids)) AS BIGINT) AS n_evidence FROM (SELECT DISTINCT question_id, answer_type, difficulty, retrieval_scope, evidence_sentence_ids FROM p3_gold_p3v3_new10) GROUP BY 1, 2""")
def gold_aggregates(spark, d):
    q = table(spark, d, "p3_gold_p3v3_new10").select("question_id", "answer_type", "difficulty", "retrieval_scope", "evidence_sentence_ids").distinct()
    return q.groupBy("answer_type", "difficulty").agg(F.count("*").alias("n"), F.count_distinct("retrieval_scope").alias("n_scopes"), F.sum(F.when(F.col("evidence_sentence_ids").isNotNull(), F.size("evidence_sentence_ids")).cast("long")).alias("n_evidence"))


@query()
def question_entities(spark, d):
    return ent.question_entities(table(spark, d, "p3_gold_p3v3_new10"), table(spark, d, "sec_company_tickers"), 2025)


_TERMS_OF = lambda t: f"list_filter(list_transform(list_distinct(regexp_extract_all(lower({t}), '([\\p{{L}}\\p{{N}}$%.,]{{3,}})')), lambda x: regexp_replace(x, '[.,]+$', '')), lambda x: length(x) >= 3 AND x NOT IN ({', '.join(map(repr, evaluation._STOP))}))"  # noqa: E731, SLF001
_SHARE = lambda t: f"CASE WHEN len({t}) > 0 THEN len(list_filter({t}, lambda x: contains(low, x)))::DOUBLE / len({t}) ELSE 1.0::DOUBLE END"


def _answered(spark, d):
    """(question_id, question, truth, facts, response): a gold answer, its items, and the evidence it cites as the response."""
    g = table(spark, d, "p3_gold_p3v3_new10").groupBy("question_id").agg(F.min("question_text").alias("question"), F.min("answer_text").alias("truth"))
    core = table(spark, d, "v_sample_1m_core").groupBy(F.upper(F.trim("sentenceID")).alias("id")).agg(F.min("sentence").alias("sentence"))
    cited = table(spark, d, "p3_gold_p3v3_new10").select("question_id", F.explode("evidence_sentence_ids").alias("id")).select("question_id", F.upper(F.trim("id")).alias("id")).distinct()
    response = cited.join(core, "id").where("sentence is not null").groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "sentence"))), lambda x: x["sentence"]), " ").alias("response"))
    facts = F.when(F.col("truth").isNull(), F.array().cast("array<string>")).otherwise(F.split("truth", "; "))
    return g.join(response, "question_id", "left").withColumn("facts", facts)


@query(f"""WITH g AS (SELECT question_id, min(question_text) AS question, min(answer_text) AS truth FROM p3_gold_p3v3_new10 GROUP BY 1), core AS (SELECT upper(trim(sentenceID)) AS id, min(sentence) AS sentence FROM v_sample_1m_core GROUP BY 1),
cited AS (SELECT DISTINCT question_id, upper(trim(id)) AS id FROM (SELECT question_id, unnest(evidence_sentence_ids) AS id FROM p3_gold_p3v3_new10)), resp AS (SELECT question_id, string_agg(sentence, ' ' ORDER BY id) AS response FROM cited JOIN core USING (id) WHERE sentence IS NOT NULL GROUP BY 1),
j AS (SELECT *, lower(coalesce(response, '')) AS low, CASE WHEN truth IS NULL THEN []::VARCHAR[] ELSE string_split(truth, '; ') END AS facts FROM g LEFT JOIN resp USING (question_id)),
k AS (SELECT *, trim(low) <> '' AS said, len(string_split_regex(trim(low), '\\s+')) AS n, {_TERMS_OF('truth')} AS tt, {_TERMS_OF('question')} AS qt FROM j),
f AS (SELECT *, CASE WHEN said THEN CASE WHEN len(facts) > 0 THEN list_sum(list_transform(facts, lambda f: CASE WHEN contains(low, lower(f)) THEN 1.0::DOUBLE WHEN len({_TERMS_OF('f')}) > 0 AND {_SHARE(_TERMS_OF('f'))} >= 0.7 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END)) / len(facts) ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END AS factual,
CASE WHEN said THEN {_SHARE('tt')} ELSE 0.0::DOUBLE END AS completeness, CASE WHEN said THEN least(1.0::DOUBLE, {_SHARE('qt')} + CASE WHEN length(response) < 1000 THEN 0.1::DOUBLE ELSE 0 END) ELSE 0.0::DOUBLE END AS relevance,
CASE WHEN said THEN CASE WHEN n < 50 THEN n / 50.0::DOUBLE WHEN n <= 300 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (n - 300) / 700.0::DOUBLE) END ELSE 0.0::DOUBLE END AS conciseness FROM k)
SELECT question_id, round(factual, 6) AS factual, round(completeness, 6) AS completeness, round(relevance, 6) AS relevance, round(conciseness, 6) AS conciseness, round(factual * 0.4 + completeness * 0.3 + relevance * 0.2 + conciseness * 0.1, 6) AS overall FROM f WHERE truth IS NOT NULL AND question IS NOT NULL""")
def answer_scores(spark, d):
    s = evaluation.answer_scores(_answered(spark, d).where("truth is not null and question is not null"), "question", "response", "truth", "facts")
    return s.select("question_id", *(F.round(c, 6).alias(c) for c in ("factual", "completeness", "relevance", "conciseness", "overall")))


@query()
def rouge_scores(spark, d):
    return _answered(spark, d).select("question_id", evaluation.rouge_l("response", "truth").alias("rouge_l"))


@query("SELECT event_type AS model_id, count(*) AS n, CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS BIGINT) AS n_errors, CAST(sum(user_id) AS BIGINT) AS tokens, round(sum(value), 4) AS cost, round(avg(value), 6) AS avg_ms, max(value) AS max_ms FROM events GROUP BY 1")
def query_log_summary(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("model_id"), F.when(F.col("event_type") == "error", "x").alias("error"), F.col("user_id").alias("total_tokens"), F.col("value").alias("cost"), F.col("value").alias("processing_time_ms"))
    return evaluation.log_summary(e, "model_id").withColumns({"cost": F.round("cost", 4), "avg_ms": F.round("avg_ms", 6)})


# --- ingestion ------------------------------------------------------------------------------------------------------


@query()
def document_sentences(spark, d):
    return ingest.split_documents(table(spark, d, "documents"), "doc_id", "text", is_html=True, whole=True)


@query("""SELECT DISTINCT s.cik, s.ticker FROM sec_company_tickers s WHERE s.ticker IS NOT NULL AND s.cik NOT IN (SELECT cik_int FROM v_sample_1m_core WHERE cik_int IS NOT NULL)""")
def download_plan(spark, d):
    index = table(spark, d, "sec_company_tickers").where("ticker is not null").distinct().withColumn("form", F.lit("10-K"))
    have = table(spark, d, "v_sample_1m_core").select(F.col("cik_int").alias("cik"))
    return ingest.download_plan(index, have, ["cik"], ["10-K"]).select("cik", "ticker").distinct()

