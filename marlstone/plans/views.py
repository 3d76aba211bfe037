"""Queries of question views, retrieval, files and small operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marlstone.functions import dates, text
from marlstone.operators import evaluation, kpi, merge, mining, vectors
from marlstone.plans.domain import _CORE, _COS, _KPI, _POS, _RISK, _RATIOS, _positions, _queries, _statement
from marlstone.session import shared_folder, table
from marlstone.sources import catalog, formats

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- views of sentences ---------------------------------------------------------------------------------------------

_VIEWS = f"{_CORE}, {_KPI.replace('AS kpi_label FROM s', 'AS kpi_label, section_name FROM s')}, {_RISK.replace('AS risk_cue_count FROM s', 'AS risk_cue_count, section_name FROM s')}"
_KPIS, _RISKS = f"WITH {_VIEWS}, v AS (SELECT * FROM k WHERE kpi_label IS NOT NULL)", f"WITH {_VIEWS}, v AS (SELECT * FROM r WHERE risk_cue_count > 0)"
# The figures that matter most, in two selections.
PRIORITY = ("revenue", "net_income", "operating_income", "cash_from_ops", "gross_margin", "eps")
CANDIDATES = ("revenue", "net_income", "operating_income", "cash_from_ops", "eps")
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "v_sample_1m_core").where("sentence is not null").select("sentenceID", "cik_int", "report_year", "section_name", "sentence").distinct()


def _kpis(spark: SparkSession, d: str) -> DataFrame:
    return mining.kpi_scan(_sentences(spark, d), "sentence", ["sentenceID", "cik_int", "report_year", "section_name", "sentence"])


def _risks(spark: SparkSession, d: str) -> DataFrame:
    return mining.risk_atlas(_sentences(spark, d), "sentence", "section_name", ["sentenceID", "cik_int", "report_year", "section_name", "sentence"])


@query(f"{_KPIS} SELECT kpi_label, count(*) AS num_sentences FROM v GROUP BY 1")
def gold_q1_labels(spark, d):
    return mining.counted(_kpis(spark, d), ["kpi_label"])


@query(f"{_KPIS} SELECT cik_int, kpi_label, count(*) AS num_sentences FROM v GROUP BY 1, 2 ORDER BY 3 DESC, 1 NULLS LAST, 2 LIMIT 15")
def gold_q2_labels_by_company(spark, d):
    return mining.counted(_kpis(spark, d), ["cik_int", "kpi_label"], 15)


@query(f"{_KPIS} SELECT kpi_label, cik_int, count(*) AS num_sentences FROM v WHERE kpi_label IN ({_IN(PRIORITY)}) GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2 NULLS LAST LIMIT 10")
def gold_q3_priority(spark, d):
    g = mining.counted(_kpis(spark, d).where(F.col("kpi_label").isin(*PRIORITY)), ["kpi_label", "cik_int"])
    return g.orderBy("kpi_label", F.col("num_sentences").desc(), F.col("cik_int").asc_nulls_last()).limit(10)


@query(f"{_RISKS} SELECT risk_topic, count(*) AS num_sentences, round(avg(risk_cue_count), 6) AS avg_cues FROM v GROUP BY 1")
def gold_q4_topics(spark, d):
    return mining.counted(_risks(spark, d), ["risk_topic"], mean="risk_cue_count").withColumn("avg_cues", F.round("avg_cues", 6))


@query(f"{_RISKS} SELECT cik_int, risk_topic, count(*) AS num_sentences, round(avg(risk_cue_count), 6) AS avg_cues FROM v GROUP BY 1, 2 ORDER BY 3 DESC, 1 NULLS LAST, 2 LIMIT 15")
def gold_q5_topics_by_company(spark, d):
    return mining.counted(_risks(spark, d), ["cik_int", "risk_topic"], 15, "risk_cue_count").withColumn("avg_cues", F.round("avg_cues", 6))


@query(f"{_RISKS} SELECT cik_int, report_year, section_name, sentenceID, risk_topic, CAST(risk_cue_count AS INTEGER) AS risk_cue_count, sentence FROM v ORDER BY v.risk_cue_count DESC, sentenceID, cik_int, report_year, section_name, sentence LIMIT 20")
def gold_q6_strongest(spark, d):
    r = _risks(spark, d)
    by = [F.col("risk_cue_count").desc(), *(F.col(c).asc_nulls_last() for c in ("sentenceID", "cik_int", "report_year", "section_name", "sentence"))]
    return r.orderBy(*by).limit(20).select("cik_int", "report_year", "section_name", "sentenceID", "risk_topic", "risk_cue_count", "sentence")


@query(f"{_KPIS} SELECT cik_int, report_year, kpi_label, regexp_extract(sentence, '(\\$?\\d[\\d,]*(\\.\\d+)?)', 1) AS first_number_raw, sentenceID, sentence FROM v WHERE kpi_label IN ({_IN(CANDIDATES)}) AND upper(section_name) IN ('ITEM_7', 'ITEM_8')")
def gold_qa_candidates(spark, d):
    k = _kpis(spark, d).where(F.col("kpi_label").isin(*CANDIDATES) & F.upper("section_name").isin("ITEM_7", "ITEM_8"))
    return k.select("cik_int", "report_year", "kpi_label", "first_number_raw", "sentenceID", "sentence")


@query(f"{_RISKS} SELECT cik_int, report_year, risk_topic, CAST(risk_cue_count AS INTEGER) AS risk_cue_count, sentenceID, sentence FROM v")
def gold_qb_candidates(spark, d):
    return _risks(spark, d).select("cik_int", "report_year", "risk_topic", "risk_cue_count", "sentenceID", "sentence")


@query(f"WITH {_CORE} SELECT cik_int, report_year, list(sentenceID ORDER BY sentenceID) AS ids, list(length(sentence) ORDER BY sentenceID)::INT[] AS sizes FROM (SELECT DISTINCT cik_int, report_year, sentenceID, sentence FROM s) GROUP BY 1, 2")
def grouped_structs(spark, d):
    """Rows of a company and year as one list of structs in order, then its fields."""
    s = _sentences(spark, d).select("cik_int", "report_year", "sentenceID", "sentence").distinct()
    g = s.groupBy("cik_int", "report_year").agg(F.array_sort(F.collect_list(F.struct("sentenceID", F.length("sentence").alias("size")))).alias("rows"))
    return g.select("cik_int", "report_year", F.col("rows.sentenceID").alias("ids"), F.col("rows.size").alias("sizes"))


# --- retrieval ------------------------------------------------------------------------------------------------------


@query(f"""WITH {_COS}, h AS (SELECT s.query_id, s.id, s.distance, doc.source AS t FROM s JOIN documents doc ON doc.doc_id = s.id WHERE doc.report_year >= 2012 AND doc.source IS NOT NULL AND s.distance <= 1.2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY distance, id) AS k FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rk FROM o WHERE k = 1) SELECT query_id, id, round(distance, 6) AS distance, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 3""")
def search_over_fetch(spark, d):
    docs = table(spark, d, "documents").where("source is not null").select(F.col("doc_id").alias("id"), "report_year", "source")
    e = table(spark, d, "embeddings")
    got = vectors.search_and_filter(e, _queries(e), 3, docs, F.col("report_year") >= 2012, 1.2, "source")
    return got.withColumn("distance", F.round("distance", 6))


@query("""SELECT doc_id, CASE WHEN vec_id IS NOT NULL THEN 'run_2' ELSE source END AS source, CASE WHEN vec_id IS NOT NULL THEN len(embedding) ELSE report_year END::INT AS report_year FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def lineage_update(spark, d):
    m = table(spark, d, "documents").select("doc_id", "source", "report_year")
    run = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("run_2").alias("source"), F.size("embedding").alias("report_year"))
    return vectors.update_lineage(m, run, "doc_id", ["source", "report_year"])


@query("""SELECT sentenceID, sample_created_at FROM v_sample_1m_core WHERE cik_int IN (5000000, 5198837) AND report_year IN (2014, 2018, 2020) AND section_name IN ('ITEM_7', 'ITEM_8', 'ITEM_1A')""")
def question_filters(spark, d):
    spec = vectors.question_filter([5000000, 5198837], [2014, 2018, 2020, 2031], ["ITEM_7", "ITEM_8", "ITEM_1A"], as_of_year=2025)
    return table(spark, d, "v_sample_1m_core").where(vectors.compile_filter(spec, ["report_year", "section_name", "cik_int"])).select("sentenceID", "sample_created_at")


@query(f"WITH {_POS} SELECT a.sentenceID AS query_id, b.sentenceID AS id FROM c a JOIN c b ON a.pre = b.pre AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND a.sentenceID <> b.sentenceID")
def gold_neighbours(spark, d):
    c = _positions(spark, d)
    return evaluation.gold_neighbours(c, c, ["pre"], "sentenceID", "pos", 2)


@query(f"""WITH {_POS}, w AS (SELECT *, CASE WHEN length(sentence) < 60 THEN 5 WHEN length(sentence) < 200 THEN 3 ELSE 2 END AS size, CASE WHEN length(sentence) < 60 THEN 'short' WHEN length(sentence) < 200 THEN 'medium' ELSE 'long' END AS bucket FROM c),
g AS (SELECT a.bucket, a.sentenceID, count(b.sentenceID) AS n, min(CASE WHEN b.pos > a.pos THEN b.pos - a.pos END) AS first_hit FROM w a LEFT JOIN c b ON a.pre = b.pre AND b.pos BETWEEN a.pos - a.size AND a.pos + a.size AND a.sentenceID <> b.sentenceID GROUP BY 1, 2)
SELECT bucket, count(*) AS n, count(CASE WHEN n > 0 THEN 1 END) AS covered, round(avg(CASE WHEN first_hit <= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit FROM g GROUP BY 1""")
def adaptive_windows(spark, d):
    """The window by the sentence's length; the next sentence in the window stands for its first hit."""
    c = _positions(spark, d).withColumn("chars", F.length("sentence"))
    w = c.withColumn("size", evaluation.adaptive_window("chars")).withColumn("bucket", F.when(F.col("chars") < 60, "short").when(F.col("chars") < 200, "medium").otherwise("long"))
    a = w.select(F.col("sentenceID").alias("query_id"), "pre", F.col("pos").alias("at"), F.explode(F.sequence(F.col("pos") - F.col("size"), F.col("pos") + F.col("size"))).alias("pos"))
    near = a.join(c.select("pre", "pos", F.col("sentenceID").alias("id")), ["pre", "pos"]).where("id <> query_id")
    first = near.groupBy("query_id").agg(F.min(F.when(F.col("pos") > F.col("at"), F.col("pos") - F.col("at"))).alias("first_hit"), F.lit(True).alias("has_gold"))
    r = w.select(F.col("sentenceID").alias("query_id"), "bucket").join(first, "query_id", "left").withColumn("has_gold", F.coalesce("has_gold", F.lit(False)))
    return evaluation.bucket_scores(r, "bucket", 2).withColumn("hit", F.round("hit", 6))


# --- metrics --------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT c_mktsegment AS entity, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), n AS (SELECT entity, year, value + 1 AS value FROM p), f AS (SELECT max(year) - 1 AS y FROM n) SELECT * FROM p WHERE year < (SELECT y FROM f) UNION ALL SELECT * FROM n WHERE year >= (SELECT y FROM f)""")
def gated_merge(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    p = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("entity"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return kpi.gated_merge(p, p.withColumn("value", F.col("value") + 1), "year", 2, 5, 3)[0]


@query("""SELECT c_mktsegment AS entity, year(o_orderdate)::INT AS year, round(coalesce(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END), 0) + coalesce(sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END), 0), 2) AS current_items FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def kpi_alias_sum(spark, d):
    s = kpi.sum_by_alias(_statement(spark, d), "entity", "year", "label", "amount", ["AssetsCurrent", " liabilitiescurrent ", "No Such Line"], "current_items")
    return s.withColumn("current_items", F.round("current_items", 2))


@query(f"WITH {_RATIOS} SELECT entity, year, metric, round(value, 4) AS value FROM ratios WHERE contains(lower(metric), 'ratio')")
def kpi_search(spark, d):
    f = kpi.derive(kpi.pick_by_alias(_statement(spark, d), "entity", "year", "label", "amount"), "entity", "year")
    return kpi.search(f, "Ratio").withColumn("value", F.round("value", 4))


@query("""SELECT CAST((SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS id, c_name FROM customer""")
def id_continuation(spark, d):
    new = table(spark, d, "customer").select(F.lit(0).cast("long").alias("id"), "c_name", "c_custkey")
    return merge.next_ids(new, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id", "c_custkey").select("id", "c_name")


@query("""WITH q AS (SELECT user_id, event_id, ts, value FROM events) SELECT a.event_id, b.event_id AS previous_error FROM (SELECT * FROM events) a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def as_of_join(spark, d):
    """The last error of the same user up to each event: one sort for each user, no join of ranges."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.max(F.when(F.col("event_type") == "error", F.struct("ts", "event_id"))).over(w)["event_id"].alias("previous_error"))


@query("""SELECT source, CAST(sum(length(text)) AS BIGINT) AS n_chars, round(sum(length(text)) / 4.0::DOUBLE / 1e6 * 0.02, 9) AS token_cost, round(sum(length(text)) / 1073741824.0::DOUBLE * 0.09, 12) AS egress_cost FROM documents GROUP BY 1""")
def cost_arithmetic(spark, d):
    n = F.sum(F.length("text"))
    one = F.lit(1.0).cast("double")
    return table(spark, d, "documents").groupBy("source").agg(n.alias("n_chars"), F.round(one * n / 4 / 1e6 * 0.02, 9).alias("token_cost"), F.round(one * n / (1 << 30) * 0.09, 12).alias("egress_cost"))


@query("""SELECT sentenceID, sample_created_at, tickers = ['AAPL'] AS only_one, coalesce(list_contains(tickers, 'A'), false) AS has_a, coalesce(len(tickers), 0) = 0 AS none FROM v_sample_1m_core""")
def list_equality(spark, d):
    t = F.col("tickers")
    return table(spark, d, "v_sample_1m_core").select("sentenceID", "sample_created_at", (t == F.array(F.lit("AAPL"))).alias("only_one"), F.coalesce(F.array_contains(t, "A"), F.lit(False)).alias("has_a"), (F.coalesce(F.size(t), F.lit(0)) <= 0).alias("none"))


@query("""SELECT DISTINCT reportDate, TRY_CAST(reportDate AS DATE) AS day, TRY_CAST(nullif(regexp_extract(reportDate, '(19\\d{2}|20\\d{2})', 1), '') AS INTEGER) AS year_in_text, TRY_CAST(left(reportDate, 4) AS INTEGER) AS head FROM corpus_tagged""")
def tolerant_casts(spark, d):
    c = F.col("reportDate")
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).try_cast("date")
    return table(spark, d, "corpus_tagged").select("reportDate", day.alias("day"), dates.year_in(c).alias("year_in_text"), F.left(c, F.lit(4)).try_cast("int").alias("head")).distinct()


@query("""SELECT p_partkey, regexp_replace(x, '([^A-Z])([A-Z])', '\\1 \\2', 'g') AS words FROM (SELECT p_partkey, replace(regexp_replace(upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) || 'Net' || 'Sales', '[^A-Za-z]', '', 'g'), ' ', '') AS x FROM part)""")
def camel_case(spark, d):
    b = F.col("p_brand")
    x = F.regexp_replace(F.concat(F.upper(F.left(b, F.lit(1))), F.lower(F.substr(b, F.lit(2))), F.lit("NetSales")), "[^A-Za-z]", "")
    return table(spark, d, "part").select("p_partkey", text.split_camel(x).alias("words"))


@query("""SELECT doc_id, length(trim(regexp_replace(regexp_replace(translate(text, chr(160) || '‘’“”–—', ' ''''""--'), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'))) > 0 AS has_text FROM documents WHERE text IS NOT NULL""")
def normalised_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", (F.length(text.plain_text(F.col("text"))) > 0).alias("has_text"))


# --- files: written to the session's shared folder and read again --------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}/{name}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, d):
    """The reader goes by the suffix, the types by the schema."""
    at = _place(spark, "nation.csv")
    formats.append_log(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), at, "csv")
    return formats.read(spark, at, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT question_id, question_text, years FROM p3_gold_p3v3_new10")
def json_round_trip(spark, d):
    at = _place(spark, "gold.json")
    formats.write_json(table(spark, d, "p3_gold_p3v3_new10").select("question_id", "question_text", "years"), at)
    return formats.read(spark, at, "question_id string, question_text string, years array<int>")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS name FROM region")
def keyed_json(spark, d):
    """A JSON object of objects, as company lists come, as rows."""
    at = _place(spark, "regions.json")
    r = table(spark, d, "region").select(F.struct(F.col("r_regionkey").cast("string").alias("key"), F.struct(F.col("r_name").alias("name")).alias("value")).alias("e"))
    r.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).coalesce(1).write.text(at)  # a row a region
    return formats.read_keyed_json(spark, at, "name string").select("key", "name")


@query("SELECT trim(company_name) AS name, nullif(trim(ticker), '') AS ticker, trim(identifier) AS identifier FROM spy_holdings_15oct WHERE company_name IS NOT NULL")
def sheet_scan(spark, d):
    """A sheet with title rows above its header, saved as text: titles, header and blank rows go."""
    at = _place(spark, "sheet.csv")
    head = spark.createDataFrame([("Fund Name:", None, None), ("Name", "Ticker", "Identifier")], "name string, ticker string, identifier string")
    rows = table(spark, d, "spy_holdings_15oct").where("company_name is not null").select(F.col("company_name").alias("name"), "ticker", "identifier")
    head.unionByName(rows).write.option("escape", '"').csv(at)
    return formats.read_sheet(spark, at, ["name", "ticker", "identifier"], "Name").select(*(F.trim(c).alias(c) for c in ("name", "ticker", "identifier")))


@query("SELECT cik, 'https://files/' || cik || '/' || coalesce(ticker, '') AS url FROM sec_company_tickers WHERE cik IS NOT NULL")
def filing_index(spark, d):
    """A pipe-separated index without header."""
    at = _place(spark, "index.txt")
    s = table(spark, d, "sec_company_tickers").where("cik is not null")
    line = {"cik": F.col("cik").cast("string"), "form": F.lit("10-K"), "path": F.concat(F.col("cik").cast("string"), F.lit("/"), F.coalesce("ticker", F.lit("")))}
    s.select(*(line.get(c, F.lit("x")).alias(c) for c in formats.INDEX_COLUMNS)).write.option("sep", "|").csv(at)
    return formats.read_filing_index(spark, at, "https://files/", ["10-K"]).select("cik", "url")


@query("SELECT count(*) AS n_rows, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem")
def parquet_export(spark, d):
    """Compressed export with bounded files, footers and rows read back."""
    at = _place(spark, "lineitem.parquet")
    formats.write_parquet(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), at, most_rows=20_000)
    formats.preflight(spark, [at])
    return formats.read(spark, at).agg(F.count("*").alias("n_rows"), F.sum("l_quantity").alias("quantity"))


@query("SELECT event_type, count(*) * 2 AS n FROM events GROUP BY 1")
def append_log(spark, d):
    """A log that grows by appended files; nothing of it is rewritten."""
    at = _place(spark, "log.parquet")
    e = table(spark, d, "events").select("event_id", "event_type")
    formats.append_log(e, at)
    formats.append_log(e, at)
    return formats.read(spark, at).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS key, n_name AS name, CAST(NULL AS VARCHAR) AS comment FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def multi_file_merge(spark, d):
    """Files of unlike columns and integer widths, one below the other, sorted."""
    a, b = _place(spark, "a.parquet"), _place(spark, "b.parquet")
    formats.write_parquet(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")), a)
    formats.write_parquet(table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("key"), F.col("r_name").alias("name"), F.lit("region").alias("comment")), b)
    return formats.read_many(spark, [a, b], ["name", "key"])


@query("SELECT 'now' AS version, count(*) AS n FROM region UNION ALL SELECT 'archived', count(*) FROM nation")
def archive_replace(spark, d):
    """The table at a path is replaced and the one before it kept."""
    at = _place(spark, "t.parquet")
    archive = at.rsplit("/", 1)[0] + "/archive"
    formats.replace(table(spark, d, "nation").select(F.col("n_name").alias("name")), at, archive)
    formats.replace(table(spark, d, "region").select(F.col("r_name").alias("name")), at, archive)
    old = formats.read(spark, archive + "/*.parquet")
    return formats.read(spark, at).agg(F.lit("now").alias("version"), F.count("*").alias("n")).unionByName(old.agg(F.lit("archived").alias("version"), F.count("*").alias("n")))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def catalog_views(spark, d):
    """Tables by name, as temporary views for SQL."""
    c = catalog.Catalog(spark, d)
    c.register("nation")
    return spark.sql("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def partial_read(spark, d):
    return formats.read(spark, f"{d}/orders.parquet").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(5)


@query("SELECT CAST(count(*) AS BIGINT) AS rows FROM embeddings")
def index_put(spark, d):
    """Vectors handed over in bounded batches by the tasks."""
    got = formats.put_batches(table(spark, d, "embeddings").select("vec_id", "embedding"), lambda batch: None, 100)
    return got.agg(F.sum("rows").alias("rows"))
