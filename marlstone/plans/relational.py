"""Queries of the relational constructs: aggregation, windows, joins, sets, sorting, functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F, types as T

from marlstone.functions import dates, text
from marlstone.operators import merge
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


@query("""SELECT section_name, count(*) AS n_rows, count(DISTINCT cik_int) AS n_entities, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
FROM v_sample_1m_core WHERE section_name IS NOT NULL GROUP BY section_name""")
def section_profile(spark, d):
    g = table(spark, d, "v_sample_1m_core").where("section_name is not null").groupBy("section_name").agg(F.count("*").alias("n_rows"), F.count_distinct("cik_int").alias("n_entities"))
    return g.withColumn("pct", F.round(F.lit(100.0).cast("double") * F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()), 6))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(avg(l_quantity), 6) AS avg_qty, count(*) AS n, count(DISTINCT l_suppkey) AS n_supp FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def grouped_aggregates(spark, d):
    c = F.col
    li = table(spark, d, "lineitem").where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("n_supp"))


@query("""WITH s AS (SELECT docID, count(*) AS n FROM v_sample_1m_core WHERE docID IS NOT NULL GROUP BY docID)
SELECT count(*) AS n_docs, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(stddev(n), 6) AS sd, percentile_cont(0.25) WITHIN GROUP (ORDER BY n) AS p25,
percentile_cont(0.5) WITHIN GROUP (ORDER BY n) AS p50, percentile_cont(0.95) WITHIN GROUP (ORDER BY n) AS p95, round(stddev(n) / nullif(avg(n), 0), 6) AS cv FROM s""")
def size_distribution(spark, d):
    s = table(spark, d, "v_sample_1m_core").where("docID is not null").groupBy("docID").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("n_docs"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev("n"), 6).alias("sd"), *(F.percentile("n", p).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.95)), F.round(F.try_divide(F.stddev("n"), F.avg("n")), 6).alias("cv"))


@query("""SELECT count(*) AS n_rows, count(DISTINCT concat(cik, '|', docID)) AS n_pairs, count(sentence) AS n_text, count(DISTINCT section_name) AS n_sections FROM v_sample_1m_core""")
def global_counts(spark, d):
    return table(spark, d, "v_sample_1m_core").agg(F.count("*").alias("n_rows"), F.count_distinct(F.concat_ws("|", F.coalesce("cik", F.lit("")), F.coalesce("docID", F.lit("")))).alias("n_pairs"), F.count("sentence").alias("n_text"), F.count_distinct("section_name").alias("n_sections"))


@query("""WITH y AS (SELECT report_year, count(*) AS n FROM corpus_tagged WHERE report_year IS NOT NULL GROUP BY 1)
SELECT report_year, n, n - lag(n) OVER (ORDER BY report_year) AS delta, round(100.0 * (n - lag(n) OVER (ORDER BY report_year)) / lag(n) OVER (ORDER BY report_year), 6) AS delta_pct, CAST(sum(n) OVER (ORDER BY report_year) AS BIGINT) AS running FROM y""")
def yearly_growth(spark, d):
    y = table(spark, d, "corpus_tagged").where("report_year is not null").groupBy("report_year").agg(F.count("*").alias("n"))
    w = Window.orderBy("report_year")  # one row a year
    delta = F.col("n") - F.lag("n").over(w)
    return y.select("report_year", "n", delta.alias("delta"), F.round(F.lit(100.0).cast("double") * delta / F.lag("n").over(w), 6).alias("delta_pct"), F.sum("n").over(w).alias("running"))


@query("""SELECT sentenceID, reportDate, CAST(coalesce(try_strptime(reportDate, '%Y-%m-%d'), try_strptime(reportDate, '%m/%d/%Y'), try_strptime(reportDate, '%Y%m%d'), try_strptime(reportDate, '%B %d, %Y')) AS DATE) AS parsed FROM corpus_tagged WHERE reportDate IS NOT NULL""")
def multi_format_dates(spark, d):
    return table(spark, d, "corpus_tagged").where("reportDate is not null").select("sentenceID", "reportDate", dates.parse_date(F.col("reportDate"), ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "MMMM d, yyyy")).alias("parsed"))


@query("""SELECT CASE WHEN report_year BETWEEN 2006 AND 2009 THEN 'bin_2006_2009' WHEN report_year BETWEEN 2010 AND 2015 THEN 'bin_2010_2015' WHEN report_year BETWEEN 2016 AND 2020 THEN 'bin_2016_2020' WHEN report_year BETWEEN 2021 AND 2025 THEN 'bin_2021_2025' ELSE 'bin_unknown' END AS bin, count(*) AS n FROM v_sample_1m_core GROUP BY 1""")
def temporal_bins(spark, d):
    return table(spark, d, "v_sample_1m_core").groupBy(dates.temporal_bin(F.col("report_year")).alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'TOTAL' ELSE c_mktsegment END AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())""")
def grouping_sets_total(spark, d):
    return spark.sql("SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'TOTAL' ELSE c_mktsegment END AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM {c} GROUP BY GROUPING SETS ((c_mktsegment), ())", c=table(spark, d, "customer"))


@query("""SELECT o_orderpriority, count(CASE WHEN year(o_orderdate) < 1997 THEN 1 END) AS early, count(CASE WHEN year(o_orderdate) BETWEEN 1997 AND 1998 THEN 1 END) AS middle, count(CASE WHEN year(o_orderdate) > 1998 THEN 1 END) AS late FROM orders GROUP BY 1""")
def pivot_bins(spark, d):
    b = dates.temporal_bin(F.year("o_orderdate"), {"early": (0, 1996), "middle": (1997, 1998)}, "late")
    return table(spark, d, "orders").select("o_orderpriority", b.alias("b")).groupBy("o_orderpriority").pivot("b", ["early", "middle", "late"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""WITH p AS (SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)
SELECT o_orderstatus, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM p UNION ALL SELECT o_orderstatus, 'total', total FROM p""")
def unpivot_bins(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").cast("double").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return p.unpivot(["o_orderstatus"], ["n", "total"], "metric", "value")


@query("""SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 6) AS mean FROM supplier GROUP BY 1 HAVING count(*) >= 3""")
def having_filter(spark, d):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 6).alias("mean")).where("n >= 3")


@query("""SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, list(n_nationkey ORDER BY n_nationkey) AS ids FROM nation GROUP BY 1""")
def string_and_list_aggregates(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name)").alias("names"), F.array_sort(F.collect_list("n_nationkey")).alias("ids"))


@query("""SELECT cik_int, list(DISTINCT t ORDER BY t) AS all_tickers FROM (SELECT cik_int, unnest(tickers) AS t FROM v_sample_1m_core) WHERE t IS NOT NULL GROUP BY 1""")
def array_agg_distinct(spark, d):
    x = table(spark, d, "v_sample_1m_core").select("cik_int", F.explode("tickers").alias("t")).where("t is not null")
    return x.groupBy("cik_int").agg(F.array_sort(F.collect_set("t")).alias("all_tickers"))


@query("""SELECT part, count(*) AS n FROM (SELECT unnest(string_split(sentenceID, '_')) AS part FROM corpus_tagged) GROUP BY 1""")
def explode_split(spark, d):
    return table(spark, d, "corpus_tagged").select(F.explode(F.split("sentenceID", "_")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("""SELECT c_nationkey, arg_max(c_name, c_acctbal) AS richest, max(c_acctbal) AS balance, arg_min(c_name, c_acctbal) AS poorest FROM customer GROUP BY 1""")
def latest_by_order(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_name", "c_acctbal").alias("richest"), F.max("c_acctbal").alias("balance"), F.min_by("c_name", "c_acctbal").alias("poorest"))


@query("""SELECT c.c_custkey, c.c_name, n.n_name, r.r_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey AND r.r_name <> 'ASIA'""")
def dimension_joins(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, (r.r_regionkey == n.n_regionkey) & (r.r_name != "ASIA"), "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_join(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("""SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' WHERE o_orderkey IS NULL""")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '5-LOW')""")
def exists_filter(spark, d):
    o = table(spark, d, "orders")
    has = lambda c, how: lambda x: x.join(o.where(c).select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), how)
    return table(spark, d, "customer").select("c_custkey").transform(has("o_totalprice > 100000", "left_semi")).transform(has("o_orderpriority = '5-LOW'", "left_anti"))


@query("""SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')""")
def not_in(spark, d):
    return spark.sql("SELECT n_name FROM {n} WHERE n_regionkey NOT IN (SELECT r_regionkey FROM {r} WHERE r_name LIKE 'A%')", n=table(spark, d, "nation"), r=table(spark, d, "region"))


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)""")
def scalar_subquery(spark, d):
    o = table(spark, d, "orders")
    return o.crossJoin(F.broadcast(o.agg(F.avg("o_totalprice").alias("mean")))).where(F.col("o_totalprice") > 1.5 * F.col("mean")).select("o_orderkey")


@query("""SELECT p_partkey, p_name FROM part p WHERE p_retailprice = (SELECT max(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)""")
def correlated_subquery(spark, d):
    p = table(spark, d, "part")
    return p.withColumn("m", F.max("p_retailprice").over(Window.partitionBy("p_brand"))).where("p_retailprice = m").select("p_partkey", "p_name")


@query("""SELECT a.o_orderkey AS earlier, b.o_orderkey AS later FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 5 DAY""")
def band_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    a, b = o.alias("a"), o.alias("b")
    on = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("b.o_orderdate") > F.col("a.o_orderdate")) & (F.col("b.o_orderdate") <= F.col("a.o_orderdate") + F.expr("INTERVAL 5 DAYS"))
    return a.join(b, on).select(F.col("a.o_orderkey").alias("earlier"), F.col("b.o_orderkey").alias("later"))


@query("""SELECT c.cik, c.company_name, h.identifier FROM (SELECT DISTINCT cik, company_name, upper(trim(ticker)) AS t FROM sec_company_tickers WHERE ticker IS NOT NULL) c JOIN (SELECT DISTINCT identifier, upper(trim(ticker)) AS t FROM spy_holdings_15oct WHERE ticker IS NOT NULL) h USING (t)""")
def normalised_key_join(spark, d):
    t = F.upper(F.trim("ticker")).alias("t")
    c = table(spark, d, "sec_company_tickers").where("ticker is not null").select("cik", "company_name", t).distinct()
    return c.join(table(spark, d, "spy_holdings_15oct").where("ticker is not null").select("identifier", t).distinct(), "t").select("cik", "company_name", "identifier")


@query("""SELECT DISTINCT v.cik_int, s.cik FROM (SELECT cik_int, unnest(tickers) AS t FROM v_sample_1m_core) v JOIN sec_company_tickers s ON s.ticker = v.t""")
def array_membership_join(spark, d):
    v = table(spark, d, "v_sample_1m_core").select("cik_int", F.explode("tickers").alias("ticker")).distinct()
    return v.join(table(spark, d, "sec_company_tickers").select("cik", "ticker").distinct(), "ticker").select("cik_int", "cik").distinct()


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, p.p_brand FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey = p.p_size % 25""")
def composite_key_join(spark, d):
    li, p, s = (table(spark, d, x) for x in ("lineitem", "part", "supplier"))
    j = li.join(p.withColumn("nk", F.col("p_size") % 25), li.l_partkey == p.p_partkey).join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("nk") == F.col("s_nationkey")))
    return j.select("l_orderkey", "l_linenumber", "l_quantity", "p_brand")


@query("""SELECT r_name, y, CAST(coalesce(n, 0) AS BIGINT) AS n FROM region CROSS JOIN (SELECT unnest(range(1995, 1999)) AS y) LEFT JOIN (SELECT n_regionkey, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) g ON g.n_regionkey = r_regionkey AND g.y = y""".replace("g.y = y", "g.y = t.y").replace("(SELECT unnest(range(1995, 1999)) AS y)", "(SELECT unnest(range(1995, 1999)) AS y) t").replace("SELECT r_name, y,", "SELECT r_name, t.y AS y,"))
def cartesian_grid(spark, d):
    y = spark.range(1995, 1999).withColumnRenamed("id", "y")
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    g = o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey).groupBy("n_regionkey", F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))
    return table(spark, d, "region").crossJoin(y).withColumnRenamed("r_regionkey", "n_regionkey").join(g, ["n_regionkey", "y"], "left").select("r_name", "y", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("""SELECT c_mktsegment, c_custkey, rn FROM (SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rn FROM customer) WHERE rn <= 3""")
def top_n_per_group(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, d, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("c_mktsegment", "c_custkey", "rn")


@query("""SELECT event_id, user_id, n_user, CAST(rank_avg AS DOUBLE) AS rank_avg, round(cum, 4) AS cum, prev_id, next_id FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n_user,
rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS rank_avg, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum,
lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events)""")
def window_family(spark, d):
    u, o = Window.partitionBy("user_id"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events")
    avg_rank = F.rank().over(u.orderBy(F.col("value").asc_nulls_last())) + (F.count("*").over(Window.partitionBy("user_id", "value")) - 1) / F.lit(2.0).cast("double")
    return e.select("event_id", "user_id", F.count("*").over(u).alias("n_user"), avg_rank.alias("rank_avg"), F.round(F.sum("value").over(o.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("cum"), F.lag("event_id").over(o).alias("prev_id"), F.lead("event_id").over(o).alias("next_id"))


@query("""SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20""")
def top_k(spark, d):
    return table(spark, d, "customer").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("""SELECT DISTINCT n_regionkey AS k, 'nation' AS src FROM nation UNION ALL SELECT r_regionkey, 'region' FROM region""")
def union_all(spark, d):
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.lit("nation").alias("src")).distinct().unionByName(table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.lit("region").alias("src")))


@query("""SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("""SELECT sentenceID FROM v_sample_1m_core INTERSECT SELECT sentenceID FROM sentence_removals""")
def key_overlap(spark, d):
    return table(spark, d, "v_sample_1m_core").select("sentenceID").intersect(table(spark, d, "sentence_removals").select("sentenceID"))


@query("""SELECT cik FROM sec_company_tickers EXCEPT SELECT cik_int FROM v_sample_1m_core""")
def key_difference(spark, d):
    return table(spark, d, "sec_company_tickers").select("cik").subtract(table(spark, d, "v_sample_1m_core").select("cik_int"))


@query("""SELECT doc_id, upper(substr(source, 1, 5)) AS head, length(text) AS n, length(text) - length(replace(text, ' ', '')) + 1 AS n_words, lpad(CAST(doc_id AS VARCHAR), 10, '0') AS padded, md5(concat(CAST(doc_id AS VARCHAR), coalesce(source, ''))) AS row_hash,
replace(trim(source), '_', ' ') AS spaced FROM documents""")
def text_functions(spark, d):
    c = F.col
    return table(spark, d, "documents").select("doc_id", F.upper(F.substring("source", 1, 5)).alias("head"), F.length("text").cast("long").alias("n"), text.word_count(c("text")).cast("long").alias("n_words"), F.lpad(c("doc_id").cast("string"), 10, "0").alias("padded"), F.md5(F.concat_ws("", c("doc_id").cast("string"), c("source"))).alias("row_hash"), F.replace(F.trim("source"), F.lit("_"), F.lit(" ")).alias("spaced"))


@query("""SELECT doc_id, CAST(trunc((length(text) - length(replace(text, ' ', '')) + 1) * CAST(1.33 AS DOUBLE)) AS SMALLINT) AS tokens FROM documents WHERE text IS NOT NULL""")
def token_estimate(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT sentenceID, coalesce(TRY_CAST(string_split(sentenceID, '_')[-1] AS SMALLINT), CAST(-1 AS SMALLINT)) AS pos, regexp_replace(sentenceID, '_[^_]*$', '') AS prefix, CAST(nullif(regexp_extract(sentenceID, '_(\\d{4})_section', 1), '') AS INTEGER) AS y FROM v_sample_1m_core""")
def id_parts(spark, d):
    s = F.col("sentenceID")
    return table(spark, d, "v_sample_1m_core").select("sentenceID", text.position_of(s).alias("pos"), text.prefix_of(s).alias("prefix"), F.nullif(F.regexp_extract(s, r"_(\d{4})_section", 1), F.lit("")).try_cast("int").alias("y"))


@query("""SELECT cik, regexp_replace(upper(trim(company_name)), '[,. ]+(INC|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED|PLC|LP)\\.?$', '') AS bare FROM (SELECT DISTINCT cik, company_name FROM sec_company_tickers)""")
def suffix_stripping(spark, d):
    return table(spark, d, "sec_company_tickers").select("cik", "company_name").distinct().select("cik", F.regexp_replace(F.upper(F.trim("company_name")), r"[,. ]+(INC|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED|PLC|LP)\.?$", "").alias("bare"))


@query("""SELECT a.n_name AS a, b.n_name AS b, round(1.0 - CAST(levenshtein(a.n_name, b.n_name) AS DOUBLE) / greatest(length(a.n_name), length(b.n_name)), 6) AS sim FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey""")
def fuzzy_similarity(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_regionkey") == F.col("b.n_regionkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.round(text.similarity(F.col("a.n_name"), F.col("b.n_name")), 6).alias("sim"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("""SELECT question_id, len(evidence_sentence_ids) AS n_ids, evidence_sentence_ids[1] AS first_id, list_contains(section_hints, 'ITEM_7') AS in_item_7, len(list_distinct(years)) AS n_years, list_sort(years) AS sorted_years FROM (SELECT DISTINCT question_id, evidence_sentence_ids, section_hints, years FROM p3_gold_p3v3_new10)""")
def array_functions(spark, d):
    q = table(spark, d, "p3_gold_p3v3_new10").select("question_id", "evidence_sentence_ids", "section_hints", "years").distinct()
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return q.select("question_id", size("evidence_sentence_ids").alias("n_ids"), F.try_element_at("evidence_sentence_ids", F.lit(1)).alias("first_id"), F.array_contains("section_hints", "ITEM_7").alias("in_item_7"), F.when(F.col("years").isNotNull(), F.size(F.array_distinct(F.array_compact("years")))).cast("long").alias("n_years"), F.array_sort("years").alias("sorted_years"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, greatest(p_size, 20) AS g, abs(p_size - 25) AS a, TRY_CAST(substr(p_brand, -2) AS INTEGER) AS b, coalesce(nullif(p_size % 7, 0), -1) AS m FROM part WHERE p_type LIKE '%BRASS%' OR upper(p_name) LIKE '%A%'""")
def scalar_functions(spark, d):
    c = F.col
    p = table(spark, d, "part").where(c("p_type").contains("BRASS") | F.upper("p_name").contains("A"))
    return p.select("p_partkey", F.when(c("p_size") < 10, "small").when(c("p_size") < 30, "medium").otherwise("large").alias("size_class"), F.greatest("p_size", F.lit(20)).alias("g"), F.abs(c("p_size") - 25).alias("a"), F.substring("p_brand", -2, 2).try_cast("int").alias("b"), F.coalesce(F.nullif(c("p_size") % 7, F.lit(0)), F.lit(-1)).alias("m"))


@query("""WITH a AS (SELECT * FROM (VALUES ('doc id', 'bigint'), ('text', 'string'), ('year', 'int'), ('Section_Name', 'string')) t(c, ty)), b AS (SELECT * FROM (VALUES ('DOC_ID', 'bigint'), ('text', 'binary'), ('lang', 'string'), ('section-name', 'string')) t(c, ty)),
x AS (SELECT lower(regexp_replace(trim(c), '[ _-]+', '_', 'g')) AS column_name, ty FROM a), y AS (SELECT lower(regexp_replace(trim(c), '[ _-]+', '_', 'g')) AS column_name, ty FROM b)
SELECT coalesce(x.column_name, y.column_name) AS column_name, x.ty AS left_type, y.ty AS right_type, CASE WHEN x.ty IS NULL THEN 'right_only' WHEN y.ty IS NULL THEN 'left_only' WHEN x.ty = y.ty THEN 'match' ELSE 'type_mismatch' END AS status FROM x FULL OUTER JOIN y USING (column_name)""")
def full_outer_schema_diff(spark, d):
    s = "column_name string, data_type string"
    a = spark.createDataFrame([("doc id", "bigint"), ("text", "string"), ("year", "int"), ("Section_Name", "string")], s)
    b = spark.createDataFrame([("DOC_ID", "bigint"), ("text", "binary"), ("lang", "string"), ("section-name", "string")], s)
    return merge.schema_diff(a, b)


@query("""SELECT row_number() OVER () AS ordinal, column_name, replace(replace(replace(replace(replace(replace(column_type, 'BIGINT', 'bigint'), 'VARCHAR', 'string'), 'DOUBLE', 'double'), 'TIMESTAMP WITH TIME ZONE', 'timestamp'), 'INTEGER', 'int'), '[]', '[]') AS data_type FROM (DESCRIBE SELECT * FROM p3_gold_p3v3_new10)""")
def table_schema(spark, d):
    s = merge.schema_rows(table(spark, d, "p3_gold_p3v3_new10"))
    return s.select(F.col("ordinal").cast("long").alias("ordinal"), "column_name", F.regexp_replace("data_type", "^array<(.*)>$", "$1[]").alias("data_type"))


@query()
def parquet_footers(spark, d):
    from urllib.parse import unquote

    from marlstone.sources.formats import footers, row_group_summary

    return row_group_summary(footers(spark, sorted(map(unquote, table(spark, d, "lineitem").inputFiles()))))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS key, CAST(o_custkey AS INTEGER) AS cust, CAST(NULL AS VARCHAR) AS note, 'load' AS method FROM orders""")
def schema_alignment(spark, d):
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("cust", T.IntegerType()), T.StructField("note", T.StringType()), T.StructField("method", T.StringType())])
    return merge.align(table(spark, d, "orders"), schema, {"o_orderkey": "key", "o_custkey": "cust"}, {"method": F.lit("load")})


@query("""SELECT event_type, date_trunc('day', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    from marlstone.streaming.flows import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "value").select("event_type", "window_start", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    from marlstone.streaming.flows import sessions

    return sessions(table(spark, d, "events"), "ts", "user_id", "6 hours")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 15""")
def prepared_statement(spark, d):
    """Parameters are bound, never pasted into the text."""
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {o} WHERE o_orderpriority = :p AND o_totalprice >= :least ORDER BY o_totalprice DESC, o_orderkey LIMIT 15", args={"p": "1-URGENT", "least": 200000}, o=table(spark, d, "orders"))


@query("""SELECT v.code, v.label, count(o_orderkey) AS n FROM (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'partial'), ('X', 'none')) v(code, label) LEFT JOIN orders ON o_orderstatus = v.code GROUP BY 1, 2""")
def inline_values(spark, d):
    v = spark.createDataFrame([("F", "finished"), ("O", "open"), ("P", "partial"), ("X", "none")], "code string, label string")
    return v.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == F.col("code"), "left").groupBy("code", "label").agg(F.count("o_orderkey").alias("n"))


@query("""SELECT x, CASE WHEN regexp_matches(trim(x), '^\\(.*\\)$') THEN -TRY_CAST(regexp_replace(trim(x), '[$,()\\s]', '', 'g') AS DOUBLE) ELSE TRY_CAST(regexp_replace(trim(x), '[$,()\\s]', '', 'g') AS DOUBLE) END AS n FROM (VALUES ('1,234'), ('(123)'), ('—'), ('$5'), (' $ (4,000.5) '), ('x'), (NULL)) t(x)""")
def clean_numbers(spark, d):
    df = spark.createDataFrame([(x,) for x in ("1,234", "(123)", "—", "$5", " $ (4,000.5) ", "x", None)], "x string")
    return df.select("x", text.clean_number(F.col("x")).alias("n"))


@query("""SELECT sentenceID, CAST(len(regexp_extract_all(sentence, '\\d+')) AS INTEGER) AS n_numbers, nullif(regexp_extract(sentence, '\\$([0-9.,]+)', 1), '') AS first_amount, regexp_replace(sentence, '[0-9]+', '#', 'g') AS masked FROM (SELECT DISTINCT sentenceID, sentence FROM v_sample_1m_core WHERE sentence IS NOT NULL)""")
def pattern_functions(spark, d):
    s = F.col("sentence")
    c = table(spark, d, "v_sample_1m_core").where("sentence is not null").select("sentenceID", "sentence").distinct()
    return c.select("sentenceID", F.regexp_count(s, F.lit(r"\d+")).alias("n_numbers"), F.nullif(F.regexp_extract(s, r"\$([0-9.,]+)", 1), F.lit("")).alias("first_amount"), F.regexp_replace(s, "[0-9]+", "#").alias("masked"))


@query("""SELECT question_id, s.t AS kind, s.n AS n_years, typeof(s.n) = 'BIGINT' AS is_long FROM (SELECT question_id, struct_pack(t := answer_type, n := CAST(len(years) AS BIGINT)) AS s FROM (SELECT DISTINCT question_id, answer_type, years FROM p3_gold_p3v3_new10 WHERE years IS NOT NULL))""")
def struct_fields(spark, d):
    q = table(spark, d, "p3_gold_p3v3_new10").where("years is not null").select("question_id", "answer_type", "years").distinct()
    q = q.select("question_id", F.struct(F.col("answer_type").alias("t"), F.size("years").cast("long").alias("n")).alias("s"))
    return q.select("question_id", F.col("s.t").alias("kind"), F.col("s.n").alias("n_years"), (F.typeof("s.n") == "bigint").alias("is_long"))


@query("""SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS micros_since FROM events""")
def step_durations(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(t) - F.lag(F.unix_micros(t)).over(w)).alias("micros_since"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 4) AS INTEGER) AS sliced FROM orders""")
def date_parts(spark, d):
    o = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(o, "yyyy-MM").alias("ym"), o.cast("date").alias("day"), F.year(o).alias("y"), F.substring(o.cast("date").cast("string"), 1, 4).try_cast("int").alias("sliced"))


@query("""SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) IS NULL AS none_finished, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_open, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0) / nullif(sum(o_totalprice), 0), 6) AS share FROM orders GROUP BY 1""")
def conditional_aggregates(spark, d):
    f = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(f.isNull().alias("none_finished"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.round(F.try_divide(F.coalesce(f, F.lit(0.0)), F.sum("o_totalprice")), 6).alias("share"))


@query("""SELECT metric, value FROM (SELECT 'core_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM v_sample_1m_core UNION ALL SELECT 'core_ids', CAST(count(DISTINCT sentenceID) AS DOUBLE) FROM v_sample_1m_core UNION ALL SELECT 'null_sentences', CAST(count(*) - count(sentence) AS DOUBLE) FROM v_sample_1m_core)""")
def report_rows(spark, d):
    from marlstone.operators.quality import report

    return report({"core_rows": F.count("*"), "core_ids": F.count_distinct("sentenceID"), "null_sentences": F.count_if(F.col("sentence").isNull())}, table(spark, d, "v_sample_1m_core"))
