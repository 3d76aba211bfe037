"""Small fixtures with values worked out by hand, and the edges: nulls, ties, repeated rows, empty tables, clashing names."""

import datetime

import pytest
from pyspark.sql import functions as F, types as T

from marlstone.functions import dates, text
from marlstone.operators import context, curation, evaluation, flags, ingest, kpi, merge, mining, orphans, quality, sampling, vectors
from marlstone.operators import entities as ent


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_allocation_of_the_published_case(spark):
    pops = spark.createDataFrame([("bin_2016_2020", 654096), ("bin_2010_2015", 814696), ("bin_2006_2009", 483913)], "temporal_bin string, population long")
    got = {r["temporal_bin"]: (r["target_n"], r["allocation_mode"]) for r in sampling.allocate(pops, sampling.Budget(1_000_000, "bin_2016_2020", {"bin_2010_2015": 0.6, "bin_2006_2009": 0.4})).collect()}
    assert got == {"bin_2016_2020": (654096, "MODERN_FULL_PLUS_OLDER"), "bin_2010_2015": (207542, "MODERN_FULL_PLUS_OLDER"), "bin_2006_2009": (138362, "MODERN_FULL_PLUS_OLDER")}


def test_sampling_takes_one_of_each_stratum_and_is_reproducible(spark):
    df = spark.createDataFrame([(f"s{i}", "b", 1 if i < 8 else 2, 2010) for i in range(9)], "id string, temporal_bin string, cik int, year int")
    a = spark.createDataFrame([("b", 9, 2, "x")], "temporal_bin string, population long, target_n long, allocation_mode string")
    one = rows(sampling.stratified_ids(df, a, ["cik", "year"], "id"), "id")
    assert one == rows(sampling.stratified_ids(df.orderBy(F.desc("id")), a, ["cik", "year"], "id"), "id")
    assert sorted(r[2] for r in one) == [1, 1, 2]
    assert sampling.stratified_ids(df.limit(0), a, ["cik", "year"], "id").count() == 0


CASES = [
    ("Revenue increased 15% to $2.3 billion in 2019.", 2019, {"likely_kpi", "has_numbers", "mentions_years", "is_recent"}, 6),
    ("We expect significant growth versus the prior year.", 2017, {"has_forward_looking", "has_comparison", "is_material"}, 4),
    ("This forward-looking statement is subject to risk and uncertainty.", 2020, {"is_recent", "has_risk_language", "is_safe_harbor"}, -1),
    ("The Company was incorporated in Delaware.", 2008, set(), 0),
    ("Total  assets were 1,234,567 at year end.", 2018, {"has_numbers", "is_table_like", "is_recent"}, 3),
    (None, None, set(), 0),
]


def test_flags_and_score(spark):
    df = spark.createDataFrame([(c[0], c[1], i) for i, c in enumerate(CASES)], "sentence string, report_year int, i int")
    for r in flags.with_flags(df, "sentence", "report_year").collect():
        _, _, names, score = CASES[r["i"]]
        assert {k for k in flags.flags(F.lit(""), F.lit(1)) if r[k]} == names, CASES[r["i"]]
        assert r["retrieval_signal_score"] == score


def test_bins_positions_numbers(spark):
    df = spark.createDataFrame([(2009, "x_section_1A_45", "1,234"), (2010, "x_x", "(123)"), (2021, "x_40000", "—"), (2005, None, "$5"), (None, "", None)], "y int, s string, n string")
    got = [tuple(r) for r in df.select(dates.temporal_bin(F.col("y")), text.position_of(F.col("s")), text.clean_number(F.col("n"))).collect()]
    assert got == [("bin_2006_2009", 45, 1234.0), ("bin_2010_2015", -1, -123.0), ("bin_2021_2025", -1, None), ("bin_unknown", -1, 5.0), ("bin_unknown", -1, None)]


def test_compact_figures(spark):
    df = spark.createDataFrame([(394328000000.0, "r"), (17.0, "p"), (0.545, "q"), (None, "r"), (-2500.0, "r")], "v double, k string")
    got = [r[0] for r in df.select(text.compact_money(F.col("v"), percent=F.col("k") == "p", ratio=F.col("k") == "q")).collect()]
    assert got == ["$394.3B", "17.0%", "0.55", None, "-$2.5K"]


def test_window_starts_at_zero(spark):
    facts = spark.createDataFrame([("g", i, f"t{i}") for i in range(10)], "g string, pos int, t string")
    for pos, want in ((5, range(2, 9)), (9, range(6, 10)), (0, range(0, 4))):
        hits = spark.createDataFrame([("h", "g", pos)], "hit string, g string, pos int")
        assert [r["pos"] for r in context.expand(hits, facts, ["g"], "pos", 3, keep=["t"]).orderBy("pos").collect()] == list(want)
    assert context.expand(hits.limit(0), facts, ["g"], "pos", 3).count() == 0


def test_hit_dedupe(spark):
    h = spark.createDataFrame([("s1", "e1", 0.3, "filtered", 0), ("s1", "e1", 0.2, "global", 0), ("s1", "e2", 0.25, "filtered", 1)], "s string, e string, distance double, source string, variant_id int")
    assert rows(vectors.dedupe_hits(h, ["s", "e"]), "e") == [("s1", "e1", 0.2, ["filtered", "global"], [0]), ("s1", "e2", 0.25, ["filtered"], [1])]


@pytest.mark.parametrize(("filtered", "global_", "want"), [(40, 20, (23, 7)), (10, 40, (10, 20)), (5, 3, (5, 3))])
def test_proportional(spark, filtered, global_, want):
    h = [(1, i, i / 100, ["filtered"]) for i in range(filtered)] + [(1, 100 + i, i / 100, ["global"]) for i in range(global_)]
    got = vectors.proportional(spark.createDataFrame(h, "q int, id long, distance double, sources array<string>"), "q", 30)
    n = {r[0]: r[1] for r in got.groupBy("primary_source").count().collect()}
    assert (n.get("filtered", 0), n.get("global", 0)) == want


def test_top_k_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [2.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id long, query array<float>")
    assert [(r["id"], r["rank"]) for r in vectors.top_k(v, q, 5).orderBy("rank").collect()] == [(1, 1), (6, 2), (2, 3)]
    assert vectors.top_k(v.limit(0), q, 5).count() == 0 and vectors.top_k(v, q.limit(0), 5).count() == 0


def test_filters_reject_what_they_do_not_know(spark):
    with pytest.raises(ValueError):
        vectors.compile_filter({"nope": 1}, ["a"])
    with pytest.raises(ValueError):
        vectors.compile_filter({"a": {"$near": 1}}, ["a"])
    df = spark.createDataFrame([(1,), (5,), (None,)], "a int")
    assert df.where(vectors.compile_filter({"$or": [{"a": {"$gte": 3}}, {"a": {"$in": [1]}}]}, ["a"])).count() == 2


def test_merge_keeps_the_increment(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    inc = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    merged, stats = merge.incremental_merge(base, inc, ["k"], ["v"])
    assert rows(merged, "k") == [("a", 1), ("b", 9), ("c", 3)] and stats.first()["duplicates_removed"] == 1
    assert rows(merge.incremental_merge(merged, inc, ["k"], ["v"])[0], "k") == rows(merged, "k")
    assert rows(merge.upsert(merge.upsert(base, inc, ["k"]), inc, ["k"]), "k") == rows(merged, "k")
    assert merge.upsert(base.limit(0), inc, ["k"]).count() == 2


def test_align_with_clashing_names(spark):
    df = spark.createDataFrame([("1", "x", "y")], "ID string, Text string, other string")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("extra", T.ArrayType(T.StringType()))])
    assert rows(merge.align(df, schema)) == [(1, "x", None)]
    assert rows(merge.align(df.withColumn("ID", F.lit("bad")), schema))[0][0] is None


def test_schema_diff_and_next_ids(spark):
    a = merge.schema_rows(spark.createDataFrame([], "a int, s struct<x: int>"))
    assert {r["column_name"] for r in a.collect()} == {"a", "s", "s.x"}
    base = spark.createDataFrame([(7, "q")], "id long, k string")
    assert rows(merge.next_ids(spark.createDataFrame([("b",), ("a",)], "k string"), base, "id", "k"), "id") == [("a", 8), ("b", 9)]


def test_quality_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, y int, h string, b boolean")
    got = {r["check_name"]: r["passed"] for r in quality.quality_score(df, ["k"], "k", "y", (2000, 2030), "h", ["b"]).collect()}
    assert got["quality_score"] is False
    assert quality.profile(df).count() == 4
    full = spark.createDataFrame([("a", 2001, "h1", "TRUE"), ("b", 2002, "h2", "FALSE")], "k string, y int, h string, b string")
    assert quality.quality_score(full, ["k"], "k", "y", (2000, 2030), "h", ["b"]).where("check_name = 'quality_score'").first()["value"] == 100.0


def test_trend_and_coverage(spark):
    f = spark.createDataFrame([("a", 2020, 100.0), ("a", 2023, 200.0), ("b", 2020, -1.0), ("b", 2021, 5.0), ("c", 2020, 1.0)], "e string, y int, v double")
    got = {r["e"]: r for r in kpi.trend(f, ["e"], "y", "v").collect()}
    assert (got["a"]["change"], got["a"]["change_pct"], round(got["a"]["cagr_pct"], 6), got["a"]["direction"]) == (100.0, 100.0, 25.992105, "Strong Growth")
    assert got["b"]["cagr_pct"] is None and "c" not in got
    assert [r["e"] for r in kpi.yoy(f, ["e"], "y", "v").collect()] == ["a"]
    g = spark.createDataFrame([("t1", 1), ("t1", 2), ("t2", 1), ("t2", 2)], "t string, y int")
    facts = spark.createDataFrame([("t1", 1, 1.0), ("t1", 2, 2.0), ("t2", 1, None)], "t string, y int, v double")
    assert rows(kpi.lookup_stats(kpi.lookup(g, facts, ["t", "y"], "v"))) == [(4, 3, 2, 1, 1, 50.0)]


def test_gated_merge(spark):
    old = spark.createDataFrame([("a", 2019, 1.0), ("a", 2020, 2.0), ("a", 2021, 3.0)], "e string, y int, v double")
    new = spark.createDataFrame([("a", 2020, 9.0), ("a", 2021, 8.0)], "e string, y int, v double")
    assert rows(kpi.gated_merge(old, new, "y", 2, 5, 5)[0], "y") == [("a", 2019, 1.0), ("a", 2020, 9.0), ("a", 2021, 8.0)]
    assert kpi.gated_merge(old, new, "y", 2, 5, 6)[1] is False
    with pytest.raises(ValueError):
        kpi.gated_merge(old, new.drop("v"), "y", 2, 5, 5)


def test_years_metrics_sections(spark):
    assert ent.years_of("from 2015-2018", 2025) == [2015, 2016, 2017, 2018]
    assert ent.years_of("between 2020 and 2018", 2025) == [2018, 2019, 2020]
    assert ent.years_of("2030 and 2031", 2025) == [2030] and ent.years_of(None, 2025) == []
    assert ent.metrics_of("what is net income and revenu in 2024") == ["Net Income", "Revenue"]
    df = spark.createDataFrame([("Item 7A and the balance sheet",), ("cyber attacks",), (None,)], "t string")
    assert [r[0] for r in df.select(ent.sections(F.col("t"))).collect()] == [["ITEM_8", "ITEM_7A"], ["ITEM_1A"], []]


def test_companies_in_questions(spark):
    u = spark.createDataFrame([(320193, "AAPL", "Apple Inc"), (789019, "MSFT", "Microsoft Corp"), (1045810, None, "Nvidia Corp")], "cik long, ticker string, company_name string")
    q = spark.createDataFrame([(1, "How did AAPL do?"), (2, "microsft in 2019"), (3, "CIK 1045810 and Microsoft Corp"), (4, None), (5, "")], "question_id int, question_text string")
    got = {(r["question_id"], r["cik"], r["found_by"]) for r in ent.companies(q, u).collect()}
    assert got == {(1, 320193, "ticker"), (2, 789019, "fuzzy"), (3, 1045810, "cik"), (3, 789019, "name")}
    assert ent.question_entities(q, u.limit(0), 2025).count() == 5


def test_sentences():
    assert ingest.split_sentences("Sales rose in the U.S. by 3.5% in 2019. Mr. Smith left. It fell.") == ["Sales rose in the U.S. by 3.5% in 2019.", "Mr. Smith left.", "It fell."]
    t = ingest.strip_html("<p>Item 1. Business</p><p>We sell &amp; buy.</p><table><tr><td>1</td><td>2</td></tr></table><script>x()</script>")
    assert ingest.sections_of(t) == [("1", "We sell & buy.")]
    assert ingest.normal_text("donâ€™t \x00 x") == "don't x" and ingest.strip_html(None) == ""


def test_staging(spark):
    s = ingest.split_documents(spark.createDataFrame([("d", "Item 1. Business\nWe sell things."), ("e", None)], "k string, t string"), "k", "t")
    f = spark.createDataFrame([("d", "1234", "N", "2024-12-31", "2025-02-01", None)], "doc_key string, cik string, name string, period string, filing_date string, sic string")
    r = ingest.staging(s, f).first()
    assert (r["cik"], r["report_year"], r["temporal_bin"], r["sentenceID"]) == ("0000001234", 2024, "bin_2021_2025", "0000001234_10-K_2024_section_1_0")


def test_orphans_of_all_kinds(spark):
    t = lambda m, d=1: datetime.datetime(2024, m, d)
    refs = spark.createDataFrame([("q1", " a\t", t(3)), ("q1", "B", t(3)), ("q2", "c", t(3)), ("q3", "d", t(3)), ("q4", "d", None), ("q5", " ", t(3)), ("q6", None, t(3)), ("q7", "e", t(3, 2)), ("q8", "e", t(3, 9)), ("q1", "A", t(3))], "ref_key string, key string, at timestamp").withColumn("period", orphans.month(F.col("at")))
    parents = spark.createDataFrame([("a", t(1)), ("d", t(5)), ("D ", t(6)), ("e", t(3, 5)), ("e", None)], "key string, at timestamp")
    gone = spark.createDataFrame([("C",), ("c",), ("a",), (None,)], "key string")
    got = {(r["ref_key"], r["missing_id"], r["orphan_kind"]) for r in orphans.orphans(refs, parents, gone).collect()}
    assert got == {("q1", "B", "missing"), ("q2", "C", "deleted"), ("q3", "D", "late"), ("q7", "E", "late")}
    assert orphans.orphans(refs.limit(0), parents, gone).count() == 0
    assert orphans.orphans(refs, parents.limit(0), gone.limit(0)).count() == 7


def test_orphans_against_brute_force(spark):
    import random

    r = random.Random(3)
    refs = [(f"r{i % 40}", f"k{r.randrange(3 if i % 3 == 0 else 60)}", datetime.datetime(2024, r.randint(1, 6), r.randint(1, 28)) if r.random() > 0.1 else None) for i in range(400)]
    par = [(f"K{r.randrange(60)} ", datetime.datetime(2024, r.randint(1, 6), r.randint(1, 28))) for _ in range(45)]
    gone = [(f"k{r.randrange(60)}",) for _ in range(20)]
    first: dict = {}
    for k, at in par:
        k = k.strip().upper()
        first[k] = min(first.get(k, at), at)
    removed, want = {g[0].upper() for g in gone}, set()
    for ref, k, at in refs:
        k = k.upper()
        if k not in first:
            want.add((ref, k, "deleted" if k in removed else "missing"))
        elif at is not None and first[k] > at:
            want.add((ref, k, "late"))
    df = spark.createDataFrame(refs, "ref_key string, key string, at timestamp").withColumn("period", orphans.month(F.col("at")))
    got = orphans.orphans(df, spark.createDataFrame(par, "key string, at timestamp"), spark.createDataFrame(gone, "key string"), expected_keys=100_000)
    assert {(x["ref_key"], x["missing_id"], x["orphan_kind"]) for x in got.collect()} == want


def test_tfidf_and_simhash(spark):
    docs = [("s", i, "alpha beta gamma delta epsilon" if i % 2 else f"zeta eta theta iota word{i}") for i in range(20)]
    df = spark.createDataFrame(docs, "section string, id int, t string")
    top = mining.tfidf_terms(df, "section", "id", "t", 3, min_df=2, max_df=0.6)
    assert top.count() == 3 and top.where("score <= 0").count() == 0
    near = mining.simhash_rate(df, "section", "id", "t").first()
    assert near["n"] == 20 and near["n_near"] >= 10
    assert mining.tfidf_terms(df.limit(0), "section", "id", "t").count() == 0 and mining.simhash_rate(df.limit(0), "section", "id", "t").count() == 0


def test_simhash_pairs_are_those_of_brute_force(spark):
    import random

    r = random.Random(6)
    docs = []
    for i in range(150):
        w = docs[r.randrange(len(docs))][2].split() if docs and r.random() < 0.6 else [f"word{r.randrange(200)}" for _ in range(60)]
        if r.random() < 0.7:
            w[r.randrange(len(w))] = "x"
        docs.append(("s" if i % 2 else "t", i, " ".join(w)))
    df = spark.createDataFrame(docs, "section string, id int, t string")
    h = [(x["section"], x["id"], x["h"]) for x in df.select("section", "id", mining.simhash(F.col("t")).alias("h")).collect()]
    want = {s: sum(any(s == b[0] and i != b[1] and ((v ^ b[2]) & (2**64 - 1)).bit_count() <= 3 for b in h) for z, i, v in h if z == s) for s in "st"}
    assert {x["section"]: x["n_near"] for x in mining.simhash_rate(df, "section", "id", "t").collect()} == want and sum(want.values()) > 5


def test_answer_scores(spark):
    df = spark.createDataFrame([("What is revenue?", "Revenue was $5 billion in 2020.", "Revenue was $5 billion", ["revenue was $5 billion", "profit of nine"]), ("q", None, "t", ["a"])], "q string, r string, t string, f array<string>")
    a, b = evaluation.answer_scores(df, "q", "r", "t", "f").select("factual", "completeness", "overall").collect()
    assert a["factual"] == 0.5 and a["completeness"] == 1.0 and b["overall"] == 0.0
    assert [round(r[0], 6) for r in df.select(evaluation.rouge_l("r", "t")).collect()][1] == 0.0


def test_retrieval_ranks_ignore_the_query_itself(spark):
    hits = spark.createDataFrame([(1, 1, 1), (1, 5, 2), (1, 7, 3), (2, 9, 1)], "query_id int, id int, rank int")
    gold = spark.createDataFrame([(1, 5)], "query_id int, id int")
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    s = evaluation.retrieval_scores(evaluation.ranks(hits, gold, q)).first()
    assert (s["n"], s["self_at_1"], s["hit_at_1"], s["mrr_at_5"]) == (2, 0.5, 0.5, 0.5)


def test_two_tier_and_dimension(spark):
    facts = spark.createDataFrame([(1, "Old", 2010, ["A"]), (1, "New", 2012, ["B", None]), (2, None, 2011, None), (None, "x", 2011, ["Z"])], "k int, n string, y int, t array<string>")
    dim = curation.entity_dimension(facts, "k", "n", "y", "t")
    assert rows(dim.select("k", "latest_name", "all_codes"), "k") == [(1, "New", ["A", "B"]), (2, None, [])]
    targets = spark.createDataFrame([("t1", 1, None), ("t2", 9, "b "), ("t3", None, "q")], "id string, key int, code string")
    got = curation.two_tier_match(targets, dim, "key", "code", "k", "all_codes", "last_seen", "id")
    assert rows(got.select("id", "matched_key", "match_tier"), "id") == [("t1", 1, 1), ("t2", 1, 2), ("t3", None, None)]


def test_search_and_filter_passes_over_copies(spark):
    v = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(40)] + [(100 + i, [1.0, 0.5 + i / 10]) for i in range(3)] + [(200, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    attributes = spark.createDataFrame([(i, "copy") for i in range(40)] + [(100 + i, f"t{i}") for i in range(3)] + [(200, "far")], "id long, text string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    got = vectors.search_and_filter(v, q, 3, attributes, F.lit(True), 1.0, "text")
    assert [r["id"] for r in got.orderBy("rank").collect()] == [0, 100, 101]


def test_near_words_lose_none(spark):
    from marlstone.operators import entities

    names = ["microsoft", "internationalbusiness", "weyerhaeuser", "supercalifragilistic", "abcdefghijklmn"]
    words = ["microsotf", "mcirosoft", "internationalbusines", "xnternationalbusinesy", "intrnatonalbusiness", "weyerhauser", "upercalifragilisticx", "xbcdefghijklmy", "unrelated", "abcd"]
    got = {tuple(r) for r in entities._near_words(spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame([(n,) for n in names], "first string"), 0.85).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(w, n) for w in words for n in names if w != n and 1 - edits(w, n) / max(len(w), len(n)) >= 0.85}
    assert got == want and ("xbcdefghijklmy", "abcdefghijklmn") in want


def test_simhash_is_that_of_single_texts(spark):
    from marlstone.operators import mining

    texts = ["Revenue grew by 12% in 2019.", "", None, "abcd", "abcde", "x" * 5000, "Revenue  grew by 12% in 2019. "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(map(tuple, df.select("i", mining.simhash("t")).collect()))
    assert got[0] == got[6] != 0 and got[1] == got[2] == got[3] == 0 and got[4] != 0
    assert all(int(mining._simhashes([" ".join((t or "").lower().split()).encode()])[0]) == got[i] for i, t in enumerate(texts))


def test_alias_sum_and_search(spark):
    from marlstone.operators import kpi

    f = spark.createDataFrame([("a", 1, "Cash", 2.0), ("a", 1, " cash ", 3.0), ("a", 1, "Debt", 4.0), ("a", 2, "Cash", None), ("b", None, "Cash", 1.0)], "e string, y int, label string, v double")
    assert {tuple(r) for r in kpi.sum_by_alias(f, "e", "y", "label", "v", ["cash", "Debt"], "s").collect()} == {("a", 1, 7.0), ("a", 2, None)}
    g = spark.createDataFrame([("Current Ratio",), ("Quick ratio",), ("Debt",), (None,)], "metric string")
    assert [r[0] for r in kpi.search(g, "RATIO", n=1).collect()] == ["Quick ratio"] and kpi.search(g, "ratio").count() == 2


def test_batches_by_group(spark):
    from pyspark.sql import functions as F

    from marlstone.operators import vectors

    df = spark.createDataFrame([(i, None if i == 3 else 40 if i != 5 else 500) for i in range(10)], "k long, t long")
    got = {r["key"]: r["batch"] for r in vectors.greedy_batches(df, "k", "t", 3, 100, group=F.floor(F.col("k") / 6)).collect()}
    assert got == {0: "0-0", 1: "0-0", 2: "0-1", 3: "0-1", 4: "0-1", 5: None, 6: "1-0", 7: "1-0", 8: "1-1", 9: "1-1"}
