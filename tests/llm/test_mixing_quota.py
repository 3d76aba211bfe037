import collections
import os
import random

import pytest

from marlstone.llm import mixing, quota

needs_vocabulary = pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="no vocabulary")


def test_pivot_keeps_the_sum_and_the_expectation():
    total = collections.Counter()
    for seed in range(400):
        done, held = mixing.pivot([(i, 1, 0.3, "s", 10) for i in range(7)], seed, 0)
        assert sum(r[1] for r in done) + (held[1] + held[2] if held else 0) == pytest.approx(7 + 2.1)
        for r in done + ([held] if held else []):
            total[r[0]] += r[1] + r[2]
    assert all(abs(total[i] / 400 - 1.3) < 0.08 for i in range(7))


@needs_vocabulary
def test_mix_reaches_shares_and_reports_shortfalls(spark):
    docs = [(i, "some words of text " * (1 + i % 5), ("Web Pages", "web-pages ", "books", None, "other")[i % 5]) for i in range(300)] + [(900, None, "books"), (901, "  ", "books"), (902, "word " * 40_000, "books")]
    target = spark.createDataFrame([("web_pages", 0.2, 3), ("books", 0.3, 1), ("absent", 0.5, 4), ("books", 0.3, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(11)
    uses, report = mixing.mix(df, target, 100_000)
    by = {r["source"]: r for r in report.collect()}
    assert by["absent"]["short"] and by["absent"]["tokens"] == 0 and not by["books"]["short"] and by["web_pages"]["short"]
    u = uses.collect()
    assert len(u) == 120 + 61 and {r["uses"] for r in u if r["source"] == "web_pages"} == {3} and max(r["uses"] for r in u if r["source"] == "books") <= 1
    assert sorted(map(tuple, u)) == sorted(map(tuple, mixing.mix(df, target, 100_000)[0].collect()))
    small = mixing.mix(df, target, 2_000)[1].where("source = 'web_pages'").first()
    largest = max(r["n_tokens"] for r in u if r["source"] == "web_pages")
    assert abs(small["tokens"] - 400) <= 3 * largest
    assert mixing.mix(df.limit(0), target, 1000)[0].count() == 0 and mixing.mix(df, target, None)[1].where("short").count() == 0


@needs_vocabulary
def test_pieces_change_no_count():
    e = mixing.encoder(mixing.VOCABULARY)
    t = "Some text, with  spaces\n and numbers 12345. " * 50
    assert "".join(mixing._pieces(t, 100)) == t and sum(len(e.encode_ordinary(p)) for p in mixing._pieces(t, 100)) == len(e.encode_ordinary(t))


def test_quotas_meet_what_they_can():
    r = random.Random(4)
    cells = [(b, s, 1 / 60, r.choice([0, 3, 40, 100])) for b in "abc" for s in range(20)]
    got = quota.quotas(cells, 1000, 5)
    assert all(x[5] == max(0, x[2] - x[3]) and x[4] <= x[3] for x in got)
    free = quota.quotas([(b, s, 1 / 6, 1000) for b in "ab" for s in range(3)], 600, 5)
    assert [x[4] for x in free] == [100.0] * 6 and not any(x[5] for x in free)
    assert quota.quotas([], 10, 1) == [] and quota.rounded([], 1) == []


def test_rounding_is_controlled_and_fair():
    r = random.Random(1)
    cells = [(b, s, r.random() * 5) for b in "abcd" for s in range(6)]
    total = collections.Counter()
    for seed in range(600):
        w = quota.rounded(cells, seed)
        assert all(int(q) <= k <= int(q) + 1 for (_, _, q), k in zip(cells, w))
        for key in ("abcd", range(6)):
            for v in key:
                at = [i for i, c in enumerate(cells) if v in c[:2]]
                assert abs(sum(w[i] for i in at) - sum(cells[i][2] for i in at)) < 1
        total.update({i: k for i, k in enumerate(w)})
    assert max(abs(total[i] / 600 - c[2]) for i, c in enumerate(cells)) < 0.09


def test_plan_and_draw(spark):
    rows = [(f"s{i}", ("Bin A", "bin-a ", "BIN_A", "bin_b", None)[i % 5], i % 3 if i % 11 else None) for i in range(3000)] * 2
    df = spark.createDataFrame(rows, "sentenceID string, temporal_bin string, section int")
    t = spark.createDataFrame([("bin_a", 0, 0.5), ("bin_a", 1, 0.2), ("bin_b", 2, 0.3), ("bin_c", 0, 0.0), (None, 1, 0.1)], "temporal_bin string, section int, target_share double")
    p = quota.plan(df, t, 600, 5)
    got = {(r["row_name"], r["column"]): r for r in p.collect()}
    assert len(got) == 4 and got["bin_b", 2]["shortfall"] == max(0, 180 - got["bin_b", 2]["available"]) and got["bin_c", 0]["shortfall"] == 5
    drawn = quota.draw(df, p)
    n = {(r["row"], r["column"]): r["count"] for r in drawn.groupBy("row", "column").count().collect()}
    assert all(n.get((r["row"], r["column"]), 0) == r["quota"] for r in p.collect()) and drawn.distinct().count() == drawn.count()
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, quota.draw(df.repartition(5), p).collect()))
    assert quota.draw(df.limit(0), p).count() == 0 and quota.plan(df.limit(0), t, 600, 5).where("shortfall > 0").count() == 4
