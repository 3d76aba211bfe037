import os

import pytest

from marlstone.llm import queries
from tests.compare import differs

FOLDER = os.environ.get("MARLSTONE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, name):
    assert differs(spark, FOLDER, queries.QUERIES[name], queries.SQL[name]) == ""


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, FOLDER).collect()]


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_defects_are_of_known_questions_once(spark):
    got = rows(spark, "p1_found")
    asked = {r[0] for r in table(spark, "p3_gold_p3v3_new10").select("question_id").collect()}
    ids = [r["question_id"] for r in got]
    assert got and len(set(ids)) == len(ids) and set(ids) <= asked
    assert {r["defect"] for r in got} <= {"empty", "truncated", "refusal", "copies_question", "other_language"}


def test_the_sample_has_its_quotas(spark):
    plan = {(r["temporal_bin"], r["section"]): r for r in rows(spark, "p2_plan")}
    drawn = rows(spark, "p2_sample")
    n = {}
    for r in drawn:
        k = r["temporal_bin"], r["section"]
        n[k] = n.get(k, 0) + 1
    assert all(n.get(k, 0) == r["quota"] <= r["available"] for k, r in plan.items()) and len({r["sentenceID"] for r in drawn}) > 0.9 * len(drawn) > 0


def test_groups_follow_from_the_pairs(spark):
    group = {}
    for r in rows(spark, "p3_groups"):
        group.setdefault(r["sentence_id"], set()).add(r["group_id"])
    pairs = rows(spark, "p3_found")
    assert pairs and all(group[r["sentence_id_a"]] & group[r["sentence_id_b"]] for r in pairs)


def test_matches_have_confidences(spark):
    got = rows(spark, "p5_matches")
    assert got and all(0.5 <= r["confidence"] <= 1 for r in got) and len({(r["cik"], r["identifier"]) for r in got}) == len(got)
    per = {}
    for r in got:
        per[r["identifier"]] = per.get(r["identifier"], 0) + r["confidence"]
    assert max(per.values()) <= 1 + 1e-9 and {(r["cik"], r["identifier"]) for r in rows(spark, "p5_found")} == {(r["cik"], r["identifier"]) for r in got}


def test_leaks_have_places(spark):
    got, found = rows(spark, "p6_matches"), rows(spark, "p6_found")
    assert got and {(r["doc_id"], r["item_id"]) for r in got} == {(r["doc_id"], r["item_id"]) for r in found}


def test_uses_give_the_shares(spark):
    uses, shares = rows(spark, "p7_uses"), {r["source"]: r for r in rows(spark, "p7_shares")}
    tokens = {}
    for r in uses:
        assert 0 <= r["uses"] <= shares[r["source"]]["repeats"]
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["uses"] * r["n_tokens"]
    largest = {s: max([r["n_tokens"] for r in uses if r["source"] == s], default=0) for s in shares}
    for s, r in shares.items():
        assert r["tokens"] == tokens.get(s, 0)
        assert abs(r["tokens"] - min(r["wanted"], r["held"] * r["repeats"])) <= 40 * largest[s] + 1e-6
    assert sum(r["share"] for r in shares.values()) == pytest.approx(1.0)


def test_every_document_has_statistics(spark):
    got, found = rows(spark, "p8_stats"), rows(spark, "p8_found")
    assert {r["doc_id"] for r in got} == {r[0] for r in table(spark, "documents").select("doc_id").collect()} and len(got) == table(spark, "documents").count()
    assert {(r["doc_id"], r["text_kind"]) for r in found} == {(r["doc_id"], r["text_kind"]) for r in got if r["text_kind"] != "prose"} and 0 < len(found) < len(got)
