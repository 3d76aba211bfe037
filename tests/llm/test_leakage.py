import random
import re

from marlstone.llm import leakage


def brute(docs, items, width=13):
    def grams(t):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    g = [(i, grams(t)) for i, t in items]
    return {(d, i) for d, t in docs for i, x in g if grams(t) & x}


def test_against_brute_force(spark):
    r = random.Random(5)
    words = [f"v{k}" for k in range(40)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([5, 13, 40])))) for i in range(12)] + [(99, None), (98, "")]
    docs = []
    for d in range(60):
        t = [r.choice(words) for _ in range(30)]
        if d % 2:
            w = items[r.randrange(12)][1].split()
            n = r.choice([12, 13, 20])
            k = r.randrange(max(1, len(w) - n + 1))
            t[10:10] = [x.upper() + r.choice(["", ",", "\r\n"]) for x in w[k : k + n]]
        docs.append((d, " ".join(t)))
    docs += [(100, None), (101, ""), (1, docs[1][1]), (102, "x " * 100_000)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    got = leakage.leaks(a, b).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == brute(docs, items) and len(got) == len({(x["doc_id"], x["item_id"]) for x in got}) > 5
    assert leakage.leaks(a.limit(0), b).count() == 0 and leakage.leaks(a, b.limit(0)).count() == 0


def test_offsets_are_of_the_original_text(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    text = "É ünïcode — " + item.upper().replace(" ", ",  ") + "! End"
    a = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = leakage.leaks(a, spark.createDataFrame([(7, item)], "item_id long, item_text string")).collect()
    assert r["n_words"] == 14 and re.findall(r"\w+", text[r["start_char"] : r["end_char"]].lower()) == item.lower().split()


def test_many_items_take_several_automata(spark, monkeypatch):
    monkeypatch.setattr(leakage, "AUTOMATON_WORDS", 30)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(9)]
    docs = [(i, "before " + t + " after") for i, t in items]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i) for i in range(9)}
