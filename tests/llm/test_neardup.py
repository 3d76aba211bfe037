import random

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import neardup, wordscan


def brute(rows, t, least):
    import re

    s = [(i, d, frozenset(re.findall("[a-z0-9]+", x.lower()))) for i, d, x in rows if i is not None and d is not None and x is not None]
    s = [r for r in s if len(r[2]) >= least]
    return {tuple(sorted((a[0], b[0]))) for k, a in enumerate(s) for b in s[:k] if a[0] != b[0] and a[1] != b[1] and len(a[2] & b[2]) >= t * len(a[2] | b[2]) - 1e-12}


def made(seed, n=260):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            w = r.choice(rows)[2].split()
            for _ in range(r.randint(0, 6)):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = [r.choice(words + [f"rare{r.randrange(9999)}"])] if r.random() < 0.7 else []
                w = w or ["w0"]
            r.shuffle(w)
        else:
            w = [r.choice(words) for _ in range(r.choice([14, 20, 30, 45, 90]))]
        rows.append((f"s{i}", f"d{r.randrange(40)}", " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_pairs_are_those_of_brute_force(spark, seed, threshold):
    rows = made(seed)
    df = spark.createDataFrame(rows, "id string, doc string, text string")
    got = neardup.similar_pairs(df, "id", "doc", "text", threshold)
    assert {(r[0], r[1]) for r in got.collect()} == brute(rows, threshold, 12)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    plan = neardup.Plan(0.7, 12)
    rows = made(7, 120)
    number = pa.array([x for _, _, x in rows])
    row, words = neardup.distinct_words(number)
    n = np.bincount(row)
    keep = {i for i, k in enumerate(n) if k >= 12}
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), number], names=["a", "b", "c"])
    sets = next(neardup._sets(iter([batch]), 12))
    rec = np.empty(sets.num_rows, dtype=neardup.ROW)
    rec["sig"], rec["kb"], rec["kl"], rec["sk"] = 5, sets.column(2).to_numpy().view(np.uint64), sets.column(3).to_numpy(), sets.column(4).to_numpy()
    blob = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([rec.tobytes()], pa.binary())], names=["bucket", "blob"])
    monkeypatch.setattr(neardup, "BUCKET_MOST", 1 << 30)
    whole = {tuple(p) for b in neardup._compare(iter([blob]), plan) for p in zip(*(b.column(i).to_pylist() for i in range(4)))}
    monkeypatch.setattr(neardup, "BUCKET_MOST", 16)
    monkeypatch.setattr(neardup, "BLOCK", 9)
    work = [pa.RecordBatch.from_arrays([b.column(5), b.column(6)], names=["x", "y"]) for b in neardup._compare(iter([blob]), plan)]
    parts = {tuple(p) for b in neardup._work(iter(work), plan) for p in zip(*(b.column(i).to_pylist() for i in range(4)))}
    assert parts == whole and len(keep) == sets.num_rows and len(whole) > 5


def test_edges(spark):
    t = " ".join(f"word{k}" for k in range(14))
    rows = [("a", "1", t), ("b", "2", t), ("b", "2", t), ("c", "2", t.upper() + "!"), ("d", None, t), (None, "3", t), ("e", "4", None), ("f", "5", ""), ("g", "6", "short"), ("h", "7", t + " more"), ("long", "8", "x " * 50_000), ("big", "9", " ".join(f"y{k}" for k in range(3000))), ("big2", "10", " ".join(f"y{k}" for k in range(2990)))]
    df = spark.createDataFrame(rows, "id string, doc string, text string")
    got = {(r[0], r[1]): r[2] for r in neardup.similar_pairs(df, "id", "doc", "text").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("a", "h"), ("b", "h"), ("c", "h"), ("big", "big2")} and got["a", "b"] == 1.0
    assert neardup.similar_pairs(df.limit(0), "id", "doc", "text").count() == 0
    g = {r["id"]: (r["group_id"], r["links"]) for r in neardup.near_duplicate_groups(df, "id", "text").collect()}
    assert g["a"] == g["b"] and g["a"][0] == g["h"][0] and "g" not in g and g["h"][1] == 1 and g["big"][0] == g["big2"][0]
    assert neardup.near_duplicate_groups(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.93])
def test_sketch_bounds_hold_for_all_sizes(threshold):
    plan = neardup.Plan(threshold, 12)
    compare, n = neardup._Compare(plan), np.arange(12, 700)
    code = neardup.size_code(n).astype(int)
    assert (compare.least[code] <= n).all() and (n <= compare.most[code]).all()
    a, b = np.meshgrid(n, n)
    ca, cb = np.meshgrid(code, code)
    can = plan.overlap(a, b) <= np.minimum(a, b)
    assert compare.fits[ca, cb][can].all() and (plan.distance(a, b) <= compare.allowed[ca, cb])[can].all()
    k = np.arange(64)
    assert all((compare.allowed[: i + 1, : j + 1] <= compare.top[i, j]).all() for i in k for j in k)


@pytest.mark.parametrize("sizes", [(14, 15), (36, 49), (46, 53), (59, 84)])
def test_pairs_at_the_bound_are_compared(sizes):
    plan = neardup.Plan(0.7, 12)
    both, texts = plan.overlap(*sizes), []
    for k in range(40):
        texts += [" ".join([*(f"c{k}x{i}" for i in range(both)), *(f"o{k}x{i}x{size}" for i in range(size - both))]) for size in sizes]
    ids = pa.array([f"s{i}" for i in range(len(texts))])
    sets = next(neardup._sets(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["a", "b", "c"])]), 12))
    rec = np.zeros(len(texts), dtype=neardup.ROW)
    rec["kb"], rec["kl"], rec["sk"] = sets.column(2).to_numpy().view(np.uint64), sets.column(3).to_numpy(), sets.column(4).to_numpy()
    compare = neardup._Compare(plan)
    got = {tuple(p) for ij in compare.block(rec, rec, True) for p in ij.T.tolist()}
    assert {(i, i + 1) for i in range(0, len(texts), 2)} <= got


def test_batches_of_copies_only():
    texts = pa.array([f"{' '.join(f'word{k}' for k in range(14))} own{i % 2}" for i in range(4)])
    ids = pa.array([f"s{i}" for i in range(4)])
    sets = next(neardup._sets(iter([pa.RecordBatch.from_arrays([ids, ids, texts], names=["a", "b", "c"])]), 12)).select(["kb", "kl", "sk", "words"])
    counts = type("Sent", (), {"value": np.full(1 << neardup.CELL_BITS, 4)})
    emitted = lambda batches: [b.to_pydict() for b in neardup._emit(iter(batches), counts, 4, neardup.Plan(0.7, 12), 3)]
    first = emitted([sets.slice(0, 2)])
    assert first and emitted([sets.slice(0, 2), sets.slice(2, 2), sets.slice(0, 1)]) == first


def joined(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = {}
    for x in list(root):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("seed", [4, 5])
def test_groups_follow_from_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(i if r.random() < 0.9 else f"s{r.randrange(260)}", r.choice([f"d{r.randrange(3)}", f"d{r.randrange(3)}", None]), t) for i, _, t in made(seed)]
    rows += [(f"c{k}", r.choice([d, d, None]), t) for k, (_, d, t) in enumerate(r.choices(rows, k=60))]
    df = spark.createDataFrame(rows, "id string, doc string, text string")
    of = {}
    for x in neardup.near_duplicate_groups(df, "id", "text", 0.7, doc_col="doc").collect():
        of.setdefault(x["group_id"], set()).add(x["id"])
    assert {frozenset(g) for g in of.values() if len(g) > 1} == joined(brute(rows, 0.7, 12))


def test_rows_of_one_document_are_no_group(spark):
    t, u = (" ".join(f"{c}{k}" for k in range(14)) for c in "tu")
    rows = [("a", "1", t), ("b", "1", t), ("c", "1", t + " more"), ("n", None, t), ("x", "1", u), ("y", "1", u), ("z", "2", u + " more"), ("n", None, u)]
    g = {(r["id"], r["class_id"]): r for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "id string, doc string, text string"), "id", "text", doc_col="doc").collect()}
    of = {}
    for (i, _), r in g.items():
        of.setdefault(r["group_id"], set()).add(i)
    assert sorted(map(sorted, of.values())) == [["a"], ["b"], ["c"], ["n"], ["n"], ["x", "y", "z"]]
    assert sorted((i, r["links"]) for (i, _), r in g.items()) == [("a", 0), ("b", 0), ("c", 0), ("n", 0), ("n", 0), ("x", 1), ("y", 1), ("z", 1)]


def test_components_of_paths_and_stars(spark):
    edges = [(f"p{i}", f"p{i + 1}") for i in range(30)] + [("c", f"x{i}") for i in range(20)] + [("z", "y"), ("q", "q")]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"p{i}"] for i in range(31)} == {"p0"} and {got[f"x{i}"] for i in range(20)} == {"c"} and got["z"] == got["y"] == "y"


def test_words_like_the_pattern():
    import re

    texts = ["Hello, World-12.5%", None, "", "É1a b", "x" * 70_000, "İstanbul K"]
    number, row, start, end = wordscan.scan(pa.array(texts))
    for i, t in enumerate(texts[:5]):
        want = re.findall("[a-z0-9]+", (t or "").lower())
        assert [int(x) for x in number[row == i]] == [wordscan.number_of(w) for w in want]
    assert len(number[row == 0]) == 4 and (end > start).all()
