import random

import pytest

from marlstone.llm import matching, quality

PROSE = "Management noted that the plant would close at the end of the year. Sales fell by 3.1% to $4.2 million as demand for parts declined, although the company raised its prices."
WRAPPED = "Management noted that the plant would\nclose at the end of the year. Sales fell\nby 3.1% to $4.2 million as demand for\nparts declined."
NOISE = "M{nagement n*ted th#t t}e pl~nt w0uld cl|se at th^ en< of the y~ar. S#les f{ll by 3|1% to $4;2 m*llion as d}mand for p#rts d~clined"
rnd = random.Random(2)
KINDS = [
    (PROSE, "prose"), (WRAPPED, "prose"), (PROSE.upper(), "prose"), ("• " + PROSE, "prose"), ("<p>" + PROSE + "</p>", "prose"), ("Analyst 2: " + PROSE + "\n\nOperator: " + PROSE, "prose"), (PROSE * 60, "junk"),
    ("Der Konzern erklärt den Rückgang durch die Zinsen. Die Leitung erwartet für das Jahr mit dem neuen Werk keine Änderung.", "prose"), ("La dirección atribuye el aumento a la demanda en la región. El consejo no espera cambios para el año.", "prose"),
    ("A | 2019 | 2018\nNet sales | 4,210 | 3,900\nCosts | (120) | 99\nTotal | 1,000 | 900", "table"), (",2019,2018\nNet sales,29,213,17,502\nCosts,30,965,17,772\nTotal,80,508,64,585", "table"), ("\t2010\t2009\nNet sales\t96908\t43010\nCosts\t83882\t(72348)", "table"),
    ("Pumps\n- steel valves\n- copper pipes\n- rubber seals\n- glass plates", "list"), ("Note 1 Sales\nNote 2 Costs\nNote 3 Leases\nNote 4 Taxes", "list"), ("Exhibit 80.1  Form of lease\nExhibit 66.2  Form of deed\nExhibit 18.3  Form of note", "list"), ("steel valves;\ncopper pipes;\nrubber seals;", "list"),
    (None, "junk"), ("", "junk"), ("  \n", "junk"), (NOISE, "junk"), ("[image omitted]\n" * 20, "junk"), ("quotas " * 50, "junk"), ("%$#! @@~^ *&%$ ##!@ ^^~~ %%$$", "junk"), ("".join(rnd.choice("abcXYZ019+/") for _ in range(400)), "junk"),
    (".c1{margin:3px;color:#2e3}\n.c2{margin:2px;color:#e12}\n.c3{margin:9px;color:#ffb}", "junk"), ("preferred vessels metered quarterly trials permits cylinders vaccines grievances options seismic tenants plates " * 1 + "copper valves pipes rubber glass steel seals plates boards lamps", "junk"),
    ("00000000  2d 97 b9 b6 8f 86 0a 55\n00000010  e5 58 6a 07 30 c0 af 51", "junk"), (PROSE + "\n\nA | 2019\nSales | 4,210", "prose"),
]


@pytest.mark.parametrize(("text", "kind"), KINDS)
def test_kinds(text, kind):
    import pyarrow as pa

    (b,) = quality._stats(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text], pa.string())], names=["a", "b"])]))
    assert b.column("text_kind").to_pylist() == [kind]


def test_letters_set_apart_are_near_no_language():
    import numpy as np
    import pyarrow as pa

    german = "Der Konzern erklärt den Rückgang durch die Zinsen und die Leitung erwartet für das Jahr mit dem neuen Werk keine Änderung. " * 3
    texts = ["     ".join(" ".join(w) for w in (PROSE * 2).split()), PROSE * 3, german]
    (b,) = quality._stats(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], names=["a", "b"])]))
    assert b.column("text_kind").to_pylist() == ["junk", "prose", "prose"]
    far = b.column("language_divergence").to_pylist()
    assert far[0] > 0.7 > max(far[1:]) and np.isnan(quality.language_divergences(np.zeros((1, len(quality._VOCABULARY))))).all()


def test_statistics_of_a_table(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(KINDS)] + [(99, "word " * 100_000), (99, None)], "doc_id long, text string")
    got = quality.text_statistics(df).collect()
    assert len(got) == len(KINDS) + 2
    r = next(x for x in got if x["doc_id"] == 0)
    assert r["n_words"] == len(PROSE.split()) and 0 < r["common_words"] < 1 and r["prose_share"] == 1.0 and r["ended_lines"] == 1.0
    assert quality.text_statistics(df.limit(0)).count() == 0


def test_names():
    assert matching.normal_name("THE Acme-Power & Sons P.L.C. CL A") == (["ACME", "POWER", "SONS"], "PLC")
    assert matching.normal_name("Acme Power L P  /DE/") == (["ACME", "POWER"], "LP") and matching.normal_name("ACME POWER CORP (THE)-A") == (["ACME", "POWER"], "CORP") and matching.normal_name(None) == ([], "")
    assert matching.alike("PPTYS", "PROPERTIES") > 0.8 and matching.alike("SVCS", "SERVICES") > 0.8 and matching.alike("HLODRAMIR", "HOLDRAMIR") > 0.8 and matching.alike("STEEL", "POWER") == 0
    assert matching.deletions("ABCDE") & matching.deletions("ABDCE") and matching.ticker_root(" abc.b ") == "ABC" and matching.ticker_root(None) is None


def test_matches_of_invented_companies(spark):
    r = random.Random(8)
    part = ["tor", "vel", "mir", "kul", "zan", "hol", "fen", "ras", "bri", "cor", "nal", "gra"]
    trade = ["Power", "Steel", "Realty", "Software", "Freight", "Chemical", "Storage"]
    comp, hold, want = [], [], set()
    for i in range(260):
        name = "".join(r.choice(part) for _ in range(3)).capitalize()
        kind, form = r.choice(trade), r.choice(["Inc", "Corp", "PLC", "L P"])
        t = "".join(r.choice("ABCDEFGHJK") for _ in range(4))
        comp.append((1000 + i, t if r.random() < 0.9 else None, f"{name} {kind} Holdings {form}"))
        if i % 3 == 0:
            w = list(name)
            k = r.randrange(1, len(w) - 1)
            if r.random() < 0.3:
                w[k], w[k + 1] = w[k + 1], w[k]
            hold.append((f"H{i}", t if r.random() < 0.7 else None, f"{''.join(w)} {kind} {r.choice(['HLDGS', 'Holdings'])} {form}".upper()))
            want.add((1000 + i, f"H{i}"))
    names = {c[2].split()[0] for c in comp}
    hold += [(f"X{i}", comp[i][1], "Quorbex Mining Trust") for i in range(1, 10)] + [("N", None, None), ("H0", hold[0][1], hold[0][2])]
    c = spark.createDataFrame(comp + comp[:5], "cik long, ticker string, company_name string")
    h = spark.createDataFrame(hold, "identifier string, ticker string, company_name string")
    got = {(x["cik"], x["identifier"]) for x in matching.match(c, h).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.03 * len(want) and len(names) > 200
    assert matching.match(c.limit(0), h).count() == 0 and matching.match(c, h.limit(0)).count() == 0


def test_names_without_a_rare_token_are_matched(spark):
    r = random.Random(9)
    part = ["tor", "vel", "mir", "kul", "zan", "hol", "fen", "ras", "bri", "cor", "nal", "gra"]
    comp = [(1000 + i, None, "".join(r.choice(part) for _ in range(3)).capitalize() + f" {r.choice(['Power', 'Steel', 'Realty'])} Inc") for i in range(200)]
    hold = [(f"H{i}", None, comp[i][2].upper()) for i in range(0, 200, 3)]
    words = ["First", "National", "Bancorp", "United", "Savings", "Community"]
    banks = [f"{x} {y} {z}" for x in words for y in words for z in words if len({x, y, z}) == 3][::6]
    comp += [(2000 + i, None, f"{b} Inc") for i, b in enumerate(banks)]
    hold += [(f"B{i}", "OLD", f"{b.upper()} INC") for i, b in enumerate(banks)]
    short = ["3M Co", "HP Inc", "GE"]
    comp += [(3000 + i, None, n) for i, n in enumerate(short)]
    hold += [(f"S{i}", None, n.upper()) for i, n in enumerate(short)]
    c = spark.createDataFrame(comp, "cik long, ticker string, company_name string")
    h = spark.createDataFrame(hold, "identifier string, ticker string, company_name string")
    got = {(x["cik"], x["identifier"]) for x in matching.match(c, h, threshold=0.0).select("cik", "identifier").collect()}
    assert {(2000 + i, f"B{i}") for i in range(len(banks))} <= got
    assert {(3000 + i, f"S{i}") for i in range(len(short))} <= got
    # a frequent word that is misspelt beside another, and one alone
    h = h.union(spark.createDataFrame([("E", None, "FIRST NATOINAL"), ("F", None, "Bancorp")], h.schema))
    got = {x["identifier"] for x in matching.match(c, h, threshold=0.0).select("identifier").collect()}
    assert {"E", "F"} <= got


def test_a_pair_near_in_one_name_dimension_only_is_held_down():
    import numpy as np

    m = matching.Mixture()
    m.mean = np.array([[0.98, 1.0, 0.95, 0.9, 0.8], [0.6, 0.3, 0.3, 0.5, 0.3]])
    m.cov = np.array([np.eye(5) * 0.03, np.eye(5) * 0.08])
    m.share = 0.8
    x = np.array([[1.0, 0.4, 0.5, 1.0, 1.0], [0.5, 1.0, 1.0, 1.0, 1.0], [0.97, 0.95, 0.9, 1.0, 1.0]])
    assert m.dominates(x).tolist() == [False, False, True]
    assert (m.posterior(x, np.arange(3)) >= 0.5).tolist() == [False, False, True]


def test_every_ticker_of_a_holding_counts():
    v = matching.vector(["ACME"], [2.0], ["AAA", "ZZZ"], "", ["ACME"], [2.0], ["ZZZ"], "")
    assert v[3] == 1.0 and matching.vector(["ACME"], [2.0], ["AAA"], "", ["ACME"], [2.0], ["ZZZ"], "")[3] == matching.UNLIKE
    assert matching.vector(["ACME"], [2.0], [], "", ["ACME"], [2.0], ["ZZZ"], "")[3] == 0.5


def test_candidates_hold_what_all_pairs_give(spark):
    """Every pair of company and holding that the fitted mixture takes for a match is among the candidates, but for 1 % at most."""
    import math
    import os
    from collections import defaultdict

    import numpy as np

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    comp, hold = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("sec_company_tickers", "spy_holdings_15oct"))
    best = matching.candidates(comp, hold)
    model = matching.fit(best.where("keyed"))
    have = {(r["cid"], r["hid"]) for r in best.select("cid", "hid").collect()}

    def named(df, key):
        out = defaultdict(set)
        for r in df.where(f"{key} is not null and company_name is not null").collect():
            toks, legal = matching.normal_name(r["company_name"])
            if toks:
                out[str(r[key]), tuple(toks), legal].add(matching.ticker_root(r["ticker"]))
        return {k: sorted(t for t in v if t) for k, v in out.items()}

    c, h = named(comp, "cik"), named(hold, "identifier")
    df = defaultdict(set)
    for i, toks, _ in c:
        for t in toks:
            df[t].add((i, toks))
    total = len({k[0] for k in c})
    weight = lambda toks: [math.log(1 + total / (len({x for x in df.get(t, ())}) + 1)) for t in toks]
    found = set()
    for (hid, ht, hl), h_tickers in h.items():
        rows = [((cid, hid), matching.vector(list(ht), weight(ht), h_tickers, hl, list(ct), weight(ct), c_tickers, cl)) for (cid, ct, cl), c_tickers in c.items()]
        g = model.posterior(np.array([v for _, v in rows]), np.array([0]))
        found |= {k for (k, _), p in zip(rows, g) if p >= 0.5}
    share = len(found & have) / len(found)
    print(f"candidates hold {share:.4f} of {len(found)} matches over all {len(c) * len(h)} pairs")
    assert share >= 0.99 and len(found) > 40
