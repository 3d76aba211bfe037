"""Matching entities of two sources without a common key: Gaussian mixtures with transitivity.

Names are cut into tokens; candidates share a rare token up to one edit, a ticker, or the whole name run together. Where
either name has no rare token, any token they share up to one edit makes them candidates, however frequent or short.
Each candidate pair becomes a vector of similarities. Two Gaussians, matched and unmatched, are fitted without labels to
the vectors of all candidates but the last kind, which may be many and unlike, and judge those too; their
covariances are regularised. In each E step the posteriors of one holding's candidates are brought into agreement
with transitivity: companies with different keys are different, so a holding can be the same as one of them at most.
Every iteration is one pass over the vectors that returns sums only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

# Legal forms and their spellings.
LEGAL = {"INC": "INC", "INCORPORATED": "INC", "CO": "CO", "COMPANY": "CO", "CORP": "CORP", "CORPORATION": "CORP", "LTD": "LTD", "LIMITED": "LTD", "PLC": "PLC", "LP": "LP", "LLC": "LLC", "LLP": "LLP", "SA": "SA", "NV": "NV", "AG": "AG", "SE": "SE", "GMBH": "GMBH", "TRUST": "TRUST", "SPA": "SPA"}
_CLASS = re.compile(r"(?:[\s,-]+(?:CL(?:ASS)?|SER(?:IES)?)\.?[\s-]*[A-K]|[\s,-]+(?:SHS|COM|COMMON(?: STOCK)?|ORD|ADR|ADS|NPV|REIT|UNITS?)|-[A-K]|(?<=[A-Z.)]{2})[\s,]+[A-K])\s*$")
_STATE = re.compile(r"\s*[/\\](?:NEW|ADR|FI|[A-Z]{2,4})[/\\]?\s*$|\s*\((?:THE|NEW)\)\s*")
#: Tickers go out of date and are mixed up, so unlike ones say less than like ones; a missing one counts 0.5.
UNLIKE = 0.35
#: Pairs whose name, holding and company similarities have this mean start as matches.
ALIKE = 0.85
DIMENSIONS = ("name", "holding", "company", "ticker", "legal")


def normal_name(name: str | None) -> tuple[list[str], str]:
    """(tokens, legal form) of a company name in any source's way of writing."""
    s = re.sub(r"\s+", " ", (name or "").upper()).strip()
    for _ in range(3):
        s = _STATE.sub(" ", s).strip()
        s = _CLASS.sub("", s).strip()
    s = re.sub(r"^THE\s+|[,\s]+THE$", "", s)
    s = re.sub(r"(?<=\b\w)\.(?=\w\b)", "", s).replace("&", " AND ")
    toks = re.findall(r"[^\W_]+", re.sub(r"['’.]", "", re.sub(r"\b(\w)\. ?(?=\w\.)", r"\1", s)))
    s = " ".join(toks)
    s = re.sub(r"\bLIMITED PARTNERSHIP$", "LP", s)
    s = re.sub(r"\bL P$", "LP", s)
    s = re.sub(r"\bP L C$", "PLC", s)
    toks, legal = s.split(), ""
    while len(toks) > 1 and toks[-1] in LEGAL:
        legal = LEGAL[toks.pop()]
    return [t for t in toks if t not in ("AND", "OF", "THE")], legal


def ticker_root(t: str | None) -> str | None:
    """A ticker without exchange, share class and the marks of bankruptcy."""
    s = re.sub(r"[^A-Z]+", " ", (t or "").upper()).split()
    return s[0] if s else None


def deletions(w: str) -> set[str]:
    """The word and what is left of it without any one character; words one edit or swap apart share one."""
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) >= 5 else {w}


def distance(a: str, b: str) -> int:
    """Edits and swaps of neighbours between two words."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def alike(h: str, c: str) -> float:
    """How well a holding's token stands for a company's: equal, misspelt, cut off, an initial or an abbreviation."""
    if h == c:
        return 1.0
    if len(h) < len(c) and c.startswith(h):
        return 0.95 if len(h) >= 3 else 0.85
    near = abs(len(h) - len(c)) <= 2 and min(len(h), len(c)) >= 4
    if near:
        d = distance(h, c)
        if d <= 1 or d == 2 and len(c) >= 9:
            return 1 - d / max(len(h), len(c))
    if 2 <= len(h) <= len(c) - 2 and h[0] == c[0]:
        for w in (h, h.replace("Y", "I")):  # PPTYS for PROPERTIES
            it = iter(c)
            if all(x in it for x in w):
                return 0.85
    return 0.0


def vector(ht: list[str], hw: list[float], h_tickers: list[str], h_legal: str, ct: list[str], cw: list[float], c_tickers: list[str], c_legal: str) -> list[float]:
    """The similarities of DIMENSIONS for one candidate pair."""
    order = sorted(range(len(ct)), key=lambda i: -cw[i])
    used, got, sure = set(), 0.0, 0.0
    for i in order:
        best = max(((alike(ht[j], ct[i]), -j) for j in range(len(ht)) if j not in used), default=(0.0, 0))
        if best[0] > 0:
            used.add(-best[1])
            got += cw[i] * best[0]
    main = ct[order[0]] if order else ""
    name = max((1 - distance(h, main) / max(len(h), len(main)) for h in ht), default=0.0) if main else 0.0
    name = max(name, max((0.9 for h in ht if len(h) >= 5 and main.startswith(h)), default=0.0))
    sure = sum(w for j, w in enumerate(hw) if j in used)
    all_h, all_c = sum(hw), sum(cw)
    ticker = 0.5
    if h_tickers and c_tickers:
        ticker = 1.0 if any(h == t or (h[:1] == "Z" and h[-1:] == "Q" and h[1:-1] == t) or (len(h) == len(t) + 1 and h[:-1] == t) for h in h_tickers for t in c_tickers) else UNLIKE
    legal = 0.5 if not h_legal or not c_legal else float(h_legal == c_legal)
    return [name, sure / all_h if all_h else 0.0, got / all_c if all_c else 0.0, ticker, legal]


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [normal_name(n) for n in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.string()), pa.array([ticker_root(t) for t in b.column(2).to_pylist()], pa.string())], names=["id", "tokens", "legal", "ticker"])


def _keys(batches: Iterator[pa.RecordBatch], rare: int) -> Iterator[pa.RecordBatch]:
    """(id, key): rare tokens (n), tickers (t), the whole name run together (w), all tokens (f)."""
    for b in batches:
        out = []
        for i, toks, dfs, tickers in zip(*(b.column(k).to_pylist() for k in range(4))):
            keys = {f"n {v}" for t, d in zip(toks, dfs) if d <= rare for v in deletions(t)} | {f"t {t}" for t in tickers if t}
            keys |= {f"w {''.join(toks)}"} | {f"f {v}" for t in toks for v in deletions(t)}
            keys |= {f"t {t[1:-1]}" for t in tickers if t and len(t) > 3 and t[0] == "Z" and t[-1] == "Q"} | {f"t {t[:-1]}" for t in tickers if t and len(t) > 3}
            out += [(i, k) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["id", "key"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [vector(*r) for r in zip(*(b.column(k).to_pylist() for k in range(2, 10)))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(10), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(5))], names=["cid", "hid", "keyed", *DIMENSIONS])


class Mixture:
    """Two Gaussians and the share of matches; covariances carry ridge on their diagonal.

    The first M step takes pairs for matches whose three name similarities are ALIKE on the mean, so the means and
    covariances come from the data from the start; rounds and converged tell how the fit ended.
    """

    def __init__(self, ridge: float = 0.01):
        self.share, self.ridge, self.rounds, self.converged = 0.1, ridge, 0, False
        self.mean, self.cov = np.zeros((2, 5)), np.array([np.eye(5), np.eye(5)])

    @staticmethod
    def first(x: np.ndarray) -> np.ndarray:
        return (x[:, :3].mean(axis=1) >= ALIKE).astype(float)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = []
        for m, c in zip(self.mean, self.cov):
            d = x - m
            out.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
        return out[0] - out[1] + math.log(self.share / (1 - self.share))

    def posterior(self, x: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Posteriors after transitivity; heads are the first rows of the holdings, whose candidates stand together."""
        o = self.log_odds(x)
        o = np.where(self.dominates(x), o, np.minimum(o, -2.0))
        size = np.diff(np.r_[heads, len(x)])
        top = np.repeat(np.maximum(np.maximum.reduceat(o, heads), 0), size)
        e = np.exp(o - top)
        return e / (np.repeat(np.add.reduceat(e, heads), size) + np.exp(-top))

    def dominates(self, x: np.ndarray) -> np.ndarray:
        """Gaussians cross again at their tails; a pair that lies nearer the unmatched mean in either name dimension is held down."""
        mid = (self.mean[0] + self.mean[1]) / 2
        return (x[:, 0] >= mid[0]) & (x[:, 1] >= mid[1])

    def update(self, sums: list[tuple]) -> None:
        for k in range(2):
            n = sum(s[k][0] for s in sums)
            if n < 1e-9:
                continue
            m = sum(s[k][1] for s in sums) / n
            self.mean[k] = m
            self.cov[k] = sum(s[k][2] for s in sums) / n - np.outer(m, m) + self.ridge * np.eye(5)
        match, every = sum(s[0][0] for s in sums), sum(s[0][0] + s[1][0] for s in sums)
        self.share = min(0.9, max(1e-4, match / max(every, 1e-9)))


def _heads(hid: list) -> np.ndarray:
    return np.array([i for i in range(len(hid)) if i == 0 or hid[i] != hid[i - 1]], dtype=int)


def _matrix(batch) -> np.ndarray:
    return np.stack([batch.column(d).to_numpy(zero_copy_only=False) for d in DIMENSIONS], axis=1)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole holdings; a holding may reach over batches."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        hid = t.column("hid").to_pylist()
        k = len(hid) - 1
        while k > 0 and hid[k - 1] == hid[k]:
            k -= 1
        if k:
            yield t.slice(0, k)
        held = t.slice(k)
    if held is not None:
        yield held


_SUMS = [f"s{i}" for i in range(62)]


def fit(pairs: DataFrame, rounds: int = 25) -> Mixture:
    """Expectation-maximisation over pairs, which stand sorted by holding within their partitions; 62 sums come back a round."""
    model = Mixture()
    for k in range(rounds):

        def step(batches: Iterator[pa.RecordBatch], model=model, begin=k == 0) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 31))
            for t in _whole(batches):
                x = _matrix(t)
                g = model.first(x) if begin else model.posterior(x, _heads(t.column("hid").to_pylist()))
                for i, w in enumerate((g, 1 - g)):
                    total[i] += np.r_[w.sum(), w @ x, ((x * w[:, None]).T @ x).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total.ravel().tolist()], names=_SUMS)

        got = pairs.mapInArrow(step, ", ".join(f"{c} double" for c in _SUMS)).agg(*(F.sum(c) for c in _SUMS)).first()
        s = np.array([v or 0.0 for v in got]).reshape(2, 31)
        before = model.mean.copy()
        model.update([tuple((s[i, 0], s[i, 1:6], s[i, 6:].reshape(5, 5)) for i in range(2))])
        model.rounds, model.converged = k + 1, bool(np.abs(model.mean - before).max() < 1e-4)
        if model.converged:
            break
    return model


def candidates(companies: DataFrame, holdings: DataFrame) -> DataFrame:
    """(cid, hid, keyed, similarities): the pairs that are compared, each once with its best spellings, sorted by holding
    within partitions and persisted; keyed tells those that share a rare token, a ticker or the whole name."""
    rows = lambda df, key: df.select(F.col(key).cast("string").alias("id"), F.col("company_name").alias("name"), "ticker").where("id is not null and name is not null").distinct().mapInArrow(_named, "id string, tokens array<string>, legal string, ticker string")
    one = rows(companies, "cik").where("size(tokens) > 0").groupBy("id", "tokens", "legal").agg(F.collect_set("ticker").alias("tickers"))
    two = rows(holdings, "identifier").where("size(tokens) > 0").groupBy("id", "tokens", "legal").agg(F.collect_set("ticker").alias("tickers"))
    df = one.select("id", F.explode(F.array_distinct("tokens")).alias("token")).distinct().groupBy("token").agg(F.count("*").alias("df")).persist(StorageLevel.MEMORY_AND_DISK)
    total = max(1, one.select("id").distinct().count())
    rare = max(3, round(0.003 * total))

    def weighted(side: DataFrame) -> DataFrame:
        t = side.withColumn("k", F.xxhash64("id", "tokens", "legal")).select("id", "legal", "tickers", "k", F.posexplode("tokens").alias("pos", "token")).join(df, "token", "left")
        g = t.groupBy("id", "k", "legal").agg(F.first("tickers").alias("tickers"), F.array_sort(F.collect_list(F.struct("pos", "token", F.coalesce("df", F.lit(0)).alias("df")))).alias("all"))
        g = g.select("id", "k", "legal", "tickers", F.col("all.token").alias("tokens"), F.col("all.df").alias("dfs"))
        return g.withColumn("weights", F.transform("dfs", lambda d: F.log(F.lit(1.0) + F.lit(float(total)) / (d + 1.0)))).persist(StorageLevel.MEMORY_AND_DISK)

    one, two = weighted(one), weighted(two)
    keys = lambda side: side.select(F.col("k").cast("string").alias("id"), "tokens", "dfs", "tickers").mapInArrow(lambda it: _keys(it, rare), "id string, key string").distinct()
    a, b = (keys(side).withColumnRenamed("id", i).persist(StorageLevel.MEMORY_AND_DISK) for side, i in ((one, "ck"), (two, "hk")))
    bare = lambda x, i: x.where("key like 'f %'").join(x.where("key like 'n %'").select(i).distinct(), i, "left_anti")
    met = lambda x, y, keyed: x.join(y, "key").select("ck", "hk", F.lit(keyed).alias("keyed"))
    linked = met(a.where("key not like 'f %'"), b, True).union(met(bare(a, "ck"), b, False)).union(met(a, bare(b, "hk"), False))
    linked = linked.groupBy("ck", "hk").agg(F.max("keyed").alias("keyed"))
    c = one.select(F.col("k").cast("string").alias("ck"), F.col("id").alias("cid"), F.col("tokens").alias("ct"), F.col("weights").alias("cw"), F.col("tickers").alias("c_tickers"), F.col("legal").alias("c_legal"))
    h = two.select(F.col("k").cast("string").alias("hk"), F.col("id").alias("hid"), F.col("tokens").alias("ht"), F.col("weights").alias("hw"), F.col("tickers").alias("h_tickers"), F.col("legal").alias("h_legal"))
    pairs = linked.join(c, "ck").join(h, "hk").select("cid", "hid", "ht", "hw", "h_tickers", "h_legal", "ct", "cw", "c_tickers", "c_legal", "keyed")
    vectors = pairs.mapInArrow(_vectors, "cid string, hid string, keyed boolean, " + ", ".join(f"{d} double" for d in DIMENSIONS))
    best = vectors.groupBy("cid", "hid").agg(F.max(F.struct((F.col("name") + F.col("holding") + F.col("company")).alias("s"), *DIMENSIONS)).alias("b"), F.max("keyed").alias("keyed")).select("cid", "hid", "keyed", *(F.col(f"b.{d}").alias(d) for d in DIMENSIONS))
    return best.repartition("hid").sortWithinPartitions("hid", "cid").persist(StorageLevel.MEMORY_AND_DISK)


def match(companies: DataFrame, holdings: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(cik, identifier, confidence): pairs whose posterior reaches the threshold, each once.

    companies has cik, ticker, company_name, holdings identifier, ticker, company_name, both with repeated rows.
    A holding or company of several spellings counts with each. Null names have no tokens and match nothing.
    """
    best = candidates(companies, holdings)
    keyed = best.where("keyed")
    model = fit(keyed if keyed.take(1) else best)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            g = model.posterior(_matrix(t), _heads(t.column("hid").to_pylist()))
            for x in pa.table({"cik": t.column("cid").cast(pa.int64()), "identifier": t.column("hid"), "confidence": pa.array(g), **{d: t.column(d) for d in DIMENSIONS}}).to_batches():
                yield x

    scored = best.mapInArrow(score, "cik long, identifier string, confidence double, " + ", ".join(f"{d} double" for d in DIMENSIONS))
    return scored.where(F.col("confidence") >= threshold)
