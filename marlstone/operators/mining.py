"""Views of sentences for building question sets, and profiles of sections."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from marlstone.functions.text import AFTER, BEFORE

_W = lambda alt: f"(?i){BEFORE}({alt}){AFTER}"
# Labels by pattern, the first that fits counts.
KPI_LABELS = {
    "revenue": _W(r"net\s+sales|total\s+revenue|revenues?|sales"), "gross_margin": _W(r"gross\s+(profit|margin)"), "operating_income": _W(r"operating\s+(income|loss|margin)"), "net_income": _W(r"net\s+(income|loss)"),
    "eps": _W(r"earnings\s+per\s+share|eps"), "cash_from_ops": _W(r"cash\s+flows?|cash\s+provided\s+by\s+operating\s+activities"), "capex": _W(r"capital\s+expenditures?|capex"), "debt": _W("debt|borrowings|indebtedness"), "interest_expense": _W(r"interest\s+expense"),
}
RISK_CUES = _W("risk|uncertain|volatility|adverse|material adverse|disruption|default|covenant|liquidity|leverage|cyber|security|breach|litigation|regulatory|regulation|fine|sanction|pandemic|recession|downturn")
TOPIC_PATTERNS = {
    "regulatory": _W("regulatory|regulation|compliance|sec|doj|fines?|sanctions?"), "liquidity_credit": _W(r"liquidity|cash\s+flows?|refinanc(e|ing)|covenants?|default|going\s+concern"),
    "market_competitive": _W(r"competition|competitors?|market\s+share|pricing\s+pressure|volatility|macroeconomic"), "operational_supply_chain": _W(r"supply\s+chain|operations?|manufactur(e|ing)|facilities|disruptions?"),
    "cybersecurity_tech": _W(r"cyber|information\s+security|data\s+breach|unauthorized\s+access|ransomware"), "legal_ip_litigation": _W(r"litigation|lawsuits?|legal\s+proceedings?|claims?|patent|intellectual\s+property"),
}
CAUSAL = _W("due to|because|as a result of|resulted from|driven by|attributed to|primarily due to|primarily as a result of")
# Signals of figures and of change.
SIGNALS = {
    "currency": r"(?i)(\$|usd|us\$)\s?\d[\d,]*\.?\d*", "percent": rf"{BEFORE}\d{{1,3}}\.\d+%|{BEFORE}\d{{1,3}}%", "eps": _W("eps|earnings per share"), "units": "(?i)in (thousands|millions|billions)", "yoy": _W("year[- ]over[- ]year|yoy"), "growth": _W("increase[d]?|decrease[d]?|grew|declined"),
}
DEFINITION = _W("is defined as|are defined as|means|refers to|is calculated as|are calculated as|we define")


def first_label(text: Column, patterns: dict[str, str], other: str | None = None) -> Column:
    out = None
    for name, p in patterns.items():
        out = (F if out is None else out).when(text.rlike(p), name)
    return out.otherwise(F.lit(other))


def kpi_scan(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Sentences with a digit and a label: keep, kpi_label, is_percent, has_amount_cue, first_number_raw."""
    t = F.col(text)
    return df.where(t.rlike(r"\d")).withColumn("kpi_label", first_label(t, KPI_LABELS)).where("kpi_label is not null").select(
        *keep, "kpi_label", t.rlike("(?i)%|percent").alias("is_percent"), t.rlike(r"(?i)\$|usd|million|billion").alias("has_amount_cue"), F.nullif(F.regexp_extract(t, r"(\$?\d[\d,]*(\.\d+)?)", 1), F.lit("")).alias("first_number_raw"),
    )


def risk_atlas(df: DataFrame, text: str, section: str, keep: Sequence[str], marker: str = "ITEM_1A") -> DataFrame:
    """Sentences of the risk section with a cue: keep, risk_topic, risk_cue_count."""
    t = F.col(text)
    r = df.where(F.contains(F.upper(F.col(section)), F.lit(marker))).withColumn("risk_cue_count", F.regexp_count(t, F.lit(RISK_CUES)))
    return r.where("risk_cue_count > 0").select(*keep, first_label(t, TOPIC_PATTERNS, "general_risk").alias("risk_topic"), "risk_cue_count")


def counted(view: DataFrame, keys: Sequence[str], most: int | None = None, mean: str | None = None) -> DataFrame:
    """(keys, num_sentences, avg_cues): sentences of each key and, where asked, the mean of a column; the most frequent if most is given."""
    g = view.groupBy(*keys).agg(F.count("*").alias("num_sentences"), *([F.avg(mean).alias("avg_cues")] if mean else []))
    return g.orderBy(F.col("num_sentences").desc(), *(F.col(k).asc_nulls_last() for k in keys)).limit(most) if most else g


def trend_bundles(labelled: DataFrame, entity: Sequence[str], label: str, year: str, id_col: str, text: str, bundle: str, most: int = 5, least_years: int = 2) -> DataFrame:
    """(entity, topic_label, years, sentences, n_sentences, bundle_type) of labels that an entity explains in least_years and more.

    sentences holds the first most of them by year and id; they are ranked before they are gathered, so no bundle grows.
    """
    c = labelled.where(F.col(text).rlike(CAUSAL) & F.col(year).isNotNull())
    keys = [*entity, label]
    w = Window.partitionBy(*keys).orderBy(year, id_col)
    c = c.withColumn("_rn", F.row_number().over(w))
    g = c.groupBy(*keys).agg(F.array_sort(F.collect_set(year)).alias("years"), F.count("*").alias("n_sentences"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= most, F.struct(F.col(year).alias("year"), F.col(id_col).alias("id"), F.col(text).alias("text"))))).alias("sentences"))
    return g.where(F.size("years") >= least_years).withColumnRenamed(label, "topic_label").withColumn("bundle_type", F.lit(bundle))


def cross_company_bundles(labelled: DataFrame, entity: str, label: str, year: str, id_col: str, text: str, most: int = 5, least: int = 2) -> DataFrame:
    """(topic_label, year, n_companies, ids): labels that least companies and more explain in a year, one sentence each, most of them."""
    c = labelled.where(F.col(text).rlike(CAUSAL) & F.col(year).isNotNull())
    one = c.groupBy(F.col(label).alias("topic_label"), F.col(year).alias("year"), entity).agg(F.min(id_col).alias("id"))
    one = one.withColumn("_rn", F.row_number().over(Window.partitionBy("topic_label", "year").orderBy(entity)))
    g = one.groupBy("topic_label", "year").agg(F.count("*").alias("n_companies"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= most, F.col("id")))).alias("ids"))
    return g.where(F.col("n_companies") >= least)


def definitions(df: DataFrame, text: str, keys: Sequence[str], id_col: str) -> DataFrame:
    """(keys, id): sentences that define something, the smallest id of equal keys."""
    return df.where(F.col(text).rlike(DEFINITION)).groupBy(*keys).agg(F.min(id_col).alias("id"))


def signal_rates(df: DataFrame, section: str, text: str, patterns: dict[str, str] = SIGNALS) -> DataFrame:
    """(section, n, a rate for each pattern) over the sections' texts; rows without section or text are left out."""
    return df.where(F.col(section).isNotNull() & F.col(text).isNotNull()).groupBy(section).agg(F.count("*").alias("n"), *(F.avg(F.col(text).rlike(p).cast("double")).alias(n) for n, p in patterns.items()))


def length_profile(df: DataFrame, section: str, text: str, long: int = 1000) -> DataFrame:
    """(section, n, mean_chars, median_chars, p95_chars, n_table_like)."""
    n = F.length(text)
    return df.where(F.col(section).isNotNull() & F.col(text).isNotNull()).groupBy(section).agg(F.count("*").alias("n"), F.avg(n).alias("mean_chars"), F.median(n).cast("double").alias("median_chars"), F.percentile(n, 0.95).alias("p95_chars"), F.count_if(n > long).alias("n_table_like"))


def ngrams(text: Column) -> Column:
    """The words of two letters and more and their neighbours in pairs."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]{2,})"), F.lit(1))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def tfidf_terms(df: DataFrame, section: str, id_col: str, text: str, n: int = 15, min_df: int = 5, max_df: float = 0.6) -> DataFrame:
    """(section, term, score, rank): terms of one and two words by their mean tf-idf over a section's documents.

    idf = ln((1 + N) / (1 + df)) + 1 within the section, vectors have length 1; terms in fewer than min_df or more than
    max_df of a section's documents are out. Scores are rounded to nine places. Texts are shuffled once by document, as
    they are; counts and lengths of vectors follow within that partitioning, and only counts by term move again.
    """
    d = df.where(F.col(section).isNotNull() & F.col(text).isNotNull()).select(F.col(section).alias("section"), F.col(id_col).alias("doc"), F.col(text).alias("t")).repartition("section", "doc")
    tf = d.select("section", "doc", F.explode(ngrams(F.col("t"))).alias("term")).groupBy("section", "doc", "term").agg(F.count("*").alias("tf"))
    size = d.groupBy("section").agg(F.count_distinct("doc").alias("n_docs"))
    dfs = tf.groupBy("section", "term").agg(F.count("*").alias("df")).join(size, "section").where((F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * max_df))
    w = tf.join(dfs, ["section", "term"]).withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0))
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("section", "doc"))))
    score = w.groupBy("section", "term").agg(F.round(F.sum("w") / F.first("n_docs"), 9).alias("score"))
    return score.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(F.col("score").desc(), "term"))).where(F.col("rank") <= n)


def suggest_labels(terms: DataFrame, hints: dict[str, Sequence[str]]) -> DataFrame:
    """(section, label, hits): the label whose hint words most of a section's top terms hold, ties by label."""
    spark = terms.sparkSession
    h = spark.createDataFrame([(k, w) for k, ws in hints.items() for w in ws], "label string, hint string")
    hits = terms.crossJoin(F.broadcast(h)).where(F.contains("term", "hint")).groupBy("section", "label").agg(F.count("*").alias("hits"))
    return hits.withColumn("_rn", F.row_number().over(Window.partitionBy("section").orderBy(F.col("hits").desc(), "label"))).where("_rn = 1").drop("_rn")


def _simhashes(texts: list[bytes]) -> np.ndarray:
    n = np.array([max(0, len(t) - 4) for t in texts], dtype=np.int64)
    out, some = np.zeros(len(texts), dtype=np.uint64), np.flatnonzero(n)
    if not len(some):
        return out.view(np.int64)
    x = np.frombuffer(b"".join(texts[i] for i in some), dtype=np.uint8).astype(np.uint64)
    h = np.zeros(len(x) - 4, dtype=np.uint64)
    for k in range(5):
        h = (h ^ x[k : len(x) - 4 + k]) * np.uint64(0x100000001B3)
    n = n[some]
    heads = np.cumsum(n) - n
    h = h[np.arange(n.sum()) + np.repeat(4 * np.arange(len(n)), n)]  # a text's last four places start no run
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    for bit in range(64):
        ones = np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.int32), heads)
        out[some] |= (2 * ones > n).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """64-bit simhash over runs of five characters of the lower-cased text without repeated spaces; 0 for short or null."""
    flat, out, held, size = [" ".join((t or "").lower().split()).encode() for t in texts], [], [], 0
    for t in flat:  # some two million characters at a time
        held.append(t)
        size += len(t)
        if size > 2_000_000:
            out.append(_simhashes(held))
            held, size = [], 0
    out.append(_simhashes(held))
    return pd.Series(np.concatenate(out), dtype="int64")


def simhash_rate(df: DataFrame, section: str, id_col: str, text: str, most: int = 3) -> DataFrame:
    """(section, n, n_near, near_pct): texts with another of the section within most bits.

    Equal hashes are one representative with a count. The bits are cut into most + 2 blocks; two hashes within most bits
    agree in two of them at least, so each choice of two blocks is a key and no pair is missed.
    """
    h = df.where(F.col(section).isNotNull() & F.col(text).isNotNull()).select(F.col(section).alias("section"), simhash(F.col(text)).alias("h")).groupBy("section", "h").agg(F.count("*").alias("c"))
    n = most + 2
    cuts = [64 * i // n for i in range(n + 1)]
    parts = [F.shiftrightunsigned("h", a).bitwiseAND((1 << (z - a)) - 1) for a, z in zip(cuts, cuts[1:])]
    keys = F.array(*(F.struct(F.lit(i).alias("b"), F.xxhash64(*(parts[k] for k in some)).alias("v")) for i, some in enumerate(combinations(range(n), 2))))
    e = h.select("section", "h", F.inline(keys))
    pairs = e.alias("x").join(e.alias("y"), ["section", "b", "v"]).where((F.col("x.h") != F.col("y.h")) & (F.bit_count(F.col("x.h").bitwiseXOR(F.col("y.h"))) <= most))
    near = pairs.select("section", F.col("x.h").alias("h")).distinct().withColumn("near", F.lit(1))
    j = h.join(near, ["section", "h"], "left")
    return j.groupBy("section").agg(F.sum("c").alias("n"), F.sum(F.when((F.col("c") > 1) | F.col("near").isNotNull(), F.col("c")).otherwise(0)).alias("n_near")).withColumn("near_pct", F.col("n_near") * F.lit(100.0).cast("double") / F.col("n"))
