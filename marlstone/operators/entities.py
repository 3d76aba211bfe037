"""Companies, years, sections, risk topics and metrics named in questions; questions come as a table."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.functions.text import similarity

# Phrases that point to a section.
SECTION_KEYWORDS = {
    "ITEM_1": ["business description", "business overview", "company overview", "products and services", "market segments", "business strategy"],
    "ITEM_1A": ["risk factors", "key risks", "risk factor section", "forward looking statements", "forward-looking statements", "uncertainties"],
    "ITEM_2": ["properties", "facilities", "real estate"],
    "ITEM_3": ["legal proceedings", "litigation", "legal matters"],
    "ITEM_4": ["mine safety", "mine safety disclosures"],
    "ITEM_5": ["market for registrant common equity", "stock market data", "share repurchases", "dividends", "stock performance"],
    "ITEM_6": ["selected financial data", "multi-year financial summary"],
    "ITEM_7": ["md&a", "mda", "mdna", "management discussion and analysis", "management's discussion and analysis", "results of operations", "operating results", "liquidity and capital resources", "capital resources", "liquidity", "outlook"],
    "ITEM_7A": ["market risk", "quantitative and qualitative disclosures about market risk", "interest rate risk", "foreign currency risk", "fx risk", "commodity price risk"],
    "ITEM_8": ["financial statements", "audited financial statements", "balance sheet", "income statement", "statement of operations", "statement of cash flows", "cash flow statement", "supplementary data"],
    "ITEM_9": ["changes in and disagreements with accountants", "changes in accountants"],
    "ITEM_9A": ["controls and procedures", "internal controls", "icfr", "sox 404", "internal control over financial reporting"],
    "ITEM_9B": ["other information"],
    "ITEM_10": ["directors and executive officers", "corporate governance", "board of directors"],
    "ITEM_11": ["executive compensation", "compensation discussion and analysis"],
    "ITEM_12": ["security ownership", "beneficial ownership"],
    "ITEM_13": ["related party transactions", "related transactions"],
    "ITEM_14": ["auditor fees", "principal accountant fees"],
    "ITEM_15": ["exhibits and financial statement schedules", "exhibit index"],
    "ITEM_16": ["10-k summary", "form 10-k summary"],
}
# Sections in order of priority; others follow by name.
SECTION_PRIORITY = ("ITEM_7", "ITEM_8", "ITEM_1A", "ITEM_1", "ITEM_7A")
# Phrases of each risk topic.
RISK_TOPICS = {
    "liquidity_credit": ["liquidity", "cash flow", "cash flows", "cash position", "capital resources", "capital structure", "refinancing", "refinance", "credit facility", "credit facilities", "revolving credit", "covenant", "covenants", "default", "debt maturity", "going concern", "solvency"],
    "regulatory": ["regulatory", "regulation", "regulations", "regulatory approval", "regulatory changes", "laws and regulations", "legal and regulatory", "compliance", "government investigations", "regulatory investigations", "fines", "penalties", "sanctions", "enforcement actions"],
    "market_competitive": ["competition", "competitive", "competitive pressures", "market share", "pricing pressure", "pricing pressures", "demand", "customer demand", "macroeconomic", "economic conditions", "recession", "downturn", "market volatility", "volatility"],
    "operational_supply_chain": ["operations", "operational", "operating disruptions", "supply chain", "supply-chain", "supply disruptions", "logistics", "manufacturing", "production facilities", "plant closures", "outages", "business interruption", "natural disaster", "catastrophic events"],
    "cybersecurity_tech": ["cybersecurity", "cyber security", "cyber", "information security", "data security", "data breach", "breach of data", "security incident", "security incidents", "ransomware", "malware", "hacking", "unauthorized access", "privacy", "personal data", "confidential information"],
    "legal_ip_litigation": ["litigation", "lawsuits", "class action", "legal proceedings", "legal claims", "claims and proceedings", "disputes", "arbitration", "settlement", "judgment", "patent", "patent infringement", "intellectual property", "ip rights"],
    "general_risk": ["risk factors", "risks and uncertainties", "material adverse effect", "adverse effect", "adverse impacts", "economic conditions", "market conditions", "pandemic", "covid-19", "downturn", "volatility"],
}
# Words for metrics.
METRICS = {
    "Revenue": ["revenue", "revenues", "sales", "net sales", "total revenue"], "Net Income": ["net income", "profit", "net profit", "earnings", "bottom line"], "Operating Income": ["operating income", "operating profit", "ebit"],
    "Total Assets": ["total assets", "assets"], "Total Liabilities": ["total liabilities", "liabilities"], "Stockholders Equity": ["equity", "stockholders equity", "shareholders equity"], "Gross Profit": ["gross profit"],
    "Operating Cash Flow": ["operating cash flow", "cash flow", "cfo"], "ROA % (Avg Assets)": ["roa", "return on assets"], "ROE % (Avg Equity)": ["roe", "return on equity"], "Current Ratio": ["current ratio"], "Debt-to-Equity": ["debt to equity", "debt-to-equity"],
    "Net Profit Margin %": ["net margin", "profit margin", "net profit margin"], "EPS": ["eps", "earnings per share"], "Free Cash Flow": ["free cash flow", "fcf"], "Capital Expenditures": ["capex", "capital expenditures"],
}
_STOP = frozenset("the and what how was is are were from with".split())


def _near_words(words: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(w, first): different words of four letters and more within the least similarity.

    Words of n letters may be k = floor((1 - least) n') edits apart, n' the longer length. A name cut into k + 1 pieces
    keeps one piece whole in such a word, moved by k places at most; so pieces with their place are the keys, for every
    length a partner can have, and no pair is lost.
    """
    long = words.where("length(w) >= 4").select("w").distinct().withColumn("n", F.length("w"))
    ours = names.select("first").distinct().withColumn("m", F.length("first"))
    edits = lambda n, m: F.floor((1 - least) * F.greatest(n, m) + 1e-9).cast("int")
    most = F.floor(F.col("m") / least + 1e-9).cast("int")
    p = ours.select("first", "m", F.explode(F.sequence(F.ceil(F.col("m") * least - 1e-9).cast("int"), most)).alias("n")).withColumn("k", edits(F.col("n"), F.col("m")))
    p = p.select("first", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), "m")
    p = p.withColumn("s", F.floor(F.col("m") * F.col("i") / (F.col("k") + 1)).cast("int")).withColumn("e", F.floor(F.col("m") * (F.col("i") + 1) / (F.col("k") + 1)).cast("int"))
    p = p.select("first", "n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("s") - F.col("k")), F.col("s") + F.col("k"))).alias("at"), F.expr("substring(first, s + 1, e - s)").alias("piece")).distinct()
    sizes = ours.agg(F.max("m")).first()[0] or 0  # the longest name bounds the pieces
    w = long.where(F.col("n") <= int(sizes / least) + 1).select("w", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    w = w.select("w", "n", "at", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.col("at"), F.lit(max(1, sizes))))).alias("size")).select("w", "n", "at", F.expr("substring(w, at + 1, size)").alias("piece"))
    return p.join(w, ["n", "at", "piece"]).select("w", "first").distinct().where((F.col("w") != F.col("first")) & (similarity(F.col("w"), F.col("first")) >= least))


def companies(questions: DataFrame, universe: DataFrame, question_id: str = "question_id", text: str = "question_text", cik: str = "cik", ticker: str = "ticker", name: str = "company_name", least: float = 0.85) -> DataFrame:
    """(question_id, cik, found_by): companies by ticker (upper-case words of up to five letters), by number, by full name
    or by a word within least similarity of the name's first word of four letters and more; each way once.

    Words are joined by equality, the fuzzy way over the distinct words alone.
    """
    q = questions.where(F.col(text).isNotNull()).select(F.col(question_id).alias("question_id"), F.col(text).alias("t"))
    u = universe.where(F.col(cik).isNotNull()).select(F.col(cik).cast("long").alias("cik"), F.upper(F.trim(ticker)).alias("ticker"), F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))).alias("name"))
    words = lambda p: q.select("question_id", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(p), F.lit(1)))).alias("w"))
    by_ticker = words(r"(?<![0-9A-Za-z_])([A-Z]{1,5})(?![0-9A-Za-z_])").join(u.where("ticker is not null").select("cik", F.col("ticker").alias("w")).distinct(), "w").select("question_id", "cik", F.lit("ticker").alias("found_by"))
    by_cik = words(r"(?<![0-9A-Za-z_])(\d{5,10})(?![0-9A-Za-z_])").select("question_id", F.col("w").try_cast("long").alias("cik")).join(u.select("cik").distinct(), "cik").select("question_id", "cik", F.lit("cik").alias("found_by"))
    names = u.where("name <> ''").select("cik", "name", F.regexp_extract("name", r"^(\w+)", 1).alias("first")).distinct()
    qw = q.select("question_id", F.lower("t").alias("t"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"(\w+)"), F.lit(1)))).alias("w"))
    by_name = qw.join(names.withColumnRenamed("first", "w"), "w").where(F.contains("t", "name")).select("question_id", "cik", F.lit("name").alias("found_by"))
    n = names.where("length(first) >= 4").select("cik", "first").distinct()
    a = qw.where("length(w) >= 4").select("question_id", "w").join(_near_words(qw.select("w"), n.select("first"), least), "w").select("question_id", "first")
    fuzzy = a.join(n, "first").select("question_id", "cik", F.lit("fuzzy").alias("found_by"))
    return by_ticker.unionByName(by_cik).unionByName(by_name).unionByName(fuzzy).distinct()


def years_of(text: str | None, as_of: int, first: int = 1950, ahead: int = 5) -> list[int]:
    """The years a question names, ranges filled up; ranges may run backwards; years out of first to as_of + ahead are dropped."""
    s = re.sub("[–—−]", "-", text or "")
    got: set[int] = set()
    y = r"((?:19|20)\d{2})"
    for p in (rf"\b{y}\s*(?:to|-)\s*{y}\b", rf"\bbetween\s+{y}\s+and\s+{y}\b", rf"\bfrom\s+{y}\s+(?:through|thru)\s+{y}\b", rf"\b{y}\s+(?:till|until)\s+{y}\b"):
        for a, b in re.findall(p, s, re.I):
            low, high = sorted((int(a), int(b)))
            got.update(range(max(low, first), min(high, as_of + ahead) + 1))
    got.update(int(v) for v in re.findall(rf"\b{y}\b", s))
    return sorted(v for v in got if first <= v <= as_of + ahead)


def years(questions: DataFrame, as_of: int, question_id: str = "question_id", text: str = "question_text") -> DataFrame:
    """(question_id, years, past_years, current_years, future_years, warning) as of a given year."""

    @F.pandas_udf("array<int>")
    def find(t: pd.Series) -> pd.Series:
        return t.map(lambda x: years_of(x, as_of))

    q = questions.select(F.col(question_id).alias("question_id"), find(text).alias("years"))
    q = q.withColumns({"past_years": F.filter("years", lambda v: v < as_of), "current_years": F.filter("years", lambda v: v == as_of), "future_years": F.filter("years", lambda v: v > as_of)})
    return q.withColumn("warning", F.when(F.size("future_years") > 0, F.concat(F.lit("future years: "), F.array_join("future_years", ", "))))


def _any(text: Column, phrases: list[str]) -> Column:
    """Whether a phrase stands in the text as whole words, with ASCII boundaries."""
    return text.rlike(r"(?i)(?<![0-9A-Za-z_])(" + "|".join(re.escape(p) for p in phrases) + r")(?![0-9A-Za-z_])")


def risk_topics(text: Column) -> Column:
    """The topics a text touches, in name order."""
    return F.array_compact(F.array(*(F.when(_any(text, RISK_TOPICS[t]), t) for t in sorted(RISK_TOPICS))))


def sections(text: Column) -> Column:
    """The sections a text points to by phrase, by "item N" or by a risk topic, by priority and then by name."""
    rest = sorted(s for s in SECTION_KEYWORDS if s not in SECTION_PRIORITY)
    hits = []
    for s in (*SECTION_PRIORITY, *rest):
        n = s.removeprefix("ITEM_").lower()
        hit = _any(text, SECTION_KEYWORDS[s]) | text.rlike(rf"(?i)(?<![0-9A-Za-z_])item\s*[-_ ]?\s*{n}(?![0-9A-Za-z_])")
        if n in ("7a", "1a"):
            hit = hit | text.rlike(rf"(?i)(?<![0-9A-Za-z_]){n}(?![0-9A-Za-z_])")
        if s == "ITEM_1A":
            hit = hit | (F.size(risk_topics(text)) > 0)
        hits.append(F.when(hit, s))
    return F.array_compact(F.array(*hits))


def _similar(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def metrics_of(text: str | None, words: dict[str, list[str]] = METRICS, least: float = 0.70) -> list[str]:
    """Metrics named in a question: longest phrases first without overlaps, then words of four letters and more by similarity."""
    low = (text or "").lower()
    phrases = sorted(((p, m) for m, ps in words.items() for p in ps), key=lambda x: -len(x[0]))
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    used: set[str] = set()
    for p, m in phrases:
        for hit in re.finditer(rf"\b{re.escape(p)}\b", low):
            a, b = hit.span()
            if m not in out and not any(a < z and b > y for y, z in spans):
                out.append(m)
                spans.append((a, b))
                used.update(p.split())
    for w in low.split():
        if w in used or len(w) < 4 or w in _STOP or w.isdigit():
            continue
        s, i, m = max(((_similar(w, p), -i, m) for i, (p, m) in enumerate(phrases)), key=lambda x: x[:2])
        if s >= least and m not in out:
            out.append(m)
    return out


def metrics(questions: DataFrame, question_id: str = "question_id", text: str = "question_text") -> DataFrame:
    """(question_id, metrics, needs_metrics): metrics named, and whether a figure is asked for at all."""

    @F.pandas_udf("array<string>")
    def find(t: pd.Series) -> pd.Series:
        return t.map(metrics_of)

    q = questions.select(F.col(question_id).alias("question_id"), F.col(text).alias("t"), find(text).alias("metrics"))
    routed = (F.size("metrics") > 0) & F.coalesce(F.col("t").rlike(r"(?i)\b(what|how much|how many|amount|value|figure|percent|percentage|ratio|total|compare|trend|change)\b|(19|20)\d{2}"), F.lit(False))
    return q.select("question_id", "metrics", routed.alias("needs_metrics"))


def question_entities(questions: DataFrame, universe: DataFrame, as_of: int, question_id: str = "question_id", text: str = "question_text") -> DataFrame:
    """(question_id, ciks, years, sections, primary_section, topics, metrics), a row for each question."""
    q = questions.select(question_id, text).dropDuplicates([question_id])
    c = companies(q, universe, question_id, text).groupBy("question_id").agg(F.array_sort(F.collect_set("cik")).alias("ciks"))
    out = q.select(F.col(question_id).alias("question_id"), F.coalesce(text, F.lit("")).alias("t")).withColumns({"sections": sections(F.col("t")), "topics": risk_topics(F.col("t"))})
    out = out.join(c, "question_id", "left").join(years(q, as_of, question_id, text).select("question_id", "years"), "question_id").join(metrics(q, question_id, text).select("question_id", "metrics"), "question_id")
    return out.select("question_id", F.coalesce("ciks", F.array().cast("array<bigint>")).alias("ciks"), "years", "sections", F.try_element_at("sections", F.lit(1)).alias("primary_section"), "topics", "metrics")


def best_choice(words: DataFrame, word: str, choices: DataFrame, choice: str, least: float) -> DataFrame:
    """(word, choice, similarity): the most similar choice of each word, the first in the choices' order on ties; choices are a short list."""
    c = choices.select(F.col(choice).alias("choice"), F.monotonically_increasing_id().alias("_i"))
    s = words.select(F.col(word).alias("word")).distinct().crossJoin(F.broadcast(c)).withColumn("similarity", similarity(F.lower("word"), F.lower("choice"))).where(F.col("similarity") >= least)
    w = Window.partitionBy("word").orderBy(F.col("similarity").desc(), "_i")
    return s.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("word", "choice", "similarity")
