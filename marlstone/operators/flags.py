"""Flags of sentences by patterns and a score over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.functions.text import AFTER, BEFORE, has_word

# The alternatives of each flag; stems are whole words here, as in the data's own convention.
KPI = "revenue|sales|gross margin|operating margin|net margin|cost|expense|income|earnings|ebitda|cash flow|profit|loss|asset|liability|equity|debt|eps|roe|roa|operating income|net income|gross profit"
FORWARD = "expects?|expected|forecasts?|forecasted|plans?|planned|anticipates?|anticipated|believes?|believed|estimates?|estimated|projects?|projected|intends?|intended|guidance|outlook|targets?|targeted"
COMPARISON = r"increas|decreas|compar|prior|previous|year-over-year|yoy|y/y|quarter-over-quarter|qoq|q/q|versus|vs\.|compared to|change|growth|decline"
MATERIAL = "significant|material|substantially|primarily|approximately|considerable|major|critical|key|important"
RISK = "risks?|material adverse|uncertain|uncertainty|volatility|exposure to|regulatory risk|regulatory scrutiny|compliance risk|litigation risk|threat|vulnerab"
SAFE_HARBOR = "forward-looking statement|safe harbor|private securities litigation reform act|actual results may differ|risk factors described"
YEAR = r"19\d{2}|20\d{2}"
AMOUNT = r"(?i)\(?\$?\d{1,3}(,\d{3})*(\.\d+)?\)?\s*(million|billion|thousand|M|B|K|%|percent|bps|basis points)"
GROUPED = r"\d{1,3}(,\d{3})+(\.\d+)?"
#: With stem=True, word beginnings count as well.
STEMS = {COMPARISON: r"increas\w*|decreas\w*|compar\w*|prior|previous|year-over-year|yoy|qoq|versus|vs|chang\w*|growth|declin\w*", RISK: RISK.replace("vulnerab", r"vulnerab\w*")}


def flags(text: Column, year: Column, recent_from: int = 2018, stem: bool = False) -> dict[str, Column]:
    """The ten flags; all are false for a null text but is_recent, which follows the year."""
    word = lambda p: F.coalesce(has_word(text, STEMS.get(p, p) if stem else p), F.lit(False))
    like = lambda p: F.coalesce(text.rlike(p), F.lit(False))
    return {
        "likely_kpi": word(KPI),
        "has_numbers": like(AMOUNT) | like(GROUPED) | like(r"\$\d+"),
        "is_table_like": F.coalesce(F.length(text) > 1000, F.lit(False)) | like(r"(\s{2,}|\t)") | like(r"(\d+\s+){5,}"),
        "has_forward_looking": word(FORWARD),
        "has_comparison": word(COMPARISON),
        "is_material": word(MATERIAL),
        "mentions_years": like(f"{BEFORE}({YEAR}){AFTER}"),
        "is_recent": F.coalesce(year >= recent_from, F.lit(False)),
        "has_risk_language": word(RISK),
        "is_safe_harbor": word(SAFE_HARBOR),
    }


# Weights of the score.
WEIGHTS = {"likely_kpi": 3, "has_numbers": 2, "has_comparison": 2, "is_material": 1, "has_forward_looking": 1, "is_recent": 1, "is_safe_harbor": -2}


def with_flags(df: DataFrame, text: str, year: str, recent_from: int = 2018, stem: bool = False) -> DataFrame:
    """df with the flags and their score; columns of those names are replaced."""
    out = df.withColumns(flags(F.col(text), F.col(year), recent_from, stem))
    return out.withColumn("retrieval_signal_score", sum(F.col(k).cast("int") * w for k, w in WEIGHTS.items()))


# The words of the light tags.
TAG_KPI = ("revenue", "income", "profit", "loss", "margin", "earnings", "cash", "assets", "debt", "equity")
TAG_COMPARISON = ("increase", "decrease", "compared", "higher", "lower", "growth", "decline", "versus", "change")


def light_tags(text: Column) -> dict[str, Column]:
    """Tags by plain substrings: key figures, any digit, comparison."""
    low = F.lower(text)
    any_of = lambda words: F.coalesce(low.rlike("|".join(words)), F.lit(False))
    return {"tag_kpi": any_of(TAG_KPI), "tag_number": F.coalesce(text.rlike(r"\d"), F.lit(False)), "tag_comparison": any_of(TAG_COMPARISON)}
