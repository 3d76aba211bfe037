"""String functions on columns, all built from Spark's own; where a word boundary is meant, it is that of ASCII."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BEFORE, AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def word_pattern(alternatives: str) -> str:
    """A case-insensitive pattern of whole words, with ASCII boundaries in any locale."""
    return f"(?iu){BEFORE}({alternatives}){AFTER}"


def has_word(c: Column, alternatives: str) -> Column:
    return c.rlike(word_pattern(alternatives))


def space_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def word_count(c: Column) -> Column:
    """Spaces plus one; null for null."""
    return space_count(c) + 1


def token_estimate(c: Column) -> Column:
    """Words times 1.33, truncated, as a smallint; null beyond its range."""
    return (word_count(c) * F.lit(1.33).cast("double")).cast("int").try_cast("smallint")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def last_part(c: Column, sep: str = "_") -> Column:
    return F.element_at(F.split(c, sep), -1)


def position_of(sentence_id: Column) -> Column:
    """The running number at an id's end as a smallint, -1 if it is none or too large."""
    return F.coalesce(last_part(sentence_id).try_cast("smallint"), F.lit(-1).cast("smallint"))


def prefix_of(sentence_id: Column) -> Column:
    return F.regexp_replace(sentence_id, "_[^_]*$", "")


def pad_cik(c: Column) -> Column:
    return F.lpad(F.regexp_replace(c.cast("string"), "^0+", ""), 10, "0")


def bare_cik(c: Column) -> Column:
    """A key without leading zeros, 0 if nothing is left."""
    s = F.regexp_replace(c.cast("string"), "^0+", "")
    return F.when(s == "", "0").otherwise(s)


def clean_number(c: Column) -> Column:
    """1,234 -> 1234, (123) -> -123, $5 -> 5; dashes and other texts are null."""
    s = F.trim(c)
    negative = s.rlike(r"^\(.*\)$")
    n = F.regexp_replace(s, r"[$,()\s]", "").try_cast("double")
    return F.when(negative, -n).otherwise(n)


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!^)(?=[A-Z])", " ")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


# Characters that stand for plainer ones.
PLAIN = {" ": " ", " ": " ", " ": " ", "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": "\n", " ": "\n"}


def plain_text(c: Column) -> Column:
    """No-break spaces, typographic quotes and dashes made plain, control characters dropped, runs of spaces shortened."""
    s = F.translate(c, "".join(PLAIN), "".join(PLAIN.values()))
    s = F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200B}\x{FEFF}]", "")
    s = F.regexp_replace(s, r"\r\n?", "\n")
    s = F.regexp_replace(s, r"(?m)^\s*[-=_*]{3,}\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def compact_money(c: Column, percent: Column | None = None, ratio: Column | None = None) -> Column:
    """$1.2B, $3.4M, $5.6K; 17.0% where percent holds, 0.55 where ratio holds."""
    size = F.abs(c)
    sign = F.when(c < 0, "-").otherwise("")
    money = (
        F.when(size >= 1e9, F.concat(sign, F.lit("$"), F.format_string("%.1fB", size / 1e9)))
        .when(size >= 1e6, F.concat(sign, F.lit("$"), F.format_string("%.1fM", size / 1e6)))
        .when(size >= 1e3, F.concat(sign, F.lit("$"), F.format_string("%.1fK", size / 1e3)))
        .otherwise(F.concat(sign, F.lit("$"), F.format_string("%.2f", size)))
    )
    out = money
    if ratio is not None:
        out = F.when(ratio, F.format_string("%.2f", c + F.lit(1e-9))).otherwise(out)
    if percent is not None:
        out = F.when(percent, F.format_string("%.1f%%", c)).otherwise(out)
    return F.when(c.isNotNull(), out)
