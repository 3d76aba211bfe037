"""Dates out of strings in several formats, and bins of years."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The formats dates arrive in, tried in this order.
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "M/d/yyyy", "yyyyMMdd", "MMMM d, yyyy", "d-MMM-yyyy")
# First and last year of each bin.
BINS = {"bin_2006_2009": (2006, 2009), "bin_2010_2015": (2010, 2015), "bin_2016_2020": (2016, 2020), "bin_2021_2025": (2021, 2025)}


def parse_date(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats)).cast("date")


def year_in(c: Column) -> Column:
    """The first year from 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(c, r"(19\d{2}|20\d{2})", 1), F.lit("")).try_cast("int")


def temporal_bin(year: Column, bins: dict[str, tuple[int, int]] = BINS, other: str | None = "bin_unknown") -> Column:
    out = None
    for name, (a, b) in bins.items():
        out = (F if out is None else out).when(year.between(a, b), name)
    return out.otherwise(F.lit(other))


def normal_bin(c: Column) -> Column:
    """A bin's name without letter case, outer spaces and kind of separator; blank is null."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")
    return F.when(s != "", s)
