"""Budget-driven stratified sampling with a late join back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Budget:
    """size: rows wanted; priority: the bin taken first; older: weights of the others for what it leaves."""

    size: int
    priority: str
    older: dict[str, float]


def gate(corpus: DataFrame, text: str | None = None, year: str = "report_year", first: int = 2006, last: int = 2020, section: str = "section", least_chars: int = 10) -> DataFrame:
    """Rows of the wanted years with a section and, where a text is named, more than least_chars of it."""
    keep = F.col(year).between(first, last) & F.col(section).isNotNull()
    if text:
        keep = keep & F.col(text).isNotNull() & (F.length(text) > least_chars)
    return corpus.where(keep)


def populations(corpus: DataFrame, bin_col: str = "temporal_bin") -> DataFrame:
    return corpus.groupBy(F.col(bin_col).alias("temporal_bin")).agg(F.count("*").alias("population"))


def allocate(pops: DataFrame, budget: Budget) -> DataFrame:
    """(temporal_bin, population, target_n, allocation_mode): the priority bin first, the rest by weights, rounded half up.

    Bins without population or weight get 0, so nothing is divided by 0.
    """
    names = [budget.priority, *budget.older]
    at = lambda n: F.coalesce(F.sum(F.when(F.col("temporal_bin") == n, F.col("population"))), F.lit(0))
    one = pops.agg(*(at(n).alias(f"p{i}") for i, n in enumerate(names)))
    left = F.greatest(F.lit(0), F.lit(budget.size) - F.col("p0"))
    mode = F.when(F.col("p0") >= budget.size, "MODERN_ONLY").otherwise("MODERN_FULL_PLUS_OLDER")
    rows = [F.struct(F.lit(budget.priority).alias("temporal_bin"), F.col("p0").alias("population"), F.least(F.lit(budget.size).cast("long"), F.col("p0")).alias("target_n"))]
    for i, (n, w) in enumerate(budget.older.items(), 1):
        rows.append(F.struct(F.lit(n).alias("temporal_bin"), F.col(f"p{i}").alias("population"), F.floor(left * F.lit(float(w)) + 0.5).cast("long").alias("target_n")))
    return one.select(mode.alias("allocation_mode"), F.inline(F.array(*rows)))


def order_key(key: Column, seed: str) -> Column:
    """A reproducible random order: the digest of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def stratified_ids(corpus: DataFrame, allocation: DataFrame, strata: list[str], key: str, bin_col: str = "temporal_bin", seed: str = "42") -> DataFrame:
    """(key, strata, stratum_size, stratum_n): in each stratum the first stratum_n rows of the seeded order.

    A bin whose target reaches its population is taken whole; else a stratum gives its share, rounded half up, at
    least one row, so the sum may pass the budget. Strata are shuffled once, sizes come from the same window.
    """
    part = [bin_col, *[s for s in strata if s != bin_col]]
    w = Window.partitionBy(*part)
    a = F.broadcast(allocation.select(F.col("temporal_bin").alias(bin_col), "population", "target_n").where("target_n > 0"))  # a row for each bin
    t = corpus.select(key, *part).join(a, bin_col)
    t = t.withColumn("stratum_size", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(order_key(F.col(key), seed), F.col(key))))
    share = F.floor(F.col("stratum_size") * (F.col("target_n") * F.lit(1.0).cast("double") / F.col("population")) + 0.5).cast("long")
    t = t.withColumn("stratum_n", F.when(F.col("target_n") >= F.col("population"), F.col("stratum_size")).otherwise(F.greatest(F.lit(1).cast("long"), share)))
    return t.where("rn <= stratum_n").select(key, *part, "stratum_size", "stratum_n")


def join_back(ids: DataFrame, facts: DataFrame, key: str, columns: list[str], dims: DataFrame | None = None, dim_key: str | None = None) -> DataFrame:
    """The wide rows of the sampled ids; wide columns are read for those alone, after ids has been reduced."""
    out = facts.select(key, *[c for c in columns if c != key]).join(ids.select(key).distinct(), key, "left_semi")
    return out.join(dims, dim_key, "left") if dims is not None else out


def row_hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("", *parts))


def keep_share(df: DataFrame, key: str, percent: int, modulus: int = 100) -> DataFrame:
    """A uniform sample that a key is in or out of for good: 32 bits of its digest modulo modulus are under percent."""
    return df.where(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(modulus)) < percent)


def uniform_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows in seeded order."""
    return df.orderBy(order_key(F.col(key), seed), key).limit(n)
