"""Checks of tables: validation queries, a quality score, expectations, contracts and profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T


def status(ok: Column, bad: str = "FAIL") -> Column:
    return F.when(ok, "PASS").otherwise(bad)


def report(rows: dict[str, Column], df: DataFrame) -> DataFrame:
    """(metric, value): several aggregates of df in one pass, one row each."""
    one = df.agg(*(c.cast("double").alias(n) for n, c in rows.items()))
    return one.unpivot([], list(rows), "metric", "value")


def validate_sample(sample: DataFrame, corpus: DataFrame, target: int, key: str, entity: str, year: str, section: str, bin_col: str, tolerance: float = 0.05) -> DataFrame:
    """(check_name, value, status): size within tolerance, unique keys, no null keys, coverage of entities, bins, years and
    sections, imbalance between bins, and that every sampled key is in the corpus. Each table is read once and shuffled by key once."""
    s = sample.agg(
        F.count("*").cast("double").alias("rows"), F.count_distinct(key).cast("double").alias("keys"), F.count_if(F.col(key).isNull()).cast("double").alias("null_keys"),
        *(F.count_distinct(c).cast("double").alias(f"s_{i}") for i, c in enumerate((entity, bin_col, year, section))),
    )
    c = corpus.agg(*(F.count_distinct(c).cast("double").alias(f"c_{i}") for i, c in enumerate((entity, bin_col, year, section))))
    sizes = sample.groupBy(bin_col).count().agg(F.try_divide(F.max("count"), F.min("count")).cast("double").alias("imbalance"))
    stray = sample.join(corpus.select(key).distinct(), key, "left_anti").agg(F.count("*").cast("double").alias("stray"))
    one = s.crossJoin(c).crossJoin(sizes).crossJoin(stray)
    row = lambda name, value, ok: F.struct(F.lit(name).alias("check_name"), value.alias("value"), status(ok).alias("status"))
    rows = [
        row("V1_size", F.col("rows"), F.abs(F.col("rows") - target) <= tolerance * target),
        row("V2_unique_keys", F.col("keys"), F.col("keys") == F.col("rows")),
        row("V3_null_keys", F.col("null_keys"), F.col("null_keys") == 0),
        *(row(f"V{4 + i}_{n}_coverage", F.col(f"s_{i}") * 100.0 / F.greatest(F.col(f"c_{i}"), F.lit(1.0)), F.col(f"s_{i}") == F.col(f"c_{i}")) for i, n in enumerate(("entity", "bin", "year", "section"))),
        row("V8_imbalance", F.col("imbalance"), F.col("imbalance") < 100),
        row("V9_stray_keys", F.col("stray"), F.col("stray") == 0),
    ]
    return one.select(F.inline(F.array(*rows)))


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n_rows, n_null, null_pct, n_unique, unique_pct, min_value, max_value) in one pass; extrema as strings."""
    simple = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType))]
    columns = [c for c in (columns or simple) if c in simple]
    aggs = [F.count("*").alias("n_rows")]
    for i, c in enumerate(columns):
        q = F.col(f"`{c}`")
        aggs += [F.count_if(q.isNull()).alias(f"n{i}"), F.count_distinct(q).alias(f"u{i}"), F.min(q).cast("string").alias(f"a{i}"), F.max(q).cast("string").alias(f"z{i}")]
    one = df.agg(*aggs)
    pct = lambda x: F.when(F.col("n_rows") > 0, F.col(x) * F.lit(100.0).cast("double") / F.col("n_rows"))
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), F.col(f"n{i}").alias("n_null"), pct(f"n{i}").alias("null_pct"), F.col(f"u{i}").alias("n_unique"), pct(f"u{i}").alias("unique_pct"), F.col(f"a{i}").alias("min_value"), F.col(f"z{i}").alias("max_value")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(n)


def quality_score(df: DataFrame, required: Sequence[str], key: str, year: str, years: tuple[int, int], hash_col: str, booleans: Sequence[str], most_null: float = 0.10) -> DataFrame:
    """(check_name, value, passed) and a last row quality_score with the percentage passed.

    Checks: null rate of each required column, unique keys, years within bounds, unique hashes, booleans that are true,
    false or their strings. Nulls count against uniqueness of nothing. An empty table passes none.
    """
    n = F.count("*").cast("double")
    one = df.agg(
        n.alias("n"), *(F.try_divide(F.count_if(F.col(c).isNull()), n).alias(f"r{i}") for i, c in enumerate(required)),
        (F.count(key) - F.count_distinct(key)).cast("double").alias("dup"), F.count_if(~F.col(year).between(*years)).cast("double").alias("bad_year"),
        (F.count(hash_col) - F.count_distinct(hash_col)).cast("double").alias("dup_hash"),
        *(F.count_if(~F.lower(F.col(c).cast("string")).isin("true", "false", "0", "1")).cast("double").alias(f"b{i}") for i, c in enumerate(booleans)),
    )
    some = F.col("n") > 0
    rows = [(f"null_rate_{c}", F.col(f"r{i}"), F.col(f"r{i}") <= most_null) for i, c in enumerate(required)]
    rows += [("unique_key", F.col("dup"), F.col("dup") == 0), ("year_bounds", F.col("bad_year"), F.col("bad_year") == 0), ("unique_hash", F.col("dup_hash"), F.col("dup_hash") == 0)]
    rows += [(f"boolean_{c}", F.col(f"b{i}"), F.col(f"b{i}") == 0) for i, c in enumerate(booleans)]
    passed = [F.coalesce(p & some, F.lit(False)) for _, _, p in rows]
    total = sum(p.cast("int") for p in passed) * F.lit(100.0).cast("double") / len(rows)
    structs = [F.struct(F.lit(nm).alias("check_name"), v.cast("double").alias("value"), p.alias("passed")) for (nm, v, _), p in zip(rows, passed)]
    return one.select(F.inline(F.array(*structs, F.struct(F.lit("quality_score").alias("check_name"), total.alias("value"), (total >= 100.0).alias("passed")))))


@dataclass(frozen=True)
class Expectation:
    """kind: exists, not_null, between, in_set, unique, length, row_count or column_count; args: what it needs."""

    kind: str
    column: str | None = None
    args: tuple = ()


def check_expectations(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """(expectation, column_name, violations, passed), all in one pass; nulls violate not_null alone. A missing column fails."""
    aggs, rows = [F.count("*").alias("n")], []
    for i, e in enumerate(suite):
        here = e.column is None or e.column in df.columns
        q = F.col(f"`{e.column}`") if e.column and here else None
        bad = None
        if e.kind == "exists" or not here:
            bad = F.lit(0 if here else 1)
        elif e.kind == "not_null":
            aggs.append(F.count_if(q.isNull()).alias(f"v{i}"))
        elif e.kind == "between":
            aggs.append(F.count_if(~q.between(*e.args)).alias(f"v{i}"))
        elif e.kind == "in_set":
            aggs.append(F.count_if(~q.isin(*e.args)).alias(f"v{i}"))
        elif e.kind == "unique":
            aggs.append((F.count(q) - F.count_distinct(q)).alias(f"v{i}"))
        elif e.kind == "length":
            aggs.append(F.count_if(~F.length(q).between(*e.args)).alias(f"v{i}"))
        elif e.kind == "row_count":
            bad = F.when(F.col("n").between(*e.args), 0).otherwise(1)
        elif e.kind == "column_count":
            bad = F.lit(0 if len(df.columns) == e.args[0] else 1)
        else:
            raise ValueError(f"unknown expectation {e.kind}")
        rows.append((e, bad if bad is not None else F.col(f"v{i}")))
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*(F.struct(F.lit(e.kind).alias("expectation"), F.lit(e.column).alias("column_name"), b.cast("long").alias("violations"), (b == 0).alias("passed")) for e, b in rows))))


def contract(df: DataFrame, strict: Sequence[str], derived: Sequence[str] = ()) -> DataFrame:
    """(column_name, phase, status) of a two-phase contract: strict columns must be there and no others but derived ones."""
    have = df.columns
    rows = [(c, "strict", "present" if c in have else "missing") for c in strict] + [(c, "derived", "present" if c in have else "missing") for c in derived]
    rows += [(c, "extra", "unexpected") for c in have if c not in strict and c not in derived]
    return df.sparkSession.createDataFrame(rows, "column_name string, phase string, status string")


def id_pattern_check(df: DataFrame, id_col: str, doc_col: str, pattern: str = r"^(\d{10})_(10-[KQ]|8-K)_(\d{4})_section_(\w+)_(\d+)$") -> DataFrame:
    """(status, n): ids that fit the pattern and their document, fit the pattern alone, do not fit, or are null."""
    i = F.col(id_col)
    st = F.when(i.isNull(), "null").when(~i.rlike(pattern), "no_match").when(F.col(doc_col).isNull() | ~i.startswith(F.concat(F.col(doc_col), F.lit("_"))), "other_document").otherwise("ok")
    return df.groupBy(st.alias("status")).agg(F.count("*").alias("n"))


def contiguity(df: DataFrame, group: str, position: Column) -> DataFrame:
    """(group, n, first, last, missing): whether the positions of each group follow one another."""
    p = df.where(F.col(group).isNotNull()).select(F.col(group), position.cast("int").alias("_p")).where("_p >= 0").distinct()
    return p.groupBy(group).agg(F.count("*").alias("n"), F.min("_p").alias("first_pos"), F.max("_p").alias("last_pos")).withColumn("missing", F.col("last_pos") - F.col("first_pos") + 1 - F.col("n"))
