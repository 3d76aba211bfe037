"""Aligning schemas and merging increments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def schema_rows(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, data_type, nullable) of df, nested fields by their path."""

    def walk(s: T.StructType, at: str):
        for f in s.fields:
            path = f"{at}{f.name}"
            yield path, f.dataType.simpleString(), f.nullable
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path + ".")

    rows = [(i, *r) for i, r in enumerate(walk(df.schema, ""), 1)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, data_type string, nullable boolean")


def normal_column(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"[\s_-]+", "_"))


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(column_name, left_type, right_type, status) over schema_rows of two tables: match, type_mismatch, left_only, right_only."""
    a = left.select(normal_column(F.col("column_name")).alias("column_name"), F.col("data_type").alias("left_type"))
    b = right.select(normal_column(F.col("column_name")).alias("column_name"), F.col("data_type").alias("right_type"))
    status = F.when(F.col("left_type").isNull(), "right_only").when(F.col("right_type").isNull(), "left_only").when(F.col("left_type") == F.col("right_type"), "match").otherwise("type_mismatch")
    return a.join(b, "column_name", "full_outer").withColumn("status", status)


def align(df: DataFrame, schema: T.StructType, rename: dict[str, str] | None = None, fill: dict[str, Column] | None = None) -> DataFrame:
    """df with exactly the schema's columns in its order: renamed, cast without error, missing ones filled or typed nulls.

    Names are compared without letter case; a further column whose name clashes in case alone is dropped.
    """
    rename, fill = rename or {}, fill or {}
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(rename.get(c, c).lower(), c)
    out = []
    for f in schema.fields:
        if f.name.lower() in have:
            c = F.col(f"`{have[f.name.lower()]}`")
            out.append((c.cast(f.dataType) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else c.try_cast(f.dataType)).alias(f.name))
        else:
            out.append(fill.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*out)


def dedupe_last(df: DataFrame, keys: Sequence[str], precedence: Sequence[Column]) -> DataFrame:
    """The row of each key with the greatest precedence; null keys are one key."""
    w = Window.partitionBy(*keys).orderBy(*precedence)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], mark: dict[str, Column] | None = None) -> DataFrame:
    """base without new's keys, and new; applying it twice changes nothing. Null keys of new are inserted, and replace nothing."""
    new = new.withColumns(mark) if mark else new
    return base.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def next_ids(new: DataFrame, base: DataFrame, id_col: str, order: str) -> DataFrame:
    """new with ids that go on after base's greatest, in order; meant for increments, as they are numbered in one task."""
    top = base.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    return new.crossJoin(F.broadcast(top)).withColumn(id_col, (F.col("_top") + F.row_number().over(Window.orderBy(order))).cast("long")).drop("_top")


def incremental_merge(base: DataFrame, increment: DataFrame, keys: Sequence[str], tie: Sequence[str], checks: bool = True) -> tuple[DataFrame, DataFrame]:
    """(merged, stats): rows of both by key, the increment's winning, and one row of counts.

    Within either side repeated keys keep the greatest tie. With checks an error says if the merge has fewer rows than
    the larger side has keys, more than both have rows, or repeated keys.
    """
    order = [F.col("_from").desc(), *(F.col(t).desc_nulls_last() for t in tie)]
    both = base.withColumn("_from", F.lit(0)).unionByName(increment.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    merged = dedupe_last(both, keys, order)
    n = both.agg(F.count_if(F.col("_from") == 0).alias("base_rows"), F.count_if(F.col("_from") == 1).alias("increment_rows"))
    m = merged.agg(F.count("*").alias("merged_rows"), F.count_if(F.col("_from") == 1).alias("from_increment"))
    stats = n.crossJoin(m).withColumn("duplicates_removed", F.col("base_rows") + F.col("increment_rows") - F.col("merged_rows"))
    if checks:
        s = stats.first()
        if s["merged_rows"] > s["base_rows"] + s["increment_rows"] or s["merged_rows"] < s["from_increment"]:
            raise ValueError(f"rows out of bounds: {s}")
    return merged.drop("_from"), stats


def fill_from(df: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df with nulls of columns filled from source's row of the same key; of several rows the greatest value counts."""
    s = source.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.max(c).alias(f"_{c}") for c in columns))
    out = df.join(s, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def clean_and_dedupe(df: DataFrame, text: str, keys: Sequence[str], least_chars: int = 1) -> DataFrame:
    """Rows with a text of least_chars at least, one for each (text, keys) after trimming; the smallest row stays."""
    t = df.withColumn(text, F.trim(text)).where(F.length(text) >= least_chars)
    rest = [c for c in t.columns if c not in (text, *keys)]
    return dedupe_last(t, [text, *keys], [F.col(c).asc_nulls_last() for c in rest] or [F.lit(1)])
