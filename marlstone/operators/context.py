"""Neighbours of hits within their section, and the text put together from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.functions.text import position_of, prefix_of, token_estimate


def enrich(facts: DataFrame, id_col: str, text: str, lineage: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """facts with previous and next id, lengths, token estimate, size of the section and typed nulls of lineage.

    Rows are ordered by the number at the id's end within the id's prefix; ids without a number come first.
    """
    f = facts.withColumns({"_p": prefix_of(F.col(id_col)), "sentence_pos": position_of(F.col(id_col))})
    w = Window.partitionBy("_p").orderBy("sentence_pos", id_col)
    out = f.withColumns({
        "prev_id": F.lag(id_col).over(w), "next_id": F.lead(id_col).over(w), "char_length": F.length(text), "token_count": token_estimate(F.col(text)), "section_count": F.count("*").over(Window.partitionBy("_p")),
    })
    return out.withColumns({n: F.lit(None).cast(t) for n, t in lineage}).drop("_p") if lineage else out.drop("_p")


def expand(hits: DataFrame, facts: DataFrame, group: Sequence[str], position: str, size: int, lowest: int = 0, count: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(hit columns, position, is_core and facts' columns): the rows within size places of each hit in its group.

    A hit's positions are listed and joined by equality, so the join is on (group, position), however large a group.
    The window starts at lowest and, with count naming the group's size among the hits' columns, ends there.
    """
    low = F.greatest(F.lit(lowest), F.col(position) - size)
    high = F.col(position) + size if count is None else F.least(F.col(position) + size, F.col(count))
    h = hits.withColumn("hit_pos", F.col(position).cast("int")).withColumn("_at", F.explode(F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))))
    h = h.drop(position).withColumnRenamed("_at", position).withColumn("is_core", F.col(position) == F.col("hit_pos"))
    return h.join(facts.withColumn(position, F.col(position).cast("int")).select(*group, position, *keep), [*group, position])


def dedupe_expanded(rows: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One row for each key: the best parent's distance, all sources and variants, whether it is a hit itself."""
    return rows.groupBy(*keys).agg(
        F.min("distance").alias("distance"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("variant_ids")))).alias("variant_ids"),
        F.max("is_core").alias("is_core"), *(F.min(c).alias(c) for c in carry),
    )


def assemble(rows: DataFrame, query: str, order: Sequence[str], breaks: Sequence[str], header: Column, text: str, id_col: str) -> DataFrame:
    """(query, context, n_sentences): rows in order, under a header wherever one of breaks changes, which names the first
    and last id below it. A query's rows are a bounded number of hits and neighbours."""
    w = Window.partitionBy(query).orderBy(*order)
    same = F.lit(True)
    for b in breaks:
        same = same & F.lag(b).over(w).eqNullSafe(F.col(b))
    r = rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise((~same).cast("int")))
    r = r.withColumn("_block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(w)).withColumn("_h", header)
    b = r.groupBy(query, "_block").agg(F.min_by("_h", "_rn").alias("_h"), F.min_by(id_col, "_rn").alias("_a"), F.max_by(id_col, "_rn").alias("_z"), F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(text).alias("t")))), lambda x: x["t"]), " ").alias("_t"))
    b = b.withColumn("_t", F.concat(F.lit("=== "), F.col("_h"), F.lit(" | Sentences: "), F.col("_a"), F.lit(" - "), F.col("_z"), F.lit(" ===\n"), F.col("_t")))
    return b.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_t"))), lambda x: x["_t"]), "\n\n").alias("context"), F.sum("_n").alias("n_sentences"))
