"""Choosing and resolving entities: scores, tiers, keys, dimensions, searches and subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.functions.dates import temporal_bin


def entity_dimension(facts: DataFrame, key: str, name: str, order: str, codes: str | None = None, measures: dict[str, Column] | None = None) -> DataFrame:
    """(key, latest_name, n_rows, first, last[, all_codes] and measures), a row for each key.

    latest_name belongs to the greatest (order, name); codes is an array column whose distinct entries are gathered
    in order. Null names and orders are passed over; entities without codes have an empty array.
    """
    f = facts.where(F.col(key).isNotNull())
    aggs = [F.max(F.when(F.col(order).isNotNull() & F.col(name).isNotNull(), F.struct(order, name)))[name].alias("latest_name"), F.count("*").alias("n_rows"), F.min(order).alias("first_seen"), F.max(order).alias("last_seen")]
    out = f.groupBy(key).agg(*aggs, *[c.alias(n) for n, c in (measures or {}).items()])
    if codes:
        sets = f.select(key, F.explode(codes).alias("code")).where("code is not null").distinct().groupBy(key).agg(F.array_sort(F.collect_list("code")).alias("all_codes"))
        out = out.join(sets, key, "left").withColumn("all_codes", F.coalesce("all_codes", F.array().cast("array<string>")))
    return out


def two_tier_match(targets: DataFrame, entities: DataFrame, key: str, code: str, entity_key: str, entity_codes: str, latest: str, target_id: str) -> DataFrame:
    """targets with matched_key and match_tier (1 by key, 2 by code, null if unmatched), a row for each target.

    A target whose key is an entity's is taken at once. The others are matched by code among the entities' arrays of
    codes, exploded for an equi-join; of several the latest wins, ties by smaller key.
    """
    known = entities.select(F.col(entity_key).alias("matched_key")).distinct()
    first = targets.join(known, F.col(key) == F.col("matched_key")).withColumn("match_tier", F.lit(1))
    rest = targets.join(known, F.col(key) == F.col("matched_key"), "left_anti")
    codes = entities.select(F.col(entity_key).alias("matched_key"), F.col(latest).alias("_latest"), F.explode(entity_codes).alias("_code")).where("_code is not null")
    w = Window.partitionBy("_code").orderBy(F.col("_latest").desc_nulls_last(), F.col("matched_key"))
    codes = codes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_latest")
    second = rest.join(codes, F.upper(F.trim(F.col(code))) == F.upper(F.trim("_code")), "left").drop("_code").withColumn("match_tier", F.when(F.col("matched_key").isNotNull(), 2))
    both = first.unionByName(second)
    pick = Window.partitionBy(target_id).orderBy(F.col("match_tier").asc_nulls_last(), F.col("matched_key").asc_nulls_last())
    return both.withColumn("_rn", F.row_number().over(pick)).where("_rn = 1").drop("_rn")


def theta_search(entities: DataFrame, name: str, wanted: Sequence[tuple[int | None, str, str | None]], key: str, codes: str | None = None) -> DataFrame:
    """(pattern_id, key, name): entities found by key, by a part of the name or by a code; wanted is a short list.

    The disjunction makes this a nested-loop join, whose one side is the list written in the call.
    """
    spark = entities.sparkSession
    p = spark.createDataFrame([(i, *w) for i, w in enumerate(wanted)], "pattern_id int, want_key long, pattern string, want_code string")
    hit = (F.col(key) == F.col("want_key")) | F.upper(name).contains(F.upper(F.col("pattern")))
    if codes:
        hit = hit | F.array_contains(F.col(codes), F.col("want_code"))
    return entities.join(F.broadcast(p), hit).select("pattern_id", F.col(key), F.col(name))


def quality_score(facts: DataFrame, key: str, year: str, section: str, recent_from: int, priority: Sequence[int], least_years: int = 1, least_sections: int = 1) -> DataFrame:
    """(key, n_rows, n_years, n_sections, recent, priority_rows, score) of the keys that pass both gates.

    score = 5 years + 10 sections + recent / 100 + priority_rows / 50.
    """
    g = facts.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n_rows"), F.count_distinct(year).alias("n_years"), F.count_distinct(section).alias("n_sections"),
        F.count_if(F.col(year) >= recent_from).alias("recent"), F.count_if(F.col(section).isin(*priority)).alias("priority_rows"),
    )
    g = g.where((F.col("n_years") >= least_years) & (F.col("n_sections") >= least_sections))
    return g.withColumn("score", F.col("n_years") * 5.0 + F.col("n_sections") * 10.0 + F.col("recent") / 100.0 + F.col("priority_rows") / 50.0)


def tier(score: Column, bounds: Sequence[tuple[float, str]], other: str) -> Column:
    """The name of the first bound that the score reaches."""
    out = None
    for least, name in bounds:
        out = (F if out is None else out).when(score >= least, name)
    return out.otherwise(F.lit(other))


def candidate_pool(scored: DataFrame, key: str, n_auto: int, excluded: DataFrame, picked: DataFrame, limit: int) -> DataFrame:
    """(key, selection): the best n_auto scores without the excluded keys, and the picked keys, at most limit of them."""
    auto = scored.join(excluded.select(key).distinct(), key, "left_anti").orderBy(F.col("score").desc_nulls_last(), F.col(key)).limit(n_auto)
    hand = picked.select(key).distinct().withColumn("selection", F.lit("picked")).withColumn("score", F.lit(None).cast("double"))
    auto = auto.select(key, F.lit("auto").alias("selection"), F.col("score").cast("double").alias("score")).join(hand.select(key), key, "left_anti")
    return hand.unionByName(auto).orderBy(F.col("selection").desc(), F.col("score").desc_nulls_last(), key).limit(limit).select(key, "selection")


def top_per_source(parts: Sequence[tuple[str, DataFrame, int]], order: Column, key: str) -> DataFrame:
    """(source, key, rank_within_group): the best n rows of each part, ranked again after their union."""
    out = None
    for name, df, n in parts:
        one = df.withColumn("_o", order).orderBy(F.col("_o").desc_nulls_last(), key).limit(n).select(F.lit(name).alias("source"), key, "_o")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("rank_within_group", F.row_number().over(Window.partitionBy("source").orderBy(F.col("_o").desc_nulls_last(), key))).drop("_o")


def top_n_with_mandatory(scored: DataFrame, group: str, score: str, key: str, per_group: dict[str, int], mandatory: Sequence) -> DataFrame:
    """(group, key, rank_within_group): the best per_group[g] of each group and every mandatory key, whose rank is 0."""
    must = F.col(key).isin(*mandatory) if mandatory else F.lit(False)
    rest = scored.where(~must).withColumn("rank_within_group", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), key)))
    most = None
    for g, n in per_group.items():
        most = (F if most is None else most).when(F.col(group) == g, n)
    rest = rest.where(F.col("rank_within_group") <= most.otherwise(0))
    return rest.select(group, key, "rank_within_group").unionByName(scored.where(must).select(group, key, F.lit(0).alias("rank_within_group")))


def section_keyword_rates(facts: DataFrame, section: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(section, n_rows, rate of each pattern, best_label): which pattern a section's texts match most, ties by order."""
    g = facts.where(F.col(section).isNotNull() & F.col(text).isNotNull()).groupBy(section).agg(F.count("*").alias("n_rows"), *(F.avg(F.col(text).rlike(p).cast("double")).alias(f"rate_{n}") for n, p in patterns.items()))
    top = F.greatest(*(F.col(f"rate_{n}") for n in patterns)) if len(patterns) > 1 else F.col(f"rate_{next(iter(patterns))}")
    label = None
    for n in patterns:
        label = (F if label is None else label).when(F.col(f"rate_{n}") == top, n)
    return g.withColumn("best_label", F.when(top > 0, label))


SUBSETS = {"ALL_BINS": None, "MODERN_ONLY": ("bin_2016_2020",), "HISTORICAL_ONLY": ("bin_2006_2009", "bin_2010_2015")}


def subset(facts: DataFrame, entities: DataFrame, key: str, template: str = "ALL_BINS", year: str = "report_year", years: tuple[int, int] | None = None) -> DataFrame:
    """The facts of the listed entities within the template's bins or a range of years."""
    out = facts.join(entities.select(key).distinct(), key, "left_semi")
    if years:
        return out.where(F.col(year).between(*years))
    bins = SUBSETS[template]
    return out if bins is None else out.where(temporal_bin(F.col(year)).isin(*bins))


def upsert_simulation(base: DataFrame, new: DataFrame, group: str, key: str) -> DataFrame:
    """(strategy, deleted, inserted, lost, lost_pct): deleting by group against deleting by key before an insert.

    lost: base rows deleted whose key does not come again.
    """
    b, n = base.select(group, key), new.select(group, key)
    total = b.count()
    gone = {"delete_by_group": b.join(n.select(group).distinct(), group, "left_semi"), "delete_by_key": b.join(n.select(key).distinct(), key, "left_semi")}
    out = None
    for name, d in gone.items():
        lost = d.join(n.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
        one = lost.agg(F.count("*").alias("deleted"), F.count_if(F.col("_in").isNull()).alias("lost")).crossJoin(n.agg(F.count("*").alias("inserted")))
        one = one.select(F.lit(name).alias("strategy"), "deleted", "inserted", "lost", (F.col("lost") * 100.0 / F.lit(float(max(1, total)))).cast("double").alias("lost_pct"))
        out = one if out is None else out.unionByName(one)
    return out
