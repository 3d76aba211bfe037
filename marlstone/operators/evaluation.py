"""Quality of retrieval and of answers, and the log of questions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from marlstone.operators.vectors import top_k


def anchors(facts: DataFrame, group: Sequence[str], id_col: str, position: str, least: int = 20, stride: int = 4, most: int = 60) -> DataFrame:
    """Rows spaced through the sections of at least `least` rows: every max(n // 5, stride)-th, most of them in order."""
    w = Window.partitionBy(*group)
    f = facts.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least).withColumn("_i", F.row_number().over(w.orderBy(position, id_col)) - 1)
    f = f.where(F.col("_i") % F.greatest(F.floor(F.col("_n") / 5), F.lit(stride)) == 0)
    return f.orderBy(*group, position, id_col).limit(most).drop("_n", "_i")


def gold_neighbours(anchor: DataFrame, facts: DataFrame, group: Sequence[str], id_col: str, position: str, window: int) -> DataFrame:
    """(query_id, id): rows within window places of each anchor in its group, without itself."""
    a = anchor.select(F.col(id_col).alias("query_id"), *group, F.explode(F.sequence((F.col(position) - window).cast("int"), (F.col(position) + window).cast("int"))).alias(position))
    f = facts.select(F.col(id_col).alias("id"), *group, F.col(position).cast("int").alias(position))
    return a.join(f, [*group, position]).where("id <> query_id").select("query_id", "id")


def ranks(hits: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, self_rank, first_hit): hits (query_id, id, rank) against gold (query_id, id); the query itself takes no place."""
    own = hits.where("id = query_id").select("query_id", F.col("rank").alias("self_rank"))
    rest = hits.where("id <> query_id").withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    first = rest.join(gold, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("_r").alias("first_hit"))
    return queries.select("query_id").distinct().join(own, "query_id", "left").join(first, "query_id", "left")


def retrieval_scores(r: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """One row: n, self_at_1, hit_at_k and mrr_at_k over ranks."""
    one = F.lit(1.0).cast("double")
    zero = F.lit(0.0).cast("double")
    aggs = [F.count("*").alias("n"), F.avg(F.when(F.col("self_rank") == 1, one).otherwise(zero)).alias("self_at_1")]
    for k in ks:
        aggs += [F.avg(F.when(F.col("first_hit") <= k, one).otherwise(zero)).alias(f"hit_at_{k}"), F.avg(F.when(F.col("first_hit") <= k, one / F.col("first_hit")).otherwise(zero)).alias(f"mrr_at_{k}")]
    return r.agg(*aggs)


def evaluate_retrieval(vectors: DataFrame, queries: DataFrame, gold: DataFrame, k: int = 20, same: tuple[str, str] | None = None, ks: Sequence[int] = (1, 3, 5), **names: str) -> DataFrame:
    return retrieval_scores(ranks(top_k(vectors, queries, k + 1, same=same, **names), gold, queries), ks)


def adaptive_window(length: str, short: int = 60, long: int = 200, sizes: tuple[int, int, int] = (5, 3, 2)):
    """Short sentences look further: the window by length in characters."""
    return F.when(F.col(length) < short, sizes[0]).when(F.col(length) < long, sizes[1]).otherwise(sizes[2])


def bucket_scores(r: DataFrame, bucket: str, k: int = 5) -> DataFrame:
    """(bucket, n, covered, hit): retrieval by buckets, such as lengths; covered counts queries that have gold."""
    return r.groupBy(bucket).agg(F.count("*").alias("n"), F.count_if(F.col("has_gold")).alias("covered"), F.avg(F.when(F.col("first_hit") <= k, 1.0).otherwise(0.0)).alias("hit"))


def hardest(r: DataFrame, n: int) -> DataFrame:
    """The queries whose first gold hit comes last; without any hit first of all."""
    return r.orderBy(F.col("first_hit").desc_nulls_first(), "query_id").limit(n)


# Words that make no key term.
_STOP = "the a an and or of to in for on with by at from is are was were be been has have had this that these those it its as will would can could may might".split()


def key_terms(text):
    """The distinct lower-cased words of three letters and more that are not stop words."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}$%.,]{3,})"), F.lit(1)))
    return F.filter(F.transform(w, lambda x: F.regexp_replace(x, r"[.,]+$", "")), lambda x: ~x.isin(*_STOP) & (F.length(x) >= 3))


def found_share(terms, text):
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(text, t))).cast("double") / F.size(terms)).otherwise(1.0)


def answer_scores(df: DataFrame, query: str, response: str, truth: str, facts: str, passing: float = 0.7) -> DataFrame:
    """df with factual, completeness, relevance, conciseness, overall and passed; a null response scores 0 throughout.

    A fact counts 1 if it stands in the response and 0.7 if 70 % of its key terms do.
    """
    low = F.lower(F.coalesce(response, F.lit("")))
    fact = lambda f: F.when(F.contains(low, F.lower(f)), 1.0).when((F.size(key_terms(f)) > 0) & (found_share(key_terms(f), low) >= 0.7), 0.7).otherwise(0.0)
    total = F.aggregate(F.transform(F.col(facts), fact), F.lit(0.0).cast("double"), lambda s, x: s + x)
    n = F.size(F.split(F.trim(low), r"\s+"))
    some = F.trim(low) != ""
    out = df.withColumns({
        "factual": F.when(some, F.when(F.size(facts) > 0, total / F.size(facts)).otherwise(1.0)).otherwise(0.0), "completeness": F.when(some, found_share(key_terms(F.col(truth)), low)).otherwise(0.0),
        "relevance": F.when(some, F.least(F.lit(1.0), found_share(key_terms(F.col(query)), low) + F.when(F.length(response) < 1000, 0.1).otherwise(0.0))).otherwise(0.0),
        "conciseness": F.when(some, F.when(n < 50, n / 50.0).when(n <= 300, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (n - 300) / 700.0))).otherwise(0.0),
    })
    out = out.withColumn("overall", F.col("factual") * 0.4 + F.col("completeness") * 0.3 + F.col("relevance") * 0.2 + F.col("conciseness") * 0.1)
    return out.withColumn("passed", F.col("overall") >= passing)


@F.pandas_udf(T.DoubleType())
def rouge_l(answer: pd.Series, truth: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words; 0 where either is null or without words."""

    def one(a, b):
        a, b = (a or "").lower().split(), (b or "").lower().split()
        if not a or not b:
            return 0.0
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                keep = row[j]
                row[j] = last + 1 if x == y else max(row[j], row[j - 1])
                last = keep
        n = row[-1]
        return 2 * n / (len(a) + len(b))

    return pd.Series([one(a, b) for a, b in zip(answer, truth)], dtype="float64")


def log_summary(log: DataFrame, by: str | None = None) -> DataFrame:
    """Counts, tokens, cost and times of a question log, in total or by a column such as model_id or error_type."""
    aggs = [F.count("*").alias("n"), F.count("error").alias("n_errors"), F.sum("total_tokens").alias("tokens"), F.sum("cost").alias("cost"), F.avg("processing_time_ms").alias("avg_ms"), F.max("processing_time_ms").alias("max_ms")]
    return log.groupBy(by).agg(*aggs) if by else log.agg(*aggs)


def step_durations(log: DataFrame, step: str = "step", at: str = "at") -> DataFrame:
    """The log with the time since the step before."""
    return log.withColumn("duration", F.col(at) - F.lag(at).over(Window.orderBy(step)))
