"""Exact nearest neighbours over a table of vectors, and what becomes of the hits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Queries scored together against a partition of vectors.
QUERY_BLOCK = 1_024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null for a zero vector."""
    return F.try_divide(dot(a, b), F.when(dot(a, a) * dot(b, b) > 0, F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def similarity_of(distance: Column) -> Column:
    return 1 - distance / 2


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", query_id: str = "query_id", query_vec: str = "query", same: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest vectors of each query by cosine distance, ties by smaller id.

    same=(vector column, query column) leaves a query the vectors that agree with it. Queries are a bounded set: they go
    to the tasks in blocks of QUERY_BLOCK, each partition of vectors keeps its own k best of every query, and only those
    are shuffled. Zero and null vectors, and those of another length, are nobody's neighbours.
    """
    spark = vectors.sparkSession
    have, asked = (same if same else (None, None))
    q = queries.select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("v"), *([F.col(asked).cast("string").alias("s")] if asked else [])).where("v is not null")
    source = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec).alias("v"), *([F.col(have).cast("string").alias("s")] if have else [])).where("v is not null")
    block: list = []
    parts: list[DataFrame] = []

    def best(rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(([r["q"] for r in rows], np.array([r["v"] for r in rows], dtype=np.float64), [r["s"] for r in rows] if asked else None))

        def score(it):
            ids, m, agree = sent.value
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            kept: list = [[] for _ in ids]
            asked_by = {} if agree is None else {s: np.array([a for a, t in enumerate(agree) if t == s]) for s in set(agree) if s is not None}
            for pdf in it:
                pdf = pdf[pdf["v"].map(len) == m.shape[1]]
                if not len(pdf):
                    continue
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(x, axis=1)
                x, i = x[norm > 0] / norm[norm > 0, None], pdf["i"].to_numpy()[norm > 0]
                if agree is None:
                    blocks = [(np.arange(len(ids)), np.arange(len(x)))]
                else:  # a query meets the vectors of its own group alone
                    own = pdf["s"].to_numpy()[norm > 0]
                    blocks = [(asked_by[s], np.flatnonzero(own == s)) for s in asked_by.keys() & set(own)]
                for queries_at, rows_at in blocks:
                    d = 1 - m[queries_at] @ x[rows_at].T
                    for row, a in zip(d, queries_at):
                        j = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.flatnonzero(~np.isnan(row))
                        j = j[np.lexsort((i[rows_at[j]], row[j]))[:k]]
                        kept[a] = sorted(kept[a] + list(zip(row[j].tolist(), i[rows_at[j]].tolist())))[:k]
            yield pd.DataFrame([(ids[a], i, d) for a in range(len(ids)) for d, i in kept[a]], columns=["query_id", "id", "distance"])

        return source.mapInPandas(score, f"query_id {dict(queries.dtypes)[query_id]}, id long, distance double")

    for r in q.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            parts.append(best(block))
            block = []
    if not block and not parts:
        return spark.createDataFrame([], f"query_id {dict(queries.dtypes)[query_id]}, id long, distance double, rank int")
    if block:
        parts.append(best(block))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieve(vectors: DataFrame, queries: DataFrame, k_filtered: int, k_global: int, same: tuple[str, str], least_similarity: float = 0.0, variants: DataFrame | None = None, **names: str) -> DataFrame:
    """(query_id, id, distance, source, variant_id): filtered and global hits of the queries, filtered ones of their variants.

    Variants are rows like queries with a variant_id. Hits whose similarity 1 - distance / 2 is below the least are dropped.
    """
    one = top_k(vectors, queries, k_filtered, same=same, **names).withColumn("source", F.lit("filtered")).withColumn("variant_id", F.lit(0))
    out = one.unionByName(top_k(vectors, queries, k_global, **names).withColumn("source", F.lit("global")).withColumn("variant_id", F.lit(0)))
    if variants is not None:
        key = F.struct("query_id", "variant_id")
        v = top_k(vectors, variants.withColumn("_k", F.to_json(key)).drop("query_id").withColumnRenamed("_k", "query_id"), k_filtered, same=same, **names)
        v = v.withColumn("_k", F.from_json("query_id", f"query_id {dict(queries.dtypes)['query_id']}, variant_id int"))
        out = out.unionByName(v.select("_k.query_id", "id", "distance", "rank", F.lit("filtered").alias("source"), "_k.variant_id"))
    return out.where(similarity_of(F.col("distance")) >= least_similarity).drop("rank")


def dedupe_hits(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, distance, sources, variant_ids): the least distance of each hit and, in order, where it came from."""
    return hits.groupBy(*keys).agg(F.min("distance").alias("distance"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("variant_id")).alias("variant_ids"))


def proportional(hits: DataFrame, query: str, limit: int, share: float = 0.75, rest: float = 0.25, tie: str = "id") -> DataFrame:
    """hits with primary_source and final_rank: int(limit share) filtered hits and int(limit rest) global ones, filled up.

    A hit found both ways is a filtered one. Places left are filled from the filtered hits if any are left over, else
    from the global ones.
    """
    a, b = int(limit * share), int(limit * rest)
    h = hits.withColumn("primary_source", F.when(F.array_contains("sources", "filtered"), "filtered").otherwise("global"))
    h = h.withColumn("_rn", F.row_number().over(Window.partitionBy(query, "primary_source").orderBy("distance", tie)))
    w = Window.partitionBy(query)
    h = h.withColumns({"_f": F.count_if(F.col("primary_source") == "filtered").over(w), "_g": F.count_if(F.col("primary_source") == "global").over(w)})
    left = F.lit(limit) - F.least(F.col("_f"), F.lit(a)) - F.least(F.col("_g"), F.lit(b))
    more_f = F.when(F.col("_f") > a, left).otherwise(0)
    more_g = F.when(F.col("_f") > a, 0).otherwise(left)
    keep = F.when(F.col("primary_source") == "filtered", F.col("_rn") <= a + more_f).otherwise(F.col("_rn") <= b + more_g)
    return h.where(keep).drop("_rn", "_f", "_g").withColumn("final_rank", F.row_number().over(Window.partitionBy(query).orderBy("distance", tie)))


def search_and_filter(vectors: DataFrame, queries: DataFrame, k: int, attributes: DataFrame, keep: Column, most_distance: float, text: str, multiplier: int = 4) -> DataFrame:
    """(query_id, id, distance, rank): k nearest of those that keep holds for, under most_distance, one for each text.

    Rather than fetch more and filter, the filter comes first, and while a query has k times multiplier hits within
    most_distance but under k texts, multiplier grows; so no hit is lost.
    """
    ok = vectors.join(attributes.where(keep).select(F.col("id").alias("vec_id"), F.col(text).alias("_t")), "vec_id")
    while True:
        hits = top_k(ok, queries, k * multiplier).where(F.col("distance") <= most_distance).join(ok.select(F.col("vec_id").alias("id"), "_t"), "id")
        short = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct(F.struct("_t")).alias("texts")).where((F.col("n") >= k * multiplier) & (F.col("texts") < k))
        if not short.take(1):
            break
        multiplier *= 4
    one = hits.withColumn("_d", F.row_number().over(Window.partitionBy("query_id", "_t").orderBy("distance", "id"))).where("_d = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def compile_filter(spec: dict, fields: Sequence[str]) -> Column:
    """A filter of $eq, $ne, $in, $gt, $gte, $lt, $lte, $and and $or as a column; other names and operators raise."""
    ops = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$in": lambda c, v: c.isin(*v), "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}
    out = F.lit(True)
    for name, value in spec.items():
        if name in ("$and", "$or"):
            parts = [compile_filter(v, fields) for v in value]
            if not parts:
                raise ValueError(f"{name} needs parts")
            one = parts[0]
            for p in parts[1:]:
                one = one & p if name == "$and" else one | p
        elif name not in fields:
            raise ValueError(f"unknown field {name}")
        else:
            one = None
            for op, v in (value if isinstance(value, dict) else {"$eq": value}).items():
                if op not in ops:
                    raise ValueError(f"unknown operator {op}")
                one = ops[op](F.col(name), v) if one is None else one & ops[op](F.col(name), v)
        out = out & one
    return out


def question_filter(ciks: Sequence[int] = (), years: Sequence[int] = (), sections: Sequence[str] = (), as_of_year: int | None = None) -> dict:
    """The filter of one question: its companies, its years (past ones if it has any) and its sections."""
    parts: list[dict] = []
    past = [y for y in years if as_of_year is None or y <= as_of_year] or list(years)
    if ciks:
        parts.append({"cik_int": {"$in": list(ciks)}})
    if past:
        parts.append({"report_year": {"$in": past}})
    if len(sections) == 1:
        parts.append({"section_name": {"$eq": sections[0]}})
    elif sections:
        parts.append({"$or": [{"section_name": {"$eq": s}} for s in sections]})
    return parts[0] if len(parts) == 1 else {"$and": parts} if parts else {}


def global_filter(first_year: int = 2015) -> dict:
    return {"report_year": {"$gte": first_year}}


def build_stage(meta: DataFrame, vectors: DataFrame, key: str, vec: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """(rows, audit): meta with its vectors and a 64-bit surrogate; counts of rows, wrong dimensions and surrogate collisions."""
    rows = meta.join(vectors.where(F.col(vec).isNotNull()).select(key, vec), key).withColumn("surrogate", F.xxhash64(key))
    n = rows.agg(F.count("*").alias("n_rows"), F.count_if(F.size(vec) != dims).alias("wrong_dims"), (F.count_distinct(key) - F.count_distinct("surrogate")).alias("collisions"))
    return rows, n


def parity(meta: DataFrame, vectors: DataFrame, key: str, lineage: str, size: str) -> DataFrame:
    """(issue, n) between a meta table and its vectors: missing on either side, repeated, null lineage, wrong size, stale."""
    v = vectors.groupBy(key).agg(F.count("*").alias("_n"), F.max(lineage).alias("_v"), F.max(size).alias("_s"))
    j = meta.select(key, F.col(lineage).alias("_m"), F.lit(1).alias("_meta")).join(v, key, "full_outer")
    one = j.agg(
        F.count_if(F.col("_meta").isNull()).alias("missing_in_meta"), F.count_if(F.col("_n").isNull()).alias("missing_vector"), F.count_if(F.col("_n") > 1).alias("duplicate_vectors"),
        F.count_if(F.col("_meta").isNotNull() & F.col("_m").isNull()).alias("null_lineage"), F.count_if(F.col("_m") != F.col("_v")).alias("stale"),
    )
    return one.unpivot([], one.columns, "issue", "n")


def run_summary(vectors: DataFrame, run: str, vec: str) -> DataFrame:
    """(run, n, min_dims, max_dims, avg_dims) of each embedding run."""
    return vectors.groupBy(run).agg(F.count("*").alias("n"), F.min(F.size(vec)).alias("min_dims"), F.max(F.size(vec)).alias("max_dims"), F.avg(F.size(vec)).alias("avg_dims"))


def gaps(meta: DataFrame, done: DataFrame, key: str, group: Sequence[str], least_pct: float = 0.0) -> DataFrame:
    """(group, total, embedded, gap_pct) of the groups whose share without vectors reaches least_pct; 100 means no coverage."""
    j = meta.select(key, *group).join(done.select(key).distinct().withColumn("_d", F.lit(1)), key, "left")
    g = j.groupBy(*group).agg(F.count("*").alias("total"), F.count("_d").alias("embedded"))
    return g.withColumn("gap_pct", (F.col("total") - F.col("embedded")) * F.lit(100.0).cast("double") / F.col("total")).where(F.col("gap_pct") >= least_pct)


def update_lineage(meta: DataFrame, run: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """meta with columns taken from run where it has the key, the other rows as they were; as many rows as before."""
    r = run.groupBy(key).agg(*(F.max(c).alias(f"_{c}") for c in columns), F.lit(1).alias("_hit"))
    j = meta.join(r, key, "left")
    return j.withColumns({c: F.when(F.col("_hit").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*meta.columns)


def greedy_batches(df: DataFrame, key: str, tokens: str, most_rows: int, most_tokens: int, partitions: int | None = None, group: Column | None = None) -> DataFrame:
    """(key, tokens, batch): rows in key order packed into batches of at most most_rows rows and most_tokens tokens.

    Rows of more than most_tokens alone are outliers with a null batch. Packing is sequential within a range of keys:
    the values of group, which name the batches for good, or else ranges that Spark cuts. Null tokens count 0.
    """
    src = df.select(F.col(key).alias("key"), F.col(tokens).cast("long").alias("tokens"), *([group.cast("string").alias("part")] if group is not None else []))
    if group is not None:
        src = src.repartition("part").sortWithinPartitions("part", "key")
    else:
        src = (src.repartitionByRange(partitions, "key") if partitions else src.repartitionByRange("key")).sortWithinPartitions("key").withColumn("part", F.spark_partition_id().cast("string"))

    def pack(it):
        batch, n, t, own = 0, 0, 0, None
        for pdf in it:
            out = []
            for k, tok, part in zip(pdf["key"], pdf["tokens"], pdf["part"]):
                if part != own:
                    batch, n, t, own = 0, 0, 0, part
                tok = 0 if pd.isna(tok) else int(tok)
                if tok > most_tokens:
                    out.append((k, tok, None))
                    continue
                if n and (n + 1 > most_rows or t + tok > most_tokens):
                    batch, n, t = batch + 1, 0, 0
                n, t = n + 1, t + tok
                out.append((k, tok, f"{part}-{batch}"))
            yield pd.DataFrame(out, columns=["key", "tokens", "batch"])

    return src.mapInPandas(pack, f"key {dict(src.dtypes)['key']}, tokens long, batch string")
