"""Mixing sources to target shares: copies of each document by pivotal dependent rounding.

Every source gets the expected number of copies c = min(max_repeats, wanted / held) for each of its documents. The
whole part of c is certain; the fractional parts are rounded by the pivotal method: two fractions meet, one random
step moves mass from one to the other until one is integral, the other goes on. Tasks round their own documents and
leave one fraction each and source; those residuals meet in a tree of reductions until one is left, which is drawn.
The expected copies stay exactly c, and the sum over a source differs from its expectation by less than one copy.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern of the byte-level vocabulary; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str, most: int = 20_000) -> list[str]:
    """The text in pieces cut before a space, where the pattern cuts too."""
    out = []
    while len(text) > most:
        k = text.rfind(" ", 1, most)
        if k < 1 or text[k - 1].isspace():
            k = next((i for i in range(min(most, len(text) - 1), 0, -1) if text[i] == " " and not text[i - 1].isspace()), most)
        out.append(text[:k])
        text = text[k:]
    return [*out, text]


def token_counts(path: str = VOCABULARY):
    """A column function: tokens of the text by the vocabulary at path; 0 for null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series([0 if t is None else sum(len(e.encode_ordinary(p)) for p in _pieces(t)) for t in texts], dtype="int64")

    return count


def source_key(c: Column) -> Column:
    """Sources compared without letter case, outer white space or kind of separator."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_\-./]+", "_")


def _unit(seed: int, *key) -> float:
    """A number in [0, 1) that depends on the key alone, so a repeated task draws the same."""
    return int.from_bytes(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=8).digest(), "big") / 2**64


def pivot(rows: list[tuple], seed: int, level: int) -> tuple[list[tuple], tuple | None]:
    """(settled, residual) of (key, whole, fraction, ...) rows: settled ones have integral copies, at most one is left."""
    done, held = [], None
    for r in rows:
        if r[2] <= 1e-12 or r[2] >= 1 - 1e-12:
            done.append((*r[:1], r[1] + round(r[2]), 0.0, *r[3:]))
            continue
        if held is None:
            held = r
            continue
        p, q, u = held[2], r[2], _unit(seed, level, held[0], r[0])
        if p + q < 1:
            win, lose = (held, r) if u < p / (p + q) else (r, held)
            done.append((lose[0], lose[1], 0.0, *lose[3:]))
            held = (win[0], win[1], p + q, *win[3:])
        else:
            full, rest = (held, r) if u < (1 - q) / (2 - p - q) else (r, held)
            done.append((full[0], full[1] + 1, 0.0, *full[3:]))
            held = (rest[0], rest[1], p + q - 1, *rest[3:])
            if held[2] <= 1e-12:
                done.append((held[0], held[1], 0.0, *held[3:]))
                held = None
    return done, held


OUT = "doc_id long, source string, n_tokens long, uses long, left double"


def _round(batches: Iterator[pa.RecordBatch], seed: int, level: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, source, n_tokens, uses, left); rounds each source's fractions, leaving at most one of each in this task."""
    held: dict[str, tuple] = {}
    batch_of = lambda rows: pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "source": [r[3] for r in rows], "n_tokens": [r[4] for r in rows], "uses": [r[1] for r in rows], "left": [r[2] for r in rows]}, schema=pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64()), ("uses", pa.int64()), ("left", pa.float64())]))
    for batch in batches:
        by: dict[str, list] = {}
        for doc, source, tokens, uses, left in zip(*(c.to_pylist() for c in batch.columns)):
            by.setdefault(source, []).append((doc, uses, left, source, tokens))
        out = []
        for source, rows in by.items():
            done, held_now = pivot(([held.pop(source)] if source in held else []) + rows, seed, level)
            out += done
            if held_now is not None:
                held[source] = held_now
        if out:
            yield batch_of(out)
    if held:
        yield batch_of(list(held.values()))


def sized(docs: DataFrame, doc_id: str, text: str, source: str, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that have a source and a text that is not blank."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), source_key(F.col(source)).alias("source"), F.col(text).alias("text"))
    rows = rows.where(F.col("source").isNotNull() & (F.col("source") != "") & F.col("text").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}\x{FEFF}\x{200B}]"))
    return rows.select("doc_id", "source", token_counts(path)(F.col("text")).alias("n_tokens"))


def targets(mix: DataFrame) -> DataFrame:
    """(source, name, share, repeats) of the target table, each source once."""
    rows = mix.select(source_key(F.col("source")).alias("source"), F.col("source").alias("name"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("repeats"))
    return rows.where("source is not null and source <> ''").groupBy("source").agg(F.min("name").alias("name"), F.max("share").alias("share"), F.max("repeats").alias("repeats"))


def source_report(sizes: DataFrame, mix: DataFrame, budget: int) -> DataFrame:
    """(source, name, n_docs, held, wanted, repeats, copies): a row for each target source, also without documents.

    held: its tokens, wanted: share times budget, copies: mean uses of a document.
    """
    held = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("held"))
    t = targets(mix).join(held, "source", "left")
    return t.select(
        "source", "name", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("held", F.lit(0)).alias("held"), (F.col("share") * F.lit(float(budget))).alias("wanted"), F.coalesce("repeats", F.lit(1)).alias("repeats"),
    ).withColumn("copies", F.when(F.col("held") > 0, F.least(F.col("repeats").cast("double"), F.col("wanted") / F.col("held"))).otherwise(0.0))


def mix(docs: DataFrame, mix_targets: DataFrame, budget: int, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(uses, report). uses: (doc_id, source, n_tokens, uses), a row for each document of a target source, also with no use;
    report: source_report with the tokens and the share that were reached, the most and fewest uses of a document, and
    short: the rounding has used every document as often as allowed and the tokens are still fewer than wanted.

    A budget of null or 0 asks for nothing. Sources that only the documents have take no part. No source's documents
    are ever gathered: tasks round their rows as they stand, and only one residual a task and source moves on.
    """
    sizes = sized(docs, doc_id, text, source, path).persist(StorageLevel.MEMORY_AND_DISK)
    report = source_report(sizes, mix_targets, int(budget or 0))
    rates = [(r["source"], r["name"], r["copies"]) for r in report.select("source", "name", "copies").toLocalIterator()]  # a row a target
    rate = sizes.sparkSession.createDataFrame(rates, "source string, name string, copies double")
    rows = sizes.join(F.broadcast(rate), "source").select("doc_id", "source", "n_tokens", F.floor(F.col("copies") + 1e-12).cast("long").alias("uses"), F.greatest(F.lit(0.0), F.col("copies") - F.floor(F.col("copies") + 1e-12)).alias("left"))
    level, left = rows.mapInArrow(lambda it: _round(it, seed, 0), OUT).persist(StorageLevel.MEMORY_AND_DISK), None
    settled = level.where("left = 0")
    left = level.where("left > 0")
    tasks, k = max(1, left.rdd.getNumPartitions()), 1
    while tasks > 1:  # residuals of eight tasks meet in one
        tasks = -(-tasks // 8)
        step = left.repartition(tasks, F.pmod(F.xxhash64("doc_id"), F.lit(tasks))).sortWithinPartitions("source", "doc_id").mapInArrow(lambda it, k=k: _round(it, seed, k), OUT).persist(StorageLevel.MEMORY_AND_DISK)
        settled, left = settled.unionByName(step.where("left = 0")), step.where("left > 0")
        k += 1
    last = left.select("doc_id", "source", "n_tokens", (F.col("uses") + (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.col("left")).cast("long")).alias("uses"))
    uses = settled.drop("left").unionByName(last)
    got = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"), F.min("uses").alias("fewest_uses"))
    report = report.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    report = report.withColumn("short", (F.coalesce("fewest_uses", "repeats") >= F.col("repeats")) & (F.col("tokens") < F.col("wanted")))
    total = report.agg(F.sum("tokens").alias("all_tokens"))
    report = report.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0)).drop("all_tokens")
    return uses.join(F.broadcast(rate.select("source", "name")), "source").select("doc_id", F.col("name").alias("source"), "n_tokens", "uses"), report.drop("source").withColumnRenamed("name", "source")
