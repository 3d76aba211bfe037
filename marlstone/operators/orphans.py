"""References to records that do not exist: bitmap AND-NOT by key range and period.

Keys are spread over ranges by hash and numbered inside each range, so a key is (range, number). A range holds one
compressed bitmap for each period of the references, one for each period in which parents arrived and one for the
removals. References AND-NOT parents that arrived before leaves the orphans of the period and those parents that
arrived within or after it; a final comparison of time stamps settles the latter. Surviving bits are decoded to keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Keys of a range; a range is one group of the shuffle, its bitmaps have that many bits.
RANGE_KEYS = 50_000
PARENT, REMOVED, REFERENCE = 0, 1, 2
_EVER = -(1 << 31)  # the period of parents without a time, and of references without one


def normal_key(c: Column) -> Column:
    """A key without outer white space of any kind, in upper case; blank ones are null."""
    k = F.upper(F.regexp_replace(c.cast("string"), r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
    return F.when(k != "", k)


def month(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


class Bitmap:
    """A set of small integers; kept deflated, as most bits of a period are zero."""

    def __init__(self, codes: np.ndarray, size: int):
        bits = np.zeros(size, dtype=bool)
        bits[codes] = True
        self.size, self.held = size, zlib.compress(np.packbits(bits).tobytes(), 1)

    def packed(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.held), dtype=np.uint8)


def decode(packed: np.ndarray, size: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(packed, count=size))


def _range(rows: pa.Table) -> tuple | None:
    """(keys, periods, kinds, arrivals) of one range's surviving bits."""
    coded = rows.column("key").combine_chunks().dictionary_encode()
    keys, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    role, period = rows.column("role").to_numpy(), rows.column("period").to_numpy()
    size = len(keys)
    arrival = np.full(size, np.iinfo(np.int64).min)
    own = role == PARENT
    arrival[code[own]] = pc.fill_null(rows.column("at"), np.iinfo(np.int64).min).to_numpy()[own]
    maps = {(r, p): Bitmap(code[(role == r) & (period == p)], size) for r, p in {*zip(role.tolist(), period.tolist())}}
    ever, gone = np.zeros((size + 7) // 8, np.uint8), np.zeros((size + 7) // 8, np.uint8)
    for (r, _), m in maps.items():
        if r == PARENT:
            ever = ever | m.packed()
        elif r == REMOVED:
            gone = gone | m.packed()
    arrived, before = sorted(p for r, p in maps if r == PARENT), np.zeros_like(ever)
    out = []
    for p in sorted(p for r, p in maps if r == REFERENCE):
        while arrived and arrived[0] < p:
            before = before | maps[PARENT, arrived.pop(0)].packed()
        left = maps[REFERENCE, p].packed() & ~(ever if p == _EVER else before)
        for kind, bits in (("missing", left & ~ever & ~gone), ("deleted", left & ~ever & gone), ("late", left & ever)):
            at = decode(bits, size)
            if len(at):
                out.append((at, np.full(len(at), p), np.full(len(at), kind, dtype=object)))
    if not out:
        return None
    at = np.concatenate([o[0] for o in out])
    return keys.take(pa.array(at)), np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out]), arrival[at]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through ranges in order; a range may reach over batches."""
    held: list[pa.RecordBatch] = []

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            got = _range(pa.Table.from_batches(held))
            held.clear()
            if got:
                yield pa.RecordBatch.from_arrays([got[0].cast(pa.string()), pa.array(got[1], pa.int32()), pa.array(got[2].tolist(), pa.string()), pa.array(got[3], pa.int64())], names=["missing_id", "period", "orphan_kind", "arrival"])

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(0)[0].as_py() != part[a]:
                yield from close()
            held.append(batch.slice(a, b - a))
    yield from close()


def orphans(references: DataFrame, parents: DataFrame, removals: DataFrame, expected_keys: int | None = None) -> DataFrame:
    """(ref_key, missing_id, period, orphan_kind), distinct: references (ref_key, key, at, period) without a parent (key, at).

    Keys are compared as normal_key gives them; null and blank ones are no references. deleted: no parent, but in
    removals (key). missing: in neither. late: the first parent's at is after the reference's; a null at on either
    side is never late. period is an int that grows with at where both are given, null allowed. Repeated rows count once.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    refs = references.select("ref_key", normal_key(F.col("key")).alias("key"), micros(F.col("at")).alias("at"), F.col("period").cast("int").alias("period")).where("key is not null")
    ever = F.lit(_EVER)
    compared = F.when(F.col("at").isNull(), ever).otherwise(F.coalesce("period", ever))
    refs = refs.withColumn("slot", compared)
    own = parents.select(normal_key(F.col("key")).alias("key"), F.col("at").cast("timestamp").alias("t")).where("key is not null").groupBy("key").agg(F.min("t").alias("t"))
    own = own.select("key", F.lit(PARENT).alias("role"), F.coalesce(month(F.col("t")), ever).alias("period"), micros(F.col("t")).alias("at"))
    gone = removals.select(normal_key(F.col("key")).alias("key")).where("key is not null").distinct().select("key", F.lit(REMOVED).alias("role"), ever.alias("period"), F.lit(None).cast("long").alias("at"))
    asked = refs.select("key", F.col("slot").alias("period")).distinct().select("key", F.lit(REFERENCE).alias("role"), "period", F.lit(None).cast("long").alias("at"))
    count = expected_keys or own.count()
    ranges = max(1, -(-2 * count // RANGE_KEYS))
    every = own.unionByName(gone).unionByName(asked).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
    tasks = max(int(references.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges // 4)
    bits = every.repartition(tasks, "part").sortWithinPartitions("part").select("part", "key", "role", "period", "at").mapInArrow(_ranges, "missing_id string, period int, orphan_kind string, arrival long")
    bits = bits.withColumnRenamed("period", "slot")
    joined = refs.withColumnRenamed("key", "missing_id").join(bits, ["missing_id", "slot"])
    return joined.where((F.col("orphan_kind") != "late") | (F.col("arrival") > F.col("at"))).select("ref_key", "missing_id", "period", "orphan_kind").distinct()


def gold_references(gold: DataFrame) -> DataFrame:
    """The evidence entries of each question; null and empty lists give none."""
    return gold.select(F.col("question_id").alias("ref_key"), F.explode("evidence_sentence_ids").alias("key"), F.col("created_at").alias("at"), month(F.col("created_at")).alias("period"))


def filing_orphans(gold: DataFrame, core: DataFrame, corpus: DataFrame, removals: DataFrame, first_year: int = 2006, last_year: int = 2020) -> DataFrame:
    """(ref_table, ref_key, missing_id, orphan_kind, period) of gold evidence against the core and of the core against the corpus.

    period is the month of created_at as yyyymm for the former and report_year for the latter, null where unknown.
    """
    gone = removals.select(F.col("sentenceID").alias("key"))
    cited = orphans(gold_references(gold), core.select(F.col("sentenceID").alias("key"), F.col("sample_created_at").alias("at")), gone)
    sampled = core.where(F.col("report_year").between(first_year, last_year)).select(F.col("sentenceID").alias("ref_key"), F.col("sentenceID").alias("key"), F.lit(None).cast("timestamp").alias("at"), F.col("report_year").alias("period"))
    kept = orphans(sampled, corpus.select(F.col("sentenceID").alias("key"), F.lit(None).cast("timestamp").alias("at")), gone)
    columns = ["ref_table", "ref_key", "missing_id", "orphan_kind", "period"]
    cited = cited.withColumn("ref_table", F.lit("p3_gold_p3v3_new10")).withColumn("period", (F.floor(F.col("period") / 12) * 100 + F.pmod(F.col("period"), F.lit(12)) + 1).cast("int"))
    return cited.select(columns).unionByName(kept.withColumn("ref_table", F.lit("v_sample_1m_core")).select(columns))


def orphan_report(found: DataFrame) -> DataFrame:
    """(ref_table, period, orphan_kind, n_references, n_keys) over filing_orphans."""
    return found.groupBy("ref_table", "period", "orphan_kind").agg(F.count("*").alias("n_references"), F.count_distinct("missing_id").alias("n_keys"))
