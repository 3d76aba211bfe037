"""Readers, writers and file chores. Paths go through Hadoop's file systems, so they may be local or remote."""

from __future__ import annotations

import datetime
import random
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# The columns of a filing index without header.
INDEX_COLUMNS = "cik company form filed period path accession sic state fiscal_end url size items status".split()


def read(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """The table at a path by its suffix: parquet, orc, csv, tsv, json (lines), json array with multiLine=true."""
    low = path.rstrip("/").lower().removesuffix(".gz")
    kind = next((k for k in ("parquet", "orc", "csv", "tsv", "json", "jsonl", "txt") if low.endswith("." + k)), "parquet")
    r = spark.read.options(**options)
    r = r.schema(schema) if schema else r
    if kind in ("csv", "tsv"):
        return r.options(header=options.get("header", "true"), sep=options.get("sep", "\t" if kind == "tsv" else ","), escape='"', multiLine="true").csv(path)
    if kind in ("json", "jsonl"):
        return r.json(path)
    return r.text(path) if kind == "txt" else r.format(kind).load(path)


def read_many(spark: SparkSession, paths: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Several tables one below the other by column names, missing ones null, sorted if asked."""
    out = None
    for p in paths:
        out = read(spark, p) if out is None else out.unionByName(read(spark, p), allowMissingColumns=True)
    return out.orderBy(*order) if order else out


def read_filing_index(spark: SparkSession, path: str, prefix: str, forms: Sequence[str]) -> DataFrame:
    """A pipe-separated index without header: 14 strings, url prefixed, wanted forms, keys as numbers."""
    schema = ", ".join(f"{c} string" for c in INDEX_COLUMNS)
    df = spark.read.schema(schema).option("sep", "|").csv(path)
    return df.where(F.trim("form").isin(*forms)).withColumn("url", F.concat(F.lit(prefix), "path")).withColumn("cik", F.trim("cik").try_cast("long")).where("cik is not null")


def read_keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON object {"0": {...}, "1": {...}} as rows (key, value fields)."""
    whole = spark.read.text(path, wholetext=True)
    m = whole.select(F.explode(F.from_json("value", f"map<string, struct<{value_schema}>>")).alias("key", "v"))
    return m.select("key", "v.*")


def read_sheet(spark: SparkSession, path: str, names: Sequence[str], header_mark: str, sep: str = ",") -> DataFrame:
    """A sheet saved as text, with titles above its header: positional names, rows up to the header and blank ones dropped."""
    df = spark.read.schema(", ".join(f"{n} string" for n in names)).options(sep=sep, escape='"').csv(path)
    body = df.where(F.col(names[0]).isNotNull() & (F.trim(names[0]) != header_mark))
    filled = sum(F.col(n).isNotNull().cast("int") for n in names)
    return body.where(filled > 1)


def filing_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, row_group, n_rows, n_bytes) of Parquet files, read by tasks, one file each; paths may be URIs of any file system."""

    def meta(rows):
        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs

        for pdf in rows:
            out = []
            for p in pdf["path"]:
                where, at = fs.FileSystem.from_uri(p) if ":/" in p else (fs.LocalFileSystem(), p)
                m = pq.ParquetFile(where.open_input_file(at)).metadata
                out += [(p, i, m.row_group(i).num_rows, m.row_group(i).total_byte_size) for i in range(m.num_row_groups)]
            yield pd.DataFrame(out, columns=["path", "row_group", "n_rows", "n_bytes"])

    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return df.repartition(max(1, len(paths))).mapInPandas(meta, "path string, row_group int, n_rows long, n_bytes long")


def row_group_summary(f: DataFrame) -> DataFrame:
    return f.agg(F.count_distinct("path").alias("n_files"), F.count("*").alias("n_row_groups"), F.sum("n_rows").alias("n_rows"), F.avg("n_rows").alias("avg_rows_per_group"), F.sum("n_bytes").alias("n_bytes"))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "zstd", row_group_bytes: int = 128 << 20, most_rows: int = 0, by: Sequence[str] = ()) -> None:
    """Written by the tasks, never gathered; row groups of about row_group_bytes, files of at most most_rows rows."""
    w = df.write.mode(mode).option("compression", compression).option("parquet.block.size", str(row_group_bytes))
    w = w.option("maxRecordsPerFile", most_rows) if most_rows else w
    (w.partitionBy(*by) if by else w).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Rows added to a log; nothing that is there is read or written again."""
    w = df.write.mode("append")
    w.option("header", "true").csv(path) if kind == "csv" else w.format(kind).save(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def preflight(spark: SparkSession, paths: Sequence[str]) -> None:
    """Raises with all paths that are missing."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))


def _move(fs, a, b) -> None:
    """A rename that raises where Hadoop only says false."""
    if not fs.rename(a, b):
        raise OSError(f"cannot move {a} to {b}")


def replace(df: DataFrame, path: str, archive: str | None = None, most_backups: int = 5, now: datetime.datetime | None = None) -> None:
    """Writes beside the path, moves what is there aside and the new table into its place, as two renames.

    The old table goes to the archive under its time, of which the most_backups latest stay, or is deleted once the new
    one is in place. If the second rename fails the old table is moved back. Readers see no table between the renames.
    """
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    fresh = f"{path.rstrip('/')}.new"
    write_parquet(df, fresh)
    new, old = _fs(spark, fresh)[1], None
    if fs.exists(target):
        stamp = (now or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y%m%dT%H%M%S%f")
        if archive:
            fs.mkdirs(_fs(spark, archive)[1])
        old = _fs(spark, f"{archive.rstrip('/')}/{stamp}.parquet" if archive else f"{path.rstrip('/')}.{stamp}.old")[1]
        _move(fs, target, old)
    try:
        _move(fs, new, target)
    except Exception:
        if old is not None:
            _move(fs, old, target)
        raise
    if old is not None and not archive:
        fs.delete(old, True)
    if archive and fs.exists(_fs(spark, archive)[1]):
        names = sorted(s.getPath().toString() for s in fs.listStatus(_fs(spark, archive)[1]))
        for n in names[: max(0, len(names) - most_backups)]:
            fs.delete(_fs(spark, n)[1], True)


def put_batches(rows: DataFrame, send: Callable[[list], None], most_rows: int = 500, most_bytes: int = 20 << 20, tries: int = 4, wait: float = 0.5) -> DataFrame:
    """(partition, batches, rows): rows handed to an outside index in bounded batches by the tasks, with retries that wait
    longer each time, by a random part of it. send must be idempotent, as a lost task is run again."""

    def go(it):
        import pandas as pd
        from pyspark import TaskContext

        batch, size, sent, n = [], 0, 0, 0

        def flush():
            nonlocal batch, size, sent, n
            for k in range(tries):
                try:
                    send(batch)
                    break
                except Exception:
                    if k == tries - 1:
                        raise
                    time.sleep(wait * 2**k * random.random())
            sent, n = sent + 1, n + len(batch)
            batch, size = [], 0

        for pdf in it:
            for r in pdf.to_dict("records"):
                b = sum(getattr(v, "nbytes", None) or len(str(v)) for v in r.values())
                if batch and (len(batch) >= most_rows or size + b > most_bytes):
                    flush()
                batch.append(r)
                size += b
        if batch:
            flush()
        yield pd.DataFrame([(TaskContext.get().partitionId(), sent, n)], columns=["partition", "batches", "rows"])

    return rows.mapInPandas(go, "partition int, batches long, rows long")
