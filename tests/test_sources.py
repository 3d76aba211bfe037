"""Reading, writing, replacing and streams, on files of the test's own."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from marlstone.sources import formats
from marlstone.sources.catalog import Catalog
from marlstone.streaming import flows


def test_formats_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, s string")
    formats.write_parquet(df, f"{tmp_path}/t.parquet")
    df.write.option("header", "true").csv(f"{tmp_path}/t.csv")
    formats.write_json(df, f"{tmp_path}/t.json")
    for k in ("parquet", "csv", "json"):
        assert formats.read(spark, f"{tmp_path}/t.{k}").count() == 2
    assert formats.read_many(spark, [f"{tmp_path}/t.parquet"] * 2, ["id"]).count() == 4
    c = Catalog(spark, str(tmp_path))
    assert c.rows_by_ids("t", "id", df.select("id").limit(1)).count() == 1
    with pytest.raises(FileNotFoundError):
        c.table("none")


def test_keyed_json_sheet_and_index(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "A"}, "1": {"cik_str": 8, "ticker": "B"}}))
    assert {r["ticker"] for r in formats.read_keyed_json(spark, f"{tmp_path}/m.json", "cik_str: bigint, ticker: string").collect()} == {"A", "B"}
    (tmp_path / "s.csv").write_text("Fund title,,\n,,\nName,Ticker,Weight\nAcme,ACM,1.5\n")
    got = formats.read_sheet(spark, f"{tmp_path}/s.csv", ["name", "ticker", "weight"], "Name").collect()
    assert [tuple(r) for r in got] == [("Acme", "ACM", "1.5")]
    (tmp_path / "i.txt").write_text("0000123|Acme|10-K|2020|2019|a/b|x|1|DE|1231|u|9|i|ok\n1|B|8-K|||||||||||\n")
    (r,) = formats.read_filing_index(spark, f"{tmp_path}/i.txt", "http://x/", ["10-K"]).collect()
    assert (r["cik"], r["url"]) == (123, "http://x/a/b")


def test_footers_and_logs(spark, tmp_path):
    formats.write_parquet(spark.range(1000).coalesce(1), f"{tmp_path}/t.parquet", most_rows=400)
    files = sorted(str(p) for p in (tmp_path / "t.parquet").glob("*.parquet"))
    assert formats.row_group_summary(formats.footers(spark, files)).first()["n_rows"] == 1000 and len(files) == 3
    for _ in range(2):
        formats.append_log(spark.range(3), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6
    with pytest.raises(FileNotFoundError):
        formats.preflight(spark, [f"{tmp_path}/log", f"{tmp_path}/nothing"])


def test_replace_keeps_few_backups(spark, tmp_path):
    for i in range(4):
        formats.replace(spark.range(i + 1), f"{tmp_path}/t.parquet", f"{tmp_path}/old", 2, datetime.datetime(2024, 1, i + 1))
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 4
    assert len([p for p in (tmp_path / "old").iterdir() if p.is_dir()]) == 2


def test_batches_are_bounded_and_tried_again(spark, tmp_path):
    folder = str(tmp_path)

    def send(batch):
        import os
        import uuid

        mark = f"{folder}/failed-once"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        assert len(batch) <= 7
        open(f"{folder}/{uuid.uuid4()}-{len(batch)}.sent", "w").close()

    got = formats.put_batches(spark.range(20).coalesce(1), send, most_rows=7, wait=0.01).collect()
    assert sum(r["rows"] for r in got) == 20 and sum(r["batches"] for r in got) == 3


def test_upsert_stream_twice(spark, tmp_path):
    schema = "k string, v int, at timestamp"
    day = lambda n: datetime.datetime(2024, 1, n)
    spark.createDataFrame([("a", 1, day(1)), ("a", 2, day(2)), ("b", 1, day(1))], schema).write.parquet(f"{tmp_path}/in")
    run = lambda: flows.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["k"], "at", f"{tmp_path}/cp").awaitTermination()
    run()
    spark.createDataFrame([("b", 7, day(3)), ("c", 1, day(3))], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("k", "v").orderBy("k").collect()] == [("a", 2), ("b", 7), ("c", 1)]


def test_running_totals_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "k string, v double").write.parquet(f"{tmp_path}/in")
    s = flows.running_totals(spark.readStream.schema("k string, v double").parquet(f"{tmp_path}/in"), "k", "v")
    q = s.writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("totals").collect()} == {("a", 2, 3.0), ("b", 1, 0.0)}


def test_windows_and_sessions(spark):
    t = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    e = spark.createDataFrame([("u", t(1), 1.0), ("u", t(1, 10), 2.0), ("u", t(5), 3.0)], "u string, ts timestamp, v double")
    assert flows.sessions(e, "ts", "u").count() == 2
    assert flows.windowed_counts(e, "ts", "u", "v", size="2 hours", slide="1 hour").agg(F.sum("n")).first()[0] == 6
