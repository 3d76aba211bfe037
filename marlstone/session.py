"""Session building and the few settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, ANSI casts and adaptive execution on; conf overrides any of them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir if the session names one.

    A temporary folder of this machine is taken only for a local master, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"marlstone-{spark.sparkContext.applicationId}")
    os.makedirs(made, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: With it on, Spark deletes a plan's shuffle files as soon as the plan has run.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder, without its lineage; the shuffle files it took are deleted at once.

    The kept files go when nothing refers to them any more if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEAN, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
