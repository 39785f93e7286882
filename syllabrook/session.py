"""Session and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "syllabrook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; a cluster's own settings stay as they are."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; filters and columns chosen later reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a temporary folder takes its place on a single machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="syllabrook-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/syllabrook/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: whoever reads it twice sees the same rows, and a lost executor costs only its files."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
