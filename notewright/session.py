"""Session settings that the operators rely on, and the shared folder for what they write between jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "notewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings win over the defaults here."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and the session is a local one, a private folder is made and
    remembered in the session; elsewhere that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("notewright.shared.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = os.path.join(tempfile.mkdtemp(prefix="shared-"), "data")
    spark.conf.set("notewright.shared.dir", folder)
    return folder


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage, survives the loss of executors, and keeps column pruning and
    file statistics, which ``checkpoint()`` gives up.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` by way of the shared folder; see :func:`stage`."""
    return stage(df)
