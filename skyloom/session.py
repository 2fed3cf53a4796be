"""Session defaults and small helpers every module shares."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def session(app: str = "skyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="skyloom-ship-")
    target = os.path.join(folder, "skyloom-src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.join("skyloom", os.path.relpath(full, PACKAGE)))
    known = list(sys.path)
    spark.sparkContext.addPyFile(target)
    sys.path[:] = known  # the driver goes on with its own copy
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "skyloom-shared")
    return f"{root.rstrip('/')}/skyloom/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """A small intermediate table computed once: a checkpoint in the shared folder where one is set, else persisted with a copy on disk."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """An intermediate table of any size computed once: written to the shared folder and read back."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
