"""Folders that driver and executors share, and files of one document per image in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir; a local session without that setting takes a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="scenegrain-")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written as Parquet to a new shared folder and read again, with the path: what follows doesn't work it out anew."""
    path = shared(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def packed(documents: DataFrame, tag: str) -> DataFrame:
    """Documents (image_id, value) written to a shared folder and read again, as rows of Parquet files.

    What readers take for a folder of one file per image: a file and a folder for each image cost some
    10 ms to write and as much to list and read, so the documents of many images share a file here.
    """
    return stored(documents.select("image_id", "value"), tag)[0]


def write_per_image(documents: DataFrame, path: str) -> str:
    """Documents (image_id as group/stem, value) as one file each: group=<group>/stem=<stem>/part-*.txt. For those who need files: see packed()."""
    parts = F.split("image_id", "/", 2)
    rows = documents.select(parts[0].alias("group"), parts[1].alias("stem"), "value")
    # the number is given, since small documents would else be coalesced into one task, which opens all files
    rows.repartition(documents.sparkSession.sparkContext.defaultParallelism, "group", "stem").write.partitionBy("group", "stem").text(path)
    return path
