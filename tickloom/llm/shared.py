"""Folders all executors share, and frames cut off from their lineage by a written table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where a local session has none, one is made and set."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-shared-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def text_key(text: str) -> Column:
    """The digest that tells rows with one doc_id and different texts apart; null for a null text."""
    return F.unhex(F.md5(text))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: a lost executor then costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
