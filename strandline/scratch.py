"""Shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.files import delete_folder

_made: list[str] = []


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Only a local master may leave the setting out and gets a local folder: on a cluster every executor would write
    to a disk of its own. The folders stay until :func:`discard_scratch`, since the frames that read them are lazy.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # local, local[4], local[*, 2]; local-cluster[...] has executors of its own.
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strandline-")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def discard_scratch(spark: SparkSession) -> None:
    """Delete the folders this process asked for. Call it when no frame that reads them is left."""
    while _made:
        delete_folder(spark, _made.pop())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of the files, not a re-run of the plan, and
    values that depend on the run (range bounds, row ids) are fixed from here on.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
