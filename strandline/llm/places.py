"""Rows told apart by where they are stored, so that repeated rows and null identifiers stay apart."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.frames import fresh
from strandline.scratch import stored

PLACE = "struct<file:string,row:bigint>"


def placed(df: DataFrame, column: str = "_place") -> DataFrame:
    """``df`` with the file and row of each row; a frame that was not read from files is stored first."""
    try:
        place = df.metadataColumn("_metadata")
        return df.withColumn(column, F.struct(place["file_path"].alias("file"), place["row_index"].alias("row")))
    except AnalysisException:
        return placed(stored(df, "rows"), column)


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """``df``, read from files, without the rows whose places are in ``gone`` (column ``place``)."""
    mine, theirs = fresh("_place", df), fresh("_gone", df)
    gone = gone.select(F.col("place").alias(theirs))
    return placed(df, mine).join(gone, F.col(mine) == F.col(theirs), "left_anti").drop(mine)
