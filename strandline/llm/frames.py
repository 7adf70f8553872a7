"""Small helpers shared by the operators: reading a table, and running a function over whole texts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

# Texts handed to a function at once. A single text may be larger; it then comes alone.
BYTES_AT_ONCE = 2 << 20
ROWS_AT_ONCE = 500
# Bytes of a batch between Spark and a worker, each of which holds it more than once; Spark's own limit is 64 MB.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors import this package, wherever they run: it is sent to them once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="package-")), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as zipped:
        for file in sorted(package.rglob("*.py")):
            zipped.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors, and batches of few bytes unless the session sets a limit."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_LIMIT, None) in (None, "67108864b"):
        df.sparkSession.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch, column: str, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece of several rows holds more than ``most`` bytes of ``column``."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and (held + size > most or at - start >= ROWS_AT_ONCE):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, column: str, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = BYTES_AT_ONCE) -> DataFrame:
    """``work`` on every piece of ``df``'s batches, of about ``most`` bytes; it returns a batch, a list of arrays, or None for no rows."""
    names = StructType.fieldNames(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, most):
                out = work(piece)
                if out is None:
                    continue
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays(out, names=names)

    return map_arrow(df, run, schema)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores as make it none of ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
