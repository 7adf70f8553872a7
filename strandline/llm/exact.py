"""Exact deduplication as a stateful stream: keyed state on disk, without expiry, and a check of full bytes on hits.

Every arriving row is reduced to its digest, its stable identifier and its locator (file and row of the content).
A streaming aggregation keeps, per digest, how often it came and the identifier and locator of the row that stays;
RocksDB holds this state on disk and the checkpoint in the shared folder makes it survive lost executors. A digest
that came more than once is a hit: its rows' full texts are compared with the text at the kept row's locator, and
rows that differ in spite of equal digests are grouped by their text itself.

Of equal texts the row with the largest identifier stays; among rows that repeat it, the one latest by locator.

Edge cases: a null text counts as empty; a null identifier sorts below all others; repeated rows are each judged,
and one of them stays; texts of any length are compared whole; an empty table gives an empty table; other columns
of the input play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.places import placed, without
from strandline.scratch import scratch_dir, stored

# Rows per state store. A store preallocates some megabytes and lives as long as the state, so their number follows
# the rows and not the session's shuffle partitions. Only cost depends on it.
ROWS_PER_STORE = 50_000
# The settings and the class of Spark's disk-backed state store.
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STORES_SETTING = "spark.sql.streaming.internal.stateStore.partitions"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``id``, ``text`` (null as empty) and ``locator``: the file and the row in it that hold the text."""
    return placed(docs, "_locator").select(
        F.col(f"`{id_column}`").alias("id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        F.col("_locator").alias("locator"),
    )


class DedupState:
    """Digest -> how often it came, and which row stays; fed by streams, kept below ``folder`` between them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @contextmanager
    def _settings(self, stores: int):
        """Disk-backed stores, of this number if the state is new (else it keeps its own)."""
        wanted = {STORE_SETTING: STORE, STORES_SETTING: str(stores)}
        before = {name: self.spark.conf.get(name, None) for name in wanted}
        try:
            for name, value in wanted.items():
                self.spark.conf.set(name, value)
            yield
        finally:
            for name, value in before.items():
                if value is None:
                    self.spark.conf.unset(name)
                else:
                    self.spark.conf.set(name, value)

    def feed(self, arrivals: str, files_per_batch: int = 1000) -> None:
        """Take in the files below ``arrivals`` (id, digest, locator) that no earlier call has taken in."""
        known = self.spark.read.parquet(arrivals)
        schema, stores = known.schema, 1 + known.count() // ROWS_PER_STORE
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
        state = stream.groupBy("digest").agg(
            F.count(F.lit(1)).alias("seen"), F.max(F.struct("id", "locator")).alias("keep")
        )

        def save(changed: DataFrame, batch: int) -> None:  # a repeated batch replaces its own folder
            changed.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch}")

        with self._settings(stores):
            query = (
                state.writeStream.outputMode("update")
                .foreachBatch(save)
                .option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()

    def groups(self) -> DataFrame:
        """The state as it stands: one row per digest."""
        changes = self.spark.read.parquet(f"{self.folder}/changes")
        latest = changes.groupBy("digest").agg(F.max_by(F.struct("seen", "keep"), "batch").alias("now"))
        return latest.select("digest", "now.seen", "now.keep")


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 1000,
) -> DataFrame:
    """One row per row of ``docs``: id, locator, digest, keep_id, group_size, kept."""
    spark = docs.sparkSession
    rows = located(docs, id_column, text).withColumn("digest", digest(F.col("text")))
    folder = scratch_dir(spark, "dedup")
    rows.select("id", "digest", "locator").write.parquet(f"{folder}/arrivals")
    arrivals = spark.read.parquet(f"{folder}/arrivals")
    if arrivals.isEmpty():
        return _judged(arrivals, F.lit(None).cast("struct<id:bigint,locator:struct<file:string,row:bigint>>"), F.lit(1))
    state = DedupState(spark, folder)
    state.feed(f"{folder}/arrivals", files_per_batch)
    repeated = stored(state.groups().filter("seen > 1"), "repeated")

    # Hits: rows whose digest came before. The kept row's full text is fetched by its locator. The number of repeated
    # digests has no bound, so they are merged with the texts and not broadcast, at any size.
    hits = stored(rows.join(repeated.select("digest", "keep").hint("merge"), "digest"), "hits")
    originals = hits.filter("locator = keep.locator").select("digest", F.col("text").alias("original"))
    differing = stored(
        hits.filter("locator != keep.locator").join(originals, "digest").filter("text != original").drop("original"),
        "differing",
    )
    judged = arrivals.join(repeated, "digest", "left")
    if differing.isEmpty():
        return _judged(judged, F.col("keep"), F.col("seen"))

    # Unequal texts under one digest: those that differ from the kept text are grouped by the text itself.
    own = differing.groupBy("digest", "text").agg(
        F.max(F.struct("id", "locator")).alias("own_keep"), F.count(F.lit(1)).alias("own_size")
    )
    places = differing.join(own, ["digest", "text"]).select("locator", "own_keep", "own_size")
    fewer = differing.groupBy("digest").agg(F.count(F.lit(1)).alias("apart"))
    judged = judged.join(places, "locator", "left").join(fewer, "digest", "left")
    size = F.coalesce("own_size", F.col("seen") - F.coalesce("apart", F.lit(0)))
    return _judged(judged, F.coalesce("own_keep", "keep"), size)


def _judged(rows: DataFrame, keep: Column, size: Column) -> DataFrame:
    """A digest that came once keeps its own row."""
    return rows.select(
        "id",
        "locator",
        "digest",
        F.when(keep.isNull(), F.col("id")).otherwise(keep["id"]).alias("keep_id"),
        F.coalesce(size, F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("locator") == keep["locator"], F.lit(True)).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, read from files, without the rows that repeat another row's text."""
    gone = exact_dedup(docs, id_column, text).filter(~F.col("kept"))
    return without(docs, gone.select(F.col("locator").alias("place")))
