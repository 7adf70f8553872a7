"""The gate in front of the combined table: a stream over the ledger that opens once for each day.

Its keyed state holds, per day, which inputs are on record: landing tables that have the day, and histories that
contain it. A day whose inputs are complete starts the combination and the models on it. A record that comes
again changes no state, and what was built is on the ledger, so nothing is built twice, also after a failure.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.plans.flow import DailyFlow
from strandline.plans.models import Models
from strandline.streaming.ingest import NO_AGE


def complete_days(records: DataFrame, flow: DailyFlow) -> DataFrame:
    """``partition`` of the days of which ``records``, a ledger or its stream, has all inputs.

    A history on record as of some day contains all days up to it.
    """
    landed = [s.landing_asset for s in flow.specs]
    histories = [s.history_asset for s in flow.specs]
    start = F.lit(min(s.start for s in flow.specs))
    asset, reached = F.col("asset"), F.col("latest_partition")
    days = F.when(asset.isin(landed), F.array("partition")).when(
        asset.isin(histories) & (reached >= start), F.sequence(start, reached, F.expr("interval 1 day"))
    )
    seen = records.select("asset", F.explode(days).alias("partition")).filter("partition IS NOT NULL")
    # At most as many names as there are inputs.
    inputs = seen.groupBy("partition").agg(F.size(F.collect_set("asset")).alias("inputs"))
    return inputs.filter(F.col("inputs") == len({*landed, *histories})).select("partition")


def gate_stream(
    flow: DailyFlow,
    checkpoint: str,
    *,
    models: Models | None = None,
    as_of: date | None = None,
    interval: str | None = None,
    after: Callable[[date], None] | None = None,
) -> StreamingQuery:
    """Start the gate of a flow. Without ``interval`` it takes the records there are and stops.

    ``after`` is called with each day that was built. A ledger is compacted no sooner than ``compact_after`` appends,
    and a folded file goes one compaction later; a gate that stands still for longer has to start anew.
    """
    records = flow.ledger.stream(maxFileAge=NO_AGE)

    def on_batch(batch: DataFrame, _: int) -> None:
        days = sorted(row["partition"] for row in batch.collect())  # one row per day that is complete now
        if not days:
            return
        complete = flow.spark.createDataFrame([(d,) for d in days], "partition date")
        built = flow.combine_when_ready(complete, as_of=as_of, models=models)
        if built is not None and after:
            after(built)

    writer = complete_days(records, flow).writeStream.outputMode("update").foreachBatch(on_batch)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
