"""File arrivals as a stream that drives the daily flow.

The stream carries the listing, not the rows. A micro-batch ingests the whole files of the days that
arrived, so each file is parsed once and a day is never replaced by a part of itself. Micro-batches may
be repeated after a failure; every step they run can be.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandline.plans.flow import DailyFlow
from strandline.sources.landing import stream_arrivals
from strandline.spec import TableSpec

FILES_PER_BATCH = 1000
# The file source forgets files older than the newest by this: a thousand years.
NO_AGE = "365000d"


def ingest_stream(
    flow: DailyFlow,
    spec: TableSpec,
    checkpoint: str,
    *,
    history: bool = True,
    files_per_batch: int = FILES_PER_BATCH,
    interval: str | None = None,
    after: Callable[[TableSpec, list[date]], None] | None = None,
) -> StreamingQuery:
    """Start the stream of one table: new files to the landing table, then to its history.

    Without ``interval`` it takes what is there and stops. ``after`` is called with the days of each
    micro-batch. No file is too old to be looked at.
    """
    files = stream_arrivals(
        flow.spark, spec, flow.zone, maxFilesPerTrigger=str(files_per_batch), maxFileAge=NO_AGE
    )

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # At most one row per file of the micro-batch.
        arrived = batch.select("partition").filter("partition IS NOT NULL").distinct().collect()
        days = sorted(row["partition"] for row in arrived)
        if not days:
            return
        flow.ingest(spec, days)
        if history:
            flow.refresh_history(spec, days, run_key=f"{spec.history_asset}/{batch_id}")
        if after:
            after(spec, days)

    writer = files.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
