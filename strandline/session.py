"""Session settings for every job in this package."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Broadcast joins are left to the optimizer and its size statistics, up to this size per side.
BROADCAST_LIMIT = "64MB"

# Public settings that the plans rely on.
SETTINGS = {
    # current_date() and load_ts depend on the zone, so it is pinned for the session and the JVM.
    "spark.sql.session.timeZone": "UTC",
    "spark.driver.extraJavaOptions": "-Duser.timezone=UTC",
    "spark.executor.extraJavaOptions": "-Duser.timezone=UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": BROADCAST_LIMIT,
}


def build_session(
    app: str = "strandline",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **settings: str,
) -> SparkSession:
    """Get or create a session with the package's settings; ``settings`` override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
