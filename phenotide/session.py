"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes the shuffles at run time, splits skewed inner and left joins, and turns
# a join into a broadcast join only when the measured side is below the threshold.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The larger side of a join on selected keys is filtered by them before its shuffle.
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "256MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB",
}


def build_session(app_name: str = "phenotide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` adds or overrides entries (dots as ``__``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
