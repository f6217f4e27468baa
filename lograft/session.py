"""Session settings the column expressions rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

REQUIRED_SETTINGS = {
    # Instants are rendered through date_format, which uses the session zone.
    "spark.sql.session.timeZone": "UTC",
    # JSON objects keep the last of several equal keys, as does flattening.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Set the required settings where they differ; every public operator calls this."""
    for name, value in REQUIRED_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark
