"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

PINNED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "aeroseries", **settings: str) -> SparkSession:
    """A session with the pinned settings; extra settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in PINNED_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
