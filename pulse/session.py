"""Session and global parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Thresholds of the analyses; hours unless said otherwise."""

    z_threshold: float = 3.0
    baseline_hours: int = 168
    merge_gap_hours: int = 6
    top_channels: int = 500
    cooccurrence_hours: int = 48
    before_hours: int = 24
    after_hours: int = 72
    sustain_factor: float = 2.0
    sustain_hours: int = 24
    monitor_hours: int = 48
    early_hours: int = 4
    precursor_hours: int = 48
    simultaneous_hours: int = 2


DEFAULTS = Settings()


def create_session(app_name: str = "pulse", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; the master and sizes are the cluster's to set."""
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
