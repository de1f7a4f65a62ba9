"""Schemas of the manifests (one kind of row each) and the projections that resolve their optional fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = "window_id STRING, split STRING, gps_start BIGINT, gps_end BIGINT, gps_block STRING, ifos ARRAY<STRING>"
TRIGGER = (
    "window_id STRING, split STRING, gps_start BIGINT, gps_end BIGINT, gps_block STRING, valid_ifos ARRAY<STRING>, ifos ARRAY<STRING>, "
    "chirp_scores MAP<STRING,DOUBLE>, glitch_scores MAP<STRING,DOUBLE>, peak_times MAP<STRING,MAP<STRING,STRUCT<gps:DOUBLE>>>"
)
CANDIDATE = "candidate_id STRING, window_id STRING, injection_id STRING, split STRING, ifo STRING, gps_start DOUBLE, gps_end DOUBLE, gps_peak DOUBLE, score DOUBLE, timing_method STRING"
INJECTION = (
    "injection_id STRING, waveform_id STRING, source_family STRING, split STRING, optimal_snr_stratum STRING, optimal_snr_by_ifo MAP<STRING,DOUBLE>, "
    "detector_arrival_gps MAP<STRING,DOUBLE>, ranking_score DOUBLE, vt_weight DOUBLE, weight DOUBLE"
)
RECIPE = (
    "split STRING, scene_type STRING, observing_run STRING, gps_start BIGINT, duration DOUBLE, sample_rate INT, ifos ARRAY<STRING>, q_values ARRAY<DOUBLE>, "
    "seed BIGINT, waveform_id STRING, injection_id STRING, glitch_id STRING, glitch_ifo STRING, source_family STRING, target_snr DOUBLE"
)
SAMPLE = "sample_id STRING, group_id STRING, source STRING, image STRING, label STRING, image_sha256 STRING, label_sha256 STRING, image_bytes INT, objects INT, class_0 INT, class_1 INT, empty BOOLEAN, split STRING"
SERIES = "ifo STRING, gps_start BIGINT, sample_rate INT, values ARRAY<DOUBLE>"
QUALITY = "ifo STRING, gps_start BIGINT, duration INT, dqmask ARRAY<BIGINT>, injmask ARRAY<BIGINT>"
POSTERIOR = "backend STRING, injection_id STRING, condition STRING, posterior MAP<STRING,ARRAY<DOUBLE>>, latency_seconds DOUBLE, truth MAP<STRING,DOUBLE>"


def column_or_null(df: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def resolve(df: DataFrame) -> DataFrame:
    """valid_ifos falls back to ifos; the weight is vt_weight, else weight, else 1."""
    ifos = F.coalesce(column_or_null(df, "valid_ifos", "array<string>"), column_or_null(df, "ifos", "array<string>"))
    weight = F.coalesce(column_or_null(df, "vt_weight"), column_or_null(df, "weight"), F.lit(1.0))
    return df.withColumn("valid_ifos", ifos).withColumn("search_weight", weight)
