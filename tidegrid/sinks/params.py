"""Fitted bounds on disk. They live outside the stage, so that replacing a stage keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.sinks.stage import read_if_exists


def save_params(params: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """Replace the saved fit."""
    params.write.mode("overwrite").parquet(f"{path}/bounds")
    if meta is not None:
        meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_params(spark: SparkSession, path: str) -> DataFrame:
    params = read_if_exists(spark, f"{path}/bounds")
    if params is None:
        raise FileNotFoundError(f"no fitted bounds in {path}: run once with fit=True")
    return params
