"""Generated sensor days."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.sources import synthetic


def devices(spark):
    return spark.range(3).select(F.concat(F.lit("d"), "id").alias("device_id"), F.col("id").alias("device_no"))


def test_seconds_are_made_by_compiled_code_alone(spark):
    """Functions over arrays are interpreted: a second cost some ten times as much with them."""
    made = synthetic.sensor_days(devices(spark), days=2)
    with_functions = devices(spark).select(F.transform(F.array("device_no"), lambda x: x + 1))
    assert "lambda" in with_functions._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_readings_do_not_depend_on_the_partitions(spark):
    one, many = (
        {tuple(r) for r in synthetic.sensor_days(devices(spark), days=1, partitions=n).collect()} for n in (1, 7)
    )
    assert one == many and len(one) > 3 * 3400
