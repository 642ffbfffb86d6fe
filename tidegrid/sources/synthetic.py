"""Generated sensor days: 1 Hz readings with gaps, spikes and duplicate lines.

Noise is integer arithmetic on (seed, device, second, channel), so the output
is the same for any partitioning and any engine can recompute it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shape of the generated signal.
CHANNELS = 12
FULL_SCALE = 800
SWING = 200
NOISE = 12
GAP_PER_THOUSAND = 4
SPIKES_PER_THOUSAND = 2
DUPLICATES_PER_THOUSAND = 3
# Modulus (a prime below 2^31) and multipliers of the noise.
PRIME = 2_147_483_647
DEVICE_STEP = 1_000_003
SECOND_STEP = 69_621
CHANNEL_STEP = 7_919


def noise(seed: int, device: Column, second: Column, channel: Column) -> Column:
    """An integer in [0, PRIME). Every channel walks the residues in its own stride."""
    stride = F.lit(SECOND_STEP).cast("long") * (channel * 2 + 1)
    start = (F.lit(seed * CHANNEL_STEP).cast("long") + channel) * 104_729
    return F.pmod(device * DEVICE_STEP + second * stride + start, F.lit(PRIME))


def sensor_days(
    devices: DataFrame,
    start_day: str = "2026-01-20",
    days: int = 3,
    hours: int = 1,
    seed: int = 42,
    experience: str = "DEMO",
    partitions: int | None = None,
) -> DataFrame:
    """Readings for every row of ``devices`` (``device_id`` text, ``device_no`` long).

    Columns as in the raw lines: ``m0…m11`` long, ``outdoor_temp`` double, and
    ``copies`` = 2 where the line is written twice. What is worked out for every
    second is plain arithmetic on columns: functions over arrays are interpreted,
    value by value, these expressions are compiled.
    """
    dev = F.col("device_no")

    def fixed(offset: int, values: int, least: int) -> Column:
        """One number per channel that a device keeps."""
        drawn = [noise(seed, dev, F.lit(0), F.lit(offset + i)) for i in range(CHANNELS)]
        return F.array(*[F.pmod(r, F.lit(values)) + least for r in drawn])

    grid = devices.select("device_id", dev.cast("long").alias("device_no")).select(
        "*",
        F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day_no"),
        fixed(200, 131, 250).alias("_base"),
        fixed(300, 3600, 0).alias("_phase"),
    )
    # Spread before a day is blown up into seconds; device-days are equal in
    # size. The number is explicit: adaptive execution would judge by the few
    # bytes going in, not by the rows coming out.
    spread = partitions or 4 * devices.sparkSession.sparkContext.defaultParallelism
    grid = grid.repartition(spread, "device_id", "day_no").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(hours * 3600 - 1))).alias("t")
    )
    dev, t = F.col("device_no"), F.col("t")
    abs_t = F.col("day_no").cast("long") * 86_400 + t

    def draw(channel: int, at: Column = abs_t) -> Column:
        return noise(seed, dev, at, F.lit(channel))

    def coin(r: Column, divisor: int) -> Column:
        return F.when(F.floor(r / divisor) % 2 == 0, 1).otherwise(-1)

    # A gap starts at some seconds and swallows 2 to 8 of them.
    in_gap = F.lit(False)
    for back in range(8):
        starts = draw(100, abs_t - back) % 1000 < GAP_PER_THOUSAND
        in_gap = in_gap | (starts & (draw(101, abs_t - back) % 7 + 2 > back) & (t >= back))

    # Drawn once, although used several times: Spark keeps a projection whose columns are.
    noisy = grid.filter(~in_gap).select(
        "device_id",
        "t",
        abs_t.alias("_abs"),
        "_base",
        "_phase",
        *[draw(i).alias(f"_r{i}") for i in (*range(CHANNELS), 50)],
        *[draw(i).alias(f"_r{i}") for i in (*range(20, 20 + CHANNELS), 51, 60)],
    )

    def channel(i: int) -> Column:
        r = F.col(f"_r{i}")
        wave = F.sin((t + F.get("_phase", F.lit(i))) * F.lit(6.283185307179586) / 3600.0) * float(SWING)
        jitter = r % (2 * NOISE + 1) - NOISE
        burst = F.floor(r / 7) % 121 + 180
        spike = F.when(F.col(f"_r{i + 20}") % 1000 < SPIKES_PER_THOUSAND, coin(r, 3) * burst).otherwise(0)
        value = (F.rint(wave) + F.get("_base", F.lit(i)) + jitter + spike).cast("long")
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(FULL_SCALE).cast("long"), value))

    r = F.col("_r50")
    drift = F.rint(F.sin(t * F.lit(6.283185307179586) / 86_400.0) * 600)
    burst = F.when(F.col("_r51") % 10_000 < 15, (r % 601 + 800) * coin(r, 5)).otherwise(0)
    midnight = F.unix_seconds(F.lit(f"{start_day} 00:00:00+00:00").cast("timestamp"))
    return noisy.select(
        F.lit(experience).alias("experience"),
        "device_id",
        F.timestamp_seconds(midnight + F.col("_abs")).alias("ts"),
        *[channel(i).alias(f"m{i}") for i in range(CHANNELS)],
        ((drift + r % 51 + burst + 1775) / 100.0).alias("outdoor_temp"),
        F.when(F.col("_r60") % 1000 < DUPLICATES_PER_THOUSAND, 2).otherwise(1).alias("copies"),
    )


def raw_lines(readings: DataFrame) -> DataFrame:
    """Readings as raw key:value lines, duplicates written out; ``seq`` numbers the copies."""
    fields = [f"m{i}" for i in range(CHANNELS)] + ["outdoor_temp"]
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = F.concat_ws(";", stamp, *[F.concat(F.lit(f"{f}:"), F.col(f).cast("string")) for f in fields])
    return readings.select(
        "experience",
        "device_id",
        F.to_date("ts").alias("file_day"),
        line.alias("value"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("seq"),
    )
