"""Parsing, coercion, filters, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.base import COARSE, K, READINGS, Registry, coarse, r6, readings, sql_r6, table
from tidegrid.functions import names
from tidegrid.functions import scalars as S
from tidegrid.operators import columns as C
from tidegrid.operators.clean import clean
from tidegrid.sources import raw, synthetic

QUERIES = Registry()

# --- A1, A2, C6: raw lines ------------------------------------------------------

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
DOMAINS = {
    "bio_signal": {"columns": ["m1"], "dtype": "int"},
    "environment": {"columns": ["m0"], "dtype": "float"},
}


def _lines(spark, sf_dir, fields):
    r = readings(spark, sf_dir)
    stamp = F.date_format("ts", STAMP)
    return r.select(
        F.concat_ws(";", stamp, *fields).alias("value"),
        F.concat_ws("_", "experience", "device_id", F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(".csv"))).alias(
            "source_file"
        ),
        "seq",
    )


def kv_lines(spark, sf_dir):
    return _lines(
        spark,
        sf_dir,
        [F.concat(F.lit("m0:"), F.col("m0").cast("string")), F.concat(F.lit("m1:"), F.col("m1").cast("string"))],
    )


@QUERIES.add(
    f"""WITH {READINGS}
    SELECT experience, device_id, 'bio_signal' AS "domain", "day", ts, seq, CAST(NULL AS DOUBLE) AS m0, m1 FROM readings
    UNION ALL
    SELECT experience, device_id, 'environment', "day", ts, seq, m0, NULL FROM readings"""
)
def kv_parse(spark, sf_dir):
    """Lines built from the events, parsed back into two domains in one pass."""
    parsed = raw.parse_kv_lines(raw.source_metadata(kv_lines(spark, sf_dir)))
    return raw.type_rows(parsed, DOMAINS).select(
        "experience", "device_id", "domain", "day", "ts", "seq", "m0", "m1"
    )


@QUERIES.add(
    f"""WITH {READINGS}
    SELECT experience, device_id, "day", ts, seq,
      CASE seq % 7 WHEN 0 THEN NULL WHEN 5 THEN NULL ELSE m0 END AS m0,
      CASE seq % 7 WHEN 1 THEN NULL ELSE m1 END AS m1
    FROM readings WHERE seq % 7 <> 4"""
)
def kv_parse_dirty(spark, sf_dir):
    """Junk on every line: text values, fractions, repeated keys, NUL, lines without a pair."""
    kind = F.col("seq") % 7
    m0, m1 = F.col("m0").cast("string"), F.col("m1").cast("string")

    def pick(*cases, default):
        out = F.when(F.lit(False), "")
        for k, text in cases:
            out = out.when(kind == k, text)
        return out.otherwise(default)

    first = pick(
        (0, F.lit("m0:N/A")),
        (2, F.concat(F.lit("m0:999;m0:"), m0)),
        (3, F.concat(F.lit("m\0" + "0:"), m0)),
        (4, F.lit("nothing")),
        (5, F.concat(F.lit("note:a:b;m0:"), m0, F.lit("d"))),
        (6, F.concat(F.lit("junk;ts:1999-01-01T00:00:00Z;m0:"), m0)),
        default=F.concat(F.lit("m0:"), m0),
    )
    second = pick(
        (1, F.concat(F.lit("m1:"), m1, F.lit(".5"))),
        (3, F.concat(F.lit("m1:"), m1, F.lit(".0 \t "))),
        (4, F.lit("here")),
        default=F.concat(F.lit("m1:"), m1),
    )
    parsed = raw.parse_kv_lines(raw.source_metadata(_lines(spark, sf_dir, [first, second])))
    spec = {"bio_signal": {"columns": ["m1"], "dtype": "int"}, "environment": {"columns": ["m0"]}}
    tables = raw.type_domains(parsed, spec)
    m1_rows, m0_rows = tables["bio_signal"], tables["environment"]
    by = ["experience", "device_id", "day", "ts", "seq"]
    return m0_rows.select(*by, "m0").join(m1_rows.select(*by, "m1"), by)


@QUERIES.add(
    """WITH s AS (
      SELECT o_orderkey, o_custkey, replace(o_orderstatus || '_EXP_cust' || o_custkey || '_' ||
             strftime(o_orderdate, '%Y-%m-%d') || '_raw', 'F_EXP', 'F-EXP') AS stem FROM orders)
    SELECT o_orderkey, regexp_extract(stem, '^(.*)_[^_]*_[0-9]{4}-', 1) AS experience,
      regexp_extract(stem, '([^_]*)_[0-9]{4}-', 1) AS device_id,
      CAST(regexp_extract(stem, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS DATE) AS file_day,
      CAST(regexp_extract(stem, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS DATE) AS first_date
    FROM s"""
)
def source_metadata(spark, sf_dir):
    """File names made from the orders, decoded after a substitution."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(
            F.col("o_orderstatus"), F.lit("_EXP_cust"), F.col("o_custkey").cast("string"), F.lit("_"),
            F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_raw.csv"),
        ).alias("source_file"),
    )
    named = raw.source_metadata(o, substitutions=[{"src": "F_EXP", "target": "F-EXP"}])
    return named.withColumn("first_date", S.extract_date(F.col("source_file"))).drop("source_file")


# --- filters ---------------------------------------------------------------------


@QUERIES.add(
    f"""WITH {READINGS} SELECT * FROM readings
    WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'"""
)
def prune_days(spark, sf_dir):
    return C.prune_days(readings(spark, sf_dir), "2024-01-10T06:00:00Z", "2024-01-20T12:00:00Z")


@QUERIES.add(
    f"""WITH {COARSE}
    SELECT 'both_ends' AS range, * FROM coarse WHERE ts >= TIMESTAMP '2024-01-05 10:00:00' AND ts <= TIMESTAMP '2024-01-07 10:00:00'
    UNION ALL
    SELECT 'half_open' AS range, * FROM coarse WHERE ts >= TIMESTAMP '2024-01-05 10:00:00' AND ts < TIMESTAMP '2024-01-07 10:00:00'"""
)
def range_filters(spark, sf_dir):
    df = coarse(spark, sf_dir)
    start, end = "2024-01-05T12:00:00+02:00", "2024-01-07T10:00:00"
    closed = C.trim_time(df, start, end).withColumn("range", F.lit("both_ends"))
    half = C.range_filter(df, start, end).withColumn("range", F.lit("half_open"))
    return closed.unionByName(half)


@QUERIES.add(
    f"""WITH {READINGS}
    SELECT * REPLACE (CASE WHEN m0 BETWEEN 10 AND 150 THEN m0 END AS m0, CASE WHEN m1 >= 20 THEN m1 END AS m1)
    FROM readings"""
)
def mask_bounds(spark, sf_dir):
    df = C.mask_bounds(readings(spark, sf_dir), ["m0"], 10, 150)
    return C.mask_bounds(df, ["m1"], low=20)


@QUERIES.add(
    f"""WITH {READINGS}, d AS (
      SELECT * REPLACE (CASE device_id WHEN 'error' THEN 'environment' WHEN 'signup' THEN 'other' ELSE "domain" END AS "domain")
      FROM readings)
    SELECT * REPLACE (CASE WHEN "domain" = 'environment' THEN m0 WHEN m0 BETWEEN 10 AND 150 THEN m0 END AS m0,
                      CASE WHEN "domain" = 'environment' THEN m1 WHEN m1 BETWEEN 10 AND 150 THEN m1 END AS m1)
    FROM d WHERE "domain" <> 'other'"""
)
def pass_through(spark, sf_dir):
    """Domains with rules are masked, others carried, a listed one dropped."""
    device = F.col("device_id")
    df = readings(spark, sf_dir).withColumn(
        "domain",
        F.when(device == "error", "environment").when(device == "signup", "other").otherwise(F.col("domain")),
    )
    kept = C.drop_domains(df, ["other", "bio_signal"], target="bio_signal")
    cleaned = clean(C.keep_domains(kept, ["bio_signal"]), min_value=10, max_value=150, drop_dups=False)
    return cleaned.unionByName(C.keep_domains(kept, ["environment"]))


# --- domains and types -------------------------------------------------------------


@QUERIES.add(
    f"""WITH {READINGS}
    SELECT experience, device_id, "day", ts, seq, 'bio_signal' AS "domain",
      CASE WHEN m0 = round_even(m0, 0) THEN CAST(m0 AS BIGINT) END AS m0, m1 AS k, CAST(NULL AS DOUBLE) AS outdoor_temp
    FROM readings
    UNION ALL
    SELECT experience, device_id, "day", ts, seq, 'environment', NULL, NULL, m0 FROM readings"""
)
def split_domains(spark, sf_dir):
    df = readings(spark, sf_dir)
    text = df.select(
        "experience", "device_id", "day", "ts", "seq",
        F.col("m0").cast("string").alias("m0"),
        F.col("m1").cast("string").alias("m1"),
        F.col("m0").cast("string").alias("outdoor_temp"),
    )
    spec = {
        "bio_signal": {"prefix": "m", "dtype": "int", "rename": {"m1": "k"}},
        "environment": {"columns": ["outdoor_temp", "absent"], "dtype": "float"},
        "empty": {"prefix": "q"},
    }
    return C.stack_domains(C.split_domains(text, spec))


NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def _sql_int(x: str) -> str:
    v = f"TRY_CAST({x} AS DOUBLE)"
    return f"CASE WHEN regexp_matches({x}, {NUM}) AND {v} = round_even({v}, 0) THEN CAST({v} AS BIGINT) END"


def _sql_float(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {NUM}) THEN TRY_CAST({x} AS DOUBLE) END"


@QUERIES.add(
    f"""WITH v AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, CAST(p_retailprice AS VARCHAR) AS price FROM part),
    t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN size WHEN 1 THEN size || '.0' WHEN 2 THEN size || 'd'
        WHEN 3 THEN ' ' || size || ' ' WHEN 4 THEN size || 'e1' WHEN 5 THEN price WHEN 6 THEN '1_000' ELSE 'N/A' END AS txt FROM v)
    SELECT p_partkey, {_sql_int('txt')} AS as_int, {_sql_float('txt')} AS as_float FROM t"""
)
def coerce_types(spark, sf_dir):
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 8
    txt = (
        F.when(kind == 0, size)
        .when(kind == 1, F.concat(size, F.lit(".0")))
        .when(kind == 2, F.concat(size, F.lit("d")))
        .when(kind == 3, F.concat(F.lit(" "), size, F.lit(" ")))
        .when(kind == 4, F.concat(size, F.lit("e1")))
        .when(kind == 5, F.col("p_retailprice").cast("string"))
        .when(kind == 6, F.lit("1_000"))
        .otherwise("N/A")
    )
    df = table(spark, sf_dir, "part").withColumn("txt", txt)
    return df.select(
        "p_partkey", S.coerce_int(F.col("txt")).alias("as_int"), S.coerce_float(F.col("txt")).alias("as_float")
    )


@QUERIES.add(
    """SELECT p_partkey, 900719925474099000 + p_partkey AS as_int, CAST(NULL AS BIGINT) AS none FROM part"""
)
def coerce_long(spark, sf_dir):
    """Whole numbers of more digits than a double holds keep all of them; too long ones are null."""
    digits = (F.lit(900719925474099000) + F.col("p_partkey")).cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.coerce_int(digits).alias("as_int"), S.coerce_int(F.concat(digits, digits)).alias("none")
    )


@QUERIES.add("SELECT event_id, ts - INTERVAL 1 HOUR AS at, ts AS given FROM events")
def parse_zone(spark, sf_dir):
    """Wall-clock text of a zone becomes UTC; text that names its offset keeps it. January: one hour."""
    e = table(spark, sf_dir, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = "Europe/Paris"
    return e.select(
        "event_id",
        S.parse_ts(text, zone).alias("at"),
        S.parse_ts(F.concat(text, F.lit("Z")), zone).alias("given"),
    )


# --- scalar functions ----------------------------------------------------------------


@QUERIES.add(
    f"""WITH {READINGS}
    SELECT {K}, ts, seq, {sql_r6('m0')} AS m0,
      {sql_r6('CASE WHEN m0 > 0 THEN 1 / sqrt(m0) END')} AS m0__sqrt_inv,
      {sql_r6('CASE WHEN m0 > 0 THEN ln(m0) END')} AS m0__log,
      {sql_r6('CASE WHEN m1 > 0 THEN 1 / cbrt(m1) END')} AS m1,
      {sql_r6('CASE WHEN m1 > 0 AND 1 / cbrt(m1) > 0 THEN ln(1 / cbrt(m1)) END')} AS m1__log,
      {sql_r6('CASE WHEN m1 > 0 THEN 1 / cbrt(m1) END')} AS m1__identity
    FROM readings"""
)
def scalar_transforms(spark, sf_dir):
    """Added and replaced columns; later entries see earlier replacements."""
    out = C.apply_transforms(
        readings(spark, sf_dir),
        [
            {"function": "sqrt_inv", "target": {"columns": ["m0", "absent"]}},
            {"function": "cbrt_inv", "target": {"columns": ["m1"]}, "mode": "replace"},
            {"function": "log", "target": {"domain": "bio_signal"}, "mode": "add"},
            {"function": "identity", "target": {"columns": ["m1"]}},
            {"function": "log", "target": {"domain": "environment"}},
        ],
        "bio_signal",
    )
    values = ["m0", "m0__sqrt_inv", "m0__log", "m1", "m1__log", "m1__identity"]
    return out.withColumns({c: r6(c) for c in values})


@QUERIES.add(
    """SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice / 100.0 * 10.0, 0) / 10.0 AS tenths,
      CAST(round_even(l_quantity / 2.0, 0) AS BIGINT) AS half,
      make_timestamp((epoch_us(l_shipdate) // 604800000000) * 604800000000) AS week_slot,
      strftime((l_shipdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris', '%Y-%m-%d %H:%M:%S') AS local_time
    FROM lineitem"""
)
def round_and_time(spark, sf_dir):
    """Half-even rounding, epoch floors and local time over all line items."""
    li = table(spark, sf_dir, "lineitem")
    ts = F.col("l_shipdate").cast("timestamp")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        S.round_even(F.col("l_extendedprice") / 100.0, 1).alias("tenths"),
        S.to_long_even(F.col("l_quantity") / 2.0).alias("half"),
        S.floor_ts(ts, "7d").alias("week_slot"),
        S.local_time(ts, "Europe/Paris").alias("local_time"),
    )


@QUERIES.add(
    """SELECT p_partkey, upper(regexp_replace(p_brand || '__' || p_type || '.' || p_name, '[^a-zA-Z0-9]', '_', 'g')) AS table_name,
      'PART__AGGREGATED' AS template_name FROM part"""
)
def table_names(spark, sf_dir):
    filled = names.table_name("{experience}__{step}__{aggregation}", {"experience": "part", "step": "aggregated", "aggregation": None})
    text = F.concat("p_brand", F.lit("__"), "p_type", F.lit("."), "p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(names.sanitize_column(text)).alias("table_name"), F.lit(filled).alias("template_name")
    )


# --- A6: generated days ------------------------------------------------------------------


def _sql_noise(second: str, channel: int, seed: int = 42) -> str:
    stride = synthetic.SECOND_STEP * (2 * channel + 1)
    start = (seed * synthetic.CHANNEL_STEP + channel) * 104_729
    walk = f"device_no * {synthetic.DEVICE_STEP} + ({second}) * {stride} + {start}"
    # pmod: the second may lie before the day, which makes the walk negative.
    return f"((({walk}) % {synthetic.PRIME} + {synthetic.PRIME}) % {synthetic.PRIME})"


def _sensor_days_sql() -> str:
    cols = {f"r{i}": _sql_noise("abs_t", i) for i in range(12)}
    cols |= {f"s{i}": _sql_noise("abs_t", 20 + i) for i in range(12)}
    cols |= {f"b{i}": _sql_noise("0", 200 + i) for i in range(12)}
    cols |= {f"p{i}": _sql_noise("0", 300 + i) for i in range(12)}
    cols |= {"r50": _sql_noise("abs_t", 50), "r51": _sql_noise("abs_t", 51), "r60": _sql_noise("abs_t", 60)}
    for back in range(8):
        cols[f"g{back}"] = _sql_noise(f"abs_t - {back}", 100)
        cols[f"h{back}"] = _sql_noise(f"abs_t - {back}", 101)
    gap = " OR ".join(f"(g{b} % 1000 < 4 AND h{b} % 7 + 2 > {b} AND t >= {b})" for b in range(8))
    channel = {
        i: f"""greatest(0, least(800, CAST(250 + b{i} % 131 + round_even(200.0 * sin((t + p{i} % 3600) * 6.283185307179586 / 3600.0), 0)
            + r{i} % 25 - 12 + CASE WHEN s{i} % 1000 < 2 THEN (CASE WHEN (r{i} // 3) % 2 = 0 THEN 1 ELSE -1 END) * (180 + (r{i} // 7) % 121) ELSE 0 END AS BIGINT)))"""
        for i in range(12)
    }
    temp = """CAST(1800 + round_even(600 * sin(t * 6.283185307179586 / 86400.0), 0) + r50 % 51 - 25 + CASE WHEN r51 % 10000 < 15
        THEN (800 + r50 % 601) * (CASE WHEN (r50 // 5) % 2 = 0 THEN 1 ELSE -1 END) ELSE 0 END AS BIGINT)"""
    sums = ", ".join(f"CAST(sum({e}) AS BIGINT) AS m{i}_sum" for i, e in channel.items())
    return f"""WITH grid AS (
        SELECT s_name AS device_id, s_suppkey AS device_no, CAST(d AS BIGINT) * 86400 + t AS abs_t, t
        FROM supplier, range(0, 2) AS days(d), range(0, 3600) AS secs(t)),
      noisy AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM grid)
      SELECT device_id, CAST(count(*) AS BIGINT) AS rows,
        CAST(sum(CASE WHEN r60 % 1000 < 3 THEN 2 ELSE 1 END) AS BIGINT) AS lines, {sums},
        CAST(sum({temp}) AS BIGINT) AS temp_hundredths
      FROM noisy WHERE NOT ({gap}) GROUP BY device_id"""


@QUERIES.add(_sensor_days_sql())
def sensor_days(spark, sf_dir):
    """Two generated days of an hour for every supplier, summed up per device."""
    devices = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("device_id"), F.col("s_suppkey").alias("device_no")
    )
    days = synthetic.sensor_days(devices, days=2, hours=1)
    return days.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("copies").alias("lines"),
        *[F.sum(f"m{i}").alias(f"m{i}_sum") for i in range(synthetic.CHANNELS)],
        F.sum(F.rint(F.col("outdoor_temp") * 100).cast("long")).alias("temp_hundredths"),
    )
