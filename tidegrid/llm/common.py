"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.session import cut_lineage, scratch_path, write_scratch

# ASCII white space: what separates words everywhere in this package.
SPACE = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]+"


TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public vocabulary lies on the driver."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Compute ``df`` once: a table in the shared folder, which outlives executors."""
    return cut_lineage(df, label)


def settle_by(df: DataFrame, flag: str, label: str) -> tuple[DataFrame, str]:
    """``df`` computed once, its rows in folders by ``flag``, and the path of the table.

    A folder can be deleted when its rows are needed no more.
    """
    path = scratch_path(df.sparkSession, label)
    write_scratch(df, path, [flag])
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns), path


def with_struct(df: DataFrame, name: str, **fields: Column) -> DataFrame:
    """``df`` with its results in one struct column; a column of that name is replaced."""
    return df.withColumn(name, F.struct(*[c.alias(k) for k, c in fields.items()]))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use, compared without case as Spark does."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def tag(column: str) -> Column:
    """A null-safe key: joins on it keep the rows of the null group."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(
        F.concat(F.lit("s"), F.col(column).cast("string"))
    )


def utf8(column: str | Column) -> Column:
    """The text's bytes; a null text has none."""
    text = F.col(column) if isinstance(column, str) else column
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def schema_with(df: DataFrame, columns: Sequence[str], added: str) -> T.StructType:
    """The schema of some columns of ``df`` followed by ``added`` (DDL)."""
    extra = T.StructType.fromDDL(added)
    return T.StructType([df.schema[c] for c in columns] + extra.fields)


def residue(column: str | Column, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``; a null counts as an empty text."""
    value = F.col(column) if isinstance(column, str) else column
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % modulus


def least_hashed(df: DataFrame, key: Column, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of ``df``, those of least hash of ``key``: a bounded sample.

    Far more rows than that are thinned by hash before any are ordered, so that what meets
    in one task stays bounded too.
    """
    place = free_name(df, "_least_hash")
    hashed = df.withColumn(place, F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1))
    rows = df.count()
    if rows > 2 * most:
        hashed = hashed.filter(F.col(place) < int(2**63 * (1.5 * most / rows)))
    return hashed.orderBy(place).limit(most).drop(place)


def frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of greatest ``count``, as many as whole classes of counts allow within ``most``.

    Only a histogram of the counts, in steps of about one per cent, comes to the driver.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 64).cast("int")
    classes = df.groupBy(step.alias("step")).count().collect()
    total, bound = 0, None
    for row in sorted(classes, key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            break
        bound = row["step"]
    return df.filter(step >= bound) if bound is not None else df.limit(0)
