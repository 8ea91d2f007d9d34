"""Readers and writers. All are plain Spark sources with explicit schemas and no driver round trip."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headed CSV with a declared schema. Columns are matched by name, whatever their order in the file; a byte-order
    mark in the header does no harm. A missing column raises; columns outside the schema are not read."""
    names = [c.lstrip("\ufeff").strip() for c in spark.read.option("header", True).csv(path).columns]
    known = {f.name: f for f in schema}
    if missing := sorted(set(known) - set(names)):
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    in_file = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])
    return (spark.read.option("header", True).option("enforceSchema", True)
            .option("timestampFormat", TIMESTAMP_FORMAT).option("multiLine", False)
            .schema(in_file).csv(path).select(*schema.fieldNames()))


def scan_reviews_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Free-text CSV: quoted fields may hold line breaks."""
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("timestampFormat", TIMESTAMP_FORMAT).schema(schema).csv(path))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan with fewer splits than cores (one large unsplittable file) by key; else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores, key) if splits < cores else df


def sink_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def sink_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True)
       .option("timestampFormat", TIMESTAMP_FORMAT).csv(path))


def sink_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sink_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A network as two tables: ``vertices`` and canonical ``edges``."""
    sink_parquet(vertices, f"{path}/vertices")
    sink_parquet(edges, f"{path}/edges")


def parse_timestamps(df: DataFrame, columns: list[str], lenient: bool = False,
                     fmt: str = TIMESTAMP_FORMAT) -> DataFrame:
    """Text columns to timestamps; lenient parsing turns bad text into NULL instead of failing."""
    parse = F.try_to_timestamp if lenient else F.to_timestamp
    return df.withColumns({c: parse(F.col(c), F.lit(fmt) if lenient else fmt) for c in columns})


@contextmanager
def cache_hot(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keep a table cached around several actions and release it afterwards."""
    held = df.persist(level)
    try:
        yield held
    finally:
        held.unpersist()
