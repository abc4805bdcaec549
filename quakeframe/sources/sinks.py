"""Writers: Parquet with a metadata sidecar, CSV, GeoJSON lines, hash parts, view registration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's file systems."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_table(df: DataFrame, path: str, metadata: dict | None = None, partition_by: list[str] | None = None) -> int:
    """Parquet and ``path``.metadata.json; rows are counted while they are written."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    n = seen.get["n"]
    _write_text(df.sparkSession, f"{path}.metadata.json", json.dumps({**(metadata or {}), "rows": n}, sort_keys=True))
    return n


def write_csv_export(df: DataFrame, path: str) -> None:
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, path: str, points: str = "points") -> None:
    """A GeoJSON feature on each line; other columns are its properties."""
    rest = [c for c in df.columns if c != points]
    line = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def write_partitioned_parts(df: DataFrame, path: str, parts: int, keys: tuple[str, ...] = ("event_id", "station_id")) -> DataFrame:
    """Writes hash parts that are not there yet; returns rows and distinct keys of each part of this call."""
    spark = df.sparkSession
    out = df.withColumn("part_id", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    done = [i for i in range(parts) if exists(spark, f"{path}/part_id={i}")]
    out = out.where(~F.col("part_id").isin(done)) if done else out
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_id").parquet(path)
    # counted from what was written, not computed again
    there = spark.read.schema(out.schema).parquet(path)
    there = there.where(~F.col("part_id").isin(done)) if done else there
    return there.groupBy("part_id", *keys).agg(F.count(F.lit(1)).alias("n")).groupBy("part_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"))


def register_outputs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """A view for each output that exists; name, path and status of all."""
    rows = []
    for name, path in sorted(paths.items()):
        there = exists(spark, path)
        if there:
            spark.read.parquet(path).createOrReplaceTempView(name)
        rows.append((name, path, "registered" if there else "missing"))
    return spark.createDataFrame(rows, "name string, path string, status string")


def empty_outputs(like: DataFrame, path: str) -> DataFrame:
    """Writes a table without rows in the columns and types of ``like`` where no output is at ``path`` yet, so that later stages of a
    run whose input is absent find their tables; what is there stays. Returns the output as read back."""
    spark = like.sparkSession
    if not exists(spark, path):
        spark.createDataFrame([], like.schema).write.parquet(path)
    return spark.read.parquet(path)
