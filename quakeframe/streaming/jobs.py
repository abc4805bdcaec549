"""Streaming forms of the catalogue and spectra jobs: quality control with deduplication, binned counts, resumable append."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import expr, geo
from ..operators.catalog import CatalogRules, catalog_filter


def stream_catalog_qc(stream: DataFrame, rules: CatalogRules, delay: str = "30 days") -> DataFrame:
    """The catalogue's filters and scores on a stream; an event id counts once within the watermark, which begins at 1970."""
    x, y = geo.project_lonlat("lon", "lat", rules.bbox, rules.crs)
    kept = catalog_filter(stream.withWatermark("time_utc", delay), rules).dropDuplicatesWithinWatermark(["event_id"])
    return kept.withColumns({"x_m": x, "y_m": y, "z_m": F.col("depth_km") * 1000.0, "quality_score": expr.catalog_quality_score("magnitude_type", "depth_km")})


def stream_bin_summary(stream: DataFrame, window: str = "30 days", delay: str = "30 days") -> DataFrame:
    """Counts and magnitudes by tumbling window and epoch-aligned bins; rows behind the watermark are dropped."""
    binned = stream.withWatermark("time_utc", delay).groupBy(F.window("time_utc", window), F.floor(F.col("depth_km") / 5.0).alias("depth_bin"))
    return binned.agg(F.count(F.lit(1)).alias("event_count"), F.avg("magnitude").alias("magnitude_mean"), F.max("magnitude").alias("magnitude_max"))


def stream_append_spectra(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends rows whose keys are not stored yet, batch by batch; a null in a key is a value like others.

    Keys alone are exchanged to find those that are not stored; rows are exchanged only if theirs is one of them."""
    spark: SparkSession = stream.sparkSession

    def same(left: DataFrame, right: DataFrame) -> Column:
        return reduce(and_, (left[k].eqNullSafe(right[f"__{k}"]) for k in keys))

    def append(batch: DataFrame, _: int) -> None:
        fresh = None
        try:
            stored = spark.read.parquet(path).select(*(F.col(k).alias(f"__{k}") for k in keys))
        except Exception as e:  # nothing is stored before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            asked = batch.select(*keys)
            fresh = asked.join(stored, same(asked, stored), "left_anti").select(*(F.col(k).alias(f"__{k}") for k in keys)).persist(StorageLevel.DISK_ONLY)
            fresh.count()  # so that the join of the rows knows its size
        rows = batch if fresh is None else batch.join(fresh, same(batch, fresh), "left_semi")
        rows.dropDuplicates(keys).write.mode("append").parquet(path)
        if fresh is not None:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
