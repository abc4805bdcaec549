"""Catalogue jobs: quality control, deduplication, epochs, bins, selection, coverage, resumable appends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, geo


@dataclass(frozen=True)
class CatalogRules:
    bbox: tuple[float, float, float, float]
    min_magnitude: float = 2.0
    max_depth_km: float = 40.0
    start_date: str = "1900-01-01"
    end_date: str = "9999-12-31"
    crs: str = "local"


def first_rows(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. Order columns must settle ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def dedupe_events(df: DataFrame) -> DataFrame:
    """One row for each (second, lon and lat to 3 places, depth to 1); rounded half away from zero, seconds cut off."""
    keys = [F.date_trunc("second", "time_utc"), F.round("lon", 3), F.round("lat", 3), F.round("depth_km", 1)]
    return first_rows(df, keys, ["time_utc", "event_id"])


def dedupe_by_id(df: DataFrame, order: list[str]) -> DataFrame:
    return first_rows(df, ["event_id"], order)


def flag_membership(df: DataFrame, ids: DataFrame, flag: str, key: str = "event_id") -> DataFrame:
    """True where the key is among ``ids``; never multiplies rows."""
    known = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def catalog_filter(df: DataFrame, rules: CatalogRules) -> DataFrame:
    day = F.to_date("time_utc")
    return df.where(
        F.col("time_utc").isNotNull()
        & geo.in_bbox("lon", "lat", rules.bbox)
        & expr.finite("depth_km")
        & F.col("depth_km").between(0.0, rules.max_depth_km)
        & expr.finite("magnitude")
        & (F.col("magnitude") >= rules.min_magnitude)
        & day.between(F.lit(rules.start_date).cast("date"), F.lit(rules.end_date).cast("date"))
    )


def catalog_qc(df: DataFrame, rules: CatalogRules, mechanisms: DataFrame | None = None, waveforms: DataFrame | None = None) -> DataFrame:
    """Filters, deduplicates, flags, projects and scores a catalogue. Sorting by time is left to the export."""
    out = dedupe_events(catalog_filter(df, rules))
    for ids, flag in ((mechanisms, "has_mechanism"), (waveforms, "has_waveform_feature")):
        out = flag_membership(out, ids, flag) if ids is not None else out.withColumn(flag, F.lit(False))
    x, y = geo.project_lonlat("lon", "lat", rules.bbox, rules.crs)
    return out.withColumns(
        {"x_m": x, "y_m": y, "z_m": F.col("depth_km") * 1000.0, "qc_pass": F.lit(True), "quality_score": expr.catalog_quality_score("magnitude_type", "depth_km")}
    )


# Id, first day, last day, location km, depth km, magnitude, time s, completeness, weight.
EPOCHS = [
    ("pre_instrumental_to_1922", "0001-01-01", "1922-12-31", 50.0, 30.0, 0.5, 86400.0, 6.5, 0.15),
    ("early_instrumental_1923_1994", "1923-01-01", "1994-12-31", 15.0, 20.0, 0.3, 3600.0, 5.0, 0.40),
    ("modern_dense_1995_2010", "1995-01-01", "2010-12-31", 5.0, 8.0, 0.15, 60.0, 3.0, 0.75),
    ("recent_high_density_2011_present", "2011-01-01", "9999-12-31", 3.0, 5.0, 0.1, 10.0, 2.0, 0.90),
]
EPOCH_SCHEMA = "epoch_id string, start_date string, end_date string, location_uncertainty_km double, depth_uncertainty_km double, magnitude_uncertainty double, time_uncertainty_s double, completeness_magnitude double, epoch_weight double"


def epochs(spark) -> DataFrame:
    df = spark.createDataFrame(EPOCHS, EPOCH_SCHEMA)
    return df.withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})


def epoch_profile(df: DataFrame, table: DataFrame) -> DataFrame:
    """Each event with the epoch that holds its date; ``table`` has four rows, so the range join is a broadcast."""
    day = F.to_date("time_utc")
    out = df.join(F.broadcast(table), day.between(F.col("start_date"), F.col("end_date")))
    margin = F.col("magnitude") - F.col("completeness_magnitude")
    return out.withColumns({"analysis_weight": F.col("epoch_weight") * expr.clamp01(margin + 1), "is_above_epoch_completeness": margin >= 0})


def epoch_summary(profile: DataFrame) -> DataFrame:
    return profile.groupBy("epoch_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("analysis_weight").alias("mean_weight"), F.count_if("is_above_epoch_completeness").alias("n_complete"), F.min("time_utc").alias("first_time")
    )


def event_bins(df: DataFrame, days: int = 30, spatial_km: float = 10.0, depth_km: float = 5.0, magnitude: float = 0.5) -> DataFrame:
    return df.withColumns(
        {
            "event_date": F.to_date("time_utc"),
            "time_bin_start": expr.bin_date("time_utc", days),
            "spatial_bin_x": expr.floor_bin("x_m", spatial_km * 1000),
            "spatial_bin_y": expr.floor_bin("y_m", spatial_km * 1000),
            "depth_bin_km": F.floor(F.col("depth_km") / depth_km) * depth_km,
            "magnitude_bin": F.round(F.floor(F.col("magnitude") / magnitude) * magnitude, 3),
        }
    )


def event_compact(events: DataFrame, profile: DataFrame) -> DataFrame:
    """Events with their profile, one row for each event, and the bins. The profile is made unique by event first."""
    known = profile.groupBy("event_id").agg(F.min_by(F.struct("epoch_id", "analysis_weight"), "epoch_id").alias("p"))
    out = events.join(known, "event_id", "left").withColumns(
        {"epoch_id": F.coalesce("p.epoch_id", F.lit("unprofiled")), "analysis_weight": F.coalesce("p.analysis_weight", "quality_score")}
    )
    return event_bins(out.drop("p"))


BIN_KEYS = ["time_bin_start", "spatial_bin_x", "spatial_bin_y", "depth_bin_km", "magnitude_bin", "epoch_id"]


def event_bin_summary(compact: DataFrame) -> DataFrame:
    return compact.groupBy(*BIN_KEYS).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("analysis_weight").alias("weight_sum"),
        F.avg("magnitude").alias("magnitude_mean"),
        F.max("magnitude").alias("magnitude_max"),
        F.avg("depth_km").alias("depth_mean_km"),
        F.avg("lon").alias("lon_mean"),
        F.avg("lat").alias("lat_mean"),
        F.avg("x_m").alias("x_mean_m"),
        F.avg("y_m").alias("y_mean_m"),
        F.avg("quality_score").alias("quality_mean"),
        F.min("event_date").alias("first_date"),
        F.max("event_date").alias("last_date"),
        F.bool_or("has_mechanism").alias("any_mechanism"),
    )


def flagship(catalog: DataFrame, rules: CatalogRules, mechanisms: DataFrame, waveforms: DataFrame) -> DataFrame:
    """Catalogue to bin summary in one job: the epoch columns come from the same row, so no join by event is needed."""
    qc = catalog_qc(catalog, rules, mechanisms, waveforms)
    return event_bin_summary(event_bins(epoch_profile(qc, epochs(catalog.sparkSession))))


def merge_dedupe(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of collected parts with differing columns; the first part, then its first row, wins a key. Each part needs
    a row_order column."""
    tagged = [p.withColumn("source_order", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return first_rows(out, keys, ["source_order", "row_order"])


def catalog_coverage(raw: DataFrame, kept: DataFrame, source: str = "catalog_source") -> DataFrame:
    """For each source every day of its range, with raw and kept counts and a status."""
    day = F.to_date("time_utc").alias("day")
    raw_n = raw.select(source, day).groupBy(source, "day").agg(F.count(F.lit(1)).alias("n_raw"))
    kept_n = kept.select(source, day).groupBy(source, "day").agg(F.count(F.lit(1)).alias("n_kept"))
    days = raw_n.groupBy(source).agg(F.min("day").alias("a"), F.max("day").alias("b")).select(source, F.explode(F.sequence("a", "b")).alias("day"))
    out = days.join(raw_n, [source, "day"], "left").join(kept_n, [source, "day"], "left")
    out = out.withColumns({"n_raw": F.coalesce("n_raw", F.lit(0)), "n_kept": F.coalesce("n_kept", F.lit(0))})
    return out.withColumn("status", F.when(F.col("n_raw") == 0, "not_collected").when(F.col("n_kept") == 0, "all_filtered").otherwise("collected"))


def anti_join_resume(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(stored.select(*keys), keys, "left_anti")


def select_events_by_policy(df: DataFrame, n: int, policy: str) -> DataFrame:
    """recent, smallest, largest, or stratified: rounds over the magnitude strata 2-3, 3-4, 4-5 and 5+, newest first.
    Of fewer than n events all are taken, below magnitude 2 too."""
    if policy == "recent":
        return df.orderBy(F.desc("time_utc"), "event_id").limit(n)
    if policy == "smallest":
        return df.orderBy("magnitude", "time_utc", "event_id").limit(n)
    if policy == "stratified":
        if df.limit(n + 1).count() <= n:
            return df
        stratum = F.least(F.floor("magnitude"), F.lit(5)).cast("int")
        w = Window.partitionBy("__s").orderBy(F.desc("time_utc"), "event_id")
        ranked = df.where("magnitude >= 2").withColumn("__s", stratum).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
        return ranked.orderBy("__r", "__s").limit(n).drop("__s", "__r")
    return df.orderBy(F.desc("magnitude"), F.desc("time_utc"), "event_id").limit(n)


def select_display_events(df: DataFrame, n: int) -> DataFrame:
    """The top half by magnitude and the latest, each event once."""
    half = n // 2
    top = df.orderBy(F.desc("magnitude"), "event_id").limit(half)
    last = df.orderBy(F.desc("time_utc"), "event_id").limit(n - half)
    return top.union(last).dropDuplicates(["event_id"])


def frame_counts(df: DataFrame, days: int, max_frames: int) -> DataFrame:
    """Events by time bin from the first event on, and the running count. Bins widen until at most max_frames."""
    span = df.agg(F.to_date(F.min("time_utc")).alias("a"), F.datediff(F.max("time_utc"), F.min("time_utc")).alias("d")).first()
    total = (span["d"] or 0) + 1
    width = days if -(-total // days) <= max_frames else -(-total // max_frames)
    start = F.lit(span["a"])
    counts = df.select(F.floor(F.datediff(F.to_date("time_utc"), start) / float(width)).cast("long").alias("frame")).groupBy("frame").agg(F.count(F.lit(1)).alias("n_events"))
    # at most max_frames rows
    w = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns({"visible": F.sum("n_events").over(w), "frame_start": F.date_add(start, (F.col("frame") * width).cast("int"))})


def normalise_usgs_catalog(df: DataFrame, source: str) -> DataFrame:
    """Of text columns of the survey's CSV: earthquakes with magnitude and depth."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    kept = df.where((text("type") == "earthquake") & (text("mag") != "") & (text("depth") != ""))
    fallback = F.concat(F.coalesce("net", F.lit("usgs")), F.coalesce("code", F.lit("unknown")))
    return kept.select(
        F.when(text("id") != "", F.col("id")).otherwise(fallback).alias("event_id"),
        F.regexp_replace("time", r"\.000Z$", "Z").alias("time_utc"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.col("depth").alias("depth_km"),
        F.col("mag").alias("magnitude"),
        text("magType").alias("magnitude_type"),
        F.lit(source).alias("catalog_source"),
    )


def normalise_jst_catalog(df: DataFrame, rules: CatalogRules, prefix: str = "hinet_") -> DataFrame:
    """Origins in local time (UTC+9) to UTC, with the catalogue's filters."""
    out = df.withColumns({"event_id": F.concat(F.lit(prefix), F.col("evid").cast("string")), "time_utc": F.col("origin_jst") - F.expr("INTERVAL 9 HOURS")})
    return out.where(geo.in_bbox("lon", "lat", rules.bbox) & (F.col("magnitude") >= rules.min_magnitude) & F.col("depth_km").between(0.0, rules.max_depth_km))
