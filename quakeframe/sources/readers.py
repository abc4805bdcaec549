"""Readers: text tables with required columns, GeoJSON features, plate and slab lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr, geo

BBOX = (129.6, 31.8, 131.5, 33.6)

# Required columns of each input.
EVENT = ["event_id", "time_utc", "lat", "lon", "depth_km", "magnitude", "magnitude_type", "catalog_source"]
GNSS = ["station_id", "date", "lat", "lon", "east_m", "north_m", "up_m", "sigma_e", "sigma_n", "sigma_u"]
MECHANISM = ["mechanism_id", "event_id", "strike1", "dip1", "rake1", "strike2", "dip2", "rake2", "scalar_moment_nm", "source"]
WAVEFORM = ["event_id", "station_id", "channel", "pga", "pgv", "psa_0p3", "psa_1p0", "psa_3p0", "p_residual_s", "s_residual_s", "amp_residual_log", "source"]
SPECTRUM = ["event_id", "station_id", "frequency_hz", "amplitude", "phase_rad", "group_delay_s"]
SPECTRUM_OPTIONAL = {"channel": ("string", ""), "network": ("string", ""), "source": ("string", ""), "p_residual_s": ("double", 0.0), "s_residual_s": ("double", 0.0), "lat": ("double", 0.0), "lon": ("double", 0.0), "window_s": ("double", 0.0), "snr": ("double", 0.0)}


def require_columns(df: DataFrame, columns: list[str], name: str, not_empty: bool = False) -> DataFrame:
    """Raises ``ValueError`` with the missing columns, before any job; with ``not_empty`` also for an empty table."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {', '.join(missing)}")
    if not_empty and df.isEmpty():
        raise ValueError(f"{name}: no rows")
    return df


def _csv(spark: SparkSession, path: str, columns: list[str], name: str, not_empty: bool = False) -> DataFrame:
    return require_columns(spark.read.option("header", True).csv(path), columns, name, not_empty)


def _numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: expr.num(c) for c in columns})


def read_event_catalog(spark: SparkSession, path: str, bbox=BBOX, crs: str = "local", sample: bool = False) -> DataFrame:
    df = _numbers(_csv(spark, path, EVENT, "event catalogue", True), ["lat", "lon", "depth_km", "magnitude"])
    x, y = geo.project_lonlat("lon", "lat", bbox, crs)
    flags = {"has_mechanism": F.lit(False), "has_waveform_feature": F.lit(False), "is_sample_data": F.lit(sample)}
    return df.withColumns({"time_utc": expr.iso_time("time_utc"), "x_m": x, "y_m": y, "z_m": F.col("depth_km") * 1000.0, **flags})


def read_gnss_daily(spark: SparkSession, path: str, bbox=BBOX, crs: str = "local") -> DataFrame:
    df = _numbers(_csv(spark, path, GNSS, "GNSS"), GNSS[2:])
    x, y = geo.project_lonlat("lon", "lat", bbox, crs)
    return df.withColumns({"date": F.col("date").try_cast("date"), "x_m": x, "y_m": y})


def read_mechanisms(spark: SparkSession, path: str) -> DataFrame:
    return _numbers(_csv(spark, path, MECHANISM, "mechanisms"), MECHANISM[2:9])


def read_waveform_features(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path, WAVEFORM, "waveform features")
    return df.withColumns({c: F.coalesce(expr.num(c), F.lit(0.0)) for c in WAVEFORM[3:11]})


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Optional columns are added with their defaults; amplitudes are floored, phases wrapped."""
    df = _numbers(_csv(spark, path, SPECTRUM, "spectra"), SPECTRUM[2:])
    for c, (kind, default) in SPECTRUM_OPTIONAL.items():
        df = df.withColumn(c, F.coalesce(F.col(c).try_cast(kind), F.lit(default)) if c in df.columns else F.lit(default).cast(kind))
    a = F.greatest(F.coalesce("amplitude", F.lit(0.0)), F.lit(1e-30))
    return df.withColumns({"amplitude": a, "log_amplitude": F.log(a), "phase_rad": expr.wrap_phase("phase_rad")})


# GeoJSON, with positions and properties kept as text until a job asks for them
_FEATURES = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(T.StringType()))])
_FEATURE = "geometry struct<type: string, coordinates: string>, properties map<string, string>"


def _collection(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(_FEATURES).option("multiLine", True).json(path)
    checked = F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")).cast("array<string>"))
    return raw.select(F.posexplode(checked).alias("feature_index", "f")).select("feature_index", F.from_json("f", _FEATURE).alias("f")).select("feature_index", "f.*")


def _points(coordinates: Column) -> Column:
    return F.from_json(coordinates, "array<array<double>>")


def read_fault_features(spark: SparkSession, path: str, bbox=BBOX, crs: str = "local") -> DataFrame:
    """A row for each feature; the trace in metres, missing properties defaulted, the id from the geometry's hash."""
    df = _collection(spark, path)
    p = F.col("properties")
    number = lambda k, d: F.coalesce(p[k].try_cast("double"), F.lit(d))
    lon_lat = _points(F.col("geometry.coordinates"))

    def at(c: Column) -> Column:
        x, y = geo.project_lonlat(c[0], c[1], bbox, crs)
        return F.struct(x.alias("x"), y.alias("y"))

    df = df.withColumn("trace", F.coalesce(F.transform(lon_lat, at), F.array().cast("array<struct<x:double,y:double>>")))
    length = F.greatest(geo.polyline_length_km("trace"), F.lit(1.0))
    return df.select(
        F.coalesce(p["segment_id"], F.concat(F.lit("fault_"), F.hex(F.xxhash64(F.to_json("geometry"))))).alias("segment_id"),
        F.coalesce(p["strike"].try_cast("double"), geo.trace_strike_deg("trace")).alias("strike"),
        number("dip", 60.0).alias("dip"), number("rake", 0.0).alias("rake"), F.coalesce(p["length_km"].try_cast("double"), length).alias("length_km"), number("width_km", 10.0).alias("width_km"),
        number("top_depth_km", 0.0).alias("top_depth_km"), number("bottom_depth_km", 15.0).alias("bottom_depth_km"), expr.parse_bool_text(p["is_inferred"]).alias("is_inferred"), number("confidence", 0.5).alias("confidence"),
        F.coalesce(p["source"], F.lit("unknown")).alias("source"), "trace",
    )


def read_plate_lines(spark: SparkSession, path: str) -> DataFrame:
    """name and points (lon, lat, depth) of lines with at least two points; parts of a multi-line get numbered names."""
    df = _collection(spark, path)
    single, multi = F.array(_points(F.col("geometry.coordinates"))), F.from_json("geometry.coordinates", "array<array<array<double>>>")
    lines = F.when(F.col("geometry.type") == "LineString", single).when(F.col("geometry.type") == "MultiLineString", multi)
    name = F.coalesce(F.col("properties")["name"], F.col("properties")["Name"], F.concat(F.lit("boundary_"), F.col("feature_index").cast("string")))
    out = df.select(name.alias("name"), F.size(lines).alias("n"), F.posexplode(lines).alias("part", "line"))
    points = F.transform(F.filter("line", lambda c: F.size(c) >= 2), lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat"), F.coalesce(F.get(c, 2), F.lit(0.0)).alias("depth_km")))
    named = F.when(F.col("n") > 1, F.concat_ws("_", "name", F.col("part").cast("string"))).otherwise(F.col("name"))
    return out.select(named.alias("name"), points.alias("points")).where(F.size("points") >= 2)


# Accepted names of slab columns.
SLAB_NAMES = {"lon": ["lon", "longitude", "x"], "lat": ["lat", "latitude", "y"], "depth_km": ["depth_km", "depth", "z"], "name": ["name", "contour", "line_id"], "plate": ["plate", "slab"], "kind": ["kind", "type"]}


def read_slab_lines(spark: SparkSession, path: str, default_kind: str = "slab_contour") -> DataFrame:
    """Lines by (name, plate, kind) with points in file order; at least two points."""
    df = spark.read.option("header", True).csv(path)
    lower = {c.lower(): c for c in df.columns}
    have = {k: next((lower[n] for n in names if n in lower), None) for k, names in SLAB_NAMES.items()}
    missing = [k for k in ("lon", "lat", "depth_km") if have[k] is None]
    if missing:
        raise ValueError(f"slab table: missing columns {', '.join(missing)}")
    text = lambda k, d: F.coalesce(F.col(have[k]), F.lit(d)) if have[k] else F.lit(d)
    rows = df.select(
        F.monotonically_increasing_id().alias("i"), *(expr.num(have[k]).alias(k) for k in ("lon", "lat", "depth_km")), text("name", "slab").alias("name"), text("plate", "unknown").alias("plate"), text("kind", default_kind).alias("kind")
    ).where("lon is not null and lat is not null and depth_km is not null")
    points = F.transform(F.array_sort(F.collect_list(F.struct("i", "lon", "lat", "depth_km"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), p["depth_km"].alias("depth_km")))
    return rows.groupBy("name", "plate", "kind").agg(points.alias("points")).where(F.size("points") >= 2)
