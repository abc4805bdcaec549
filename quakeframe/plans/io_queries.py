"""Registered queries of readers, writers and streams: given tables go through files of each format and come back.

Files lie in the shared folder, in a new place for each call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators.clusters import shared_folder
from ..sources import readers, sinks
from ..streaming import jobs
from .queries import BBOX, INSIDE, QUALITY, RULES, XM, YM, query, rounded, rsql


def place(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def as_csv(df: DataFrame, name: str) -> str:
    path = place(df, name)
    sinks.write_csv_export(df, path)
    return path


# ---------------------------------------------------------------- text tables

_TIME = "strftime(time_utc, '%Y-%m-%dT%H:%M:%SZ')"


@query(rsql(f"SELECT event_id, {_TIME} AS t, magnitude_type, depth_km, magnitude, {XM()} AS x_m, {YM()} AS y_m FROM fx_event", "event_id, t, magnitude_type", "depth_km, magnitude, x_m, y_m"))
def read_event_catalog(v):
    e = v("fx_event").withColumn("time_utc", expr.iso_text("time_utc")).select(*readers.EVENT)
    back = readers.read_event_catalog(e.sparkSession, as_csv(e, "events"), BBOX)
    return rounded(back.select("event_id", expr.iso_text("time_utc").alias("t"), F.coalesce("magnitude_type", F.lit("")).alias("magnitude_type"), "depth_km", "magnitude", "x_m", "y_m"))


@query(rsql(f"SELECT row_id, station_id, date, east_m, {XM()} AS x_m, {YM()} AS y_m FROM fx_gnss", "row_id, station_id, date", "east_m, x_m, y_m"))
def read_gnss_daily(v):
    g = v("fx_gnss").withColumns({c: F.lit(0.001) for c in readers.GNSS[-3:]}).select(*readers.GNSS, "row_id")
    back = readers.read_gnss_daily(g.sparkSession, as_csv(g, "gnss"), BBOX)
    return rounded(back.select(F.col("row_id").cast("long"), "station_id", "date", "east_m", "x_m", "y_m"))


@query(rsql("SELECT mechanism_id, event_id, strike1, dip1, rake2, scalar_moment_nm / 1e15 AS moment FROM fx_mechanism", "mechanism_id, event_id", "strike1, dip1, rake2, moment"))
def read_mechanisms(v):
    m = v("fx_mechanism").withColumn("source", F.lit("survey")).select(*readers.MECHANISM)
    back = readers.read_mechanisms(m.sparkSession, as_csv(m, "mechanisms"))
    return rounded(back.select("mechanism_id", "event_id", "strike1", "dip1", "rake2", (F.col("scalar_moment_nm") / 1e15).alias("moment")))


@query(rsql("SELECT l_orderkey, l_linenumber, l_partkey, amplitude AS pga, CASE WHEN l_linenumber % 2 = 0 THEN 0e0 ELSE group_delay_s END AS pgv FROM fx_spectrum", "l_orderkey, l_linenumber, l_partkey", "pga, pgv"))
def read_waveform_features(v):
    """Blank numbers become 0."""
    s = v("fx_spectrum").select(
        "event_id", "station_id", "channel", F.col("amplitude").alias("pga"), F.when(F.col("l_linenumber") % 2 != 0, F.col("group_delay_s")).alias("pgv"), *(F.lit(0.5).alias(c) for c in readers.WAVEFORM[5:11]), F.lit("survey").alias("source"), "l_orderkey", "l_linenumber", "l_partkey"
    )
    back = readers.read_waveform_features(s.sparkSession, as_csv(s, "features"))
    return rounded(back.select(*(F.col(c).cast("long") for c in ("l_orderkey", "l_partkey")), F.col("l_linenumber").cast("int"), "pga", "pgv"))


@query(rsql("SELECT l_orderkey, l_linenumber, l_partkey, channel, ln(greatest(amplitude, 1e-30)) AS log_amplitude, group_delay_s, 0e0 AS snr FROM fx_spectrum", "l_orderkey, l_linenumber, l_partkey, channel", "log_amplitude, group_delay_s, snr"))
def read_spectra(v):
    s = v("fx_spectrum").select(*readers.SPECTRUM, "channel", "l_orderkey", "l_linenumber", "l_partkey")
    back = readers.read_spectra(s.sparkSession, as_csv(s, "spectra"))
    return rounded(back.select(*(F.col(c).cast("long") for c in ("l_orderkey", "l_partkey")), F.col("l_linenumber").cast("int"), "channel", "log_amplitude", "group_delay_s", "snr"))


# ---------------------------------------------------------------- features and lines

# a line from each station, 0.1 degrees east and 0.05 north
_LINES = "SELECT station_id, network, lon, lat FROM fx_station"


def station_lines(v) -> DataFrame:
    at = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    return v("fx_station").select(F.col("station_id").alias("segment_id"), F.col("station_id").alias("name"), F.col("network").alias("source"), F.lit("45").alias("dip"), F.array(at(0.0, 0.0), at(0.1, 0.05)).alias("points"))


def as_collections(lines: DataFrame, name: str, files: int = 16) -> str:
    """Feature collections, a file for each of so many groups of lines."""
    path, features = place(lines, name), place(lines, "features")
    sinks.write_features(lines, features)
    one = lines.sparkSession.read.text(features).groupBy(F.pmod(F.xxhash64("value"), F.lit(files)).alias("g"))
    text = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list("value"), ","), F.lit("]}"))
    one.agg(text.alias("value")).repartition("g").write.partitionBy("g").text(path)
    return path


@query(rsql(f"WITH s AS ({_LINES});; SELECT station_id AS segment_id, network AS source, 45e0 AS dip, {XM()} AS first_x_m, {YM('(lat + 5e-2)')} AS last_y_m FROM s", "segment_id, source", "dip, first_x_m, last_y_m"))
def read_fault_features(v):
    lines = station_lines(v)
    back = readers.read_fault_features(lines.sparkSession, as_collections(lines, "faults"), BBOX)
    return rounded(back.select("segment_id", "source", "dip", F.col("trace")[0]["x"].alias("first_x_m"), F.col("trace")[1]["y"].alias("last_y_m")))


@query(rsql(f"WITH s AS ({_LINES});; SELECT station_id AS name, 2 AS n_points, lon AS first_lon, lat + 5e-2 AS last_lat FROM s", "name, n_points", "first_lon, last_lat"))
def read_plate_lines(v):
    lines = station_lines(v)
    back = readers.read_plate_lines(lines.sparkSession, as_collections(lines, "plates"))
    return rounded(back.select("name", F.size("points").alias("n_points"), F.col("points")[0]["lon"].alias("first_lon"), F.col("points")[1]["lat"].alias("last_lat")))


@query(rsql("SELECT catalog_source AS name, CAST(count(*) AS INTEGER) AS n_points, sum(depth_km) / 1e3 AS depth FROM fx_event WHERE k % 7 <> 0 GROUP BY 1", "name, n_points", "depth"))
def read_slab_lines(v):
    """Rows without a number are left out."""
    e = v("fx_event").select(F.col("catalog_source").alias("Contour"), F.col("lon").alias("Longitude"), F.col("lat").alias("Y"), F.when(F.col("k") % 7 != 0, F.col("depth_km").cast("string")).otherwise("none").alias("Depth"))
    back = readers.read_slab_lines(e.sparkSession, as_csv(e, "slab"))
    depth = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["depth_km"])
    return rounded(back.select("name", F.size("points").alias("n_points"), (depth / 1e3).alias("depth")))


# ---------------------------------------------------------------- writers


@query(f"SELECT event_id, {_TIME} AS t, count(*) OVER () AS told FROM fx_event")
def write_table(v):
    e = v("fx_event")
    path = place(e, "table")
    n = sinks.write_table(e, path, {"method": "copy"})
    told = e.sparkSession.read.text(f"{path}.metadata.json").select(F.from_json("value", "rows long, method string")["rows"].alias("told"))
    return e.sparkSession.read.parquet(path).select("event_id", expr.iso_text("time_utc").alias("t")).join(F.broadcast(told.where(F.col("told") == n)))


@query(rsql("SELECT segment_id, n, length_km, strike FROM fx_trace", "segment_id, n", "length_km, strike"))
def write_csv_export(v):
    t = v("fx_trace")
    back = t.sparkSession.read.option("header", True).csv(as_csv(t, "traces"))
    whole = back.withColumn("trace", F.from_json("trace", "array<struct<x:double,y:double>>")).where(F.size("trace") == 3)
    return rounded(whole.select("segment_id", F.col("n").cast("long"), F.col("length_km").cast("double"), F.col("strike").cast("double")))


@query(rsql(f"WITH s AS ({_LINES});; SELECT station_id AS name, network AS source, lon, lat FROM s", "name, source", "lon, lat"))
def write_features(v):
    lines = station_lines(v)
    path = place(lines, "features")
    sinks.write_features(lines, path)
    schema = "geometry struct<coordinates: array<array<double>>>, properties struct<name: string, source: string>"
    f = lines.sparkSession.read.text(path).select(F.from_json("value", schema).alias("f")).select("f.*")
    return rounded(f.select("properties.name", "properties.source", F.col("geometry.coordinates")[0][0].alias("lon"), F.col("geometry.coordinates")[0][1].alias("lat")))


@query("SELECT 'fx_events_out' AS name, 'registered' AS status, count(*) AS n FROM fx_event UNION ALL SELECT 'fx_nothing_out', 'missing', 0")
def register_outputs(v):
    e = v("fx_event")
    path = place(e, "out")
    sinks.write_table(e, path)
    status = sinks.register_outputs(e.sparkSession, {"fx_events_out": path, "fx_nothing_out": f"{path}-none"}).select("name", "status")
    n = e.sparkSession.table("fx_events_out").agg(F.count(F.lit(1)).alias("n"))  # one row
    return status.join(F.broadcast(n)).withColumn("n", F.when(F.col("status") == "registered", F.col("n")).otherwise(0))


@query("SELECT CAST(count(*) AS BIGINT) AS rows_, CAST(count(DISTINCT event_id || ':' || station_id) AS BIGINT) AS keys_, CAST(0 AS BIGINT) AS again FROM fx_spectrum")
def write_partitioned_parts(v):
    s = v("fx_spectrum")
    path = place(s, "parts")
    first = sinks.write_partitioned_parts(s, path, 16).agg(F.sum("rows").alias("rows_"), F.sum("keys").alias("keys_"))
    again = sinks.write_partitioned_parts(s, path, 16).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("again"))  # every part is there
    return first.join(F.broadcast(again))


_TYPED = [("event_id", "string"), ("magnitude", "double"), ("time_utc", "timestamp")]


@query(
    f"""WITH t AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(_TYPED))}) x(place, name, type)),
    n AS (SELECT 'given' AS output, count(*) AS n_rows FROM fx_event UNION ALL SELECT 'absent', 0)
    SELECT output, place, name, type, n_rows FROM t, n"""
)
def empty_outputs(v):
    """The events' output, and the empty one of a run without events, whose types come from the output; both as read back."""
    events = v("fx_event").select(*(c for c, _ in _TYPED))
    given, absent = place(events, "given"), place(events, "absent")
    events.write.parquet(given)
    spark, out = events.sparkSession, None
    for name, df in (("given", sinks.empty_outputs(events, given)), ("absent", sinks.empty_outputs(spark.read.parquet(given), absent))):
        fields = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for i, f in enumerate(df.schema)))
        counted = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("output"), F.explode(fields).alias("f"), "n_rows").select("output", "f.*", "n_rows")
        out = counted if out is None else out.unionByName(counted)
    return out


# ---------------------------------------------------------------- streams


def as_stream(df: DataFrame, name: str) -> DataFrame:
    path = place(df, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def drained(out: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for the files that are there."""
    path = place(out, name)
    q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)


@query(rsql(f"SELECT DISTINCT event_id, {XM()} AS x_m, {QUALITY} AS quality_score FROM (SELECT * FROM fx_event WHERE {INSIDE} AND time_utc >= TIMESTAMP '1970-01-01')", "event_id", "x_m, quality_score"))
def stream_catalog_qc(v):
    """Events that come twice count once. A stream's watermark begins at 1970, so older events are late."""
    e = v("fx_event")
    twice = as_stream(e.unionByName(e.where("k % 3 = 0")), "qc-in")
    return rounded(drained(jobs.stream_catalog_qc(twice, RULES), "qc-out").select("event_id", "x_m", "quality_score"))


@query(
    rsql(
        """WITH w AS (SELECT DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', CAST(time_utc AS DATE)) / 30e0) * 30 AS INTEGER) AS day, CAST(floor(depth_km / 5e0) AS BIGINT) AS depth_bin, magnitude FROM fx_event),
    z AS (SELECT CAST(max(time_utc) AS TIMESTAMP) - INTERVAL 30 DAY AS mark FROM fx_event)
    ;; SELECT day, depth_bin, count(*) AS event_count, avg(magnitude) AS magnitude_mean, max(magnitude) AS magnitude_max FROM w, z WHERE CAST(day + 30 AS TIMESTAMP) <= mark AND day + 30 > DATE '1970-01-01' GROUP BY ALL""",
        "day, depth_bin, event_count",
        "magnitude_mean, magnitude_max",
    )
)
def stream_bin_summary(v):
    """In append mode: windows that the watermark has passed; those that end by 1970, where it begins, are late."""
    out = drained(jobs.stream_bin_summary(as_stream(v("fx_event"), "bins-in")), "bins-out")
    return rounded(out.select(F.to_date("window.start").alias("day"), "depth_bin", "event_count", "magnitude_mean", "magnitude_max"))


@query("SELECT event_id, station_id, channel, frequency_hz, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT event_id, station_id, channel, frequency_hz FROM fx_spectrum) GROUP BY ALL")
def stream_append_spectra(v):
    """Two streams over the same rows store each key once."""
    s, keys = v("fx_spectrum"), ["event_id", "station_id", "channel", "frequency_hz"]
    path = place(s, "appended")
    for i in range(2):
        jobs.stream_append_spectra(as_stream(s, "spectra-in"), path, keys, f"{path}-progress{i}").awaitTermination()
    return s.sparkSession.read.schema(s.schema).parquet(path).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
