"""Faults: nearest traces, stress scores, candidates from event clouds, scenario quantiles and rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, geo, linear
from ..functions.fields import WeightTree
from ..functions.trees import SegmentTree
from .clusters import cut

BROADCAST_ROWS = 200_000
PLACE_ROWS = 2_000  # places that a task looks up at least, if there are as many


def is_small(df: DataFrame, most: int | None = None) -> bool:
    most = BROADCAST_ROWS if most is None else most
    return df.limit(most + 1).count() <= most


def small_side(df: DataFrame, most: int | None = None) -> DataFrame:
    """Broadcast if counted to be small; else Spark plans the join without a hint."""
    return F.broadcast(df) if is_small(df, most) else df


def segments(traces: DataFrame) -> DataFrame:
    """A row for each pair of consecutive points; a trace of one point is a segment of no length."""
    points = F.when(F.size("trace") == 1, F.concat("trace", "trace")).otherwise(F.col("trace"))
    pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cut = traces.select("segment_id", F.explode(pairs).alias("s"))
    return cut.select(F.col("segment_id").alias("near_segment_id"), F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def _reached(points: DataFrame, cuts: DataFrame, key: str, reach_m: float) -> DataFrame:
    """key and nearest segment (m) of points that have one within reach: cells as wide as the reach meet the segments whose box,
    widened by it, covers them."""
    cell = lambda c: F.floor(c / reach_m)
    span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - reach_m), cell(F.greatest(a, b) + reach_m)))
    spread = cuts.withColumn("tx", span("ax", "bx")).withColumn("ty", span("ay", "by"))
    d = geo.point_segment_distance("px", "py", "ax", "ay", "bx", "by") / 1000.0
    met = points.withColumns({"tx": cell(F.col("px")), "ty": cell(F.col("py"))}).join(spread, ["tx", "ty"]).withColumn("d", d)
    return met.where(F.col("d") * 1000.0 <= reach_m).groupBy(key).agg(F.min(F.struct("d", "near_segment_id")).alias("m"))


def _in_tree(points: DataFrame, cuts: DataFrame, key: str, batch_rows: int = 4000) -> DataFrame:
    held = cuts.toPandas()  # at most BROADCAST_ROWS rows
    ids = held["near_segment_id"].to_numpy(object)
    ends = [held[c].to_numpy(float) for c in ("ax", "ay", "bx", "by")]
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids.astype(str), kind="stable")] = np.arange(len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = SegmentTree(*ends) if len(ids) else None
        for whole in batches:
            for batch in (whole.slice(i, batch_rows) for i in range(0, whole.num_rows, batch_rows)) if tree else ():
                x, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (1, 2))
                there = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
                at, d = tree.nearest(x[there], y[there], rank)
                m = pa.StructArray.from_arrays([pa.array(d / 1000.0), pa.array(ids[at], pa.string())], ["d", "near_segment_id"])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(there)), m], names=[key, "m"])

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, "px", "py").mapInArrow(run, f"`{key}` {kind}, m struct<d: double, near_segment_id: string>")


def _nearest(points: DataFrame, cuts: DataFrame, key: str, reach_m: float = 25_000.0, widenings: int = 5) -> DataFrame:
    """key and m: the nearest segment of each point (px, py). Up to ``BROADCAST_ROWS`` segments go to all tasks, which look points up in a packed
    tree; more are met through cells whose width grows fourfold for the points that have found none."""
    if is_small(cuts):
        return _in_tree(points, cuts, key)
    cuts, left, found = cut(cuts), cut(points), None
    for _ in range(widenings):
        some = cut(_reached(left, cuts, key, reach_m))
        found = some if found is None else found.unionByName(some)
        left = cut(left.join(some.select(key), key, "left_anti"))
        if left.isEmpty():
            return found
        reach_m *= 4
    return found.unionByName(_reached(left, cuts, key, 1e8))  # farther than any two places of the plane


def nearest_fault(points: DataFrame, traces: DataFrame, key: str, x: str = "x_m", y: str = "y_m") -> DataFrame:
    """For each point its nearest trace and the distance in km; without traces null and infinity. Equal distances go to
    the smaller id."""
    near = _nearest(points.select(key, F.col(x).alias("px"), F.col(y).alias("py")), segments(traces), key)
    out = points.join(near, key, "left")
    return out.withColumns({"nearest_segment_id": F.col("m.near_segment_id"), "fault_distance_km": F.coalesce("m.d", F.lit(float("inf")))}).drop("m")


def known_fault_distance(candidates: DataFrame, traces: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Distance of candidate centres and the score 1 - min(d, 30) / 30; 0.5 without known faults."""
    out = nearest_fault(candidates, traces, key, "center_x_m", "center_y_m")
    d = F.col("fault_distance_km")
    return out.withColumn("proximity_score", F.when(d == float("inf"), 0.5).otherwise(1 - F.least(d, F.lit(30.0)) / 30.0))


def link_inferred_to_known(inferred: DataFrame, known: DataFrame, most_km: float = 50.0) -> DataFrame:
    """Nearest known centre within ``most_km``: cells as wide as that meet their neighbours."""
    cell = lambda c: F.floor(F.col(c) / (most_km * 1000.0))
    k = known.select(F.col("segment_id").alias("known_id"), F.col("x_m").alias("kx"), F.col("y_m").alias("ky")).withColumns({"tx": cell("kx"), "ty": cell("ky")})
    around = F.explode(F.array(*(F.struct((cell("x_m") + i).alias("tx"), (cell("y_m") + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    d = F.hypot(F.col("x_m") - F.col("kx"), F.col("y_m") - F.col("ky")) / 1000.0
    met = inferred.select("segment_id", "x_m", "y_m", around.alias("c")).select("segment_id", "x_m", "y_m", "c.*").join(k, ["tx", "ty"]).withColumn("d", d)
    near = met.where(F.col("d") <= most_km).groupBy("segment_id").agg(F.min(F.struct("d", "known_id")).alias("m"))
    return near.select("segment_id", F.col("m.known_id").alias("known_id"), F.col("m.d").alias("distance_km"))


def stress_pairs(events: DataFrame, faults: DataFrame) -> DataFrame:
    """Every event with every fault: 3-D distance and approximate score. Faults are the small side; events keep their
    partitions, and sums should be taken of these pairs at once rather than of a stored table."""
    f = faults.select("segment_id", F.col("x_m").alias("fx"), F.col("y_m").alias("fy"), F.coalesce("z_m", F.lit(5000.0)).alias("fz"), F.col("strike").alias("fs"))
    d = F.greatest(F.lit(0.1), F.sqrt(F.pow(F.col("x_m") - F.col("fx"), 2) + F.pow(F.col("y_m") - F.col("fy"), 2) + F.pow(F.col("z_m") - F.col("fz"), 2)) / 1000.0)
    out = events.select("event_id", F.to_date("time_utc").alias("date"), "magnitude", "x_m", "y_m", "z_m").join(small_side(f))
    out = out.withColumn("distance_km", d).withColumn("mechanism_alignment", 1 - F.least(F.lit(90.0), expr.angle_difference_deg("fs", "fs")) / 90.0)
    scale = expr.clamp01((F.col("magnitude") - 2) / 5.0)
    score = expr.clamp01(F.exp(-F.col("distance_km") / 35.0) * (0.35 + 0.65 * scale) * F.col("mechanism_alignment"))
    return out.select("segment_id", "event_id", "date", F.lit(None).cast("double").alias("cfs_pa"), score.alias("cfs_score_approx"), "distance_km", "mechanism_alignment", F.lit(0.4).alias("effective_friction"))


def stress_value(scale: bool = True):
    score = F.col("cfs_score_approx") * (1e5 if scale else 1.0)
    return F.coalesce(F.col("cfs_pa"), score, F.lit(0.0))


def stress_sum_by_segment(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("segment_id").agg(F.sum(stress_value()).alias("cfs_sum_pa"))


def latest_stress_by_segment(pairs: DataFrame) -> DataFrame:
    last = pairs.agg(F.max("date").alias("last_date"))  # one row
    return pairs.join(F.broadcast(last), F.col("date") == F.col("last_date")).groupBy("segment_id").agg(F.avg(stress_value(False)).alias("value"))


def stress_time_bins(pairs: DataFrame, bin_days: int, max_frames: int) -> DataFrame:
    """Mean value by time bin and segment; bins widen until at most max_frames."""
    span = pairs.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    if span["a"] is None:
        return pairs.select(F.lit(None).cast("date").alias("bin_start"), "segment_id", F.lit(None).cast("double").alias("value")).limit(0)
    days = (span["b"] - span["a"]).days + 1
    width = bin_days if days / bin_days <= max_frames else -(-days // max_frames)
    start = F.lit(span["a"])
    n = F.floor(F.datediff("date", start) / float(width)).cast("int")
    return pairs.groupBy(F.date_add(start, n * width).alias("bin_start"), "segment_id").agg(F.avg(stress_value(False)).alias("value"))


# ---------------------------------------------------------------- scenarios


def scenario_quantiles(members: DataFrame, stress: DataFrame, years: int) -> DataFrame:
    """Failure index of each ensemble member and year, and its quantiles by segment and year."""
    m = members.join(stress, "segment_id", "left").withColumn("strength", F.col("cohesion_pa") + F.col("friction") * F.col("normal_pa"))
    m = m.select("segment_id", "strength", "stress_rate", (F.col("initial_fraction") * F.col("strength") + F.coalesce("cfs_sum_pa", F.lit(0.0))).alias("initial"), F.explode(F.sequence(F.lit(0), F.lit(years))).alias("year"))
    index = F.greatest(F.lit(0.0), F.col("initial") + F.col("stress_rate") * F.col("year")) / F.col("strength")
    m = m.withColumn("idx", index)
    out = m.groupBy("segment_id", "year").agg(
        F.percentile("idx", [0.05, 0.5, 0.95]).alias("q"), F.avg(F.when(F.col("idx") > 1, 1.0).otherwise(0.0)).alias("prob_index_gt_1"), F.avg("stress_rate").alias("stress_rate_mean"), F.stddev_pop("stress_rate").alias("rate_std")
    )
    return out.select(
        "segment_id", "year", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"), "prob_index_gt_1", "stress_rate_mean",
        expr.clamp01(F.col("rate_std") / (F.col("stress_rate_mean") + 1e-9)).alias("uncertainty_score"),
    )


HORIZONS = (0, 10, 30, 50, 100)


def rank_failure(scenarios: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    w = Window.partitionBy("year").orderBy(F.desc("p50"), "segment_id")
    return scenarios.where(F.col("year").isin(*horizons)).withColumn("rank", F.row_number().over(w))


def failure_delta(scenarios: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """p50 at the chosen years and its increase over the first of them."""
    chosen = scenarios.where(F.col("year").isin(*years)).select("segment_id", "year", F.col("p50").alias("value"))
    first = chosen.where(F.col("year") == min(years)).select("segment_id", F.col("value").alias("base"))
    return chosen.join(first, "segment_id").select("segment_id", "year", "value", F.greatest(F.lit(0.0), F.col("value") - F.col("base")).alias("increase"))


def top_scenarios(scenarios: DataFrame, by: str, n: int = 10, year: int = 100) -> DataFrame:
    return scenarios.where(F.col("year") == year).orderBy(F.desc(by), "segment_id").limit(n)


# ---------------------------------------------------------------- candidates


# Tile metres, depth metres, least events, name.
TILES = [(80000.0, 15000.0, 5, "local80_depth15"), (50000.0, 10000.0, 5, "local50_depth10"), (30000.0, 8000.0, 4, "local30_depth8"), (20000.0, 6000.0, 4, "local20_depth6"), (15000.0, 5000.0, 4, "local15_depth5")]
SHIFTS = [(0.0, 0.0), (0.5, 0.5), (0.5, 0.0), (0.0, 0.5)]


def cluster_eps(points: DataFrame, low: float = 8000.0, high: float = 50000.0) -> DataFrame:
    """One row: a twentieth of the larger horizontal span, within 8 and 50 km."""
    span = F.greatest(F.max("x_m") - F.min("x_m"), F.max("y_m") - F.min("y_m"))
    return points.agg(expr.clamp(span / 20.0, low, high).alias("eps_m"))


def _tiled(points: DataFrame, least_points: int) -> DataFrame:
    """Every event in each of 20 tile grids: method, least events of a tile, and its place (tx, ty, tz)."""
    spark = points.sparkSession
    specs = spark.createDataFrame([(t, d, n, f"{name}_offset{i}", sx * t, sy * t) for t, d, n, name in TILES for i, (sx, sy) in enumerate(SHIFTS)], "tile double, depth double, least int, method string, sx double, sy double")
    origin = points.agg(F.min("x_m").alias("x0"), F.min("y_m").alias("y0"), F.min("z_m").alias("z0"), F.count(F.lit(1)).alias("n_points"))  # one row
    p = points.crossJoin(F.broadcast(origin)).where(F.col("n_points") >= least_points).crossJoin(F.broadcast(specs))
    cell = [F.floor((F.col("x_m") - F.col("x0") + F.col("sx")) / F.col("tile")), F.floor((F.col("y_m") - F.col("y0") + F.col("sy")) / F.col("tile")), F.floor((F.col("z_m") - F.col("z0")) / F.col("depth"))]
    return p.withColumns({"tx": cell[0], "ty": cell[1], "tz": cell[2]})


def _tile_name() -> Column:
    return F.concat_ws("_", "method", F.col("tx").cast("string"), F.col("ty").cast("string"), F.col("tz").cast("string"))


def tile_sizes(points: DataFrame, least_points: int = 200) -> DataFrame:
    """cluster_id, method and n of the tiles of ``multiscale_tiles``. Events are counted where they are; members are no rows."""
    sizes = _tiled(points, least_points).groupBy("method", "least", "tx", "ty", "tz").agg(F.count(F.lit(1)).alias("n")).where("n >= least")
    return sizes.select(_tile_name().alias("cluster_id"), "method", "n")


def multiscale_tiles(points: DataFrame, least_points: int = 200) -> DataFrame:
    """Members (cluster_id, method, event_id, x_m, y_m, z_m, and time_utc, lon, lat where there) of 20 tile grids, tiles with enough
    events only. The tiles are counted first; few of them go to all tasks, so that members are found where the events are."""
    extra = [c for c in ("time_utc", "lon", "lat") if c in points.columns]
    keyed = _tiled(points, least_points)
    full = cut(keyed.groupBy("method", "least", "tx", "ty", "tz").agg(F.count(F.lit(1)).alias("n")).where("n >= least").drop("least", "n"))
    return keyed.join(small_side(full), ["method", "tx", "ty", "tz"]).select(_tile_name().alias("cluster_id"), "method", "event_id", "x_m", "y_m", "z_m", *extra)


def cluster_covariance(members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Count, centre and sample covariance of each cluster; combined before the shuffle."""
    c = [F.covar_samp(a, b).alias(f"c{a[0]}{b[0]}") for a, b in (("x_m", "x_m"), ("x_m", "y_m"), ("x_m", "z_m"), ("y_m", "y_m"), ("y_m", "z_m"), ("z_m", "z_m"))]
    return members.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), F.avg("x_m").alias("center_x_m"), F.avg("y_m").alias("center_y_m"), F.avg("z_m").alias("center_z_m"), *c)


#: eigenvalues closer than this share of the largest count as equal
EQUAL = 1e-9


def plane_fit(covariances: DataFrame) -> DataFrame:
    """Plane normal, extents and planarity of 3 x 3 covariances, by their eigenvalues in closed form. The normal is the vector of the
    smallest one; it points up, and a level one is turned so that its first component that isn't 0 is positive. Events on a line lie in many
    planes: of these the flattest is taken (of a vertical line that across x); a cloud alike in all directions, or without extent, has the
    level plane. Null covariances (of a single event) count as 0."""
    made = ["nx", "ny", "nz", "length_km", "width_km", "planarity"]
    kept = [c for c in covariances.columns if c not in made]
    out = linear.symmetric_eigen(covariances.select(*kept), value="ev_", vector="en_")
    out = out.withColumns({f"ev_{k}": F.greatest(F.lit(0.0), f"ev_{k}") for k in range(3)})
    ball = F.col("ev_2") - F.col("ev_0") <= EQUAL * F.col("ev_2")
    line = F.col("ev_1") - F.col("ev_0") <= EQUAL * F.col("ev_2")
    slope = 1 - F.col("en_2z") * F.col("en_2z")
    flattest = [F.when(slope < 1e-12, F.lit(1.0 if a == "x" else 0.0)).otherwise((F.lit(1.0 if a == "z" else 0.0) - F.col("en_2z") * F.col(f"en_2{a}")) / F.sqrt(slope)) for a in "xyz"]
    normal = [F.when(ball, F.lit(1.0 if a == "z" else 0.0)).when(line, f).otherwise(F.col(f"en_0{a}")) for a, f in zip("xyz", flattest)]
    out = out.withColumns({f"en_{a}": n for a, n in zip("xyz", normal)})
    out = out.withColumns({f"en_{a}": F.when(F.abs(f"en_{a}") < 1e-12, 0.0).otherwise(F.col(f"en_{a}")) for a in "xyz"})
    lead = F.when(F.col("en_z") != 0, F.col("en_z")).when(F.col("en_x") != 0, F.col("en_x")).otherwise(F.col("en_y"))
    sign = F.when(lead < 0, -1.0).otherwise(1.0)
    count = F.greatest(F.lit(1.0), F.col("n_events").cast("double"))
    size = lambda k: F.greatest(F.lit(1.0), 4 * F.sqrt(F.col(f"ev_{k}") * ((count - 1) / count)) / 1000)
    total = F.greatest(F.lit(1e-9), F.col("ev_0") + F.col("ev_1") + F.col("ev_2"))
    values = [*(sign * F.col(f"en_{a}") for a in "xyz"), size(2), size(1), expr.clamp01(1 - F.col("ev_0") / total)]
    return out.select(*kept, *(v.alias(n) for v, n in zip(values, made)))


def mechanism_consistency(members: DataFrame, planes: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """cluster_id and the mean of 1 - min(difference of either strike, 90) / 90 over the members' mechanisms; 0.5 without.
    Members are cut to events with a mechanism before they meet the planes."""
    # equal mechanisms of an event count as often as they come
    m = cut(mechanisms.groupBy("event_id", "strike1", "strike2").agg(F.count(F.lit(1)).alias("times")))
    hit = members.select("cluster_id", "event_id").join(small_side(m), "event_id").join(planes.select("cluster_id", "strike"), "cluster_id")
    d = F.least(expr.angle_difference_deg("strike", "strike1"), expr.angle_difference_deg("strike", "strike2"), F.lit(90.0))
    scored = hit.groupBy("cluster_id").agg((1 - F.sum(d * F.col("times")) / F.sum(F.when(d.isNotNull(), F.col("times"))) / 90.0).alias("s"))
    return planes.select("cluster_id").join(scored, "cluster_id", "left").select("cluster_id", F.coalesce("s", F.lit(0.5)).alias("mechanism_score"))


def gnss_proximity_score(clusters: DataFrame, stations: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Ten times the mean over all stations of strain score / distance in km (at least 1), between 0 and 1. Stations without a place or a score count
    for nothing; without stations, or for a cluster without a centre, 0.5.

    Tasks sum far groups of stations by their moments (``WeightTree``: off by a share below 4e-10), so a cluster takes log m steps for m stations.
    Stations at one place are one with the sum of their scores, and a place of clusters is looked up once. Stations go to tasks in parts of about
    ``BROADCAST_ROWS``; the sums of further parts are added to those of the first. Places are dealt out evenly, as a few files of them would be a few long tasks."""
    known = [F.col(c).cast("double").alias(n) for c, n in (("x_m", "x"), ("y_m", "y"), ("strain_gradient_score", "w"))]
    s = stations.select(*known).where(" and ".join(f"{c} is not null and not isnan({c})" for c in "xyw"))
    s = s.groupBy("x", "y").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    s = cut(s.withColumn("part", F.monotonically_increasing_id()))  # a part is the same rows each time it is read
    held = s.agg(F.count(F.lit(1)).alias("places"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n, parts = held["n"], -(-held["places"] // BROADCAST_ROWS)
    centre = ["center_x_m", "center_y_m"]
    named = clusters.select(key, *(F.col(c).cast("double").alias(c) for c in centre))
    places = cut(named.select(*centre).where(" and ".join(f"{c} is not null and not isnan({c})" for c in centre)).distinct())
    # the number of tasks is set, as rows are few for the work on them and small parts would be put together
    tasks = max(1, min(places.count() // PLACE_ROWS, 4 * int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = places.repartition(tasks).select(*centre, F.lit(0.0).alias("total"))
    for part in range(parts):
        out = _with_sums(out, s.where(F.col("part") % parts == part).toPandas())  # about BROADCAST_ROWS rows
        out = cut(out) if parts > 1 else out
    if not n:
        return named.select(key, F.lit(0.5).alias("gnss_score"))
    score = F.when(F.col("center_x_m").isNotNull() & F.col("center_y_m").isNotNull(), expr.clamp01(10 * F.col("total") / n))
    return named.join(out, centre, "left").select(key, F.coalesce(score, F.lit(0.5)).alias("gnss_score"))


def _with_sums(places: DataFrame, held: pd.DataFrame, batch_rows: int = 2000) -> DataFrame:
    """``total`` more by the sum of weight / distance in km over the held stations."""
    tree = WeightTree(*(held[c].to_numpy(float) for c in "xyw"))  # made once, not in each task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, batch_rows) for i in range(0, whole.num_rows, batch_rows)):
                px, py, total = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in range(3))
                there = np.isfinite(px) & np.isfinite(py)
                total = total.copy()
                total[there] += 1000.0 * tree.sums(px[there], py[there], 1000.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(2)), pa.array(total)], names=batch.schema.names)

    return places.mapInArrow(run, "center_x_m double, center_y_m double, total double")


def is_regional_sheet():
    return (F.col("length_km") > 800) | (F.col("width_km") > 300)


def select_region_sheets(candidates: DataFrame) -> DataFrame:
    """Drops regional sheets if any local candidate is left."""
    local = candidates.agg(F.count_if(~is_regional_sheet()).alias("n_local"))  # one row
    return candidates.crossJoin(F.broadcast(local)).where(~is_regional_sheet() | (F.col("n_local") == 0)).drop("n_local")


def limit_faults(faults: DataFrame, n: int) -> DataFrame:
    return faults.orderBy(F.desc(F.coalesce("fault_score", "confidence", F.lit(0.0))), "segment_id").limit(n)


def limit_faults_known_first(faults: DataFrame, n: int) -> DataFrame:
    score = F.when(F.col("is_inferred"), F.coalesce("fault_score", "confidence")).otherwise(F.col("confidence"))
    return faults.orderBy("is_inferred", F.desc(score), "segment_id").limit(n)


def union_faults(known: DataFrame, inferred: DataFrame) -> DataFrame:
    return known.withColumn("part", F.lit(0)).unionByName(inferred.withColumn("part", F.lit(1)), allowMissingColumns=True)


def candidate_attributes(planes: DataFrame) -> DataFrame:
    """Strike, dip, score, confidence, rake and depths of fitted clusters with their scores. A score of 0.5 counts as such whatever the order
    its sum was taken in, so its last bits do not turn the rake."""
    strike, dip = geo.plane_to_strike_dip("nx", "ny", "nz")
    out = planes.withColumns({"strike": strike, "dip": dip, "center_depth_km": F.greatest(F.lit(0.0), F.col("center_z_m") / 1000.0), "waveform_score": F.lit(0.5)})
    half = F.col("width_km") * F.sin(F.radians("dip")) / 2
    out = out.withColumns({"fault_score": expr.fault_score("planarity", "mechanism_score", "gnss_score", "waveform_score", "proximity_score"), "top_depth_km": F.greatest(F.lit(0.0), F.col("center_depth_km") - half), "bottom_depth_km": F.col("center_depth_km") + half, "rake": F.when(F.round("mechanism_score", 12) >= 0.5, -170.0).otherwise(0.0)})
    nearest = F.coalesce("nearest_segment_id", F.lit("no_known_faults_loaded"))
    near = F.when(F.col("fault_distance_km") <= 5, "known_fault_extension_candidate").otherwise(F.concat(F.lit("unregistered_candidate; nearest_known="), nearest))
    return out.withColumns({"confidence": expr.confidence_from_score("fault_score", "n_events"), "notes": near})


#: names of the score columns in a candidate's output
SCORE_NAMES = {
    "planarity": "seismicity_planarity_score", "mechanism_score": "mechanism_consistency_score", "gnss_score": "gnss_strain_gradient_score", "waveform_score": "waveform_residual_score",
    "proximity_score": "distance_from_known_fault_score", "fault_distance_km": "distance_to_known_fault_km",
}


def candidate_traces(members: DataFrame) -> DataFrame:
    """cluster_id, inference_method and the trace from a cluster's first to its last event by time. First and last times are numbers, which are
    found without a sort; places are looked up for the members of these times alone."""
    rows = members.withColumn("t", F.coalesce(F.unix_micros("time_utc"), F.lit(-(1 << 63))))  # unknown times come first
    ends = rows.groupBy("cluster_id", "method").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    ends = cut(ends.groupBy("cluster_id").agg(F.min("method").alias("inference_method"), F.min("a").alias("a"), F.max("b").alias("b")))
    at = rows.select("cluster_id", "t", "event_id", "lon", "lat").join(small_side(ends), "cluster_id").where("t = a or t = b")
    place, when = F.struct("lon", "lat"), F.struct("t", "event_id")
    return at.groupBy("cluster_id", "inference_method").agg(F.array(F.min_by(place, when), F.max_by(place, when)).alias("trace"))


def infer_faults(events: DataFrame, traces: DataFrame, mechanisms: DataFrame, stations: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Clusters, plane fits and scores in one table; ``members`` may add clusters of another method to the tiles. An event is a member of some 20
    tiles: these rows are made where the events are, each time they are summed, and never written."""
    tiles = multiscale_tiles(events)
    every = tiles if members is None else tiles.unionByName(cut(members))
    fitted = cut(plane_fit(cluster_covariance(every)))
    strike, _ = geo.plane_to_strike_dip("nx", "ny", "nz")
    fitted = fitted.withColumn("strike", strike)
    mech = mechanism_consistency(every, fitted, mechanisms)
    out = known_fault_distance(fitted.join(mech, "cluster_id"), traces, "cluster_id").join(gnss_proximity_score(fitted, stations), "cluster_id")
    return candidate_attributes(out.drop("strike")).join(candidate_traces(every), "cluster_id")


def candidate_features(kept: DataFrame) -> DataFrame:
    """Output rows of kept candidates: score names, provenance, and the local trace along strike through the centre."""
    half = [F.col("length_km") * 500.0 * f(F.radians("strike")) for f in (F.sin, F.cos)]
    end = lambda s: F.struct((F.col("center_x_m") + s * half[0]).alias("x"), (F.col("center_y_m") + s * half[1]).alias("y"))
    out = kept.withColumns({"local_trace": F.array(end(-1), end(1)), "is_inferred": F.lit(True), "source": F.lit("seismicity_pca_multiscale"), "sensitivity_mode": F.lit("high_resolution_multiscale_overlapping_tiles")})
    return out.withColumnsRenamed({**SCORE_NAMES, "cluster_id": "raw_cluster_id"})
