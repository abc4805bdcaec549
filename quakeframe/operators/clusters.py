"""Iterative jobs: connected components, density clusters, greedy deduplication. Rounds are cut by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which executors share; a local one is set in local mode only."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again. Unlike a checkpoint this runs the plan once, gives the planner true sizes, and
    carries no constraints of earlier rounds, which else double with every round."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id and label (the smallest id reached) of each node. Every round each node joins its smallest neighbour, and that one's, four steps
    far, and edges are contracted, until none is left."""
    labels = nodes.select("id", F.col("id").alias("at"))
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        if least.isEmpty():
            break
        for _ in range(2):
            least = least.join(least.select(F.col("a").alias("to"), F.col("to").alias("far")), "to").select("a", F.col("far").alias("to"))
        least = cut(least)
        labels = cut(labels.join(least, labels["at"] == least["a"], "left").select("id", F.coalesce("to", "at").alias("at")))
        l, r = least.select("a", F.col("to").alias("a2")), least.select(F.col("a").alias("b"), F.col("to").alias("b2"))
        edges = cut(edges.join(l, "a").join(r, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    # contraction ends at some member; its smallest is the label
    small = labels.groupBy("at").agg(F.min("id").alias("label"))
    return labels.join(small, "at").select("id", "label")


def _cells(points: DataFrame, eps: float) -> DataFrame:
    return points.withColumns({c: F.floor(F.col(v) / eps).cast("long") for c, v in (("cx", "x_m"), ("cy", "y_m"), ("cz", "z_m"))})


def _around(r: range = range(-1, 2)) -> Column:
    return F.explode(F.array(*(F.struct((F.col("cx") + i).alias("nx"), (F.col("cy") + j).alias("ny"), (F.col("cz") + k).alias("nz")) for i in r for j in r for k in r)))


def grid_components(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """event_id and cluster (null: none): occupied cells joined through their 26 neighbours; groups with enough points.
    Only occupied cells move through the rounds, not points."""
    p = _cells(points, eps)
    name = lambda x, y, z: F.concat_ws(":", F.col(x).cast("string"), F.col(y).cast("string"), F.col(z).cast("string"))
    occupied = cut(p.groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n")).withColumn("id", name("cx", "cy", "cz")))
    near = occupied.select("id", _around().alias("c")).select(F.col("id").alias("a"), "c.nx", "c.ny", "c.nz").withColumn("b", name("nx", "ny", "nz"))
    edges = near.where("a < b").join(occupied.select(F.col("id").alias("b")), "b").select("a", "b")
    labelled = components(occupied, edges).join(occupied.select("id", "n", "cx", "cy", "cz"), "id")
    full = labelled.groupBy("label").agg(F.sum("n").alias("size")).where(F.col("size") >= min_samples)
    kept = labelled.join(full, "label").select("cx", "cy", "cz", F.col("label").alias("cluster"))
    return p.join(kept, ["cx", "cy", "cz"], "left").select("event_id", "cluster")


XYZ = ("x_m", "y_m", "z_m")
#: pairs of points that are compared one by one rather than split further, and the deepest split
DIRECT, DEEPEST = 1024, 24


def _nodes(points: DataFrame, key: str, level: int, side: float) -> DataFrame:
    """Nodes of an octree over each key's points: count, box and the point next to the middle, by key and place (i, j, k). A cell's side is
    halved ``level`` times; points of equal places count, and share a box without extent."""
    scaled = [F.col(c) / side * float(1 << level) for c in XYZ]
    at = {n: F.floor(x).cast("long") for n, x in zip("ijk", scaled)}
    off = sum((F.pow(x - F.floor(x) - 0.5, 2) for x in scaled), F.lit(0.0))
    ends = [f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
    placed = points.withColumns(at).withColumn("off", off)
    return placed.groupBy(key, "i", "j", "k").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*XYZ), F.struct("off", *XYZ)).alias("rep"), *ends)


def _sided(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.withColumnsRenamed({c: f"{side}_{c}" for c in nodes.columns if c != side})


def within(left: DataFrame, right: DataFrame, pairs: DataFrame, eps: float, side: float, least: int = 1) -> DataFrame:
    """Of ``pairs`` (a, b) those with points of ``left`` (a, x_m, y_m, z_m) and of ``right`` (b, ...) within eps: a, b and hits.

    Both sides are split as octrees, level by level, and only boxes whose gap is within eps go on. Boxes that lie within eps as a whole give
    their hits at once, boxes of few points are compared point by point, and a pair with ``least`` hits goes no further. With ``least`` 1 two
    middle points within eps settle a pair. Otherwise ``left`` has one point for each a, and hits below ``least`` are its whole number of
    neighbours. So two dense clouds never give the pairs of their points, and no task holds a cloud.
    """
    d2 = lambda f: sum((F.pow(f(c), 2) for c in XYZ), F.lit(0.0))
    gap = d2(lambda c: F.greatest(F.lit(0.0), F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}")))
    far = d2(lambda c: F.greatest(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"), F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}")))
    reps = d2(lambda c: F.col(f"a_rep.{c}") - F.col(f"b_rep.{c}"))
    hits = F.when(far <= eps * eps, F.col("b_n"))
    if least == 1:
        hits = hits.when(reps <= eps * eps, F.lit(1))
    active = cut(pairs.select("a", "b"))
    found = active.select("a", "b", F.lit(0).cast("long").alias("hits")).where("hits > 0")
    if active.isEmpty():
        return found
    left, right = cut(left.select("a", *XYZ)), cut(right.select("b", *XYZ))
    on = {s: [s] for s in "ab"}
    for level in range(DEEPEST + 1):
        for s, points in (("a", left), ("b", right)):
            nodes = _sided(_nodes(points.join(active.select(s).distinct(), s, "left_semi"), s, level, side), s)
            if level:
                nodes = nodes.withColumns({f"{s}_p{n}": F.shiftright(f"{s}_{n}", 1) for n in "ijk"})
            active = active.join(nodes, on[s])
            on[s] = [s, *(f"{s}_p{n}" for n in "ijk")]
        active = cut(active.where(gap <= eps * eps).withColumn("hits", hits))
        direct = active.where(F.col("hits").isNull() & ((F.col("a_n") * F.col("b_n") <= DIRECT) | F.lit(level == DEEPEST)))
        met = direct.select("a", "b", *(f"{s}_{n}" for s in "ab" for n in "ijk"))
        for s, points in (("a", left), ("b", right)):
            placed = points.select(s, *(F.floor(F.col(c) / side * float(1 << level)).cast("long").alias(f"{s}_{n}") for n, c in zip("ijk", XYZ)), F.struct(*XYZ).alias(f"{s}_at"))
            met = met.join(placed, [s, *(f"{s}_{n}" for n in "ijk")])
        met = met.where(d2(lambda c: F.col(f"a_at.{c}") - F.col(f"b_at.{c}")) <= eps * eps).select("a", "b", F.lit(1).cast("long").alias("hits"))
        now = active.where("hits IS NOT NULL").select("a", "b", F.col("hits").cast("long").alias("hits")).unionByName(met)
        found = cut(now.unionByName(found).groupBy("a", "b").agg(F.sum("hits").alias("hits")))
        active = active.where(F.col("hits").isNull() & (F.col("a_n") * F.col("b_n") > DIRECT))
        active = active.join(found.where(F.col("hits") >= least), ["a", "b"], "left_anti")
        # children are met by their parents' places
        active = cut(active.select("a", "b", *(F.col(f"{s}_{n}").alias(f"{s}_p{n}") for s in "ab" for n in "ijk")))
        if active.isEmpty():
            break
    return found


def dbscan(points: DataFrame, eps: float, min_samples: int = 4) -> DataFrame:
    """event_id and cluster (null: noise), clusters named by their smallest core event. A border point goes to the cluster
    of its smallest core neighbour's label. Any two points of a cell lie within eps, so a cell with enough points is core as a
    whole and one node. Only occupied cells meet, and of two cells it only counts whether they touch (``within``); cells that touching ones
    join already are not tested. Points of cells with few points are compared with their few neighbours one by one."""
    side = eps / 3**0.5 * (1 - 1e-9)
    p = _cells(points.select("event_id", *XYZ), side).withColumn("cell", F.concat_ws(":", "cx", "cy", "cz"))
    sizes = p.groupBy("cell", "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"))
    cells = cut(sizes.withColumn("full", F.col("n") >= min_samples))
    p = cut(p.join(cells.select("cell", "full"), "cell"))

    def neighbours(some: DataFrame, others: DataFrame) -> DataFrame:
        """cell and o_cell: occupied ones that points within eps may be in."""
        o = others.select(F.col("cell").alias("o_cell"), F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("cz").alias("nz"), F.col("full").alias("o_full"))
        return some.select("cell", _around(range(-2, 3)).alias("c")).select("cell", "c.*").join(o, ["nx", "ny", "nz"]).select("cell", "o_cell", "o_full")

    # cells that aren't full hold few points, so each point meets few of them
    few = p.where("not full")
    near = cut(neighbours(cells.where("not full"), cells))
    d2 = sum((F.pow(F.col(c) - F.col(f"o_{c}"), 2) for c in XYZ), F.lit(0.0))
    around = few.join(near.where("not o_full"), "cell").join(few.select(F.col("cell").alias("o_cell"), *(F.col(c).alias(f"o_{c}") for c in XYZ)), "o_cell")
    apart = around.where(d2 <= eps * eps).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    single = few.select(F.col("event_id").alias("a"), *XYZ)
    beside = few.join(near.where("o_full"), "cell").select(F.col("event_id").alias("a"), F.col("o_cell").alias("b"))
    dense = within(single, p.where("full").select(F.col("cell").alias("b"), *XYZ), beside, eps, side, min_samples)
    counted = apart.unionByName(dense.select(F.col("a").alias("event_id"), F.col("hits").alias("n"))).groupBy("event_id").agg(F.sum("n").alias("n"))
    core = cut(p.where("full").unionByName(few.join(counted.where(F.col("n") >= min_samples), "event_id", "left_semi")))

    nodes = cut(core.groupBy("cell", "cx", "cy", "cz", "full").agg(F.min("event_id").alias("least")))
    middles = _nodes(core.select("cell", *XYZ), "cell", 0, side).select("cell", *(F.col(f"rep.{c}").alias(c) for c in XYZ))
    pairs = neighbours(nodes, nodes).where("cell < o_cell").select(F.col("cell").alias("a"), F.col("o_cell").alias("b"))
    both = pairs.join(middles.withColumnRenamed("cell", "a"), "a").join(middles.select(F.col("cell").alias("b"), *(F.col(c).alias(f"o_{c}") for c in XYZ)), "b")
    both = cut(both.select("a", "b", (d2 <= eps * eps).alias("touch")))
    ids = nodes.select(F.col("cell").alias("id"))
    first = cut(components(ids, both.where("touch").select("a", "b")))
    of = lambda x: first.select(F.col("id").alias(x), F.col("label").alias(f"of_{x}"))
    open_ = both.where("not touch").join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select("a", "b")
    mine = lambda x: core.select(F.col("cell").alias(x), *XYZ)
    more = within(mine("a"), mine("b"), open_, eps, side).select("a", "b")
    merged = first.select(F.col("label").alias("id"), "label").distinct() if more.isEmpty() else components(first.select(F.col("label").alias("id")).distinct(), more.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    found = first.join(merged.select(F.col("id").alias("label"), F.col("label").alias("last")), "label").join(nodes.select(F.col("cell").alias("id"), "least"), "id")
    labels = found.groupBy("last").agg(F.min("least").alias("cluster"))
    of_cell = cut(found.join(labels, "last").select(F.col("id").alias("cell"), "cluster"))
    inside = core.join(of_cell, "cell").select("event_id", "cluster")
    edge = cut(few.join(core.select("event_id"), "event_id", "left_anti"))
    at_edge = edge.join(neighbours(edge.select("cell", "cx", "cy", "cz").distinct(), nodes), "cell")
    reached = within(edge.select(F.col("event_id").alias("a"), *XYZ), mine("b"), at_edge.select(F.col("event_id").alias("a"), F.col("o_cell").alias("b")), eps, side)
    border = reached.join(of_cell.withColumnRenamed("cell", "b"), "b").groupBy(F.col("a").alias("event_id")).agg(F.min("cluster").alias("cluster"))
    return points.select("event_id").join(inside.unionByName(border), "event_id", "left").select("event_id", "cluster")


def dbscan_members(points: DataFrame, eps: float, min_samples: int = 4) -> DataFrame:
    """Members of the density clusters with at least min_samples events, in the columns of ``multiscale_tiles``."""
    extra = [c for c in ("time_utc", "lon", "lat") if c in points.columns]
    p = cut(points.select("event_id", "x_m", "y_m", "z_m", *extra))
    found = cut(dbscan(p, eps, min_samples).where("cluster is not null"))
    full = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).drop("n")
    kept = found.join(full, "cluster").join(p, "event_id")
    return kept.select(F.concat(F.lit("global_dbscan_"), "cluster").alias("cluster_id"), F.lit("global_dbscan").alias("method"), "event_id", "x_m", "y_m", "z_m", *extra)


def dbscan_sizes(points: DataFrame, eps: float, min_samples: int = 4) -> DataFrame:
    """cluster_id, method and n of the clusters of ``dbscan_members``, without their members."""
    sizes = dbscan(points, eps, min_samples).where("cluster is not null").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("n") >= min_samples).select(F.concat(F.lit("global_dbscan_"), "cluster").alias("cluster_id"), F.lit("global_dbscan").alias("method"), "n")


RANK = ("fault_score", "planarity", "n_events")
#: rows of the first block of candidates, and of what one task settles by itself
BLOCK_ROWS = 4000
PLACE = ("center_x_m", "center_y_m", "center_depth_km", "strike")


def dedupe_candidates(df: DataFrame, km: float = 6.0, depth_km: float = 5.0, strike: float = 20.0, most: int | None = 1000) -> DataFrame:
    """Candidates in order of score (then planarity, events, the key p), less those near a kept better one in place, depth and strike. With ``most``
    the first kept ones are numbered in rank order (segment_id). Null scores come last; a candidate without a place is near none.

    A candidate's fate depends on better ones alone, so blocks by score are settled from the top until enough are kept; their bounds come
    from one quantile summary and may be off, which only makes a block larger."""
    named = df.select("p", *PLACE, F.struct(*(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(c) for c in RANK), (-F.col("p")).alias("p")).alias("o"))
    base, kept = cut(_placed(named, km, depth_km, strike)), None
    for low, high in _score_blocks(base, most):
        block = base.where((F.col("o.fault_score") >= low if low is not None else F.lit(True)) & (F.col("o.fault_score") < high if high is not None else F.lit(True)))
        if kept is not None:
            block = block.join(_near(block, kept, km, depth_km, strike).select("p").distinct(), "p", "left_anti")
        more = _settled(cut(block), km, depth_km, strike)
        kept = more if kept is None else cut(kept.unionByName(more))
        if most is not None and kept.count() >= most:
            break
    if most is None:
        return df.join(kept.select("p"), "p", "left_semi")
    first = kept.orderBy(F.desc("o")).limit(most).select("p", "o")  # at most ``most`` rows
    number = F.format_string("inferred_fault_%04d", F.row_number().over(Window.orderBy(F.desc("o"))) - 1)
    return df.join(F.broadcast(first.select("p", number.alias("segment_id"))), "p").orderBy("segment_id")


def _score_blocks(base: DataFrame, most: int | None, growth: int = 16) -> list[tuple[float | None, float | None]]:
    """Ranges of scores from the top, of about ``BLOCK_ROWS`` rows and then ``growth`` times as many each."""
    n, size, shares = base.count(), BLOCK_ROWS, []
    while most is not None and size < n:
        shares.append(1 - size / n)
        size *= growth
    bounds = base.agg(F.percentile_approx("o.fault_score", shares, 10000)).first()[0] if shares else []
    bounds = sorted(set(bounds), reverse=True)
    return list(zip([*bounds, None], [None, *bounds]))


def _placed(df: DataFrame, km: float, depth_km: float, strike: float) -> DataFrame:
    """Cells as wide as the reach (cx, cy, cz), and small ones (small) of which any two members are near each other."""
    w = km * 1000.0
    cell = lambda c, width: F.floor(c / width)
    x, y, z, s = (F.col(c) for c in PLACE)
    tight = 1 - 1e-6
    small = F.struct(cell(x, w * tight / 2**0.5).alias("x"), cell(y, w * tight / 2**0.5).alias("y"), cell(z, depth_km * tight).alias("z"), cell(F.pmod(s, F.lit(180.0)), strike * tight).alias("s"))
    return df.withColumns({"cx": cell(x, w), "cy": cell(y, w), "cz": cell(z, depth_km), "small": small})


def _near(df: DataFrame, others: DataFrame, km: float, depth_km: float, strike: float) -> DataFrame:
    """p and o of rows, q and oq of other candidates near them. The others, few to a cell, go to the cells around theirs."""
    around = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), (F.col("cz") + k).alias("cz")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    there = others.select(F.col("p").alias("q"), F.col("o").alias("oq"), *(F.col(c).alias(f"q_{c}") for c in PLACE), around.alias("c")).select("*", "c.*").drop("c")
    flat = F.hypot(F.col("center_x_m") - F.col("q_center_x_m"), F.col("center_y_m") - F.col("q_center_y_m")) <= km * 1000.0
    close = flat & (F.abs(F.col("center_depth_km") - F.col("q_center_depth_km")) <= depth_km) & (expr.strike_difference_deg("strike", "q_strike") <= strike)
    return df.join(there, ["cx", "cy", "cz"]).where(close & (F.col("p") != F.col("q"))).select("p", "o", "q", "oq")


def _settled(open_: DataFrame, km: float, depth_km: float, strike: float, rounds: int = 1000) -> DataFrame:
    """The kept candidates of ``open_``, as the greedy order keeps them.

    Only the best open candidate of a small cell can be kept next, as all others of the cell are near it. In a round these leaders meet the open candidates around
    them; a leader without a better one near it is kept and those near it go. A candidate meets a bounded number of leaders however
    many lie in one place, so no round makes all pairs of a dense place. When at most ``BLOCK_ROWS`` are open, one task settles them."""
    placeless = F.greatest(*(F.col(c).isNull() | F.isnan(c) for c in PLACE))
    kept, open_ = open_.where(placeless), open_.where(~placeless)
    columns = open_.columns

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        return _greedy(rows, km, depth_km, strike)

    for _ in range(rounds):
        if open_.limit(BLOCK_ROWS + 1).count() <= BLOCK_ROWS:
            last = open_.select(*PLACE, "p", *(F.col(f"o.{c}").alias(f"o_{c}") for c in RANK))
            ids = last.groupBy(F.lit("one")).applyInPandas(greedy, last.select("p").schema)  # at most BLOCK_ROWS rows
            return cut(kept.unionByName(open_.join(ids, "p", "left_semi")))
        leaders = cut(open_.groupBy("small").agg(F.max_by(F.struct(*columns), "o").alias("l")).select("l.*"))
        beaten = _near(open_, leaders, km, depth_km, strike).where("o > oq").select(F.col("q").alias("p")).distinct()
        now = cut(leaders.join(beaten, "p", "left_anti"))
        gone = _near(open_, now, km, depth_km, strike).select("p").union(now.select("p")).distinct()
        kept, open_ = kept.unionByName(now), cut(open_.join(gone, "p", "left_anti"))
    raise RuntimeError("deduplication did not settle")


def _greedy(rows: pd.DataFrame, km: float, depth_km: float, strike: float) -> pd.DataFrame:
    """p of the rows that are near no better kept one."""
    rows = rows.sort_values([*(f"o_{c}" for c in RANK), "p"], ascending=[False] * len(RANK) + [True])
    x, y, z, s = (rows[c].to_numpy(float) for c in PLACE)
    at, n = np.zeros(len(rows), dtype=np.int64), 0
    for i in range(len(rows)):
        k = at[:n]
        turn = np.abs((s[i] - s[k] + 180) % 360 - 180)
        near = (np.hypot(x[i] - x[k], y[i] - y[k]) <= km * 1000) & (np.abs(z[i] - z[k]) <= depth_km) & (np.minimum(turn, np.abs(turn - 180)) <= strike)
        if not near.any():
            at[n] = i
            n += 1
    return rows.iloc[at[:n]][["p"]]
