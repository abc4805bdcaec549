"""Rows at the edges of the rules, and helpers against plain loops."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.functions import expr, geo, linear
from quakeframe.functions.trees import SegmentTree
from quakeframe.operators import catalog, clusters, faults, imaging, stations
from quakeframe.sources import readers, sinks
from quakeframe.streaming import jobs

BOX = (129.6, 31.8, 131.5, 33.6)


def value(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def test_expressions(spark):
    got = value(
        spark, nan=expr.clamp01(F.lit(float("nan"))), inf=expr.clamp01(F.lit(float("inf"))), low=expr.clamp01(F.lit(-1.0)), angle=expr.angle_difference_deg(F.lit(350.0), F.lit(10.0)), strike=expr.strike_difference_deg(F.lit(5.0), F.lit(184.0)),
        wrap=expr.wrap_phase(F.lit(math.pi + 0.1)), old=expr.bin_date(F.lit("1969-12-31"), 30).cast("string"), neg=expr.floor_bin(F.lit(-1.0), 10), year=expr.year_fraction(F.lit("2024-12-31")), bad=expr.num(F.lit("x")),
        yes=expr.parse_bool_text(F.lit(" YES ")), no=expr.parse_bool_text(F.lit(None).cast("string")),
    )
    assert (got["nan"], got["inf"], got["low"], got["angle"], got["strike"]) == (0, 0, 0, 20, 1)
    assert got["wrap"] == pytest.approx(-math.pi + 0.1)
    assert (got["old"], got["neg"], got["bad"], got["yes"], got["no"]) == ("1969-12-02", -1, None, True, False)
    assert got["year"] == pytest.approx(2024 + 365 / 366)


def test_transverse_mercator(spark):
    """The origin of a zone is 0, 0; a degree of latitude on the central meridian is its meridian arc times 0.9999."""
    x0, y0 = geo.transverse_mercator(F.lit(131.0), F.lit(33.0), 33.0, 131.0)
    x1, y1 = geo.transverse_mercator(F.lit(131.0), F.lit(34.0), 33.0, 131.0)
    x2, y2 = geo.transverse_mercator(F.lit(131.5), F.lit(33.0), 33.0, 131.0)
    got = value(spark, x0=x0, y0=y0, x1=x1, y1=y1, x2=x2, y2=y2)
    assert abs(got["x0"]) < 1e-6 and abs(got["y0"]) < 1e-6
    e2 = geo.GRS80_F * (2 - geo.GRS80_F)
    phi = np.linspace(math.radians(33), math.radians(34), 20001)
    arc = np.trapezoid(geo.GRS80_A * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    assert got["y1"] == pytest.approx(0.9999 * arc, abs=1e-3)
    assert got["x2"] == pytest.approx(46727, rel=1e-3) and 0 < got["y2"] < 200


def events(spark, rows):
    schema = "event_id string, time string, lon double, lat double, depth_km double, magnitude double, magnitude_type string"
    return spark.createDataFrame(rows, schema).withColumn("time_utc", expr.iso_time("time"))


def test_catalog_qc_edges(spark):
    nan = float("nan")
    rows = [
        ("edge", "1995-01-01T00:00:00Z", 129.6, 31.8, 0.0, 2.0, ""), ("max", "1994-12-31T23:59:59Z", 131.5, 33.6, 40.0, 5.0, "Mj"), ("deep", "2000-01-01T00:00:00Z", 130.0, 32.0, 40.1, 5.0, "Mj"),
        ("nan", "2000-01-01T00:00:01Z", 130.0, 32.0, nan, 5.0, "Mj"), ("inf", "2000-01-01T00:00:02Z", 130.0, 32.0, 1.0, float("inf"), "Mj"), ("null", None, 130.0, 32.0, 1.0, 5.0, "Mj"),
        ("first", "2011-01-01T00:00:00.1Z", 130.0, 32.0, 1.0, 5.0, "Mj"), ("second", "2011-01-01T00:00:00.9Z", 130.0, 32.0, 1.0, 5.0, "Mj"), ("out", "2011-01-01T00:00:00Z", 129.59, 32.0, 1.0, 5.0, "Mj"),
    ]
    rules = catalog.CatalogRules(BOX)
    qc = catalog.catalog_qc(events(spark, rows), rules)
    got = {r["event_id"]: r["quality_score"] for r in qc.collect()}
    assert set(got) == {"edge", "max", "first"}
    assert got["edge"] == pytest.approx(0.7) and got["max"] == 1
    epoch = {r["event_id"]: r["epoch_id"] for r in catalog.epoch_profile(qc, catalog.epochs(spark)).collect()}
    assert epoch == {"edge": "modern_dense_1995_2010", "max": "early_instrumental_1923_1994", "first": "recent_high_density_2011_present"}
    empty = catalog.catalog_qc(events(spark, []), rules)
    assert empty.count() == 0 and catalog.event_bin_summary(catalog.event_bins(catalog.epoch_profile(empty, catalog.epochs(spark)))).count() == 0


def test_partitions_do_not_matter(spark):
    rng = random.Random(5)
    rows = [(f"e{i}", f"20{rng.randrange(10, 20)}-0{rng.randrange(1, 9)}-01T00:00:00Z", rng.uniform(129.7, 131), rng.uniform(32, 33), rng.uniform(0, 30), rng.uniform(2, 6), "M") for i in range(200)]
    rules = catalog.CatalogRules(BOX)
    out = []
    for n in (1, 8):
        rng.shuffle(rows)
        out.append(sorted(map(str, catalog.event_bins(catalog.catalog_qc(events(spark, rows).repartition(n), rules)).collect())))
    assert out[0] == out[1]


def points(spark, xyz):
    return spark.createDataFrame([(f"p{i:04d}", *map(float, p)) for i, p in enumerate(xyz)], "event_id string, x_m double, y_m double, z_m double")


def test_dbscan(spark):
    rng = np.random.default_rng(2)
    xyz = np.concatenate([rng.normal(0, 3, (40, 3)), rng.normal(30, 3, (30, 3)), rng.uniform(-60, 60, (30, 3))])
    eps, least = 4.0, 4
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2) <= eps
    core = d.sum(axis=1) >= least
    label = {i: i for i in np.flatnonzero(core)}
    for _ in range(len(xyz)):
        for i in label:
            label[i] = min(label[j] for j in label if d[i, j])
    want = [f"p{label[i]:04d}" if core[i] else min((f"p{label[j]:04d}" for j in label if d[i, j]), default=None) for i in range(len(xyz))]
    got = {r["event_id"]: r["cluster"] for r in clusters.dbscan(points(spark, xyz), eps, least).collect()}
    assert [got[f"p{i:04d}"] for i in range(len(xyz))] == want


def plain_dbscan(xyz, eps, least):
    """The smallest core neighbour's label of each point (None: noise), by all distances."""
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2) <= eps
    core = d.sum(axis=1) >= least
    label = np.where(core, np.arange(len(xyz)), len(xyz))
    while True:
        low = np.where(core, np.where(d & core[None], label[None], len(xyz)).min(axis=1), len(xyz))
        if (low == label).all():
            break
        label = low
    out = np.where(core, label, np.where(d & core[None], label[None], len(xyz)).min(axis=1))
    return [f"p{i:04d}" if i < len(xyz) else None for i in out]


@pytest.mark.parametrize("case", ["walls", "shells", "copies"])
def test_dbscan_of_dense_clouds(spark, monkeypatch, case):
    """Cells with many points each, that meet only through boxes split several times."""
    monkeypatch.setattr(clusters, "DIRECT", 4)
    rng = np.random.default_rng(6)
    if case == "walls":  # dense sheets, apart by a little less and a little more than eps
        a = np.c_[rng.uniform(0, 3, (150, 2)), np.zeros(150)]
        xyz = np.concatenate([a, a + [0, 0, 0.999], a + [0.3, 0.2, 2.05]])
    elif case == "shells":
        v = rng.normal(size=(360, 3))
        v /= np.linalg.norm(v, axis=1)[:, None]
        xyz = np.concatenate([0.8 * v[:120], 1.85 * v[120:], rng.uniform(-4, 4, (60, 3))])
    else:  # many events in one place, and single ones at distances of just eps
        xyz = np.concatenate([np.zeros((200, 3)), np.tile([1.0, 0, 0], (100, 1)), [[2.0, 0, 0], [3.0, 0, 0], [0, 1.0000001, 0], [0, -1, 0]], rng.uniform(-3, 3, (60, 3))])
    got = {r["event_id"]: r["cluster"] for r in clusters.dbscan(points(spark, xyz), 1.0, 5).collect()}
    assert [got[f"p{i:04d}"] for i in range(len(xyz))] == plain_dbscan(xyz, 1.0, 5)


def test_dbscan_without_events(spark):
    assert clusters.dbscan(points(spark, [(0, 0, 0)]).limit(0), 1.0).count() == 0
    assert [r["cluster"] for r in clusters.dbscan(points(spark, [(0, 0, 0), (9, 9, 9)]), 1.0).collect()] == [None, None]


def test_grid_components(spark):
    got = {r["event_id"]: r["cluster"] for r in clusters.grid_components(points(spark, [(0, 0, 0), (9, 0, 0), (11, 0, 0), (21, 0, 0), (-500, 0, 0)]), 10.0, 4).collect()}
    assert got["p0004"] is None and len({got[f"p000{i}"] for i in range(4)}) == 1 and got["p0000"]


def test_dedupe_is_greedy(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.uniform(0, 60000), rng.uniform(0, 60000), rng.uniform(0, 20), rng.uniform(0, 360), round(rng.random(), 2), 0.5, 5) for i in range(200)]
    df = spark.createDataFrame(rows, "p long, center_x_m double, center_y_m double, center_depth_km double, strike double, fault_score double, planarity double, n_events int")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[0])):
        def near(k):
            d = abs((r[4] - k[4] + 180) % 360 - 180)
            return math.hypot(r[1] - k[1], r[2] - k[2]) <= 6000 and abs(r[3] - k[3]) <= 5 and min(d, abs(d - 180)) <= 20
        if not any(map(near, kept)):
            kept.append(r)
    assert [r["p"] for r in clusters.dedupe_candidates(df, most=1000).collect()] == [r[0] for r in kept]
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 7)
    some = clusters.dedupe_candidates(df, most=20).collect()
    assert [(r["p"], r["segment_id"]) for r in some] == [(r[0], f"inferred_fault_{i:04d}") for i, r in enumerate(kept[:20])]
    assert {r["p"] for r in clusters.dedupe_candidates(df, most=None).collect()} == {r[0] for r in kept}
    assert clusters.dedupe_candidates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, 0.0, 1.0, 10.0, 0.5, 0.5, 5), (2, 0.0, 0.0, 1.0, 10.0, None, 0.5, 5), (3, 0.0, 1.0, 1.0, 190.0, 0.1, None, None), (4, None, 0.0, 1.0, 10.0, 0.5, 0.5, 5)], df.schema)
    for block in (1, 100):
        monkeypatch.setattr(clusters, "BLOCK_ROWS", block)
        assert [r["p"] for r in clusters.dedupe_candidates(odd).collect()] == [1, 4, 3]


def test_dedupe_of_a_dense_place(spark, monkeypatch):
    """A third of all candidates lie in one place; rounds of leaders give the greedy rule's rows."""
    rng = np.random.default_rng(11)
    n = 1500
    xyz = rng.uniform(0, 1, (n, 3)) * [90000, 90000, 20]
    xyz[: n // 3] = rng.uniform(0, 1, (n // 3, 3)) * [3000, 3000, 3] + [40000, 40000, 5]
    score = np.round(rng.uniform(0, 1, n), 2)
    rows = [(i, *map(float, xyz[i]), float(rng.uniform(0, 360)), float(score[i]), 0.5, 5) for i in range(n)]
    df = spark.createDataFrame(rows, "p long, center_x_m double, center_y_m double, center_depth_km double, strike double, fault_score double, planarity double, n_events int")
    want = clusters.dedupe_candidates(df, most=2000).select("p", "segment_id").collect()
    order = sorted(rows, key=lambda r: (-r[5], r[0]))
    kept = []
    for r in order:
        d = [abs((r[4] - k[4] + 180) % 360 - 180) for k in kept]
        if not any(math.hypot(r[1] - k[1], r[2] - k[2]) <= 6000 and abs(r[3] - k[3]) <= 5 and min(t, abs(t - 180)) <= 20 for k, t in zip(kept, d)):
            kept.append(r)
    assert [r["p"] for r in want] == [r[0] for r in kept]
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 150)
    assert [tuple(r) for r in clusters.dedupe_candidates(df, most=2000).select("p", "segment_id").collect()] == [tuple(r) for r in want]
    assert [r["p"] for r in clusters.dedupe_candidates(df, most=30).collect()] == [r[0] for r in kept[:30]]


def test_station_sums(spark, monkeypatch):
    """Sums over a tree of stations, in one part or several, are the plain means."""
    rng = np.random.default_rng(4)
    m = 5000
    xy = rng.uniform(-4e5, 4e5, (m, 2))
    xy[: m // 3] = rng.uniform(0, 30, (m // 3, 2))
    w = rng.uniform(0, 1, m)
    s = spark.createDataFrame([(*map(float, p), float(v)) for p, v in zip(xy, w)] + [(None, 0.0, 1.0), (0.0, 0.0, None), (0.0, 0.0, float("nan"))], "x_m double, y_m double, strain_gradient_score double")
    places = [*map(tuple, rng.uniform(-5e5, 5e5, (300, 2)).tolist()), tuple(xy[0].tolist()), tuple(xy[-1].tolist()), (None, 0.0)]
    c = spark.createDataFrame([(f"c{i}", *p) for i, p in enumerate(places)], "cluster_id string, center_x_m double, center_y_m double")

    def plain(x, y):
        return 0.5 if x is None else min(1.0, 10 * np.mean(w / np.maximum(1, np.hypot(xy[:, 0] - x, xy[:, 1] - y) / 1000)))

    for rows in (200_000, 1500):
        monkeypatch.setattr(faults, "BROADCAST_ROWS", rows)
        got = {r["cluster_id"]: r["gnss_score"] for r in faults.gnss_proximity_score(c, s).collect()}
        assert len(got) == len(places)
        assert [got[f"c{i}"] for i in range(len(places))] == pytest.approx([plain(*p) for p in places], rel=1e-9)
    assert {r["gnss_score"] for r in faults.gnss_proximity_score(c, s.limit(0)).collect()} == {0.5}
    assert faults.gnss_proximity_score(c.limit(0), s).count() == 0


def test_leave_one_out(spark):
    rng = random.Random(1)
    rows = [(f"e{rng.randrange(6)}", f"s{rng.randrange(3)}", 1.0, rng.random(), rng.uniform(-3, 3), rng.random()) for _ in range(80)] + [("alone", "s9", 1.0, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "event_id string, station_id string, frequency_hz double, log_amplitude double, phase_rad double, group_delay_s double")
    got = sorted((r["event_id"], round(r["log_amplitude"], 9), round(r["predicted"], 9)) for r in stations.leave_one_event_out(df).collect())
    want = sorted((r[0], round(r[3], 9), round(float(np.median([q[3] for q in rows if q[1] == r[1] and q[0] != r[0]])), 9)) for r in rows if r[0] != "alone")
    assert got == want
    alone = stations.transfer_validation_loo(df).where("heldout_event_id = 'alone'").first()
    assert (alone["n_observations"], alone["amplitude_prediction_corr"]) == (0, 0) and alone["phase_error_rad"] == pytest.approx(math.pi)


def test_exact_median(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice([1.0, 2.0, rng.random()])) for k in "ab" for _ in range(101 if k == "a" else 100)]
    got = {r["k"]: r["m"] for r in stations.exact_median(spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v", "m").collect()}
    assert got == pytest.approx({k: float(np.median([v for q, v in rows if q == k])) for k in "ab"})


def test_plane_fit(spark):
    rng = np.random.default_rng(4)
    flat = np.stack([rng.normal(0, 9000, 400), rng.normal(0, 3000, 400), np.full(400, 5000.0)], axis=1)
    df = points(spark, flat).withColumn("cluster_id", F.lit("c"))
    r = faults.plane_fit(faults.cluster_covariance(df)).first()
    assert r["nz"] == pytest.approx(1) and r["planarity"] == pytest.approx(1)
    assert r["length_km"] == pytest.approx(4 * np.std(flat[:, 0]) / 1000, rel=0.02)


def test_symmetric_eigen_like_lapack(spark):
    rng = np.random.default_rng(1)
    lams = [None, [0, 1, 1], [0, 0, 1], [1, 1, 1], [0, 0, 0], [1, 1 + 1e-7, 1e6], [1e-9, 1, 1 + 1e-9], [0, 1e-8, 1e8], "signed", [1e-30, 2e-30, 3e-30]]
    ms = [np.diag([3.0, 1, 2]), np.array([[1.0, 1, 0], [1, 1, 0], [0, 0, 0]]), np.diag([1e300, 1, 1]), np.array([[0, 1.0, 0], [1, 0, 0], [0, 0, 0]])]
    for k in range(400):
        lam = lams[k % 10] if isinstance(lams[k % 10], list) else rng.uniform(0 if lams[k % 10] is None else -1, 1, 3)
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        m = q @ np.diag(lam) @ q.T
        ms.append((m + m.T) / 2)
    rows = [(i, *map(float, m[np.triu_indices(3)])) for i, m in enumerate(ms)] + [(len(ms), None, float("nan"), None, 0.0, None, None)]
    df = spark.createDataFrame(rows, "I int, cxx double, cxy double, cxz double, cyy double, cyz double, czz double").withColumn("e3_q", F.lit("clash"))
    for r in linear.symmetric_eigen(df).collect():
        m = ms[r["I"]] if r["I"] < len(ms) else np.zeros((3, 3))
        val, vec = np.array([r[f"val{k}"] for k in range(3)]), np.array([[r[f"vec{k}{a}"] for a in "xyz"] for k in range(3)]).T
        scale = max(np.abs(m).max(), 1e-300)
        want, axes = np.linalg.eigh(m)
        assert np.allclose(val / scale, want / scale, atol=1e-12) and np.allclose(vec.T @ vec, np.eye(3), atol=1e-12)
        assert np.allclose(m / scale @ vec, vec * (val / scale), atol=1e-12) and r["e3_q"] == "clash"
        if (want[1] - want[0]) / scale > 1e-6:
            assert abs(axes[:, 0] @ vec[:, 0]) == pytest.approx(1, abs=1e-6)


def test_planes_of_lines_and_points(spark):
    line = np.outer(np.arange(6), [3.0, 4.0, 5.0]) * 1000
    upright, dot, ball = np.outer(np.arange(5), [0, 0, 700.0]), np.zeros((4, 3)), np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]]) * 5e3
    want = {"line": np.array([-15.0, -20, 25]) / np.linalg.norm([-15.0, -20, 25]), "upright": [1, 0, 0], "dot": [0, 0, 1], "ball": [0, 0, 1], "one": [0, 0, 1]}
    df = None
    for name, xyz in (("line", line), ("upright", upright), ("dot", dot), ("ball", ball), ("one", dot[:1])):
        more = points(spark, xyz).withColumn("cluster_id", F.lit(name))
        df = more if df is None else df.unionByName(more)
    planes = faults.plane_fit(faults.cluster_covariance(df))
    for r in planes.collect():
        assert [r["nx"], r["ny"], r["nz"]] == pytest.approx(list(want[r["cluster_id"]]), abs=1e-9), r
        assert r["length_km"] >= 1 and r["width_km"] >= 1 and 0 <= r["planarity"] <= 1
    plan = planes._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert faults.plane_fit(faults.cluster_covariance(df.limit(0))).count() == 0


@pytest.mark.parametrize("n", [1, 7, 8, 9, 300, 5000])
def test_segment_tree_like_all_distances(n):
    rng = np.random.default_rng(n)
    a = rng.uniform(-1e5, 1e5, (n, 2)) if n != 300 else rng.integers(-3, 4, (n, 2)).astype(float)  # many ties
    b = a + (rng.normal(0, 2000, (n, 2)) if n != 300 else rng.integers(-1, 2, (n, 2)))
    p = rng.uniform(-1.5e5, 1.5e5, (400, 2)) if n != 300 else rng.integers(-5, 6, (400, 2)).astype(float)
    rank = rng.permutation(n)
    at, d = SegmentTree(a[:, 0], a[:, 1], b[:, 0], b[:, 1]).nearest(p[:, 0], p[:, 1], rank)
    v = b - a
    size = (v**2).sum(axis=1)
    t = np.where(size > 0, np.clip(((p[:, None] - a) * v).sum(axis=2) / np.where(size > 0, size, 1), 0, 1), 0)
    every = np.hypot(*np.moveaxis(p[:, None] - a - t[..., None] * v, 2, 0))
    assert d == pytest.approx(every.min(axis=1), abs=1e-9)
    for i in range(len(p)):
        equal = np.flatnonzero(every[i] <= every[i].min() + (0 if n == 300 else 1e-9))
        assert at[i] in equal and (len(equal) == 1 or rank[at[i]] == rank[equal].min() or n != 300)


def test_spectra_like_a_transform(spark):
    """Bins, phases and delays of odd and even lengths against whole transforms."""
    rng = np.random.default_rng(9)
    rows = [(f"e{i}", "s", rate, (rng.normal(size=n) + 5 + 0.1 * np.arange(n)).tolist()) for i, (n, rate) in enumerate([(16, 20.0), (17, 20.0), (64, 20.0), (101, 50.0), (400, 100.0), (999, 17.5), (64, 3.0)])]
    rows += [("null", "s", 20.0, None), ("hole", "s", 20.0, [1.0, None] * 10), ("nan", "s", 20.0, [1.0, float("nan")] * 10), ("inf", "s", 20.0, [float("inf")] * 20), ("none", "s", 20.0, []), ("short", "s", 20.0, [1.0] * 15), ("rate", "s", 0.0, [1.0] * 20)]
    got = {(r["event_id"], r["frequency_hz"]): r for r in stations.spectra_from_waveforms(spark.createDataFrame(rows, "event_id string, station_id string, sampling_rate double, samples array<double>")).collect()}
    want = set()
    for name, _, rate, x in rows[:7]:
        n = len(x)
        x = np.array(x) - np.mean(x)
        t = np.arange(n) - (n - 1) / 2
        x -= t * (t @ x) / (t @ t)
        m = max(1, int(0.05 * n))
        taper = np.ones(n)
        taper[:m] = 0.5 - 0.5 * np.cos(np.pi * np.arange(m) / m)
        taper[-m:] = taper[:m][::-1]
        spec = np.fft.rfft(x * taper * np.hanning(n))
        freq, phase = np.fft.rfftfreq(n, 1 / rate), np.unwrap(np.angle(spec))
        for f in (0.5, 1.0, 2.0, 4.0, 8.0):
            i = int(np.argmin(np.abs(freq - f)))
            if f <= freq[-1] and 0 < i < len(freq) - 1:
                want.add((name, f))
                r = got[name, f]
                assert r["amplitude"] == pytest.approx(abs(spec[i]), rel=1e-9) and r["phase_rad"] == pytest.approx(np.angle(spec[i]), abs=1e-9)
                assert r["group_delay_s"] == pytest.approx(-(phase[i + 1] - phase[i - 1]) / (2 * np.pi * (freq[i + 1] - freq[i - 1])), abs=1e-9)
    assert set(got) == want and len(want) > 20


def test_waveforms(spark):
    t = np.arange(400) / 20
    df = spark.createDataFrame([("e", "s", 20.0, np.sin(2 * np.pi * 2 * t).tolist(), 3.0), ("short", "s", 20.0, [1.0] * 8, 3.0)], "event_id string, station_id string, sampling_rate double, samples array<double>, magnitude double")
    rows = {r["frequency_hz"]: r["amplitude"] for r in stations.spectra_from_waveforms(df).collect()}
    assert set(rows) == {0.5, 1.0, 2.0, 4.0, 8.0} and max(rows, key=rows.get) == 2.0
    f = stations.waveform_features(df).where("event_id = 'short'").first()
    assert f["pga"] == 1 and f["pgv"] == pytest.approx(8 / 20) and f["amp_residual_log"] == pytest.approx(-3)


def test_projection_finds_the_source(spark):
    rng = np.random.default_rng(0)
    x, y = rng.uniform(-60000, 60000, (2, 30))
    d = np.hypot(x - 20000, y + 20000) / 1000 / imaging.VELOCITY
    rows = [("e", 0.5, f"s{i}", 1.0, float((2 * np.pi * 0.5 * d[i] + np.pi) % (2 * np.pi) - np.pi), float(d[i]), float(x[i]), float(y[i])) for i in range(30)]
    st = spark.createDataFrame(rows, "event_id string, frequency_hz double, station_id string, amplitude double, phase_rad double, group_delay_s double, x_m double, y_m double")
    ev = spark.createDataFrame([("e", 0.0, 0.0, 30.0)], "event_id string, x_m double, y_m double, depth_km double")
    best = imaging.array_projection(st, ev).where("primitive_type = 'direct'").orderBy(F.desc("beam_power")).first()
    assert math.hypot(best["projection_x_m"] - 20000, best["projection_y_m"] + 20000) < 12000 and 0 <= best["beam_energy"] <= 1


def plain_late(array, p):
    """Late metrics of one point, station by station."""
    d = [math.hypot(x - p[0], y - p[1]) / 1000 for x, y in zip(array.x, array.y)]
    mid = float(np.median(d))
    pred = [(v - mid) / array.v for v in d]
    res = [o - q for o, q in zip(array.obs, pred)]
    late = sorted((r, w) for r, w in zip(res, array.w) if r > 0.175)
    total, mass = sum(array.w), sum(w for _, w in late)
    if len(late) < 2 or mass / total < 0.2:
        return None
    run, raw = 0.0, None
    for r, w in late:
        run += w
        if raw is None and run >= 0.5 * mass:
            raw = r
    delay = min(max(raw, 0.175), 30.0)
    fit = sum(w * math.exp(-0.5 * ((r - delay) / 0.7) ** 2) for r, w in zip(res, array.w) if r > 0) / total
    mean = sum(r * w for r, w in late) / mass
    spread = math.sqrt(sum(w * (r - mean) ** 2 for r, w in late) / mass)
    length = 0.0
    for sign in (1, -1):
        turned = [ph - sign * 2 * math.pi * array.f * (q + delay) for ph, q in zip(array.phase, pred)]
        length = max(length, math.hypot(sum(w * math.cos(t) for t, w in zip(turned, array.w)), sum(w * math.sin(t) for t, w in zip(turned, array.w))) / total)
    return delay, spread, mass / total, length, min(1.0, (0.55 * length + 0.45 * fit) * (0.35 + 0.65 * mass / total)), raw >= 30.0


def test_late_phase_against_plain_loops():
    import pandas as pd

    rng = np.random.default_rng(3)
    seen = 0
    for n in (4, 9, 40):
        g = pd.DataFrame({"x_m": rng.uniform(-6e4, 6e4, n), "y_m": rng.uniform(-6e4, 6e4, n), "phase_rad": rng.uniform(-3, 3, n), "amplitude": rng.uniform(0, 5, n), "group_delay_s": rng.choice([0.0, 1.0, 40.0, 3.0], n) + rng.normal(0, 0.2, n), "frequency_hz": 2.0})
        array = imaging._Array(g)
        points = rng.uniform(-6e4, 6e4, (30, 2))
        energy, length, fit, _, pred = array.parts(points)
        got = array.late(pred)
        assert ((0 <= length) & (length <= 1) & (0 <= fit) & (fit <= 1)).all() and energy == pytest.approx(0.65 * length + 0.35 * fit)
        for i, p in enumerate(points):
            want = plain_late(array, p)
            if want is None:
                assert got["energy"][i] == 0
                continue
            seen += 1
            assert [got[k][i] for k in ("delay", "spread", "fraction", "phase", "energy", "clipped")] == pytest.approx(list(want))
    assert seen > 30


def test_projection_feeds_splats_and_views(spark):
    from quakeframe.plans import queries
    from quakeframe.plans.fixtures import view

    v = lambda name: view(spark, "/root/testdata/sf0.001", name)
    found = queries.projected(v).cache()
    rows = found.collect()
    assert {r["source_weight"] for r in rows} <= {1.0, 1.15} and all(0 <= r["array_coherence"] <= 1 and r["depth_p05_km"] <= r["depth_p50_km"] <= r["depth_p95_km"] for r in rows)
    for r in rows:
        if r["primitive_type"] == "direct":
            assert r["array_coherence"] == pytest.approx(r["phase_coherence"] * r["delay_fit"]) and r["late_phase_delay_s"] == 0 and r["projection_z_m"] == r["event_z_m"]
            assert r["beam_power"] >= r["beam_energy"] * math.log1p(r["n_stations"]) - 1e-9
        gone = math.hypot(r["projection_x_m"] - r["event_x_m"], r["projection_y_m"] - r["event_y_m"])
        assert math.hypot(r["slowness_x_s_per_km"], r["slowness_y_s_per_km"]) == pytest.approx(1 / imaging.VELOCITY if gone > 1e-6 else 0)
    best = imaging.select_projection_topk(found.withColumn("p", F.xxhash64("event_id", "frequency_hz", "primitive_type", "projection_x_m", "projection_y_m")), 6)
    assert best.groupBy("event_id").count().where("count > 6").isEmpty()
    splats = imaging.splat_primitives(best)
    assert splats.count() >= best.count() and splats.select("primitive_id").distinct().count() == splats.count()
    pixels = imaging.view_image_pixels(imaging.view_image_base(best, v("fx_spectrum")))
    voxels = imaging.voxel_lod(splats)
    assert pixels.count() > 0 and voxels.count() > 0


def test_nearest_by_cells_is_nearest(spark, monkeypatch):
    """With traces beyond the broadcast bound, cells give the same faults and energies."""
    rng = np.random.default_rng(6)
    p = points(spark, rng.uniform(-3e5, 3e5, (120, 3)))
    traces = spark.createDataFrame([(f"f{i:03d}", [(float(a), float(b)), (float(a + c), float(b + d))], 10.0 + i, 5.0, 8000.0) for i, (a, b, c, d) in enumerate(rng.uniform(-3e4, 3e4, (60, 4)) * [1, 1, 0.5, 0.5])] + [("far", [(9e6, 0.0)], 1.0, 1.0, 0.0)], "segment_id string, trace array<struct<x:double,y:double>>, length_km double, width_km double, fault_depth_m double")
    splats = p.withColumns({"primitive_type": F.lit("reflected"), "splat_role": F.lit("structure"), "structure_amplitude": F.lit(0.5), "z_m": F.lit(9000.0)})

    def found():
        near = {r["event_id"]: (r["nearest_segment_id"], round(r["fault_distance_km"], 9)) for r in faults.nearest_fault(p, traces, "event_id").collect()}
        waves = {r["segment_id"]: r["raw_score"] for r in imaging.fault_wave_interaction(splats, traces).collect()}
        return near, waves

    near, waves = found()
    monkeypatch.setattr(faults, "BROADCAST_ROWS", 5)
    again, cells = found()
    assert near == again and len(near) == 120
    assert cells == pytest.approx(waves, abs=1e-12)


def test_readers(spark, tmp_path):
    p = tmp_path / "events.csv"
    p.write_text("event_id,time_utc,lat,lon,depth_km,magnitude,magnitude_type,catalog_source\na,2020-01-01T00:00:00Z,32,130,x,3,,c\n")
    r = readers.read_event_catalog(spark, str(p)).first()
    assert r["depth_km"] is None and r["x_m"] is not None and r["time_utc"].year == 2020
    p.write_text("event_id,lat\na,1\n")
    with pytest.raises(ValueError, match="time_utc"):
        readers.read_event_catalog(spark, str(p))
    p.write_text(",".join(readers.EVENT) + "\n")
    with pytest.raises(ValueError, match="no rows"):
        readers.read_event_catalog(spark, str(p))
    p.write_text("event_id,station_id,frequency_hz,amplitude,phase_rad,group_delay_s,snr\ne,s,1,0,4,1,\n")
    r = readers.read_spectra(spark, str(p)).first()
    assert r["amplitude"] == 1e-30 and r["snr"] == 0 and r["channel"] == "" and r["phase_rad"] < math.pi
    g = tmp_path / "faults.geojson"
    line = {"type": "Feature", "properties": {"segment_id": "f1", "dip": 45}, "geometry": {"type": "LineString", "coordinates": [[130, 32], [130, 33]]}}
    multi = {"type": "Feature", "properties": {"name": "m"}, "geometry": {"type": "MultiLineString", "coordinates": [[[130, 32], [130, 33]], [[131, 32]]]}}
    g.write_text(json.dumps({"type": "FeatureCollection", "features": [line]}))
    r = readers.read_fault_features(spark, str(g)).first()
    assert (r["segment_id"], r["dip"], len(r["trace"])) == ("f1", 45, 2) and r["strike"] == pytest.approx(0) and r["length_km"] == pytest.approx(111.19, abs=0.1)
    g.write_text(json.dumps({"type": "FeatureCollection", "features": [line, multi]}))
    assert sorted(r["name"] for r in readers.read_plate_lines(spark, str(g)).collect()) == ["boundary_0", "m_0"]
    g.write_text(json.dumps({"type": "Other"}))
    with pytest.raises(Exception, match="FeatureCollection"):
        readers.read_fault_features(spark, str(g)).collect()
    s = tmp_path / "slab.csv"
    s.write_text("Longitude,Latitude,Depth,contour\n130,32,10,a\n130,33,10,a\n131,33,20,b\n")
    rows = readers.read_slab_lines(spark, str(s)).collect()
    assert [(r["name"], len(r["points"])) for r in rows] == [("a", 2)]


def test_sinks(spark, tmp_path):
    df = spark.range(20).selectExpr("concat('e', id % 5) AS event_id", "concat('s', id) AS station_id")
    assert sinks.write_table(df, str(tmp_path / "t"), {"method": "test"}) == 20
    assert json.loads((tmp_path / "t.metadata.json").read_text()) == {"method": "test", "rows": 20}
    first = sinks.write_partitioned_parts(df, str(tmp_path / "parts"), 4).agg(F.sum("rows")).first()[0]
    again = sinks.write_partitioned_parts(df, str(tmp_path / "parts"), 4).count()
    assert (first, again) == (20, 0) and spark.read.parquet(str(tmp_path / "parts")).count() == 20
    status = {r["name"]: r["status"] for r in sinks.register_outputs(spark, {"tt": str(tmp_path / "t"), "none": str(tmp_path / "no")}).collect()}
    assert status == {"tt": "registered", "none": "missing"} and spark.table("tt").count() == 20
    sinks.write_csv_export(df, str(tmp_path / "c"))
    lines = spark.createDataFrame([("a", [(130.0, 32.0), (131.0, 33.0)])], "name string, points array<struct<lon:double,lat:double>>")
    sinks.write_features(lines, str(tmp_path / "g"))
    assert json.loads(spark.read.text(str(tmp_path / "g")).first()[0])["geometry"]["coordinates"] == [[130.0, 32.0], [131.0, 33.0]]
    like = spark.table("tt").withColumn("at", F.array(F.struct(F.lit(1.5).alias("x"))))
    empty = sinks.empty_outputs(like, str(tmp_path / "no"))
    assert empty.count() == 0 and empty.dtypes == like.dtypes
    assert sinks.empty_outputs(like, str(tmp_path / "t")).count() == 20


def test_streams(spark, tmp_path):
    rows = [("a", "2020-01-01T00:00:00Z", 130.0, 32.0, 1.0, 3.0, "M"), ("a", "2020-01-01T00:00:00Z", 130.0, 32.0, 1.0, 3.0, "M"), ("b", "2020-01-02T00:00:00Z", 130.0, 32.0, 1.0, 1.0, "M")]
    df = events(spark, rows)
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("qc", jobs.stream_catalog_qc(read(), catalog.CatalogRules(BOX))), ("bins", jobs.stream_bin_summary(read()))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append" if name == "qc" else "complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [r["event_id"] for r in spark.table("qc").collect()] == ["a"]
    assert spark.table("bins").agg(F.sum("event_count")).first()[0] == 3
    for i in range(2):
        jobs.stream_append_spectra(read(), str(tmp_path / "out"), ["event_id"], str(tmp_path / f"cp{i}")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_merge_and_coverage(spark):
    a = spark.createDataFrame([("k1", 1, "x")], "k string, row_order int, v string")
    b = spark.createDataFrame([("k1", 1, 5), ("k2", 2, 6)], "k string, row_order int, w int")
    got = {r["k"]: (r["v"], r["w"]) for r in catalog.merge_dedupe([a, b], ["k"]).collect()}
    assert got == {"k1": ("x", None), "k2": (None, 6)}


def test_no_faults_and_one_point_traces(spark):
    p = points(spark, [(0, 0, 0)])
    schema = "segment_id string, trace array<struct<x:double,y:double>>"
    none = faults.nearest_fault(p, spark.createDataFrame([], schema), "event_id").first()
    assert none["nearest_segment_id"] is None and none["fault_distance_km"] == float("inf")
    one = faults.nearest_fault(p, spark.createDataFrame([("f", [(3000.0, 4000.0)])], schema), "event_id").first()
    assert (one["nearest_segment_id"], one["fault_distance_km"]) == ("f", 5.0)


@pytest.mark.parametrize("name, table", [("fx_projection", "part"), ("fx_spectrum", "lineitem")])
def test_fixture_views_grow_with_their_tables(spark, name, table):
    from quakeframe.plans.fixtures import view

    events = []
    for sf in ("0.01", "0.1"):
        each = view(spark, f"/root/testdata/sf{sf}", name).groupBy("event_id").count().agg(F.sum("count"), F.count("*"), F.max("count")).first()
        assert each[0] == view(spark, f"/root/testdata/sf{sf}", table).count() and each[2] < 500
        events.append(each[1])
    assert events[1] == 10 * events[0]


def test_infer_faults_has_density_clusters_and_no_near_copies(spark):
    from quakeframe.plans import queries
    from quakeframe.plans.fixtures import view

    def few(name):
        df = view(spark, "/root/testdata/sf0.001", name)
        if name != "fx_event_dup":
            return df
        return df.where("k < 150").withColumns({"lon": 130.5 + (F.col("k") % 10) * 5e-3, "lat": 32.7 + (F.col("k") % 7) * 5e-3, "depth_km": 10.0 + F.col("k") % 3})

    n = queries.qc_events(few).count()
    assert 4 <= n < 200  # too few for tiles
    got = queries.infer_faults(few).collect()
    assert [(r["raw_cluster_id"].startswith("global_dbscan_"), r["n_events"], r["segment_id"]) for r in got] == [(True, n, "inferred_fault_0000")]
    r = got[0]
    score = 0.35 * r["seismicity_planarity_score"] + 0.25 * r["mechanism_consistency_score"] + 0.2 * r["gnss_strain_gradient_score"] + 0.1 * r["waveform_residual_score"] + 0.1 * r["distance_from_known_fault_score"]
    assert r["fault_score"] == pytest.approx(score) and r["inference_method"] == "global_dbscan" and r["is_inferred"] and len(r["trace"]) == len(r["local_trace"]) == 2
    assert r["notes"] == "known_fault_extension_candidate" if r["distance_to_known_fault_km"] <= 5 else r["notes"].startswith("unregistered_candidate; nearest_known=known_")
    a, b = r["local_trace"]
    assert math.hypot(a["x"] - b["x"], a["y"] - b["y"]) / 1000 == pytest.approx(r["length_km"]) and (a["x"] + b["x"]) / 2 == pytest.approx(r["center_x_m"])

    kept = queries.infer_faults(lambda name: view(spark, "/root/testdata/sf0.001", name)).collect()
    assert kept and all(r["length_km"] <= 800 and r["width_km"] <= 300 for r in kept)
    for i, a in enumerate(kept):
        for b in kept[:i]:
            turn = abs((a["strike"] - b["strike"] + 180) % 360 - 180)
            near = math.hypot(a["center_x_m"] - b["center_x_m"], a["center_y_m"] - b["center_y_m"]) <= 6000 and abs(a["center_depth_km"] - b["center_depth_km"]) <= 5
            assert not (near and min(turn, abs(turn - 180)) <= 20)


def test_array_projection_takes_every_event(spark):
    from quakeframe.plans import queries
    from quakeframe.plans.fixtures import view

    def moved(name):
        df = view(spark, "/root/testdata/sf0.001", name)
        return df.where("event_id = 'ev0'").withColumn("event_id", F.lit("ev1000")) if name == "fx_spectrum" else df

    assert {r["event_id"] for r in queries.array_projection(moved).collect()} == {"ev1000"}


def test_splat_primitives_keeps_every_row(spark):
    n = 100_003
    rows = spark.range(n).select(
        F.col("id").alias("p"), F.concat(F.lit("ev"), F.col("id")).alias("event_id"), F.lit("direct").alias("primitive_type"), F.lit(1.0).alias("frequency_hz"), F.lit(0.0).alias("projection_x_m"), F.lit(0.0).alias("projection_y_m"),
        F.lit(5000.0).alias("projection_z_m"), (F.col("id") / n).alias("beam_energy"), F.lit(0.5).alias("array_coherence"), F.lit(1.0).alias("beam_power"), F.lit(0.0).alias("late_phase_delay_s"), F.lit(0.0).alias("residual_spread_s"),
    )
    ids = imaging.splat_primitives(rows).agg(F.count_distinct("p"), F.count_distinct("primitive_id"), F.max("primitive_id")).first()
    assert tuple(ids) == (n, n, f"gs_{n - 1:08d}")
    assert imaging.splat_primitives(rows, 10).agg(F.min("p")).first()[0] == n - 10


def test_view_image_pixels_exchange_base_rows_alone(spark):
    rows = [("e", "s1", 1.0, "direct", 1, 0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 1.0, 1.0, 3.0), ("e", "s1", 1.0, "direct", 2, 5000.0, 0.0, 5000.0, 0.0, 0.5, 4.0, 1.0, 1.0, 1.0), ("e", "s2", 1.0, "direct", 3, 0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 1.0, 1.0, 1.0)]
    base = spark.createDataFrame(
        rows, "event_id string, station_id string, frequency_hz double, primitive_type string, projection_rank int, rel_x_m double, rel_y_m double, range_m double, depth_m double, phase_alignment double, group_delay_s double, beam_energy double, array_coherence double, amplitude double"
    )
    pixels = imaging.view_image_pixels(base)
    want = {}
    for r in rows:
        for plane, u, v in (("xy", r[5], r[6]), ("range_depth", r[7], r[8])):
            for du in range(-2, 3):
                for dv in range(-2, 3):
                    if du * du + dv * dv <= 4:
                        at = want.setdefault((r[1], plane, int(u // 5000) + du, int(v // 5000) + dv), [0.0, 0, 9, 0.0])
                        at[:] = at[0] + r[13] * r[9] * math.exp(-0.5 * (du * du + dv * dv)), at[1] + 1, min(at[2], r[4]), at[3] + r[9]
    got = {(p["station_id"], p["image_plane"], p["pixel_u"], p["pixel_v"]): p for p in pixels.collect()}
    assert got.keys() == want.keys()
    for k, (i, n, r, a) in want.items():
        assert (got[k]["contribution_count"], got[k]["best_projection_rank"]) == (n, r)
        assert got[k]["intensity"] == pytest.approx(i) and got[k]["phase_alignment_mean"] == pytest.approx(a / n)
    plan = imaging.view_image_part_stats(imaging.with_parts(pixels, 16))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(event_id") == 2 and plan.count("Exchange") == 3  # the rows of both branches are one exchange


def test_nearest_stations_of_dense_and_lonely_places(spark):
    rng = np.random.default_rng(3)
    st = [(f"s{i:04d}", float(130 + x), float(32 + y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(0, 0.05, (1500, 2)), rng.uniform(-2, 2, (60, 2))]))]
    st += [(f"t{i}", 130.5, 32.5) for i in range(9)] + [("u", 130.0, 59.5), ("v", 130.8, 59.5)]
    ev = [(f"e{i}", float(130 + x), float(32 + y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(0, 0.05, (150, 2)), rng.uniform(-2.5, 2.5, (80, 2))]))]
    ev += [("same", 130.5, 32.5), ("far", 10.0, 10.0), ("north", 130.1, 59.6), ("none", None, 32.0)]
    events, stations_ = spark.createDataFrame(ev, "event_id string, lon double, lat double"), spark.createDataFrame(st, "station_id string, lon double, lat double")
    got = {}
    for r in stations.nearest_stations(events, stations_, 50.0, 5).collect():
        got.setdefault(r["event_id"], {})[r["rank"]] = r["station_id"]

    def km(a, b):
        (o1, a1), (o2, a2) = np.radians(a), np.radians(b)
        h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin((o2 - o1) / 2) ** 2
        return 12742 * math.atan2(math.sqrt(h), math.sqrt(max(0, 1 - h)))

    for name, lon, lat in ev[:-1]:
        near = sorted((round(d, 9), s) for s, o, a in st if (d := km((lon, lat), (o, a))) <= 50)[:5]
        assert got.get(name, {}) == {i + 1: s for i, (_, s) in enumerate(near)}
    assert "none" not in got
    dense = events.where("event_id in ('e0', 'e1', 'e2', 'e3')")  # each has 1,500 stations within the radius
    assert stations.station_pairs(dense.select("lon", "lat"), stations_, 50.0, 5).count() < 4 * 300


def test_voxels_are_summed_without_events(spark):
    rng = np.random.default_rng(5)
    rows = [(f"e{i % 7}", *map(float, rng.uniform(-20000, 20000, 3)), *map(float, rng.uniform(1000, 9000, 3)), float(rng.uniform(0, 1)), float(rng.uniform(0, 1)), ("direct", "reflected", "scattered", "residual")[i % 4]) for i in range(200)]
    splats = spark.createDataFrame(rows, "event_id string, x_m double, y_m double, z_m double, sigma_x_m double, sigma_y_m double, sigma_z_m double, structure_amplitude double, opacity double, primitive_type string")
    for lods, radius in (([(0, 2500.0), (1, 5000.0)], 1), ([(0, 3000.0), (1, 7000.0)], 2)):
        want = {}
        for lod, size in lods:
            for e, x, y, z, sx, sy, sz, a, o, t in rows:
                for d in np.ndindex(*[2 * radius + 1] * 3):
                    dx, dy, dz = (v - radius for v in d)
                    if dx * dx + dy * dy + dz * dz <= radius * radius:
                        c = math.exp(-0.5 * ((dx * size / sx) ** 2 + (dy * size / sy) ** 2 + (dz * size / sz) ** 2)) * a * o
                        at = want.setdefault((lod, math.floor(x / size) + dx, math.floor(y / size) + dy, math.floor(z / size) + dz), [0.0, 0.0, 0.0, 0, set()])
                        at[:3] = at[0] + c, at[1] + c * a, at[2] + c * (t == "direct")
                        at[3] += 1
                        at[4].add(e)
        voxels = imaging.voxel_lod(splats, lods, radius)
        got = {(r["lod"], r["ix"], r["iy"], r["iz"]): r for r in voxels.collect()}
        assert got.keys() == {k for k, v in want.items() if v[0] > 1e-8}
        for k, r in got.items():
            c, ca, direct, n, events = want[k]
            assert (r["contribution_count"], r["n_events"]) == (n, len(events))
            assert (r["density"], r["weighted_amplitude"], r["direct_density"]) == pytest.approx((c, ca / c, direct))
    plain = imaging.lod_summary(imaging.voxel_lod(splats, count_events=False))
    assert "event_id" not in plain._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_turns_and_medians_of_arrays():
    r = np.concatenate([np.random.default_rng(0).uniform(-500, 500, 5000), [0, 0.25, 0.5, -0.5, 0.75, 1e-9, -1e-9]])
    c, s = imaging._turns(r)
    part = r - np.rint(r)
    assert np.abs(c - np.cos(2 * np.pi * part)).max() < 4e-15 and np.abs(s - np.sin(2 * np.pi * part)).max() < 4e-15
    for n in (4, 5, 60):
        d = np.random.default_rng(n).uniform(0, 9, (50, n))
        assert (imaging._medians(d)[:, 0] == np.median(d, axis=1)).all()


def test_wave_energies_exchange_sums_alone(spark, monkeypatch):
    """Energies like a plain loop, with unknown places and types; splats meet the traces in their tasks and no pair of them is a row."""
    rng = np.random.default_rng(12)
    kinds = ["direct", "reflected", "scattered", "residual", None]
    rows = [(*map(float, rng.uniform(-5e4, 5e4, 2)), float(rng.uniform(0, 3e4)), kinds[i % 5], "structure", float(rng.uniform(0, 1))) for i in range(300)]
    rows += [(None, 0.0, 0.0, "reflected", "structure", 1.0), (0.0, 0.0, 0.0, "reflected", "source_anchor", 1.0), (0.0, 0.0, 8000.0, "scattered", "structure", None)]
    splats = spark.createDataFrame(rows, "x_m double, y_m double, z_m double, primitive_type string, splat_role string, structure_amplitude double")
    traces = spark.createDataFrame([("a", [(0.0, 0.0), (1e4, 0.0), (1e4, 2e4)], 4.0, 100.0, 8000.0), ("b", [(5e3, 5e3)], 9.0, None, 3000.0), ("c", [(0.0, 0.0), (1.0, 1.0)], 1.0, 1.0, None)], "segment_id string, trace array<struct<x:double,y:double>>, length_km double, width_km double, fault_depth_m double")
    plans = []
    monkeypatch.setattr(imaging, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or clusters.cut(df))
    got = {r["segment_id"]: r for r in imaging.fault_wave_interaction(splats, traces).collect()}
    assert "mapinarrow" in plans[0].lower() and "array_min" not in plans[0]

    def distance(x, y, points):
        ends = list(zip(points, points[1:])) or [(points[0], points[0])]
        out = []
        for (ax, ay), (bx, by) in ends:
            size = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size)) if size else 0
            out.append(math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        return min(out)

    for name, points_, width, deep in (("a", [(0, 0), (1e4, 0), (1e4, 2e4)], 100.0, 8000.0), ("b", [(5e3, 5e3)], 1.0, 3000.0)):
        sums, near = dict.fromkeys(kinds, 0.0), 0
        for x, y, z, kind, role, a in rows:
            if role == "structure" and x is not None:
                k = math.exp(-0.5 * (distance(x, y, points_) / 3e4) ** 2) * math.exp(-0.5 * ((z - deep) / max(35000, 500 * width)) ** 2)
                sums[kind] += {"reflected": 1.0, "scattered": 0.82}.get(kind, 0.45) * (a or 0.0) * k
                near += k >= math.exp(-0.5)
        r = got[name]
        assert r["near_splat_count"] == near
        assert (r["reflected_energy"], r["scattered_energy"], r["residual_energy"]) == pytest.approx((sums["reflected"], sums["scattered"], sums["direct"] + sums["residual"]))
        assert r["raw_score"] == pytest.approx(sum(sums.values()) / math.sqrt({"a": 4.0, "b": 9.0}[name]))
    assert (got["c"]["raw_score"], got["c"]["near_splat_count"]) == (0.0, 0)


def test_gnss_places_are_looked_up_once_in_many_tasks(spark, monkeypatch):
    """Clusters and stations at the same places count each, but a place is looked up once, and one file of clusters is many tasks."""
    rng = np.random.default_rng(3)
    at = rng.uniform(-2e5, 2e5, (40, 2)).tolist()
    s = spark.createDataFrame([(*at[i % 40], (i % 7) / 7) for i in range(400)], "x_m double, y_m double, strain_gradient_score double")
    c = spark.createDataFrame([(i, float(i % 60) * 1e3, float(i % 60) * -2e3) for i in range(600)] + [(600, float("nan"), 0.0)], "cluster_id long, center_x_m double, center_y_m double").coalesce(1)
    seen, sums = [], faults._with_sums
    monkeypatch.setattr(faults, "PLACE_ROWS", 10)
    monkeypatch.setattr(faults, "_with_sums", lambda places, held: seen.append((places.count(), places.rdd.getNumPartitions(), len(held))) or sums(places, held))
    got = {r["cluster_id"]: r["gnss_score"] for r in faults.gnss_proximity_score(c, s).collect()}
    assert seen == [(60, 6, 40)]
    for i in (0, 59, 60, 599):
        x, y = (i % 60) * 1e3, (i % 60) * -2e3
        want = np.mean([(j % 7) / 7 / max(1, math.hypot(at[j % 40][0] - x, at[j % 40][1] - y) / 1000) for j in range(400)])
        assert got[i] == pytest.approx(min(1.0, 10 * want), rel=1e-9)
    assert len(got) == 601 and got[600] == 0.0


def test_leave_one_out_in_tasks_and_by_ranks(spark, monkeypatch):
    """Groups in tasks, over chunk ends, and large ones by ranks predict alike; rows without a delay count in the validation, as it asks for none."""
    rng = random.Random(8)
    rows = [(f"e{rng.randrange(9)}", f"s{rng.randrange(7)}", float(rng.randrange(2)), rng.choice([1.0, 2.0, rng.random()]), rng.uniform(-3, 3), rng.random()) for _ in range(300)]
    schema = "event_id string, station_id string, frequency_hz double, log_amplitude double, phase_rad double, group_delay_s double"
    df = spark.createDataFrame(rows, schema)

    def found():
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in stations.leave_one_event_out(df).collect())

    plain = found()
    assert len(plain) == 300
    monkeypatch.setattr(stations, "_median_of_others", lambda *a: pytest.fail("small groups go by ranks"))
    monkeypatch.setattr(stations, "CHUNK_ROWS", 7)
    assert found() == plain
    monkeypatch.undo()
    monkeypatch.setattr(stations, "GROUP_ROWS", 21)  # some groups are larger
    assert found() == plain
    monkeypatch.undo()
    one = [(e, "s", 1.0, a, 0.0, None) for e, a in (("a", 1.0), ("b", 2.0), ("a", 3.0))]
    got = {r["heldout_event_id"]: r["n_observations"] for r in stations.transfer_validation_loo(spark.createDataFrame(one, schema)).collect()}
    assert got == {"a": 2, "b": 1}


def test_an_id_and_a_second_are_resolved_once(spark, monkeypatch):
    t = [datetime.datetime(2020, 1, 1, 0, 0, s) for s in range(60)]
    events = spark.createDataFrame([("a", t[0]), ("b", t[5]), ("c", t[5])], "event_id string, time_utc timestamp")
    cases = [("a", t[9], "a"), ("a", None, "a"), ("x", t[5], "c"), (None, t[5], "c"), (None, t[9], "c"), ("x", None, None), (None, None, None), ("x", t[9] + datetime.timedelta(minutes=1), None)]
    spectra = spark.createDataFrame([(i, e, at) for i, (e, at, _) in enumerate(cases * 50)], "n int, event_id string, time_utc timestamp")
    pairs, plain = [], stations._resolved_pairs
    monkeypatch.setattr(stations, "_resolved_pairs", lambda some, all_: pairs.append(some.count()) or plain(some, all_))
    got = {r["n"]: r["resolved_event_id"] for r in stations.resolve_spectrum_event(spectra, events).collect()}
    assert pairs == [len(cases)]
    assert got == {i: want for i, (_, _, want) in enumerate(cases * 50) if want}


def test_tiles_are_counted_and_met_without_an_exchange_of_members(spark):
    """Sizes of tiles without their members; members, and traces' ends, like plain loops."""
    rng = np.random.default_rng(9)
    start = datetime.datetime(2020, 1, 1)
    rows = [(f"e{i:03d}", *map(float, rng.uniform(0, 6e4, 2)), float(rng.uniform(0, 2e4)), None if i == 7 else start + datetime.timedelta(days=int(rng.integers(20))), float(i), 1.0) for i in range(250)]
    df = spark.createDataFrame(rows, "event_id string, x_m double, y_m double, z_m double, time_utc timestamp, lon double, lat double")
    members = faults.multiscale_tiles(df)
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    found = members.collect()
    want = {}
    for r in found:
        want.setdefault((r["cluster_id"], r["method"]), []).append(r)
    assert {(r["cluster_id"], r["method"]): r["n"] for r in faults.tile_sizes(df).collect()} == {k: len(v) for k, v in want.items()}
    traces = {r["cluster_id"]: (r["inference_method"], [p["lon"] for p in r["trace"]]) for r in faults.candidate_traces(members).collect()}
    when = lambda r: (r["time_utc"] or datetime.datetime.min, r["event_id"])
    assert traces == {c: (m, [min(v, key=when)["lon"], max(v, key=when)["lon"]]) for (c, m), v in want.items()}


def test_append_stores_each_key_once(spark, tmp_path):
    """Also a key with a null, and rows that come again beside new ones, which are stored with their own values."""
    schema = "event_id string, channel string, amplitude double"
    spark.createDataFrame([("a", "E", 1.0), ("a", None, 2.0), ("a", "E", 1.0)], schema).write.parquet(str(tmp_path / "in0"))
    spark.createDataFrame([("a", "E", 1.0), ("a", None, 2.0), ("b", None, 3.0), (None, "E", 4.0), ("b", None, 3.0)], schema).write.parquet(str(tmp_path / "in1"))
    for i in range(2):
        for k in range(2):
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{i}"))
            jobs.stream_append_spectra(stream, str(tmp_path / "out"), ["event_id", "channel"], str(tmp_path / f"cp{i}{k}")).awaitTermination(120)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=lambda r: r[2]) == [("a", "E", 1.0), ("a", None, 2.0), ("b", None, 3.0), (None, "E", 4.0)]


def test_many_projections_are_not_broadcast(spark, monkeypatch):
    """Beyond the bound the join is a merge, whose memory does not follow the projections; pairs are the same, also at the edges of keys."""
    rng = np.random.default_rng(4)
    freq = [0.5, 1.0, 1.0 + 8e-10, 1.0 + 2e-9, 4.0000005, 4.0000005 + 9e-10, 4.0000005 - 9e-10, 1.0000015, 0.0, None]
    name = lambda i: f"ev{i % 3}"
    p = [(name(i), f, float(i), 1.0, 2.0, 0.1, "direct", i, 0.5, 0.5) for i, f in enumerate(freq * 3)]
    s = [(name(int(rng.integers(3))), f"ST{i}", f, 130.0, 32.0, 1.0, 0.2, 0.3) for i, f in enumerate(freq * 6)]
    projections = spark.createDataFrame(p, "event_id string, frequency_hz double, projection_x_m double, projection_y_m double, projection_z_m double, phase_resultant_rad double, primitive_type string, projection_rank int, beam_energy double, array_coherence double")
    spectra = spark.createDataFrame(s, "event_id string, station_id string, frequency_hz double, lon double, lat double, amplitude double, phase_rad double, group_delay_s double")
    want = sorted((a[7], b[1]) for a in p for b in s if a[0] == b[0] and a[1] and b[2] and abs(a[1] - b[2]) < 1e-9)
    for bound in (100, 5):
        monkeypatch.setattr(imaging, "VIEW_ROWS", bound)
        base = imaging.view_image_base(projections, spectra)
        assert sorted((r["projection_rank"], r["station_id"]) for r in base.collect()) == want
    assert "SortMergeJoin" in base._jdf.queryExecution().sparkPlan().toString()


def plain_energy(array, p):
    """Energy of one point, station by station."""
    d = [math.hypot(x - p[0], y - p[1]) / 1000 for x, y in zip(array.x, array.y)]
    mid = float(np.median(d))
    pred = [(v - mid) / array.v for v in d]
    length = 0.0
    for sign in (1, -1):
        turned = [ph - sign * 2 * math.pi * float(array.f) * q for ph, q in zip(array.phase, pred)]
        length = max(length, math.hypot(sum(w * math.cos(t) for t, w in zip(turned, array.w)), sum(w * math.sin(t) for t, w in zip(turned, array.w))) / sum(array.w))
    return 0.65 * min(1.0, length) + 0.35 * sum(math.exp(-0.5 * ((o - q) / array.sigma) ** 2) for o, q in zip(array.obs, pred)) / len(d)


def station_table(groups, rng):
    """Rows of groups given by event, frequency, depth and number of stations, in the order of their keys."""
    import pyarrow as pa

    rows = []
    for event, f, depth, n in groups:
        x, y, phase = rng.uniform(-6e4, 6e4, n), rng.uniform(-6e4, 6e4, n), rng.uniform(-3, 3, n)
        rows += [{"event_id": event, "frequency_hz": f, "station_id": f"s{i}", "amplitude": float(i), "phase_rad": phase[i], "group_delay_s": float(rng.integers(1, 51)) / 10, "x_m": x[i], "y_m": y[i], "source_weight": 1.15, "ex": 1000.0, "ey": -2000.0, "depth_km": depth} for i in range(n)]
    return pa.Table.from_pylist(rows)


def test_groups_projected_together_are_like_plain_loops():
    rng = np.random.default_rng(8)
    groups = [("a", 0.5, 12.0, 5), ("a", 8.0, 12.0, 5), ("a", 8.5, 12.0, 3), ("b", 8.0, 33.0, 5), ("b", 8.5, 33.0, 6), ("c", 2.0, 33.0, 5), ("d", 2.0, 20.0, 4)]
    table = station_table(groups, rng)
    got = [r for b in imaging._project_groups(table, 4, 4) for r in b.to_pylist()]
    assert {(r["event_id"], r["frequency_hz"]) for r in got} == {g[:2] for g in groups if g[3] >= 4}
    for event, f, depth, n in groups:
        if n < 4:
            continue
        array = imaging._Array(table.to_pandas().query("event_id == @event and frequency_hz == @f"))
        offsets, step, steps = imaging.candidate_grid(depth)
        ends = []
        for at in offsets + (1000.0, -2000.0):
            best, s = plain_energy(array, at), step
            for _ in range(steps):
                for move in imaging.STENCIL:
                    trial = at + np.array(move) * s
                    e = plain_energy(array, trial)
                    if e > best + 1e-12:
                        at, best = trial, e
                s /= 2
            ends.append((best, *at))
        mine = [r for r in got if (r["event_id"], r["frequency_hz"]) == (event, f)]
        assert {r["n_stations"] for r in mine} == {n} and {r["event_z_m"] for r in mine} == {depth * 1000} and {r["source_weight"] for r in mine} == {1.15}
        direct = [r for r in mine if r["primitive_type"] == "direct"]
        assert [r["raw_energy"] for r in direct] == pytest.approx([e[0] for e in sorted(ends, reverse=True)[:4]], abs=1e-9)
        for r in direct:
            near = min(ends, key=lambda e: math.hypot(e[1] - r["projection_x_m"], e[2] - r["projection_y_m"]))
            assert near == pytest.approx((r["raw_energy"], r["projection_x_m"], r["projection_y_m"]), abs=1e-6)
            begun = (r["projection_x_m"] - r["projection_refinement_dx_m"], r["projection_y_m"] - r["projection_refinement_dy_m"])
            assert r["projection_refinement_score_gain"] == pytest.approx(r["raw_energy"] - plain_energy(array, begun), abs=1e-9)
        late = sorted((x[4] for x in (plain_late(array, e[1:]) for e in ends) if x and x[4] >= 0.08), reverse=True)[:4]
        assert [r["raw_energy"] for r in mine if r["primitive_type"] != "direct"] == pytest.approx(late, abs=1e-9)


def test_quick_energies_keep_their_bound():
    rng = np.random.default_rng(10)
    for n, f in ((2, 0.5), (5, 0.5), (60, 8.0), (256, 8.0)):
        g = {"x_m": rng.uniform(-2e6, 2e6, (3, n)), "y_m": rng.uniform(-2e6, 2e6, (3, n)), "phase_rad": rng.uniform(-3, 3, (3, n)), "amplitude": rng.uniform(0, 5, (3, n)), "group_delay_s": rng.uniform(0, 40, (3, n)), "frequency_hz": np.full((3, n), f)}
        g["x_m"][0], g["y_m"][0] = 7.0, 9.0  # all in one place
        array, p = imaging._Array(g), rng.uniform(-9e4, 9e4, (3, 50, 2))
        assert np.abs(array.quick(p) - array.parts(p)[0]).max() < array.tolerance
        at, best = array.refined(p, 3500.0, 2)
        assert np.abs(best - array.parts(at)[0]).max() < array.tolerance and (best >= array.quick(p)).all()
        one = imaging._Array({k: v[1] for k, v in g.items()})
        assert (one.refined(p[1], 3500.0, 2)[0] == at[1]).all()


def test_groups_of_station_rows_stay_whole():
    table = station_table([("a", 1.0, 5.0, 7), ("a", 2.0, 5.0, 1), ("b", 2.0, 5.0, 30), ("c", 2.0, 5.0, 2)], np.random.default_rng(1))
    for size in (1, 3, 100):
        parts = list(imaging._whole_groups(iter(table.to_batches(max_chunksize=size)), 5))
        assert [r for p in parts for r in p.to_pylist()] == table.to_pylist() and (len(parts) > 1 or size == 100)
        seen = [set(zip(p["event_id"].to_pylist(), p["frequency_hz"].to_pylist())) for p in parts]
        assert sum(map(len, seen)) == len(set().union(*seen)) == 4


def test_projection_takes_groups_in_arrow_batches_and_runs_once(spark, monkeypatch):
    from quakeframe.plans import queries
    from quakeframe.plans.fixtures import view

    v = lambda name: view(spark, "/root/testdata/sf0.001", name)
    spark.catalog.clearCache()
    runs = lambda df: [w for line in df._jdf.queryExecution().executedPlan().toString().splitlines() for w in ("MapInArrow", "FlatMapGroupsIn") if w in line]
    assert runs(queries.array_projection(v)) == ["MapInArrow"]
    seen, whole = [], clusters.cut
    for module in (imaging, clusters):
        monkeypatch.setattr(module, "cut", lambda df: seen.extend(runs(df)) or whole(df))
    assert queries.projection_splats(v).count() > 0 and seen == ["MapInArrow"]


def test_station_rows_hold_medians_of_known_values(spark):
    rng = np.random.default_rng(4)
    rows = [("e", f, f"s{n}", float(a), 0.5, None if i % 4 == 3 or n == 6 else float(d), 1.0, 2.0) for f in (1.0, 2.0) for n in (1, 2, 3, 4, 5, 6, 12) for i, (a, d) in enumerate(rng.uniform(0, 9, (n, 2)))]
    rows += [("e", 1.0, "none", None, 0.5, 1.0, 1.0, 2.0), ("e", -1.0, "s1", 1.0, 0.5, 1.0, 1.0, 2.0), ("e", 2.0, "nan", float("nan"), 0.5, float("nan"), 1.0, 2.0), ("e", 2.0, "nan", 7.0, 0.5, 3.0, 1.0, 2.0), ("e", 2.0, "nan", 4.0, 0.5, 2.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "event_id string, frequency_hz double, station_id string, amplitude double, phase_rad double, group_delay_s double, x_m double, y_m double")
    found = imaging.station_event_rows(df)
    got = {(r["frequency_hz"], r["station_id"]): (r["amplitude"], r["group_delay_s"]) for r in found.collect()}
    assert len(got) == 16 and got[1.0, "none"] == (1e-30, 1.0) and got[2.0, "nan"] == (7.0, 3.0)
    for (f, s), (a, d) in got.items():
        if s[1:].isdigit():
            mine = [r for r in rows if (r[1], r[2]) == (f, s)]
            known = [r[5] for r in mine if r[5] is not None]
            assert a == pytest.approx(np.median([r[3] for r in mine])) and (d is None if not known else d == pytest.approx(np.median(known)))
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
