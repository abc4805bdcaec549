"""Fixture views over the driver's tables, written once as SQL that Spark and DuckDB both read.

``{table}`` stands for a table or an earlier view. Where the engines differ, a view is built from ``dialect`` pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BBOX = (129.6, 31.8, 131.5, 33.6)


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def after(self, time: str, days: str, seconds: str = "0") -> str:
        if self.spark:
            return f"timestampadd(SECOND, CAST({seconds} AS INT), timestampadd(DAY, CAST({days} AS INT), CAST({time} AS TIMESTAMP)))"
        return f"{time} + to_seconds(CAST(({days}) * 86400 + ({seconds}) AS BIGINT))"

    def points(self, *xy: tuple[str, str]) -> str:
        if self.spark:
            return "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in xy) + ")"
        return "[" + ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in xy) + "]"


def _views(d: Dialect) -> dict[str, str]:
    k = "o_orderkey"
    text = "STRING" if d.spark else "VARCHAR"
    ll = lambda key, a, b: f"129.6 + (({key} * {a}) % 1900) / 1e3 AS lon, 31.8 + (({key} * {b}) % 1800) / 1e3 AS lat"
    far = lambda c: f"CAST({c} AS DOUBLE)"
    # events of neighbouring keys: their number grows with the table, the rows of each stay few
    block = lambda key, n: f"'ev' || CAST(CAST(({key} - {key} % {n}) / {n} AS BIGINT) AS {text})"
    return {
        "fx_event": f"""SELECT {k} AS k, 'ev' || CAST({k} AS {text}) AS event_id, CAST(129.5 AS DOUBLE) + (({k} * 7919) % 2100) / 1e3 AS lon,
            CAST(31.7 AS DOUBLE) + (({k} * 104729) % 2000) / 1e3 AS lat, (({k} * 31) % 450) / 1e1 AS depth_km, CAST(1.5 AS DOUBLE) + (({k} * 13) % 60) / 1e1 AS magnitude,
            CASE WHEN {k} % 11 = 0 THEN '' ELSE 'Mj' END AS magnitude_type, o_orderpriority AS catalog_source,
            {d.after("o_orderdate", f"9131 * (({k} % 5) - 3)", f"({k} * 37) % 86400")} AS time_utc FROM {{orders}}""",
        "fx_event_dup": f"""SELECT * FROM {{fx_event}} UNION ALL SELECT k, event_id || 'd' AS event_id, lon, lat, depth_km, magnitude, magnitude_type,
            catalog_source, time_utc FROM {{fx_event}} WHERE k % 97 = 0""",
        "fx_mechanism": f"""SELECT p_partkey AS p, 'm' || CAST(p_partkey AS {text}) AS mechanism_id, 'ev' || CAST((p_partkey * 7) % 1500 AS {text}) AS event_id,
            {far("(p_partkey * 37) % 360")} AS strike1, {far("(p_partkey * 11) % 90")} AS dip1, {far("(p_partkey * 29) % 360 - 180")} AS rake1,
            {far("(p_partkey * 37 + 90) % 360")} AS strike2, {far("(p_partkey * 11 + 30) % 90")} AS dip2, {far("(p_partkey * 29 + 90) % 360 - 180")} AS rake2,
            p_retailprice * 1e15 AS scalar_moment_nm FROM {{part}}""",
        "fx_mechanism_origin": f"""SELECT m.p, m.mechanism_id, {d.after("e.time_utc", "0", "(m.p * 17) % 2001 - 1000")} AS origin_utc, e.lon + ((m.p % 7) - 3) / 1e1 AS lon,
            e.lat + ((m.p % 7) - 3) / 1e1 AS lat, e.magnitude + ((m.p % 5) - 2) / 1e1 AS magnitude FROM {{fx_mechanism}} m JOIN {{fx_event}} e ON m.event_id = e.event_id""",
        "fx_spectrum": f"""SELECT {block("l_orderkey", 75)} AS event_id, 'ST' || CAST(l_suppkey AS {text}) AS station_id, l_returnflag AS channel,
            CASE l_linenumber % 5 WHEN 0 THEN 5e-1 WHEN 1 THEN 1e0 WHEN 2 THEN 2e0 WHEN 3 THEN 4e0 ELSE 8e0 END AS frequency_hz,
            l_extendedprice / 1e3 AS amplitude, ((l_partkey * 17) % 6283) / 1e3 - CAST(3.1415 AS DOUBLE) AS phase_rad, l_quantity / 1e1 AS group_delay_s,
            CAST(129.6 AS DOUBLE) + ((l_suppkey * 613) % 1900) / 1e3 AS lon, CAST(31.8 AS DOUBLE) + ((l_suppkey * 997) % 1800) / 1e3 AS lat,
            l_orderkey, l_partkey, l_suppkey, l_linenumber FROM {{lineitem}}""",
        "fx_station": f"""SELECT 'ST' || CAST(s_suppkey AS {text}) AS station_id, CASE WHEN s_suppkey % 3 = 0 THEN 'hinet' ELSE 'fdsn' END AS network,
            CAST(129.6 AS DOUBLE) + ((s_suppkey * 613) % 1900) / 1e3 AS lon, CAST(31.8 AS DOUBLE) + ((s_suppkey * 997) % 1800) / 1e3 AS lat FROM {{supplier}}""",
        "fx_gnss": f"""SELECT 'G' || CAST(user_id AS {text}) AS station_id, event_id AS row_id, CAST(ts AS DATE) AS date, CAST(129.6 AS DOUBLE) + ((user_id * 419) % 1900) / 1e3 AS lon,
            CAST(31.8 AS DOUBLE) + ((user_id * 727) % 1800) / 1e3 AS lat, value / 1e3 AS east_m, ((event_id * 29) % 1000) / 1e4 AS north_m, ((event_id * 53) % 1000) / 1e5 AS up_m FROM {{events}}""",
        "fx_fault": f"""SELECT n_nationkey AS n, 'known_' || CAST(n_nationkey AS {text}) AS segment_id, CAST(129.7 AS DOUBLE) + ((n_nationkey * 733) % 1700) / 1e3 AS lon0,
            CAST(31.9 AS DOUBLE) + ((n_nationkey * 557) % 1600) / 1e3 AS lat0, {far("(n_nationkey * 47) % 360")} AS strike, {far("60 + n_nationkey % 30")} AS dip,
            {far("10 + n_nationkey % 40")} AS length_km, {far("8 + n_nationkey % 10")} AS width_km, n_nationkey % 5 = 0 AS is_inferred, ((n_nationkey * 17) % 100) / 1e2 AS confidence FROM {{nation}}""",
        "fx_trace": f"""SELECT segment_id, n, is_inferred, confidence, length_km, width_km, strike, dip, {d.points(*((f"111000e0 * (lon0 + {x} - 130.5e0)", f"111000e0 * (lat0 + {y} - 32.7e0)") for x, y in (("0e0", "0e0"), ("1e-1", "5e-2"), ("2e-1", "15e-2"))))} AS trace FROM {{fx_fault}}""",
        "fx_member": f"""SELECT 'known_' || CAST(c_nationkey AS {text}) AS segment_id, c_custkey AS member, CAST(0.2 AS DOUBLE) + 4e-1 * ((c_custkey * 37) % 1000) / 1e3 AS friction,
            1e6 + 9e6 * ((c_custkey * 53) % 1000) / 1e3 AS cohesion_pa, 1e7 + 9e7 * ((c_custkey * 71) % 1000) / 1e3 AS normal_pa,
            1e4 * (5e-1 + ((c_custkey * 89) % 1000) / 1e3) AS stress_rate, 25e-2 * ((c_custkey * 97) % 1000) / 1e3 AS initial_fraction FROM {{customer}}""",
        "fx_splat": f"""SELECT 'ev' || CAST(l_orderkey % 200 AS {text}) AS event_id, {far("(l_partkey * 911) % 200000")} AS x_m, {far("(l_suppkey * 1301) % 200000")} AS y_m,
            {far("(l_partkey * 37) % 40000")} AS z_m, 2500e0 + 100 * l_quantity AS sigma_x_m, 2500e0 + 100 * l_quantity AS sigma_y_m, 2500e0 AS sigma_z_m,
            5 * l_discount AS structure_amplitude, 2e-1 + 5 * l_tax AS opacity,
            CASE l_linenumber % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'reflected' WHEN 2 THEN 'scattered' ELSE 'residual' END AS primitive_type,
            CASE WHEN l_linenumber % 4 = 0 THEN 'source_anchor' WHEN l_partkey % 3 = 0 THEN 'diagnostic_rejected' ELSE 'structure' END AS splat_role,
            l_quantity AS late_phase_delay_s, l_partkey % 7 = 0 AS late_delay_clipped, l_orderkey, l_partkey, l_linenumber FROM {{lineitem}}""",
        "fx_projection": f"""SELECT {block("p_partkey", 10)} AS event_id, p_partkey AS p,
            CASE p_partkey % 5 WHEN 0 THEN 5e-1 WHEN 1 THEN 1e0 WHEN 2 THEN 2e0 WHEN 3 THEN 4e0 ELSE 8e0 END AS frequency_hz,
            6378137e0 * radians(130.5e0) + ((p_partkey * 613) % 160000) - 80000 AS projection_x_m,
            6378137e0 * ln(tan(pi() / 4 + radians(32.7e0) / 2)) + ((p_partkey * 997) % 160000) - 80000 AS projection_y_m, ((p_partkey * 31) % 450) * 1e2 AS projection_z_m,
            ((p_partkey * 7) % 100) / 1e2 AS beam_energy, ((p_partkey * 13) % 100) / 1e2 AS array_coherence, ((p_partkey * 17) % 6283) / 1e3 - CAST(3.1415 AS DOUBLE) AS phase_resultant_rad,
            p_size AS projection_rank, CASE p_partkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'reflected' WHEN 2 THEN 'scattered' ELSE 'residual' END AS primitive_type,
            ((p_partkey * 19) % 50) / 1e1 AS residual_spread_s, ((p_partkey * 23) % 310) / 1e1 AS late_phase_delay_s, ((p_partkey * 7) % 100) / 1e2 * 3 AS beam_power FROM {{part}}""",
        "fx_candidate": f"""SELECT p_partkey AS p, 'c' || CAST(p_partkey AS {text}) AS candidate_id, {far("(p_partkey * 7919) % 200000")} AS center_x_m, {far("(p_partkey * 6007) % 150000")} AS center_y_m,
            {far("(p_partkey * 31) % 400")} / 1e1 AS center_depth_km, {far("(p_partkey * 37) % 360")} AS strike, CASE WHEN p_partkey % 50 = 0 THEN 900e0 ELSE {far("10 + p_partkey % 90")} END AS length_km,
            {far("5 + p_partkey % 30")} AS width_km, ((p_partkey * 53) % 1000) / 1e3 AS fault_score, ((p_partkey * 71) % 100) / 1e2 AS planarity, 4 + p_partkey % 40 AS n_events FROM {{part}}""",
    }


SPARK, DUCK = Dialect(True), Dialect(False)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
_NAMES = list(_views(SPARK))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _views(SPARK)[name]
    used = {n: view(spark, sf_dir, n) for n in (*TABLES, *_NAMES) if f"{{{n}}}" in sql}
    return spark.sql(sql, **used)


def oracle(sql: str) -> str:
    """DuckDB SQL with the fixture views it uses in front."""
    views, wanted, todo = _views(DUCK), [], [n for n in _NAMES if n in sql]
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.append(n)
            todo += [x for x in _NAMES if f"{{{x}}}" in views[n]]
    parts = []
    for n in _NAMES:
        if n in wanted:
            text = views[n]
            for x in (*TABLES, *_NAMES):
                text = text.replace(f"{{{x}}}", x)
            parts.append(f"{n} AS ({text})")
    body = sql.strip()
    if not parts:
        return body
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body.removeprefix("WITH RECURSIVE ")
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
