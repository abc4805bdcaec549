"""Eigenvalues and eigenvectors of symmetric 3 x 3 matrices in closed form, as column expressions.

The matrix is scaled by its largest entry. The eigenvalue that lies apart from the other two comes from the trigonometric roots of the
cubic; its vector is the longest cross product of two rows of the matrix less that eigenvalue. What is left is a symmetric 2 x 2
matrix in the plane across that vector, whose eigenvalues and vectors have a closed form without cancellation. So two close eigenvalues
keep their full precision, which the roots of the cubic alone would lose.

Defined results: null and NaN entries count as 0; a triple root has the axes x, y, z as vectors; a double root has the two vectors of the
plane across the third, the first of them across the third's larger one of x and y (``u`` below), so that it is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
AXES = "xyz"
#: a spread of eigenvalues below this share of the largest entry is a triple root
TRIPLE = 1e-14


def _vector(name: str) -> list[Column]:
    return [F.col(f"{name}{a}") for a in AXES]


def _dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _named(name: str, values: list[Column]) -> dict[str, Column]:
    return {f"{name}{a}": v for a, v in zip(AXES, values)}


def symmetric_eigen(df: DataFrame, entries: tuple[str, ...] = ENTRIES, value: str = "val", vector: str = "vec") -> DataFrame:
    """``df`` with val0 <= val1 <= val2 and the unit vectors vec0x ... vec2z of the matrix of the columns ``entries`` (xx, xy, xz, yy,
    yz, zz). Each step is a projection of its own, so that no expression is worked out twice."""
    p, taken = "e3_", {c.lower() for c in df.columns}
    while any(c.startswith(p) for c in taken):
        p += "_"
    n = lambda name: p + name
    c = lambda name: F.col(p + name)
    names = [n(e) for e in ("xx", "xy", "xz", "yy", "yz", "zz")]
    keep = df.columns
    clean = [F.coalesce(F.when(~F.isnan(e), e), F.lit(0.0)) for e in (F.col(x).cast("double") for x in entries)]
    out = df.withColumns(dict(zip(names, clean)))
    out = out.withColumn(n("scale"), F.greatest(*(F.abs(x) for x in names)))
    out = out.withColumns({x: F.when(c("scale") > 0, F.col(x) / c("scale")).otherwise(0.0) for x in names})
    xx, xy, xz, yy, yz, zz = (F.col(x) for x in names)
    rows = [[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]
    times = lambda v: [_dot(row, v) for row in rows]

    # roots of the cubic of the matrix less its mean eigenvalue
    out = out.withColumn(n("q"), (xx + yy + zz) / 3)
    dx, dy, dz = xx - c("q"), yy - c("q"), zz - c("q")
    out = out.withColumn(n("p"), F.sqrt((dx * dx + dy * dy + dz * dz + 2 * (xy * xy + xz * xz + yz * yz)) / 6))
    det = dx * (dy * dz - yz * yz) - xy * (xy * dz - yz * xz) + xz * (xy * yz - dy * xz)
    half = F.when(c("p") > TRIPLE, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (c("p") * c("p") * c("p")) / 2))).otherwise(1.0)
    out = out.withColumn(n("half"), half)
    # the root that lies apart: the largest if the determinant is positive, else the smallest
    turn = F.acos(c("half")) / 3 + F.when(c("half") < 0, F.lit(2.0943951023931953)).otherwise(0.0)
    out = out.withColumn(n("root"), c("q") + 2 * c("p") * F.cos(turn))

    less = [[rows[i][j] - c("root") if i == j else rows[i][j] for j in range(3)] for i in range(3)]
    for name, (i, j) in {"f": (0, 1), "g": (0, 2), "h": (1, 2)}.items():
        out = out.withColumns(_named(n(name), _cross(less[i], less[j])))
    out = out.withColumns({n(f"{x}2"): _dot(_vector(n(x)), _vector(n(x))) for x in "fgh"})
    most = F.greatest(c("f2"), c("g2"), c("h2"))
    out = out.withColumn(n("most"), most)
    triple = (c("p") <= TRIPLE) | (c("most") <= 0)
    w = [
        F.when(triple, F.lit(1.0 if a == "z" else 0.0))
        .when(c("f2") == c("most"), c(f"f{a}") / F.sqrt(n("most")))
        .when(c("g2") == c("most"), c(f"g{a}") / F.sqrt(n("most")))
        .otherwise(c(f"h{a}") / F.sqrt(n("most")))
        for a in AXES
    ]
    out = out.withColumns(_named(n("w"), w))

    # the plane across w, and the matrix in it
    wx, wy, wz = _vector(n("w"))
    wide = F.abs(wx) > F.abs(wy)
    long = F.when(wide, F.sqrt(wx * wx + wz * wz)).otherwise(F.sqrt(wy * wy + wz * wz))
    u = [F.when(triple, 1.0).when(wide, -wz / long).otherwise(0.0), F.when(triple | wide, 0.0).otherwise(wz / long), F.when(triple, 0.0).when(wide, wx / long).otherwise(-wy / long)]
    out = out.withColumns(_named(n("u"), u))
    out = out.withColumns(_named(n("v"), _cross(_vector(n("w")), _vector(n("u")))))
    U, V, Wv = _vector(n("u")), _vector(n("v")), _vector(n("w"))
    out = out.withColumns({n("uu"): _dot(U, times(U)), n("uv"): _dot(U, times(V)), n("vv"): _dot(V, times(V)), n("ww"): _dot(Wv, times(Wv))})
    gap = (c("uu") - c("vv")) / 2
    out = out.withColumns({n("gap"): gap, n("mid"): (c("uu") + c("vv")) / 2, n("rad"): F.hypot(gap, n("uv"))})
    # the vector of the smaller one in the plane, by its larger form
    reach = F.abs(c("gap")) + c("rad")
    s = F.when(c("gap") >= 0, c("uv")).otherwise(-reach)
    t = F.when(c("gap") >= 0, -reach).otherwise(c("uv"))
    out = out.withColumns({n("s"): s, n("t"): t})
    size = F.hypot(c("s"), c("t"))
    flat = (c("rad") <= 0) | (size <= 0)
    out = out.withColumns({n("sn"): F.when(flat, 1.0).otherwise(c("s") / size), n("tn"): F.when(flat, 0.0).otherwise(c("t") / size)})
    low = [c("sn") * a + c("tn") * b for a, b in zip(U, V)]
    high = [c("sn") * b - c("tn") * a for a, b in zip(U, V)]
    top = c("half") >= 0
    made = {f"{value}0": F.when(top, c("mid") - c("rad")).otherwise(c("ww")), f"{value}1": F.when(top, c("mid") + c("rad")).otherwise(c("mid") - c("rad"))}
    made[f"{value}2"] = F.when(top, c("ww")).otherwise(c("mid") + c("rad"))
    made = {k: v * c("scale") for k, v in made.items()}
    for k, (a, b) in enumerate(((low, Wv), (high, low), (Wv, high))):
        made |= _named(f"{vector}{k}", [F.when(top, x).otherwise(y) for x, y in zip(a, b)])
    kept = [x for x in keep if x.lower() not in {m.lower() for m in made}]
    return out.select(*(F.col(f"`{x}`") for x in kept), *(v.alias(k) for k, v in made.items()))
