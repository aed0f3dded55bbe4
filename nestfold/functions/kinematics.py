"""Four-vector arithmetic as column expressions, so that it stays in generated code.

Everything is double precision. Squared masses below 0, which rounding can give, count as 0, but for the
SQL function ``dimuon_mass``, which gives NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Z_MASS, TOP_MASS = 91.1876, 172.5


def p4(pt: Column, eta: Column, phi: Column, mass: Column) -> Column:
    """struct(px, py, pz, e)."""
    pt, eta, phi, mass = (c.cast("double") for c in (pt, eta, phi, mass))
    px, py, pz = pt * F.cos(phi), pt * F.sin(phi), pt * F.sinh(eta)
    return F.struct(px.alias("px"), py.alias("py"), pz.alias("pz"), F.sqrt(px * px + py * py + pz * pz + mass * mass).alias("e"))


def total(*vectors: Column) -> Column:
    """The sum of structs with px, py, pz, e."""
    out = []
    for name in ("px", "py", "pz", "e"):
        c = vectors[0][name]
        for v in vectors[1:]:
            c = c + v[name]
        out.append(c.alias(name))
    return F.struct(*out)


def total_of(vectors: Column) -> Column:
    """The sum of all vectors of an array; zero of none."""
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("px", "py", "pz", "e")])
    return F.aggregate(vectors, start, lambda s, v: total(s, v))


def mass(v: Column) -> Column:
    return F.sqrt(F.greatest(v["e"] * v["e"] - v["px"] * v["px"] - v["py"] * v["py"] - v["pz"] * v["pz"], F.lit(0.0)))


def pair_mass(a: Column, b: Column) -> Column:
    return mass(total(a, b))


def transverse(v: Column) -> Column:
    return F.sqrt(v["px"] * v["px"] + v["py"] * v["py"])


def delta_phi(a: Column, b: Column) -> Column:
    """a - b brought to -pi..pi."""
    d = a - b
    return d - 2 * F.pi() * F.floor((d + F.pi()) / (2 * F.pi())).cast("double")


def delta_r(eta1: Column, phi1: Column, eta2: Column, phi2: Column) -> Column:
    d = delta_phi(phi1, phi2)
    return F.sqrt((eta1 - eta2) * (eta1 - eta2) + d * d)


def transverse_mass(pt: Column, phi: Column, met: Column, met_phi: Column) -> Column:
    return F.sqrt(2 * pt * met * (1 - F.cos(phi - met_phi)))


def _norm(names: list[str], part: str) -> str:
    return "(" + " + ".join(part.format(n=n) for n in names) + ")"


_PX, _PY, _PZ = "pt{n} * cos(phi{n})", "pt{n} * sin(phi{n})", "pt{n} * sinh(eta{n})"
_E = f"sqrt(({_PX}) * ({_PX}) + ({_PY}) * ({_PY}) + ({_PZ}) * ({_PZ}) + m{{n}} * m{{n}})"


def _mass_sql(n: int) -> str:
    names = [str(i) for i in range(1, n + 1)]
    e, px, py, pz = (_norm(names, p) for p in (_E, _PX, _PY, _PZ))
    return f"sqrt(greatest({e} * {e} - {px} * {px} - {py} * {py} - {pz} * {pz}, 0D))"


def sql_functions() -> dict[str, tuple[str, str]]:
    """Name -> (arguments, expression) of the functions offered to SQL."""
    args = lambda parts, n: ", ".join(f"{p}{i} DOUBLE" for i in range(1, n + 1) for p in parts)
    # not clipped: a squared mass below 0 gives NaN
    cart = "sqrt((e1 + e2) * (e1 + e2) - (px1 + px2) * (px1 + px2) - (py1 + py2) * (py1 + py2) - (pz1 + pz2) * (pz1 + pz2))"
    px, py = (_norm(["1", "2", "3"], p) for p in (_PX, _PY))
    return {
        "dimuon_mass": (args(("e", "px", "py", "pz"), 2), cart),
        "dimuon_mass_polar": (args(("pt", "eta", "phi", "m"), 2), _mass_sql(2)),
        "trijet_pt": (args(("pt", "phi"), 3), f"sqrt({px} * {px} + {py} * {py})"),
        "trijet_mass": (args(("pt", "eta", "phi", "m"), 3), _mass_sql(3)),
    }


def register(spark: SparkSession) -> None:
    """Make the functions usable in SQL; Catalyst inlines them."""
    for name, (args, body) in sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
