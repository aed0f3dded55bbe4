"""The eight benchmark queries over nested events, and the muon pair and trijet family.

Each takes events with met_pt, met_phi and arrays jets and muons (pt, eta, phi, mass[, charge]) and
gives (event_id, value), a row for each entry that a histogram of it would get.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.functions.kinematics import TOP_MASS, Z_MASS, delta_r, mass, p4, pair_mass, total, transverse, transverse_mass
from nestfold.operators.nesting import pairs


def _value(df: DataFrame, value: Column) -> DataFrame:
    return df.select("event_id", value.alias("value"))


def _value_where(df: DataFrame, keep: Column, value: Column) -> DataFrame:
    """The value of the rows that ``keep`` is true for. A generator in place of a filter: Catalyst would
    push a filter below the columns that it uses, and compute them once for each use."""
    return df.select("event_id", F.explode(F.when(keep, F.array(value)).otherwise(F.array().cast("array<double>"))).alias("value"))


def q1(events: DataFrame) -> DataFrame:
    """MET of every event."""
    return _value(events, F.col("met_pt"))


def q2(events: DataFrame) -> DataFrame:
    """pt of every jet."""
    return _value(events, F.explode("jets.pt"))


def q3(events: DataFrame) -> DataFrame:
    """pt of jets with |eta| < 1."""
    return events.select("event_id", F.explode(F.arrays_zip("jets.pt", "jets.eta")).alias("j")).where("abs(j.eta) < 1").select("event_id", F.col("j.pt").alias("value"))


def q4(events: DataFrame) -> DataFrame:
    """MET of events with two or more jets of pt > 40."""
    return _value(events.where(F.size(F.filter("jets.pt", lambda pt: pt > 40)) >= 2), F.col("met_pt"))


def with_p4(items: Column) -> Column:
    return F.transform(items, lambda o: F.struct(p4(o["pt"], o["eta"], o["phi"], o["mass"]).alias("v"), o["pt"].alias("pt"), o["phi"].alias("phi"), o["charge"].alias("charge")))


def _opposite(a: Column, b: Column) -> Column:
    return a["charge"] != b["charge"]


def q5(events: DataFrame) -> DataFrame:
    """MET of events in which a muon pair of opposite charge has 60 < m < 120."""
    made = events.where(F.size("muons") >= 2).withColumn("_m", with_p4(F.col("muons")))
    masses = pairs(F.col("_m"), lambda a, b: pair_mass(a["v"], b["v"]), _opposite)
    return _value_where(made, F.exists(masses, lambda m: (m > 60) & (m < 120)), F.col("met_pt"))


def _best_trijet(jets: Column) -> Column:
    """struct(off, i, j, k, v) of the three jets nearest to the top mass; of ties, the first."""
    n = F.size(jets)
    numbered = F.transform(jets, lambda o, i: F.struct(i.alias("i"), o["v"].alias("v")))

    def with_third(a, b):
        def of(c):
            v = total(a["v"], b["v"], c["v"])
            return F.struct(F.abs(mass(v) - TOP_MASS).alias("off"), a["i"].alias("i"), b["i"].alias("j"), c["i"].alias("k"), v.alias("v"))

        return F.array_min(F.transform(F.slice(numbered, b["i"] + 2, n), of))

    return F.array_min(F.flatten(F.transform(numbered, lambda a: F.transform(F.slice(numbered, a["i"] + 2, n), lambda b: with_third(a, b)))))


def q6(events: DataFrame) -> DataFrame:
    """pt of the trijet whose mass is nearest to that of the top quark; events with three jets or more."""
    made = events.where(F.size("jets") >= 3).withColumn("_j", F.transform("jets", lambda o: F.struct(p4(o["pt"], o["eta"], o["phi"], o["mass"]).alias("v"))))
    return _value(made.withColumn("_b", _best_trijet(F.col("_j"))), transverse(F.col("_b.v")))


def q7(events: DataFrame) -> DataFrame:
    """Sum of pt of jets over 30 that have no muon over 10 within 0.4; every event has a value."""
    dirty = lambda j: F.exists("muons", lambda m: (m["pt"] > 10) & (delta_r(j["eta"], j["phi"], m["eta"], m["phi"]) <= 0.4))
    clean = F.filter("jets", lambda j: (j["pt"] > 30) & ~dirty(j))
    return _value(events, F.aggregate(clean, F.lit(0.0), lambda s, j: s + j["pt"]))


def q8(events: DataFrame) -> DataFrame:
    """Transverse mass of MET and the leading muon outside the opposite-charge pair nearest to the Z; three muons or more."""
    made = events.where(F.size("muons") >= 3).withColumn("_m", F.transform(with_p4(F.col("muons")), lambda o, i: F.struct(i.alias("i"), *[o[f].alias(f) for f in ("v", "pt", "phi", "charge")])))
    best = F.array_min(pairs(F.col("_m"), lambda a, b: F.struct(F.abs(pair_mass(a["v"], b["v"]) - Z_MASS).alias("off"), a["i"].alias("i"), b["i"].alias("j")), _opposite))
    made = made.withColumn("_b", best)
    rest = F.filter("_m", lambda m: (m["i"] != F.col("_b.i")) & (m["i"] != F.col("_b.j")))
    lead = F.array_max(F.transform(rest, lambda m: F.struct(m["pt"].alias("pt"), (-m["i"]).alias("back"), m["phi"].alias("phi"))))
    made = made.withColumn("_l", lead)
    return _value_where(made, F.col("_b").isNotNull(), transverse_mass(F.col("_l.pt"), F.col("_l.phi"), F.col("met_pt"), F.col("met_phi")))


def zmumu_flat(events: DataFrame) -> DataFrame:
    """Mass of the two muons of events with exactly two, of opposite charge, in 60 < m < 120."""
    first, second = F.get("muons", F.lit(0)), F.get("muons", F.lit(1))
    made = events.where((F.size("muons") == 2) & (first["charge"] + second["charge"] == 0)).withColumn("_m", with_p4(F.col("muons")))
    one = pairs(F.col("_m"), lambda a, b: pair_mass(a["v"], b["v"]))
    return _value(made, F.explode(F.filter(one, lambda m: (m > 60) & (m < 120))))


def zmumu_jagged(events: DataFrame) -> DataFrame:
    """Mass of every muon pair of opposite charge in 60 < m < 120."""
    made = events.where(F.size("muons") >= 2).withColumn("_m", with_p4(F.col("muons")))
    return _value(made, F.explode(pairs(F.col("_m"), lambda a, b: pair_mass(a["v"], b["v"]), _opposite))).where("value > 60 AND value < 120")


def zmumu_hybrid(events: DataFrame) -> DataFrame:
    """The same, after dropping events without muons of both charges."""
    both = F.exists("muons.charge", lambda c: c > 0) & F.exists("muons.charge", lambda c: c < 0)
    return zmumu_jagged(events.where(both))


QUERIES = {f.__name__: f for f in (q1, q2, q3, q4, q5, q6, q7, q8)}


def run_all(events: DataFrame) -> dict[str, DataFrame]:
    return {name: f(events) for name, f in QUERIES.items()}
