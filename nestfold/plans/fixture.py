"""Events and objects out of orders and lineitem, for queries over the given tables.

An order is an event. Its line items are objects, jets or muons by return flag, in a total order that
gives each its place. The same derivation as SQL, in ``ORACLE``, is what results are checked against.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestfold.operators import clustered
from nestfold.operators.clustered import with_vectors
from nestfold.storage import new_path

ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
FIELDS = ("pt", "eta", "phi", "mass")

ORACLE = """
WITH ev AS (SELECT o_orderkey AS event_id, o_totalprice / CAST(1000 AS DOUBLE) AS met_pt,
    CAST(o_custkey % 628 AS DOUBLE) / CAST(100 AS DOUBLE) - pi() AS met_phi FROM orders),
ob AS (SELECT l_orderkey AS event_id, l_returnflag = 'R' AS muon,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) - 1 AS i,
    l_quantity AS pt, (l_discount - CAST(0.05 AS DOUBLE)) * 50 AS eta,
    l_extendedprice - 2 * pi() * CAST(floor(l_extendedprice / (2 * pi())) AS DOUBLE) - pi() AS phi,
    l_tax * 100 + CAST(0 AS DOUBLE) AS mass, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS charge FROM lineitem),
c AS (SELECT *, pt * cos(phi) AS px, pt * sin(phi) AS py, pt * ((exp(eta) - exp(-eta)) / 2) AS pz FROM ob),
o4 AS (SELECT *, sqrt(px * px + py * py + pz * pz + mass * mass) AS e FROM c),
jets AS (SELECT * FROM o4 WHERE NOT muon), muons AS (SELECT * FROM o4 WHERE muon)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    phi = (F.col("o_custkey") % 628).cast("double") / 100.0 - F.pi()
    return orders.select(F.col("o_orderkey").alias("event_id"), (F.col("o_totalprice") / 1000.0).alias("met_pt"), phi.alias("met_phi"))


def _kinematics() -> dict:
    turn, price = 2 * F.pi(), F.col("l_extendedprice")
    return {
        "pt": F.col("l_quantity"),
        "eta": (F.col("l_discount") - F.lit(0.05)) * 50,
        "phi": price - turn * F.floor(price / turn).cast("double") - F.pi(),
        "mass": F.col("l_tax") * 100 + F.lit(0.0),
        "charge": F.when(F.col("l_linestatus") == "O", 1).otherwise(-1),
    }


def objects(spark: SparkSession, sf_dir: str, muon: bool | None = None) -> DataFrame:
    """(event_id, muon, i, pt, eta, phi, mass, charge): jets, muons, or both. i is the place in its collection."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("muon", F.col("l_returnflag") == "R")
    lines = lines if muon is None else lines.where("muon" if muon else "NOT muon")
    place = F.row_number().over(Window.partitionBy("l_orderkey", "muon").orderBy(*ORDER)) - 1
    return lines.select(F.col("l_orderkey").alias("event_id"), "muon", place.alias("i"), *[c.alias(k) for k, c in _kinematics().items()])


def nested(spark: SparkSession, sf_dir: str, jets: bool = True, muons: bool = True) -> DataFrame:
    """events with arrays jets and muons, in the same order as ``objects`` gives them; one shuffle of the line items.

    Ordering is by the source columns themselves, inside the arrays, so no window is needed.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if jets != muons:  # one collection: the others' rows stay in the file
        lines = lines.where(F.col("l_returnflag") == "R" if muons else F.col("l_returnflag") != "R")
    made = F.struct(*ORDER, *[c.alias(k) for k, c in _kinematics().items()])
    lines = lines.select("l_orderkey", "l_returnflag", made.alias("made"))  # in compiled code, which an aggregate of lists is not
    made = F.col("made")
    wanted = {n: r for n, r, on in (("jets", F.col("l_returnflag") != "R", jets), ("muons", F.col("l_returnflag") == "R", muons)) if on}
    strip = lambda o: F.struct(*[o[f].alias(f) for f in (*FIELDS, "charge")])
    lists = [F.transform(F.array_sort(F.collect_list(F.when(r, made))), strip).alias(n) for n, r in wanted.items()]
    packed = lines.groupBy(F.col("l_orderkey").alias("event_id")).agg(*lists)
    out = events(spark, sf_dir).join(packed, "event_id", "left")
    return out.withColumns({n: F.coalesce(n, F.array()) for n in wanted})


def store_clustered(spark: SparkSession, sf_dir: str, buckets: int, prefix: str | None = None) -> str:
    """The flat events, jets and muons as clustered tables, objects with their vectors and events with counts; the tables' prefix.

    Without ``prefix``, each call has names and a folder of its own, so that neither another session nor what one left in the warehouse is met.
    """
    folder = None if prefix else new_path(spark, "clustered")
    prefix = prefix or f"clustered_{uuid.uuid4().hex[:12]}"
    both = with_vectors(objects(spark, sf_dir))
    n = lambda of: F.count_if(of).cast("int")
    counts = both.groupBy("event_id").agg(n(~F.col("muon")).alias("n_jets"), n(F.col("muon")).alias("n_muons"))
    flat = {"events": events(spark, sf_dir).join(counts, "event_id", "left").fillna(0, ["n_jets", "n_muons"])}
    flat |= {name: both.where(of).drop("muon") for name, of in (("jets", "NOT muon"), ("muons", "muon"))}
    clustered.store(flat, prefix, buckets, folder=folder)
    return prefix
