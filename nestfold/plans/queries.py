"""Every query over the given tables, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.functions import lists, statistics
from nestfold.functions.keys import KeyLayout, Manifest, ShardMap, owners
from nestfold.functions.kinematics import mass, p4, register, total_of
from nestfold.operators import clustered, nesting, record, shards, tables
from nestfold.plans import adl
from nestfold.plans.fixture import ORACLE, events, nested, objects, store_clustered
from nestfold.sources import datasets, root
from nestfold.storage import children, new_path, written
from nestfold.tools.scoring import compare

QUERIES: dict = {}
SQL: dict[str, str] = {}
WIDE, NARROW = KeyLayout(40), KeyLayout(31)
PER_FILE = 1000  # for key queries: order key = file * 1000 + entry


def query(sql: str, plain: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql if plain else ORACLE + sql
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_id, round(met_pt, 6) AS value FROM ev")
def q1(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(adl.q1(events(spark, d)))


@query("SELECT event_id, round(pt, 6) AS value FROM jets")
def q2(spark, d):
    return _rounded(objects(spark, d, False).select("event_id", F.col("pt").alias("value")))


@query("SELECT event_id, round(pt, 6) AS value FROM jets WHERE abs(eta) < 1")
def q3(spark, d):
    return _rounded(objects(spark, d, False).where("abs(eta) < 1").select("event_id", F.col("pt").alias("value")))


@query("SELECT event_id, round(met_pt, 6) AS value FROM ev WHERE event_id IN (SELECT event_id FROM jets WHERE pt > 40 GROUP BY event_id HAVING count(*) >= 2)")
def q4(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag <> 'R' AND l_quantity > 40")
    picked = lines.groupBy(F.col("l_orderkey").alias("event_id")).count().where("count >= 2")
    return _rounded(events(spark, d).join(picked, "event_id", "left_semi").select("event_id", F.col("met_pt").alias("value")))


@query("SELECT event_id, round(pt, 6) AS value FROM jets")
def q2_nested(spark, d):
    return _rounded(adl.q2(nested(spark, d, muons=False)))


@query("SELECT event_id, round(pt, 6) AS value FROM jets WHERE abs(eta) < 1")
def q3_nested(spark, d):
    return _rounded(adl.q3(nested(spark, d, muons=False)))


@query("SELECT event_id, round(met_pt, 6) AS value FROM ev WHERE event_id IN (SELECT event_id FROM jets WHERE pt > 40 GROUP BY event_id HAVING count(*) >= 2)")
def q4_nested(spark, d):
    return _rounded(adl.q4(nested(spark, d, muons=False)))


_MASS2 = "sqrt(greatest(({e}) * ({e}) - ({x}) * ({x}) - ({y}) * ({y}) - ({z}) * ({z}), CAST(0 AS DOUBLE)))"
_PAIR = _MASS2.format(e="a.e + b.e", x="a.px + b.px", y="a.py + b.py", z="a.pz + b.pz")
_OS = f"mm AS (SELECT a.event_id, a.i AS i, b.i AS j, {_PAIR} AS m FROM muons a JOIN muons b ON a.event_id = b.event_id AND a.i < b.i AND a.charge <> b.charge)"


@query(f", {_OS} SELECT event_id, round(met_pt, 6) AS value FROM ev WHERE event_id IN (SELECT event_id FROM mm WHERE m > 60 AND m < 120)")
def q5(spark, d):
    return _rounded(adl.q5(nested(spark, d, jets=False)))


_TRI = _MASS2.format(e="a.e + b.e + c.e", x="a.px + b.px + c.px", y="a.py + b.py + c.py", z="a.pz + b.pz + c.pz")
_TRIJET = f""", tri AS (SELECT a.event_id, a.i AS i, b.i AS j, c.i AS k, {_TRI} AS m, a.px + b.px + c.px AS x, a.py + b.py + c.py AS y
    FROM jets a JOIN jets b ON a.event_id = b.event_id AND a.i < b.i JOIN jets c ON b.event_id = c.event_id AND b.i < c.i),
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(m - CAST(172.5 AS DOUBLE)), i, j, k) AS r FROM tri)
SELECT event_id, round(sqrt(x * x + y * y), 6) AS value FROM best WHERE r = 1"""


@query(_TRIJET)
def q6(spark, d):
    return _rounded(adl.q6(nested(spark, d, muons=False)))


@query(""", dirty AS (SELECT DISTINCT j.event_id, j.i FROM jets j JOIN muons m ON j.event_id = m.event_id AND m.pt > 10 AND
    sqrt((j.eta - m.eta) * (j.eta - m.eta) + power(j.phi - m.phi - 2 * pi() * floor((j.phi - m.phi + pi()) / (2 * pi())), 2)) <= CAST(0.4 AS DOUBLE)),
ht AS (SELECT j.event_id, sum(j.pt) AS ht FROM jets j LEFT JOIN dirty x ON j.event_id = x.event_id AND j.i = x.i WHERE x.i IS NULL AND j.pt > 30 GROUP BY j.event_id)
SELECT event_id, round(coalesce(ht, 0), 6) AS value FROM ev LEFT JOIN ht USING (event_id)""")
def q7(spark, d):
    return _rounded(adl.q7(nested(spark, d)))


@query(f""", {_OS}, z AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(m - CAST(91.1876 AS DOUBLE)), i, j) AS r FROM mm),
lead AS (SELECT m.event_id, m.pt, m.phi, row_number() OVER (PARTITION BY m.event_id ORDER BY m.pt DESC, m.i) AS r FROM muons m JOIN z ON z.event_id = m.event_id AND z.r = 1 AND m.i <> z.i AND m.i <> z.j)
SELECT event_id, round(sqrt(2 * pt * met_pt * (1 - cos(phi - met_phi))), 6) AS value FROM lead JOIN ev USING (event_id) WHERE r = 1""")
def q8(spark, d):
    return _rounded(adl.q8(nested(spark, d, jets=False)))


@query(f", {_OS}, two AS (SELECT event_id FROM muons GROUP BY event_id HAVING count(*) = 2) SELECT event_id, round(m, 6) AS value FROM mm JOIN two USING (event_id) WHERE m > 60 AND m < 120")
def zmumu_flat(spark, d):
    return _rounded(adl.zmumu_flat(nested(spark, d, jets=False)))


@query(f", {_OS}, two AS (SELECT event_id FROM muons GROUP BY event_id HAVING count(*) = 2) SELECT event_id, round(m, 6) AS value FROM mm JOIN two USING (event_id) WHERE m BETWEEN 60 AND 120")
def zmumu_flat_sql(spark, d):
    """Two slots joined by key, with the registered SQL function and an inclusive window."""
    register(spark)
    objects(spark, d, True).createOrReplaceTempView("fx_muons")
    return spark.sql("""
        SELECT event_id, round(value, 6) AS value FROM (
          SELECT a.event_id, dimuon_mass_polar(a.pt, a.eta, a.phi, a.mass, b.pt, b.eta, b.phi, b.mass) AS value
          FROM fx_muons a JOIN fx_muons b ON a.event_id = b.event_id AND a.i = 0 AND b.i = 1 AND a.charge <> b.charge
          JOIN (SELECT event_id FROM fx_muons GROUP BY event_id HAVING count(*) = 2) t ON t.event_id = a.event_id)
        WHERE value BETWEEN 60 AND 120""")


@query(f", {_OS} SELECT event_id, round(m, 6) AS value FROM mm WHERE m > 60 AND m < 120")
def zmumu_jagged(spark, d):
    return _rounded(adl.zmumu_jagged(nested(spark, d, jets=False)))


@query(f", {_OS} SELECT event_id, round(m, 6) AS value FROM mm WHERE m > 60 AND m < 120")
def zmumu_hybrid(spark, d):
    return _rounded(adl.zmumu_hybrid(nested(spark, d, jets=False)))


@query(f", {_OS} SELECT count(*) AS n, round(avg(m), 4) AS mean FROM mm WHERE m > 60 AND m < 120")
def zmumu_metric(spark, d):
    return adl.zmumu_jagged(nested(spark, d, jets=False)).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(_TRIJET)
def trijet_sql(spark, d):
    """The trijet as joins of flat jets, with the best per event by a window."""
    jets = objects(spark, d, False).where("NOT muon")
    vector = adl.p4(F.col("pt"), F.col("eta"), F.col("phi"), F.col("mass"))
    jets.select("event_id", "i", vector.alias("v")).select("event_id", "i", "v.*").createOrReplaceTempView("fx_jets")
    return spark.sql(f"""
        WITH tri AS (SELECT a.event_id, a.i AS i, b.i AS j, c.i AS k, {_TRI} AS m, a.px + b.px + c.px AS x, a.py + b.py + c.py AS y
          FROM fx_jets a JOIN fx_jets b ON a.event_id = b.event_id AND a.i < b.i JOIN fx_jets c ON b.event_id = c.event_id AND b.i < c.i),
        best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(m - 172.5D), i, j, k) AS r FROM tri)
        SELECT event_id, round(sqrt(x * x + y * y), 6) AS value FROM best WHERE r = 1""")


def _clustered(spark, d) -> str:
    return store_clustered(spark, d, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query(_TRIJET)
def trijet_clustered(spark, d):
    """The trijet as joins of jets that are stored in buckets with their vectors: no exchange."""
    return _rounded(clustered.trijet(spark, _clustered(spark, d)))


@query(f", {_OS}, two AS (SELECT event_id FROM muons GROUP BY event_id HAVING count(*) = 2) SELECT event_id, round(m, 6) AS value FROM mm JOIN two USING (event_id) WHERE m BETWEEN 60 AND 120")
def zmumu_flat_clustered(spark, d):
    """Two slots joined to each other and to their event's count in stored buckets: no exchange."""
    return _rounded(clustered.zmumu_two(spark, _clustered(spark, d)))


@query(f", {_OS} SELECT event_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(m, 6) AS m FROM mm WHERE m > 60 AND m < 120")
def zmumu_jagged_clustered(spark, d):
    """All pairs of muons of an event, bucket by bucket."""
    return clustered.zmumu_pairs(spark, _clustered(spark, d)).select("event_id", "i", "j", F.round("value", 6).alias("m"))


@query("SELECT event_id, CAST(i AS INTEGER) AS i, round(pt, 6) AS pt FROM jets JOIN ev USING (event_id) WHERE met_pt > 60 AND event_id >= (SELECT max(event_id) // 4 FROM ev) AND event_id < (SELECT max(event_id) // 3 FROM ev)")
def clustered_range(spark, d):
    """Objects of the selected events in a range of keys, of which other row groups are skipped."""
    prefix = _clustered(spark, d)
    last = clustered.table(spark, prefix, "events").agg(F.max("event_id")).first()[0]
    found = clustered.fetch(spark, prefix, "jets", "met_pt > 60", (last // 4, last // 3), object_columns=["event_id", "i", "pt"])[1]
    return found.withColumn("pt", F.round("pt", 6))


@query("""SELECT event_id, CAST(coalesce(nj, 0) AS INTEGER) AS n_jets, CAST(coalesce(nm, 0) AS INTEGER) AS n_muons FROM ev
    LEFT JOIN (SELECT event_id, count(*) AS nj FROM jets GROUP BY 1) a USING (event_id) LEFT JOIN (SELECT event_id, count(*) AS nm FROM muons GROUP BY 1) b USING (event_id)""")
def nest_counts(spark, d):
    made = nested(spark, d)
    return made.select("event_id", F.size("jets").alias("n_jets"), F.size("muons").alias("n_muons"))


@query("SELECT event_id, CAST(i AS INTEGER) AS jet_index, round(pt, 6) AS pt, round(eta, 6) AS eta, round(phi, 6) AS phi, round(mass, 6) AS mass FROM jets")
def unnest_roundtrip(spark, d):
    """Flat objects nested by the general operator, and flattened again."""
    flat = objects(spark, d, False).select("event_id", F.col("i").alias("jet_index"), "pt", "eta", "phi", "mass")
    made = nesting.nest(events(spark, d), {"jets": flat}, {"jets": "jet_index"})
    back = nesting.unnest(made, "jets", "jet_index")
    return back.select("event_id", "jet_index", *[F.round(c, 6).alias(c) for c in ("pt", "eta", "phi", "mass")])


@query("SELECT event_id, count(*) AS n, CAST(sum(CASE WHEN charge > 0 THEN 1 ELSE -1 END) AS BIGINT) AS charge FROM muons GROUP BY event_id")
def nest_present(spark, d):
    """Only events with a muon; charge sum and multiplicity per event."""
    made = nesting.nest_present(objects(spark, d, True).select("event_id", "i", "charge"), "muons", "i")
    return made.select("event_id", F.size("muons").cast("long").alias("n"), F.aggregate("muons.charge", F.lit(0), lambda s, c: s + c).cast("long").alias("charge"))


@query("SELECT event_id, CAST(i AS INTEGER) AS muon_index, round(pt, 6) AS pt FROM muons WHERE i < 2 AND event_id IN (SELECT event_id FROM muons GROUP BY 1 HAVING count(*) >= 2)")
def wide_unpivot(spark, d):
    wide = nested(spark, d, jets=False).where(F.size("muons") >= 2)
    wide = wide.select("event_id", *[F.get("muons", F.lit(i))["pt"].alias(f"pt{i + 1}") for i in (0, 1)])
    return datasets.objects_table(wide, datasets.Wide("muons", {"pt": "pt"}, (1, 2))).withColumn("pt", F.round("pt", 6))


def _packed(spark, d, layout=WIDE):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    return orders.select("o_orderkey", layout.pack(F.floor(F.col("o_orderkey") / PER_FILE), F.col("o_orderkey") % PER_FILE).alias("event_id"))


@query("SELECT o_orderkey, (o_orderkey // 1000) * 1099511627776 + o_orderkey % 1000 AS event_id FROM orders", True)
def key_pack(spark, d):
    return _packed(spark, d)


@query("SELECT o_orderkey // 1000 AS file_id, count(*) AS n, min(o_orderkey % 1000) AS first, max(o_orderkey % 1000) AS last FROM orders GROUP BY 1", True)
def key_split_counts(spark, d):
    key = F.col("event_id")
    return _packed(spark, d).groupBy(WIDE.file_of(key).alias("file_id")).agg(F.count("*").alias("n"), F.min(WIDE.entry_of(key)).alias("first"), F.max(WIDE.entry_of(key)).alias("last"))


@query("SELECT o_orderkey, (o_orderkey // 1000) * 2147483648 + o_orderkey % 1000 AS event_id FROM orders", True)
def key_migrate(spark, d):
    """Keys of a stored table that was rewritten to another layout."""
    root, to = new_path(spark, "old"), new_path(spark, "new")
    tables.load({"events": _packed(spark, d)}, root, WIDE)
    tables.migrate(spark, root, to, ["events"], WIDE, NARROW)
    return tables.stored(spark, to, "events").select("o_orderkey", "event_id")


@query("""WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*) / 400.0) AS BIGINT) AS m, max(o_orderkey) AS last FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders),
    c AS (SELECT i, o_orderkey AS first, last FROM n, range((SELECT m FROM n)) t(i), r WHERE n > 400 AND r.p = i * n // m) SELECT first, coalesce(lead(first) OVER (ORDER BY i), last + 1) AS stop FROM c""", True)
def event_ranges(spark, d):
    """Ranges of 400 events at most, of equal numbers, over all files, as starts and stops in order keys."""
    made = tables.event_ranges(_packed(spark, d), 400) or []
    plain = lambda k: WIDE.split(k)[0] * PER_FILE + WIDE.split(k)[1]
    return spark.createDataFrame([(plain(a), plain(b)) for a, b in made], "first long, stop long")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'part' || (o_orderkey // 3) END AS shard FROM orders", True)
def interval_lookup(spark, d):
    """The owner of each key, of as many intervals as a third of the keys, with gaps between them."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    last = orders.agg(F.coalesce(F.max("o_orderkey"), F.lit(-1))).first()[0]
    parts = spark.range(last // 3 + 1).select(F.concat(F.lit("part"), F.col("id")).alias("name"), (3 * F.col("id")).alias("start"), (3 * F.col("id") + 2).alias("stop"))
    return owners(orders, "o_orderkey", parts, "shard")


@query("SELECT CASE WHEN o_orderkey // 1000 < 4 THEN 'shard0' ELSE 'shard1' END AS shard, count(*) AS n FROM orders GROUP BY 1", True)
def verify_shards(spark, d):
    return tables.misplaced(_packed(spark, d), ShardMap([("shard0", 0, 4), ("shard1", 4, None)]), WIDE).select("shard", "n")


@query("SELECT event_id, CAST(i AS INTEGER) AS i FROM jets WHERE event_id NOT IN (SELECT event_id FROM ev WHERE event_id % 7 <> 0)")
def verify_orphans(spark, d):
    """Jets whose event is missing once every seventh event is gone."""
    return nesting.orphans(events(spark, d).where("event_id % 7 <> 0"), objects(spark, d, False)).select("event_id", "i")


@query("SELECT event_id, CAST(i AS INTEGER) AS i, round(m.pt, 6) AS pt FROM muons m JOIN ev USING (event_id) WHERE met_pt BETWEEN 60 AND 120")
def where_pushdown(spark, d):
    _, found = nesting.fetch(events(spark, d), objects(spark, d, True), "events.met_pt BETWEEN 60 AND 120", object_columns=["event_id", "i", "pt"])
    return found.withColumn("pt", F.round("pt", 6))


@query("SELECT event_id, count(*) AS n FROM jets WHERE event_id >= 100 AND event_id < 900 GROUP BY 1")
def key_range_fetch(spark, d):
    _, found = nesting.fetch(events(spark, d), objects(spark, d, False), keys=(100, 900))
    return found.groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM jets GROUP BY event_id HAVING count(*) >= 3 INTERSECT SELECT event_id FROM muons GROUP BY event_id HAVING count(*) >= 2")
def stored_multiplicity(spark, d):
    made = nested(spark, d).withColumns({"n_jets": F.size("jets"), "n_muons": F.size("muons")})
    return made.where("n_jets >= 3 AND n_muons >= 2").select("event_id")


_FLAG = "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderstatus = 'F' END"


@query(f"SELECT CASE WHEN flag IS NULL THEN 'null' WHEN flag THEN 'true' ELSE 'false' END AS flag, count(*) AS n FROM (SELECT {_FLAG} AS flag FROM orders) GROUP BY 1", True)
def null_flags(spark, d):
    flag = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderstatus") == "F")
    made = spark.read.parquet(f"{d}/orders.parquet").select(flag.alias("flag"))
    said = F.when(F.col("flag").isNull(), "null").when(F.col("flag"), "true").otherwise("false")
    return made.groupBy(said.alias("flag")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_nonfinite, round(avg(met_pt), 6) AS mean, round(stddev_pop(met_pt), 6) AS std, round(min(met_pt), 6) AS q0,
    round(quantile_cont(met_pt, 0.25), 6) AS q25, round(quantile_cont(met_pt, 0.5), 6) AS q50, round(quantile_cont(met_pt, 0.75), 6) AS q75, round(max(met_pt), 6) AS q100 FROM ev""")
def summary_stats(spark, d):
    made = statistics.summary(events(spark, d), "met_pt")
    return made.select("n", "n_nonfinite", *[F.round(c, 6).alias(c) for c in made.columns[2:]])


_QUARTILES = ", ".join(f"round(quantile_cont(v, {q}), 6) AS q{int(100 * q)}" for q in (0, 0.25, 0.5, 0.75, 1))


@query(f"""SELECT charge, "column", count(*) AS n, CAST(0 AS BIGINT) AS n_nonfinite, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, {_QUARTILES}
    FROM (SELECT charge, 'pt' AS "column", pt AS v FROM jets UNION ALL SELECT charge, 'phi', phi FROM jets) GROUP BY 1, 2""")
def grouped_quantiles(spark, d):
    """Summaries of two columns in each group, with exact quantiles."""
    made = statistics.summaries(objects(spark, d, False), ["pt", "phi"], ["charge"])
    return made.select("charge", "column", "n", "n_nonfinite", *[F.round(c, 6).alias(c) for c in made.columns[4:]])


@query("SELECT CAST(least(floor(met_pt / 25), 19) AS INTEGER) AS bin, count(*) AS n FROM ev WHERE met_pt BETWEEN 0 AND 500 GROUP BY 1")
def histogram(spark, d):
    return statistics.histogram(events(spark, d), "met_pt", 20, 0.0, 500.0)


@query(""", n AS (SELECT event_id, count(i) AS n FROM ev LEFT JOIN jets USING (event_id) GROUP BY event_id)
    SELECT n.event_id, CAST(s AS INTEGER) AS slot, CAST(n.n AS INTEGER) AS count, s < n.n AS is_real, round(coalesce(j.pt, 0), 6) AS pt
    FROM n JOIN range((SELECT max(n) FROM n)) t(s) ON TRUE LEFT JOIN jets j ON j.event_id = n.event_id AND j.i = s""")
def dense_pad(spark, d):
    """As many jet slots as the largest event has, padded with 0, which are real, and how many."""
    made = nesting.tensor(nested(spark, d, muons=False), "jets", ["pt"])
    out = made.select("event_id", "count", F.posexplode(F.arrays_zip("mask", "x")).alias("slot", "o"))
    return out.select("event_id", "slot", "count", F.col("o.mask").alias("is_real"), F.round(F.col("o.x")["pt"], 6).alias("pt"))


@query("SELECT event_id, CAST(i AS INTEGER) AS i, round((pt - (SELECT avg(pt) FROM jets)) / (SELECT stddev_pop(pt) FROM jets), 5) AS pt FROM jets")
def standardise(spark, d):
    return nesting.standardised(objects(spark, d, False).select("event_id", "i", "pt"), ["pt"]).withColumn("pt", F.round("pt", 5))


@query(f"""SELECT a.event_id, round({_PAIR}, 6) AS m2, round(sqrt(power(a.px + b.px + c.px, 2) + power(a.py + b.py + c.py, 2)), 6) AS pt3, round({_TRI}, 6) AS m3
    FROM jets a JOIN jets b ON a.event_id = b.event_id AND a.i = 0 AND b.i = 1 JOIN jets c ON c.event_id = a.event_id AND c.i = 2""")
def standard_fns(spark, d):
    """The registered SQL functions on the first three jets."""
    register(spark)
    nested(spark, d, muons=False).where(F.size("jets") >= 3).createOrReplaceTempView("fx_nested")
    return spark.sql("""
        SELECT event_id, round(dimuon_mass_polar(a.pt, a.eta, a.phi, a.mass, b.pt, b.eta, b.phi, b.mass), 6) AS m2,
               round(trijet_pt(a.pt, a.phi, b.pt, b.phi, c.pt, c.phi), 6) AS pt3,
               round(trijet_mass(a.pt, a.eta, a.phi, a.mass, b.pt, b.eta, b.phi, b.mass, c.pt, c.eta, c.phi, c.mass), 6) AS m3
        FROM (SELECT event_id, jets[0] AS a, jets[1] AS b, jets[2] AS c FROM fx_nested)""")


@query("SELECT event_id + k * 1000000 AS event_id, round(met_pt, 6) AS met_pt FROM ev CROSS JOIN range(3) t(k)")
def tile_scale(spark, d):
    return nesting.tiled(events(spark, d), 3, 1_000_000).select("event_id", F.round("met_pt", 6).alias("met_pt"))


@query("SELECT count(DISTINCT event_id) AS n, min(event_id) AS first, max(event_id) AS last FROM jets")
def distinct_events(spark, d):
    return objects(spark, d, False).agg(F.count_distinct("event_id").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT CAST(least(floor(met_pt / 100), 9) AS INTEGER) AS bin, count(*) AS n FROM ev WHERE met_pt BETWEEN 0 AND 1000 GROUP BY 1")
def merge_partials(spark, d):
    """Histograms of three parts, put together."""
    parts = [statistics.histogram(events(spark, d).where(F.col("event_id") % 3 == k), "met_pt", 10, 0.0, 1000.0) for k in range(3)]
    return statistics.combined([None, *parts], ["bin"])


@query(f""", {_OS}, z AS (SELECT event_id, m FROM mm WHERE m > 60 AND m < 120) SELECT count(*) AS n, CAST(sum(CASE WHEN m > 90 THEN 1 ELSE 0 END) AS BIGINT) AS above FROM (SELECT * FROM z)""")
def count_sum(spark, d):
    """Count and sum over a query's rows."""
    found = adl.zmumu_jagged(nested(spark, d, jets=False))
    return found.agg(F.count("*").alias("n"), F.sum(F.when(F.col("value") > 90, 1).otherwise(0)).alias("above"))


@query(f", {_OS} SELECT event_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(m, 6) AS m FROM mm WHERE m > 60 AND m < 120")
def zmumu_jagged_sql(spark, d):
    """All pairs as a join of flat muons, whose Cartesian components are made once."""
    register(spark)
    muons = objects(spark, d, True).select("event_id", "i", "charge", p4(*[F.col(c) for c in ("pt", "eta", "phi", "mass")]).alias("v"))
    muons.select("event_id", "i", "charge", "v.*").createOrReplaceTempView("fx_cartesian")
    return spark.sql("""
        SELECT event_id, i, j, round(m, 6) AS m FROM (
          SELECT a.event_id, a.i, b.i AS j, dimuon_mass(a.e, a.px, a.py, a.pz, b.e, b.px, b.py, b.pz) AS m
          FROM fx_cartesian a JOIN fx_cartesian b ON a.event_id = b.event_id AND a.i < b.i AND a.charge <> b.charge)
        WHERE m > 60 AND m < 120""")


_ROUTES = f""", {_OS}, z AS (SELECT event_id, m FROM mm WHERE m > 60 AND m < 120), r AS (SELECT count(*) AS n, round(avg(m), 4) AS mean FROM z)"""


@query(_ROUTES + " SELECT route, n, mean FROM r, (VALUES ('expressions'), ('filtered'), ('joins')) t(route)")
def routes_agree(spark, d):
    """The same selection by three routes: number and mean of each."""
    both = nested(spark, d, jets=False)
    routes = {"expressions": adl.zmumu_jagged(both), "filtered": adl.zmumu_hybrid(both), "joins": zmumu_jagged_sql(spark, d).select(F.col("m").alias("value"))}
    return statistics.combined([statistics.metric(df).select(F.lit(name).alias("route"), "n", F.round("mean", 4).alias("mean")) for name, df in routes.items()])


@query("""SELECT 'q1' AS query, count(*) AS n, round(avg(met_pt), 4) AS mean FROM ev UNION ALL SELECT 'q2', count(*), round(avg(pt), 4) FROM jets UNION ALL SELECT 'q3', count(*), round(avg(pt), 4) FROM jets WHERE abs(eta) < 1
    UNION ALL SELECT 'q4', count(*), round(avg(met_pt), 4) FROM ev WHERE event_id IN (SELECT event_id FROM jets WHERE pt > 40 GROUP BY event_id HAVING count(*) >= 2)""")
def run_all_metrics(spark, d):
    """Number and mean of the first four of all benchmark queries, as the registry runs them."""
    found = adl.run_all(nested(spark, d))
    return statistics.combined([statistics.metric(found[q]).select(F.lit(q).alias("query"), "n", F.round("mean", 4).alias("mean")) for q in ("q1", "q2", "q3", "q4")])


@query("SELECT event_id FROM ev WHERE event_id NOT IN (SELECT event_id FROM muons WHERE NOT pt > 15)")
def forall_muons(spark, d):
    """Events all of whose muons, which may be none, are above a cut."""
    return nested(spark, d, jets=False).where(lists.all_(F.col("muons"), lambda m: m["pt"] > 15)).select("event_id")


@query("""SELECT event_id, round(sum(px), 4) AS px, round(sum(e), 4) AS e, round(sqrt(greatest(sum(e) * sum(e) - sum(px) * sum(px) - sum(py) * sum(py) - sum(pz) * sum(pz), CAST(0 AS DOUBLE))), 3) AS mass
    FROM jets GROUP BY event_id HAVING count(*) >= 2""")
def sum_of_vectors(spark, d):
    """The sum of all jets of an event."""
    vectors = F.transform("jets", lambda o: p4(o["pt"], o["eta"], o["phi"], o["mass"]))
    made = nested(spark, d, muons=False).where(F.size("jets") >= 2).select("event_id", total_of(vectors).alias("v"))
    return made.select("event_id", F.round("v.px", 4).alias("px"), F.round("v.e", 4).alias("e"), F.round(mass(F.col("v")), 3).alias("mass"))


def _lists(spark, d, *fields: str):
    return nested(spark, d, muons=False).select("event_id", *[F.col(f"jets.{f}").alias(f) for f in fields])


@query("""SELECT event_id, CAST(count(pt) AS INTEGER) AS n, CAST(count(CASE WHEN eta <> 0 THEN 1 END) AS INTEGER) AS nonzero, round(coalesce(sum(pt), 0), 6) AS sum, round(coalesce(product(pt), 1), 3) AS prod, round(avg(pt), 6) AS mean,
    round(avg(pt * pt), 6) AS square, round(var_pop(pt), 6) AS var, round(stddev_pop(pt), 5) AS std, min(pt) AS min, max(pt) AS max, max(pt) - min(pt) AS ptp,
    coalesce(bool_and(pt > 10), TRUE) AS all_above, coalesce(bool_or(pt > 45), FALSE) AS any_above FROM ev LEFT JOIN jets USING (event_id) GROUP BY event_id""")
def list_reductions(spark, d):
    pt = F.col("pt")
    made = {
        "n": lists.count(pt), "nonzero": lists.count_nonzero(F.col("eta")), "sum": F.round(lists.sum_(pt), 6), "prod": F.round(lists.prod(pt), 3), "mean": F.round(lists.mean(pt), 6), "square": F.round(lists.moment(pt, 2), 6),
        "var": F.round(lists.var(pt), 6), "std": F.round(lists.std(pt), 5), "min": F.array_min(pt), "max": F.array_max(pt), "ptp": lists.ptp(pt), "all_above": lists.all_(pt, lambda x: x > 10), "any_above": lists.any_(pt, lambda x: x > 45),
    }
    return _lists(spark, d, "pt", "eta").select("event_id", *[c.alias(k) for k, c in made.items()])


@query("""SELECT event_id, round(median(pt), 6) AS median, round(quantile_cont(pt, 0.25), 6) AS q25, round(quantile_cont(pt, 0.9), 6) AS q90, CAST(count(*) FILTER (pt < 25) AS INTEGER) AS below, CAST(count(*) FILTER (pt <= 25) AS INTEGER) AS upto
    FROM ev LEFT JOIN jets USING (event_id) GROUP BY event_id""")
def list_quantiles(spark, d):
    """Median and quantiles of each list, and where a number would go in it."""
    pt = F.col("pt")
    made = {"median": F.round(lists.median(pt), 6), "q25": F.round(lists.quantile(pt, 0.25), 6), "q90": F.round(lists.quantile(pt, 0.9), 6), "below": lists.searchsorted(lists.sort(pt), F.lit(25.0)), "upto": lists.searchsorted(lists.sort(pt), F.lit(25.0), right=True)}
    return _lists(spark, d, "pt").select("event_id", *[c.alias(k) for k, c in made.items()])


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY pt, i) - 1 AS INTEGER) AS rank, CAST(i AS INTEGER) AS place, pt,
    CAST(first_value(i) OVER (PARTITION BY event_id ORDER BY pt, i) AS INTEGER) AS least, CAST(first_value(i) OVER (PARTITION BY event_id ORDER BY pt DESC, i) AS INTEGER) AS largest FROM jets""")
def list_order(spark, d):
    """Sorting, its places, and those of the extremes."""
    made = _lists(spark, d, "pt").select("event_id", lists.argmin(F.col("pt")).alias("least"), lists.argmax(F.col("pt")).alias("largest"), F.arrays_zip(lists.argsort(F.col("pt")).alias("place"), lists.sort(F.col("pt")).alias("pt")).alias("z"))
    return made.select("event_id", "least", "largest", F.posexplode("z").alias("rank", "o")).select("event_id", "rank", "o.place", "o.pt", "least", "largest")


@query("SELECT event_id, CAST(j.i AS INTEGER) AS jet, CAST(m.i AS INTEGER) AS muon, round(j.pt * m.pt, 6) AS pt2 FROM jets j JOIN muons m USING (event_id)")
def list_cartesian(spark, d):
    both = nested(spark, d).select("event_id", F.arrays_zip(lists.argcartesian(F.col("jets"), F.col("muons")).alias("at"), lists.cartesian(F.col("jets"), F.col("muons"), lambda j, m: j["pt"] * m["pt"]).alias("pt2")).alias("z"))
    return both.select("event_id", F.explode("z").alias("z")).select("event_id", F.col("z.at.0").alias("jet"), F.col("z.at.1").alias("muon"), F.round("z.pt2", 6).alias("pt2"))


@query("SELECT a.event_id, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, CAST(c.i AS INTEGER) AS k, c.pt AS third FROM jets a JOIN jets b ON a.event_id = b.event_id AND a.i < b.i JOIN jets c ON b.event_id = c.event_id AND b.i < c.i")
def list_combinations(spark, d):
    pt = F.col("pt")
    made = _lists(spark, d, "pt").select("event_id", F.explode(F.arrays_zip(lists.argcombinations(pt, 3).alias("at"), lists.combinations(pt, 3).alias("x"))).alias("z"))
    return made.select("event_id", F.col("z.at.0").alias("i"), F.col("z.at.1").alias("j"), F.col("z.at.2").alias("k"), F.col("z.x.2").alias("third"))


@query(""", ch AS (SELECT *, CASE WHEN charge = lag(charge) OVER (PARTITION BY event_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM jets), r AS (SELECT *, sum(new) OVER (PARTITION BY event_id ORDER BY i) - 1 AS run FROM ch)
    SELECT event_id, CAST(run AS INTEGER) AS run, CAST(count(*) AS INTEGER) AS length, round(sum(pt), 6) AS pt FROM r GROUP BY event_id, run""")
def list_runs(spark, d):
    """Runs of equal charge: their lengths, and the list cut into them."""
    made = _lists(spark, d, "pt", "charge").withColumn("n", lists.run_lengths(F.col("charge")))
    each = F.arrays_zip(F.col("n"), lists.unflatten(F.col("pt"), F.col("n")).alias("part"))
    return made.select("event_id", F.posexplode(each).alias("run", "o")).select("event_id", "run", F.col("o.n").alias("length"), F.round(lists.sum_(F.col("o.part")), 6).alias("pt"))


@query("""SELECT event_id, CAST(i AS INTEGER) AS i, round(sum(pt) OVER (PARTITION BY event_id ORDER BY i), 6) AS cumsum, round(pt - lag(pt) OVER (PARTITION BY event_id ORDER BY i), 6) AS diff, CASE WHEN charge > 0 THEN pt ELSE -pt END AS signed FROM jets""")
def list_cumulative(spark, d):
    pt = F.col("pt")
    parts = F.arrays_zip(lists.cumsum(pt).alias("cumsum"), F.concat(F.array(F.lit(None).cast("double")), lists.diff(pt)).alias("diff"), lists.where(F.transform("charge", lambda c: c > 0), pt, F.transform(pt, lambda x: -x)).alias("signed"))
    made = _lists(spark, d, "pt", "charge").where(F.size("pt") > 0).select("event_id", F.posexplode(parts).alias("i", "o"))
    return made.select("event_id", "i", F.round("o.cumsum", 6).alias("cumsum"), F.round("o.diff", 6).alias("diff"), "o.signed")


@query(""", x AS (SELECT event_id, i, CASE WHEN pt > 40 THEN NULL ELSE pt END AS x FROM jets)
    SELECT event_id, CAST(count(x) AS INTEGER) AS kept, round(coalesce(sum(coalesce(x, -1)) FILTER (i IS NOT NULL), 0), 6) AS filled, max(x) FILTER (i = 0) AS first, CAST(greatest(count(i), 4) AS INTEGER) AS padded, CAST(count(DISTINCT x) AS INTEGER) AS distinct,
    CAST(CASE WHEN max(x) FILTER (i = 0) IS NULL THEN 0 ELSE 1 END AS INTEGER) AS single, round(coalesce(sum(x), 0), 6) AS sum FROM ev LEFT JOIN x USING (event_id) GROUP BY event_id""")
def list_missing(spark, d):
    """Elements that are null: dropped, filled, padded, passed over."""
    x = F.col("x")
    made = _lists(spark, d, "pt").select("event_id", F.transform("pt", lambda v: F.when(v <= 40, v)).alias("x"))
    return made.select(
        "event_id", F.size(lists.there(x)).alias("kept"), F.round(lists.sum_(lists.fill_none(x, F.lit(-1.0))), 6).alias("filled"), lists.firsts(x).alias("first"), F.size(lists.pad_none(x, 4)).alias("padded"),
        F.size(lists.unique(lists.there(x))).alias("distinct"), F.size(lists.singletons(lists.firsts(x))).alias("single"), F.round(lists.sum_(x), 6).alias("sum"),
    )


@query("""SELECT event_id, least(greatest(met_pt, 50), 200) AS clipped, CAST(floor(met_pt) AS BIGINT) AS floor, CAST(ceil(met_pt) AS BIGINT) AS ceil, round(sqrt(met_pt * met_pt + met_phi * met_phi), 6) AS hypot, round(atan2(met_phi, met_pt), 6) AS angle,
    round(ln(1 + met_pt), 6) AS log1p, CAST(sign(met_phi) AS DOUBLE) AS sign, round(met_pt - 7 * floor(met_pt / 7), 6) AS mod, round(degrees(met_phi), 6) AS degrees, round(cbrt(met_pt), 6) AS cbrt,
    CAST((met_pt >= 20) AS INTEGER) + CAST((met_pt >= 100) AS INTEGER) + CAST((met_pt >= 250) AS INTEGER) AS bin, CASE WHEN met_pt > 300 THEN CAST(0 AS DOUBLE) ELSE met_pt END AS without_nan, CAST(met_pt AS FLOAT) AS target FROM ev""")
def array_math(spark, d):
    """Elementary functions, rounding, clipping, binning and NaN handling, element by element."""
    pt, phi = F.col("met_pt"), F.col("met_phi")
    with_nan = F.when(pt > 300, F.lit(float("nan"))).otherwise(pt)
    return events(spark, d).select(
        "event_id", lists.clip(pt, 50.0, 200.0).alias("clipped"), F.floor(pt).alias("floor"), F.ceil(pt).alias("ceil"), F.round(F.hypot(pt, phi), 6).alias("hypot"), F.round(F.atan2(phi, pt), 6).alias("angle"), F.round(F.log1p(pt), 6).alias("log1p"),
        F.signum(phi).alias("sign"), F.round(F.pmod(pt, F.lit(7.0)), 6).alias("mod"), F.round(F.degrees(phi), 6).alias("degrees"), F.round(F.cbrt(pt), 6).alias("cbrt"), lists.digitize(pt, [20, 100, 250]).alias("bin"),
        lists.nan_to_num(with_nan).alias("without_nan"), pt.cast("float").alias("target"),
    )


@query("SELECT event_id, CAST(k AS INTEGER) AS k, round(met_pt * k / 8, 8) AS x, CAST(k % 3 = 0 AS BOOLEAN) AS third FROM ev CROSS JOIN range(9) t(k)")
def array_builders(spark, d):
    """Evenly spaced numbers up to each event's MET."""
    grid = F.transform(lists.linspace(0.0, 1.0, 9), lambda x, k: F.struct(k.alias("k"), x.alias("x")))
    made = events(spark, d).select("event_id", "met_pt", F.explode(grid).alias("g"))
    return made.select("event_id", "g.k", F.round(F.col("met_pt") * F.col("g.x"), 8).alias("x"), (F.pmod("g.k", F.lit(3)) == 0).alias("third"))


@query("SELECT o_orderkey, (8192 + o_orderkey // 1000) * 1099511627776 + o_orderkey % 1000 AS event_id, 8192 + o_orderkey // 1000 AS file_id, o_orderkey % 1000 AS entry FROM orders", True)
def key_pack_large(spark, d):
    """Keys from 2^53 up, which doubles could not hold."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    made = orders.withColumn("event_id", WIDE.pack(F.floor(F.col("o_orderkey") / PER_FILE) + 8192, F.col("o_orderkey") % PER_FILE))
    return made.withColumns({"file_id": WIDE.file_of(F.col("event_id")), "entry": WIDE.entry_of(F.col("event_id"))})


_NANO = datasets.Dataset(
    "fixture", {"met_pt": "MET_pt"}, (datasets.Jagged("jets", {"pt": "Jet_pt", "eta": "Jet_eta"}, "Jet_pt"), datasets.Jagged("muons", {"pt": "Muon_pt"}, "Muon_pt")),
    flags={"hlt": "HLT_none"}, counts={"n_jets": "jets", "n_muons": "muons"}, constants={"version": 9},
)


def _nano(spark, d):
    """The nested fixture in a source layout of parallel lists."""
    made = nested(spark, d)
    key = WIDE.pack(F.floor(F.col("event_id") / PER_FILE), F.col("event_id") % PER_FILE)
    return made.select(key.alias("event_id"), F.col("met_pt").alias("MET_pt"), F.col("jets.pt").alias("Jet_pt"), F.col("jets.eta").alias("Jet_eta"), F.col("muons.pt").alias("Muon_pt"))


_KEY = "(event_id // 1000) * 1099511627776 + event_id % 1000"


@query(f"""SELECT {_KEY} AS event_id, round(met_pt, 6) AS met_pt, CAST(NULL AS BOOLEAN) AS hlt, CAST(coalesce(nj, 0) AS INTEGER) AS n_jets, CAST(coalesce(nm, 0) AS INTEGER) AS n_muons, 9 AS version FROM ev
    LEFT JOIN (SELECT event_id, count(*) AS nj FROM jets GROUP BY 1) a USING (event_id) LEFT JOIN (SELECT event_id, count(*) AS nm FROM muons GROUP BY 1) b USING (event_id)""")
def source_events(spark, d):
    """The events table of a source of parallel lists; a flag that it lacks is null."""
    return datasets.events_table(_nano(spark, d), _NANO).withColumn("met_pt", F.round("met_pt", 6))


@query(f"SELECT {_KEY} AS event_id, CAST(i AS INTEGER) AS jet_index, round(pt, 6) AS pt, round(eta, 6) AS eta FROM jets")
def source_jets(spark, d):
    made = datasets.tables(_nano(spark, d), _NANO)["jets"]
    return made.withColumns({c: F.round(c, 6) for c in ("pt", "eta")})


@query(f"SELECT {_KEY} AS event_id, CAST(i AS INTEGER) AS jet_index, round(pt, 6) AS pt, round(eta, 6) AS eta FROM jets")
def root_jets(spark, d):
    """The jets of trees that were written to ROOT files and read back."""
    path = new_path(spark, "trees")
    root.write_root(_nano(spark, d), path, cluster=1000)
    rows = root.read_root(spark, path, columns=["event_id", "Jet_pt", "Jet_eta"], entries=4000)
    return datasets.objects_table(rows, _NANO.collections[0]).withColumns({c: F.round(c, 6) for c in ("pt", "eta")})


@query(f"""SELECT {_KEY} AS event_id, round(met_pt + CASE WHEN event_id // 1000 = 2 AND event_id % 1000 BETWEEN 100 AND 599 THEN 1 ELSE 0 END, 6) AS met_pt, CAST(count(i) AS BIGINT) AS n
    FROM ev LEFT JOIN (SELECT * FROM muons WHERE NOT (event_id // 1000 = 2 AND event_id % 1000 BETWEEN 100 AND 599)) USING (event_id) GROUP BY ALL""")
def replace_range(spark, d):
    """Stored tables in which a range of one file's entries was replaced by rows of another MET and without muons."""
    made, root = datasets.tables(written(_nano(spark, d), "nano"), _NANO), new_path(spark, "replaced")
    tables.load(made, root, WIDE)
    mine = (WIDE.file_of(F.col("event_id")) == 2) & WIDE.entry_of(F.col("event_id")).between(100, 599)
    again = {"events": made["events"].where(mine).withColumn("met_pt", F.col("met_pt") + 1), "jets": made["jets"].where(mine), "muons": made["muons"].where(F.lit(False))}
    for _ in range(2):  # a second time changes nothing
        tables.load(again, root, WIDE, ranges={2: (100, 600)})
    n = tables.stored(spark, root, "muons").groupBy("event_id").agg(F.count("*").alias("n"))
    return tables.stored(spark, root, "events").join(n, "event_id", "left").select("event_id", F.round("met_pt", 6).alias("met_pt"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH f AS (SELECT o_orderkey // 1000 AS file_id, count(*) AS rows FROM orders GROUP BY 1), j AS (SELECT l_orderkey // 1000 AS file_id, count(*) AS jets FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
    SELECT file_id, 'ok' AS status, rows, jets FROM f LEFT JOIN j USING (file_id) UNION ALL SELECT max(file_id) + 1, 'failed', NULL, NULL FROM f""", True)
def ingest_log(spark, d):
    """Many source files and one that is not there, loaded as one record: what became of each, and how many jets are stored."""
    source, root = new_path(spark, "source"), new_path(spark, "record")
    rows = _nano(spark, d).withColumn("file", WIDE.file_of(F.col("event_id")))
    rows.repartition("file").sortWithinPartitions("file", "event_id").drop("event_id").write.partitionBy("file").parquet(source)
    files = sorted(int(n.removeprefix("file=")) for n in children(spark, source) if n.startswith("file="))
    listed = Manifest(WIDE, [{"path": f"{source}/file={i}", "file_id": i} for i in [*files, files[-1] + 1]])
    told = record.ingest_record(spark, listed, _NANO, root, retries=0)
    jets = tables.stored(spark, root, "jets").groupBy("file_id").agg(F.count("*").alias("jets"))
    return told.join(jets, "file_id", "left").select("file_id", "status", "rows", "jets")


@query("""SELECT version, count(*) AS n, round(sum(met_pt + CASE WHEN version = 2 AND event_id // 1000 = 1 THEN 10 ELSE 0 END), 3) AS met FROM ev CROSS JOIN (VALUES (1), (2)) t(version) WHERE version = 1 OR event_id // 1000 <> 2 GROUP BY version""")
def stored_versions(spark, d):
    """Two versions of a stored table, the second with a file's rows replaced and those of another gone; both can be read."""
    made, root, file = datasets.events_table(written(_nano(spark, d), "nano"), _NANO), new_path(spark, "versions"), WIDE.file_of(F.col("event_id"))
    tables.load({"events": made}, root, WIDE)
    tables.load({"events": made.where(file == 1).withColumn("met_pt", F.col("met_pt") + 10)}, root, WIDE, ranges={1: (0, None), 2: (0, None)})
    both = [tables.stored(spark, root, "events", at=v).select(F.lit(v).alias("version"), "met_pt") for v in (1, 2)]
    return both[0].unionByName(both[1]).groupBy("version").agg(F.count("*").alias("n"), F.round(F.sum("met_pt"), 3).alias("met"))


@query(f"""SELECT {_KEY} AS event_id, CAST(count(j.i) AS INTEGER) AS n_jets, CASE WHEN event_id // 1000 < 4 THEN 'shard0' ELSE 'shard1' END AS shard FROM ev LEFT JOIN jets j USING (event_id) WHERE met_pt > 100 GROUP BY event_id""")
def shard_fetch(spark, d):
    """Selected events over a shard map, fetched in one query."""
    root, split = new_path(spark, "shards"), ShardMap([("shard0", 0, 4), ("shard1", 4, None)])
    made = datasets.tables(written(_nano(spark, d), "nano"), _NANO)
    at = split.column(WIDE.file_of(F.col("event_id")))
    for name in ("shard0", "shard1"):
        tables.load({n: df.where(at == name) for n, df in made.items()}, f"{root}/{name}", WIDE)
    found = shards.fetch(spark, root, split, "met_pt > 100", ["jets"])
    return found.select("event_id", F.size("jets").alias("n_jets"), split.column(WIDE.file_of(F.col("event_id"))).alias("shard"))


@query("""SELECT CASE WHEN event_id // 1000 < 4 THEN 'shard0' ELSE 'shard1' END AS shard, count(*) AS n, round(sum(met_pt), 3) AS met FROM ev GROUP BY 1""")
def shard_map_reduce(spark, d):
    """A function of each shard's events, run next to them, and the results put together."""
    root, split = new_path(spark, "shards"), ShardMap([("shard0", 0, 4), ("shard1", 4, None)])
    made = {"events": datasets.events_table(written(_nano(spark, d), "nano"), _NANO)}
    at = split.column(WIDE.file_of(F.col("event_id")))
    for name in ("shard0", "shard1"):
        tables.load({n: df.where(at == name) for n, df in made.items()}, f"{root}/{name}", WIDE)
    found = shards.map_events(spark, root, split, lambda e: {"n": len(e), "met": sum(e.column("met_pt").to_pylist())}, collections=())
    value = lambda name, c: F.max(F.when(F.col("path")[0] == name, F.col(c)))
    return found.groupBy("shard").agg(value("n", "whole").alias("n"), F.round(value("met", "number"), 3).alias("met"))


@query("""SELECT 'same' AS pair, count(*) = 0 AS equal FROM (SELECT round(pt, 6) AS v FROM jets EXCEPT ALL SELECT round(pt, 6) FROM jets)
    UNION ALL SELECT 'one moved', count(*) = 0 FROM (SELECT round(met_pt, 6) AS v FROM ev EXCEPT ALL SELECT round(met_pt + CASE WHEN event_id = (SELECT min(event_id) FROM ev) THEN 1 ELSE 0 END, 6) FROM ev)
    UNION ALL SELECT 'one infinite', count(*) = 0 FROM (SELECT met_pt AS v FROM ev EXCEPT ALL SELECT CASE WHEN event_id = (SELECT min(event_id) FROM ev) THEN CAST('inf' AS DOUBLE) ELSE met_pt END FROM ev)
    UNION ALL SELECT 'one missing', count(*) = 0 FROM (SELECT met_pt AS v FROM ev EXCEPT ALL SELECT CASE WHEN event_id = (SELECT min(event_id) FROM ev) THEN NULL ELSE met_pt END FROM ev)""")
def compare_multisets(spark, d):
    """Whether answers agree: with themselves, with one value moved, infinite, or null."""
    values = events(spark, d).select("event_id", F.col("met_pt").alias("value"))
    first = F.col("event_id") == values.agg(F.min("event_id")).first()[0]
    changed = lambda v: values.select(F.when(first, v).otherwise(F.col("value")).alias("value"))
    pt, met = objects(spark, d, False).select(F.col("pt").alias("value")), values.select("value")
    pairs = {"same": (pt, pt), "one moved": (met, changed(F.col("value") + 1)), "one infinite": (met, changed(F.lit(float("inf")))), "one missing": (met, changed(F.lit(None)))}
    return spark.createDataFrame([(name, compare(*two)[0]) for name, two in pairs.items()], "pair string, equal boolean")
