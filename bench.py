"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of median seconds.

``queries`` are timed from the given tables, with all that it takes to nest them. ``stored`` are those over
nested events, timed over a bucketed table of them that was written before (``prepare``), and those over clustered flat tables. ``slope`` is
microseconds for each further event, from a tenth of the size to the whole, so without fixed cost.
"""

import json
import os
import tempfile

os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession

from nestfold.operators import clustered
from nestfold.operators.tables import store_nested
from nestfold.plans import adl
from nestfold.plans.fixture import nested, store_clustered
from nestfold.plans.queries import QUERIES
from nestfold.tools.timing import drain, timed

NAMES = ("q1", "q2", "q3", "q4", "q5", "q6", "q7", "q8", "zmumu_flat", "zmumu_jagged", "zmumu_metric", "trijet_sql")
STORED = {**adl.QUERIES, "zmumu_flat": adl.zmumu_flat, "zmumu_jagged": adl.zmumu_jagged, "zmumu_hybrid": adl.zmumu_hybrid}


def measured(spark: SparkSession, folder: str, cpus: int) -> dict:
    took = {name: round(timed(lambda name=name: drain(QUERIES[name](spark, folder)), 3, 2).median, 3) for name in NAMES}
    prepare = timed(lambda: store_nested(nested(spark, folder), "bench_nested", cpus), 1, 0)
    table = spark.table("bench_nested")
    stored = {name: round(timed(lambda f=f: drain(f(table)), 3, 2).median, 3) for name, f in STORED.items()}
    store_clustered(spark, folder, cpus, "bench")
    flat = {f"{name}_clustered": f for name, f in (("trijet", clustered.trijet), ("zmumu_flat", clustered.zmumu_two), ("zmumu_jagged", clustered.zmumu_pairs))}
    stored |= {name: round(timed(lambda f=f: drain(f(spark, "bench")), 3, 2).median, 3) for name, f in flat.items()}
    return {"queries": took, "stored": stored, "prepare": round(prepare.median, 3), "events": table.count()}


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/"), os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as warehouse:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.warehouse.dir", warehouse)
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        size = os.path.basename(folder).removeprefix("sf")
        small = f"{os.path.dirname(folder)}/sf{float(size) / 10:g}"
        less = measured(spark, small, int(cpus)) if os.path.isdir(small) else None
        out = measured(spark, folder, int(cpus))
        if less:
            slope = lambda kind: {q: round(1e6 * (s - less[kind][q]) / (out["events"] - less["events"]), 2) for q, s in out[kind].items()}
            out |= {"slope": slope("queries"), "stored_slope": slope("stored"), "small": {"sf": f"{float(size) / 10:g}", "events": less["events"], "queries": less["queries"], "stored": less["stored"]}}
        spark.stop()
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(out["queries"].values()), 3), "unit": "sec", **out, "sf": size}))


if __name__ == "__main__":
    main()
