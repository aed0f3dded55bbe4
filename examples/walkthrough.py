"""A tour: invent events, load them, and look at four of the benchmark queries.

    python examples/walkthrough.py OUT [--events 5000]

Writes a stored table of nested events under OUT, and a picture (SVG) of each query's values.
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession

from nestfold.functions.keys import Manifest
from nestfold.operators import nesting, record, tables
from nestfold.plans import adl
from nestfold.sources import datasets
from nestfold.tools.analysis import TASKS, Analysis
from nestfold.tools.timing import Stages

LABELS = {"Q4": "MET (GeV)", "Q6": "trijet pt (GeV)", "Q7": "sum of jet pt (GeV)", "Q8": "transverse mass (GeV)"}


def tour(spark: SparkSession, out: str, events: int = 5000) -> dict[str, int]:
    """The number of values of each query."""
    stages, counts = Stages(), {}
    with stages("invent"):
        datasets.sample_rows(spark, events, 1).coalesce(1).write.mode("overwrite").parquet(f"{out}/source")
    with stages("load"):
        listed = Manifest()
        listed.add(f"{out}/source", events)
        record.ingest(spark, listed, datasets.NANOAOD, f"{out}/tables")
    flat = {n: tables.stored(spark, f"{out}/tables", n).drop("file_id") for n in ("events", "jets", "muons")}
    nested = nesting.nest(flat["events"], {n: flat[n] for n in ("jets", "muons")}, {"jets": "jet_index", "muons": "muon_index"})
    tools = Analysis(spark, flat | {"nested": nested})
    for task, label in LABELS.items():
        with stages(task):
            values = adl.QUERIES[task.lower()](nested).select("value")
            tools.results[task] = values
            counts[task] = values.count()
            Path(out, f"{task}.svg").write_text(tools.plot_result(task, title=TASKS[task], xlabel=label)["svg"])
    print(stages.table())
    return counts


if __name__ == "__main__":
    asked = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    asked.add_argument("out")
    asked.add_argument("--events", type=int, default=5000)
    given = asked.parse_args()
    session = SparkSession.builder.appName("walkthrough").getOrCreate()
    for name, n in tour(session, given.out, given.events).items():
        print(f"{name}: {n} values, {given.out}/{name}.svg")
    session.stop()
