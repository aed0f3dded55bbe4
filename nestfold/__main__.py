"""The command line: ``python -m nestfold VERB`` or through spark-submit."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.functions.keys import KeyLayout, Manifest, ShardMap
from nestfold.functions.kinematics import mass, total
from nestfold.operators import nesting, record, regression, set_network, shards, tables
from nestfold.plans import adl
from nestfold.sources import datasets
from nestfold.sources.root import write_root
from nestfold.tools import analysis, mcp, timing
from nestfold.tools.records import Checks


def _text(path: str) -> str:
    with open(path) as f:
        return f.read()


def _save(path: str, text: str) -> None:
    with open(path, "w") as f:
        f.write(text)


def _manifest(path: str) -> Manifest:
    return Manifest.from_json(_text(path))


def _flat(spark: SparkSession, path: str, dataset: str) -> dict[str, DataFrame]:
    """The tables of a stored root, or of a source file or folder that has the dataset's columns."""
    made = datasets.DATASETS[dataset]
    names = ["events", *[c.name for c in made.collections]]
    if tables.has(spark, path):
        return {n: tables.stored(spark, path, n).drop("file_id") for n in names}
    return datasets.tables(datasets.keyed(datasets.read(spark, path, made), made), made)


def _nested(flat: dict[str, DataFrame]) -> DataFrame:
    objects = {n: df for n, df in flat.items() if n != "events"}
    return nesting.nest(flat["events"], objects, {n: n.rstrip("s") + "_index" for n in objects})


def make_nano(spark, a) -> None:
    """Invented events as Parquet, or as a tree if the name ends in .root."""
    rows = datasets.sample_rows(spark, a.events, a.seed, not a.no_triggers).coalesce(1)
    if a.out.endswith(".root"):
        write_root(rows, a.out, mode="overwrite")
    else:
        rows.write.mode("overwrite").parquet(a.out)


def manifest(spark, a) -> None:
    made = _manifest(a.out) if os.path.exists(a.out) and not a.fresh else Manifest(KeyLayout(a.entry_bits))
    for path in a.files:
        if path not in made:
            made.add(path, datasets.entries_of(spark, path) if a.count_entries else None)
    _save(a.out, made.to_json())
    print(f"{len(made.files)} files")


def ingest(spark, a) -> None:
    """Load the files of a manifest, or of each a range of entries."""
    n = record.ingest(spark, _manifest(a.manifest), datasets.DATASETS[a.dataset], a.root, (a.first, a.stop), not a.append)
    print(f"{n} events")


def _shards(a) -> ShardMap:
    return ShardMap.from_json(_text(a.shards))


def shards_init(spark, a) -> None:
    _save(a.out, ShardMap.split(max((f["file_id"] for f in _manifest(a.manifest).files), default=-1) + 1, a.shards).to_json())


def shards_ingest(spark, a) -> None:
    """Load each file of a manifest into the shard that owns it."""
    n = record.ingest(spark, _manifest(a.manifest), datasets.DATASETS[a.dataset], a.root, shards=_shards(a))
    print(f"{n} events")


def shards_verify(spark, a) -> int:
    """1 if rows are in another shard than their own, have none, or objects have no event."""
    layout, split, bad = _manifest(a.manifest).layout, _shards(a), 0
    names = ["events", *[c.name for c in datasets.DATASETS[a.dataset].collections]]
    events = shards.table(spark, a.root, split, "events")
    for name in names:
        rows = shards.table(spark, a.root, split, name)
        lost = shards.misrouted(spark, a.root, split, name, layout).agg(F.sum("n")).first()[0] or 0
        orphans = nesting.orphans(events, rows).count() if name != "events" else 0
        print(f"{name}: {rows.count()} rows, {lost} not in their shard, {orphans} without an event")
        bad += lost + orphans
    return int(bad > 0)


def shards_migrate(spark, a) -> None:
    """Rewrite each shard's tables to another key layout; the manifest follows."""
    made = _manifest(a.manifest)
    new = KeyLayout(a.entry_bits)
    names = ["events", *[c.name for c in datasets.DATASETS[a.dataset].collections]]
    moved = made.with_layout(new)
    for name, _, _ in _shards(a).shards:
        if tables.has(spark, f"{a.root}/{name}"):
            tables.migrate(spark, f"{a.root}/{name}", f"{a.to}/{name}", names, made.layout, new)
    _save(a.manifest, moved.to_json())


def shards_adl(spark, a) -> None:
    """The eight queries over all shards."""
    _print_adl(shards.fetch(spark, a.root, _shards(a), a.where, ordered=False))


def reconstruct(spark, a) -> int:
    """Nest, and compare every pair's mass with the stored one. 1 if none was selected or one is off."""
    both = _nested(_flat(spark, a.path, "dimuon")).where(a.where)
    vector = lambda i: F.struct(*[F.col("muons")[i][c].alias(c) for c in ("e", "px", "py", "pz")])
    off = both.select(F.abs(mass(total(vector(0), vector(1))) - F.col("mass")).alias("off"))
    n, worst = off.agg(F.count("*"), F.max("off")).first()
    print(f"{n} events, largest difference {worst}")
    return int(not n or worst is None or worst >= 1e-2)


def _print_adl(nested: DataFrame) -> None:
    for name, df in adl.run_all(nested).items():
        n, mean = df.agg(F.count("*"), F.avg("value")).first()
        print(f"{name}: {n} values, mean {mean}")


def run_adl(spark, a) -> None:
    nested = _nested(_flat(spark, a.path, "nanoaod"))
    _print_adl(nested.where(a.where) if a.where else nested)


def bench(spark, a) -> None:
    """Median seconds of each query."""
    found = adl.run_all(_nested(_flat(spark, a.path, "nanoaod")))
    print(json.dumps({name: round(timing.timed(lambda df=df: timing.drain(df), a.repeats).median, 3) for name, df in found.items()}))


def learn(spark, a) -> None:
    """Train on a value of the events, and tell R2 on held-out ones and events a second."""
    events = _nested(_flat(spark, a.path, "nanoaod")) if a.path else datasets.synthetic_events(spark, a.events, seed=a.seed)
    if a.network:
        r2 = set_network.train(events, target=a.target, seed=a.seed)[1]
    else:
        r2 = regression.train(regression.dataset(events, target=a.target), trees=a.trees)[1]
    print(json.dumps({"r2": round(r2, 4), **regression.throughput(events, a.target)}))


def _tools(spark, a) -> analysis.Analysis:
    flat = _flat(spark, a.path, "nanoaod")
    return analysis.Analysis(spark, flat | {"nested": _nested(flat)}, getattr(a, "check_log", None), getattr(a, "references", None))


def agent_eval(spark, a) -> int:
    scores = analysis.evaluate(lambda: _tools(spark, a), analysis.expert if not a.replay else lambda q: analysis.replay(f"{a.replay}/{q}.json"), a.queries or list(analysis.TASKS))
    print(analysis.as_table(scores))
    return int(not scores["passed"].all())


def agent_mcp(spark, a) -> None:
    """The tools as a server of the Model Context Protocol, over standard input and output or HTTP."""
    server = mcp.Server(_tools(spark, a), not a.no_expressions)
    if a.http is None:
        mcp.serve(server, sys.stdin, sys.stdout)
    else:
        mcp.serve_http(server, a.http).serve_forever()


def agent_ask(spark, a) -> int:
    """One task, worked on by the calls of a saved run or by the expert."""
    tools = _tools(spark, a)
    analysis.run(tools, a.task, analysis.replay(a.replay) if a.replay else analysis.expert(a.task), save=a.save)
    said = tools.call("check_answer", query=a.task) if a.task in analysis.TASKS else {"passed": tools.answer is not None}
    print(json.dumps(said, default=str))
    return int(not said.get("passed"))


def agent_serve(spark, a) -> None:
    """One JSON request a line, {"tool": ..., "args": {...}}; one JSON answer a line."""
    tools = _tools(spark, a)
    for line in sys.stdin:
        try:
            asked = json.loads(line)
            said = tools.call(asked["tool"], **asked.get("args", {}))
        except (ValueError, KeyError, TypeError) as e:
            said = {"error": f"not a request: {e}"}
        print(json.dumps(said, default=str), flush=True)


def agent_questions(spark, a) -> None:
    for k, v in analysis.TASKS.items():
        print(f"{k}: {v}")


def agent_checks(spark, a) -> None:
    for c in Checks(spark, a.check_log).rows().orderBy("at").toLocalIterator():
        print(f"{c['at']:%Y-%m-%dT%H:%M:%S} {c['task']} {'PASS' if c['agreed'] else 'FAIL'} {c['detail']}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="nestfold")
    verbs = top.add_subparsers(required=True)

    def verb(under, name, f, *args):
        p = under.add_parser(name, help=f.__doc__)
        p.set_defaults(run=f)
        for flag, options in args:
            p.add_argument(flag, **options)

    group = lambda name: verbs.add_parser(name).add_subparsers(required=True)
    path, root = ("path", {}), ("root", {})
    listed, kind = ("--manifest", {"required": True}), ("--dataset", {"default": "nanoaod", "choices": sorted(datasets.DATASETS)})
    bits, where = ("--entry-bits", {"type": int, "default": 40}), ("--where", {"default": None})
    verb(verbs, "make-nano", make_nano, ("--out", {"required": True}), ("--events", {"type": int, "default": 2000}), ("--seed", {"type": int, "default": 0}), ("--no-triggers", {"action": "store_true"}))
    verb(verbs, "manifest", manifest, ("files", {"nargs": "+"}), ("--out", {"default": "manifest.json"}), bits, ("--fresh", {"action": "store_true"}), ("--count-entries", {"action": "store_true"}))
    verb(verbs, "ingest", ingest, root, listed, kind, ("--first", {"type": int, "default": 0}), ("--stop", {"type": int, "default": None}), ("--append", {"action": "store_true"}))
    split = group("shards")
    owners = ("--shards", {"required": True})
    verb(split, "init", shards_init, listed, ("--shards", {"type": int, "required": True}), ("--out", {"default": "shards.json"}))
    verb(split, "ingest", shards_ingest, root, listed, owners, kind)
    verb(split, "verify", shards_verify, root, listed, owners, kind)
    verb(split, "migrate", shards_migrate, root, listed, owners, ("--to", {"required": True}), ("--entry-bits", {"type": int, "required": True}), kind)
    verb(split, "adl", shards_adl, root, owners, where)
    for name in ("reconstruct", "roundtrip"):
        verb(verbs, name, reconstruct, path, ("--where", {"default": "mass BETWEEN 60 AND 120" if name == "roundtrip" else "true"}))
    verb(verbs, "adl", run_adl, path, where)
    verb(verbs, "bench", bench, path, ("--repeats", {"type": int, "default": 5}))
    verb(verbs, "learn", learn, ("--path", {"default": None}), ("--events", {"type": int, "default": 20_000}), ("--seed", {"type": int, "default": 0}), ("--target", {"default": "met_pt"}), ("--trees", {"action": "store_true"}), ("--network", {"action": "store_true"}))
    agent = group("agent")
    log, kept, replayed = ("--check-log", {"default": None}), ("--references", {"default": None}), ("--replay", {"default": None})
    verb(agent, "eval", agent_eval, path, ("--queries", {"nargs": "*"}), replayed, kept)
    verb(agent, "ask", agent_ask, path, ("task", {}), replayed, ("--save", {"default": None}), log, kept)
    verb(agent, "serve", agent_serve, path, log)
    verb(agent, "mcp", agent_mcp, path, log, ("--http", {"type": int, "default": None}), ("--no-expressions", {"action": "store_true"}))
    verb(agent, "questions", agent_questions)
    verb(agent, "checks", agent_checks, ("--check-log", {"required": True}))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one verb; a problem is told in one line, and gives 2."""
    a = parser().parse_args(args)
    needs = a.run not in (agent_questions, shards_init)
    spark = spark or (SparkSession.builder.appName("nestfold").getOrCreate() if needs else None)
    try:
        return a.run(spark, a) or 0
    except (ValueError, OSError) as e:
        print(f"nestfold: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
