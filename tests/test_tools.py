"""The read-only tools, scoring, the regressor and the command line."""

import importlib.util
import io
import json
import threading
import urllib.request
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from nestfold.__main__ import _nested, main
from nestfold.operators import regression
from nestfold.sources.datasets import NANOAOD, keyed, sample_rows
from nestfold.sources.datasets import tables as tables_of
from nestfold.tools import analysis, guard, mcp, timing
from nestfold.tools.guard import ToolError
from nestfold.tools.records import References
from nestfold.tools.scoring import compare


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nano") / "a")
    sample_rows(spark, 300, 1).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("entry", F.col("_metadata.row_index"))
    return path, tables_of(keyed(rows, NANOAOD), NANOAOD)


@pytest.fixture
def tools(spark, flat):
    return analysis.Analysis(spark, flat[1] | {"nested": _nested(flat[1])})


@pytest.mark.parametrize(
    "sql",
    [
        "", ";", "DROP TABLE events", "INSERT INTO events SELECT 1", "WITH a AS (SELECT 1) INSERT INTO events SELECT * FROM a", "SELECT 1; DROP TABLE events", "SET a=1", "FROM events INSERT INTO b SELECT *",
        "EXECUTE IMMEDIATE 'DROP TABLE events'", "EXPLAIN SELECT 1", "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT java_method('a', 'b')", "SELECT TRANSFORM(event_id) USING 'cat' FROM events",
        "SELECT * FROM (SELECT TRANSFORM(event_id) USING 'cat' FROM events)", "BEGIN SELECT 1; END", "CREATE TABLE x AS SELECT 1", "SELECT * FROM parquet.`/etc`", "SELECT * FROM text.`/etc/passwd`",
    ],
)
def test_guard_refuses(tools, sql):
    with pytest.raises(ToolError):
        guard.query(tools.session, sql)


def test_guard_lets_queries_pass(tools):
    for sql in ("SELECT 'drop table; x' AS a", "WITH a AS (SELECT 1 AS x) SELECT x FROM a;", "SELECT transform(array(1), x -> x + 1)", "(SELECT 1) UNION ALL (SELECT 2)", "VALUES 1, 2"):
        assert guard.query(tools.session, sql).count() >= 1
    assert guard.condition(tools.session, " WHERE met_pt > 3; ") == "met_pt > 3"
    assert guard.condition(tools.session, " ") is None
    for bad in ("1 = 1 UNION SELECT 1", "true) OR (true", "1 = 1; DROP TABLE events", "event_id IN (SELECT reflect('a', 'b'))"):
        with pytest.raises(ToolError):
            guard.condition(tools.session, bad)


def test_tools_and_trace(tools):
    said = tools.call("run_sql", sql="SELECT * FROM events", max_rows=3)
    assert said["row_count"] == 300 and len(said["rows"]) == 3 and said["truncated"]
    assert tools.call("describe_schema")["tables"]["events"]["rows"] == 300
    assert "error" in tools.call("run_sql", sql="DROP TABLE events") and "error" in tools.call("nothing")
    assert "nulls" in tools.call("submit_answer", sql="SELECT CAST(NULL AS DOUBLE)")["error"]
    assert "not a number" in tools.call("submit_answer", sql="SELECT 'a'")["error"]
    assert "either" in tools.call("submit_answer")["error"]
    assert "error" in tools.call("nested_eval", expression="1 FROM nested; SELECT 1")
    made = tools.call("nested_eval", expression="jets.pt", where="n_jets >= 2")
    h = tools.call("histogram_of", result_id=made["result_id"], bins=1000)
    assert len(h["counts"]) == 200 and sum(h["counts"]) + h["outside"] == made["summary"]["n"]
    assert [c.ok for c in tools.trace] == [True, True, False, False, False, False, False, False, True, True]


def test_answers_are_scored_and_attempts_counted(spark, flat, tmp_path):
    log, kept = str(tmp_path / "log" / "checks"), str(tmp_path / "references")
    make = lambda: analysis.Analysis(spark, flat[1] | {"nested": _nested(flat[1])}, log, kept)
    tools = make()
    assert "no answer" in tools.call("check_answer", query="q1")["error"]
    tools.call("submit_answer", sql="SELECT met_pt + 1 FROM events")
    assert tools.call("check_answer", query="q1")["passed"] is False
    tools = make()
    tools.call("submit_answer", sql=analysis.EXPERT["Q1"])
    assert tools.call("check_answer", query="q1") == {"query": "Q1", "passed": True, "reason": "300 values agree", "attempt": 2}
    assert tools.checks.rows().count() == 2
    analysis.run(make(), "Q2", analysis.expert("Q2"), save=str(tmp_path / "Q2.json"))
    again = analysis.run(make(), "Q2", analysis.replay(str(tmp_path / "Q2.json")))
    assert compare(again.answer, again.reference("Q2"))[0]


def test_references_follow_the_data(spark, flat, tmp_path):
    nested, kept = _nested(flat[1]), References(spark, str(tmp_path / "kept"))
    asked = []

    def make():
        asked.append(1)
        return nested.select(F.col("met_pt").alias("value"))

    assert kept.get("Q1", nested, make).count() == 300 == kept.get("Q1", nested.repartition(7), make).count() and len(asked) == 1
    kept.get("Q1", nested.withColumn("met_pt", F.when(F.col("event_id") == 3, 0.5).otherwise(F.col("met_pt"))), make)
    assert len(asked) == 2


def test_summary_of_values(tools):
    said = tools.call("nested_eval", expression="met_pt")["summary"]
    assert said["n"] == 300 and len(said["first"]) == 8 and sum(said["histogram"]["counts"]) == 300


def test_picture(tools):
    said = tools.call("plot_result", sql="SELECT met_pt FROM events", title="MET <all>", bins=20, x_range=[0, 50])
    picture = ElementTree.fromstring(said["svg"])
    assert said["bins"] == 20 and said["outside"] > 0 and len(picture.findall("{*}rect")) == 21 and "MET <all>" in "".join(picture.itertext())


def test_conversation(tools):
    calls = iter([{"tool": "run_sql", "args": {"sql": "SELECT count(*) FROM jets"}}, {"tool": "submit_answer", "args": {"sql": "SELECT met_pt FROM events"}}])
    heard = []
    done = analysis.run(tools, "Q1", analysis.conversation(lambda said: heard.append(list(said)) or next(calls, None)))
    assert done.answer is not None and [x["from"] for x in heard[1]] == ["task", "call", "tool"]


def test_protocol(tools):
    server = mcp.Server(tools, expressions=False)
    ask = lambda method, number=1, **params: server.answer({"jsonrpc": "2.0", "id": number, "method": method, "params": params})
    assert ask("initialize", protocolVersion="2025-03-26")["result"]["protocolVersion"] == "2025-03-26"
    listed = {t["name"]: t for t in ask("tools/list")["result"]["tools"]}
    assert "nested_eval" not in listed and listed["run_sql"]["inputSchema"]["required"] == ["sql"] and listed["run_sql"]["description"]
    said = ask("tools/call", name="run_sql", arguments={"sql": "SELECT count(*) AS n FROM events"})["result"]
    assert not said["isError"] and json.loads(said["content"][0]["text"])["rows"] == [[300]]
    assert ask("tools/call", name="run_sql", arguments={"sql": "DROP TABLE events"})["result"]["isError"]
    assert ask("tools/call", name="nested_eval", arguments={"expression": "1"})["result"]["isError"]
    assert ask("nothing")["error"]["code"] == -32601 and server.answer([])["error"]["code"] == -32600
    assert server.answer({"method": "notifications/initialized"}) is None and ask("tools/call")["error"]["code"] == -32602
    out = io.StringIO()
    mcp.serve(server, io.StringIO('{"id": 1, "method": "ping"}\n\nnot json\n'), out)
    assert [json.loads(x).get("result", "bad") for x in out.getvalue().splitlines()] == [{}, "bad"]
    web = mcp.serve_http(server, 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{web.server_port}/", b'{"id": 7, "method": "ping"}')) as r:
        assert json.loads(r.read()) == {"jsonrpc": "2.0", "id": 7, "result": {}}
    web.shutdown()


def test_timing(spark):
    stages = timing.Stages()
    with timing.used(spark, watts=10) as cost:
        for _ in range(2):
            with stages("count"):
                assert timing.timed(lambda: spark.range(5).count(), repeats=2).result == 5
    assert len(stages.seconds) == 1 and "100.0 %" in stages.table()
    assert cost["seconds"] > 0 and cost["peak_mb"] > 0 and cost["joules"] == 10 * cost["cpu_seconds"]


def test_compare_counts_wrong_values(spark):
    a = spark.range(1000).select(F.col("id").cast("double").alias("value"))
    b = spark.range(1000).select(F.when(F.col("id") == 10, 5000.0).otherwise(F.col("id").cast("double")).alias("value"))
    assert compare(a, a) == (True, "1000 values agree")
    assert compare(b, a) == (False, "1 of 1000 values differ")
    for odd in (float("inf"), float("nan"), float("-inf"), None):
        c = spark.range(1000).select(F.when(F.col("id") == 10, F.lit(odd).cast("double")).otherwise(F.col("id").cast("double")).alias("value"))
        assert compare(a, c)[0] is False and compare(c, a) == (False, "1 of 1000 values differ") and compare(c, c)[0]
    many = spark.range(5000).select(F.lit(1.5).alias("value"))
    assert compare(many, many)[0] and compare(many, many.withColumn("value", F.col("value") + 1e-9))[0]
    assert compare(a.limit(3), a)[0] is False and compare(a.limit(0), a.limit(0))[0]


def test_regressor_learns_what_objects_say(spark, flat):
    nested = _nested(flat[1]).withColumn("ht", F.aggregate("jets.pt", F.lit(0.0), lambda s, x: s + x))
    model, r2 = regression.train(regression.dataset(nested, target="ht"))
    assert r2 > 0.99 and model.numFeatures == 15


def test_command_line(spark, flat, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    run = lambda *args: main(list(args), spark)
    for i in (0, 1):
        assert run("make-nano", "--out", at(f"n{i}"), "--events", "60", "--seed", str(i)) == 0
    assert run("manifest", at("n0"), at("n1"), "--out", at("m.json"), "--count-entries") == 0
    assert run("ingest", at("root"), "--manifest", at("m.json")) == 0
    assert "120 events" in capsys.readouterr().out
    split = ("--manifest", at("m.json"), "--shards", at("s.json"))
    assert run("shards", "init", "--manifest", at("m.json"), "--shards", "2", "--out", at("s.json")) == 0
    assert run("shards", "ingest", at("parts"), *split) == 0
    assert run("shards", "verify", at("parts"), *split) == 0
    assert run("shards", "migrate", at("parts"), *split, "--to", at("new"), "--entry-bits", "31") == 0
    assert run("shards", "verify", at("new"), *split) == 0
    assert run("shards", "adl", at("new"), "--shards", at("s.json")) == 0 and "q1: 120 values" in capsys.readouterr().out
    assert run("ingest", at("root"), "--manifest", at("m.json"), "--first", "0", "--stop", "10") == 0
    assert run("adl", at("root")) == 0 and "q1: 120 values" in capsys.readouterr().out
    assert run("agent", "eval", at("root"), "--references", at("kept")) == 0 and "8 of 8 passed" in capsys.readouterr().out
    assert run("agent", "ask", at("root"), "Q3", "--check-log", at("log")) == 0
    assert run("agent", "checks", "--check-log", at("log")) == 0 and "Q3 PASS" in capsys.readouterr().out
    assert run("learn", "--events", "2000") == 0 and "events_per_second" in capsys.readouterr().out
    assert run("bench", at("root"), "--repeats", "1") == 0
    assert run("agent", "questions") == 0
    assert run("ingest", at("x"), "--manifest", at("missing.json")) == 2


def test_walkthrough(spark, tmp_path):
    spec = importlib.util.spec_from_file_location("walkthrough", Path(__file__).parent.parent / "examples" / "walkthrough.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    counts = module.tour(spark, str(tmp_path), 200)
    assert counts["Q7"] == 200 and 0 < counts["Q6"] < 200 and (tmp_path / "Q6.svg").read_text().startswith("<svg")
