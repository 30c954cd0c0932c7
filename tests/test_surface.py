"""The command line and the stream of commits."""

from __future__ import annotations

import json

from tests.test_engine import repo  # noqa: F401


def test_command_line(spark, repo, capsys):  # noqa: F811
    from lodestone.cli import main

    assert main(["--repo", str(repo), "search", "cart", "--type", "class"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["id"] == "shop/cart.py::Cart"
    assert main(["--repo", str(repo), "viz", "dependencies", "--of", "cart.py"], spark) == 0
    assert capsys.readouterr().out.startswith("graph TD")
    assert main(["--repo", str(repo / "none"), "analyze"], spark) == 1
    assert json.loads(capsys.readouterr().out)["error_type"] == "not_found"


def test_tables(spark, repo, capsys):  # noqa: F811
    from lodestone.cli import main, table

    assert main(["--repo", str(repo), "--table", "search", "cart", "--type", "class"], spark) == 0
    out = capsys.readouterr().out.split("\n")
    assert out[0].startswith("id") and set(out[1]) <= {"-", " "} and out[2].startswith("shop/cart.py::Cart")
    assert main(["--repo", str(repo), "--table", "git-context", "shop/stock.py", "--entity", "reserve"], spark) == 0
    out = capsys.readouterr().out
    assert "co_changed" in out and "history knows no entities" in out
    assert table([]) == "(none)" and table([{"a": [1, 2], "b": None, "c": "x" * 199}]).endswith("...")


def test_server(spark, repo):  # noqa: F811
    import io

    from lodestone.server import TOOLS, serve

    ask = lambda n, method, **params: json.dumps({"jsonrpc": "2.0", "id": n, "method": method, "params": params})
    tool = lambda n, name, **arguments: ask(n, "tools/call", name=name, arguments=arguments)
    lines = [
        ask(1, "initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask(2, "tools/list"), tool(3, "search_graph", query="cart"), tool(4, "analyze_repo", repo_path="relative"),
        tool(5, "analyze_repo", repo_path=str(repo), use_cache=False), tool(6, "search_graph", query="cart", entity_type="class"), tool(7, "trace_flow", entity_name="main", max_depth=1), tool(8, "find_issues", issue_types=["orphan_file"]),
        tool(9, "get_metrics", metric="complexity", top_n=2), tool(10, "visualize", diagram_type="dependencies", scope="shop/cart.py"), tool(11, "get_git_context", file_path="shop/../shop/stock.py", entity_name="reserve"),
        tool(12, "trace_flow", entity_name="main", direction="up"), tool(13, "get_git_context", file_path="../x"), tool(14, "nothing"), tool(15, "search_graph"), "{", ask(16, "other"), tool(17, "search_graph", query="x" * 200), tool(18, "analyze_repo", repo_path=str(repo / "gone")), tool(19, "find_issues"),
    ]
    out = io.StringIO()
    assert serve(spark, lines, out) == 0
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    said = lambda n: json.loads(got[n]["result"]["content"][0]["text"])
    assert got[1]["result"]["serverInfo"]["name"] == "lodestone" and [t["name"] for t in got[2]["result"]["tools"]] == list(TOOLS) and len(TOOLS) == 7
    assert said(3)["error_type"] == "not_analyzed" and got[3]["result"]["isError"] and said(4)["error_type"] == "not_found"
    assert said(5)["entities"]["module"] == 10 and said(5)["health"]["cycles"] == 1 and not got[5]["result"]["isError"]
    assert said(6)[0]["id"] == "shop/cart.py::Cart" and [s["relationship"] for s in said(7)["steps"]] == ["calls", "calls"] and said(7)["truncated"]
    assert [i["type"] for i in said(8)] == ["orphan_file"] and len(said(9)) == 2 and got[10]["result"]["content"][0]["text"].startswith("graph TD") and said(11)["frequency"] == 4
    assert [said(n)["error_type"] for n in (12, 13, 14, 15, 17, 18, 19)] == ["invalid_input", "not_found", "invalid_input", "invalid_input", "invalid_input", "not_found", "not_analyzed"]
    assert got[16]["error"]["code"] == -32601 and got[None]["error"]["code"] == -32700


def test_commit_stream(spark, tmp_path):
    from lodestone.streaming.commits import touches

    rows = [("a", "2024-01-01 10:00:00", "x.py"), ("a", "2024-01-01 10:00:00", "x.py"), ("b", "2024-01-01 11:00:00", "x.py"), ("c", "2024-01-02 00:00:00", "y.py")]
    df = spark.createDataFrame(rows, "sha string, ts string, path string").selectExpr("sha", "ts::timestamp ts", "path")
    df.write.parquet(str(tmp_path / "in"))
    want = {("x.py", "2024-01-01", 2), ("y.py", "2024-01-02", 1)}
    assert {tuple(r) for r in touches(df).collect()} == want
    stream = touches(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("touches").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("touches").collect()} == want
