import json

from factloom import cli
from factloom.operators.extract import generic_facts
from factloom.sources import jsonl


def test_generic_facts(spark):
    text = 'import os\n# import no\nclass A:\n  x = "class No {"\ndef f():\n'
    files = spark.createDataFrame([("p/a.py", "python", text, "sha256:1"), ("p/b.py", "python", "import os\n", None), ("c", None, None, None)], "path string, language string, text string, content_id string")
    f = generic_facts(files)
    assert sorted((r["kind"], r["name"]) for r in f.nodes.collect()) == [("file", "a.py"), ("file", "b.py"), ("function", "f"), ("import", "os"), ("module", "p.a"), ("module", "p.b"), ("type", "A")]
    assert sorted(r["relation"] for r in f.edges.collect()) == ["contains", "contains", "defines", "defines", "imports", "imports"]
    assert jsonl.violations(f).where("rule != 'node-path'").count() == 0


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import os\ndef main():\n  pass\n")
    store, graph = str(tmp_path / "store"), str(tmp_path / "graph")

    def run(*args):
        code = cli.main(list(args))
        out = capsys.readouterr().out.splitlines()
        return code, out

    assert len(run("scan", "--root", str(tmp_path / "src"), "--store", store)[1][0]) == 64
    assert run("doctor", "--store", store) == (0, [])
    assert json.loads(run("find", "main", "--store", store)[1][0])["kind"] == "function"
    assert json.loads(run("show", "main", "--store", store)[1][0])["name"] == "main"
    assert json.loads(run("refs", "main", "--store", store)[1][0])["relation"] == "defines"
    assert run("calls", "main", "--store", store) == (0, [])
    assert json.loads(run("status", "--store", store)[1][0])["snapshots"] == 1
    assert run("export", "--out", str(tmp_path / "out"), "--store", store)[0] == 0
    assert json.loads(run("gc", "--dry-run", "--store", store)[1][0])["delete"] == []
    assert len(run("languages", "--store", store)[1]) > 5
    assert run("sync", "--store", store, "--graph", graph)[0] == 0
    assert {json.loads(x)["name"] for x in run("query", "--name", "a", "--graph", graph)[1]} == {"main", "os"}
    assert len(run("stats", "--graph", graph)[1]) > 3
