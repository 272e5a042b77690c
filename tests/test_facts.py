import hashlib

import pytest
from pyspark.sql import functions as F

from factloom import schema
from factloom.functions import text
from factloom.graph import FactSet, GraphError, compile_graph
from factloom.operators import diff, link, lookup, maintain, stats
from factloom.sources import files, jsonl, snapshots
from factloom.streaming import evidence, watch


def sid(x):
    return "sha256:" + hashlib.sha256(str(x).encode()).hexdigest()


def span(path, line):
    return (path, line, 1, line, 5)


def sample(spark, extra=(), calls=True):
    nodes = [(sid("f"), "file", "a.py", "a.py", "a.py", None, "a.py", None, None), (sid("g"), "function", "g", "a.py", "a.g", None, "a.py", span("a.py", 3), '{"x":1}'), (sid("h"), "function", "h", "b.py", "b.h", None, "b.py", span("b.py", 1), None), (sid("r"), "repository", "r", ".", "r", None, None, None, None), *extra]
    edges = [(sid("f"), sid("g"), "contains", "a.py", None, None)] + [(sid("g"), sid("h"), "calls", "a.py", span("a.py", 4), None)] * calls
    unresolved = [(sid("g"), "calls", "z()", "dynamic-target", None, None, "a.py", None, None)]
    return FactSet(spark.createDataFrame(nodes, schema.NODE), spark.createDataFrame(edges, schema.EDGE), spark.createDataFrame(unresolved, schema.UNRESOLVED))


HEADER = {"record": "header", "schema_version": 1, "adapter_version": "1", "language": "python", "repository": "r", "mode": None, "changed_files": None, "removed_files": None, "shared_complete": None}


def rows(f):
    return [sorted(map(str, df.collect())) for df in (f.nodes, f.edges, f.unresolved)]


def test_jsonl_round_trip(spark, tmp_path):
    f = sample(spark)
    jsonl.write(f, HEADER, str(tmp_path / "x"))
    head, back = jsonl.read(spark, str(tmp_path / "x"))
    assert head["language"] == "python" and rows(back) == rows(f)
    jsonl.write(back, head, str(tmp_path / "y"))
    read = lambda p: [r["value"] for r in spark.read.text(str(p)).coalesce(1).collect()]
    assert sorted(read(tmp_path / "x")) == sorted(read(tmp_path / "y"))
    assert jsonl.export_languages({"python": (HEADER, f)}, None, str(tmp_path / "all")) == ["python"]
    with pytest.raises(GraphError):
        jsonl.export_languages({"python": (HEADER, f)}, ["cobol"], str(tmp_path / "all"))


def test_validation(spark, tmp_path):
    good = sample(spark)
    assert jsonl.violations(good).count() == 0
    bad = [("x", "file", "n", "a//b", "q", None, None, None, None), (sid("r2"), "file", "n", ".", "q", None, None, None, None), (sid("s"), "function", "n", "p", "q", None, None, ("p", 5, 1, 4, 1), None), (sid("g"), "function", "other", "a.py", "a.g", None, None, None, None)]
    found = {r["rule"] for r in jsonl.violations(sample(spark, bad)).collect()}
    assert {"node-id", "node-path", "root-node", "node-span", "conflicting-node"} <= found
    orphan = FactSet(good.nodes.where("name = 'h'"), good.edges, good.unresolved)
    assert {r["rule"] for r in jsonl.violations(orphan).collect()} == {"edge-source-missing", "unresolved-source-missing"}
    inc = HEADER | {"mode": "incremental", "changed_files": ["b.py"], "removed_files": [], "shared_complete": True}
    assert {r["rule"] for r in jsonl.violations(good, inc).collect()} == {"node-owner", "edge-owner", "unresolved-owner"}
    for change in ({"schema_version": 2}, {"language": ""}, {"mode": "odd"}, {"mode": "incremental"}, {"changed_files": ["b", "a"]}):
        with pytest.raises(GraphError):
            jsonl.check_header(HEADER | change)
    (tmp_path / "z.jsonl").write_text('{"record":"header","schema_version":1,"adapter_version":"1","language":"p","repository":"r"}\n{"record":"node","bogus":1}\n')
    with pytest.raises(GraphError, match="unknown keys"):
        jsonl.read(spark, str(tmp_path / "z.jsonl"))


def test_tsv_catalogue_and_graph_files(spark, tmp_path):
    f = sample(spark)
    files.write_tsv(f, str(tmp_path / "t"))
    assert rows(files.read_tsv(spark, str(tmp_path / "t"))) == rows(f)
    g = compile_graph(f)
    files.write_catalogue(g.nodes, str(tmp_path / "c"))
    assert sorted(map(str, files.read_catalogue(spark, str(tmp_path / "c")).collect())) == sorted(map(str, g.nodes.collect()))
    files.write_graph(g, str(tmp_path / "g"))
    for side in ("outgoing", "incoming"):
        assert sorted(map(str, files.read_graph(spark, str(tmp_path / "g"), side).edges.collect())) == sorted(map(str, g.edges.collect()))
    files.write_overlay(g.edges, g.edges.where("false"), str(tmp_path / "o"))
    assert files.read_overlay(spark, str(tmp_path / "o"))[0].count() == 2
    files.write_report(g.edges.select("src"), str(tmp_path / "r"))


def test_source_tree(spark, tmp_path):
    for p, t in (("a/x.py", "def f():\n  pass\n"), ("node_modules/y.js", "1"), ("Cargo.toml", "[package]"), ("z.weird", "q")):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text(t)
    got = {r["path"]: r["language"] for r in files.source_tree(spark, str(tmp_path)).collect()}
    assert got == {"a/x.py": "python", "Cargo.toml": "rust", "z.weird": "generic-weird"}
    assert files.source_lines(files.source_tree(spark, str(tmp_path))).where("line = '  pass'").first()["line_no"] == 2


def test_store(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"))
    one = store.publish("python", sample(spark))
    assert store.publish("python", sample(spark)) == one and rows(store.open()) == rows(sample(spark))
    two = store.publish("python", sample(spark, calls=False))
    assert store.open(owners=["b.py"]).nodes.count() == 1 and store.doctor() == [] and store.status()["snapshots"] == 2
    assert store.gc_plan(0) == {"keep": [two], "delete": [one]}
    store.pin("c", one)
    assert store.gc(0, dry_run=True)["delete"] == []
    with pytest.raises(GraphError):
        store.manifest("none")
    files.atomic_write(f"{store.root}/PENDING", "half")
    assert store.doctor() == ["a publication was cut off"] and store.recover() == "discarded" and store.recover() is None
    fails = watch.Consumers(store, {"bad": lambda s: 1 / 0, "good": lambda s: None})
    three = watch.maintain(spark, store, "python", sample(spark, calls=False), ["b.py"], [], False, fails)
    assert list(fails.failures) == ["bad"] and store.current() == three


def test_ownership_and_incremental(spark):
    f = sample(spark)
    owned = maintain.graph_owners(FactSet(f.nodes.withColumn("owner", F.lit(None).cast("string")), f.edges.withColumn("owner", F.lit(None).cast("string")), f.unresolved))
    assert {r["name"]: r["owner"] for r in owned.nodes.collect()} == {"a.py": "a.py", "g": "a.py", "h": "b.py", "r": None}
    assert owned.edges.where("owner = 'a.py'").count() == 2
    assert maintain.fact_owners(f).nodes.where("owner is null").count() == 1
    fresh = sample(spark, calls=False)
    whole = maintain.replace_changed(f, fresh, ["a.py"])
    assert rows(whole) == rows(fresh)
    only = FactSet(fresh.nodes.where("owner = 'a.py'"), fresh.edges.where("owner = 'a.py'"), fresh.unresolved)
    assert rows(maintain.apply_incremental(f, only, ["a.py"], [], False)) == rows(fresh)
    gone = maintain.apply_incremental(f, FactSet(*(x.where("false") for x in (f.nodes, f.edges, f.unresolved))), [], ["b.py"], False)
    assert gone.edges.where("relation = 'calls'").count() == 0 and gone.nodes.count() == 3
    old, new = compile_graph(f), fresh
    added, removed = maintain.incremental_compile(old, new)
    assert added.count() == 0 and removed.count() == 1
    with pytest.raises(GraphError):
        maintain.incremental_compile(old, FactSet(f.nodes.where("name != 'h'"), f.edges.where("relation = 'contains'"), f.unresolved))
    a, b = snapshots.owner_objects(f), snapshots.owner_objects(fresh)
    assert [r["owner"] for r in maintain.changed_objects(a, b).collect()] == ["a.py"] and not maintain.needs_full(a, b)
    assert maintain.merge_shared(f, fresh, ["zzz"]).edges.count() == 2
    assert maintain.unsafe_topology(fresh, f, ["b.py"]).first()["problem"] == "outside" and maintain.unsafe_topology(fresh, f, ["a.py"]).count() == 0


def test_dependencies_and_plans(spark):
    f = sample(spark)
    deps = maintain.file_dependencies(f)
    assert [tuple(r) for r in deps.collect()] == [("a.py", "b.py")]
    assert rows(FactSet(maintain.dependencies_delta(deps, f, ["a.py"]), f.edges, f.unresolved)) == rows(FactSet(deps, f.edges, f.unresolved))
    known = spark.createDataFrame([("a.py",), ("b.py",)], "path string")
    assert sorted(tuple(r) for r in maintain.closure(deps, known, ["b.py"]).collect()) == [("a.py", "emit"), ("b.py", "emit")]
    assert sorted(tuple(r) for r in maintain.closure(deps, known, ["a.py"]).collect()) == [("a.py", "emit"), ("b.py", "context")]
    with pytest.raises(GraphError):
        maintain.closure(deps, known, ["zzz.py"])
    ch = lambda *xs: spark.createDataFrame(list(xs), "status string, old string, new string")
    plan = lambda *xs, **k: {r["language"]: r.asDict() for r in maintain.scan_plan(ch(*xs), ["python", "go"], **k).collect()}
    p = plan(("M", None, "a.py"))["python"]
    assert p["changed_files"] == ["a.py"] and not p["full"] and p["removed_files"] == []
    assert plan(("A", None, "b.py"))["python"]["added_files"] == ["b.py"] and plan(("A", None, "b.go"))["go"]["full"]
    r = plan(("R100", "a.py", "c.py"))["python"]
    assert r["removed_files"] == ["a.py"] and r["added_files"] == ["c.py"] and not r["full"]
    assert plan(("D", "a.py", None))["python"]["full"] and plan(("M", None, "pyproject.toml"))["python"]["full"] and plan(("M", None, "x.rb")) == {}
    assert plan(("M", None, "a.py"), drift=["go"])["go"]["full"]
    m = {"format": 1, "facts": 1}
    assert maintain.sync_plan(None, m, [])[0] == "rebuild" and maintain.sync_plan(m, m, [])[0] == "existing" and maintain.sync_plan(m, {"format": 1, "facts": 2}, ["a"])[0] == "incremental" and maintain.sync_plan({"format": 0}, m, [])[1] == "another graph format"
    lines = spark.createDataFrame([("pkg/a.py", 1, "from .b import c"), ("pkg/a.py", 2, "import os.path")], "path string, line_no long, line string")
    tree = spark.createDataFrame([(x,) for x in ("pkg/__init__.py", "pkg/a.py", "pkg/b.py", "pkg/d.py")], "path string")
    assert sorted(r["path"] for r in maintain.import_context(lines, tree, ["pkg/a.py"]).collect()) == ["pkg/__init__.py", "pkg/b.py"]
    crates = spark.createDataFrame([(x,) for x in ("x/Cargo.toml", "x/src/a.rs", "x/src/b.rs", "y/Cargo.toml", "y/c.rs")], "path string")
    assert sorted(r["path"] for r in maintain.analysis_scope(crates, ["x/src/a.rs"], "rust").where("path like '%.rs'").collect()) == ["x/src/a.rs", "x/src/b.rs"]
    t = lambda *xs: spark.createDataFrame(list(xs), "path string, content_id string")
    got = set(tuple(r) for r in diff.tree_changes(t(("a", "1"), ("b", "2"), ("c", "3")), t(("a", "9"), ("d", "2"), ("e", "5"))).collect())
    assert got == {("M", "a", "a"), ("R", "b", "d"), ("D", "c", None), ("A", None, "e")}


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x"))).first()[0]
    assert text.normalize_path("a\\.//b/") == "a/b" and text.normalize_path("./") == "."
    assert one(text.normalize_path_col, "a/./b") == "a/b" and one(text.normalize_path_col, "../b") is None
    for name, want in (("parseHTTPRequest", "parse http request"), ("snake_case2Value", "snake case2 value"), ("__x", "x")):
        assert one(text.identifier_terms, name) == want
    for url, want in (("https://h.example/api/v1/${id}/x?q=1", "/api/v1/{param}/x"), ("http://h.example", ""), ("base + /api/users/:id", "/api/users/{param}"), ("/a/../b//c/./d#z", "/b/c/d"), ("res://x", "")):
        assert one(text.normalize_route, url) == want
    assert one(text.route_shape, "/a/{param}/b") == "/a/{}/b"
    assert [one(text.http_method, x) for x in ("client.post('/x')", "METHOD_DELETE", "fetch(u, {method: 'put'})", "x")] == ["POST", "DELETE", "PUT", ""]
    assert one(text.client_call, "axios.get('/x')") and not one(text.client_call, "mux.HandleFunc('/x', h)")
    assert one(text.component_of, "services/x/y.go") == "services/x" and one(text.component_of, "lib/y.go") == "lib"
    assert one(text.module_name, "pkg/new/__init__.py") == "pkg.new" and one(text.camelize, "a_b-c") == "ABC" and one(text.camel_to_kebab, "fooBar") == "foo-bar"
    assert one(text.fnv1a64, "a") == "af63dc4c8601ec8c"
    assert one(text.bounded_bytes, "é" * 4000) == "é" * 3000
    assert one(lambda c: text.node_identity(F.lit("go"), F.lit("function"), c), "x") == "sha256:" + hashlib.sha256(b"factloom:v1\0go\0function\0x").hexdigest()
    assert one(lambda c: text.mask_comments(c), 'a // b\n"// c" /* d\ne */ f') == 'a     \n"// c"     \n     f'


def test_owners_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    c = [("f", f"o{i}", a := rnd.randint(1, 100), rnd.randint(1, 9), a + rnd.choice((0, 3, 40))) for i in range(30)]
    asked = [("f", i) for i in range(111)]
    got = {r["line_no"]: r["owner"] for r in link.owners(spark.createDataFrame(asked, "path string, line_no long"), spark.createDataFrame(c, "path string, owner string, start_line long, start_column long, end_line long"), 16).collect()}
    for _, i in asked:
        inside = min(((s, col, o) for _, o, s, col, e in c if s <= i <= e), default=None)
        before = max(((s, col, o) for _, o, s, col, e in c if s <= i), default=None)
        assert got[i] == (inside or before or (0, 0, None))[2]


def lines_of(spark, path, source):
    return spark.createDataFrame([(path, i + 1, x) for i, x in enumerate(source.split("\n"))], "path string, line_no long, line string")


def test_linking(spark):
    got = [(r["fact"], r["name"]) for r in link.extract(lines_of(spark, "x", "import os\n#include <a.h>\nclass Foo {\npub fn bar() {\nfrom a.b import c\ncreate table t1 (")).orderBy("line_no").collect()]
    assert got == [("import", "os"), ("import", "a.h"), ("type", "Foo"), ("function", "bar"), ("import", "a.b"), ("type", "t1")]
    r = link.routes(lines_of(spark, "m.go", 'mux.HandleFunc("/api/x/{id}", h.get)\nr.post("/y", make)\nr.Handle("GET /z", v)'), spark.createDataFrame([("m.go", "v", "bound")], "path string, variable string, handler string"))
    assert sorted((x["method"], x["route"], x["handler"], x["confidence"]) for x in r.collect()) == [("*", "/api/x/{param}", "get", 1.0), ("GET", "/z", "bound", 0.95), ("POST", "/y", "make", 1.0)]
    rails = link.rails_routes(lines_of(spark, "config/routes.rb", "namespace :api do\n  scope '/v1' do\n    get 'users', to: 'users#index'\n  end\n  post 'x'\nend\nget '/top'"))
    assert sorted((x["method"], x["route"]) for x in rails.collect()) == [("GET", "/api/v1/users"), ("GET", "/top"), ("POST", "/api/x")]
    call = spark.createDataFrame([("c.py", "f", 1, 1, 9), ("c.py", "user_path", 10, 1, 12)], "path string, owner string, start_line long, start_column long, end_line long")
    made = link.producers(lines_of(spark, "c.py", "def f():\n  requests.get(\n    '/api/users/1')\n\n\n\n\n\n\ndef user_path():\n  return '/api/me'"), call)
    assert sorted((x["owner"], x["method"], x["route"]) for x in made.collect()) == [("f", "GET", "/api/users/1"), ("user_path", "", "/api/me")]
    known = link.constants(lines_of(spark, "k", "const JOIN = 'player_join'\nA = 'x'\nA = 'y'"))
    assert [tuple(r) for r in known.collect()] == [("JOIN", "player_join")]
    m = link.messages(lines_of(spark, "s.js", "send({type: JOIN})\nswitch (p.type) {\ncase 'chat_say':\n}\nregister_handler(JOIN, f)"), known)
    assert sorted((x["role"], x["channel"]) for x in m.collect()) == [("consumes", "chat_say"), ("consumes", "player_join"), ("publishes", "player_join")]
    c = link.config_reads(lines_of(spark, "e", 'os.getenv("HOME_DIR")\nprocess.env.PORT\nENV[JOIN]'), known)
    assert sorted(r["key"] for r in c.collect()) == ["HOME_DIR", "PORT", "player_join"]
    assert link.boundary_keys(lines_of(spark, "e", "a KEY1 b"), ["KEY1", "KEY2"]).first()["key"] == "KEY1"
    assert link.rule_links(lines_of(spark, "e", "spawn('ffmpeg')"), [("ffmpeg", "invokes-process", "process", "ffmpeg")]).count() == 1
    best = link.callable_by_name(spark.createDataFrame([("go", "a/b/x.py"), ("tie", "z/x.py")], "name string, path string"), spark.createDataFrame([("go", "a/b/y.py", "near"), ("go", "q/y.py", "far"), ("tie", "m/y", "1"), ("tie", "n/y", "2")], "name string, path string, owner string"))
    assert [tuple(r) for r in best.collect()] == [("go", "a/b/x.py", "near")]
    assert link.last_wins(spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, n int, v string"), ["k"], "n").first()["v"] == "b"


def test_lookup_over_facts(spark):
    f = sample(spark)
    assert [r["name"] for r in lookup.find(f.nodes, "A.G").collect()] == ["g"]
    assert lookup.resolve(f.nodes, "a.g") == sid("g") and lookup.show(f.nodes, sid("h")).count() == 1
    with pytest.raises(GraphError, match="nothing"):
        lookup.resolve(f.nodes, "nope")
    got = sorted((r["direction"], r["relation"]) for r in lookup.refs(f.nodes, f.edges, f.unresolved, sid("g")).collect())
    assert got == [("incoming", "contains"), ("outgoing", "calls"), ("unresolved", "calls")]
    n = spark.createDataFrame([("1", "capability:errors", "p"), ("2", "catch:x", "p"), ("3", "catch:y", "p"), ("4", "report:z", "p")], "id string, name string, path string")
    e = spark.createDataFrame([("3", "4", "contains")], "source string, target string, relation string")
    assert [r["id"] for r in lookup.missing_behaviour(n, e, "catch", ("report", "throw"), "errors").collect()] == ["2"]


def test_scoring(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 2)], "case_id int, doc_id int, rank int")
    rel = spark.createDataFrame([(1, 10), (2, 12), (2, 99)], "case_id int, doc_id int")
    m = stats.retrieval_metrics(ranked, rel, 10).first()
    assert (m["cases"], m["recall"], m["mrr"], m["pass_rate"]) == (2, 0.75, 0.75, 0.5)


def test_evidence_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("target"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in evidence.windowed(src, "1 day", keys=["target"]).collect()}
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = evidence.windowed(stream, "1 day", "40 days", ["target"]).writeStream.format("memory").queryName("ev").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("ev").collect()} == want
    (tmp_path / "changes").mkdir(exist_ok=True)
    paths = spark.readStream.schema("path string").json(str(tmp_path / "changes"))
    (tmp_path / "changes" / "a.json").write_text('{"path":"x.py"}\n{"path":"sub/.gitignore"}\n')
    seen = []
    watch.watch_changes(paths, lambda p, full: seen.append((p, full)), str(tmp_path / "cp2"), once=True).awaitTermination()
    assert seen == [(["sub/.gitignore", "x.py"], True)]


def test_reconcile(spark):
    from tests import graphs

    g = graphs.analysis(spark)
    o = spark.createDataFrame([("20", "30", None, 2), ("20", "40", None, 1), ("20", None, "libc", 1), ("20", "zz", None, 1)], "source string, target string, external_target string, count long").withColumn("relation", F.lit("observed-calls"))
    got = {(r["source"], r["target"]): r["category"] for r in evidence.reconcile(o, g, spark.createDataFrame([("30",)], "source string")).collect()}
    assert got == {("20", "30"): "confirmed", ("20", "40"): "dynamic", ("20", None): "external", ("20", "zz"): "unmapped", ("30", "40"): "unobserved"}
    assert evidence.observed_edges(o, g).count() == 2
