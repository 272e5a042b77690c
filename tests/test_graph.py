import json
import random

import pytest
from pyspark.sql import functions as F

from factloom import schema, synth
from factloom.graph import GraphError, apply_overlay, check_overlay, checksum, compact, compile_graph, edge_changes
from factloom.operators import answers, components, diff, export, lookup, stats, traverse, vector
from factloom.plans.protocol import QuerySession, operations
from tests import graphs


@pytest.fixture(scope="module")
def analysis(spark):
    return graphs.analysis(spark)


@pytest.fixture(scope="module")
def dense(spark):
    return graphs.dense(spark)


def names(df):
    return [r["name"] for r in df.collect()]


def test_vocabulary():
    assert len(schema.NODE_KINDS) == 27 and len(schema.RELATIONS) == 32 and len(schema.REASONS) == 15
    assert len(schema.IMPACT_RELATIONS) == 13 and len(schema.ARCHITECTURE_RELATIONS) == 20 and len(schema.CALL_RELATIONS) == 9
    assert set(schema.RELATION_PRIORITY) == set(schema.RELATIONS)


def test_analysis_graph(analysis):
    p = traverse.paths(analysis, 1, 3, ["calls"]).collect()
    assert len(p) == 1 and p[0]["depth"] == 2 and p[0]["nodes"] == [1, 2, 3] and not p[0]["truncated"]
    assert traverse.shortest_call_chain(analysis, 1, 3).first()["depth"] == 2
    assert traverse.reachability(analysis, [1, 1]).count() == 3
    assert names(traverse.impact(analysis, 3).orderBy("depth")) == ["middle", "entry"]
    assert names(traverse.dead_symbols(analysis, [1])) == ["unused"]
    role = traverse.operational_role(analysis, 3, [1])
    assert role["incoming"] == {"calls": 1} and role["entry_chain"]["depth"] == 2
    with pytest.raises(GraphError, match="at least one"):
        traverse.reachability(analysis, [])
    with pytest.raises(GraphError) as e:
        traverse.impact(analysis, 99)
    assert e.value.code == "unknown_node"


def test_dense_traversal(dense):
    p = traverse.paths(dense, 1, 4, limit=1).collect()
    assert p[0]["nodes"] == [1, 2, 4] and p[0]["truncated"]
    assert traverse.paths(dense, 1, 4, max_depth=1).count() == 0
    assert traverse.paths(dense, 1, 4).count() == 2 and not traverse.paths(dense, 1, 4).first()["truncated"]
    assert traverse.shortest_call_chain(dense, 1, 4).first()["nodes"] == [1, 2, 4]
    assert names(traverse.reachability(dense, [1], max_depth=1).orderBy("depth", "node_id")) == ["entry", "alpha", "beta"]
    i = traverse.impact(dense, 4, ["calls", "references"], 2).orderBy("depth", "node_id")
    assert names(i) == ["alpha", "beta", "referrer", "entry"]
    assert lookup.require_relations(["calls", "references"]) == ("references", "calls")
    assert names(traverse.dead_symbols(dense, [1], include_possible=False)) == ["beta", "referrer", "unused"]
    same = traverse.paths(dense, 1, 1).collect()
    assert len(same) == 1 and same[0]["depth"] == 0
    assert traverse.paths(dense, 1, 4, limit=0).count() == 0


def test_architecture(spark):
    g = graphs.architecture(spark)
    rel = ["observed-calls", "communicates-with", "routes-to"]
    totals, listed = components.summary(g, None, rel, 2)
    t = totals.first()
    assert (t["node_count"], t["internal_edges"], t["component_count"], t["community_count"], t["excluded_nodes"]) == (6, 3, 3, 2, 1)
    assert t["runtime_confirmed_relationships"] == 1
    first = listed.first()
    assert (first["nodes"], first["edges"], first["representatives"][0]) == (3, 2, 1)
    totals, _ = components.summary(g, "src/service", ["observed-calls"], 1)
    t = totals.first()
    assert (t["node_count"], t["internal_edges"], t["boundary_edges"]) == (1, 0, 1)


def test_lookup_and_pages(analysis):
    assert names(lookup.resolve_symbol(analysis, "entry", "function", "./src//analysis.go")) == ["entry"]
    assert names(lookup.resolve_file(analysis, "analysis.go")) == ["analysis.go"]
    assert lookup.list_nodes(analysis, path_prefix="src").count() == 4 and lookup.list_nodes(analysis, path_prefix="sr").count() == 0
    assert lookup.page(5, 3, 1) == lookup.Page(5, 3, 4) and lookup.page(5, 9, 1).next_offset is None
    assert lookup.unresolved(analysis).count() == 2 and lookup.unresolved(analysis, path="src/analysis.go", reason="missing-target").count() == 1
    hit = lookup.search_nodes(analysis, "ENTRY").first()
    assert hit["rank"] == 0 and hit["matched_fields"] == ["name", "qualified_name"]
    assert lookup.search_nodes(analysis, "  ").count() == 0
    with pytest.raises(GraphError):
        lookup.resolve_symbol(analysis, "x", "nonsense")
    with pytest.raises(ValueError):
        lookup.resolve_file(analysis, "/etc/passwd")
    nodes, edges = export.export_graph(analysis, None, 1, 1, [2])
    assert nodes.count() == 2 and [r["edge_id"] for r in edges.collect()] == ["1:calls:2"]


def test_compile_errors(spark):
    with pytest.raises(GraphError) as e:
        graphs.build(spark, [("1", "file", "a", "a")], [("1", "2", "calls")])
    assert e.value.code == "missing_endpoint"
    with pytest.raises(GraphError) as e:
        graphs.build(spark, [("1", "file", "a", "a"), ("1", "file", "a", "b")], [])
    assert e.value.code == "conflicting_node"
    g = graphs.build(spark, [("1", "odd", "a", "a"), ("2", "file", "b", "b")], [("1", "2", "calls"), ("1", "2", "calls"), ("1", "2", "strange")])
    assert g.edges.count() == 1 and g.nodes.where("kind = 'symbol'").count() == 1


def test_overlay_and_compaction(spark, dense, tmp_path):
    new = spark.createDataFrame([(5, 6, "calls", 5)], "src int, dst int, relation string, code short")
    gone = dense.edges.where("src = 2 and dst = 1")
    check_overlay(dense.edges, new, gone)
    for bad in ((gone, gone), (new, new)):
        with pytest.raises(GraphError):
            check_overlay(dense.edges, *bad)
    visible = apply_overlay(dense.edges, new, gone)
    assert visible.count() == dense.edges.count()
    written = compact(dense.nodes, dense.edges, new, gone, str(tmp_path / "g"))
    assert checksum(dense.nodes, written).first() == checksum(dense.nodes, visible).first()
    added, removed = edge_changes(dense.edges, visible)
    assert added.collect() == new.collect() and removed.count() == 1


def test_diff(spark):
    base = [("1", "file", "a", "a"), ("2", "function", "a", "f"), ("3", "function", "a", "g")]
    old = graphs.build(spark, base, [("2", "3", "calls")])
    new = graphs.build(spark, [*base[:2], ("3", "function", "a", "h"), ("4", "function", "a", "i")], [("2", "3", "references")])
    got = sorted((r["key"], r["change"]) for r in diff.diff(new, old).collect())
    assert got == [("2", "relationship_changed"), ("3", "metadata_changed"), ("4", "added")]
    assert sorted((r["key"], r["change"]) for r in diff.diff(old, new).collect())[-1] == ("4", "removed")
    assert diff.same(old, old) and not diff.same(old, new)


def _random_graph(spark, topology, seed):
    e = synth.synthetic(spark, topology, 64, 300, seed)
    names = {v: k for k, v in schema.RELATION_CODE.items()}
    rows = [(r["src"], r["dst"], names[r["code"]], r["code"]) for r in e.collect()]
    from factloom.graph import Graph

    n = spark.createDataFrame([(i, f"{i:04d}", "function", "p", f"n{i}", f"n{i}", None) for i in range(64)], "node_id int, key string, kind string, path string, name string, qualified_name string, content_id string")
    u = spark.createDataFrame([], "source_node_id int, relation string, expression string, candidate_namespace string, candidate_name string, reason string")
    return Graph(n, spark.createDataFrame(rows, "src int, dst int, relation string, code short"), u), rows


@pytest.mark.parametrize("topology", synth.TOPOLOGIES)
def test_synthetic_and_distances(spark, topology):
    g, rows = _random_graph(spark, topology, 5)
    pairs = {(a, b) for a, b, *_ in rows}
    assert len(rows) == 300 == len(pairs) and all(a != b and 0 <= a < 64 and 0 <= b < 64 for a, b in pairs)
    assert sorted(rows) == sorted(_random_graph(spark, topology, 5)[1])
    want, frontier = {7: 0}, [7]
    for d in range(1, 4):
        frontier = sorted({b for a, b in pairs if a in frontier} - want.keys())
        want |= dict.fromkeys(frontier, d)
    for local in (traverse.LOCAL_EDGES, 0):
        got = {r["node_id"]: r["depth"] for r in traverse.distances(g, [7], "outgoing", None, 3, local).collect()}
        assert got == want
    root = list(range(64))
    for _ in range(64):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    for size in (300, None):
        got = {r["node_id"]: r["component"] for r in components.components(g.nodes.select("node_id"), g.edges, size).collect()}
        assert got == dict(enumerate(root))


def test_paths_against_walk(spark):
    g, rows = _random_graph(spark, "entangled", 9)
    adjacent = {}
    for a, b, r, _ in rows:
        adjacent.setdefault(a, []).append((b, schema.TRAVERSAL_ORDER[r]))
    for hops in adjacent.values():
        hops.sort()
    for s, t, limit in ((0, 9, 5), (3, 40, 40), (11, 2, 1)):
        found, cut = traverse.walk(adjacent, s, t, 4, limit)
        got = traverse.paths(g, s, t, None, 4, limit).orderBy("path_rank").collect()
        assert [(r["nodes"], r["relations"]) for r in got] == [(n, [schema.RELATIONS[o] for o in os]) for n, os in found]
        assert not got or got[0]["truncated"] == cut
        chain = traverse.first_chain(adjacent, s, t, 12)
        row = traverse.shortest_call_chain(g, s, t, relations=schema.RELATIONS).first()
        assert row["nodes"] == chain[0] and row["relations"] == [schema.RELATIONS[o] for o in chain[1]]


def test_mutations(spark):
    e = synth.synthetic(spark, "hub-heavy", 64, 300, 1)
    for kind, amount in (("single-node", 1), ("local-range", 4), ("scattered", 3), ("hub", 1), ("percentage", 10)):
        added, removed = synth.mutate(e, 64, kind, amount)
        a, r = added.collect(), removed.collect()
        assert len(a) == len(r) > 0 and sorted(x["code"] for x in a) == sorted(x["code"] for x in r)
        assert not {(x["src"], x["dst"]) for x in a} & {(x["src"], x["dst"]) for x in e.collect()}
    assert synth.workload(5, "sequential", 7) == [0, 1, 2, 3, 4, 0, 1] and synth.workload(5, "hot", 3, hot=[4, 2]) == [4, 2, 4]


def test_vector_and_documents(spark, dense):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in vector.search(v, [1.0, 0.5], 2).collect()] == [1, 3]
    for q, k in (([], 1), ([1.0], 1), ([float("nan"), 0.0], 1), ([1.0, 0.0], 0)):
        with pytest.raises(GraphError):
            vector.search(v, q, k)
    docs = vector.documents(dense)
    text = {r["node_id"]: r["text"] for r in docs.collect()}
    assert "out: calls target; calls entry" in text[2] or "out: calls entry; calls target" in text[2]
    calls = []

    def embed(texts):
        if len(texts) > 2:
            raise vector.ContextTooLong
        calls.append(len(texts))
        return [[float(len(t))] for t in texts]

    assert [x[0] for x in vector.embed_all(embed, ["a", "bb", "ccc"])] == [1.0, 2.0, 3.0]
    index = vector.build_index(docs, lambda ts: [[float(len(t))] for t in ts])
    assert index.count() == docs.count()
    again = vector.build_index(docs, lambda ts: 1 / 0, index.select("content_hash", "vector").distinct())
    assert again.count() == docs.count()


def test_stats_and_protocol(spark, analysis):
    assert {(r["section"], r["name"]): r["count"] for r in stats.stats(analysis).collect()}[("edges", "calls")] == 2
    s = QuerySession(analysis, lambda p: analysis)
    def ask(op, **args):
        return {"op": op} | args

    ends = {"from_node_id": 1, "to_node_id": 3}
    requests = [
        ask("stats"), ask("capabilities"), ask("search_nodes", query="tar"), ask("resolve_symbol", name="entry"), ask("resolve_file", path="analysis.go"),
        ask("list_nodes", limit=2), ask("export_graph", limit=2), ask("neighbors", node_id=1, direction="outgoing"), ask("paths", **ends),
        ask("reachability", entry_node_ids=[1]), ask("impact", node_id=3), ask("shortest_call_chain", **ends), ask("dead_symbols", entry_node_ids=[1]),
        ask("operational_role", node_id=2, entry_node_ids=[1]), ask("architecture_summary"), ask("unresolved"), ask("diff", other_snapshot="x"),
    ]
    assert {r["op"] for r in requests} == set(operations())
    for r in requests:
        answer = json.loads(s.handle_line(json.dumps(r | {"id": 7})))
        assert answer["ok"] and answer["id"] == 7, answer
    assert s.handle({"op": "list_nodes", "limit": 2})["result"]["next_offset"] == 2
    wrong = [(ask("impact", node_id=50), "unknown_node"), (ask("neighbors", node_id=1, direction="outgoing", relation="x"), "invalid_relation"), (ask("resolve_file", path="../x"), "invalid_path"), (ask("reachability", entry_node_ids=[]), "missing_entry_points")]
    for line, code in [("{", "invalid_json"), *((json.dumps(r), c) for r, c in wrong)]:
        assert json.loads(s.handle_line(line))["error"]["code"] == code
    assert s.handle({"op": "stats"})["ok"]


def test_dense_ids_are_ranks(spark):
    keys = [f"{random.Random(i).random():.12f}" for i in range(500)]
    from factloom.graph import dense_ids

    got = {r["k"]: r["node_id"] for r in dense_ids(spark.createDataFrame([(k,) for k in keys], "k string").repartition(7), "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_unresolved_and_empty_graph(spark):
    g = graphs.build(spark, [("1", "file", "a", "a")], [])
    assert traverse.reachability(g, [0]).count() == 1 and components.summary(g)[1].count() == 0
    assert compile_graph(graphs.fact_set(spark, [], [])).nodes.count() == 0


def test_compare_overlay_and_answers(spark, tmp_path):
    n = 60
    base = synth.synthetic(spark, "modular", n, 300, 1).withColumn("relation", F.lit("calls"))
    nodes = spark.range(n).select(F.col("id").cast("int").alias("node_id"))
    base.cache()
    made = {}
    for s in ("hub", "percentage"):
        added, removed = synth.mutate(base.drop("relation"), n, s, 5, 1)
        made[s] = tuple(df.withColumn("relation", F.lit("calls")).cache() for df in (added, base.join(removed, ["src", "dst", "code"], "left_semi").drop("relation")))
    asked = nodes.select(F.lit("all").alias("workload"), F.col("node_id").alias("node"))
    got = synth.compare_overlay(nodes, base, made, asked, f"file://{tmp_path}/o").collect()
    assert len(got) == 4 and all(r["same"] and r["rows"] == r["rebuilt_rows"] == 300 for r in got)
    view = synth.answers(base, asked).collect()
    other = synth.answers(base.withColumn("code", (F.col("code") % 32 + 1).cast("short")), asked).collect()
    assert {r["rows"] for r in view} == {r["rows"] for r in other} == {300} and {r["fingerprint"] for r in view}.isdisjoint(r["fingerprint"] for r in other)


def test_walks_are_bounded(spark, dense, monkeypatch):
    monkeypatch.setattr(traverse, "WALK_EDGES", 1)
    with pytest.raises(GraphError, match="edges lie between the ends"):
        traverse.paths(dense, 1, 4).collect()
    monkeypatch.undo()
    assert traverse.entry_chain(dense, 4, [2, 1, 3])["entry_node_id"] == 2
    assert traverse.entry_chain(dense, 4, []) is None and traverse.entry_chain(dense, 4, [6]) is None


def test_answer_scores(spark):
    a = spark.createDataFrame([(1, "c", 'In A\\B.py, class Foo.\nEVIDENCE_JSON: {"x": 1}\nsee a/b.py:3-9'), (2, "c", "EVIDENCE_JSON: [1]\na/b.py:1 forbidden"), (3, "c", None)], "run_id int, case_id string, answer string")
    e = spark.createDataFrame([("c", "ownership", "a/b.py:3", ["foo", "bar"]), ("c", "required", "a\\b.py", []), ("c", "required", "", None), ("c", "structural", "a/b.py", ["missing"])], "case_id string, `group` string, path string, symbols array<string>")
    f = spark.createDataFrame([("c", "Forbidden")], "case_id string, pattern string")
    o = spark.createDataFrame([("c", "names class", ["CLASS", "type"])], "case_id string, label string, any array<string>")
    got = {r["run_id"]: r for r in answers.score_answers(a, e, f, o).collect()}
    assert [got[1][f"{g}_recovered"] for g in answers.GROUPS] == [1, 1, 0] and [got[1][f"{g}_total"] for g in answers.GROUPS] == [1, 2, 1]
    assert got[1]["correct"] and got[1]["evidence_valid"] and got[1]["citation_count"] == 1
    assert got[2]["forbidden_hits"] == ["Forbidden"] and got[2]["outcome_missing"] == ["names class"] and not got[2]["evidence_valid"] and not got[2]["correct"]
    assert got[3]["ownership_recovered"] == 0 and not got[3]["correct"]
