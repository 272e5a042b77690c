"""What queries shuffle and write, apart from their results."""

import random

import numpy as np
from pyspark.sql import functions as F

from factloom import graph as graphs
from factloom import synth
from factloom.graph import Graph, apply_overlay
from factloom.operators import answers, components, diff, lookup, maintain, stats
from factloom.streaming import evidence
from factloom.plans import workload
from factloom.plans.derived import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(df.collect(), key=str)


def test_only_asked_relations_are_compiled(spark):
    workload._GRAPHS.pop((spark.sparkContext.applicationId, SF, 1), None)
    g = workload.graph(spark, SF)
    calls = g.edges_of(("calls",))
    assert "edges" not in vars(g) and "lineitem" not in plan(g._of.edges_of(("calls",)))
    assert rows(calls) == rows(g.edges.where("relation = 'calls'")) and g.size_of(("calls",)) == g.edge_counts()["calls"] > 1000


def test_edges_at_nodes_and_among_pages_are_compiled_alone(spark):
    workload._GRAPHS.pop((spark.sparkContext.applicationId, SF, 1), None)
    g = workload.graph(spark, SF)
    got = {q: rows(QUERIES[q](spark, SF)) for q in ("a4_relation_counts", "g10_operational_role", "g12_export_graph")}
    hub = g.nodes.where("kind = 'directory'").agg(F.min("node_id")).first()[0]
    near, page = rows(g.edges_at([hub, 7, -1])), g.nodes.where("node_id < 900").select("node_id")
    among = rows(g.edges_among(page))
    assert "edges" not in vars(g)
    assert near == rows(g.edges.where(F.col("src").isin(hub, 7) | F.col("dst").isin(hub, 7))) == rows(g.edges_at([hub, 7, -1])) and len(near) > 5
    assert among == rows(g.edges.where("src < 900 and dst < 900")) == rows(g.edges_among(page)) and len(among) > 100
    assert got == {q: rows(QUERIES[q](spark, SF)) for q in got} and all(got.values())


def test_few_edges_are_sent_to_the_nodes_and_many_are_not(spark, monkeypatch):
    one = workload.referenced_facts(spark, SF)
    g = graphs.compile_graph(graphs.FactSet(one.nodes.withColumn("id", F.col("id").cast("string")), one.edges.withColumns({c: F.col(c).cast("string") for c in ("source", "target")}), one.unresolved.withColumn("source", F.col("source").cast("string"))), check=False)
    few = rows(g.edges_at([3]))
    monkeypatch.setattr(graphs, "FEW_EDGES", -1)
    assert few == rows(g.edges_at([3])) == rows(g.edges.where("src = 3 or dst = 3")) != []


def test_components_write_tables_that_shrink(spark, monkeypatch):
    n, written = 600, []
    ids = random.Random(4).sample(range(n), n)
    made = spark.createDataFrame([*zip(ids, ids[1:])], "src int, dst int").where("src != 7 and dst != 7")
    true = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(true(df, name)) or written[-1])
    got = dict(components.components(spark.range(n).select(F.col("id").cast("int").alias("node_id")), made).collect())
    at = ids.index(7)
    assert got == {7: 7} | {x: min(part) for part in (ids[:at], ids[at + 1 :]) for x in part}
    assert sum(t.count() for t in written) < 8 * n


def test_far_pages_are_not_sorted(spark):
    n = spark.range(200_000).select((F.col("id") * 2).cast("int").alias("node_id"), F.lit("function").alias("kind"), F.lit("a").alias("path"))
    g = Graph(n, n, n)
    for offset in (9_000, 70_001, 131_071, 199_998, 200_000, 10**9):
        page = lookup.list_nodes(g, "function", None, offset, 5)
        assert [r["node_id"] for r in page.collect()] == [2 * i for i in range(offset, min(offset + 5, 200_000))]
    assert "limit=150005" not in plan(lookup.list_nodes(g, "function", None, 150_000, 5))


def test_overlays_leave_other_relations_alone(spark):
    base = spark.createDataFrame([(1, 2, "calls", 5), (1, 2, "references", 3), (2, 3, "references", 3)], "src int, dst int, relation string, code short")
    gone = base.where("src = 2")
    view = apply_overlay(base, base.limit(0), gone)
    assert rows(view) == rows(base.where("src = 1")) and "references" in plan(view)
    assert rows(apply_overlay(base, base.limit(0), base.limit(0))) == rows(base)


def test_differences_of_facts_and_of_graphs(spark):
    got = QUERIES["g13_diff"](spark, SF)
    assert rows(got) == rows(diff.diff(workload.graph(spark, SF, 2), workload.graph(spark, SF)))
    one = workload.referenced_facts(spark, SF)
    assert diff.diff_facts(one, one).isEmpty()


def test_key_changes_meet_in_one_shuffle(spark):
    a, b = (workload.graph(spark, SF, v).nodes for v in (1, 2))
    added, removed = graphs.key_changes(a, b)
    assert added.isEmpty() and rows(removed) == rows(a.select("key").subtract(b.select("key")))
    assert "Anti" not in plan(removed)


def test_a_folder_stands_for_the_list_of_its_files(spark):
    def plain(version):
        f = workload.referenced_facts(spark, SF, version, exact=False)
        n = f.nodes.withColumn("owner", F.when(~F.col("kind").isin("repository", "directory"), F.col("path")))
        owner = n.select(F.col("id").alias("source"), "owner")
        return graphs.FactSet(n, f.edges.where("relation = 'calls'").join(owner, "source"), f.unresolved.join(owner, "source").limit(0))

    a, b = plain(1), plain(2)
    files = [r[0] for r in a.nodes.where("owner like 'r1/%'").select("owner").distinct().collect()]
    for merge in (maintain.replace_changed, lambda x, y, f: maintain.apply_incremental(x, y, f, [], False)):
        x, y = merge(a, b, lambda owner: owner.startswith("r1/")), merge(a, b, files)
        assert rows(x.nodes) == rows(y.nodes) and rows(x.edges) == rows(y.edges) and x.edges.count() > 1000


def test_same_nodes_are_not_numbered_again(spark, monkeypatch):
    workload.graph(spark, SF)
    monkeypatch.setattr(graphs, "dense_ids", None)
    got = QUERIES["g19_incremental_compile"](spark, SF)
    assert {r["side"] for r in got.select("side").distinct().collect()} == {"added", "removed"}


def test_answers_of_one_case_stay_where_they_are(spark):
    a = spark.createDataFrame([(1, "c", "x/a.py:3 bad"), (2, "d", "bad"), (3, "none", "bad"), (4, None, "bad"), (5, "e", "fine yes")], "run_id int, case_id string, answer string")
    e = spark.createDataFrame([("c", "required", "x/a.py", ["", None]), ("c", "required", "x/b.py", None), ("d", "structural", "bad", ["BAD"])], "case_id string, `group` string, path string, symbols array<string>")
    f = spark.createDataFrame([("c", "Bad"), ("c", "BAD"), ("c", "Bad"), ("e", None)], "case_id string, pattern string")
    o = spark.createDataFrame([("d", "z", ["never"]), ("d", "a", []), ("d", "k", ["BAD"]), ("e", "yes", ["YES", None]), ("e", "open", None)], "case_id string, label string, any array<string>")
    out = answers.score_answers(a, e, f, o)
    got = {r["run_id"]: (r["required_recovered"], r["required_total"], r["structural_recovered"], r["forbidden_hits"], r["outcome_missing"]) for r in out.collect()}
    assert got == {1: (1, 2, 0, ["BAD", "Bad"], []), 2: (0, 0, 1, [], ["a", "z"]), 3: (0, 0, 0, [], []), 4: (0, 0, 0, [], []), 5: (0, 0, 0, [], [])}
    assert "hashpartitioning(run_id" not in plan(out)


def test_draws_are_walked_in_arrays_and_first_ones_found_by_bins(spark, monkeypatch):
    for size in (7, 10**6, 10**13 + 37, (1 << 61) + 1):
        step, start = synth.permutation(size, 4)
        i = [0, 1, 5, 6, 10**4, 10**8 + 3]
        assert synth.walked(np.array(i), size, step, start).tolist() == [(step * x + start) % size for x in i]
    monkeypatch.setattr(synth, "BIN", 16)
    draw = lambda k: spark.range(k).select(F.col("id").alias("i"), (F.col("id") % 97).cast("int").alias("src"), F.col("id").cast("int").alias("dst"))
    have = draw(40_000).where("i % 3 != 0 and i < 30000").select("src", "dst")
    left = [x for x in range(40_000) if x % 3 == 0 or x >= 30_000]
    for most, n in ((40_000, 0), (40_000, 1), (40_000, 160), (40_000, 12_000), (300, 1000), (40_000, 19_999)):
        got = synth._first_new(draw, most, have, n)
        assert sorted(r["i"] for r in got.collect()) == [x for x in left if x < most][:n]
    assert "TakeOrdered" not in plan(synth.synthetic(spark, "hub-heavy", 640, 3000, 1).where("src >= 0").groupBy("code").count())


def test_bm25_keeps_the_best_of_each_batch(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("a b c d e f g Ünï h_1 zz".split(), k=rng.randrange(0, 9))) for _ in range(60)] + [None, "", "a a b"]
    docs = spark.createDataFrame([(i, rng.choice(texts)) for i in range(900)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i * 7, " ".join(rng.choices("a b c d e F g ünï h_1 never".split(), k=rng.randrange(0, 6)))) for i in range(12)] + [(99, None)], "query_id int, text string")
    out = stats.bm25(docs, queries, 5)
    # nothing of a document is shuffled but the best of each task
    assert "hashpartitioning(doc_id" not in plan(out) and "hashpartitioning(term" not in plan(out)
    got = rows(out)
    monkeypatch.setattr(stats, "PAIRS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    assert got == rows(stats.bm25(docs, queries, 5)) and len(got) > 30
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(stats, "ASKED", 0)
    assert got == rows(stats.bm25(docs, queries, 5).select(out.columns))


def test_reconcile_by_ids_of_ends(spark):
    g = workload.graph(spark, SF)
    calls = g.edges_of(("calls",)).limit(5).select("src", "dst")
    made = calls.unionByName(calls.selectExpr("dst as src", "src as dst")).unionByName(calls).select("*", F.lit("observed-calls").alias("relation"), F.lit(None).cast("string").alias("external_target"), F.lit(2).alias("count"))
    ids = g.nodes.select("key", "node_id")
    keyed = made.join(ids.toDF("source", "src"), "src").join(ids.toDF("target", "dst"), "dst")
    by_key = evidence.reconcile(keyed.drop("src", "dst"), g)
    by_id = evidence.reconcile(keyed, g)
    assert rows(by_key) == rows(by_id) and {(r["category"], r["count"]) for r in by_id.collect()} == {("confirmed", 4), ("dynamic", 2)}
    assert plan(by_id).count("Join") < plan(by_key).count("Join")
