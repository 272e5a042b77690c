"""Small graphs for tests: node(key, kind, path, name), ids are the ranks of the keys."""

from factloom import schema
from factloom.graph import FactSet, Graph, compile_graph

NODE = "id string, kind string, name string, path string, qualified_name string, content_id string"


def fact_set(spark, nodes, edges, unresolved=()):
    n = spark.createDataFrame([(k, kind, name, path, name, None) for k, kind, path, name in nodes], NODE)
    e = spark.createDataFrame(list(edges), "source string, target string, relation string")
    u = spark.createDataFrame(list(unresolved), "source string, relation string, expression string, candidate_namespace string, candidate_name string, reason string")
    return FactSet(n, e, u)


def build(spark, nodes, edges, unresolved=()) -> Graph:
    return compile_graph(fact_set(spark, nodes, edges, unresolved)).persist()


def analysis(spark):
    p = "src/analysis.go"
    nodes = [("10", "file", "analysis.go", "analysis.go")] + [(k, "function", p, n) for k, n in (("20", "entry"), ("30", "middle"), ("40", "target"), ("50", "unused"))]
    return build(spark, nodes, [("20", "30", "calls"), ("30", "40", "calls")], [("20", "calls", "x()", None, "x", "dynamic-target"), ("20", "calls", "x()", None, "x", "dynamic-target"), ("30", "references", "y", None, None, "missing-target")])


def dense(spark):
    names = (("10", "file"), ("20", "entry"), ("30", "alpha"), ("40", "beta"), ("50", "target"), ("60", "referrer"), ("70", "unused"))
    nodes = [(k, "file" if n == "file" else "function", f"src/{n}.go", n) for k, n in names]
    edges = [("20", "30", "calls"), ("20", "40", "possible-calls"), ("30", "50", "calls"), ("40", "50", "calls"), ("30", "20", "calls"), ("60", "50", "references")]
    return build(spark, nodes, edges)


def architecture(spark):
    names = (("10", "handler", "function"), ("20", "service", "function"), ("30", "repository", "function"), ("40", "worker", "function"), ("50", "queue", "type"), ("60", "isolated", "function"))
    nodes = [(k, kind, f"src/{n}/{n}.go" if n != "service" else "src/service/service.go", n) for k, n, kind in names]
    edges = [("30", "50", "similar-to"), ("40", "50", "communicates-with"), ("20", "30", "observed-calls"), ("10", "20", "routes-to")]
    return build(spark, nodes, edges)


assert set(schema.RELATION_CODE) == set(schema.RELATIONS)
