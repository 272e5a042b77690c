"""Lookups, filters and ranked search over compiled graphs and over raw facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import ascii_lower, normalize_path
from ..graph import Graph, GraphError

DEFAULT_LIMIT, MAX_LIMIT = 1000, 10_000
SORTED_OFFSET, ID_BIN = 10_000, 65_536


def bounded(limit: int | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    return min(default if limit is None else limit, most)


def require_kind(kind: str | None) -> None:
    if kind is not None and kind not in schema.NODE_KINDS:
        raise GraphError("invalid_node_kind", f"unknown node kind '{kind}'")


def require_relations(relations) -> tuple[str, ...] | None:
    """The relations in traversal order; None stays None (all)."""
    if relations is None:
        return None
    for r in relations:
        if r not in schema.TRAVERSAL_ORDER:
            raise GraphError("invalid_relation", f"unknown relation '{r}'")
    return tuple(sorted(set(relations), key=schema.TRAVERSAL_ORDER.__getitem__))


def under(path: Column, prefix: str) -> Column:
    """Whether a path is ``prefix`` or lies below it."""
    return (path == prefix) | path.startswith(prefix + "/")


def resolve_symbol(g: Graph, name: str, kind: str | None = None, path: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes of exactly that name (and kind, and normalised path), by id."""
    require_kind(kind)
    n = g.nodes.where(F.col("name") == name)
    n = n.where(F.col("kind") == kind) if kind else n
    n = n.where(F.col("path") == normalize_path(path)) if path is not None else n
    return n.orderBy("node_id").limit(bounded(limit))


def resolve_file(g: Graph, path: str, limit: int | None = None) -> DataFrame:
    return g.nodes.where((F.col("path") == normalize_path(path)) & (F.col("kind") == "file")).orderBy("node_id").limit(bounded(limit))


def entry(g: Graph, node_id: int) -> DataFrame:
    return g.nodes.where(F.col("node_id") == node_id)


def by_key(g: Graph, key: str) -> DataFrame:
    return g.nodes.where(F.col("key") == key).select("node_id")


def selected(g: Graph, kind: str | None = None, path_prefix: str | None = None) -> DataFrame:
    require_kind(kind)
    n = g.nodes.where(F.col("kind") == kind) if kind else g.nodes
    return n.where(under(F.col("path"), normalize_path(path_prefix))) if path_prefix is not None else n


def list_nodes(g: Graph, kind: str | None = None, path_prefix: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """One page by id. Beyond ``SORTED_OFFSET`` the nodes before it are counted in bins of ids and not sorted."""
    n = selected(g, kind, path_prefix)
    if offset > SORTED_OFFSET:
        bins = n.groupBy(F.floor(F.col("node_id") / ID_BIN).alias("bin")).count().orderBy("bin").collect()
        # of whole bins before the page only their counts matter
        first = 0
        while first < len(bins) and bins[first]["count"] <= offset:
            offset -= bins[first]["count"]
            first += 1
        if first == len(bins):
            return n.limit(0)
        last, left = first, bins[first]["count"] - offset
        while left < bounded(limit) and last + 1 < len(bins):
            last += 1
            left += bins[last]["count"]
        n = n.where(F.col("node_id").between(bins[first]["bin"] * ID_BIN, (bins[last]["bin"] + 1) * ID_BIN - 1))
    return n.orderBy("node_id").offset(offset).limit(bounded(limit))


@dataclass
class Page:
    total: int
    offset: int
    next_offset: int | None


def page(total: int, offset: int, limit: int) -> Page:
    """``next_offset`` is set only if rows are left after the page."""
    at = min(offset, total)
    return Page(total, at, at + limit if at + limit < total else None)


def search_nodes(g: Graph, query: str, limit: int | None = None) -> DataFrame:
    """Exact, prefix and substring matches in name, qualified name and path, best rank first.

    Only ids are ranked; the winners' other columns are fetched by the projection after the top-k.
    """
    slashed = "/".join(query.strip().split("\\"))
    q = ascii_lower(slashed)
    if not q:
        return g.nodes.where("false").withColumns({"rank": F.lit(0), "matched_fields": F.array().cast("array<string>")})
    fields, ranks = ("name", "qualified_name", "path"), []
    for i, f in enumerate(fields):
        v = ascii_lower(F.col(f))
        ranks.append(F.when(v == q, F.lit(i)).when(v.startswith(q), F.lit(3 + i)).when(v.contains(q), F.lit(6 + i)))
    matched = F.array_compact(F.array(*[F.when(r.isNotNull(), F.lit(f)) for r, f in zip(ranks, fields, strict=True)]))
    out = g.nodes.withColumns({"rank": F.least(*ranks), "matched_fields": matched}).where(F.col("rank").isNotNull())
    return out.orderBy("rank", "qualified_name", "path", "node_id").limit(bounded(limit))


def unresolved(g: Graph, node_id: int | None = None, path: str | None = None, reason: str | None = None, relation: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct unresolved facts; ``path`` is that of the source node."""
    require_relations([relation] if relation else None)
    u = g.unresolved.distinct()
    u = u.where(F.col("source_node_id") == node_id) if node_id is not None else u
    u = u.where(F.col("reason") == reason) if reason else u
    u = u.where(F.col("relation") == relation) if relation else u
    if path is not None:
        here = g.nodes.where(F.col("path") == normalize_path(path)).select(F.col("node_id").alias("source_node_id"))
        u = u.join(here, "source_node_id", "left_semi")
    order = ["source_node_id", F.expr(f"array_position(array({','.join(repr(r) for r in schema.RELATIONS)}), relation)"), "expression", "candidate_namespace", "candidate_name", "reason"]
    return u.orderBy(*order).limit(bounded(limit))


def neighbors(g: Graph, node_id: int, direction: str = "outgoing", relations=None, limit: int | None = None) -> DataFrame:
    """One hop in storage order (other node, code), over at most ``clamp(16 * limit, 1024, 16384)`` edges."""
    relations, limit = require_relations(relations), bounded(limit)
    own, other = ("src", "dst") if direction == "outgoing" else ("dst", "src")
    e = g.edges.where(F.col(own) == node_id).select(F.col(other).alias("node_id"), "relation", "code")
    e = e.orderBy("node_id", "code").limit(min(max(16 * limit, 1024), 16_384))
    e = e.where(F.col("relation").isin(*relations)) if relations else e
    return e.join(g.nodes, "node_id").orderBy("node_id", "code").limit(limit)


# Raw facts


def find(nodes: DataFrame, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Rank 0 exact, 1 exact but for case, 2 prefix, 3 substring, over qualified name, name, path and kind."""
    q, fields = query.lower(), ("qualified_name", "name", "path", "kind")

    def any_of(test) -> Column:
        out = F.lit(False)
        for f in fields:
            out = out | test(F.col(f))
        return out

    rank = (
        F.when(any_of(lambda c: c == query), 0).when(any_of(lambda c: F.lower(c) == q), 1)
        .when(any_of(lambda c: F.lower(c).startswith(q)), 2).when(any_of(lambda c: F.lower(c).contains(q)), 3)
    )
    return nodes.withColumn("rank", rank).where(F.col("rank").isNotNull()).orderBy("rank", "qualified_name", "path", "id").limit(limit)


def resolve(nodes: DataFrame, selector: str) -> str:
    """The id of the one node with that id, or else of that qualified name, name or path."""
    if not nodes.where(F.col("id") == selector).isEmpty():
        return selector
    hits = nodes.where((F.col("qualified_name") == selector) | (F.col("name") == selector) | (F.col("path") == selector))
    ids = [r["id"] for r in hits.select("id").distinct().orderBy("id").limit(101).collect()]
    if not ids:
        raise GraphError("not_found", f"nothing is called '{selector}'")
    if len(ids) > 1:
        raise GraphError("ambiguous", f"'{selector}' fits {', '.join(ids)}")
    return ids[0]


def show(nodes: DataFrame, selector: str) -> DataFrame:
    return nodes.where(F.col("id") == resolve(nodes, selector))


def refs(nodes: DataFrame, edges: DataFrame, unresolved_facts: DataFrame, node: str, relations=None) -> DataFrame:
    """Edges at a node, outgoing before incoming (a loop is outgoing), and its unresolved facts."""
    e = edges.where((F.col("source") == node) | (F.col("target") == node))
    u = unresolved_facts.where(F.col("source") == node)
    if relations:
        e, u = e.where(F.col("relation").isin(*relations)), u.where(F.col("relation").isin(*relations))
    out = F.col("source") == node
    found = e.select(F.when(out, "outgoing").otherwise("incoming").alias("direction"), "relation", F.when(out, F.col("target")).otherwise(F.col("source")).alias("id"))
    names = nodes.select("id", "qualified_name", "path")
    found = found.distinct().join(names, "id", "left").select("direction", "relation", "id", "qualified_name", "path", F.lit(None).cast("string").alias("expression"))
    none = [F.lit(None).cast("string").alias(c) for c in ("id", "qualified_name", "path")]
    return found.unionByName(u.select(F.lit("unresolved").alias("direction"), "relation", *none, "expression").distinct())


CALLS = ("calls", "possible-calls", "calls-endpoint")


# Semantic rules over behaviour facts: action and flow nodes below callables, capabilities as ``kind:detail`` names.


def missing_behaviour(nodes: DataFrame, edges: DataFrame, trigger: str, required: tuple[str, ...], capability: str) -> DataFrame:
    """Nodes whose name's first part is ``trigger`` and that contain no node of ``required``, in files that declare
    ``capability``: ``swallowed-error`` is a catch without report or rethrow, ``unobserved-outcome`` an action whose
    outcome nothing reads."""
    head = F.split("name", ":")[0]
    able = nodes.where(F.col("name") == f"capability:{capability}").select("path").distinct()
    triggers = nodes.where(head == trigger).join(able, "path", "left_semi")
    inner = nodes.where(head.isin(*required)).select(F.col("id").alias("target"))
    eased = edges.where(F.col("relation").isin("contains", "defines")).join(inner, "target", "left_semi").select(F.col("source").alias("id"))
    return triggers.join(eased, "id", "left_anti")


def per_node_top(edges: DataFrame, most: int) -> DataFrame:
    """The first ``most`` edges of each source by priority, relation and target."""
    w = Window.partitionBy("src").orderBy("priority", "relation", "dst")
    return edges.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
