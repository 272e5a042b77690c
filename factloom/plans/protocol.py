"""Requests as dictionaries or JSON lines, answered by the operators; the only place that collects results."""

from __future__ import annotations

import json
import re
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, GraphError
from ..operators import components, diff, export, lookup, stats, traverse

def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class QuerySession:
    """Answers one request at a time; an error is an answer, and the session goes on."""

    def __init__(self, graph: Graph, open_snapshot=None):
        self.graph, self.open_snapshot = graph, open_snapshot

    def handle_line(self, line: str) -> str:
        try:
            request = json.loads(line)
        except ValueError as e:
            return json.dumps({"ok": False, "error": {"code": "invalid_json", "message": str(e)}})
        return json.dumps(self.handle(request), default=str)

    def serve(self, source: IO[str], sink: IO[str]) -> None:
        for line in source:
            if line.strip():
                sink.write(self.handle_line(line) + "\n")
                sink.flush()

    def handle(self, request: dict) -> dict:
        head = {"id": request["id"]} if "id" in request else {}
        try:
            args = {k: v for k, v in request.items() if k not in ("id", "op")}
            if request.get("op") not in operations():
                raise GraphError("invalid_json", f"unknown operation {request.get('op')!r}")
            return head | {"ok": True, "result": getattr(self, f"_{request['op']}")(**args)}
        except GraphError as e:
            return head | {"ok": False, "error": {"code": e.code, "message": str(e)}}
        except ValueError as e:
            return head | {"ok": False, "error": {"code": "invalid_path", "message": str(e)}}
        except TypeError as e:
            return head | {"ok": False, "error": {"code": "invalid_json", "message": str(e)}}
        except Exception as e:
            return head | {"ok": False, "error": {"code": "query_failed", "message": str(e)[:500]}}

    def _capabilities(self):
        return {"operations": operations()}

    def _search_nodes(self, query, limit=None):
        return {"nodes": _rows(lookup.search_nodes(self.graph, query, limit))}

    def _resolve_symbol(self, name, kind=None, path=None, limit=None):
        return {"nodes": _rows(lookup.resolve_symbol(self.graph, name, kind, path, limit))}

    def _resolve_file(self, path, limit=None):
        return {"nodes": _rows(lookup.resolve_file(self.graph, path, limit))}

    def _list_nodes(self, kind=None, path_prefix=None, offset=0, limit=None):
        total = lookup.selected(self.graph, kind, path_prefix).count()
        p = lookup.page(total, offset or 0, lookup.bounded(limit))
        return {"nodes": _rows(lookup.list_nodes(self.graph, kind, path_prefix, p.offset, limit)), "total": p.total, "offset": p.offset} | ({"next_offset": p.next_offset} if p.next_offset is not None else {})

    def _export_graph(self, path_prefix=None, offset=0, limit=None, pinned_node_ids=()):
        total = lookup.selected(self.graph, None, path_prefix).count()
        p = lookup.page(total, offset or 0, lookup.bounded(limit, 1000, 100_000))
        nodes, edges = export.export_graph(self.graph, path_prefix, p.offset, limit, pinned_node_ids or ())
        return {"nodes": _rows(nodes), "edges": _rows(edges), "total": p.total} | ({"next_offset": p.next_offset} if p.next_offset is not None else {})

    def _neighbors(self, node_id, direction, relation=None, relations=None, limit=None):
        traverse.require_node(self.graph, node_id)
        wanted = relations if relations is not None else [relation] if relation else None
        rows = _rows(lookup.neighbors(self.graph, node_id, direction, wanted, lookup.bounded(limit) + 1))
        return {"neighbors": rows[: lookup.bounded(limit)], "count": len(rows), "truncated": len(rows) > lookup.bounded(limit)}

    def _paths(self, from_node_id, to_node_id, relations=None, max_depth=None, limit=None):
        rows = _rows(traverse.paths(self.graph, from_node_id, to_node_id, relations, max_depth, limit))
        cut = rows[0]["truncated"] if rows else limit == 0
        return {"paths": rows, "count": len(rows), "truncated": bool(cut), "max_depth": traverse.bounded_depth(max_depth)}

    def _reachability(self, entry_node_ids, include_possible=True, max_depth=None, limit=None):
        rows = _rows(traverse.reachability(self.graph, entry_node_ids, include_possible, max_depth, limit).orderBy("depth", "node_id"))
        return {"nodes": rows, "count": len(rows), "max_depth": traverse.bounded_depth(max_depth)}

    def _impact(self, node_id, relations=None, max_depth=None, limit=None):
        rows = _rows(traverse.impact(self.graph, node_id, relations, max_depth, limit).orderBy("depth", "node_id"))
        used = lookup.require_relations(relations) or lookup.require_relations(traverse.schema.IMPACT_RELATIONS)
        return {"nodes": rows, "count": len(rows), "relations": list(used), "max_depth": traverse.bounded_depth(max_depth)}

    def _shortest_call_chain(self, from_node_id, to_node_id, include_possible=True, max_depth=None):
        row = traverse.shortest_call_chain(self.graph, from_node_id, to_node_id, include_possible, max_depth).first()
        return {"found": row is not None, "chain": row and row.asDict(), "max_depth": traverse.bounded_depth(max_depth)}

    def _dead_symbols(self, entry_node_ids, include_possible=True, kinds=None, max_depth=None, limit=None):
        rows = _rows(traverse.dead_symbols(self.graph, entry_node_ids, include_possible, kinds, max_depth, limit))
        return {"nodes": rows, "count": len(rows)}

    def _operational_role(self, node_id, entry_node_ids=(), include_possible=True, max_depth=None):
        return traverse.operational_role(self.graph, node_id, entry_node_ids or (), include_possible, max_depth)

    def _architecture_summary(self, path_prefix=None, relations=None, min_community_size=2, limit=None):
        totals, listed = components.summary(self.graph, path_prefix, relations, min_community_size, limit)
        return totals.first().asDict() | {"communities": _rows(listed)}

    def _unresolved(self, node_id=None, path=None, reason=None, relation=None, limit=None):
        if node_id is not None:
            traverse.require_node(self.graph, node_id)
        if reason is not None and reason not in traverse.schema.REASONS and self.graph.unresolved.where(F.col("reason") == reason).isEmpty():
            raise GraphError("invalid_unresolved_reason", f"unknown reason '{reason}'")
        return {"unresolved": _rows(lookup.unresolved(self.graph, node_id, path, reason, relation, limit))}

    def _stats(self):
        out: dict = {"call_resolution": stats.call_resolution(self.graph).first().asDict()}
        for r in stats.stats(self.graph).collect():
            out.setdefault(r["section"], {})[r["name"]] = r["count"]
        return out

    def _diff(self, other_snapshot, limit=None):
        if self.open_snapshot is None:
            raise GraphError("snapshot_open_failed", "no other snapshot can be opened")
        other = self.open_snapshot(other_snapshot)
        if diff.same(self.graph, other):
            return {}
        out: dict = {}
        for r in diff.diff(self.graph, other).orderBy("change", "key").collect():
            out.setdefault(r["change"], []).append(r["key"])
        return {k: v[: lookup.bounded(limit)] for k, v in out.items()}


def operations() -> list[str]:
    """Names of the requests that a session answers: its methods with one leading underscore."""
    return [n[1:] for n in vars(QuerySession) if re.match("_[a-z]", n)]
