"""Command line: fact stores (scan, export, find, show, refs, calls, gc, status, doctor, languages) and graphs (sync,
query, protocol, stats).

``python -m factloom.cli scan --root SOURCES --store STORE`` and so on; results are JSON lines.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

from .graph import Graph, compile_graph
from .operators import lookup, stats
from .operators.extract import generic_facts
from .plans.protocol import QuerySession
from .session import local_session
from .sources import files, jsonl
from .sources.snapshots import Store


def _print(rows) -> None:
    for r in rows.collect() if isinstance(rows, DataFrame) else rows:
        print(json.dumps(r.asDict(recursive=True) if hasattr(r, "asDict") else r, default=str))


def _graph(spark, path: str) -> Graph:
    return files.read_graph(spark, path)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="factloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "rebuild"):
        c = sub.add_parser(name)
        c.add_argument("--root", required=True)
    c = sub.add_parser("export")
    c.add_argument("--out", required=True)
    c = sub.add_parser("gc")
    c.add_argument("--keep", type=int, default=3)
    c.add_argument("--dry-run", action="store_true")
    c = sub.add_parser("find")
    c.add_argument("query")
    c.add_argument("--limit", default=20, type=int)
    for name in ("show", "refs", "calls"):
        sub.add_parser(name).add_argument("selector")
    for name in ("status", "doctor", "languages"):
        sub.add_parser(name)
    for c in sub.choices.values():
        c.add_argument("--store", required=True)
    c = sub.add_parser("sync")
    c.add_argument("--store", required=True)
    c.add_argument("--graph", required=True)
    for name in ("query", "protocol", "stats"):
        c = sub.add_parser(name)
        c.add_argument("--graph", required=True)
        if name == "query":
            c.add_argument("--name", required=True)
            c.add_argument("--reverse", action="store_true")
            c.add_argument("--relation")
    a = p.parse_args(argv)
    spark = local_session("*")
    store = Store(spark, a.store) if hasattr(a, "store") else None
    if a.command in ("scan", "rebuild"):
        store.recover()
        print(store.publish("generic", generic_facts(files.source_tree(spark, a.root))))
    elif a.command == "export":
        m = store.manifest(store.current())
        header = {"record": "header", "schema_version": 1, "adapter_version": "1", "language": m["language"], "repository": ".", "mode": "full"}
        _print([{"language": x} for x in jsonl.export_languages({m["language"]: (header, store.open())}, None, a.out)])
    elif a.command == "gc":
        _print([store.gc(a.keep, a.dry_run)])
    elif a.command == "status":
        _print([store.status()])
    elif a.command == "doctor":
        problems = store.doctor()
        _print([{"problem": x} for x in problems])
        return int(bool(problems))
    elif a.command == "languages":
        _print([{"language": k, "extensions": v} for k, v in files.LANGUAGES.items()])
    elif a.command == "find":
        _print(lookup.find(store.open().nodes, a.query, a.limit))
    elif a.command in ("show", "refs", "calls"):
        f = store.open()
        if a.command == "show":
            _print(lookup.show(f.nodes, a.selector))
        else:
            _print(lookup.refs(f.nodes, f.edges, f.unresolved, lookup.resolve(f.nodes, a.selector), lookup.CALLS if a.command == "calls" else None))
    elif a.command == "sync":
        files.write_graph(compile_graph(store.open()), a.graph)
    elif a.command == "query":
        g = _graph(spark, a.graph)
        for n in lookup.resolve_symbol(g, a.name).select("node_id").collect():
            _print(lookup.neighbors(g, n[0], "incoming" if a.reverse else "outgoing", [a.relation] if a.relation else None))
    elif a.command == "stats":
        _print(stats.stats(_graph(spark, a.graph)))
    else:
        QuerySession(_graph(spark, a.graph).persist(), lambda path: _graph(spark, path)).serve(sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
