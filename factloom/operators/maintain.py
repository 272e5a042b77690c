"""Incremental maintenance: ownership, changed files, dependency closures, scan plans and safety checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_name, parent_path
from ..graph import FactSet, Graph, GraphError, changed_rows, edge_changes, numbered_edges, reference
from ..session import materialise
from ..sources.files import language_of, owns_source

STRUCTURAL = ("repository", "directory")


def node_path_owner(path: Column, kind: Column) -> Column:
    return F.when(~kind.isin(*STRUCTURAL) & F.element_at(F.split(path, "/"), -1).contains("."), path)


def graph_owners(facts: FactSet) -> FactSet:
    """Owners for graph updates: the span's path, else for nodes a path with an extension, else for edges the
    source's owner and then the target's, and for unresolved facts the source's."""
    n = facts.nodes.withColumn("owner", F.coalesce("span.path", node_path_owner(F.col("path"), F.col("kind"))))
    owners = n.groupBy(F.col("id").alias("_id")).agg(F.min("owner").alias("_o"))

    def owned(df: DataFrame, owner: Column) -> DataFrame:
        return df.withColumn("owner", owner).select(*facts.edges.columns)

    # each edge only meets the ends that its owner depends on
    rest = facts.edges.where("span.path is null").join(owners.toDF("source", "_so"), "source", "left")
    e = owned(facts.edges.where("span.path is not null"), F.col("span.path")).unionByName(owned(rest.where("_so is not null"), F.col("_so")))
    e = e.unionByName(owned(rest.where("_so is null").join(owners.toDF("target", "_to"), "target", "left"), F.col("_to")))
    return FactSet(n.select(*facts.nodes.columns), e, _sourced(facts.unresolved, owners, F.col("span.path")))


def _sourced(df: DataFrame, owners: DataFrame, own: Column) -> DataFrame:
    """Facts with ``own`` as owner, or where that is null their source's; only the latter are shuffled."""
    rest = df.where(own.isNull()).join(owners.toDF("source", "_so"), "source", "left").withColumn("owner", F.col("_so"))
    return df.where(own.isNotNull()).withColumn("owner", own).select(*df.columns).unionByName(rest.select(*df.columns))


def fact_owners(facts: FactSet) -> FactSet:
    """Owners for fact storage: the record's own, its span's path, a file node's path, the source's owner; the target
    never counts."""
    n = facts.nodes.withColumn("owner", F.coalesce("owner", "span.path", F.when(F.col("kind") == "file", F.col("path"))))
    owners = n.groupBy(F.col("id").alias("source")).agg(F.min("owner").alias("_so"))
    follow = lambda df: _sourced(df, owners, F.coalesce("owner", "span.path"))
    return FactSet(n.select(*facts.nodes.columns), follow(facts.edges), follow(facts.unresolved))


def _each(a: FactSet, b: FactSet, f) -> FactSet:
    return FactSet(f(a.nodes, b.nodes), f(a.edges, b.edges), f(a.unresolved, b.unresolved))


#: Files by name, or a condition on the owner (a folder, say), which needs no list of them.
Files = list[str] | Callable[[Column], Column]


def _among(files: Files) -> Column:
    return files(F.col("owner")) if callable(files) else F.col("owner").isin(files)


def replace_changed(base: FactSet, new: FactSet, changed: Files) -> FactSet:
    """Shared facts (no owner) and those of changed files come from ``new``, all others from ``base``."""
    hit = _among(changed)
    return _each(base, new, lambda x, y: x.where(F.col("owner").isNotNull() & ~hit).unionByName(y.where(F.col("owner").isNull() | hit)).distinct())


def apply_incremental(base: FactSet, delta: FactSet, changed: Files, removed: list[str], shared_complete: bool) -> FactSet:
    """Facts after an incremental stream.

    All that changed and removed files own goes; with ``shared_complete`` shared facts are replaced, else the new
    ones are added. Edges and unresolved facts at nodes that are gone go with them.
    """
    hit = _among(changed)
    gone = hit | _among(removed)

    def merge(x: DataFrame, y: DataFrame) -> DataFrame:
        kept = x.where(F.col("owner").isNotNull() & ~gone)
        shared = y.where("owner is null") if shared_complete else x.where("owner is null").unionByName(y.where("owner is null"))
        return kept.unionByName(shared).unionByName(y.where(hit)).distinct()

    out = _each(base, delta, merge)
    ids = out.nodes.select("id").distinct()
    before = base.nodes.select("id").unionByName(delta.nodes.select("id")).distinct()
    # written, since both ends of all edges meet it
    dead = materialise(before.join(ids, "id", "left_anti"), "dead")
    edges = out.edges.join(dead.toDF("source"), "source", "left_anti").join(dead.toDF("target"), "target", "left_anti").select(*out.edges.columns)
    unresolved = out.unresolved.join(dead.toDF("source"), "source", "left_anti").select(*out.unresolved.columns)
    return FactSet(out.nodes, edges, unresolved)


def changed_objects(old: DataFrame, new: DataFrame) -> DataFrame:
    """Owners whose object (``owner, object_id``) is new or different: only these are written again."""
    return new.join(old.withColumnRenamed("object_id", "_old"), new["owner"].eqNullSafe(old["owner"]), "left").where(~F.col("object_id").eqNullSafe(F.col("_old"))).select(new["owner"], "object_id")


def needs_full(old: DataFrame, new: DataFrame) -> bool:
    """Whether the shared object changed, which strict maintenance answers with a full scan."""
    return not changed_objects(old, new).where("owner is null").isEmpty()


def merge_shared(base: FactSet, delta: FactSet, touched: list[str]) -> FactSet:
    """Shared records after dropping those whose span lies in touched paths or that are incident to their nodes."""
    hit = base.nodes.where(F.col("path").isin(touched)).select("id").distinct()

    def away(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
        df2 = df.where(~F.coalesce(F.col("span.path").isin(touched), F.lit(False)))
        for c in cols:
            df2 = df2.join(hit.toDF(c), c, "left_anti")
        return df2.select(*df.columns)

    kept = FactSet(away(base.nodes, ("id",)), away(base.edges, ("source", "target")), away(base.unresolved, ("source",)))
    key = {"nodes": ["id"], "edges": ["source", "target", "relation"], "unresolved": ["source", "relation", "expression"]}

    def upsert(x: DataFrame, y: DataFrame, cols: list[str]) -> DataFrame:
        return x.join(y.select(*cols).distinct(), cols, "left_anti").select(*y.columns).unionByName(y).distinct()

    return FactSet(upsert(kept.nodes, delta.nodes, key["nodes"]), upsert(kept.edges, delta.edges, key["edges"]), upsert(kept.unresolved, delta.unresolved, key["unresolved"]))


def incremental_compile(old: Graph, facts: FactSet) -> tuple[DataFrame, DataFrame]:
    """Edges added and removed against ``old``; a changed set of nodes raises ``node_set_changed`` (compile anew)."""
    # facts by the references of the graph's own compilation need no keys
    numbered = "ref" in facts.nodes.columns and old.numbered is not None
    known = old.numbered if numbered else old.nodes.withColumn("ref", reference(F.col("key")))
    given = facts.nodes.select((F.col("ref") if numbered else reference(F.col("id"))).alias("ref"))
    if not changed_rows(known, given, ["ref"]).isEmpty():
        raise GraphError("node_set_changed", "nodes were added or removed")
    # the same nodes have the same ids, so only edges are compiled; duplicates meet in the comparison
    return edge_changes(old.edges, numbered_edges(facts.edges, known.select("ref", "node_id")))


# Dependencies between files


def file_dependencies(facts: FactSet) -> DataFrame:
    """``file, needs``: a file owns an edge to a node that another file owns."""
    owners = facts.nodes.where("owner is not null").select(F.col("id").alias("target"), F.col("owner").alias("needs")).distinct()
    return facts.edges.where("owner is not null").select(F.col("owner").alias("file"), "target").join(owners, "target").where("file != needs").select("file", "needs").distinct()


def dependencies_delta(old: DataFrame, facts: FactSet, changed: list[str]) -> DataFrame:
    """Dependencies after a change: those of changed files are derived anew from their own edges."""
    fresh = file_dependencies(FactSet(facts.nodes, facts.edges.where(F.col("owner").isin(changed)), facts.unresolved))
    return old.where(~F.col("file").isin(changed)).unionByName(fresh).distinct()


def closure(deps: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """``path, role``: ``emit`` is the roots and what needs them, ``context`` also what those need (one hop each).

    A root that is no known file raises ``full_scan``.
    """
    spark = deps.sparkSession
    start = spark.createDataFrame([(r,) for r in roots], "path string")
    if not start.join(files.select("path"), "path", "left_anti").isEmpty():
        raise GraphError("full_scan", "a root is not indexed")
    emit = start.unionByName(deps.join(start, deps["needs"] == start["path"], "left_semi").select(F.col("file").alias("path"))).distinct()
    context = deps.join(emit, deps["file"] == emit["path"], "left_semi").select(F.col("needs").alias("path")).distinct().join(emit, "path", "left_anti")
    return emit.withColumn("role", F.lit("emit")).unionByName(context.withColumn("role", F.lit("context")))


def scan_plan(changes: DataFrame, enabled: list[str], drift: list[str] = ()) -> DataFrame:
    """``language, full, changed_files, added_files, removed_files`` of ``changes(status, old, new)``.

    Edits of source files are incremental. Additions are incremental for Python alone, renames too (a removal and an
    addition); configuration files, deletions and anything else make their language's scan full, as does drift.
    """
    rename = F.col("status").startswith("R")
    edit = changes.where(F.col("status").startswith("M") | F.col("status").startswith("A")).select(F.col("new").alias("path"), F.when(F.col("status").startswith("A"), "added").otherwise("changed").alias("what"))
    both_python = F.coalesce((language_of(F.col("old")) == "python") & owns_source(F.col("old")) & (language_of(F.col("new")) == "python") & owns_source(F.col("new")), F.lit(False))
    moved = changes.where(rename).select(F.explode(F.array(F.struct(F.col("old").alias("path"), F.when(both_python, "removed").otherwise("full").alias("what")), F.struct(F.col("new").alias("path"), F.when(both_python, "added").otherwise("full").alias("what")))).alias("x")).select("x.*")
    other = changes.where(~F.col("status").rlike("^[MAR]")).select(F.explode(F.array("old", "new")).alias("path"), F.lit("full").alias("what")).where("path is not null and path != ''")
    rows = edit.unionByName(moved).unionByName(other).withColumn("language", language_of(F.col("path"))).where(F.col("language").isin(enabled))
    full = (F.col("what") == "full") | ~owns_source(F.col("path")) | ((F.col("what") == "added") & (F.col("language") != "python"))
    rows = rows.withColumn("full", full)
    pick = lambda w: F.array_sort(F.collect_set(F.when((F.col("what") == w) & ~F.col("full"), F.col("path"))))
    plan = rows.groupBy("language").agg(F.bool_or("full").alias("full"), pick("changed").alias("changed_files"), pick("added").alias("added_files"), pick("removed").alias("removed_files"))
    if not drift:
        return plan
    none = F.array().cast("array<string>")
    forced = changes.sparkSession.createDataFrame([(x,) for x in sorted(set(drift) & set(enabled))], "language string")
    rest = plan.join(forced, "language", "left_anti")
    return rest.unionByName(forced.select("language", F.lit(True).alias("full"), none.alias("changed_files"), none.alias("added_files"), none.alias("removed_files")))


def unsafe_topology(before: FactSet, after: FactSet, selected: list[str]) -> DataFrame:
    """``problem, record``: what an incremental scan of ``selected`` files must not produce: ambiguous or generated
    targets that were not there before, and new relationships owned by other files."""
    odd = F.col("reason").isin("ambiguous-target", "generated-target")
    cols = ["source", "relation", "expression", "reason"]
    new = after.unresolved.where(odd).select(*cols).distinct().join(before.unresolved.where(odd).select(*cols).distinct(), cols, "left_anti")
    key = ["source", "target", "relation"]
    outside = after.edges.where(F.col("owner").isNotNull() & ~F.col("owner").isin(selected)).join(before.edges.select(*key).distinct(), key, "left_anti")
    return new.select(F.lit("unresolved").alias("problem"), F.to_json(F.struct(*cols)).alias("record")).unionByName(outside.select(F.lit("outside").alias("problem"), F.to_json(F.struct(*key)).alias("record")))


def sync_plan(current: dict | None, wanted: dict, changed: list[str] | None, node_set_same: bool = True) -> tuple[str, str]:
    """``existing``, ``incremental`` or ``rebuild`` with the reason, from two graph manifests."""
    if current is None:
        return "rebuild", "no current graph"
    if current.get("corrupt"):
        return "rebuild", "the current graph can't be read"
    for k, why in (("format", "another graph format"), ("policy", "another compile policy"), ("repository", "another repository"), ("languages", "other languages"), ("adapters", "other adapters"), ("schema_version", "another fact schema")):
        if current.get(k) != wanted.get(k):
            return "rebuild", why
    if current.get("facts") == wanted.get("facts"):
        return "existing", "same facts"
    if changed is None:
        return "rebuild", "changed files are unknown"
    if current.get("shared") != wanted.get("shared"):
        return "rebuild", "shared facts changed"
    if not node_set_same:
        return "rebuild", "nodes were added or removed"
    return "incremental", f"{len(changed)} changed files"


def import_context(lines: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """Python files that the roots import, and the package initialisers above each of them."""
    own = lines.where(F.col("path").isin(roots))
    named = own.select("path", F.regexp_extract("line", r"^\s*from\s+(\.*)([\w.]*)\s+import", 1).alias("dots"), F.regexp_extract("line", r"^\s*from\s+\.*([\w.]*)\s+import\s+(\w+)?", 1).alias("module"), F.regexp_extract("line", r"^\s*from\s+\.*[\w.]*\s+import\s+\(?\s*(\w+)", 1).alias("member"), F.regexp_extract("line", r"^\s*import\s+([\w.]+)", 1).alias("plain"))
    base = F.split(F.regexp_replace(module_name(F.col("path")), r"(^|\.)[^.]*$", ""), r"\.")
    up = F.slice(base, 1, F.greatest(F.size(base) - F.length("dots") + 1, F.lit(0)))
    absolute = F.when(F.col("dots") != "", F.array_join(F.filter(F.concat(up, F.array("module")), lambda x: x != ""), ".")).otherwise(F.col("module"))
    wanted = named.select(F.explode(F.array(F.when(F.col("plain") != "", F.col("plain")), F.when(absolute != "", absolute), F.when((F.col("member") != "") & (absolute != ""), F.concat_ws(".", absolute, "member")))).alias("module")).where("module is not null").distinct()
    parts = F.split("module", r"\.")
    each = wanted.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("module")).distinct()
    mods = files.select("path", module_name(F.col("path")).alias("module")).where("module is not null")
    return mods.join(each, "module", "left_semi").select("path").where(~F.col("path").isin(roots)).distinct()


def analysis_scope(files: DataFrame, roots: list[str], language: str) -> DataFrame:
    """Files in the semantic units of the roots: the folder for Go, the crate (nearest ``Cargo.toml``) for Rust, else
    the file itself."""
    spark = files.sparkSession
    start = spark.createDataFrame([(r,) for r in roots], "path string")
    if language == "go":
        dirs = start.select(parent_path(F.col("path")).alias("dir")).distinct()
        return files.withColumn("dir", parent_path(F.col("path"))).join(dirs, "dir", "left_semi").select("path")
    if language == "rust":
        crates = files.where(F.col("path").rlike(r"(^|/)Cargo\.toml$")).select(parent_path(F.col("path")).alias("crate"))

        def nearest(df: DataFrame) -> DataFrame:
            parts = F.split(parent_path(F.col("path")), "/")
            above = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit(".")))
            return df.select("path", F.explode(F.array_distinct(above)).alias("crate")).join(crates, "crate").groupBy("path").agg(F.max_by("crate", F.when(F.col("crate") == ".", 0).otherwise(F.length("crate"))).alias("crate"))

        units = nearest(start).select("crate").distinct()
        return nearest(files).join(units, "crate", "left_semi").select("path")
    return files.join(start, "path", "left_semi").select("path")
