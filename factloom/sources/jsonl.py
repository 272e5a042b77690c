"""Fact streams as JSON lines: header, nodes, edges and unresolved records; validation and canonical order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..graph import FactSet, GraphError

ID = "^sha256:(?:[a-f0-9]{2}){32}$"


def read(spark: SparkSession, path: str, validate: bool = True, linker_language: str = "cross-language") -> tuple[dict, FactSet]:
    """Header and facts of a stream. Lines are parsed with fixed schemas; unknown keys are errors when validating."""
    lines = spark.read.text(path).withColumn("record", F.get_json_object("value", "$.record"))
    heads = lines.where(~F.coalesce("record", F.lit("")).isin(*schema.RECORDS)).select(F.from_json("value", schema.HEADER).alias("h"), F.col("value")).limit(2).collect()
    if len(heads) != 1 or heads[0]["h"] is None or not heads[0]["h"]["record"]:
        raise GraphError("invalid_facts", "a stream needs exactly one header")
    header = heads[0]["h"].asDict()
    if validate:
        check_header(header)
        for name, kind in schema.RECORDS.items():
            extra = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(x) for x in (*kind.fieldNames(), "record")]))
            if not lines.where((F.col("record") == name) & (F.coalesce(F.size(extra), F.lit(1)) > 0)).isEmpty():
                raise GraphError("invalid_facts", f"a {name} record has unknown keys")
    parts = {n: lines.where(F.col("record") == n).select(F.from_json("value", k).alias("r")).select("r.*") for n, k in schema.RECORDS.items()}
    facts = FactSet(parts["node"], parts["edge"], parts["unresolved"])
    if validate and (problems := [r.asDict() for r in violations(facts, header, linker_language).limit(20).collect()]):
        raise GraphError("invalid_facts", "; ".join(f"{p['rule']}: {p['record']}" for p in problems))
    return header, facts


def check_header(h: dict) -> None:
    if h.get("schema_version") != schema.SCHEMA_VERSION:
        raise GraphError("invalid_header", f"schema version {h.get('schema_version')} is not {schema.SCHEMA_VERSION}")
    for k in ("adapter_version", "language", "repository"):
        if not h.get(k):
            raise GraphError("invalid_header", f"{k} is empty")
    if h.get("mode") not in (None, "full", "incremental"):
        raise GraphError("invalid_header", f"unknown mode {h['mode']}")
    if h.get("mode") == "incremental" and (h.get("changed_files") is None or h.get("removed_files") is None or h.get("shared_complete") is None):
        raise GraphError("invalid_header", "an incremental stream names changed and removed files and says if shared facts are complete")
    for k in ("changed_files", "removed_files"):
        paths = h.get(k) or []
        if any(a >= b for a, b in zip(paths, paths[1:], strict=False)):
            raise GraphError("invalid_header", f"{k} is not strictly ascending")


def bad_path(p: Column) -> Column:
    parts = F.split(p, "/")
    return p.contains("\\") | p.startswith("/") | p.rlike("^[A-Za-z]:") | ((p != ".") & F.exists(parts, lambda x: x.isin("", ".", "..")))


def bad_span(s: Column) -> Column:
    first = (s["start_line"] < 1) | (s["start_column"] < 1)
    back = F.struct(s["end_line"], s["end_column"]) < F.struct(s["start_line"], s["start_column"])
    return s.isNotNull() & (first | back | bad_path(s["path"]))


def violations(facts: FactSet, header: dict | None = None, linker_language: str = "cross-language") -> DataFrame:
    """``rule, record`` of everything that breaks an integrity rule; nothing is gathered in one place."""
    n, e, u = facts.nodes, facts.edges, facts.unresolved
    out = []

    def add(rule: str, df: DataFrame, what) -> None:
        out.append(df.select(F.lit(rule).alias("rule"), F.col(what).cast("string").alias("record") if isinstance(what, str) else what.alias("record")))

    add("node-id", n.where(~F.coalesce(F.col("id").rlike(ID), F.lit(False))), "id")
    add("node-path", n.where(F.coalesce(bad_path(F.col("path")), F.lit(True))), "id")
    add("node-span", n.where(bad_span(F.col("span"))), "id")
    add("root-node", n.where((F.col("path") == ".") & (F.col("owner").isNotNull() | F.col("span").isNotNull() | (F.col("kind") == "file"))), "id")
    add("conflicting-node", n.distinct().groupBy("id").count().where("count > 1"), "id")
    for name, df, cols in (("edge", e, ("source", "target")), ("unresolved", u, ("source",))):
        for c in cols:
            add(f"{name}-{c}-id", df.where(~F.coalesce(F.col(c).rlike(ID), F.lit(False))), c)
        add(f"{name}-span", df.where(bad_span(F.col("span"))), "source")
        if not header or header.get("language") != linker_language:
            add(f"{name}-source-missing", df.join(n.select(F.col("id").alias("source")), "source", "left_anti"), "source")
    if header and header.get("mode") == "incremental":
        allowed = set(header["changed_files"]) - set(header["removed_files"])
        for name, df in (("node", n), ("edge", e), ("unresolved", u)):
            add(f"{name}-owner", df.where(F.col("owner").isNotNull() & ~F.col("owner").isin(list(allowed))), "owner")
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


#: The optional vocabulary of behaviour facts: heads of ``kind:detail`` names.
BEHAVIOUR = ("capability", "action", "flow", "outcome", "catch", "throw", "report", "return", "observe")


def behaviour_violations(nodes: DataFrame) -> DataFrame:
    """Nodes with a ``behaviour`` attribute whose name's head is outside the vocabulary."""
    marked = nodes.where(F.get_json_object("attributes", "$.behaviour").isNotNull())
    return marked.where(~F.split("name", ":")[0].isin(*BEHAVIOUR)).select("id", "name")


_SPAN_ORDER = [f"span.{f}" for f in schema.SPAN.fieldNames()]


def canonical_order(record: str) -> list[Column]:
    """Sort columns of a record type; absent owners and spans come first, absent attributes last."""
    keys = {"node": ["path", "kind", "qualified_name", "name", "id"], "edge": ["source", "relation", "target"], "unresolved": ["source", "relation", "expression", "reason", "candidate_namespace", "candidate_name"]}[record]
    return [*(F.col(c).asc_nulls_first() for c in (*keys, "owner", *_SPAN_ORDER)), F.col("attributes").asc_nulls_last()]


def write(facts: FactSet, header: dict, path: str) -> None:
    """Canonical stream: one line a record with sorted keys and no nulls, nodes, then edges, then unresolved, in order.

    Lines are range-partitioned, so the files in name order are the stream; the header is in the first.
    """
    spark = facts.nodes.sparkSession
    head = spark.createDataFrame([header], schema.HEADER).select(F.lit(0).alias("part"), F.array().cast("array<string>").alias("k"), F.to_json(F.struct(*sorted(schema.HEADER.fieldNames()))).alias("value"))
    parts = [head]
    for i, (name, kind) in enumerate(schema.RECORDS.items()):
        df = {"node": facts.nodes, "edge": facts.edges, "unresolved": facts.unresolved}[name].distinct()
        cols = sorted([*kind.fieldNames(), "record"])
        line = F.to_json(F.struct(*cols))
        key = F.array(*[F.coalesce(F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(c).cast("string"))), F.lit("")) for c in _keys(name)], F.coalesce(F.col("attributes"), F.lit("\U0010ffff")))
        parts.append(df.withColumn("record", F.lit(name)).select(F.lit(i + 1).alias("part"), key.alias("k"), line.alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.orderBy("part", "k", "value").select("value").write.mode("overwrite").text(path)


def _keys(record: str) -> list[str]:
    return {"node": ["path", "kind", "qualified_name", "name", "id"], "edge": ["source", "relation", "target"], "unresolved": ["source", "relation", "expression", "reason", "candidate_namespace", "candidate_name"]}[record] + ["owner"]


def export_languages(facts_by_language: dict[str, tuple[dict, FactSet]], wanted: list[str] | None, path: str) -> list[str]:
    """One canonical stream a language below ``path``; unknown languages are an error."""
    names = wanted or sorted(facts_by_language)
    for name in names:
        if name not in facts_by_language:
            raise GraphError("unknown_language", f"no facts for '{name}'")
    for name in names:
        header, facts = facts_by_language[name]
        write(facts, header, f"{path}/{name}.jsonl")
    return names
