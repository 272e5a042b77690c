"""Tab-separated facts and catalogues, source trees, report files and Parquet graph stores."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..graph import FactSet, Graph, GraphError, write_edges

TSV_VERSION = "factloom-tsv-1"
_WIDTH = 10


def write_tsv(facts: FactSet, path: str) -> None:
    """One line a fact: kind of record, then its fields; the folder's ``version`` line comes from the first column."""

    def lines(df: DataFrame, mark: str, cols: list[Column]) -> DataFrame:
        fields = [F.lit(mark), *cols, *[F.lit(None).cast("string")] * (_WIDTH - 1 - len(cols))]
        return df.select(*[f.cast("string").alias(f"c{i}") for i, f in enumerate(fields)])

    span = F.to_json("span")
    n = lines(facts.nodes, "node", [F.col(c) for c in ("id", "kind", "path", "name", "qualified_name", "content_id", "owner")] + [span, F.col("attributes")])
    e = lines(facts.edges, "edge", [F.col(c) for c in ("source", "target", "relation", "owner")] + [span, F.col("attributes")])
    u = lines(facts.unresolved, "unresolved", [F.col(c) for c in "source relation expression reason candidate_name candidate_namespace owner".split()] + [span, F.col("attributes")])
    spark = facts.nodes.sparkSession
    head = spark.createDataFrame([(TSV_VERSION,)], "c0 string").select("c0", *[F.lit(None).cast("string").alias(f"c{i}") for i in range(1, _WIDTH)])
    head.unionByName(n).unionByName(e).unionByName(u).write.mode("overwrite").csv(path, sep="\t", nullValue="\\N", escape='"', quoteAll=True, emptyValue="")


def read_tsv(spark: SparkSession, path: str) -> FactSet:
    rows = spark.read.csv(path, sep="\t", schema=", ".join(f"c{i} string" for i in range(_WIDTH)), nullValue="\\N", emptyValue="", escape='"', quote='"', multiLine=True)
    if rows.where(F.col("c0") == TSV_VERSION).isEmpty():
        raise GraphError("invalid_facts", "the version line is missing")

    def part(mark: str, cols: list[str], kind) -> DataFrame:
        df = rows.where(F.col("c0") == mark).select(*[F.col(f"c{i + 1}").alias(c) for i, c in enumerate(cols)])
        return df.withColumn("span", F.from_json("span", schema.SPAN)).select(*kind.fieldNames())

    return FactSet(
        part("node", ["id", "kind", "path", "name", "qualified_name", "content_id", "owner", "span", "attributes"], schema.NODE),
        part("edge", ["source", "target", "relation", "owner", "span", "attributes"], schema.EDGE),
        part("unresolved", "source relation expression reason candidate_name candidate_namespace owner span attributes".split(), schema.UNRESOLVED),
    )


def write_catalogue(nodes: DataFrame, path: str) -> None:
    nodes.orderBy("node_id").write.mode("overwrite").csv(path, sep="\t", nullValue="\\N", emptyValue="", quoteAll=True, escape='"')


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    kind = "node_id int, key string, kind string, path string, name string, qualified_name string, content_id string"
    return spark.read.csv(path, sep="\t", schema=kind, nullValue="\\N", emptyValue="", escape='"', multiLine=True)


def write_graph(g: Graph, path: str) -> None:
    """Nodes in id ranges, edges by source and by target, unresolved facts by source: statistics prune each of them."""
    g.nodes.repartitionByRange("node_id").sortWithinPartitions("node_id").write.mode("overwrite").parquet(f"{path}/nodes")
    write_edges(g.edges, f"{path}/edges")
    g.unresolved.repartitionByRange("source_node_id").sortWithinPartitions("source_node_id").write.mode("overwrite").parquet(f"{path}/unresolved")


def read_graph(spark: SparkSession, path: str, direction: str = "outgoing") -> Graph:
    side = "by_src" if direction == "outgoing" else "by_dst"
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges/{side}"), spark.read.parquet(f"{path}/unresolved"))


def write_overlay(added: DataFrame, removed: DataFrame, path: str) -> None:
    added.write.mode("overwrite").parquet(f"{path}/added")
    removed.write.mode("overwrite").parquet(f"{path}/removed")


def read_overlay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/added"), spark.read.parquet(f"{path}/removed")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


LANGUAGES = {
    "python": ("py", "pyi"), "rust": ("rs",), "go": ("go",), "typescript": ("ts", "tsx", "js", "jsx", "mjs", "cjs", "svelte"),
    "c-family": ("c", "h", "cc", "cpp", "cxx", "hpp", "hh"), "kotlin": ("kt", "kts"), "java": ("java",), "csharp": ("cs",),
    "ruby": ("rb",), "gdscript": ("gd",), "lotusscript": ("lss",),
}
CONFIG_FILES = {"pyproject.toml": "python", "Cargo.toml": "rust", "go.mod": "go", "package.json": "typescript", "tsconfig.json": "typescript", "build.gradle.kts": "kotlin", "Gemfile": "ruby", "project.godot": "gdscript"}
IGNORED = tuple(".git .venv __pycache__ build dist node_modules target".split())


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1)


def language_of(path: Column) -> Column:
    """The language of a path by extension or configuration file, else ``generic-<extension>``; null if it has neither."""
    by_ext = F.create_map(*[F.lit(x) for lang, exts in LANGUAGES.items() for e in exts for x in (e, lang)])
    by_name = F.create_map(*[F.lit(x) for kv in CONFIG_FILES.items() for x in kv])
    ext = F.lower(extension(path))
    return F.coalesce(by_name[F.element_at(F.split(path, "/"), -1)], by_ext[ext], F.when(ext != "", F.concat(F.lit("generic-"), ext)))


def owns_source(path: Column) -> Column:
    """Whether the path is a source file of its language, not a configuration file."""
    return language_of(path).isNotNull() & ~F.element_at(F.split(path, "/"), -1).isin(list(CONFIG_FILES))


def source_tree(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """``path, language, text, content_id`` of the files below ``root``, ignored folders apart."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), f"^{base}/", "")
    out = raw.select(path.alias("path"), "content").where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in ignored])))
    return out.select("path", language_of(F.col("path")).alias("language"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_id"))


def source_lines(files: DataFrame) -> DataFrame:
    """``path, line_no, line``."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def dumps(value) -> str:
    """Canonical JSON: sorted keys, no blanks."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def atomic_write(path: str, text: str) -> None:
    tmp = f"{path}.{os.getpid()}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, path)
