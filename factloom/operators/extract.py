"""Facts from source files by the generic extractor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import mask_udf, node_identity
from ..graph import FactSet
from ..sources.files import source_lines
from .link import extract

HASH_COMMENTS = ("py", "rb", "sh", "pl", "r", "yaml", "yml", "toml", "ex", "exs")


def _span(path: Column, line: Column, text: Column) -> Column:
    n = line.cast("long")
    return F.struct(path.alias("path"), n.alias("start_line"), F.lit(1).cast("long").alias("start_column"), n.alias("end_line"), (F.length(text) + 1).cast("long").alias("end_column"))


def generic_facts(files: DataFrame) -> FactSet:
    """File, module, import and declaration nodes with ``contains``, ``imports`` and ``defines`` edges.

    ``files(path, language, text, content_id)``. Comments are blanked before imports are looked for, strings also
    before declarations; each line keeps its number.
    """
    f = files.where("text is not null").withColumn("language", F.coalesce("language", F.lit("generic")))
    hashed = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*HASH_COMMENTS)
    found = None
    for strings, wanted in ((False, F.col("fact") == "import"), (True, F.col("fact") != "import")):
        text = F.when(hashed, mask_udf("hash", strings)("text")).otherwise(mask_udf("slash", strings)("text"))
        part = extract(source_lines(f.select("path", text.alias("text")))).where(wanted)
        found = part if found is None else found.unionByName(part)
    lines = source_lines(f.select("path", "text"))
    rows = found.join(f.select("path", "language"), "path").join(lines, ["path", "line_no"])
    file_id = node_identity(F.col("language"), F.lit("file"), F.col("path"))
    module_id = node_identity(F.col("language"), F.lit("module"), F.col("path"))
    kind = F.col("fact")
    owner = F.when(kind == "import", F.col("name")).otherwise(F.concat_ws("#", "path", "name", "line_no"))
    row_id = node_identity(F.col("language"), kind, owner)
    none = F.lit(None).cast("string")
    no_span = F.lit(None).cast(schema.SPAN)
    stem = F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/", ".")

    def node(df: DataFrame, i: Column, k: Column, name: Column, path: Column, qname: Column, content: Column, own: Column, span: Column) -> DataFrame:
        return df.select(i.alias("id"), k.alias("kind"), name.alias("name"), path.alias("path"), qname.alias("qualified_name"), content.alias("content_id"), own.alias("owner"), span.alias("span"), none.alias("attributes"))

    here = _span(F.col("path"), F.col("line_no"), F.col("line"))
    nodes = (
        node(f, file_id, F.lit("file"), F.element_at(F.split("path", "/"), -1), F.col("path"), F.col("path"), F.col("content_id"), F.col("path"), no_span)
        .unionByName(node(f, module_id, F.lit("module"), stem, F.col("path"), stem, none, F.col("path"), no_span))
        .unionByName(node(rows.where(kind == "import"), row_id, kind, F.col("name"), F.concat(F.lit("@import/"), "name"), F.col("name"), none, none, no_span))
        .unionByName(node(rows.where(kind != "import"), row_id, kind, F.col("name"), F.col("path"), F.concat(stem, F.lit("."), "name"), none, F.col("path"), here))
    ).distinct()

    def edge(df: DataFrame, a: Column, b: Column, relation: Column, span: Column) -> DataFrame:
        return df.select(a.alias("source"), b.alias("target"), relation.alias("relation"), F.col("path").alias("owner"), span.alias("span"), none.alias("attributes"))

    relation = F.when(kind == "import", "imports").otherwise("defines")
    edges = edge(f, file_id, module_id, F.lit("contains"), no_span).unionByName(edge(rows, module_id, row_id, relation, here)).distinct()
    spark = files.sparkSession
    return FactSet(nodes, edges, spark.createDataFrame([], schema.UNRESOLVED))
