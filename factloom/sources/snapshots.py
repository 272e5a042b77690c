"""Immutable snapshots of facts: content-addressed manifests, a CURRENT pointer, pending recovery, collection.

Facts of a snapshot are Parquet, partitioned by language and by a shard of the owner, so that opening some files'
facts reads few partitions. Manifests and pointers are small JSON files handled by the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.text import shard
from ..graph import FactSet, GraphError
from .files import atomic_write, dumps


def object_id(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def owner_objects(facts: FactSet) -> DataFrame:
    """``owner, object_id, records``: the identity of each owner's records, whatever their order (null: shared)."""
    parts = [df.select("owner", F.concat(F.lit(f"{name}:"), F.to_json(F.struct(*sorted(df.columns)))).alias("j")) for name, df in (("node", facts.nodes), ("edge", facts.edges), ("unresolved", facts.unresolved))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    digest = F.sha2(F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("j")), F.bit_xor(F.xxhash64(F.lit(1), "j")), F.min(F.sha2("j", 256)), F.max(F.sha2("j", 256))), 256)
    return rows.groupBy("owner").agg(F.concat(F.lit("sha256:"), digest).alias("object_id"), F.count("*").alias("records"))


class Store:
    """``objects/<snapshot>``, ``snapshots/<id>.json``, ``CURRENT``, ``PENDING`` and ``pins/<consumer>`` below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.removeprefix("file://")
        for d in ("objects", "snapshots", "pins"):
            os.makedirs(f"{self.root}/{d}", exist_ok=True)

    def publish(self, language: str, facts: FactSet, meta: dict | None = None) -> str:
        """Write facts, then the manifest, then swap CURRENT; a crash in between leaves CURRENT as it was."""
        owners = [r.asDict() for r in owner_objects(facts).orderBy(F.col("owner").asc_nulls_first()).collect()]
        manifest = {"version": 1, "language": language, "meta": meta or {}, "objects": [[o["owner"], o["object_id"]] for o in owners]}
        snapshot = hashlib.sha256(dumps(manifest).encode()).hexdigest()
        if os.path.exists(f"{self.root}/snapshots/{snapshot}.json"):
            self._point(snapshot)
            return snapshot
        atomic_write(f"{self.root}/PENDING", snapshot)
        for name, df in (("nodes", facts.nodes), ("edges", facts.edges), ("unresolved", facts.unresolved)):
            dealt = df.distinct().withColumn("owner_shard", shard(F.coalesce("owner", F.lit(""))))
            dealt.repartition("owner_shard").write.mode("overwrite").partitionBy("owner_shard").parquet(f"file://{self.root}/objects/{snapshot}/{name}")
        atomic_write(f"{self.root}/snapshots/{snapshot}.json", dumps(manifest))
        self._point(snapshot)
        os.remove(f"{self.root}/PENDING")
        return snapshot

    def _point(self, snapshot: str) -> None:
        atomic_write(f"{self.root}/CURRENT", snapshot)

    def recover(self) -> str | None:
        """Finish or undo a publication that was cut off; gives what it did."""
        try:
            with open(f"{self.root}/PENDING") as f:
                snapshot = f.read()
        except FileNotFoundError:
            return None
        if os.path.exists(f"{self.root}/snapshots/{snapshot}.json"):
            self._point(snapshot)
            done = "finished"
        else:
            shutil.rmtree(f"{self.root}/objects/{snapshot}", ignore_errors=True)
            done = "discarded"
        os.remove(f"{self.root}/PENDING")
        return done

    def current(self) -> str:
        with open(f"{self.root}/CURRENT") as f:
            return f.read()

    def manifest(self, snapshot: str) -> dict:
        try:
            with open(f"{self.root}/snapshots/{snapshot}.json") as f:
                text = f.read()
        except FileNotFoundError as e:
            raise GraphError("snapshot_open_failed", f"no snapshot {snapshot}") from e
        if hashlib.sha256(text.encode()).hexdigest() != snapshot:
            raise GraphError("invalid_snapshot", "the manifest doesn't have its digest")
        return json.loads(text)

    def open(self, snapshot: str | None = None, owners: list[str] | None = None) -> FactSet:
        """Facts of a snapshot; with ``owners`` only their partitions are read."""
        snapshot = snapshot or self.current()
        self.manifest(snapshot)

        def part(name: str, kind: T.StructType) -> DataFrame:
            stored = T.StructType([*kind.fields, T.StructField("owner_shard", T.IntegerType())])
            df = self.spark.read.schema(stored).parquet(f"file://{self.root}/objects/{snapshot}/{name}")
            if owners is not None:
                shards = {int(hashlib.sha256(o.encode()).hexdigest()[:2], 16) % 64 for o in owners}
                df = df.where(F.col("owner_shard").isin(list(shards)) & F.col("owner").isin(owners))
            return df.drop("owner_shard")

        return FactSet(part("nodes", schema.NODE), part("edges", schema.EDGE), part("unresolved", schema.UNRESOLVED))

    def pin(self, consumer: str, snapshot: str) -> None:
        atomic_write(f"{self.root}/pins/{consumer}", snapshot)

    def gc_plan(self, keep: int) -> dict[str, list[str]]:
        """Snapshots to keep (current, newest ``keep``, pinned) and to delete."""
        ids = [f.removesuffix(".json") for f in os.listdir(f"{self.root}/snapshots") if f.endswith(".json")]
        newest = sorted(ids, key=lambda i: (-os.stat(f"{self.root}/snapshots/{i}.json").st_mtime_ns, i))[:keep]
        pins = {open(f"{self.root}/pins/{p}").read() for p in os.listdir(f"{self.root}/pins")}
        held = {self.current(), *newest, *pins} & set(ids)
        return {"keep": sorted(held), "delete": sorted(set(ids) - held)}

    def gc(self, keep: int, dry_run: bool = False) -> dict[str, list[str]]:
        plan = self.gc_plan(keep)
        for i in [] if dry_run else plan["delete"]:
            os.remove(f"{self.root}/snapshots/{i}.json")
            shutil.rmtree(f"{self.root}/objects/{i}", ignore_errors=True)
        return plan

    def status(self) -> dict:
        ids = [f for f in os.listdir(f"{self.root}/snapshots") if f.endswith(".json")]
        current = self.current() if os.path.exists(f"{self.root}/CURRENT") else None
        return {"current": current, "snapshots": len(ids), "pending": os.path.exists(f"{self.root}/PENDING")}

    def doctor(self) -> list[str]:
        """What is wrong with the store."""
        found = []
        if os.path.exists(f"{self.root}/PENDING"):
            found.append("a publication was cut off")
        if not os.path.exists(f"{self.root}/CURRENT"):
            return [*found, "there is no current snapshot"]
        try:
            m = self.manifest(self.current())
            facts = self.open()
            here = {(r["owner"], r["object_id"]) for r in owner_objects(facts).collect()}
            if here != {tuple(o) for o in m["objects"]}:
                found.append("objects differ from the manifest")
        except GraphError as e:
            found.append(str(e))
        return found
