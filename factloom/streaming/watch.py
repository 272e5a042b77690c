"""Watching a folder of fact streams: micro-batches apply incremental updates, publish and run consumers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import FactSet
from ..operators.maintain import apply_incremental
from ..sources.snapshots import Store

IGNORE_FILES = (".gitignore", ".ignore")


@dataclass
class Consumers:
    """Callbacks after a publication. A failure is kept and the others still run; success pins the snapshot."""

    store: Store
    hooks: dict[str, Callable[[str], None]] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)

    def run(self, snapshot: str) -> None:
        self.failures = {}
        for name, hook in sorted(self.hooks.items()):
            try:
                hook(snapshot)
                self.store.pin(name, snapshot)
            except Exception as e:  # a consumer's fault must not stop the others
                self.failures[name] = str(e)


def needs_reconcile(paths: DataFrame) -> bool:
    """Whether a change of ignore rules makes the next scan a full one."""
    return not paths.where(F.element_at(F.split("path", "/"), -1).isin(*IGNORE_FILES)).isEmpty()


def watch_changes(changes: DataFrame, scan: Callable[[list[str], bool], None], checkpoint: str, debounce: str = "150 milliseconds", once: bool = False) -> StreamingQuery:
    """Run ``scan(paths, full)`` for each micro-batch of a stream of changed paths; the trigger interval debounces."""

    def batch(df: DataFrame, _: int) -> None:
        paths = [r[0] for r in df.select("path").distinct().orderBy("path").collect()]
        if paths:
            scan(paths, needs_reconcile(df))

    w = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=debounce)).start()


def maintain(spark: SparkSession, store: Store, language: str, delta: FactSet, changed: list[str], removed: list[str], shared_complete: bool, consumers: Consumers | None = None) -> str:
    """One maintenance step: apply an incremental stream to the current snapshot, publish, run the consumers."""
    facts = apply_incremental(store.open(), delta, changed, removed, shared_complete)
    snapshot = store.publish(language, facts)
    if consumers:
        consumers.run(snapshot)
    return snapshot
