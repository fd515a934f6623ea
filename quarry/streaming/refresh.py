"""Refreshing a catalog from a stream of source files: rebuild on change, never swap in nothing, old readers keep theirs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import publish


@dataclass
class RefreshState:
    """What happened so far."""

    rounds: int = 0
    swaps: int = 0
    failures: int = 0
    last_error: str = ""


def refresher(table: str, build: Callable[[DataFrame], DataFrame], state: RefreshState) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that publishes a new version of ``table`` from each micro-batch; a failed round leaves the version that is there."""

    def run(batch: DataFrame, _: int) -> None:
        state.rounds += 1
        if batch.isEmpty():
            return
        try:
            publish(build(batch), table)
            state.swaps += 1
        except Exception as e:  # noqa: BLE001  a bad source must not end the loop
            state.failures += 1
            state.last_error = str(e)[:500]

    return run


def changed_sources(batch: DataFrame, key: str = "name", content: str = "content", order: str = "fetched_at") -> DataFrame:
    """The last content of each source of a batch with its digest."""
    return batch.groupBy(key).agg(F.max_by(content, order).alias(content)).withColumn("sha256", F.sha2(content, 256))
