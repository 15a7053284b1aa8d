"""Incremental refresh of derived tables from the change feeds of their sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.store import Store, merge_hash_guarded

WATERMARKS, STATS = "ops.watermarks", "ops.refresh_stats"
FULL, INCREMENTAL = "full", "incremental"
Mapping = Callable[[DataFrame], DataFrame]


@dataclass
class Plan:
    """How a target will be refreshed, why, up to which version of each source, and the changes if incremental."""

    mode: str
    reason: str
    versions: dict[str, int]
    changes: dict[str, DataFrame] = field(default_factory=dict)


def watermarks(store: Store, target: str) -> dict[str, int]:
    """The version of each source that a target was last refreshed to."""
    if not store.exists(WATERMARKS):
        return {}
    return {r["source"]: r["version"] for r in store.read(WATERMARKS).where(F.col("target") == target).collect()}


def save_watermarks(store: Store, target: str, versions: dict[str, int]) -> None:
    rows = store.spark.createDataFrame([(target, s, v) for s, v in sorted(versions.items())], "target string, source string, version int")
    store.ensure(WATERMARKS, rows.schema, ["target", "source"])
    store.merge(WATERMARKS, rows, ["target", "source"])


def plan(store: Store, target: str, sources: list[str], full: bool = False) -> Plan:
    """Fixes the sources' versions first, so that what comes in meanwhile belongs to the next run; then decides.

    Full if asked for, if the target isn't there, if a source has no watermark, or if its change feed can't be read.
    """
    versions = {s: store.version(s) for s in sources}
    if full:
        return Plan(FULL, "asked for", versions)
    if not store.exists(target):
        return Plan(FULL, "no target yet", versions)
    done = watermarks(store, target)
    lacking = sorted(set(sources) - set(done))
    if lacking:
        return Plan(FULL, f"no watermark for {', '.join(lacking)}", versions)
    for s in sources:
        if not store.readable_changes(s, done[s], versions[s]):
            return Plan(FULL, f"the changes of {s} can't be read", versions)
    return Plan(INCREMENTAL, "change feeds", versions, {s: store.changes(s, done[s], versions[s]) for s in sources if versions[s] > done[s]})


def changed_ids(plan_: Plan, mapping: dict[str, Mapping]) -> DataFrame | None:
    """The distinct ids of target rows that a plan's changes concern; None for a full refresh. Before- and after-images
    both count, so that an id a row moved away from is refreshed too."""
    if plan_.mode == FULL:
        return None
    parts = [mapping[s](c) for s, c in plan_.changes.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct() if parts else None


def only(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows of the changed ids, all for None. A semi-join; the session's threshold decides whether ids are broadcast."""
    return rows if ids is None else rows.join(ids, ids.columns, "left_semi")


def merge_rebuilt(store: Store, name: str, hashed: DataFrame, keys: list[str], changed: DataFrame | None) -> None:
    """Merges rows built anew for the changed ids (None: all) by their hash; rows of these ids that are no more are deleted."""
    merge_hash_guarded(store, name, hashed, keys, delete_missing=changed is None)
    if changed is not None:
        gone = only(store.read(name), changed).select(keys).join(hashed.select(keys), keys, "left_anti")
        if not gone.isEmpty():
            store.delete(name, gone)


def refresh(store: Store, target: str, sources: list[str], mapping: dict[str, Mapping], build_and_merge: Callable[[DataFrame | None], None], full: bool = False, total: Callable[[], DataFrame] | None = None) -> Plan:
    """Plans, builds and merges, and only then moves the watermarks: a failed run starts again with the same changes.
    Without any change nothing is built and the watermarks still move. ``total`` gives the ids there are, for the statistics:
    how many of them were processed."""
    p = plan(store, target, sources, full)
    ids = changed_ids(p, mapping)
    count = -1
    if p.mode == INCREMENTAL:
        if ids is not None:
            ids = ids.persist()
            count = ids.count()
        else:
            count = 0
    if count != 0:
        build_and_merge(ids)
    if ids is not None:
        ids.unpersist()
    save_watermarks(store, target, p.versions)
    every = total().distinct().count() if total else -1
    stats = store.spark.createDataFrame([(target, p.mode, p.reason, count, every if count < 0 else count, every)], "target string, mode string, reason string, changed_ids bigint, processed_ids bigint, total_ids bigint")
    store.append(STATS, stats)
    return p
