"""The queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thicket.operators import cluster, converge, drafts, history, provenance, references, routing, scalars, similarity, snapshots, tree, union, validate
from thicket.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _three(fn):
    return lambda s, d: fn(table(s, d, "leaf"), table(s, d, "index_page"), table(s, d, "leaf_removal"))


QUERIES: dict[str, Query] = {
    "p3_found": _three(references.orphans),
    "p3_report": _three(references.orphan_report),
    "p4_found": lambda s, d: snapshots.snapshot_changes(table(s, d, "source_snapshot")),
    "p4_counts": lambda s, d: snapshots.change_counts(table(s, d, "source_snapshot")),
}
SQL: dict[str, str] = {
    "p3_found": references.ORPHANS_SQL,
    "p3_report": references.REPORT_SQL,
    "p4_found": snapshots.CHANGES_SQL,
    "p4_counts": snapshots.COUNTS_SQL,
}

for _module in (similarity, drafts, validate, provenance, tree, routing, union, cluster, history, converge, scalars):
    QUERIES |= _module.queries()
    SQL |= _module.SQL
