"""All registered queries."""

from __future__ import annotations

from contigloom.plans import catalog_blocks, catalog_files, catalog_graph, catalog_io, catalog_merge, catalog_reads, catalog_sequences, catalog_structure  # noqa: F401
from contigloom.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
