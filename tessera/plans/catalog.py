"""Assembles the registry from the operator modules."""

from __future__ import annotations

from tessera.functions import scalars, udfs
from tessera.operators import aggregates, intervals, joins, recursion, relational, scans, selection, textjoins, vectors, windows
from tessera.plans.registry import Registry
from tessera.sources import files
from tessera.streaming import windows as streams

REGISTRY = Registry()
for module in (relational, recursion, joins, intervals, textjoins, aggregates, selection, vectors, windows, scans, scalars, udfs, files, streams):
    module.register_queries(REGISTRY)
