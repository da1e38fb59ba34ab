"""All registered queries of the engine: name to (spark, sf_dir) callable, and name to equivalent SQL."""

from __future__ import annotations

from tessera.plans import catalogue, clones, cohort, discrimination, estimation, generation, graph, head, policy, ranking, readouts, survival, verification
from tessera.streaming import events

_MODULES = (survival, cohort, graph, clones, ranking, discrimination, estimation, generation, head, policy, readouts, catalogue, verification, events)
FLAGSHIP = estimation.emulation_table
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
