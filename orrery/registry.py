"""Every query of the engine by name, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from orrery.functions import models, text, udfs
from orrery.operators import agents, approximate, cache, graph, inverted, items, lexical, lookup, metrics, mining, profile, prompts, rank, relational, similarity, stats, traces, vectors
from orrery.plans import agents as agent_plans
from orrery.plans import evaluation, service, serving
from orrery.sources import offsets
from orrery.streaming import caches, telemetry, windows

MODULES = (vectors, similarity, text, metrics, rank, stats, lexical, lookup, prompts, mining, traces, relational, agents, items, cache, approximate, inverted, graph, udfs, windows, caches, telemetry, evaluation, models, agent_plans, serving, service, offsets, profile)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
