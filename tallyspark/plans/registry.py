"""Every query over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from . import audits, cards, catalog, contexts, decisions, evaluation, evidence, forecasts, history, imports, markets, models, reads, refresh, relational, text

MODULES = (relational, history, markets, evaluation, text, evidence, models, refresh, catalog, decisions, forecasts, contexts, reads, audits, imports, cards)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
