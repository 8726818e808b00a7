"""The registry of every query outside the removable subpackage."""

from __future__ import annotations

from cosecha.plans import browse_queries, card_queries, catalog_queries, conform_queries, dimension_queries, golden_queries, ingest_queries, merge_queries, observation_queries, price_queries, rule_queries, source_queries, supply_queries, text_queries, workbook_queries
from cosecha.plans.registry import Registry

FAMILIES = (supply_queries, price_queries, catalog_queries, browse_queries, conform_queries, dimension_queries, text_queries, source_queries, golden_queries, card_queries, observation_queries, workbook_queries, merge_queries, ingest_queries, rule_queries)


def build_registry() -> Registry:
    """All queries of the engine, with their oracles."""
    registry = Registry()
    for family in FAMILIES:
        for name, function in family.registry.queries.items():
            registry.add(name, function, family.registry.oracles.get(name))
    return registry
