"""All queries of the core with their SQL."""

from __future__ import annotations

from pramana.plans import boundary, catalogue, chains, curation, exact, programs, quality, reports  # noqa: F401  they add to the catalogue

QUERIES, SQL = catalogue.QUERIES, catalogue.SQL
