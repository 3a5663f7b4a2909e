"""All registered queries of the core and their SQL."""

from __future__ import annotations

from kinolith.plans import audits, branches, checks, curation, evidence, evidence_sql, formats, ingest, retrieval, rules, streams, timeline

CATALOGS = [retrieval.CATALOG, timeline.CATALOG, ingest.CATALOG, streams.CATALOG, checks.CATALOG, audits.CATALOG, rules.CATALOG, curation.CATALOG, formats.CATALOG, branches.CATALOG]


def flagship(spark, d):
    return retrieval.hybrid_rrf(spark, d)


def queries() -> dict:
    return evidence.queries() | {k: f for m in CATALOGS for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return evidence_sql.SQL | {k: s for m in CATALOGS for k, s in m.SQL.items()}
