"""All registered queries by name, and the SQL that answers the same question."""

from __future__ import annotations

from cotejo.plans import queries_boxes, queries_claims, queries_finance, queries_images, queries_more, queries_pdf, queries_text

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (queries_finance, queries_claims, queries_text, queries_pdf, queries_boxes, queries_images, queries_more):
    QUERIES.update(_module.Q)
    ORACLE_SQL.update(_module.SQL)
