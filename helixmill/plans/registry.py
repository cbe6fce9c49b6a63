"""All queries of the variant engine and their SQL."""

from __future__ import annotations

from helixmill.plans import q_canon, q_evidence, q_match, q_more, q_normalize, q_text, q_vcf
from helixmill.plans.fixtures import with_views

MODULES = (q_vcf, q_text, q_canon, q_match, q_evidence, q_more, q_normalize)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: with_views(sql) for m in MODULES for name, sql in m.SQL.items()}
