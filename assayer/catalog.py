"""All queries on the driver's tables by name, with their DuckDB SQL."""

from __future__ import annotations

from assayer.plans import exams, ledger, marking, pages, paper, scoring, services

QUERIES = scoring.QUERIES | ledger.QUERIES | paper.QUERIES | marking.QUERIES | exams.QUERIES | pages.QUERIES | services.QUERIES
ORACLE_SQL = scoring.SQL | ledger.SQL | paper.SQL | marking.SQL | exams.SQL | pages.SQL | services.SQL
