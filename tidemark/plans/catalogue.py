"""All queries of the core by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.plans import boards, geography, postings, problems, reference

QUERIES = {name: getattr(problems, name) for name in dir(problems) if name[0] == "p" and name[1:2].isdigit()} | reference.QUERIES | postings.QUERIES | boards.QUERIES | geography.QUERIES
ORACLES: dict[str, str] = reference.SQL | postings.SQL | boards.SQL | geography.SQL
