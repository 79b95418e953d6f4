"""All core queries by name, and the SQL that checks them."""

from __future__ import annotations

from astrolith.plans import corpus, problems, relational, units

QUERIES = {**relational.QUERIES, **corpus.QUERIES, **units.QUERIES, **problems.QUERIES}
SQL = {**relational.SQL, **corpus.SQL, **units.SQL, **problems.SQL}

caller_callee_top = corpus.caller_callee_top
