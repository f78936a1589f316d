"""All queries and their SQL."""

from ratersight.plans import models, roundtrips, totals  # noqa: F401  they register theirs
from ratersight.plans.roster import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
