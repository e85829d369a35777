"""Named queries over the given tables, and the SQL that each must equal."""

from corpusprov.plans import formats  # noqa: F401  registers its queries
from corpusprov.plans.oracles import oracle_sql
from corpusprov.plans.queries import queries

__all__ = ["oracle_sql", "queries"]
