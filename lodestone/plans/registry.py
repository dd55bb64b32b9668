"""All queries of the library on the given tables, with their SQL."""

from lodestone.plans import ensembles, entries, files, graphs, molecules, preparation, relational, spatial, text  # noqa: F401
from lodestone.plans.tables import SQL as ORACLE
from lodestone.plans.tables import Q as QUERIES

__all__ = ["ORACLE", "QUERIES"]
