"""Every registered query and the SQL that gives the same rows."""

from lodestone.plans import code_queries, table_queries, view_queries  # noqa: F401 - view queries add themselves to the table queries

QUERIES: dict = {**table_queries.QUERIES, **code_queries.QUERIES}
ORACLES: dict = {**table_queries.ORACLES, **code_queries.ORACLES}
