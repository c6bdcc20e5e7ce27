"""All queries of the engine by name, with their SQL."""

from terraloom.plans import checks, fits, geometry, joins, lists, relational

_MODULES = (geometry, relational, joins, checks, lists, fits)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
