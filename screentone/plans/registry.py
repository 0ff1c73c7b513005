"""All registered queries of the library and their SQL."""

from screentone.plans import curve_queries, settings_queries, shape_queries

_MODULES = [shape_queries, curve_queries, settings_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
