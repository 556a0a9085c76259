"""The catalogue: named queries over the driver's tables, each with its DuckDB twin where SQL can express it."""

from . import evaluation, files, fitting, learning, manifests, memory, plans_reports, probing, rag_memory, ranking, records, summaries, text

MODULES = (evaluation, ranking, text, rag_memory, plans_reports, records, manifests, memory, fitting, summaries, probing, files, learning)
QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
